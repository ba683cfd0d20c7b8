"""Receipts, expectation checks and audits over tables of runs and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from salesloom.functions.scalars import count_if, percent


def confidence(runs: DataFrame) -> DataFrame:
    """Level and reasons of every run.

    Columns read: considered, used, missing_key_field, is_snapshot_stale, single_entity_share_pct,
    cross_board_link_coverage_pct (may be null), verifier_fallback.
    """
    considered = F.col("considered")
    share = lambda part: F.when(considered > 0, part / considered).otherwise(0.0)
    df = runs.withColumns({"_excluded": share(considered - F.col("used")), "_missing": share(F.col("missing_key_field"))})
    one_digit = lambda c: F.format_string("%.1f", F.round(c, 1))
    reason = lambda cond, *parts: F.when(F.coalesce(cond, F.lit(False)), F.concat(*parts))
    low = F.array_compact(F.array(
        reason(F.col("_excluded") > 0.5, F.lit(">50% of candidate records excluded ("),
               one_digit(F.col("_excluded") * 100), F.lit("%)")),
        reason(F.col("single_entity_share_pct") > 50, F.lit("Single entity concentration exceeds 50% ("),
               one_digit(F.col("single_entity_share_pct")), F.lit("%)")),
        reason(F.col("cross_board_link_coverage_pct") < 50, F.lit("Cross-board linkage feasibility under 50% ("),
               one_digit(F.col("cross_board_link_coverage_pct")), F.lit("%)")),
        reason(F.col("verifier_fallback"), F.lit("Verifier fallback to deterministic template invoked"))))
    medium = F.array_compact(F.array(
        reason((F.col("_excluded") > 0.2) | (F.col("_missing") > 0.2),
               F.lit("Over 20% of records excluded or missing analytical fields")),
        reason(F.col("is_snapshot_stale"), F.lit("Underlying data snapshot exceeds TTL freshness threshold"))))
    df = df.withColumns({"_low": low, "_medium": medium})
    is_low, is_medium = F.size("_low") > 0, F.size("_medium") > 0
    return df.withColumns({
        "confidence": F.when(is_low, "low").when(is_medium, "medium").otherwise("high"),
        "confidence_reasons": F.when(is_low, F.col("_low")).otherwise(F.col("_medium")),
    }).drop("_excluded", "_missing", "_low", "_medium")


def query_hash(tool: Column, sql: Column, params: Column) -> Column:
    """First 16 hex digits of SHA-256 over tool, statement and parameters."""
    return F.substring(F.sha2(F.concat(tool, sql, F.coalesce(params, F.lit(""))), 256), 1, 16)


def row_accounting(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows considered, excluded by each rule (the first that hits), and used."""
    first = None
    for name, cond in rules.items():
        hit = F.coalesce(cond, F.lit(False))
        first = F.when(hit, name) if first is None else first.when(hit, name)
    counted = df.groupBy(first.otherwise("used").alias("outcome")).agg(F.count(F.lit(1)).alias("rows"))
    return counted


def concentration(rows: DataFrame, entity: str, value: str) -> DataFrame:
    """single_entity_share_pct: what part of all positive value the largest entity holds, in one row.

    Summed by entity first, so a hot entity is one row before it meets the others. Rows without an entity or a value hold
    nothing; 0 where nothing is held.
    """
    held = F.when(F.col(entity).isNotNull() & (F.col(value) > 0), F.col(value)).cast("decimal(28,2)")
    sums = rows.groupBy(entity).agg(F.sum(held).alias("_held"))
    share = percent(F.max("_held").cast("double"), F.sum("_held").cast("double"), 1)
    return sums.agg(F.coalesce(share, F.lit(0.0)).alias("single_entity_share_pct"))


def receipt_inputs(counted: DataFrame, rows: DataFrame, entity: str, value: str, needed: Column, coverage: DataFrame | None = None,
                   stale: bool = False, fallback: bool = False) -> DataFrame:
    """What the confidence of a tool run rests on, in one row.

    counted: (considered, used) of the run; rows: those it reads; needed: true where a row has the field the tool needs;
    coverage: match_rate_pct of the boards, for tools that read both. All frames have one row.
    """
    missing = rows.agg(count_if(~F.coalesce(needed, F.lit(False))).alias("missing_key_field"))
    link = (F.lit(None).cast("double") if coverage is None else F.col("match_rate_pct")).alias("cross_board_link_coverage_pct")
    joined = counted.crossJoin(F.broadcast(missing)).crossJoin(F.broadcast(concentration(rows, entity, value)))
    if coverage is not None:
        joined = joined.crossJoin(F.broadcast(coverage.select("match_rate_pct")))
    return joined.select("considered", "used", "missing_key_field", "single_entity_share_pct", link,
                         F.lit(stale).alias("is_snapshot_stale"), F.lit(fallback).alias("verifier_fallback"))


def receipt(inputs: DataFrame, tool: str, statement: str, params: str | None, as_of) -> DataFrame:
    """One audit row for a tool run, from the row of `receipt_inputs`."""
    return confidence(inputs).select(
        F.lit(tool).alias("tool_name"),
        query_hash(F.lit(tool), F.lit(statement), F.lit(params).cast("string")).alias("query_hash"),
        "considered", "used", "missing_key_field", "single_entity_share_pct", "cross_board_link_coverage_pct",
        F.lit(str(as_of)).alias("as_of_date"), F.lit(True).alias("deterministic"), "confidence", "confidence_reasons")


def check_expectations(actual: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Actual against expected: tolerance, bounds and keywords; a missing result fails.

    Expected has expected, tolerance_abs, min_value, max_value (any may be null) and keywords.
    """
    joined = expected.join(actual, keys, "left")
    optional = lambda cond: F.coalesce(cond, F.lit(True))
    value = F.col("value")
    answer = F.lower(F.coalesce("answer", F.lit("")))
    passed = (value.isNotNull()
              & optional(F.abs(value - F.col("expected")) <= F.col("tolerance_abs"))
              & optional(value >= F.col("min_value")) & optional(value <= F.col("max_value"))
              & F.forall(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: F.contains(answer, k)))
    return joined.withColumn("passed", passed)


def expectation_summary(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count(F.lit(1)).alias("total"), count_if(F.col("passed")).alias("passed"),
                       F.round(F.avg("duration_ms"), 2).alias("avg_latency_ms")).withColumn(
        "pass_rate", percent(F.col("passed"), F.col("total"), 1))


# ---------------------------------------------------------------- answer audit

def last_answers(log: DataFrame) -> DataFrame:
    """The last non-blank answer of each question text."""
    newest = log.groupBy("question").agg(F.max_by("answer", "seq").alias("answer"))
    return newest.withColumn("answer", F.btrim("answer")).filter(F.col("answer") != "")


def identical_answers(log: DataFrame) -> DataFrame:
    """Answers given to more than one question, with how many pairs that makes.

    Pairs are counted per group, never listed: a group of n questions has n(n-1)/2.
    """
    groups = last_answers(log).groupBy("answer").agg(
        F.count(F.lit(1)).alias("questions"), F.min("question").alias("first_question"),
        F.max("question").alias("last_question"))
    many = groups.filter(F.col("questions") > 1)
    return many.withColumn("pairs", F.expr("questions * (questions - 1) div 2"))


def answer_audit(log: DataFrame, template: str = "template") -> DataFrame:
    """Template rate, distinct (tool, arguments) and identical pairs in one row."""
    head = log.agg(F.count(F.lit(1)).alias("total_questions"),
                   count_if(F.col("source") == template).alias("template_answers"),
                   F.count_distinct(F.struct("tool", "args")).alias("distinct_tool_args"))
    pairs = identical_answers(log).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("identical_pairs"))
    return head.crossJoin(pairs).withColumn(
        "template_rate", percent(F.col("template_answers"), F.col("total_questions"), 1))


def routing_accuracy(routed: DataFrame, labels: DataFrame, by: str = "group") -> DataFrame:
    """Expected against found tool, task and arguments per group. Labels are a small fixed set."""
    both = routed.join(F.broadcast(labels), "label_id")
    args_ok = F.forall(F.map_entries("expected_args"), lambda e: F.coalesce(
        F.try_element_at(F.col("args"), e["key"]) == e["value"], F.lit(False)))
    return both.groupBy(by).agg(
        F.count(F.lit(1)).alias("questions"),
        count_if(F.col("tool") == F.col("expected_tool")).alias("tool_hits"),
        count_if(F.col("task") == F.col("expected_task")).alias("task_hits"),
        count_if(args_ok).alias("args_hits")).withColumn(
        "tool_accuracy_pct", percent(F.col("tool_hits"), F.col("questions")))


def contract_violations(facts: DataFrame, durations: DataFrame | None = None, limit_ms: float = 250.0) -> DataFrame:
    """Tools whose facts break the contract: none at all, bad id, no metric, no display, or too slow."""
    bad = ~F.col("id").startswith("F") | F.col("metric").isNull() | F.col("display").isNull()
    checked = facts.groupBy("tool").agg(F.count("id").alias("facts"),
                                        count_if(F.col("id").isNotNull() & bad).alias("bad_facts"))
    if durations is not None:
        checked = checked.join(durations, "tool", "left").withColumn("too_slow", F.col("duration_ms") >= limit_ms)
    return checked.withColumn("ok", (F.col("facts") > 0) & (F.col("bad_facts") == 0))
