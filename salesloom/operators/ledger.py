"""Data-quality ledger: one row per rule, with a bounded sample of row names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from salesloom import contracts as C
from salesloom.functions.scalars import count_if

LEDGER_COLUMNS = ["code", "rule_name", "severity", "description", "affected_count", "resolution",
                  "sample_identifiers"]


def rule_samples(df: DataFrame, rules: dict[str, Column], name: Column, copies: dict[str, Column] | None = None) -> DataFrame:
    """Up to five smallest row names per rule; copies: for which rules a row stands for so many.

    The row limit per rule is applied inside every task before the shuffle, so a
    rule that hits a third of all rows still sends only a handful of them.
    """
    times = lambda code: F.least((copies or {}).get(code, F.lit(1)), F.lit(C.DQ_SAMPLE_SIZE)).cast("int")
    hits = F.flatten(F.array(*[F.array_repeat(F.lit(code), F.when(F.coalesce(cond, F.lit(False)), times(code)).otherwise(0))
                               for code, cond in rules.items()]))
    flagged = df.select(F.explode(hits).alias("code"), name.cast("string").alias("sample"))
    order = W.partitionBy("code").orderBy("sample")
    few = flagged.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= C.DQ_SAMPLE_SIZE)
    return few.groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "sample"))),
                                               lambda s: s["sample"]).alias("sample_identifiers"))


def rule_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One pass over the rows: (code, affected_count) for every rule, zero included."""
    totals = df.agg(*[count_if(cond).alias(code) for code, cond in rules.items()])
    return counts_to_rows(totals, list(rules))


def counts_to_rows(totals: DataFrame, codes: list[str]) -> DataFrame:
    return totals.select(F.inline(F.array(*[
        F.struct(F.lit(code).alias("code"), F.col(code).cast("long").alias("affected_count")) for code in codes])))


def build_ledger(counts: DataFrame, samples: DataFrame, descriptions: DataFrame | None = None) -> DataFrame:
    """Attach names, severities and samples. Every side has at most one row per rule."""
    rule = lambda i: F.try_element_at(
        F.create_map(*[F.lit(x) for code, row in C.DQ_RULES.items() for x in (code, row[i])]), F.col("code"))
    ledger = counts.join(samples, "code", "left")
    if descriptions is not None:
        ledger = ledger.join(descriptions, "code", "left")
        description = F.coalesce(F.col("found_description"), rule(2))
    else:
        description = rule(2)
    return ledger.select(
        "code", rule(0).alias("rule_name"), rule(1).alias("severity"), description.alias("description"),
        "affected_count", rule(3).alias("resolution"),
        F.coalesce(F.col("sample_identifiers"), F.array().cast("array<string>")).alias("sample_identifiers"),
    )


def export_view(ledger: DataFrame) -> DataFrame:
    """The ledger under its display headers, samples as one text."""
    samples = F.concat_ws(", ", F.slice("sample_identifiers", 1, C.DQ_SAMPLE_SIZE))
    return ledger.select([(samples if c == "sample_identifiers" else F.col(c)).alias(title)
                          for c, title in C.DQ_EXPORT_HEADERS.items()])


def export_csv(ledger: DataFrame, path: str) -> str:
    """Write the display view, at most one row per rule, as CSV with a header."""
    export_view(ledger).orderBy("DQ Code").write.mode("overwrite").option("header", True).csv(path)
    return path
