"""Keyword rules over a table of questions: policy, period, sector, task, route, carry-over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from salesloom import contracts as C
from salesloom.functions.scalars import contains_any, strip
from salesloom.operators.carry import first_since_reset



def _first_match(text: Column, rules: list[tuple[list[str], str]]) -> Column:
    chain = None
    for words, result in rules:
        hit = contains_any(text, words)
        chain = F.when(hit, result) if chain is None else chain.when(hit, result)
    return chain


def with_lowered(questions: DataFrame, column: str = "question") -> DataFrame:
    return questions.withColumn("_q", F.lower(strip(F.coalesce(F.col(column), F.lit("")))))


def policy_flags(questions: DataFrame, column: str = "question") -> DataFrame:
    """Refused (prompt override, bulk export) and out-of-scope questions."""
    q = F.col("_q")
    return with_lowered(questions, column).withColumns({
        "refused": contains_any(q, C.REFUSAL_TERMS), "out_of_scope": contains_any(q, C.OUT_OF_SCOPE_TERMS)}).drop("_q")


def own_period(q: Column) -> Column:
    return _first_match(q, C.QUESTION_PERIODS)


def own_sector(q: Column) -> Column:
    """Sector of the first listed keyword that occurs."""
    return _first_match(q, [([word], sector) for word, sector in C.QUESTION_SECTORS])


def task_of(q: Column) -> Column:
    return F.coalesce(_first_match(q, [(words, task) for task, words in C.TASK_TERMS]), F.lit(C.DEFAULT_TASK))


def understand(questions: DataFrame, column: str = "question") -> DataFrame:
    """Policy flags, own period, deal type, sector, task and the intent derived from them."""
    q = F.col("_q")
    df = with_lowered(questions, column).withColumns({
        "refused": contains_any(q, C.REFUSAL_TERMS),
        "out_of_scope": contains_any(q, C.OUT_OF_SCOPE_TERMS),
        "own_period": own_period(q),
        "deal_type": F.when(contains_any(q, C.DEAL_TYPE_TERMS), "Tender"),
        "sector": own_sector(q),
        "task": task_of(q),
        "top_n": F.when(contains_any(q, C.TOP_ONE_TERMS), 1).otherwise(5),
    })
    return df.withColumns({
        "group_by": F.when(F.col("task") == "rank", "sector"),
        "need_chart": F.col("task").isin(C.CHART_TASKS),
    }).drop("_q")


def is_follow_up(q: Column) -> Column:
    """Starts like a follow-up or is very short, and names no period itself."""
    opener = None
    for start in C.FOLLOW_UP_OPENERS:
        opener = q.startswith(start) if opener is None else opener | q.startswith(start)
    words = F.size(F.filter(F.split(q, r"\s+"), lambda w: w != ""))
    return (opener | (words <= C.FOLLOW_UP_MAX_WORDS)) & ~contains_any(q, C.EXPLICIT_PERIOD_TOKENS)


def carry_period(understood: DataFrame, session: str = "session_id", turn: str = "turn",
                 column: str = "question") -> DataFrame:
    """Period of each turn, inherited along follow-ups of a session.

    Refused and out-of-scope turns neither reset nor hand on a period.
    """
    df = with_lowered(understood, column)
    df = df.withColumns({"_follow": is_follow_up(F.col("_q")),
                         "_in_scope": ~F.col("refused") & ~F.col("out_of_scope")})
    carried = first_since_reset(df, session, turn, F.col("_in_scope") & ~F.col("_follow"),
                                F.when(F.col("_in_scope"), F.col("own_period")), "_carried")
    period = F.when(F.col("_follow"), F.coalesce("_carried", "own_period")).otherwise(F.col("own_period"))
    return carried.withColumn("period", period).drop("_q", "_follow", "_in_scope", "_carried")


def route(understood: DataFrame, column: str = "question", period: str = "own_period") -> DataFrame:
    """Tool and arguments by the first rule that fits."""
    q = F.col("_q")
    df = with_lowered(understood, column)

    def arguments(rule: dict) -> Column:
        pairs = [F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in rule.get("args", {}).items()]
        if "top_one" in rule:
            pairs.append(F.struct(F.lit("top_n").alias("k"),
                                  F.when(contains_any(q, rule["top_one"]), "1").alias("v")))
        for name in rule.get("pass", []):
            pairs.append(F.struct(F.lit(name).alias("k"),
                                  F.col(period if name == "period" else name).alias("v")))
        if not pairs:
            return F.create_map().cast("map<string,string>")
        return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["v"].isNotNull()))

    number = None
    for i, rule in enumerate(C.ROUTES):
        hit = F.col("sector").isNotNull() if rule.get("needs_sector") else F.lit(True)
        for words in rule["any"]:
            hit = hit & contains_any(q, words)
        number = F.when(hit, i) if number is None else number.when(hit, i)
    df = df.withColumn("_rule", number.otherwise(len(C.ROUTES)))
    rules = [*C.ROUTES, C.DEFAULT_ROUTE]
    tool = F.get(F.array(*[F.lit(r["tool"]) for r in rules]), F.col("_rule"))
    args = None
    for i, rule in enumerate(rules):
        if any(k in rule for k in ("args", "pass")):
            hit = F.col("_rule") == i
            args = F.when(hit, arguments(rule)) if args is None else args.when(hit, arguments(rule))
    return df.withColumns({"tool": tool, "args": args.otherwise(F.create_map().cast("map<string,string>"))}
                          ).drop("_q", "_rule")


def args_text(args: Column) -> Column:
    """Arguments as sorted text, equal for equal maps."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(args)),
                                    lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def ambiguity_hits(questions: DataFrame, column: str = "question") -> DataFrame:
    """Ambiguous words in each question with the question to ask back. Row-local: four terms."""
    terms = F.array(*[F.struct(F.lit(term).alias("term"), F.lit(row[0]).alias("detected_intent"),
                               F.lit(row[1]).alias("clarifying_question"),
                               F.array(*[F.lit(o) for o in row[2]]).alias("options"))
                      for term, row in C.AMBIGUOUS_TERMS.items()])
    hits = with_lowered(questions, column).withColumn(
        "_hit", F.explode(F.filter(terms, lambda t: F.contains(F.col("_q"), t["term"]))))
    return hits.select(*questions.columns, "_hit.*")
