"""Checking written answers against computed facts.

Answers: (answer_id, question, draft, top_n). Facts: (answer_id, id, value_double, display, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from salesloom import contracts as C

ANSWER = "answer_id"


# ---------------------------------------------------------------- numbers that may be claimed

def scaled(value: Column) -> Column:
    """A number and the ways it may be written: rounded, in crore or lakh, as share or percentage."""
    r = lambda v, d: F.round(v, d)
    forms = [value, r(value, 2), r(value, 1)]
    for unit in (1e7, 1e5):
        forms += [F.when(value >= 100_000, r(value / unit, d)) for d in (2, 1)]
    forms += [F.when(value.between(0, 100), r(value / 100, d)) for d in (2, 3, 4)]
    forms += [F.when(value.between(0, 1), r(value * 100, d)) for d in (1, 2)]
    return F.array_distinct(F.array_compact(F.array(*forms)))


def numbers_in(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"({C.NUMBER})"), F.lit(1)), lambda s: s.try_cast("double"))


def truth_numbers(facts: DataFrame, cells: DataFrame | None = None, notes: DataFrame | None = None) -> DataFrame:
    """Distinct (answer_id, truth) from fact values, table cells (answer_id, value) and note texts (answer_id, text)."""
    values = facts.filter("value_double IS NOT NULL").select(ANSWER, F.col("value_double").alias("v"))
    if cells is not None:
        values = values.unionByName(cells.select(ANSWER, F.col("value").cast("double").alias("v")).filter("v IS NOT NULL"))
    if notes is not None:
        values = values.unionByName(notes.select(ANSWER, F.explode(numbers_in(F.col("text"))).alias("v")))
    return values.select(ANSWER, F.explode(scaled(F.col("v"))).alias("truth")).distinct()


def allowed_by_question(answers: DataFrame) -> DataFrame:
    """Numbers named in the question, and top_n, count as known too."""
    asked = numbers_in(F.replace(F.coalesce("question", F.lit("")), F.lit(","), F.lit("")))
    top = F.array_compact(F.array(F.col("top_n").cast("double")))
    return answers.select(ANSWER, F.explode(F.concat(asked, top)).alias("truth"))


# ---------------------------------------------------------------- what the draft says

def citations(answers: DataFrame, facts: DataFrame) -> DataFrame:
    """Every [[F#]] of a draft with its place and whether that fact exists."""
    return with_evidence(answers, facts, facts.sparkSession.createDataFrame([], TRUTHS)).select(ANSWER, F.inline("_cited"))


def masked(draft: Column) -> Column:
    """The draft without labels that are no claims: dates, codes, quarters, ordinals, years."""
    for pattern in C.NON_CLAIMS:
        draft = F.regexp_replace(draft, pattern, C.NON_CLAIM_MARK)
    return draft


def claims(answers: DataFrame) -> DataFrame:
    """Distinct claims: (answer_id, kind, span, number). Kind 'bare' is a number outside every pattern's span."""
    found = answers.select(ANSWER, F.inline(claimed_spans(F.col("draft"))))
    return found.select(ANSWER, "kind", "span", F.explode(numbers_of_span(F.col("span"))).alias("number")).distinct()


def claimed_spans(draft: Column) -> Column:
    """(kind, span) of every claim in a draft."""
    def spans(kind: str, text: Column, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)),
                           lambda s: F.struct(F.lit(kind).alias("kind"), F.btrim(s).alias("span")))

    def every(text: Column) -> Column:
        found = [spans(kind, text, pattern) for kind, pattern in C.CLAIMS.items()]
        found.append(spans("bare", F.regexp_replace(text, C.BARE_NUMBER_NOISE, ""), C.NUMBER))
        return F.flatten(F.array(*found))

    return F.transform(F.array(masked(draft)), every)[0]


def numbers_of_span(span: Column) -> Column:
    return numbers_in(F.replace(span, F.lit(","), F.lit("")))


# ---------------------------------------------------------------- grounding

TRUTHS = f"{ANSWER} long, truth double"
#: What rounding may add to the bounds between which a match can lie.
SLACK = 1e-9


def first_at_least(values: Column, bound: Column) -> Column:
    """Place of the first element of a sorted array that is not below the bound, by binary search."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1)).cast("int"))
    start = F.struct(F.lit(0).alias("low"), F.size(values).alias("high"))

    def step(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["low"] + s["high"], 1)
        open_ = s["low"] < s["high"]
        below = open_ & (F.get(values, middle) < bound)
        return F.struct(F.when(below, middle + 1).otherwise(s["low"]).alias("low"),
                        F.when(open_ & ~below, middle).otherwise(s["high"]).alias("high"))

    return F.aggregate(steps, start, step, lambda s: s["low"])


def close(n: Column, g: Column) -> Column:
    return (F.abs(n - g) < C.MATCH_ABSOLUTE) | ((g != 0) & (F.abs(n - g) < C.MATCH_RELATIVE * F.abs(g)))


def is_grounded(n: Column, known: Column) -> Column:
    """Is there a number within tolerance in the sorted array? Claimed numbers are never negative.

    Matches lie between two bounds; between their places the first exact match ends the search.
    """
    low = F.least(n - C.MATCH_ABSOLUTE, n / (1 + C.MATCH_RELATIVE)) * (1 - SLACK) - SLACK
    high = F.greatest(n + C.MATCH_ABSOLUTE, n / (1 - C.MATCH_RELATIVE)) * (1 + SLACK) + SLACK
    first, after = first_at_least(known, low), first_at_least(known, high)
    return F.exists(F.slice(known, first + 1, F.greatest(after - first, F.lit(0))), lambda g: close(n, g))


def grounded(claimed: DataFrame, truths: DataFrame) -> DataFrame:
    """Distinct (answer_id, number) with a known number of their answer within tolerance."""
    known = truths.groupBy(ANSWER).agg(F.array_sort(F.collect_set("truth")).alias("_known"))
    found = claimed.select(ANSWER, "number").distinct().join(known, ANSWER)
    return found.filter(is_grounded(F.col("number"), F.col("_known"))).select(ANSWER, "number")


def with_evidence(answers: DataFrame, facts: DataFrame, truths: DataFrame | None = None) -> DataFrame:
    """answers with _numbers, the distinct claimed numbers with grounded and allowed, and _cited, their references.

    Facts are gathered once per answer, their numbers in all spellings as one sorted array; every claim is then looked up
    in its own row. An answer's facts are the few its tool defines, or the truths given instead of them. One row per answer.
    """
    known = facts.groupBy(ANSWER).agg(F.collect_set("id").alias("_ids"), F.collect_set("value_double").alias("_values"))
    spelled = F.flatten(F.transform(F.coalesce("_values", F.array().cast("array<double>")), scaled))
    df = answers.join(known, ANSWER, "left")
    if truths is not None:
        given = truths.groupBy(ANSWER).agg(F.collect_set("truth").alias("_truths"))
        df = df.join(given, ANSWER, "left")
        spelled = F.coalesce("_truths", F.array().cast("array<double>"))
    asked = numbers_in(F.replace(F.coalesce("question", F.lit("")), F.lit(","), F.lit("")))
    every = F.concat(spelled, asked, F.array(F.col("top_n").cast("double")))
    claimed = F.array_distinct(F.array_compact(F.flatten(F.transform(
        claimed_spans(F.col("draft")), lambda s: numbers_of_span(s["span"])))))
    cited = F.regexp_extract_all("draft", F.lit(C.FACT_REFERENCE), F.lit(1))
    ids = F.coalesce("_ids", F.array().cast("array<string>"))
    df = df.withColumns({"_known": F.array_sort(F.array_distinct(F.array_compact(every))), "_claimed": claimed})
    numerals = [float(x) for x in C.ALLOWED_NUMERALS]
    return df.withColumns({
        "_numbers": F.transform("_claimed", lambda n: F.struct(
            n.alias("number"), is_grounded(n, F.col("_known")).alias("grounded"), n.isin(numerals).alias("allowed"))),
        "_cited": F.transform(cited, lambda c, i: F.struct(
            i.alias("position"), c.alias("id"), F.array_contains(ids, c).alias("valid"))),
    }).drop("_ids", "_values", "_truths", "_known", "_claimed")


def judged_numbers(answers: DataFrame, facts: DataFrame, truths: DataFrame | None = None) -> DataFrame:
    """Distinct numbers of each answer: grounded, allowed anyway, or neither."""
    return with_evidence(answers, facts, truths).select(ANSWER, F.inline("_numbers"))


def ungrounded_claims(answers: DataFrame, facts: DataFrame) -> DataFrame:
    return judged_numbers(answers, facts).filter("NOT grounded AND NOT allowed").select(ANSWER, "number")


def verdicts(answers: DataFrame, facts: DataFrame, truths: DataFrame | None = None) -> DataFrame:
    """Per answer: verified or not, confidence, grounded items, bad numbers, invalid references."""
    many = lambda of, test: F.coalesce(F.size(F.filter(of, test)), F.lit(0)).cast("long")
    df = with_evidence(answers, facts, truths).withColumns({
        "_grounded": many("_numbers", lambda n: n["grounded"]),
        "bad_numbers": many("_numbers", lambda n: ~n["grounded"] & ~n["allowed"]),
        "valid_citations": many("_cited", lambda c: c["valid"]),
        "invalid_citations": many("_cited", lambda c: ~c["valid"])}).drop("_numbers", "_cited")
    bad, invalid = F.col("bad_numbers"), F.col("invalid_citations")
    exact = lambda text: F.lit(text).cast("decimal(4,2)")
    penalty = bad.cast("decimal(18,0)") * exact("0.15") + invalid.cast("decimal(18,0)") * exact("0.20")
    return df.withColumns({
        "verified": (bad == 0) & (invalid == 0),
        "confidence": F.greatest(F.lit(0.4), F.round(exact("1.00") - penalty, 2).cast("double")),
        "facts_grounded": F.col("valid_citations") + F.col("_grounded"),
    }).drop("_grounded")


# ---------------------------------------------------------------- writing

def facts_by_answer(facts: DataFrame) -> DataFrame:
    """The facts of an answer in fact order, as one array. An answer has the few facts its tool defines."""
    number = F.substring("id", 2, 9).try_cast("int").alias("n")
    fact = F.struct(number, "id", "label", "display", "role", "must_mention")
    return facts.groupBy(ANSWER).agg(F.array_sort(F.collect_list(fact)).alias("_facts"))


def fill_references(text: Column, facts: Column) -> Column:
    """Replace [[F#]] by the display of that fact."""
    return F.reduce(facts, text, lambda t, f: F.replace(
        t, F.concat(F.lit("[["), f["id"], F.lit("]]")), f["display"]))


def substitute(answers: DataFrame, facts: DataFrame) -> DataFrame:
    """Drafts with the facts filled in and doubled nouns collapsed."""
    df = answers.join(facts_by_answer(facts), ANSWER, "left")
    filled = F.when(F.col("_facts").isNull(), F.col("draft")).otherwise(fill_references(F.col("draft"), F.col("_facts")))
    return df.withColumn("final_text", F.regexp_replace(filled, C.DOUBLED_NOUNS, "$1")).drop("_facts")


def fallback_text(answers: DataFrame, facts: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """Plain answer from facts by role: lead sentence, supporting details, notes.

    answers may carry sector, period and status; notes are (answer_id, code, rule_name, description).
    """
    df = answers.join(facts_by_answer(facts), ANSWER, "left")
    if notes is not None:
        line = F.concat(F.lit("- **"), "code", F.lit("** ("), "rule_name", F.lit("): "), "description")
        listed = notes.groupBy(ANSWER).agg(F.array_sort(F.collect_list(F.struct("code", line.alias("line"))))
                                           .alias("_notes"))
        df = df.join(listed, ANSWER, "left")
        note_lines = F.transform(F.coalesce("_notes", F.expr("array()").cast(listed.schema["_notes"].dataType)),
                                 lambda n: n["line"])
    else:
        note_lines = F.array().cast("array<string>")
    every = F.coalesce("_facts", F.expr("array()").cast(df.schema["_facts"].dataType))
    of_role = lambda role: F.filter(every, lambda f: f["role"] == role)
    has_primary = F.size(of_role("primary")) > 0
    primary = F.when(has_primary, of_role("primary")).otherwise(F.slice(every, 1, 1))
    support = F.when(has_primary, of_role("support")).otherwise(F.slice(every, 2, F.greatest(F.size(every), F.lit(1))))
    text = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    scope = F.array_compact(F.array(
        F.concat(F.lit("the **"), text("sector"), F.lit("** sector")),
        F.concat(F.lit("for **"), text("period"), F.lit("**")),
        F.concat(F.lit("with status '"), text("status"), F.lit("'"))))
    question = F.btrim(F.regexp_replace("question", r"[?!.]+$", ""))
    opening = (F.when(F.size(scope) > 0, F.concat(F.lit("For "), F.array_join(scope, " "), F.lit(", ")))
               .when(F.coalesce("question", F.lit("")) != "", F.concat(F.lit("Regarding "), F.lower(question), F.lit(", ")))
               .otherwise(""))
    lead = F.concat(opening, F.array_join(F.transform(primary, lambda f: F.concat(
        f["label"], F.lit(" stands at **"), f["display"], F.lit("**"))), " and "), F.lit("."))
    details = F.transform(support, lambda f: F.concat(F.lit("- **"), f["label"], F.lit("**: "), f["display"]))
    caveats = F.concat(F.transform(of_role("caveat"), lambda f: F.concat(F.lit("- "), f["label"], F.lit(": "), f["display"])),
                       note_lines)
    section = lambda title, lines: F.when(F.size(lines) > 0, F.concat(F.lit(f"\n**{title}:**\n"), F.array_join(lines, "\n")))
    body = F.array_compact(F.array(lead, section("Key Supporting Details", details),
                                   section("Governance & Coverage Notes", caveats)))
    return df.withColumn("fallback", F.array_join(body, "\n\n")).drop("_facts", "_notes")


def narrate(results: DataFrame, facts: DataFrame) -> DataFrame:
    """Tool template with its facts filled in, and the facts as a bullet list.

    results: (answer_id, template).
    """
    df = results.join(facts_by_answer(facts), ANSWER, "left")
    every = F.coalesce("_facts", F.expr("array()").cast(df.schema["_facts"].dataType))
    bullet = lambda f: F.concat(F.lit("- **"), f["label"], F.lit("**: "), f["display"],
                                F.when(f["must_mention"], " *(Priority)*").otherwise(""))
    return df.withColumns({
        "summary": fill_references(F.col("template"), every),
        "bullets": F.array_join(F.transform(every, bullet), "\n")}).drop("_facts")


def checked_answers(answers: DataFrame, facts: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """Verdict of every answer with its final text: the filled draft, or the fallback when it failed."""
    judged = verdicts(answers, facts)
    filled = substitute(judged, facts)
    both = fallback_text(filled, facts, notes)
    return both.withColumn("final_text", F.when(F.col("verified"), F.col("final_text")).otherwise(F.col("fallback"))
                           ).withColumn("degraded", ~F.col("verified")).drop("fallback")


def select_blocks(answers: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts shown as cards for each answer's task, primary before support, within that task's limit.

    answers: (answer_id, task, top_n).
    """
    tasks = F.create_map(*[x for task, row in C.BLOCK_LIMITS.items()
                           for x in (F.lit(task), F.struct(F.lit(row[0]).alias("cards"), F.lit(row[1]).alias("charts"),
                                                           F.lit(row[2]).alias("rows"), F.lit(row[3]).alias("notes")))])
    limits = F.coalesce(F.try_element_at(tasks, F.col("task")), F.try_element_at(tasks, F.lit("summarize")))
    df = answers.withColumn("_l", limits)
    df = df.withColumn("table_rows", F.when((F.col("task") == "rank") & (F.coalesce("top_n", F.lit(0)) > 0), F.col("top_n"))
                       .otherwise(F.col("_l.rows")))
    is_shown = F.col("role").isin("primary", "support")
    with_role = facts.groupBy(ANSWER).agg(F.max(is_shown).alias("_any"))
    shown = facts.join(with_role, ANSWER).filter(is_shown | ~F.col("_any"))  # without such a role all facts count
    order = W.partitionBy(ANSWER).orderBy(F.when(F.col("role") == "primary", 0).otherwise(1),
                                          F.substring("id", 2, 9).try_cast("int"))
    ranked = shown.withColumn("card", F.row_number().over(order)).filter(
        F.col("card") <= max(row[0] for row in C.BLOCK_LIMITS.values()))
    joined = df.join(ranked.select(ANSWER, "card", "id", "label", "display"), ANSWER)
    return joined.filter(F.col("card") <= F.col("_l.cards")).select(
        ANSWER, "task", "card", "id", "label", "display", F.col("_l.charts").alias("charts"), "table_rows",
        F.col("_l.notes").alias("notes"))
