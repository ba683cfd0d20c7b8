"""Names in text, answer checks, questions and event rules, against small brute-force versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from salesloom import contracts as C
from salesloom.operators import audits as A
from salesloom.operators import privacy as T
from salesloom.operators import questions as QU
from salesloom.operators import verification as V
from salesloom.operators.carry import first_since_reset
from salesloom.operators.numbering import number_within
from salesloom.plans.labelled import QUESTIONS
from salesloom.streaming import admission

NAMES = [("Alice Smith", "owner"), ("Bob", "owner"), ("Acme Corp", "client"), ("Acme Corp India", "client"),
         ("Foo (Labs)", "client"), ("Project Alpha", "deal"), ("Alpha", "deal"), ("x", "deal"), ("Ünïcode AG", "client")]
TEXTS = [
    "Yesterday Alice Smith brought Project Alpha home, to the joy of Acme Corp.", "acme corp india and ACME CORP; Alphabet, alpha-beta",
    "Bob's Foo (Labs) and Foo Labs, x marks", "", "no names here", "Alice Smith", "ünïcode ag met Bob,Bob",
    "Project Alpha Project Alpha\nAlpha", "(Foo (Labs))",
]


@pytest.fixture(scope="module")
def catalog(spark):
    return T.keep_catalog(T.build_catalog(spark.createDataFrame(NAMES, "entity string, entity_type string")))


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")


def test_tokens(catalog):
    tokens = {r["entity"]: r["token"] for r in catalog.collect()}
    assert tokens["Alice Smith"] == "OWNER_REP_01" and tokens["Bob"] == "OWNER_REP_02"
    assert tokens["Acme Corp"] == "CLIENT_ENT_001" and tokens["Alpha"] == "PROJECT_DEAL_001"


def brute_mask(text, tokens):
    taken, hits = [False] * len(text), []
    for name in sorted((n for n in tokens if len(n) >= C.MIN_MASKED_LENGTH), key=len, reverse=True):
        left = r"(?<!\w)" if re.match(r"\w", name) else ""
        right = r"(?!\w)" if re.search(r"\w$", name) else ""
        for m in re.finditer(left + re.escape(name) + right, text, re.IGNORECASE):
            if not any(taken[m.start():m.end()]):
                taken[m.start():m.end()] = [True] * (m.end() - m.start())
                hits.append((m.start(), m.end(), tokens[name]))
    out, at = "", 0
    for start, end, token in sorted(hits):
        out, at = out + text[at:start] + token, end
    return out + text[at:]


def test_masking_matches_brute_force(spark, catalog, texts):
    tokens = {r["entity"]: r["token"] for r in catalog.collect()}
    got = {r["doc_id"]: r["text"] for r in T.tokenize_text(texts, catalog).collect()}
    assert got == {i: brute_mask(t, tokens) for i, t in enumerate(TEXTS)}


def test_random_texts(spark, catalog):
    rng = random.Random(7)
    parts = [n for n, _ in NAMES] + ["and", ",", " ", "(", ")", "corp", "beta", "-", "\n", "Acme"]
    made = [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id int, text string")
    tokens = {r["entity"]: r["token"] for r in catalog.collect()}
    got = {r["doc_id"]: r["text"] for r in T.tokenize_text(df, catalog).collect()}
    assert got == {i: brute_mask(t, tokens) for i, t in enumerate(made)}


def test_round_trip_and_no_leak(catalog, texts):
    exact = texts.filter("doc_id IN (0, 2, 4, 5, 7)")
    masked = T.tokenize_text(exact, catalog)
    back = T.rehydrate_text(masked, catalog)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, exact.collect()))
    assert T.leaks(masked, catalog).count() == 0
    assert {r["entity"] for r in T.leaks(texts.filter("doc_id = 0"), catalog).collect()} == {
        "Alice Smith", "Project Alpha", "Alpha", "Acme Corp"}


def test_minting_continues_counters(spark, catalog):
    new = spark.createDataFrame([("Bob", "deal"), ("Zed Company", "deal"), ("Rep 9", None), ("Zeta", None), (" ", "deal")],
                                "entity string, entity_type string")
    rows = {r["entity"]: r["token"] for r in T.mint(catalog, new).collect()}
    assert rows == {"Zed Company": "CLIENT_ENT_005", "Rep 9": "OWNER_REP_03", "Zeta": "PROJECT_DEAL_004"}


def test_columns_round_trip(spark, catalog):
    df = spark.createDataFrame([("Alpha", "Acme Corp", None), ("Project Alpha", "", "Bob")],
                               "deal_alias string, client_id string, owner_id string")
    masked = T.tokenize_columns(df, catalog)
    assert ("PROJECT_DEAL_001", "CLIENT_ENT_001", None) in set(map(tuple, masked.collect()))
    assert sorted(map(str, T.rehydrate_columns(masked, catalog).collect())) == sorted(map(str, df.collect()))


def test_numbering_of_a_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "rare").otherwise("hot").alias("g"),
                                  F.col("id").alias("v")).repartition(7)
    rows = number_within(df, ["g"], ["v"]).collect()
    for g in ("hot", "rare"):
        mine = sorted((r["v"], r["number"]) for r in rows if r["g"] == g)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))


# ---------------------------------------------------------------- answers

def frames(spark, draft, values, question="q", top_n=None):
    answers = spark.createDataFrame([(1, question, draft, top_n)], "answer_id int, question string, draft string, top_n int")
    rows = [(1, f"F{i}", f"Label {i}", float(v), d, "primary" if i == 1 else "support", i == 1)
            for i, (v, d) in enumerate(values, 1)]
    facts = spark.createDataFrame(rows, "answer_id int, id string, label string, value_double double, display string, "
                                        "role string, must_mention boolean")
    return answers, facts


@pytest.mark.parametrize("draft,values,verified,bad", [
    ("The board lists 37 live deals worth ₹12.40 Cr, and 61.25% of that is billed.",
     [(37, "37 deals"), (124_000_000.0, "₹12.40 Cr"), (61.25, "61.3%")], True, 0),
    ("Some 888 live deals close at 73.15% this time.", [(37, "37 deals")], False, 2),
    ("On 15 Jan 2026, in Q4 FY25-26, DQ009 and the 90-day limit put [[F1]] in 1st place.",
     [(21_500_000.0, "₹2.15 Cr")], True, 0),
    ("We count [[F1]] worth ₹777.25 Cr and bill 91.5% of it.", [(37, "37 deals")], False, 2),
    ("See [[F7]].", [(49, "49 deals")], False, 0),
])
def test_verdicts(spark, draft, values, verified, bad):
    answers, facts = frames(spark, draft, values)
    row = V.verdicts(answers, facts).first()
    assert row["verified"] is verified and row["bad_numbers"] == bad
    assert row["confidence"] == (1.0 if verified else max(0.4, round(1 - .15 * bad - .2 * row["invalid_citations"], 2)))


def test_question_numbers_and_top_n_count_as_known(spark):
    answers, facts = frames(spark, "Found 4321 and 77 rows", [(49, "49")], "Are there 4,321 rows?", 77)
    assert V.verdicts(answers, facts).first()["verified"]


def test_grounding_matches_brute_force(spark):
    rng = random.Random(3)
    truths = [(rng.randint(1, 3), round(rng.choice([rng.random(), rng.uniform(0, 200), rng.uniform(0, 1e9)]), 2))
              for _ in range(300)] + [(1, 0.0), (1, -0.02)]
    near = [(a, max(0.0, g * rng.choice([1.0, 1.0099, 0.9901, 1.0101, 1.02]) + rng.choice([0, 0.049, -0.049, 0.051])))
            for a, g in truths for _ in range(3)]
    known = spark.createDataFrame(truths, "answer_id int, truth double")
    claimed = spark.createDataFrame(near, "answer_id int, number double")
    want = {(a, n) for a, n in near if any(b == a and (abs(n - g) < 0.05 or (g != 0 and abs(n - g) / abs(g) < 0.01))
                                           for b, g in truths)}
    got = {tuple(r) for r in V.grounded(claimed, known).collect()}
    edge = {(a, n) for a, n in want ^ got if any(b == a and abs(abs(n - g) - 0.01 * abs(g)) < 1e-9 * max(1, abs(g))
                                                 for b, g in truths)}
    assert (want ^ got) - edge == set()


def test_substitution_and_fallback(spark):
    answers, facts = frames(spark, "There are [[F1]] deals at [[F2]].", [(8, "8 deals"), (15200000.0, "₹1.52 Cr")])
    assert V.substitute(answers, facts).first()["final_text"] == "There are 8 deals at ₹1.52 Cr."
    wrong, facts = frames(spark, "999.5 Cr", [(8, "8 deals")], "What is open?")
    notes = spark.createDataFrame([(1, "DQ009", "Credits", "two rows")],
                                  "answer_id int, code string, rule_name string, description string")
    row = V.checked_answers(wrong.withColumn("sector", F.lit("Mining")), facts, notes).first()
    assert row["degraded"] and row["final_text"].startswith("For the **Mining** sector, Label 1 stands at **8 deals**.")
    assert "- **DQ009** (Credits): two rows" in row["final_text"]


def test_answer_without_facts(spark):
    answers, facts = frames(spark, "Nothing to say", [(1, "1")])
    none = facts.filter("answer_id = 9")
    assert V.verdicts(answers, none).first()["verified"]
    assert V.substitute(answers, none).first()["final_text"] == "Nothing to say"


# ---------------------------------------------------------------- questions

def test_labelled_questions_route(spark):
    rows = [(i, 1, q[1]) for i, q in enumerate(QUESTIONS)]
    df = QU.route(QU.understand(spark.createDataFrame(rows, "session_id int, turn int, question string")))
    got = {r["session_id"]: r for r in df.collect()}
    for i in (0, 1, 2, 3, 4, 6, 7, 8, 10, 11, 12, 13, 15, 16, 17, 18, 20, 25, 26):
        assert got[i]["tool"] == QUESTIONS[i][4], QUESTIONS[i][1]
    assert got[22]["tool"] == "owner_performance"  # rules match substrings, and "report" holds "rep"
    assert got[28]["out_of_scope"] and got[3]["args"] == {"metric": "open_pipeline", "top_n": "1"}
    assert got[1]["args"] == {"sector": "Energy", "period": "Q4 FY25-26"}


def test_carry_over_chain(spark):
    turns = ["Energy pipeline in Q3", "What about Mining?", "What's our profit margin?", "and solar?",
             "how about FY24-25", "Show me the revenue realization ladder for everything", "and wind?"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(turns)], "session_id int, turn int, question string")
    got = [r["period"] for r in QU.carry_period(QU.understand(df)).orderBy("turn").collect()]
    assert got == ["Q3 FY25-26", "Q3 FY25-26", "Q3 FY25-26", "Q3 FY25-26", "FY24-25", None, None]


def test_carry_over_in_pieces(spark):
    rng = random.Random(5)
    rows = [(k, i, rng.random() < .15, rng.choice([None, None, f"v{i}"])) for k in range(3) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, i int, reset boolean, v string")
    want = {}
    for k in range(3):
        state = None
        for _, i, reset, v in [r for r in rows if r[0] == k]:
            state = v if reset else (state if state is not None else v)
            want[k, i] = state
    for chunk in (1, 3, 16, 4096):
        got = first_since_reset(df, "k", "i", F.col("reset"), F.col("v"), "out", chunk)
        assert {(r["k"], r["i"]): r["out"] for r in got.collect()} == want


# ---------------------------------------------------------------- audits and admission

def test_identical_answers_count_pairs(spark):
    log = spark.createDataFrame([(1, "a", "t", "x", "same"), (2, "b", "t", "x", "same "), (3, "c", "t", "y", "same"),
                                 (4, "d", "t", "y", "other"), (5, "d", "t", "y", "same"), (6, "e", "t", "z", " ")],
                                "seq int, question string, tool string, args string, answer string")
    row = A.answer_audit(log.withColumn("source", F.when(F.col("seq") < 4, "template").otherwise("w"))).first()
    assert (row["identical_pairs"], row["distinct_tool_args"], row["template_rate"]) == (6, 3, 50.0)


def test_identical_answers_do_not_list_pairs(spark):
    log = spark.range(3000).select(F.col("id").alias("seq"), F.col("id").cast("string").alias("question"),
                                   F.lit("one answer").alias("answer"))
    rows = A.identical_answers(log).collect()
    assert len(rows) == 1 and rows[0]["pairs"] == 3000 * 2999 // 2


@pytest.mark.parametrize("rule", [admission.SlidingWindow(3, 60), admission.TokenBucket(0.1, 3.0),
                                  admission.CallBudget(4, 100)])
def test_admission_matches_a_plain_walk(spark, rule):
    rng = random.Random(11)
    events, at = [], {0: 0.0, 1: 0.0}
    for i in range(1200):
        key = 0 if rng.random() < .8 else 1  # one hot key
        at[key] += rng.choice([0.0, 0.5, 3.0, 20.0, 70.0, 150.0])
        events.append((i, key, at[key]))
    df = spark.createDataFrame(events, "event_id int, user_id int, s double").withColumn(
        "ts", F.timestamp_micros((F.col("s") * 1e6).cast("long")))
    want, state = {}, {0: rule.start(), 1: rule.start()}
    for i, key, s in sorted(events, key=lambda e: (e[1], e[2], e[0])):
        state[key], result = rule.step(state[key], int(s * 1e6))
        want[i] = result[0]
    got = {r["event_id"]: r["admitted"] for r in admission.admit(df, rule).collect()}
    assert got == want and len(set(want.values())) == 2


def test_numbers_of_any_length_are_checked(spark):
    from salesloom.operators.verification import grounded
    claimed = spark.createDataFrame([("a", 1e22), ("a", 999999999999999999.0), ("a", 5e29), ("a", 7.0)], "answer_id string, number double")
    truths = spark.createDataFrame([("a", 1.001e22), ("a", 999999999999999999.0), ("a", 7.04)], "answer_id string, truth double")
    assert sorted(r.number for r in grounded(claimed, truths).collect()) == [7.0, 999999999999999999.0, 1e22]


def test_names_the_catalogue_lacks_are_minted(spark):
    catalog = T.build_catalog(spark.createDataFrame([("Acme", "client"), ("Bond", "owner")], "entity string, entity_type string"))
    df = spark.createDataFrame([("Acme", "Bond"), ("Unknown Co", None), ("Unknown Co", "")], "client_id string, owner_id string")
    masked = T.tokenize_columns(df, catalog)
    got = [tuple(r) for r in masked.collect()]
    assert None not in {c for c, _ in got} and got.count(got[1]) + got.count(got[2]) >= 2 and got[1][0] == got[2][0] != got[0][0]
    back = T.rehydrate_columns(masked, T.minted_catalog(df, catalog))
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
