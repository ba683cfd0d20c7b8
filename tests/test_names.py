"""Names in texts: spellings of one form, names of punctuation, leaks inside longer words, plans."""

import random

import pytest
from pyspark.sql import functions as F

from salesloom import contracts as C
from salesloom.operators import privacy as T

NAMES = [("Acme", "client"), ("ACME", "client"), ("acme co", "client"), ("Zoë Ångström", "owner"), ("**", "deal"), ("&&&", "deal"),
         ("(Bond)", "owner"), ("Bond", "owner"), ("Bond Street", "deal"), ("Street Bond", "deal"), ("NATION_1", "client"), ("xyzq", "deal")]
TEXTS = ["Acme met ACME and acme; acme CO too", "** && &&& ***** a**b", "(Bond) or Bond or (bond", "Bond Street Bond Street Bond",
         "ZOË ÅNGSTRÖM's nation_12 and XNATION_1", "", None, "nothing here", "placme&&&bondage"]


@pytest.fixture(scope="module")
def catalog(spark):
    return T.keep_catalog(T.build_catalog(spark.createDataFrame(NAMES, "entity string, entity_type string")))


def frame(spark, texts, first=0):
    return spark.createDataFrame([(i + first, t) for i, t in enumerate(texts)], "doc_id int, text string")


def by_id(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_spellings_keep_their_own_tokens_and_come_back(spark, catalog):
    token = {r["entity"]: r["token"] for r in catalog.collect()}
    got = by_id(T.tokenize_text(frame(spark, TEXTS), catalog))
    assert got[0] == f"{token['Acme']} met {token['ACME']} and {token['ACME']}; {token['acme co']} too"
    assert got[1] == f"{token['**']} && {token['&&&']} {token['**']}{token['**']}* a{token['**']}b"
    assert got[2] == f"{token['(Bond)']} or {token['Bond']} or ({token['Bond']}"
    assert got[3] == f"{token['Bond Street']} {token['Bond Street']} {token['Bond']}"
    assert got[5] == "" and got[6] is None and got[7] == "nothing here"
    exact = frame(spark, ["Acme ACME acme co", "a ** b &&& c", "Zoë Ångström, (Bond)", None, "", "Bond Street"])
    assert by_id(T.rehydrate_text(T.tokenize_text(exact, catalog), catalog)) == by_id(exact)


def test_repeated_and_missing_ids(spark, catalog):
    token = {r["entity"]: r["token"] for r in catalog.collect()}
    rows = [(1, "Acme"), (1, "Acme"), (1, "Bond x"), (None, "Acme y"), (None, None)]
    masked = T.tokenize_text(spark.createDataFrame(rows, "doc_id int, text string"), catalog)
    want = [(1, token["Acme"]), (1, token["Acme"]), (1, token["Bond"] + " x"), (None, token["Acme"] + " y"), (None, None)]
    assert sorted(map(tuple, masked.collect()), key=repr) == sorted(want, key=repr)
    assert sorted(map(tuple, T.rehydrate_text(masked, catalog).collect()), key=repr) == sorted(rows, key=repr)


def test_a_long_chain_of_overlapping_names(spark, catalog):
    token = {r["entity"]: r["token"] for r in catalog.collect()}
    got = by_id(T.tokenize_text(frame(spark, ["Bond Street " * 4000]), catalog))[0]
    assert got == f"{token['Bond Street']} " * 4000


def test_leaks_are_substrings_in_any_case(spark, catalog):
    rng = random.Random(5)
    parts = [n for n, _ in NAMES] + ["x", " ", "1", "ac", "me", "bondBond", "\n", "ÅNG", "é"]
    texts = TEXTS + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(120)]
    want = {(i, n) for i, t in enumerate(texts) for n, _ in NAMES
            if t is not None and len(n) >= C.MIN_LEAK_LENGTH and n.lower() in t.lower()}
    found = T.leaks(frame(spark, texts), catalog)
    assert set(map(tuple, found.collect())) == want and found.count() == len(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "Join Inner\n" not in plan


def test_an_audit_tells_what_masking_leaves(spark, catalog):
    left = T.leaks(T.tokenize_text(frame(spark, TEXTS), catalog), catalog)
    assert set(map(tuple, left.collect())) == {(4, "NATION_1"), (8, "Acme"), (8, "ACME"), (8, "Bond")}


def test_nothing_to_look_for(spark):
    none = T.keep_catalog(T.build_catalog(spark.createDataFrame([], "entity string, entity_type string")))
    texts = frame(spark, TEXTS)
    assert by_id(T.tokenize_text(texts, none)) == by_id(texts) and T.leaks(texts, none).count() == 0


def test_few_names_explode_few_runs(spark, catalog):
    """Runs that go to the join are fewer than the words of the texts."""
    words = "lorem ipsum dolor sit amet consectetur".split()
    texts = frame(spark, [" ".join(random.Random(i).choice(words) for _ in range(400)) + " Acme" for i in range(50)])
    runs = T.candidates(texts, T.search_keys(catalog, C.MIN_MASKED_LENGTH), "text", "doc_id").count()
    assert 50 <= runs < 50 * 40


def test_names_in_notes_of_a_table(spark, catalog):
    token = {r["entity"]: r["token"] for r in catalog.collect()}
    rows = [("Acme", "Bond", "Acme called Bond Street", "x"), ("New Co", None, None, "about New Co"), ("New Co", None, None, "about New Co")]
    table = spark.createDataFrame(rows, "client_id string, owner_id string, note string, other string").withColumn("n", F.lit(1))
    got = T.tokenize_table(table, catalog)
    minted = {r["entity"]: r["token"] for r in T.minted_catalog(table, catalog).collect()}["New Co"]
    want = [(token["Acme"], token["Bond"], f"{token['Acme']} called {token['Bond Street']}", "x", 1)] + [(minted, None, None, f"about {minted}", 1)] * 2
    assert got.columns == table.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_masked_texts_are_computed_once(spark, context):
    """What is read more than once is read from a table, not masked anew for each reading."""
    from salesloom.plans import text_queries as Q
    masked = Q.masked_board_texts(context, Q.board_catalog(context))
    assert all("masked-texts" in f for f in masked.inputFiles())
    plan = Q.leaks_after_masking(context)._jdf.queryExecution().optimizedPlan().toString()
    assert "longest_first" not in plan
