"""Masking entity names in columns and texts, and restoring them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from salesloom import contracts as C
from salesloom.functions.scalars import contains_any, strip
from salesloom.operators.cells import Cells
from salesloom.operators.numbering import number_within
from salesloom.session import stored

WORD_EDGE = r"(?U)(?<=\w)(?=\W)|(?<=\W)(?=\w)"
STARTS_WITH_WORD = r"(?U)^\w"
TOKEN_PATTERN = "(?:" + "|".join(row[1] for row in C.TOKEN_FORMATS.values()) + r")\d+"


def token_text(kind: Column, number: Column) -> Column:
    chain = None
    for name, (_, prefix, digits) in C.TOKEN_FORMATS.items():
        text = F.format_string(f"{prefix}%0{digits}d", number)
        chain = F.when(kind == name, text) if chain is None else chain.when(kind == name, text)
    return chain


# ---------------------------------------------------------------- catalogue

def entity_names(deals: DataFrame, orders: DataFrame) -> DataFrame:
    """Every owner, client and deal name of both boards once; a name met as two types keeps the first of
    owner, client, deal."""
    def of(df):
        named = df.filter(F.col("deal_alias").isNotNull())
        row = lambda c, kind: F.struct(strip(F.col(c)).alias("entity"),
                                       F.lit(C.TOKEN_FORMATS[kind][0]).alias("rank"))
        return named.select(F.inline(F.array(row("owner_id", "owner"), row("client_id", "client"),
                                             row("deal_alias", "deal"))))
    names = of(deals).unionByName(of(orders)).filter(F.coalesce("entity", F.lit("")) != "")
    first = names.groupBy("entity").agg(F.min("rank").alias("rank"))
    kinds = F.array(*[F.lit(k) for k in C.TOKEN_FORMATS])
    return first.select("entity", F.get(kinds, F.col("rank")).alias("entity_type"))


def build_catalog(names: DataFrame) -> DataFrame:
    """Names with their tokens, numbered by type in name order."""
    numbered = number_within(names, ["entity_type"], ["entity"])
    return numbered.select("entity", "entity_type", "number",
                           token_text(F.col("entity_type"), F.col("number")).alias("token"))


def guess_type(entity: Column, hint: Column) -> Column:
    low = F.lower(entity)
    return (F.when((hint == "client") | contains_any(low, C.CLIENT_HINTS), "client")
            .when((hint == "owner") | contains_any(low, C.OWNER_HINTS), "owner").otherwise("deal"))


def mint(catalog: DataFrame, names: DataFrame, sessions: bool = False) -> DataFrame:
    """Tokens for names the catalogue lacks, continuing its counters.

    names has (entity, entity_type) where the type is only a hint, and session_id when
    every session continues the shared catalogue on its own.
    """
    scope = ["session_id"] if sessions else []
    fresh = names.select(*scope, strip(F.col("entity")).alias("entity"), "entity_type").filter(
        F.coalesce("entity", F.lit("")) != "")
    fresh = fresh.join(catalog.select("entity"), "entity", "left_anti")
    fresh = fresh.withColumn("entity_type", guess_type(F.col("entity"), F.coalesce("entity_type", F.lit("deal"))))
    fresh = fresh.groupBy(*scope, "entity").agg(F.min("entity_type").alias("entity_type"))
    numbered = number_within(fresh, [*scope, "entity_type"], ["entity"])
    used = catalog.groupBy("entity_type").agg(F.max("number").alias("_used"))  # at most three rows
    full = numbered.join(F.broadcast(used), "entity_type", "left").withColumn(
        "number", F.col("number") + F.coalesce("_used", F.lit(0)))
    return full.select(*scope, "entity", "entity_type", "number",
                       token_text(F.col("entity_type"), F.col("number")).alias("token"))


def kind_of_column(name: str) -> str | None:
    if name in C.CLIENT_COLUMNS:
        return "client"
    if name in C.OWNER_COLUMNS:
        return "owner"
    return "deal" if name in C.DEAL_NAME_COLUMNS else None


def column_names(df: DataFrame) -> DataFrame:
    """Distinct names in the maskable columns, with the type their column implies."""
    cells = [F.struct(F.col(c).cast("string").alias("entity"), F.lit(kind_of_column(c)).alias("entity_type"))
             for c in df.columns if kind_of_column(c)]
    return df.select(F.inline(F.array(*cells))).filter("entity IS NOT NULL AND entity != ''").distinct()


def minted_catalog(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """The catalogue and, continuing its counters, tokens for names of the maskable columns that it lacks."""
    return catalog.unionByName(mint(catalog, column_names(df)).select(*catalog.columns))


def tokenize_columns(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """Replace the name columns by tokens. Names missing from the catalogue get the tokens of `minted_catalog`.

    The names that occur meet the catalogue once, each of them once; a column of few names is then a small table, which
    Spark broadcasts by its size, and only long columns are shuffled.
    """
    return _with_column_tokens(df, minted_catalog(df, catalog))


def _with_column_tokens(df: DataFrame, full: DataFrame) -> DataFrame:
    columns = [c for c in df.columns if kind_of_column(c)]
    if not columns:
        return df
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("_column"), strip(F.col(c).cast("string")).alias("entity")) for c in columns]))
    names = df.select(cells).filter("entity IS NOT NULL AND entity != ''").distinct()
    known = names.join(full.select("entity", "token"), "entity")
    tokens = stored(known.select("entity", "token", "_column"), "name-tokens", ["_column"])
    for c in columns:
        lookup = tokens.filter(F.col("_column") == c).select(F.col("entity").alias("_entity"), F.col("token").alias("_token"))
        masked = F.when(F.coalesce(F.col(c), F.lit("")) == "", F.col(c)).otherwise(F.col("_token"))
        df = df.join(lookup, strip(F.col(c)) == F.col("_entity"), "left").withColumn(c, masked).drop("_entity", "_token")
    return df


def tokenize_table(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """Name columns as `tokenize_columns` does it, and names inside the texts of all other text columns.

    All texts of all columns are masked in one pass, each under its row and column.
    """
    columns = [c for c, t in df.dtypes if t == "string" and not kind_of_column(c)]
    full = stored(minted_catalog(df, catalog), "all-names") if columns else minted_catalog(df, catalog)
    named = stored(_with_column_tokens(df, full).withColumn("_row", F.monotonically_increasing_id()), "named-rows")
    if not columns:
        return named.drop("_row")
    cells = F.inline(F.array(*[F.struct(F.lit(i).alias("_column"), F.col(c).alias("text")) for i, c in enumerate(columns)]))
    texts = named.select("_row", cells).filter("text IS NOT NULL").withColumn("_cell", F.struct("_row", "_column"))
    masked = tokenize_text(texts.select("_cell", "text"), full, "text", "_cell")
    wide = masked.groupBy(F.col("_cell._row").alias("_at")).agg(
        *[F.max(F.when(F.col("_cell._column") == i, F.col("text"))).alias(f"_t{i}") for i in range(len(columns))])
    met = named.join(wide, F.col("_row") == F.col("_at"), "left")
    return met.select(*[F.col(f"_t{columns.index(c)}").alias(c) if c in columns else c for c in df.columns])


def rehydrate_columns(df: DataFrame, catalog: DataFrame) -> DataFrame:
    for c in [c for c in df.columns if kind_of_column(c)]:
        lookup = catalog.select(F.col("token").alias("_token"), F.col("entity").alias("_entity"))
        df = df.join(lookup, F.col(c) == F.col("_token"), "left").withColumn(
            c, F.coalesce("_entity", F.col(c))).drop("_entity", "_token")
    return df


# ---------------------------------------------------------------- names in text

def pieces(text: Column) -> Column:
    """Text cut into alternating runs of word and other characters; joining them gives the text back."""
    return F.split(text, WORD_EDGE)


def rank_of(kind: Column) -> Column:
    """Place of an entity type in the order in which types claim a name."""
    ranks = F.array(*[F.lit(row[0]) for row in C.TOKEN_FORMATS.values()])
    return F.get(ranks, F.array_position(F.array(*[F.lit(k) for k in C.TOKEN_FORMATS]), kind).cast("int") - 1)


def search_keys(catalog: DataFrame, min_length: int) -> DataFrame:
    """One row for each lower-case word run that names are made of, with all names of that form.

    Punctuation at a name's ends is kept aside and compared at each hit. Names without a word character are not here.
    """
    named = catalog.filter(F.length("entity") >= min_length).select(
        "entity", "token", rank_of(F.col("entity_type")).alias("rank"),
        F.regexp_extract("entity", r"(?U)^(\W*)", 1).alias("lead"), F.regexp_extract("entity", r"(?U)(\W*)$", 1).alias("trail"))
    core = F.expr("substring(entity, length(lead) + 1, length(entity) - length(lead) - length(trail))")
    keyed = named.withColumn("gram", F.lower(core)).filter("gram != ''")
    name = F.struct("entity", "token", "rank", F.lower("lead").alias("lead"), F.lower("trail").alias("trail"))
    grams = keyed.groupBy("gram").agg(F.collect_list(name).alias("names"))  # spellings of one form
    return grams.withColumn("words", ((F.size(pieces(F.col("gram"))) + 1) / 2).cast("int"))


def candidates(texts: DataFrame, keys: DataFrame, text: str, id: str) -> DataFrame:
    """(id, key, at, size, gram, raw, before, after) of the word runs that may be names: their first word and their length
    go together in some name. Nothing else is exploded. at and size count pieces; key: hash of the text."""
    first = F.get(pieces(F.col("gram")), 0)
    cells = Cells(keys, first, F.col("words"))
    lengths = sorted(r["words"] for r in keys.select("words").distinct().collect())
    cut = texts.select(F.col(id), F.xxhash64(text).alias("key"), pieces(F.col(text)).alias("_p"))
    p, start = F.col("_p"), F.when(F.get("_p", 0).rlike(STARTS_WITH_WORD), 0).otherwise(1)

    def runs(k: int) -> Column:
        last = F.size(p) - (2 * k - 1)
        starts = F.when(last >= start, F.sequence(start, last, F.lit(2))).otherwise(F.array().cast("array<int>"))
        likely = F.filter(starts, lambda at: cells.may_hold(F.lower(F.get(p, at)), F.lit(k)))
        return F.transform(likely, lambda at: F.struct(
            at.alias("at"), F.lit(2 * k - 1).alias("size"), F.array_join(F.slice(p, at + 1, F.lit(2 * k - 1)), "").alias("raw"),
            F.coalesce(F.get(p, at - 1), F.lit("")).alias("before"), F.coalesce(F.get(p, at + 2 * k - 1), F.lit("")).alias("after")))

    if not lengths:
        lengths, cut = [1], cut.filter("false")
    found = cut.select(id, "key", F.inline(F.concat(*[runs(k) for k in lengths])))
    return found.withColumn("gram", F.lower("raw"))


def find_names(texts: DataFrame, keys: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Whole-word hits of names in texts, any case: (id, key, at, size, entity, token, lead, trail).

    Of the names of one lower-case form the longest wins at a hit, then the one spelled as the text spells it, then the
    first by type and name. Rows repeated with one id and text give their hits once.
    """
    met = candidates(texts, keys, text, id).join(keys.drop("words"), "gram")
    low = lambda c: F.lower(F.col(c))
    fits = F.filter("names", lambda n: low("before").endswith(n["lead"]) & low("after").startswith(n["trail"]))
    spelled = lambda n: F.concat(F.right(F.col("before"), F.length(n["lead"])), F.col("raw"),
                                 F.left(F.col("after"), F.length(n["trail"])))
    order = F.transform(fits, lambda n: F.struct((-F.length(n["entity"])).alias("o"), (spelled(n) != n["entity"]).alias("other"),
                                                 n["rank"].alias("rank"), n["entity"].alias("entity"), n.alias("n")))
    best = met.withColumn("_best", F.array_min(order)["n"]).filter("_best IS NOT NULL")
    hits = best.select(id, "key", "at", "size", "_best.entity", "_best.token", "_best.lead", "_best.trail")
    return hits.dropDuplicates([id, "key", "at", "size"])


@F.pandas_udf(ArrayType(IntegerType()))
def longest_first(clusters: pd.Series) -> pd.Series:
    """Of overlapping runs (at, end, length) the places of those that stay: the longest first, then the leftmost."""
    def kept(runs):
        if runs is None:
            return None
        taken, out = set(), []
        for i in sorted(range(len(runs)), key=lambda i: (-runs[i]["length"], runs[i]["at"])):
            span = range(runs[i]["at"], runs[i]["end"])
            if taken.isdisjoint(span):
                taken.update(span)
                out.append(i)
        return sorted(out)
    return clusters.map(kept)


def chosen_names(hits: DataFrame, id: str) -> DataFrame:
    """(id, key, hits) with the hits that stay when longer names win over shorter ones they overlap, in text order.

    A sweep along each text cuts its hits into clusters that overlap; a cluster of one stays as it is.
    """
    along = W.partitionBy(id, "key").orderBy("at", "size")
    ended = F.max(F.col("at") + F.col("size")).over(along.rowsBetween(W.unboundedPreceding, -1))
    swept = hits.withColumn("_new", F.coalesce(F.col("at") >= ended, F.lit(True)))
    swept = swept.withColumn("_cluster", F.count_if("_new").over(along.rowsBetween(W.unboundedPreceding, 0)))
    hit = F.struct("at", "size", "entity", "token", "lead", "trail")
    clusters = swept.groupBy(id, "key", "_cluster").agg(F.collect_list(hit).alias("_hits"))
    many = F.when(F.size("_hits") > 1, F.transform("_hits", lambda h: F.struct(
        h["at"].alias("at"), (h["at"] + h["size"]).alias("end"), F.length(h["entity"]).alias("length"))))
    stay = clusters.withColumn("_stay", longest_first(many))
    stay = stay.withColumn("_hits", F.when(F.col("_stay").isNull(), F.col("_hits")).otherwise(
        F.transform("_stay", lambda i: F.get("_hits", i))))
    return stay.groupBy(id, "key").agg(F.array_sort(F.flatten(F.collect_list("_hits"))).alias("_kept"))


def tokenize_text(texts: DataFrame, catalog: DataFrame, text: str = "text", id: str = "doc_id",
                  min_length: int = C.MIN_MASKED_LENGTH) -> DataFrame:
    """Replace every catalogued name by its token, the longest name first; names without a word character come last.

    A null text stays null. Rows may share an id; equal texts of one id are masked alike.
    """
    keys = stored(search_keys(catalog, min_length), "search-keys")  # read for cells, for lengths and for the join
    masked = _with_word_names(texts, keys, text, id)
    marks = catalog.filter((F.length("entity") >= min_length) & ~F.col("entity").rlike(r"(?U)\w"))
    return masked if marks.isEmpty() else _with_mark_names(masked, marks, text, id)


def _with_word_names(texts: DataFrame, keys: DataFrame, text: str, id: str) -> DataFrame:
    kept = chosen_names(find_names(texts, keys, text, id), id).withColumnsRenamed({id: "_id", "key": "_key"})
    df = texts.join(kept, F.col(id).eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_key")), "left")
    df = df.withColumn("_p", F.when(F.col("_kept").isNotNull(), pieces(F.col(text))))
    kept = F.col("_kept")

    def gap(previous_end, previous_trail, next_start, next_lead):
        joined = F.array_join(F.slice("_p", previous_end + 1, F.greatest(next_start - previous_end, F.lit(0))), "")
        keep = F.greatest(F.length(joined) - F.length(previous_trail) - F.length(next_lead), F.lit(0))
        return F.substring(joined, F.length(previous_trail) + 1, keep)

    nothing = F.lit("")
    prior = lambda i: F.get(kept, i - 1)
    parts = F.transform(kept, lambda h, i: F.concat(
        F.when(i == 0, gap(F.lit(0), nothing, h["at"], h["lead"])).otherwise(
            gap(prior(i)["at"] + prior(i)["size"], prior(i)["trail"], h["at"], h["lead"])), h["token"]))
    last = F.try_element_at(kept, F.lit(-1))
    tail = gap(last["at"] + last["size"], last["trail"], F.size("_p"), nothing)
    masked = F.when(kept.isNotNull(), F.concat(F.array_join(parts, ""), tail)).otherwise(F.col(text))
    return df.withColumn(text, masked).drop("_id", "_key", "_kept", "_p")


def _with_mark_names(texts: DataFrame, names: DataFrame, text: str, id: str) -> DataFrame:
    """Names made of punctuation alone. Such a name lies within one run of other than word characters."""
    lengths = sorted(r["n"] for r in names.select(F.length("entity").alias("n")).distinct().collect())
    cells = Cells(names, F.col("entity"))
    cut = texts.select(F.col(id), F.xxhash64(text).alias("key"), F.posexplode(pieces(F.col(text))).alias("piece", "run"))
    cut = cut.filter(~F.col("run").rlike(STARTS_WITH_WORD))

    def spots(n: int) -> Column:
        last = F.length("run") - n + 1
        at = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        here = lambda i: F.substring(F.col("run"), i, F.lit(n))
        return F.transform(F.filter(at, lambda i: cells.may_hold(here(i))), lambda i: F.struct(
            i.alias("at"), F.lit(n).alias("size"), here(i).alias("entity")))

    found = cut.select(id, "key", "piece", "run", F.inline(F.concat(*[spots(n) for n in lengths])))
    met = found.join(names.select("entity", "token"), "entity").dropDuplicates([id, "key", "piece", "at", "size"])
    runs = met.groupBy(id, "key", "piece", "run").agg(F.array_sort(F.collect_list(F.struct("at", "size", "token"))).alias("_h"))
    spans = F.transform("_h", lambda h: F.struct(h["at"].alias("at"), (h["at"] + h["size"]).alias("end"), h["size"].alias("length")))
    runs = runs.withColumn("_h", F.transform(longest_first(spans), lambda i: F.get("_h", i)))
    h = F.col("_h")
    end = lambda i: F.when(i == 0, 1).otherwise(F.get(h, i - 1)["at"] + F.get(h, i - 1)["size"])
    parts = F.transform(h, lambda x, i: F.concat(F.substring(F.col("run"), end(i), x["at"] - end(i)), x["token"]))
    rest = F.substring(F.col("run"), end(F.size(h)), F.length("run"))
    new = runs.select(id, "key", F.struct("piece", F.concat(F.array_join(parts, ""), rest).alias("run")).alias("_new"))
    new = new.groupBy(id, "key").agg(F.map_from_entries(F.collect_list("_new")).alias("_new")).withColumnsRenamed({id: "_id", "key": "_key"})
    df = texts.join(new, F.col(id).eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_key")), "left")
    whole = F.array_join(F.transform(pieces(F.col(text)), lambda p, i: F.coalesce(F.try_element_at("_new", i), p)), "")
    return df.withColumn(text, F.when(F.col("_new").isNull(), F.col(text)).otherwise(whole)).drop("_id", "_key", "_new")


def rehydrate_text(texts: DataFrame, catalog: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Put the names back for every token in the texts; tokens nobody knows stay. Texts are read twice: store them first if
    they are costly to compute."""
    found = F.regexp_extract_all(F.col(text), F.lit(f"({TOKEN_PATTERN})"), F.lit(1))
    tokens = texts.select(F.col(id).alias("_id"), F.explode(F.array_distinct(found)).alias("token")).distinct()
    known = tokens.join(catalog.select("token", "entity"), "token").groupBy("_id").agg(
        F.map_from_entries(F.collect_list(F.struct("token", "entity"))).alias("_names"))
    df = texts.join(known, F.col(id).eqNullSafe(F.col("_id")), "left").drop("_id")
    gaps = F.split(F.col(text), TOKEN_PATTERN)
    rebuilt = F.array_join(F.transform(found, lambda t, i: F.concat(
        F.get(gaps, i), F.coalesce(F.try_element_at(F.col("_names"), t), t))), "")
    whole = F.concat(rebuilt, F.coalesce(F.get(gaps, F.size(found)), F.lit("")))
    return df.withColumn(text, F.when(F.col("_names").isNull(), F.col(text)).otherwise(whole)).drop("_names")


# ---------------------------------------------------------------- leaks

#: Cells for the character runs of names, of which there are more than of first words.
GRAM_CELLS = 1 << 18


def quads(text: Column) -> Column:
    """All runs of four characters, overlapping, in one pass over the text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{C.MIN_LEAK_LENGTH}}}))"), F.lit(1))


def leaks(texts: DataFrame, catalog: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Catalogued names of four characters or more that stand in a text, any case, inside longer words too: (id, entity).

    Each name is looked for by the one of its four-character runs that the fewest texts have; a name with a run that no
    text has is nowhere. Texts with that run are searched for the name itself. All spellings of a form are reported.
    Texts are read three times: store them first if they are costly to compute.
    """
    forms = catalog.filter(F.length("entity") >= C.MIN_LEAK_LENGTH).groupBy(F.lower("entity").alias("form")).agg(
        F.collect_set("entity").alias("entities"))
    grams = stored(forms.select("form", F.explode(F.array_distinct(quads(F.col("form")))).alias("gram")), "name-grams")
    low = texts.filter(F.col(text).isNotNull()).select(F.col(id), F.xxhash64(text).alias("key"), F.lower(text).alias("low"))

    def with_grams(wanted: DataFrame) -> DataFrame:
        cells = Cells(wanted, F.col("gram"), size=GRAM_CELLS)
        likely = F.filter(quads(F.col("low")), lambda g: cells.may_hold(g))
        return low.select(id, "key", F.explode(F.array_distinct(likely)).alias("gram"))

    held = with_grams(grams).groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    rarest = grams.join(held, "gram", "left").groupBy("form").agg(
        F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "gram")).alias("r"))
    chosen = stored(rarest.filter("r.texts > 0").select("form", "r.gram"), "rarest-grams")
    pairs = with_grams(chosen).join(chosen, "gram").groupBy(id, "key").agg(F.collect_set("form").alias("_forms"))
    pairs = pairs.withColumnsRenamed({id: "_id", "key": "_key"})
    met = low.join(pairs, F.col(id).eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")))
    found = met.select(id, F.explode(F.filter("_forms", lambda f: F.contains(F.col("low"), f))).alias("form"))
    return found.join(forms, "form").select(id, F.explode("entities").alias("entity")).distinct()


def session_catalog(catalog: DataFrame, minted: DataFrame) -> DataFrame:
    """The shared catalogue with each session's own additions; shared rows have no session."""
    shared = catalog.withColumn("session_id", F.lit(None).cast(minted.schema["session_id"].dataType))
    return shared.unionByName(minted)


def keep_catalog(catalog: DataFrame) -> DataFrame:
    """Store the catalogue, so that it is built once and its size is known to the planner."""
    return stored(catalog, "catalog")
