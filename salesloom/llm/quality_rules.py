"""Quality rules: a table of thresholds compiled into one projection.

Every rule is a ratio of two counts of a text with a least and a most value, compared in whole numbers. The counts are
column expressions, so judging a text needs no shuffle and no user function, and memory holds one text at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from salesloom.llm.frames import let, words

# Function words of the four languages.
STOP_WORDS = {
    "en": "the of and to a in is that for it was on with be as by this are at from or not have an they which you",
    "de": "der die und in den von zu das sich mit auf des für ist nicht im dem ein eine als auch es an werden aus",
    "fr": "de la le et les des en un du une que pour est qui dans par pas au sur avec il ne se plus ce ou sont",
    "es": "de la que el en y los se del las por un no con su una es para al lo como más o pero sus le ha",
}
SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """least <= 100 * part / whole <= most; a bound that is None does not hold. With no whole the rule is passed."""
    name: str
    part: str
    whole: str
    least: int | None = None
    most: int | None = None


#: The production table, in per cent.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", least=200, most=1200),
    Rule("symbols_to_words", "n_symbols", "n_words", most=10),
    Rule("stop_words", "n_stop_words", "n_words", least=4),
    Rule("shouted_words", "n_shouted", "n_words", most=30),
    Rule("stuttered_words", "n_stuttered", "n_words", most=20),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=30),
    Rule("cut_lines", "n_cut_lines", "n_lines", most=30),
)


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda line: F.length(F.translate(line, " \t\n\x0b\x0c\r", "")) > 0)


def base_counts(text: Column, found: Column, lines: Column) -> dict[str, Column]:
    """Counts of one text; found: its words; lines: those with a word."""
    return {
        "n_words": F.size(found).cast("long"),
        "word_chars": F.length(F.array_join(found, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_cut_lines": F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).cast("long"),
        "n_repeat_words": repeated_words(found).cast("long"),
    }


def repeated_words(found: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of so many words which the text has twice or more.

    Windows are compared by a 64-bit hash. Only texts with a repeated window sort their windows; positions of repeated
    ones come back in order and each adds the words that the one before it did not cover: n log n at most.
    """
    hashes = F.transform(found, lambda w: F.xxhash64(w))
    last = F.size(found) - window

    def windows(h: Column) -> Column:
        mixed = lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)])
        return F.transform(F.sequence(F.lit(0), F.size(h) - window), mixed)

    def covered(all_windows: Column) -> Column:
        placed = F.sort_array(F.transform(all_windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda x, j: (x["w"] == F.get(s, j - 1)["w"]) | (x["w"] == F.get(s, j + 1)["w"]))
        starts = let(placed, lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"])))
        steps = lambda p: F.transform(p, lambda x, j: F.least(F.lit(window), F.coalesce(F.get(p, j + 1), x + window) - x))
        return let(starts, lambda p: F.aggregate(steps(p), F.lit(0), lambda a, x: a + x))

    counted = let(let(hashes, windows), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered(w)))
    return F.when(last < 1, 0).otherwise(counted)


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, stop_words: dict[str, str] = STOP_WORDS) -> DataFrame:
    """docs with the counts, base_failed, one `rule_<name>` boolean per rule (true: passed) and kept.

    A null text counts as empty: no words, base_failed. Rules whose whole is 0 are passed. Columns of docs that bear the
    name of a computed one are replaced. No row is added, dropped or moved; an empty table gives an empty one.

    Words and lines are columns of their own, and the counts come out of a generator, so no filter on them is pushed to
    where the text is split, and each text is split once whatever is asked of the result.
    """
    stops = F.array(*[F.lit(w) for w in sorted({w for line in stop_words.values() for w in line.split()})])
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?")))
    found = F.col("_words")
    counts = base_counts(F.col("_text"), found, F.col("_lines")) | {
        "n_stop_words": F.size(F.filter(found, lambda w: F.array_contains(stops, bare(w)))).cast("long"),
        "n_stuttered": F.size(F.filter(found, lambda w, i: w == F.get(found, i - 1))).cast("long"),
        "n_shouted": F.size(F.filter(found, lambda w: w.endswith("!!"))).cast("long"),
    }
    kept = [c for c in docs.columns if c not in counts]
    split = docs.select(*kept, text.alias("_text"), words(text).alias("_words"), lines_with_words(text).alias("_lines"))
    out = split.select(*kept, F.inline(F.array(F.struct(*[c.alias(name) for name, c in counts.items()]))))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = out.withColumns({"base_failed": failed, **{f"rule_{r.name}": passed(r) for r in rules}})
    kept = ~F.col("base_failed")
    for rule in rules:
        kept = kept & F.col(f"rule_{rule.name}")
    return out.withColumn("kept", kept)


def passed(rule: Rule) -> Column:
    part, whole = 100 * F.col(rule.part), F.col(rule.whole)
    test = F.lit(True)
    if rule.least is not None:
        test = test & (part >= rule.least * whole)
    if rule.most is not None:
        test = test & (part <= rule.most * whole)
    return (whole == 0) | test
