"""Text functions over written answers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from salesloom import contracts as C
from salesloom.functions.scalars import strip


def first_sentence(text: Column) -> Column:
    """First sentence of a markdown answer without headings and section labels; else its first 120 characters."""
    lines = F.transform(F.split(strip(text), "\n"), strip)
    heading = lambda line: strip(F.regexp_replace(line, r"^#+\s*", ""))
    bold = lambda line: strip(F.regexp_replace(line, r"^\*{1,3}[^*]+\*{1,3}\s*[:\-]?\s*", ""))
    unmarked = lambda line: F.when(line.startswith("#"), heading(line)).when(line.startswith("**"), bold(line)) \
        .otherwise(line)
    is_label = lambda raw, line: (raw.startswith("#") | raw.startswith("**")) & F.lower(line).isin(C.ANSWER_LABELS)
    prose = lambda raw: F.when(is_label(raw, unmarked(raw)), F.lit("")).otherwise(
        strip(F.regexp_replace(unmarked(raw), C.ANSWER_LABEL_PREFIX, "")))
    joined = F.array_join(F.filter(F.transform(lines, prose), lambda p: p != ""), " ")
    full = F.when(joined != "", joined).otherwise(strip(F.replace(text, F.lit("\n"), F.lit(" "))))
    sentence = F.regexp_extract(full, r"^(.*?[.!?])(?:\s|$)", 1)
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("N/A")).when(
        sentence != "", strip(sentence)).otherwise(strip(F.substring(full, 1, C.FIRST_SENTENCE_LIMIT)))
