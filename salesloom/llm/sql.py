"""SQL of the numbered queries that SQL can express, for DuckDB."""

from __future__ import annotations

from salesloom.llm.quality_rules import RULES, STOP_WORDS

GAP = r"[\x20\x09-\x0D]+"

EXACT_DEDUP = rf"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{GAP}', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""


def _verdict() -> str:
    tests = []
    for r in RULES:
        both = [f"100 * {r.part} >= {r.least} * {r.whole}"] if r.least is not None else []
        both += [f"100 * {r.part} <= {r.most} * {r.whole}"] if r.most is not None else []
        tests.append(f"({r.whole} = 0 OR ({' AND '.join(both)}))")
    return " AND ".join(tests)


_STOPS = ", ".join(f"'{w}'" for w in sorted({w for line in STOP_WORDS.values() for w in line.split()}))

QUALITY = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
e AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
win AS (SELECT r, i, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o,
               lead(word, 4) OVER o, lead(word, 5) OVER o, lead(word, 6) OVER o, lead(word, 7) OVER o) AS g,
               lead(word, 7) OVER o IS NOT NULL AS whole FROM e WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM win WHERE whole QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
steps AS (SELECT r, least(8, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 8)) AS step FROM twice),
rep AS (SELECT r, sum(step)::BIGINT AS n FROM steps GROUP BY r),
c AS (SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…) *$')))::BIGINT AS n_cut_lines,
             len(list_filter(words, lambda x: list_contains([{_STOPS}], lower(rtrim(x, '.,;:!?')))))::BIGINT AS n_stop_words,
             len(list_filter(words, lambda x: ends_with(x, '!!')))::BIGINT AS n_shouted,
             len(list_filter(words, lambda x, i: i > 1 AND x = words[i - 1]))::BIGINT AS n_stuttered,
             coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {_verdict()} AS kept FROM b
"""

JACCARD = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM t UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b)
SELECT t.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach.b) AS component_id
FROM t JOIN reach ON reach.a = t.doc_id LEFT JOIN n ON n.doc_id = t.doc_id GROUP BY t.doc_id
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _phrases(n: int) -> str:
    return (f"SELECT lang, {n} AS size, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: "
            f"array_to_string(w[i:i + {n - 1}], ' '))) AS phrase FROM p")


COLLOCATIONS = rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
f AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS w, count(*) AS f
      FROM ({" UNION ALL ".join(map(_phrases, (1, 2, 3, 4)))}) GROUP BY lang, size, phrase HAVING count(*) >= 30),
cut AS (SELECT lang, phrase, f AS a, k, array_to_string(w[:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y
        FROM (SELECT *, unnest(range(1, size)) AS k FROM f WHERE size > 1)),
scored AS (SELECT cut.*, l.f AS l, r.f AS r, (2000000::HUGEINT * a // (l.f + r.f))::BIGINT AS score
           FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = x JOIN f r ON r.lang = cut.lang AND r.phrase = y),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
spans AS (SELECT lang, f, size, w, m, unnest(range(1, size - m + 2)) AS i
          FROM (SELECT *, unnest(range(2, size)) AS m FROM f WHERE size > 2)),
inside AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(f) AS longer FROM spans GROUP BY 1, 2),
ranked AS (SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, encode(w.phrase)) AS rank,
                  w.phrase, a, l, r, score FROM worst w LEFT JOIN inside i ON i.lang = w.lang AND i.phrase = w.phrase
           WHERE i.longer IS NULL OR 100::HUGEINT * i.longer < 80::HUGEINT * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

def _escaped(field: str) -> str:
    return rf"regexp_replace({field}, '<(\\*)\|im_(start|end|nl)\|>', '<\1\\|im_\2|>', 'g')"


CHAT_FORMAT = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, turn, role, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
f AS (SELECT *, '<|im_start|>' || replace({_escaped('role')}, chr(10), '<|im_nl|>') || chr(10) || {_escaped('text')} || '<|im_end|>'
             || chr(10) AS fragment FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, encode(fragment))) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, encode(fragment)) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(fragment))::BIGINT AS formatted_chars FROM f GROUP BY conv_id
"""

ORACLES = {"op11_chat_format": CHAT_FORMAT, "op12_collocations": COLLOCATIONS, "op4_exact_dedup": EXACT_DEDUP, "op6_quality_rules": QUALITY, "op9_jaccard_groups": JACCARD}
