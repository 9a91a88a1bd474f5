"""Check SQL of the queries whose rows SQL can give."""

from __future__ import annotations

_WORD = r"'[^\x20\x09-\x0D]+'"
_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
_FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def repetition(repeat: int, percent: int, longest: int) -> str:
    """Windows of words that are found twice stand for the suffix array: a repeat of n words or more is one of n words."""
    ahead = lambda n: " || ' ' || ".join(f"lead(word, {k}) OVER o" for k in range(n))
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORD}) AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM d),
g AS (
  SELECT doc_id, pos, {ahead(3)} AS short, {ahead(repeat)} AS long FROM w
  WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
r AS (
  SELECT doc_id, pos, short IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, short) > 1 AS short,
    long IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, long) > 1 AS long FROM g),
c AS (
  SELECT doc_id, bool_or(short) OVER (PARTITION BY doc_id ORDER BY pos ROWS 2 PRECEDING) AS short,
    bool_or(long) OVER (PARTITION BY doc_id ORDER BY pos ROWS {repeat - 1} PRECEDING) AS long FROM r),
s AS (SELECT doc_id, count_if(short) AS n_repeat_words, count_if(long) AS n_covered FROM c GROUP BY doc_id),
x AS (
  SELECT DISTINCT doc_id FROM (
    SELECT doc_id, array_to_string(words[pos : pos + {longest}], ' ') AS string, count(*) AS n
    FROM r JOIN d USING (doc_id) WHERE long AND pos + {longest} <= len(words) GROUP BY ALL) WHERE n > 1),
l AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, {_WORD}) GROUP BY doc_id),
f AS (
  SELECT doc_id, len(words) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(n_covered, 0) AS BIGINT) AS n_covered, x.doc_id IS NOT NULL AS too_long
  FROM d LEFT JOIN s USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN x USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_covered <= {percent} * n_words AND NOT too_long AS kept
FROM f
"""


LEXICAL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, {_TERM}) AS t FROM documents),
h AS (SELECT doc_id, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0),
z AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM h),
q AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all({_FOLDED}, {_TERM})) AS term FROM benchmark) GROUP BY ALL),
p AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, z GROUP BY term, docs),
s AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN h USING (doc_id), z GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER o AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER o <= 20
"""


def clusters(count: int, rounds: int, size: int, scale: int, seed: int) -> str:
    """Rounds side by side; doubles hold the numbers of the tables exactly."""
    steps = [
        f"""WITH v AS (
  SELECT vec_id, [floor({scale} * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = {size} AND list_count([x FOR x IN embedding IF isfinite(x)]) = {size}),
c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c, v AS m FROM v ORDER BY c LIMIT {count})"""
    ]
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS (
  SELECT vec_id, v, c, list_inner_product(v, v) - 2 * list_inner_product(v, m) + list_inner_product(m, m) AS d FROM v, c{k}
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)""")
        if k < rounds:
            steps.append(f"""s{k} AS (
  SELECT c, i, floor(sum(x) / count(*)) AS x FROM (SELECT c, unnest(v) AS x, unnest(range(1, {size + 1})) AS i FROM a{k}) GROUP BY c, i),
c{k + 1} AS (
  SELECT c, coalesce(n.m, c{k}.m) AS m FROM c{k} LEFT JOIN (SELECT c, list(x ORDER BY i) AS m FROM s{k} GROUP BY c) n USING (c))""")
    return ",\n".join(steps) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string([CAST(CAST(x AS BIGINT) AS VARCHAR) FOR x IN m], ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (c)
"""
