"""SQL over the same tables for the corpus operators that SQL can express."""

from __future__ import annotations

import re
from math import ceil

from tabassay.llm.license_scan import NOT_WORD, PHRASES, TEMPLATES, THRESHOLD

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TEXT = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

# All pairs of documents that share a shingle, then what can be reached by links.
JACCARD = f"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({TEXT}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3
    THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1),
    lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
  WHERE 100 * x >= 90 * (p.n + q.n - x)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
low AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents LEFT JOIN n USING (doc_id) JOIN low USING (doc_id)"""

# Distances of the sign codes of all queries and rows.
HAMMING = """WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS id,
  CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN
    coalesce(a.embedding[i] > 0, false) <> coalesce(b.embedding[i] > 0, false)
    THEN 1 ELSE 0 END)) AS INTEGER) AS distance
  FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
  AND len(a.embedding) > 0 AND len(b.embedding) > 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, distance FROM (SELECT *, row_number()
  OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM p) WHERE rank <= 10"""

_FINITE = (
    "vec_id IS NOT NULL AND len(e) > 0 AND list_bool_and(list_transform(e, "
    "lambda c: coalesce(isfinite(c), false))) AND list_bool_or(list_transform(e, lambda c: c <> 0))"
)
# Cosines of all pairs.
COSINE = f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE {_FINITE}),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
  ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v
  UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
low AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
deg AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v LEFT JOIN deg USING (vec_id) JOIN low USING (vec_id)"""

_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

# Checksums byte by byte through a table made by its rule; the id decides the noise.
RESAMPLING = f"""WITH d AS (SELECT doc_id, regexp_extract_all({TEXT}, '{_WORD}') AS w FROM documents),
e AS (SELECT regexp_extract_all({TEXT}, '{_WORD}') AS w FROM benchmark),
df AS (SELECT doc_id, len(w) AS n_words, w || list_transform(range(1, len(w)),
  lambda i: w[i] || ' ' || w[i + 1]) AS f FROM d),
ef AS (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f
  FROM e),
u AS (SELECT doc_id, unnest(f) AS f FROM df),
h AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM u UNION SELECT f FROM ef)),
x AS (SELECT f, list_transform(range(0, length(h) // 2), lambda i:
  16 * (strpos('0123456789ABCDEF', h[2 * i + 1]) - 1)
  + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1) AS b FROM h),
t AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k:
  CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t),
k AS (SELECT f, xor(list_reduce(b, lambda c, y: xor(t[(xor(c, y) & 255) + 1], c >> 8),
  CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS k FROM x, t),
s AS (SELECT k, count(*) AS s FROM u JOIN k USING (f) GROUP BY k),
g AS (SELECT k, count(*) AS t FROM ef JOIN k USING (f) GROUP BY k),
a AS (SELECT k, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE)
  * ((SELECT count(*) FROM u) + 10000) / ((coalesce(s, 0) + 1.0::DOUBLE)
  * ((SELECT count(*) FROM ef) + 10000)))) AS BIGINT) AS gain FROM s FULL JOIN g USING (k)),
m AS (SELECT doc_id, count(*) AS n, sum(gain) AS total FROM u JOIN k USING (f) JOIN a USING (k)
  GROUP BY doc_id),
c AS (SELECT doc_id, n_words, coalesce(n, 0) AS n_features,
  CAST(floor(coalesce(total / n, 0)) AS BIGINT) AS weight,
  CAST('0x' || sha256('7:' || doc_id)[1:8] AS BIGINT) AS h FROM df LEFT JOIN m USING (doc_id)),
z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT)
  AS score FROM c),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM z
  WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, rank FROM z LEFT JOIN (SELECT * FROM r
  WHERE rank <= 25 * (SELECT count(*) FROM r) // 100) USING (doc_id)"""

# Every window of every item against every run of as many words.
LEAKS = f"""WITH d AS (SELECT doc_id, regexp_extract_all({TEXT}, '{_WORD}') AS w FROM documents),
e AS (SELECT item_id, regexp_extract_all({TEXT}, '{_WORD}') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2),
  lambda k: array_to_string(w[k:k + n - 1], ' '))) AS win
  FROM (SELECT *, least(len(w), 10) AS n FROM e) WHERE n > 0),
r AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS k,
  unnest(list_transform(range(1, len(w) - n + 2),
  lambda k: array_to_string(w[k:k + n - 1], ' '))) AS win
  FROM d, (SELECT DISTINCT n FROM i)),
p AS (SELECT DISTINCT doc_id, item_id, n, k FROM r JOIN i USING (n, win)),
c AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n))
  AS word FROM p) GROUP BY doc_id),
o AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items
  FROM p GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN o USING (doc_id)"""

# Each step of each order over the documents' failures.
AUDIT = """WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS text,
  coalesce(lang, '') AS part FROM documents),
low AS (SELECT text, min(doc_id) AS low FROM t GROUP BY text),
w AS (SELECT t.*, low, regexp_extract_all(t.text, '[^\\x20\\x09-\\x0D]+') AS w
  FROM t JOIN low USING (text)),
f AS (SELECT part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic,
  CASE WHEN len(w) < 100 THEN 'A' ELSE '' END
  || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text)
    THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN doc_id > low THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN labels USING (doc_id)),
cells AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter),
prefixes AS (SELECT '' AS filter_order UNION ALL
  SELECT filter_order || letter FROM prefixes, letters WHERE NOT contains(filter_order, letter)),
steps AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM prefixes
  WHERE length(filter_order) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS letter,
  filter_order[1:step - 1] AS before FROM steps),
m AS (SELECT part, filter_order, step, letter, n, good, toxic, contains(fails, letter) AS failing,
  regexp_matches(fails, '[' || before || '-]') AS earlier, fails = letter AS alone
  FROM cells, s),
o AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, letter,
  coalesce(sum(n) FILTER (NOT failing AND NOT earlier), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (failing AND NOT earlier), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (failing AND earlier), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails,
  coalesce(sum(n) FILTER (failing AND NOT earlier AND good), 0)::BIGINT AS good_lost,
  coalesce(sum(n) FILTER (failing AND NOT earlier AND toxic), 0)::BIGINT AS toxic_lost
  FROM m GROUP BY ALL)
SELECT * EXCLUDE (letter), CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM o"""


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _words(text: str) -> list[str]:
    return [w for w in re.split(NOT_WORD, text.lower()) if w]


def licenses() -> str:
    """Phrases by their places; every block against every template."""
    places = " || ".join(
        f"""list_transform(list_filter(range(1, len(w) - {len(_words(p)) - 2}),
        lambda i: w[i:i + {len(_words(p)) - 1}] = {_list(_words(p))}),
        lambda i: {{'label': '{label}', 'start': i - 1}})"""
        for p, label in PHRASES.items()
    )
    rows = ", ".join(
        f"('{label}', {_list(own)}, {ceil(THRESHOLD * len(own) - 1e-9)})"
        for label, own in ((label, sorted(set(_words(t)))) for label, t in TEMPLATES)
    )
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    return f"""WITH t(label, own, need) AS (VALUES {rows}),
    d AS (SELECT doc_id, regexp_extract_all({TEXT}, '{word}') AS w FROM documents),
    p AS (SELECT doc_id, len(w) AS n_words, {places} AS places FROM d),
    b AS (SELECT doc_id, list_distinct(regexp_extract_all(unnest(string_split_regex(
      regexp_replace({TEXT}, '([.!?])\\s+', '\\1' || chr(10), 'g'), '[\\r\\n]+')), '{word}'))
      AS w FROM documents),
    m AS (SELECT doc_id, label, max(CAST(len(list_intersect(w, own)) AS DOUBLE) / len(own)) AS c
      FROM b, t WHERE len(list_intersect(w, own)) >= need GROUP BY doc_id, label),
    f AS (SELECT doc_id, list(label) AS labels, max(c) AS most FROM m GROUP BY doc_id)
    SELECT doc_id, n_words, len(places) AS n_base,
      list_min(list_transform(places, lambda x: x.start)) AS first_word,
      list_max(list_transform(places, lambda x: x.start)) AS last_word,
      coalesce(array_to_string(list_sort(list_distinct(
        list_transform(places, lambda x: x.label))), ','), '') AS base_labels,
      coalesce(array_to_string(list_sort(list_distinct(list_transform(places,
        lambda x: x.label) || coalesce(labels, []))), ','), '') AS labels,
      CASE WHEN len(places) > 0 THEN 1.0 ELSE coalesce(most, 0.0) END::DOUBLE AS score
    FROM p LEFT JOIN f USING (doc_id)"""
