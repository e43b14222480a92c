"""DuckDB SQL of the operators' contracts, for the queries that SQL can express.

Written from the contracts alone: plain windows, joins and recursion, none of the operators'
methods.  op5, op6 and op8 have none (fitted models, a hash order DuckDB lacks), nor op9 and
op10, whose byte strings and bags are too slow there; tests compare those with brute force.
"""

from edgetide.llm import sharding

_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BENCH = "regexp_extract_all(" + _AZ.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = "regexp_extract_all(" + _AZ.format("coalesce(text, '')") + r", '[^\x20\x09-\x0D]+')"

DECONTAMINATION = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_BENCH} AS w FROM benchmark),
wins AS (SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[s:s + 9], ' ') AS win
  FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS s FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {_BENCH} AS w FROM documents),
spots AS (SELECT doc_id, s, size, array_to_string(w[s:s + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS s
    FROM docs, (SELECT DISTINCT size FROM wins) WHERE len(w) >= size)),
hits AS (SELECT DISTINCT spots.doc_id, s, spots.size, item FROM spots JOIN wins ON spots.win = wins.win AND spots.size = wins.size),
covered AS (SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest(generate_series(s, s + size - 1)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(named.n, 0) AS BIGINT) AS n_items, sha256(coalesce(named.ids, '')) AS items_sha256,
  coalesce(covered.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {_SPACED} AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS s FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION
  SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT a AS doc_id, CAST(coalesce(max(sizes.n), 0) AS BIGINT) AS n_shingles, min(b) AS component_id
FROM reach LEFT JOIN sizes ON sizes.doc_id = a GROUP BY a"""

LINES = r"""
WITH lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS place
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (SELECT *, """ + _AZ.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))") + r""" AS k FROM lines),
repeats AS (SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT keyed.*, owner IS NOT NULL AND owner <> doc_id AS gone FROM keyed LEFT JOIN repeats USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

TOP_K = """
WITH v AS (SELECT vec_id, row_number() OVER () AS own, [floor(1024 * CAST(x AS DOUBLE)) for x in embedding] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.own, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.own <> c.own AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10"""


HARD_NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, vec_id AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= 10"""


def codes(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Lloyd's rounds written out, every part against every entry."""
    nearest = """
n{k} AS MATERIALIZED (SELECT vec_id, label, p, x, arg_min(i, (dist, i)) AS i, min(dist) AS dist FROM (
    SELECT cut.*, b.i, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist
    FROM cut JOIN b{k} b USING (p)) GROUP BY ALL)"""
    step = """,
m{k} AS (SELECT p, i, list(CAST(floor(s / n) AS BIGINT) ORDER BY q) AS c FROM (
    SELECT p, i, q, CAST(sum(x[q]) AS DOUBLE) AS s, count(*) AS n FROM n{k}, (SELECT unnest(range(1, (SELECT any_value(len(x)) FROM cut) + 1)) AS q)
    GROUP BY ALL) GROUP BY p, i),
b{next} AS MATERIALIZED (SELECT b{k}.p, b{k}.i, coalesce(m{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN m{k} USING (p, i)),"""
    lloyd = "".join(nearest.format(k=k) + step.format(k=k, next=k + 1) for k in range(rounds)) + nearest.format(k=rounds)
    return f"""
WITH v AS (SELECT vec_id, label, [CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
cut AS MATERIALIZED (SELECT vec_id, label, p, e[p * (len(e) // {parts}) + 1:(p + 1) * (len(e) // {parts})] AS x
  FROM (SELECT *, unnest(range({parts})) AS p FROM v)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS i, x AS c FROM cut
  QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= {entries}),{lloyd},
coded AS (SELECT vec_id, label, string_agg(lower(format('{{:02x}}', i)), '' ORDER BY p) AS code,
    CAST(sum(dist) AS BIGINT) AS error FROM n{rounds} GROUP BY vec_id, label),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, i)) AS d FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, d AS codebooks_sha256
FROM coded, digest"""


def _round(half: str, key: int) -> str:
    x = f"(({half} + {key}) * 48271 % {sharding.PRIME})"
    y = f"(xor({x}, {x} >> 13) * 69621 % {sharding.PRIME})"
    return f"xor({y}, {y} >> 15)"


def shards(count: int) -> str:
    """Row numbers through the network as columns, and along their cycles by recursion."""
    steps, keys = "", sharding.round_keys()
    for k, key in enumerate(keys):
        new = (f"(l + {_round('r', key)}) % a AS l, r" if k % 2 == 0 else f"l, (r + {_round('l', key)}) % b AS r")
        steps += f", s{k + 1} AS (SELECT x, n, a, b, {new} FROM s{k})"
    last = f"s{len(keys)}"
    # where every number of the grid goes; walks follow it
    table = 256
    return f"""
WITH RECURSIVE size AS (SELECT count(*) AS n, CAST(floor(sqrt(count(*) - 1)) AS BIGINT) + 1 AS a FROM documents),
grid AS (SELECT n, a, CAST(ceil(n / a) AS BIGINT) AS b FROM size),
s0 AS (SELECT x, n, a, b, x % a AS l, x // a AS r FROM (SELECT n, a, b, unnest(range(a * b)) AS x FROM grid)){steps},
network AS (SELECT x, n, r * a + l AS y FROM {last}),
rows AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS x FROM documents),
walk AS (SELECT x, y, n FROM network WHERE x < n UNION ALL
  SELECT walk.x, network.y, walk.n FROM walk JOIN network ON network.x = walk.y WHERE walk.y >= walk.n),
places AS (SELECT x, y FROM walk WHERE y < n),
crc AS (SELECT list_reduce([i for i in range(8)], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, v)
    AS c, v FROM (SELECT unnest(range({table})) AS v)),
crcs AS (SELECT list(c ORDER BY v) AS t FROM crc),
bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sums AS (SELECT doc_id, xor(list_reduce([CAST(('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2)) AS BIGINT) for i in range(len(h) // 2)],
    lambda c, v: xor(c >> 8, t[xor(c & 255, v) + 1]), 4294967295), 4294967295) AS c FROM bytes, crcs)
SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 8 AS BIGINT) AS size, sums.c AS text_crc32, 'rows' AS law,
  CAST(y % {count} AS INTEGER) AS shard, CAST(y // {count} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM rows JOIN places USING (x) JOIN sums USING (doc_id)"""


SQL = {
    "op1_sharding": shards(24),
    "op2_decontamination": DECONTAMINATION,
    "op3_ngram_jaccard": NEAR_DUPLICATES,
    "op4_line_dedup": LINES,
    "op7_topk": TOP_K,
    "op11_hard_negatives": HARD_NEGATIVES,
    "op12_vector_codes": codes(),
}
