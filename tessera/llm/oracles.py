"""DuckDB SQL of the corpus queries that SQL can express on whole tables."""

from __future__ import annotations

BLANKS = r"[\x20\x09-\x0D]+"
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def words(text: str) -> str:
    return f"list_filter(string_split_regex(coalesce({text}, ''), '{BLANKS}'), lambda x: x <> '')"


PHRASES = f"""
WITH w AS (SELECT doc_id, {words("text")} AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM w),
s AS (SELECT doc_id, pos, word, string_agg(word, ' ') OVER f AS phrase, count(*) OVER f AS n FROM p
      WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
first AS (SELECT phrase, min(doc_id) AS earliest FROM s WHERE n = 13 GROUP BY phrase),
hit AS (SELECT s.*, n = 13 AND earliest < doc_id AS hit FROM s LEFT JOIN first USING (phrase)),
gone AS (SELECT doc_id, pos, word, max(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM hit),
kept AS (SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (gone = 0) AS text FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id"""

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {words(LOWER.format("text"))} AS w FROM documents),
p AS (SELECT doc_id, len(w) AS size, unnest(w) AS word, unnest(range(len(w))) AS pos FROM w WHERE len(w) >= 5),
s AS (SELECT doc_id, pos, size, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS shingle FROM p),
sets AS (SELECT DISTINCT doc_id, shingle FROM s WHERE pos <= size - 5
         UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN link l ON r.other = l.x)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.other) AS component_id FROM reach r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""

VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) >= 0.95 * a.norm * b.norm),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.y FROM reach r JOIN link l ON r.other = l.x),
c AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT x, count(*) AS n FROM link GROUP BY x)
SELECT c.vec_id, coalesce(n, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON x = c.vec_id"""

def repeats(name: str, n: int) -> str:
    """Tables of which `name` has the maximal runs (r, a, z), from 1, that strings of n bytes that are there twice cover."""
    return f"""{name}_w AS (SELECT r, pos, md5_number(b[pos:pos + {n - 1}]) AS h FROM (SELECT r, b, unnest(range(1, octet_length(b) - {n - 2})) AS pos FROM d)),
{name}_s AS (SELECT h FROM {name}_w GROUP BY h HAVING count(*) > 1),
{name}_p AS (SELECT r, pos, lag(pos) OVER (PARTITION BY r ORDER BY pos) AS before FROM {name}_w SEMI JOIN {name}_s USING (h)),
{name}_i AS (SELECT r, pos, sum(CASE WHEN before IS NULL OR pos > before + {n} THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY pos) AS k FROM {name}_p),
{name} AS (SELECT r, k, min(pos) AS a, max(pos) + {n} AS z FROM {name}_i GROUP BY r, k)"""


REPEATS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
{repeats("cut", 400)},
{repeats("passage", 200)},
n AS (SELECT r, CAST(sum(z - a) AS BIGINT) AS removed, count(*) AS spans FROM cut GROUP BY r),
m AS (SELECT r, CAST(sum(z - a) AS BIGINT) AS covered FROM passage GROUP BY r),
edge AS (SELECT r, a, z FROM cut UNION ALL SELECT r, octet_length(b) + 1, octet_length(b) + 1 FROM d),
kept AS (SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a, z), 1) AS x, a AS y FROM edge),
body AS (SELECT r, string_agg(hex(b[x:y - 1]), '' ORDER BY x) AS body FROM kept JOIN d USING (r) WHERE x < y GROUP BY r)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(body, ''))) AS kept_sha256, coalesce(covered, 0) AS n_passage
FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r) LEFT JOIN body USING (r)"""


def field(column: str) -> str:
    """A value as a leaf holds it."""
    return f"coalesce(strlen(CAST({column} AS VARCHAR)) || ':' || CAST({column} AS VARCHAR), '-')"


def leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


#: The unsigned crc32 of a string of ASCII, a bit at a time: each byte is put in, then eight steps (256) follow.
CRC32 = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ord(c) AS BIGINT), 256, 256, 256, 256, 256, 256, 256, 256]))),
 lambda a, x: CASE WHEN x < 256 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, CAST(3988292384 AS BIGINT)) ELSE a // 2 END), CAST(4294967295 AS BIGINT))"""


def tree(name: str, leaves: str) -> str:
    """Tables of the nodes (t, lv, i, h) above leaves (t, i, h), and of their runs of three."""
    return f"""{name}(t, lv, i, h) AS (SELECT t, 0, i, h FROM {leaves} UNION ALL
 SELECT t, lv + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY t) AS n FROM {name}) WHERE n > 1 GROUP BY t, lv, i // 3),
{name}_root AS (SELECT t, arg_max(h, lv) AS root, max(lv) AS top FROM {name} GROUP BY t),
{name}_run AS (SELECT t, lv, i // 3 AS r, coalesce(max(h) FILTER (i % 3 = 0), '') AS a, coalesce(max(h) FILTER (i % 3 = 1), '') AS b, coalesce(max(h) FILTER (i % 3 = 2), '') AS c FROM {name} JOIN {name}_root USING (t) WHERE lv < top GROUP BY t, lv, i // 3)"""


def climb(name: str, nodes: str, start: str) -> str:
    """A table of the way (d, t, lv, i, proof, h) of each start (d, t, i, proof, h) up its tree."""
    return f"""{name}(d, t, lv, i, proof, h) AS (SELECT d, t, 0, i, proof, h FROM {start} UNION ALL
 SELECT w.d, w.t, w.lv + 1, w.i // 3, w.proof || CASE w.i % 3 WHEN 0 THEN b || c WHEN 1 THEN a || c ELSE a || b END, sha256(CASE w.i % 3 WHEN 0 THEN w.h || b || c WHEN 1 THEN a || w.h || c ELSE a || b || w.h END)
 FROM {name} w JOIN {nodes}_run r ON r.t = w.t AND r.lv = w.lv AND r.r = w.i // 3),
{name}_end AS (SELECT d, t, arg_max(proof, lv) AS proof, arg_max(h, lv) AS h FROM {name} GROUP BY d, t)"""


MANIFEST = f"""
WITH RECURSIVE docs AS (SELECT *, row_number() OVER () AS d, coalesce('1' || source, '0') AS t, {leaf("text")} AS leaf, CASE WHEN {CRC32} % 2 = 0 THEN {leaf(r"replace(text, chr(10), '')")} ELSE {leaf("text")} END AS bent FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h FROM docs),
{tree("node", "leaves")},
subs AS (SELECT '' AS t, t AS of, row_number() OVER (ORDER BY t) - 1 AS i, root AS h FROM node_root),
{tree("top", "subs")},
low AS (SELECT d, t, i, '' AS proof, bent AS h FROM leaves),
{climb("way", "node", "low")},
mid AS (SELECT d, '' AS t, i, proof, w.h FROM way_end w JOIN subs ON subs.of = w.t),
{climb("last", "top", "mid")}
SELECT doc_id, leaf, r.root AS subroot, o.root AS root, sha256(e.proof) AS proof_sha256, e.h AS folded_root, e.h = o.root AS verified
FROM leaves l JOIN last_end e ON e.d = l.d JOIN node_root r ON r.t = l.t, top_root o"""

TAKEN = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def whole(scale: int) -> str:
    return f"list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE)))"


HARD_NEGATIVES = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {whole(256)} AS e FROM embeddings WHERE label IS NOT NULL AND {TAKEN}),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT p.*, other AS negative_id, score AS negative_score, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""

TOP_PRODUCTS = f"""
WITH v AS (SELECT vec_id, {whole(1024)} AS e FROM embeddings WHERE {TAKEN}),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""

ORACLE_SQL = {"op3_suffix_repeats": REPEATS, "op4_phrases": PHRASES, "op7_jaccard": JACCARD, "op8_vectors": VECTORS, "op11_manifest": MANIFEST, "op12_hard_negatives": HARD_NEGATIVES, "op13_top_products": TOP_PRODUCTS}
