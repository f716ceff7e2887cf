"""Plans for filters, joins, graph features, vector scores and scalar functions; two texts where the dialects differ."""

from __future__ import annotations

from loomgraph.plans.sql import BOTH, HT, SPLIT, TT

P = "WITH parts AS (" + SPLIT + ")"
#: One row for each component of each vector, from 0.
CELLS = ("(SELECT vec_id, p AS i, CAST(x AS DOUBLE) AS x FROM (SELECT vec_id, posexplode(embedding) AS (p, x) FROM embeddings) c0)",
         "(SELECT vec_id, i - 1 AS i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings CROSS JOIN range(1, 65) g(i))")


def on_cells(query: str) -> tuple[str, str]:
    return query.replace("CELLS", CELLS[0]), query.replace("CELLS", CELLS[1])


#: An edge into every vector.
EDGES = "edges AS (SELECT DISTINCT (vec_id * 7 + 1) % (SELECT count(*) FROM embeddings) AS u, vec_id AS v, vec_id % 3 AS rel FROM embeddings)"


def on_edges(query: str) -> tuple[str, str]:
    return on_cells(query.replace("EDGES", EDGES))


#: ``relative_contrast`` over whole vectors: a pair carries one vector of numbers through one shuffle, not a row a component.
NEAR_AND_DRAWN = """WITH size AS (SELECT count(*) AS n FROM embeddings),
v AS (SELECT vec_id, embedding AS x, sqrt(aggregate(embedding, CAST(0 AS DOUBLE), (s, z) -> s + CAST(z AS DOUBLE) * CAST(z AS DOUBLE))) AS l FROM embeddings),
pairs AS (SELECT vec_id AS u, 1 AS near, (vec_id * 7 + 1) % n AS v FROM embeddings CROSS JOIN size UNION ALL SELECT vec_id, 0, DRAW[CAST(vec_id AS STRING) || '|' || k.k] % n FROM embeddings CROSS JOIN size CROSS JOIN {FIFTY} k),
met AS (SELECT u, v, near, count(*) AS c FROM pairs WHERE u <> v GROUP BY u, v, near),
s AS (SELECT near, c * aggregate(zip_with(a.x, b.x, (p, q) -> CAST(p AS DOUBLE) * CAST(q AS DOUBLE)), CAST(0 AS DOUBLE), (t, z) -> t + z) / (a.l * b.l) AS cs FROM met JOIN v a ON a.vec_id = met.u JOIN v b ON b.vec_id = met.v)
SELECT round(avg(CASE WHEN near = 1 THEN cs END) - avg(CASE WHEN near = 0 THEN cs END), 4) + 0.0 AS contrast FROM s"""


PLANS: dict[str, str | tuple[str, str]] = {
    # JON-04: one partner for each normalised name, the least key
    "name_join_first": "SELECT a.p_partkey, b.p_partkey AS partner FROM part a JOIN (SELECT k, p_partkey FROM (SELECT lower(trim(p_brand)) AS k, p_partkey, row_number() OVER (PARTITION BY lower(trim(p_brand)) ORDER BY p_partkey) AS r FROM part) x WHERE r = 1) b ON lower(trim(a.p_brand)) = b.k",
    # JON-05, FLT-02: rows whose built key is a node, and those whose is none
    "key_matched": "SELECT 'Part::' || p_partkey AS node, EXISTS (SELECT 1 FROM kg WHERE kg.interaction = 'RETURNED' AND kg.tail = 'Part::' || part.p_partkey) AS known FROM part",
    # JON-06, JON-07: number of keys that break a one-to-one join
    "one_to_one_breaks": "SELECT count(*) AS breaks FROM (SELECT head FROM kg WHERE interaction = 'CUST_NATION' GROUP BY head HAVING count(*) > 1) x",
    # JON-11: pairs whose groups are linked
    "group_semi_join": f"SELECT s.ht, s.interaction, count(*) AS n FROM (SELECT {HT} AS ht, interaction, {TT} AS tt FROM kg) s WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT {TT} AS ht FROM kg) k WHERE k.ht = s.ht) GROUP BY s.ht, s.interaction",
    # JON-19, SRC-16: two listings of the same pairs, aligned by key
    "aligned_pairs": "SELECT count(*) AS n, count(CASE WHEN a.head IS NULL OR b.head IS NULL THEN 1 END) AS unmatched FROM (SELECT head, tail FROM kg WHERE interaction = 'BOUGHT') a FULL OUTER JOIN (SELECT head, tail FROM kg WHERE interaction = 'RETURNED') b ON a.head = b.head AND a.tail = b.tail",
    # SET-02, SET-03, SET-10, SRC-15: first and newest of each key
    "first_and_newest": "SELECT user_id, max(CASE WHEN f = 1 THEN event_id END) AS first_id, max(CASE WHEN l = 1 THEN event_id END) AS newest_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS l FROM events) x GROUP BY user_id",
    # AGG-06, AGG-07, FLT-14: roles by cascade, their shares of nodes and edges
    "role_coverage": "SELECT role, count(*) AS nodes, CAST(sum(n) AS BIGINT) AS edges, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS node_share, round(sum(n) * 1.0 / sum(sum(n)) OVER (), 6) AS edge_share FROM (SELECT tail, count(*) AS n, CASE WHEN count(*) > 30 THEN 'hub' WHEN count(*) > 20 THEN 'busy' WHEN count(*) > 10 THEN 'common' WHEN count(*) > 1 THEN 'rare' ELSE 'single' END AS role FROM kg WHERE interaction = 'BOUGHT' GROUP BY tail) x GROUP BY role",
    # AGG-17, AGG-18: most frequent relation of each pair of types
    "mode_relation": f"SELECT ht, tt, interaction, n FROM (SELECT ht, tt, interaction, n, row_number() OVER (PARTITION BY ht, tt ORDER BY n DESC, interaction) AS r FROM (SELECT {HT} AS ht, {TT} AS tt, interaction, count(*) AS n FROM kg GROUP BY 1, 2, 3) a) b WHERE r = 1",
    # FLT-06 .. FLT-10: text filters, and a pattern that any row of a node may fit
    "text_filters": "SELECT p_brand, count(CASE WHEN instr(lower(p_name), 'green') > 0 THEN 1 END) AS has_word, count(CASE WHEN p_type LIKE 'STANDARD%' THEN 1 END) AS has_prefix, max(CASE WHEN {MATCH}(lower(p_type), 'brass|steel') THEN 1 ELSE 0 END) AS any_metal, count(CASE WHEN ' ' || lower(p_type) || ' ' LIKE '% tin %' THEN 1 END) AS in_group FROM part GROUP BY p_brand",
    # GRA-11: training targets of an anchor vote for their relatives by shared sizes
    "relatives_score": P + f", attrs AS (SELECT head AS part, tail AS attr FROM kg WHERE interaction = 'PART_SIZE'), s AS (SELECT attr, count(*) AS m FROM attrs GROUP BY attr HAVING count(*) BETWEEN 2 AND 500), rel AS (SELECT x.part AS a, y.part AS b, sum(1.0 / s.m) AS w FROM attrs x JOIN s ON x.attr = s.attr JOIN attrs y ON y.attr = s.attr WHERE x.part <> y.part GROUP BY x.part, y.part) SELECT p.head, rel.b AS tail, round(sum(rel.w), 6) AS score FROM parts p JOIN rel ON p.tail = rel.a WHERE p.part = 'train' GROUP BY p.head, rel.b",
    # GRA-12: cosine votes at several exponents
    "cf_votes_grid": P + f", n AS (SELECT tail, count(*) AS n FROM parts WHERE part = 'train' GROUP BY tail), co AS (SELECT a.tail AS a, b.tail AS b, count(*) AS c FROM parts a JOIN parts b ON a.head = b.head AND b.part = 'train' WHERE a.part = 'train' AND a.tail <> b.tail GROUP BY a.tail, b.tail) SELECT co.a, g.g AS exponent, round(sum(co.c / power(x.n * y.n * 1.0, g.g)), 6) AS mass FROM co JOIN n x ON x.tail = co.a JOIN n y ON y.tail = co.b CROSS JOIN (SELECT 0.25 AS g UNION ALL SELECT 0.5 UNION ALL SELECT 1.0) g GROUP BY co.a, g.g",
    # GRA-22: squared differences along edges, each end divided by the root of its degree
    "dirichlet_energy": on_edges("WITH EDGES, deg AS (SELECT n, count(*) AS d FROM (SELECT u AS n FROM edges UNION ALL SELECT v FROM edges) a GROUP BY n) SELECT e.rel, round(sum(power(a.x / sqrt(p.d * 1.0) - b.x / sqrt(q.d * 1.0), 2)), 4) AS energy FROM edges e JOIN CELLS a ON a.vec_id = e.u JOIN CELLS b ON b.vec_id = e.v AND a.i = b.i JOIN deg p ON p.n = e.u JOIN deg q ON q.n = e.v GROUP BY e.rel"),
    # GRA-23: mean cosine to relatives less mean cosine to drawn vectors
    "relative_contrast": (NEAR_AND_DRAWN, on_cells("WITH c AS (SELECT * FROM CELLS z), nrm AS (SELECT vec_id, sqrt(sum(x * x)) AS l FROM c GROUP BY vec_id), pairs AS (SELECT vec_id AS u, 1 AS near, (vec_id * 7 + 1) % (SELECT count(*) FROM embeddings) AS v FROM nrm UNION ALL SELECT vec_id, 0, DRAW[CAST(vec_id AS STRING) || '|' || k.k] % (SELECT count(*) FROM embeddings) FROM nrm CROSS JOIN {FIFTY} k), s AS (SELECT p.u, p.v, p.near, sum(a.x * b.x) / (max(m.l) * max(o.l)) AS cs FROM pairs p JOIN c a ON a.vec_id = p.u JOIN c b ON b.vec_id = p.v AND a.i = b.i JOIN nrm m ON m.vec_id = p.u JOIN nrm o ON o.vec_id = p.v WHERE p.u <> p.v GROUP BY p.u, p.v, p.near) SELECT round(avg(CASE WHEN near = 1 THEN cs END) - avg(CASE WHEN near = 0 THEN cs END), 4) + 0.0 AS contrast FROM s")[1]),
    # LRN-04: mean of neighbours by relation, through weights of two bases; no root weight
    "rgcn_step": on_edges("WITH EDGES, basis AS (SELECT b.b, i.i, o.i AS o, sin(b.b * 3.0 + i.i * 0.7 + o.i * 1.3) AS w FROM (SELECT 0 AS b UNION ALL SELECT 1) b CROSS JOIN (SELECT DISTINCT i FROM CELLS z) i CROSS JOIN (SELECT DISTINCT i FROM CELLS z) o), m AS (SELECT e.v, e.rel, c.i, avg(c.x) AS x FROM edges e JOIN CELLS c ON c.vec_id = e.u GROUP BY e.v, e.rel, c.i) SELECT m.v AS node, s.o, round(sum(m.x * s.w * cos(m.rel * 2.0 + s.b)), 4) + 0.0 AS y FROM m JOIN basis s ON s.i = m.i GROUP BY m.v, s.o"),
    # LRN-06: product with the relation's vector, symmetric degree norm, mean of in, out and own direction
    "compgcn_step": on_edges("WITH EDGES, deg AS (SELECT n, count(*) AS d FROM (SELECT u AS n FROM edges UNION ALL SELECT v FROM edges) a GROUP BY n), c AS (SELECT * FROM CELLS z), both_ways AS (SELECT u, v, rel FROM edges UNION ALL SELECT v, u, rel + 3 FROM edges), msg AS (SELECT e.v AS node, c.i, c.x * cos(e.rel * 1.0 + c.i) / sqrt(p.d * q.d * 1.0) AS x FROM both_ways e JOIN c ON c.vec_id = e.u JOIN deg p ON p.n = e.u JOIN deg q ON q.n = e.v UNION ALL SELECT vec_id, i, x * cos(6.0 + i) FROM c) SELECT node, i, round(sum(x) / 3.0, 4) + 0.0 AS y FROM msg GROUP BY node, i"),
    # LRN-02: real part of the complex product, the halves of each vector being its real and imaginary parts
    "complex_scores": on_cells("WITH c AS (SELECT vec_id, i % 32 AS k, sum(CASE WHEN i < 32 THEN x ELSE 0.0 END) AS re, sum(CASE WHEN i >= 32 THEN x ELSE 0.0 END) AS im FROM CELLS z GROUP BY vec_id, i % 32) SELECT h.vec_id AS h, t.vec_id AS t, round(sum(h.re * r.re * t.re + h.im * r.re * t.im + h.re * r.im * t.im - h.im * r.im * t.re), 4) + 0.0 AS score FROM c h JOIN c r ON r.vec_id = 3 AND r.k = h.k JOIN c t ON t.vec_id = (h.vec_id * 7 + 1) % (SELECT count(*) FROM embeddings) AND t.k = h.k GROUP BY h.vec_id, t.vec_id"),
    # FUN-16: circular correlation of paired vectors
    "circular_correlation": on_cells("SELECT a.vec_id, (b.i - a.i + 64) % 64 AS k, round(sum(a.x * b.x), 4) + 0.0 AS y FROM CELLS a JOIN CELLS b ON b.vec_id = (a.vec_id * 7 + 1) % (SELECT count(*) FROM embeddings) GROUP BY a.vec_id, (b.i - a.i + 64) % 64"),
    # LRN-08 .. LRN-10, FUN-10, FUN-11: focal loss, weights of negatives within their user, squares
    "training_losses": "WITH s AS (SELECT user_id, event_id, ln(1 + abs(value)) / 3.0 AS z, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS y FROM events), p AS (SELECT *, 1 / (1 + exp(-z)) AS p FROM s), w AS (SELECT *, CASE WHEN y = 0 THEN exp(0.5 * z) / sum(CASE WHEN y = 0 THEN exp(0.5 * z) ELSE 0.0 END) OVER (PARTITION BY user_id) END AS w FROM p) SELECT user_id, round(avg(CASE WHEN y = 1 THEN -0.25 * power(1 - p, 2) * ln(p) ELSE -0.75 * power(p, 2) * ln(1 - p) END), 6) AS focal, round(max(w), 6) AS top_weight, round(0.01 * sum(z * z), 6) AS squares FROM w GROUP BY user_id",
    # FUN-04 .. FUN-07, FUN-15, FUN-18: ids in text, tokens, tails of paths, digests, clean labels
    "scalar_text": ("SELECT p_partkey, array_join(regexp_extract_all(p_name || ' DB0' || (1000 + p_partkey) || ' DB09999', 'DB[0-9]{5}', 0), ';') AS ids, size(filter(split(trim(p_name), ' +'), x -> x <> '')) AS tokens, substring_index('http://x/a/' || p_partkey, '/', -1) AS tail, sha2(p_name, 256) AS digest, coalesce(replace(p_name, '\\t', ' '), '') AS label FROM part",
                    "SELECT p_partkey, array_to_string(regexp_extract_all(p_name || ' DB0' || (1000 + p_partkey) || ' DB09999', 'DB[0-9]{5}'), ';') AS ids, len(list_filter(regexp_split_to_array(trim(p_name), ' +'), lambda x: x <> '')) AS tokens, regexp_extract('http://x/a/' || p_partkey, '[^/]*$') AS tail, sha256(p_name) AS digest, coalesce(replace(p_name, chr(9), ' '), '') AS label FROM part"),
    # FUN-09, SRC-13: fields read from lines of a log
    "log_fields": "SELECT event_id, CAST(regexp_extract(line, 'run=([0-9]+)', 1) AS INT) AS run, CAST(regexp_extract(line, 'hits@10=([0-9.]+)', 1) AS DOUBLE) AS hits_10 FROM (SELECT event_id, 'TEST run=' || (event_id % 12) || ' mrr=0.5 hits@10=' || (event_id % 10) || '.25' AS line FROM events) x",
    # GRA-14, GRA-15: simple two-step chains of every anchor, as text
    "metapath_chains": f"WITH e AS ({BOTH}) SELECT a.u AS source, t.tail AS brand, count(*) AS chains, min(a.u || ' -- ' || a.v || ' -> ' || t.tail) AS first_chain FROM e a JOIN kg t ON t.head = a.v AND t.interaction = 'PART_BRAND' WHERE a.u <> a.v GROUP BY a.u, t.tail",
}
