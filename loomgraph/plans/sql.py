"""Declarative plans over ``kg`` and the tables; one text serves Spark and the check in DuckDB unless a twin is given."""

from __future__ import annotations

import re

TYPE = "CASE WHEN instr({0}, '::') > 0 THEN substr({0}, 1, instr({0}, '::') - 1) ELSE 'Entity' END"
HT, TT = TYPE.format("head"), TYPE.format("tail")
POOLED = "SELECT head AS node FROM kg UNION SELECT tail FROM kg"
BOTH = "SELECT head AS u, tail AS v FROM kg WHERE interaction = 'CO_ORDER' UNION SELECT tail, head FROM kg WHERE interaction = 'CO_ORDER'"
ANCHORS = "SELECT 'Part::' || p_partkey AS node FROM part"
SPLIT = """
  SELECT head, tail, CASE WHEN i <= n_test THEN 'test'
    WHEN i <= n_test + CASE WHEN n <= 2 OR n - n_test <= 1 THEN 0 ELSE greatest(1, CAST({bround}((n - n_test) * 0.15, 0) AS INT)) END THEN 'val' ELSE 'train' END AS part
  FROM (SELECT *, CASE WHEN n = 1 THEN 0 WHEN n = 2 THEN 1 ELSE CAST(ceil(n * 0.2) AS INT) END AS n_test
    FROM (SELECT head, tail, count(*) OVER (PARTITION BY tail) AS n, row_number() OVER (PARTITION BY tail ORDER BY md5('42|' || head || '|' || tail), head) AS i
      FROM kg WHERE interaction = 'RETURNED') a) b"""

#: name -> SQL. Operators of the survey that each one shows are in its first line.
PLANS = {
    # AGG-02, AGG-03
    "kg_relation_counts": "SELECT interaction, count(*) AS edges, count(DISTINCT head) AS heads, count(DISTINCT tail) AS tails FROM kg GROUP BY interaction",
    # PRJ-01, PRJ-02, AGG-02
    "kg_schema_counts": f"SELECT ht || '-' || tt AS edge_type, interaction, count(*) AS edges FROM (SELECT {HT} AS ht, {TT} AS tt, interaction FROM kg) x GROUP BY ht, tt, interaction",
    # AGG-01, AGG-25
    "kg_node_profile": f"SELECT ht, interaction, count(*) AS n, grouping(ht) * 2 + grouping(interaction) AS g FROM (SELECT {HT} AS ht, interaction FROM kg) x GROUP BY GROUPING SETS ((ht), (interaction), (ht, interaction), ())",
    # AGG-04
    "kg_percent_of_total": "SELECT interaction, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM kg GROUP BY interaction",
    # AGG-22, ORD-01
    "kg_hub_share": "SELECT round(sum(CASE WHEN r <= 10 THEN c ELSE 0 END) * 1.0 / sum(c), 6) AS share FROM (SELECT c, row_number() OVER (ORDER BY c DESC, tail) AS r FROM (SELECT tail, count(*) AS c FROM kg WHERE interaction = 'RETURNED' GROUP BY tail) a) b",
    # PRJ-04, SET-01, SET-03, SET-09
    "kg_canonical_pairs": "SELECT DISTINCT least(a, b) AS head, greatest(a, b) AS tail FROM (SELECT 'Part::' || l_partkey AS a, 'Part::' || (l_suppkey + l_partkey % 7) AS b FROM lineitem) x WHERE a <> b",
    # PRJ-03, JON-01, JON-03, FLT-01, FLT-02, GRA-20: one predicate, told apart by the types of both ends; unmapped and unresolved edges go
    "kg_relation_rename": f"""
SELECT m.rel, count(*) AS edges FROM (SELECT {HT} AS s, 'linked to' AS p, {TT} AS t FROM kg WHERE interaction IN ('RETURNED', 'CO_ORDER', 'PART_SUPPLIER', 'NATION_REGION')
  UNION ALL SELECT {TT}, 'linked to', {HT} FROM kg WHERE interaction = 'PART_SUPPLIER') e
JOIN (SELECT 'Customer' AS s, 'linked to' AS p, 'Part' AS t, 'USES' AS rel UNION ALL SELECT 'Part', 'linked to', 'Part', 'WITH' UNION ALL SELECT 'Part', 'linked to', 'Supplier', 'FROM') m
  ON e.s = m.s AND e.p = m.p AND e.t = m.t GROUP BY m.rel""",
    # JON-02, FUN-19
    "kg_left_sentinel": "SELECT coalesce(nullif(c.c_mktsegment, ''), '<none>') AS segment, count(*) AS n FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_acctbal > 0 GROUP BY 1",
    # JON-03: kept although nothing matches
    "kg_coverage_zero_rows": "SELECT t.rel, count(k.head) AS edges FROM (SELECT 'RETURNED' AS rel UNION ALL SELECT 'NOTHING') t LEFT JOIN kg k ON k.interaction = t.rel GROUP BY t.rel",
    # FLT-03, SET-04
    "kg_ablation_variants": "SELECT v.variant, count(*) AS edges FROM kg CROSS JOIN (SELECT 'full' AS variant, '' AS gone UNION ALL SELECT 'no_pairs', 'CO_ORDER' UNION ALL SELECT 'no_brand', 'PART_BRAND') v WHERE kg.interaction <> v.gone GROUP BY v.variant",
    # FLT-04, FLT-05, FUN-07
    "kg_target_label": f"SELECT label, count(*) AS n FROM (SELECT CASE WHEN lower(replace(interaction, ' ', '_')) IN ('returned') OR lower(replace(et, ' ', '_')) IN ('supplier-part', 'part-supplier') THEN 1 ELSE 0 END AS label FROM (SELECT interaction, {HT} || '-' || {TT} AS et FROM kg) a) b GROUP BY label",
    # AGG-08, AGG-09, AGG-11
    "kg_degree_by_type": f"SELECT {TYPE.format('node')} AS t, count(*) AS nodes, max(d) AS top, sum(d) AS total FROM (SELECT node, count(*) AS d FROM (SELECT head AS node FROM kg UNION ALL SELECT tail FROM kg) a GROUP BY node) b GROUP BY 1",
    # JON-09, JON-10, SET-07
    "kg_bought_not_returned": "SELECT head, count(*) AS n FROM kg WHERE interaction = 'BOUGHT' AND NOT EXISTS (SELECT 1 FROM kg k WHERE k.interaction = 'RETURNED' AND k.head = kg.head AND k.tail = kg.tail) GROUP BY head",
    # JON-12, SET-06
    "kg_overlap": "SELECT count(*) AS n FROM (SELECT head, tail FROM kg WHERE interaction = 'BOUGHT' INTERSECT SELECT head, tail FROM kg WHERE interaction = 'RETURNED') x",
    # SET-11
    "kg_multiset_difference": "SELECT count(*) AS n FROM (SELECT head FROM kg WHERE interaction = 'BOUGHT' EXCEPT ALL SELECT head FROM kg WHERE interaction = 'RETURNED') x",
    # JON-16, FLT-11, FLT-12, GRA-10: shared attribute, weighted by its members, in groups of bounded size
    "relatives_weight": "WITH a AS (SELECT head AS part, tail AS attr FROM kg WHERE interaction = 'PART_SIZE'), s AS (SELECT attr, count(*) AS m FROM a GROUP BY attr HAVING count(*) BETWEEN 2 AND 500) SELECT x.part AS part, count(*) AS pairs, round(sum(1.0 / s.m), 6) AS weight FROM a x JOIN s ON x.attr = s.attr JOIN a y ON y.attr = s.attr WHERE x.part <> y.part GROUP BY x.part",
    # AGG-05, FUN-14
    "kg_collect_sets": "{SETS}",
    # AGG-12, STA-10, ORD-04
    "strata_degree_bins": "SELECT bin, count(*) AS n, sum(d) AS edges FROM (SELECT d, CASE WHEN d = 0 THEN '0' WHEN d <= 1 THEN '1' WHEN d <= 3 THEN '2-3' WHEN d <= 10 THEN '4-10' ELSE '>10' END AS bin FROM (SELECT tail, count(*) AS d FROM kg WHERE interaction = 'RETURNED' GROUP BY tail) a) b GROUP BY bin",
    "top_tails_per_head": "SELECT head, tail, r FROM (SELECT head, tail, row_number() OVER (PARTITION BY head ORDER BY c DESC, tail) AS r FROM (SELECT head, tail, count(*) OVER (PARTITION BY tail) AS c FROM kg WHERE interaction = 'RETURNED') a) b WHERE r <= 3",
    # ORD-06, ORD-07, ORD-11
    "rank_band": "SELECT tail, r FROM (SELECT tail, row_number() OVER (ORDER BY count(*) DESC NULLS LAST, tail) AS r FROM kg WHERE interaction = 'RETURNED' GROUP BY tail) a WHERE r BETWEEN 40 AND 100",
    # SPL-01
    "split_stratified": "WITH parts AS (" + SPLIT + ") SELECT head, tail, part FROM parts",
    # MET-14, STA-11, JON-08
    "strata_regime": "WITH parts AS (" + SPLIT + "), d AS (SELECT tail, count(*) AS n FROM parts WHERE part = 'train' GROUP BY tail), c AS (SELECT node, count(*) AS n FROM (SELECT head AS node FROM kg WHERE interaction <> 'RETURNED' UNION ALL SELECT tail FROM kg WHERE interaction <> 'RETURNED') x GROUP BY node) SELECT CASE WHEN d.n IS NOT NULL THEN 'warm' WHEN c.n IS NOT NULL THEN 'context-only' ELSE 'cold' END AS regime, count(*) AS n FROM parts p LEFT JOIN d ON p.tail = d.tail LEFT JOIN c ON p.tail = c.node WHERE p.part = 'test' GROUP BY 1",
    # AGG-10: clean context degree beside the published formula
    "degree_target_context": "WITH parts AS (" + SPLIT + ") SELECT x.node, sum(x.ctx) AS ctx_deg, sum(x.tgt) AS target_deg, 2 * sum(x.ctx) + sum(x.tgt) AS ctx_deg_compat FROM (SELECT head AS node, 1 AS ctx, 0 AS tgt FROM kg WHERE interaction <> 'RETURNED' UNION ALL SELECT tail, 1, 0 FROM kg WHERE interaction <> 'RETURNED' UNION ALL SELECT head, 0, 1 FROM parts WHERE part = 'train' UNION ALL SELECT tail, 0, 1 FROM parts WHERE part = 'train') x GROUP BY x.node",
    # GRA-12
    "cf_cosine": f"WITH r AS (SELECT head, tail FROM kg WHERE interaction = 'RETURNED'), n AS (SELECT tail, count(*) AS n FROM r GROUP BY tail), s AS ({ANCHORS}) SELECT a.tail AS a, b.tail AS b, round(count(*) / sqrt(max(x.n) * max(y.n) * 1.0), 6) AS sim FROM r a JOIN s ON a.tail = s.node JOIN r b ON a.head = b.head JOIN n x ON x.tail = a.tail JOIN n y ON y.tail = b.tail WHERE a.tail <> b.tail GROUP BY a.tail, b.tail",
    # GRA-14, GRA-15, JON-17, ORD-09: cheapest chain over hubs
    "metapath_best": "WITH d AS (SELECT node, count(*) AS n FROM (SELECT head AS node FROM kg UNION ALL SELECT tail FROM kg) a GROUP BY node), p AS (SELECT a.head AS c, a.tail AS m, b.tail AS s, n.tail AS nation, round(log10(x.n + 1) + log10(y.n + 1), 6) AS cost FROM kg a JOIN kg b ON a.tail = b.head AND b.interaction = 'PART_SUPPLIER' JOIN kg n ON b.tail = n.head AND n.interaction = 'SUPPLIER_NATION' JOIN d x ON x.node = a.tail JOIN d y ON y.node = b.tail WHERE a.interaction = 'RETURNED') SELECT c, nation, chain, cost FROM (SELECT c, nation, cost, c || ' -> ' || m || ' -> ' || s || ' -> ' || nation AS chain, row_number() OVER (PARTITION BY c, nation ORDER BY cost, m, s) AS r FROM p) q WHERE r = 1",
    # GRA-16 .. GRA-18, JON-18: evidence of a candidate against what is known, itself excluded
    "evidence_tiers": "WITH k AS (SELECT head, tail FROM kg WHERE interaction = 'RETURNED'), c AS (SELECT b.head, b.tail FROM kg b WHERE b.interaction = 'BOUGHT' AND NOT EXISTS (SELECT 1 FROM k WHERE k.head = b.head AND k.tail = b.tail)), e AS (" + BOTH + "), br AS (SELECT head, tail FROM kg WHERE interaction = 'PART_BRAND'), ppi AS (SELECT DISTINCT c.head, c.tail FROM c JOIN k ON c.head = k.head JOIN e ON e.u = c.tail AND e.v = k.tail), go AS (SELECT DISTINCT c.head, c.tail FROM c JOIN k ON c.head = k.head AND c.tail <> k.tail JOIN br x ON x.head = c.tail JOIN br y ON y.head = k.tail AND x.tail = y.tail) SELECT tier, count(*) AS n FROM (SELECT CASE WHEN p.head IS NOT NULL AND g.head IS NOT NULL THEN 1 WHEN p.head IS NOT NULL OR g.head IS NOT NULL THEN 2 ELSE 3 END AS tier FROM c LEFT JOIN ppi p ON p.head = c.head AND p.tail = c.tail LEFT JOIN go g ON g.head = c.head AND g.tail = c.tail) z GROUP BY tier",
    # AGG-13, AGG-14, STA-01
    "welch_moments": "SELECT round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 6) AS t, round(power(v1 / n1 + v0 / n0, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v0 / n0, 2) / (n0 - 1)), 4) AS df FROM (SELECT avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS m1, avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS m0, var_samp(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS v1, var_samp(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS v0, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS n1, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS n0 FROM orders) x",
    # STA-02, JON-20, FLT-13
    "paired_moments": "SELECT count(*) AS n, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t FROM (SELECT a.v - b.v AS d FROM (SELECT user_id, avg(value) AS v FROM events WHERE event_type = 'click' GROUP BY user_id) a JOIN (SELECT user_id, avg(value) AS v FROM events WHERE event_type = 'view' GROUP BY user_id) b ON a.user_id = b.user_id) x",
    # STA-04
    "holm_adjust": "SELECT k, round(least(1.0, max(raw) OVER (ORDER BY p, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 8) AS p_holm FROM (SELECT k, p, (count(*) OVER () - row_number() OVER (ORDER BY p, k) + 1) * p AS raw FROM (SELECT c_custkey AS k, (c_custkey * 37 % 101 + 1) / 5000.0 AS p FROM customer) a) b",
    # AGG-15, AGG-16, AGG-17
    "macro_micro": "SELECT round(avg(m), 6) AS macro, round(sum(s) / sum(c), 6) AS micro FROM (SELECT avg(value) AS m, sum(value) AS s, count(*) AS c FROM events GROUP BY user_id) x",
    # ORD-10: best so far before each row
    "best_so_far": "SELECT event_id, round(value, 6) AS value, round(max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS best FROM events",
    # AGG-19
    "cumulative_within": "SELECT k.k, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM lineitem JOIN (SELECT 1 AS k UNION ALL SELECT 3 UNION ALL SELECT 5) k ON l_linenumber <= k.k GROUP BY k.k",
    # EXT-01
    "events_tumbling": "SELECT date_trunc('day', ts) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1",
}
#: Same plans in the check's dialect where the text differs.
SPARK = {
    "kg_collect_sets": "SELECT head, concat_ws(';', sort_array(collect_set(tail))) AS tails FROM kg WHERE interaction = 'PART_SUPPLIER' GROUP BY head",
    # a relation is counted before it meets its name, so its edges don't gather in one task
    "kg_coverage_zero_rows": "SELECT t.rel, coalesce(k.n, 0) AS edges FROM (SELECT 'RETURNED' AS rel UNION ALL SELECT 'NOTHING') t LEFT JOIN (SELECT interaction, count(head) AS n FROM kg GROUP BY interaction) k ON k.interaction = t.rel",
}
DUCK = {"kg_collect_sets": "SELECT head, array_to_string(list_sort(list(DISTINCT tail)), ';') AS tails FROM kg WHERE interaction = 'PART_SUPPLIER' GROUP BY head"}


def _doubles(text: str) -> str:
    """Number literals with a point are decimals in both dialects, of other scales; make them doubles."""
    return re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])", r"CAST(\1 AS DOUBLE)", text)


def series(n: int) -> tuple[str, str]:
    """The numbers 1 to n as a table (k) in both dialects."""
    return f"(SELECT explode(sequence(1, {n})) AS k)", f"(SELECT unnest(range(1, {n + 1}))::INT AS k)"


#: What the two dialects call the same function.
WORDS = tuple({"{bround}": r, "{MATCH}": m, "{SERIES}": series(20)[i], "{FIFTY}": series(50)[i]} for i, (r, m) in enumerate((("bround", "regexp"), ("round_even", "regexp_matches"))))
#: A number below 2**32 from the first digits of a digest: DRAW[text].
DRAWS = (r"CAST(conv(substr(md5(\1), 1, 8), 16, 10) AS BIGINT)", r"CAST('0x' || substr(md5(\1), 1, 8) AS BIGINT)")


def dialect(text: str, check: bool) -> str:
    """The text for Spark, or for the check in DuckDB."""
    for old, new in WORDS[check].items():
        text = text.replace(old, new)
    return re.sub(r"DRAW\[(.*?)\]", DRAWS[check], _doubles(text))


def spark_text(name: str) -> str:
    return dialect(SPARK.get(name, PLANS[name]), False)


def duck_text(name: str) -> str:
    return dialect(DUCK.get(name, PLANS[name]), True)
