"""Plans for ranking, sampling and statistics. Two texts (Spark, DuckDB) where the check uses the plain definition."""

from __future__ import annotations

from loomgraph.plans.sql import SPLIT

P = "WITH parts AS (" + SPLIT + ")"
SCORES = "scores AS (SELECT x.tail, count(p.tail) AS score FROM (SELECT DISTINCT tail FROM parts) x LEFT JOIN parts p ON p.tail = x.tail AND p.part = 'train' GROUP BY x.tail)"

#: Filtered ranks of test rows from the histogram of scores; linear in the edges.
HISTOGRAM = SCORES + """,
hist AS (SELECT score, count(*) AS c, sum(count(*)) OVER (ORDER BY score DESC) - count(*) AS above FROM scores GROUP BY score),
own AS (SELECT p.head, s.score, count(*) AS same, sum(count(*)) OVER (PARTITION BY p.head ORDER BY s.score DESC) - count(*) AS higher FROM parts p JOIN scores s ON p.tail = s.tail GROUP BY p.head, s.score),
ranked AS (SELECT p.head, p.tail, h.above - o.higher + h.c - o.same + 1 AS rank FROM parts p JOIN scores s ON p.tail = s.tail JOIN hist h ON h.score = s.score JOIN own o ON o.head = p.head AND o.score = s.score WHERE p.part = 'test')"""


def plain_ranks(anchor: str, target: str, filtered: bool = True) -> str:
    """The definition itself: every candidate of the pool that is no other positive of the anchor."""
    mask = f"NOT EXISTS (SELECT 1 FROM parts k WHERE k.{anchor} = t.{anchor} AND k.{target} = s.c)" if filtered else f"s.c <> t.{target}"
    return P + f""", s AS (SELECT x.{target} AS c, count(p.{target}) AS score FROM (SELECT DISTINCT {target} FROM parts) x LEFT JOIN parts p ON p.{target} = x.{target} AND p.part = 'train' GROUP BY x.{target}),
t AS (SELECT p.head, p.tail, s.score FROM parts p JOIN s ON p.{target} = s.c WHERE p.part = 'test'),
r AS (SELECT t.head, t.tail, count(*) FILTER (WHERE s.score > t.score) AS greater, count(*) FILTER (WHERE s.score = t.score) AS ties
FROM t CROSS JOIN s WHERE {mask} GROUP BY t.head, t.tail)
SELECT t.head, t.tail, coalesce(greater, 0) AS greater, coalesce(ties, 0) AS ties, coalesce(greater, 0) + coalesce(ties, 0) + 1 AS rank, coalesce(greater, 0) + coalesce(ties, 0) / 2.0 + 1 AS expected FROM t LEFT JOIN r ON t.head = r.head AND t.tail = r.tail"""


def on_ranks(query: str) -> tuple[str, str]:
    """A query over ``parts`` and ``ranked`` (head, tail, rank), ranked by histogram here and plainly in the check."""
    return f"{P}, {HISTOGRAM} {query}", f"{P}, ranked AS ({plain_ranks('head', 'tail')}) {query}"


HITS = ", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END), 6) AS hits_{k}" for k in (1, 3, 5, 10, 20, 50, 100))
PAIRED = "d AS (SELECT a.v - b.v AS d FROM (SELECT user_id, avg(value) AS v FROM events WHERE event_type = 'click' GROUP BY user_id) a JOIN (SELECT user_id, avg(value) AS v FROM events WHERE event_type = 'view' GROUP BY user_id) b ON a.user_id = b.user_id)"
KNOWN = "SELECT head, count(*) AS n FROM parts GROUP BY head"
TOP_NOVEL = "SELECT head, tail, score, r FROM (SELECT c.head, c.tail, c.score, row_number() OVER (PARTITION BY c.head ORDER BY c.score DESC, c.tail) AS r FROM {0} c WHERE NOT EXISTS (SELECT 1 FROM parts k WHERE k.head = c.head AND k.tail = c.tail)) x WHERE r <= 3"

PLANS: dict[str, str | tuple[str, str]] = {
    # MET-11: hits of each anchor over all its test targets
    "hits_per_anchor": on_ranks(f"SELECT head, count(*) AS n, {HITS} FROM ranked GROUP BY head"),
    # MET-14, MET-15: ranks again over rows whose ends both train
    "warm_metrics": on_ranks(f"SELECT count(*) AS n, round(avg(1.0 / rank), 6) AS mrr, {HITS} FROM ranked WHERE EXISTS (SELECT 1 FROM parts p WHERE p.part = 'train' AND p.tail = ranked.tail) AND EXISTS (SELECT 1 FROM parts p WHERE p.part = 'train' AND p.head = ranked.head)"),
    # AGG-15, AGG-16: means over anchors beside means over rows
    "rank_macro_micro": on_ranks("SELECT round(avg(m), 6) AS macro_mrr, round(sum(s) / sum(n), 6) AS micro_mrr, round(sum(t) / sum(n), 6) AS mean_rank FROM (SELECT head, avg(1.0 / rank) AS m, sum(1.0 / rank) AS s, sum(rank * 1.0) AS t, count(*) AS n FROM ranked GROUP BY head) x"),
    # STA-10, AGG-12: hit rate by training degree
    "hits_by_degree": on_ranks("SELECT bin, count(*) AS n, round(avg(1.0 / rank), 6) AS mrr FROM (SELECT rank, CASE WHEN coalesce(d.n, 0) = 0 THEN '0' WHEN d.n <= 10 THEN '1-10' WHEN d.n <= 50 THEN '11-50' WHEN d.n <= 200 THEN '51-200' ELSE '>200' END AS bin FROM ranked LEFT JOIN (SELECT tail, count(*) AS n FROM parts WHERE part = 'train' GROUP BY tail) d ON d.tail = ranked.tail) x GROUP BY bin"),
    # GRA-19: rows whose anchor already has a target of the same brand in training
    "strata_redundancy": on_ranks("SELECT redundant, count(*) AS n, round(avg(1.0 / rank), 6) AS mrr FROM (SELECT ranked.rank, EXISTS (SELECT 1 FROM (SELECT p.head, b.tail AS brand FROM parts p JOIN kg b ON b.head = p.tail AND b.interaction = 'PART_BRAND' WHERE p.part = 'train') k WHERE k.head = ranked.head AND k.brand = mine.tail) AS redundant FROM ranked JOIN kg mine ON mine.head = ranked.tail AND mine.interaction = 'PART_BRAND') x GROUP BY redundant"),
    # ORD-04, ORD-05, MET-18: best three new targets. An anchor with n known targets finds them among the n + 3 first of the board
    "competitors_topk": (
        f"{P}, {SCORES}, board AS (SELECT tail, score, row_number() OVER (ORDER BY score DESC, tail) AS i FROM scores), places AS (SELECT head, explode(sequence(1, n + 3)) AS i FROM ({KNOWN}) a), c AS (SELECT p.head, b.tail, b.score FROM places p JOIN board b ON p.i = b.i) {TOP_NOVEL.format('c')}",
        f"{P}, {SCORES}, c AS (SELECT h.head, s.tail, s.score FROM (SELECT DISTINCT head FROM parts) h CROSS JOIN scores s) {TOP_NOVEL.format('c')}",
    ),
    # SPL-05: each round other positives supervise, the rest stay in the graph
    "split_disjoint_supervision": P + ", t AS (SELECT head, tail, row_number() OVER (ORDER BY md5('7|' || head || '|' || tail), head, tail) AS i, count(*) OVER () AS n FROM parts WHERE part = 'train') SELECT head, tail, i <= least(n - 1, greatest(1, CAST({bround}(n * 0.3, 0) AS BIGINT))) AS supervises FROM t",
    # SPL-06: one end replaced by any target node
    "neg_uniform": P + ", pool AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS i FROM (SELECT head AS node FROM parts UNION SELECT tail FROM parts) a), size AS (SELECT count(*) AS m FROM pool), d AS (SELECT head, tail, DRAW[head || '|' || tail || '|side'] % 2 AS side, DRAW[head || '|' || tail || '|node'] % m AS i FROM parts CROSS JOIN size WHERE part = 'train') SELECT head, tail, CASE WHEN side = 0 THEN node ELSE head END AS neg_head, CASE WHEN side = 1 THEN node ELSE tail END AS neg_tail FROM d JOIN pool ON d.i = pool.i",
    # SPL-10: unseen items of the middle ranks, in hashed order, numbered
    "decoy_items": "WITH b AS (SELECT tail, row_number() OVER (ORDER BY count(*) DESC, tail) AS r FROM kg WHERE interaction = 'BOUGHT' GROUP BY tail), u AS (SELECT tail FROM b WHERE r BETWEEN 40 AND 160 AND NOT EXISTS (SELECT 1 FROM kg k WHERE k.interaction = 'RETURNED' AND k.tail = b.tail AND k.head = 'Customer::7')) SELECT 'IT' || lpad(CAST(i AS STRING), 5, '0') AS item, tail FROM (SELECT tail, row_number() OVER (ORDER BY md5('42|' || tail), tail) AS i FROM u) x WHERE i <= 20",
    # STA-08: pairs in both relations over those expected by chance
    "enrichment_ratio": "SELECT seen, round(seen * 1.0 * heads * tails / (a * b), 6) AS ratio FROM (SELECT (SELECT count(*) FROM (SELECT head, tail FROM kg WHERE interaction = 'BOUGHT' INTERSECT SELECT head, tail FROM kg WHERE interaction = 'RETURNED') i) AS seen, count(CASE WHEN interaction = 'BOUGHT' THEN 1 END) AS a, count(CASE WHEN interaction = 'RETURNED' THEN 1 END) AS b, count(DISTINCT head) AS heads, count(DISTINCT tail) AS tails FROM kg WHERE interaction IN ('BOUGHT', 'RETURNED')) x",
    # STA-03: signed ranks of differences, ties averaged, zeros left out
    "wilcoxon_moments": "WITH " + PAIRED + ", r AS (SELECT round(d, 9) AS d, rank() OVER (ORDER BY abs(round(d, 9))) + (count(*) OVER (PARTITION BY abs(round(d, 9))) - 1) / 2.0 AS r FROM d WHERE round(d, 9) <> 0) SELECT n, round(w, 4) AS w_plus, round((w - n * (n + 1) / 4.0) / sqrt(q / 4.0), 6) AS z FROM (SELECT count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0.0 END) AS w, sum(r * r) AS q FROM r) x",
    # STA-05, STA-06: interval at a given critical value, and both one-sided statistics of equivalence within a margin
    "tost_moments": "WITH " + PAIRED + " SELECT n, round(m, 6) AS mean, round(m - 1.96 * se, 6) AS low, round(m + 1.96 * se, 6) AS high, round((m + 0.5) / se, 6) AS t_low, round((m - 0.5) / se, 6) AS t_high FROM (SELECT count(*) AS n, avg(d) AS m, stddev_samp(d) / sqrt(count(*)) AS se FROM d) x",
    # STA-09: whether the least of one group is above the greatest of the other
    "no_overlap": "SELECT a.event_type AS a, b.event_type AS b, a.lo > b.hi AS apart FROM (SELECT event_type, min(value) AS lo FROM events GROUP BY event_type) a JOIN (SELECT event_type, max(value) AS hi FROM events GROUP BY event_type) b ON a.event_type <> b.event_type",
    # STA-13, FUN-08: tiers read from text, agreement of two of them
    "tier_agreement": "SELECT tier, count(*) AS n, round(avg(CASE WHEN other = tier THEN 1.0 ELSE 0.0 END), 6) AS agree FROM (SELECT CASE WHEN lower(o_orderpriority) IN ('1-urgent', '2-high') THEN 1 WHEN lower(o_orderpriority) LIKE '3-%' THEN 2 ELSE 3 END AS tier, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 2 ELSE 3 END AS other FROM orders) x GROUP BY tier",
    # AGG-13, AGG-14, AGG-20: a curve over time with both deviations
    "curve_by_day": "SELECT day, count(*) AS runs, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(stddev_pop(v), 6) AS sd_pop FROM (SELECT user_id, date_trunc('day', ts) AS day, max(value) AS v FROM events GROUP BY user_id, date_trunc('day', ts)) x GROUP BY day",
    # AGG-21
    "mean_of_means": "SELECT round(avg(a) / avg(b), 6) AS ratio FROM (SELECT user_id, avg(CASE WHEN event_type = 'click' THEN value END) AS a, avg(value) AS b FROM events GROUP BY user_id) x WHERE a IS NOT NULL",
    # ORD-08, ORD-12: best row of each group, equal ones by id
    "best_event": "SELECT event_type, event_id, round(value, 6) AS value FROM (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC NULLS LAST, event_id) AS r FROM events) x WHERE r = 1",
    # ORD-15: best of the last tenth less the best before
    "gain_last_tenth": "SELECT user_id, round(max(CASE WHEN i * 10 > n * 9 THEN value END) - max(CASE WHEN i * 10 <= n * 9 THEN value END), 6) AS gain FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) x GROUP BY user_id",
}
