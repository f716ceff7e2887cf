"""Queries over evidence, review sheets, stopping rules and reports of predictions, with SQL written apart from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import evidence, graph, rank, review, tests_of_runs
from loomgraph.plans.sql import BOTH
from loomgraph.sources.tables import triples, views
from loomgraph.streaming import windows

QUERIES, ORACLES = {}, {}


def add(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return keep


def _pairs(kg, relation):
    return kg.where(F.col("interaction") == relation).select("head", "tail")


# --- evidence -------------------------------------------------------------------------------------

NOVEL = "k AS MATERIALIZED (SELECT head, tail FROM kg WHERE interaction = 'RETURNED'), c AS MATERIALIZED (SELECT b.head, b.tail FROM kg b WHERE b.interaction = 'BOUGHT' AND NOT EXISTS (SELECT 1 FROM k WHERE k.head = b.head AND k.tail = b.tail))"
SAME = "SELECT DISTINCT c.head, c.tail FROM c JOIN (SELECT DISTINCT k.head, x.tail AS a FROM k JOIN kg x ON x.head = k.tail AND x.interaction = '{0}') q ON q.head = c.head JOIN kg y ON y.head = c.tail AND y.interaction = '{0}' AND y.tail = q.a"


@add("evidence_kinds", f"""WITH {NOVEL}, e AS ({BOTH}), p1 AS (SELECT DISTINCT c.head, c.tail FROM c JOIN k ON k.head = c.head JOIN e ON e.u = c.tail AND e.v = k.tail), p2 AS ({SAME.format("PART_SIZE")}), p3 AS ({SAME.format("PART_BRAND")}),
z AS (SELECT CASE WHEN p1.head IS NULL THEN 0 ELSE 1 END AS a, CASE WHEN p2.head IS NULL THEN 0 ELSE 1 END AS b, CASE WHEN p3.head IS NULL THEN 0 ELSE 1 END AS g FROM c LEFT JOIN p1 ON p1.head = c.head AND p1.tail = c.tail LEFT JOIN p2 ON p2.head = c.head AND p2.tail = c.tail LEFT JOIN p3 ON p3.head = c.head AND p3.tail = c.tail)
SELECT CASE WHEN a + b + g = 0 THEN '-' ELSE substr(CASE a WHEN 1 THEN '+LINK' ELSE '' END || CASE b WHEN 1 THEN '+PATHWAY' ELSE '' END || CASE g WHEN 1 THEN '+GROUP' ELSE '' END, 2) END AS evidence, (a + b + g)::INT AS n_evidence, (CASE WHEN a + b + g >= 2 THEN 1 WHEN a + b + g = 1 THEN 2 ELSE 3 END)::INT AS tier, count(*) AS n FROM z GROUP BY a, b, g""")  # GRA-16, GRA-18
def _(spark, sf):
    kg = triples(spark, sf, "RETURNED", "BOUGHT", "CO_ORDER", "PART_SIZE", "PART_BRAND")
    known = _pairs(kg, "RETURNED")
    novel = _pairs(kg, "BOUGHT").join(known, ["head", "tail"], "left_anti")
    kinds = {
        "LINK": evidence.linked_to_known(novel, known, _pairs(kg, "CO_ORDER")),
        "PATHWAY": evidence.shares_attribute(novel, known, _pairs(kg, "PART_SIZE")),
        "GROUP": evidence.shares_attribute(novel, known, _pairs(kg, "PART_BRAND")),
    }
    return evidence.tiers(novel, kinds).groupBy("evidence", "n_evidence", "tier").agg(F.count("*").alias("n"))


_VIA = "SELECT DISTINCT a.head, n.tail FROM kg a JOIN kg s ON s.head = a.tail AND s.interaction = 'PART_SUPPLIER' JOIN kg n ON n.head = s.tail AND n.interaction = 'SUPPLIER_NATION' WHERE a.interaction = '{}'"


@add("evidence_paths", f"""WITH k AS (SELECT head, tail FROM kg WHERE interaction = 'CUST_NATION'), c AS MATERIALIZED (SELECT v.head, v.tail FROM ({_VIA.format("BOUGHT")}) v WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.head = v.head AND k.tail = v.tail)), m AS ({_VIA.format("RETURNED")}),
r AS (SELECT head, tail FROM kg WHERE interaction = 'NATION_REGION'), f AS (SELECT DISTINCT c.head, c.tail FROM c JOIN k ON k.head = c.head JOIN r x ON x.head = k.tail JOIN r y ON y.head = c.tail AND y.tail = x.tail)
SELECT c.head, c.tail, CASE WHEN m.head IS NOT NULL AND f.head IS NOT NULL THEN 'PATH+PHENOTYPE' WHEN m.head IS NOT NULL THEN 'PATH' WHEN f.head IS NOT NULL THEN 'PHENOTYPE' ELSE '-' END AS evidence, (CASE WHEN m.head IS NOT NULL AND f.head IS NOT NULL THEN 1 WHEN m.head IS NOT NULL OR f.head IS NOT NULL THEN 2 ELSE 3 END)::INT AS tier
FROM c LEFT JOIN m ON m.head = c.head AND m.tail = c.tail LEFT JOIN f ON f.head = c.head AND f.tail = c.tail""")  # GRA-17, GRA-18, JON-17, JON-18
def _(spark, sf):
    kg = triples(spark, sf, "BOUGHT", "RETURNED", "PART_SUPPLIER", "SUPPLIER_NATION", "CUST_NATION", "NATION_REGION")
    known = _pairs(kg, "CUST_NATION")
    # where a part comes from is told once a part, before its many buyers meet it
    made = _pairs(kg, "PART_SUPPLIER").toDF("head", "by").join(_pairs(kg, "SUPPLIER_NATION").toDF("by", "tail"), "by").select("head", "tail").distinct()
    reached = _pairs(kg, "BOUGHT").join(made.toDF("tail", "to"), "tail").select("head", F.col("to").alias("tail")).distinct()
    novel = graph.cut(reached.join(known, ["head", "tail"], "left_anti"))
    kinds = {"PATH": evidence.reached(novel, _pairs(kg, "RETURNED"), made), "PHENOTYPE": evidence.shares_attribute(novel, known, _pairs(kg, "NATION_REGION"))}
    return evidence.tiers(novel, kinds).select("head", "tail", "evidence", "tier")


# --- predictions ----------------------------------------------------------------------------------

BUSY = "b AS MATERIALIZED (SELECT tail, count(*) AS s FROM kg WHERE interaction = 'BOUGHT' GROUP BY tail)"


@add("top_outside_pool", f"""WITH k AS MATERIALIZED (SELECT head, tail FROM kg WHERE interaction = 'RETURNED'), {BUSY}, h AS (SELECT DISTINCT head FROM k),
q AS (SELECT h.head, b.tail, row_number() OVER (PARTITION BY h.head ORDER BY b.s DESC, b.tail) AS place FROM h CROSS JOIN b WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.head = h.head AND k.tail = b.tail))
SELECT q.head, count(*) AS n, round(avg(CASE WHEN EXISTS (SELECT 1 FROM k WHERE k.tail = q.tail) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 6) AS outside FROM q WHERE place <= 10 GROUP BY q.head""")  # MET-13, MET-18
def _(spark, sf):
    kg = triples(spark, sf, "RETURNED", "BOUGHT")
    known, busy = _pairs(kg, "RETURNED"), _pairs(kg, "BOUGHT").groupBy("tail").agg(F.count("*").alias("s"))
    first = rank.first_novel(known.select("head").distinct(), known, busy, 10)
    inside = known.select("tail").distinct().withColumn("inside", F.lit(1))
    out = F.avg(F.when(F.col("inside").isNull(), 1.0).otherwise(0.0))
    return first.join(inside, "tail", "left").groupBy("head").agg(F.count("*").alias("n"), F.round(out, 6).alias("outside"))


FILLED = "SELECT 'IT' || p_partkey AS item_id, CASE p_size % 3 WHEN 0 THEN 'topk' WHEN 1 THEN 'decoy_midrank' ELSE 'decoy_random' END AS stratum, CASE p_partkey % 5 WHEN 0 THEN 'High' WHEN 1 THEN ' moderate' WHEN 2 THEN '3' WHEN 3 THEN 'low' ELSE '' END AS expert_tier, CASE WHEN p_size > 20 THEN 'Yes' ELSE 'n' END AS expert_plausible FROM part"


@add("review_agreement", f"""WITH f AS ({FILLED}), r AS (SELECT stratum, CASE WHEN lower(expert_plausible) LIKE 'y%' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p, CASE WHEN lower(trim(expert_tier)) IN ('high', 'moderate') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS s FROM f WHERE trim(expert_tier) <> ''), g AS (SELECT stratum, count(*) AS n, avg(p) AS p, avg(s) AS s FROM r GROUP BY stratum)
SELECT g.stratum, g.n, round(g.p, 6) AS plausible, round(g.s, 6) AS supported, round(t.p - g.p, 6) AS top_less_plausible, round(t.s - g.s, 6) AS top_less_supported FROM g LEFT JOIN (SELECT p, s FROM g WHERE stratum = 'topk') t ON true""")  # STA-13, FUN-08, JON-06
def _(spark, sf):
    views(spark, sf)
    sheet = spark.sql(FILLED)
    return review.agreement(sheet.drop("stratum"), sheet.select("item_id", "stratum"))


# --- runs over time -------------------------------------------------------------------------------

DAYS = "SELECT user_id, date_diff('day', DATE '2024-01-01', ts::DATE) AS epoch, max(value) AS value FROM events GROUP BY 1, 2"


@add("early_stop", f"""WITH v AS ({DAYS}), i AS (SELECT *, value > coalesce(max(value) OVER (PARTITION BY user_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '-inf'::DOUBLE) AS better FROM v),
l AS (SELECT *, max(CASE WHEN better THEN epoch END) OVER (PARTITION BY user_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last FROM i), s AS (SELECT user_id, min(CASE WHEN epoch - last >= 5 THEN epoch END) AS stop FROM l GROUP BY user_id)
SELECT l.user_id, max(l.last)::INT AS best_epoch, round(max(l.value), 6) AS best, any_value(s.stop)::INT AS stopped FROM l JOIN s ON s.user_id = l.user_id WHERE s.stop IS NULL OR l.epoch < s.stop GROUP BY l.user_id""")  # ORD-10
def _(spark, sf):
    views(spark, sf)
    days = spark.table("events").groupBy("user_id", F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("epoch")).agg(F.max("value").alias("value"))
    return tests_of_runs.early_stop(days.withColumnRenamed("user_id", "run"), patience=5).select(F.col("run").alias("user_id"), "best_epoch", F.round("best", 6).alias("best"), "stopped")


@add("metric_texts", "SELECT event_type, count(*) AS n, format('{:.3f}±{:.3f}', avg(value), stddev_samp(value)) AS mean_sd, round(stddev_samp(value) / sqrt(count(*)), 6) AS sem FROM events GROUP BY event_type")  # AGG-13, STA-14, FUN-12
def _(spark, sf):
    views(spark, sf)
    sd = F.stddev_samp("value")
    return spark.table("events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.format_string("%.3f±%.3f", F.avg("value"), sd).alias("mean_sd"), F.round(sd / F.sqrt(F.count("*")), 6).alias("sem")
    )


@add("props_flattened", "SELECT 'k' AS name, count(*) AS n, sum(regexp_extract(props, '\"k\": *([0-9]+)', 1)::BIGINT)::BIGINT AS total FROM events WHERE props LIKE '%\"k\"%'")  # FUN-13, SRC-17
def _(spark, sf):
    views(spark, sf)
    each = spark.table("events").select(F.explode(F.from_json("props", "map<string,string>")).alias("name", "value"))
    return each.groupBy("name").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("long")).alias("total"))


@add("events_sliding", "SELECT strftime(date_trunc('day', ts) - to_days(i::INT), '%Y-%m-%d') AS start, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 3) AS total FROM events CROSS JOIN range(7) g(i) GROUP BY 1")  # EXT-01
def _(spark, sf):
    views(spark, sf)
    return windows.sliding(spark.table("events"))


@add("label_lookup", "SELECT k.tail AS entity, coalesce(p.p_name, '') AS label, count(*) AS n FROM kg k LEFT JOIN part p ON 'Part::' || p.p_partkey = k.tail AND p.p_size > 10 WHERE k.interaction = 'RETURNED' GROUP BY 1, 2")  # JON-08, SRC-10
def _(spark, sf):
    known = _pairs(triples(spark, sf, "RETURNED"), "RETURNED")
    names = spark.table("part").where("p_size > 10").select(F.concat(F.lit("Part::"), F.col("p_partkey").cast("string")).alias("tail"), "p_name")
    return known.join(names, "tail", "left").groupBy(F.col("tail").alias("entity"), F.coalesce("p_name", F.lit("")).alias("label")).agg(F.count("*").alias("n"))
