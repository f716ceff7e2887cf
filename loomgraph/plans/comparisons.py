"""Queries of supervision by epochs, both ways of comparisons, relatives, votes by anchors and tests with p-values, with SQL written apart from them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import stats
from loomgraph.operators import evidence, exact, graph, ids, products, rank, split
from loomgraph.plans.evaluation import P, WALKS, _walk_edges, parts_of, ranked_sql
from loomgraph.plans.models import V, _model
from loomgraph.sources.tables import triples, views

QUERIES, ORACLES = {}, {}


def add(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return keep


@add("supervision_epochs", f"""{P}, t AS MATERIALIZED (SELECT DISTINCT head, tail FROM parts WHERE part = 'train'), m AS (SELECT count(*) AS n, least(count(*) - 1, greatest(1, round_even(count(*) * 0.3::DOUBLE, 0)::BIGINT)) AS k FROM t),
o AS (SELECT e.epoch, t.head, t.tail, row_number() OVER (PARTITION BY e.epoch ORDER BY md5((42 + e.epoch) || '|' || t.head || '|' || t.tail), t.head, t.tail) AS i FROM t, (SELECT unnest([0, 1, 2]) AS epoch) e),
r AS (SELECT o.epoch::INT AS epoch, o.head, o.tail, CASE WHEN o.i <= m.k THEN 'supervises' ELSE 'graph' END AS role FROM o, m)
SELECT epoch, head, tail, role, false AS reverse FROM r UNION ALL SELECT epoch, tail, head, role, true FROM r WHERE role = 'graph'""")  # SPL-05
def _(spark, sf):
    train = parts_of(spark, sf).where("part = 'train'")
    return reduce(DataFrame.unionByName, [split.supervision(train, e).withColumn("epoch", F.lit(e)) for e in range(3)])


@add("multiset_differences", """WITH a AS (SELECT head, count(*) AS n FROM kg WHERE interaction = 'BOUGHT' GROUP BY head), b AS (SELECT head, count(*) AS n FROM kg WHERE interaction = 'RETURNED' GROUP BY head),
d AS (SELECT coalesce(a.n, 0) - coalesce(b.n, 0) AS d FROM a FULL JOIN b ON a.head = b.head) SELECT sum(greatest(d, 0))::BIGINT AS only_left, sum(greatest(-d, 0))::BIGINT AS only_right, sum(abs(d)) = 0 AS equal FROM d""")  # SET-11: both directions
def _(spark, sf):
    kg = triples(spark, sf, "BOUGHT", "RETURNED")
    left, right = (kg.where(F.col("interaction") == r).select("head") for r in ("BOUGHT", "RETURNED"))
    n = lambda a, b, name: a.exceptAll(b).agg(F.count("*").alias(name))
    both = n(left, right, "only_left").join(F.broadcast(n(right, left, "only_right")))  # one row each
    return both.withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


@add("relatives_with_links", """WITH att AS (SELECT DISTINCT head, tail FROM kg WHERE interaction = 'PART_SIZE'), s AS (SELECT tail, count(*) AS m FROM att GROUP BY tail HAVING count(*) > 1),
w AS (SELECT x.head AS a, y.head AS b, round(1000000.0::DOUBLE / s.m)::BIGINT AS w FROM att x JOIN s ON s.tail = x.tail JOIN att y ON y.tail = x.tail AND y.head <> x.head
UNION ALL SELECT * FROM (SELECT head, tail, 1000000 FROM kg WHERE interaction = 'CO_ORDER' UNION SELECT tail, head, 1000000 FROM kg WHERE interaction = 'CO_ORDER') z),
p AS (SELECT a, b, sum(w) / 1000000 AS weight FROM w GROUP BY a, b) SELECT a AS part, count(*) AS relatives, round(sum(weight), 6) AS weight, round(max(weight), 6) AS nearest FROM p GROUP BY a""")  # GRA-10: direct links and shared attributes
def _(spark, sf):
    kg = triples(spark, sf, "CO_ORDER", "PART_SIZE")
    found = evidence.relatives(kg.where("interaction = 'CO_ORDER'"), kg.where("interaction = 'PART_SIZE'"))
    return found.select(F.col("a").alias("part"), "relatives", F.round("weight", 6).alias("weight"), F.round("nearest", 6).alias("nearest"))


@add("cf_votes_by_heads", f"""{P}, t AS MATERIALIZED (SELECT head, tail FROM parts WHERE part = 'train'), n AS (SELECT head, count(*) AS n FROM t GROUP BY head), c AS MATERIALIZED (SELECT a.head AS a, b.head AS b, count(*) AS c FROM t a JOIN t b ON b.tail = a.tail AND b.head <> a.head WHERE a.head IN (SELECT head FROM parts WHERE part = 'test') GROUP BY a.head, b.head),
w AS (SELECT c.a, c.b, round(c.c / sqrt(x.n::DOUBLE * y.n), 9)::DECIMAL(18,9) AS w FROM c JOIN n x ON x.head = c.a JOIN n y ON y.head = c.b), sc AS MATERIALIZED (SELECT w.a AS head, t.tail, sum(w.w)::DOUBLE AS s FROM w JOIN t ON t.head = w.b GROUP BY w.a, t.tail) """ + ranked_sql("votes of anchors", "sc"))  # GRA-12: the other side
def _(spark, sf):
    parts = parts_of(spark, sf)
    train = parts.where("part = 'train'").select("head", "tail")
    n = train.groupBy("head").agg(F.count("*").alias("n"))
    pool = products.pool_of(parts)
    heads = ids.numbered(n, "head", name="i").select("head", F.col("i").cast("int").alias("i"), F.col("n").cast("int").alias("n"))
    own = graph.cut(train.join(heads, "head").join(pool, "tail").select("head", "i", "n", "tail", "t"))
    asked = own.join(parts.where("part = 'test'").select("head").distinct(), "head", "left_semi").select(F.col("i").alias("a"), F.col("n").alias("x"), "t")
    met = asked.join(own.select(F.col("i").alias("b"), F.col("n").alias("y"), "t"), "t").where("a <> b").groupBy("a", "x", "b", "y").agg(F.count("*").alias("c"))
    w = (F.round(F.col("c") / F.sqrt(F.col("x").cast("double") * F.col("y")), 9).cast("decimal(18,9)") * products.UNIT).cast("long")
    near = met.select("a", F.col("b").alias("mid"), w.alias("w")).join(heads.select("head", F.col("i").alias("a")), "a").select("head", "mid", "w")
    lists = products.lists_of(own.select(F.col("i").alias("mid"), "tail"), pool)
    ranks = products.met_ranks(parts, pool, near, lists, lambda a, b: a["w"][:, None], lambda w: w / products.UNIT, 1)
    return rank.summary(ranks, "votes of anchors")


@add("metapath_best")  # its SQL stays that of the plan
def _(spark, sf):
    kg = triples(spark, sf)
    pairs = lambda relation, a, b: kg.where(F.col("interaction") == relation).select(F.col("head").alias(a), F.col("tail").alias(b))
    n = graph.cut(kg.select(F.col("head").alias("node")).unionByName(kg.select(F.col("tail").alias("node"))).groupBy("node").agg(F.count("*").alias("n")))
    made = pairs("PART_SUPPLIER", "m", "s").join(pairs("SUPPLIER_NATION", "s", "nation"), "s").join(n.toDF("m", "x"), "m").join(n.toDF("s", "y"), "s")
    # of a part and a nation one supplier wins, whoever asks
    last = made.groupBy("m", "nation").agg(F.min(F.struct(F.round(F.log10(F.col("x") + 1) + F.log10(F.col("y") + 1), 6).alias("cost"), "s")).alias("b"))
    best = pairs("RETURNED", "c", "m").join(last, "m").groupBy("c", "nation").agg(F.min(F.struct("b.cost", "m", "b.s")).alias("b"))
    return best.select("c", "nation", F.concat_ws(" -> ", "c", "b.m", "b.s", "nation").alias("chain"), "b.cost")


@add("cf_cosine")  # its SQL stays that of the plan
def _(spark, sf):
    r = triples(spark, sf, "RETURNED").select("head", "tail")
    n = graph.cut(ids.numbered(r.groupBy("tail").agg(F.count("*").alias("n")), "tail", name="t").select("tail", F.col("t").cast("int").alias("t"), "n"))
    own = r.join(n.select("tail", "t"), "tail").select("head", "t")
    # a pair is counted once, by numbers, and named and turned round last
    lists = own.groupBy("head").agg(F.array_sort(F.collect_list("t")).alias("x")).select("x", F.posexplode("x").alias("i", "a"))
    met = lists.select("a", F.explode(F.slice("x", F.col("i") + 2, F.size("x"))).alias("b")).groupBy("a", "b").agg(F.count("*").alias("c"))
    # a part of the table is asked for as often as it stands there
    asked = spark.table("part").groupBy(F.concat(F.lit("Part::"), F.col("p_partkey").cast("string")).alias("tail")).agg(F.count("*").alias("s"))
    told = graph.cut(n.join(asked, "tail", "left").fillna(0, "s"))
    x, y = (told.toDF(f"name_{k}", k, f"n_{k}", f"s_{k}") for k in "ab")
    both = met.join(x, "a").join(y, "b")
    sim = F.round(F.col("c") * F.col("s") / F.sqrt(F.col("n_a") * F.col("n_b") * F.lit(1.0)), 6)
    way = lambda a, b: F.struct(F.col(f"name_{a}").alias("a"), F.col(f"name_{b}").alias("b"), F.col(f"s_{a}").alias("s"))
    each = both.select("c", "n_a", "n_b", F.explode(F.array(way("a", "b"), way("b", "a"))).alias("p")).where("p.s > 0").withColumn("s", F.col("p.s"))
    return each.select("p.a", "p.b", sim.alias("sim"))


def welch(groups: DataFrame) -> DataFrame:
    """(name, t, df, p) of ``groups(name, n1, m1, v1, n0, m0, v0)``, counts, means and variances of two samples; two-sided, null without a test."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for name, n1, m1, v1, n0, m0, v0 in zip(*(c.to_pylist() for c in b.columns)):
                spread = None if min(n1, n0) < 2 else v1 / n1 + v0 / n0
                if not spread:
                    out.append((name, None, None, None))
                    continue
                t = (m1 - m0) / spread**0.5
                df = spread**2 / ((v1 / n1) ** 2 / (n1 - 1) + (v0 / n0) ** 2 / (n0 - 1))
                out.append((name, t, df, stats.t_p(t, df)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [pa.string(), *[pa.float64()] * 3])], ["name", "t", "df", "p"])

    return groups.select("name", "n1", "m1", "v1", "n0", "m0", "v0").mapInArrow(run, "name string, t double, df double, p double")


@add("welch_tests", """WITH k AS (SELECT DISTINCT event_type FROM events), g AS (SELECT k.event_type AS name, count(CASE WHEN e.event_type = k.event_type THEN 1 END) AS n1, avg(CASE WHEN e.event_type = k.event_type THEN value END) AS m1, var_samp(CASE WHEN e.event_type = k.event_type THEN value END) AS v1,
count(CASE WHEN e.event_type <> k.event_type THEN 1 END) AS n0, avg(CASE WHEN e.event_type <> k.event_type THEN value END) AS m0, var_samp(CASE WHEN e.event_type <> k.event_type THEN value END) AS v0 FROM events e CROSS JOIN k GROUP BY k.event_type),
s AS (SELECT name, (m1 - m0) / sqrt(v1 / n1 + v0 / n0) AS t, power(v1 / n1 + v0 / n0, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v0 / n0, 2) / (n0 - 1)) AS df FROM g),
f AS (SELECT s.*, i, CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(lgamma((df + 1) / 2) - lgamma(df / 2) - 0.5 * ln(df * pi()) - (df + 1) / 2 * ln(1 + power(t * i / 4000.0::DOUBLE, 2) / df)) AS y FROM s, (SELECT unnest(range(0, 4001)) AS i) r)
SELECT name, round(t, 6) AS t, round(df, 4) AS df, round(greatest(0, 1 - 2 * sum(y) * abs(t) / 12000), 6) AS p FROM f GROUP BY name, t, df""")  # STA-01: Student's density by Simpson's rule in the check, the incomplete beta function here
def _(spark, sf):
    views(spark, sf)
    each = spark.table("events").groupBy(F.col("event_type").alias("name")).agg(F.count("value").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    all_ = each.agg(F.sum("n").alias("n_"), F.sum("s").alias("s_"), F.sum("q").alias("q_"))
    both = each.join(F.broadcast(all_))  # one row
    n0, s0, q0 = F.col("n_") - F.col("n"), F.col("s_") - F.col("s"), F.col("q_") - F.col("q")
    got = welch(both.select("name", F.col("n").alias("n1"), F.col("m").alias("m1"), F.col("v").alias("v1"), n0.alias("n0"), (s0 / n0).alias("m0"), ((q0 - s0 * s0 / n0) / (n0 - 1)).alias("v0")))
    return got.select("name", F.round("t", 6).alias("t"), F.round("df", 4).alias("df"), F.round("p", 6).alias("p"))


@add("l2_penalty", f"""{P}, {V}, sq AS (SELECT node, list_sum(list_transform(x, lambda z: z * z)) / len(x) AS s FROM v) SELECT count(*) AS n, round(avg(h.s), 9) AS heads, round(avg(t.s), 9) AS tails, round(avg(h.s) + avg(t.s) + (SELECT list_sum(list_transform(r, lambda z: z * z)) / len(r) FROM rel), 9) AS penalty
FROM parts p JOIN sq h ON h.node = p.head JOIN sq t ON t.node = p.tail WHERE p.part = 'train'""")  # LRN-10: the mean over each of the three tables
def _(spark, sf):
    parts = parts_of(spark, sf)
    vectors, _ = _model(spark, parts)
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda a, z: a + z.cast("double") * z.cast("double")) / F.size(x)
    sq = vectors.select("node", mean(F.col("vector")).alias("s"))
    rel = spark.table("embeddings").where("vec_id = 3").select(mean(F.col("embedding")).alias("r"))
    rows = parts.where("part = 'train'").join(sq.toDF("head", "h"), "head").join(sq.toDF("tail", "t"), "tail")
    told = rows.agg(F.count("*").alias("n"), exact.exact_avg(F.col("h")).alias("h"), exact.exact_avg(F.col("t")).alias("t")).join(F.broadcast(rel))  # one row each
    return told.select("n", F.round("h", 9).alias("heads"), F.round("t", 9).alias("tails"), F.round(F.col("h") + F.col("t") + F.col("r"), 9).alias("penalty"))


BETAS = (0.001, 0.01, 0.05, 0.2)
PLATEAU = 0.002


def _katz_sql(beta: float) -> str:
    b = f"{beta}::DOUBLE"
    scores = f"(SELECT head, tail, round(a * {b} + b * ({b} * {b}) + c * ({b} * {b} * {b}), 9) AS s FROM w)"
    return f"SELECT {b} AS beta, mrr FROM ({ranked_sql('katz', scores)}) k{str(beta).replace('.', '')}"


@add("beta_choice", P + ((WALKS.removeprefix(P).rsplit(", sc AS", 1)[0].rsplit(",\nsc AS", 1)[0]) + ", g AS (" + " UNION ALL ".join(map(_katz_sql, BETAS)) + f""") SELECT beta, mrr, row_number() OVER (ORDER BY mrr DESC, beta) = 1 AS chosen,
CASE WHEN row_number() OVER (ORDER BY mrr DESC, beta) > 1 THEN '' WHEN beta NOT IN ({BETAS[0]}, {BETAS[-1]}) THEN 'inside the grid' WHEN mrr - (SELECT max(mrr) FROM g WHERE beta IN ({BETAS[1]}, {BETAS[-2]})) > {PLATEAU} THEN 'the optimum may lie outside' ELSE 'the edge of a plateau' END AS note FROM g""").replace("'test'", "'val'"))  # GRA-13: beta, on validation
def _(spark, sf):
    parts = parts_of(spark, sf)
    judged = parts.withColumn("part", F.when(F.col("part") == "val", "test").when(F.col("part") == "test", "other").otherwise("train"))
    ranks = graph.cut(products.walk_ranks(_walk_edges(spark, sf, parts), judged, products.pool_of(parts), BETAS))
    one = lambda i, b: rank.summary(ranks.where(F.col("method") == i), "katz").select(F.lit(b).alias("beta"), "mrr")
    grid = graph.cut(reduce(DataFrame.unionByName, [one(i, b) for i, b in enumerate(BETAS)]))  # a row a choice
    inner = grid.where(F.col("beta").isin(BETAS[1], BETAS[-2])).agg(F.max("mrr").alias("inner"))
    first = F.row_number().over(Window.orderBy(F.desc("mrr"), "beta")) == 1
    note = F.when(~F.col("chosen"), "").when(~F.col("beta").isin(BETAS[0], BETAS[-1]), "inside the grid").when(F.col("mrr") - F.col("inner") > PLATEAU, "the optimum may lie outside").otherwise("the edge of a plateau")
    return grid.join(F.broadcast(inner)).withColumn("chosen", first).select("beta", "mrr", "chosen", note.alias("note"))
