"""All registered queries of the knowledge-graph engine and their SQL twins."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.operators import ids, rank, split
from loomgraph.plans import comparisons, evaluation, features, models, ranking, reviewing, sql
from loomgraph.plans.ranking import plain_ranks as _rank_sql
from loomgraph.sources.tables import KG, NAMES, register, triples, views
from loomgraph.streaming import windows

WITH_KG = f"WITH RECURSIVE kg AS MATERIALIZED ({KG}) "


def named_in(text_: str) -> list[str]:
    """The relations that a plan reads: those it names if every use of ``kg`` is held to some, else all."""
    uses, held = len(re.findall(r"\bkg\b", text_)), len(re.findall(r"\binteraction (?:=|IN)", text_))
    return [name for name in NAMES if f"'{name}'" in text_ or uses > held]


def _plan(text_: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if re.search(r"\bkg\b", text_):
            register(spark, sf_dir, *named_in(text_))
        else:
            views(spark, sf_dir)
        return spark.sql(text_)

    return run


def _duck(text_: str) -> str:
    """Put ``kg`` before the plan's own common tables."""
    t = text_.strip().removeprefix("WITH RECURSIVE ").removeprefix("WITH ")
    return WITH_KG.rstrip() + ", " + t if t != text_.strip() else WITH_KG + t


QUERIES = {name: _plan(sql.spark_text(name)) for name in sql.PLANS}
ORACLES = {name: _duck(sql.duck_text(name)) for name in sql.PLANS}
for _name, _text in (ranking.PLANS | features.PLANS).items():
    _here, _there = (_text, _text) if isinstance(_text, str) else _text
    QUERIES[_name], ORACLES[_name] = _plan(sql.dialect(_here, False)), _duck(sql.dialect(_there, True))
QUERIES |= evaluation.QUERIES | reviewing.QUERIES | models.QUERIES | comparisons.QUERIES
ORACLES |= {name: _duck(text_) for name, text_ in (evaluation.ORACLES | reviewing.ORACLES | models.ORACLES | comparisons.ORACLES).items()}
PARTS = "WITH parts AS (" + sql.SPLIT + ")"


def add(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = _duck(oracle.replace("{bround}", "round_even"))
        return f

    return keep


_parts = evaluation.parts_of


@add("rank_popularity_tail", _rank_sql("head", "tail"))
def _(spark, sf):
    return rank.popularity_ranks(_parts(spark, sf), "head", "tail")


@add("rank_popularity_head", _rank_sql("tail", "head"))
def _(spark, sf):
    return rank.popularity_ranks(_parts(spark, sf), "tail", "head")


@add("mrr_hits", "WITH ranked AS (" + _rank_sql("head", "tail") + ") SELECT count(*) AS n, round(avg(1.0 / rank), 6) AS mrr, round(avg(1.0 / expected), 6) AS mrr_expected, round(avg((rank <= 1)::INT::DOUBLE), 6) AS hits_1, round(avg((rank <= 3)::INT::DOUBLE), 6) AS hits_3, round(avg((rank <= 10)::INT::DOUBLE), 6) AS hits_10, max(rank) AS worst FROM ranked")
def _(spark, sf):
    return rank.mrr_hits(rank.popularity_ranks(_parts(spark, sf)))


@add("split_undersample", "SELECT head, interaction, tail FROM kg ORDER BY md5('42|' || head || '|' || interaction || '|' || tail), head, interaction, tail LIMIT 500")
def _(spark, sf):
    return split.undersample(triples(spark, sf), 500)


@add("split_oversample", "SELECT head, interaction, tail, g.c AS copy FROM kg CROSS JOIN range(1, 4) g(c) WHERE interaction = 'PART_BRAND'")
def _(spark, sf):
    return split.oversample(triples(spark, sf, "PART_BRAND"), 3)


@add("norm_name_parts", r"SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(p_name || ' (2+)')), '\s*\(\d*[+-]\)$', ''), '^\((?:r|s|e|z|\+|-)\)-', ''), '[^a-z0-9 ]', '', 'g')) AS name FROM part")
def _(spark, sf):
    views(spark, sf)
    return spark.table("part").select("p_partkey", text.norm_name(F.concat("p_name", F.lit(" (2+)"))).alias("name"))


@add("family_key_parts", r"SELECT p_partkey, CASE WHEN len(t) >= 2 THEN array_to_string(list_slice(t, 1, 3), ' ') END AS family FROM (SELECT p_partkey, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(p_name || ' type-' || p_type), '\(human\)', '', 'g'), '[0-9]', '', 'g'), '[,\- ]'), lambda x: length(x) > 2) AS t FROM part) a")
def _(spark, sf):
    views(spark, sf)
    return spark.table("part").select("p_partkey", text.family_key(F.concat("p_name", F.lit(" type-"), "p_type")).alias("family"))


@add("distmult_scores", "SELECT a.vec_id AS h, b.vec_id AS t, round(list_sum(list_transform(list_zip(a.embedding, r.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE * z[3]::DOUBLE)), 4) + 0.0 AS score FROM embeddings a JOIN embeddings r ON r.vec_id = 3 JOIN embeddings b ON b.vec_id = (a.vec_id * 7 + 1) % (SELECT count(*) FROM embeddings)")
def _(spark, sf):
    views(spark, sf)
    e = spark.table("embeddings")
    a = e.crossJoin(F.broadcast(e.agg(F.count("*").alias("n")))).select(F.col("vec_id").alias("h"), F.col("embedding").alias("x"), ((F.col("vec_id") * 7 + 1) % F.col("n")).alias("t"))
    r = e.where("vec_id = 3").select(F.col("embedding").alias("r"))
    b = e.select(F.col("vec_id").alias("t"), F.col("embedding").alias("y"))
    both = a.join(b, "t").join(F.broadcast(r))  # one row
    xr = F.zip_with("x", "r", lambda p, q: p.cast("double") * q.cast("double"))
    return both.select("h", "t", (F.round(text.dot(xr, F.col("y")), 4) + F.lit(0.0)).alias("score"))


@add("events_sessions", "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events) a) b GROUP BY user_id, s")
def _(spark, sf):
    views(spark, sf)
    return windows.sessions(spark.table("events"))


@add("auroc_popularity", PARTS + ", s AS (SELECT x.tail, count(p.tail) AS d FROM (SELECT DISTINCT tail FROM parts) x LEFT JOIN parts p ON p.tail = x.tail AND p.part = 'train' GROUP BY x.tail), y AS (SELECT s.d, CASE WHEN part = 'test' THEN 1 ELSE 0 END AS y FROM parts JOIN s ON parts.tail = s.tail WHERE part <> 'train') SELECT round((sum(CASE WHEN a.y = 1 AND b.y = 0 AND a.d > b.d THEN a.c * b.c * 1.0 ELSE 0 END) + 0.5 * sum(CASE WHEN a.y = 1 AND b.y = 0 AND a.d = b.d THEN a.c * b.c ELSE 0 END)) / max((SELECT count(*) FROM y WHERE y = 1) * (SELECT count(*) FROM y WHERE y = 0)), 6) AS auroc FROM (SELECT d, y, count(*) AS c FROM y GROUP BY d, y) a CROSS JOIN (SELECT d, y, count(*) AS c FROM y GROUP BY d, y) b")
def _(spark, sf):
    return rank.auroc(_labelled(spark, sf))


@add("auprc_popularity", PARTS + ", s AS (SELECT x.tail, count(p.tail) AS d FROM (SELECT DISTINCT tail FROM parts) x LEFT JOIN parts p ON p.tail = x.tail AND p.part = 'train' GROUP BY x.tail), h AS (SELECT s.d, sum(CASE WHEN part = 'test' THEN 1 ELSE 0 END) AS tp, count(*) AS n FROM parts JOIN s ON parts.tail = s.tail WHERE part <> 'train' GROUP BY s.d) SELECT round(sum(tp * prec) / sum(tp), 6) AS auprc FROM (SELECT tp, (SELECT sum(z.tp) * 1.0 / sum(z.n) FROM h z WHERE z.d >= h.d) AS prec FROM h) q")
def _(spark, sf):
    return rank.auprc(_labelled(spark, sf))


def _labelled(spark, sf):
    parts = _parts(spark, sf)
    d = parts.where("part = 'train'").groupBy("tail").agg(F.count("*").alias("score"))
    return parts.where("part <> 'train'").join(d, "tail", "left").fillna(0, "score").select("score", (F.col("part") == "test").cast("int").alias("y"))


@add("rank_dump", f"WITH a AS ({_rank_sql('head', 'tail')}), b AS ({_rank_sql('tail', 'head')}) SELECT a.head, a.tail, a.rank AS rank_tail, b.rank AS rank_head, round((1.0::DOUBLE / a.rank + 1.0::DOUBLE / b.rank) / 2, 6) AS rr_mean FROM a JOIN b ON a.head = b.head AND a.tail = b.tail")
def _(spark, sf):
    parts = _parts(spark, sf)
    by_tail = rank.popularity_ranks(parts).select("head", "tail", F.col("rank").alias("rank_tail"))
    by_head = rank.popularity_ranks(parts, "tail", "head").select("head", "tail", F.col("rank").alias("rank_head"))
    return by_tail.join(by_head, ["head", "tail"]).withColumn("rr_mean", F.round((1 / F.col("rank_tail") + 1 / F.col("rank_head")) / 2, 6))


@add("rank_unfiltered", _rank_sql("head", "tail", filtered=False))
def _(spark, sf):
    return rank.popularity_ranks(_parts(spark, sf), filtered=False)




@add("split_disjoint_supervision")  # numbered by ranges; its SQL stays that of the plan
def _(spark, sf):
    train = _parts(spark, sf).where("part = 'train'").select("head", "tail")
    n = train.count()
    told = ids.numbered(train.withColumn("_o", F.md5(F.concat(F.lit("7|"), "head", F.lit("|"), "tail"))), "_o", "head", "tail", name="i")
    return told.select("head", "tail", (F.col("i") < min(n - 1, max(1, round(n * 0.3)))).alias("supervises"))
