"""Steps whose cost must follow the input: the graph's tables, ranks over shared lists, counts by classes."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from loomgraph import catalog
from loomgraph.operators import draws, graph, scoring
from loomgraph.plans import models
from loomgraph.sources import tables

SF = "/root/testdata/sf0.001"


def test_relations_are_those_of_the_definition(spark):
    tables.views(spark, SF)
    want = sorted(map(tuple, spark.sql(tables.KG).collect()))
    got = sorted((r.head, name, r.tail) for name, df in tables.relations(spark).items() for r in df.collect())
    assert len(want) > 1_000 and got == want


def test_plans_without_the_graph_do_not_write_it(spark, monkeypatch):
    monkeypatch.setattr(tables, "_written", {})
    for name in ("effective_rank", "first_and_newest", "events_tumbling", "events_sessions", "cumulative_within"):
        catalog.QUERIES[name](spark, SF).collect()
    assert not tables._written


def test_competitors_count_equal_scores_and_need_no_tiles(spark, monkeypatch):
    monkeypatch.setattr(models.scoring, "best", None)
    assert "c.s >= x.s" in catalog.ORACLES["competitors_above"]
    got = catalog.QUERIES["competitors_above"](spark, SF).collect()
    duck = duckdb.connect()
    for name in ("lineitem", "orders", "part", "supplier", "customer", "nation"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want = duck.execute(catalog.ORACLES["competitors_above"]).fetchall()
    assert want and sorted(map(tuple, got)) == sorted(want)


def test_enrichment_by_shared_values_is_that_by_listed_pairs(spark):
    nodes = spark.createDataFrame([(f"t{i}",) for i in range(40)], "node string")
    values = spark.createDataFrame([("same", f"t{i}", f"v{i % 5}") for i in range(40)], "criterion string, node string, value string")
    pairs = [("same", f"t{a}", f"t{b}") for a in range(40) for b in range(40) if a != b and a % 5 == b % 5]
    schema = "criterion string, target string, other string"
    observed = spark.createDataFrame([("i", "t1", "t6"), ("i", "t1", "t2"), ("j", "t3", "t8")], "item string, target string, other string")
    want = draws.enrichment(observed, nodes, spark.createDataFrame(pairs, schema)).collect()
    got = draws.enrichment(observed, nodes, spark.createDataFrame([], schema), values=values).collect()
    assert want and got == want


def test_equal_vectors_are_scored_once(spark, monkeypatch):
    seen, dealt = [], scoring._dealt
    monkeypatch.setattr(scoring, "_dealt", lambda q, c, *rest: seen.append((q.count(), c.count())) or dealt(q, c, *rest))
    parts = spark.createDataFrame([(f"h{i}", f"t{j}", "test" if (i + j) % 3 == 0 else "train") for i in range(12) for j in range(30) if (i * j) % 4 == 1], "head string, tail string, part string")
    queries = spark.createDataFrame([(f"h{i}", [1.0, i % 2 - 0.5]) for i in range(12)], "node string, query array<double>")
    vectors = spark.createDataFrame([(f"t{j}", [j % 3 / 2, 1.0]) for j in range(30)], "node string, vector array<double>")
    rows = [tuple(r) for r in parts.collect()]
    score = lambda h, t: int(t[1:]) % 3 / 2 + int(h[1:]) % 2 - 0.5
    known, pool = {(h, t) for h, t, _ in rows}, {t for _, t, _ in rows}
    want = {}
    for h, t, part in rows:
        if part == "test":
            other = [score(h, x) for x in pool if (h, x) not in known]
            want[h, t] = sum(x > score(h, t) for x in other), sum(x == score(h, t) for x in other)
    got = {(r.head, r.tail): (r.greater, r.ties) for r in scoring.model_ranks(parts, queries, vectors).collect()}
    assert got == want and seen and all(q <= 2 and c <= 3 for q, c in seen)


def test_best_novel_orders_equal_scores_of_different_vectors_by_name(spark):
    queries = spark.createDataFrame([("g", [1.0, 0.0]), ("h", [1.0, 0.0])], "node string, query array<double>")
    vectors = spark.createDataFrame([(f"t{j:02}", [1.0, float(j * 7 % 20)]) for j in range(20)], "node string, vector array<double>")
    known = spark.createDataFrame([("h", "t00"), ("h", "t02"), ("h", "t19")], "anchor string, node string")
    got = {(r.anchor, r.place): r.node for r in scoring.best_novel(queries, vectors, known, 2).collect()}
    assert got == {("g", 1): "t00", ("g", 2): "t01", ("h", 1): "t01", ("h", 2): "t03"}


@pytest.mark.parametrize("hops", [2, 3, 4])
def test_pair_distance_is_that_of_a_plain_search_and_makes_no_balls(spark, monkeypatch, hops):
    monkeypatch.setattr(graph, "bfs", None)
    edges = [(f"a{i}", f"b{i * 5 % 17}") for i in range(30)] + [(f"b{i}", f"c{i % 4}") for i in range(17)] + [("c0", "d"), ("d", "e"), ("a1", "a1"), ("a1", "a2")]
    near: dict[str, set[str]] = {}
    for u, v in edges:
        if u != v:
            near.setdefault(u, set()).add(v), near.setdefault(v, set()).add(u)
    asked = [(f"a{i}", x) for i in range(6) for x in ("a1", "a7", "b3", "c0", "d", "e", "none")]
    want = {}
    for h, t in asked:
        front, seen, d = {h}, {h}, 0
        while t not in seen and d < hops and front:
            front = {x for n in front for x in near.get(n, ())} - seen
            seen |= front
            d += 1
        want[h, t] = d if t in seen else -1
    got = graph.pair_distance(spark.createDataFrame(edges, "head string, tail string"), spark.createDataFrame(asked, "head string, tail string"), hops)
    assert {(r.head, r.tail): r.dist for r in got.collect()} == want


def test_supervision_has_no_window_over_all_rows_and_a_name_meets_counted_edges(spark):
    plan = lambda name: catalog.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "Window" not in plan("split_disjoint_supervision")
    assert "count(head" in plan("kg_coverage_zero_rows").split("Join")[-1]
    assert plan("relative_contrast").count("generate posexplode") == 0


def test_queries_write_the_relations_that_they_name_only(spark, monkeypatch):
    monkeypatch.setattr(tables, "_written", {})
    for name in ("duplicate_leaks", "composite_metric", "lca_distance", "rank_popularity_tail"):
        assert catalog.QUERIES[name](spark, SF).count()
    (paths,) = tables._written.values()
    assert set(paths) == {"RETURNED", "CUST_NATION", "SUPPLIER_NATION", "NATION_REGION"}


def test_plans_find_all_they_need_in_the_relations_that_they_name():
    duck = duckdb.connect()
    for name in tables.TABLES:
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    duck.execute(f"CREATE TABLE whole AS {tables.KG}")
    texts = {name: catalog.sql.duck_text(name) for name in catalog.sql.PLANS} | {name: catalog.sql.dialect(t if isinstance(t, str) else t[1], True) for name, t in (catalog.ranking.PLANS | catalog.features.PLANS).items()}
    fewer = 0
    for name, text in texts.items():
        if "kg" in text and len(need := catalog.named_in(text)) < len(tables.NAMES):
            rows = []
            for where in ("true", f"interaction IN ({', '.join(map(repr, need))})"):
                duck.execute(f"CREATE OR REPLACE VIEW kg AS SELECT * FROM whole WHERE {where}")
                rows.append(duck.execute(f"SELECT count(*), sum(hash(x)::DOUBLE) FROM ({text}) x").fetchone())
            assert rows[0] == pytest.approx(rows[1], rel=1e-6), name
            fewer += 1
    assert fewer > 20


def test_a_task_gives_a_large_forest_away(monkeypatch):
    from loomgraph.operators import components

    monkeypatch.setattr(components, "CONTRACT_EDGES", 10)
    u, v = np.arange(1, 101), np.arange(100)
    batches = [pa.RecordBatch.from_arrays([pa.array(u[i : i + 5]), pa.array(v[i : i + 5])], ["u", "v"]) for i in range(0, 100, 5)]
    out = list(components._contract(iter(batches), 20))
    assert len(out) > 2 and all(b.num_rows <= 40 for b in out)
    whole = components._forest(*(np.concatenate([b.column(i).to_numpy() for b in out]) for i in range(2)))
    assert len(whole[0]) == 100 and not whole[1].any()


def test_components_tell_no_edges_apart_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(graph, "undirected", None)
    edges = spark.createDataFrame([("b", "a"), ("a", "b"), ("b", "c"), ("b", "c"), ("d", "d"), ("f", "e")], "head string, tail string")
    assert {(r.node, r.component) for r in graph.components(edges).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("e", "e"), ("f", "e")}


def test_a_walk_that_no_types_allow_is_not_asked(spark, monkeypatch):
    """Sides of a bipartite graph have no distance of two or four, so nothing is listed for them."""
    edges = [(f"C::{i}", f"P::{j}") for i in range(12) for j in range(12) if (i + j) % 7 == 0] + [(f"P::{j}", "B::0") for j in range(0, 12, 3)] + [("C::11", "N::1"), ("D::x", "N::1")]
    pairs = [(f"C::{i}", f"P::{j}") for i in range(12) for j in range(12)] + [("C::1", "C::1"), ("C::0", "C::7"), ("D::x", "C::0"), ("Q::1", "C::1")]
    near = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v), near.setdefault(v, set()).add(u)
    want = {}
    for h, t in pairs:
        front, seen, d = {h}, {h}, 0
        while t not in seen and d < 4 and front:
            front = {x for n in front for x in near.get(n, ())} - seen
            seen |= front
            d += 1
        want[h, t] = d if t in seen else -1
    df = spark.createDataFrame(edges, "head string, tail string"), spark.createDataFrame(pairs, "head string, tail string")
    assert {(r.head, r.tail): r.dist for r in graph.pair_distance(*df).collect()} == want and {1, 2, 3, -1} <= set(want.values())
    plans = []
    kept = graph.cut
    monkeypatch.setattr(graph, "cut", lambda x: plans.append(x._jdf.queryExecution().optimizedPlan().toString()) or kept(x))
    assert {(r.head, r.tail): r.dist for r in graph.pair_distance(df[0], df[1].where("head like 'C%' and tail like 'P%'")).collect()} == {k: v for k, v in want.items() if k[0][0] == "C" and k[1][0] == "P"}
    assert plans and not any("count(1)" in p for p in plans)  # neighbours are counted for four hops only
