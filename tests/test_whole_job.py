"""Queries that read whole tables, against brute force that is written apart from the SQL twins."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq

from loomgraph import catalog
from loomgraph.operators import graph, split
from loomgraph.sources import tables

SF = "/root/testdata/sf0.001"


def vectors():
    t = pq.read_table(f"{SF}/embeddings.parquet")
    x = dict(zip(t["vec_id"].to_pylist(), np.array(t["embedding"].to_pylist(), float)))
    return x, [((v * 7 + 1) % len(x), v, v % 3) for v in x]


def degrees(edges):
    deg = defaultdict(int)
    for u, v, _ in edges:
        deg[u] += 1
        deg[v] += 1
    return deg


def test_dirichlet_energy_of_every_edge(spark):
    x, edges = vectors()
    deg, want = degrees(edges), defaultdict(float)
    for u, v, rel in edges:
        want[rel] += float(((x[u] / math.sqrt(deg[u]) - x[v] / math.sqrt(deg[v])) ** 2).sum())
    got = {r.rel: r.energy for r in catalog.QUERIES["dirichlet_energy"](spark, SF).collect()}
    assert len(edges) > 400 and set(got) == set(want) and all(abs(got[r] - want[r]) < 1e-3 for r in want)


def test_rgcn_step_of_every_node(spark):
    x, edges = vectors()
    i = np.arange(64)
    basis = [np.sin(b * 3.0 + i[:, None] * 0.7 + i[None, :] * 1.3) for b in (0, 1)]
    want = {v: sum(math.cos(rel * 2.0 + b) * (x[u] @ basis[b]) for b in (0, 1)) for u, v, rel in edges}  # one edge into each
    got = {(r.node, r.o): r.y for r in catalog.QUERIES["rgcn_step"](spark, SF).collect()}
    assert set(got) == {(v, o) for v in x for o in range(64)}
    assert all(abs(y - want[v][o]) < 1e-3 for (v, o), y in got.items())


def test_rgcn_step_sends_whole_vectors(spark):
    plan = catalog.QUERIES["rgcn_step"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode") == 1 and "Aggregate" not in plan.split("MapInArrow")[0]


def test_compgcn_step_over_every_edge(spark):
    x, edges = vectors()
    i = np.arange(64)
    deg = degrees(edges)
    want = {v: y * np.cos(6.0 + i) for v, y in x.items()}
    for u, v, rel in edges:
        root = math.sqrt(deg[u] * deg[v])
        want[v] = want[v] + x[u] * np.cos(rel + i) / root
        want[u] = want[u] + x[v] * np.cos(rel + 3 + i) / root
    got = {(r.node, r.i): r.y for r in catalog.QUERIES["compgcn_step"](spark, SF).collect()}
    assert set(got) == {(v, o) for v in x for o in range(64)}
    assert all(abs(y - want[v][o] / 3.0) < 1e-3 for (v, o), y in got.items())


def number(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def negatives(test, true, attempts=50):
    heads, tails = sorted({h for h, _ in true}), sorted({t for _, t in true})
    for h, t in test:
        keys = [f"42|{h}|{t}|{k}" for k in range(1, attempts + 1)]
        tried = ((heads[number(x) % len(heads)], t) if number(x + "|side") % 2 == 0 else (h, tails[number(x) % len(tails)]) for x in keys)
        yield (h, t, *next((x for x in tried if x not in true), (h, t)))


def test_negatives_are_no_positive_of_any_part(spark):
    parts = split.stratified(tables.triples(spark, SF, "RETURNED").select("head", "tail")).collect()
    true, test = {(r.head, r.tail) for r in parts}, [(r.head, r.tail) for r in parts if r.part == "test"]
    got = [tuple(r) for r in catalog.QUERIES["neg_filtered"](spark, SF).collect()]
    assert sorted(got) == sorted(negatives(test, true))
    assert not any((h, t) != (nh, nt) and (nh, nt) in true for h, t, nh, nt in got)


def test_a_dense_anchor_gets_fifty_attempts(spark):
    true = {(f"h{i}", f"t{j}") for i in range(20) for j in range(20) if (i * 7 + j) % 20 > 0}  # one free pair a head and a tail
    df = spark.createDataFrame(sorted(true), "head string, tail string")
    got = [tuple(r) for r in split.filtered_negatives(df, df).collect()]
    assert sorted(got) == sorted(negatives(true, true))
    assert sorted(got) != sorted(negatives(true, true, 10))


def union_find(pairs):
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {a: find(a) for a in parent}


def test_components_of_the_whole_graph(spark):
    want = union_find([(r.head, r.tail) for r in tables.triples(spark, SF).collect()])
    assert {r.node: r.component for r in catalog.QUERIES["components"](spark, SF).collect()} == want
    sizes = Counter(want.values()).values()
    got = [tuple(r[:4]) for r in catalog.QUERIES["component_histogram"](spark, SF).collect()]
    assert got == [("101-1000", len(sizes), sum(sizes), max(sizes))]


def test_largest_component_keeps_its_edges(spark):
    rows = [("a", "R", "b"), ("b", "S", "c"), ("c", "R", "d"), ("x", "R", "y"), ("y", "R", "x"), ("y", "S", "z"), ("b", "R", "a")]
    df = spark.createDataFrame(rows, "head string, interaction string, tail string")
    kept = graph.largest_component(df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == sorted(r for r in rows if r[0] in "abcd")


def hops(spark, *relations):
    parts = split.stratified(tables.triples(spark, SF, "RETURNED").select("head", "tail")).collect()
    near = defaultdict(set)
    for h, t in [(r.head, r.tail) for r in parts if r.part == "train"] + [(r.head, r.tail) for r in tables.triples(spark, SF, *relations).collect()]:
        near[h].add(t)
        near[t].add(h)
    return near, parts


def test_distance_to_four_hops(spark):
    near, parts = hops(spark, "PART_BRAND", "CUST_NATION")
    want = {}
    for h, t in ((r.head, r.tail) for r in parts if r.part == "test"):
        dist, front = {h: 0}, [h]
        for d in range(1, 5):
            front = sorted({v for u in front for v in near[u]} - set(dist))
            dist.update(dict.fromkeys(front, d))
        want[h, t] = dist.get(t, -1)
    got = {(r.head, r.tail): r.dist for r in catalog.QUERIES["bfs_distance"](spark, SF).collect()}
    assert got == want and max(want.values()) > 2


def test_mass_after_thirty_rounds(spark):
    near, parts = hops(spark, "CUST_NATION")
    nodes = sorted(near)
    at = {v: i for i, v in enumerate(nodes)}
    step = np.zeros((len(nodes), len(nodes)))
    for u, vs in near.items():
        for v in vs:
            step[at[v], at[u]] = 1 / len(vs)
    pool = sorted({r.tail for r in parts})
    known = defaultdict(set)
    for r in parts:
        known[r.head].add(r.tail)
    heads = sorted({r.head for r in parts if r.part == "test"})
    start = np.zeros((len(nodes), len(heads)))
    start[[at[s] for s in heads], range(len(heads))] = 1
    mass = start
    for _ in range(30):
        mass = 0.15 * start + 0.85 * step @ mass
    value = lambda h, t: round(float(mass[at[t], heads.index(h)]), 9) if t in at else 0.0
    rows = {(r.head, r.tail): r for r in catalog.QUERIES["ppr"](spark, SF).collect()}
    assert set(rows) == {(r.head, r.tail) for r in parts if r.part == "test"}
    for (h, t), r in rows.items():
        s = value(h, t)
        others = [value(h, c) for c in pool if c not in known[h]]
        assert abs(r.mass - s) < 2e-6
        assert sum(x > s + 1e-8 for x in others) <= r["rank"] - 1 <= sum(x >= s - 1e-8 for x in others)


def test_page_rank_in_blocks_of_sources(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), ("d", "d"), ("b", "a")]
    edges = spark.createDataFrame(pairs, "head string, tail string")
    names = ["a", "y", "alone", "d"]
    sources = spark.createDataFrame([(n,) for n in names], "node string")
    near = defaultdict(set)
    for u, v in pairs:
        if u != v:
            near[u].add(v)
            near[v].add(u)
    want = {}
    for s in names:
        mass = {s: 1.0}
        for _ in range(7):
            new = defaultdict(float, {s: 0.15})
            for u, m in mass.items():
                for v in near[u]:
                    new[v] += 0.85 * m / len(near[u])
            mass = new
        want |= {(s, v): m for v, m in mass.items()}
    for together in (1, 3, 64):
        got = {(r.source, r.node): r.mass for r in graph.page_rank(edges, sources, rounds=7, together=together).collect()}
        assert set(got) == set(want) and all(abs(got[k] - v) < 1e-12 for k, v in want.items())
    pool = spark.createDataFrame([("a",), ("d",)], "node string")
    assert {r.node for r in graph.page_rank(edges, sources, rounds=3, pool=pool).collect()} == {"a", "d"}


def test_effective_rank_by_decomposition(spark):
    x, _ = vectors()
    z = np.array(list(x.values()))
    sv = np.linalg.svd(z - z.mean(0), compute_uv=False)
    p = sv / sv.sum()
    r = catalog.QUERIES["effective_rank"](spark, SF).first()
    assert r.n == len(z) and abs(r.effective_rank - math.exp(-(p * np.log(p)).sum())) < 1e-3
    assert catalog.QUERIES["effective_rank"].__globals__["vectors"].effective_rank(spark.createDataFrame([], "embedding array<float>")).first().n == 0
