"""Operators on small inputs against plain Python: ranks by any score, tests of runs, hierarchies, names, numbers, ingest."""

import io
import itertools
import json
import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import stats, text
from loomgraph.operators import graph, hierarchy, ids, rank, split, tests_of_runs
from loomgraph.sources import ingest, sinks, tables


@pytest.mark.parametrize("side,filtered,whole", [("tail", True, False), ("tail", False, False), ("head", True, False), ("tail", True, True), ("head", False, True)])
def test_ranks_by_any_score(spark, side, filtered, whole):
    rng = random.Random(1)
    pairs = rng.sample([(f"h{i}", f"t{j}") for i in range(9) for j in range(12)], 60)
    parts = [(h, t, rng.choice(["train", "train", "val", "test"])) for h, t in pairs]
    scores = {(f"h{i}", f"t{j}"): rng.choice([-1.0, 0.0, 0.5, 1.0, 2.0]) for i in range(9) for j in range(14) if rng.random() < 0.6}
    nodes = [f"h{i}" for i in range(9)] + [f"t{j}" for j in range(13)]
    pool = set(nodes) if whole else {p[side == "tail"] for p in pairs}
    df = spark.createDataFrame(parts, "head string, tail string, part string")
    sc = spark.createDataFrame([(*k, v) for k, v in scores.items()], "head string, tail string, score double")
    got = {(r.head, r.tail): (r.greater, r.ties) for r in rank.score_ranks(df, sc, spark.createDataFrame([(n,) for n in nodes], "node string") if whole else None, side, filtered).collect()}
    want = {}
    for h, t, p in parts:
        if p == "test":
            other = lambda c: (h, c) if side == "tail" else (c, t)
            s = scores.get((h, t), 0.0)
            cands = [c for c in pool if other(c) != (h, t) and not (filtered and other(c) in pairs)]
            want[h, t] = (sum(scores.get(other(c), 0.0) > s for c in cands), sum(scores.get(other(c), 0.0) == s for c in cands))
    assert got == want


def test_distributions():
    for df in (1, 2, 5, 30):  # by Simpson's rule over the density
        c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
        for t in (0.3, 1.0, 2.5):
            f = lambda x: c * (1 + x * x / df) ** (-(df + 1) / 2)
            n = 2000
            area = sum((1 if i in (0, n) else 4 if i % 2 else 2) * f(i * t / n) for i in range(n + 1)) * t / n / 3
            assert abs(stats.t_above(t, df) - (0.5 - area)) < 1e-9 and abs(stats.t_above(-t, df) - (0.5 + area)) < 1e-9
    assert abs(stats.t_quantile(0.975, 9) - 2.262157) < 1e-5 and abs(stats.t_quantile(0.975, 1) - 12.706205) < 1e-4  # printed tables
    for n in (3, 6, 9):
        sums = [sum(r for r, up in zip(range(1, n + 1), ups) if up) for ups in itertools.product((0, 1), repeat=n)]
        for w in range(n * (n + 1) // 2 + 1):
            above, below = sum(x >= w for x in sums) / 2**n, sum(x <= w for x in sums) / 2**n
            assert stats.wilcoxon_p(w, n, 0, False, "greater") == above and stats.wilcoxon_p(w, n, 0, False) == min(1.0, 2 * min(above, below))
    assert stats.p_text(None) == "n/a" and stats.p_text(0.0001) == "<0.001" and stats.p_text(0.25) == "0.250" and stats.mean_sd_text(0.5, 0.01) == "0.500±0.010"


def test_paired_comparison(spark):
    rng = random.Random(2)
    base = {i: rng.random() for i in range(10)}
    runs = [("full", i, v) for i, v in base.items()] + [("more", i, v + 0.2 + 0.02 * rng.random()) for i, v in base.items()]
    runs += [("same", i, v + 0.001 * (-1) ** i) for i, v in base.items()] + [("nothing", i, v) for i, v in base.items()] + [("one", 3, 0.5), ("more", 11, 9.0), ("gone", 1, float("nan")), ("gone", 2, None)]
    df = spark.createDataFrame(runs, "variant string, run int, value double")
    got = {r.variant: r for r in tests_of_runs.verdicts(tests_of_runs.paired_comparison(df, "full", ["more", "nothing"], "greater", 0.05)).collect()}
    d = [dict((i, v) for n, i, v in runs if n == "more")[i] - base[i] for i in range(10)]
    mean = sum(d) / 10
    sd = math.sqrt(sum((x - mean) ** 2 for x in d) / 9)
    m = got["more"]
    assert set(got) == {"more", "same", "nothing", "one"} and (m.n, m.role, m.verdict) == (10, "primary", "better")
    assert abs(m.t - mean / (sd / 10**0.5)) < 1e-4 and abs(m.ci_low - (mean - 2.262157 * sd / 10**0.5)) < 1e-6 and m.p_w == 1 / 1024
    assert m.p_holm == m.p_t and got["same"].p_holm is None and (got["same"].role, got["same"].verdict) == ("secondary", "equivalent")
    assert got["nothing"].p_t is None and got["nothing"].verdict == "not testable" and got["one"].n == 1 and got["one"].p_t is None


def test_hierarchy_of_any_shape(spark):
    rng = random.Random(3)
    edges = {(f"n{a}", f"n{b}") for a, b in (sorted(rng.sample(range(16), 2)) for _ in range(40))} | {("n1", "n0"), ("n3", "n3"), ("n15", "q"), ("q", "n15")}
    edges |= {("n0", "n1")}
    nodes = sorted({x for e in edges for x in e})
    up = lambda es: {n: set() for n in nodes} | {c: {p for a, p in es if a == c} for c, _ in es}

    def reach(es):
        near, out = up(es), {}
        for n in nodes:
            todo, seen = [n], set()
            while todo:
                for p in near[todo.pop()] - seen:
                    seen.add(p)
                    todo.append(p)
            out[n] = seen
        return out

    r = reach({e for e in edges if e[0] != e[1]})
    dag = {(c, p) for c, p in edges if c != p and c not in r[p]}
    r = reach(dag)
    want = {(c, p) for c, p in dag if not any(p in r[x] for a, x in dag if a == c)}
    red = graph.cut(hierarchy.reduced(spark.createDataFrame(sorted(edges), "c string, p string")))
    assert {tuple(x) for x in red.collect()} == want and len(want) < len(dag) < len(edges)
    near = up(want)
    steps = {}
    for n in nodes:
        steps[n], front = {n: 0}, {n}
        while front:
            front = {p for x in front for p in near[x]} - set(steps[n])
            steps[n].update(dict.fromkeys(front, max(steps[n].values()) + 1))
    inside = {x for e in want for x in e}
    below = {a: sum(a in steps[n] and n != a for n in inside) for a in nodes}
    pairs = [(a, b) for a in [*nodes, "none"] for b in nodes if a != b and b in inside]
    got = {(x.a, x.b): (x.dist, x.lca) for x in hierarchy.lca_distance(red, spark.createDataFrame(pairs, "a string, b string"), 4).collect()}
    for a, b in pairs:
        if a not in inside:
            assert got[a, b] == (-2, "")
            continue
        options = [(steps[a][x] + steps[b][x], x not in (a, b), x) for x in steps[a].keys() & steps[b].keys() if x in (a, b) or below[x] <= 4]
        assert got[a, b] == ((min(options)[0], min(options)[2]) if options else (-1, ""))


def test_compound_keys():
    key = text.compound_key
    assert key("Imatinib Mesylate") == key("imatinib") == "imatinib" and key("methotrexate(2-)") == "methotrexate"
    assert key("sodium chloride") == "sodiumchloride" and key("zinc sulfate") == "zincsulfate" and key("tin oxalate") == "tinoxalate"
    assert key("cidofovir dihydrate") == "cidofovir" and key("morphine sulfate hydrochloride anhydrous") == "morphine" and key("insulin (human)") == "insulin"
    assert key("(R)-warfarin sodium") == "rwarfarin" and key("(R)-warfarin sodium", True) == "warfarin" == key("dl cis-warfarin", True)
    assert key(None) == "" and key("") == "" and key("sodium") == "sodium"


def test_numbers_in_a_global_order(spark):
    rows = [(f"k{i:04}", i % 7) for i in random.Random(4).sample(range(2000), 2000)]
    got = ids.numbered(spark.createDataFrame(rows, "k string, x int").repartition(5), "x", "k").collect()
    assert [r.k for r in sorted(got, key=lambda r: r.id)] == [k for k, _ in sorted(rows, key=lambda r: (r[1], r[0]))]
    assert ids.numbered(spark.createDataFrame([], "k string"), "k").count() == 0


def test_splits_and_seeds(spark):
    df = spark.range(4000).select(F.concat(F.lit("h"), (F.col("id") % 50).cast("string")).alias("head"), F.col("id").cast("string").alias("tail"))
    got = [{(r.head, r.tail): r.part for r in split.global_random(x).collect()} for x in (df, df.repartition(7))]
    assert got[0] == got[1]
    n = {p: sum(v == p for v in got[0].values()) for p in ("test", "val", "train")}
    assert abs(n["test"] - 800) < 110 and abs(n["val"] - 480) < 90
    assert split.derived_seeds(3) == {"run": 45, "data": 42, "val": 1045, "test": 2045, "warm": 3045, "dedup": 4045}


def test_largest_component_of_several(spark):
    rows = [("a", "b"), ("b", "c"), ("x", "y"), ("p", "q"), ("q", "r"), ("r", "s")]
    df = spark.createDataFrame(rows, "head string, tail string")
    assert sorted(map(tuple, graph.largest_component(df).collect())) == rows[3:]
    sizes = {r.bracket: (r.components, r.nodes, r.density) for r in graph.component_sizes(graph.components(df), df).collect()}
    assert sizes == {"2 (pairs)": (1, 2, round(6 / 36, 9)), "3-5": (2, 7, round(6 / 36, 9))}


def test_ingest_of_zipped_arrays_and_tables(spark, tmp_path):
    def zipped(name, member, data):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr(member, data)
        return str(tmp_path / name)

    nodes = [{"uri": f"u{i}", "entity_id": f"E{i}", "label": "α\tβ", "bioentity_type": "Drug" if i < 3 else "Gene"} for i in range(6)]
    edges = [("u0", "u3", "targets"), ("u0", "u3", "targets"), ("u4", "u3", "binds"), ("u3", "u4", "binds"), ("u3", "u3", "binds"), ("u1", "gone", "targets"), ("u1", "u2", "targets")]
    edges = [{"source_uri": a, "target_uri": b, "predicate_label": p} for a, b, p in edges]
    for name, rows in (("nodes", nodes), ("edges", edges)):
        assert ingest.array_to_lines(zipped(f"{name}.zip", f"x/{name}.json", json.dumps(rows, indent=1)), f"{tmp_path}/{name}.jsonl") == len(rows)
    got, left = ingest.read_graph(spark, f"{tmp_path}/nodes.jsonl", f"{tmp_path}/edges.jsonl", {("Drug", "targets", "Gene"): "DTI", ("Gene", "binds", "Gene"): "PPI"})
    assert sorted(map(tuple, got.collect())) == [("Drug::E0", "DTI", "Gene::E3"), ("Gene::E3", "PPI", "Gene::E4")]
    assert sorted(map(tuple, left.collect())) == [("targets", "end unknown", 1), ("targets", "relation not taken", 1)]
    values = [1, 12345, "a]b,[", {"x": [1, 2]}, None, -2.5e3, []]
    for chunk in (1, 2, 3, 1000):
        assert list(ingest.array_items(io.BytesIO(json.dumps(values).encode()), chunk)) == values
    for broken in (b"", b"{}", b"[1, 2", b'[{"a": 1}, {"b"'):
        with pytest.raises(ValueError):
            list(ingest.array_items(io.BytesIO(broken), 4))
    long = "z" * 300_000
    table = zipped("t.zip", "t.csv", f'id,groups\n1,"a, b"\n2,"{long}"\n3,caf'.encode() + b"\xe9\n")
    assert ingest.csv_to_lines(table, f"{tmp_path}/t.jsonl") == 3
    assert [r.groups for r in spark.read.json(f"{tmp_path}/t.jsonl").orderBy("id").collect()] == ["a, b", long, "caf"]
    sinks.write_tsv(spark.createDataFrame([("a", "one", "T"), ("b", None, "T"), ("a", "two", "T")], "e string, l string, t string"), f"{tmp_path}/labels")
    assert sorted(map(tuple, ingest.read_labels(spark, f"{tmp_path}/labels").collect())) == [("a", "one", "T"), ("b", "", "T")]


def test_no_machine_local_folder_on_a_cluster(spark):
    class Fake:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "spark://far:7077"})

    with pytest.raises(RuntimeError):
        sinks.shared_dir(Fake)
    assert tables.triples(spark, "/root/testdata/sf0.001").columns == ["head", "interaction", "tail"]
