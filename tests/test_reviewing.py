"""Review sheets, evidence, run logs, sinks and growing triples against plain Python."""

import datetime
import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from loomgraph import catalog
from loomgraph.operators import evidence, rank, review, tests_of_runs
from loomgraph.plans import reviewing
from loomgraph.sources import runs, sinks
from loomgraph.streaming import windows

SF = "/root/testdata/sf0.001"
PAIR = "head string, tail string"


def draw(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def plain_items(ranked, truth, pool, topk, mid, n_mid, n_random, seed):
    md5 = lambda *x: hashlib.md5("|".join(map(str, x)).encode()).hexdigest()
    pool, out = sorted(set(pool)), []
    for h in sorted({h for h, _, _ in ranked}):
        known = {t for a, t in truth if a == h}
        novel = sorted((r, t) for a, t, r in ranked if a == h and t not in known)
        got = [(t, "topk", r) for r, t in novel[:topk]]
        band = [(t, r) for r, t in novel[topk:] if mid[0] <= r <= mid[1]]
        got += [(t, "decoy_midrank", r) for t, r in sorted(band, key=lambda x: (md5(seed, h, x[0]), x[0]))[:n_mid]]
        left = [t for t in pool if t not in known and t not in {g[0] for g in got}]
        chosen = []
        for j in range(max(0, len(left) - n_random), len(left)):
            t = draw(f"{seed}|{h}|{j}") % (j + 1)
            chosen.append(j if t in chosen else t)
        out += [(h, *g) for g in got] + [(h, left[i], "decoy_random", None) for i in chosen]
    out.sort(key=lambda x: (md5(f"{seed}|shuffle", x[0], x[1]), x[0], x[1]))
    return [(f"IT{i + 1:05d}", *x) for i, x in enumerate(out)]


@pytest.mark.parametrize("n_random", [0, 3, 50])
def test_items_equal_a_plain_draw(spark, n_random):
    ranked = [(h, f"t{(i * 7 + h_i) % 30:02}", i + 1) for h_i, h in enumerate(("a", "b", "c")) for i in range(25)]
    truth = [("a", f"t{i:02}") for i in range(0, 30, 4)] + [("b", "t01"), ("z", "t02")]
    pool = [f"t{i:02}" for i in range(30)]
    got = review.items(spark.createDataFrame(ranked, PAIR + ", rank int"), spark.createDataFrame(truth, PAIR), spark.createDataFrame([(t,) for t in pool], "tail string"), 4, (8, 20), 3, n_random, 5)
    want = plain_items(ranked, truth, pool, 4, (8, 20), 3, n_random, 5)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want, key=lambda x: x[0])
    sheet = review.blind(got, spark.createDataFrame([("a", "A", "T")], "entity string, label string, type string"))
    assert "stratum" not in sheet.columns and sheet.count() == len(want)


def test_review_items_hold_nothing_asserted(spark):
    got = catalog.QUERIES["review_items"](spark, SF).collect()
    true = {(r["head"], r["tail"]) for r in catalog.QUERIES["split_stratified"](spark, SF).collect()}
    assert got and not true & {(r["head"], r["tail"]) for r in got} and len({(r["head"], r["tail"]) for r in got}) == len(got)
    assert {r["stratum"] for r in got} >= {"topk", "decoy_random"}


def test_a_repeated_item_is_an_error(spark):
    filled = spark.createDataFrame([("IT1", "High", "y"), ("IT1", "low", "n")], "item_id string, expert_tier string, expert_plausible string")
    with pytest.raises(Exception, match="not one to one"):
        review.agreement(filled, spark.createDataFrame([("IT1", "topk")], "item_id string, stratum string")).collect()


def test_evidence(spark):
    df = lambda rows: spark.createDataFrame(rows, PAIR)
    cand, known = df([("d", "p1"), ("d", "p2"), ("d", "p3"), ("e", "p1")]), df([("d", "k"), ("d", "p2"), ("e", "p1")])
    attributes = df([("p1", "x"), ("k", "x"), ("p2", "y"), ("p3", "z")])
    assert {tuple(r) for r in evidence.shares_attribute(cand, known, attributes).collect()} == {("d", "p1")}
    own = df([("d", "z"), ("e", "w")])
    assert {tuple(r) for r in evidence.shares_attribute(cand, known, attributes, own).collect()} == {("d", "p1"), ("d", "p3")}
    assert {tuple(r) for r in evidence.linked_to_known(cand, known, df([("p3", "k")])).collect()} == {("d", "p3")}
    assert {tuple(r) for r in evidence.reached(cand, df([("d", "g")]), df([("g", "p2"), ("g", "q")])).collect()} == {("d", "p2")}
    told = evidence.tiers(cand, {"A": df([("d", "p1")]), "B": df([("d", "p1"), ("e", "p1")])}).collect()
    assert {(r["head"], r["tail"], r["evidence"], r["tier"]) for r in told} == {("d", "p1", "A+B", 1), ("e", "p1", "B", 2), ("d", "p2", "-", 3), ("d", "p3", "-", 3)}


def test_first_novel(spark):
    scores = spark.createDataFrame([("a", 3), ("b", 3), ("c", 2), ("d", 9)], "tail string, s long")
    heads, known = spark.createDataFrame([("h",), ("i",)], "head string"), spark.createDataFrame([("h", "d"), ("h", "a"), ("j", "b")], PAIR)
    got = {tuple(r) for r in rank.first_novel(heads, known, scores, 2).collect()}
    assert got == {("h", "b", 3, 1), ("h", "c", 2, 2), ("i", "d", 9, 1), ("i", "a", 3, 2)}


def test_early_stop_with_a_least_gain(spark):
    values = [0.1, 0.5, 0.55, 0.9, 0.91, 0.92, 0.93, 2.0]
    points = spark.createDataFrame([("r", i, v) for i, v in enumerate(values)] + [("s", 0, None), ("s", 1, 1.0)], "run string, epoch int, value double")
    assert {tuple(r) for r in tests_of_runs.early_stop(points, 3, 0.1).collect()} == {("r", 3, 0.9, 6), ("s", 1, 1.0, None)}


def test_logs(spark, tmp_path):
    line = "Run {} | Test Auroc: 0.899, Test Auprc: 0.921, Test MRR: 0.385, TEST HITS: {{1: 0.006, 3: 0.015, 10: 0.05}}\n"
    val = "x\r[val] 2025-01-01 00:00:00 run 0 epoch {} | loss 0.5000 | AUROC {} | AUPRC 0.2 | MRR 0.3 | M 0.4\n"
    (tmp_path / "e3_comp_a_20250101_000000.log").write_text(line.format(0) + line.format(1) + val.format(10, "0.1"))
    (tmp_path / "e3_comp_a_20250102_000000.log").write_text(line.format(0) + "noise\n" + val.format(10, "0.7") + val.format(20, "0.9"))
    (tmp_path / "other.log").write_text(line.format(0))
    got = runs.test_results(spark, str(tmp_path)).orderBy("run").collect()
    assert [(r["family"], r["tag"], r["stamp"], r["run"], r["mrr"]) for r in got] == [("e3", "comp_a", "20250101_000000", i, 0.385) for i in (0, 1)]
    assert got[0]["hits"] == {1: 0.006, 3: 0.015, 10: 0.05}
    points = runs.curves(spark, str(tmp_path))
    assert [(r["epoch"], r["auroc"]) for r in points.orderBy("epoch").collect()] == [(10, 0.7), (20, 0.9)]
    assert [(r["epoch"], r["mean"], r["sd"], r["n"]) for r in runs.curve_means(points, "auroc").orderBy("epoch").collect()] == [(10, 0.7, 0.0, 1), (20, 0.9, 0.0, 1)]
    (tmp_path / "a_params.json").write_text(json.dumps({"lr": 0.1, "layers": [1, 2], "name": "x"}, indent=1))
    assert {(r["name"], r["value"]) for r in runs.configurations(spark, f"{tmp_path}/*.json").collect()} == {("lr", "0.1"), ("layers", "[1,2]"), ("name", "x")}


def test_other_lines_of_logs_and_any_spelling_of_numbers(spark, tmp_path):
    (tmp_path / "e1_DTI_rgcn_20250101_000000.log").write_text(
        "[val] 2025-01-01 00:00:00 run 0 epoch 10 | loss 4.1e-05 | AUROC 0.5 | AUPRC 1 | MRR .25 | M 1E-3\n"
        "[val]  2025-01-01 00:00:01  run  1  epoch  20|loss 0.5|  AUROC   nan | AUPRC 0.2 | MRR 0.3 | M 0.4\n"
        "Run 0 | Test Auroc: 0.9, Test Auprc: 0.8, Test MRR: 1e-02, TEST HITS: {1: 0.0, 10: 5e-05}\n"
        "Run 0 | best_epoch: 40 | train_time_sec: 12.5\nRun 1 | best_epoch: None | train_time_sec: 3\n"
        "Run 0 | cold-start test triples: 3/12 (25.00%)\nRun 0 | WARM Test Auroc: 0.91, Test Auprc: 0.81, Test MRR: 0.41, TEST HITS: {1: 0.1}\n"
        "Run 0 | dedup: test triples whose fact is already in train via a twin node: 1/4 (25.00%)\nRun 0 | DEDUP_STEREO Test Auroc: 0.92, Test Auprc: 0.82, Test MRR: 0.42, TEST HITS: {1: 0.2}\n"
    )
    points = {(r.run, r.epoch): tuple(r)[4:] for r in runs.curves(spark, str(tmp_path)).collect()}
    assert points[0, 10] == (4.1e-05, 0.5, 1.0, 0.25, 0.001) and points[1, 20][0] == 0.5 and math.isnan(points[1, 20][1]) and len(points) == 2
    got = {r.subset: (r.mrr, r.hits) for r in runs.test_results(spark, str(tmp_path)).collect()}
    assert got == {"": (0.01, {1: 0.0, 10: 5e-05}), "warm": (0.41, {1: 0.1}), "dedup_stereo": (0.42, {1: 0.2})}
    facts = {(r.run, r.name): r.value for r in runs.run_facts(spark, str(tmp_path)).collect()}
    assert facts == {(0, "best_epoch"): 40.0, (0, "seconds"): 12.5, (1, "seconds"): 3.0, (0, "cold-start"): 0.25, (0, "dedup"): 0.25}


def test_kept_results_and_sinks(spark, tmp_path):
    calls = []
    compute = lambda: calls.append(1) or spark.range(3)
    assert [runs.kept(spark, f"{tmp_path}/kept", compute).count() for _ in range(2)] == [3, 3] and calls == [1]
    sinks.write_labels(spark.createDataFrame([("A::1", "a\tb", "A"), ("A::2", None, "A")], "entity string, label string, type string"), f"{tmp_path}/labels")
    back = spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/labels")
    assert {(r["entity"], r["label"] or "") for r in back.collect()} == {("A::1", "a b"), ("A::2", "")}
    ranked = spark.createDataFrame([("h", f"t{i}", i, 1.0 / i) for i in range(1, 6)], PAIR + ", rank int, score double")
    sinks.write_rankings(ranked, f"{tmp_path}/ranks", top=3)
    assert [x["rank"] for x in spark.read.json(f"{tmp_path}/ranks").first()["ranking"]] == [1, 2, 3]
    sinks.write_csv(ranked, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 5
    source = tmp_path / "in.txt"
    source.write_text("abc")
    made = sinks.provenance(f"{tmp_path}/made.json", {"k": 3}, {"in": str(source)}, [("rows", True, "5"), ("columns", False, "")])
    assert json.loads((tmp_path / "made.json").read_text()) == made and not made["ok"] and made["sha256"]["in"] == hashlib.sha256(b"abc").hexdigest()


def test_triples_grow_and_repeats_change_nothing(spark, tmp_path):
    schema, path = "head string, interaction string, tail string", f"{tmp_path}/kg"
    batches = [[("a", "R", "b"), ("a", "S", "c")], [("a", "R", "b"), ("d", "R", "b")], [("a", "R", "b"), ("d", "R", "b")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        windows.ingest(spark, f"{tmp_path}/in", path, f"{tmp_path}/mark").awaitTermination()
    got = {(r["node"], r["degree"], r["place"]) for r in windows.degrees(spark, path).collect()}
    assert got == {("a", 2, 1), ("b", 2, 1), ("c", 1, 3), ("d", 1, 3)}


def test_stream_without_repeats(spark, tmp_path):
    schema = "event_id long, ts timestamp"
    spark.sql("select id % 3 as event_id, timestamp'2024-01-01 00:00:00' as ts from range(9)").write.parquet(f"{tmp_path}/in")
    out = windows.deduplicated(spark, f"{tmp_path}/in", schema).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/mark").trigger(availableNow=True).start(f"{tmp_path}/out")
    out.awaitTermination()
    assert sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/out").select("event_id").collect()) == [0, 1, 2]


def test_every_reviewing_query_is_registered():
    assert set(reviewing.QUERIES) <= set(catalog.QUERIES)


def test_degrees_grow_by_batches_and_late_rows_are_counted(spark, tmp_path):
    day = lambda d: datetime.datetime(2025, 1, d)
    schema = "ts timestamp, head string, interaction string, tail string"
    batches = [
        [(day(1), "a", "r", "b"), (day(1), "a", "r", "b"), (day(2), "c", "r", "d")],
        [(day(9), "a", "r", "c"), (day(9), "a", "q", "b")],
        [(day(1), "late", "r", "b"), (day(9), "a", "r", "c"), (day(10), "e", "r", "e")],
    ]
    query = None
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        query = windows.growing_degrees(stream, f"{tmp_path}/out", f"{tmp_path}/mark")
        query.awaitTermination()
    assert windows.late_rows(query) == 1
    want = {"a": 3, "b": 2, "c": 2, "d": 1, "e": 2}
    got = {r.node: (r.degree, r.place) for r in windows.grown_degrees(spark, f"{tmp_path}/out").collect()}
    assert got == {n: (d, 1 + sum(x > d for x in want.values())) for n, d in want.items()}
    told = spark.read.parquet(f"{tmp_path}/out").groupBy("batch").agg(F.sort_array(F.collect_set("node")).alias("n")).collect()
    assert sorted(r.n for r in told if r.n) == sorted([["a", "b", "c", "d"], ["a", "b", "c"], ["e"]])  # what a batch changes, nothing else
    windows.compact_degrees(spark, f"{tmp_path}/out", f"{tmp_path}/one")
    assert {r.node: r.degree for r in windows.grown_degrees(spark, f"{tmp_path}/one").collect()} == want


def plain_relatives(direct, attributes):
    held, weight = {}, {}
    for h, t in set(attributes):
        held.setdefault(t, set()).add(h)
    for hs in held.values():
        for a in hs:
            for b in hs - {a}:
                weight[a, b] = weight.get((a, b), 0) + int(1_000_000 / len(hs) + 0.5)
    for a, b in {x for h, t in direct for x in ((h, t), (t, h)) if h != t}:
        weight[a, b] = weight.get((a, b), 0) + 1_000_000
    want = {}
    for (a, _), w in weight.items():
        n, total, top = want.get(a, (0, 0, 0))
        want[a] = (n + 1, total + w, max(top, w))
    return {a: (n, round(total / 1e6, 6), round(top / 1e6, 6)) for a, (n, total, top) in want.items()}


def test_an_attribute_of_very_many_holders_links_them_all(spark):
    attributes = [(f"n{i}", "all") for i in range(700)] + [(f"n{i}", f"x{i % 9}") for i in range(0, 60, 2)] + [("n3", "own"), ("n900", "own2"), ("n5", "all")]
    direct = [("n1", "n2"), ("n2", "n1"), ("n2", "n2"), ("n800", "n1"), ("n800", "n801"), ("n900", "n0"), ("n0", "n18")]
    df = [spark.createDataFrame(x, PAIR) for x in (direct, attributes)]
    want = plain_relatives(direct, attributes)
    got = {r.a: (r.relatives, round(r.weight, 6), round(r.nearest, 6)) for r in evidence.relatives(*df).collect()}
    assert got == want and got["n4"][0] == 699 and got["n1"][0] == 700
    pairs = evidence.relative_weights(*df).groupBy("a").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("w"), F.max("weight").alias("top"))
    assert {r.a: (r.n, r.w, r.top) for r in pairs.collect()} == want
