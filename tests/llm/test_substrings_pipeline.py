"""Substring dedup against brute force, and the pipeline stage by stage."""

import hashlib
import random

import pytest

import corpus_pipeline
from loomgraph.llm import op04_packing, op09_substrings


def brute(docs, length):
    seen, out = set(), []
    for d, t in docs:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length,k,batches", [(12, 4, 4), (20, 8, 5), (100, 32, 2)])
def test_removed_bytes(spark, length, k, batches):
    rng = random.Random(length)
    alphabet = "abcd eé\n"
    passages = ["".join(rng.choice(alphabet) for _ in range(rng.randint(length - 3, 4 * length))) for _ in range(8)]
    docs = []
    for d in range(90):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 3 * length)))
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randint(0, len(t))
            t = t[:a] + p[rng.randrange(3) : len(p) - rng.randrange(3)] + t[a:]
        docs.append((d * 3, t))
    docs += [(1000, docs[5][1]), (1001, None), (1002, ""), (1003, "ab" * 5 * length), (1004, "x" * (length - 1)), (1005, "x" * (length + 1)), (1006, docs[7][1] + "q" * 9)]
    df = spark.createDataFrame([(d, t, 1) for d, t in random.Random(1).sample(docs, len(docs))], "doc_id long, text string, uid int").repartition(3)
    got = op09_substrings.dedup_substrings(df, length, k, batches).collect()
    assert sorted(map(tuple, got)) == brute(docs, length)
    got = op09_substrings.dedup_substrings(df, length, k, batches, run_rows=3).collect()
    assert sorted(map(tuple, got)) == brute(docs, length)


def test_rows_without_own_ids(spark):
    t = "the quick brown fox jumps " * 6
    df = spark.createDataFrame([(4, t), (4, t), (None, t), (9, None)], "doc_id long, text string")
    got = {(r.doc_id, r.n_removed) for r in op09_substrings.dedup_substrings(df).collect()}
    n = len(t)
    whole = brute([(0, t)], 100)[0][2]
    assert got == {(None, whole), (4, n), (9, 0)}
    assert op09_substrings.dedup_substrings(df.limit(0)).count() == 0


def test_long_texts_that_repeat(spark, monkeypatch):
    million = 1_000_000
    docs = [(1, "x" * 20 * million), (2, "abcdefg" * 200_000 + "y" * 150 + "abcdefg" * 20), (3, "x" * 500)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in op09_substrings.dedup_substrings(df).collect()}
    n = 1_400_000
    assert got == {1: (20 * million, 20 * million - 1, 1), 2: (n + 290, n - 7 + 149 + 140, 2), 3: (500, 500, 1)}
    rows = op09_substrings.anchors(df.withColumnRenamed("doc_id", "uid")).where("stop is null").count()
    assert rows < 500  # not one for each window
    monkeypatch.setattr(op09_substrings, "CHUNK", 700)
    text = lambda r, m: "".join(r.choice("abc d") for _ in range(m))
    rng = random.Random(8)
    p = text(rng, 400)
    docs = [(1, text(rng, 900) + p + "zz" * 600 + p + text(rng, 900)), (2, p + text(rng, 3000) + p[50:] + "zz" * 300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, op09_substrings.dedup_substrings(df).collect())) == brute(docs, 100)


def test_lengths_that_do_not_fit_are_refused(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    for length, k in ((400, 32), (32, 32), (10, 0)):
        with pytest.raises(ValueError):
            op09_substrings.dedup_substrings(df, length, k)


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    rng = random.Random(9)
    vocab = [f"word{i}" for i in range(500)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    item, rows, labels = text(40), [], []
    for i in range(400):
        toxic = i % 8 == 0
        rows.append((i, text(rng.randint(20, 80)) + (" scumbag moronic scumbag" if toxic else ""), "en", f"s{i % 4}", 1))
        labels.append((i, 1, int(toxic)))
    copied = [x for x in range(1, 20) if x % 8]
    rows += [(1000 + x, rows[x][1], "fr", "s9", 1) for x in copied]
    rows += [(2000, text(30) + " " + item + " " + text(5), "en", "s1", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), {r[0] for r in rows}
    for (name, stage), gone in zip(corpus_pipeline.STAGES[:3], [{r[0] for r in rows if "scumbag" in r[1]}, {1000 + x for x in copied}, {2000}]):
        docs = stage(spark, docs, str(tmp_path))
        left -= gone
        assert {r.doc_id for r in docs.select("doc_id").collect()} == left, name
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    out = op04_packing.unpack(packed)
    assert {d for d, _ in out} <= left and all(dict((r[0], r[1]) for r in rows)[d] == t for d, t in out)
