"""Paged sources against a server that fails, and tables kept by what they are made of."""

import hashlib
import http.server
import json
import threading
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.operators import pools
from loomgraph.sources import ingest, paged


@pytest.fixture
def server():
    asked, broken = Counter(), {"until": 2}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked[self.path] += 1
            page = int(self.path.rsplit("=", 1)[1])
            if page == 99:
                return self.send_error(404)
            if asked[self.path] <= broken["until"]:
                return self.send_error(503)
            body = "" if page == 3 else f"id\tname\n{page}\ta b\n{page + 100}\t\n" if "tsv" in self.path else f'{{"rows": [{{"id": {page}}},\n {{"id": {page + 100}}}]}}'
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *args):
            pass

    made = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}", asked, broken
    made.shutdown()


def test_pages_come_after_failures_and_are_not_asked_for_again(spark, server, tmp_path):
    url, asked, _ = server
    get = lambda n: paged.pages(spark, url + "/tsv?p={page}", range(n), f"file://{tmp_path}", together=2, pause="0.01")
    got = paged.tsv_pages(get(5))
    assert sorted(map(tuple, got.collect())) == sorted([(str(p), "a b") for p in (0, 1, 2, 4)] + [(str(p + 100), "") for p in (0, 1, 2, 4)])
    assert set(asked.values()) == {3}
    assert get(5).count() == 12 and set(asked.values()) == {3}  # all from the folder, the empty page as well
    assert get(6).where("page = 5").count() == 3 and asked["/tsv?p=1"] == 3
    rows = paged.json_rows(paged.pages(spark, url + "/json?p={page}", range(2), f"file://{tmp_path}", pause="0.01"), "id: int", "rows")
    assert sorted(r.id for r in rows.collect()) == [0, 1, 100, 101]
    assert paged.pages(spark, url + "/none?p={page}", range(0), f"file://{tmp_path}").count() == 0


def test_a_page_that_never_comes_ends_the_query_and_a_later_one_goes_on(spark, server, tmp_path):
    url, asked, broken = server
    broken["until"] = 4
    get = lambda tries: paged.pages(spark, url + "/tsv?p={page}", range(2), f"file://{tmp_path}", together=1, pause="0.01", tries=tries)
    with pytest.raises(Exception, match="in try 3 of 3"):
        get("3").count()
    assert get("5").count() == 6
    with pytest.raises(Exception, match="404"):
        paged.pages(spark, url + "/tsv?p={page}", range(99, 100), f"file://{tmp_path}", pause="0.01").count()
    assert asked["/tsv?p=99"] == 1  # what is not there is not asked for again


def test_tables_are_made_once_for_their_rows(spark, tmp_path):
    made = []

    def make(df):
        made.append(1)
        return df.groupBy("head").agg(F.count("*").alias("n"))

    pairs = spark.createDataFrame([(f"h{i % 7}", f"t{i}") for i in range(50)] + [(None, "t1")], "head string, tail string")
    folder = f"file://{tmp_path}"
    want = sorted(map(str, pools.by_content(pairs, "x", make, folder).collect()))
    assert sorted(map(str, pools.by_content(pairs.repartition(5), "x", make, folder).collect())) == want and len(made) == 1
    pools.by_content(pairs.withColumn("tail", F.when(F.col("tail") == "t3", "t4").otherwise(F.col("tail"))), "x", make, folder)
    pools.by_content(pairs.unionByName(pairs.limit(1)), "x", make, folder)
    assert len(made) == 3
    assert pools.digest(pairs.limit(0)) != pools.digest(pairs.limit(0).withColumnRenamed("head", "h"))
    sides = pools.pools(pairs.where("head is not null"), folder)
    assert [r.i for r in sides["head"].orderBy("pick").collect()] == list(range(7)) and sides["tail"].count() == 50
    known = pools.known_pairs(pairs, folder)
    asked = spark.createDataFrame([("h0", "t0", 1), ("h0", "t1", 2), ("zz", "t0", 3)], "head string, tail string, n int")
    assert sorted(r.n for r in pools.unknown(asked, known).collect()) == [2, 3]


def test_archives_are_streamed_by_tasks(spark, tmp_path):
    def zipped(name, members):
        with zipfile.ZipFile(tmp_path / name, "w", zipfile.ZIP_DEFLATED) as z:
            for member, body in members.items():
                z.writestr(member, body)
        return str(tmp_path / name)

    many = [{"uri": f"u{i}", "label": "é\tx" * (i % 3), "n": i} for i in range(5_000)]
    one, two = zipped("a.zip", {"x/nodes.json": json.dumps(many, indent=1), "other.txt": "?"}), zipped("b.zip", {"nodes.json": "[]"})
    rows = ingest.member_rows(spark, [one, f"file://{two}"], "nodes.json")
    got = ingest.typed(rows, T.StructType([T.StructField("uri", T.StringType()), T.StructField("n", T.LongType()), T.StructField("none", T.StringType())]))
    assert sorted((r.uri, r.n) for r in got.collect()) == sorted((r["uri"], r["n"]) for r in many) and got.where("none is not null").count() == 0
    assert [r.n for r in rows.select("n").orderBy("n").collect()] == list(range(5_000))
    table = zipped("c.zip", {"t.csv": "id,groups\n1,a b\n2,\"x,\ny\"\n".encode() + b"3,\xff!\n"})
    csv_rows = ingest.typed(ingest.member_rows(spark, [table], ".csv"), T.StructType([T.StructField(c, T.StringType()) for c in ("id", "groups")]))
    assert sorted(map(tuple, csv_rows.collect())) == [("1", "a b"), ("2", "x,\ny"), ("3", "!")]
    for bad in ({"nodes.json": "[{}, "}, {}, {"a/nodes.json": "[]", "b/nodes.json": "[]"}):
        with pytest.raises(Exception, match="breaks off|members end in"):
            ingest.member_rows(spark, [zipped("bad.zip", bad)], "nodes.json").count()


def test_downloads_are_kept_when_their_digest_is_right(spark, server, tmp_path):
    url, asked, broken = server
    broken["until"] = 0
    address = url + "/tsv?p=1"
    sha = hashlib.sha256(b"id\tname\n1\ta b\n101\t\n").hexdigest()
    with pytest.raises(Exception, match="has the digest"):
        ingest.fetched(spark, {address: "0" * 64}, f"file://{tmp_path}").count()
    for _ in range(2):
        got = ingest.fetched(spark, {address: sha}, f"file://{tmp_path}", part=5).orderBy("part").collect()
        assert b"".join(bytes(r.content) for r in got).startswith(b"id\tname") and len(got) == 4
    assert asked["/tsv?p=1"] == 2  # once for the wrong digest, once for the right one
