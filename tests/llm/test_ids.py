"""Large ids beside null come out of every query as they went in."""

import pytest

from loomgraph.llm import registry

BIG = 1 << 60
IDS = [BIG + 1, BIG + 3, None, BIG + 5, 7, -(BIG + 1)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("ids")
    tables = {
        "documents": ("doc_id long, text string, lang string, source string, n_chars long", [(i, f"some plain words of text number {n} " * 9, "en", "s", 1) for n, i in enumerate(IDS)]),
        "labels": ("doc_id long, quality int, toxic int", [(i, 1, n % 2) for n, i in enumerate(IDS)]),
        "benchmark": ("item_id long, text string", [(i, f"some item text {n}") for n, i in enumerate(IDS)]),
        "pages": ("page_id long, url string, html string", [(i, f"http://a.com/{n}", "") for n, i in enumerate(IDS)]),
        "conversations": ("conv_id long, turn long, role string, text string", [(i, t, r, f"{r} {n}") for n, i in enumerate(IDS) for t, r in enumerate(("user", "assistant"))]),
        "embeddings": ("vec_id long, embedding array<float>, label int", [(i, [float(n), 1.0, 2.0], 0) for n, i in enumerate(IDS)]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.mark.parametrize("name", [n for n in registry.queries() if n not in ("pipeline", "op4_packed_tokens", "op10_benchmark_leaks")])
def test_ids_stay(spark, folder, name):
    got = registry.queries()[name](spark, folder)
    key = got.columns[0]
    assert key in ("doc_id", "vec_id", "conv_id", "page_id")
    found = [r[0] for r in got.select(key).collect()]
    assert sorted(map(str, set(found) - {-1})) == sorted(map(str, set(IDS)))


def test_ids_stay_in_packed_rows(spark, folder):
    got = registry.queries()["op4_packed_tokens"](spark, folder).collect()
    assert sorted(str(i) for r in got for i in r.doc_ids) == sorted(map(str, IDS))
