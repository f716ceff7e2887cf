"""Components of edge tables by one task and by rounds of joins, against a plain search."""

import random

import pytest

from loomgraph.llm import shared


def plain(edges):
    near = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = start
                todo += near[x]
    return out


def graphs():
    rng = random.Random(11)
    chain = list(range(-300, 300))
    rng.shuffle(chain)
    yield [(a, b) for a, b in zip(chain, chain[1:])] + [(1_000, 1_001), (2_000, 2_000), (None, 5), (3_000, None)]
    yield [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] * 2
    yield [(10**12, i) for i in range(500)] + [(-(10**15), 499)]
    yield []


@pytest.mark.parametrize("task_edges", [shared.TASK_EDGES, 0])
def test_components(spark, task_edges):
    for edges in graphs():
        df = spark.createDataFrame(edges, "u long, v long").repartition(5)
        got = shared.connected_components(df, task_edges=task_edges).collect()
        assert {r.node: r.component for r in got} == plain(edges) and len(got) == len(plain(edges))


def test_contract_in_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(shared, "CONTRACT_EDGES", 7)
    rng = random.Random(2)
    edges = [(rng.randrange(90), rng.randrange(90)) for _ in range(70)]
    pieces = [pa.RecordBatch.from_arrays([pa.array([a for a, _ in edges[i : i + 3]]), pa.array([b for _, b in edges[i : i + 3]])], ["u", "v"]) for i in range(0, 70, 3)]
    got = {a: b for t in shared._contract(iter(pieces)) for a, b in zip(t.column(0).to_pylist(), t.column(1).to_pylist())}
    assert got == {a: b for a, b in plain(edges).items() if a != b}
