import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import hnsw


def frame(spark, ids, vectors):
    return spark.createDataFrame(list(zip(ids, vectors)), "vec_id long, embedding array<double>").withColumn("shard", F.lit("x"))


def brute(ids, vectors, queries, k):
    ids, u = np.array(ids), hnsw.unit(np.array(vectors))
    out = {}
    for q in queries:
        s = u @ u[np.nonzero(ids == q)[0][0]]
        other = np.nonzero(ids != q)[0]
        order = other[np.lexsort((ids[other], -s[other]))][:k]
        out[q] = list(zip(ids[order].tolist(), s[order].tolist()))
    return out


@pytest.mark.parametrize("kind", ["even", "clusters", "copies"])
def test_recall_against_brute_force(spark, kind):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((3000, 32))
    if kind == "clusters":
        v = rng.standard_normal((40, 32))[rng.integers(0, 40, 3000)] + 0.1 * v
    if kind == "copies":
        v[::3] = v[0]
    ids = list(range(3000))
    got = {}
    for r in hnsw.neighbours(frame(spark, ids, v.tolist()), F.col("vec_id") % 50 == 0, shard=1000).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    want = brute(ids, v, range(0, 3000, 50), 5)
    assert got.keys() == want.keys() and all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())
    hits = sum(len({x for x, _ in want[q]} & {x for x, _ in got[q].values()}) for q in want)
    assert hits >= 0.95 * 5 * len(want)
    u = hnsw.unit(v)
    assert all(abs(u[q] @ u[x] - s) < 1e-12 for q, g in got.items() for x, s in g.values())
    for g in got.values():
        ordered = [(-g[r][1], g[r][0]) for r in range(1, 6)]
        assert ordered == sorted(ordered)


def test_rows_that_take_no_part(spark):
    rows = [
        (0, [1.0, 0.0]), (1, [0.9, 0.1]), (1, [0.9, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]),
        (6, [float("inf"), 1.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (8, []), (9, [1e200, 1e200]), (10, [-1e-200, 0.0]),
    ]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in hnsw.neighbours(v, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert [(q, r, x) for q, r, x, _ in got] == [(0, 1, 1), (0, 2, 9), (0, 3, 10)]
    assert hnsw.neighbours(v.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert hnsw.neighbours(v.filter("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0


def test_graphs_survive_packing():
    rng = np.random.default_rng(2)
    g = hnsw.build(rng.standard_normal((500, 8)), rng.integers(0, 400, 500))
    again = hnsw._unpack(hnsw._pack(3, g).to_pylist()[0])
    assert (again.vectors == g.vectors).all() and (again.ids == g.ids).all() and len(again.links) == len(g.links)
    assert all((a == b).all() for a, b in zip(again.links, g.links))
    assert all(x.max() < len(g.vectors) for x in g.links)
