import pytest
from pyspark.sql import functions as F

from lodestar.llm import mixing

from .helpers import EDGE, edge, empty, rows


def test_targets_stop_at_the_cap_and_reshare():
    assert mixing.targets([("a", 10), ("b", 1000), ("c", 10)], (3, 1, 2), 1.5, 2) == [20.0, 1490.0, 20.0]
    assert mixing.targets([("a", 100), ("b", 100)], (3, 1), 1.0, 2) == [150.0, 50.0]
    assert mixing.targets([], (1,), 1.5, 2) == []
    assert mixing.targets([("a", 0), ("b", 4)], (3, 1), 1.5, 2) == [0.0, 6.0]


def test_taken_words_follow_the_targets(spark):
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"),
        F.expr("repeat('w ', cast(1 + id * 7919 % 83 as int))").alias("text"),
        F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"),
    )
    mixed = mixing.mix(docs).cache()
    for r in mixed.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r["taken"] - r["target"]) <= 2 * 83
    assert mixed.agg(F.max("copies")).first()[0] <= 2
    again = mixing.mix(docs.repartition(7))
    assert rows(again.select("doc_id", "copies")) == rows(mixed.select("doc_id", "copies"))
    emitted = mixing.emit(docs)
    assert emitted.columns == [*docs.columns, "copy"]
    counted = emitted.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copy").alias("last")).collect()
    taken = {r["doc_id"]: r["copies"] for r in mixed.collect() if r["copies"]}
    assert {r["doc_id"]: r["n"] for r in counted} == taken and all(r["n"] == r["last"] for r in counted)


def test_edge_rows(spark):
    found = mixing.mix(edge(spark))
    assert found.count() == len(EDGE)
    assert {r["size"] for r in found.filter("doc_id in (1, 2, 3, 8)").collect()} == {0}
    assert mixing.mix(empty(spark)).count() == 0
    emitted = mixing.emit(edge(spark))
    assert emitted.columns == [*edge(spark).columns, "_copy"]
    both = found.agg(F.sum("copies")).first()[0]
    assert emitted.count() == both


@pytest.mark.parametrize("rate", [1, (1 << 28) - 1, 1 << 28, 2 << 28])
def test_crossings_never_exceed_the_cap(rate):
    offset = (1 << 28) - 1
    steps = [(k * rate + offset >> 28) - ((k - 1) * rate + offset >> 28) for k in range(1, 5000)]
    assert max(steps) <= -(-rate // (1 << 28))


def test_sources_of_very_many_documents(spark):
    """Steps beyond 2**63 / 2**29 documents, where the plain product overflows, against Python's integers."""
    ks, offset = [1, 5, (1 << 28) - 1, 1 << 28, (1 << 28) + 1, 2 * 10**10, 9 * 10**14 + 7], (1 << 28) - 3
    for rate in (1, 12345, (1 << 28) - 1, 1 << 28, 2 << 28):
        df = spark.createDataFrame([(k, rate, offset) for k in ks], "k long, rate long, o long")
        got = df.select(mixing.crossed(F.col("k"), F.col("rate"), F.col("o"))).collect()
        assert [r[0] for r in got] == [k * rate + offset >> 28 for k in ks]
