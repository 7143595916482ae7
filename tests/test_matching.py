from pyspark.sql import functions as F

from lodestar.functions import numbers as N
from lodestar.functions import text as T
from lodestar.operators import gates as G
from lodestar.plans import catalogue

DOCS = [(1, "Solar Winds over Kepler station"), (2, "nothing shared"), (3, ""), (4, None), (41, "kepler " * 30 + "zebra"), (41, "quiet zebra")]
ITEMS = [(2, "kepler orbit " + "word " * 20 + "zebra"), (3, "the of"), (4, None), (7, "winds"), (8, "#Solar")]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def crossed(docs, items):
    d, i = docs.select("doc_id", F.col("text").alias("d")), items.select("item_id", F.col("text").alias("i"))
    return d.crossJoin(i)


def relevant(docs, items):
    q, m = T.query_terms(F.col("i")), T.query_terms(F.col("d"))
    x = crossed(docs, items).filter(G.relevance_gate(q, q, m))
    return rows(x.select("doc_id", "item_id", N.rounded(G.relevance_score(q, q, m), 6).alias("score")))


def matched(docs, items):
    x = crossed(docs, items).select(
        "doc_id",
        "item_id",
        G.terms_match(T.topic_terms(F.col("i")), F.col("d"), 2).alias("terms"),
        G.subject_match(F.col("i"), F.col("d"), T.subject_anchors(F.col("i"))).alias("subject"),
    )
    return rows(x.filter("terms or subject"))


def test_all_pairs_of_any_ids(spark):
    from lodestar.operators import matching

    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    found = rows(matching.relevant_pairs(docs, items, "doc_id", "item_id"))
    assert found == relevant(docs, items)
    assert {(1, 7), (1, 2), (41, 2)} <= {r[:2] for r in found}
    assert rows(matching.matching_pairs(docs, items, "doc_id", "item_id")) == matched(docs, items) != []
    assert rows(matching.relevant_pairs(docs.limit(0), items, "doc_id", "item_id")) == []


def test_queries_against_all_combinations(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    of = lambda name: [r for r in rows(catalogue.queries()[name](spark, small)) if r[0] in ids]
    found = of("relevant_documents")
    assert found == relevant(docs, items) and any(d % 40 != i % 40 for d, i, _ in found)
    assert of("matched_documents") == matched(docs, items)


def shown(docs, items, cutoff, query_weight, topic_weight):
    q, t, m = T.query_terms(F.col("i")), T.topic_terms(F.col("topic")), T.query_terms(F.col("d"))
    d, i = docs.select("doc_id", F.col("text").alias("d")).distinct(), items.select("item_id", F.col("text").alias("i"), "topic").distinct()
    x = d.crossJoin(i).filter(G.relevance_gate(q, t, m)).withColumn("score", N.rounded(G.relevance_score(q, t, m, query_weight, topic_weight), 6))
    return rows(x.filter(F.col("score") >= cutoff).select("doc_id", "item_id", "score"))


def test_pairs_at_a_cutoff(spark, small):
    from lodestar.operators import matching

    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame([(*x, t) for x, t in zip(ITEMS, ["solar kepler", "", None, "station winds over", "zebra"])], "item_id long, text string, topic string")
    for cutoff, a, b in ((0.3, 0.7, 0.3), (0.05, 0.6, 0.4), (0.999999, 0.5, 0.5), (0.6, 0.6, 0.4)):
        got = rows(matching.shown_pairs(docs, items, "doc_id", "item_id", cutoff=cutoff, query_weight=a, topic_weight=b))
        assert got == shown(docs, items, cutoff, a, b)
    assert rows(matching.shown_pairs(docs.limit(0), items, "doc_id", "item_id")) == []
    assert rows(matching.shown_pairs(docs, items.limit(0), "doc_id", "item_id")) == []
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(80)
    items = spark.read.parquet(f"{small}/benchmark.parquet").withColumn("topic", F.substring("text", 1, 60))
    got = rows(matching.shown_pairs(docs, items, "doc_id", "item_id", cutoff=0.5))
    assert got == shown(docs, items, 0.5, 0.7, 0.3) and got


def test_common_terms_make_no_candidates(spark):
    """Words that all texts share pair nothing: candidates are the pairs with a rarer term in common."""
    from lodestar.operators import matching

    common = [f"common{k}" for k in range(20)]
    d = spark.range(2000).select(F.col("id").alias("doc"), F.concat(F.array(*map(F.lit, common)), F.array(F.concat(F.lit("own"), F.col("id")))).alias("m"))
    i = spark.range(500).select(F.col("id").alias("item"), F.concat(F.array(*map(F.lit, common[:4])), F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.concat(F.lit("own"), F.col("id") + k))).alias("q"))
    i = i.withColumn("t", F.array().cast("array<string>"))
    assert matching.pairs_to_score(d, i, 0.41, 1.0, 0.0).count() == 500 * 6  # of 1,000,000


def test_scored_pairs_carry_no_arrays(spark):
    """The overlaps are counted, by row and not by key; no array of terms is joined to a pair."""
    from lodestar.operators import matching as M

    docs = spark.createDataFrame([(1, ["aaa", "bbb"]), (1, ["ccc"]), (2, []), (3, ["aaa", "ccc", "ddd"]), (3, ["aaa", "ccc", "ddd"])], "d long, m array<string>")
    items = spark.createDataFrame([(7, ["aaa", "bbb"], ["ccc"]), (8, [], ["ccc"]), (9, [], []), (10, ["ddd", "eee"], []), (7, ["bbb"], ["aaa"])], "i long, q array<string>, t array<string>")
    got = M.scored_pairs(docs, items, "d", "i", 0.7, 0.3)
    q, t, m = F.col("q"), F.col("t"), F.col("m")
    want = docs.crossJoin(items).filter(G.relevance_gate(q, t, m)).select("d", "i", M.N.rounded(G.relevance_score(q, t, m, 0.7, 0.3), 6))
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect()) != []
    assert "array_intersect" not in got._jdf.queryExecution().optimizedPlan().toString()
