"""Long texts against short ones: the prefix form equals brute force and the form by two tokens, with keys in proportion."""

import random

from pyspark.sql import functions as F

from lodestar.operators import similarity as S


def tokens(text):
    return {w for w in (text or "").split()}


def test_prefix_form_equals_the_others(spark):
    rng = random.Random(3)
    words = [f"q{k}" for k in range(60)]
    pick = lambda n: " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(60)], k=n))
    left = [(k, pick(rng.choice([0, 1, 1, 2, 5, 40]))) for k in range(150)] + [(3, "q59 q58"), (900, None), (901, "q7 q7 q7")]
    right = [(k, pick(rng.choice([0, 1, 2, 3, 8]))) for k in range(60)] + [(70, "q59 q58 q57"), (71, None), (72, "q59"), (73, "")]
    a, b = spark.createDataFrame(left, "l long, lt string"), spark.createDataFrame(right, "r long, rt string")
    want = {(i, j) for i, x in left for j, y in right if tokens(x) and tokens(y) and len(tokens(x) & tokens(y)) >= min(2, len(tokens(x)), len(tokens(y)))}
    for f in (S.similar_long_pairs, S.similar_pairs):
        assert {tuple(r) for r in f(a, b, "l", "lt", "r", "rt").collect()} == want
    assert S.similar_long_pairs(a.limit(0), b, "l", "lt", "r", "rt").count() == 0


def test_long_texts_that_all_share_one_word(spark):
    """The commonest word pairs nothing, and a text of 3,000 words makes no more than so many keys."""
    n = 3000
    left = spark.range(20).select(F.col("id").alias("l"), F.concat(F.lit("same "), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.concat(F.lit("w"), F.col("id") * n + k)), " ")).alias("lt"))
    right = spark.range(20).select(F.col("id").alias("r"), F.concat(F.lit("same w"), F.col("id") * n + 5, F.lit(" other"), F.col("id")).alias("rt"))
    assert {tuple(r) for r in S.similar_long_pairs(left, right, "l", "lt", "r", "rt").collect()} == {(k, k) for k in range(20)}


def test_tokens_of_one_side_alone_are_not_ranked(spark):
    """Long texts against short ones: what only one side holds goes before the tokens are put in order."""
    left = spark.createDataFrame([(1, "qa qb qc qd"), (2, "qx qy"), (3, "qa")], "l long, lt string")
    right = spark.createDataFrame([(1, "qa qb other"), (2, "none")], "r long, rt string")
    found = S.similar_long_pairs(left, right, "l", "lt", "r", "rt")
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1), (3, 1)]
