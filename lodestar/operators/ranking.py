"""Ranking, de-duplication of candidates, counts and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N


def dedupe_best(cands: DataFrame, key: str = "video_id", keep: str = "best") -> DataFrame:
    """One row for each key: the best score, then the first source; keep="first" goes by source alone."""
    order = [F.col("source")] if keep == "first" else [F.desc("trend_score"), F.col("source")]
    w = Window.partitionBy(key).orderBy(*order)
    return cands.withColumn("_row", F.row_number().over(w)).filter("_row = 1").drop("_row")


def source_counts(df: DataFrame, source: str = "source") -> DataFrame:
    return df.groupBy(source).agg(F.count("*").alias("n_rows"))


def top_trends(cands: DataFrame, n: int = 120) -> DataFrame:
    """The n best by score, then views, then id, with their rank; only n rows are ranked."""
    top = cands.orderBy(F.desc("trend_score"), F.desc("views"), "video_id").limit(n)
    w = Window.orderBy(F.desc("trend_score"), F.desc("views"), "video_id")
    return top.withColumn("rank", F.row_number().over(w))


def candidate_windows(df: DataFrame, key: list[str], order: str, n: int) -> DataFrame:
    """The number of the window of n results that each row falls into, from 1."""
    at = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    return df.withColumn("window", F.ceil(at / n).cast("long"))


def stage_timings(runs: DataFrame, stage: str, seconds: str) -> DataFrame:
    """Seconds of each stage and, under a null stage, of all."""
    total = N.rounded(F.sum(seconds))
    return runs.rollup(stage).agg(F.count("*").alias("n_runs"), total.alias("seconds"))


def model_status(attempts: DataFrame) -> DataFrame:
    """For each model its attempts, failures, classes of failure and the class of the last one. attempts: model, ts, message."""
    kind = F.when(F.col("message").isNotNull(), N.error_class(F.col("message")))
    seen = attempts.withColumn("kind", kind)
    count = lambda k: F.count_if(F.col("kind") == k).alias(f"n_{k}")
    return seen.groupBy("model").agg(
        F.count("*").alias("attempts"),
        F.count("kind").alias("failures"),
        count("auth"),
        count("transient"),
        count("fatal"),
        F.max_by("kind", F.when(F.col("kind").isNotNull(), F.struct("ts", "message"))).alias("last_kind"),
    )


def distinct_in_order(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Values of each key in the order in which they first appear."""
    first = df.groupBy(key, value).agg(F.min(order).alias("at"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", value))), lambda x: x[value]).alias("values"))
