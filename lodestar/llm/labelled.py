"""Bounded samples of labelled documents, for classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that a longer text gives to a fit, in pieces spread evenly over all of it. Texts are scored whole.
FIT_CHARS = 60_000
#: Characters of such a piece.
PIECE = 1000


def fitted(text: Column) -> Column:
    """The text, or, if it is longer than FIT_CHARS, so many of its characters in pieces from its start to its end."""
    n = FIT_CHARS // PIECE
    step = (F.length(text) - PIECE) / F.lit(float(n - 1))
    pieces = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.substring(text, F.floor(i * step).cast("int") + 1, F.lit(PIECE)))
    return F.when(F.length(text) <= FIT_CHARS, text).otherwise(F.array_join(pieces, " "))


def texts_of(docs: DataFrame, chosen: DataFrame, *keys: str) -> DataFrame:
    """keys and `text` for each row of chosen (keys, mark; few rows) that docs (keys, text) has; alike rows are one."""
    marked = docs.select(*(F.col(k).alias(f"of_{k}") for k in keys), F.xxhash64("text").alias("of_mark"), "text")
    same = F.col("of_mark") == F.col("mark")
    for k in keys:
        same = same & (F.col(f"of_{k}") == F.col(k))
    met = marked.join(F.broadcast(chosen), same)
    # Alike rows meet in the map-side part of the grouping, however many they are.
    return met.groupBy(*chosen.columns).agg(F.first(fitted(F.col("text"))).alias("text"))


def sample(docs: DataFrame, labels: DataFrame, label: str, train, per_class: int) -> tuple[list[tuple[int, bytes]], dict[int, int]]:
    """Up to `per_class` labelled texts of either class, with the numbers of labelled texts.

    labels: doc_id and a 0/1 column `label`; rows with a null in either are left out, as
    are rows that `train` (a Column over doc_id) rejects, and null texts. Rows are taken in
    the order of a hash of id and text, so the sample is the same at every run, and an id
    that many rows share is no larger part of it than of them. Rows alike in id, label and
    text are one. At most 2 * per_class texts of about FIT_CHARS characters reach the driver.
    """
    known = labels.select(F.col("doc_id").alias("l_id"), F.col(label).cast("int").alias("label")).filter("l_id is not null and label in (0, 1)")
    known = known.filter(train(F.col("l_id"))).distinct()
    marks = docs.filter("text is not null").select("doc_id", F.xxhash64("text").alias("mark"))
    rows = marks.join(known, F.col("doc_id") == F.col("l_id")).select("doc_id", "label", "mark").distinct()
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id", "mark"), F.col("doc_id"), F.col("mark")]
    zero, one = (rows.filter(F.col("label") == value).orderBy(*order).limit(per_class) for value in (0, 1))
    found = texts_of(docs, zero.union(one), "doc_id").select("doc_id", "label", "text").collect()
    found.sort(key=lambda r: (str(r["doc_id"]), r["label"], r["text"]))
    return [(r["label"], r["text"].encode()) for r in found], sizes
