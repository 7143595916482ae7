"""Importance resampling towards a target distribution by hashed n-gram features."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Buckets of features, words of the longest one, words a document needs to be drawn, and percent that is drawn.
BUCKETS, LONGEST, LEAST_WORDS, PERCENT = 10_000, 1, 20, 10
#: Added to the draws' hashes.
SEED = 2024
#: Words whose buckets or gains a task keeps.
KEPT = 500_000

#: Byte to byte: A-Z in lower case; everything in ASCII but letters and digits is blank.
_TABLE = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256)).lower()


def words_of(text: bytes) -> list[bytes]:
    """Words of a text in UTF-8: runs of letters and digits of ASCII and of everything beyond it."""
    return text.translate(_TABLE).split()


def runs(words: list[bytes], longest: int) -> Iterator[int]:
    """The crc32 of every run of 2 to `longest` words, joined by one space: each goes on from that of the run without its last word."""
    seeds = [zlib.crc32(w) for w in words]
    for n in range(1, longest):
        seeds = [zlib.crc32(words[i + n], zlib.crc32(b" ", seeds[i])) for i in range(len(words) - n)]
        yield from seeds


class _Known(dict):
    """What `of` gives for a word, kept for the next time."""

    def __init__(self, of) -> None:
        self.of = of

    def __missing__(self, word: bytes):
        if len(self) >= KEPT:
            self.clear()
        self[word] = found = self.of(word)
        return found


def bucket_counts(texts: DataFrame, buckets: int, longest: int) -> DataFrame:
    """(bucket, n) of all texts (the only column): a task sends a row for each bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        single: Counter = Counter()

        def settle() -> None:
            for w, n in single.items():
                total[zlib.crc32(w) % buckets] += n
            single.clear()

        for batch in batches:
            for v in batch.column(0).cast(pa.large_binary()):
                words = words_of(v.as_py() or b"")
                single.update(words)
                if longest > 1:
                    total.update(h % buckets for h in runs(words, longest))
                if len(single) > KEPT:
                    settle()
        settle()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["bucket", "n"])

    return texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    """What a feature of each bucket adds to a document's weight: 1000 times the log of its share in the target over that in the source."""
    all_source, all_target = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)

    def gain(bucket: int) -> int:
        return math.floor(1000 * math.log((target.get(bucket, 0) + 1) * all_source / ((source.get(bucket, 0) + 1) * all_target)))

    return [gain(b) for b in range(buckets)]


def weigh(docs: DataFrame, gain: list[int], longest: int, seed: int) -> DataFrame:
    """docs (doc_id, mark, text) as doc_id, mark, n_words, n_features, weight, score."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    buckets = len(gain)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        known = _Known(lambda w: own[zlib.crc32(w) % buckets])
        for batch in batches:
            n_words, n_features, weights, scores = [], [], [], []
            for key, v in zip(batch.column(2).to_pylist(), batch.column(3).cast(pa.large_binary())):
                words = words_of(v.as_py() or b"")
                n, weight = len(words), sum(map(known.__getitem__, words))
                if longest > 1:
                    more = [own[h % buckets] for h in runs(words, longest)]
                    n, weight = n + len(more), weight + sum(more)
                h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
                n_words.append(len(words))
                n_features.append(n)
                weights.append(weight)
                scores.append(weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
            numbers = [pa.array(x, pa.int64()) for x in (n_words, n_features, weights, scores)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *numbers], names=names)

    names = ["doc_id", "mark", "n_words", "n_features", "weight", "score"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", "mark", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), "text")
    return keyed.mapInArrow(weighed, f"doc_id {kind}, mark long, n_words long, n_features long, weight long, score long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    target_text: str = "text",
    buckets: int = BUCKETS,
    longest: int = LONGEST,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: doc_id, mark, n_words, n_features, weight, score, rank.

    Features are all runs of 1 to `longest` words. The log ratio of a bucket's share in the
    target texts to that in the documents is a feature's gain; a document's weight is the
    sum of its features' gains. Its score adds noise that a hash of seed and id gives, so
    that the `percent` highest scores of documents of `least_words` words or more are a
    draw without replacement in proportion to the exponential of the weight. Drawn
    documents have their rank from 1; the others null.

    Texts are read twice, for counts and for weights. A task sends a row for each bucket
    at most, and the driver holds the counts of `buckets` buckets. Ranks come from range
    partitions of (score, doc_id) and the rows before each: no task has all rows.

    Null and empty texts have no feature, weight 0 and are never drawn. A null id hashes as
    the empty text and comes after the others in a tie; rows with one id tie by a hash
    of their text, repeated rows in any order, as they are alike. An empty table gives no
    rows; without a target, all its buckets are equal. Very long texts are read whole.
    Extra columns are ignored.
    """
    spark = docs.sparkSession
    body = F.col(f"`{text}`").cast("string")
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(body).alias("mark"), body.alias("text"))
    counted = lambda df: {r["bucket"]: r["n"] for r in bucket_counts(df, buckets, longest).collect()}
    gain = gains(counted(slim.select("text")), counted(target.select(F.col(f"`{target_text}`").cast("string"))), buckets)
    fit = F.col("n_words") >= least_words
    order = [F.desc("fit"), F.desc("score"), F.asc_nulls_last("doc_id"), F.col("mark")]
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    laid = weigh(slim, gain, longest, seed).withColumn("fit", fit).repartitionByRange(parts, *order)
    laid = checkpointed(laid.withColumn("part", F.spark_partition_id()))
    counts = laid.groupBy("part").agg(F.count_if("fit").alias("n"))
    # One row for each partition.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("part").alias("at_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    drawn = F.lit((laid.agg(F.count_if("fit")).first()[0] or 0) * percent // 100)
    rank = F.col("first") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    ranked = laid.join(F.broadcast(starts), F.col("part") == F.col("at_part")).withColumn("rank", rank)
    ranked = ranked.withColumn("rank", F.when(F.col("fit") & (F.col("rank") <= drawn), F.col("rank")).cast("long"))
    return ranked.select("doc_id", "mark", "n_words", "n_features", "weight", "score", "rank")


def keep_drawn(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", **resampling) -> DataFrame:
    """The drawn documents with all their columns; rows alike in id and text are drawn together or, at the cut, all of them."""
    drawn = resample(docs, target, text, doc_id, **resampling).filter("rank is not null").select(F.col("doc_id").alias("of_id"), F.col("mark").alias("of_mark")).distinct()
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col("of_id")) & (F.xxhash64(F.col(f"`{text}`").cast("string")) == F.col("of_mark"))
    return docs.join(drawn, same, "left_semi")
