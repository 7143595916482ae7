"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, free_name

#: Expected copies are whole multiples of 2**-28, so prefix sums are exact long arithmetic.
_ONE = 1 << 28


def n_words(text: Column) -> Column:
    """Words of a text (runs of anything but ASCII white space); null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...], share: float, cap: float) -> list[float]:
    """The words to take of each (source, size), in the order given.

    Weights repeat over the sources. `share` times all sizes is dealt out by weight; a
    source that would get more than `cap` times its size stops there, and the excess is
    dealt out again among the others until none is above.
    """
    out = [0.0] * len(sizes)
    left, open_ = share * sum(n for _, n in sizes), list(range(len(sizes)))
    while open_:
        total = sum(weights[i % len(weights)] for i in open_)
        full = [i for i in open_ if left * weights[i % len(weights)] / total >= cap * sizes[i][1]]
        if not full:
            for i in open_:
                out[i] = left * weights[i % len(weights)] / total
            break
        for i in full:
            out[i] = float(cap * sizes[i][1])
            left -= out[i]
        open_ = [i for i in open_ if i not in full]
        left = max(left, 0.0)
    return out


def shares(docs: DataFrame, source: str, size: str, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """(source, source_size, target, rate) for each source; rate is expected copies in units of 2**-28.

    The list of sources goes through the driver: one row for each source, not for each
    document.
    """
    found = docs.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("n")).collect()
    # By code point, null last: UTF-8 keeps the order of code points.
    sizes = sorted(((r["source"], int(r["n"])) for r in found), key=lambda x: (x[0] is None, (x[0] or "").encode()))
    goal = targets(sizes, weights, share, cap)
    rows = [(s, n, t, min(int(cap * _ONE), round(t / n * _ONE)) if n else 0) for (s, n), t in zip(sizes, goal)]
    return docs.sparkSession.createDataFrame(rows, "source string, source_size long, target double, rate long")


def _mark(seed: int, doc_id: str, source: str, text: str) -> Column:
    return F.xxhash64(F.lit(seed), F.col(doc_id), F.col(doc_id).isNull(), F.col(source), F.col(source).isNull(), F.col(text))


def mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2,
    seed: int = 42,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, mark.

    Systematic sampling: within a source, documents stand in order of size, then of a hash
    of their id, source and text (`mark`), so that the copies a source gets follow its target to about one document.
    The expected copies of a document are summed up over that order, one random offset of
    the source (drawn from `seed` and its name) is added, and the document is emitted once
    for each whole number that its step crosses: at most ceil(cap) times.

    The order of all rows is laid out by range partitions, so a source with most of the
    rows is spread over many of them; a running sum over (partition, source) counts gives
    each partition its start. Reruns agree. Null texts have size 0, null sources are one
    source, null or repeated ids and repeated rows are documents of their own. An empty
    table gives no rows. Sources without words have target 0. Very long texts count whole.
    Extra columns are ignored, whatever their names. The list of sources reaches the driver:
    a row for each distinct value of the column.
    """
    spark = docs.sparkSession
    mark = _mark(seed, doc_id, source, text).alias("mark")
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), mark)
    slim = checkpointed(slim)
    rates = shares(slim, "source", "size", weights, share, cap)
    order = ["source", "size", "mark", "doc_id"]
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    laid = slim.repartitionByRange(parts, *order)
    laid = checkpointed(laid.withColumn("part", F.spark_partition_id()))
    counts = laid.groupBy("part", "source").agg(F.count("*").alias("n"))
    # One row for each partition and source that meet: partitions plus sources at most.
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    starts = starts.select(F.col("part").alias("at_part"), F.col("source").alias("at_source"), "start")
    starts = starts.join(F.broadcast(rates), F.col("at_source").eqNullSafe(F.col("source"))).drop("source")
    within = Window.partitionBy("part", "source").orderBy(*order)
    ranked = laid.withColumn("rank", F.row_number().over(within).cast("long"))
    same = (F.col("part") == F.col("at_part")) & F.col("source").eqNullSafe(F.col("at_source"))
    placed = ranked.join(starts, same)
    offset = F.pmod(F.xxhash64(F.lit(seed), F.col("source")), F.lit(_ONE))
    k = F.col("start") + F.col("rank")
    return placed.select("doc_id", "source", "size", "source_size", "target", (crossed(k, F.col("rate"), offset) - crossed(k - 1, F.col("rate"), offset)).alias("copies"), "mark")


def crossed(k: Column, rate: Column, offset: Column) -> Column:
    """Whole numbers that the sum of k steps of `rate` and the offset, both in units of 2**-28, reaches.

    The high and the low part of k are multiplied apart, so nothing overflows however many
    documents a source has.
    """
    high, low = F.shiftright(k, 28), k.bitwiseAND(F.lit(_ONE - 1))
    return high * rate + F.shiftright(low * rate + offset, 28)


def emit(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", copy: str = "copy", seed: int = 42, **mixing) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the copy's number from 1.

    All columns are kept, with the copy's number in another (under a free name).
    """
    taken = mix(docs, text, source, doc_id, seed=seed, **mixing)
    # Of rows that are alike, some are taken `least` times and the others once more.
    alike = taken.groupBy("mark", "size").agg(
        F.min("copies").alias("least"), F.sum("copies").alias("all"), F.count("*").alias("n")
    )
    alike = alike.filter(F.col("all") > 0).select(*(F.col(c).alias(f"mix_{c}") for c in alike.columns))
    mark, size, row, name = (free_name(docs, x) for x in ("mark", "size", "row", copy))
    marked = docs.withColumn(mark, _mark(seed, doc_id, source, text)).withColumn(size, n_words(F.col(text)))
    # The join and the row numbers need the same partitioning: the texts are shuffled once.
    marked = marked.withColumn(row, F.row_number().over(Window.partitionBy(mark, size).orderBy(F.lit(0))))
    met = marked.join(alike, (F.col(mark) == F.col("mix_mark")) & (F.col(size) == F.col("mix_size")))
    more = F.col(row) <= F.col("mix_all") - F.col("mix_least") * F.col("mix_n")
    copies = F.col("mix_least") + more.cast("int")
    numbers = F.filter(F.sequence(F.lit(0), copies.cast("int")), lambda i: i > 0)
    return met.withColumn(name, F.explode(numbers)).select(*docs.columns, name)
