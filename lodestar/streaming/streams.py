"""Streams of candidates: polling, de-duplication, velocity and unused topics."""

from __future__ import annotations

from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import AtomicType, BinaryType, BooleanType, DoubleType, FloatType, NumericType

from ..functions import constants as C
from ..functions import numbers as N
from ..operators.similarity import anti_indexed, anti_similar, index_topics


def stream_candidates(spark: SparkSession, path: str, schema, files: int = 10, form: str = "parquet") -> DataFrame:
    """New files of candidates as they land."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(form).load(path)


def _timed(df: DataFrame, ts: str) -> DataFrame:
    """df with its event time as an instant; one without a zone is in the session's."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def stream_dedupe(cands: DataFrame, key: str = "video_id", ts: str = "published_at") -> DataFrame:
    """The first row of each id within the window; older ones are late and dropped, and so is their state."""
    return _timed(cands, ts).withWatermark(ts, f"{C.WINDOW_HOURS} hours").dropDuplicatesWithinWatermark([key])


def stream_velocity(events: DataFrame, ts: str, key: str, value: str, width: str = "8 hours", slide: str | None = None) -> DataFrame:
    """Sums and counts of each key over tumbling (or, with slide, sliding) windows."""
    marked = _timed(events, ts).withWatermark(ts, f"{C.WINDOW_HOURS} hours")
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return marked.groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total"
    )


def stream_unused(cands: DataFrame, history_path: str, out_path: str, checkpoint: str, available_now: bool = True):
    """Write the candidates of each batch that are similar to no used topic, and add their titles to the history.

    Both folders are written under the batch's number, so a batch that runs again after a
    failure replaces what it wrote, and reads only the history of the batches before.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        used = spark.read.parquet(history_path).filter(F.col("batch") < number)
        kept = anti_similar(batch, used, "video_id", "title", "topic", "topic")
        kept.write.mode("overwrite").parquet(f"{out_path}/batch={number}")
        done = spark.read.parquet(f"{out_path}/batch={number}")
        done.select(F.col("title").alias("topic")).write.mode("overwrite").parquet(f"{history_path}/batch={number}")

    writer = cands.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_unused_indexed(cands: DataFrame, index_path: str, out_path: str, checkpoint: str, available_now: bool = True):
    """As stream_unused(), with the history as an index of keys (see index_topics()): a batch reads only the folders it touches."""

    def step(batch: DataFrame, number: int) -> None:
        anti_indexed(batch, index_path, number, "video_id", "title").write.mode("overwrite").parquet(f"{out_path}/batch={number}")
        done = batch.sparkSession.read.parquet(f"{out_path}/batch={number}")
        index_topics(done.select(F.col("title").alias("topic")), index_path, number)

    writer = cands.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_scores(cands: DataFrame, key: str = "video_id", ts: str = "published_at", by: str = "channel", hours: int = 8) -> DataFrame:
    """(start, by, n, views, likes, comments, score): the trend score of each window's sums, of candidates counted once.

    Three steps in one stream: rows whose id has come before are dropped, the others summed
    up over windows of `hours`, and each closed window scored with its width as the age.
    cands: key, ts, by, views, likes, comments.
    """
    once = stream_dedupe(cands, key, ts)
    sums = [F.sum(c).alias(c) for c in ("views", "likes", "comments")]
    summed = once.groupBy(F.window(ts, f"{hours} hours").alias("w"), by).agg(F.count("*").alias("n"), *sums)
    score = N.trend_score(F.col("views"), F.col("likes"), F.col("comments"), F.lit(float(hours)))
    return summed.select(F.col("w.start").alias("start"), by, "n", "views", "likes", "comments", score.alias("score"))


def stream_seen_media(media: DataFrame, history_path: str, out_path: str, checkpoint: str):
    """Write the media of each batch whose hash neither the history nor an earlier item of the batch has."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        used = spark.read.parquet(history_path).filter(F.col("batch") < number).select(F.col("sha").alias("_sha"))
        fresh = batch.join(used, F.col("sha") == F.col("_sha"), "left_anti").dropDuplicates(["sha"])
        fresh.write.mode("overwrite").parquet(f"{out_path}/batch={number}")
        done = spark.read.parquet(f"{out_path}/batch={number}")
        done.select("sha").write.mode("overwrite").parquet(f"{history_path}/batch={number}")

    return media.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Groups into which stream_seen() deals keys; each has one state.
BUCKETS = 4096


class _Seen(StatefulProcessor):
    """Lets a row through if none of its key was let through in the time to live before it.

    A group holds the keys of a bucket; its state is the time of each one's row last let
    through, without those that the watermark has passed, and goes when all have.
    """

    def __init__(self, live: int, names: list[str]) -> None:
        self.live, self.names = live, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "keys array<string>, us array<long>")

    def _get(self) -> dict:
        return dict(zip(*self.state.get())) if self.state.exists() else {}

    def _put(self, last: dict, passed: int) -> None:
        """Keep the times that a row not before `passed` could still depend on."""
        last = {k: us for k, us in last.items() if us + self.live > passed}
        if last:
            self.state.update((list(last), list(last.values())))
            self.handle.registerTimer((max(last.values()) + self.live) // 1000 + 1)
        else:
            self.state.clear()

    def handleInitialState(self, key, initialState, timerValues) -> None:
        last = self._get()
        for k, us in zip(initialState["k"].tolist(), initialState["micros"].tolist()):
            last[k] = max(us, last.get(k, us))
        self._put(last, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleInputRows(self, key, rows, timerValues):
        parts = [r for r in rows if len(r)]
        if not parts:  # a bucket that has begun with its state alone
            return
        last, kept = self._get(), []
        batch = pd.concat(parts).sort_values("micros", kind="stable")
        for at, (k, us) in enumerate(zip(batch["k"].tolist(), batch["micros"].tolist())):
            before = last.get(k)
            if before is None or us >= before + self.live:
                last[k] = us
                kept.append(at)
        if kept:
            # Rows that this batch still takes may lie before the watermark, those of the next one don't.
            self._put(last, timerValues.getCurrentWatermarkInMs() * 1000)
            yield batch.iloc[kept][self.names]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        # Later rows may have set times anew, with a timer of their own.
        last = self._get()
        if last:
            self._put(last, expiredTimerInfo.getExpiryTimeInMs() * 1000)
        return iter(())

    def close(self) -> None:
        pass


def stream_seen(rows: DataFrame, key: str, ts: str, hours: int = C.WINDOW_HOURS, seen: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The rows of a stream whose key was not let through in the `hours` before, by state that expires.

    A key's state is the time of its row last let through. A row at least `hours` later
    is let through again; when the watermark (as long again) has passed that point, the
    state goes, so it holds the keys of the last days and no history is read in a batch.
    `seen` (key, ts) are rows of before: they are the state of the first batch.

    Keys are dealt by their hash into `buckets`, and a batch takes each bucket's rows and
    state at once, since calls for single keys cost far more than their rows. A bucket's
    state is written whole when one of its keys is let through. It must stay the same as
    long as the stream's checkpoint is used.

    Rows of one key in a batch are taken in order of time; those older than the watermark
    are dropped. Rows without a time are dropped; null keys are one key. The state store
    must be RocksDB's (see rocksdb()).
    """
    names = rows.columns
    # The operator's rows come with names that must be plain words.
    plain = [f"c{i}" for i in range(len(names))]
    at, of = plain[names.index(ts)], plain[names.index(key)]

    def marked(df: DataFrame) -> DataFrame:
        timed = df.withColumns({"micros": F.unix_micros(at), "k": _plain_key(df, of)}).filter("micros is not null")
        return timed.withColumn("bucket", F.pmod(F.xxhash64("k"), F.lit(buckets)).cast("int"))

    # Numbers travel as texts: Pandas would take whole ones beside nulls, and nulls beside NaN, as floating point.
    kinds = {c: f.dataType for c, f in zip(plain, rows.schema) if c != at and isinstance(f.dataType, (NumericType, BooleanType))}
    texts = {c: F.col(c).cast("string") for c in kinds}
    stream = marked(_timed(rows.toDF(*plain), at)).withColumns(texts).withWatermark(at, f"{hours} hours")
    before = None
    if seen is not None:
        cast = F.col(key).cast(rows.schema[key].dataType)
        before = marked(_timed(seen.select(cast.alias(of), F.col(ts).alias(at)), at)).select("bucket", "k", "micros").groupBy("bucket")
    found = stream.groupBy("bucket").transformWithStateInPandas(_Seen(hours * 3_600_000_000, plain), stream.select(*plain).schema, "Append", "EventTime", before)
    return found.withColumns({c: F.col(c).cast(kind) for c, kind in kinds.items()}).toDF(*names)


def _plain_key(df: DataFrame, name: str) -> Column:
    """A text that is the same for the keys that a grouping takes as equal, and for no others; null has one of its own."""
    kind = df.schema[name].dataType
    if isinstance(kind, BinaryType):
        text = F.hex(name)
    elif isinstance(kind, (FloatType, DoubleType)):
        text = (F.col(name) + F.lit(0.0).cast(kind)).cast("string")  # -0.0 is 0.0
    elif isinstance(kind, AtomicType):
        text = F.col(name).cast("string")
    else:
        text = F.to_json(F.struct(name), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    return F.coalesce(F.concat(F.lit("="), text), F.lit(""))


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams started within keep their state in RocksDB, as operators with state of their own need."""
    name, old = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if old is None else spark.conf.set(name, old)
