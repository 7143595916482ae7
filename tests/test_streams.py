"""Streams with state, batch by batch, against brute force."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestar.streaming import streams as W

START = datetime(2024, 3, 1)


def land(spark, folder, batches, schema):
    """A file for each batch, in order of time."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/b{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def ran(stream, tmp_path, mode="append"):
    out = str(tmp_path / "out")
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return q, stream.sparkSession.read.parquet(out)


def let_through(rows, hours, seen=()):
    last, out = {}, []
    for k, at in sorted(seen, key=lambda r: r[1]):
        last[k] = at
    for k, at in sorted(rows, key=lambda r: r[1]):
        if k not in last or at >= last[k] + timedelta(hours=hours):
            last[k] = at
            out.append((k, at))
    return sorted(out, key=repr)


def test_seen_keys_expire(spark, tmp_path):
    at = lambda h, s=0: START + timedelta(hours=h, seconds=s)
    batches = [
        [("a", at(0)), ("b", at(0)), ("a", at(1)), (None, at(1)), ("old", at(1))],
        [("a", at(50)), ("c", at(50)), ("c", at(50)), ("b", at(71, 3599)), (None, at(2))],
        [("a", at(72)), ("b", at(72)), ("old", at(30)), ("d", None)],
        [("a", at(300)), ("b", at(144)), ("c", at(240))],
        [("a", at(301)), ("b", at(301)), ("old", at(299)), (None, at(303))],
    ]
    seen = [("old", at(-40)), ("old", at(-50)), ("b", at(-80))]
    with W.rocksdb(spark):
        stream = land(spark, tmp_path / "in", batches, "sha string, ts timestamp")
        q, out = ran(W.stream_seen(stream, "sha", "ts", 72, spark.createDataFrame(seen, "sha string, ts timestamp")), tmp_path)
    want = let_through([r for b in batches for r in b if r[1]], 72, seen)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == want
    assert ("a", at(72)) in want and ("old", at(30)) not in want and ("old", at(299)) in want
    # The keys of the last batches are left; those that the watermark has passed are gone.
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2 * 5


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(f"k{rng.randrange(12)}", START + timedelta(minutes=rng.randrange(60 * 400))) for _ in range(600)]
    rows.sort(key=lambda r: r[1])
    batches = [rng.sample(rows[i : i + 100], 100) for i in range(0, 600, 100)]
    with W.rocksdb(spark):
        _, out = ran(W.stream_seen(land(spark, tmp_path / "in", batches, "sha string, ts timestamp"), "sha", "ts", 24), tmp_path)
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    assert got == let_through(rows, 24)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "none").endswith(("HDFSBackedStateStoreProvider", "none"))


def test_keys_share_states(spark, tmp_path):
    """A bucket's keys have one state, begun by a history; numbers come out as they are, beside nulls as well."""
    rng = random.Random(3)
    keys, big = [None, *(2**60 + k for k in range(60))], 2**53 + 1
    rows = sorted(((rng.choice(keys), START + timedelta(minutes=rng.randrange(60 * 400))) for _ in range(900)), key=lambda r: r[1])
    rows = [(k, at, None if i % 3 else big + i, float("nan") if i % 2 else None) for i, (k, at) in enumerate(rows)]
    batches = [rng.sample(rows[i : i + 150], 150) for i in range(0, 900, 150)]
    seen = [(k, START - timedelta(hours=h)) for k in keys[:9] for h in (3, 30)]
    with W.rocksdb(spark):
        stream = land(spark, tmp_path / "in", batches, "sha long, ts timestamp, n long, x double")
        found = W.stream_seen(stream, "sha", "ts", 24, spark.createDataFrame(seen, "sha long, ts timestamp"), buckets=3)
        q, out = ran(found, tmp_path)
    got = [tuple(r) for r in out.collect()]
    assert sorted(((k, at) for k, at, *_ in got), key=repr) == let_through([r[:2] for r in rows], 24, seen)
    assert {repr(r) for r in got} <= {repr(r) for r in rows}
    # One time for each bucket and a timer, of two rows, for each of the last batches: not one for each key.
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3 * (1 + 2 * 6)


def test_files_without_order_in_time(spark, small, tmp_path):
    """A table in many files, each over the whole time, gives what it gives in one."""
    from lodestar.plans import catalogue

    spark.read.parquet(f"{small}/events.parquet").repartition(30).write.parquet(str(tmp_path / "events.parquet"))
    found, want = (sorted(map(tuple, catalogue.queries()["streamed_expiring"](spark, str(d)).collect())) for d in (tmp_path, small))
    assert found == want and want


@pytest.mark.parametrize(
    ("kind", "values", "distinct"),
    [
        ("double", [0.0, -0.0, None, float("nan"), float("nan")], 3),
        ("string", ["", "=", None, "a"], 4),
        ("binary", [b"", b"\xff", b"\xfe", None], 4),
        ("timestamp", [START, START + timedelta(microseconds=1), None], 3),
        ("array<string>", [["a", "b"], ["a, b"], ["a", None], [], None], 5),
    ],
)
def test_texts_of_keys(spark, kind, values, distinct):
    df = spark.createDataFrame([(v,) for v in values], f"c0 {kind}")
    texts = df.select(W._plain_key(df, "c0").alias("k"))
    assert texts.filter("k is null").count() == 0
    assert texts.distinct().count() == df.distinct().count() == distinct


def test_scores_of_windows(spark, tmp_path):
    """Batch by batch: repeats are dropped, windows close, and each is scored from its sums."""
    from lodestar.functions import numbers as N

    rng = random.Random(5)
    rows = [(f"v{k}", START + timedelta(minutes=17 * k), rng.choice("xy"), rng.randrange(5000), rng.randrange(50), rng.randrange(9)) for k in range(600)]
    schema = "video_id string, published_at timestamp, channel string, views long, likes long, comments long"
    batches = [rows[i : i + 120] + rng.sample(rows[max(0, i - 60) : i + 120], 30) for i in range(0, 600, 120)]
    _, out = ran(W.stream_scores(land(spark, tmp_path / "in", batches, schema)), tmp_path)
    got = {(r["start"], r["channel"]): (r["n"], r["views"], r["likes"], r["comments"], r["score"]) for r in out.collect()}
    whole = spark.createDataFrame(rows, schema).groupBy(F.window("published_at", "8 hours").alias("w"), "channel")
    whole = whole.agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("views", "likes", "comments")))
    whole = whole.withColumn("score", N.trend_score(F.col("views"), F.col("likes"), F.col("comments"), F.lit(8.0)))
    want = {(r["w"]["start"], r["channel"]): (r["n"], r["views"], r["likes"], r["comments"], r["score"]) for r in whole.collect()}
    closed = rows[-1][1] - timedelta(hours=72 + 8)
    assert got == {k: v for k, v in want.items() if k in got} and {k for k in want if k[0] < closed - timedelta(hours=8)} <= set(got)


def test_indexed_history(spark, tmp_path):
    """Batches read only the folders of the index that their keys fall into, and what they let through counts from then on."""
    from lodestar.operators import similarity as S

    used, out = str(tmp_path / "used"), str(tmp_path / "out")
    S.index_topics(spark.createDataFrame([("old topic words",), ("solo",), ("",), (None,)], "topic string"), used, -1)
    batches = [[("1", "old topic again"), ("2", "fresh subject here")], [("3", "fresh subject returns"), ("4", "other thing entirely"), ("5", "solo piece"), ("6", None)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "video_id string, title string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        cands = W.stream_candidates(spark, str(tmp_path / "in"), "video_id string, title string", files=1)
        W.stream_unused_indexed(cands, used, out, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["video_id"] for r in spark.read.parquet(out).select("video_id").collect()) == ["2", "4", "6"]
    own, kept = S.used_keys(spark.createDataFrame([("7", "solo")], "video_id string, title string"), used, 1, "video_id", "title")
    cells = {r["cell"] for r in own.collect()}
    files = {f.split("cell=")[1].split("/")[0] for f in kept.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
    assert files <= {str(c) for c in cells} and len(cells) <= 2
    assert "PartitionFilters: [isnotnull(batch" in kept._jdf.queryExecution().toString() or "cell" in kept._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:200]
