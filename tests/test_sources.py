import json

import pytest
from pyspark.sql import functions as F

from lodestar.sources import readers as R
from lodestar.streaming import streams as W


def page(*items):
    return json.dumps({"items": list(items)})


def test_api_pages(spark, tmp_path):
    good = {"id": "a", "snippet": {"title": "T", "publishedAt": "2024-01-01T00:00:00Z", "description": "d" * 700}, "statistics": {"viewCount": "12", "likeCount": "x"}}
    (tmp_path / "p.json").write_text(page(good, {"id": "b", "snippet": {"title": " "}}, {"id": None}) + "\nnot json\n")
    rows = R.read_api_pages(spark, str(tmp_path), "popular", "28").collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["video_id"], r["views"], r["likes"], r["category_id"], len(r["description"])) == ("a", 12, 0, "28", 600)


def test_search_results(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"results": ["http://a", {"title": "t", "url": "http://b"}, {"link": "http://c", "snippet": "s"}]}))
    rows = R.read_search_results(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r["pos"], r["title"], r["snippet"], r["link"]) for r in rows] == [(0, "", "", "http://a"), (1, "t", "", "http://b"), (2, "", "s", "http://c")]


def test_topic_lists(spark, tmp_path):
    p = tmp_path / "topics.txt"
    p.write_text("# head\n one \n\n #kept\ntwo\n")
    topics = R.read_topic_list(spark, str(p))
    assert [r["topic"] for r in topics.collect()] == ["one", "#kept", "two"]
    R.append_topics(topics, str(tmp_path / "out"))
    R.append_topics(spark.createDataFrame([("three",)], "topic string"), str(tmp_path / "out"))
    assert R.read_topic_list(spark, str(tmp_path / "out")).count() == 3  # "#kept" now begins with #


def test_media_history(spark, tmp_path):
    p = tmp_path / "h.json"
    p.write_text(json.dumps({"videos": ["u1", "u2"], "image_hashes": ["h"], "video_perceptual_hashes": ["0f"]}))
    found = sorted(tuple(r) for r in R.read_media_history(spark, str(p)).collect())
    assert found == [("image", "hash", "h"), ("video", "perceptual", "0f"), ("video", "url", "u1"), ("video", "url", "u2")]
    p.write_text("{broken")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        R.read_media_history(spark, str(p)).collect()


def test_replaced_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    R.replace_table(spark.range(3), path)
    R.replace_table(spark.read.parquet(path).union(spark.range(9, 10)), path)
    assert spark.read.parquet(path).count() == 4


def test_inventories(spark, tmp_path):
    for name, n in (("small", 10), ("fit", 100), ("large", 1000)):
        (tmp_path / name).write_bytes(b"x" * n)
    rows = R.inventory_media(spark, str(tmp_path), 50, 500).collect()
    assert [r["size"] for r in rows] == [100] and len(rows[0]["sha"]) == 64


def test_captions_round_trip(spark, tmp_path):
    srt = "1\n00:00:00,000 --> 00:00:01,500\nfirst line\nsecond\n\nx\n00:00:02,000 --> 00:00:03,000\nlast\n\nnonsense\n"
    (tmp_path / "a.srt").write_text(srt)
    rows = R.read_srt(spark, str(tmp_path)).orderBy("at").collect()
    assert [(r["start_ms"], r["end_ms"], r["text"]) for r in rows] == [(0, 1500, "first line\nsecond"), (2000, 3000, "last")]
    assert R.read_srt(spark, str(tmp_path), strict=True).count() == 2
    R.write_srt(spark.createDataFrame([(7, srt)], "script long, srt string"), str(tmp_path / "out"), "script")
    assert R.read_srt(spark, str(tmp_path / "out" / "script=7")).count() == 2


def test_stage_documents(spark, tmp_path):
    R.write_stage_json(spark.createDataFrame([(1, ["a"])], "id long, tags array<string>"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first()["tags"] == ["a"]


def test_streams_deduplicate_and_drop_late_rows(spark, tmp_path):
    src = tmp_path / "in"
    schema = "video_id string, published_at timestamp"
    put = lambda *rows: spark.createDataFrame(rows, "video_id string, at string").selectExpr("video_id", "to_timestamp(at) AS published_at").coalesce(1).write.mode("append").parquet(str(src))

    def run():
        out = W.stream_dedupe(W.stream_candidates(spark, str(src), schema, files=1))
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r["video_id"] for r in spark.read.schema(schema).parquet(str(tmp_path / "out")).collect())

    put(("a", "2024-01-10 00:00:00"), ("b", "2024-01-10 01:00:00"))
    assert run() == ["a", "b"]
    put(("a", "2024-01-10 02:00:00"), ("c", "2024-01-20 00:00:00"))
    assert run() == ["a", "b", "c"]
    put(("late", "2024-01-02 00:00:00"), ("d", "2024-01-20 01:00:00"))
    assert run() == ["a", "b", "c", "d"]


def test_unused_stream_appends_its_history(spark, tmp_path):
    src, used = tmp_path / "in", str(tmp_path / "used")
    spark.createDataFrame([("old topic words",)], "topic string").write.parquet(f"{used}/batch=-1")
    for name, rows in (("1", [("1", "old topic again"), ("2", "fresh subject here")]), ("2", [("3", "fresh subject returns"), ("4", "other thing entirely")])):
        spark.createDataFrame(rows, "video_id string, title string").coalesce(1).write.mode("append").parquet(str(src))
        cands = W.stream_candidates(spark, str(src), "video_id string, title string", files=1)
        W.stream_unused(cands, used, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["video_id"] for r in spark.read.parquet(str(tmp_path / "out")).select("video_id").collect()) == ["2", "4"]
    assert spark.read.parquet(used).filter(F.col("batch") >= 0).count() == 2


def test_model_plug_point_fails_closed(spark):
    from lodestar.functions.sql_udfs import score_batches

    def model(batch):
        raise ValueError("no answer")

    assert score_batches(spark.createDataFrame([("a",)], "video_id string"), model).count() == 0


def test_a_source_that_cannot_be_read_is_skipped(spark, tmp_path):
    page = '{"items": [{"id": "1", "snippet": {"title": "t", "publishedAt": "2024-01-31T00:00:00Z"}}]}'
    (tmp_path / "a.json").write_text(page)
    found = R.read_sources(spark, {"here": (str(tmp_path / "a.json"), "1"), "gone": (str(tmp_path / "none.json"), "2")})
    assert [(r["video_id"], r["source"]) for r in found.collect()] == [("1", "here")]
    with pytest.raises(ValueError):
        R.read_sources(spark, {"gone": (str(tmp_path / "none.json"), "2")})


def test_sources_are_checked(spark, tmp_path):
    """A source with a page that is no JSON gives no rows and says so; the others count without it."""
    item = lambda i, title="t": {"id": i, "snippet": {"title": title, "publishedAt": "2024-01-31T00:00:00Z"}}
    (tmp_path / "good").mkdir()
    (tmp_path / "good/a.json").write_text(page(item("1"), item("2", " "), {"id": None}) + "\n" + json.dumps({"nextPageToken": "x"}) + "\n")
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/a.json").write_text(page(item("3")) + "\n" + page(item("4"))[:30] + "\n")
    paths = {k: (str(tmp_path / k), "1") for k in ("good", "bad", "gone")}
    rows, report = R.checked_sources(spark, paths)
    assert [(r["video_id"], r["source"]) for r in rows.collect()] == [("1", "good")]
    found = {r["source"]: tuple(r)[1:] for r in report.collect()}
    assert found == {"good": (2, 0, 1, 2, "read"), "bad": (2, 1, 1, 0, "failed"), "gone": (0, 0, 0, 0, "missing")}
    rows, report = R.checked_sources(spark, {"gone": paths["gone"]})
    assert rows is None and report.count() == 1


@pytest.mark.parametrize("name,prefix", [("file_inventory", "files"), ("read_cues", "srt")])
def test_small_files_are_packed(spark, small, name, prefix):
    """A query over very many small files writes a bounded number of files, not a folder for each."""
    import glob

    from lodestar.plans import catalogue
    from lodestar.sources.folders import shared_base

    base = shared_base(spark).removeprefix("file:")
    before = set(glob.glob(f"{base}/{prefix}-*"))
    catalogue.queries()[name](spark, small).count()
    (made,) = set(glob.glob(f"{base}/{prefix}-*")) - before
    assert 0 < len(glob.glob(f"{made}/**/part-*", recursive=True)) <= 8


def test_packed_files_equal_single_ones(spark, tmp_path):
    texts = spark.createDataFrame([(1, "1\n00:00:01,000 --> 00:00:02,500\nü –\n\n"), (2, "1\n00:00:00,000 --> 00:00:01,000\na\nb\n\n2\n00:00:01,000 --> 00:00:03,000\nc\n\n"), (3, "")], "s int, srt string")
    for form in (False, True):
        R.write_srt(texts, str(tmp_path / f"srt{form}"), "s", packed=form)
    one, many = R.read_srt(spark, str(tmp_path / "srtTrue"), True, packed=True), R.read_srt(spark, f"{tmp_path}/srtFalse/*", True)
    rows = lambda df: sorted(tuple(r) for r in df.select(F.regexp_extract("path", r"s=(\d+)", 1), "at", "start_ms", "end_ms", "text").collect())
    assert rows(one) == rows(many) and len(rows(one)) == 3
    (tmp_path / "files").mkdir()
    for n in (10, 100, 1000):
        (tmp_path / "files" / f"f{n}").write_bytes(b"\xff" * n)
    R.pack_files(spark.read.format("binaryFile").load(str(tmp_path / "files")), str(tmp_path / "packed"))
    got = [R.inventory_media(spark, str(tmp_path / p), 50, 500, packed=p == "packed") for p in ("files", "packed")]
    assert got[0].select("path", "size", "sha").collect() == got[1].select("path", "size", "sha").collect() != []
