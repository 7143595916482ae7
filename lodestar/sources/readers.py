"""Sources and sinks: API pages, search results, topic lists, media history, inventories and captions."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import numbers as N

API_PAGE = (
    "items array<struct<id string, snippet struct<title string, description string, publishedAt string, channelTitle string, "
    "categoryId string>, statistics struct<viewCount string, likeCount string, commentCount string>>>, nextPageToken string"
)
SEARCH_PAGE = "results array<string>"
MEDIA_HISTORY = (
    "videos array<string>, images array<string>, video_hashes array<string>, image_hashes array<string>, "
    "video_perceptual_hashes array<string>, image_perceptual_hashes array<string>"
)


def api_rows(pages: DataFrame, source: str, category: str = "") -> DataFrame:
    """One row for each item of parsed pages (schema API_PAGE) that has an id, a title and a time."""
    item = pages.select(F.explode("items").alias("i"))
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    count = lambda name: F.coalesce(F.col(f"i.statistics.{name}").try_cast("long"), F.lit(0))
    rows = item.filter((text(F.col("i.id")) != "") & (text(F.col("i.snippet.title")) != "") & (text(F.col("i.snippet.publishedAt")) != ""))
    return rows.select(
        F.col("i.id").alias("video_id"),
        F.col("i.snippet.title").alias("title"),
        F.left(F.coalesce("i.snippet.description", F.lit("")), F.lit(600)).alias("description"),
        F.col("i.snippet.publishedAt").alias("published_at"),
        F.coalesce("i.snippet.channelTitle", F.lit("")).alias("channel"),
        F.coalesce(F.nullif(F.col("i.snippet.categoryId"), F.lit("")), F.lit(category)).alias("category_id"),
        count("viewCount").alias("views"),
        count("likeCount").alias("likes"),
        count("commentCount").alias("comments"),
        F.lit(source).alias("source"),
    )


def read_api_pages(spark: SparkSession, path: str, source: str, category: str = "") -> DataFrame:
    """Rows of landed API pages; a page that is not JSON gives none."""
    return api_rows(spark.read.schema(API_PAGE).json(path), source, category)


def union_sources(*sources: DataFrame) -> DataFrame:
    """All rows of all sources; a column that one lacks is null there."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def read_sources(spark: SparkSession, sources: dict[str, tuple[str, str]]) -> DataFrame:
    """Rows of all sources, given by label as (path, category); one that cannot be found is skipped, all of them are an error."""
    read = []
    for label, (path, category) in sources.items():
        try:
            read.append(read_api_pages(spark, path, label, category))
        except AnalysisException:  # its path is not there: the others count without it
            continue
    if not read:
        raise ValueError("no source can be read")
    return union_sources(*read)


def _usable(i: Column) -> Column:
    """Whether an item has an id, a title and a time."""
    said = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    return said(i["id"]) & said(i["snippet"]["title"]) & said(i["snippet"]["publishedAt"])


def checked_sources(spark: SparkSession, sources: dict[str, tuple[str, str]]) -> tuple[DataFrame | None, DataFrame]:
    """(rows, report) of sources given by label as (path, category).

    report: source, pages, failed (pages that are no JSON), n_read and n_refused (items with
    and without an id, a title and a time), status: `read`, `failed` if any page failed, or
    `missing`. A source that failed gives no rows, the others all of theirs; rows is None
    if none was read. Each source is a row of the report, which reaches the driver.
    """
    found = []
    for label, (path, category) in sources.items():
        try:
            pages = spark.read.schema(f"{API_PAGE}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
        except AnalysisException:  # its path is not there
            found.append((label, 0, 0, 0, 0, "missing"))
            continue
        items = F.coalesce(F.size("items"), F.lit(0))
        items = F.when(items < 0, 0).otherwise(items)
        good = F.when(F.col("items").isNotNull(), F.size(F.filter("items", _usable))).otherwise(0)
        sums = pages.select(F.col("_corrupt").isNotNull().alias("bad"), items.alias("items"), good.alias("good"))
        r = sums.agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"), F.sum("items").alias("items"), F.sum("good").alias("good")).first()
        n_read = r["good"] or 0
        found.append((label, r["n"], r["bad"], n_read, (r["items"] or 0) - n_read, "failed" if r["bad"] else "read"))
    report = spark.createDataFrame(found, "source string, pages long, failed long, n_read long, n_refused long, status string")
    read = [read_api_pages(spark, sources[s][0], s, sources[s][1]) for s, *_, status in found if status == "read"]
    return (union_sources(*read) if read else None), report


def search_rows(pages: DataFrame, results: Column) -> DataFrame:
    """(title, snippet, source, link, pos) of an array of JSON texts, each an address or an object."""
    one = pages.select("*", F.posexplode(results).alias("pos", "raw"))
    parsed = F.from_json("raw", "title string, snippet string, source string, link string, url string")
    is_object = F.ltrim("raw").startswith("{")
    field = lambda name: F.coalesce(F.when(is_object, parsed[name]), F.lit(""))
    link = F.when(is_object, F.coalesce(F.nullif(parsed["link"], F.lit("")), parsed["url"], F.lit(""))).otherwise(F.col("raw"))
    return one.select(*pages.columns, "pos", field("title").alias("title"), field("snippet").alias("snippet"), field("source").alias("source"), link.alias("link"))


def read_search_results(spark: SparkSession, path: str) -> DataFrame:
    return search_rows(spark.read.schema(SEARCH_PAGE).json(path), F.col("results")).drop("results")


def read_topic_list(spark: SparkSession, path: str) -> DataFrame:
    """Topics of a text file, one a line; blank lines and lines that begin with # are left out."""
    lines = spark.read.text(path)
    return lines.filter((F.trim("value") != "") & ~F.col("value").startswith("#")).select(F.trim("value").alias("topic"))


def append_topics(topics: DataFrame, path: str, mode: str = "append") -> None:
    topics.select(F.col("topic").alias("value")).write.mode(mode).text(path)


def history_rows(history: DataFrame) -> DataFrame:
    """(media_type, key_kind, key_value) of the wide form; missing lists are empty."""
    columns = {"url": "{}s", "hash": "{}_hashes", "perceptual": "{}_perceptual_hashes"}

    def entries(media: str, kind: str) -> Column:
        values = F.coalesce(F.col(columns[kind].format(media)), F.array().cast("array<string>"))
        entry = lambda v: F.struct(F.lit(media).alias("media_type"), F.lit(kind).alias("key_kind"), v.alias("key_value"))
        return F.transform(values, entry)

    lists = [entries(media, kind) for media in ("video", "image") for kind in columns]
    return history.select(F.explode(F.concat(*lists)).alias("x")).select("x.*").filter("key_value is not null")


def read_media_history(spark: SparkSession, path: str) -> DataFrame:
    """The history as a long table; a corrupt file is an error."""
    return history_rows(spark.read.schema(MEDIA_HISTORY).option("multiLine", True).option("mode", "FAILFAST").json(path))


def _recovered(fs, target, aside) -> None:
    """Put a table that was set aside back in its place, if a failure left none there."""
    if fs.exists(aside) and not fs.exists(target) and not fs.rename(aside, target):
        raise OSError(f"{aside} cannot be put back in the place of {target}")


def replace_table(df: DataFrame, path: str) -> None:
    """Write df beside path, then put it in path's place.

    The old table is set aside before and deleted after. A failure in between leaves it set
    aside, and the next call, or recover_table(), puts it back before anything else. For
    readers that must never find a moment without a table, see snapshots.write_snapshot().
    """
    spark = df.sparkSession
    recover_table(spark, path)
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    fs, target, aside, new = _places(spark, path, staged)
    if fs.exists(target):
        fs.delete(aside, True)
        if not fs.rename(target, aside):
            raise OSError(f"{path} cannot be set aside")
    if not fs.rename(new, target):
        _recovered(fs, target, aside)
        raise OSError(f"{staged} cannot be put in the place of {path}")
    fs.delete(aside, True)


def _places(spark: SparkSession, path: str, staged: str):
    at = spark._jvm.org.apache.hadoop.fs.Path
    target = at(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target, at(f"{path.rstrip('/')}.before"), at(staged)


def recover_table(spark: SparkSession, path: str) -> None:
    """Undo a replace_table() that failed after it had set the old table aside."""
    fs, target, aside, _ = _places(spark, path, path)
    _recovered(fs, target, aside)


def pack_files(files: DataFrame, path: str) -> None:
    """Write small files (path string, content binary) as rows of a bounded number of Parquet files, with their lengths.

    A folder or file for each of very many would cost the driver, which lists and commits
    them, more than reading them costs the cluster.
    """
    files.select("path", F.length("content").cast("long").alias("length"), "content").write.mode("overwrite").parquet(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of files that pack_files() wrote, as the reader of single binary files names them."""
    return spark.read.schema("path string, length long, content binary").parquet(path)


def inventory_media(spark: SparkSession, path: str, least_bytes: int, most_bytes: int = C.MAX_BYTES, packed: bool = False) -> DataFrame:
    """(path, size, sha) of the files, single or packed, within the limits; the others' bytes are not hashed."""
    files = read_packed(spark, path) if packed else spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    fit = files.filter((F.col("length") >= least_bytes) & (F.col("length") <= most_bytes))
    return fit.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha"))


def cue_rows(files: DataFrame, strict: bool = False) -> DataFrame:
    """(path, at, start_ms, end_ms, text) of caption files (path, value); with strict the time line must be the second."""
    blocks = files.select("path", F.posexplode(F.split(F.trim(F.regexp_replace("value", "\r", "")), r"\n\s*\n")).alias("at", "block"))
    stamp = r"(\d\d:\d\d:\d\d,\d+)\s+-->\s+(\d\d:\d\d:\d\d,\d+)"
    line = rf"^[^\n]*\n{stamp}[^\n]*\n([\s\S]*)" if strict else rf"(?:^|\n){stamp}[^\n]*\n([\s\S]*)"
    part = lambda k: F.regexp_extract("block", line, k)
    rows = blocks.filter(F.col("block").rlike(line) & (F.size(F.split("block", "\n")) >= 3))
    return rows.select("path", "at", N.parse_srt_time(part(1)).alias("start_ms"), N.parse_srt_time(part(2)).alias("end_ms"), F.trim(part(3)).alias("text"))


def read_srt(spark: SparkSession, path: str, strict: bool = False, packed: bool = False) -> DataFrame:
    """Cues of caption files, single or packed."""
    if packed:
        files = read_packed(spark, path).select("path", F.decode("content", "UTF-8").alias("value"))
    else:
        files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return cue_rows(files, strict)


def write_srt(texts: DataFrame, path: str, script: str, packed: bool = False) -> None:
    """One folder for each script with its caption text; packed, those files as rows of a bounded number of files."""
    if packed:
        name = F.concat(F.lit(f"{script}="), F.col(script).cast("string"), F.lit(".srt"))
        pack_files(texts.select(name.alias("path"), F.encode("srt", "UTF-8").alias("content")), path)
        return
    texts.select(script, F.col("srt").alias("value")).write.partitionBy(script).mode("overwrite").text(path)


def write_stage_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
