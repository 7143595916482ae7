"""Tables derived from the test data, in Spark and as SQL with the same meaning.

The raw tables hold no repeated addresses, hardly any near fingerprints and only short
scripts, so such cases are planted here by rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import fingerprints as H

AS_OF = "2024-02-01 00:00:00"


def load(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def as_of():
    return F.expr(f"TIMESTAMP '{AS_OF}'")


def cand(spark: SparkSession, d: str, scored: bool = True) -> DataFrame:
    """Candidates from documents; every third also arrives from source B."""
    docs = load(spark, d, "documents")
    rows = docs.select(
        F.col("doc_id").cast("string").alias("video_id"),
        "doc_id",
        F.array_join(F.slice(F.split("text", " "), 1, 8), " ").alias("title"),
        F.substring("text", 1, 600).alias("description"),
        F.col("source").alias("channel"),
        F.col("lang").alias("category_id"),
        (as_of() - F.make_dt_interval(hours=(F.col("doc_id") % 120).cast("int"))).alias("published_at"),
        (1000 + 37 * F.col("n_chars")).alias("views"),
        (F.col("n_chars") % 997).alias("likes"),
        (F.col("doc_id") % 89).alias("comments"),
    )
    both = rows.withColumn("source", F.lit("A")).union(rows.filter("doc_id % 3 = 0").withColumn("source", F.lit("B")))
    if not scored:
        return both
    age = N.age_hours(F.col("published_at"), as_of())
    return both.withColumn("trend_score", N.trend_score(F.col("views"), F.col("likes"), F.col("comments"), age))


def history(spark: SparkSession, d: str) -> DataFrame:
    items = load(spark, d, "benchmark")
    return items.select("item_id", F.array_join(F.slice(F.split("text", " "), 1, 4), " ").alias("topic"))


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    """A verdict for every candidate, varied so that each rule fires; every 97th id is unknown."""
    k = F.col("doc_id") % 8
    return load(spark, d, "documents").select(
        F.when(F.col("doc_id") % 97 == 5, F.concat(F.lit("x"), F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string")).alias("candidate_id"),
        F.when(k == 1, "ANIME").when(k == 2, "POLITICS").otherwise("movie ").alias("content_domain"),
        F.when(k == 3, "").otherwise(F.col("source")).alias("niche_subject"),
        F.when(k == 4, F.lit(None).cast("string")).otherwise(F.col("lang")).alias("niche_evidence"),
        F.when(k == 5, '"true"').when(k == 6, "false").otherwise("true").alias("us_movie_relevant"),
        F.when(k == 7, " ").otherwise("reason").alias("us_relevance_reason"),
        F.when(F.col("doc_id") % 5 == 0, "recap").when(F.col("doc_id") % 5 == 1, "POEM").otherwise("ANALYSIS").alias("content_type"),
    )


def sections(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "conversations")
    return c.select(
        F.col("conv_id").alias("script_id"),
        F.col("turn").alias("section_id"),
        F.col("role").alias("section_type"),
        F.col("text").alias("narration"),
        (F.col("conv_id") * 7 + F.col("turn") * 3).alias("n"),
    )


def timed_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections with whole and half seconds, some 0."""
    return sections(spark, d).withColumn("seconds", F.col("n") % 11 * 0.5)


def media(spark: SparkSession, d: str) -> DataFrame:
    """Media from pages with planted repeats of address and content."""
    p = load(spark, d, "pages").select(
        "page_id",
        "url",
        F.when(F.col("page_id") % 4 < 2, "video").otherwise("image").alias("kind"),
        (F.col("page_id") * 7919 * 1009 % 3_000_000_000).alias("size"),
        F.when(F.col("page_id") % 11 != 0, (F.col("page_id") * 37 % 12_000).cast("double")).alias("duration"),
        F.sha2("html", 256).alias("sha"),
    )
    part = lambda k: F.regexp_extract("url", r"^([a-z]+)://([^/?#]*)([^?#]*)", k)
    same_url = p.filter("page_id % 3 = 0").withColumn("url", F.concat(part(1), F.lit("://"), F.upper(part(2)), part(3), F.lit("?ref=x")))
    same_body = p.filter("page_id % 5 = 0").withColumn("url", F.concat(F.lit("https://mirror.example.com/p/"), F.col("page_id")))
    short = p.filter("page_id % 7 = 0").withColumn("url", F.concat(F.lit("https://youtu.be/v"), F.col("page_id")))
    watch = p.filter("page_id % 7 = 0").withColumn("url", F.concat(F.lit("https://www.youtube.com/watch?t=1&v=v"), F.col("page_id")))
    planted = [p, same_url, same_body, *(x.withColumn("sha", F.sha2("url", 256)) for x in (short, watch))]
    out = None
    for k, x in enumerate(planted):
        x = x.withColumn("media_id", F.col("page_id") + k * 1_000_000).drop("page_id")
        out = x if out is None else out.unionByName(x)
    return out


def media_history(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "pages")
    urls = p.filter("page_id % 10 = 3").select(F.lit("video").alias("media_type"), F.lit("url").alias("key_kind"), F.regexp_extract("url", r"^([^?#]*)", 1).alias("key_value"))
    shas = p.filter("page_id % 10 = 7").select(F.lit("video").alias("media_type"), F.lit("hash").alias("key_kind"), F.sha2("html", 256).alias("key_value"))
    return urls.union(shas)


def fp(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints of embeddings, four a clip, with planted copies 0 to 9 bits away."""
    e = load(spark, d, "embeddings").select("vec_id", N.diff_hash(F.col("embedding")).alias("h"))
    rows = e.select("vec_id", "h", F.floor(F.col("vec_id") / 4).cast("long").alias("clip"), (F.col("vec_id") % 4).cast("int").alias("frame"))
    flips = (3 * F.floor(F.col("vec_id") / 20) + F.col("vec_id") % 4) % 10
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), flips.cast("int")) - 1
    copies = rows.filter(F.col("clip") % 5 == 0).select(
        (F.col("vec_id") + 1_000_000_000).alias("vec_id"), F.col("h").bitwiseXOR(mask).alias("h"), (F.col("clip") + 1_000_000_000).alias("clip"), "frame"
    )
    return rows.union(copies)


def attempts(spark: SparkSession, d: str) -> DataFrame:
    """An attempt log from events: errors by their value, everything else a success."""
    v = F.floor("value").cast("int") % 4
    message = F.when(v == 0, "HTTP 401 Unauthenticated").when(v == 1, "503 service unavailable").when(v == 2, "deadline_exceeded").otherwise("bad schema")
    return load(spark, d, "events").select(
        F.concat(F.lit("m"), F.col("user_id") % 4).alias("model"), "ts", F.when(F.col("event_type") == "error", message).alias("message")
    )


def renditions(spark: SparkSession, d: str) -> DataFrame:
    """Four renditions of every part, some without a link or size."""
    p = load(spark, d, "part").select("p_partkey", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k"))
    n = F.col("p_partkey") * 31 + F.col("k") * 17
    return p.select(
        F.col("p_partkey").alias("item"),
        F.when(n % 13 == 0, "").otherwise(F.concat(F.lit("f"), F.col("p_partkey"), F.lit("-"), F.col("k"))).alias("link"),
        F.when(n % 7 == 0, 0).otherwise(240 + n % 9 * 240).cast("int").alias("width"),
        (320 + n % 5 * 400).cast("int").alias("height"),
        F.when(n % 3 == 0, "HD").otherwise("sd").alias("quality"),
    )


def script_media(spark: SparkSession, d: str) -> DataFrame:
    """Media of sections: none for every fourth, else one to three, with names from both tiers and repeats."""
    s = sections(spark, d).filter("n % 4 <> 0").select("script_id", "section_id", "n", F.explode(F.expr("sequence(0, cast(n % 3 as int))")).alias("pos"))
    m = F.col("n") + F.col("pos")
    name = F.concat(F.when(m % 5 == 0, "googlevideo_").otherwise("px_"), m % 6, F.when(m % 2 == 0, ".mp4").otherwise(".jpg"))
    return s.select(
        "script_id", "section_id", "pos", F.concat(F.lit("media/"), name).alias("path"),
        F.when(m % 2 == 0, "video").otherwise("image").alias("kind"), F.when(m % 3 > 0, F.concat(F.lit("sha"), m % 4)).alias("sha"),
    )


def segment_media(spark: SparkSession, d: str) -> DataFrame:
    """Media of sections with the seconds of clips, some unknown or 0."""
    m = script_media(spark, d)
    k = F.col("script_id") * 7 + F.col("section_id") * 3 + F.col("pos")
    return m.withColumn("seconds", F.when((F.col("kind") == "video") & (k % 9 != 4), k % 7 * 0.5))


def segment_sections(spark: SparkSession, d: str) -> DataFrame:
    return sections(spark, d).select("script_id", "section_id", (F.col("n") % 23 * 1.5).alias("seconds"))


def openings(spark: SparkSession, d: str) -> DataFrame:
    """For every other script the first item of its first section with media."""
    m = script_media(spark, d).filter("script_id % 2 = 0")
    first = m.groupBy("script_id").agg(F.min_by(F.struct("section_id", "path"), F.struct("section_id", "pos", "path")).alias("f"))
    return first.select("script_id", "f.section_id", "f.path")


def quota_cands(spark: SparkSession, d: str) -> DataFrame:
    """Listed items for each section: 4 tiers of 3 results, with ids that come again in a script."""
    s = sections(spark, d).select("script_id", "section_id", "n", F.explode(F.expr("sequence(1, 4)")).alias("tier"))
    s = s.select("*", F.explode(F.expr("sequence(0, 2)")).alias("pos"))
    item = (F.col("n") * 5 + F.col("tier") * 3 + F.col("pos") * 7) % 40
    kind = F.when(item % 2 == 0, "video").otherwise("image")
    query = (1 + (F.col("n") + F.col("pos")) % 4).cast("int")
    return s.select("script_id", "section_id", "tier", query.alias("query"), "pos", item.alias("item"), kind.alias("kind"))


def scripts(spark: SparkSession, d: str) -> DataFrame:
    """Scripts as audits take them: four queries from the words of each narration, research from the first section."""
    s = sections(spark, d)
    w = F.split("narration", " ")
    piece = lambda at: F.array_join(F.slice(w, at, 3), " ")
    return s.select(
        "script_id", "section_id", F.when(F.col("section_id") == 2, "call-to-action").otherwise(F.col("section_type")).alias("section_type"),
        F.when(F.col("n") % 19 == 0, "  ").otherwise(F.col("narration")).alias("narration"),
        piece(1).alias("video_query"), piece(2).alias("video_query_2"),
        F.when(F.col("n") % 5 == 0, "onlytag").otherwise(piece(1)).alias("video_query_3"),
        F.when(F.col("n") % 17 == 0, "").otherwise(piece(3)).alias("video_query_4"),
    )


def research(spark: SparkSession, d: str) -> DataFrame:
    """Research for each script: its topic from the first section, key points from its next words."""
    s = sections(spark, d).filter("section_id = 0")
    w = F.split("narration", " ")
    piece = lambda at, n: F.array_join(F.slice(w, at, n), " ")
    return s.select(
        "script_id",
        F.when(F.col("script_id") % 3 == 0, "shorts").when(F.col("script_id") % 3 == 1, "long").otherwise("other").alias("video_type"),
        F.when(F.col("script_id") % 13 == 0, "").otherwise(piece(1, 5)).alias("topic"),
        piece(3, 6).alias("source_trend"),
        piece(1, 8).alias("video_title"),
        piece(6, 5).alias("hook_question"),
        F.lit("angle").alias("content_angle"),
        F.array(piece(2, 6), piece(9, 6)).alias("key_points"),
        F.when(F.col("script_id") % 5 == 0, F.lit(None)).otherwise(F.concat(F.slice(w, 1, 10), F.array(F.lit("onlytag")))).alias("tags"),
        F.when(F.col("script_id") % 7 == 0, "SPORTS").otherwise("movie").alias("content_domain"),
        F.when(F.col("script_id") % 11 == 0, "POEM").otherwise("recap").alias("content_type"),
    )


def headers(spark: SparkSession, d: str) -> DataFrame:
    """What scripts say of themselves: topics with and without terms, a trend, an unknown domain."""
    k = F.col("script_id")
    return research(spark, d).filter("script_id % 10 <> 9").select(
        "script_id",
        F.when(k % 4 == 0, F.col("topic")).when(k % 4 == 1, "of a").when(k % 4 == 2, "quite another subject").alias("topic"),
        F.when(k % 3 == 0, F.col("hook_question")).alias("source_trend"),
        F.when(k % 6 == 1, "Sports ").alias("content_domain"),
    )


def frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames of media: those of the fingerprints' clips under the ids of pages and of their planted copies."""
    clip = F.col("clip")
    return fp(spark, d).select(F.when(clip < 1_000_000_000, clip).otherwise(clip - 999_000_000).alias("media_id"), "frame", "h")


def used_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """History entries of the fingerprints of every sixth clip, their frames 0 to 8 bits away."""
    flips = (3 * F.col("frame") + F.col("clip") % 5) % 9
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), flips.cast("int")) - 1
    moved = fp(spark, d).filter("clip < 1000000000 and clip % 6 = 1").withColumn("h", F.col("h").bitwiseXOR(mask))
    clips = moved.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("frame", "h"))).alias("x"))
    return clips.select(F.lit("video").alias("media_type"), F.lit("perceptual").alias("key_kind"), H.fingerprint(F.col("x.h")).alias("key_value"))


#: The same tables as SQL; each needs those it names before it.
SQL = {
    "base": """base AS (
  SELECT CAST(doc_id AS VARCHAR) AS video_id, doc_id, array_to_string(list_slice(string_split(text, ' '), 1, 8), ' ') AS title,
         left(text, 600) AS description, source AS channel, lang AS category_id,
         TIMESTAMP '2024-02-01 00:00:00' - to_hours(CAST(doc_id % 120 AS INTEGER)) AS published_at,
         1000 + 37 * n_chars AS views, n_chars % 997 AS likes, doc_id % 89 AS comments, doc_id % 120 AS age
  FROM documents)""",
    "cand": """cand AS (
  SELECT *, floor(least(100, least(45, greatest(0, 10 * log10(greatest(greatest(views, 1) / greatest(age, 0.5), 1))))
         + least(20, (likes + comments) / CAST(greatest(views, 1) AS DOUBLE) * 1000)
         + greatest(0, 20 - greatest(age, 0.5) / CAST(72 AS DOUBLE) * 20)) * 100 + 0.5) / 100 AS trend_score
  FROM (SELECT *, 'A' AS source FROM base UNION ALL SELECT *, 'B' FROM base WHERE doc_id % 3 = 0))""",
    "history": """history AS (
  SELECT item_id, array_to_string(list_slice(string_split(text, ' '), 1, 4), ' ') AS topic FROM benchmark)""",
    "verdicts": """verdicts AS (
  SELECT CASE WHEN doc_id % 97 = 5 THEN 'x' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS candidate_id,
         CASE doc_id % 8 WHEN 1 THEN 'ANIME' WHEN 2 THEN 'POLITICS' ELSE 'movie ' END AS content_domain,
         CASE WHEN doc_id % 8 = 3 THEN '' ELSE source END AS niche_subject,
         CASE WHEN doc_id % 8 = 4 THEN NULL ELSE lang END AS niche_evidence,
         CASE doc_id % 8 WHEN 5 THEN '"true"' WHEN 6 THEN 'false' ELSE 'true' END AS us_movie_relevant,
         CASE WHEN doc_id % 8 = 7 THEN ' ' ELSE 'reason' END AS us_relevance_reason,
         CASE doc_id % 5 WHEN 0 THEN 'recap' WHEN 1 THEN 'POEM' ELSE 'ANALYSIS' END AS content_type
  FROM documents),
verdict_ok AS (
  SELECT *, upper(trim(content_domain)) IN ('MOVIE', 'ANIME') AND trim(niche_subject) <> '' AND coalesce(trim(niche_evidence) <> '', false)
         AND (upper(trim(content_domain)) <> 'MOVIE' OR (us_movie_relevant = 'true' AND trim(us_relevance_reason) <> '')) AS ok
  FROM verdicts)""",
    "sections": """sections AS (
  SELECT conv_id AS script_id, turn AS section_id, role AS section_type, text AS narration, conv_id * 7 + turn * 3 AS n,
         (conv_id * 7 + turn * 3) % 11 * CAST(0.5 AS DOUBLE) AS seconds
  FROM conversations)""",
    "media": """p AS (
  SELECT page_id, url, CASE WHEN page_id % 4 < 2 THEN 'video' ELSE 'image' END AS kind, page_id * 7919 * 1009 % 3000000000 AS size,
         CASE WHEN page_id % 11 <> 0 THEN CAST(page_id * 37 % 12000 AS DOUBLE) END AS duration, sha256(html) AS sha
  FROM pages),
media AS (
  SELECT page_id AS media_id, url, kind, size, duration, sha FROM p
  UNION ALL SELECT page_id + 1000000, regexp_extract(url, '^([a-z]+)://', 1) || '://' || upper(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))
         || regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) || '?ref=x', kind, size, duration, sha FROM p WHERE page_id % 3 = 0
  UNION ALL SELECT page_id + 2000000, 'https://mirror.example.com/p/' || page_id, kind, size, duration, sha FROM p WHERE page_id % 5 = 0
  UNION ALL SELECT page_id + 3000000, 'https://youtu.be/v' || page_id, kind, size, duration, sha256('https://youtu.be/v' || page_id) FROM p WHERE page_id % 7 = 0
  UNION ALL SELECT page_id + 4000000, 'https://www.youtube.com/watch?t=1&v=v' || page_id, kind, size, duration,
         sha256('https://www.youtube.com/watch?t=1&v=v' || page_id) FROM p WHERE page_id % 7 = 0),
canon AS (
  SELECT *, CASE WHEN auth IN ('youtube.com', 'www.youtube.com', 'm.youtube.com') AND regexp_extract(url, '[?&]v=([^&#]+)', 1) <> ''
                 THEN 'youtube:' || regexp_extract(url, '[?&]v=([^&#]+)', 1)
                 WHEN auth = 'youtu.be' THEN 'youtube:' || trim(path, '/')
                 ELSE regexp_extract(url, '^([a-z]+)://', 1) || '://' || auth || path END AS canonical
  FROM (SELECT *, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS auth, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM media))""",
    "media_history": """media_history AS (
  SELECT 'video' AS media_type, 'url' AS key_kind, regexp_extract(url, '^([^?#]*)', 1) AS key_value FROM pages WHERE page_id % 10 = 3
  UNION ALL SELECT 'video', 'hash', sha256(html) FROM pages WHERE page_id % 10 = 7)""",
    "fp": """bits AS (
  SELECT vec_id, sum(CASE WHEN embedding[(i % 64) + 1] > embedding[i] THEN CAST(1 AS HUGEINT) << (i - 1) ELSE 0 END) AS u
  FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY vec_id),
rows_ AS (
  SELECT vec_id, CAST(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END AS BIGINT) AS h, vec_id // 4 AS clip, vec_id % 4 AS frame
  FROM bits),
fp AS (
  SELECT * FROM rows_
  UNION ALL SELECT vec_id + 1000000000, xor(h, (CAST(1 AS BIGINT) << CAST((3 * (vec_id // 20) + vec_id % 4) % 10 AS INTEGER)) - 1), clip + 1000000000, frame
  FROM rows_ WHERE clip % 5 = 0)""",
    "attempts": """attempts AS (
  SELECT 'm' || (user_id % 4) AS model, ts, CASE WHEN event_type = 'error' THEN
         CASE CAST(floor(value) AS INTEGER) % 4 WHEN 0 THEN 'HTTP 401 Unauthenticated' WHEN 1 THEN '503 service unavailable'
              WHEN 2 THEN 'deadline_exceeded' ELSE 'bad schema' END END AS message
  FROM events)""",
    "renditions": """renditions AS (
  SELECT p_partkey AS item, CASE WHEN n % 13 = 0 THEN '' ELSE 'f' || p_partkey || '-' || k END AS link,
         CAST(CASE WHEN n % 7 = 0 THEN 0 ELSE 240 + n % 9 * 240 END AS INTEGER) AS width, CAST(320 + n % 5 * 400 AS INTEGER) AS height,
         CASE WHEN n % 3 = 0 THEN 'HD' ELSE 'sd' END AS quality
  FROM (SELECT p_partkey, k, p_partkey * 31 + k * 17 AS n FROM (SELECT p_partkey, unnest([1, 2, 3, 4]) AS k FROM part)))""",
    "script_media": """script_media AS (
  SELECT script_id, section_id, pos, 'media/' || CASE WHEN m % 5 = 0 THEN 'googlevideo_' ELSE 'px_' END || (m % 6) ||
         CASE WHEN m % 2 = 0 THEN '.mp4' ELSE '.jpg' END AS path, CASE WHEN m % 2 = 0 THEN 'video' ELSE 'image' END AS kind,
         CASE WHEN m % 3 > 0 THEN 'sha' || (m % 4) END AS sha, m % 5 = 0 AS web
  FROM (SELECT script_id, section_id, pos, n + pos AS m FROM (
    SELECT script_id, section_id, n, unnest(range(0, n % 3 + 1)) AS pos FROM sections WHERE n % 4 <> 0)))""",
    "quota_cands": """quota_cands AS (
  SELECT *, CASE WHEN tier = 2 THEN (query + 2) % 4 ELSE query - 1 END AS turn FROM (
    SELECT script_id, section_id, tier, CAST(1 + (n + pos) % 4 AS INTEGER) AS query, pos, (n * 5 + tier * 3 + pos * 7) % 40 AS item
    FROM (SELECT script_id, section_id, n, tier, unnest([0, 1, 2]) AS pos FROM (SELECT script_id, section_id, n, unnest([1, 2, 3, 4]) AS tier FROM sections)))
  WHERE tier <> 1 OR query = 1)""",
    "scripts": """scripts AS (
  SELECT script_id, section_id, CASE WHEN section_id = 2 THEN 'call-to-action' ELSE section_type END AS section_type,
         CASE WHEN n % 19 = 0 THEN '  ' ELSE narration END AS narration,
         array_to_string(w[1:3], ' ') AS video_query, array_to_string(w[2:4], ' ') AS video_query_2,
         CASE WHEN n % 5 = 0 THEN 'onlytag' ELSE array_to_string(w[1:3], ' ') END AS video_query_3,
         CASE WHEN n % 17 = 0 THEN '' ELSE array_to_string(w[3:5], ' ') END AS video_query_4
  FROM (SELECT *, string_split(narration, ' ') AS w FROM sections))""",
    "research": """research AS (
  SELECT script_id, CASE script_id % 3 WHEN 0 THEN 'shorts' WHEN 1 THEN 'long' ELSE 'other' END AS video_type,
         CASE WHEN script_id % 13 = 0 THEN '' ELSE array_to_string(w[1:5], ' ') END AS topic, array_to_string(w[3:8], ' ') AS source_trend,
         array_to_string(w[1:8], ' ') AS video_title, array_to_string(w[6:10], ' ') AS hook_question, 'angle' AS content_angle,
         [array_to_string(w[2:7], ' '), array_to_string(w[9:14], ' ')] AS key_points,
         CASE WHEN script_id % 5 = 0 THEN NULL ELSE list_concat(w[1:10], ['onlytag']) END AS tags,
         CASE WHEN script_id % 7 = 0 THEN 'SPORTS' ELSE 'movie' END AS content_domain,
         CASE WHEN script_id % 11 = 0 THEN 'POEM' ELSE 'recap' END AS content_type
  FROM (SELECT *, string_split(narration, ' ') AS w FROM sections WHERE section_id = 0))""",
}


SQL["headers"] = """headers AS (
  SELECT script_id, CASE script_id % 4 WHEN 0 THEN topic WHEN 1 THEN 'of a' WHEN 2 THEN 'quite another subject' END AS own_topic,
         CASE WHEN script_id % 3 = 0 THEN hook_question END AS own_trend, CASE WHEN script_id % 6 = 1 THEN 'Sports ' END AS own_domain
  FROM research WHERE script_id % 10 <> 9)"""
SQL["segments"] = """segment_items AS (
  SELECT m.script_id, m.section_id, m.pos, m.path, m.kind, s.n % 23 * CAST(1.5 AS DOUBLE) AS target,
         CASE WHEN m.kind = 'video' AND (s.n + m.pos) % 9 <> 4 THEN (s.n + m.pos) % 7 * CAST(0.5 AS DOUBLE) END AS own
  FROM script_media m JOIN sections s USING (script_id, section_id) WHERE s.n % 23 > 0),
firsts AS (
  SELECT script_id, section_id, path AS opening FROM script_media WHERE script_id % 2 = 0
  QUALIFY row_number() OVER (PARTITION BY script_id ORDER BY section_id, pos, path) = 1),
ruled AS (
  SELECT 'even' AS rule, i.*, opening, CASE WHEN opening IS NULL THEN 0.0 ELSE least(3.0, greatest(target, 0.1)) END AS base
  FROM segment_items i LEFT JOIN firsts USING (script_id, section_id)
  QUALIFY opening IS NULL OR path <> opening OR min(CAST(path = opening AS INTEGER)) OVER (PARTITION BY script_id, section_id) = 1
  UNION ALL SELECT 'whole', *, NULL, 0.0 FROM segment_items WHERE kind <> 'image' AND own > 0
  UNION ALL SELECT 'stills', *, NULL, 0.0 FROM segment_items),
numbered AS (
  SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY rule, script_id, section_id) AS n FROM ruled
  WINDOW w AS (PARTITION BY rule, script_id, section_id ORDER BY pos, path)),
stepped AS (
  SELECT *, CAST(CASE rule WHEN 'even' THEN greatest((target - base) / n, 1.5) WHEN 'whole' THEN own ELSE CASE WHEN kind = 'image' THEN 2.5 ELSE greatest(coalesce(own, 0), 0.1) END END AS DOUBLE) AS step,
         CASE rule WHEN 'even' THEN 0.05 WHEN 'whole' THEN 0 ELSE 0.01 END AS rest, CASE rule WHEN 'even' THEN 20 * n + 1 WHEN 'whole' THEN 201 ELSE 1000000 END AS most
  FROM numbered),
turns AS (
  SELECT rule, script_id, section_id, CAST(0 AS BIGINT) AS k, CAST(base AS DOUBLE) AS start FROM stepped WHERE i = 0 AND base < target - rest
  UNION ALL
  SELECT t.rule, t.script_id, t.section_id, k + 1, start + least(step, target - start)
  FROM turns t JOIN stepped s ON t.rule = s.rule AND t.script_id = s.script_id AND t.section_id = s.section_id AND s.i = k % s.n
  WHERE start + least(step, target - start) < target - rest AND k + 1 < most)"""
SQL["used"] = """used AS (
  SELECT clip AS used_clip, frame, xor(h, (CAST(1 AS BIGINT) << CAST((3 * frame + clip % 5) % 9 AS INTEGER)) - 1) AS h
  FROM fp WHERE clip < 1000000000 AND clip % 6 = 1)"""
SQL["frames"] = "frames AS (SELECT CASE WHEN clip < 1000000000 THEN clip ELSE clip - 999000000 END AS media_id, frame, h FROM fp)"


def with_(names: str, query: str) -> str:
    """query with the named derived tables before it."""
    return "WITH " + ",\n".join(SQL[n] for n in names.split()) + "\n" + query
