"""Queries of the scalar functions and of single predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import numbers as N
from ..functions import text as T
from ..functions import urls as U
from ..operators import gates as G
from ..operators import matching
from . import fixtures as X
from . import registry as R
from .registry import query

_j = lambda c: F.array_join(c, ",")
_sorted = lambda c: F.array_join(F.array_sort(c), ",")
KEYWORDS = ("enth", "blest", "therou", "Self-Harm")


@query(
    f"""SELECT doc_id, sha256({R.normal('text')}) AS normal, array_to_string({R.terms('text', C.TOPIC_STOP, 1)}, ',') AS topic_tokens,
       array_to_string({R.terms('text')}, ',') AS topic_terms, array_to_string({R.terms('text', C.QUERY_STOP)}, ',') AS query_terms,
       array_to_string({R.terms('text', C.SUBJECT_STOP)}, ',') AS subject_terms FROM documents"""
)
def text_terms(spark, d):
    normal = X.load(spark, d, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("normal"))
    found = normal.select("doc_id", "normal", F.array_distinct(F.split("normal", " ")).alias("tokens"))
    of = lambda stop, least=3: _sorted(T.terms_of(F.col("tokens"), stop, least))
    return found.select(
        "doc_id",
        F.sha2("normal", 256).alias("normal"),
        of(C.TOPIC_STOP, 1).alias("topic_tokens"),
        of(C.GENERIC_WORDS).alias("topic_terms"),
        of(C.QUERY_STOP).alias("query_terms"),
        of(C.SUBJECT_STOP).alias("subject_terms"),
    )


@query(
    f"""SELECT doc_id, array_to_string({R.anchors('text')}, ',') AS anchors,
       array_to_string(list_sort(list_distinct(list_concat({R.terms('text')}, {R.terms('source')}))), ',') AS both_terms FROM documents"""
)
def text_anchors(spark, d):
    both = T.terms_union(T.topic_terms(F.col("text")), T.topic_terms(F.col("source")))
    return X.load(spark, d, "documents").select("doc_id", _j(T.subject_anchors(F.col("text"))).alias("anchors"), _j(both).alias("both_terms"))


@query(X.with_("base cand", "SELECT video_id, source, CAST(age AS DOUBLE) AS age, trend_score FROM cand"))
def trend_scores(spark, d):
    age = N.age_hours(F.col("published_at"), X.as_of())
    return X.cand(spark, d).select("video_id", "source", age.alias("age"), "trend_score")


@query(
    X.with_(
        "media",
        """SELECT media_id, canonical, split_part(auth, ':', 1) AS host,
       CASE WHEN auth IN ('youtube.com', 'www.youtube.com', 'm.youtube.com', 'youtu.be')
            THEN 'https://i.ytimg.com/vi/' || substr(canonical, 9) || '/hqdefault.jpg' ELSE '' END AS preview,
       CASE WHEN media_id % 3 = 0 THEN 'image' WHEN media_id % 3 = 1 THEN 'video' END AS kind,
       CASE WHEN media_id % 2 = 0 THEN 'web' ELSE 'stock' END AS tier FROM canon""",
    )
)
def media_urls(spark, d):
    m = X.media(spark, d)
    ending = F.when(F.col("media_id") % 3 == 0, ".JPG").when(F.col("media_id") % 3 == 1, ".mp4").otherwise(".txt")
    name = F.concat(F.lit("a/b/"), F.when(F.col("media_id") % 2 == 0, "GoogleVideo_1").otherwise("px_1"), ending)
    url = F.col("url")
    return m.select(
        "media_id",
        U.canonical_url(url).alias("canonical"),
        U.source_host(url).alias("host"),
        U.preview_url(url, F.lit(" ")).alias("preview"),
        U.media_kind(name).alias("kind"),
        U.source_tier(name).alias("tier"),
    )


_MS = "CAST(floor(value * 100000) AS BIGINT)"


@query(
    f"""SELECT event_id, CASE WHEN value - 50 > 0 THEN value - 50 WHEN value > 0 THEN value END AS positive, {R.srt(_MS)} AS stamp,
       {R.srt('floor(value * 100 * 1000 + 0.5)')} AS rounded, {_MS} AS parsed, {R.chapter('CAST(floor(value * 100) AS BIGINT)')} AS chapter,
       greatest(8, user_id / CAST(110 AS DOUBLE) * 60) AS seconds, CAST(greatest(8, floor(user_id / CAST(110 AS DOUBLE) * 60)) AS BIGINT) AS whole,
       {', '.join(f'floor((least(0.3, value * 0.1) + greatest(value - least(0.3, value * 0.1) * 2, 0.1) * {i} / 4) * 1000 + 0.5) / 1000 AS {name}' for i, name in ((1, 'early'), (2, 'middle'), (3, 'late')))},
       event_id / CAST(10000 AS DOUBLE) AS ms, upper(replace(trim(' ' || event_type || '-x'), '-', '_')) AS section_type FROM events"""
)
def number_functions(spark, d):
    v = F.col("value")
    ms = F.floor(v * 100_000)
    return X.load(spark, d, "events").select(
        "event_id",
        N.first_positive((v - 50).cast("string"), v.cast("string")).alias("positive"),
        N.srt_time(ms).alias("stamp"),
        N.srt_time_rounded(v * 100).alias("rounded"),
        N.parse_srt_time(N.srt_time(ms)).alias("parsed"),
        N.chapter_ts(F.floor(v * 100)).alias("chapter"),
        N.estimate_seconds(F.col("user_id")).alias("seconds"),
        N.whole_seconds(F.col("user_id")).alias("whole"),
        *(N.rounded(N.frame_timestamps(v, 3)[i], 3).alias(name) for i, name in enumerate(("early", "middle", "late"))),
        N.ticks_to_ms(F.col("event_id")).alias("ms"),
        N.section_type(F.concat(F.lit(" "), F.col("event_type"), F.lit("-x"))).alias("section_type"),
    )


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id % 5 = 0 AS broken FROM events WHERE event_id % 5 <> 0 UNION ALL SELECT event_id, NULL, true FROM events WHERE event_id % 5 = 0")
def json_objects(spark, d):
    e = X.load(spark, d, "events")
    fenced = F.when(F.col("event_id") % 5 == 0, "no object here").otherwise(F.concat(F.lit("Sure:\n```json\n"), F.col("props"), F.lit("\n``` done")))
    found = F.from_json(T.json_object(fenced), "k long")["k"]
    return e.select("event_id", found.alias("k"), found.isNull().alias("broken"))


@query(
    rf"""SELECT doc_id, array_to_string(list_transform(string_split(text, ' ')[1:8], lambda w: '#' || replace(w, ' ', '')), ' ') AS tags,
       CASE WHEN length(text) > 70 THEN left(text, 70) || '…' ELSE text END AS clipped, CAST(len({R.words('text')}) AS BIGINT) AS n_words,
       CAST(len({R.sentences('text')}) AS BIGINT) AS n_sentences, sha256(array_to_string({R.sentences('text')}, '|')) AS sentences FROM documents"""
)
def string_functions(spark, d):
    t = F.col("text")
    return X.load(spark, d, "documents").select(
        "doc_id",
        T.hashtags(F.split(t, " ")).alias("tags"),
        T.clip_text(t, 70, "…").alias("clipped"),
        T.word_count(t).alias("n_words"),
        F.size(T.split_sentences(t)).cast("long").alias("n_sentences"),
        F.sha2(F.array_join(T.split_sentences(t), "|"), 256).alias("sentences"),
    )


@query(X.with_("fp", "SELECT vec_id, h, CAST(bit_count(xor(h, vec_id)) AS BIGINT) AS bits FROM fp"))
def fingerprint_functions(spark, d):
    return X.fp(spark, d).select("vec_id", "h", N.hamming(F.col("h"), F.col("vec_id")).cast("long").alias("bits"))


_PATTERN = "|".join(sorted({"enth", "blest", "therou", "self harm"}))


@query(
    f"""SELECT doc_id, NOT regexp_matches({R.normal('text')}, '{_PATTERN}') AS inside,
       NOT regexp_matches({R.normal('text')}, '\\b({_PATTERN})\\b') AS whole FROM documents"""
)
def safe_documents(spark, d):
    t = F.col("text")
    return X.load(spark, d, "documents").select("doc_id", G.not_banned(t, KEYWORDS).alias("inside"), G.not_banned(t, KEYWORDS, True).alias("whole"))


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 72 HOUR AND trim(event_type) <> '' AND ts <= TIMESTAMP '2024-01-20 00:00:00'")
def recent_events(spark, d):
    e = X.load(spark, d, "events")
    return e.filter(G.recent(F.col("ts"), "2024-01-20 00:00:00") & G.required(F.col("event_type")) & (F.col("ts") <= F.expr("TIMESTAMP '2024-01-20 00:00:00'"))).select("event_id", "ts")


@query("SELECT page_id, NOT (host = 'spam-farm.example.org' OR host LIKE '%.example.net') AS allowed FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host FROM pages)")
def allowed_domains(spark, d):
    blocked = ("spam-farm.example.org", "example.net", "www.nowhere.org")
    return X.load(spark, d, "pages").select("page_id", U.domain_not_blocked(F.col("url"), blocked).alias("allowed"))


@query(X.with_("media", "SELECT media_id, CASE WHEN duration > 10000 THEN 'duration' WHEN size > 2147483648 THEN 'size' END AS reason FROM media"))
def media_limits(spark, d):
    return X.media(spark, d).select("media_id", G.limit_reason(F.col("duration"), F.col("size")).alias("reason"))


_Q, _T, _M = R.terms("b.text", C.QUERY_STOP), R.terms("b.text"), R.terms("d.text", C.QUERY_STOP)
_PAIRS = f"""WITH q AS MATERIALIZED (SELECT item_id, {_Q} AS q, {_T} AS t FROM benchmark b), m AS MATERIALIZED (SELECT doc_id, {_M} AS m FROM documents d),
x AS (SELECT doc_id, item_id, q, t, len(list_intersect(q, m)) AS qm, len(list_intersect(t, m)) AS tm FROM m, q),
g AS (SELECT * FROM x WHERE CASE WHEN len(q) > 0 THEN qm > 0 AND (len(t) = 0 OR tm >= 1 OR qm >= 2) WHEN len(t) > 0 THEN tm >= 1 ELSE false END)"""


@query(
    _PAIRS + """ SELECT doc_id, item_id, score, score >= 0.3 AS shown FROM (SELECT doc_id, item_id,
    floor(least(1, qm / CAST(greatest(len(q), 1) AS DOUBLE) * 0.7 + tm / CAST(greatest(len(t), 1) AS DOUBLE) * 0.3) * 1000000 + 0.5) / 1000000 AS score FROM g)"""
)
def relevance(spark, d):
    """All pairs of a document and an item that pass the gate, with the stock score and its cutoff; how often pairs meet on shared terms are their overlaps."""
    b = X.load(spark, d, "benchmark").select("item_id", T.query_terms(F.col("text")).alias("q"), T.topic_terms(F.col("text")).alias("t"))
    m = X.load(spark, d, "documents").select("doc_id", T.query_terms(F.col("text")).alias("m"))
    x = matching.scored_pairs(m, b, "doc_id", "item_id", 0.7, 0.3)
    return x.withColumn("shown", F.col("score") >= 0.3)


@query(
    f"""WITH q AS MATERIALIZED (SELECT item_id, {_Q} AS q, {R.terms("array_to_string(list_slice(string_split(text, ' '), 1, 6), ' ')", C.GENERIC_WORDS)} AS t FROM benchmark b), m AS MATERIALIZED (SELECT doc_id, {_M} AS m FROM documents d),
x AS (SELECT doc_id, item_id, q, t, len(list_intersect(q, m)) AS qm, len(list_intersect(t, m)) AS tm FROM m, q),
g AS (SELECT * FROM x WHERE CASE WHEN len(q) > 0 THEN qm > 0 AND (len(t) = 0 OR tm >= 1 OR qm >= 2) WHEN len(t) > 0 THEN tm >= 1 ELSE false END)
SELECT * FROM (SELECT doc_id, item_id, floor(least(1, qm / CAST(greatest(len(q), 1) AS DOUBLE) * 0.6 + tm / CAST(greatest(len(t), 1) AS DOUBLE) * 0.4) * 1000000 + 0.5) / 1000000 AS score FROM g) WHERE score >= 0.4"""
)
def shown_documents(spark, d):
    """The pairs of documents and items at the web score's cutoff of 0.4, each item with a topic of its own; found by their rarer terms."""
    items = X.load(spark, d, "benchmark").withColumn("topic", F.array_join(F.slice(F.split("text", " "), 1, 6), " "))
    return matching.shown_pairs(X.load(spark, d, "documents"), items, "doc_id", "item_id", cutoff=0.4, query_weight=0.6, topic_weight=0.4)


@query(X.with_("verdicts", f"SELECT candidate_id, ok, CASE WHEN upper(trim(content_type)) IN ({', '.join(repr(t) for t in C.CONTENT_TYPES)}) THEN upper(trim(content_type)) ELSE 'EXPLAINER' END AS content_type FROM verdict_ok"))
def verdict_gate(spark, d):
    v = X.verdicts(spark, d)
    ok = G.verdict_ok(*(F.col(c) for c in ("content_domain", "niche_subject", "niche_evidence", "us_movie_relevant", "us_relevance_reason")))
    return v.select("candidate_id", ok.alias("ok"), G.content_type(F.col("content_type")).alias("content_type"))


def _matches(least: int) -> str:
    subject = R.terms("text", C.SUBJECT_STOP)
    return f"""WITH b AS MATERIALIZED (SELECT item_id, {R.terms('text')} AS a, {subject} AS s, {R.anchors('text')} AS anchors FROM benchmark),
dd AS MATERIALIZED (SELECT doc_id, {R.terms('text')} AS t, {subject} AS u FROM documents),
x AS (SELECT doc_id, item_id, len(a) > 0 AND len(t) > 0 AND {R.overlap('a', 't')} >= least({least}, len(a)) AS terms_match,
      len(s) > 0 AND len(u) > 0 AND ({R.overlap('s', 'u')} >= least(2, len(s)) OR {R.overlap('anchors', 'u')} > 0) AS subject_match FROM dd, b)
SELECT * FROM x WHERE terms_match OR subject_match"""


@query(_matches(1))
def term_matches(spark, d):
    """All pairs of a document and an item of which the terms or the subject match, by one shared term."""
    return matching.matching_pairs(X.load(spark, d, "documents"), X.load(spark, d, "benchmark"), "doc_id", "item_id", least=1)


@query(
    f"""WITH q AS MATERIALIZED (SELECT item_id, {_Q} AS q FROM benchmark b), m AS MATERIALIZED (SELECT doc_id, {_M} AS m FROM documents d)
SELECT doc_id, item_id, floor(least(1, k / CAST(n AS DOUBLE) * 0.6 + k / CAST(n AS DOUBLE) * 0.4) * 1000000 + 0.5) / 1000000 AS score
FROM (SELECT doc_id, item_id, len(q) AS n, len(list_intersect(q, m)) AS k FROM m, q) WHERE k > 0"""
)
def relevant_documents(spark, d):
    """All relevant pairs of documents and benchmark items by the web score."""
    return matching.relevant_pairs(X.load(spark, d, "documents"), X.load(spark, d, "benchmark"), "doc_id", "item_id")


@query(_matches(2))
def matched_documents(spark, d):
    """All matching pairs of documents and benchmark items, by two shared terms."""
    return matching.matching_pairs(X.load(spark, d, "documents"), X.load(spark, d, "benchmark"), "doc_id", "item_id")


_CELL = "embedding[({r} * 9 + {c}) % 64 + 1]"
_GRID = " + ".join(
    f"CASE WHEN {_CELL.format(r=r, c=c + 1)} > {_CELL.format(r=r, c=c)} THEN CAST({1 << (63 - 8 * r - c)} AS HUGEINT) ELSE 0 END" for r in range(8) for c in range(8)
)


@query(f"SELECT vec_id, CAST(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END AS BIGINT) AS h FROM (SELECT vec_id, {_GRID} AS u FROM embeddings)")
def grid_hashes(spark, d):
    """The difference hash of an 8 x 9 grid, read from each embedding and again from its start."""
    grid = F.concat("embedding", F.slice("embedding", 1, 8))
    return X.load(spark, d, "embeddings").select("vec_id", N.grid_hash(grid).alias("h"))


def _chunk_sql() -> str:
    """Sentence after sentence: the words before it in its chunk decide whether a new chunk begins."""
    return rf"""WITH RECURSIVE s AS (
  SELECT doc_id, unnest({R.sentences('text')}) AS s, generate_subscripts({R.sentences('text')}, 1) AS i FROM documents),
w AS (SELECT doc_id, i, s, len({R.words('s')}) AS n FROM s),
fold AS (
  SELECT doc_id, i, n, s, CASE WHEN n > 80 THEN (n + 79) // 80 ELSE 1 END AS chunk, CASE WHEN n > 80 THEN 0 ELSE n END AS open FROM w WHERE i = 1
  UNION ALL
  SELECT w.doc_id, w.i, w.n, w.s,
         CASE WHEN w.n > 80 THEN f.chunk + (w.n + 79) // 80 WHEN f.open > 0 AND f.open + w.n <= 80 THEN f.chunk ELSE f.chunk + 1 END,
         CASE WHEN w.n > 80 THEN 0 WHEN f.open > 0 AND f.open + w.n <= 80 THEN f.open + w.n ELSE w.n END
  FROM fold f JOIN w ON w.doc_id = f.doc_id AND w.i = f.i + 1)
SELECT doc_id, CAST(max(chunk) AS BIGINT) AS n_chunks, CAST(sum(n) AS BIGINT) AS n_words FROM fold GROUP BY doc_id"""


@query(_chunk_sql())
def text_chunks(spark, d):
    """Chunks of 80 words of every document."""
    c = X.load(spark, d, "documents").select("doc_id", T.chunk_text(F.col("text"), 80).alias("chunks"))
    n = F.aggregate("chunks", F.lit(0).cast("long"), lambda acc, x: acc + T.word_count(x))
    return c.filter(F.size("chunks") > 0).select("doc_id", F.size("chunks").cast("long").alias("n_chunks"), n.alias("n_words"))
