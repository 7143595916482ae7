"""Queries of the joins, audits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from ..functions import urls as U
from ..operators import audit as A
from ..operators import captions as K
from ..operators import fingerprints as H
from ..operators import gates as G
from ..operators import media as M
from ..operators import similarity as S
from ..sources.folders import shared_folder
from . import fixtures as X
from . import pipelines as E
from . import registry as R
from .registry import query

_TOK = lambda x: R.terms(x, C.TOPIC_STOP, 1)
_SIMILAR = f"""c AS (SELECT DISTINCT video_id, {_TOK('title')} AS a FROM base), h AS (SELECT item_id, {_TOK('topic')} AS b FROM history),
pairs AS (SELECT video_id, item_id FROM c JOIN h ON len(a) > 0 AND len(b) > 0 AND len(list_intersect(a, b)) >= least(2, len(a), len(b)))"""


def _cands(spark, d):
    return X.cand(spark, d, scored=False).filter("source = 'A'")


@query(X.with_("base history", f", {_SIMILAR} SELECT DISTINCT video_id AS left_id, item_id AS right_id FROM pairs").replace("\n,", ","))
def similar_topics(spark, d):
    return S.similar_pairs(_cands(spark, d), X.history(spark, d), "video_id", "title", "item_id", "topic")


@query(X.with_("base history", f", {_SIMILAR} SELECT video_id, title FROM base WHERE video_id NOT IN (SELECT video_id FROM pairs)").replace("\n,", ","))
def unused_topics(spark, d):
    return S.anti_similar(_cands(spark, d), X.history(spark, d), "video_id", "title", "item_id", "topic").select("video_id", "title")


@query(X.with_("base history", f", {_SIMILAR} SELECT video_id, title FROM base WHERE video_id IN (SELECT video_id FROM pairs)").replace("\n,", ","))
def used_topics(spark, d):
    return S.semi_similar(_cands(spark, d), X.history(spark, d), "video_id", "title", "item_id", "topic").select("video_id", "title")


@query(X.with_("history", f"""c AS (SELECT doc_id, {_TOK('text')} AS a FROM documents), h AS (SELECT item_id, {_TOK('topic')} AS b FROM history)
SELECT DISTINCT doc_id AS left_id, item_id AS right_id FROM c JOIN h ON len(a) > 0 AND len(b) > 0 AND len(list_intersect(a, b)) >= least(2, len(a), len(b))""").replace("FROM benchmark)\nc AS", "FROM benchmark),\nc AS"))  # fmt: skip
def similar_texts(spark, d):
    """Whole texts similar to used topics, with as many keys as a text has tokens."""
    return S.similar_long_pairs(X.load(spark, d, "documents"), X.history(spark, d), "doc_id", "text", "item_id", "topic")


@query(X.with_("media media_history", """SELECT media_id, 'url' AS kind FROM canon WHERE canonical NOT IN (SELECT key_value FROM media_history WHERE key_kind = 'url')
UNION ALL SELECT media_id, 'hash' FROM media WHERE sha NOT IN (SELECT key_value FROM media_history WHERE key_kind = 'hash')"""))  # fmt: skip
def unused_media(spark, d):
    m, h = X.media(spark, d), X.media_history(spark, d)
    by_url = M.anti_used(m, h, U.canonical_url(F.col("url")), "url").select("media_id", F.lit("url").alias("kind"))
    return by_url.union(M.anti_used(m, h, F.col("sha"), "hash").select("media_id", F.lit("hash").alias("kind")))


@query(X.with_("fp", """, least_ AS (SELECT h, min(vec_id) AS id FROM fp GROUP BY h)
SELECT least(a.id, b.id) AS a_id, greatest(a.id, b.id) AS b_id, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance
FROM least_ a JOIN least_ b ON a.h < b.h AND bit_count(xor(a.h, b.h)) <= 6""").replace("\n,", ","))  # fmt: skip
def near_fingerprints(spark, d):
    return H.near_dup_pairs(X.fp(spark, d))


@query(X.with_("fp", """, hit AS (SELECT DISTINCT a.clip, a.frame, b.clip AS b_clip FROM fp a JOIN fp b ON a.clip <> b.clip AND bit_count(xor(a.h, b.h)) <= 6),
n AS (SELECT clip, count(DISTINCT frame) AS n FROM fp GROUP BY clip)
SELECT clip AS a_clip, b_clip, count(*) / CAST(any_value(n) AS DOUBLE) AS share FROM hit JOIN n USING (clip) GROUP BY clip, b_clip HAVING count(*) / CAST(any_value(n) AS DOUBLE) >= 0.5""").replace("\n,", ","))  # fmt: skip
def near_clips(spark, d):
    return H.near_dup_clips(X.fp(spark, d))


@query(X.with_("fp used", """, hit AS (SELECT DISTINCT a.clip, a.frame, b.used_clip FROM fp a JOIN used b ON bit_count(xor(a.h, b.h)) <= 6),
n AS (SELECT clip, count(DISTINCT frame) AS n FROM fp GROUP BY clip),
named AS (SELECT used_clip, string_agg(lpad(lower(to_hex(h)), 16, '0'), ',' ORDER BY frame) AS used FROM used GROUP BY used_clip)
SELECT DISTINCT clip AS a_clip, used, share FROM (SELECT clip, used_clip, count(*) / CAST(any_value(n) AS DOUBLE) AS share FROM hit JOIN n USING (clip) GROUP BY clip, used_clip) JOIN named USING (used_clip)
WHERE share >= 0.5""").replace("\n,", ","))  # fmt: skip
def near_used_clips(spark, d):
    """Clips near to a stored fingerprint, by the stored index."""
    index = shared_folder(spark, "fingerprints")
    H.index_fingerprints(H.stored_frames(X.used_fingerprints(spark, d)), index)
    return H.near_stored_clips(X.fp(spark, d), index)


@query(X.with_("base verdicts", """SELECT video_id, content_domain, false AS unknown FROM base JOIN verdicts ON video_id = candidate_id
UNION ALL SELECT candidate_id, content_domain, true FROM verdicts WHERE candidate_id NOT IN (SELECT video_id FROM base)"""))  # fmt: skip
def joined_verdicts(spark, d):
    met, unknown = G.join_verdict(_cands(spark, d), X.verdicts(spark, d))
    met = met.select("video_id", "content_domain", F.lit(False).alias("unknown"))
    return met.union(unknown.select("candidate_id", "content_domain", F.lit(True)))


def _timeline(spark, d):
    return K.timeline(X.timed_sections(spark, d), "script_id", "section_id", "seconds")


def _cues(spark, d):
    """One cue for each section, shifted and lengthened so that it crosses into the next."""
    t = _timeline(spark, d)
    return t.select("script_id", (F.col("start") + 0.25).alias("start"), (F.col("start") + F.col("duration") + 0.75).alias("end"), F.concat(F.lit(" cue "), "section_id").alias("text"))


_LINE = """, t AS (SELECT script_id, section_id, CASE WHEN seconds > 0 THEN seconds ELSE 1 END AS duration FROM sections),
line AS (SELECT *, coalesce(sum(duration) OVER (PARTITION BY script_id ORDER BY section_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM t),
cues AS (SELECT script_id, start + 0.25 AS start, start + duration + 0.75 AS "end", 'cue ' || section_id AS text FROM line),
points AS (SELECT script_id, section_id * 1.5 - 0.5 AS at FROM sections)"""


@query(X.with_("sections", _LINE + """
SELECT c.script_id, section_id, row_number() OVER (PARTITION BY c.script_id, section_id ORDER BY c.start, c."end", c.text) AS number,
       greatest(0, c.start - l.start) AS local_start, least(duration, c."end" - l.start) AS local_end, c.text
FROM cues c JOIN line l ON c.script_id = l.script_id AND c."end" > l.start AND c.start < l.start + duration""").replace("\n,", ","))  # fmt: skip
def clipped_cues(spark, d):
    return K.clip_cues(_cues(spark, d), _timeline(spark, d), "script_id")


def _points(spark, d):
    return X.sections(spark, d).select("script_id", (F.col("section_id") * 1.5 - 0.5).alias("at"))


@query(X.with_("sections", _LINE + """
SELECT p.script_id, p.at, coalesce(arg_min(' ' || c.text, c.start), '') AS caption FROM points p
LEFT JOIN cues c ON c.script_id = p.script_id AND c.start <= p.at AND p.at < c."end" GROUP BY ALL""").replace("\n,", ","))  # fmt: skip
def captions_at(spark, d):
    return K.caption_at(_points(spark, d), _cues(spark, d), "script_id", "at")


@query(X.with_("sections", _LINE + """
SELECT p.script_id, p.at, coalesce(arg_min(l.section_id, l.start), any_value(last)) AS section_id FROM points p
LEFT JOIN line l ON l.script_id = p.script_id AND l.start <= p.at AND p.at < l.start + l.duration
JOIN (SELECT script_id, max(section_id) AS last FROM line GROUP BY 1) x ON x.script_id = p.script_id GROUP BY ALL""").replace("\n,", ","))  # fmt: skip
def sections_at(spark, d):
    return K.section_at(_points(spark, d), _timeline(spark, d), "script_id", "at")


@query(X.with_("sections research", f"""SELECT script_id, array_to_string(anchors, ',') AS anchors,
array_to_string(list_filter([CASE WHEN {R.blank("coalesce(nullif(source_trend, ''), topic)")} THEN 'no source' END,
  CASE WHEN upper(trim(content_domain)) NOT IN ('MOVIE', 'ANIME') THEN 'domain' END,
  CASE WHEN NOT list_contains({R.listed(C.CONTENT_TYPES)}, upper(trim(content_type))) THEN 'content type' END,
  CASE WHEN {R.blank('topic')} OR NOT (len(anchors) > 0 AND len({R.terms('topic')}) > 0 AND {R.overlap('anchors', R.terms('topic'))} >= 1) THEN 'topic drifted' END],
  lambda v: v IS NOT NULL), ',') AS violations
FROM (SELECT *, list_sort(list_distinct(list_concat({R.terms('source_trend')}, {R.terms('hook_question')}, {R.terms('content_angle')}, {R.terms('topic')},
      {R.terms("array_to_string(key_points, ' ')")}))) AS anchors FROM research)"""))  # fmt: skip
def audited_research(spark, d):
    j = lambda c: F.array_join(c, ",").alias(c)
    return A.audit_research(X.research(spark, d)).select("script_id", j("anchors"), j("violations"))


_FIELDS = ("topic", "source_trend", "video_title", "hook_question", "content_angle", "content_domain", "content_type")


@query(X.with_("sections research", f"""SELECT script_id, array_to_string(list_filter([{', '.join(f"CASE WHEN {R.blank(c)} THEN '{c}' END" for c in _FIELDS)},
CASE WHEN key_points IS NULL OR len(key_points) = 0 THEN 'key_points' END, CASE WHEN tags IS NULL THEN 'tags' END], lambda v: v IS NOT NULL), ',') AS violations FROM research"""))  # fmt: skip
def valid_research(spark, d):
    return X.research(spark, d).select("script_id", F.array_join(A.research_violations(_FIELDS), ",").alias("violations"))


@query(X.with_("sections research", f"""SELECT script_id, array_to_string(anchors, ',') AS anchors, array_to_string(list_filter([
CASE WHEN {R.blank('video_title')} THEN 'no trend' END,
CASE WHEN {R.blank('source')} OR NOT {R.match('video_title', 'source', 'anchors')} THEN 'source drifted' END,
CASE WHEN {R.blank('topic')} OR NOT {R.match('video_title', 'topic', 'anchors')} THEN 'topic drifted' END], lambda v: v IS NOT NULL), ',') AS violations
FROM (SELECT *, coalesce(nullif(source_trend, ''), video_title) AS source,
      list_sort(list_distinct(list_concat({R.anchors('video_title')}, {R.anchors('hook_question')}, {R.anchors('content_angle')}))) AS anchors FROM research)"""))  # fmt: skip
def topic_drift(spark, d):
    r = X.research(spark, d).withColumnRenamed("video_title", "selected_trend")
    j = lambda c: F.array_join(c, ",").alias(c)
    return A.audit_topic_drift(r, ("hook_question", "content_angle")).select("script_id", j("anchors"), j("violations"))


@query(X.with_("sections research", "SELECT script_id, content_domain, CASE WHEN script_id % 2 = 0 THEN 'movie' ELSE 'ANIME' END AS trend_domain FROM research WHERE content_domain <> CASE WHEN script_id % 2 = 0 THEN 'movie' ELSE 'ANIME' END"))
def drifted_domains(spark, d):
    r = X.research(spark, d).select("script_id", "content_domain")
    trends = r.select("script_id", F.when(F.col("script_id") % 2 == 0, "movie").otherwise("ANIME").alias("content_domain"))
    return A.domain_drift(r, trends, "script_id")


_AN = R.terms("narration")
_QS = [(q, R.terms(q)) for q in A.QUERIES]
_CHECKS = ", ".join(
    [
        f"CASE WHEN {R.blank('narration')} THEN 'narration empty' END",
        "CASE WHEN NOT blank_ AND NOT anchored_ AND NOT list_contains(['CTA', 'CALL_TO_ACTION'], kind) THEN 'narration drifted' END",
        *(f"CASE WHEN {R.blank(q)} THEN '{q} missing' END, CASE WHEN NOT {R.blank(q)} AND NOT {R.overlap('anchors', t)} > 0 THEN '{q} drifted' END" for q, t in _QS),
    ]
)


_AUDITED = f""", a AS (SELECT script_id, video_type, coalesce(nullif(own_trend, ''), nullif(own_topic, ''), nullif(source_trend, ''), topic, '') AS source,
  upper(trim(coalesce(nullif(own_domain, ''), content_domain, ''))) AS domain, own_topic,
  list_filter(list_sort(list_distinct(list_concat({', '.join(R.terms(c) for c in (*_FIELDS[:5], 'own_topic', 'own_trend'))},
  {R.terms("array_to_string(key_points, ' ')")}, {R.terms("array_to_string(tags, ' ')")}))), lambda t: NOT list_contains({R.terms("'" + A.SCHEMA_WORDS + "'")}, t)) AS anchors
  FROM research LEFT JOIN headers USING (script_id)),
s AS (SELECT *, {R.blank('narration')} AS blank_, upper(replace(trim(section_type), '-', '_')) AS kind, len(anchors) > 0 AND {R.overlap('anchors', _AN)} > 0 AS anchored_
      FROM scripts JOIN a USING (script_id)),
f AS (SELECT *, list_filter([{_CHECKS}], lambda v: v IS NOT NULL) AS found FROM s),
g AS (SELECT script_id, any_value(source) AS source, any_value(domain) AS domain, any_value(own_topic) AS own_topic, any_value(anchors) AS anchors, any_value(video_type) AS t, any_value(len(anchors)) AS n_anchors, count(*) AS n_sections, count_if(anchored_ AND NOT blank_) AS n_anchored,
      list_distinct(flatten(list(found))) AS found FROM f GROUP BY script_id)
SELECT script_id, n_sections, CAST(n_anchored AS BIGINT) AS n_anchored, array_to_string(list_sort(list_concat(found, list_filter([
  CASE WHEN {R.blank('source')} THEN 'no source' END, CASE WHEN domain <> '' AND domain NOT IN ('MOVIE', 'ANIME') THEN 'domain' END,
  CASE WHEN coalesce(own_topic, '') <> '' AND NOT (len(anchors) > 0 AND {R.overlap('anchors', R.terms('own_topic'))} > 0) THEN 'topic drifted' END,
  CASE WHEN n_sections <> CASE t WHEN 'shorts' THEN 3 WHEN 'long' THEN 9 ELSE n_sections END THEN 'section count' END,
  CASE WHEN n_anchors < 2 THEN 'weak context' END, CASE WHEN n_anchored < CASE t WHEN 'shorts' THEN 2 WHEN 'long' THEN 4 ELSE 1 END THEN 'too few anchored' END],
  lambda v: v IS NOT NULL))), ',') AS violations FROM g"""


@query(X.with_("sections scripts research headers", _AUDITED).replace("\n,", ","))
def audited_scripts(spark, d):
    return A.audit_scripts(X.scripts(spark, d), X.research(spark, d), X.headers(spark, d)).withColumn("violations", F.array_join("violations", ","))


@query(X.with_("sections script_media", """, pool AS (SELECT script_id, path, kind, row_number() OVER (PARTITION BY script_id ORDER BY section_id, pos, path) - 1 AS slot,
  count(*) OVER (PARTITION BY script_id) AS n FROM script_media WHERE kind = 'image'),
empty_ AS (SELECT script_id, section_id, row_number() OVER (PARTITION BY script_id ORDER BY section_id) - 1 AS k FROM sections s
  WHERE NOT EXISTS (SELECT 1 FROM script_media m WHERE m.script_id = s.script_id AND m.section_id = s.section_id))
SELECT e.script_id, e.section_id, p.path, p.kind FROM empty_ e JOIN pool p ON p.script_id = e.script_id AND p.slot = e.k % p.n""").replace("\n,", ","))  # fmt: skip
def filled_sections(spark, d):
    return M.fill_from_pool(X.script_media(spark, d), X.sections(spark, d))


@query(f"""WITH t AS (SELECT doc_id, {R.terms('text')} AS a, {R.terms('text', C.SUBJECT_STOP)} AS b FROM documents)
SELECT doc_id, array_to_string(list_sort(list_intersect(a, b)), ',') AS common, array_to_string(list_filter(b, lambda x: NOT list_contains(a, x)), ',') AS lost,
       array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS all_terms FROM t""")  # fmt: skip
def term_sets(spark, d):
    """Intersection, difference and union of two term sets of each document."""
    t = X.load(spark, d, "documents").select("doc_id", T.topic_terms(F.col("text")).alias("a"), T.subject_terms(F.col("text")).alias("b"))
    s = lambda c: F.array_join(F.array_sort(c), ",")
    return t.select("doc_id", s(F.array_intersect("a", "b")).alias("common"), s(F.array_except("b", "a")).alias("lost"), s(F.array_union("a", "b")).alias("all_terms"))


@query("""SELECT 'intersect' AS op, source FROM (SELECT source FROM documents WHERE lang = 'en' INTERSECT SELECT source FROM documents WHERE lang = 'de')
UNION ALL SELECT 'except', lang FROM (SELECT lang FROM documents EXCEPT ALL (SELECT lang FROM documents JOIN labels USING (doc_id)))
UNION ALL SELECT 'union', source FROM (SELECT source FROM documents UNION SELECT role FROM conversations)""")  # fmt: skip
def row_sets(spark, d):
    """Intersect, except all and union of rows."""
    docs, labels = X.load(spark, d, "documents"), X.load(spark, d, "labels").select("doc_id")
    of = lambda lang: docs.filter(F.col("lang") == lang).select("source")
    rest = docs.select("lang").exceptAll(docs.join(labels, "doc_id").select("lang"))
    both = docs.select("source").union(X.load(spark, d, "conversations").select("role")).distinct()
    named = lambda op, df: df.select(F.lit(op).alias("op"), F.col(df.columns[0]).alias("source"))
    return named("intersect", of("en").intersect(of("de"))).union(named("except", rest)).union(named("union", both))


def _marked(query_name: str, name: str) -> str:
    """The violations that a query lists, one a row, with the audit's name before each."""
    return f"SELECT script_id, '{name}: ' || unnest(string_split(violations, ',')) AS v FROM ({R.ORACLES[query_name]}) WHERE violations <> ''"


@query(f"""WITH v AS ({_marked('valid_research', 'research')} UNION ALL {_marked('audited_research', 'lock')} UNION ALL {_marked('topic_drift', 'drift')}
UNION ALL {_marked('audited_scripts', 'script')} UNION ALL SELECT script_id, 'domain drift' FROM ({R.ORACLES['drifted_domains']}))
SELECT DISTINCT r.script_id, coalesce(string_agg(v, ',' ORDER BY v), '') AS violations FROM (SELECT conv_id AS script_id FROM conversations WHERE turn = 0) r LEFT JOIN v USING (script_id) GROUP BY r.script_id""")  # fmt: skip
def audited_pipelines(spark, d):
    """All audits of each script together."""
    r = X.research(spark, d).withColumn("selected_trend", F.col("video_title"))
    trends = r.select("script_id", F.when(F.col("script_id") % 2 == 0, "movie").otherwise("ANIME").alias("content_domain"))
    found = E.audit_all(X.scripts(spark, d), r, trends, X.headers(spark, d))
    return found.select("script_id", F.array_join("violations", ",").alias("violations"))
