"""Queries of aggregations, windows, captions and allocation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit as A
from ..operators import captions as K
from ..operators import media as M
from ..operators import ranking as P
from ..operators import scripts as S
from . import fixtures as X
from . import registry as R
from .registry import query


@query(X.with_("base cand", "SELECT video_id, source, trend_score FROM cand QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY trend_score DESC, source) = 1"))
def deduped_candidates(spark, d):
    return P.dedupe_best(X.cand(spark, d)).select("video_id", "source", "trend_score")


@query(X.with_("base cand", "SELECT source, count(*) AS n_rows FROM cand GROUP BY source"))
def source_totals(spark, d):
    return P.source_counts(X.cand(spark, d, scored=False))


@query(X.with_("sections", f"SELECT script_id, count(*) AS n_sections, CAST(sum(len({R.words('narration')})) AS BIGINT) AS n_words, CAST(max(len({R.words('narration')})) AS BIGINT) AS most_words FROM sections GROUP BY script_id"))
def script_stats(spark, d):
    return S.section_stats(X.sections(spark, d), "script_id", "narration")


@query(X.with_("sections script_media", """SELECT script_id, section_id, count(*) FILTER (kind = 'video') AS n_video, count(*) FILTER (kind = 'image') AS n_image, count(kind) < 2 AS short
FROM (SELECT script_id, section_id FROM sections) LEFT JOIN script_media USING (script_id, section_id) GROUP BY script_id, section_id"""))  # fmt: skip
def section_media(spark, d):
    return M.media_stats(X.script_media(spark, d), X.sections(spark, d), 2)


@query("SELECT event_type AS stage, count(*) AS n_runs, floor(sum(CAST(round(value * 100) AS BIGINT)) / CAST(100 AS DOUBLE) * 100 + 0.5) / 100 AS seconds FROM events GROUP BY ROLLUP (event_type)")
def stage_seconds(spark, d):
    e = X.load(spark, d, "events").select(F.col("event_type").alias("stage"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    total = P.stage_timings(e, "stage", "cents")
    return total.withColumn("seconds", F.floor(F.col("seconds") / 100.0 * 100 + 0.5) / 100)


@query(X.with_("attempts", """, k AS (SELECT *, CASE WHEN message LIKE '%401%' THEN 'auth' WHEN upper(message) LIKE '%503%' OR upper(message) LIKE '%DEADLINE_EXCEEDED%' THEN 'transient'
  WHEN message IS NOT NULL THEN 'fatal' END AS kind FROM attempts)
SELECT model, count(*) AS attempts, count(kind) AS failures, count_if(kind = 'auth') AS n_auth, count_if(kind = 'transient') AS n_transient, count_if(kind = 'fatal') AS n_fatal,
       arg_max(kind, ts) FILTER (kind IS NOT NULL) AS last_kind FROM k GROUP BY model""").replace("\n,", ","))  # fmt: skip
def model_statuses(spark, d):
    return P.model_status(X.attempts(spark, d))


@query(X.with_("sections scripts research headers script_media", """, b AS (SELECT script_id, section_id, concat_ws(chr(10), '  Section ' || section_id || ': ' || coalesce(narration, ''),
  CASE WHEN trim(video_query) <> '' THEN '    video_query: ' || video_query END, CASE WHEN trim(video_query_2) <> '' THEN '    video_query_2: ' || video_query_2 END,
  CASE WHEN trim(video_query_3) <> '' THEN '    video_query_3: ' || video_query_3 END, CASE WHEN trim(video_query_4) <> '' THEN '    video_query_4: ' || video_query_4 END) AS b FROM scripts)
SELECT script_id, concat_ws(chr(10), 'SELECTED SUBJECT', '  ' || coalesce(nullif(any_value(r.source_trend), ''), any_value(r.topic)), 'DOMAIN', '  ' || any_value(r.content_domain),
  'CONTENT TYPE', '  ' || any_value(r.content_type), 'RESEARCH TOPIC', '  ' || any_value(r.topic), 'SCRIPT TOPIC', '  ' || coalesce(any_value(own_topic), 'None'),
  string_agg(b || chr(10) || '    downloaded: [' || coalesce(files, '') || ']', chr(10) ORDER BY section_id)) AS trace
FROM b JOIN research r USING (script_id) LEFT JOIN headers USING (script_id)
LEFT JOIN (SELECT script_id, section_id, string_agg('''' || path || '''', ', ' ORDER BY pos, path) AS files FROM script_media GROUP BY ALL) USING (script_id, section_id) GROUP BY script_id""").replace("\n,", ","))  # fmt: skip
def topic_traces(spark, d):
    r = X.research(spark, d).withColumn("subject", F.coalesce(F.nullif(F.col("source_trend"), F.lit("")), F.col("topic")))
    own = X.headers(spark, d).select("script_id", F.col("topic").alias("script_topic"))
    return A.topic_trace(X.scripts(spark, d), r.join(own, "script_id", "left"), X.script_media(spark, d))


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY first_id, event_type) AS types FROM (SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY ALL) GROUP BY user_id")
def ordered_types(spark, d):
    found = P.distinct_in_order(X.load(spark, d, "events"), "user_id", "event_id", "event_type")
    return found.select("user_id", F.array_join("values", ",").alias("types"))


@query(X.with_("renditions", """SELECT item, link, width, height FROM renditions WHERE link <> '' AND width > 0 AND height > 0
QUALIFY row_number() OVER (PARTITION BY item ORDER BY width * height >= 2073600 * 0.55 DESC, lower(quality) = 'hd' DESC,
  greatest(0, width * height / CAST(2073600 AS DOUBLE) - 1.25), abs(width * height - 2073600), link) = 1"""))  # fmt: skip
def best_files(spark, d):
    return M.select_best_file(X.renditions(spark, d), "item").select("item", "link", "width", "height")


@query(X.with_("renditions", """SELECT item, link, width, height FROM (SELECT *, CASE WHEN height >= width THEN 2073600 ELSE 921600 END AS target FROM renditions)
WHERE link <> '' AND width > 0 AND height > 0
QUALIFY row_number() OVER (PARTITION BY item ORDER BY width * height >= target * 0.55 DESC, lower(quality) = 'hd' DESC,
  greatest(0, width * height / CAST(target AS DOUBLE) - 1.25), abs(width * height - target), link) = 1"""))  # fmt: skip
def oriented_files(spark, d):
    """Best files where landscape ones have a smaller target."""
    return M.select_best_file(X.renditions(spark, d), "item", landscape=1280 * 720).select("item", "link", "width", "height")


@query(X.with_("sections script_media", """, f AS (SELECT *, section_id = min(section_id) OVER (PARTITION BY script_id) AS here FROM script_media),
p AS (SELECT *, CASE WHEN web AND kind = 'video' THEN 1 WHEN web THEN 2 WHEN here AND kind = 'video' THEN 3 WHEN here THEN 4 ELSE 5 END AS priority FROM f)
SELECT script_id, path, priority FROM p QUALIFY row_number() OVER (PARTITION BY script_id ORDER BY priority, section_id, pos, path) = 1""").replace("\n,", ","))  # fmt: skip
def opening_assets(spark, d):
    return M.opening_asset(X.script_media(spark, d))


@query(X.with_("base cand", """, u AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY trend_score DESC, source) = 1)
SELECT video_id, trend_score, views, row_number() OVER (ORDER BY trend_score DESC, views DESC, video_id) AS rank FROM u QUALIFY rank <= 120""").replace("\n,", ","))  # fmt: skip
def ranked_trends(spark, d):
    return P.top_trends(P.dedupe_best(X.cand(spark, d))).select("video_id", "trend_score", "views", F.col("rank").cast("long").alias("rank"))


@query("SELECT event_id, CAST(ceil(row_number() OVER (PARTITION BY user_id ORDER BY event_id) / 5.0) AS BIGINT) AS window FROM events".replace("AS window", 'AS "window"'))
def result_windows(spark, d):
    return P.candidate_windows(X.load(spark, d, "events"), ["user_id"], "event_id", 5).select("event_id", "window")


_FIRST = """, first_ AS (SELECT * FROM quota_cands QUALIFY row_number() OVER (PARTITION BY script_id, item ORDER BY section_id, tier, turn, pos) = 1)
SELECT script_id, section_id, tier, pos, item, row_number() OVER (PARTITION BY script_id, section_id ORDER BY tier, turn, pos, item) AS place FROM first_ QUALIFY place <= 4"""


@query(X.with_("sections quota_cands", _FIRST).replace("\n,", ","))
def quotas(spark, d):
    q = M.quota_first_n(X.quota_cands(spark, d), 4)
    return q.select("script_id", "section_id", "tier", "pos", "item", F.col("place").cast("long").alias("place"))


_EXACT = """, o AS (SELECT script_id, section_id, item, row_number() OVER (PARTITION BY script_id, section_id ORDER BY tier, turn, pos, item) AS turn_
  FROM quota_cands QUALIFY row_number() OVER (PARTITION BY script_id, section_id, item ORDER BY tier, turn, pos) = 1),
l AS (SELECT script_id, section_id, list(item ORDER BY turn_) AS items, row_number() OVER (PARTITION BY script_id ORDER BY section_id) AS i FROM o GROUP BY script_id, section_id),
fold AS (SELECT script_id, section_id, i, items[1:4] AS taken, items[1:4] AS used FROM l WHERE i = 1
  UNION ALL SELECT l.script_id, l.section_id, l.i, list_filter(l.items, lambda x: NOT list_contains(f.used, x))[1:4],
    list_concat(f.used, list_filter(l.items, lambda x: NOT list_contains(f.used, x))[1:4]) FROM fold f JOIN l ON l.script_id = f.script_id AND l.i = f.i + 1)
SELECT script_id, section_id, unnest(taken) AS item, CAST(generate_subscripts(taken, 1) AS INTEGER) AS place FROM fold"""


@query(X.with_("sections quota_cands", _EXACT).replace("\n,", ",").replace("WITH ", "WITH RECURSIVE ", 1))
def exact_quotas(spark, d):
    c = X.quota_cands(spark, d).drop("kind")
    typed = c.select(*(F.col(n).cast("long" if n in ("script_id", "section_id", "item") else "int").alias(n) for n in c.columns))
    return M.allocate_exact(typed, 4).select("script_id", "section_id", "item", "place")


@query(X.with_("sections script_media", """, c AS (SELECT * FROM script_media WHERE kind = 'video' QUALIFY row_number() OVER (PARTITION BY script_id, coalesce(sha, path) ORDER BY section_id, pos, path) = 1),
e AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY script_id, path ORDER BY section_id, pos, path) = 1)
SELECT script_id, section_id, pos, path, kind FROM e UNION ALL SELECT script_id, section_id, pos, path, kind FROM script_media WHERE kind = 'image'""").replace("\n,", ","))  # fmt: skip
def unrepeated_assets(spark, d):
    m = M.drop_repeated_assets(X.script_media(spark, d))
    return m.select("script_id", "section_id", F.col("pos").cast("long").alias("pos"), "path", "kind")


@query(X.with_("sections", """, t AS (SELECT script_id, section_id, CASE WHEN seconds > 0 THEN seconds ELSE 1 END AS n FROM sections)
SELECT script_id, section_id, coalesce(sum(n) OVER (PARTITION BY script_id ORDER BY section_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * (64 / sum(n) OVER (PARTITION BY script_id)) AS start,
       n * (64 / sum(n) OVER (PARTITION BY script_id)) AS duration FROM t""").replace("\n,", ","))  # fmt: skip
def timelines(spark, d):
    s = X.timed_sections(spark, d).withColumn("total", F.lit(64.0))
    return K.timeline(s, "script_id", "section_id", "seconds", "total").select("script_id", "section_id", "start", "duration")


_CHAPTERS = f""", w AS (SELECT script_id, section_id, CAST(greatest(8, floor(len({R.words('narration')}) / CAST(110 AS DOUBLE) * 60)) AS BIGINT) AS seconds FROM sections),
c AS (SELECT *, CAST(coalesce(sum(seconds) OVER (PARTITION BY script_id ORDER BY section_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM w)"""


@query(X.with_("sections", _CHAPTERS + f" SELECT script_id, section_id, seconds, start, {R.chapter('start')} AS chapter FROM c").replace("\n,", ","))
def chapters(spark, d):
    return K.timeline_by_words(X.sections(spark, d), "script_id", "section_id", "narration").select("script_id", "section_id", "seconds", "start", "chapter")


_WORD = f""", e AS (SELECT script_id, section_id, unnest({R.words('narration')}) AS word, generate_subscripts({R.words('narration')}, 1) AS i FROM sections),
o AS (SELECT script_id, word, row_number() OVER (PARTITION BY script_id ORDER BY section_id, i) AS place FROM e)"""


@query(X.with_("sections", _WORD + """ SELECT script_id, (place - 1) // 5 AS cue, min(place) * 400 AS start_ms, max(place) * 400 + 350 AS end_ms, string_agg(word, ' ' ORDER BY place) AS text FROM o GROUP BY ALL""").replace("\n,", ","))
def word_groups(spark, d):
    s = X.sections(spark, d).select("script_id", "section_id", F.posexplode(T.words(F.col("narration"))).alias("i", "word"))
    at = F.row_number().over(K.Window.partitionBy("script_id").orderBy("section_id", "i")).cast("long")
    e = s.withColumn("at", at).withColumn("start_ms", F.col("at") * 400).withColumn("end_ms", F.col("at") * 400 + 350)
    return K.group_words(e.select("script_id", "at", "word", "start_ms", "end_ms"), "script_id", "at")


_PROP = f""", s AS (SELECT script_id, section_id, unnest({R.sentences('narration')}) AS s, generate_subscripts({R.sentences('narration')}, 1) - 1 AS sentence,
  CAST(len({R.words('narration')}) * 400 AS DOUBLE) AS total FROM sections),
w AS (SELECT *, unnest({R.words('s')}) AS word, generate_subscripts({R.words('s')}, 1) - 1 AS place FROM s),
t AS (SELECT *, coalesce(sum(length(word) + CAST(1.5 AS DOUBLE)) OVER (PARTITION BY script_id, section_id ORDER BY sentence, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  total / sum(length(word) + CAST(1.5 AS DOUBLE)) OVER (PARTITION BY script_id, section_id) AS ms FROM w),
g AS (SELECT script_id, section_id, sentence, place // 6 AS part, min(before * ms) AS start, max(least((before + length(word)) * ms, total)) AS "end", any_value(total) AS total,
  string_agg(word, ' ' ORDER BY place) AS text FROM t GROUP BY ALL),
cues AS (SELECT script_id, section_id, row_number() OVER x AS cue, CAST(floor(start) AS BIGINT) AS start_ms,
  CAST(floor(CASE WHEN lead(part) OVER x IS NULL THEN total ELSE "end" END) AS BIGINT) AS end_ms, text, total FROM g WINDOW x AS (PARTITION BY script_id, section_id ORDER BY sentence, part))"""


def _prop(spark, d):
    s = X.sections(spark, d).withColumn("total", T.word_count(F.col("narration")) * 400.0)
    return K.proportional_cues(s, ["script_id", "section_id"], "narration", "total")


@query(X.with_("sections", _PROP + " SELECT script_id, section_id, cue, start_ms, end_ms, text FROM cues").replace("\n,", ","))
def sentence_cues(spark, d):
    return _prop(spark, d).withColumn("cue", F.col("cue").cast("long"))


_MERGE = _PROP + f""", parts AS (SELECT script_id, section_id, CAST(coalesce(sum(len({R.words('narration')}) * 400) OVER (PARTITION BY script_id ORDER BY section_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM sections),
merged AS (SELECT script_id, section_id, cue, start_ms + off AS start_ms, end_ms + off AS end_ms, text FROM cues JOIN parts USING (script_id, section_id))"""


def _merged(spark, d):
    parts = X.sections(spark, d).select("script_id", "section_id", (T.word_count(F.col("narration")) * 400.0).alias("duration_ms"))
    return K.merge_cues(_prop(spark, d), parts, "script_id", "section_id")


@query(X.with_("sections", _MERGE + " SELECT script_id, section_id, cue, start_ms, end_ms, text FROM merged").replace("\n,", ","))
def merged_cues(spark, d):
    return _merged(spark, d).select("script_id", "section_id", F.col("cue").cast("long").alias("cue"), "start_ms", "end_ms", "text")


_SRT = f""", n AS (SELECT script_id, row_number() OVER (PARTITION BY script_id ORDER BY section_id, cue) AS cue, start_ms, end_ms, text FROM merged)
SELECT script_id, string_agg(cue || chr(10) || {R.srt('start_ms')} || ' --> ' || {R.srt('end_ms')} || chr(10) || text || chr(10) || chr(10), '' ORDER BY cue) AS srt FROM n GROUP BY script_id"""


def numbered(cues):
    n = F.row_number().over(K.Window.partitionBy("script_id").orderBy("section_id", "cue"))
    return cues.withColumn("n", n).select("script_id", F.col("n").alias("cue"), "start_ms", "end_ms", "text")


@query(X.with_("sections", _MERGE + _SRT).replace("\n,", ","))
def caption_files(spark, d):
    return K.srt_text(numbered(_merged(spark, d)), "script_id")


@query(X.with_("sections", _MERGE + """ SELECT script_id, count(*) AS n_cues, floor(max(end_ms) / CAST(any_value(whole) AS DOUBLE) * 100 * 100 + 0.5) / 100 AS coverage,
  floor(max(end_ms) / CAST(any_value(whole) AS DOUBLE) * 100 * 100 + 0.5) / 100 < 85 AS short FROM merged JOIN (SELECT script_id, max(off) + 60000 AS whole FROM parts GROUP BY 1) USING (script_id) GROUP BY script_id""").replace("\n,", ","))
def coverages(spark, d):
    cues = _merged(spark, d)
    # Scripts whose last section has no words still count its offset.
    parts = X.sections(spark, d).select("script_id", "section_id", (T.word_count(F.col("narration")) * 400.0).alias("ms"))
    before = F.coalesce(F.sum(F.round("ms").cast("long")).over(K.Window.partitionBy("script_id").orderBy("section_id").rowsBetween(K.Window.unboundedPreceding, -1)), F.lit(0))
    whole = parts.withColumn("off", before).groupBy(F.col("script_id").alias("_s")).agg((F.max("off") + 60000).alias("whole"))
    return K.caption_coverage(cues.join(whole, F.col("script_id") == F.col("_s")), "script_id", "whole")


@query("""WITH t AS (SELECT p_size AS playlist, p_partkey, CAST(p_partkey % 7 + 1 AS DOUBLE) AS duration FROM part),
r AS (SELECT *, unnest(range(0, 10)) AS loop FROM t),
s AS (SELECT *, coalesce(sum(duration) OVER (PARTITION BY playlist ORDER BY loop, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM r)
SELECT playlist, p_partkey, loop, start, least(duration, 300.5 - start) AS played FROM s WHERE start < 300.5""")  # fmt: skip
def playlists(spark, d):
    t = X.load(spark, d, "part").select(F.col("p_size").alias("playlist"), "p_partkey", (F.col("p_partkey") % 7 + 1).cast("double").alias("duration"))
    return K.loop_playlist(t, F.lit(300.5), "playlist", "p_partkey").select("playlist", "p_partkey", F.col("loop").cast("long").alias("loop"), "start", "played")


@query(X.with_("sections", """SELECT script_id, string_agg(trim(narration), '  ...  ' ORDER BY section_id) AS narration FROM sections
WHERE trim(coalesce(narration, '')) <> '' AND NOT starts_with(trim(narration), 'Start with') AND NOT starts_with(trim(narration), 'Open with') AND NOT starts_with(trim(narration), 'Deep explanation')
GROUP BY script_id"""))  # fmt: skip
def narrations(spark, d):
    return K.clean_narration(X.sections(spark, d), "script_id", "section_id", "narration")


_RULE = "─" * 40
_DESC = _CHAPTERS + f""", l AS (SELECT script_id, list({R.chapter('start')} || ' S' || section_id ORDER BY section_id) AS lines FROM c GROUP BY script_id)
SELECT script_id, concat_ws(chr(10), CASE WHEN coalesce(hook_question, '') <> '' THEN hook_question || chr(10) END, CASE WHEN coalesce(source_trend, '') <> '' THEN source_trend || chr(10) END,
  CASE WHEN video_type <> 'shorts' AND len(lines) >= 3 THEN '{_RULE}' || chr(10) || '⏱ CHAPTERS' || chr(10) || '{_RULE}' || chr(10) || array_to_string(lines, chr(10)) || chr(10) END,
  '{_RULE}' || chr(10) || '🧠 WHAT YOU''LL LEARN' || chr(10) || '{_RULE}' || chr(10) || array_to_string(list_transform(key_points, lambda p: '• ' || p), chr(10)) || chr(10),
  CASE WHEN video_type = 'shorts' THEN '👆 Follow for more mind-bending facts!' || chr(10) || '💬 Comment: did this surprise you?' || chr(10)
       ELSE '{_RULE}' || chr(10) || '🔔 Subscribe for a new mind-bending video every week!' || chr(10) || '👍 Like if this made you think differently.' || chr(10) || '💬 Drop a comment — we read every one.' || chr(10) END,
  CASE WHEN len(tags) > 0 THEN array_to_string(list_transform(tags[1:8], lambda t: '#' || replace(t, ' ', '')), ' ') END,
  CASE WHEN video_type = 'shorts' THEN '#Shorts #YouTubeShorts' END) AS description
FROM research JOIN l USING (script_id)"""


@query(X.with_("sections research", _DESC).replace("\n,", ","))
def descriptions(spark, d):
    r = X.research(spark, d).withColumnRenamed("source_trend", "description").withColumn("why_now", F.lit(""))
    c = K.timeline_by_words(X.sections(spark, d), "script_id", "section_id", "narration")
    return S.build_description(r, c.withColumn("title", F.concat(F.lit("S"), F.col("section_id").cast("string"))))


@query(X.with_("sections research", """SELECT s.script_id, s.section_id, CASE WHEN r.script_id IS NOT NULL THEN r.topic ELSE s.section_type END AS topic
FROM sections s LEFT JOIN (SELECT * FROM research WHERE script_id % 2 = 0) r USING (script_id)"""))  # fmt: skip
def stamped_scripts(spark, d):
    s = X.sections(spark, d).select("script_id", "section_id", F.col("section_type").alias("topic"))
    return S.stamp_identity(s, X.research(spark, d).filter("script_id % 2 = 0"), "script_id", ("topic",))


@query(X.with_("sections research", """SELECT script_id, coalesce(hook_question, '') || chr(10) || chr(10) || repeat('─', 29) || chr(10) || 'Subscribe for more current-trend explainers!' || chr(10)
|| repeat('─', 29) || chr(10) || coalesce(array_to_string(list_transform(tags, lambda t: '#' || t), ' '), '') AS description FROM research"""))  # fmt: skip
def upload_descriptions(spark, d):
    return X.research(spark, d).select("script_id", S.upload_description(F.col("hook_question"), F.col("tags")).alias("description"))


@query("WITH RECURSIVE " + X.with_("sections script_media segments", """SELECT t.rule, t.script_id, t.section_id, k + CAST(opening IS NOT NULL AS BIGINT) AS segment, path, start, least(step, target - start) AS length
FROM turns t JOIN stepped s ON t.rule = s.rule AND t.script_id = s.script_id AND t.section_id = s.section_id AND s.i = k % s.n
UNION ALL SELECT DISTINCT rule, script_id, section_id, CAST(0 AS BIGINT), opening, CAST(0 AS DOUBLE), CAST(base AS DOUBLE) FROM stepped WHERE opening IS NOT NULL""").removeprefix("WITH "))  # fmt: skip
def section_segments(spark, d):
    """Sections filled with their media by each rule; the SQL goes on from segment to segment."""
    m, s, o = X.segment_media(spark, d), X.segment_sections(spark, d), X.openings(spark, d)
    out = None
    for rule in K.RULES:
        one = K.fill_segments(m, s, rule, o if rule == "even" else None).withColumn("rule", F.lit(rule))
        out = one if out is None else out.unionByName(one)
    return out
