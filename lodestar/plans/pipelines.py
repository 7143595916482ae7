"""Composite pipelines: what a user calls end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit as A
from ..operators import captions as K
from ..operators import gates as G
from ..operators import media as M
from ..operators import ranking as P
from ..operators import similarity as S

_VERDICT = ("content_domain", "niche_subject", "niche_evidence", "us_movie_relevant", "us_relevance_reason")


def ranked_candidates(cands: DataFrame, history: DataFrame, as_of: str, keywords: tuple[str, ...], n: int = 120) -> DataFrame:
    """The n best recent, safe candidates that resemble no used topic, with their rank.

    cands: video_id, title, description, published_at, views, trend_score, source.
    history: item_id, topic.
    """
    text = F.concat_ws(" ", "title", "description")
    fit = cands.filter(G.recent(F.col("published_at"), as_of)).filter(G.required(F.col("video_id"), F.col("title")) & G.not_banned(text, keywords))
    fresh = S.anti_similar(P.dedupe_best(fit), history, "video_id", "title", "item_id", "topic")
    return P.top_trends(fresh, n)


def best_trend(
    cands: DataFrame, history: DataFrame, verdicts: DataFrame, as_of: str, keywords: tuple[str, ...], size: int = 20, most: int = 4, strict: bool = True
) -> DataFrame:
    """The best candidate with an acceptable verdict within the first batches; one row or none.

    With strict, a verdict on an id that is no candidate's is an error; else it is left out.
    """
    if strict:
        unknown = G.join_verdict(cands, verdicts)[1].select("candidate_id").first()
        if unknown is not None:
            raise ValueError(f"verdict on an unknown candidate: {unknown[0]}")
    ranked = ranked_candidates(cands, history, as_of, keywords)
    met, _ = G.join_verdict(ranked, verdicts)
    ok = G.verdict_ok(*(F.col(c) for c in _VERDICT))
    chosen = G.gate_batches(met, ok, size, most)
    return chosen.select("video_id", "title", "rank", "batch", F.upper(F.trim("content_domain")).alias("content_domain"), G.content_type(F.col("content_type")).alias("content_type"))


def allocate_media(
    cands: DataFrame, sections: DataFrame, quota: int, media: DataFrame | None = None, history: DataFrame | None = None,
    frames: DataFrame | None = None, strict: bool = True, index: str | None = None,
) -> DataFrame:
    """Media of every section: its quota of accepted items, what it borrows if it has none, repeats dropped.

    cands: as for quota_first_n, with the item's kind. With media (media_id is the item),
    history and perhaps frames and the index of stored fingerprints, only items that
    dedupe_media accepts take part, and clips with the content of an earlier section's are
    repeats. With strict, a section that stays empty is an error.
    """
    sha = F.lit(None).cast("string").alias("sha")
    if media is not None:
        accepted = M.dedupe_media(media, history, frames, index).filter("reason is null").select(F.col("media_id").alias("_item"), sha if "sha" not in media.columns else "sha")
        cands, sha = cands.join(accepted, F.col("item") == F.col("_item")).drop("_item"), F.col("sha")
    own = M.quota_first_n(cands, quota)
    own = own.select("script_id", "section_id", F.col("place").alias("pos"), F.col("item").cast("string").alias("path"), "kind", sha)
    lent = M.fill_from_pool(own, sections).select("script_id", "section_id", F.lit(1).alias("pos"), "path", "kind", F.lit(None).cast("string").alias("sha"))
    filled = own.unionByName(lent)
    if strict:
        empty = sections.join(filled, ["script_id", "section_id"], "left_anti").select("script_id", "section_id").first()
        if empty is not None:
            raise ValueError(f"section without media: {tuple(empty)}")
    return M.drop_repeated_assets(filled).select("script_id", "section_id", "pos", "path", "kind")


def audit_all(sections: DataFrame, research: DataFrame, trends: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """All audits of each script: script_id and the sorted violations, each with the audit's name before it.

    research: as the audits take it, with selected_trend. trends: script_id, content_domain.
    """
    fields = ("topic", "source_trend", "video_title", "hook_question", "content_angle", "content_domain", "content_type")
    said = lambda name, c: F.transform(c, lambda v: F.concat(F.lit(f"{name}: "), v))
    r = research.withColumn("research", said("research", A.research_violations(fields)))
    r = A.audit_research(r).withColumn("lock", said("lock", F.col("violations"))).drop("anchors", "violations")
    r = A.audit_topic_drift(r, ("hook_question", "content_angle")).withColumn("drift", said("drift", F.col("violations"))).drop("anchors", "violations")
    astray = A.domain_drift(research, trends, "script_id").select(F.col("script_id").alias("_d"), F.array(F.lit("domain drift")).alias("domain")).distinct()
    scripts = A.audit_scripts(sections, research, headers).select(F.col("script_id").alias("_s"), said("script", F.col("violations")).alias("script"))
    met = r.join(astray, F.col("script_id") == F.col("_d"), "left").join(scripts, F.col("script_id") == F.col("_s"), "left")
    none = F.array().cast("array<string>")
    return met.select("script_id", F.array_sort(F.concat(*(F.coalesce(c, none) for c in ("research", "lock", "drift", "domain", "script")))).alias("violations"))


def build_captions(sections: DataFrame, script: str = "script_id", max_words: int = 260, ms_per_word: float = 400.0) -> DataFrame:
    """Caption files of scripts: narration, chunks, cues timed by weight, merged and numbered; with their coverage."""
    text = K.clean_narration(sections, script, "section_id", "narration")
    chunks = text.select(script, F.posexplode(T.chunk_text(F.col("narration"), max_words)).alias("section_id", "chunk"))
    chunks = chunks.withColumn("duration_ms", T.word_count(F.col("chunk")) * ms_per_word)
    cues = K.proportional_cues(chunks, [script, "section_id"], "chunk", "duration_ms")
    merged = K.merge_cues(cues, chunks, script, "section_id")
    number = F.row_number().over(K.Window.partitionBy(script).orderBy("section_id", "cue"))
    merged = merged.withColumn("cue", number)
    total = chunks.groupBy(F.col(script).alias("_s")).agg(F.sum(F.round("duration_ms").cast("long")).alias("total"))
    covered = K.caption_coverage(merged.join(total, F.col(script) == F.col("_s")), script, "total")
    return K.srt_text(merged.select(script, "cue", "start_ms", "end_ms", "text"), script).join(covered, script)


def manual_topic(topics: DataFrame) -> DataFrame:
    """Verdict-shaped rows of topics that a user chose, each passed through the gate as an explainer of a movie."""
    v = topics.select(
        F.col("topic").alias("title"),
        F.lit("MOVIE").alias("content_domain"),
        F.trim("topic").alias("niche_subject"),
        F.trim("topic").alias("niche_evidence"),
        F.lit("true").alias("us_movie_relevant"),
        F.lit("chosen by the user").alias("us_relevance_reason"),
    )
    return v.filter(G.verdict_ok(*(F.col(c) for c in _VERDICT))).select("title", "content_domain", F.lit("EXPLAINER").alias("content_type"))
