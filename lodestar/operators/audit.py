"""Audits of research and scripts against their subject; each gives the list of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import numbers as N
from ..functions import text as T
from .gates import subject_match, terms_match

QUERIES = ("video_query", "video_query_2", "video_query_3", "video_query_4")
# Fixed value: names of the schema itself, which anchor nothing.
SCHEMA_WORDS = "EXPLAINER BREAKDOWN ANALYSIS NEWS EXPLAINER CONTEXT TIMELINE HOW IT WORKS RECAP TREND EXPLAINER"


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def _listed(*checks: tuple[Column, str]) -> Column:
    """Names of the checks that hold, in order."""
    return F.filter(F.array(*(F.when(c, F.lit(name)) for c, name in checks)), lambda x: x.isNotNull())


def research_violations(required: tuple[str, ...]) -> Column:
    """Blank fields among `required`, an empty key_points and a missing tags."""
    fields = [(_blank(F.col(c)), c) for c in required]
    points = F.col("key_points").isNull() | (F.size("key_points") <= 0)
    return _listed(*fields, (points, "key_points"), (F.col("tags").isNull(), "tags"))


def audit_research(research: DataFrame, strict: bool = False) -> DataFrame:
    """research with `violations` of the topic lock: source, domain, content type, topic anchored.

    With strict, the topic is not among its own anchors.
    """
    none = F.array().cast("array<string>")
    trusted = ["source_trend", "hook_question", "content_angle"] + ([] if strict else ["topic"])
    terms = [T.topic_terms(F.col(c)) for c in trusted]
    points = T.topic_terms(F.array_join(F.coalesce("key_points", none), " "))
    anchors = T.terms_union(*terms, points)
    upper = lambda c: F.upper(F.trim(F.coalesce(F.col(c), F.lit(""))))
    source = F.coalesce(F.nullif(F.col("source_trend"), F.lit("")), F.col("topic"))
    return research.withColumn("anchors", anchors).withColumn(
        "violations",
        _listed(
            (_blank(source), "no source"),
            (~upper("content_domain").isin(*C.CONTENT_DOMAINS), "domain"),
            (~upper("content_type").isin(*C.CONTENT_TYPES), "content type"),
            (_blank(F.col("topic")) | ~terms_match(F.col("anchors"), F.col("topic")), "topic drifted"),
        ),
    )


def audit_topic_drift(derived: DataFrame, context: tuple[str, ...] = ("title", "description", "content_angle")) -> DataFrame:
    """derived (with selected_trend, source_trend, topic and context columns) with sorted `anchors` and `violations`."""
    anchors = T.terms_union(T.subject_anchors(F.col("selected_trend")), *(T.subject_anchors(F.col(c)) for c in context))
    source = F.coalesce(F.nullif(F.col("source_trend"), F.lit("")), F.col("selected_trend"))
    match = lambda c: subject_match(F.col("selected_trend"), c, F.col("anchors"))
    return derived.withColumn("anchors", anchors).withColumn(
        "violations",
        _listed(
            (_blank(F.col("selected_trend")), "no trend"),
            (_blank(source) | ~match(source), "source drifted"),
            (_blank(F.col("topic")) | ~match(F.col("topic")), "topic drifted"),
        ),
    )


def domain_drift(research: DataFrame, trends: DataFrame, key: str) -> DataFrame:
    """Rows of research whose content_domain is not their trend's."""
    t = trends.select(F.col(key).alias("_k"), F.col("content_domain").alias("trend_domain"))
    return research.join(t, F.col(key) == F.col("_k")).filter(~F.col("content_domain").eqNullSafe(F.col("trend_domain"))).drop("_k")


def audit_scripts(sections: DataFrame, research: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """One row for each script: sections, anchored sections, and the sorted violations.

    sections: script_id, section_id, section_type, narration, the four queries.
    research: script_id, video_type, topic, source_trend, video_title, hook_question,
    content_angle, content_domain, key_points, tags. headers: script_id and the script's own
    topic, source_trend and content_domain, where it has any.
    """
    none = F.array().cast("array<string>")
    own = ("topic", "source_trend", "content_domain")
    if headers is None:
        headers = research.select("script_id", *(F.lit(None).cast("string").alias(c) for c in own)).limit(0)
    head = headers.select(F.col("script_id").alias("_h"), *(F.col(c).alias(f"own_{c}") for c in own))
    r = research.join(head, F.col("script_id") == F.col("_h"), "left")
    fields = ("topic", "source_trend", "video_title", "hook_question", "content_angle", "own_topic", "own_source_trend")
    lists = [F.array_join(F.coalesce(c, none), " ") for c in ("key_points", "tags")]
    terms = [T.topic_terms(F.col(c)) for c in fields] + [T.topic_terms(x) for x in lists]
    said = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    source = F.coalesce(said("own_source_trend"), said("own_topic"), said("source_trend"), said("topic"), F.lit(""))
    domain = F.upper(F.trim(F.coalesce(said("own_content_domain"), said("content_domain"), F.lit(""))))
    anchors = F.array_except(T.terms_union(*terms), T.topic_terms(F.lit(SCHEMA_WORDS)))
    trusted = r.select(F.col("script_id").alias("_id"), "video_type", anchors.alias("anchors"), source.alias("source"), domain.alias("domain"), said("own_topic").alias("own"))
    trusted = trusted.withColumn(
        "whole",
        _listed(
            (_blank(F.col("source")), "no source"),
            ((F.col("domain") != "") & ~F.col("domain").isin(*C.CONTENT_DOMAINS), "domain"),
            (F.col("own").isNotNull() & ~terms_match(F.col("anchors"), F.col("own")), "topic drifted"),
        ),
    )
    s = sections.join(trusted.drop("source", "domain", "own"), F.col("script_id") == F.col("_id"))
    kind = N.section_type(F.col("section_type"))
    anchored = terms_match(F.col("anchors"), F.col("narration"))
    blank = _blank(F.col("narration"))
    checks = [(blank, "narration empty"), (~blank & ~anchored & ~kind.isin(*C.CALL_TO_ACTION), "narration drifted")]
    for q in QUERIES:
        checks += [(_blank(F.col(q)), f"{q} missing"), (~_blank(F.col(q)) & ~terms_match(F.col("anchors"), F.col(q)), f"{q} drifted")]
    s = s.withColumn("anchored", anchored & ~blank).withColumn("found", _listed(*checks))
    per = s.groupBy("script_id").agg(
        F.first("video_type").alias("video_type"),
        F.first(F.size("anchors")).alias("n_anchors"),
        F.first("whole").alias("whole"),
        F.count("*").alias("n_sections"),
        F.count_if("anchored").alias("n_anchored"),
        F.flatten(F.collect_set("found")).alias("found"),
    )
    by_type = lambda shorts, long, other: F.when(F.col("video_type") == "shorts", shorts).when(F.col("video_type") == "long", long).otherwise(other)
    expected = by_type(F.lit(3), F.lit(9), F.col("n_sections"))
    whole = _listed(
        (F.col("n_sections") != expected, "section count"),
        (F.col("n_anchors") < 2, "weak context"),
        (F.col("n_anchored") < by_type(2, 4, 1), "too few anchored"),
    )
    violations = F.array_sort(F.array_union(F.concat("whole", whole), F.array_distinct("found")))
    return per.select("script_id", "n_sections", "n_anchored", violations.alias("violations"))


#: Headings of a trace and the columns under them.
TRACED = (("SELECTED SUBJECT", "subject"), ("DOMAIN", "content_domain"), ("CONTENT TYPE", "content_type"), ("RESEARCH TOPIC", "topic"), ("SCRIPT TOPIC", "script_topic"))


def topic_trace(sections: DataFrame, headers: DataFrame, media: DataFrame | None = None, script: str = "script_id") -> DataFrame:
    """An ordered dump of each script: its subject and fields, then sections with their queries and, with media, their files.

    sections: script, section_id, narration, queries. headers: script and the columns of
    TRACED; a missing value reads None. media: script, section_id, pos, path.
    """
    lines = [F.concat(F.lit("  Section "), F.col("section_id").cast("string"), F.lit(": "), F.coalesce("narration", F.lit("")))]
    lines += [F.when(~_blank(F.col(q)), F.concat(F.lit(f"    {q}: "), F.col(q))) for q in QUERIES]
    s = sections
    if media is not None:
        paths = F.transform(F.array_sort(F.collect_list(F.struct("pos", "path"))), lambda x: F.concat(F.lit("'"), x["path"], F.lit("'")))
        files = media.groupBy(F.col(script).alias("_s"), F.col("section_id").alias("_n")).agg(F.array_join(paths, ", ").alias("_files"))
        s = s.join(files, (F.col(script) == F.col("_s")) & (F.col("section_id") == F.col("_n")), "left")
        lines.append(F.concat(F.lit("    downloaded: ["), F.coalesce("_files", F.lit("")), F.lit("]")))
    parts = F.array_sort(F.collect_list(F.struct("section_id", "_b")))
    out = s.withColumn("_b", F.concat_ws("\n", *lines)).groupBy(script).agg(F.transform(parts, lambda x: x["_b"]).alias("b"))
    head = [x for title, c in TRACED for x in (F.lit(title), F.concat(F.lit("  "), F.coalesce(F.col(c), F.lit("None"))))]
    named = headers.select(F.col(script).alias("_k"), F.concat_ws("\n", *head).alias("_head"))
    return out.join(named, F.col(script) == F.col("_k")).select(script, F.concat_ws("\n", "_head", F.array_join("b", "\n")).alias("trace"))
