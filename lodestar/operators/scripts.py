"""Scripts: statistics, identity and descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Rules, headings and closing lines of a description.
_RULE, _UPLOAD_RULE = "─" * 40, "─" * 29
_CHAPTERS, _POINTS = "⏱ CHAPTERS", "🧠 WHAT YOU'LL LEARN"
_CLOSING = ("🔔 Subscribe for a new mind-bending video every week!", "👍 Like if this made you think differently.", "💬 Drop a comment — we read every one.")
_CLOSING_SHORTS = ("👆 Follow for more mind-bending facts!", "💬 Comment: did this surprise you?")
_SHORTS_TAGS = "#Shorts #YouTubeShorts"
_UPLOAD_CALL = "Subscribe for more current-trend explainers!"


def section_stats(sections: DataFrame, script: str, text: str) -> DataFrame:
    """Sections, words, and most words of a section for each script."""
    n = T.word_count(F.col(text))
    return sections.groupBy(script).agg(F.count("*").alias("n_sections"), F.sum(n).alias("n_words"), F.max(n).alias("most_words"))


def stamp_identity(scripts: DataFrame, research: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """scripts with the given fields overwritten by those of their research."""
    r = research.select(F.col(key).alias("_k"), *(F.col(f).alias(f"_{f}") for f in fields))
    met = scripts.join(r, F.col(key) == F.col("_k"), "left")
    kept = {f: F.when(F.col("_k").isNotNull(), F.col(f"_{f}")).otherwise(F.col(f)) for f in fields}
    return met.withColumns(kept).select(*scripts.columns)


def build_description(scripts: DataFrame, chapters: DataFrame, script: str = "script_id") -> DataFrame:
    """The description of each script: hook, description, why now, chapters, key points, a call to action, tags.

    scripts: script, video_type, hook_question, description, why_now, key_points, tags.
    chapters: script, section_id, chapter, title; listed from three on, and never for shorts,
    which also have closing lines and tags of their own. Blank parts vanish with the line
    after them.
    """
    parts = F.array_sort(F.collect_list(F.struct("section_id", F.concat_ws(" ", "chapter", "title").alias("line"))))
    listed = chapters.groupBy(F.col(script).alias("_k")).agg(F.transform(parts, lambda x: x["line"]).alias("lines"))
    met = scripts.join(listed, F.col(script) == F.col("_k"), "left")
    shorts = F.coalesce(F.col("video_type") == "shorts", F.lit(False))
    para = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.col(c), F.lit("\n")))
    head = lambda title, body: F.concat_ws("\n", F.lit(_RULE), F.lit(title), F.lit(_RULE), body, F.lit(""))
    points = F.array_join(F.transform("key_points", lambda p: F.concat(F.lit("• "), p)), "\n")
    closing = F.when(shorts, "\n".join([*_CLOSING_SHORTS, ""])).otherwise("\n".join([_RULE, *_CLOSING, ""]))
    return met.select(
        script,
        F.concat_ws(
            "\n",
            para("hook_question"),
            para("description"),
            para("why_now"),
            F.when(~shorts & (F.size("lines") >= 3), head(_CHAPTERS, F.array_join("lines", "\n"))),
            F.when(F.size("key_points") > 0, head(_POINTS, points)),
            closing,
            F.when(F.size("tags") > 0, T.hashtags(F.col("tags"))),
            F.when(shorts, _SHORTS_TAGS),
        ).alias("description"),
    )


def upload_description(description: Column, tags: Column) -> Column:
    """The short form that an upload takes: the description, a call to action, and all tags."""
    none = F.array().cast("array<string>")
    lines = "\n".join(["", "", _UPLOAD_RULE, _UPLOAD_CALL, _UPLOAD_RULE, ""])
    return F.concat(F.coalesce(description, F.lit("")), F.lit(lines), F.array_join(F.transform(F.coalesce(tags, none), lambda t: F.concat(F.lit("#"), t)), " "))
