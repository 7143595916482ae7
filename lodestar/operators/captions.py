"""Captions and timelines: cues from words, offsets, clips of intervals and point look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import numbers as N
from ..functions import text as T

#: Share of a character that the gap after a word counts as.
GAP = 1.5
CUE_WORDS = 6


def _before(part: list[str], *order: str):
    return Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def timeline(sections: DataFrame, script: str, section: str, seconds: str, total: str | None = None) -> DataFrame:
    """Start and duration of each section in order: missing or 0 seconds count as 1; with `total`, scaled to it."""
    nominal = F.when(F.coalesce(F.col(seconds), F.lit(0.0)) > 0, F.col(seconds)).otherwise(F.lit(1.0)).cast("double")
    out = sections.withColumn("_n", nominal)
    start = F.coalesce(F.sum("_n").over(_before([script], section)), F.lit(0.0))
    scale = F.lit(1.0)
    if total:
        whole = F.sum("_n").over(Window.partitionBy(script))
        scale = F.when((F.col(total) > 0) & (whole > 0), F.col(total) / whole).otherwise(1.0)
    return out.withColumn("start", start * scale).withColumn("duration", F.col("_n") * scale).drop("_n")


def timeline_by_words(sections: DataFrame, script: str, section: str, text: str) -> DataFrame:
    """Start of each section in whole seconds from its words, with the chapter's mark."""
    out = sections.withColumn("seconds", N.whole_seconds(T.word_count(F.col(text))))
    start = F.coalesce(F.sum("seconds").over(_before([script], section)), F.lit(0)).cast("long")
    return out.withColumn("start", start).withColumn("chapter", N.chapter_ts(F.col("start")))


def group_words(events: DataFrame, script: str, order: str, n: int = 5) -> DataFrame:
    """Cues of n word events each: first start, last end, text. events: word, start_ms, end_ms."""
    at = F.row_number().over(Window.partitionBy(script).orderBy(order))
    put = events.withColumn("cue", F.floor((at - 1) / n).cast("long"))
    cues = put.groupBy(script, "cue").agg(
        F.min("start_ms").alias("start_ms"),
        F.max("end_ms").alias("end_ms"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "word"))), lambda x: x["word"]), " ").alias("text"),
    )
    return cues


def proportional_cues(scripts: DataFrame, key: list[str], text: str, total_ms: str, n: int = CUE_WORDS) -> DataFrame:
    """Cues of up to n words of a sentence, timed by the weight len + 1.5 of their words; the last ends at total_ms.

    Weights are whole multiples of a half, so their running sums are exact.
    """
    sentences = scripts.select(*key, F.col(total_ms).cast("double").alias("_total"), F.posexplode(T.split_sentences(F.col(text))).alias("sentence", "_s"))
    each = sentences.select(*key, "_total", "sentence", F.posexplode(T.words(F.col("_s"))).alias("at", "word"))
    weight = F.length("word") + F.lit(GAP)
    order = ["sentence", "at"]
    each = each.withColumn("_w", weight)
    each = each.withColumn("_before", F.coalesce(F.sum("_w").over(_before(key, *order)), F.lit(0.0)))
    each = each.withColumn("_all", F.sum("_w").over(Window.partitionBy(*key)))
    ms = F.col("_total") / F.col("_all")
    each = each.withColumn("start", F.col("_before") * ms).withColumn("end", F.least((F.col("_before") + F.length("word")) * ms, F.col("_total")))
    cues = each.withColumn("part", F.floor(F.col("at") / n).cast("int")).groupBy(*key, "sentence", "part").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.first("_total").alias("_total"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("text"),
    )
    w = Window.partitionBy(*key).orderBy("sentence", "part")
    cues = cues.withColumn("cue", F.row_number().over(w))
    end = F.when(F.lead("cue").over(w).isNull(), F.col("_total")).otherwise(F.col("end"))
    return cues.select(*key, "cue", F.floor("start").cast("long").alias("start_ms"), F.floor(end).cast("long").alias("end_ms"), "text")


def merge_cues(cues: DataFrame, parts: DataFrame, script: str, part: str) -> DataFrame:
    """Cues shifted by the rounded durations of the parts before theirs. parts: script, part, duration_ms."""
    offset = F.coalesce(F.sum(F.round("duration_ms").cast("long")).over(_before([script], part)), F.lit(0)).cast("long")
    moved = parts.select(script, part, offset.alias("offset_ms"))
    met = cues.join(moved, [script, part])
    return met.withColumn("start_ms", F.col("start_ms") + F.col("offset_ms")).withColumn("end_ms", F.col("end_ms") + F.col("offset_ms"))


#: Ticks of a second in which intervals are laid on grids.
_TICKS = 1000


def _met(points: DataFrame, at: str, intervals: DataFrame, start: str, end: str, script: str) -> DataFrame:
    """points joined with the intervals of their script that hold them up to a tick, without a product within a script.

    An interval lies on a grid with cells of about its own length, in three of them at
    most. A point is looked up on every grid that its script has, so it meets the
    intervals next to it and no others, however many there are.
    """
    tick = lambda c: F.floor(F.col(c) * _TICKS).cast("long")
    placed = intervals.filter(F.col(end) >= F.col(start)).withColumns({"_a": tick(start), "_b": tick(end)})
    placed = placed.withColumn("_grid", F.ceil(F.log2(F.col("_b") - F.col("_a") + 1)).cast("int"))
    cell = lambda c: F.expr(f"shiftright({c}, _grid)")
    placed = placed.withColumn("_cell", F.explode(F.sequence(cell("_a"), cell("_b"))))
    grids = placed.select(F.col(script).alias("_gs"), "_grid").distinct()
    asked = points.withColumn("_at", tick(at)).join(grids, F.col(script) == F.col("_gs")).drop("_gs").withColumn("_cell", cell("_at")).drop("_at")
    return asked.join(placed.drop("_a", "_b"), [script, "_grid", "_cell"]).drop("_grid", "_cell")


def clip_cues(cues: DataFrame, sections: DataFrame, script: str) -> DataFrame:
    """Cues of each section they overlap, in the section's own time and numbered anew.

    cues: script, start, end, text. sections: script, section_id, start, duration. A cue
    overlaps a section if it begins in it or the section begins in the cue: two joins of
    points with intervals.
    """
    s = sections.select(script, "section_id", F.col("start").alias("s0"), (F.col("start") + F.col("duration")).alias("s1"), "duration")
    c = cues.select(script, "start", "end", "text")
    begins = _met(c, "start", s, "s0", "s1", script).filter((F.col("s0") <= F.col("start")) & (F.col("start") < F.col("s1")))
    holds = _met(s, "s0", c, "start", "end", script).filter((F.col("start") < F.col("s0")) & (F.col("s0") < F.col("end")))
    met = begins.unionByName(holds)
    local = met.withColumn("local_start", F.greatest(F.lit(0.0), F.col("start") - F.col("s0")))
    local = local.withColumn("local_end", F.least(F.col("duration"), F.col("end") - F.col("s0")))
    local = local.filter((F.col("local_end") > F.col("local_start")) & (F.trim("text") != ""))
    number = F.row_number().over(Window.partitionBy(script, "section_id").orderBy("start", "end", "text"))
    return local.select(script, "section_id", number.alias("number"), "local_start", "local_end", F.trim("text").alias("text"))


def _first_holding(points: DataFrame, point: str, intervals: DataFrame, script: str, order: list[str], value: str) -> DataFrame:
    """(script, point, value) of the first interval, in the given order, with start <= point < end; null if there is none.

    intervals: script, start, end, value. In that order, which must begin with the start,
    the first interval that ends after the point is the first at which the latest end so far
    exceeds it. So only intervals that raise it count, and each point takes the one with
    the least such end beyond it: one sort of points and ends, and a last value.
    """
    so_far = F.max("end").over(_before([script], *order))
    rising = intervals.withColumn("_so_far", so_far).filter(F.col("_so_far").isNull() | (F.col("end") > F.col("_so_far")))
    ends = rising.select(script, F.col("end").cast("double").alias("_v"), F.lit(1).alias("_k"), F.struct("start", value).alias("_i"))
    asked = points.select(script, F.col(point).alias("_p")).distinct()
    asked = asked.select(script, F.col("_p").cast("double").alias("_v"), F.lit(0).alias("_k"), "_p")
    w = Window.partitionBy(script).orderBy(F.desc("_v"), "_k").rowsBetween(Window.unboundedPreceding, 0)
    met = ends.unionByName(asked, allowMissingColumns=True).withColumn("_i", F.last("_i", ignorenulls=True).over(w)).filter("_k = 0")
    found = F.when(F.col("_i.start") <= F.col("_p"), F.col(f"_i.{value}"))
    return met.select(script, F.col("_p").alias(point), found.alias(value))


def caption_at(points: DataFrame, cues: DataFrame, script: str, point: str) -> DataFrame:
    """The text of the first cue with start <= point < end, '' if there is none."""
    c = cues.filter("start is not null and end is not null").select(script, "start", "end", F.col("text").alias("caption"))
    found = _first_holding(points, point, c, script, ["start", "end", "caption"], "caption")
    return found.withColumn("caption", F.coalesce("caption", F.lit("")))


def section_at(points: DataFrame, sections: DataFrame, script: str, point: str) -> DataFrame:
    """The section whose interval holds the point, else the script's last."""
    s = sections.select(script, "section_id", "start", (F.col("start") + F.col("duration")).alias("end"))
    last = s.groupBy(F.col(script).alias("_s")).agg(F.max_by("section_id", F.struct("start", "section_id")).alias("last"))
    known = s.filter("start is not null and end is not null")
    first = _first_holding(points, point, known, script, ["start", "section_id"], "section_id").withColumnRenamed("section_id", "found")
    return first.join(last, F.col(script) == F.col("_s"), "left").select(script, point, F.coalesce("found", "last").alias("section_id"))


def loop_playlist(tracks: DataFrame, target: Column, playlist: str, order: str, most_loops: int = 10) -> DataFrame:
    """The pieces of a playlist, repeated up to `most_loops` times, that fill `target` seconds; the last is cut."""
    rounds = tracks.withColumn("loop", F.explode(F.sequence(F.lit(0), F.lit(most_loops - 1)))).withColumn("_target", target)
    start = F.coalesce(F.sum("duration").over(_before([playlist], "loop", order)), F.lit(0.0))
    placed = rounds.withColumn("start", start).filter(F.col("start") < F.col("_target"))
    return placed.withColumn("played", F.least(F.col("duration"), F.col("_target") - F.col("start"))).drop("_target")


#: Rules by which a section's media fill its length: the least rest that is still filled, and the most pieces for n items.
RULES = {"even": (0.05, lambda n: n * C.CYCLES + 1), "whole": (0.0, lambda n: F.lit(C.MOST_PIECES)), "stills": (0.01, None)}


def fill_segments(media: DataFrame, sections: DataFrame, rule: str, openings: DataFrame | None = None, script: str = "script_id", section: str = "section_id") -> DataFrame:
    """The segments that fill each section with its media in turn: script, section, segment (from 0), path, start, length.

    media: script, section, pos, path, kind, seconds (of a clip). sections: script, section,
    seconds. Items come round in order of pos until the section is full; the last segment is
    cut. By rule:

    * even: every item plays as long, an equal share of the section but 1.5 seconds at least.
      openings (script, section, path) play before for 3 seconds, and such an item comes
      round only where there is no other.
    * whole: clips play whole; images and clips without a length take no part.
    * stills: images play 2.5 seconds, clips whole and 0.1 seconds at least.

    Where an item's turns start follows from its place in the round and the round's length,
    so only the segments themselves are made. Sections without usable media or without a
    length have none.
    """
    key, (rest, most) = [script, section], RULES[rule]
    image = F.coalesce(F.col("kind") == "image", F.lit(False))
    m = media.select(*key, "pos", "path", image.alias("_image"), F.col("seconds").cast("double").alias("_own"))
    target = sections.select(*key, F.col("seconds").cast("double").alias("_target")).filter("_target > 0")
    first = None
    if openings is not None:
        first = openings.select(*key, F.col("path").alias("_opening"))
        target = target.join(first, key, "left")
        target = target.withColumn("_base", F.when(F.col("_opening").isNotNull(), F.least(F.lit(C.OPENING_SECONDS), F.greatest("_target", F.lit(0.1)))).otherwise(0.0))
        # Without another item the opening comes round.
        m = m.join(first, key, "left").withColumn("_again", F.coalesce(F.col("path") == F.col("_opening"), F.lit(False)))
        m = m.withColumn("_others", F.min("_again").over(Window.partitionBy(*key))).filter(~F.col("_again") | F.col("_others")).drop("_opening", "_again", "_others")
    else:
        target = target.withColumn("_base", F.lit(0.0))
    if rule == "whole":
        m = m.filter(~F.col("_image") & (F.col("_own") > 0))
    m = m.join(target, key)
    n, i = F.count("*").over(Window.partitionBy(*key)), F.row_number().over(Window.partitionBy(*key).orderBy("pos", "path")) - 1
    m = m.withColumn("_n", n).withColumn("_i", i)
    step = {
        "even": F.greatest((F.col("_target") - F.col("_base")) / F.col("_n"), F.lit(C.LEAST_SEGMENT)),
        "whole": F.col("_own"),
        "stills": F.when(F.col("_image"), F.lit(C.STILL_SECONDS)).otherwise(F.greatest(F.coalesce("_own", F.lit(0.0)), F.lit(0.1))),
    }[rule]
    m = m.withColumn("_step", step).withColumn("_round", F.sum("_step").over(Window.partitionBy(*key)))
    m = m.withColumn("_first", F.col("_base") + F.coalesce(F.sum("_step").over(_before(key, "_i")), F.lit(0.0)))
    room = F.col("_target") - F.lit(rest)
    turns = F.ceil((room - F.col("_first")) / F.col("_round")).cast("int")
    if most is not None:
        turns = F.least(turns, F.floor((most(F.col("_n")) - 1 - F.col("_i")) / F.col("_n")).cast("int") + 1)
    each = m.filter(F.col("_first") < room).select("*", F.explode(F.sequence(F.lit(0), turns)).alias("_turn"))
    start = F.col("_first") + F.col("_turn") * F.col("_round")
    number = F.col("_turn") * F.col("_n") + F.col("_i")
    each = each.withColumn("start", start).withColumn("segment", number.cast("long")).filter(F.col("start") < room)
    if most is not None:
        each = each.filter(F.col("segment") < most(F.col("_n")))
    out = each.select(*key, "segment", "path", "start", F.least("_step", F.col("_target") - F.col("start")).alias("length"))
    if first is None:
        return out
    opened = target.filter("_opening is not null")
    before = opened.select(*key, F.lit(0).cast("long").alias("segment"), F.col("_opening").alias("path"), F.lit(0.0).alias("start"), F.col("_base").alias("length"))
    later = out.join(opened.select(*key, F.lit(1).alias("_one")), key, "left").withColumn("segment", F.col("segment") + F.coalesce("_one", F.lit(0)))
    return before.unionByName(later.drop("_one"))


def clean_narration(sections: DataFrame, script: str, section: str, text: str) -> DataFrame:
    """One narration for each script: sections in order, without blank ones and template openings."""
    t = F.trim(F.coalesce(F.col(text), F.lit("")))
    kept = sections.withColumn("_t", t).filter(F.col("_t") != "")
    for opening in C.TEMPLATE_OPENINGS:
        kept = kept.filter(~F.col("_t").startswith(opening))
    parts = F.array_sort(F.collect_list(F.struct(section, "_t")))
    return kept.groupBy(script).agg(F.array_join(F.transform(parts, lambda x: x["_t"]), "  ...  ").alias("narration"))


def srt_text(cues: DataFrame, script: str) -> DataFrame:
    """One caption file's text for each script from (cue, start_ms, end_ms, text)."""
    span = F.concat(N.srt_time(F.col("start_ms")), F.lit(" --> "), N.srt_time(F.col("end_ms")))
    block = F.concat(F.col("cue").cast("string"), F.lit("\n"), span, F.lit("\n"), F.col("text"), F.lit("\n\n"))
    blocks = cues.withColumn("_b", block).groupBy(script).agg(F.array_sort(F.collect_list(F.struct("cue", "_b"))).alias("b"))
    return blocks.select(script, F.array_join(F.transform("b", lambda x: x["_b"]), "").alias("srt"))


def caption_coverage(cues: DataFrame, script: str, total_ms: str) -> DataFrame:
    """Cues of each script, the percentage of its length that they reach, and whether that is below 85."""
    per = cues.groupBy(script).agg(F.count("*").alias("n_cues"), F.max("end_ms").alias("last_ms"), F.max(total_ms).alias("total"))
    share = N.rounded(F.col("last_ms") / F.col("total") * 100.0)
    return per.select(script, "n_cues", share.alias("coverage"), (share < 85).alias("short"))
