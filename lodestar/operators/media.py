"""Media: duplicates against a history, renditions, quotas, pool fill and repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import urls as U
from ..sources.folders import settled
from .fingerprints import near_dup_clips, near_stored_clips
from .gates import limit_reason


def anti_used(media: DataFrame, history: DataFrame, key: Column, kind: str) -> DataFrame:
    """Media whose key is not in the history under the given kind. history: media_type, key_kind, key_value."""
    used = history.filter(F.col("key_kind") == kind).select("key_value").distinct()
    return media.withColumn("_key", key).join(used, F.col("_key") == F.col("key_value"), "left_anti").drop("_key")


def upsert_history(history: DataFrame, new: DataFrame) -> DataFrame:
    """Both histories, each entry once."""
    return history.unionByName(new).dropDuplicates(["media_type", "key_kind", "key_value"])


def dedupe_media(media: DataFrame, history: DataFrame, frames: DataFrame | None = None, index: str | None = None) -> DataFrame:
    """Each item with the first reason that speaks against it; null means accepted.

    Cheap checks stand before dear ones: used address, blocked domain, limits, used
    content, an earlier item with the same address, one with the same content, and, with
    frames (media_id, frame, h), one that at least half of the frames are near to. Earlier
    means a smaller id among items that pass all checks before. Items without an address
    or hash are no repeats of each other by it.

    With index, the path of an index of stored fingerprints, items near to one of those are
    refused as well ("used fingerprint"); they still count as earlier items, since whatever
    was looked at counts, accepted or not.
    """
    m = media.withColumn("canonical", U.canonical_url(F.col("url")))
    urls = history.filter("key_kind = 'url'").select(F.col("key_value").alias("canonical"), F.lit(True).alias("url_used")).distinct()
    hashes = history.filter("key_kind = 'hash'").select(F.col("key_value").alias("sha"), F.lit(True).alias("hash_used")).distinct()
    m = m.join(urls, "canonical", "left").join(hashes, "sha", "left")
    reason = (
        F.when(F.col("url_used"), "used url")
        .when(~U.domain_not_blocked(F.col("url")), "blocked domain")
        .otherwise(limit_reason(F.col("duration"), F.col("size")))
    )
    m = m.withColumn("reason", F.coalesce(reason, F.when(F.col("hash_used"), "used hash")))
    for column, name in (("canonical", "duplicate url"), ("sha", "duplicate hash")):
        # Missing values are groups of their own: no repeats, and no large group.
        known = F.coalesce(F.col(column), F.lit("")) != ""
        w = Window.partitionBy(column, F.when(~known, F.col("media_id")), F.col("reason").isNull()).orderBy("media_id")
        again = F.col("reason").isNull() & known & (F.row_number().over(w) > 1)
        m = m.withColumn("_again", again).withColumn("reason", F.coalesce("reason", F.when(F.col("_again"), name))).drop("_again")
    m = m.drop("url_used", "hash_used")
    if frames is None:
        return m
    # Both are read several times below.
    m = settled(m)
    looked_at = m.filter("reason is null").select(F.col("media_id").alias("_seen"))
    seen = settled(frames.join(looked_at, F.col("media_id") == F.col("_seen"), "left_semi"))
    near = near_dup_clips(seen, "media_id", "frame", "h").filter("b_clip < a_clip").select(F.col("a_clip").alias("_near")).distinct()
    m = m.join(near, F.col("media_id") == F.col("_near"), "left")
    m = m.withColumn("reason", F.when(F.col("_near").isNotNull(), "near duplicate").otherwise(F.col("reason"))).drop("_near")
    if index is None:
        return m
    used = near_stored_clips(seen, index, "media_id", "frame", "h").select(F.col("a_clip").alias("_used")).distinct()
    m = m.join(used, F.col("media_id") == F.col("_used"), "left")
    return m.withColumn("reason", F.when(F.col("_used").isNotNull(), "used fingerprint").otherwise(F.col("reason"))).drop("_used")


def select_best_file(files: DataFrame, key: str, portrait: int = C.TARGET_AREA, landscape: int = C.TARGET_AREA) -> DataFrame:
    """The best rendition of each item: large enough, hd, least oversized, nearest to the target area of its own orientation.

    files: link, width, height, quality. Square ones count as portrait.
    """
    usable = files.filter((F.coalesce(F.col("link"), F.lit("")) != "") & (F.col("width") > 0) & (F.col("height") > 0))
    area, target = (F.col("width") * F.col("height")).cast("double"), F.when(F.col("height") >= F.col("width"), float(portrait)).otherwise(float(landscape))
    rank = [
        F.desc(area >= target * 0.55),
        F.desc(F.lower(F.col("quality")) == "hd"),
        F.greatest(F.lit(0.0), area / target - 1.25),
        F.abs(area - target),
        F.col("link"),
    ]
    w = Window.partitionBy(key).orderBy(*rank)
    return usable.withColumn("_row", F.row_number().over(w)).filter("_row = 1").drop("_row")


def opening_asset(media: DataFrame, script: str = "script_id") -> DataFrame:
    """The opening of each script by priority: web clip, web image, first section's clip or image, anything.

    media: script, section_id, pos, path.
    """
    m = media.withColumn("_first", F.min("section_id").over(Window.partitionBy(script)))
    kind, web = U.media_kind(F.col("path")), U.source_tier(F.col("path")) == "web"
    here = F.col("section_id") == F.col("_first")
    priority = (
        F.when(web & (kind == "video"), 1)
        .when(web & (kind == "image"), 2)
        .when(here & (kind == "video"), 3)
        .when(here & (kind == "image"), 4)
        .when(kind.isNotNull(), 5)
    )
    m = m.withColumn("_p", priority).filter(F.col("_p").isNotNull())
    best = m.groupBy(script).agg(F.min_by(F.struct("path", "_p"), F.struct("_p", "section_id", "pos", "path")).alias("b"))
    return best.select(script, F.col("b.path").alias("path"), F.col("b._p").alias("priority"))


def media_stats(media: DataFrame, sections: DataFrame, quota: int) -> DataFrame:
    """Clips and images of each section, and whether it is short of its quota."""
    n = media.groupBy("script_id", "section_id").agg(
        F.count_if(F.col("kind") == "video").alias("n_video"), F.count_if(F.col("kind") == "image").alias("n_image")
    )
    all_ = sections.select("script_id", "section_id").join(n, ["script_id", "section_id"], "left").na.fill(0, ["n_video", "n_image"])
    return all_.withColumn("short", (F.col("n_video") + F.col("n_image")) < quota)


def eligible(cands: DataFrame) -> DataFrame:
    """Candidates that their tier may use, with `turn`, the place of their query in its order.

    Web clips (tier 1) come from query 1 only, stock clips (2) from queries 2 to 4, then 1,
    images (3, 4) from queries 1 to 4.
    """
    turn = F.when(F.col("tier") == 2, F.pmod(F.col("query") - 2, F.lit(4))).otherwise(F.col("query") - 1)
    return cands.filter((F.col("tier") != 1) | (F.col("query") == 1)).withColumn("turn", turn.cast("int"))


def quota_first_n(cands: DataFrame, k: int) -> DataFrame:
    """The first k items of each section by tier, its order of queries and pos, no id twice in a script: set-based form.

    cands: script_id, section_id, tier, query, pos, item. An item goes to the first section
    that lists it, then sections are cut at k.
    """
    once = Window.partitionBy("script_id", "item").orderBy("section_id", "tier", "turn", "pos")
    first = eligible(cands).withColumn("_r", F.row_number().over(once)).filter("_r = 1").drop("_r")
    w = Window.partitionBy("script_id", "section_id").orderBy("tier", "turn", "pos", "item")
    return first.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).drop("turn")


def allocate_exact(cands: DataFrame, k: int) -> DataFrame:
    """As quota_first_n, but an item that a section left for its quota can go to a later one.

    Each script is folded on its own, section by section over its list. Earlier sections take at most k items each, so of the
    s-th section only the first k * s distinct items can matter; the others do not reach the
    fold, and a group is bounded by the sections of its script.
    """
    again = Window.partitionBy("script_id", "section_id", "item").orderBy("tier", "turn", "pos")
    order = Window.partitionBy("script_id", "section_id").orderBy("tier", "turn", "pos", "item")
    once = eligible(cands).withColumn("_r", F.row_number().over(again)).filter("_r = 1").withColumn("_place", F.row_number().over(order))
    number = F.row_number().over(Window.partitionBy("script_id").orderBy("section_id")).alias("_s")
    numbers = cands.select("script_id", "section_id").distinct().select("script_id", "section_id", number)
    needed = once.join(numbers, ["script_id", "section_id"]).filter(F.col("_place") <= k * F.col("_s"))
    listed = needed.groupBy("script_id", "section_id").agg(F.array_sort(F.collect_list(F.struct("tier", "turn", "pos", "item"))).alias("x"))
    listed = listed.select("script_id", F.struct("section_id", F.transform("x", lambda x: x["item"]).alias("items")).alias("s"))
    scripts = listed.groupBy("script_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    kinds = dict(cands.dtypes)
    none = f"named_struct('used', cast(array() as array<{kinds['item']}>), 'taken', cast(array() as array<struct<section_id: {kinds['section_id']}, item: {kinds['item']}, place: int>>))"
    # A section takes its first k items that no earlier one took; `own` stands for them.
    step = f"""transform(array(slice(filter(x.items, i -> not array_contains(acc.used, i)), 1, {int(k)})), own -> named_struct('used', concat(acc.used, own),
      'taken', concat(acc.taken, transform(own, (i, p) -> named_struct('section_id', x.section_id, 'item', i, 'place', p + 1)))))[0]"""
    taken = scripts.select("script_id", F.explode(F.expr(f"aggregate(s, {none}, (acc, x) -> {step}, acc -> acc.taken)")).alias("t"))
    taken = taken.select("script_id", "t.section_id", "t.item", "t.place")
    return taken.join(needed, ["script_id", "section_id", "item"]).select("script_id", "section_id", "tier", "query", "pos", "item", "place")


def fill_from_pool(media: DataFrame, sections: DataFrame, images_only: bool = True) -> DataFrame:
    """What sections without media borrow: the k-th of them gets item (k - 1) mod n of the script's pool."""
    pool = media.filter("kind = 'image'") if images_only else media
    w = Window.partitionBy("script_id").orderBy("section_id", "pos", "path")
    n = F.count("*").over(Window.partitionBy("script_id"))
    pool = pool.select("script_id", "path", "kind", (F.row_number().over(w) - 1).alias("slot"), n.alias("n"))
    sizes = pool.select("script_id", "n").distinct()
    has = media.select("script_id", "section_id").distinct()
    empty = sections.select("script_id", "section_id").join(has, ["script_id", "section_id"], "left_anti").join(sizes, "script_id")
    order = Window.partitionBy("script_id").orderBy("section_id")
    empty = empty.withColumn("slot", (F.row_number().over(order) - 1) % F.col("n")).drop("n")
    return empty.join(pool.drop("n"), ["script_id", "slot"]).select("script_id", "section_id", "path", "kind")


def drop_repeated_assets(media: DataFrame) -> DataFrame:
    """Without clips whose path or content an earlier section of the script already has; images pass."""
    clips, others = media.filter("kind = 'video'"), media.filter("kind <> 'video' or kind is null")
    key = F.coalesce("sha", "path")
    by = lambda k: Window.partitionBy("script_id", k).orderBy("section_id", "pos", "path")
    kept = clips.withColumn("_k", key).withColumn("_r", F.row_number().over(by("_k"))).filter("_r = 1")
    kept = kept.withColumn("_r", F.row_number().over(by("path"))).filter("_r = 1").drop("_k", "_r")
    return kept.unionByName(others)
