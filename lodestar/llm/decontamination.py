"""Benchmark decontamination: a prefix-filtered set join in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, free_name

#: Consecutive item words of a window.
WINDOW = 10
#: Words of a shingle, the token that windows are found by.
SHINGLE = 3
#: A side of at most this many bytes is broadcast; beyond it positions are joined by a shuffle.
BROADCAST_BYTES = 64 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: everything in ASCII but letters and digits.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text with A-Z lower-cased; the first and last may be empty strings."""
    ascii_only = F.length(text) == F.octet_length(text)
    lowered = lambda w: F.when(F.length(w) == F.octet_length(w), F.lower(w)).otherwise(F.translate(w, _UPPER, _LOWER))
    text = F.coalesce(text, F.lit(""))
    return F.when(ascii_only, F.split(F.lower(text), _BETWEEN)).otherwise(F.transform(F.split(text, _BETWEEN), lowered))


def _count(w: str) -> Column:
    """Words of an array without the empty strings at its ends."""
    ends = (F.get(w, F.lit(0)) == "").cast("int") + ((F.size(w) > 1) & (F.element_at(w, -1) == "")).cast("int")
    return (F.size(w) - ends).cast("long")


def _is_small(df: DataFrame, row_bytes: Column) -> bool:
    """Whether df, of rows of row_bytes and 64 bytes more in a table of hashes, is within the bound of a broadcast."""
    return (df.agg(F.sum(row_bytes + 64)).first()[0] or 0) <= BROADCAST_BYTES


def _shingles(df: DataFrame, sizes: list[int], *keep: str) -> DataFrame:
    """One row for each position of the word array `w` and shingle size: keep, pos, size, h."""
    at = df.select(*keep, "w", F.posexplode("w").alias("pos", "word"))
    hashed = [
        F.struct(F.lit(k).alias("size"), F.xxhash64(F.lit(k), "word", *(F.get("w", F.col("pos") + i) for i in range(1, k))).alias("h"))
        for k in sizes
    ]
    if len(sizes) > 1:
        at = at.withColumn("s", F.explode(F.array(*hashed))).select("*", "s.size", "s.h")
    else:
        at = at.select("*", F.lit(sizes[0]).alias("size"), hashed[0]["h"].alias("h"))
    return at


def windows_of(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(words, n, item) for each window of each item."""
    w = items.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.filter(words(F.col(f"`{text}`")), lambda x: x != "").alias("w"))
    n = F.least(F.size("w"), F.lit(WINDOW))
    starts = F.sequence(F.lit(0), F.size("w") - n)
    each = w.filter(F.size("w") > 0).select("item", "w", n.alias("n"), F.explode(starts).alias("start"))
    return each.select("item", F.slice("w", F.col("start") + 1, F.col("n")).alias("words"), "n").distinct()


def numbered(windows: DataFrame) -> DataFrame:
    """(window, words, n): the distinct windows with numbers of their own."""
    distinct = windows.select("words", "n").distinct()
    return checkpointed(distinct.withColumn("window", F.monotonically_increasing_id()))


def hits(docs: DataFrame, windows: DataFrame, *keep: str) -> DataFrame:
    """Occurrences of windows in documents: keep, start, n, window.

    docs has the columns `keep`, which tell its texts apart, and a word array `w`; windows
    has window, words and n. A window lies in a document only if all its shingles do, so it
    is enough to look it up by one of them: shingles are ordered by how often they occur in
    the documents, and the rarest of each window is its prefix. A window with a shingle
    that occurs nowhere is dropped. An occurrence of the prefix is kept if the whole window
    fits between the ends of the document around it, and then compared word by word.

    Prefixes within the bound of a broadcast meet the documents where these are read. More
    of them are joined to the bare positions by a shuffle, and the words fetched after that.
    """
    sizes = sorted(r["k"] for r in windows.select(F.least("n", F.lit(SHINGLE)).alias("k")).distinct().collect())
    if not sizes:
        return docs.select(*keep, F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("window")).limit(0)
    inside = _shingles(windows.withColumnRenamed("words", "w"), sizes, "window", "n")
    inside = inside.filter((F.col("size") == F.least("n", F.lit(SHINGLE))) & (F.col("pos") + F.col("size") <= F.col("n")))
    inside = checkpointed(inside.select("window", "n", "pos", "h"))
    spread = _shingles(docs, sizes, *keep)
    wanted = checkpointed(inside.select("h").distinct())
    wanted = F.broadcast(wanted) if _is_small(wanted, F.lit(8)) else wanted
    rarity = checkpointed(spread.select("h").join(wanted, "h").groupBy("h").agg(F.count("*").alias("times")))
    ranked = inside.join(rarity, "h", "left").groupBy("window").agg(
        F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "h", "pos")).alias("rarest")
    )
    prefixes = ranked.filter("rarest.times > 0").join(windows.select("window", "words", "n"), "window")
    prefixes = checkpointed(prefixes.select("window", "words", "n", F.col("rarest.h").alias("h"), F.col("rarest.pos").alias("offset")))
    start = (F.col("pos") - F.col("offset")).alias("start")
    if _is_small(prefixes, F.octet_length(F.array_join("words", "")) + 16 * F.size("words")):
        met = spread.join(F.broadcast(prefixes), "h").select(*keep, "w", start, "n", "window", "words")
    else:
        bare = prefixes.select("h", "offset", "n", "window")
        found = spread.select(*keep, "pos", "h").join(bare, "h").filter("pos >= offset").select(*keep, start, "n", "window").distinct()
        found = found.join(windows.select("window", "words"), "window")
        found = found.select(*(F.col(c).alias(f"of_{c}") if c in keep else F.col(c) for c in found.columns))
        same = F.lit(True)
        for c in keep:
            same = same & F.col(c).eqNullSafe(F.col(f"of_{c}"))
        met = docs.select(*keep, "w").join(found, same).select(*keep, "w", "start", "n", "window", "words")
    fits = (F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.size("w"))
    same = F.slice("w", F.col("start") + 1, F.col("n")) == F.col("words")
    return met.filter(F.when(fits, same).otherwise(False)).select(*keep, "start", "n", "window")


def _covered(spans: Column) -> Column:
    """How many positions the sorted (start, n) spans cover together."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
    add = lambda acc, s: F.struct(
        F.greatest(acc["end"], s["start"] + s["n"]).alias("end"),
        (acc["total"] + F.greatest(F.lit(0), s["start"] + s["n"] - F.greatest(acc["end"], s["start"]))).alias("total"),
    )
    return F.aggregate(F.array_sort(spans), start, add, lambda acc: acc["total"].cast("long"))


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, mark, n_words, n_hit, n_items, items_sha256, contaminated.

    `mark` is a hash of the text. Null and empty texts have no words and no hits; null and
    empty items have no window. Repeated rows each get a row with the same figures; ids may
    be null or repeat, rows with one id and different texts are kept apart by their marks.
    Items without an id count for n_hit but not for n_items. An empty table on either side
    gives no hits. Very long texts are read whole; of equally rare shingles of a window the
    first by hash and place finds it, which changes no result. Extra columns are ignored.
    """
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(text).alias("mark"), words(F.col(text)).alias("w"))
    all_windows = checkpointed(windows_of(items))
    distinct = numbered(all_windows)
    found = checkpointed(hits(slim, distinct, "doc_id", "mark").distinct())
    spans = found.select("doc_id", "mark", "start", "n").distinct()
    n_hit = spans.groupBy("doc_id", "mark").agg(_covered(F.collect_list(F.struct("start", "n"))).alias("n_hit"))
    per_item = found.select("doc_id", "mark", "window").distinct().join(all_windows.join(distinct, ["words", "n"]).select("window", "item"), "window")
    listed = per_item.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set("item")).alias("listed"))
    hit = n_hit.join(
        listed.select(F.col("doc_id").alias("l_id"), F.col("mark").alias("l_mark"), "listed"),
        F.col("doc_id").eqNullSafe(F.col("l_id")) & (F.col("mark") == F.col("l_mark")),
        "left",
    ).select(F.col("doc_id").alias("h_id"), F.col("mark").alias("h_mark"), "n_hit", "listed")
    out = slim.select("doc_id", "mark", _count("w").alias("n_words"))
    out = out.join(hit, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("mark") == F.col("h_mark")), "left")
    listed = F.coalesce("listed", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id",
        "mark",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents in which no window of an item occurs, with all their columns.

    Null and empty texts stay, as they have no words; null and empty items take nothing
    away. Repeated rows stay or go together; ids may be null or repeat, and rows with one
    id and different texts are judged apart. An empty table of documents gives no rows, one
    of items keeps all. Very long texts are read whole. Extra columns may have any names.
    """
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(text).alias("mark"), words(F.col(text)).alias("w"))
    found = hits(slim, numbered(windows_of(items)), "doc_id", "mark").select(F.col("doc_id").alias("hit_id"), F.col("mark").alias("hit_mark"))
    found = checkpointed(found.distinct())
    mark = free_name(docs, "mark")
    marked = docs.withColumn(mark, F.xxhash64(text))
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col("hit_id")) & (F.col(mark) == F.col("hit_mark"))
    return marked.join(found, same, "left_anti").select(*docs.columns)
