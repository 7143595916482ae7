"""SimHash near-duplicates, linked through multi-index hashing, and near copies by their sets of shingles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bitmaps import bitmap, has
from .common import checkpointed, free_name
from .components import components

#: Bands of a text's set of shingles and minima of each. At a Jaccard similarity of 0.8 some band is equal with probability 0.999.
BANDS, ROWS = 24, 6
#: Bits of two sketches in which candidates may differ: pairs at 0.8 differ in 58 on average, 0.997 of them in 88 or fewer.
APART = 88
#: Sets outside a large band's main group that one part of its comparisons holds.
PART = 1024

#: A segment value with more fingerprints than this is linked through ball centres instead of pairs.
BUCKET = 64
_LOW = (1 << 32) - 1


def _hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of all word shingles of a text; fewer words than a shingle are one, no words none."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.fromiter(map(len, words), dtype=np.int64, count=len(words)).cumsum() + np.arange(len(words))
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    stops = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], 42) for s, e in zip(starts, stops)], dtype=np.uint64)


def _majority(hashes: np.ndarray) -> int:
    """The bits that over half the hashes set, as an unsigned number; 0 for no hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):  # a block at a time: bits need eight times the room of hashes
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8))
        ones += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint_of(text: bytes | None, shingle: int) -> int:
    """The 64-bit SimHash of a text as an unsigned number; 0 where there are no words."""
    return _majority(_hashes(text, shingle))


_DRAWN = np.random.default_rng(42).integers(0, 1 << 32, (2, BANDS * ROWS, 1), dtype=np.uint32)


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles, in order."""
    return np.unique(_hashes(text, shingle))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least values of a set of hashes under BANDS * ROWS different orders."""
    least = np.full(BANDS * ROWS, (1 << 32) - 1, dtype=np.uint32)
    mixed = hashes.astype(np.uint32) ^ (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(mixed), 1 << 12):  # a block at a time, for long texts
        z = (mixed[at : at + (1 << 12)] ^ _DRAWN[0]) * (_DRAWN[1] | np.uint32(1))
        z = (z ^ (z >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        least = np.minimum(least, (z ^ (z >> np.uint32(12))).min(axis=1))
    return least


def bands_of(least: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band: a hash of its ROWS minima."""
    keys = [xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def sketch_of(least: np.ndarray) -> list[int]:
    """Four bits of each minimum, sixteen of them in a signed 64-bit number."""
    nibbles = (least & np.uint32(15)).astype(np.uint8)
    return (nibbles[::2] | nibbles[1::2] << 4).view("<i8").tolist()


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """SimHash over word shingles of a text column, as a signed long.

    A-Z are lower-cased; words are runs of anything but ASCII white space; each shingle,
    repeats included, is hashed with XXH64 (seed 42); a bit is set where over half the
    hashes set it. Fewer words than a shingle count as one shingle. Null, empty and blank
    texts give 0.
    """

    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        values = texts.cast(pa.large_binary())
        return pa.array(np.fromiter((fingerprint_of(v.as_py(), shingle) for v in values), dtype=np.uint64, count=len(values)).view(np.int64))

    return simhash(text)


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints at 2 or fewer differing bits.

    prints: one row per distinct long `fp`. Multi-index hashing: a fingerprint has a high
    and a low segment of 32 bits. A pair at distance 2 or less differs in at most one bit
    of the high segment, or in two there and in none of the low one. So high segments are
    looked up within a Hamming ball of radius 1 and low segments exactly, and the whole
    distance is verified. Of two values one bit apart one has that bit set, so only balls
    of cleared bits are enumerated.

    Segment values that more than `bucket` fingerprints share would make pairs in
    proportion to the square of their number. All fingerprints that hold or probe such a
    value are linked exactly by another way: two fingerprints are at most 2 bits apart if
    and only if the balls of radius 1 around them meet, so each is put under the 65 points
    of its own ball, and those under one point (65 at most) are linked to the smallest.
    """
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(_LOW))
    tag = F.lit(1 << 40)
    cleared = F.expr(
        "transform(filter(sequence(0, 31), i -> (shiftrightunsigned(fp, 32 + i) & 1L) = 1L), "
        "i -> shiftrightunsigned(fp, 32) - shiftleft(1L, i))"
    )
    exact = F.array(F.struct(high.alias("key"), F.lit(True).alias("holds")), F.struct((low + tag).alias("key"), F.lit(True).alias("holds")))
    near = F.transform(cleared, lambda k: F.struct(k.alias("key"), F.lit(False).alias("holds")))
    probes = prints.select("fp", F.explode(F.concat(exact, near)).alias("p")).select("fp", "p.key", "p.holds")
    table = prints.select("fp", F.explode(F.array(high, low + tag)).alias("key"))
    full = table.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > bucket).select("key")
    full = checkpointed(full)
    small = table.join(full, "key", "left_anti").withColumnRenamed("fp", "other")
    pairs = (
        probes.join(small, "key")
        .filter((F.col("fp") != F.col("other")) & (~F.col("holds") | (F.col("fp") < F.col("other"))))
        .filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= 2)
        .select(F.col("fp").alias("a"), F.col("other").alias("b"))
    )
    if full.isEmpty():
        return pairs
    hot = probes.join(full, "key", "left_semi").select("fp").distinct()
    centres = hot.select(
        "fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")).alias("centre")
    )
    met = centres.groupBy("centre").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    stars = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b").distinct()
    return pairs.union(stars)


def groups(prints: DataFrame) -> DataFrame:
    """(fp, root, component_id) for each distinct fingerprint; prints has doc_id and fp.

    component_id is the smallest doc_id among the documents reachable over links, null
    only if none of them has an id.
    """
    distinct = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = components(links(distinct.select("fp")))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3) -> DataFrame:
    """One row per document: doc_id, fp (long), component_id.

    Null, empty and blank texts have the fingerprint 0 and are linked like any other.
    Repeated rows and repeated ids each keep their row; ties go to the smallest id. Very long
    texts are read whole. An empty table gives no rows. Extra columns are ignored, whatever
    their names.
    """
    prints = checkpointed(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text), shingle).alias("fp")))
    return prints.join(groups(prints), "fp").select("doc_id", "fp", "component_id")


def _banded(text: Column, shingle: int) -> Column:
    """A struct of a text: its SimHash fp, and of its set of shingles id (a hash of the set), size, keys of its bands and sketch."""
    kind = pa.struct([("fp", pa.int64()), ("id", pa.int64()), ("size", pa.int64()), ("keys", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])

    @F.arrow_udf("struct<fp: long, id: long, size: long, keys: array<long>, sketch: array<long>>")
    def banded(texts: pa.Array) -> pa.Array:
        out = []
        for v in texts.cast(pa.large_binary()):
            every = _hashes(v.as_py(), shingle)
            hashes = np.unique(every)
            own = int.from_bytes(xxhash.xxh64_digest(hashes.tobytes()), "big", signed=True)
            least = minima(hashes)
            fp = int(np.uint64(_majority(every)).view(np.int64))
            out.append({"fp": fp, "id": own, "size": len(hashes), "keys": bands_of(least) if len(hashes) else [], "sketch": sketch_of(least)})
        return pa.array(out, kind)

    return banded(text)


def shingles_of(docs: DataFrame, id_type: T.DataType, bits: np.ndarray, shingle: int) -> DataFrame:
    """(doc_id, mark, hashes) of the documents whose slot is in a bitmap, a few more than asked for; no text is shuffled.

    docs: doc_id, mark, slot (a hash), text. Of each hash of a shingle 32 bits are kept: of
    two texts of n and m words, n * m / 2**32 unequal shingles agree by chance.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = batch.column(2).to_numpy()
            rows = np.nonzero(has(shared.value, slots))[0]
            texts = batch.column(3).cast(pa.large_binary())
            sets = [np.unique(shingle_set(texts[int(i)].as_py(), shingle).astype(np.uint32)).view(np.int32) for i in rows]
            taken = batch.select([0, 1]).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(sets, pa.list_(pa.int32()))], names=["doc_id", "mark", "hashes"])

    fields = [("doc_id", id_type), ("mark", T.LongType()), ("hashes", T.ArrayType(T.IntegerType()))]
    return docs.mapInArrow(read, T.StructType([T.StructField(*f) for f in fields]))


def _in_bitmap(slots: Column, shared: Broadcast) -> Column:
    """Whether a broadcast bitmap holds the slots."""

    @F.arrow_udf("boolean")
    def held(values: pa.Array) -> pa.Array:
        return pa.array(has(shared.value, values.to_numpy()))

    return held(slots)


def _alike(x: str, y: str) -> Column:
    """Sizes and sketches of two sets allow a similarity of 0.8; x and y are suffixes of columns."""
    least, most = F.least(f"size{x}", f"size{y}"), F.greatest(f"size{x}", f"size{y}")
    bits = lambda k: F.bit_count(F.get(f"sketch{x}", F.lit(k)).bitwiseXOR(F.get(f"sketch{y}", F.lit(k))))
    differ = sum((bits(k) for k in range(1, BANDS * ROWS // 16)), bits(0))
    return (5 * least >= 4 * most) & (differ <= APART)


def _as(df: DataFrame, end: str, *keep: str) -> DataFrame:
    """df with an ending on the names of all its columns but `keep`."""
    return df.select(*(F.col(c) if c in keep else F.col(c).alias(c + end) for c in df.columns))


def fingerprint_pairs(held: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of sets whose SimHash fingerprints are equal or link (see links()).

    held: fp, id; a set has a fingerprint for each way its shingles are repeated. Of the
    sets under one fingerprint that with the smallest id meets the others and those of
    fingerprints linked to it, so a fingerprint that very many sets have costs their number.
    """
    held = checkpointed(held.distinct())
    heads = checkpointed(held.groupBy("fp").agg(F.min("id").alias("head")))
    same = held.join(heads, "fp").select(F.col("head").alias("a"), F.col("id").alias("b"))
    a, b = (heads.select(F.col("fp").alias(k), F.col("head").alias(f"head_{k}")) for k in "ab")
    linked = links(heads.select("fp")).join(a, "a").join(b, "b")
    linked = linked.select(F.least("head_a", "head_b").alias("a"), F.greatest("head_a", "head_b").alias("b"))
    return same.union(linked).filter("a < b").distinct()


def near_links(prints: DataFrame, sets: Callable[[DataFrame], DataFrame], by_fingerprint: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between sets of shingles whose Jaccard similarity is 0.8 or more.

    prints: one row for each distinct set: id, size, keys of its bands, sketch. sets(ids)
    gives (id, hashes) for the ids asked for. by_fingerprint (a, b): candidates whose
    SimHash fingerprints link. Sets that share a band are candidates as well, for pairs that
    fingerprints tell apart, if their sizes and sketches allow it (0.996 of the pairs at
    0.8, more above); an edge stands only if the sets themselves are that similar.

    Bands that over `bucket` sets share are first compared with one set alone, that which
    shares most bands with others, so a group of near copies costs its size. Sets that
    edges connect already need no edge of their own: of each band only those outside its
    largest component are compared with all in the band, dealt out in parts by their
    number, so no candidate is left out.
    """
    table = prints.select("id", F.explode("keys").alias("key"))
    counted = checkpointed(table.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    met = checkpointed(table.join(counted, "key").join(prints.select("id", "size", "sketch"), "id"))

    def similar(found: DataFrame) -> DataFrame:
        found = checkpointed(found.distinct())
        hashes = checkpointed(sets(found.select(F.col("a").alias("id")).union(found.select("b")).distinct()))
        x, y = (hashes.select(F.col("id").alias(k), F.col("hashes").alias(f"set_{k}")) for k in "ab")
        both = F.size(F.array_intersect("set_a", "set_b"))
        alike = found.join(x, "a").join(y, "b").filter(9 * both >= 4 * (F.size("set_a") + F.size("set_b")))
        return checkpointed(alike.select("a", "b"))

    small, full = met.filter(F.col("n") <= bucket).drop("n"), met.filter(F.col("n") > bucket)
    pairs = _as(small, "_a", "key").join(_as(small, "_b", "key"), "key").filter((F.col("id_a") < F.col("id_b")) & _alike("_a", "_b"))
    pairs = pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    known = full.groupBy("id").agg(F.sum("n").alias("known"))
    heads = full.select("id", "key").join(known, "id").groupBy("key").agg(F.max(F.struct("known", "id"))["id"].alias("head"))
    led = full.join(heads, "key").filter("id <> head").select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b"))
    edges = similar(by_fingerprint.union(pairs).union(led))
    if full.isEmpty():
        return edges
    roots = components(edges)
    rooted = full.join(roots, full.id == roots.node, "left").select("key", "id", "size", "sketch", F.coalesce("root", "id").alias("root"))
    rooted = checkpointed(rooted)
    groups_ = rooted.groupBy("key", "root").agg(F.count("*").alias("n"))
    main = groups_.groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"))
    parts = F.ceil((F.col("n") - F.col("most")) / PART).cast("int")
    members = rooted.join(main.filter("n > most").select("key", "main", parts.alias("parts")), "key")
    rest = members.filter("root <> main").withColumn("part", F.pmod(F.hash("id"), F.col("parts")))
    every = members.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("main", "parts")
    apart = (F.col("root_a") != F.col("root_b")) & ((F.col("root_b") == F.col("main_a")) | (F.col("id_a") < F.col("id_b")))
    more = _as(rest, "_a", "key", "part").join(_as(every, "_b", "key", "part"), ["key", "part"]).filter(apart & _alike("_a", "_b"))
    return edges.union(similar(more.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5) -> DataFrame:
    """The documents without near-duplicates: of each group the row with the smallest doc_id stays.

    Groups are what near_links() connects: texts whose sets of shingles have a Jaccard
    similarity of 0.8 or more, found by multi-index hashing of their SimHash fingerprints
    and, where those differ in more than 2 bits, by bands of minima. All columns are kept. Null, empty and blank texts are one
    group. Of repeated rows with the smallest id one stays; of a group without ids, one
    row. An empty table gives no rows. Only texts that a bitmap of those that may go holds
    are shuffled; the others stay where they are read.
    """
    mark, row, kept_id, kept_mark, place = (free_name(docs, x) for x in ("mark", "row_of_group", "kept_id", "kept_mark", "slot"))
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(f"`{text}`").alias("text"))
    slim = checkpointed(own.select("doc_id", "mark", _banded(F.col("text"), shingle).alias("s")).select("doc_id", "mark", "s.*"))
    # A set's documents become one row: a large group of copies is no large key.
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")).alias("least")
    first_of = [F.first(c).alias(c) for c in ("size", "keys", "sketch")]
    prints = checkpointed(slim.groupBy("id").agg(*first_of, least))
    slot = F.xxhash64("doc_id", "mark")

    def sets(ids: DataFrame) -> DataFrame:
        """The sets of some ids, made anew from one text of each."""
        wanted = prints.join(ids, "id").select("id", "least.doc_id", "least.mark")
        wanted = checkpointed(wanted.withColumn("slot", slot))
        read = shingles_of(own.select("doc_id", "mark", slot.alias("slot"), "text"), docs.schema[doc_id].dataType, bitmap(wanted.select("slot")), shingle)
        wanted = wanted.select("id", F.col("doc_id").alias("w_id"), F.col("mark").alias("w_mark"))
        met = read.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("mark") == F.col("w_mark")))
        return met.groupBy("id").agg(F.first("hashes").alias("hashes"))

    roots = components(near_links(prints, sets, fingerprint_pairs(slim.select("fp", "id"))))
    firsts = prints.select("id", "least").join(roots, F.col("id") == F.col("node"), "left")
    first = firsts.groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("least").alias("least"))
    first = checkpointed(first.select(F.col("least.doc_id").alias(kept_id), F.col("least.mark").alias(kept_mark)))
    times = slim.groupBy("doc_id", "mark").agg(F.count("*").alias("n"))
    stays = (F.col("mark") == F.col(kept_mark)) & F.col("doc_id").eqNullSafe(F.col(kept_id))
    # What is not the first of its group, or is repeated, is decided by joining; every other row stays.
    unsure = times.filter("n > 1").select("doc_id", "mark").union(times.select("doc_id", "mark").join(first, stays, "left_anti"))
    maybe = _in_bitmap(F.col(place), docs.sparkSession.sparkContext.broadcast(bitmap(unsure.select(slot.alias("slot")))))
    marked = docs.withColumn(mark, F.xxhash64(text)).withColumn(place, F.xxhash64(F.col(f"`{doc_id}`"), mark))
    same = (F.col(mark) == F.col(kept_mark)) & F.col(f"`{doc_id}`").eqNullSafe(F.col(kept_id))
    stay = marked.filter(maybe).join(first, same)
    order = Window.partitionBy(f"`{doc_id}`", mark).orderBy(F.lit(0))
    joined = stay.withColumn(row, F.row_number().over(order)).filter(F.col(row) == 1)
    return marked.filter(~maybe).select(*docs.columns).union(joined.select(*docs.columns))
