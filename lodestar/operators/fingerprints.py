"""Near-duplicate 64-bit fingerprints and clips of several frames, within a table and against a stored index."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import numbers as N
from ..sources.folders import settled

#: 9 bands of 7 or 8 bits; at most 6 flipped bits leave 3 of them intact, so 84 keys of about 21 bits find every pair.
_BANDS = [(0, 8), *((8 + 7 * i, 7) for i in range(8))]
#: Bands of the stored index: at most 6 flipped bits leave one of 4 with one flip at most.
STORED_BANDS, STORED_BITS = 4, 16
#: Folders of each stored band, and of the stored owners.
CELLS = 64
#: A key is cut again where its two sides would make more than this many pairs for each of their hashes.
FULL = 16


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _mask(bands: list[tuple[int, int]]) -> int:
    return _signed(sum(((1 << n) - 1) << at for at, n in bands))


def _keyed(hashes: DataFrame, masks: list[int]) -> DataFrame:
    """(h, mask, value): each hash under its bits in every mask."""
    keys = F.array(*(F.struct(F.lit(m).cast("long").alias("mask"), F.col("h").bitwiseAND(F.lit(m)).alias("value")) for m in masks))
    return hashes.select("h", F.explode(keys).alias("key")).select("h", "key.mask", "key.value")


def _cut(rows: DataFrame) -> DataFrame:
    """Rows (h, mask, value) under 7 finer keys, with the key they had: 6 flips among the free bits leave one of 7 groups of them intact."""
    groups = C.NEAR_BITS + 1
    free = "filter(sequence(0, 63), i -> (shiftright(mask, i) & 1L) = 0)"
    edge = lambda g: f"cast(({g}) * size(free) div {groups} as int)"
    own = f"slice(free, 1 + {edge('g')}, {edge('g + 1')} - {edge('g')})"
    bits = f"transform(sequence(0, {groups - 1}), g -> aggregate({own}, 0L, (m, i) -> m | shiftleft(1L, i)))"
    finer = rows.withColumn("free", F.expr(free)).withColumn("bits", F.explode(F.expr(bits)))
    mask, value = F.col("mask").bitwiseOR(F.col("bits")), F.col("value").bitwiseOR(F.col("h").bitwiseAND(F.col("bits")))
    return finer.select("h", mask.alias("mask"), value.alias("value"), F.col("mask").alias("of_mask"), F.col("value").alias("of_value"))


def _met(a: DataFrame, b: DataFrame) -> DataFrame:
    """(h, other): hashes of a and b (h, mask, value) that share a key; those of a cut key only where they share a finer one.

    A key that would make many pairs is cut by 7 groups of its free bits, and its parts
    again: what differs in at most 6 of the free bits meets at every step. It is cut only
    where that at least halves the pairs. So the steps end; what is not cut any more, like
    hashes that are all near to each other, makes about the pairs that are to be found.

    Sides are merged, never broadcast: Spark takes a table for as large as it was before its
    rows were given dozens of keys each, and the driver would hold them all.
    """
    keys, own, out = ["mask", "value"], ["of_mask", "of_value"], None

    def products(x: DataFrame, y: DataFrame, *by: str) -> DataFrame:
        n = [rows.groupBy(*by).agg(F.count("*").alias(name)) for rows, name in ((x, "n_a"), (y, "n_b"))]
        return n[0].join(n[1].hint("merge"), [*by]).withColumn("pairs", F.col("n_a") * F.col("n_b"))

    while True:
        full = settled(products(a, b, *keys).filter(F.col("pairs") > FULL * (F.col("n_a") + F.col("n_b"))).select(*keys, "pairs"))
        left, right, ended = a, b, full.isEmpty()
        if not ended:
            finer = [settled(_cut(x.join(full.select(*keys), keys))) for x in ([a] if a is b else [a, b])]
            made = products(finer[0], finer[-1], *own, *keys).groupBy(*own).agg(F.sum("pairs").alias("made"))
            made = made.withColumnsRenamed(dict(zip(own, keys)))
            cut = settled(full.join(made, keys, "left").filter(F.coalesce("made", F.lit(0)) * 2 <= F.col("pairs")).select(*keys))
            left, right = (x.join(cut, keys, "left_anti") for x in (a, b))
            ended = cut.isEmpty()
        met = left.join(right.withColumnRenamed("h", "other").hint("merge"), keys).select("h", "other")
        out = met if out is None else out.union(met)
        if ended:
            return out
        taken = cut.withColumnsRenamed(dict(zip(keys, own)))
        # Cut keys may lead to one finer key: their hashes meet there once.
        finer = [x.join(taken, own, "left_semi").select("h", *keys).distinct() for x in finer]
        a, b = finer[0], finer[-1]


def _near(met: DataFrame) -> DataFrame:
    """(h, other, distance) of the pairs that differ in at most 6 bits, each once."""
    distance = N.hamming(F.col("h"), F.col("other"))
    return met.withColumn("distance", distance).filter(F.col("distance") <= C.NEAR_BITS).distinct()


def near_hashes(hashes: DataFrame, h: str = "h") -> DataFrame:
    """(a, b, distance) of all distinct hashes a < b that differ in at most 6 bits."""
    distinct = hashes.select(F.col(h).alias("h")).filter("h is not null").distinct()
    keyed = _keyed(distinct, [_mask([_BANDS[i] for i in three]) for three in combinations(range(9), 3)])
    near = _near(_met(keyed, keyed).filter("h < other"))
    return near.select(F.col("h").alias("a"), F.col("other").alias("b"), "distance")


def near_dup_pairs(fp: DataFrame, key: str = "vec_id", h: str = "h") -> DataFrame:
    """(a_id, b_id, distance) between the smallest ids of different hashes, a_id < b_id; equal hashes are one class."""
    least = fp.groupBy(F.col(h).alias("h")).agg(F.min(key).alias("id"))
    pairs = near_hashes(fp, h)
    a, b = least.select(F.col("h").alias("a"), F.col("id").alias("ia")), least.select(F.col("h").alias("b"), F.col("id").alias("ib"))
    met = pairs.join(a, "a").join(b, "b")
    return met.select(F.least("ia", "ib").alias("a_id"), F.greatest("ia", "ib").alias("b_id"), "distance")


def _frames(fp: DataFrame, clip: str, frame: str, h: str) -> DataFrame:
    return fp.select(F.col(clip).alias("clip"), F.col(frame).alias("frame"), F.col(h).alias("h")).filter("h is not null").distinct()


def _near_clips(frames: DataFrame, links: DataFrame, owners: DataFrame, same_table: bool) -> DataFrame:
    """(a_clip, b_clip, share): clips of frames with at least half of them near to some frame of b_clip.

    frames: clip, frame, h. links: h, b, hashes that are near or equal. owners: b, b_clip.
    Of n frames at least half hit only if one does among any n - n / 2 + 1; those whose
    near hashes the fewest clips have are taken. Clips meet on them, so a frame that very
    many clips share pairs nothing by itself; all frames of the pairs found are then counted,
    each looked up once by its hash and the other clip, however many near hashes it has.
    """
    total = frames.groupBy("clip").agg(F.countDistinct("frame").alias("n"))
    times = links.join(owners.groupBy("b").agg(F.count("*").alias("times")), "b").groupBy("h").agg(F.sum("times").alias("times"))
    each = frames.join(times, "h", "left").groupBy("clip", "frame").agg(F.sum(F.coalesce("times", F.lit(0))).alias("times"))
    ranked = each.withColumn("place", F.row_number().over(Window.partitionBy("clip").orderBy("times", "frame")))
    needed = F.ceil(F.col("n") * C.NEAR_SHARE)
    rare = ranked.join(total, "clip").filter(F.col("place") <= F.col("n") - needed + 1).select("clip", "frame")
    reach = links.join(owners, "b").select("h", "b_clip").distinct()
    pairs = frames.join(rare, ["clip", "frame"]).join(links, "h").join(owners, "b")
    pairs = (pairs.filter("clip <> b_clip") if same_table else pairs).select("clip", "b_clip").distinct()
    hit = frames.join(pairs, "clip").join(reach, ["h", "b_clip"]).select("clip", "frame", "b_clip").distinct()
    hit = hit.groupBy("clip", "b_clip").agg(F.count("*").alias("hits"))
    found = hit.join(total, "clip").withColumn("share", F.col("hits") / F.col("n")).filter(F.col("share") >= C.NEAR_SHARE)
    return found.select(F.col("clip").alias("a_clip"), "b_clip", "share")


def near_dup_clips(fp: DataFrame, clip: str = "clip", frame: str = "frame", h: str = "h") -> DataFrame:
    """(a_clip, b_clip, share): clips a of whose frames at least half lie within 6 bits of some frame of b."""
    frames = _frames(fp, clip, frame, h)
    near = settled(near_hashes(fp, h))
    links = near.select(F.col("a").alias("h"), "b").union(near.select(F.col("b").alias("h"), F.col("a").alias("b")))
    links = links.union(frames.select("h", F.col("h").alias("b")).distinct())
    owners = frames.select(F.col("h").alias("b"), F.col("clip").alias("b_clip")).distinct()
    return _near_clips(frames, links, owners, True)


def stored_frames(history: DataFrame, media_type: str = "video") -> DataFrame:
    """(clip, frame, h) of the history's perceptual entries: each a list of hexadecimal hashes joined by commas, which is also its name.

    What is not 16 hexadecimal digits is left out.
    """
    entries = history.filter((F.col("key_kind") == "perceptual") & (F.col("media_type") == media_type)).select(F.col("key_value").alias("clip")).distinct()
    each = entries.select("clip", F.posexplode(F.split("clip", ",")).alias("frame", "x"))
    return each.select("clip", "frame", N.hex_hash(F.trim("x")).alias("h")).filter("h is not null")


def fingerprint(hashes: Column) -> Column:
    """The history's entry for a clip's frame hashes in order."""
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), ",")


def _cell(value: Column, band: int) -> Column:
    """The folder of a band's value: its upper bits, so that a probe and most of its neighbours share one."""
    return F.shiftrightunsigned(value, band * STORED_BITS + STORED_BITS - (CELLS - 1).bit_length()).bitwiseAND(F.lit(CELLS - 1)).cast("int")


def _owner_cell(h: Column) -> Column:
    return F.pmod(F.xxhash64(h), F.lit(CELLS)).cast("int")


def index_fingerprints(frames: DataFrame, path: str) -> None:
    """Add stored frames (clip, frame, h) to the index at path.

    The index has two tables: the hashes under each of 4 bands of 16 bits, in folders by
    band and by the band's upper 6 bits, and the clips that have a hash, in folders by a
    hash of it. Entries that come again are harmless. Folders with most of the rows are
    written by several tasks.
    """
    distinct = frames.select("h").filter("h is not null").distinct()
    band = lambda i: F.col("h").bitwiseAND(F.lit(_mask([(i * STORED_BITS, STORED_BITS)])))
    keys = F.array(*(F.struct(F.lit(i).alias("band"), _cell(band(i), i).alias("cell"), band(i).alias("value")) for i in range(STORED_BANDS)))
    bands = distinct.select("h", F.explode(keys).alias("k")).select("h", "k.value", "k.band", "k.cell")
    bands.hint("rebalance", "band", "cell").write.partitionBy("band", "cell").mode("append").parquet(f"{path}/bands")
    owners = frames.select("h", F.col("clip").cast("string").alias("clip")).filter("h is not null").distinct().withColumn("cell", _owner_cell(F.col("h")))
    owners.hint("rebalance", "cell").write.partitionBy("cell").mode("append").parquet(f"{path}/owners")


def _touched(df: DataFrame, cells: DataFrame) -> DataFrame:
    """df without the folders that no row of cells names; the list of folders is bounded by their number."""
    names = cells.columns
    wanted = [tuple(r) for r in cells.distinct().collect()]
    some = [reduce(lambda x, y: x & y, (F.col(c) == v for c, v in zip(names[:-1], head)), F.lit(True)) & F.col(names[-1]).isin([w[-1] for w in wanted if w[:-1] == head]) for head in sorted({w[:-1] for w in wanted})]
    return df.filter(reduce(lambda x, y: x | y, some)) if some else df.limit(0)


def near_stored(hashes: DataFrame, path: str) -> DataFrame:
    """(h, other, distance): the batch's hashes (h) and the stored ones within 6 bits, equal ones included.

    Each hash asks for its 16 bits in each band and for those one bit away: 68 probes. Only
    the folders that some probe falls into are read. Full keys are cut as in near_hashes().
    """
    distinct = settled(hashes.select("h").filter("h is not null").distinct())
    probes = []
    for i in range(STORED_BANDS):
        mask = _mask([(i * STORED_BITS, STORED_BITS)])
        flips = [0, *(_signed(1 << (i * STORED_BITS + k)) for k in range(STORED_BITS))]
        values = F.array(*(F.col("h").bitwiseAND(F.lit(mask)).bitwiseXOR(F.lit(x).cast("long")) for x in flips))
        probe = distinct.select("h", F.lit(mask).cast("long").alias("mask"), F.explode(values).alias("value"), F.lit(i).alias("band"))
        probes.append(probe.withColumn("cell", _cell(F.col("value"), i)))
    probes = reduce(DataFrame.union, probes)
    stored = _touched(hashes.sparkSession.read.parquet(f"{path}/bands"), probes.select("band", "cell"))
    masks = F.element_at(F.array(*(F.lit(_mask([(i * STORED_BITS, STORED_BITS)])) for i in range(STORED_BANDS))), F.col("band") + 1)
    stored = stored.select("h", masks.alias("mask"), "value").distinct()
    return _near(_met(probes.select("h", "mask", "value"), stored))


def near_stored_clips(fp: DataFrame, path: str, clip: str = "clip", frame: str = "frame", h: str = "h") -> DataFrame:
    """(a_clip, used, share): clips of whose frames at least half lie within 6 bits of some frame of one stored clip."""
    frames = _frames(fp, clip, frame, h)
    links = settled(near_stored(frames, path).select("h", F.col("other").alias("b")))
    owners = _touched(fp.sparkSession.read.parquet(f"{path}/owners"), links.select(_owner_cell(F.col("b")).alias("cell")))
    owners = owners.join(links.select(F.col("b").alias("h")).distinct(), "h", "left_semi")
    owners = owners.select(F.col("h").alias("b"), F.col("clip").alias("b_clip")).distinct()
    return _near_clips(frames, links, owners, False).withColumnRenamed("b_clip", "used")
