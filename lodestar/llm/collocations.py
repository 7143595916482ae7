"""Phrases whose words occur together, from FM-indexes of shards of the corpus."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bitmaps import bitmap, has, slots_for
from .common import checkpointed
from .fmindex import Index, Phrases, packed, unpacked

#: Words of the longest phrase, occurrences a phrase needs, phrases listed for each language, and the percentage of a
#: phrase's occurrences inside a longer one from which it is dropped.
LONGEST, LEAST, MOST, INSIDE = 4, 30, 2000, 80
#: Words that the shards a task works on may hold together, and rows of a batch it sends.
SHARD_WORDS, ROWS = 4_000_000, 100_000
#: Lists of a language that are cut before they meet.
SALTS = 64
#: Occurrences from which the phrases that begin with a word are dealt out in so many parts.
PARTS = ((1 << 17, 64), (1 << 24, 8192))
#: Slots of a sketch that are summed up together.
SLICE = 1 << 22

_ENDS = b".,;:!?\n\v\f\r"
#: Byte to byte: A-Z in lower case, what ends a piece is a line feed, a tab is a space.
_TABLE = bytes(10 if b in _ENDS else 32 if b == 9 else b for b in range(256)).lower()


def _numbers() -> defaultdict:
    """Numbers of words from 1 in the order in which they are first asked for; 0 ends a piece, -1 is no word."""
    numbers: defaultdict = defaultdict(count(1).__next__)
    numbers[b"\n"], numbers[b""] = 0, -1
    return numbers


def _shard(lang: str, numbers: defaultdict, parts: list[np.ndarray], longest: int) -> tuple | None:
    symbols = np.concatenate(parts)
    word = symbols > 0
    symbols = symbols[word | np.roll(word, 1)]  # one end after each piece
    if not word.any():
        return None
    # From now on words are numbered in byte order, so phrases in the order of their numbers share their beginnings.
    vocabulary = [w for w, n in numbers.items() if n > 0]
    order = sorted(range(len(vocabulary)), key=vocabulary.__getitem__)
    place = np.zeros(len(vocabulary) + 1, dtype=np.int32)
    place[np.array(order, dtype=np.int64) + 1] = np.arange(1, len(vocabulary) + 1)
    symbols = place[symbols]
    packed = zstandard.ZstdCompressor(level=1).compress(b" ".join(map(vocabulary.__getitem__, order)))
    return (lang, int(word.sum()), packed, *Index.of(symbols, longest).pack())


def shards_of(docs: DataFrame, longest: int, shard_words: int) -> DataFrame:
    """(lang, n, words, ahead, back, counts): packed indexes of docs (lang, text), each of texts of one language.

    A task indexes what it has read of a language when it holds `shard_words` words in all.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: defaultdict = defaultdict(_numbers)
        parts: defaultdict = defaultdict(list)
        held: defaultdict = defaultdict(int)

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            del held[lang]
            if row := _shard(lang, numbers.pop(lang), parts.pop(lang), longest):
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names=names)

        for batch in batches:
            for lang, v in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                words = (v.as_py() or b"").translate(_TABLE).replace(b"\n", b" \n ").split(b" ")
                own = np.fromiter(map(numbers[lang].__getitem__, words), dtype=np.int32, count=len(words))
                parts[lang] += [own[own >= 0], np.zeros(1, dtype=np.int32)]
                held[lang] += len(own)
                if sum(held.values()) >= shard_words:
                    yield from flush(max(held, key=held.__getitem__))
        for lang in list(held):
            yield from flush(lang)

    names = ["lang", "n", "words", "ahead", "back", "counts"]
    kinds = [pa.string(), pa.int64(), *[pa.binary()] * 4]
    return docs.mapInArrow(index, "lang string, n long, words binary, ahead binary, back binary, counts binary")


class Shard:
    """A shard's index with its words and their hashes."""

    def __init__(self, row: dict) -> None:
        self.lang = row["lang"]
        self.words = zstandard.ZstdDecompressor().decompress(row["words"]).split(b" ")
        self.index = Index.view([row["ahead"], row["back"], row["counts"]])

    def hashes(self) -> np.ndarray:
        """xxhash64(lang, word) of the words by their numbers; the first place stands for the end of a piece."""
        seed = xxhash.xxh64_intdigest(self.lang.encode(), 42)
        of = (xxhash.xxh64_intdigest(w, seed) for w in self.words)
        return np.fromiter(chain([0], of), dtype=np.uint64, count=1 + len(self.words)).view(np.int64)

    def singles(self) -> Iterator[pa.RecordBatch]:
        """(lang, phrase, n) of the words."""
        own, n = pa.array(self.words, pa.string()), self.index.counts[1:]
        for at in range(0, len(n), ROWS):
            part = own.slice(at, ROWS)
            lang = pa.array([self.lang], pa.string()).take(pa.array(np.zeros(len(part), np.int32)))
            yield pa.RecordBatch.from_arrays([lang, part, pa.array(n[at : at + ROWS])], names=["lang", "phrase", "n"])

    def rows(self, words: np.ndarray, n: np.ndarray, parts: np.ndarray, h: np.ndarray) -> Iterator[pa.RecordBatch]:
        """(lang, first, part, tails, n): phrases by their words' numbers, those with one first word and part together.

        parts: for each word into how many parts its phrases are dealt, by the hashes in h of their other words.
        """
        part = slots_of(words[:, 1:], h, 62) % parts[words[:, 0]]
        order = np.lexsort((*words.T[:0:-1], part, words[:, 0]))
        words, n, part = words[order], n[order].astype(np.int32), part[order].astype(np.int32)
        new = np.flatnonzero(np.append(True, (np.diff(words[:, 0]) != 0) | (np.diff(part) != 0))) if len(n) else np.zeros(0, np.int64)
        ends = np.append(new[1:], len(n))
        own = pa.array(self.words, pa.string())
        # Batches of whole lists, of about ROWS phrases or one list.
        cuts = np.flatnonzero(np.append(True, np.diff(ends // ROWS) > 0)) if len(new) else new
        for low, high in zip(cuts, np.append(cuts[1:], len(new))):
            begin, end = new[low], ends[high - 1]
            offsets = pa.array(np.append(new[low:high], end) - begin, pa.int32())
            tails = pc.binary_join_element_wise(*(own.take(pa.array(c - 1)) for c in words[begin:end, 1:].T), " ")
            lists = pc.binary_join(pa.ListArray.from_arrays(offsets, tails), "\n")
            lang = pa.array([self.lang], pa.string()).take(pa.array(np.zeros(high - low, np.int32)))
            first = own.take(pa.array(words[new[low:high], 0] - 1))
            yield pa.RecordBatch.from_arrays([lang, first, pa.array(part[new[low:high]]), lists, pa.ListArray.from_arrays(offsets, pa.array(n[begin:end]))], names=["lang", "first", "part", "tails", "n"])


def _each(shards: DataFrame, of, schema: str) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                yield from of(Shard(batch.slice(at, 1).to_pylist()[0]))

    return shards.mapInArrow(each, schema)


def slots_of(words: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """Slots below 2**bits of phrases by their words' numbers, from the hashes h of the words."""
    out = h[words[:, 0]].astype(np.uint64)
    for w in words.T[1:]:
        out = out * np.uint64(0x9E3779B97F4A7C15) ^ h[w].view(np.uint64)
    return (out >> np.uint64(64 - bits)).astype(np.int64)


def _sketched(slots: np.ndarray, n: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
    """(slice, slots, n): the slots of a shard's phrases in order, as packed steps, with their occurrences up to `least`."""
    order = np.argsort(slots)
    slots, n = slots[order], np.minimum(n[order], least)
    at = np.flatnonzero(np.append(True, np.diff(slots // SLICE) > 0)) if len(slots) else np.zeros(0, np.int64)
    for low, high in zip(at, np.append(at[1:], len(slots))):
        row = int(slots[low] // SLICE), packed(np.diff(slots[low:high] % SLICE, prepend=0)), packed(n[low:high])
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.binary(), pa.binary()))], names=["slice", "slots", "n"])


def _reached(shards: DataFrame, of, least: int) -> DataFrame:
    """(slot): the slots of the sketch rows that `of` gives for each shard with `least` occurrences in all."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(SLICE, dtype=np.int64)

        def done() -> pa.RecordBatch:
            found = np.flatnonzero(total >= least)
            total[:] = 0
            return pa.RecordBatch.from_arrays([pa.array(found + now * SLICE, pa.int64())], names=["slot"])

        for batch in batches:
            for part, slots, n in zip(*(c.to_pylist() for c in batch.columns)):
                if now not in (None, part):
                    yield done()
                now = part
                np.add.at(total, np.cumsum(unpacked(slots)), unpacked(n))
        if now is not None:
            yield done()

    rows = _each(shards, of, "slice int, slots binary, n binary")
    return checkpointed(rows.repartition("slice").sortWithinPartitions("slice").mapInArrow(summed, "slot long"))


def _added(lists: pa.Table, least: int) -> pa.RecordBatch:
    """(lang, phrase, f) of whole groups of lists (lang, first, part, tails, n): their phrases summed up, from `least` on."""
    lists = lists.combine_chunks()
    tails = pc.split_pattern(lists["tails"], "\n").combine_chunks()
    row = pc.list_parent_indices(tails)
    keys = [lists[k].combine_chunks().dictionary_encode() for k in ("lang", "first")]
    flat = {"lang": keys[0].indices.take(row), "first": keys[1].indices.take(row), "tail": tails.flatten(), "n": lists["n"].combine_chunks().flatten()}
    sums = pa.table(flat).group_by(["lang", "first", "tail"], use_threads=False).aggregate([("n", "sum")])
    sums = sums.filter(pc.greater_equal(sums["n_sum"], least)).combine_chunks()
    lang, first = (k.dictionary.take(sums[c].combine_chunks()) for k, c in zip(keys, ("lang", "first")))
    phrase = pc.binary_join_element_wise(first, sums["tail"].combine_chunks(), " ")
    return pa.RecordBatch.from_arrays([lang, phrase, sums["n_sum"].combine_chunks()], names=["lang", "phrase", "f"])


def _summed(shards: DataFrame, of, least: int) -> DataFrame:
    """(lang, phrase, f) of the lists that `of` gives for each shard, summed up, from `least` occurrences on.

    Lists travel whole and are summed up as lists where all of one word and part have met, so
    only frequent phrases become rows; a shard's phrases are distinct, so nothing is gained by
    summing them up before.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the lists of one word and part, which may go on in the next batch

        def key(batch: pa.RecordBatch, at: int) -> tuple:
            return tuple(batch.column(c)[at].as_py() for c in range(3))

        for batch in filter(len, batches):
            new = np.zeros(len(batch), dtype=bool)
            new[0] = not held or key(held[-1], 0) != key(batch, 0)
            for c in batch.columns[:3]:
                new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            if new.any():
                last = int(np.flatnonzero(new)[-1])
                if whole := [b for b in (*held, batch[:last]) if len(b)]:
                    yield _added(pa.Table.from_batches(whole), least)
                held, batch = [], batch[last:]
            held.append(batch)
        if held:
            yield _added(pa.Table.from_batches(held), least)

    lists = _each(shards, of, "lang string, first string, part int, tails string, n array<int>").repartition("lang", "first", "part")
    return checkpointed(lists.sortWithinPartitions("lang", "first", "part").mapInArrow(summed, "lang string, phrase string, f long"))


def phrase_counts(shards: DataFrame, longest: int, least: int) -> DataFrame:
    """(lang, phrase, size, f) of all phrases of up to `longest` words with `least` occurrences in their language.

    A phrase is no more frequent than its parts. So words are counted first, then the pairs
    of frequent words, then, from the frequent pairs on, what stands before and after them;
    a bitmap of the frequent ones, of at most 16 MB, tells the shards where to go on. What
    shares a place in it by chance is counted too and falls short in the sum.

    Most phrases are rare, so before they are sent with their words a sketch is: the slots
    that they hash to, about a byte each, of as many slots as there are words in all. Only
    phrases whose slot holds `least` occurrences over all shards are sent and counted.
    """
    spark = shards.sparkSession
    counted = _each(shards, lambda s: s.singles(), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    singles = checkpointed(counted.filter(F.col("f") >= least))

    def marked(df: DataFrame, key: Column):
        return spark.sparkContext.broadcast(bitmap(df.select(key), slots_for(df.count())))

    word = lambda k: F.xxhash64("lang", F.substring_index("phrase", " ", k))
    frequent = marked(singles, word(1))
    hot = [(n, marked(singles.filter(F.col("f") >= f), word(1))) for f, n in PARTS]

    def parts(h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), dtype=np.int64)
        for n, words in hot:
            out[has(words.value, h)] = n
        return out

    # From here on the occurrences of words in all languages bound those of the phrases.
    bits = max(10, (shards.agg(F.sum("n")).first()[0] or 0).bit_length())

    def pairs(s: Shard, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = has(frequent.value, h)
        first, second, n = s.index.pairs(lambda a, b: known[a] & known[b])
        return np.stack([first, second], axis=1), n

    def sketched_pairs(s: Shard) -> Iterator[pa.RecordBatch]:
        h = s.hashes()
        words, n = pairs(s, h)
        return _sketched(slots_of(words, h, bits), n, least)

    reached = marked(_reached(shards, sketched_pairs, least), F.col("slot"))

    def counted_pairs(s: Shard) -> Iterator[pa.RecordBatch]:
        h = s.hashes()
        words, n = pairs(s, h)
        keep = has(reached.value, slots_of(words, h, bits))
        return s.rows(words[keep], n[keep], parts(h), h)

    found = [singles, _summed(shards, counted_pairs, least)]
    if longest > 2:
        mixed = word(1).bitwiseXOR(F.shiftleft(word(-1), 1).bitwiseOR(F.shiftrightunsigned(word(-1), 63)))
        beside = marked(found[1], mixed)

        def longer(s: Shard, h: np.ndarray, kept) -> Iterator[Phrases]:
            turned = (h << 1) | (h.view(np.uint64) >> np.uint64(63)).astype(np.int64)
            allowed = lambda a, b: has(beside.value, h[a] ^ turned[b])
            phrases = s.index.phrases(allowed)
            for size in range(3, longest + 1):
                phrases = s.index.extended(phrases, size % 2 == 1, allowed)
                if kept:
                    phrases = phrases.where(kept(phrases.words))
                yield phrases

        def sketched_longer(s: Shard) -> Iterator[pa.RecordBatch]:
            h = s.hashes()
            found = [(slots_of(p.words, h, bits), p.n) for p in longer(s, h, None)]
            return _sketched(*map(np.concatenate, zip(*found)), least)

        often = marked(_reached(shards, sketched_longer, least), F.col("slot"))

        def counted_longer(s: Shard) -> Iterator[pa.RecordBatch]:
            h = s.hashes()
            for p in longer(s, h, lambda words: has(often.value, slots_of(words, h, bits))):
                yield from s.rows(p.words, p.n, parts(h), h)

        found.append(_summed(shards, counted_longer, least))
    grams = found[0]
    for more in found[1:]:
        grams = grams.union(more)
    return grams.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("size"), "f")


def _whole(x: str) -> Column:
    """A count as a decimal: products with it are exact."""
    return F.col(x).cast("decimal(20,0)")


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    longest: int = LONGEST,
    least: int = LEAST,
    most: int = MOST,
    inside: int = INSIDE,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """The `most` best phrases of 2 to `longest` words of each language: lang, rank, phrase, a, l, r, n, score.

    Words are runs of anything but spaces and tabs between ends of pieces (`.,;:!?` and
    line ends), with A-Z in lower case; phrases lie within pieces. Of the ways to cut a
    phrase in two, that with the lowest 2,000,000 a / (l + r) counts (the dice
    coefficient in millionths; of ties the first), where a, l and r count the phrase and its
    parts. A phrase with `inside` percent of its occurrences or more in one longer frequent
    phrase is dropped. n counts the words of the language.

    Each task indexes its texts by shards of one language and `shard_words` words at most
    (a longer text is a shard of its own); the indexes are written once and read by each of five
    passes. Shards send each distinct phrase that may be frequent once, so a hot phrase is a row a shard. A longer phrase
    that holds a shorter one with two words more lets one with one word more hold it too, so
    only those are looked up.

    Null and empty texts have no words, a null language is `und`, and repeated rows count
    each. Very long texts are read whole. An empty table gives no rows; ids and extra
    columns are ignored. Ties in score go to the more frequent, then to the first in byte
    order.
    """
    slim = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    shards = checkpointed(shards_of(slim, longest, shard_words))
    grams = phrase_counts(shards, longest, least)
    totals = shards.groupBy("lang").agg(F.sum("n").alias("n"))
    longer = grams.filter("size > 2")
    parts = F.expr("array(substring_index(phrase, ' ', size - 1), substring_index(phrase, ' ', 1 - size))")
    holding = longer.select("lang", F.explode(parts).alias("part"), "f").groupBy("lang", "part").agg(F.max("f").alias("held"))
    holding = holding.select(F.col("lang").alias("h_lang"), "part", "held")
    phrases = grams.filter("size > 1").withColumnRenamed("f", "a")
    kept = phrases.join(holding, (F.col("lang") == F.col("h_lang")) & (F.col("phrase") == F.col("part")), "left")
    kept = kept.filter(F.col("held").isNull() | (_whole("held") * 100 < _whole("a") * inside)).select("lang", "phrase", "size", "a")
    cut = kept.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.withColumns({"head": F.expr("substring_index(phrase, ' ', k)"), "tail": F.expr("substring_index(phrase, ' ', k - size)")})
    of = lambda part, n: grams.select(F.col("lang").alias(f"{part}_lang"), F.col("phrase").alias(f"{part}_phrase"), F.col("f").alias(n))
    same = lambda part: (F.col("lang") == F.col(f"{part}_lang")) & (F.col(part) == F.col(f"{part}_phrase"))
    met = cut.join(of("head", "l"), same("head")).join(of("tail", "r"), same("tail"))
    score = F.expr("cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + r)").cast("long")
    lowest = met.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x"))
    lowest = lowest.select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    # A language with most of the phrases is cut in many lists before one task takes what is left of it.
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    first = lowest.withColumn("place", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*best))).filter(F.col("place") <= most)
    listed = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).filter(F.col("rank") <= most)
    totals = totals.select(F.col("lang").alias("t_lang"), "n")
    return listed.join(totals, F.col("lang") == F.col("t_lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
