"""Best-two-fit packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import os
import re
import struct
import sys
import types
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Tokens of a sequence, and the id that ends every document.
CAPACITY, END = 2048, 0
#: Stretches of text whose ids a Python worker keeps.
KEPT = 1_000_000

#: White space but the space itself.
_WHITE = "\t-\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Before a space that follows no white space a text may be cut without changing its tokens.
_CUT = re.compile(rf"(?<=[^{_WHITE} ])(?= )")
#: White space before a space: between white space a cut at every space would differ.
_ENDING = [chr(c) + " " for c in (*range(9, 14), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
#: Byte to the character that stands for it in a byte-level vocabulary: printable ones for themselves, the others from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_LETTERS = [chr(b) if b in _PRINTABLE else chr(256 + sum(x not in _PRINTABLE for x in range(b))) for b in range(256)]
#: Letters, and the punctuation at their end, to which no merge crosses.
_MARKED = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([.,;:!?]*)")


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    Byte-level BPE takes a text in stretches that no merge crosses, and every space after
    other than white space begins one. Stretches come again and again, so each is encoded
    once and looked up from then on (`kept` of them at most, then anew). A text that holds a
    special token's string is encoded in one piece.
    """

    def __init__(self, path: str, kept: int = KEPT) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has a core of its own
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Ids of stretches at the start of a text, and of those after the first, without the space they begin with.
        self.kept, self.first, self.later = kept, {}, {}

    @classmethod
    def of_worker(cls, path: str) -> Encoder:
        """The encoder that this Python worker has kept from earlier tasks, or a new one."""
        kept = vars(sys.modules.setdefault("lodestar_of_worker", types.ModuleType("lodestar_of_worker")))
        if path not in kept:
            kept[path] = cls(path)
        return kept[path]

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [_bytes(e.ids) for e in found]

    def _word(self, word: str) -> bytes:
        """Ids of a space and letters: one stretch for the merges, whatever stands around it."""
        if word not in self.later:
            letters = " " + word
            self.later[word] = _bytes([t.id for t in self.model.tokenize("".join(map(_LETTERS.__getitem__, letters.encode())))])
        return self.later[word]

    def _learn_first(self, parts: list[str]) -> None:
        new = list(set(parts).difference(self.first))
        self.first.update(zip(new, self._ids(new)))

    def _learn_later(self, parts: list[str]) -> None:
        plain, marked = set(), set()
        for p in parts:
            if not (m := _MARKED.fullmatch(p)):
                plain.add(p)
            elif m[2]:
                marked.add((p, *m.groups()))
            else:
                self._word(p)
        new = list(plain.difference(self.later))
        self.later.update(zip(new, self._ids([" " + p for p in new])))
        self._learn_first([marks for *_, marks in marked])
        for p, letters, marks in marked:
            self.later[p] = self._word(letters) + self.first[marks]

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.first) + len(self.later) > self.kept:
            self.first, self.later = {}, {}
        out: list[list] = []
        gaps: list[tuple[int, int, str]] = []
        for text in texts:
            if any(s in text for s in self.special):
                out.append(self._ids([text]))
                continue
            parts = text.split(" ")
            if "" in parts or any(map(text.__contains__, _ENDING if not text.isascii() else _ENDING[:9])):
                parts = _CUT.split(text)
                self._learn_first(parts)
                out.append(list(map(self.first.__getitem__, parts)))
                continue
            # The parts after the first begin with the space before them.
            self._learn_first(parts[:1])
            found = [self.first[parts[0]], *map(self.later.get, parts[1:])]
            if None in found:
                gaps += [(len(out), at, parts[at]) for at, ids in enumerate(found) if ids is None]
            out.append(found)
        self._learn_later([p for *_, p in gaps])
        for of, at, p in gaps:
            out[of][at] = self.later[p]
        return list(map(b"".join, out))


def _bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: one, or full ones after a first that may be shorter."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, n, capacity)]


class _Sizes:
    """The sizes that are left, with how many items each has."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.left = {s: n for s, n in counts.items() if n}
        self.sizes = sorted(self.left)

    def largest(self, most: int) -> int:
        """The largest size up to `most`, 0 if there is none."""
        at = bisect_right(self.sizes, most)
        return self.sizes[at - 1] if at else 0

    def take(self, size: int, n: int = 1) -> None:
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size]
            self.sizes.remove(size)

    def back(self, size: int, n: int = 1) -> None:
        if size not in self.left:
            insort(self.sizes, size)
            self.left[size] = 0
        self.left[size] += n

    def pair(self, most: int) -> tuple[int, int]:
        """The two sizes a >= b with the largest sum up to `most`, of those the largest a; (0, 0) if there are none."""
        best, low, high = (0, 0), 0, bisect_right(self.sizes, most) - 1
        while low <= high:
            a, b = self.sizes[high], self.sizes[low]
            if a + b > most or (a == b and self.left[a] < 2):
                if a == b:
                    break
                high -= 1
                continue
            if (a + b, a) > (sum(best), best[0]):
                best = (a, b)
            low += 1
        return best


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(sizes of a bin, how many bins are alike) by best-two-fit, from how many items each size has.

    A bin is filled greedily: the largest item that fits, until none does. Then its
    smallest item is put back for the two items left whose sum fits the wider gap most
    closely, if that is tighter. Items of one size are alike, so a filling that comes out
    is repeated while its sizes last: the work depends on the sizes, not on the items.
    """
    sizes, out = _Sizes(counts), []
    while sizes.sizes:
        own, gap = [], capacity
        while size := sizes.largest(gap):
            n = min(sizes.left[size], gap // size)
            sizes.take(size, n)
            own += [size] * n
            gap -= n * size
        if gap and len(own) > 1:
            smallest = own[-1]
            a, b = sizes.pair(gap + smallest)
            if a + b > smallest:
                own[-1:] = [a, b]
                sizes.take(a)
                sizes.take(b)
                sizes.back(smallest)
        uses = {s: own.count(s) for s in own}
        again = min(sizes.left.get(s, 0) // n for s, n in uses.items())
        for s, n in uses.items():
            if again:
                sizes.take(s, n * again)
        out.append((tuple(own), again + 1))
    return out


def places(bins: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each size, by the rank of an item among its like: (first ranks, first bins, items a bin, offset of the first).

    Items of a size stand together in a bin, so an item's bin and offset follow from its
    rank within the run that its rank lies in.
    """
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    number = 0
    for own, n in bins:
        at = 0
        for size in sorted(set(own), reverse=True):
            uses = own.count(size)
            rank = ranks.get(size, 0)
            runs.setdefault(size, []).append((rank, number, uses, at))
            ranks[size] = rank + uses * n
            at += uses * size
        number += n
    return {size: tuple(np.array(x, dtype=np.int64).T) for size, x in runs.items()}


def pieces(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, end: int = END, ids: bool = False) -> DataFrame:
    """(doc_id, mark, piece, start, length, ids_crc32) of every document, and with `ids` the ids themselves.

    `mark` is a hash of the text, in which rows with one id differ.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of_worker(tokenizer)
        last = np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                of, rows, tokens = [], [], []
                for at, encoded in enumerate(encoder.encode([t or "" for t in part.column(2).to_pylist()])):
                    encoded += last
                    for piece, (start, n) in enumerate(cuts(len(encoded) // 4, capacity)):
                        own = encoded[4 * start : 4 * (start + n)]
                        of.append(at)
                        rows.append((piece, start, n, zlib.crc32(own)))
                        if ids:
                            tokens.append(own)
                numbers = np.array(rows, dtype=np.int64).reshape(-1, 4).T
                # Piece, start, length and checksum.
                columns = [*(c.take(pa.array(of, pa.int64())) for c in part.columns[:2]), pa.array(numbers[0].astype(np.int32)), *map(pa.array, numbers[1:])]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(tokens, pa.binary())] if ids else []), names=names)

    names = ["doc_id", "mark", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])]
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("mark"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, mark long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if ids else "")
    return slim.mapInArrow(cut, schema)


def pack(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, end: int = END, ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and with `ids` the piece's ids, little-endian).

    A document is its tokens and `end`. Only one of over `capacity` tokens is cut: into full
    pieces and, before them, what is over. `tokenizer` is the path of a byte-level BPE
    file of the tokenizers library, the same on all executors.

    How many pieces have each length is all that the packing needs: at most `capacity`
    counts reach the driver, and best-two-fit over them is one packing of the whole
    corpus. Pieces of a length are alike; their ranks are laid out by range partitions, so
    a length with most of the pieces is spread, and the plan (runs of ranks, their number
    bounded by the lengths) gives each its sequence and offset. Order within a length
    is by a hash, so reruns agree.

    Null and empty texts are the end alone, one token. Null and repeated ids and repeated
    rows are documents of their own; very long texts are encoded whole and cut; an empty
    table gives no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    cut = pieces(docs, tokenizer, text, doc_id, capacity, end, ids)
    order = ["length", "spread", "mark", "doc_id", "piece"]
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Alike pieces of one length are in no order of their own: any of them can stand in any of their places.
    # Written first: range partitions are laid out from a sample of their input, which would encode all texts twice.
    laid = checkpointed(cut.withColumn("spread", F.xxhash64("doc_id", "mark", "piece"))).repartitionByRange(parts, *order)
    laid = checkpointed(laid.withColumn("part", F.spark_partition_id()))
    counts = laid.groupBy("part", "length").agg(F.count("*").alias("n"))
    # One row for each partition and length that meet: partitions plus lengths at most.
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("part").alias("at_part"), F.col("length").alias("at_length"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(places(plan(totals, capacity)))

    @F.arrow_udf("struct<sequence_id long, offset long>")
    def placed(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        size, rank = lengths.to_numpy(zero_copy_only=False), ranks.to_numpy(zero_copy_only=False)
        bins, offsets = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for s in np.unique(size).tolist():
            own = size == s
            first, number, uses, at = shared.value[s]
            run = np.searchsorted(first, rank[own], side="right") - 1
            k = rank[own] - first[run]
            bins[own] = number[run] + k // uses[run]
            offsets[own] = at[run] + k % uses[run] * s
        return pa.StructArray.from_arrays([pa.array(bins), pa.array(offsets)], names=["sequence_id", "offset"])

    within = Window.partitionBy("part", "length").orderBy(*order[1:])
    ranked = laid.withColumn("row", F.row_number().over(within))
    met = ranked.join(starts, (F.col("part") == F.col("at_part")) & (F.col("length") == F.col("at_length")))
    out = met.withColumn("place", placed(F.col("length"), F.col("first") + F.col("row") - 1))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset", *(["ids"] if ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) of pack(..., ids=True): each sequence's ids, little-endian unsigned 32-bit, in one binary."""
    own = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), own.alias("own"))
    ids = F.aggregate("own", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return joined.select("sequence_id", "length", ids.alias("ids"))
