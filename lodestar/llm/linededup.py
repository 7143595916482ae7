"""Line dedup over content-defined chunks of lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bitmaps import SLOTS, bitmap
from .common import checkpointed, free_name

#: Lines whose hashes the rolling hash covers.
ROLL = 2
#: Words of a chunk at least, unless the whole text has fewer; shorter chunks are never removed.
LEAST_WORDS = 8
#: Bytes of chunks that a task remembers as already sent for comparison.
REMEMBERED = 16 << 20

_PRIME, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def _boundaries(hashes: list[int], ends: list[int]) -> list[int]:
    """The lines after which a chunk ends, without the last.

    ends: words up to the end of each line. A chunk ends where the hash is the least (of
    equal ones the first) of all lines that end less than LEAST_WORDS words away, and
    neither end of the text is nearer than that.
    """
    out, stack = [], []
    near = [False] * len(hashes)
    for i, h in enumerate(hashes):
        while stack and hashes[stack[-1]] > h:
            k = stack.pop()
            near[k] = near[k] or ends[i] - ends[k] < LEAST_WORDS
        near[i] = ends[i] - (ends[stack[-1]] if stack else 0) < LEAST_WORDS
        stack.append(i)
    for i, end in enumerate(ends):
        if not near[i] and ends[-1] - end >= LEAST_WORDS:
            out.append(i)
    return out


def chunks(text: bytes) -> list[tuple[int, int, int]]:
    """(first line, end line, words) of the chunks of a text; together they hold all its lines.

    A chunk ends where a rolling hash over the hashes of the last ROLL lines is the least
    within LEAST_WORDS words, so it has that many words unless the whole text has fewer;
    a line of that many words next to another is a chunk of its own. Boundaries depend on
    the lines nearby only, so lines inserted or deleted elsewhere shift none.
    """
    lines = text.split(b"\n")
    hashes, ends = [], []
    rolled, last, words = 0, [0] * ROLL, 0
    drop = pow(_PRIME, ROLL, 1 << 64)
    for line in lines:
        h = xxhash.xxh3_64_intdigest(line)
        # The rolling polynomial takes the new line in and lets the oldest of the window go.
        rolled = (rolled * _PRIME + h - last[0] * drop) & _MASK
        last = last[1:] + [h]
        words += len(line.split())
        hashes.append(rolled * _PRIME & _MASK)
        ends.append(words)
    out, first, before = [], 0, 0
    for i in [*_boundaries(hashes, ends), len(lines) - 1]:
        out.append((first, i + 1, ends[i] - before))
        first, before = i + 1, ends[i]
    return out


def _chunk_bytes(lines: list[bytes], first: int, end: int) -> bytes:
    return b"\n".join(lines[first:end])


def _removable(text: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(number, bytes, 128-bit hash) of the chunks of a text that are large enough to be removed."""
    lines = text.split(b"\n")
    for at, (first, end, n) in enumerate(chunks(text)):
        if n >= LEAST_WORDS:
            whole = _chunk_bytes(lines, first, end)
            yield at, whole, xxhash.xxh3_128_digest(whole)


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(b"".join(digests), dtype=">i8").astype("<i8").reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _hashed(text: Column) -> Column:
    """An array of (at, hi, lo) for the chunks that are large enough to be removed; hi and lo make a 128-bit hash."""
    kind = pa.list_(pa.struct([("at", pa.int32()), ("hi", pa.int64()), ("lo", pa.int64())]))

    @F.arrow_udf("array<struct<at: int, hi: long, lo: long>>")
    def hashed(texts: pa.Array) -> pa.Array:
        sizes, numbers, digests = [0], [], []
        for v in texts.cast(pa.large_binary()):
            for at, _, digest in _removable(v.as_py() or b""):
                numbers.append(at)
                digests.append(digest)
            sizes.append(len(numbers))
        hi, lo = _halves(digests)
        found = pa.StructArray.from_arrays([pa.array(numbers, pa.int32()), pa.array(hi), pa.array(lo)], names=["at", "hi", "lo"])
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), found).cast(kind)

    return hashed(text)


def _without(text: Column, gone: Column) -> Column:
    """The text without the chunks whose numbers are in `gone`."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, numbers: pa.Array) -> pa.Array:
        out = []
        for v, gone in zip(texts.cast(pa.large_binary()), numbers):
            text, drop = v.as_py() or b"", set(gone.as_py() or [])
            lines = text.split(b"\n")
            kept = [_chunk_bytes(lines, first, end) for at, (first, end, _) in enumerate(chunks(text)) if at not in drop]
            out.append(b"\n".join(kept).decode("utf-8"))
        return pa.array(out, pa.string())

    return cut(text, gone)


def _candidates(docs: DataFrame, id_type: T.DataType, repeated: np.ndarray) -> DataFrame:
    """(doc_id, mark, at, hi, lo, bytes) of the chunks whose slot is in the bitmap: all repeated chunks and a few others.

    docs: doc_id, mark, text. A task sends the bytes of a chunk once; later chunks with
    that hash are compared with them in the task, and go without bytes if they are equal.
    """
    shared = docs.sparkSession.sparkContext.broadcast(repeated)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, sent, held = shared.value, {}, 0
        for batch in batches:
            rows, numbers, digests, contents = [], [], [], []
            for row, v in enumerate(batch.column(2).cast(pa.large_binary())):
                for at, whole, digest in _removable(v.as_py() or b""):
                    slot = int.from_bytes(digest[12:], "big") & (SLOTS - 1)
                    if not int(bits[slot >> 6]) >> (slot & 63) & 1:
                        continue
                    rows.append(row)
                    numbers.append(at)
                    digests.append(digest)
                    contents.append(None if sent.get(digest) == whole else whole)
                    if digest not in sent:
                        sent[digest] = whole
                        held += len(whole)
            if held > REMEMBERED:
                sent, held = {}, 0
            taken = batch.select([0, 1]).take(pa.array(rows, pa.int64()))
            hi, lo = _halves(digests)
            columns = [*taken.columns, pa.array(numbers, pa.int32()), pa.array(hi), pa.array(lo), pa.array(contents, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "at", "hi", "lo", "bytes"])

    fields = [("doc_id", id_type), ("mark", T.LongType()), ("at", T.IntegerType()), ("hi", T.LongType()), ("lo", T.LongType()), ("bytes", T.BinaryType())]
    return docs.mapInArrow(pieces, T.StructType([T.StructField(*f) for f in fields]))


def removals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, mark, gone): the numbers of the chunks to remove from each document that loses any.

    `mark` is a hash of the text; documents with one id and one text are one entry. A chunk
    goes if the same bytes occur in another document (id or mark differ) and it is not the
    first: the first is in the smallest id, null ids last, then the smallest mark and
    chunk number. Hashes of 128 bits find what repeats. A second reading of the texts, which
    a bitmap of the repeated hashes narrows down, brings the bytes of such chunks, grouped
    to compare them; a hash under which two byte strings met is left alone. No text is
    shuffled. No documents, or none with a repeated chunk, give no rows.
    """
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(f"`{text}`").alias("text"))
    found = slim.select("doc_id", "mark", F.explode(_hashed(F.col("text"))).alias("c")).select("doc_id", "mark", "c.*")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark", "at")
    by_hash = found.groupBy("hi", "lo").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    far = (F.col("first.mark") != F.col("last.mark")) | ~F.col("first.doc_id").eqNullSafe(F.col("last.doc_id"))
    repeated = checkpointed(by_hash.filter(far).select("hi", "lo", "first"))
    met = checkpointed(_candidates(slim, docs.schema[doc_id].dataType, bitmap(repeated.select("lo"))))
    # Equal bytes collapse before the shuffle.
    pieces = met.filter(F.col("bytes").isNotNull()).select("hi", "lo", "bytes").distinct()
    collided = pieces.groupBy("hi", "lo").agg(F.count("*").alias("n")).filter("n > 1").select("hi", "lo")
    sure = met.drop("bytes").join(repeated, ["hi", "lo"]).join(collided, ["hi", "lo"], "left_anti")
    is_first = (
        F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.mark") == F.col("mark")) & (F.col("first.at") == F.col("at"))
    )
    return sure.filter(~is_first).groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set("at")).alias("gone"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", gone: str | None = None) -> DataFrame:
    """All documents, each without its repeated chunks; with `gone`, that column holds their numbers.

    Only text changes; every row stays, with an empty text if all its chunks go. Null and
    empty texts stay as they are. Repeated rows (equal id and text) are one document and
    lose nothing to each other. An empty table gives no rows. Lines end at "\\n"; the lines
    that stay keep their bytes and order. Very long texts are read whole. Extra columns keep
    their names and values, whatever they are called; the column of numbers takes a free
    name like `gone`. Chunks have LEAST_WORDS words at least, so a repeated text of fewer
    words stays.
    """
    mark = free_name(docs, "mark")
    lost = removals(docs, doc_id, text).select(F.col("doc_id").alias("g_id"), F.col("mark").alias("g_mark"), F.col("gone").alias("g_gone"))
    marked = docs.withColumn(mark, F.xxhash64(text))
    joined = marked.join(lost, F.col(f"`{doc_id}`").eqNullSafe(F.col("g_id")) & (F.col(mark) == F.col("g_mark")), "left")
    # Only texts that lose a chunk go through Python.
    cut = F.when(F.col("g_gone").isNull(), F.col(text)).otherwise(_without(F.when(F.col("g_gone").isNotNull(), F.col(text)), F.col("g_gone")))
    columns = [cut.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    if gone:
        columns.append(F.coalesce("g_gone", F.array().cast("array<int>")).alias(free_name(docs, gone)))
    return joined.select(*columns)
