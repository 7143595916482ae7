"""Language-model scores from bigram tries in Elias-Fano form, sharded over the cluster."""

from __future__ import annotations

import mmap
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import checkpointed, remainder
from .eliasfano import CODES, Trie

#: Words whose counts every task has. Results are the same for any number: rarer words' counts wait in the shards.
FREQUENT = 65_535
#: Pseudo-count of the unigram model in each context.
PRIOR = 500.0
#: Tokens of a batch of documents at least and at most, batches a corpus has before they grow, tokens a shard is laid
#: out for, and words a counter holds.
BATCH_TOKENS, MOST_TOKENS, BATCHES, SHARD_TOKENS, COUNTED = 500_000, 4_000_000, 2_000, 1_200_000, 200_000
#: Hash of the end of a text: of a byte that no word has.
END = xxhash.xxh3_64_intdigest(b"\n") >> 1

_RARE = np.uint64(1 << 63)


def word_hash(word: bytes) -> int:
    """63 bits: two of ten million words meet with a chance of one in 200,000."""
    return xxhash.xxh3_64_intdigest(word) >> 1


def token_counts(docs: DataFrame) -> DataFrame:
    """(h, c): how often each token occurs in all texts of docs; the end of a text is a token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        ends = 0

        def flush() -> pa.RecordBatch:
            hashes = np.fromiter(map(word_hash, seen), dtype=np.int64, count=len(seen))
            return pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(list(seen.values()), pa.int64())], names=["h", "c"])

        for batch in batches:
            for v in batch.column(0).cast(pa.large_binary()):
                seen.update((v.as_py() or b"").lower().split())
                ends += 1
                if len(seen) > COUNTED:
                    yield flush()
                    seen.clear()
        yield flush()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([ends])], names=["h", "c"])

    return docs.select("text").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int) -> pd.DataFrame:
    """The most frequent tokens, `most` of them at most, by falling count.

    A histogram of counts, at most 256 steps for each doubling, gives the least count to
    take; so the driver gets that histogram and the tokens taken, however many tasks hold
    them. Tokens on one step are taken all or not at all.
    """
    step = F.floor(F.log2("c") * 256)
    sizes = sorted(map(tuple, counts.groupBy(step.alias("step")).agg(F.count("*")).collect()), reverse=True)
    taken, least = 0, None
    for at, n in sizes:
        taken += n
        if taken > most:
            break
        least = at
    top = counts.filter(step >= least if least is not None else F.lit(False)).toPandas()
    return top.sort_values(["c", "h"], ascending=[False, True])


@dataclass
class Unigrams:
    """What every task needs: the frequent words and the totals.

    A word's code is its place in `hashes`, or, if it is not among them, its hash with the
    top bit set; `start` is the code before the first token of a text.
    """

    hashes: np.ndarray
    counts: np.ndarray
    tokens: int
    distinct: int
    ends: int

    def __post_init__(self) -> None:
        self.start = len(self.hashes)
        self.whole = self.tokens + 0.5 * (self.distinct + 1)
        # No pair adds more than one with all occurrences of its second word.
        self.scale = (CODES - 1) / float(np.log10(1 + self.whole / PRIOR))

    def log_p(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the smoothed share of words with these counts."""
        return np.log10((counts + 0.5) / self.whole)

    def backoff(self, counts: np.ndarray) -> np.ndarray:
        """log10 of what contexts with these counts leave to the unigrams."""
        return np.log10(PRIOR / (counts + PRIOR))

    def gain(self, pair_counts: np.ndarray, second_counts: np.ndarray) -> np.ndarray:
        """log10 of what a pair's count adds over backing off to the unigram of its second word."""
        return np.log10(1 + pair_counts / (PRIOR * (second_counts + 0.5) / self.whole))

    def known(self, codes: np.ndarray) -> np.ndarray:
        """Counts of the frequent words and the start among codes; 0 for the others."""
        table = np.append(self.counts, self.ends)
        return np.where(codes < _RARE, table[np.minimum(codes, np.uint64(self.start)).astype(np.int64)], 0)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays compressed together, of each all first bytes, then all second bytes and so on: most high bytes are zero."""
    sizes = np.array([len(arrays), *(len(a) for a in arrays)], dtype="<i8")
    planes = (np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(b"".join([sizes.tobytes(), *planes]))


def _unpack(buffer: bytes, *types: str) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(buffer), dtype=np.uint8)
    sizes = raw[8 : 8 * (len(types) + 1)].view("<i8").tolist()
    out, at = [], 8 * (len(types) + 1)
    for n, t in zip(sizes, types):
        width = np.dtype(t).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(t).reshape(-1))
        at += n * width
    return out


@dataclass
class Batch:
    """Documents as word numbers of their own: codes[number] is a word; tokens are numbers, document after document."""

    codes: np.ndarray
    tokens: np.ndarray
    lengths: np.ndarray

    def pairs(self, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of first and second words (one beyond the codes is the start) of the distinct pairs, and each token's pair."""
        n = len(self.codes)
        first = np.empty(len(self.tokens), dtype=np.int64)
        first[1:] = self.tokens[:-1]
        first[np.cumsum(self.lengths) - self.lengths] = n
        keys, of = np.unique(first * (n + 1) + self.tokens, return_inverse=True)
        return keys // (n + 1), keys % (n + 1), of

    def dealt(self, first: np.ndarray, second: np.ndarray, start: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """The order in which pairs are sent, and where in it each shard's pairs of frequent words, of rare second and of rare first words begin.

        Pairs with a rare word go where the word's count is, the second's if both are; the
        others are dealt out by both words, so no word gathers. (3 * shards + 1 places.)
        """
        with_start = np.append(self.codes, np.uint64(start))
        a, b = with_start[first], with_start[second]
        mixed = (a * np.uint64(0x9E3779B97F4A7C15) ^ b) * np.uint64(0xD1342543DE82EF95)
        word = np.where(b >= _RARE, b & ~_RARE, np.where(a >= _RARE, a & ~_RARE, mixed >> np.uint64(33)))
        place = 3 * (word % np.uint64(shards)).astype(np.int64) + np.where(b >= _RARE, 1, np.where(a >= _RARE, 2, 0))
        order = np.argsort(place, kind="stable")
        return order, np.searchsorted(place[order], np.arange(3 * shards + 1))


_ROUTED = "shard int, batch long, grams binary, rare binary, facts binary, ids binary"
_PARTS = "batch long, shard int, gains binary, counts binary, facts binary, ids binary"


def _routed_rows(u: Unigrams, shards: int, number: int, ids: pa.Array, held: list[bool], codes: list[np.ndarray]) -> pa.RecordBatch:
    """The distinct pairs and rare words of one batch, a row for each shard that has any; one of them takes the documents."""
    lengths = np.fromiter(map(len, codes), dtype=np.int64, count=len(codes))
    # Codes of frequent words are small and come first, by falling frequency, so numbers in their order pack well.
    words, tokens = np.unique(np.concatenate(codes), return_inverse=True)
    batch = Batch(words, tokens, lengths)
    first, second, of = batch.pairs(u.start)
    learned = np.repeat(~np.array(held, dtype=bool), lengths)
    counts = np.bincount(of, weights=learned, minlength=len(first)).astype("<u4")
    order, ends = batch.dealt(first, second, u.start, shards)
    with_start = np.append(batch.codes, np.uint64(u.start))
    a, b, counts = with_start[first[order]], with_start[second[order]], counts[order]
    rare = batch.codes[batch.codes >= _RARE] & ~_RARE
    rare_place = (rare % np.uint64(shards)).astype(np.int64)
    by_rare = np.argsort(rare_place, kind="stable")
    rare_ends = np.searchsorted(rare_place[by_rare], np.arange(shards + 1))
    facts = _pack(batch.codes.astype("<u8"), batch.tokens.astype("<u4"), lengths.astype("<i8"), np.array(held, "u1"))
    own_ids = pa.record_batch([ids], names=["doc_id"]).serialize().to_pybytes()
    rows = []
    for s in range(shards):
        x, y, z, end = ends[3 * s : 3 * s + 4]
        own, own_rare = s == number % shards, rare[by_rare[rare_ends[s] : rare_ends[s + 1]]]
        if end > x or len(own_rare) or own:
            both = a[x:y] << np.uint64(32) | b[x:y]  # rising: pairs are sorted
            seconds, firsts = (np.searchsorted(own_rare, w & ~_RARE).astype("<u4") for w in (b[y:z], a[z:end]))
            grams = _pack(np.diff(both, prepend=np.uint64(0)), a[y:z], seconds, firsts, b[z:end].astype("<u4"), counts[x:end])
            rows.append((s, number, grams, _pack(own_rare), facts if own else None, own_ids if own else None))
    kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[f.split()[0] for f in _ROUTED.split(", ")])


def _grams(packed: bytes, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of first and second words and counts of a shard's pairs of a batch, whose rare words are `rare`."""
    both, a, seconds, firsts, b, counts = _unpack(packed, "<u8", "<u8", "<u4", "<u4", "<u4", "<u4")
    both = both.cumsum()
    first = np.concatenate((both >> np.uint64(32), a, rare[firsts] | _RARE))
    second = np.concatenate((both & np.uint64((1 << 32) - 1), rare[seconds] | _RARE, b.astype(np.uint64)))
    return first, second, counts


def route(docs: DataFrame, unigrams, shards: int, batch_tokens: int) -> DataFrame:
    """The n-grams of all documents, packed by (shard, batch of documents).

    docs: doc_id, held_out, text. unigrams: the fields of a Unigrams, broadcast.
    """

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = Unigrams(*unigrams.value)
        numbers = dict(zip(u.hashes.tolist(), range(len(u.hashes))))
        code_of: dict[bytes, int] = {}
        number = TaskContext.get().partitionId() << 32
        ids, held_out, codes, tokens = [], [], [], 0
        end = numbers.get(END, END | 1 << 63)
        for batch in batches:
            own_ids, held, texts = batch.columns
            first = 0
            for at, (is_held, v) in enumerate(zip(held.to_pylist(), texts.cast(pa.large_binary()))):
                words = (v.as_py() or b"").lower().split()
                for w in set(words).difference(code_of):
                    h = word_hash(w)
                    code_of[w] = numbers.get(h, h | 1 << 63)
                own = np.empty(len(words) + 1, dtype=np.uint64)
                own[:-1] = np.fromiter(map(code_of.__getitem__, words), dtype=np.uint64, count=len(words))
                own[-1] = end
                held_out.append(is_held)
                codes.append(own)
                tokens += len(own)
                if len(code_of) > COUNTED:
                    code_of.clear()
                if tokens >= batch_tokens or len(codes) >= 1 << 16:
                    yield _routed_rows(u, shards, number, pa.concat_arrays([*ids, own_ids.slice(first, at + 1 - first)]), held_out, codes)
                    first, ids, held_out, codes, tokens, number = at + 1, [], [], [], 0, number + 1
            if first < len(own_ids):
                ids.append(own_ids.slice(first))
        if codes:
            yield _routed_rows(u, shards, number, pa.concat_arrays(ids), held_out, codes)

    return docs.select("doc_id", "held_out", "text").mapInArrow(entries, _ROUTED)


def score_shard(u: Unigrams, left: pa.Table, right: pa.Table) -> pa.Table:
    """A shard's answers to each batch: codes of its pairs' gains and counts of its rare words.

    left: routed rows of the shard; right: (h, c) of the training words that fall to it.
    The shard's trie is built from the pairs that occur in training documents, over word
    numbers of its own, laid into a memory map and queried for the pairs of every batch.
    """
    rares = [_unpack(x.as_py(), "<u8")[0] for x in left["rare"]]
    grams = [_grams(x.as_py(), rare) for x, rare in zip(left["grams"], rares)]
    none = np.zeros(0, np.uint64)
    codes = np.unique(np.concatenate([x[c > 0] for a, b, c in grams for x in (a, b)] or [none]))
    span, numbered = len(codes) + 1, []
    for a, b, c in grams:
        at_a, at_b = (np.minimum(np.searchsorted(codes, x), max(0, len(codes) - 1)) for x in (a, b))
        there = (codes[at_a] == a) & (codes[at_b] == b) if len(codes) else np.zeros(len(a), dtype=bool)
        numbered.append((at_a * span + at_b, there, c))
    del grams
    distinct, place = np.unique(np.concatenate([k[c > 0] for k, _, c in numbered] or [none.astype(np.int64)]), return_inverse=True)
    pair_counts = np.bincount(place, weights=np.concatenate([c[c > 0] for *_, c in numbered] or [none]), minlength=len(distinct))
    order = np.argsort(right["h"].to_numpy())
    hashes, counts = right["h"].to_numpy()[order], right["c"].to_numpy()[order]

    def rare_counts(of: np.ndarray) -> np.ndarray:
        if not len(hashes):
            return np.zeros(len(of), dtype=np.int64)
        at = np.minimum(np.searchsorted(hashes, of), len(hashes) - 1)
        return np.where(hashes[at] == of, counts[at], 0)

    second = codes[distinct % span] if len(distinct) else none
    second_counts = np.where(second >= _RARE, rare_counts((second & ~_RARE).astype(np.int64)), u.known(second))
    packed = Trie.of(distinct // span, distinct % span, u.gain(pair_counts, second_counts), span, u.scale).pack()
    levels = mmap.mmap(-1, len(packed))
    levels.write(packed)
    trie = Trie.view(levels)
    # What batches learned alike is asked for once.
    known, at, gains = trie.found(distinct // span, distinct % span), 0, []
    for keys, there, c in numbered:
        own, new = np.zeros(len(keys), dtype=np.uint8), there & (c == 0)
        n = int((c > 0).sum())
        own[c > 0] = known[place[at : at + n]]
        own[new] = trie.found(keys[new] // span, keys[new] % span)
        at += n
        gains.append(_pack(own))
    found = [_pack(rare_counts(rare.astype(np.int64)).astype("<i8")) for rare in rares]
    return pa.table(
        {
            "batch": left["batch"], "shard": left["shard"], "gains": pa.array(gains, pa.binary()), "counts": pa.array(found, pa.binary()),
            "facts": left["facts"], "ids": left["ids"],
        }
    )


def _scored(u: Unigrams, shards: int, table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """The documents of one batch, scored by the answers of all shards: lengths, held out, known tokens, base, score, packed ids."""
    own = next(i for i, f in enumerate(table["facts"]) if f.is_valid)
    codes, tokens, lengths, held = _unpack(table["facts"][own].as_py(), "<u8", "<u4", "<i8", "u1")
    batch = Batch(codes, tokens.astype(np.int64), lengths)
    first, second, of = batch.pairs(u.start)
    order, ends = batch.dealt(first, second, u.start, shards)
    is_rare = codes >= _RARE
    counts = u.known(codes).astype(np.int64)
    rare_place = np.where(is_rare, ((codes & ~_RARE) % np.uint64(shards)).astype(np.int64), -1)
    gains = np.zeros(len(first))
    for shard, own_gains, own_counts in zip(table["shard"].to_pylist(), table["gains"], table["counts"]):
        gains[order[ends[3 * shard] : ends[3 * shard + 3]]] = _unpack(own_gains.as_py(), "u1")[0] / u.scale
        counts[rare_place == shard] = _unpack(own_counts.as_py(), "<i8")[0]
    base = u.log_p(counts[second])
    score = base + gains + u.backoff(np.append(counts, u.ends)[first])
    doc = np.repeat(np.arange(len(lengths)), lengths)
    total = lambda x: np.bincount(doc, weights=x[of], minlength=len(lengths))
    return lengths, held, total(counts[second] > 0), total(base), total(score), table["ids"][own].as_py()


def language_scores(docs: DataFrame, folds: int = 5, held_out_fold: int = 1, frequent_words: int = FREQUENT) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model is a bigram model: a token after a context has the probability
    (count of the pair + PRIOR * unigram probability) / (count of the context + PRIOR).
    Unigrams are smoothed as the base score has it. All words and all pairs of the training
    documents take part. What a pair adds to its unigram is quantised to 255 steps, of
    which the largest is the most that any pair can add.

    It learns from all documents whose crc32(doc_id as text) mod `folds` is not
    `held_out_fold` (a null id counts as the empty text). Documents are taken in batches.
    Each sends its distinct pairs, with how often its training documents have them, and its
    rare words to shards by a hash; only the `frequent_words` are broadcast. A shard holds
    a trie of its pairs and answers each batch with a byte for each pair and the counts of
    the rare words. So a hot pair costs one entry for each batch, however many documents
    have it, and no context or word gathers in one task.

    Null, empty and blank texts have one token, the end. Ids may be of any type, null or
    repeated; repeated rows are documents of their own. An empty table gives no rows;
    without a training document nothing is known and all scores are those of the smoothing.
    Very long texts are a batch of their own. Extra columns are ignored.
    """
    spark = docs.sparkSession
    held = remainder(F.col("doc_id"), folds) == held_out_fold
    slim = docs.select("doc_id", held.alias("held_out"), "text")
    counts = checkpointed(token_counts(slim.filter(~F.col("held_out"))))
    ends = F.coalesce(F.max(F.when(F.col("h") == END, F.col("c"))), F.lit(0))
    tokens, distinct, n_ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), ends).first()
    top = frequent(counts, frequent_words)
    # Plain arrays and numbers: what is broadcast is pickled by reference, and executors have no copy of the class.
    shared = spark.sparkContext.broadcast((top["h"].to_numpy(np.int64), top["c"].to_numpy(np.int64), tokens, distinct, n_ends))
    shards = max(1, ceil(tokens / SHARD_TOKENS))
    batch_tokens = min(max(BATCH_TOKENS, ceil(tokens / BATCHES)), max(BATCH_TOKENS, MOST_TOKENS))
    routed = route(slim, shared, shards, batch_tokens).groupBy("shard")
    words = counts.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int")).groupBy("shard")
    answers = routed.cogroup(words).applyInArrow(lambda left, right: score_shard(Unigrams(*shared.value), left, right), _PARTS)
    id_type = docs.schema["doc_id"].dataType
    fields = [("held_out", T.BooleanType()), *((c, T.LongType()) for c in ("n_tokens", "n_known")), *((c, T.DoubleType()) for c in ("base_score", "score"))]
    schema = T.StructType([T.StructField("doc_id", id_type), *(T.StructField(*f) for f in fields)])
    id_schema = pa.schema([("doc_id", to_arrow_type(id_type))])

    def scored(table: pa.Table) -> pa.Table:
        lengths, is_held, known, base, score, ids = _scored(Unigrams(*shared.value), shards, table)
        ids = pa.ipc.read_record_batch(pa.py_buffer(ids), id_schema)["doc_id"]
        return pa.table(
            {
                "doc_id": ids, "held_out": pa.array(is_held.astype(bool)), "n_tokens": pa.array(lengths, pa.int64()),
                "n_known": pa.array(np.rint(known).astype(np.int64)), "base_score": pa.array(base), "score": pa.array(score),
            }
        )

    found = answers.groupBy("batch").applyInArrow(scored, schema)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
