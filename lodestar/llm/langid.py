"""Language identification with bit-sliced Bloom filters of byte n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import remainder
from .labelled import texts_of

#: Documents that a fit reads at most, shared evenly among the languages.
FIT_DOCS = 3000
#: Bytes of an n-gram.
GRAM = 4
#: A language holds the n-grams in at least this share of its texts ...
SUPPORT = 0.02
#: ... if no other language has it in a share more than this many times as high.
CONTRAST = 8.0
#: Slots an n-gram is put into.
PROBES = 3
#: Share of the corrected counts that a language must have for a document to stay in a corpus.
LEAST_SCORE = 0.4

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def grams(text: bytes) -> np.ndarray:
    """All byte n-grams of a whole text: letters lower-cased, everything else one space."""
    folded = b"  " + b" ".join(text.translate(_FOLD).split()) + b" "
    a = np.frombuffer(folded, dtype=np.uint8).astype(np.uint64)
    if len(a) < GRAM:
        return a[:0]
    out = a[: len(a) - GRAM + 1].copy()
    for i in range(1, GRAM):
        out = (out << np.uint64(8)) | a[i : len(a) - GRAM + 1 + i]
    return out


@dataclass
class Model:
    """slots[s] is a row of bytes with one bit a language: which filters have slot s set."""

    langs: list[str]
    prior: int
    slots: np.ndarray
    false_rate: np.ndarray

    def holders(self, found: np.ndarray) -> np.ndarray:
        """For each n-gram the bits of all languages that contain it, by one AND over its slots."""
        shift = np.uint64(64 - int(len(self.slots)).bit_length() + 1)
        mixed = found * np.uint64(0x9E3779B97F4A7C15)
        bits = None
        for _ in range(PROBES):
            at = self.slots[(mixed >> shift).astype(np.int64)]
            bits = at if bits is None else bits & at
            mixed = mixed * np.uint64(0xD1342543DE82EF95) + np.uint64(0x2545F4914F6CDD1D)
        return bits

    def counts(self, text: bytes) -> np.ndarray:
        """The n-grams that each language contains, less those expected from false positives."""
        found = grams(text)
        hits = np.zeros(len(self.langs))
        for at in range(0, len(found), 1 << 18):
            bits = self.holders(found[at : at + (1 << 18)])
            hits += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0)[: len(self.langs)]
        return np.maximum(0.0, (hits - len(found) * self.false_rate) / (1 - self.false_rate))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0
        counts = self.counts(text.encode("utf-8", "surrogatepass"))
        total = counts.sum()
        if not total:
            return self.langs[self.prior], 0.0
        best = int(counts.argmax())
        return self.langs[best], float(min(1.0, counts[best] / total))


def fit(texts: list[tuple[str, str]], all_sizes: dict[str, int] | None = None) -> Model:
    """Filters from (language, text) pairs; ties between languages go to the first by name.

    all_sizes: how many texts each language has beyond the sample, for the prior.
    """
    langs = sorted({lang for lang, _ in texts})
    if not langs:
        return Model([], 0, np.zeros((2, 1), np.uint8), np.zeros(0))
    sizes = np.array([sum(lang == x for x, _ in texts) for lang in langs])
    found: dict[int, np.ndarray] = {}
    for i, lang in enumerate(langs):
        own = [np.unique(grams(t.encode())) for x, t in texts if x == lang]
        values, n = np.unique(np.concatenate(own), return_counts=True)
        share = n / sizes[i]
        for g, s in zip(values[share >= SUPPORT].tolist(), share[share >= SUPPORT].tolist()):
            found.setdefault(g, np.zeros(len(langs)))[i] = s
    keys = np.array(list(found), dtype=np.uint64)
    shares = np.array(list(found.values())).reshape(len(keys), len(langs))
    held = (shares > 0) & (shares * CONTRAST >= shares.max(axis=1, initial=0.0, keepdims=True))
    largest = max(1, int(held.sum(axis=0).max(initial=0)))
    n_slots = 1 << max(12, (8 * largest - 1).bit_length())
    prior = np.array([(all_sizes or {}).get(lang, n) for lang, n in zip(langs, sizes)])
    model = Model(langs, int(prior.argmax()), np.zeros((n_slots, (len(langs) + 7) // 8), np.uint8), np.zeros(len(langs)))
    packed = np.packbits(held, axis=1, bitorder="little")
    shift, mixed = np.uint64(64 - n_slots.bit_length() + 1), keys * np.uint64(0x9E3779B97F4A7C15)
    for _ in range(PROBES):
        np.bitwise_or.at(model.slots, (mixed >> shift).astype(np.int64), packed)
        mixed = mixed * np.uint64(0xD1342543DE82EF95) + np.uint64(0x2545F4914F6CDD1D)
    fill = np.unpackbits(model.slots, axis=1, bitorder="little")[:, : len(langs)].mean(axis=0)
    model.false_rate = np.minimum(fill**PROBES, 0.99)
    return model


def train_model(docs: DataFrame, train: Column, fit_docs: int = FIT_DOCS) -> Model:
    """Fit on a sample that a hash of the texts draws, of even size from each language.

    Texts alike in language and content are one. Each language gives the fit_docs / n texts
    (one at least) that come first in the order of the hash, longer ones in pieces; one
    count for each language reaches the driver.
    """
    known = docs.filter("lang is not null and text is not null").filter(train).select("lang", "text")
    marks = known.select("lang", F.xxhash64("text").alias("mark")).distinct()
    sizes = {r["lang"]: r["n"] for r in marks.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return fit([])
    each = max(1, fit_docs // len(sizes))
    # Only texts whose hash is small enough to be among the first are ranked, some more than needed.
    rates = [(lang, min(1.0, (each + 10 * each**0.5 + 20) / n)) for lang, n in sizes.items()]
    rates = F.broadcast(docs.sparkSession.createDataFrame(rates, "of_lang string, rate double"))
    drawn = F.shiftrightunsigned(F.xxhash64("lang", "mark"), 11) / F.lit(float(1 << 53))
    few = marks.withColumn("drawn", drawn).join(rates, (F.col("lang") == F.col("of_lang")) & (F.col("drawn") <= F.col("rate")))
    order = Window.partitionBy("lang").orderBy("drawn", "mark")
    chosen = few.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= each).select("lang", "mark")
    found = texts_of(known, chosen, "lang").select("lang", "text").collect()
    return fit(sorted((r["lang"], r["text"]) for r in found), sizes)


def predictions(text: Column, model: Model) -> Column:
    """A struct (lang_pred, score) for each whole text."""

    @F.arrow_udf("lang_pred string, score double")
    def identify(texts: pa.Array) -> pa.Array:
        rows = [model.predict(v.as_py()) for v in texts]
        langs, scores = zip(*rows) if rows else ((), ())
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return identify(text)


def identify(docs: DataFrame, folds: int = 3, held_out_fold: int = 1, fit_docs: int = FIT_DOCS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Learns from text and lang of documents whose crc32(doc_id as text) mod `folds` is not
    `held_out_fold` (a null id counts as the empty text). lang_pred is `und` with score 0
    where the text is null or has no letter; a text with letters of which no language holds
    an n-gram gets the most frequent language of the sample with score 0. The score is the
    winner's part of all corrected counts. Repeated rows each get a row; an empty table
    gives none; without a known language everything is `und`. Extra columns are ignored.
    """
    train = remainder(F.col("doc_id"), folds) != held_out_fold
    model = train_model(docs, train, fit_docs)
    found = docs.select("doc_id", (~train).alias("held_out"), predictions(F.col("text"), model).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


def keep_identified(
    docs: DataFrame,
    languages: tuple[str, ...] | None = None,
    least_score: float = LEAST_SCORE,
    folds: int = 3,
    held_out_fold: int = 1,
    fit_docs: int = FIT_DOCS,
) -> DataFrame:
    """The documents whose language is told with at least `least_score`, with all their columns.

    With `languages`, it must be one of them. Documents that are null, empty or without a
    letter go, and those that no language has so much of: its share of all corrected
    counts, so mixtures of more than two languages and letters that form no known word go.
    Where no language can be learned, all documents with a letter stay. Ties go to the
    first language by name. Repeated rows stay or go together; an empty table gives no rows.
    """
    train = remainder(F.col("doc_id"), folds) != held_out_fold
    model = train_model(docs, train, fit_docs)
    if not model.langs:
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = predictions(F.col("text"), model)
    told = (found["lang_pred"] != "und") & (found["score"] >= least_score)
    return docs.filter(told & found["lang_pred"].isin(*languages) if languages else told)
