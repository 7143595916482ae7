"""Quality by nearest-neighbour voting over latent-semantic vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remainder
from .labelled import sample

#: Labelled texts of either class that a fit reads at most: 4000 vectors are broadcast at most.
PER_CLASS = 2000
#: Hashed terms, latent dimensions, neighbours, and the power a similarity is raised to as a weight.
TERMS, LATENT, NEIGHBOURS, SHARPNESS = 4096, 48, 15, 16
#: Length of a pseudo-term in that of all other terms together.
PSEUDO = 0.25
#: Documents in a block of cosine products.
BLOCK = 512


def _classes() -> np.ndarray:
    """Byte to character class: letters by case, digits, bytes of other letters; the rest stand for themselves."""
    out = np.arange(256, dtype=np.uint32)
    out[ord("a") : ord("z") + 1] = ord("a")
    out[ord("A") : ord("Z") + 1] = ord("A")
    out[ord("0") : ord("9") + 1] = ord("0")
    out[128:] = 128
    return out


_CLASS = _classes()


def terms(text: bytes) -> np.ndarray:
    """Weights of the hashed terms of a whole text, as float32.

    Terms are the 4-grams of character classes, the bytes next to each other, and pseudo
    terms for the share of words that repeat the word before or any earlier word and for
    the number of words.
    """
    out = np.zeros(TERMS, dtype=np.float32)
    raw = np.frombuffer(text, dtype=np.uint8)
    for block in range(0, len(raw), 1 << 18):
        part = raw[block : block + (1 << 18) + 3]
        c = _CLASS[part]
        if len(c) >= 4:
            g = ((c[:-3] << 24) | (c[1:-2] << 16) | (c[2:-1] << 8) | c[3:]) * np.uint32(0x9E3779B1)
            out[: TERMS // 2] += np.bincount(g >> np.uint32(21), minlength=TERMS // 2)
        if len(part) >= 2:
            b = ((part[:-1].astype(np.uint32) << 8) | part[1:]) * np.uint32(0x85EBCA6B)
            out[TERMS // 2 : TERMS - 32] += np.bincount((b >> np.uint32(16)) % np.uint32(TERMS // 2 - 32), minlength=TERMS // 2 - 32)
    out[: TERMS - 32] = np.sqrt(out[: TERMS - 32])
    scale = float(np.sqrt((out**2).sum())) or 1.0
    words = text.split()
    n = max(1, len(words))
    again = sum(map(bytes.__eq__, words, words[1:])) / n
    fresh = len(set(words)) / n
    out[TERMS - 32 + min(9, int(10 * again))] = PSEUDO * scale
    out[TERMS - 22 + min(9, int(10 * fresh))] = PSEUDO * scale
    out[TERMS - 12 + min(11, n.bit_length())] = PSEUDO * scale
    return out / np.float32(scale)


@dataclass
class Model:
    """Term weights and latent axes, the labelled vectors with their labels and weights, and the prior."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    prior: float

    def latent(self, texts: list[bytes]) -> np.ndarray:
        matrix = np.stack([terms(t) for t in texts]) * self.idf @ self.axes
        length = np.linalg.norm(matrix, axis=1, keepdims=True)
        return (matrix / np.where(length > 0, length, 1)).astype(np.float32)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The weighted vote of the nearest labelled vectors, from exact cosines in blocks."""
        if not len(self.vectors):
            return np.full(len(texts), self.prior)
        out = np.empty(len(texts))
        k = min(NEIGHBOURS, len(self.vectors))
        for at in range(0, len(texts), BLOCK):
            cosines = self.latent(texts[at : at + BLOCK]) @ self.vectors.T
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            weight = np.clip(np.take_along_axis(cosines, near, axis=1), 0, 1).astype(np.float64) ** SHARPNESS * self.weights[near]
            mass = weight.sum(axis=1)
            vote = (weight * self.labels[near]).sum(axis=1)
            out[at : at + BLOCK] = (vote + 1e-3 * self.prior) / (mass + 1e-3)
        return np.clip(out, 0.0, 1.0)


def fit(texts: list[tuple[int, bytes]], sizes: dict[int, int]) -> Model:
    """Latent axes and labelled vectors; sizes has how many labelled rows each class has.

    A neighbour's vote counts as many rows as it stands for in its class. Without any
    labelled text the score is the share of label 1.
    """
    prior = sizes.get(1, 0) / max(1, sum(sizes.values()))
    none = np.zeros((0, LATENT), np.float32)
    if not texts:
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, LATENT), np.float32), none, none[:, 0], none[:, 0], prior)
    matrix = np.stack([terms(t) for _, t in texts])
    labels = np.array([y for y, _ in texts])
    idf = np.log((1 + len(texts)) / (1 + (matrix > 0).sum(axis=0))).astype(np.float32) + 0.3
    matrix *= idf
    # The leading axes by subspace iteration: no terms by terms matrix is made.
    axes = np.random.default_rng(0).standard_normal((TERMS, LATENT)).astype(np.float32)
    for _ in range(12):
        axes = np.linalg.qr(matrix.T @ (matrix @ axes))[0].astype(np.float32)
    del matrix
    stands_for = {y: sizes.get(y, 0) / max(1, int((labels == y).sum())) for y in (0, 1)}
    model = Model(idf, axes, none, labels.astype(np.float64), np.array([stands_for[y] for y in labels.tolist()]), prior)
    model.vectors = model.latent([t for _, t in texts])
    return model


def scores(text: Column, model: Model, spark) -> Column:
    """Scores of whole texts; null counts as empty, and an empty text is scored like any other."""
    # Plain arrays: what is broadcast is pickled by reference, and executors have no copy of the class.
    shared = spark.sparkContext.broadcast((model.idf, model.axes, model.vectors, model.labels, model.weights, model.prior))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(Model(*shared.value).scores([v.as_py() or b"" for v in texts.cast(pa.large_binary())]), pa.float64())

    return score(text)


def quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out_fold: int = 0, per_class: int = PER_CLASS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 where the score is 0.3 or more).

    Labels of documents whose crc32(doc_id as text) mod `folds` is `held_out_fold` are
    never read (a null id counts as the empty text). The labelled vectors that are broadcast
    are bounded by 2 * per_class; every document is compared with all of them. Null, empty,
    repeated and very long texts each get a score; an empty table gives no rows; labels
    without a document, with nulls or other values than 0 and 1 are left out. Extra columns
    are ignored.
    """
    model = fit(*sample(docs, labels, "quality", lambda c: remainder(c, folds) != held_out_fold, per_class))
    score = scores(F.col("text"), model, docs.sparkSession)
    found = docs.select("doc_id", (remainder(F.col("doc_id"), folds) == held_out_fold).alias("held_out"), score.alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
