"""Toxicity by compression distance between two zstandard dictionaries.

The contents of the dictionaries are chosen here by counts, not by zstandard's trainer:
trained ones find far fewer toxic texts (figures in the README).
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remainder
from .labelled import sample

#: Labelled texts of either class that a fit reads at most.
PER_CLASS = 2000
#: Bytes of a window, in whole words.
WINDOW = 32
#: Bytes of the ordinary dictionary.
ORDINARY_BYTES = 1024
#: Shortest match that shortens a window: a whole short word with its two spaces.
MIN_MATCH = 6
#: Bytes of a segment of the toxic dictionary at most.
SEGMENT = 14
#: Steps of the calibration.
STEPS = 16

# No match begins in the last bytes of a frame, so each window gets a tail of bytes that no text has after folding.
_TAIL = b"\n" * 10
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words; ASCII punctuation and white space stand between words."""
    return text.translate(_FOLD).split()


def windows(text: bytes, size: int = WINDOW) -> list[bytes]:
    """The whole text as consecutive windows of at least `size` bytes (the last may be shorter)."""
    words = words_of(text)
    if not words:
        return []
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    joined = b" " + b" ".join(words) + b" "
    out, start = [], 0
    while start < ends[-1]:
        at = int(np.searchsorted(ends, start + size))
        stop = int(ends[min(at, len(ends) - 1)])
        out.append(joined[start : stop + 1] + _TAIL)
        start = stop
    return out


@dataclass
class Model:
    """Two dictionaries and what they were calibrated to."""

    ordinary: bytes
    toxic: bytes
    gain: int
    usual: float
    rates: tuple[float, ...]

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        setting = zstandard.ZstdCompressionParameters.from_level(
            3, min_match=MIN_MATCH, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        make = lambda content: zstandard.ZstdCompressor(
            compression_params=setting, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        )
        return make(self.ordinary), make(self.toxic + self.ordinary)

    def gains(self, text: bytes, pair) -> list[int]:
        """Bytes that the toxic dictionary saves over the ordinary one in each window."""
        plain, toxic = pair
        return [len(plain.compress(w)) - len(toxic.compress(w)) for w in windows(text)]

    def excess(self, gains: list[int]) -> int:
        """How far the hits of a text exceed what ordinary text of its length has, as a step of the calibration."""
        usual = self.usual * len(gains)
        hits = sum(g >= self.gain for g in gains)
        return min(STEPS - 1, max(0, int(2 * (hits - usual) / (usual + 1) ** 0.5)))

    def score(self, text: bytes, pair) -> float:
        return self.rates[min(self.excess(self.gains(text, pair)), len(self.rates) - 1)]


def _segments(words: set[bytes]) -> set[bytes]:
    """The words with a space on either side, and their beginnings of MIN_MATCH to SEGMENT bytes."""
    out = set()
    for w in words:
        padded = b" " + w + b" "
        out.update(padded[:n] for n in range(MIN_MATCH, min(len(padded), SEGMENT) + 1))
    return out


def train_toxic(toxic: list[bytes], ordinary: list[bytes], support: float = 0.1, lift: float = 6.0) -> list[bytes]:
    """The toxic dictionary: segments that toxic texts repeat and ordinary texts lack.

    A segment is the beginning of a word after a space, or the whole word. It must occur in
    `lift` times the share of the ordinary texts, and in at least `support` times as many
    toxic texts as the most frequent such segment. Of segments that begin alike the
    shortest is taken, then lengthened while nine in ten of its texts have the longer one.
    The most frequent stands last, nearest to the window.
    """
    with_toxic, with_plain = Counter(), Counter()
    for t in toxic:
        with_toxic.update(_segments(set(words_of(t))))
    frequent = {s: n for s, n in with_toxic.items() if n >= 3}
    for t in ordinary:
        with_plain.update(s for s in _segments(set(words_of(t))) if s in frequent)
    apart = {s: n for s, n in frequent.items() if n * max(1, len(ordinary)) > lift * (with_plain[s] + 1) * len(toxic)}
    least = support * max(apart.values(), default=0)
    apart = {s: n for s, n in apart.items() if n >= least}
    chosen = set()
    for s in sorted(apart, key=lambda s: (len(s), s)):
        if any(s[:n] in apart for n in range(MIN_MATCH, len(s))):
            continue
        while longer := max((x for x in apart if len(x) == len(s) + 1 and x.startswith(s)), key=lambda x: (apart[x], x), default=b""):
            if apart[longer] < 0.9 * apart[s]:
                break
            s = longer
        chosen.add(s)
    cut = {_cut(s, ordinary, apart[s] / len(toxic) / lift) for s in chosen}
    return sorted(cut, key=lambda s: (with_toxic[s], s))


def _cut(segment: bytes, ordinary: list[bytes], most: float) -> bytes:
    """The segment without an end that ordinary words also have inside them.

    A match may begin inside a segment; parts of it that more than a share `most` of the
    ordinary texts hold would make hits of ordinary words.
    """
    texts = [b" " + b" ".join(words_of(t)) + b" " for t in ordinary]
    for at in range(1, len(segment) - MIN_MATCH + 1):
        part = segment[at : at + MIN_MATCH]
        if sum(part in t for t in texts) > most * len(texts):
            return segment[: at + MIN_MATCH - 1]
    return segment


def train_ordinary(ordinary: list[bytes], segments: list[bytes]) -> bytes:
    """The ordinary dictionary: the words that most ordinary texts share, the most frequent last.

    Words with a toxic segment are left out: what both dictionaries held would save nothing.
    """
    seen: Counter = Counter()
    for t in ordinary:
        seen.update(b" " + w + b" " for w in set(words_of(t)) if len(w) + 2 >= MIN_MATCH)
    out = b""
    for w, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0])):
        if len(out) + len(w) > ORDINARY_BYTES:
            break
        if not any(s in w for s in segments):
            out = w + out
    return out or b"        "


def rising(rates: np.ndarray, mass: np.ndarray) -> tuple[float, ...]:
    """The nearest rates that never fall from one step to the next (pooled neighbours)."""
    pools: list[list[float]] = []
    for r, m in zip(rates.tolist(), mass.tolist()):
        pools.append([r, m, 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            (r1, m1, n1), (r2, m2, n2) = pools[-2:]
            pools[-2:] = [[(r1 * m1 + r2 * m2) / (m1 + m2), m1 + m2, n1 + n2]]
    return tuple(r for r, _, n in pools for _ in range(n))


def fit(texts: list[tuple[int, bytes]], sizes: dict[int, int]) -> Model:
    """Dictionaries and thresholds from labelled texts; sizes has how many rows each class has.

    A window whose gain reaches a threshold is a hit; the threshold is the one whose hits
    part the classes best. A score is the share of toxic texts among those whose hits
    exceed the usual rate as far, each class weighed by its size and smoothed with one
    text. Without texts of both classes every score is the share of toxic labels.
    """
    toxic, plain = ([t for y, t in texts if y == label] for label in (1, 0))
    prior = sizes.get(1, 0) / max(1, sum(sizes.values()))
    if not toxic or not plain:
        return Model(b"        ", b"", 1, 0.0, (prior,))
    segments = train_toxic(toxic, plain)
    model = Model(train_ordinary(plain, segments), b"".join(segments), 1, 0.0, (prior,))
    if not model.toxic:
        return model
    pair = model.compressors()
    gains = [(y, model.gains(t, pair)) for y, t in texts]
    weigh = {1: sizes[1] / len(toxic), 0: sizes[0] / len(plain)}
    found = []
    for gain in range(1, 7):
        n_windows = max(1, sum(len(gs) for y, gs in gains if not y))
        usual = sum(g >= gain for y, gs in gains if not y for g in gs) / n_windows
        now = Model(model.ordinary, model.toxic, gain, usual, (prior,))
        mass = np.zeros((STEPS, 2))
        for y, gs in gains:
            mass[now.excess(gs), y] += weigh[y]
        rates = (mass[:, 1] + prior) / (mass.sum(axis=1) + 1)
        now.rates = rising(rates, mass.sum(axis=1) + 1)
        right = sum(max(m) for m in mass.tolist())
        found.append((right, -gain, now))
    return max(found, key=lambda x: x[:2])[2]


def scores(text: Column, model: Model) -> Column:
    """Scores of whole texts; null and empty texts have no window and score as texts without a hit."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        pair = model.compressors()
        values = texts.cast(pa.large_binary())
        return pa.array([model.score(v.as_py() or b"", pair) for v in values], pa.float64())

    return score(text)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out_fold: int = 0, per_class: int = PER_CLASS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Labels of documents whose crc32(doc_id as text) mod `folds` is `held_out_fold` are
    never read (a null id counts as the empty text). Texts are scored whole, window by
    window; of fits that are as good the one with the smaller gain is taken. Null, empty, repeated and very long texts each get a score; an empty table
    gives no rows; labels without a document, with nulls or other values than 0 and 1 are
    left out. Extra columns are ignored.
    """
    model = fit(*sample(docs, labels, "toxic", lambda c: remainder(c, folds) != held_out_fold, per_class))
    score = scores(F.col("text"), model)
    found = docs.select("doc_id", (remainder(F.col("doc_id"), folds) == held_out_fold).alias("held_out"), score.alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
