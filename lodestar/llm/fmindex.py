"""Depth-limited bidirectional FM-indexes over word numbers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard


def _sorted_rows(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Places of a cyclic sequence in the order of the `depth` symbols from each on."""
    key, reach = symbols.astype(np.int64), 1
    while reach < depth:
        rank = key if reach == 1 else np.unique(key, return_inverse=True)[1]
        key, reach = rank * (int(rank.max(initial=0)) + 1) + np.roll(rank, -reach), 2 * reach
    return np.argsort(key)


def packed(a: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed: high bytes are mostly zero."""
    planes = np.ascontiguousarray(a, dtype="<u4").view(np.uint8).reshape(len(a), 4).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(b: bytes) -> np.ndarray:
    """The numbers of packed()."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


class Direction:
    """The Burrows-Wheeler transform of one reading direction, and what backward steps in it need."""

    def __init__(self, bwt: np.ndarray, starts: np.ndarray) -> None:
        self.bwt, self.starts, self._order = bwt, starts, None

    def rows_before(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The first row of the interval of (symbol, phrase), where `row` is that of the phrase's: C[symbol] + Occ(symbol, row)."""
        if self._order is None:
            n = len(self.bwt)
            self._order = np.sort(self.bwt * n + np.arange(n))
        return np.searchsorted(self._order, symbol * len(self.bwt) + row)


@dataclass
class Phrases:
    """Intervals of phrases of one length: words (phrase, place), first rows in both directions, and counts."""

    words: np.ndarray
    ahead: np.ndarray
    back: np.ndarray
    n: np.ndarray

    def where(self, keep: np.ndarray) -> Phrases:
        return Phrases(self.words[keep], self.ahead[keep], self.back[keep], self.n[keep])


class Index:
    """The index of a sequence of word numbers from 1 in which 0 ends every piece.

    Rows stand in the order of the first `depth` symbols, so intervals of phrases of up to
    `depth` words are exact, and so is every step that makes such a phrase from a shorter
    one. A step back in the forward transform adds a word before a phrase and gives the
    interval in the reversed text by the number of smaller words before it; a step in the
    reversed text's transform adds a word after.
    """

    def __init__(self, ahead: np.ndarray, back: np.ndarray, counts: np.ndarray) -> None:
        self.counts = counts
        self.starts = np.cumsum(counts) - counts
        self.ahead, self.back = Direction(ahead, self.starts), Direction(back, self.starts)

    @classmethod
    def of(cls, symbols: np.ndarray, depth: int) -> Index:
        """symbols must end with 0, so that phrases neither wrap around nor go on from piece to piece."""
        counts = np.bincount(symbols, minlength=1)
        transforms = []
        for s in (symbols, symbols[::-1]):
            # Reversed, the 0 at the end comes first and still stands between the last and the first word.
            rows = _sorted_rows(s, depth)
            transforms.append(s[rows - 1].astype(np.int64))
        return cls(*transforms, counts)

    def pack(self) -> list[bytes]:
        return [packed(self.ahead.bwt), packed(self.back.bwt), packed(self.counts)]

    @classmethod
    def view(cls, packed: list[bytes]) -> Index:
        return cls(*map(unpacked, packed))

    def pairs(self, allowed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, second word, count) of the pairs that occur within pieces and that allowed(first, second) lets pass."""
        keys, n = self._pair_keys(allowed)
        return keys % len(self.counts), keys // len(self.counts), n

    def _pair_keys(self, allowed) -> tuple[np.ndarray, np.ndarray]:
        second = np.repeat(np.arange(len(self.counts)), self.counts)
        first = self.ahead.bwt
        keep = (first > 0) & (second > 0)
        first, second = first[keep], second[keep]
        keep = allowed(first, second)
        return np.unique(second[keep] * len(self.counts) + first[keep], return_counts=True)

    def phrases(self, allowed) -> Phrases:
        """The pairs of pairs() with their intervals in both directions."""
        keys, n = self._pair_keys(allowed)
        size = len(self.counts)
        first, second = keys % size, keys // size
        every = np.sort(np.repeat(np.arange(size), self.counts) * size + self.ahead.bwt)
        # The rows of `second` whose word before is smaller than `first`.
        smaller = np.searchsorted(every, keys) - self.starts[second]
        return Phrases(np.stack([first, second], axis=1), self.ahead.rows_before(first, self.starts[second]), self.starts[second] + smaller, n)

    def extended(self, p: Phrases, left: bool, allowed) -> Phrases:
        """Every phrase with each word that stands before it (or, without left, after it) and that allowed(first, second) lets pass beside its neighbour."""
        size, of = len(self.counts), np.repeat(np.arange(len(p.n)), p.n)
        here, there = (p.ahead, p.back) if left else (p.back, p.ahead)
        direction = self.ahead if left else self.back
        rows = np.arange(len(of)) - np.repeat(np.cumsum(p.n) - p.n, p.n) + here[of]
        word = direction.bwt[rows]
        every = np.sort(of * size + word)
        keys, at, n = np.unique(every, return_index=True, return_counts=True)
        phrase, word = keys // size, keys % size
        edge = p.words[phrase, 0 if left else -1]
        keep = word > 0
        keep[keep] = allowed(*((word[keep], edge[keep]) if left else (edge[keep], word[keep])))
        phrase, word, n, at = phrase[keep], word[keep], n[keep], at[keep]
        stepped = direction.rows_before(word, here[phrase])
        smaller = at - (np.cumsum(p.n) - p.n)[phrase]
        moved = there[phrase] + smaller
        both = (word[:, None], p.words[phrase]) if left else (p.words[phrase], word[:, None])
        ahead, back = (stepped, moved) if left else (moved, stepped)
        return Phrases(np.concatenate(both, axis=1), ahead, back, n)
