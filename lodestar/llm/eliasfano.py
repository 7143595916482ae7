"""Elias-Fano sequences and n-gram tries over them, in flat buffers that are read in place."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Codes of quantised values; code c stands for c / scale.
CODES = 256


@dataclass
class EliasFano:
    """A sequence of n numbers that never falls, below `universe`, as low bits and a bit vector of high parts.

    The high part of a number is its value over 2**low_bits. In `high`, number i sets bit
    (high part + i), so every 0 closes one high part. `ranks` has the ones before each
    64-bit word, which lets select and search start near their goal.
    """

    n: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray
    ranks: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        low_bits = max(0, int(universe // max(1, n)).bit_length() - 1)
        values = values.astype(np.uint64)
        bits = ((values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).reshape(-1)
        low = np.append(np.packbits(bits, bitorder="little"), np.zeros(8, np.uint8))
        size = int(universe >> low_bits) + n + 1
        marks = np.zeros(-(-size // 64) * 64, dtype=np.uint8)
        marks[(values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(marks, bitorder="little").view("<u8")
        ranks = np.concatenate(([0], np.bitwise_count(high).cumsum())).astype("<i8")
        return cls(n, low_bits, low, high, ranks)

    def low_part(self, i: np.ndarray) -> np.ndarray:
        """The low bits of numbers i, from the 8 bytes around them."""
        if not self.low_bits:
            return np.zeros(len(i), dtype=np.int64)
        at = i * self.low_bits
        window = np.zeros(len(i), dtype=np.uint64)
        for k in range(8):
            window |= self.low[(at >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
        return ((window >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """The bit position of the k-th (from 0) one or zero: a word by binary search, then a bit in it."""
        before = self.ranks if ones else np.arange(len(self.ranks)) * 64 - self.ranks
        word = np.searchsorted(before, k, side="right") - 1
        rest = k - before[word]
        bits = self.high[np.minimum(word, len(self.high) - 1)]
        bits = bits if ones else ~bits
        # Halve the word six times, keeping the half that holds the wanted bit.
        shift = np.zeros(len(k), dtype=np.uint64)
        for half in (32, 16, 8, 4, 2, 1):
            part = (bits >> shift) & np.uint64((1 << half) - 1)
            count = np.bitwise_count(part).astype(np.int64)
            beyond = rest >= count
            rest = np.where(beyond, rest - count, rest)
            shift = np.where(beyond, shift + np.uint64(half), shift)
        return word * 64 + shift.astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The numbers at i."""
        return ((self._select(i, True) - i) << self.low_bits) | self.low_part(i)

    def successor(self, x: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each x the position of the first number >= x among positions [first, end); end if there is none.

        The zeros of `high` give the positions that share the high part of x; a binary
        search over their low bits finds the place.
        """
        high = x >> self.low_bits
        start = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) - (high - 1), 0)
        stop = self._select(high, False) - high
        a, b = np.maximum(start, first), np.minimum(stop, end)
        want = x & ((1 << self.low_bits) - 1)
        while (live := a < b).any():
            middle = (a + b) >> 1
            less = live & (self.low_part(np.minimum(middle, max(0, self.n - 1))) < want)
            a, b = np.where(less, middle + 1, a), np.where(live & ~less, middle, b)
        return np.minimum(np.maximum(a, first), end)

    def pack(self) -> list[bytes]:
        return [np.array([self.n, self.low_bits], dtype="<i8").tobytes(), self.low.tobytes(), self.high.tobytes(), self.ranks.tobytes()]

    @classmethod
    def view(cls, parts: list[memoryview]) -> EliasFano:
        n, low_bits = np.frombuffer(parts[0], dtype="<i8").tolist()
        return cls(n, low_bits, *(np.frombuffer(p, dtype=t) for p, t in zip(parts[1:], (np.uint8, "<u8", "<i8"))))


@dataclass
class Trie:
    """Bigrams under their contexts, each with a quantised value.

    contexts: the distinct first words, rising. pointers: where the successors of each
    begin, one more at the end. successors: second words, rising within a context; to never
    fall over the whole level, each is stored plus `span` times its context's number, so a
    search is relative to its context.
    """

    span: int
    contexts: EliasFano
    pointers: EliasFano
    successors: EliasFano
    codes: np.ndarray

    @classmethod
    def of(cls, first: np.ndarray, second: np.ndarray, values: np.ndarray, span: int, scale: float) -> Trie:
        """From distinct bigrams in rising order, of words below `span`, and values from 0 to (CODES - 1) / scale."""
        contexts, starts = np.unique(first, return_index=True)
        number = np.repeat(np.arange(len(contexts)), np.diff(np.append(starts, len(first))))
        codes = np.clip(np.rint(values * scale), 0, CODES - 1).astype(np.uint8)
        return cls(
            span,
            EliasFano.of(contexts, span),
            EliasFano.of(np.append(starts, len(first)), len(first) + 1),
            EliasFano.of(second + number * span, max(1, len(contexts)) * span),
            codes,
        )

    def found(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The codes of bigrams; 0 for those that are not there."""
        out = np.zeros(len(first), dtype=np.uint8)
        n = self.contexts.n
        if not n or not len(first):
            return out
        zeros = np.zeros(len(first), dtype=np.int64)
        at = self.contexts.successor(first, zeros, zeros + n)
        known = at < n
        known[known] = self.contexts.get(at[known]) == first[known]
        at, wanted = at[known], second[known]
        begin, end = self.pointers.get(at), self.pointers.get(at + 1)
        wanted = wanted + at * self.span
        place = self.successors.successor(wanted, begin, end)
        there = place < end
        there[there] = self.successors.get(place[there]) == wanted[there]
        found = np.zeros(len(at), dtype=np.uint8)
        found[there] = self.codes[place[there]]
        out[known] = found
        return out

    def pack(self) -> bytes:
        """One buffer: the number of parts, their lengths, then the parts, each aligned to 8 bytes."""
        parts = [np.array([self.span], dtype="<i8").tobytes()]
        for level in (self.contexts, self.pointers, self.successors):
            parts += level.pack()
        parts.append(self.codes.tobytes())
        head = np.array([len(parts), *map(len, parts)], dtype="<i8").tobytes()
        return head + b"".join(p + bytes(-len(p) % 8) for p in parts)

    @classmethod
    def view(cls, buffer) -> Trie:
        """A trie on a buffer (bytes or a memory map), whose levels are read in place."""
        whole = memoryview(buffer)
        n = int(np.frombuffer(whole[:8], dtype="<i8")[0])
        sizes = np.frombuffer(whole[8 : 8 * (n + 1)], dtype="<i8").tolist()
        parts, at = [], 8 * (n + 1)
        for size in sizes:
            parts.append(whole[at : at + size])
            at += size + -size % 8
        span = int(np.frombuffer(parts[0], dtype="<i8")[0])
        levels = [EliasFano.view(parts[k : k + 4]) for k in (1, 5, 9)]
        return cls(span, *levels, np.frombuffer(parts[13], dtype=np.uint8))
