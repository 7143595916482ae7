"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings."""

from __future__ import annotations

import hashlib
import re
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns and the order of their kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "entropy")
#: Without one of these in its lower-cased bytes, a text has no assignment.
HINTS = (b"passw", b"secret", b"token", b"api")

#: Characters of a sliding window, and of a candidate string at least.
WINDOW = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Bits a character at which a window of each class counts as random. A window without both
#: a letter and a digit has no class: words, numbers and rulers are not secrets.
THRESHOLDS = {"hex": 3.0, "lower": 3.5, "upper": 3.5, "mixed": 3.7}
#: Strings that look random and are not: placeholders, alphabets, nil and sample identifiers.
ALLOWED = re.compile(
    r"example|sample|placeholder|changeme|your(?:[_-]?(api|key|token|secret))+[_-]?|x{6,}|(.)\2{7,}"
    r"|abcdefghij|0123456789|1234567890|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
    re.IGNORECASE | re.ASCII,
)

_DIGITS, _HEX_LETTERS = frozenset("0123456789"), frozenset("abcdefABCDEF")
_LOWER, _UPPER = frozenset("abcdefghijklmnopqrstuvwxyz"), frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_TERM = [0.0] + [n * log2(n) for n in range(1, WINDOW + 1)]


def _class_of(hexes: int, lower: int, upper: int, digits: int) -> str | None:
    if not digits or not lower + upper:
        return None
    if hexes == WINDOW:
        return "hex"
    return "mixed" if lower and upper else "lower" if lower else "upper"


def random_runs(s: str) -> list[tuple[int, int]]:
    """(start, end) of the merged windows of s whose entropy reaches their class's threshold.

    Counts of characters and of classes, and the sum of n log n over the counts, are kept
    up to date as one character enters the window and one leaves it.
    """
    counts: dict[str, int] = {}
    total, seen, out = 0.0, [0, 0, 0, 0], []

    def put(c: str, by: int) -> None:
        nonlocal total
        n = counts.get(c, 0)
        total += _TERM[n + by] - _TERM[n]
        counts[c] = n + by
        seen[0] += by * (c in _DIGITS or c in _HEX_LETTERS)
        seen[1] += by * (c in _LOWER)
        seen[2] += by * (c in _UPPER)
        seen[3] += by * (c in _DIGITS)

    for i, c in enumerate(s):
        if i >= WINDOW:
            put(s[i - WINDOW], -1)
        put(c, 1)
        if i >= WINDOW - 1 and (kind := _class_of(*seen)) and log2(WINDOW) - total / WINDOW >= THRESHOLDS[kind]:
            start = i - WINDOW + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order; offsets are code points."""
    found = []
    if any(h in low for low in [text.encode("utf-8", "surrogatepass").lower()] for h in HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _between(start: int, end: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of start:end outside the taken spans."""
    out = []
    for a, b in sorted(taken):
        if a > start:
            out.append((start, min(a, end)))
        start = max(start, b)
        if start >= end:
            break
    return [x for x in [*out, (start, end)] if x[0] < x[1]]


def entropy_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that entropy adds to the base spans.

    What the allow-list matches and what base spans hold is blanked out; the windows of
    the parts between them count.
    """
    found, taken = [], [(a, b) for a, _, b in base]
    for m in CANDIDATE.finditer(text):
        s = m[0]
        if s.isalpha() or s.isdigit():
            continue
        known = [(a, b) for a, b in taken if a < m.end() and m.start() < b]
        known += [(m.start() + x.start(), m.start() + x.end()) for x in ALLOWED.finditer(s)]
        for a, b in _between(m.start(), m.end(), known):
            found += [(a + start, 3, a + end) for start, end in random_runs(text[a:b])]
    return found


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(text: Column) -> Column:
    """A struct for each whole text: n_assign, n_access, n_hex, n_entropy, base_sha256, spans.

    Null is an empty text; a text without a secret has counts 0, the hash of the empty
    string and empty spans.
    """
    fields = "n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string"

    @F.arrow_udf(fields)
    def secrets(texts: pa.Array) -> pa.Array:
        rows = []
        for v in texts:
            text = v.as_py() or ""
            base = base_spans(text)
            more = entropy_spans(text, base)
            kinds = [k for _, k, _ in base]
            digest = hashlib.sha256(_joined(base).encode()).hexdigest()
            rows.append((kinds.count(0), kinds.count(1), kinds.count(2), len(more), digest, _joined(sorted(base + more))))
        columns = list(zip(*rows)) or [()] * 6
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        names = [f.split()[0] for f in fields.split(", ")]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return secrets(text)


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and the fields of scan().

    Every row is scanned whole, however long, and on its own, so repeated rows, ties and null
    ids need no rule; null and empty texts have no spans; an empty table gives no rows; extra
    columns are ignored. Windows of letters alone have no threshold: a key without a digit is
    found only by the base patterns.
    """
    return docs.select("doc_id", scan(F.col("text")).alias("found")).select("doc_id", "found.*")
