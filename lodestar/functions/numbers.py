"""Numeric, time and hash functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C


def rounded(x: Column, digits: int = 2) -> Column:
    """Half up on the binary value: floor(x * 10**digits + 0.5) / 10**digits."""
    k = float(10**digits)
    return F.floor(x * k + 0.5) / k


def age_hours(ts: Column, as_of: Column) -> Column:
    """Hours from a timestamp to as_of, 0 at least; null counts as older than the window."""
    hours = (F.unix_micros(as_of) - F.unix_micros(ts)) / F.lit(3.6e9)
    return F.when(hours.isNotNull(), F.greatest(F.lit(0.0), hours)).otherwise(F.lit(float(C.WINDOW_HOURS + 1)))


def text_time(s: Column) -> Column:
    """Timestamp of an ISO text with a zone; null for a text without one or that cannot be read."""
    return F.when(s.rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(s))


def trend_score(views: Column, likes: Column, comments: Column, age: Column) -> Column:
    """Velocity (to 45), engagement (to 20) and recency (to 20), rounded to two digits."""
    v, a = F.greatest(F.coalesce(views, F.lit(0)), F.lit(1)).cast("double"), F.greatest(age, F.lit(0.5))
    velocity = F.least(F.lit(45.0), F.greatest(F.lit(0.0), 10.0 * F.log10(F.greatest(v / a, F.lit(1.0)))))
    engagement = F.least(F.lit(20.0), (F.coalesce(likes, F.lit(0)) + F.coalesce(comments, F.lit(0))) / v * 1000.0)
    recency = F.greatest(F.lit(0.0), 20.0 - a / float(C.WINDOW_HOURS) * 20.0)
    return rounded(F.least(F.lit(100.0), velocity + engagement + recency))


def first_positive(*values: Column) -> Column:
    """The first value that is a number above 0."""
    cast = [v.try_cast("double") for v in values]
    return F.coalesce(*(F.when(c > 0, c) for c in cast))


def srt_time(ms: Column) -> Column:
    """HH:MM:SS,mmm of whole milliseconds (fractions are cut off)."""
    m = F.floor(ms).cast("long")
    second = F.floor(m / 1000)
    parts = (F.floor(second / 3600), F.floor(second / 60) % 60, second % 60, m % 1000)
    return F.format_string("%02d:%02d:%02d,%03d", *(p.cast("long") for p in parts))


def srt_time_rounded(seconds: Column) -> Column:
    """The same from seconds, rounded to the millisecond."""
    return srt_time(F.floor(seconds * 1000 + 0.5))


def parse_srt_time(s: Column) -> Column:
    """Milliseconds of HH:MM:SS,mmm; null for anything else."""
    part = lambda k: F.regexp_extract(s, r"^(\d\d):(\d\d):(\d\d),(\d+)$", k).cast("long")
    return F.when(s.rlike(r"^\d\d:\d\d:\d\d,\d+$"), ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + part(4))


def chapter_ts(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on."""
    s = seconds.cast("long")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor(s / 60).cast("long"), (s % 60).cast("long")
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m % 60, r)).otherwise(F.format_string("%d:%02d", m, r))


def estimate_seconds(n_words: Column) -> Column:
    """Spoken length of so many words, 8 seconds at least."""
    return F.greatest(F.lit(8.0), n_words / float(C.WORDS_PER_MINUTE) * 60.0)


def whole_seconds(n_words: Column) -> Column:
    """The same cut to whole seconds, as chapters use it."""
    return F.greatest(F.lit(8), F.floor(n_words / float(C.WORDS_PER_MINUTE) * 60.0)).cast("long")


def frame_timestamps(duration: Column, n: int) -> Column:
    """n times spread over a clip without its margins."""
    margin = F.least(F.lit(0.3), duration * 0.1)
    span = F.greatest(duration - margin * 2.0, F.lit(0.1))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: margin + span * (i + 1) / float(n + 1))


def diff_hash(values: Column) -> Column:
    """A bit for each value that its right neighbour (round the end) exceeds, the first value in bit 0."""
    bits = F.transform(values, lambda x, i: F.when(F.get(values, (i + 1) % F.size(values)) > x, F.lit(1)).otherwise(F.lit(0)).cast("long"))
    placed = F.transform(bits, lambda b, i: F.call_function("shiftleft", b, i))
    return F.aggregate(placed, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))


def grid_hash(values: Column, rows: int = 8, columns: int = 9) -> Column:
    """The 64-bit difference hash of a luminance grid given row by row: bit = right neighbour is brighter."""
    bits = [
        F.when(F.get(values, F.lit(r * columns + c + 1)) > F.get(values, F.lit(r * columns + c)), F.lit(1)).otherwise(F.lit(0)).cast("long")
        for r in range(rows)
        for c in range(columns - 1)
    ]
    total = F.lit(0).cast("long")
    for i, b in enumerate(bits):
        total = total.bitwiseOR(F.shiftleft(b, len(bits) - 1 - i))
    return total


def hex_hash(s: Column) -> Column:
    """The long of 16 hexadecimal digits; null for anything else."""
    half = lambda at: F.conv(F.substring(s, at, 8), 16, 10).cast("long")
    return F.when(s.rlike("^[0-9a-fA-F]{16}$"), F.shiftleft(half(1), 32).bitwiseOR(half(9)))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two longs; 9999 where one is missing."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)), F.lit(9999))


def error_class(message: Column) -> Column:
    """auth, transient or fatal by the tokens of a message."""
    m = F.upper(F.coalesce(message, F.lit("")))
    return F.when(m.rlike("|".join(C.AUTH_ERRORS)), "auth").when(m.rlike("|".join(C.TRANSIENT_ERRORS)), "transient").otherwise("fatal")


def section_type(s: Column) -> Column:
    return F.replace(F.upper(F.trim(F.coalesce(s, F.lit("")))), F.lit("-"), F.lit("_"))


def ticks_to_ms(x: Column) -> Column:
    """Milliseconds of 100-nanosecond ticks."""
    return x / 10_000.0
