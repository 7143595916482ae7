"""Text functions: normal forms, terms, anchors, sentences and chunks. All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C


def _array(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def normalize_text(s: Column) -> Column:
    """Lower case, every run of anything but a-z and 0-9 as one space, trimmed; null gives ''."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), "[^a-z0-9]+", " "))


def tokens(s: Column) -> Column:
    """Distinct tokens of the normal form in order of appearance."""
    return F.array_distinct(F.split(normalize_text(s), " "))


def terms_of(found: Column, stop: tuple[str, ...], least: int = 3) -> Column:
    """Of distinct tokens those that are no stop words and have at least `least` letters.

    To take several kinds of terms from one text, select its tokens first.
    """
    return F.filter(F.array_except(found, _array(stop)), lambda t: F.length(t) >= least)


def _tokens(s: Column, stop: tuple[str, ...], least: int) -> Column:
    return terms_of(tokens(s), stop, least)


def topic_tokens(s: Column) -> Column:
    """Tokens by which two topics are compared: any length but empty."""
    return _tokens(s, C.TOPIC_STOP, 1)


def topic_terms(s: Column) -> Column:
    """Terms of three letters or more that are not generic."""
    return _tokens(s, C.GENERIC_WORDS, 3)


def query_terms(s: Column) -> Column:
    """Terms of a media query."""
    return _tokens(s, C.QUERY_STOP, 3)


def subject_terms(s: Column) -> Column:
    """Terms of a research subject."""
    return _tokens(s, C.SUBJECT_STOP, 3)


def subject_anchors(s: Column) -> Column:
    """Sorted anchors of a subject: hashtags, capitalised or all-caps words, and words of six letters or more."""
    s = F.coalesce(s, F.lit(""))
    # Letters beyond ASCII belong to words, so that a word does not end before them.
    plain = F.regexp_replace(s, r"[\p{L}\p{N}&&[^\x00-\x7F]]", "_")
    tags = F.regexp_extract_all(s, F.lit("#([A-Za-z0-9_]+)"), F.lit(1))
    names = F.regexp_extract_all(plain, F.lit(r"(\b[A-Z][A-Za-z0-9-]{2,}\b|\b[A-Z]{2,}\b)"), F.lit(1))
    clean = F.transform(F.concat(tags, names), lambda t: F.regexp_replace(F.lower(t), "[^a-z0-9]", ""))
    words = F.regexp_extract_all(F.lower(s), F.lit("([A-Za-z0-9]+)"), F.lit(1))
    found = F.array_union(F.filter(clean, lambda t: F.length(t) >= 3), F.filter(words, lambda t: F.length(t) >= 6))
    return F.array_sort(F.array_except(found, _array(C.ANCHOR_STOP)))


def terms_union(*arrays: Column) -> Column:
    """Sorted union of term arrays; null arrays count as empty."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.flatten(F.array(*(F.coalesce(a, none) for a in arrays)))))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def json_object(s: Column) -> Column:
    """The text from the first { to the last }, null where there is none."""
    found = F.regexp_extract(s, r"(\{[\s\S]*\})", 1)
    return F.when(found != "", found)


def hashtags(tags: Column, most: int | None = 8) -> Column:
    """The first tags (with None all) without spaces, each after a #, joined by spaces."""
    return F.array_join(F.transform(tags if most is None else F.slice(tags, 1, most), lambda t: F.concat(F.lit("#"), F.replace(t, F.lit(" "), F.lit("")))), " ")


def clip_text(s: Column, most: int, suffix: str = "") -> Column:
    """s cut at `most` characters, with a suffix if it was longer."""
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most), F.lit(suffix))).otherwise(s)


def words(s: Column) -> Column:
    """Tokens between white space."""
    return F.filter(F.split(F.coalesce(s, F.lit("")), r"\s+"), lambda w: w != "")


def word_count(s: Column) -> Column:
    return F.size(words(s)).cast("long")


def split_sentences(s: Column) -> Column:
    """Sentences, which end at . ! ? or an ellipsis before white space; blank ones are dropped."""
    parts = F.transform(F.split(F.coalesce(s, F.lit("")), r"(?<=[.!?…])\s+"), lambda p: F.trim(F.regexp_replace(p, r"^\s+|\s+$", "")))
    return F.filter(parts, lambda p: p != "")


def chunk_text(s: Column, max_words: int = 260) -> Column:
    """Chunks of whole sentences of at most max(80, max_words) words; a longer sentence is split by words.

    A fold over the sentences: the open chunk is a string and its number of words. A text
    without a sentence gives no chunk.
    """
    most = max(80, max_words)
    sentences = F.transform(split_sentences(s), lambda x: F.struct(x.alias("text"), words(x).alias("words")))
    start = F.struct(
        F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n")
    )

    def closed(acc: Column) -> Column:
        return F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))

    def add(acc: Column, x: Column) -> Column:
        n = F.size(x["words"])
        parts = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / most).cast("int")), lambda i: F.array_join(F.slice(x["words"], i * most + 1, most), " "))
        long = F.struct(F.concat(closed(acc), parts).alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))
        fresh = F.struct(closed(acc).alias("done"), x["text"].alias("open"), n.alias("n"))
        joined = F.when(acc["open"] == "", x["text"]).otherwise(F.concat(acc["open"], F.lit(" "), x["text"]))
        more = F.struct(acc["done"].alias("done"), joined.alias("open"), (acc["n"] + n).alias("n"))
        return F.when(n > most, long).when((acc["open"] != "") & (acc["n"] + n > most), fresh).otherwise(more)

    return F.aggregate(sentences, start, add, closed)
