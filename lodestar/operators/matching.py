"""Documents matched with items by shared terms: all documents against all items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..sources.folders import settled
from . import gates as G


def _terms(df: DataFrame, key: str, text: str, kinds: dict[str, Column]) -> DataFrame:
    """One row of each distinct (key, text) with its arrays of terms."""
    return df.select(F.col(key), F.col(text).alias("_text")).distinct().select(key, F.xxhash64("_text").alias(f"_{key}"), *(c.alias(k) for k, c in kinds.items()))


def _each(df: DataFrame, keys: list[str], kinds: dict[str, str], *more: str) -> DataFrame:
    """One row of each term: keys, more, kind, term. kinds: column by kind."""
    of = lambda k: lambda t: F.struct(F.lit(k).alias("kind"), t.alias("term"))
    named = [F.transform(c, of(k)) for k, c in kinds.items()]
    return df.select(*keys, *more, F.explode(F.concat(*named)).alias("_t")).select(*keys, *more, "_t.kind", "_t.term")


def relevant_pairs(docs: DataFrame, items: DataFrame, doc_key: str, item_key: str, text: str = "text") -> DataFrame:
    """(doc_key, item_key, score) of all pairs that pass relevance_gate(), with their relevance_score().

    Query and topic terms are those of the item's whole text. Then one shared term passes the
    gate, so pairs meet on every term, and the terms they meet on are the overlap. Rows with
    one key and one text are one entry; a text without terms matches nothing.
    """
    words = lambda df, key: _terms(df, key, text, {"t": T.query_terms(F.col("_text"))}).withColumn("n", F.size("t"))
    d = _each(words(docs, doc_key), [doc_key, f"_{doc_key}"], {"query": "t"})
    i = _each(words(items, item_key), [item_key, f"_{item_key}"], {"query": "t"}, "n")
    keys = [doc_key, f"_{doc_key}", item_key, f"_{item_key}"]
    met = d.join(i, ["kind", "term"]).groupBy(*keys, "n").agg(F.count("*").alias("k"))
    share = F.col("k") / F.col("n")
    return met.select(doc_key, item_key, N.rounded(F.least(F.lit(1.0), share * 0.6 + share * 0.4), 6).alias("score"))


def scored_pairs(docs: DataFrame, items: DataFrame, doc_key: str, item_key: str, query_weight: float, topic_weight: float) -> DataFrame:
    """(doc_key, item_key, score) of all pairs that pass relevance_gate(). docs: doc_key, m; items: item_key, q, t (arrays of distinct terms).

    Pairs meet on every term of either kind, and how often they meet are the overlaps: no
    array is carried along with a pair or compared. Each row is an entry of its own.
    """
    row = lambda df, name: df.withColumn(name, F.monotonically_increasing_id())
    held = row(docs, "_doc").select("_doc", doc_key, F.explode("m").alias("term"))
    has = lambda kind: F.array_contains(kind, F.col("term")).cast("int").alias(f"in_{kind}")
    each = row(items, "_item").select("_item", item_key, "q", "t", F.explode(F.array_union("q", "t")).alias("term"))
    each = each.select("_item", item_key, "term", F.size("q").alias("nq"), F.size("t").alias("nt"), has("q"), has("t"))
    keys = ["_doc", doc_key, "_item", item_key, "nq", "nt"]
    met = held.join(each, "term").groupBy(*keys).agg(F.sum("in_q").alias("qm"), F.sum("in_t").alias("tm"))
    n = [F.col(c) for c in ("qm", "tm", "nq", "nt")]
    return met.filter(G.counted_gate(*n)).select(doc_key, item_key, N.rounded(G.counted_score(*n, query_weight, topic_weight), 6).alias("score"))


def matching_pairs(docs: DataFrame, items: DataFrame, doc_key: str, item_key: str, least: int = 2, text: str = "text") -> DataFrame:
    """(doc_key, item_key, terms_match, subject_match) of all pairs for which either holds.

    Pairs meet on topic terms, on subject terms and on anchors among the document's subject
    terms. How often they meet on each is the overlap that terms_match() and subject_match()
    ask for. Rows with one key and one text are one entry.
    """
    topic, subject = T.topic_terms(F.col("_text")), T.subject_terms(F.col("_text"))
    d = _terms(docs, doc_key, text, {"topic": topic, "subject": subject})
    i = _terms(items, item_key, text, {"topic": topic, "subject": subject, "anchors": T.subject_anchors(F.col("_text"))})
    i = i.withColumn("n_topic", F.size("topic")).withColumn("n_subject", F.size("subject"))
    # A subject without terms matches nothing, whatever its anchors.
    i = i.withColumn("anchors", F.when(F.col("n_subject") > 0, F.col("anchors")).otherwise(F.array().cast("array<string>")))
    d = _each(d.withColumn("anchors", F.col("subject")), [doc_key, f"_{doc_key}"], {"topic": "topic", "subject": "subject", "anchor": "anchors"})
    i = _each(i, [item_key, f"_{item_key}"], {"topic": "topic", "subject": "subject", "anchor": "anchors"}, "n_topic", "n_subject")
    keys = [doc_key, f"_{doc_key}", item_key, f"_{item_key}", "n_topic", "n_subject"]
    n = {k: F.count_if(F.col("kind") == k).alias(k) for k in ("topic", "subject", "anchor")}
    met = d.join(i, ["kind", "term"]).groupBy(*keys).agg(*n.values())
    enough = lambda k, few: (F.col(f"n_{k}") > 0) & (F.col(k) >= F.least(F.lit(few), F.col(f"n_{k}")))
    found = met.select(doc_key, item_key, enough("topic", least).alias("terms_match"), (enough("subject", 2) | (F.col("anchor") > 0)).alias("subject_match"))
    return found.filter("terms_match or subject_match")


def _weighted(items: DataFrame, query_weight: float, topic_weight: float) -> DataFrame:
    """One row of each term of each item (item, q, t): item, term and what the term adds to a score."""
    share = lambda of, x, w: F.when(F.array_contains(of, x), w / F.size(of)).otherwise(0.0)
    each = items.select("item", "q", "t", F.explode(F.array_union("q", "t")).alias("term"))
    return each.select("item", "term", (share(F.col("q"), F.col("term"), query_weight) + share(F.col("t"), F.col("term"), topic_weight)).alias("w"))


def pairs_to_score(docs: DataFrame, items: DataFrame, cutoff: float, query_weight: float, topic_weight: float) -> DataFrame:
    """(doc, item): the pairs that can reach the cutoff. docs: doc, m; items: item, q, t (arrays of terms).

    A weighted prefix filter: an item's terms stand in order of how many documents have
    them, the same order for all items. Its commonest terms that weigh less than the cutoff
    together cannot reach it alone, so a document that does has one of the others, and
    only those are looked up. So the commonest terms, which pair everything with
    everything, meet nothing; what remains hot is left to AQE to split.
    """
    each = _weighted(items, query_weight, topic_weight)
    held = docs.select("doc", F.explode("m").alias("term"))
    times = held.join(each.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("times"))
    commonest = Window.partitionBy("item").orderBy(F.desc("times"), "term").rowsBetween(Window.unboundedPreceding, 0)
    # Scores are rounded to six digits before they are compared; terms that no document has meet nothing.
    needed = each.join(times, "term").withColumn("together", F.sum("w").over(commonest)).filter(F.col("together") >= cutoff - 2e-6)
    return held.join(needed.select("item", "term"), "term").select("doc", "item").distinct()


def shown_pairs(
    docs: DataFrame,
    items: DataFrame,
    doc_key: str,
    item_key: str,
    text: str = "text",
    topic: str = "topic",
    cutoff: float = 0.3,
    query_weight: float = 0.7,
    topic_weight: float = 0.3,
) -> DataFrame:
    """(doc_key, item_key, score) of all pairs that pass relevance_gate() with a relevance_score() of `cutoff` or more.

    items have a text whose terms are the query and a topic of their own; docs a text. Pairs
    that can reach the cutoff are found by pairs_to_score() and then scored. Rows with one
    key and one text (and topic) are one entry. The cutoff must be above 0.
    """
    d = docs.select(F.col(doc_key).alias("key"), F.col(text).alias("text")).distinct()
    d = d.select(F.struct("key", F.xxhash64("text").alias("mark")).alias("doc"), T.query_terms(F.col("text")).alias("m"))
    i = items.select(F.col(item_key).alias("key"), F.col(text).alias("text"), F.col(topic).alias("topic")).distinct()
    mark = F.xxhash64("text", F.col("text").isNull(), "topic", F.col("topic").isNull()).alias("mark")
    i = i.select(F.struct("key", mark).alias("item"), T.query_terms(F.col("text")).alias("q"), T.topic_terms(F.col("topic")).alias("t"))
    # Texts are read and split once, and each pair's overlaps are taken once: conditions do not move below explode().
    d = settled(d)
    met = pairs_to_score(d, i, cutoff, query_weight, topic_weight).join(i, "item").join(d, "doc")
    q, t, m = F.col("q"), F.col("t"), F.col("m")
    counted = F.struct(T.overlap(q, m).alias("qm"), T.overlap(t, m).alias("tm"), F.size(q).alias("nq"), F.size(t).alias("nt"))
    met = met.select("doc", "item", F.explode(F.array(counted)).alias("n"))
    n = [F.col(f"n.{c}") for c in ("qm", "tm", "nq", "nt")]
    scored = met.filter(G.counted_gate(*n)).withColumn("score", N.rounded(G.counted_score(*n, query_weight, topic_weight), 6))
    return scored.filter(F.col("score") >= cutoff).select(F.col("doc.key").alias(doc_key), F.col("item.key").alias(item_key), "score")
