"""Filters and gates: safety, recency, limits, relevance, verdicts and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from ..functions import urls as U


def not_banned(text: Column, keywords: tuple[str, ...] = C.BANNED_KEYWORDS, whole_word: bool = False) -> Column:
    """False where the normal form holds a normalised keyword, also inside a word unless whole_word."""
    import re

    keys = [" ".join(re.sub("[^a-z0-9]+", " ", k.lower()).split()) for k in keywords]
    keys = [k for k in keys if k]
    if not keys:
        return F.lit(True)
    pattern = "|".join(sorted(set(keys)))
    return ~T.normalize_text(text).rlike(rf"\b({pattern})\b" if whole_word else pattern)


def recent(ts: Column, as_of: str, hours: int = C.WINDOW_HOURS) -> Column:
    """Timestamps within `hours` before as_of: a plain range, so it reaches the scan."""
    return ts >= F.expr(f"TIMESTAMP '{as_of}' - INTERVAL {int(hours)} HOURS")


def required(*columns: Column) -> Column:
    """All given columns are non-blank."""
    out = F.lit(True)
    for c in columns:
        out = out & F.coalesce(F.trim(c) != "", F.lit(False))
    return out


def limit_reason(duration: Column, size: Column, preview: Column | None = None) -> Column:
    """Why an item is too large, null if nothing known speaks against it; with `preview`, blank ones are a reason."""
    out = F.when(duration > C.MAX_SECONDS, "duration").when(size > C.MAX_BYTES, "size")
    if preview is not None:
        out = out.when(F.trim(F.coalesce(preview, F.lit(""))) == "", "preview")
    return out


def relevance_gate(q: Column, t: Column, m: Column) -> Column:
    """Term arrays of query, topic and metadata: whether the metadata is about them at all."""
    return counted_gate(T.overlap(q, m), T.overlap(t, m), F.size(q), F.size(t))


def counted_gate(qm: Column, tm: Column, nq: Column, nt: Column) -> Column:
    """relevance_gate() from how many of the nq query and nt topic terms the metadata has."""
    with_query = (qm > 0) & ((nt == 0) | (tm >= 1) | (qm >= 2))
    return F.when(nq > 0, with_query).when(nt > 0, tm >= 1).otherwise(False)


def relevance_score(q: Column, t: Column, m: Column, query_weight: float = 0.6, topic_weight: float = 0.4) -> Column:
    """Weighted shares of query and topic terms that the metadata has, 1 at most."""
    return counted_score(T.overlap(q, m), T.overlap(t, m), F.size(q), F.size(t), query_weight, topic_weight)


def counted_score(qm: Column, tm: Column, nq: Column, nt: Column, query_weight: float = 0.6, topic_weight: float = 0.4) -> Column:
    """relevance_score() from the same numbers as counted_gate()."""
    share = lambda k, n: k / F.greatest(n, F.lit(1))
    return F.least(F.lit(1.0), share(qm, nq) * query_weight + share(tm, nt) * topic_weight)


def _said(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def verdict_ok(
    domain: Column, subject: Column, evidence: Column, relevant_json: Column, reason: Column, domains: tuple[str, ...] = C.CONTENT_DOMAINS
) -> Column:
    """Whether a verdict passes; a MOVIE also needs the JSON literal true and a reason."""
    d = F.upper(F.trim(F.coalesce(domain, F.lit(""))))
    movie = (d != "MOVIE") | (F.coalesce(relevant_json == "true", F.lit(False)) & _said(reason))
    return d.isin(*domains) & _said(subject) & _said(evidence) & movie


def content_type(c: Column) -> Column:
    """A known content type, else EXPLAINER."""
    t = F.upper(F.trim(F.coalesce(c, F.lit("EXPLAINER"))))
    return F.when(t.isin(*C.CONTENT_TYPES), t).otherwise("EXPLAINER")


def terms_match(terms: Column, text: Column, least: int = 1) -> Column:
    """Enough of the terms occur in the text; never if either side has none."""
    target = T.topic_terms(text)
    return (F.size(terms) > 0) & (F.size(target) > 0) & (T.overlap(terms, target) >= F.least(F.lit(least), F.size(terms)))


def subject_match(source: Column, text: Column, anchors: Column) -> Column:
    """Two shared subject terms (or all, if fewer), or any anchor in the text."""
    a, b = T.subject_terms(source), T.subject_terms(text)
    enough = T.overlap(a, b) >= F.least(F.lit(2), F.size(a))
    return (F.size(a) > 0) & (F.size(b) > 0) & (enough | (T.overlap(anchors, b) > 0))


def domain_allowed(url: Column) -> Column:
    return U.domain_not_blocked(url)


def gate_batches(ranked: DataFrame, ok: Column, size: int = 20, most: int = 4, rank: str = "rank") -> DataFrame:
    """The best acceptable row of the first batch that has one: no row if none of the first batches does."""
    batch = F.ceil(F.col(rank) / size).cast("int")
    # Ordered and cut: no join back, one row travels.
    return ranked.withColumn("batch", batch).filter((F.col("batch") <= most) & ok).orderBy(rank).limit(1)


def join_verdict(cands: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates with their verdicts, verdicts whose id is unknown); a null id says "none of this batch"."""
    named = verdicts.filter("candidate_id is not null")
    met = cands.join(named, cands.video_id == named.candidate_id)
    unknown = named.join(cands, named.candidate_id == cands.video_id, "left_anti")
    return met, unknown


def first_of(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_row", F.row_number().over(w)).filter("_row = 1").drop("_row")
