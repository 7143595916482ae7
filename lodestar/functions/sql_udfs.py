"""The scalar functions for SQL users, as SQL functions that Catalyst inlines, and a plug point for models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from . import constants as C
from .urls import _VIDEO_HOSTS

_NORMAL = "trim(regexp_replace(lower(coalesce(s, '')), '[^a-z0-9]+', ' '))"


def _terms(stop: tuple[str, ...], least: int) -> str:
    listed = ", ".join(f"'{w}'" for w in stop)
    return f"filter(array_except(array_distinct(split({_NORMAL}, ' ')), array({listed})), t -> length(t) >= {least})"


_SCHEME, _HOST = r"lower(regexp_extract(trim(u), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))", r"lower(regexp_extract(trim(u), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
_PATH = r"regexp_extract(trim(u), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_VALUE = r"regexp_extract(trim(u), '^[^?#]*[?](?:[^#]*&)?v=([^&#]+)', 1)"
_CANONICAL = (
    f"CASE WHEN u IS NULL THEN '' WHEN startswith(trim(u), 'pexels:') THEN trim(u) "
    f"WHEN {_HOST} IN ({', '.join(repr(h) for h in _VIDEO_HOSTS)}) AND {_VALUE} <> '' THEN concat('youtube:', {_VALUE}) "
    f"WHEN {_HOST} = 'youtu.be' AND trim(BOTH '/' FROM {_PATH}) <> '' THEN concat('youtube:', trim(BOTH '/' FROM {_PATH})) "
    f"WHEN {_SCHEME} = '' OR {_HOST} = '' THEN trim(u) ELSE concat({_SCHEME}, '://', {_HOST}, {_PATH}) END"
)

FUNCTIONS = {
    "normalize_text(s STRING) RETURNS STRING": _NORMAL,
    "topic_tokens(s STRING) RETURNS ARRAY<STRING>": _terms(C.TOPIC_STOP, 1),
    "topic_terms(s STRING) RETURNS ARRAY<STRING>": _terms(C.GENERIC_WORDS, 3),
    "query_terms(s STRING) RETURNS ARRAY<STRING>": _terms(C.QUERY_STOP, 3),
    "subject_terms(s STRING) RETURNS ARRAY<STRING>": _terms(C.SUBJECT_STOP, 3),
    "trend_score(views BIGINT, likes BIGINT, comments BIGINT, age DOUBLE) RETURNS DOUBLE": (
        "floor(least(100D, least(45D, greatest(0D, 10D * log10(greatest(greatest(coalesce(views, 0), 1) / greatest(age, 0.5D), 1D)))) "
        "+ least(20D, (coalesce(likes, 0) + coalesce(comments, 0)) / greatest(coalesce(views, 0), 1) * 1000D) "
        f"+ greatest(0D, 20D - greatest(age, 0.5D) / {C.WINDOW_HOURS}D * 20D)) * 100 + 0.5D) / 100D"
    ),
    "canonical_url(u STRING) RETURNS STRING": _CANONICAL,
    "hamming_bits(a BIGINT, b BIGINT) RETURNS INT": "coalesce(bit_count(a ^ b), 9999)",
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; returns their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in FUNCTIONS]


VERDICT = (
    "candidate_id string, content_type string, content_domain string, niche_subject string, niche_evidence string, "
    "us_movie_relevant string, us_relevance_reason string, content_angle string, why_it_fits string, confidence double"
)


def score_batches(candidates: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Verdicts of a caller's model over batches of candidates; a batch that the model fails on gives none."""
    names = [f.split()[0] for f in VERDICT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                found = model(batch)
            except Exception:  # the gate fails closed: without a verdict no candidate passes
                continue
            found = found.reindex(columns=names)
            texts = [n for n in names if n != "confidence"]
            yield found.astype({n: object for n in texts}).where(found.notna(), None)

    return candidates.mapInPandas(run, VERDICT)
