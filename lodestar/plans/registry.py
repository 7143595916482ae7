"""Registration of queries, and pieces of SQL that several of them use."""

from __future__ import annotations

from collections.abc import Callable

from ..functions import constants as C

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) as a query under its name, with its SQL if there is any."""

    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def listed(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def normal(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'))"


def terms(x: str, stop: tuple[str, ...] = C.GENERIC_WORDS, least: int = 3) -> str:
    """Sorted distinct terms."""
    return f"list_sort(list_filter(list_distinct(string_split({normal(x)}, ' ')), lambda t: length(t) >= {least} AND NOT list_contains({listed(stop)}, t)))"


def overlap(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


def anchors(x: str) -> str:
    """Sorted anchors of a subject; letters beyond ASCII count as parts of words."""
    x = f"coalesce({x}, '')"
    names = rf"regexp_extract_all(regexp_replace({x}, '[^\x00-\x7F]', '_', 'g'), '(\b[A-Z][A-Za-z0-9-]{{2,}}\b|\b[A-Z]{{2,}}\b)')"
    tags = f"regexp_extract_all({x}, '#([A-Za-z0-9_]+)', 1)"
    clean = f"list_filter(list_transform(list_concat({tags}, {names}), lambda t: regexp_replace(lower(t), '[^a-z0-9]', '', 'g')), lambda t: length(t) >= 3)"
    words = f"list_filter(regexp_extract_all(lower({x}), '[A-Za-z0-9]+'), lambda t: length(t) >= 6)"
    return f"list_sort(list_filter(list_distinct(list_concat({clean}, {words})), lambda t: NOT list_contains({listed(C.ANCHOR_STOP)}, t)))"


def match(source: str, text: str, anchors_: str) -> str:
    a, b = terms(source, C.SUBJECT_STOP), terms(text, C.SUBJECT_STOP)
    return f"(len({a}) > 0 AND len({b}) > 0 AND ({overlap(a, b)} >= least(2, len({a})) OR {overlap(anchors_, b)} > 0))"


def words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(coalesce({x}, ''), '\s+'), lambda w: w <> '')"


def sentences(x: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace(coalesce({x}, ''), '([.!?…])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(regexp_replace(s, '^\s+|\s+$', '', 'g'))), lambda s: s <> '')"


def srt(ms: str) -> str:
    ms = f"CAST(floor({ms}) AS BIGINT)"
    return f"printf('%02d:%02d:%02d,%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


def chapter(s: str) -> str:
    return f"CASE WHEN {s} >= 3600 THEN printf('%d:%02d:%02d', {s} // 3600, {s} // 60 % 60, {s} % 60) ELSE printf('%d:%02d', {s} // 60, {s} % 60) END"


def blank(x: str) -> str:
    return f"(trim(coalesce({x}, '')) = '')"
