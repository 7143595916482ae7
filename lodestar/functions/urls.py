"""URL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C

_VIDEO_HOSTS = ("youtube.com", "www.youtube.com", "m.youtube.com")


def _part(url: Column, pattern: str) -> Column:
    return F.regexp_extract(url, pattern, 1)


def _authority(url: Column) -> Column:
    return F.lower(_part(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"))


def _query_value(url: Column) -> Column:
    return _part(url, r"^[^?#]*\?(?:[^#]*&)?v=([^&#]+)")


def source_host(url: Column) -> Column:
    """Lower-cased host without its port; '' where there is none."""
    return F.split(_authority(F.coalesce(url, F.lit(""))), ":")[0]


def canonical_url(url: Column) -> Column:
    """One form for all addresses of an item: an id as it is, a video's id, or scheme, host and path."""
    u = F.trim(F.coalesce(url, F.lit("")))
    host = _authority(u)
    path = _part(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)")
    scheme = F.lower(_part(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://"))
    short = F.regexp_replace(path, "^/+|/+$", "")
    return (
        F.when(u.startswith("pexels:"), u)
        .when(host.isin(*_VIDEO_HOSTS) & (_query_value(u) != ""), F.concat(F.lit("youtube:"), _query_value(u)))
        .when((host == "youtu.be") & (short != ""), F.concat(F.lit("youtube:"), short))
        .when((scheme == "") | (host == ""), u)
        .otherwise(F.concat(scheme, F.lit("://"), host, path))
    )


def preview_url(url: Column, *given: Column) -> Column:
    """The first non-blank of the given addresses, else a video's thumbnail, else ''."""
    named = F.coalesce(*(F.nullif(F.trim(g), F.lit("")) for g in given)) if given else F.lit(None).cast("string")
    u = F.coalesce(url, F.lit(""))
    host = _authority(u)
    first = F.split(F.regexp_replace(_part(u, r"^[a-z]+://[^/?#]*([^?#]*)"), "^/+|/+$", ""), "/")[0]
    video = F.when(host.isin(*_VIDEO_HOSTS), _query_value(u)).when(host == "youtu.be", first).otherwise("")
    thumb = F.when(video != "", F.concat(F.lit("https://i.ytimg.com/vi/"), video, F.lit("/hqdefault.jpg"))).otherwise("")
    return F.coalesce(named, thumb)


def domain_not_blocked(url: Column, domains: tuple[str, ...] = C.BLOCKED_DOMAINS) -> Column:
    """False where the host is a listed domain or lies under one that does not begin with www."""
    host = source_host(url)
    under = [host.endswith(f".{d}") for d in domains if not d.startswith("www.")]
    hit = host.isin(*domains)
    for u in under:
        hit = hit | u
    return ~hit | (host == "")


def media_kind(path: Column) -> Column:
    """image or video by the file's ending, else null."""
    p = F.lower(path)
    ends = lambda endings: p.rlike("(" + "|".join(e.replace(".", r"\.") for e in endings) + ")$")
    return F.when(ends(C.IMAGE_ENDINGS), "image").when(ends(C.CLIP_ENDINGS), "video")


def source_tier(path: Column) -> Column:
    """web where the file's name shows that it came from a web search, else stock."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return F.when(name.rlike("googlevideo|googleimage|_google_|-google-"), "web").otherwise("stock")
