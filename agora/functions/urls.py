"""Permalink and id expressions (X1-X4, F16, F17), all JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from agora import schemas

ID_SEGMENT_CHARS = schemas.ID_SEGMENT_CHARS
# Python's \w is Unicode-aware: (?U) gives Java's regex the same meaning; (?i) = IGNORECASE
GROUP_URL_PATTERN = "(?iU)" + schemas.GROUP_URL_PATTERN


def _part(url: Column, which: str) -> Column:
    return F.try_parse_url(url, F.lit(which))


def canonical_url(url: Column) -> Column:
    """Scheme + '://' + authority + path; query and fragment dropped.

    NULL for text that is not an absolute url.
    """
    scheme, auth = _part(url, "PROTOCOL"), _part(url, "AUTHORITY")
    return F.when(scheme.isNotNull() & auth.isNotNull(),
                  F.concat(scheme, F.lit("://"), auth, F.coalesce(_part(url, "PATH"), F.lit(""))))


def host_matches(url: Column, host_substring: str) -> Column:
    """F16 (link half): the url's authority contains the expected host."""
    return F.coalesce(F.instr(F.lower(_part(url, "AUTHORITY")), host_substring.lower()) > 0,
                      F.lit(False))


def _segment_after(path: Column, name: str) -> Column:
    # the element right after the FIRST path element equal to ``name``
    seg = F.regexp_extract(path, r"^(?:[^/]*/)*?" + name + r"/([^/]*)", 1)
    return F.when(seg.rlike(ID_SEGMENT_CHARS), seg)


def _query_value(url: Column, key: str) -> Column:
    raw = F.try_parse_url(url, F.lit("QUERY"), F.lit(key))
    dec = F.try_url_decode(raw)
    return F.when(F.trim(dec) != "", dec)


def record_id(url: Column) -> Column:
    """Id cascade of a permalink, in priority order:

    1. the path element after posts / videos / photos / watch / story;
    2. query value of story_fbid, fbid, v, photo_id, id (decoded, non-blank);
    3. the first run of 10+ digits after a '/' in the path.
    """
    path = _part(url, "PATH")
    cands = [_segment_after(path, n) for n in schemas.ID_PATH_SEGMENTS]
    cands += [_query_value(url, k) for k in schemas.ID_QUERY_KEYS]
    cands.append(F.nullif(F.regexp_extract(path, r"/(\d{10,})", 1), F.lit("")))
    return F.coalesce(*cands)


def fallback_id(prefix: str, *parts: Column) -> Column:
    """Deterministic id for a record without one (stable across re-scrapes)."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12))


def post_identity(url: Column, host_substring: str, has_time_marker: Column | None = None,
                  page_key: Column | None = None) -> dict[str, Column]:
    """(post_url, post_id, is_candidate) of a record.

    With a link on the expected host: canonical url and the X2 id. Otherwise
    the record is a candidate only with a time marker. A candidate without an
    id gets the X3 fallback id: of its url or else of ``page_key``, which must be made of
    what a re-scrape sees again (author, text, time), never of where it was found.
    """
    on_host = host_matches(url, host_substring)
    post_url = F.when(on_host, canonical_url(url))
    rid = F.when(on_host, record_id(url))
    marker = has_time_marker if has_time_marker is not None else F.lit(False)
    is_candidate = (on_host & post_url.isNotNull()) | marker
    key = page_key if page_key is not None else F.lit("")
    pid = F.when(is_candidate, F.coalesce(
        rid, fallback_id("generated_", F.coalesce(post_url, key.cast("string")))))
    return {"post_url": post_url, "post_id": pid, "is_candidate": is_candidate}


def comment_id_from(href: Column, data_comment_id: Column | None = None,
                    *fallback_parts: Column) -> Column:
    """``comment_id`` query value -> ``data-commentid`` attribute -> fallback."""
    q = F.try_url_decode(F.regexp_extract(href, r"[?&]comment_id=([^&#]*)", 1))
    cands = [F.when(F.trim(q) != "", q)]
    if data_comment_id is not None:
        cands.append(F.when(F.trim(data_comment_id) != "", data_comment_id))
    cands.append(fallback_id("bs_fallback_", *fallback_parts))
    return F.coalesce(*cands)


def valid_group_url(url: Column) -> Column:
    """well-formed group url (Unicode word characters in the group name)."""
    return F.coalesce(url.rlike(GROUP_URL_PATTERN), F.lit(False)) & (url != "")
