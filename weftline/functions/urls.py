"""URL columns: host, origin, normal form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def site_of(url: Column) -> Column:
    """Host of a URL without letter case, credentials, port, trailing dot and leading ``www.``; null when there is none."""
    authority = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)", 1)
    host = F.lower(F.regexp_replace(authority, r"^.*@|:\d*$|\.(?=:\d*$|$)", ""))
    host = F.regexp_replace(F.regexp_replace(host, r":\d*$", ""), r"^www\.", "")
    return F.when(host != "", host)


# Query parameters that only track, whatever their letter case.
TRACKING = r"(?i)^(?:utm_[a-z]+|fbclid|gclid|mc_cid|mc_eid|_hsenc|_hsmi|ref_src)$"
_PARTS = r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
# Extensions of files that are no pages.
ASSET = r"(?i)\.(?:png|jpe?g|gif|webp|svg|ico|bmp|tiff?|mp[34]|m4a|webm|ogg|wav|avi|mov|mkv|zip|gz|tgz|bz2|xz|7z|rar|tar|exe|dmg|msi|deb|rpm|apk|iso|woff2?|ttf|otf|eot|css|js|mjs|map|wasm)$"


def _rewritten(part: Column) -> Column:
    """A query part as form encoding writes it: ``key=value``, both decoded and encoded again; a part that cannot be decoded stays."""
    key, value = F.regexp_extract(part, "^([^=]*)", 1), F.regexp_extract(part, "^[^=]*=?(.*)$", 1)
    return F.coalesce(F.concat(F.url_encode(F.try_url_decode(key)), F.lit("="), F.url_encode(F.try_url_decode(value))), part)


def normalize_url(url: Column) -> Column:
    """A URL in its normal form: scheme and host in lower case, no default port or fragment, ``/`` for an empty path.

    A query with tracking parameters loses them, and what is left is written anew; any other query stays as it is, but for one that is empty.
    """
    scheme = F.lower(F.regexp_extract(url, _PARTS, 1))
    host = F.lower(F.regexp_extract(url, _PARTS, 2))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path, query = F.regexp_extract(url, _PARTS, 3), F.regexp_extract(url, _PARTS, 4)
    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    tracks = lambda p: F.coalesce(F.try_url_decode(F.regexp_extract(p, "^([^=]*)", 1)), p).rlike(TRACKING)
    kept = F.array_join(F.transform(F.filter(parts, lambda p: ~tracks(p)), _rewritten), "&")
    left = F.when(F.exists(parts, tracks), kept).otherwise(query)
    return F.when(scheme != "", F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(left != "", F.concat(F.lit("?"), left)).otherwise("")))


def origin_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^\s*([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 3)


def glob_to_regex(pattern: str) -> str:
    """A path pattern as an anchored regular expression: ``**`` any text, ``*`` within a segment, ``?`` one character of one.

    ``/body/flags`` is an unanchored regular expression where the flags are among i, m and s and the body has a character that only expressions have.
    """
    import re

    m = re.fullmatch(r"/(.+)/([ims]*)", pattern)
    if m and re.search(r"[\\^$()|+\[\]{}]|\.\*", m.group(1)):
        return (f"(?{m.group(2)})" if m.group(2) else "") + m.group(1)
    pieces = re.split(r"(\*\*|\*|\?)", pattern)
    kinds = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(kinds.get(p, re.escape(p)) for p in pieces) + "$"
