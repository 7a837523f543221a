"""Outcomes of fetches: error codes, policies, envelopes, timings and the choice between candidates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# System and transport codes by the error code that users see.
ERRORS = {
    "dns_failure": "ENOTFOUND EAI_AGAIN ENODATA",
    "timeout": "UND_ERR_HEADERS_TIMEOUT UND_ERR_BODY_TIMEOUT UND_ERR_CONNECT_TIMEOUT ETIMEDOUT TimeoutError",
    "cancelled": "AbortError",
    "connect_failed": "ECONNREFUSED ECONNRESET EHOSTUNREACH ENETUNREACH UND_ERR_SOCKET EPIPE CERT_HAS_EXPIRED ERR_TLS_CERT_ALTNAME_INVALID UNABLE_TO_VERIFY_LEAF_SIGNATURE DEPTH_ZERO_SELF_SIGNED_CERT SELF_SIGNED_CERT_IN_CHAIN",
}
# Error codes by the kind that comparisons between engines use.
KINDS = {
    "timeout": "timeout",
    "blocked": "blocked_by_policy robots_disallowed blocked challenge",
    "http_error": "http_error",
    "unsupported": "unsupported_content_type unsupported_encoding",
    "network": "dns_failure connect_failed tls_failure",
}


def _coded(code: Column, table: dict[str, str], otherwise: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, codes in table.items():
        out = out.when(code.isin(*codes.split()), name)
    return out.otherwise(otherwise)


def error_code(code: Column, aborted: Column | None = None, deadline: Column | None = None) -> Column:
    """The error code of a system code or error name; an aborted request is a timeout where its deadline had passed, else cancelled. Null for null."""
    known = _coded(code, ERRORS, F.lit("internal"))
    if aborted is not None:
        late = F.coalesce(deadline, F.lit(False)) if deadline is not None else F.lit(False)
        known = F.when(F.coalesce(aborted, F.lit(False)), F.when(late, "timeout").otherwise("cancelled")).otherwise(known)
    return F.when(code.isNotNull(), known)


def error_kind(code: Column) -> Column:
    """The kind of an error code; codes of no kind are the engine's own."""
    return F.when(code.isNotNull(), _coded(code, KINDS, F.lit("engine_error")))


def retryable(code: Column, status: Column) -> Column:
    """Whether another try may help: transport failures, 429 and server errors."""
    return code.isin("timeout", "dns_failure", "connect_failed") | ((code == "http_error") & ((status == 429) | (status >= 500)))


def not_run_reason(available: Column, reachable: Column, crawls: Column) -> Column:
    """Why a task does not run, in order: no engine, no fixture, no crawling; null when it runs."""
    return F.when(~available, "engine unavailable").when(~reachable, "fixture unreachable").when(~crawls, "crawl unsupported")


def url_violation(url: Column) -> Column:
    """Why a URL may not be fetched: ``invalid``, ``scheme``, ``credentials`` or ``address`` (a literal address that is not a public one); null for none.

    IPv4 literals are compared as integers with the reserved ranges, so nothing leaves the JVM; bracketed IPv6 literals are refused unless global.
    """
    scheme = F.lower(F.regexp_extract(url, r"^\s*([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), r":\d*$", ""))
    reason = F.when(scheme == "", "invalid").when(~scheme.isin("http", "https"), "scheme").when(authority.contains("@"), "credentials").when(host == "", "invalid")
    v6 = host.startswith("[") & ~(host.rlike(r"^\[[23][0-9a-f]{3}:") & ~host.rlike(r"^\[2001:(?:0?db8|0{1,4}):|^\[2002:"))
    return reason.when(F.coalesce(~ipv4_public(host), F.lit(False)) | v6 | host.rlike(r"(?:^|\.)localhost$"), "address")


# IPv4 networks that are not globally routable unicast.
RESERVED = "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.88.99.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/3"


def ipv4_public(address: Column) -> Column:
    """Whether a dotted IPv4 address is a public one, as a range test on its number; null when it is no such address."""
    ok = address.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$")
    parts = F.transform(F.split(address, r"\."), lambda x: x.cast("bigint"))
    number = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, x: a * 256 + x)
    inside = F.lit(False)
    for network in RESERVED.split():
        base, bits = network.split("/")
        low = sum(int(x) << (24 - 8 * i) for i, x in enumerate(base.split(".")))
        inside = inside | number.between(low, low + (1 << (32 - int(bits))) - 1)
    return F.when(ok, ~inside)


def resolved_allowed(resolutions: DataFrame, host: str, allowed: str) -> DataFrame:
    """(host, allowed): a host is refused when any of its addresses is; a host without an address is refused."""
    return resolutions.groupBy(host).agg(F.coalesce(F.bool_and(F.col(allowed)), F.lit(False)).alias("allowed"))


def rounded_timings(timings: Column) -> Column:
    """Each timing to a tenth; unknown, negative and infinite ones are left out."""
    sane = F.map_filter(timings, lambda k, v: v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < float("inf")))
    return F.transform_values(sane, lambda k, v: F.round(v, 1))


def summed_timings(attempts: DataFrame, key: str, timings: str) -> DataFrame:
    """(key, name, total) over all attempts of a key."""
    each = attempts.select(key, F.explode(timings).alias("name", "value"))
    return each.groupBy(key, "name").agg(F.sum("value").alias("total"))


def envelope_status(truncated: Column, warnings: Column, slice_truncated: Column | None = None) -> tuple[Column, Column]:
    """(status, reasons): ``partial`` when the input was cut or a warning says so, else ``ok``; reasons for the cut in order, without nulls."""
    says = F.coalesce(F.exists(warnings, lambda w: w.startswith("partial:")), F.lit(False))
    status = F.when(truncated.isNotNull() | says, "partial").otherwise("ok")
    cut = F.when(slice_truncated, F.lit("output_budget")) if slice_truncated is not None else F.lit(None).cast("string")
    return status, F.array_compact(F.array(truncated, cut))


def chosen(pages: DataFrame, key: str) -> DataFrame:
    """One candidate of each key: the rendered page where there is no plain one or where it has as many characters or more, else the plain one.

    ``pages`` has key, rendered (boolean), ok (boolean) and chars. ``choice`` is ``rendered``, ``http``, ``partial`` (rendering failed) or ``none``.
    """
    best = lambda cond: F.max(F.when(cond & F.col("ok"), F.col("chars")))
    g = pages.groupBy(key).agg(best(~F.col("rendered")).alias("http_chars"), best(F.col("rendered")).alias("rendered_chars"), F.bool_or(F.col("rendered") & ~F.col("ok")).alias("failed"))
    wins = F.col("rendered_chars").isNotNull() & (F.col("http_chars").isNull() | (F.col("rendered_chars") >= F.col("http_chars")))
    choice = F.when(wins, "rendered").when(F.col("http_chars").isNull(), "none").when(F.col("failed") & F.col("rendered_chars").isNull(), "partial").otherwise("http")
    return g.select(key, "http_chars", "rendered_chars", choice.alias("choice"))


def readable_enough(chars: Column, structural_chars: Column, semantic: Column, tables: Column, structural_tables: Column, codes: Column, structural_codes: Column) -> Column:
    """Whether the density candidate replaces the structural one: 200 characters or more, enough of the other's text, and no table or code lost."""
    share = F.when(semantic, 0.7).otherwise(0.3)
    return (chars >= 200) & (chars >= share * structural_chars) & (tables >= structural_tables) & (codes >= structural_codes)


def density_allowed(elements: Column, semantic: Column) -> Column:
    """Whether a page is small enough for the density candidate."""
    return elements <= F.when(semantic, 5_000).otherwise(10_000)


def usable_value(outcome: Column, expected_error: Column, score: Column) -> Column:
    """A score as comparisons use it: null where nothing was tried or an error was expected, 0 for an error, null for no finite score."""
    tried = outcome.isin("ok", "error") & ~F.coalesce(expected_error, F.lit(False))
    return F.when(tried & (outcome == "error"), 0.0).when(tried & score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf")), score)
