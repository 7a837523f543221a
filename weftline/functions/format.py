"""Small string functions of reports, ages and page keys, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def csv_cell(value: Column) -> Column:
    """A cell of a CSV file: quoted where it holds a comma, quote or line break, and made inert where a spreadsheet would read a formula."""
    safe = F.when(value.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)
    return F.when(value.isNull(), "").when(safe.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)


def escape_html(value: Column) -> Column:
    out = value
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def markdown_cell(value: Column) -> Column:
    """A cell of a Markdown table: pipes escaped, on one line."""
    return F.regexp_replace(F.replace(value, F.lit("|"), F.lit("\\|")), r"\s*\n\s*", " ")


def fence(text: Column, label: str = "") -> Column:
    """A text in a code fence that is longer than any run of backticks in it."""
    longest = F.array_max(F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), lambda x: F.length(x)))
    mark = F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(longest, F.lit(0)) + 1))
    return F.concat(mark, F.lit(f"{label}\n"), text, F.lit("\n"), mark)


def terminal_text(text: Column) -> Column:
    """A text without escape sequences, control characters and marks that turn the writing direction."""
    return F.regexp_replace(text, r"\x1b\][^\x07\x1b]*(?:\x07|\x1b\\)?|\x1b\[[0-?]*[ -/]*[@-~]|\x1b.?|[\x00-\x08\x0b-\x1f\x7f-\x9f‎‏‪-‮⁦-⁩]", "")


def byte_size(n: Column) -> Column:
    """Bytes in words: B, KiB, MiB or GiB with one digit after the point."""
    def unit(power: int, name: str) -> Column:
        return F.concat(F.format_string("%.1f", n / F.lit(float(1024**power))), F.lit(f" {name}"))

    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, unit(1, "KiB")).when(n < 1024**3, unit(2, "MiB")).otherwise(unit(3, "GiB"))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def page_key(url: Column) -> Column:
    """A URL as crawls are compared by: without fragment, ``utm_*`` parameters and a trailing ``index.html``."""
    bare = F.regexp_replace(url, "#.*$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^utm_")), "&")
    path = F.regexp_replace(F.regexp_replace(bare, r"\?.*$", ""), r"/index\.html$", "/")
    return F.concat(path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a hash of the characters of a text, as a number."""
    return F.aggregate(F.split(text, ""), F.lit(2166136261).cast("bigint"), lambda h, c: F.when(c == "", h).otherwise((h.bitwiseXOR(F.ascii(c).cast("bigint")) * 16777619).bitwiseAND(F.lit(4294967295))))


def age_start(age: Column, now: Column) -> Column:
    """The instant that an age such as ``30d``, ``12h`` or ``45m`` before ``now`` names, or that an ISO date or time does; null when it is neither."""
    n = F.regexp_extract(age, r"^(\d+)[dhm]$", 1).try_cast("bigint")
    seconds = n * F.when(age.endswith("d"), 86400).when(age.endswith("h"), 3600).otherwise(60)
    return F.coalesce(F.timestamp_seconds(F.unix_timestamp(now) - seconds), F.when(age.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(age)))


def gold_text(page: Column) -> Column:
    """The text of a page as gold text is made: without scripts and styles, tags as spaces, five entities, white space collapsed."""
    out = F.regexp_replace(page, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    out = F.regexp_replace(out, "<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))
