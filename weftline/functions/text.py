"""Text columns: lengths, tokens, hashes, references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space of the reference's text rules, ASCII and Unicode.
SPACE = r"[\s   -     　﻿]+"


def normalize_text(text: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def ascii_tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def short_hash(text: Column) -> Column:
    """First sixteen hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def doc_id_for(normalized_url: Column) -> Column:
    return F.concat(F.lit("d_"), short_hash(normalized_url))


def version_ref(doc_id: Column, version: Column, block_id: Column | None = None) -> Column:
    """A citable reference of a version or block."""
    ref = F.concat(F.lit("fk:"), doc_id, F.lit("@"), version.cast("string"))
    return ref if block_id is None else F.concat(ref, F.lit("#"), block_id)


def parse_ref(ref: Column) -> Column:
    """Struct (doc_id, version, block_id) of a reference; the prefix is optional, null when it is none."""
    pattern = r"^(?:fk:)?(d_[0-9a-f]{16})(?:@(\d+))?(?:#(b\d+))?$"

    def part(i: int) -> Column:
        got = F.regexp_extract(ref, pattern, i)
        return F.when(got != "", got)

    return F.when(ref.rlike(pattern), F.struct(part(1).alias("doc_id"), part(2).cast("int").alias("version"), part(3).alias("block_id")))


# Entities and what they stand for.
_ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "#39": "'", "nbsp": " "}


def plain(markdown: Column) -> Column:
    """Markdown as comparable lower-case text: links and images by their words, escapes and markup gone, curly quotes straight."""
    out = markdown
    for _ in range(2):  # an image may stand inside a link
        out = F.regexp_replace(out, r"!?\[([^\[\]]*)\]\([^)]*\)", "$1")
    # an entity makes no new one, so the ampersand comes last
    for name, char in reversed(_ENTITIES.items()):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    # an escaped mark is still a mark, other escaped signs stay without their backslash
    out = F.regexp_replace(out, r"\\?[*_`#>|~]", " ")
    out = F.regexp_replace(out, r"\\([\\{}\[\]()+\-.!])", "$1")
    return F.lower(F.trim(F.regexp_replace(F.translate(out, "‘’“”", "''\"\""), r"\s+", " ")))
