"""Cut items above a size limit at natural boundaries, with a given overlap.

A text is a tree: sections by heading level, blocks, list items with the lists nested in them, lines, sentences, words. Only a node above the limit is
descended into; its small children are merged with their siblings, bottom-up and under their own parent, while they fit. So a cut falls on the highest
boundary that is possible, and the parts of a large section are not mixed with its neighbours. A heading goes with the text after it. Words above the
limit are cut between characters, but not before a combining mark or around a joiner.

A piece is the last ``overlap`` characters of the piece before it followed by new text; joined without their overlaps the pieces are the text.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_LIMIT, BATCH_CHARS = 24_000, 4_000_000
_HEADING = re.compile(r"^(#{1,6})[ \t]", re.M)
_FENCE = re.compile(r"^(?:```|~~~)")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+|(?<=[。！？])")
_LINE = re.compile(r"\n")
_WORD = re.compile(r"\s+")
_JOINS = re.compile("[̀-ͯ‍︀-️\U0001f3fb-\U0001f3ff]")

Span = tuple[int, int]


def _blocks(text: str, a: int, b: int) -> list[Span]:
    """Blocks between blank lines; a code fence is one block. Each span runs up to the start of the next."""
    starts, fenced, blank, at = [a], False, False, a
    while at < b:
        end = text.find("\n", at, b)
        end = b if end < 0 else end + 1
        line = text[at:end]
        if _FENCE.match(line):
            if not fenced and blank and at != starts[-1]:
                starts.append(at)
            fenced = not fenced
            blank = False
        elif not fenced:
            if not line.strip():
                blank = True
            else:
                if blank and at != starts[-1]:
                    starts.append(at)
                blank = False
        at = end
    return list(zip(starts, [*starts[1:], b]))


_MARKER = re.compile(r"^([ \t]*)(?:[-*+]|\d+[.)])[ \t]", re.M)
ITEMS, LINES, SENTENCES, WORDS = 8, 9, 10, 11
#: lists nested deeper than this are cut between lines
NESTED = 40


def _spans(a: int, b: int, starts: list[int]) -> list[Span]:
    cuts = [a, *(x for x in starts if a < x < b)]
    return list(zip(cuts, [*cuts[1:], b]))


class _Tree:
    """Children of spans of one text; blocks and headings are found once."""

    def __init__(self, text: str):
        self.text = text
        self.blocks = [a for a, _ in _blocks(text, 0, len(text))]
        self.levels = [len(m.group(1)) if (m := _HEADING.match(text, a)) else 0 for a in self.blocks]

    def children(self, a: int, b: int, depth: int) -> list[Span]:
        """Children of a node at a depth: 1 to 6 headings, 7 blocks, 8 list items, 9 lines and rows, 10 sentences, 11 words."""
        text = self.text
        if depth < ITEMS:
            i, j = bisect_right(self.blocks, a), bisect_left(self.blocks, b)
            return _spans(a, b, [x for x, level in zip(self.blocks[i:j], self.levels[i:j]) if depth == 7 or level == depth])
        if depth == ITEMS:
            # items of the least indent below the node: its own list's, or those of the list inside an item
            below = [(m.start(), len(m.group(1).expandtabs(4))) for m in _MARKER.finditer(text, a, b) if m.start() > a]
            least = min((n for _, n in below), default=0)
            return _spans(a, b, [at for at, n in below if n == least])
        pattern = {LINES: _LINE, SENTENCES: _SENTENCE}.get(depth, _WORD)
        return _spans(a, b, [m.end() for m in pattern.finditer(text, a, b)])

    def heading_only(self, a: int, b: int) -> bool:
        """Whether a span of blocks holds headings alone."""
        i, j = bisect_left(self.blocks, a), bisect_left(self.blocks, b)
        return i < j and self.blocks[i] == a and all(self.levels[i:j])


def _cut_characters(text: str, a: int, b: int, size: int) -> int:
    """The furthest end within ``size`` characters that does not part a mark from its character, if there is one."""
    end = min(a + size, b)
    at = end
    while a < at < b and (_JOINS.match(text[at]) or text[at - 1] == "‍"):
        at -= 1
    return at if at > a else end


def boundaries(text: str, limit: int, overlap: int) -> list[Span]:
    """(start, end) of the new text of each piece. ``limit`` below 1 counts as 1, ``overlap`` is kept below the limit."""
    limit = max(1, limit)
    overlap = min(max(0, overlap), limit - 1)
    if len(text) <= limit:
        return [(0, len(text))]
    tree = _Tree(text)
    out: list[Span] = []

    def room(start: int) -> int:
        return limit - min(overlap, start)

    def pack(start: int, a: int, b: int, depth: int, nested: int = 0) -> None:
        """Pieces of the node from a to b, which is too large; what stands between start and a (a heading) goes with the first of them."""
        if depth > WORDS:
            while b - start > room(start):
                # what leads a word is no reason to cut off less than a character of it
                end = _cut_characters(text, start, b, room(start))
                out.append((start, end))
                start = end
            out.append((start, b))
            return
        kids = tree.children(a, b, depth)
        if len(kids) == 1:
            pack(start, a, b, depth + 1)
            return
        held = start  # siblings from here on are merged
        for x, y in kids:
            if y - held <= room(held):
                continue
            leads = held < x and depth <= 7 and tree.heading_only(held, x) and x - held < room(held) // 2
            if not leads:
                if held < x:
                    out.append((held, x))
                held = x
                if y - x <= room(x):
                    continue
            deeper = depth == ITEMS and nested < NESTED
            pack(held, x, y, depth if deeper else depth + 1, nested + deeper)
            held = y
        if held < b:
            out.append((held, b))

    pack(0, 0, len(text), 1)
    return out


def pieces_of(text: str | None, limit: int | None, overlap: int | None) -> Iterator[tuple[str, int, int | None]]:
    """(piece, start of its new text, offset of the next piece's new text or null), one at a time: overlaps near the limit make many times the text.

    Null text has no pieces, empty text one empty piece.
    """
    if text is None:
        return
    limit = max(1, DEFAULT_LIMIT if limit is None else limit)
    overlap = min(max(0, overlap or 0), limit - 1)
    spans = boundaries(text, limit, overlap)
    for i, (a, b) in enumerate(spans):
        yield text[a - min(overlap, a) : b], a, b if i + 1 < len(spans) else None


def _batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["request_id", "doc_id", "version", "piece_no", "text", "start_offset", "next_offset", "total_chars"]
    rows: list[tuple] = []
    size = 0
    frame = lambda: pd.DataFrame(rows, columns=columns).astype({"next_offset": "Int64"})
    for batch in batches:
        for r in batch.itertuples(index=False):
            limit, overlap = (None if pd.isna(x) else int(x) for x in (r.max_chars, r.overlap_chars))
            for i, (t, a, n) in enumerate(pieces_of(r.markdown, limit, overlap), 1):
                rows.append((r.request_id, r.doc_id, r.version, i, t, a, n, len(r.markdown)))
                size += len(t)
                if size > BATCH_CHARS:  # whatever a request's pieces come to, a batch stays small
                    yield frame()
                    rows, size = [], 0
    yield frame()


def requested(slices: DataFrame, versions: DataFrame) -> DataFrame:
    """The text of each request: of its version, or of the latest where it names none. Requests without a stored version have no row."""
    s = slices.select("request_id", F.col("doc_id").alias("s_doc"), F.col("version").alias("s_version"), "max_chars", "overlap_chars").dropDuplicates(["request_id"])
    keys = versions.select("doc_id", "version").join(s.select(F.col("s_doc").alias("doc_id")).distinct(), "doc_id", "left_semi")
    latest = keys.groupBy(F.col("doc_id").alias("l_doc")).agg(F.max("version").alias("latest"))
    s = s.join(latest, F.col("s_doc") == F.col("l_doc")).withColumn("s_version", F.coalesce("s_version", "latest")).drop("l_doc", "latest")
    # repeated versions are one record: one text for each key that is asked for
    wanted = s.select(F.col("s_doc").alias("doc_id"), F.col("s_version").alias("version")).distinct()
    texts = versions.select("doc_id", "version", "markdown").where("markdown IS NOT NULL").join(wanted, ["doc_id", "version"], "left_semi").groupBy("doc_id", "version").agg(F.max("markdown").alias("markdown"))
    return s.join(texts, (F.col("s_doc") == F.col("doc_id")) & (F.col("s_version") == F.col("version"))).select("request_id", "doc_id", "version", "markdown", "max_chars", "overlap_chars")


def pieces(slices: DataFrame, versions: DataFrame) -> DataFrame:
    """Every piece of every request. A text within its limit is one piece; repeated requests count once; null limits take the defaults."""
    schema = "request_id BIGINT, doc_id STRING, version INT, piece_no INT, text STRING, start_offset BIGINT, next_offset BIGINT, total_chars BIGINT"
    # requests of one document are spread over tasks
    return requested(slices, versions).repartition("request_id").mapInPandas(_batches, schema)


def found(slices: DataFrame, versions: DataFrame) -> DataFrame:
    """Requests whose first piece is not the last."""
    return pieces(slices, versions).where("piece_no = 1 AND next_offset IS NOT NULL").select("request_id")
