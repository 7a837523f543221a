"""Main body of a page by composite text density, and the blocks of a version that hold none of it.

Every DOM node gets its characters per tag, adjusted by its link characters and link tags; a node's density sum is the sum of its children's
densities. On the path from the node of the largest density sum up to body the smallest density is the threshold; among the nodes that reach it the
one of the largest density sum is the main body. Link-dominated parts inside it (teasers with their heading) and small print are left out.

A block of a version is compared with the main body of its page: it is furniture when it shares hardly any three-word shingle with it. Titles,
bylines, tables and quotes are content. What blocks of versions with a page teach about wording (a block without digits, dates and names) also
decides the blocks of versions whose page was not kept. ``path`` tells which of these decided a block.

Each body is parsed once (bodies of one hash are one), whatever its depth; words that could not be decoded are left out of the comparison.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import mojibake, residue
from weftline.llm.sitelines import MONTHS, NAME, form
from weftline.session import cut
from weftline.sources.htmltree import INLINE, Element, parse
from weftline.sources.pages import declared_charsets, marked

#: share of a block's shingles that the main body must hold; words beside date and name that a byline has at most
SHARED, BYLINE = 0.34, 16
#: parts of a table; one without blocks in its cells, none of which holds most of its text, is a block of its own like a paragraph
_TABLE = frozenset("table thead tbody tfoot tr td th caption colgroup col".split())
_SILENT = frozenset("script style noscript template svg".split())
_LANG = re.compile(rb"<html[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2})", re.I)
_BY_LANGUAGE = {b"ja": ("euc_jp", "cp932"), b"ru": ("cp1251", "koi8-r"), b"pl": ("cp1250", "iso8859-2"), b"zh": ("gb18030", "big5"), b"ko": ("cp949",)}
_TOKEN = re.compile("[぀-ヿ㐀-鿿]+|[^\\W_぀-ヿ㐀-鿿]+")
_DENSE = re.compile("[぀-ヿ㐀-鿿]")
_BETWEEN = "\x1e"
_IDS: dict[str, int] = {}
#: words that stayed garbled
_LOST = re.compile(r"\S*(?:[\ufffd\x80-\x9f]|[À-ÖØ-öø-ÿ¡-¿]{3,}|[a-z][ÀÁ-ÖØ-Þ¡-¿])\S*")
_TARGET = re.compile(r"\]\([^)\s]*\)")
_DATE = re.compile(r"\d{4}-\d{2}-\d{2}|\d{1,2}\.? (?:de )?(?:" + "|".join(sorted(set(MONTHS.split()))) + r")\.?,? (?:de )?\d{4}|(?:" + "|".join(sorted(set(MONTHS.split()))) + r") \d{1,2}, \d{4}|\d{1,2}[./]\d{1,2}[./]\d{4}|\d{4}年\d{1,2}月", re.I)
_YEAR = re.compile(r"\d{4}")
_TRAIL = re.compile(r"[^.!?。\n]{1,60}(?:\s[»›>|·•/]\s[^.!?。\n]{1,80}){2,}")
#: one exclamation without numbers and links; where no part of the page holds it, it is a slogan, which is none of the kinds of furniture
_SLOGAN = re.compile(r"[^\d\n\[\]|.?!。]+[!！]")
_MARKER = re.compile(r"^[ \t]*(?:[-*+]|\d+[.)])[ \t]+(?:\[[ x]\] )?", re.M)
_LINKS = re.compile(r"(?:[-*+]|\d+\.)?\s*\[[^\]\n]*\]\([^)\n]*\)\s*")


def decoded(body: bytes, header: str | None) -> str:
    """A page's text: by its byte order mark; UTF-8 where well formed; else by the first of the sets that header and page name and those of the page's
    language that gives a text without garbled sequences, or failing that the first that can decode it."""
    if mark := marked(body):
        return body[mark[1] :].decode(mark[0], "replace")
    names = declared_charsets(body, header)
    if b"\x1b" in body:
        names.sort(key=lambda x: not x.lower().startswith("iso-2022"))
    try:
        if b"\x1b" not in body or not names or not names[0].lower().startswith("iso-2022"):
            return body.decode("utf-8")
    except UnicodeDecodeError:
        pass
    lang = _LANG.search(body[:4096])
    first = None
    # a page that says Latin-1 means its Windows superset
    said = ["cp1252" if x.lower() in ("iso-8859-1", "latin-1", "latin1", "ascii", "us-ascii") else x for x in names]
    for name in dict.fromkeys([*said, *(_BY_LANGUAGE.get(lang.group(1).lower(), ()) if lang else ()), "cp1252"]):
        try:
            text = body.decode(name)
        except (UnicodeDecodeError, LookupError):
            continue
        if not mojibake.suspicious(text):
            return text
        first = text if first is None else first
    return body.decode("cp1252", "replace") if first is None else first


class _Measure:
    __slots__ = ("children", "chars", "tags", "link_chars", "link_tags", "density", "total", "flat", "cell")


def _measure(root: Element) -> list[Element]:
    """The nodes from the root on; each has its measure. Scripts, styles and the like are no nodes."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        m = node.measure = _Measure()
        m.children = [c for c in node.children if not isinstance(c, str) and c.tag not in _SILENT]
        order.append(node)
        stack += m.children
    for node in reversed(order):
        m = node.measure
        chars = tags = link_chars = link_tags = cell = 0
        flat = node.tag in _TABLE or node.tag in INLINE
        for part in node.children:
            if isinstance(part, str):
                chars += len(part.strip())
        for part in m.children:
            c = part.measure
            chars, tags, link_chars, link_tags = chars + c.chars, tags + c.tags + 1, link_chars + c.link_chars, link_tags + c.link_tags + (part.tag == "a")
            flat = flat and c.flat
            cell = c.cell if c.cell > cell else cell
        m.chars, m.tags, m.link_chars, m.link_tags = chars, tags, chars if node.tag == "a" else link_chars, link_tags
        m.cell = chars if node.tag in ("td", "th") else cell
        m.flat = flat and (node.tag != "table" or 2 * cell <= chars)
        if node.tag == "table" and m.flat:
            m.children, m.tags = [], link_tags
    body = next((n for n in order if n.tag == "body"), root).measure
    ratio = body.link_chars / max(1, body.chars)
    for node in order:
        m = node.measure
        m.density = 0.0
        if m.chars:
            c, t, lc, lt = m.chars, max(1, m.tags), max(1, m.link_chars), max(1, m.link_tags)
            base = math.log(c / max(1, c - m.link_chars) * m.link_chars + ratio * c + math.e)
            m.density = c / t * math.log(max(1.0001, c / lc * t / lt)) / math.log(max(1.1, base + 1e-9) + 1)
    for node in order:
        node.measure.total = sum(c.measure.density for c in node.measure.children)
    return order


def main_node(root: Element) -> Element | None:
    """The subtree of the largest density sum among the nodes that reach the body path's threshold; null when the page has no text."""
    order = [n for n in _measure(root) if n.tag not in ("head", "title", "html", "#root") and not (n.measure.flat and n.tag in _TABLE and n.tag != "table")]
    texts = [n for n in order if n.measure.chars and n.measure.children]
    if not texts:
        texts = [n for n in order if n.measure.chars]
        return max(texts, key=lambda n: n.measure.chars) if texts else (root if root.measure.chars else None)
    best = max(texts, key=lambda n: n.measure.total)
    threshold, up = best.measure.density, best
    while up is not None and up.tag not in ("body", "html", "#root"):
        threshold, up = min(threshold, up.measure.density), up.parent
    return max((n for n in texts if n.measure.density >= threshold), key=lambda n: n.measure.total)


def main_texts(text: str) -> list[str]:
    """The block texts of a page's main body in order, link-dominated parts and small print left out."""
    main = main_node(parse(text))
    return [] if main is None else texts_of(main)


def texts_of(top: Element, outside: Element | None = None) -> list[str]:
    """Block texts below a node: without link-dominated parts and small print, or, with ``outside``, all but those of that node."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        joined = " ".join("".join(run).split())
        if joined:
            out.append(joined)
        run.clear()

    # each frame: what is left of a node's children, and what its end does
    stack: list[tuple[Iterator[Element | str], str]] = [(iter(top.children), "block")]
    while stack:
        rest, kind = stack[-1]
        for part in rest:
            if isinstance(part, str):
                run.append(part)
                continue
            if part.tag in _SILENT or part is outside:
                continue
            if part.tag == "br":
                run.append("\n")
                continue
            m = part.measure
            if part.tag in ("td", "th") and not any(c.tag not in INLINE for c in m.children):
                run.append(" ")
                stack.append((iter(part.children), "cell"))
                break
            if outside is None and (part.tag == "small" or (part.tag not in INLINE and m.chars and m.link_chars > 0.5 * m.chars)):
                continue
            if part.tag not in INLINE:
                flush()
            stack.append((iter(part.children), "inline" if part.tag in INLINE else "block"))
            break
        else:
            if kind == "cell":
                run.append(" ")
            elif kind == "block":
                flush()
            stack.pop()
    return out


def _words(text: str) -> list[str]:
    """Lower-case words; of scripts without spaces, each three characters are a word."""
    words = _TOKEN.findall(text.lower())
    if not text.isascii() and _DENSE.search(text):
        words = [x for w in words for x in ([w[i : i + 3] for i in range(max(1, len(w) - 2))] if _DENSE.match(w) else [w])]
    return words


def _shingles(lines: list[str]) -> np.ndarray:
    """Different three-word shingles of lines, in order; none goes over the end of a line, and the words of shorter lines stand alone."""
    parts = [_words(x) for x in lines]
    words = [w for x in parts for w in x]
    if not words:
        return np.zeros(0, np.uint32)
    if len(_IDS) > 500_000:
        _IDS.clear()
    for w in set(words).difference(_IDS):
        _IDS[w] = xxhash.xxh32_intdigest(w)
    ids = np.array([_IDS[w] for w in words], np.uint32)
    sizes = np.array([len(x) for x in parts])
    line = np.repeat(np.arange(len(parts)), sizes)
    with np.errstate(over="ignore"):
        three = (ids[:-2] * np.uint32(2654435761)) ^ (ids[1:-1] * np.uint32(2246822519) + np.uint32(374761393)) ^ (ids[2:] * np.uint32(3266489917) + np.uint32(668265263))
    return np.unique(np.concatenate([three[line[:-2] == line[2:]], ids[np.repeat(sizes < 3, sizes)]]))


def _pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for key, header, body in batch[["raw_hash", "content_type_header", "body"]].itertuples(index=False):
            tree = parse(decoded(bytes(body), header))
            main = main_node(tree)
            # a page may hold garbled text of its own; restored, it is what restored blocks are compared with
            inside, outside = ([], []) if main is None else (texts_of(main), texts_of(next((n for n in tree.walk() if n.tag == "body"), tree), main))
            restored = mojibake.repair("\n".join(inside) + _BETWEEN + "\n".join(outside))[0].split(_BETWEEN)
            out.append((key, *(_shingles(x.split("\n")).view(np.int32) for x in restored)))
        yield pd.DataFrame(out, columns=["raw_hash", "main", "outside"])


def _body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        batch["main_text"] = ["\n\n".join(main_texts(decoded(bytes(b), h))) for h, b in zip(batch["content_type_header"], batch["body"])]
        yield batch[["arrival", "raw_hash", "main_text"]]


def main_bodies(fetch_log: DataFrame) -> DataFrame:
    """(arrival, raw_hash, main_text) of every fetched page with a body; repeated rows count once, a body without text gives an empty text."""
    rows = fetch_log.where("body IS NOT NULL").select("arrival", "raw_hash", "content_type_header", "body").dropDuplicates(["arrival"])
    return rows.mapInPandas(_body, "arrival BIGINT, raw_hash STRING, main_text STRING")


def byline(text: str) -> bool:
    """Whether a text is a date with hardly any words besides it and names."""
    # no form of a date is longer than 30 characters before or after its year
    dated = any(_DATE.search(text, max(0, m.start() - 30), m.end() + 30) for m in _YEAR.finditer(text))
    return dated and len(_TOKEN.findall(NAME.sub(" ", _DATE.sub(" ", text)))) <= BYLINE


def kind(block: str, block_type: str | None, level: float | None) -> str | None:
    """``title`` and ``byline`` are content whatever the page says; null for all others."""
    if block_type == "heading" and level == 1 or re.match(r"#[ \t]", block):
        return "title"
    return "byline" if block_type not in ("table", "quote", "list") and byline(block) else None


def wording(block: str) -> int:
    """Hash of a block without digits, dates, names, case and punctuation; headings of different levels differ."""
    level = m.group() if (m := re.match(r"#{1,6} ", block)) else ""
    return xxhash.xxh3_64_intdigest(level + "\n".join(x for x in map(form, block.split("\n")) if x)) - 2**63


def shared(clean: str, garbled: bool, known: np.ndarray) -> float | None:
    """Share of a restored block's shingles that the main body has; null where more than half of them have words that could not be restored."""
    lines = _MARKER.sub("", _TARGET.sub("]", clean)).split("\n")
    mine = _shingles(lines)
    if garbled:
        left = _shingles([part for line in lines for part in _LOST.split(line) if part == line or len(_TOKEN.findall(part)) >= 3])
        if 2 * len(left) < len(mine):
            return None
        mine = left
    if not len(mine) or not len(known):
        return 0.0
    at = np.minimum(np.searchsorted(known, mine), len(known) - 1)  # both are sorted
    return float((known[at] == mine).mean())


def _judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of one version with their page's main shingles to (block_id, wording, furniture or null where no page is known, path)."""
    for batch in batches:
        out = []
        for doc, version, main, rest, blocks in batch[["doc_id", "version", "main", "outside", "blocks"]].itertuples(index=False):
            elsewhere = np.zeros(0, np.uint32) if rest is None else np.asarray(rest, np.int32).view(np.uint32)
            known = None if main is None or not len(main) else np.asarray(main, np.int32).view(np.uint32)
            mine_out, kept, gone = [], 0, 0
            texts = [(b["markdown"] or "").replace(_BETWEEN, " ") for b in blocks]
            # restored together: what one block leaves in doubt another settles
            restored, garbled, _, _ = mojibake.repair(_BETWEEN.join(texts)) if known is not None else ("", 0, 0, "")
            clean = restored.split(_BETWEEN) if known is not None else texts
            for b, text, fixed_text in zip(blocks, texts, clean):
                if b["block_type"] == "code" or not re.search(r"\w", text):
                    continue
                fixed = kind(text, b["block_type"], b["level"])
                verdict, path = None, None
                if fixed or b["block_type"] in ("table", "quote"):
                    verdict, path = False, fixed or b["block_type"]
                elif known is not None:
                    share = shared(fixed_text, bool(garbled), known)
                    verdict, path = (None, None) if share is None else (share < SHARED, "page")
                    if verdict and _SLOGAN.fullmatch(text) and shared(fixed_text, bool(garbled), elsewhere) < SHARED:
                        verdict, path = False, "slogan"
                elif "](" in text and all(_LINKS.fullmatch(x) for x in text.split("\n") if x.strip()):
                    verdict, path = True, "links"
                # a path of pages may have words of the main body, and is none of it
                if not verdict and path in ("page", None) and b["block_type"] in ("paragraph", "other") and _TRAIL.fullmatch(text):
                    verdict, path = True, "trail"
                kept, gone = kept + (verdict is False) * len(text), gone + (verdict is True) * len(text)
                mine_out.append((doc, version, b["block_id"], wording(text), verdict, path, bool(fixed)))
            # a main body that holds less than half of the text is not this version's page: wording decides
            lost_page = known is not None and gone > kept
            out += [(*x[:4], None, None) if lost_page and not x[6] else x[:6] for x in mine_out]
        yield pd.DataFrame(out, columns=["doc_id", "version", "block_id", "wording", "furniture", "path"]).astype({"furniture": object})


def judged(versions: DataFrame, fetch_log: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, version, block_id, furniture, path) of every block with a word, by its page or, without one, by what its wording is elsewhere.

    Null or unknown pages, null texts and repeated rows are allowed; wording never seen elsewhere is content.
    """
    keys = versions.select("doc_id", "version", "raw_hash").dropDuplicates(["doc_id", "version"])
    # one body for each hash that a version has, before anything is parsed
    asked = keys.where("raw_hash IS NOT NULL").select("raw_hash").distinct()
    pages = fetch_log.where("body IS NOT NULL AND raw_hash IS NOT NULL").select("arrival", "raw_hash", "content_type_header", "body").join(asked, "raw_hash", "left_semi")
    pages = pages.groupBy("raw_hash").agg(F.min_by(F.struct("content_type_header", "body"), "arrival").alias("p")).select("raw_hash", "p.*")
    pages = pages.mapInPandas(_pages, "raw_hash STRING, main ARRAY<INT>, outside ARRAY<INT>")
    main = keys.join(pages, "raw_hash").select("doc_id", "version", "main", "outside")
    own = blocks.groupBy("doc_id", "version").agg(F.collect_set(F.struct("block_id", "block_type", "level", "markdown")).alias("blocks"))
    schema = "doc_id STRING, version INT, block_id STRING, wording BIGINT, furniture BOOLEAN, path STRING"
    rows = cut(own.join(main, ["doc_id", "version"], "left").select("doc_id", "version", "main", "outside", "blocks").mapInPandas(_judged, schema))
    learnt = rows.where("furniture IS NOT NULL").groupBy("wording").agg(F.avg(F.col("furniture").cast("int")).alias("share"), F.count_distinct("doc_id").alias("documents"))
    learnt = learnt.where("share >= 0.8 AND documents >= 2").select("wording", F.lit(True).alias("taught"))
    missing = rows.where("furniture IS NULL").join(learnt, "wording", "left").withColumns({"furniture": F.coalesce("taught", F.lit(False)), "path": F.lit("wording")})
    columns = ["doc_id", "version", "block_id", "furniture", "path"]
    return rows.where("furniture IS NOT NULL").select(columns).unionByName(missing.select(columns))


def found(versions: DataFrame, fetch_log: DataFrame, blocks: DataFrame) -> DataFrame:
    """Furniture blocks of versions that are content."""
    rows = judged(versions, fetch_log, blocks).where("furniture").select("doc_id", "version", "block_id").distinct()
    return rows.join(residue.found(versions), ["doc_id", "version"], "left_anti")
