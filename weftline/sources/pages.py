"""Pages, texts and PDF line tables to typed blocks of Markdown.

Extraction is one Arrow pass from fetched bodies to nested rows; all that follows (numbering, offsets, hashes) is relational.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.sources.htmltree import INLINE, Element, parse

# Elements that never hold readable content, and those that the structural extraction leaves out.
_DROP = frozenset("script style noscript template iframe object embed canvas svg link meta dialog nav aside form button input select textarea head title".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog".split())
# Words in a class or id that mark page furniture.
_NOISE_WORDS = "nav navbar navigation menu sidebar side-bar breadcrumb breadcrumbs cookie consent gdpr advert advertisement ads sponsor social share sharing related newsletter subscribe popup modal skip skip-link footer masthead toolbar pagination comment comments toc table-of-contents"
_NOISE = re.compile(rf"(?:^|[\s_-])(?:{'|'.join(_NOISE_WORDS.split())})(?:$|[\s_-])", re.I)
# Styles that hide an element.
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
# Notices that scripts are needed, and the elements that applications are drawn into.
_SCRIPTS_NEEDED = re.compile(r"\b(?:enable|requires?|turn on|activate)\s+javascript|javascript\s+(?:is\s+)?(?:disabled|required|must be enabled)", re.I)
_APP_IDS = frozenset("root app __next __nuxt svelte".split())
_APP_ATTRIBUTES = ("data-reactroot", "ng-app", "ng-version")
# Texts of links that only point to the heading they stand in, and the classes of such links.
_PERMALINKS = frozenset(("", "¶", "#", "§", "🔗", "⚓", "link"))
_PERMALINK_CLASSES = frozenset("headerlink anchor hash-link anchorjs-link".split())
_LISTS, _PARAGRAPHS = frozenset(("ul", "ol", "dl", "menu")), frozenset(("p", "figure", "address"))
_LEAVES = _LISTS | _PARAGRAPHS | {"pre", "table", "blockquote", *(f"h{i}" for i in range(1, 7))}
_BOM = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?\s*([\w:.-]+)", re.I)
SCHEMA = (
    "arrival BIGINT, title STRING, lang STRING, site_name STRING, description STRING, published STRING, canonical STRING, strategy STRING, "
    "author STRING, elements INT, semantic BOOLEAN, links ARRAY<STRUCT<href: STRING, text: STRING>>, scripts INT, external_scripts INT, inline_script_chars INT, app_root_empty BOOLEAN, noscript_warning BOOLEAN, body_text_chars INT, "
    "outlinks ARRAY<STRING>, blocks ARRAY<STRUCT<type: STRING, level: INT, lang: STRING, text: STRING, markdown: STRING>>"
)


def marked(body: bytes) -> tuple[str, int] | None:
    """(charset, length) of a byte order mark."""
    return next(((name, len(mark)) for mark, name in _BOM if body.startswith(mark)), None)


def declared_charsets(body: bytes, header: str | None) -> list[str]:
    """The charset that the header names, then the one that the page names in its first 4096 bytes."""
    found = (_CHARSET.search((header or "").encode("ascii", "ignore")), _CHARSET.search(body[:4096]))
    return [m.group(1).decode("ascii", "ignore") for m in found if m]


def decode_body(body: bytes, header: str | None) -> str:
    """Byte order mark, then the header's charset, then the page's in its first 4096 bytes, then UTF-8; unknown labels are UTF-8."""
    if mark := marked(body):
        return body[mark[1] :].decode(mark[0], "replace")
    try:
        return body.decode(next(iter(declared_charsets(body, header)), "utf-8"), "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def space(text: str) -> str:
    return re.sub(r"[\s  -   　﻿]+", " ", text).strip()


def _wrapped(c: Element, inner: str, base: str) -> str:
    """Markdown of an inline element from that of its content."""
    words = inner.strip()
    lead, tail = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :]
    if c.tag == "br":
        return "\n"
    if c.tag == "img":
        src = c.attributes.get("src") or c.attributes.get("data-src", "")
        return f"![{c.attributes.get('alt', '')}]({urljoin(base, src)})" if src and not src.startswith("data:") else c.attributes.get("alt", "")
    if c.tag in ("script", "style"):
        return ""
    if not words:
        return inner
    if c.tag in ("em", "i"):
        return f"{lead}_{words}_{tail}"
    if c.tag in ("strong", "b"):
        return f"{lead}**{words}**{tail}"
    if c.tag in ("del", "s", "strike"):
        return f"{lead}~~{words}~~{tail}"
    if c.tag == "code":
        return f"{lead}`{words}`{tail}"
    if c.tag == "a" and c.attributes.get("href") and not re.match(r"(?i)\s*(javascript|data|vbscript):", c.attributes["href"]):
        return f"{lead}[{words}]({urljoin(base, c.attributes['href'])}){tail}"
    return inner


def inline(node: Element, base: str) -> str:
    """Markdown of the inline content of an element, however deep."""
    stack: list[tuple[Element, Iterator[Element | str], list[str]]] = [(node, iter(node.children), [])]
    while True:
        element, rest, out = stack[-1]
        for c in rest:
            if isinstance(c, str):
                # signs that Markdown would read as markup are escaped, but not in code
                plain = re.sub(r"\s+", " ", c)
                out.append(plain if element.tag in ("code", "kbd", "samp", "tt") else re.sub(r"([\\`*_\[\]])", r"\\\1", plain))
            else:
                stack.append((c, iter(c.children), []))
                break
        else:
            text = re.sub(r" *\n *", "\n", re.sub(r" {2,}", " ", "".join(out)))
            stack.pop()
            if not stack:
                return text
            stack[-1][2].append(_wrapped(element, text, base))


def list_lines(node: Element, base: str) -> list[str]:
    """Lines of a list, nested lists indented under their items."""
    lines: list[str] = []

    def frame(node: Element, indent: str) -> list:
        start = node.attributes.get("start") or "1"
        return [node.tag == "ol", int(start) if start.isdigit() else 1, indent, [(None, c) for c in node.children if isinstance(c, Element) and c.tag == "li"]]

    stack = [frame(node, "")]
    while stack:
        ordered, number, indent, rest = stack[-1]
        if not rest:
            stack.pop()
            continue
        inner, item = rest.pop(0)
        if inner is not None:
            stack.append(frame(item, inner))
            continue
        mark = f"{number}. " if ordered else "- "
        stack[-1][1] += 1
        flat = Element("li", {}, None)
        flat.children = [c for c in item.children if isinstance(c, str) or c.tag not in ("ul", "ol")]
        box = next((c for c in flat.walk() if c.tag == "input" and c.attributes.get("type") == "checkbox"), None)
        tick = "" if box is None else "[x] " if "checked" in box.attributes else "[ ] "
        lines.append(f"{indent}{mark}{tick}{space(inline(flat, base))}")
        rest[:0] = [(indent + " " * len(mark), c) for c in item.children if isinstance(c, Element) and c.tag in ("ul", "ol")]
    return lines


def table_rows(node: Element) -> list[Element]:
    """Rows of a table but for those of tables inside it."""
    out, stack = [], [node]
    while stack:
        n = stack.pop()
        if n.tag == "tr":
            out.append(n)
        stack += [c for c in reversed(n.children) if isinstance(c, Element) and c.tag != "table" and n.tag != "tr"]
    return out


def table_markdown(node: Element, base: str) -> str:
    """A pipe table with its caption before it; cells that span columns are followed by empty ones."""
    rows = []
    for tr in table_rows(node):
        cells = []
        for cell in (c for c in tr.children if isinstance(c, Element) and c.tag in ("td", "th")):
            cells.append(re.sub(r"\n+", " <br> ", inline(cell, base).strip()).replace("|", "\\|"))
            span = cell.attributes.get("colspan", "1")
            cells += [""] * (min(50, int(span)) - 1 if span.isdigit() else 0)
        if cells:
            rows.append(cells)
    caption = next((space(n.text()) for n in node.walk() if n.tag == "caption"), "")
    width = max(map(len, rows), default=0)
    if not width:
        return caption
    rows = [r + [""] * (width - len(r)) for r in rows]
    lines = ["| " + " | ".join(rows[0]) + " |", "| " + " | ".join(["---"] * width) + " |", *("| " + " | ".join(r) + " |" for r in rows[1:])]
    return (f"{caption}\n\n" if caption else "") + "\n".join(lines)


def definition_lines(node: Element, base: str) -> list[str]:
    """Lines of a definition list: terms, and their definitions below them."""
    return [("" if n.tag == "dt" else ":   ") + space(inline(n, base)) for n in node.walk() if n.tag in ("dt", "dd")]


def code_language(*nodes: Element | None) -> str | None:
    for node in nodes:
        if node is None:
            continue
        classes = node.attributes.get("class", "")
        m = re.search(r"(?:^|\s)(?:language|lang|highlight-source|highlight)-([\w+#-]+)|brush:\s*([\w+#-]+)", classes)
        found = (m.group(1) or m.group(2)) if m else node.attributes.get("data-lang") or node.attributes.get("data-language")
        if found and found.lower() not in ("plaintext", "text", "none", "plain", "txt"):
            return found.lower()
    return None


def blocks_of(root: Element, base: str) -> list[dict]:
    """Typed blocks in reading order; runs of inline content between blocks are paragraphs."""
    out: list[dict] = []
    run: list[Element | str] = []

    def emit(kind: str, text: str, markdown: str, level: int | None = None, lang: str | None = None) -> None:
        if markdown.strip():
            out.append({"type": kind, "level": level, "lang": lang, "text": text, "markdown": markdown})

    def flush() -> None:
        if run:
            box = Element("p", {}, None)
            box.children = list(run)
            run.clear()
            emit("paragraph", space(box.text()), inline(box, base).strip())

    stack = [iter(root.children)]
    while stack:
        for c in stack[-1]:
            if isinstance(c, str) or (c.tag in INLINE and not any(n.tag in _LEAVES for n in c.walk())):
                run.append(c)
                continue
            flush()
            if c.tag in _DROP or c.tag == "hr":
                continue
            if re.fullmatch(r"h[1-6]", c.tag):
                level = int(c.tag[1])
                emit("heading", space(c.text()), "#" * level + " " + space(inline(c, base)), level)
            elif c.tag in _PARAGRAPHS:
                emit("paragraph", space(c.text()), inline(c, base).strip())
            elif c.tag == "dl":
                lines = definition_lines(c, base)
                emit("list", "\n".join(re.sub("^:   ", "", x) for x in lines), "\n".join(lines))
            elif c.tag in _LISTS:
                lines = list_lines(c, base)
                emit("list", "\n".join(space(re.sub(r"^\s*(?:-|\d+\.) ", "", x)) for x in lines), "\n".join(lines))
            elif c.tag == "pre":
                code = c.first("code")
                text = re.sub(r"^\n+|\s+$", "", "".join(x for n in c.walk() for x in n.children if isinstance(x, str)).replace("\r\n", "\n"))
                fence = "`" * max(3, max((len(x) for x in re.findall(r"`+", text)), default=0) + 1)
                lang = code_language(c, code, c.parent)
                emit("code", text, f"{fence}{lang or ''}\n{text}\n{fence}", None, lang)
            elif c.tag == "table" and len([1 for n in c.walk() if n.tag == "table"]) == 1 and not any(n.tag in ("h1", "h2", "h3", "p", "ul", "pre") for n in c.walk()):
                md = table_markdown(c, base)
                emit("table", "\n".join("\t".join(space(x.text()) for x in tr.children if isinstance(x, Element)) for tr in table_rows(c)), md)
            elif c.tag == "blockquote":
                emit("quote", space(c.text()), "\n".join("> " + x for x in inline(c, base).strip().split("\n")))
            else:
                stack.append(iter(c.children))
                break
        else:
            flush()
            stack.pop()
    return out


def without_permalinks(links: list[Element]) -> None:
    """Takes out links in headings, and of the classes for it, that only point into the page."""
    for a in links:
        if "#" not in a.attributes.get("href", "") or space(a.text()).lower() not in _PERMALINKS or any(n.tag == "img" and n.attributes.get("alt") for n in a.walk()):
            continue
        up = a.parent
        while up is not None and not re.fullmatch("h[1-6]", up.tag):
            up = up.parent
        if up is not None or _PERMALINK_CLASSES & set(a.attributes.get("class", "").split()):
            a.parent.children = [c for c in a.parent.children if c is not a]


def density_root(body: Element) -> Element | None:
    """The container of the densest text: each paragraph of 25 characters or more gives its characters, less those of links, to its parent and half of
    them to the parent above. Null where no paragraph has 140 characters."""
    scores: dict[int, list] = {}
    readable = False
    for p in body.walk():
        if p.tag not in ("p", "pre", "td", "blockquote"):
            continue
        text = space(p.text())
        if len(text) < 25:
            continue
        readable = readable or len(text) >= 140
        own = len(text) - sum(len(space(a.text())) for a in p.walk() if a.tag == "a")
        up, part = p.parent, 1.0
        while up is not None and part >= 0.5:
            scores.setdefault(id(up), [0.0, up])[0] += own * part
            up, part = up.parent, part / 2
    return max(scores.values(), key=lambda x: x[0])[1] if readable and scores else None


def content_root(root: Element) -> tuple[Element, bool]:
    """(first main, else the only article, else body; whether it is one of the first two); furniture elements inside are dropped."""
    body = root.first("body") or root
    main = next((n for n in body.walk() if n.tag == "main" or n.attributes.get("role") == "main"), None)
    articles = [n for n in body.walk() if n.tag == "article"]
    picked = main or (articles[0] if len(articles) == 1 else None)
    top = picked or body
    whole = max(1, len(space(top.text())))
    kept = frozenset("main article body html pre code table h1 h2 h3 h4 h5 h6".split())

    def noisy(node: Element) -> bool:
        if node.bare and node.tag not in _DROP and node.tag not in ("footer", "header"):
            return False
        a = node.attributes
        checkbox = node.tag == "input" and a.get("type") == "checkbox"
        if (node.tag in _DROP and not checkbox) or node.tag == "footer" or _HIDDEN.search(a.get("style", "")) or "hidden" in a or a.get("aria-hidden") == "true" or a.get("role") in _ROLES:
            return True
        if node.tag == "header":
            return node.first("h1", "h2") is None
        return node.tag not in kept and bool(_NOISE.search(f"{a.get('class', '')} {a.get('id', '')}")) and node.first("main", "article", "h1") is None and len(space(node.text())) <= 0.4 * whole

    for node in list(top.walk()):
        node.children = [c for c in node.children if isinstance(c, str) or not noisy(c)]
    return top, picked is not None


def extract(source: str, url: str) -> dict:
    """Metadata, signals, links and blocks of one page; of the structural and the density candidate the one that loses less."""
    root = parse(source)
    every = list(root.walk())
    tags: dict[str, list[Element]] = {}
    for n in every:
        tags.setdefault(n.tag, []).append(n)
    first_of = lambda tag: next(iter(tags.get(tag, [])), None)
    metas: dict[str, str] = {}
    for n in tags.get("meta", []):
        metas.setdefault((n.attributes.get("property") or n.attributes.get("name") or "").lower(), n.attributes.get("content", "").strip())
    title, h1, page, base_tag = (first_of(t) for t in ("title", "h1", "html", "base"))
    base = urljoin(url, base_tag.attributes.get("href", "")) if base_tag else url
    scripts, anchors = tags.get("script", []), [n for n in tags.get("a", []) if n.attributes.get("href")]
    active = [n for n in scripts if not n.attributes.get("type") or re.search("javascript|module|json", n.attributes["type"].lower())]
    links = [urljoin(base, n.attributes["href"]).split("#")[0] for n in anchors]
    roots = [n for n in every if n.tag == "app-root" or (not n.bare and (n.attributes.get("id") in _APP_IDS or any(x in n.attributes for x in _APP_ATTRIBUTES)))]
    body = first_of("body") or root
    silent = Element("div", {}, None)
    silent.children = [c for c in body.children if isinstance(c, str) or c.tag not in ("noscript", "template")]
    body_text = space(silent.text())
    needed = any(_SCRIPTS_NEEDED.search(n.text()) for n in tags.get("noscript", [])) or (len(body_text) < 400 and bool(_SCRIPTS_NEEDED.search(body_text)))
    canonical = next((n.attributes.get("href") for n in tags.get("link", []) if n.attributes.get("rel") == "canonical"), None)
    empty_root = any(len(space(n.text())) < 200 for n in roots)
    heading = space(h1.text()) if h1 else ""
    name = metas.get("og:title") or (space(title.text()) if title else "") or heading
    without_permalinks(anchors)
    elements = len(every)
    top, semantic = content_root(root)
    chosen, strategy = top, "structural"
    dense = density_root(top) if elements <= (5_000 if semantic else 10_000) else None
    if dense is not None and dense is not top:
        size = lambda n: (len(space(n.text())), sum(x.tag == "table" for x in n.walk()), sum(x.tag == "pre" for x in n.walk()))
        a, b = size(dense), size(top)
        if a[0] >= 200 and a[0] >= (0.7 if semantic else 0.3) * b[0] and a[1:] >= b[1:] and a[2] >= b[2]:
            chosen, strategy = dense, "density"
    blocks = blocks_of(chosen, base)
    first = (heading if strategy == "density" else "") or name
    if first and not any(b["type"] == "heading" and b["level"] == 1 for b in blocks):
        blocks.insert(0, {"type": "heading", "level": 1, "lang": None, "text": first, "markdown": f"# {first}"})
    inner = {}
    for n in chosen.walk():
        if n.tag == "a" and n.attributes.get("href") and re.match("(?i)https?:", href := urljoin(base, n.attributes["href"])):
            inner.setdefault(href, space(n.text()))
    return {
        "title": name or None,
        "lang": (page.attributes.get("lang") if page else None) or None,
        "site_name": metas.get("og:site_name") or None,
        "author": metas.get("author") or None,
        "description": metas.get("description") or metas.get("og:description") or None,
        "published": metas.get("article:published_time") or metas.get("date") or None,
        "canonical": urljoin(url, canonical) if canonical else None,
        "strategy": strategy,
        "elements": elements,
        "semantic": semantic,
        "links": [{"href": h, "text": t} for h, t in inner.items()],
        "scripts": len(scripts),
        "external_scripts": sum("src" in n.attributes for n in active),
        "inline_script_chars": sum(len("".join(c for c in n.children if isinstance(c, str))) for n in active if "src" not in n.attributes),
        "app_root_empty": empty_root,
        "noscript_warning": needed,
        "body_text_chars": len(body_text),
        "outlinks": list(dict.fromkeys(x for x in links if re.match(r"https?://", x))),
        "blocks": blocks,
    }


def _pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [{"arrival": a, **extract(decode_body(bytes(b), h), u or "")} for a, u, h, b in batch[["arrival", "final_url", "content_type_header", "body"]].itertuples(index=False)]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in re.sub(r"<.*?>+", "", SCHEMA).split(", ")])


def extracted(fetch_log: DataFrame) -> DataFrame:
    """One row for each fetched HTML page with a body; repeated rows count once."""
    rows = fetch_log.where("body IS NOT NULL AND content_type ILIKE '%html%'").select("arrival", "final_url", "content_type_header", "body").dropDuplicates(["arrival"])
    return rows.mapInPandas(_pages, SCHEMA)


def text_blocks(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Blocks of plain or Markdown texts: split at blank lines outside code fences."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, t in zip(batch[key], batch[text]):
                kept, fenced, block = [], False, []
                for line in (t or "").split("\n"):
                    if re.match(r"\s*(```|~~~)", line):
                        fenced = not fenced
                    if not line.strip() and not fenced:
                        kept, block = kept + ["\n".join(block)] * bool(block), []
                    else:
                        block.append(line)
                kept += ["\n".join(block)] * bool(block)
                out += [(k, i, b) for i, b in enumerate(kept)]
            yield pd.DataFrame(out, columns=["key", "idx", "markdown"])

    kind = dict(texts.dtypes)[key]
    return texts.select(key, text).mapInPandas(run, f"key {kind}, idx INT, markdown STRING")


def pdf_paragraphs(lines: DataFrame) -> DataFrame:
    """Paragraphs of PDF line tables (doc, page, seq, y, size, text): a new one at another page, a size change above 15 % or a wide gap.

    A paragraph of 1.2 times the median size and under 200 characters is a heading, of level 1 from 1.6 times on.
    """
    by = Window.partitionBy("doc").orderBy("page", "seq")
    median = lines.groupBy("doc").agg(F.sort_array(F.collect_list("size")).alias("sizes")).select("doc", F.expr("sizes[cast(size(sizes) DIV 2 AS int)]").alias("median"))
    last = {c: F.lag(c).over(by) for c in ("page", "size", "y")}
    cut = last["page"].isNull() | (last["page"] != F.col("page")) | (F.abs(F.col("size") - last["size"]) > 0.15 * last["size"]) | (F.abs(last["y"] - F.col("y")) > 1.6 * F.col("size"))
    numbered = lines.withColumn("cut", cut.cast("int")).withColumn("paragraph", F.sum("cut").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    joined = numbered.groupBy("doc", "paragraph").agg(F.min("page").alias("page"), F.max("size").alias("size"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "seq", "text"))), lambda x: x["text"]), "\n").alias("text"))
    joined = joined.withColumn("text", F.regexp_replace(F.regexp_replace("text", r"(?<=\p{L})-\n(?=\p{Ll})", ""), "\n", " ")).join(median, "doc")
    level = F.when((F.col("size") >= 1.2 * F.col("median")) & (F.length("text") < 200), F.when(F.col("size") >= 1.6 * F.col("median"), 1).otherwise(2))
    return joined.select("doc", "paragraph", "page", level.alias("level"), "text")
