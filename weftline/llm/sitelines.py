"""Lines repeated across one site's documents.

A line's form is the line without letter case, markup, punctuation, digits, dates and names of persons. Forms are the nodes of a graph per site,
weighted by the documents they stand in; forms of lines that follow each other in a document, with only blank lines between, are its edges, weighted
alike. Nodes and edges of high support are kept, the connected components are the site's boilerplate blocks, and every occurrence of a component's
lines is deleted, together with the blank lines inside a run of one block. Which lines are found follows from their own support, as the problem
defines it; components name the blocks and decide what goes with them.

A kept form stands in at least a quarter of its site's documents, so a site keeps at most four times as many forms as its average document has
lines, however many documents it has: components are found per site in that bounded space. Before that, lines are reduced to hashes and counted
with partial aggregation on (site, form, document), and joined to the kept forms in ``SALTS`` parts, so a site with a third of all rows is spread
over all tasks.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.urls import site_of
from weftline.session import cut

LEAST_DOCUMENTS, LEAST_SHARE, SALTS = 5, 0.25, 16
# Month names in the languages of the corpus.
MONTHS = (
    "january february march april may june july august september october november december "
    "januar februar märz mai juni juli oktober dezember janvier février mars avril juin juillet août septembre octobre novembre décembre "
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre "
    "janeiro fevereiro março maio junho julho setembro outubro novembro dezembro "
    "stycznia lutego marca kwietnia maja czerwca lipca sierpnia września października listopada grudnia "
    "января февраля марта апреля мая июня июля августа сентября октября ноября декабря"
)
_MONTH_SET = frozenset(MONTHS.split())
_UPPER = "".join(map(chr, (c for c in range(65, 0x530) if unicodedata.category(chr(c)) == "Lu")))
_LOWER = "".join(map(chr, (c for c in range(97, 0x530) if unicodedata.category(chr(c)) == "Ll")))
_PLACE = "(?:Bay|Port|Lake|Mount|River|Island|City|Street)"
#: exactly two capitalised words in a row
NAME = re.compile(rf"(?<![{_UPPER}{_LOWER}])(?!{_PLACE}\b)[{_UPPER}][{_LOWER}]+\s+(?!{_PLACE}\b)[{_UPPER}][{_LOWER}]+(?![{_UPPER}{_LOWER}])(?!\s+[{_UPPER}][{_LOWER}])")
_CAPITAL, _SMALL = re.compile(f"[{_UPPER}]"), re.compile(f"[{_LOWER}]")
_WORD = re.compile(r"[^\W\d_]+")
_TARGET = re.compile(r"\]\([^)\s]*\)")
_FENCE = re.compile(r"\s*(?:```|~~~)")
_BASE, _MASK = 0x9E3779B97F4A7C15, 2**64 - 1
_WORDS: dict[str, int] = {}


def _words(text: str) -> list[str]:
    return [w for w in _WORD.findall(text.lower()) if w not in _MONTH_SET]


def _reduced(line: str) -> tuple[list[str], bool]:
    """(words of a line's form, whether the line is in capitals, in which names cannot be seen)."""
    if _FENCE.match(line) or not _WORD.search(line):
        return [], False
    line = _TARGET.sub("]", line) if "](" in line else line
    if len(_CAPITAL.findall(line)) > 1 and not _SMALL.search(line):
        return _words(line), True
    return _words(NAME.sub(" ", line)) or _words(line), False


def form(line: str) -> str:
    """The first form of a line; empty for a line without a letter and a code fence."""
    return " ".join(_reduced(line)[0])


def forms(line: str) -> list[str]:
    """The forms of a line: one, or for a line in capitals one for each pair of words left out as well.

    A line without a letter and a code fence have none.
    """
    words, capitals = _reduced(line)
    less = [" ".join(words[:i] + words[i + 2 :]) for i in range(len(words) - 1)] if capitals and len(words) > 2 else []
    return [x for x in dict.fromkeys([" ".join(words), *less]) if x]


def _hashed(words: list[str]) -> list[int]:
    try:
        return [_WORDS[w] for w in words]
    except KeyError:
        if len(_WORDS) > 500_000:
            _WORDS.clear()
        _WORDS.update((w, xxhash.xxh3_64_intdigest(w)) for w in set(words).difference(_WORDS))
        return [_WORDS[w] for w in words]


def form_hashes(line: str) -> tuple[int, ...]:
    """Signed hashes of the forms of a line, in time and space linear in its length: a polynomial of the words' hashes, so that the form without a
    pair is made of the polynomials before and after the pair."""
    words, capitals = _reduced(line)
    if not words:
        return ()
    before, value = [0], 0
    hashes = _hashed(words)
    for h in hashes:
        value = (value * _BASE + h) & _MASK
        if capitals:
            before.append(value)
    out = [value]
    if capitals and len(words) > 2:
        after, power = 0, 1
        less = []
        for i in range(len(words) - 2, -1, -1):  # without words i and i + 1
            less.append((before[i] * power + after) & _MASK)
            after = (hashes[i + 1] * power + after) & _MASK
            power = (power * _BASE) & _MASK
        out += less[::-1]
    return tuple(x - 2**63 for x in dict.fromkeys(out)) if len(out) > 1 else (value - 2**63,)


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[str, tuple[int, ...]] = {}
    for batch in batches:
        row: list[int] = []
        number: list[int] = []
        rank: list[int] = []
        hashes: list[int] = []
        for i, text in enumerate(batch["markdown"]):
            at = 0
            for n, line in enumerate(text.split("\n"), 1):
                at += bool(line.strip())
                got = known.get(line)
                if got is None:
                    if len(known) > 100_000:
                        known.clear()
                    got = known[line] = form_hashes(line)
                for h in got:
                    row.append(i)
                    number.append(n)
                    rank.append(at)
                    hashes.append(h)
        at_row = np.array(row, np.int64)
        keys = {c: batch[c].to_numpy()[at_row] for c in ("site", "doc_id", "version")}
        yield pd.DataFrame({**keys, "line_no": np.array(number, np.int32), "rank": np.array(rank, np.int32), "form": np.array(hashes, np.int64)})


def site_lines(versions: DataFrame) -> DataFrame:
    """(site, doc_id, version, line_no, rank, form): hashed forms of every line and its place among the non-blank lines. Null texts and sites have none."""
    v = versions.select("doc_id", "version", _site(), "markdown").where("site IS NOT NULL AND markdown IS NOT NULL")
    return v.mapInPandas(_lines, "site STRING, doc_id STRING, version INT, line_no INT, rank INT, form BIGINT")


def _components(group: pd.DataFrame) -> pd.DataFrame:
    """Connected components of one site's kept forms; an edge's ends are ``form`` and ``other``, which are the same for the form itself."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in group[["form", "other"]].itertuples(index=False):
        ra, rb = root(parent.setdefault(int(a), int(a))), root(parent.setdefault(int(b), int(b)))
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    nodes = list(parent)
    return pd.DataFrame({"site": group["site"].iloc[0], "form": nodes, "block": [root(x) for x in nodes]})


def _site() -> Column:
    return site_of(F.col("final_url")).alias("site")


def boilerplate(lines: DataFrame, versions: DataFrame, least: int = LEAST_DOCUMENTS, share: float = LEAST_SHARE) -> DataFrame:
    """(site, form, documents, site_documents) of each form that stands in enough of its site's documents."""
    total = versions.select("doc_id", _site()).where("site IS NOT NULL").distinct().groupBy("site").agg(F.count("*").alias("site_documents"))
    one = lines.select("site", "doc_id", "form").distinct()
    support = one.groupBy("site", "form").agg(F.count("*").alias("documents")).where(F.col("documents") >= least)
    return support.join(total, "site").where(F.col("documents") >= F.col("site_documents") * share)


def occurrences(versions: DataFrame, least: int = LEAST_DOCUMENTS, share: float = LEAST_SHARE) -> DataFrame:
    """(site, doc_id, version, line_no, form, documents, site_documents, block): every line of a boilerplate block; repeated rows count once."""
    lines = cut(site_lines(versions))
    nodes = cut(boilerplate(lines, versions, least, share))
    salt = F.pmod(F.xxhash64("doc_id", "line_no"), F.lit(SALTS)).cast("int").alias("salt")
    salted = nodes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    held = lines.select("*", salt).join(salted, ["site", "form", "salt"])
    held = cut(held.groupBy("site", "doc_id", "version", "line_no").agg(F.max_by("form", F.struct("documents", "form")).alias("form"), F.max("documents").alias("documents"), F.first("site_documents").alias("site_documents"), F.first("rank").alias("rank")))
    # an edge joins kept lines with only blank lines between
    ahead = held.select("site", "doc_id", "version", (F.col("rank") - 1).alias("rank"), F.col("form").alias("other"))
    edges = held.join(ahead, ["site", "doc_id", "version", "rank"]).where("form <> other")
    edges = edges.select("site", "form", "other", "doc_id", "site_documents").distinct().groupBy("site", "form", "other").agg(F.count("*").alias("weight"), F.first("site_documents").alias("site_documents"))
    edges = edges.where((F.col("weight") >= least) & (F.col("weight") >= F.col("site_documents") * share)).select("site", "form", "other")
    graph = edges.unionByName(nodes.select("site", "form", F.col("form").alias("other")))
    blocks = graph.groupBy("site").applyInPandas(_components, "site STRING, form BIGINT, block BIGINT")
    return held.drop("rank").join(blocks, ["site", "form"])


def found(versions: DataFrame) -> DataFrame:
    return occurrences(versions).select("doc_id", "version", "line_no").distinct()


def cleaned(versions: DataFrame) -> DataFrame:
    """(doc_id, version, removed, markdown): each version's text without the lines of its site's boilerplate blocks and the blank lines inside a run of
    one block; ``removed`` counts the lines of blocks, null texts stay null."""
    gone = occurrences(versions).groupBy("doc_id", "version").agg(F.sort_array(F.collect_set(F.struct("line_no", "block"))).alias("gone"))
    v = versions.select("doc_id", "version", "markdown").dropDuplicates(["doc_id", "version"]).join(gone, ["doc_id", "version"], "left")
    # spans of lines that go: each line alone, and from one to the next of the same block where all between are blank
    lines = F.split("markdown", "\n")
    inner = F.flatten(F.zip_with(F.slice("gone", 1, F.size("gone") - 1), F.slice("gone", 2, F.size("gone")), lambda a, b: F.when((a["block"] == b["block"]) & (b["line_no"] > a["line_no"] + 1) & ~F.exists(F.slice(F.col("lines"), a["line_no"] + 1, b["line_no"] - a["line_no"] - 1), lambda x: F.trim(x) != ""), F.sequence(a["line_no"] + 1, b["line_no"] - 1)).otherwise(F.array().cast("array<int>"))))
    v = v.withColumn("lines", lines).withColumn("out", F.when(F.col("gone").isNotNull(), F.array_union(F.transform("gone", lambda g: g["line_no"]), inner)))
    keep = F.filter(F.transform("lines", lambda x, i: F.struct((i + 1).alias("n"), x.alias("line"))), lambda s: ~F.array_contains("out", s["n"]))
    text = F.when(F.col("gone").isNull(), F.col("markdown")).otherwise(F.array_join(F.transform(keep, lambda s: s["line"]), "\n"))
    return v.select("doc_id", "version", F.coalesce(F.size("gone"), F.lit(0)).alias("removed"), text.alias("markdown"))
