"""Evaluation items inside training documents.

The items are an inverted index of BM25 weights: postings by term, and for each term the highest weight in every block of ``BLOCK`` items. Every
document and every passage of it is a query, answered by block-max WAND: with the terms in the order of their highest weights, no item that lacks
all terms from the pivot on can reach the lowest threshold, so only blocks of those terms are looked at; a block is evaluated only when its highest
weights together reach the lowest threshold in it; and of its items those whose score reaches their own threshold are retrieved. An item's threshold
is the lowest score that a stretch of half its words or more can have after one word in eight was changed, so retrieval loses nothing. A retrieved
pair is verified in the passage, whose size is bounded: by the edit distance of every stretch of half the item's words or more; a local alignment,
whose score bounds that of all stretches, spares most pairs this.

Letter case, markup, link targets, punctuation, spacing and invisible characters do not count. The items are a stated query set: their index is
built once by the driver and broadcast once, after their total size was checked against ``CHARS`` (about 300,000 items); of larger sets each part of
that size passes over all documents, with the same result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHARS, BLOCK = 100_000_000, 64
K1, B = 1.2, 0.75
PASSAGE = 192
SHARE, ERRORS, PENALTY = 0.5, 1 / 8, 2
_HIDDEN = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")
_TARGET = re.compile(r"\]\((?:[^()\s]|\([^()\s]*\))*(?:\s+\"[^\"\n]*\")?\)")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>|&(?:[a-z]{2,8}|#\d{1,6});")
_WORD = re.compile("[぀-ヿ㐀-鿿가-힯]|[^\\W_぀-ヿ㐀-鿿가-힯]+")


def words(text: str) -> list[str]:
    """Lower-case words without markup; Chinese, Japanese and Korean characters are words of their own."""
    if not text.isascii():
        text = _HIDDEN.sub("", text)
    if "](" in text:
        text = _TARGET.sub("]", text)
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", text)
    return _WORD.findall(text.lower())


def allowed(length: int) -> int:
    """Errors that a stretch of so many words of an item may have."""
    return math.ceil(length * ERRORS)


def _ranges(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The numbers of all ranges in a row."""
    sizes = stops - starts
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class Index:
    """Postings of BM25 weights with block maxima, and a threshold for each item."""

    def __init__(self, items: list[tuple[int, str]]):
        rows = sorted({(int(i), t) for i, t in items if t is not None})
        held = [(i, w) for i, t in rows if (w := words(t))]
        self.ids = [i for i, _ in held]
        self.vocabulary: dict[str, int] = {}
        number = self.vocabulary.setdefault
        self.sequence = [np.array([number(x, len(self.vocabulary)) for x in w], np.int32) for _, w in held]
        n, v = len(held), len(self.vocabulary)
        counts = [np.unique(x, return_counts=True) for x in self.sequence]
        term = np.concatenate([np.zeros(0, np.int32), *[t for t, _ in counts]])
        item = np.repeat(np.arange(n, dtype=np.int32), [len(t) for t, _ in counts])
        tf = np.concatenate([np.zeros(0, np.int64), *[c for _, c in counts]])
        size = np.array([len(x) for x in self.sequence], np.float64)
        df = np.bincount(term, minlength=v)
        norm = K1 * (1 - B + B * size / max(1.0, size.mean() if n else 1.0))
        weight = (np.log(1 + (n - df[term] + 0.5) / (df[term] + 0.5)) * tf * (K1 + 1) / (tf + norm[item])).astype(np.float32)
        first = np.concatenate([[0], np.cumsum([len(t) for t, _ in counts])]).astype(np.int64)
        self.threshold = np.array([_lowest(x, dict(zip(term[first[i] : first[i + 1]].tolist(), weight[first[i] : first[i + 1]].tolist()))) for i, x in enumerate(self.sequence)], np.float32)
        order = np.lexsort((item, term))
        self.items, self.weights = item[order], weight[order]
        self.start = np.concatenate([[0], np.cumsum(df)]).astype(np.int64)
        # block maxima: of each run of one term and block the highest weight
        key = term[order].astype(np.int64) * (n // BLOCK + 1) + self.items // BLOCK
        runs = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.block_of = (self.items[runs] // BLOCK).astype(np.int32)
        self.block_top = np.maximum.reduceat(self.weights, runs) if len(runs) else np.zeros(0, np.float32)
        self.block_start = np.searchsorted(runs, self.start).astype(np.int64)
        self.top = np.maximum.reduceat(self.weights, self.start[:-1]) if v else np.zeros(0, np.float32)
        self.blocks = -(-n // BLOCK)
        self.least = np.minimum.reduceat(self.threshold, np.arange(0, n, BLOCK)) if n else np.zeros(0, np.float32)
        self.lowest = float(self.threshold.min()) if n else 0.0

    def terms_of(self, text_words: list[str]) -> np.ndarray:
        """Numbers of the words; words of no item share the number after the last."""
        get, unknown = self.vocabulary.get, len(self.vocabulary)
        return np.array([get(w, unknown) for w in text_words], np.int32)

    def retrieve(self, terms: np.ndarray, among: np.ndarray | None = None) -> np.ndarray:
        """Items (of those marked in ``among``) whose score for the distinct ``terms`` reaches their threshold."""
        terms = terms[terms < len(self.vocabulary)]
        tops = self.top[terms]
        if tops.sum() < self.lowest or not len(terms):
            return np.zeros(0, np.int64)
        if among is None:
            order = np.argsort(tops, kind="stable")
            pivot = int(np.searchsorted(np.cumsum(tops[order]), self.lowest))
            needed = terms[order[pivot:]]
            looked = np.zeros(self.blocks, bool)
            looked[self.block_of[_ranges(self.block_start[needed], self.block_start[needed + 1])]] = True
            at = _ranges(self.block_start[terms], self.block_start[terms + 1])
            bound = np.bincount(self.block_of[at], weights=self.block_top[at], minlength=self.blocks)
            kept = looked & (bound >= self.least)
            if not kept.any():
                return np.zeros(0, np.int64)
            among = np.repeat(kept, BLOCK)[: len(self.ids)]
        at = _ranges(self.start[terms], self.start[terms + 1])
        at = at[among[self.items[at]]]
        score = np.bincount(self.items[at], weights=self.weights[at], minlength=len(self.ids))
        return np.flatnonzero(among & (score >= self.threshold))


def _lowest(sequence: np.ndarray, weights: dict[int, float]) -> float:
    """The lowest score of a stretch of enough words, the heaviest of them changed."""
    seq, sums = sequence.tolist(), []
    for length in range(math.ceil(len(seq) * SHARE), len(seq) + 1):
        lost = allowed(length)
        if sums and lost == allowed(length - 1):
            continue  # a longer stretch with as many errors scores no lower
        for a in range(len(seq) - length + 1):
            x = sorted(weights[t] for t in set(seq[a : a + length]))
            sums.append(sum(x[: max(1, len(x) - lost)]))
    return min(sums) * 0.999


def best_score(item: np.ndarray, document: np.ndarray) -> int:
    """Score of the best local alignment of both sequences, with an error at ``PENALTY`` matches."""
    row = np.zeros(len(document) + 1, np.int32)
    gap = PENALTY * np.arange(len(document) + 1, dtype=np.int32)
    best = 0
    for word in item:
        new = np.maximum(row - PENALTY, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(document == word, 1, -PENALTY))
        row = np.maximum.accumulate(new + gap) - gap
        best = max(best, int(row.max()))
    return best


def held(item: np.ndarray, document: np.ndarray) -> tuple[int, int] | None:
    """(words, errors) of the longest stretch of the item, of half its words at least, that the document holds with at most ``allowed`` errors.

    Of stretches of one length that with the fewest errors counts; null when there is none.
    """
    n, m = len(item), len(document)
    least = math.ceil(n * SHARE)
    # each error takes one match at most and costs PENALTY
    if best_score(item, document) < min(k - (1 + PENALTY) * allowed(k) for k in range(least, n + 1)):
        return None
    column = np.arange(m + 1, dtype=np.int32)
    row = np.zeros(m + 1, np.int32)
    for word in item:  # the whole item first: no stretch is longer
        new = row + 1
        np.minimum(new[1:], row[:-1] + (document != word), out=new[1:])
        row = np.minimum.accumulate(new - column) + column
    if (errors := int(row.min())) <= allowed(n):
        return n, errors
    # distance[a]: errors between the words from a on and the stretch of the document that ends in each column, wherever that begins
    distance = np.zeros((n - least + 1, m + 1), np.int32)
    found = None
    for i in range(1, n + 1):
        rows = distance[: min(i, len(distance))]
        new = rows + 1
        np.minimum(new[:, 1:], rows[:, :-1] + (document != item[i - 1]), out=new[:, 1:])
        rows[:] = np.minimum.accumulate(new - column, axis=1) + column
        if i >= least:
            errors = rows[: i - least + 1].min(axis=1)
            for a in np.flatnonzero(errors <= np.ceil((i - np.arange(len(errors))) * ERRORS)).tolist():
                if found is None or (a - i, errors[a]) < (-found[0], found[1]):
                    found = (i - a, int(errors[a]))
    return found


def leaks(index: Index, text: str | None) -> list[tuple[int, int, int, int]]:
    """(item, its words, words held, errors) of every item of which the text holds enough. Null and empty texts hold none."""
    if not text or not index.ids:
        return []
    seq = index.terms_of(words(text))
    # a passage's terms are among the text's: an item below its threshold for the whole text is below it for every passage
    some = index.retrieve(np.unique(seq))
    if not len(some):
        return []
    among = np.zeros(len(index.ids), bool)
    among[some] = True
    longest = max(len(index.sequence[i]) for i in some.tolist())
    size = max(PASSAGE, 2 * (longest + allowed(longest)))  # a stretch with its errors lies within one passage
    best: dict[int, tuple[int, int]] = {}
    for a in range(0, max(1, len(seq) - size // 2), size // 2):
        part = seq[a : a + size]
        for i in index.retrieve(np.unique(part), among).tolist():
            if best.get(i) == (len(index.sequence[i]), 0):
                continue  # nothing is better than the whole item without an error
            got = held(index.sequence[i], part)
            if got is not None and (i not in best or (-got[0], got[1]) < (-best[i][0], best[i][1])):
                best[i] = got
    return [(index.ids[i], len(index.sequence[i]), *got) for i, got in best.items()]


def _over(index: Broadcast) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, *x) for d, t in batch[["doc_id", "text"]].itertuples(index=False) for x in leaks(index.value, t)]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "item_words", "held_words", "errors"])

    return run


def contaminated(documents: DataFrame, benchmark: DataFrame, chars: int = CHARS) -> DataFrame:
    """(doc_id, item_id, item_words, held_words, errors) of every document and item it holds; repeated rows count once.

    Items of null or wordless text are never held. No pair of documents is formed, so copies and hot sources need no care. ``chars``: the total
    size of items that one broadcast index may have.
    """
    schema = "doc_id BIGINT, item_id BIGINT, item_words INT, held_words INT, errors INT"
    items = benchmark.where("text IS NOT NULL").select("item_id", "text").distinct()
    parts = max(1, math.ceil(items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] / chars))
    context = documents.sparkSession.sparkContext
    out = None
    for b in range(parts):
        part = [(r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == b).collect()]
        found = documents.select("doc_id", "text").where("text IS NOT NULL").mapInPandas(_over(context.broadcast(Index(part))), schema)
        out = found if out is None else out.unionByName(found)
    best = F.min_by(F.struct("item_words", "held_words", "errors"), F.struct(-F.col("held_words"), "errors"))
    return out.groupBy("doc_id", "item_id").agg(best.alias("x")).select("doc_id", "item_id", "x.*")


def found(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contaminated(documents, benchmark).select("doc_id", "item_id")
