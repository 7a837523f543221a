"""Full-text search: postings, boolean, phrase and prefix match, BM25.

``inverted`` makes stemmed postings of text and title that can be written once, bucketed by term, and searched many times: a query reads the postings
of its own terms only. ``matching`` and ``bm25`` are the plain scans over unstemmed tokens.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.stem import stems, stems_udf
from weftline.functions.text import ascii_tokens

K1, B, TITLE_WEIGHT, LEAST_IDF = 1.2, 0.75, 0.5, 1e-6


def compile_query(query: str) -> list[list[tuple[list[str], bool]]]:
    """OR of ANDs of (words of a phrase, whether its last word is a prefix). Repeated or leading or trailing OR does not count."""
    branches: list[list[tuple[list[str], bool]]] = [[]]
    for quoted, word in re.findall(r'"([^"]*)"?|(\S+)', query):
        if word == "OR":
            if branches[-1]:
                branches.append([])
            continue
        text = quoted or word
        words = re.findall(r"[a-z0-9]+", text.lower())
        if words:
            branches[-1].append((words, word.endswith("*")))
    return [b for b in branches if b]


def postings(units: DataFrame, key: list[str], text: str, title: str | None = None) -> DataFrame:
    """(key, term, column, positions) of each unit."""
    columns = [F.struct(F.lit("text").alias("col"), ascii_tokens(F.coalesce(F.col(text), F.lit(""))).alias("words"))]
    if title:
        columns.append(F.struct(F.lit("title").alias("col"), ascii_tokens(F.coalesce(F.col(title), F.lit(""))).alias("words")))
    each = units.select(*key, F.explode(F.array(*columns)).alias("c")).select(*key, "c.col", F.posexplode("c.words").alias("pos", "term"))
    return each.groupBy(*key, "term", "col").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def matching(units: DataFrame, key: list[str], text: str, query: str) -> DataFrame:
    """Keys of the units that a query matches, each word in the text's token sequence; an empty query matches none.

    The predicate is evaluated within the row, so nothing is shuffled.
    """
    spaced = F.concat(F.lit(" "), F.array_join(ascii_tokens(F.coalesce(F.col(text), F.lit(""))), " "), F.lit(" "))
    wanted = F.lit(False)
    for branch in compile_query(query):
        every = F.lit(True)
        for words, prefix in branch:
            every = every & spaced.contains(" " + " ".join(words) + ("" if prefix else " "))
        wanted = wanted | every
    return units.where(wanted).select(*key)


def bm25(units: DataFrame, key: list[str], text: str, title: str, terms: list[str]) -> DataFrame:
    """Scores of the units that hold every term. Terms are filtered before anything is shuffled; lengths and counts are over all units."""
    words, heads = ascii_tokens(F.coalesce(F.col(text), F.lit(""))), ascii_tokens(F.coalesce(F.col(title), F.lit("")))
    u = units.select(*key, words.alias("w"), heads.alias("h"))

    def held(column: str, term: str) -> Column:
        return F.size(F.filter(column, lambda x: x == F.lit(term)))

    counts = {t: (held("w", t), held("h", t)) for t in terms}
    u = u.select(*key, (F.size("w") + F.size("h")).alias("dl"), *[c.alias(f"{n}{i}") for i, t in enumerate(terms) for n, c in zip("wh", counts[t])])
    # one row, as a scalar of the plan: nothing is run until an action asks for the scores
    s = u.agg(F.struct(F.count("*").alias("n"), F.avg("dl").alias("mean"), *[F.count_if((F.col(f"w{i}") + F.col(f"h{i}")) > 0).alias(f"df{i}") for i in range(len(terms))])).scalar()
    hit = u
    for i in range(len(terms)):
        hit = hit.where(F.col(f"w{i}") + F.col(f"h{i}") > 0)
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.greatest(F.log((s["n"] - s[f"df{i}"] + 0.5) / (s[f"df{i}"] + 0.5)), F.lit(LEAST_IDF))
        tf = F.col(f"w{i}") + TITLE_WEIGHT * F.col(f"h{i}")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.greatest(s["mean"], F.lit(1e-9))))
    return hit.select(*key, score.alias("score"))


def top(scored: DataFrame, key: list[str], k: int = 10) -> DataFrame:
    """The ``k`` best (1 to 200), ties by key."""
    return scored.orderBy(F.desc("score"), *key).limit(max(1, min(200, k)))


BUCKETS = 64


def inverted(units: DataFrame, key: list[str], text: str, title: str) -> DataFrame:
    """(term, bucket, key, length, places): the places (column 0 text or 1 title, position) of each stem in each unit.

    ``length`` counts the tokens of both columns; a unit without a token has one row of the empty term, so that the number of units and their mean
    length can be read from the postings.
    """
    w, h = stems_udf(F.coalesce(F.col(text), F.lit(""))), stems_udf(F.coalesce(F.col(title), F.lit("")))
    u = units.select(*key, w.alias("w"), h.alias("h")).withColumn("length", F.size("w") + F.size("h"))
    placed = lambda name, column: F.transform(name, lambda x, i: F.struct(x.alias("term"), F.struct(F.lit(column).alias("col"), i.alias("pos")).alias("place")))
    none = F.array(F.struct(F.lit("").alias("term"), F.lit(None).cast("struct<col:int,pos:int>").alias("place")))
    each = u.select(*key, "length", F.explode(F.concat(placed("w", 0), placed("h", 1), none)).alias("e")).select(*key, "length", "e.term", "e.place")
    out = each.groupBy("term", *key).agg(F.first("length").alias("length"), F.sort_array(F.collect_list("place")).alias("places"))
    return out.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))


def write_index(postings: DataFrame, path: str) -> None:
    """The postings as Parquet, one folder a bucket of terms."""
    postings.repartition("bucket").sortWithinPartitions("term").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def stemmed_query(query: str) -> list[list[tuple[tuple[str, ...], bool]]]:
    """``compile_query`` over stems of any script: OR of ANDs of (stems of a phrase, whether the last is a prefix). A doubled OR is an error."""
    if re.search(r"(?:^|\s)OR\s+OR(?:\s|$)", query):
        raise ValueError("invalid_argument: OR stands twice in a row")
    branches: list[list[tuple[tuple[str, ...], bool]]] = [[]]
    for quoted, word in re.findall(r'"([^"]*)"?|(\S+)', query):
        if word == "OR":
            branches.append([])
            continue
        if found := tuple(stems(quoted or word)):
            branches[-1].append((found, word.endswith("*")))
    return [b for b in branches if b]


def _followed(places: Column, after: Column, by: int) -> Column:
    """Places that one of ``after`` follows in the same column."""
    return F.filter(places, lambda p: F.exists(after, lambda q: (q["col"] == p["col"]) & (q["pos"] == p["pos"] + by)))


def search(postings: DataFrame, key: list[str], query: str, columns: tuple[int, ...] = (0, 1)) -> DataFrame:
    """(key, score): the units that match a query, with BM25 over the phrases of the branches that they match; an empty query matches none.

    Statistics are over all units of the postings. Only postings of the query's terms are read, and only they are shuffled, by unit.
    """
    branches = stemmed_query(query)
    if not branches:
        return postings.select(*key, F.lit(0.0).alias("score")).limit(0)
    phrases = list(dict.fromkeys(p for b in branches for p in b))
    exact = sorted({t for words, prefix in phrases for t in (words[:-1] if prefix else words)})
    starts = sorted({words[-1] for words, prefix in phrases if prefix})
    # a whole term stands in a known bucket, so that only the folders of the query's terms are read
    wanted = F.lit(False)
    for t in exact:
        wanted = wanted | ((F.col("bucket") == F.pmod(F.xxhash64(F.lit(t)), F.lit(BUCKETS)).cast("int")) & (F.col("term") == t))
    for t in starts:
        wanted = wanted | F.col("term").startswith(t)
    none = F.pmod(F.xxhash64(F.lit("")), F.lit(BUCKETS)).cast("int")
    size = postings.where((F.col("bucket") == none) & (F.col("term") == "")).agg(F.struct(F.count("*").alias("n"), F.avg("length").alias("mean"))).scalar()
    hits = postings.where(wanted & (F.col("term") != "")).groupBy(*key).agg(F.first("length").alias("length"), F.collect_list(F.struct("term", "places")).alias("found"))

    def places(word: str, prefix: bool) -> Column:
        mine = F.filter("found", lambda f: f["term"].startswith(word) if prefix else f["term"] == word)
        return F.flatten(F.transform(mine, lambda f: f["places"]))

    for i, (words, prefix) in enumerate(phrases):
        own = F.filter(places(words[0], prefix and len(words) == 1), lambda p: p["col"].isin(*columns))
        for j, word in enumerate(words[1:], 1):
            after = places(word, prefix and j == len(words) - 1)
            own = _followed(own, after, j)
        hits = hits.withColumn(f"tf{i}", F.size(F.filter(own, lambda p: p["col"] == 0)) + TITLE_WEIGHT * F.size(F.filter(own, lambda p: p["col"] == 1)))
    counts = hits.agg(F.struct(*[F.count_if(F.col(f"tf{i}") > 0).alias(f"n{i}") for i in range(len(phrases))])).scalar()
    match, score = F.lit(False), F.lit(0.0)
    for branch in branches:
        every, own = F.lit(True), F.lit(0.0)
        for p in branch:
            i = phrases.index(p)
            tf = F.col(f"tf{i}")
            idf = F.greatest(F.log((size["n"] - counts[f"n{i}"] + 0.5) / (counts[f"n{i}"] + 0.5)), F.lit(LEAST_IDF))
            every, own = every & (tf > 0), own + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.greatest(size["mean"], F.lit(1e-9))))
        match, score = match | every, score + F.when(every, own).otherwise(0.0)
    return hits.where(match).select(*key, score.alias("score"))


def marked_snippet(text: str | None, query: str, tokens: int = 24) -> str:
    """A window of at most ``tokens`` tokens of a text with the words of the query in marks; the window that holds most of them, the first of equals."""
    wanted = {(w, p and i == len(ws) - 1) for b in stemmed_query(query) for ws, p in b for i, w in enumerate(ws)}
    found = list(re.finditer(r"[^\W_]+", text or ""))
    hit = [any(s.startswith(w) if p else s == w for w, p in wanted) for m in found for s in [(stems(m.group()) or [""])[0]]]
    best = max(range(max(1, len(found) - tokens + 1)), key=lambda a: (sum(hit[a : a + tokens]), -a), default=0)
    out, at = [], found[best].start() if found and best else 0
    for m, h in list(zip(found, hit))[best : best + tokens]:
        out += [text[at : m.start()], f"«{m.group()}»" if h else m.group()]
        at = m.end()
    tail = text[at:] if found and best + tokens >= len(found) else ""
    return ("…" if best else "") + "".join(out) + (tail if tail or not found or best + tokens >= len(found) else "…") if found else (text or "")


def snippets(query: str):
    """``marked_snippet`` as a vectorised column function for one query."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: marked_snippet(t, query))

    return run

