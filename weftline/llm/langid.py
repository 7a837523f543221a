"""Language of each document and of each segment in it, word first with character backoff.

A known word scores its log frequency in each language; an unseen word scores its longest known character n-grams, five letters first and shorter
ones after (single letters last). Sums over a sentence give a posterior. Sentences of one language in a row are a segment.

Both models are fitted on bounded samples: words and n-grams on at most ``PER_LANGUAGE`` expected documents a language, whose paragraphs are
relabelled once by the first fit so that wrong labels do no harm, every ``HELD_OUT``-th of them set aside to calibrate the confidence; a word model of page furniture on the blocks of at most ``FURNITURE_SAMPLE``
expected versions, labelled by the density operator. They are applied to whole texts of all versions. Code, tables, furniture and bylines do not
count, filler has no language; null and empty texts and texts without words have none either.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from weftline.llm import boilerplate, mojibake, residue

PER_LANGUAGE, VOCABULARY, NGRAMS, FURNITURE_SAMPLE = 300, 20_000, 30_000, 2_000
FOREIGN, MARGIN, SEEN = 60, 6.0, 100_000
TEMPERATURES, HELD_OUT = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0), 10
_DENSE = "぀-ヿ㐀-鿿가-힯ｦ-ﾟ"
_TOKEN = re.compile(f"[{_DENSE}]+|[^\\W\\d_{_DENSE}]+(?:['’][^\\W\\d_{_DENSE}]+)?")
_IS_DENSE = re.compile(f"[{_DENSE}]")
_SENTENCE = re.compile(r"[^.!?。！？…]+(?:[.!?。！？…]+[\"”’»)]*|$)\s*")
_FENCE = re.compile(r"(?ms)^[ \t]*(?:```|~~~).*?(?:^[ \t]*(?:```|~~~)[ \t]*$|\Z)")
_INLINE = re.compile(r"`+[^`\n]+`+|!\[[^\]\n]*\]\([^)\n]*\)|<[^>\n]{1,200}>|\S*://\S+|\S+@\S+\.\S+")
_MARKS = re.compile(r"[*_#>~\[\]]+")
# Notations of languages besides the two-letter code.
NAMES = {
    "en": "eng english anglais englisch inglés inglês angielski английский 英語",
    "de": "deu ger german deutsch allemand alemán alemão niemiecki немецкий ドイツ語",
    "fr": "fra fre french français francais französisch francés francês francuski французский フランス語",
    "es": "spa spanish español espanol castellano spanisch espagnol espanhol hiszpański испанский スペイン語",
    "pt": "por portuguese português portugues portugiesisch portugais portugués portugalski португальский ポルトガル語",
    "pl": "pol polish polski polnisch polonais polaco polonês польский ポーランド語",
    "ru": "rus russian русский russisch russe ruso russo rosyjski ロシア語",
    "ja": "jpn japanese 日本語 japanisch japonais japonés japonês japoński японский",
    "it": "ita italian italiano",
    "nl": "nld dut dutch nederlands",
    "sv": "swe swedish svenska",
    "zh": "zho chi chinese 中文 漢語",
    "ko": "kor korean 한국어",
    "ar": "ara arabic العربية",
    "uk": "ukr ukrainian українська",
    "cs": "ces cze czech čeština",
}
_NOTATION = {name: code for code, names in NAMES.items() for name in [code, *names.split()]}


def named_language(label: str | None) -> str | None:
    """The two-letter code that a label names in any notation; null when it names none."""
    if not label:
        return None
    text = label.strip().lower()
    return _NOTATION.get(text) or _NOTATION.get(re.split(r"[-_ ,;()]", text)[0])


def tokens(text: str) -> list[str]:
    """Lower-case words; scripts without spaces give overlapping pairs of characters."""
    out = []
    for w in _TOKEN.findall(text.lower()):
        if _IS_DENSE.match(w):
            out += [w[i : i + 2] for i in range(max(1, len(w) - 1))]
        else:
            out.append(w)
    return out


def plain(text: str) -> str:
    """The text without code and link targets."""
    return residue._TARGET.sub("]", _INLINE.sub(" ", _FENCE.sub("\n", text)))


class Model:
    """Scores of words by language, with n-gram backoff."""

    def __init__(self, texts: list[tuple[str, str]]):
        counts: dict[str, Counter] = defaultdict(Counter)
        for lang, text in texts:
            counts[lang].update(tokens(text))
        self.languages = sorted(counts)
        self.temperature = 1.0
        words, grams = {}, {}
        vocabulary = {w for c in counts.values() for w, n in c.most_common(VOCABULARY) if n > 1}
        for lang in self.languages:
            total = sum(counts[lang].values()) + len(vocabulary)
            words[lang] = {w: math.log((counts[lang][w] + 0.5) / total) for w in vocabulary}
        gram_counts: dict[str, Counter] = {}
        for lang in self.languages:
            c = gram_counts[lang] = Counter()
            for w, n in counts[lang].items():
                w = f" {w} "
                for size in range(1, 6):
                    for i in range(len(w) - size + 1):
                        c[w[i : i + size]] += n
        known = {g for c in gram_counts.values() for g, n in c.most_common(NGRAMS) if n > 2}
        for lang in self.languages:
            total = sum(n for g, n in gram_counts[lang].items() if g in known) + len(known)
            grams[lang] = {g: math.log((gram_counts[lang][g] + 0.5) / total) for g in known}
        self.words = {w: np.array([words[x][w] for x in self.languages], np.float32) for w in vocabulary}
        self.grams = {g: np.array([grams[x][g] for x in self.languages], np.float32) for g in known}
        for table in (self.words, self.grams):  # only differences between languages matter; one odd word must not decide
            for k, v in table.items():
                table[k] = np.maximum(v - v.max(), -7).astype(np.float32)
        self.index = {w: i for i, w in enumerate(self.words)}
        self.rows = np.zeros((len(self.index) + SEEN, len(self.languages)), np.float32)
        for w, i in self.index.items():
            self.rows[i] = self.words[w]

    def _row(self, w: str) -> int:
        """The row of a word; unseen words get one until ``SEEN`` are kept, then all of them are forgotten."""
        i = self.index.get(w)
        if i is None:
            if len(self.index) == len(self.rows):
                self.index = {x: j for j, x in enumerate(self.words)}
            i = self.index[w] = len(self.index)
            self.rows[i] = self._backoff(f" {w} ") * np.float32(0.5)
        return i

    def _backoff(self, w: str) -> np.ndarray:
        for size in range(5, 0, -1):
            hits = [self.grams[g] for i in range(len(w) - size + 1) if (g := w[i : i + size]) in self.grams and g.strip()]
            if hits:
                return np.mean(hits, axis=0)
        return np.zeros(len(self.languages), np.float32)

    def posterior(self, score: np.ndarray) -> np.ndarray:
        p = np.exp((score - score.max()) / self.temperature)
        return p / p.sum()

    def calibrate(self, held: list[tuple[str, str]]) -> Model:
        """Sets the temperature of the posterior by the log loss of labelled lines that the model was not fitted on."""
        scored = [(self.languages.index(lang), s) for lang, line in held if lang in self.languages for s, n in [self.score(line)] if n]
        losses = {}
        for self.temperature in TEMPERATURES:
            losses[self.temperature] = -sum(math.log(max(1e-12, float(self.posterior(s)[i]))) for i, s in scored)
        self.temperature = min(losses, key=lambda t: (losses[t], t)) if scored else 1.0
        return self

    def score(self, text: str) -> tuple[np.ndarray, int]:
        ws = tokens(text)
        if not ws:
            return np.zeros(len(self.languages), np.float32), 0
        ids: list[int] = []
        for w in ws:
            i = self.index.get(w)
            if i is None:
                before = len(self.index)
                i = self._row(w)
                if len(self.index) <= before:  # rows were forgotten: those of this text may be others' now
                    ids = [self._row(x) for x in ws[: len(ids)]]
            ids.append(i)
        return self.rows[ids].sum(axis=0), len(ws)


class Furniture:
    """Log odds of words that a line is page furniture rather than content."""

    def __init__(self, lines: list[tuple[str, bool]]):
        counts = {True: Counter(), False: Counter()}
        for text, verdict in lines:
            counts[verdict].update(set(self.features(text)))
        total = {k: sum(1 for _, v in lines if v is k) + 2 for k in counts}
        self.odds = {w: math.log((counts[True][w] + 0.2) / total[True]) - math.log((counts[False][w] + 0.2) / total[False]) for w in {*counts[True], *counts[False]} if counts[True][w] + counts[False][w] > 1}

    @staticmethod
    def features(text: str) -> list[str]:
        size = min(8, len(text) // 25)
        return [*tokens(text), f"#{size}", "#stop" if re.search(r"[.。!?]\s*$", text) else "#open", *(["#bar"] if re.search(r"\s[|·/»›>•]\s", text) else []), *(["#©"] if "©" in text else [])]

    def odd(self, text: str) -> float:
        return sum(self.odds.get(w, 0.0) for w in set(self.features(text)))


def content_lines(text: str, furniture: Furniture | None) -> list[str]:
    """Running content of a text by line: no code, tables, lists of links, bylines or furniture."""
    out = []
    for raw in plain(text).split("\n"):
        line = raw.strip()
        if not line or line.startswith("|") or boilerplate.byline(line):
            continue
        line = _MARKS.sub("", line).strip()
        if line and not (furniture and furniture.odd(line) > 0):
            out.append(line)
    return out


def segments(model: Model, furniture: Furniture | None, text: str | None) -> list[tuple[str, int, float, str]]:
    """(language, characters, confidence, text) of each run of sentences of one language. Null, empty and filler texts have none."""
    if not text or not text.strip():
        return []
    clean = residue.prose(text)
    if residue.trusted(clean, residue.masked(clean, None, None)) == "filler":
        return []
    if not text.isascii():
        text = mojibake.repair(text)[0]
    if text.count("�") > 0.05 * len(text):
        return []
    out: list[list] = []
    langs = model.languages
    for line in content_lines(text, furniture):
        sentences = [s for s in _SENTENCE.findall(line) if s.strip()] or [line]
        scored = [model.score(s) for s in sentences]
        whole = np.sum([s for s, _ in scored], axis=0)
        if not any(n for _, n in scored):
            continue
        home = int(whole.argmax())
        for sentence, (s, n) in zip(sentences, scored):
            best = int(s.argmax())
            at = best if n and s[best] - s[home] > MARGIN else home
            if out and out[-1][0] == at:
                out[-1][1] += len(sentence.strip())
                out[-1][2] = out[-1][2] + s
                out[-1][3] += "\n" + sentence.strip()
            else:
                out.append([at, len(sentence.strip()), s, sentence.strip()])
    done = []
    for at, chars, s, piece in out:
        p = model.posterior(s)
        done.append((langs[at], chars, float(p[at]), piece))
    return done


def languages_of(found: list[tuple[str, int, float, str]]) -> list[tuple[str, int, float]]:
    """(language, characters, confidence), the main one first, then each further one of more than ``FOREIGN`` characters."""
    chars, weight = Counter(), Counter()
    for lang, n, p, _ in found:
        chars[lang] += n
        weight[lang] += n * p
    order = sorted(chars, key=lambda x: (-chars[x], x))
    return [(x, chars[x], weight[x] / chars[x]) for i, x in enumerate(order) if i == 0 or chars[x] > FOREIGN]


@F.pandas_udf(StringType())
def _named(labels: pd.Series) -> pd.Series:
    return labels.map(named_language)


def fit(documents: DataFrame) -> Model:
    """The language model from an expected ``PER_LANGUAGE`` documents of each language that labels name; of these every ``HELD_OUT``-th calibrates it.

    Labels are reduced to the languages they name before anything comes to the driver.
    """
    labels = documents.where("lang IS NOT NULL").groupBy("lang").count().withColumn("code", _named("lang")).where("code IS NOT NULL")
    total = {r["code"]: r["n"] for r in labels.groupBy("code").agg(F.sum("count").alias("n")).collect()}  # one row for each language there is a name for
    rate = F.lit(0)
    for code, n in sorted(total.items()):
        rate = F.when(F.col("code") == code, int(10**6 * min(1.0, PER_LANGUAGE / n))).otherwise(rate)
    some = documents.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", _named("lang").alias("code")).where("code IS NOT NULL")
    rows = some.where(F.pmod(F.xxhash64("doc_id"), F.lit(10**6)) < rate).select("doc_id", "code", "text").collect()
    parts = [(r["code"], line) for r in rows if r["doc_id"] % HELD_OUT for line in content_lines(r["text"], None)]
    first = Model(parts)
    again = [(first.languages[int(s.argmax())] if n >= 6 else lang, line) for lang, line in parts for s, n in [first.score(line)]]
    held = [(r["code"], line) for r in rows if not r["doc_id"] % HELD_OUT for line in content_lines(r["text"], None)]
    return Model(again).calibrate(held)


def fit_furniture(versions: DataFrame, fetch_log: DataFrame, blocks: DataFrame) -> Furniture:
    """The furniture model from blocks of an expected ``FURNITURE_SAMPLE`` versions, labelled by their pages' main bodies."""
    n = versions.count()
    part = F.pmod(F.xxhash64("doc_id"), F.lit(10**6)) < int(10**6 * min(1.0, FURNITURE_SAMPLE / max(1, n)))
    some = versions.where(part).where("raw_hash IS NOT NULL").select("doc_id", "version", "raw_hash")
    hashes = some.select("raw_hash").distinct()
    # FURNITURE_SAMPLE hashes are expected; a document of very many versions may bring more
    pages = fetch_log.join(F.broadcast(hashes) if hashes.count() <= 10 * FURNITURE_SAMPLE else hashes, "raw_hash", "left_semi")
    own = blocks.where(part)
    rows = boilerplate.judged(some, pages, own).where("furniture IS NOT NULL").join(own.select("doc_id", "version", "block_id", "markdown"), ["doc_id", "version", "block_id"]).select("markdown", "furniture").distinct().collect()
    return Furniture([(_MARKS.sub("", line).strip(), f) for text, f in rows for line in plain(text).split("\n") if line.strip() and not line.startswith("|")])


def _over(model: Model, furniture: Furniture, each: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, version, label, text in batch[["doc_id", "version", "label", "markdown"]].itertuples(index=False):
                got = segments(model, furniture, text)
                if each:
                    out += [(doc, version, i, lang, n, p, piece) for i, (lang, n, p, piece) in enumerate(got, 1)]
                    continue
                found = languages_of(got)
                right = bool(found) and named_language(label) == found[0][0]
                out += [(doc, version, lang, n, p, i == 0, label, right) for i, (lang, n, p) in enumerate(found)]
            names = ["doc_id", "version", "segment", "lang", "chars", "confidence", "text"] if each else ["doc_id", "version", "lang", "chars", "confidence", "main", "label", "label_right"]
            yield pd.DataFrame(out, columns=names)

    return run


@cache
def _schemas() -> tuple[str, str]:
    return "doc_id STRING, version INT, segment INT, lang STRING, chars INT, confidence DOUBLE, text STRING", "doc_id STRING, version INT, lang STRING, chars INT, confidence DOUBLE, main BOOLEAN, label STRING, label_right BOOLEAN"


def identified(versions: DataFrame, documents: DataFrame, fetch_log: DataFrame, blocks: DataFrame, each: bool = False) -> DataFrame:
    """One row for each version and language of its content (``each``: for each segment); repeated rows count once."""
    model, furniture = fit(documents), fit_furniture(versions, fetch_log, blocks)
    texts = versions.select("doc_id", "version", F.col("meta.lang").alias("label"), "markdown").where("markdown IS NOT NULL")
    return texts.mapInPandas(_over(model, furniture, each), _schemas()[0 if each else 1]).distinct()


def found(versions: DataFrame, documents: DataFrame, fetch_log: DataFrame, blocks: DataFrame) -> DataFrame:
    """Languages of versions whose label is not right or whose content has a further language."""
    rows = identified(versions, documents, fetch_log, blocks)
    many = rows.groupBy("doc_id", "version").agg(F.collect_set("lang").alias("langs"), F.bool_or(F.col("main") & F.col("label_right")).alias("right"))
    return many.where(~F.col("right") | (F.size("langs") > 1)).select("doc_id", "version", F.explode("langs").alias("lang"))
