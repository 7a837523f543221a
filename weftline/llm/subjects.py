"""Subject areas of documents.

Complement naive Bayes gives each word a weight for each subject: the logarithm of its likelihood in the subject's text over that in the complement,
all other text, both smoothed towards the word's likelihood in the whole. It is trained on labelled documents and refined by
expectation-maximization: each pass scores every sentence of every document, in the light of the document's other sentences, and adds its words to
the subjects by its posteriors, the rest of them going to text about no subject. The posterior that a document has a subject's label, independent of the
other subjects, is a sigmoid of the share of its own sentences about it; it is calibrated on labelled documents that were held out of training, every
``HELD_OUT``-th by hash. A document gets the subjects of at least ``SHARE`` of its own sentences, which is the definition; hand labels name only the
subjects that stand out, so a posterior of a half asks for more.

Words are hashed to ``FEATURES`` places, which bounds the model that is sent to the tasks whatever the vocabulary. Labels are trimmed and compared
without case; null or unknown labels are left out, and language labels are reduced to the languages they name. Training takes an expected
``LABELLED`` labelled documents at most, expectation-maximization all documents. A sentence ends with a sentence mark and has four words or more;
null and empty texts and texts without a sentence have no subject.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.langid import named_language
from weftline.llm.sitelines import NAME
from weftline.session import cut

FEATURES, LABELLED, ROUNDS, SHARE, CHUNK, HELD_OUT = 2**17, 20_000, 2, 0.25, 1_000, 20
PRIOR, ABOUT, KNOWN, SMOOTH, LEAST, COMMON, WRONG = 1.0, 3.5, 0.05, 3.0, 1.4, 0.2, 0.002
_DENSE = "぀-ヿ㐀-鿿"
_TOKEN = re.compile(f"[{_DENSE}]+|[^\\W\\d_{_DENSE}]{{2,}}")
_IS_DENSE = re.compile(f"[{_DENSE}]")
_SENTENCE = re.compile(r"[^.!?。！？…]+[.!?。！？…]+[\"”’»)*_`]*")
_END = re.compile(r"[.!?。！？…]")
_FENCE = re.compile(r"(?ms)^[ \t]*(?:```|~~~).*?(?:^[ \t]*(?:```|~~~)[ \t]*$|\Z)")
_TARGET = re.compile(r"\]\([^)\s]*\)")
_PLACES: dict[str, int] = {}


def features(text: str) -> list[int]:
    words = _TOKEN.findall(text.lower())
    if not text.isascii() and _IS_DENSE.search(text):
        words = [x for w in words for x in ([w[i : i + 2] for i in range(max(1, len(w) - 1))] if _IS_DENSE.match(w) else (w,))]
    try:
        return [_PLACES[w] for w in words]
    except KeyError:
        if len(_PLACES) > 500_000:
            _PLACES.clear()
        _PLACES.update((w, xxhash.xxh32_intdigest(w) % FEATURES) for w in set(words).difference(_PLACES))
        return [_PLACES[w] for w in words]


def sentences(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word places of all sentences in a row, the start of each sentence, and the line that each stands in. Code, tables and fragments are left out."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = _FENCE.sub("\n", text) if "```" in text or "~~~" in text else text
    text = _TARGET.sub("]", text) if "](" in text else text
    ids: list[int] = []
    starts, lines = [], []
    for n, line in enumerate(text.split("\n")):
        if not line or line[0] in "|#" or not _END.search(line):
            continue
        for s in _SENTENCE.findall(NAME.sub(" ", line)):
            got = features(s)
            if len(got) >= 4:
                starts.append(len(ids))
                lines.append(n)
                ids += got
    return np.array(ids, np.int64), np.array(starts, np.int64), np.array(lines, np.int64)


class Batch:
    """Sentences of many documents in a row: word places, sentence starts, document and line of each sentence. Documents without one are left out."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.kept = [i for i, r in enumerate(rows) if len(r[1])]
        rows = [rows[i] for i in self.kept]
        words = np.array([len(r[0]) for r in rows], np.int64)
        self.sentences = np.array([len(r[1]) for r in rows], np.int64)
        before = np.concatenate([[0], np.cumsum(words)])[:-1] if rows else words
        none = [np.zeros(0, np.int64)]
        self.ids = np.concatenate([r[0] for r in rows] or none).astype(np.int64)
        self.starts = np.concatenate([np.asarray(r[1], np.int64) + a for r, a in zip(rows, before)] or none)
        self.documents = np.concatenate([[0], np.cumsum(self.sentences)])[:-1].astype(np.int64) if rows else words
        self.document = np.repeat(np.arange(len(rows)), self.sentences)
        # lines are numbered through all documents
        raw = np.concatenate([np.asarray(r[2], np.int64) for r in rows] or none)
        change = np.ones(len(raw), bool)
        change[1:] = (raw[1:] != raw[:-1]) | (self.document[1:] != self.document[:-1])
        self.lines = np.cumsum(change) - 1
        self.sizes = np.diff(np.append(self.starts, len(self.ids)))

    def held(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each (document, place) once: order of the words by it, first word of each, its document, its place."""
        key = np.repeat(self.document, self.sizes) * FEATURES + self.ids
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(key) else order
        return order, first, ranked[first] // FEATURES, ranked[first] % FEATURES


def _chunks(batch: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, Batch]]:
    """Parts of a batch of bounded size with their sentences."""
    for a in range(0, len(batch), CHUNK):
        part = batch.iloc[a : a + CHUNK]
        b = Batch(list(zip(part["ids"], part["starts"], part["lines"])))
        if b.kept:
            yield part.iloc[b.kept], b


class Model:
    """Word weights by subject, from counts by place and subject; the last column counts text about no subject."""

    def __init__(self, counts: np.ndarray, subjects: list[str], common: np.ndarray, smooth: float = SMOOTH):
        self.subjects = subjects
        k = len(subjects)
        total = counts.sum(axis=1, keepdims=True)
        # likelihoods in the subject and in its complement but for the subject's size, which balancing makes the same for all: the complement has
        # k times as much text. Both are smoothed by as much of the whole; what says little says nothing.
        own = counts[:, :k] + smooth / (k + 1)
        complement = (total - counts[:, :k] + smooth * k / (k + 1)) / k
        weight = np.log(own) - np.log(complement)
        self.weights = np.where((total > 0.5) & (np.abs(weight) >= LEAST) & ~common[:, None], np.clip(weight, -4, 5), 0).astype(np.float32)
        self.about, self.slope, self.middle = ABOUT, 20.0, SHARE

    def scores(self, b: Batch) -> np.ndarray:
        """Score of each sentence for each subject; the mean posterior of its document is a prior."""
        each = self.weights[b.ids]
        raw = np.add.reduceat(each, b.starts, axis=0)
        # one word, however telling, makes no sentence about a subject
        raw = np.where(np.add.reduceat((each > 0).astype(np.int16), b.starts, axis=0) >= 2, raw, np.minimum(raw, 0))
        p = 1 / (1 + np.exp(-np.clip(raw - self.about, -30, 30)))
        prior = np.add.reduceat(p, b.documents, axis=0) / b.sentences[:, None]
        prior = np.log((prior + KNOWN) / (prior.mean(axis=1, keepdims=True) + KNOWN))
        return raw + PRIOR * np.repeat(prior, b.sentences, axis=0) * (raw.max(axis=1, keepdims=True) > 1)

    def shares(self, b: Batch) -> np.ndarray:
        """Share of each document's own sentences about each subject. Short lines about nothing are not a document's own."""
        scores = self.scores(b)
        best, about = scores.argmax(axis=1), scores.max(axis=1) > self.about
        own = (np.bincount(b.lines, weights=about)[b.lines] > 0) | (np.bincount(b.lines)[b.lines] > 2)
        n, k = len(b.documents), len(self.subjects)
        count = np.bincount(b.document[own], minlength=n)
        hit = about & own
        got = np.bincount(b.document[hit] * k + best[hit], minlength=n * k).reshape(n, k)
        return got / np.maximum(count, 1)[:, None]

    def probability(self, share: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (share - self.middle), -30, 30)))


def _featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        done = [sentences(t) for t in batch["text"]]
        parts = {c: pd.Series([d[i].astype(np.int32) for d in done], dtype=object) for i, c in enumerate(("ids", "starts", "lines"))}
        yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "lang": [named_language(x) or "" for x in batch["lang"]], **parts})


def _counts(model: Model | None, subjects: list[str], scale: dict[str, np.ndarray]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Summed word counts by subject of a task's documents: by their labels without a model, else by sentence posteriors, what is left of them
    counting for no subject.

    ``scale`` balances the subjects within each language label. Rows of place -1 hold the mass of a language before balancing. A word counts once
    a document, at its mean posterior there: one odd document cannot teach much.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(subjects)
        total, mass, even = np.zeros((FEATURES, k + 1)), {}, np.ones(k)
        for part, b in (x for batch in batches for x in _chunks(batch)):
            known = np.zeros((len(part), k))
            for i, labels in enumerate(part["labels"]):
                if labels is not None:
                    known[i, [subjects.index(x) for x in labels]] = 1 / len(labels)
            if model is None:
                p, none = known[b.document], np.zeros((len(b.starts), 1))
            else:
                # a label speaks for its subjects, but does not forbid others: labels may be wrong
                scores = model.scores(b) + (known > 0)[b.document]
                top = scores.max(axis=1, keepdims=True)
                p = np.exp(np.clip(scores - top, -30, 0))
                some = 1 / (1 + np.exp(-np.clip(top - model.about, -30, 30)))
                p, none = p / p.sum(axis=1, keepdims=True) * some, 1 - some
            langs = part["lang"].tolist()
            mean = np.add.reduceat(p, b.documents, axis=0) / b.sentences[:, None]
            for lang in set(langs):
                mass[lang] = mass.get(lang, 0) + mean[[x == lang for x in langs]].sum(axis=0)
            order, first, document, place = b.held()
            words = np.repeat(np.hstack([p, none]), b.sizes, axis=0)[order]
            each = np.add.reduceat(words, first, axis=0) / np.diff(np.append(first, len(order)))[:, None]
            each[:, :k] *= np.array([scale.get(x, even) for x in langs])[document]
            for i in range(k + 1):
                total[:, i] += np.bincount(place, weights=each[:, i], minlength=FEATURES)
        at = np.flatnonzero(total.sum(axis=1) > 1e-6)
        for a in range(0, len(at), 20_000):
            part = at[a : a + 20_000]
            yield pd.DataFrame({"place": part, "lang": None, **{f"s{i}": total[part, i] for i in range(k + 1)}})
        if mass:
            yield pd.DataFrame({"place": -1, "lang": list(mass), **{f"s{i}": [m[i] if i < k else 0.0 for m in mass.values()] for i in range(k + 1)}})

    return run


def _spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, place, documents that hold it) of a task's documents; place -1 holds the number of documents."""
    total: dict[str, np.ndarray] = {}
    for part, b in (x for batch in batches for x in _chunks(batch)):
        langs = part["lang"].to_numpy()
        _, _, document, place = b.held()
        for lang in set(langs.tolist()):
            held = total.setdefault(lang, np.zeros(FEATURES + 1, np.int64))
            mine = langs == lang
            held[:-1] += np.bincount(place[mine[document]], minlength=FEATURES)
            held[-1] += mine.sum()
    for lang, held in total.items():
        at = np.flatnonzero(held)
        yield pd.DataFrame({"lang": lang, "place": np.where(at == FEATURES, -1, at), "n": held[at]})


def common_places(rows: DataFrame, subjects: int) -> np.ndarray:
    """Whether a place stands in too many of the documents of some language to make a subject: more than ``COMMON``, or one and a half times an
    even part where the subjects are few. Counted over all documents."""
    counts = rows.select("lang", "ids", "starts", "lines").mapInPandas(_spread, "lang STRING, place BIGINT, n BIGINT").groupBy("lang", "place").agg(F.sum("n").alias("n"))
    size = counts.where("place = -1").select("lang", F.col("n").alias("size"))
    expected = F.col("size") * max(COMMON, 1.5 / subjects)
    # by more than chance, so that the documents of a rare language do not make all their words common
    places = counts.where("place >= 0").join(size, "lang").where(F.col("n") > expected + 2 * F.sqrt(expected)).select("place").distinct()
    out = np.zeros(FEATURES, bool)
    out[[r[0] for r in places.collect()]] = True  # at most FEATURES rows
    return out


def _scaled(mass: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {lang: np.clip(m.mean() / np.maximum(m, 1e-9), 0.2, 5.0) for lang, m in mass.items()}


def _gather(rows: DataFrame, model: Model | None, subjects: list[str], scale: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Counts by place, and the scale that balances the subjects of each language from their masses."""
    columns = [f"s{i}" for i in range(len(subjects) + 1)]
    parts = rows.mapInPandas(_counts(model, subjects, scale), "place BIGINT, lang STRING, " + ", ".join(f"{c} DOUBLE" for c in columns))
    got = parts.groupBy("place", "lang").agg(*[F.sum(c).cast("float").alias(c) for c in columns]).toPandas()  # at most FEATURES rows and the languages
    counts = np.zeros((FEATURES, len(subjects) + 1))
    words = got[got["place"] >= 0]
    if len(words):
        counts[words["place"].to_numpy()] = words[columns].to_numpy()
    return counts, _scaled({row.lang: np.array(row[2:-1], float) for row in got[got["place"] < 0].itertuples(index=False)})


def names(subjects: DataFrame) -> list[str]:
    return sorted({r[0].strip().lower() for r in subjects.select("subject").distinct().collect() if r[0] and r[0].strip()})


def featured(documents: DataFrame, labels: DataFrame, known: list[str]) -> DataFrame:
    """(doc_id, lang, ids, starts, lines, labels) of each document with a text, read and taken apart once and kept for all passes."""
    clean = labels.select("doc_id", F.lower(F.trim("subject")).alias("subject")).where(F.col("subject").isin(known)).groupBy("doc_id").agg(F.collect_set("subject").alias("labels"))
    rows = documents.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "text").where("text IS NOT NULL")
    rows = rows.mapInPandas(_featured, "doc_id BIGINT, lang STRING, ids ARRAY<INT>, starts ARRAY<INT>, lines ARRAY<INT>")
    return cut(rows.join(clean, "doc_id", "left"))


def fit(rows: DataFrame, known: list[str], rounds: int = ROUNDS) -> Model:
    """``rows`` as ``featured`` gives them."""
    some = rows.where("labels IS NOT NULL")
    n = max(1, some.count())
    some = some.where(F.pmod(F.xxhash64("doc_id"), F.lit(10**6)) < int(10**6 * min(1.0, LABELLED / n)))
    last = F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(HELD_OUT)) == 0
    held, some = some.where(last), some.where(~last)
    rows = rows.withColumn("labels", F.when(~last, F.col("labels")))
    common = common_places(rows, len(known))
    # labels are wrong now and then: words that few labelled documents hold, as against all of them, must not start a subject
    smooth = SMOOTH + WRONG * min(n, LABELLED)
    mass: dict[str, np.ndarray] = {}
    for lang, subject, w in some.select("lang", F.explode("labels").alias("subject"), (1 / F.size("labels")).alias("w")).groupBy("lang", "subject").agg(F.sum("w")).collect():
        mass.setdefault(lang, np.zeros(len(known)))[known.index(subject)] = w
    scale = _scaled(mass)
    counts, _ = _gather(some, None, known, scale)
    model = Model(counts, known, common, smooth)
    for _ in range(rounds):
        counts, scale = _gather(rows, model, known, scale)
        model = Model(counts, known, common, smooth)
    return calibrated(model, held)


def calibrated(model: Model, held: DataFrame) -> Model:
    """Slope and middle of the sigmoid by a grid over the log loss of labelled documents that the model was not trained on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, b in (x for batch in batches for x in _chunks(batch)):
            share = model.shares(b)
            out = [(int(round(20 * x)), s in labels, 1) for labels, row in zip(part["labels"], share) for x, s in zip(row, model.subjects)]
            yield pd.DataFrame(out, columns=["bin", "label", "n"])

    rows = held.mapInPandas(run, "bin INT, label BOOLEAN, n BIGINT").groupBy("bin", "label").agg(F.sum("n").alias("n")).collect()  # 42 rows at most
    best = None
    for slope in (5.0, 10.0, 20.0, 40.0):
        for middle in (0.1, 0.15, 0.2, 0.25, 0.3, 0.35):
            loss = 0.0
            for at, label, n in rows:
                p = 1 / (1 + np.exp(-slope * (at / 20 - middle)))
                loss -= n * np.log(max(1e-6, p if label else 1 - p))
            if best is None or loss < best[0]:
                best = (loss, slope, middle)
    if rows and best:
        model.slope, model.middle = best[1], best[2]
    return model


def assigned(documents: DataFrame, subjects: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, subject, share, probability) of every document and subject that some own sentence is about; repeated rows count once."""
    known = names(subjects)
    schema = "doc_id BIGINT, subject STRING, share DOUBLE, probability DOUBLE"
    if not known:
        return documents.sparkSession.createDataFrame([], schema)
    rows = featured(documents, labels, known)
    model = fit(rows, known)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, b in (x for batch in batches for x in _chunks(batch)):
            share = model.shares(b)
            p = model.probability(share)
            i, j = np.nonzero(share)
            docs = part["doc_id"].tolist()
            yield pd.DataFrame([(docs[a], model.subjects[b_], float(share[a, b_]), float(p[a, b_])) for a, b_ in zip(i, j)], columns=["doc_id", "subject", "share", "probability"])

    return rows.mapInPandas(run, schema).distinct()


def found(documents: DataFrame, subjects: DataFrame, labels: DataFrame) -> DataFrame:
    """Subjects that at least a quarter of a document's own sentences are about."""
    return assigned(documents, subjects, labels).where(F.col("share") >= SHARE - 1e-9).select("doc_id", "subject")
