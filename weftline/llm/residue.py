"""Template residue, error pages, script notices and filler in place of content.

Texts are masked (digits, identifiers, addresses, the site's own name) and equal masked texts are one node. Trusted labels are few: unfilled
placeholders in prose, stock filler, notices that speak for themselves (two notice sentences, or an order to switch scripts on), the wording of a
message on a fetch that failed, and a text of several documents most of whose fetches failed. They spread over the connected components of near
copies: a node joins a labelled component when its five-word shingles have a Jaccard similarity of 0.8 or more with those of a node in it; this
repeats until no node joins, however long the chain. So a message that came with status 200 gets its label from its copies that did not.

Near copies are found with partitioned SimHash tables: the key of a table is the 64-bit SimHash in as many of its bits, another choice for each
table, as the logarithm of the number of nodes asks for; pairs with a common key are kept up to a Hamming distance of ``HAMMING``. ``table_miss``
gives the share of pairs that the tables miss at a distance; it is not small at the similarity bound, so an exact complement finds the rest: of two
sets with that similarity the lowest fifth (and one) of the hashes of each share one, and their sizes are in the same or neighbouring classes. All
pairs are verified by the similarity of their texts, and none is lost. Content is never paired with content: keys are looked up from the labelled
nodes, and a bitmap of fixed size drops the keys that none of them has before anything is joined. Placeholder labels stay with their version: the
same page without them is content.

Defined results: null and empty texts are no residue, null statuses are no evidence; repeated rows give one row; texts are processed whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.urls import site_of
from weftline.session import cut

SHINGLE, SIMILAR = 5, 0.8
TABLES, HAMMING, LEAST_BITS = 64, 16, 16
#: a text that so many documents share and of whose fetches half failed is a message
FAILED_DOCUMENTS, FAILED_SHARE = 3, 0.5
#: share of a text's words that stand in sentences of such wording
MESSAGE_SHARE, FILLER_SHARE, WINDOW = 0.4, 0.3, 60
#: rows up to which a list of nodes is broadcast; beyond it the join is shuffled
SMALL = 100_000
# sizes of similar sets are at most one class apart; bits of the bitmap of keys
_CLASS, _BITS = math.log(1.008 / SIMILAR), 1 << 22
_FENCE = re.compile(r"(?ms)^[ \t]*(?:```|~~~).*?(?:^[ \t]*(?:```|~~~)[ \t]*$|\Z)")
_INLINE = re.compile(r"`+[^`\n]+`+")
_TARGET = re.compile(r"\]\([^)\s]*\)")
# each alternative begins with its first character, so that the search skips to one of them
PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]{0,60}\}\}|\{%[^%\n]{1,60}%\}|<%[^%\n]{1,60}%>|\$\{[^{}\n]{1,60}\}|#\{[^{}\n]{1,60}\}|\{[$@]?[A-Za-z_][\w. ]{1,40}\}|\{\d\}"
    r"|\[\[[^\[\]\n]{1,40}\]\]|\[[A-Z]+(?:[_ .][A-Z]+)*_HERE\]|\[[A-Z]+(?:_[A-Z]+)+\](?!\()|\[(?:Your|Insert|Enter|your|insert|enter) [^\]\n]{1,40}\](?!\()"
    r"|%%\w+%%|%(?<!\w%)[A-Z_]{2,}%|%\([a-z_]\w*\)[sd]|%(?<!\S%)(?:\d\$)?[sd](?!\w)|__(?<!\w__)[A-Z][A-Z_]+__(?!\w)|@@\w+@@|<(?:insert|enter|your|Insert|Enter|Your) [^>\n]{1,40}>"
    r"|~(?<![\w~]~)[a-z_.]{3,30}~(?!~)|\[object Object\]|u(?<![\w.]u)ndefined(?![\w(])|N(?<![\w.]N)aN(?!\w)"
)
# Wording of messages that stand in place of content, by kind and language, in lower case.
MESSAGES = (
    "page not found", "does not exist", "has moved", "couldn't find", "couldn’t find", "could not be found", "could not be reached", "could not be loaded", "no text was loaded", "may have been removed",
    "access denied", "forbidden", "will not open", "unavailable for now", "service unavailable", "too many requests", "rate limited", "something went wrong", "session has expired", "under maintenance",
    "no longer available", "you are human", "looks at your connection", "did not answer", "gateway time", "bad gateway", "internal server error", "uncaught exception", "please try again", "try again later",
    "sign in again", "making things better", "go back to the start", "check the address", "browser is not supported", "browser has it switched off", "works best with javascript", "until javascript", "activate scripting",
    "javascript switched", "javascript required", "javascript is switched", "javascript is turned", "javascript is disabled",
    *(f"{verb} {thing}" for verb in ("enable", "activate", "activating", "turn on", "allow", "require", "requires", "need", "needs", "without") for thing in ("scripts", "script ", "javascript", "java script")),
    "nicht gefunden", "gesuchte seite", "zugriff verweigert", "nicht erreichbar", "später erneut", "javascript, um", "javascript um",
    "introuvable", "n’existe pas", "n'existe pas", "accès refusé", "indisponible", "réessayer plus tard", "activer javascript",
    "no encontrada", "no existe", "acceso denegado", "no está disponible", "intentarlo más tarde", "active javascript", "habilite javascript",
    "não encontrada", "não existe", "acesso negado", "não está disponível", "tente mais tarde", "ative o javascript",
    "nie znaleziono", "nie istnieje", "brak dostępu", "niedostępn", "spróbuj później", "włącz javascript",
    "не найдена", "не существует", "доступ запрещ", "нет доступа", "недоступен", "попробуйте позже", "включите javascript",
    "見つかりません", "存在しない", "拒否されました", "利用できません", "お試しください", "javascriptを有効",
)
# Sentences that tell the reader to switch scripts on.
_ORDER = re.compile(
    r"^\W*(?:(?:please|you (?:need|have) to|if [^.]{1,60},?|to [^.]{1,40},) )?(?:enable|activate|turn on|allow) (?:java ?)?scripts?\b|your browser (?:is not supported|has it switched off|does not support)|update it or activate scripting"
    r"|stays? blank until javascript|takes longer than .{1,30} allow scripts?|bitte aktivieren sie javascript|veuillez activer javascript|^\W*(?:active|habilite|ative o) javascript|^\W*włącz javascript|^\W*включите javascript|javascriptを有効にしてください",
    re.I,
)
# Wording of stock filler, in lower case.
FILLERS = ("insert content here", "insert text here", "sample heading", "sample paragraph", "sample text", "words belong here", "write your own", "for your own", "your own text", "made by the site builder", "click to edit", "write copy for", "coming soon", "lorem ipsum")
_TO_BE_DONE = re.compile(r"^\W*tbd\W*$", re.M)
# Words of the usual filler text; two of the first three must stand in it.
_LOREM = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim laborum".split())
_UNIT = re.compile(r"[.!?:]+(?:\s+|$)|(?<=[。！？：])|\n+")
_NUMBER = re.compile(r"\W*(?:[^\W\d_]{3,8}\W+)?\d{1,3}\W*|\W*(?:id|request id|incidente?|reference|vorgang|ocorrência|zdarzenie|событие|番号)\W*[\w-]*\W*", re.I)
_TOKEN = re.compile(r"[぀-ヿ一-鿿々ー]|\d+|[^\W\d_]+")
_DENSE = re.compile(r"[぀-ヿ一-鿿]")
_IDENT = re.compile(r"\d|\w[_./:]\w|/\w|…")
_HASHES: dict[str, int] = {}
_MASKED: dict[str, tuple[str, ...]] = {}


def prose(text: str) -> str:
    """The text without code fences, code spans and link targets."""
    return _TARGET.sub("]", _INLINE.sub(" ", _FENCE.sub("\n", text)))


def masked(text: str, site: str | None, name: str | None) -> list[str]:
    """Lower-case tokens: what varies between copies of a message (identifiers, numbers, the site's name) is ``#``."""
    own = {w for w in re.split(r"[\W_]+", f"{site or ''} {name or ''}".lower()) if len(w) > 2} - {"www", "the", "hub", "com"}
    words: list[str] = []
    if len(_MASKED) > 500_000:
        _MASKED.clear()
    known = _MASKED.get
    for part in text.lower().split():
        got = known(part)
        if got is None:
            if part.isascii() and part.isalpha():
                got = (part,)
            elif _DENSE.search(part) or not _IDENT.search(part):
                got = tuple("#" if w.isdigit() else w for w in _TOKEN.findall(part))
            else:
                got = ("#",)
            _MASKED[part] = got
        words += got
    return words if own.isdisjoint(words) else ["#" if w in own else w for w in words]


def _dull(words: list[str]) -> float:
    """Share of different words in windows of ``WINDOW`` words, on average: of texts of any length alike."""
    parts = [words[a : a + WINDOW] for a in range(0, max(1, len(words) - WINDOW // 2), WINDOW)]
    return sum(len(set(x)) / len(x) for x in parts) / len(parts)


def _holds(text: str, phrases: tuple[str, ...]) -> bool:
    for phrase in phrases:
        if phrase in text:
            return True
    return False


def own_label(text: str, words: list[str]) -> tuple[str | None, bool, bool]:
    """(label that the text's wording gives, whether that is enough to trust it, whether no copy could tell better).

    ``text`` is prose, ``words`` are its masked words.
    """
    if PLACEHOLDER.search(text):
        return "placeholder", True, True
    real = [w for w in words if w != "#"]
    lorem = [w for w in real if w in _LOREM]
    if len(real) >= 6 and len({"lorem", "ipsum", "dolor", "velit"} & set(lorem)) >= 2 and len(lorem) >= 0.1 * len(real):
        return "filler", True, True
    if len(real) >= 12 and {"lorem", "ipsum", "dolor"} & set(lorem) and len(lorem) >= 0.04 * len(real) and _dull(real) <= (0.75 if len(real) < WINDOW else 0.6):
        return "filler", True, True
    low = text.lower()
    message, filler = _holds(low, MESSAGES), _holds(low, FILLERS) or ("tbd" in low and bool(_TO_BE_DONE.search(low)))
    if message or filler:
        every = notice = stock = sentences = 0
        order = False
        for unit in _UNIT.split(low):
            # a number, an identifier or the site's name says nothing either way
            n = len([w for w in _TOKEN.findall(unit) if not w.isdigit()])
            if not n or _NUMBER.fullmatch(unit):
                sentences += bool(n) or bool(unit.strip())
                continue
            every += n
            if _holds(unit, MESSAGES):
                notice, sentences, order = notice + n, sentences + 1, order or bool(_ORDER.search(unit))
            if _holds(unit, FILLERS) or _TO_BE_DONE.search(unit):
                stock += n
        if filler and stock >= FILLER_SHARE * every:
            return "filler", True, True
        if message and notice >= MESSAGE_SHARE * every:
            return "message", order or sentences >= 2, order
    latin = [w for w in words if w.isascii()]
    if len(latin) >= 4 and len(latin) == len(words):
        # one letter over and over, or words that repeat the word before
        if all(len(set(w)) == 1 for w in latin if w != "#") or (len(latin) >= 6 and sum(map(str.__eq__, latin, latin[1:])) >= 0.3 * (len(latin) - 1)):
            return "filler", True, True
    return None, False, False


def trusted(text: str, words: list[str]) -> str | None:
    """The label that a text's wording alone gives it, or null."""
    label, certain, _ = own_label(text, words)
    return label if certain else None


def shingles(words: list[str]) -> np.ndarray:
    """Distinct 64-bit hashes of the five-word shingles; fewer words are one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(_HASHES) > 500_000:
        _HASHES.clear()
    for w in set(words).difference(_HASHES):
        _HASHES[w] = xxhash.xxh3_64_intdigest(w)
    ids = np.array([_HASHES[w] for w in words], np.uint64)
    n = max(1, len(ids) - SHINGLE + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(SHINGLE, len(ids))):
            out = (out ^ ids[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return np.unique(out)


def simhash(hashes: np.ndarray) -> int:
    """64-bit SimHash of a set of hashes, as a signed number."""
    if not len(hashes):
        return 0
    ones = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(np.int64)[0])


def table_bits(nodes: int) -> int:
    """Bits in a table's key: about as many as the logarithm of the number of nodes, so that a bucket holds a bounded number of unrelated nodes."""
    return min(40, max(LEAST_BITS, math.ceil(math.log2(max(2, nodes)))))


def table_miss(distance: int, bits: int, tables: int = TABLES) -> float:
    """Share of pairs at a Hamming distance that have no key in common."""
    return (1 - math.comb(64 - distance, bits) / math.comb(64, bits)) ** tables


def table_masks(bits: int) -> np.ndarray:
    """For each table the bits of a SimHash that its key is made of: the first of a fixed permutation."""
    rng = np.random.default_rng(64)
    return np.array([sum(1 << int(b) for b in rng.permutation(64)[:bits]) for _ in range(TABLES)], np.uint64)


def table_keys(hashes: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """32-bit keys of SimHashes (signed), one column for each table."""
    with np.errstate(over="ignore"):
        x = (hashes.astype(np.int64).view(np.uint64)[:, None] & masks[None, :]) ^ (np.arange(1, len(masks) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.uint32)


def prefix(hashes: np.ndarray) -> np.ndarray:
    """Low halves of the lowest hashes: two sets of a Jaccard similarity of ``SIMILAR`` or more have one of these in common."""
    n = len(hashes)
    return hashes[: n - math.ceil(SIMILAR * n - 1e-9) + 1].astype(np.uint32).view(np.int32)


_FEATURES = "doc_id STRING, version INT, status INT, node BIGINT, size INT, simhash BIGINT, prefix ARRAY<INT>, label STRING, certain BOOLEAN, order BOOLEAN"


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for doc, version, status, site, name, text in batch[["doc_id", "version", "status", "site", "site_name", "markdown"]].itertuples(index=False):
            clean = prose(text)
            words = masked(clean, site, name)
            held = shingles(words)
            label, certain, order = own_label(clean, words)
            out.append((doc, version, None if pd.isna(status) else int(status), xxhash.xxh3_64_intdigest(" ".join(words)) - 2**63, len(held), simhash(held), prefix(held), label, certain, order))
        frame = pd.DataFrame(out, columns=["doc_id", "version", "status", "node", "size", "simhash", "prefix", "label", "certain", "order"])
        yield frame.astype({"status": "Int32"})


def _texts(versions: DataFrame) -> DataFrame:
    status = F.col("http_status").cast("int") if "http_status" in versions.columns else F.lit(None).cast("int")
    v = versions.select("doc_id", "version", status.alias("status"), site_of(F.col("final_url")).alias("site"), F.col("meta.siteName").alias("site_name"), "markdown")
    return v.where("markdown IS NOT NULL AND trim(markdown) <> ''")


def _keys(size: int, part: np.ndarray, apart: tuple[int, ...] = (0,)) -> np.ndarray:
    """Keys of a prefix in its size class, and in those that are ``apart`` from it."""
    own = int(math.log(max(1, size)) / _CLASS)
    with np.errstate(over="ignore"):
        return np.concatenate([(np.asarray(part, np.int32).view(np.uint32) + np.uint32((own + d) * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0x9E3779B1) for d in apart])


def _seeds(masks: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Keys of labelled nodes: ``kind`` 0 of the SimHash tables, 1 of the exact complement."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tables = table_keys(batch["simhash"].to_numpy(np.int64), masks).view(np.int32)
            for row, own in zip(batch[["node", "size", "simhash", "prefix", "label"]].itertuples(index=False), tables):
                exact = _keys(row.size, row.prefix, (-1, 0, 1)).view(np.int32)
                kinds = np.repeat(np.array([0, 1], np.int32), [len(own), len(exact)])
                yield pd.DataFrame({"seed": row.node, "seed_size": row.size, "seed_simhash": row.simhash, "label": row.label, "kind": kinds, "key": np.concatenate([own, exact])})

    return run


def _sought(bits: np.ndarray, masks: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Keys of nodes that may be among the seeds' keys, of which ``bits`` is the bitmap."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["size"].to_numpy(np.int64)
            counts = np.array([len(x) for x in batch["prefix"]], np.int64)
            own = (np.log(np.maximum(1, sizes)) / _CLASS).astype(np.int64)
            held = np.concatenate([np.zeros(0, np.int32), *[np.asarray(x, np.int32) for x in batch["prefix"]]]).view(np.uint32)
            with np.errstate(over="ignore"):
                shift = ((own * 0x85EBCA6B) & 0xFFFFFFFF).astype(np.uint32)
                exact = (held + np.repeat(shift, counts)) * np.uint32(0x9E3779B1)
            tables = table_keys(batch["simhash"].to_numpy(np.int64), masks)
            keys = np.concatenate([tables.reshape(-1), exact])
            rows = np.concatenate([np.repeat(np.arange(len(batch)), len(masks)), np.repeat(np.arange(len(batch)), counts)])
            at = keys & np.uint32(_BITS - 1)
            hit = np.flatnonzero((bits[at >> np.uint32(6)] >> (at & np.uint32(63)).astype(np.uint64)) & np.uint64(1) == 1)
            rows_hit = rows[hit]
            yield pd.DataFrame({"node": batch["node"].to_numpy()[rows_hit], "size": sizes[rows_hit].astype(np.int32), "simhash": batch["simhash"].to_numpy(np.int64)[rows_hit], "kind": (hit >= tables.size).astype(np.int32), "key": keys[hit].view(np.int32)})

    return run


def _bitmap(seeds: DataFrame) -> np.ndarray:
    at = F.col("key").bitwiseAND(F.lit(_BITS - 1))
    rows = seeds.select((at / 64).cast("int").alias("word"), F.expr(f"shiftleft(1L, (key & {_BITS - 1}) % 64)").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()
    out = np.zeros(_BITS // 64, np.int64)
    for r in rows:
        out[r["word"]] = r["bits"]
    return out.view(np.uint64)


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        held = [shingles(masked(prose(t), site, name)).view(np.int64) for t, site, name in zip(batch["markdown"], batch["site"], batch["site_name"])]
        yield pd.DataFrame({"node": batch["node"].to_numpy(), "held": pd.Series(held, dtype=object)})


def _bounded(df: DataFrame) -> DataFrame:
    """A broadcast hint where the rows are few, no hint where they are not."""
    return F.broadcast(df) if df.count() <= SMALL else df


def near_pairs(front: DataFrame, open_nodes: DataFrame, masks: np.ndarray) -> DataFrame:
    """(node, seed, label, by_table): candidates of labelled nodes ``front`` among ``open_nodes``, before their texts are compared."""
    seeds = cut(front.select("node", "size", "simhash", "prefix", "label").mapInPandas(_seeds(masks), "seed BIGINT, seed_size INT, seed_simhash BIGINT, label STRING, kind INT, key INT"))
    sought = open_nodes.select("node", "size", "simhash", "prefix").mapInPandas(_sought(_bitmap(seeds), masks), "node BIGINT, size INT, simhash BIGINT, kind INT, key INT")
    near = sought.join(seeds, ["kind", "key"]).where(F.least("size", "seed_size") >= SIMILAR * F.greatest("size", "seed_size") - 1e-6)
    near = near.where((F.col("kind") == 1) | (F.bit_count(F.col("simhash").bitwiseXOR(F.col("seed_simhash"))) <= HAMMING))
    return near.groupBy("node", "seed", "label").agg((F.min("kind") == 0).alias("by_table"))


def labelled(versions: DataFrame) -> DataFrame:
    """(doc_id, version, label, trusted) of every version that is residue; ``trusted`` is false where the label came over its component."""
    texts = _texts(versions)
    features = cut(texts.mapInPandas(_features, _FEATURES))
    holes = features.where("label = 'placeholder'").select("doc_id", "version", "label")
    rest = features.where("label IS NULL OR label <> 'placeholder'")
    failed = F.col("status") >= 400
    # a message that speaks for itself but came without an error is left to its component where that has a label of better evidence
    strong = F.col("order") | (F.col("label").isNotNull() & F.coalesce(failed, F.lit(False)))
    rest = rest.withColumns({"own": F.when(strong, F.col("label")), "weak": F.when(F.col("certain"), F.col("label"))})
    document = rest.groupBy("node", "doc_id").agg(F.first("size").alias("size"), F.first("simhash").alias("simhash"), F.first("prefix").alias("prefix"), F.max("own").alias("own"), F.max("weak").alias("weak"), F.max(F.coalesce(failed, F.lit(False))).alias("failed"), F.min(F.struct("doc_id", "version")).alias("at"))
    node = document.groupBy("node").agg(F.first("size").alias("size"), F.first("simhash").alias("simhash"), F.first("prefix").alias("prefix"), F.max("own").alias("own"), F.max("weak").alias("weak"), F.count("*").alias("documents"), F.count_if("failed").alias("failed"), F.min("at").alias("at"))
    common = (F.col("documents") >= FAILED_DOCUMENTS) & (F.col("failed") >= F.col("documents") * FAILED_SHARE)
    node = node.withColumn("strong", F.coalesce("own", F.when(common, F.lit("message"))))
    node = cut(node.withColumn("label", F.coalesce("strong", "weak")).drop("own", "weak"))
    masks = table_masks(table_bits(node.count()))
    front = node.where("label IS NOT NULL")
    open_nodes = node.where("label IS NULL").drop("label")
    done = front.select("node", "label")
    while True:
        near = cut(near_pairs(front, open_nodes, masks).join(done.select("node"), "node", "left_anti"))
        places = near.select("node").union(near.select(F.col("seed").alias("node"))).distinct().join(node.select("node", F.col("at.doc_id").alias("doc_id"), F.col("at.version").alias("version")), "node")
        places = cut(places)
        # the text of each of these nodes is read once
        sets = texts.join(_bounded(places), ["doc_id", "version"]).mapInPandas(_sets, "node BIGINT, held ARRAY<BIGINT>").dropDuplicates(["node"])
        pair = near.join(sets.withColumnRenamed("held", "a"), "node").join(sets.select(F.col("node").alias("seed"), F.col("held").alias("b")), "seed")
        both = F.size(F.array_intersect("a", "b"))
        new = cut(pair.where(both >= SIMILAR * (F.size("a") + F.size("b") - both)).groupBy("node").agg(F.max("label").alias("label")))
        if new.isEmpty():
            break
        done = cut(done.unionByName(new))
        front = cut(open_nodes.join(new, "node"))
    spread = rest.join(done.withColumnRenamed("label", "found").join(node.select("node", "strong"), "node"), "node")
    by_itself = F.col("own").isNotNull() | (F.col("weak").isNotNull() & F.col("strong").isNull())
    spread = spread.select("doc_id", "version", F.col("found").alias("label"), by_itself.alias("trusted"))
    every = holes.withColumn("trusted", F.lit(True)).unionByName(spread)
    return every.groupBy("doc_id", "version").agg(F.max_by("label", F.struct("trusted", "label")).alias("label"), F.max("trusted").alias("trusted"))


def found(versions: DataFrame) -> DataFrame:
    return labelled(versions).select("doc_id", "version")
