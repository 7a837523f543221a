"""Text decoded by a wrong character set: find garbled spans and restore them.

Characters are mapped back to the bytes of a legacy character set; a byte-structure automaton (the well-formed multibyte forms of UTF-8, EUC-JP
or Shift_JIS as a regular expression over those bytes) finds maximal well-formed spans; only those spans are decoded, the rest stays as it is.
This repeats until there is no span left, so text encoded any number of times is restored as well. What a span decodes to must be assigned characters of
one script that fits the letters around it, whatever the script; spans too short to be sure of count only where others have settled the set. Bytes
of one single-byte set read as another have no structure that the automaton could see; they show as marks inside words (a control character, a
capital after a small letter) and are restored word by word.

Code fences and code spans are left alone: a sequence shown there is an example. Replacement characters are garbled but not restorable.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: legacy set, and how many characters a span must have at least: letters of Cyrillic sets stand next to each other in right text, too
SETS = (("cp1252", 1), ("latin-1", 1), ("iso8859-15", 1), ("cp1250", 1), ("iso8859-2", 1), ("cp437", 1), ("cp850", 1), ("mac_roman", 1), ("cp1251", 3), ("cp866", 2), ("koi8-r", 3))
SINGLE = ("mac_roman", "cp437", "cp850", "cp1250", "iso8859-2", "cp1251", "koi8-r")
_UTF8 = re.compile("(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+")
_EUC = re.compile("(?:[\xa1-\xfe][\xa1-\xfe]|\x8e[\xa1-\xdf])+")
_SJIS = re.compile("(?:[\x81-\x9f\xe0-\xfc][\x40-\x7e\x80-\xfc])+")
#: letters and signs of which one alone may be a span; of other scripts it takes two letters
_PLAUSIBLE = re.compile("[\x80-\u017f\u01a0\u01a1\u01af\u01b0\u0218-\u021b\u02c6\u02dc\u0386-\u03ce\u0400-\u045f\u0490\u0491\u1e00-\u1eff\u2000-\u206f\u20a0-\u20bf\u2100-\u27bf\u3000-\u30ff\u4e00-\u9fff\uac00-\ud7a3\uff00-\uffef\U0001f000-\U0001faff\ufe0f]+")
_EAST = frozenset(("CJK", "HIRAGANA", "KATAKANA", "HANGUL", "KATAKANA-HIRAGANA", "BOPOMOFO"))
_SIGNS = frozenset("×÷½¼¾°™®©·†‡•§¶±µ")
_KANA = re.compile("[\u3041-\u3096\u30a1-\u30fa]")
#: three characters of either Japanese set, as cp1252 shows them
_EAST_GATE = re.compile("[\u00a1-\u00fe]{6}|[\u201a\u0192].[\u201a\u0192].[\u201a\u0192]")
_JAPANESE = re.compile("[\u3000-\u30ff\u4e00-\u9fff\uff00-\uffef]")
_CODE = re.compile(r"(?ms)(^(?:```|~~~).*?(?:^(?:```|~~~)[ \t]*$|\Z)|`+[^`\n]+`+)")
_MARK = re.compile("(?<=[a-zà-öø-ÿ])[ŽŠŸÀ-ÖØ-Þ](?![A-ZÀ-ÖØ-Þ])|(?<=[a-z])[¿¼-¾](?=[a-z¹³¿])|(?<=[a-z])[\u0192\u2018\u201a\u201c-\u201e\u2020-\u2022\u2030\u2039\u203a\u02c6\u02dc\u2122¡-¬®-´¶¸-¿×÷](?=[a-z])")
_CONTROL = re.compile("(?<=[a-z])¿[a-z¹³]|[\x80-\x84\x86-\x9f]|(?<=\\w)\x85(?=\\w)")
_RUNS = re.compile("[À-ÖØ-öø-ÿ]{5,}|[а-яё][А-ЯЁ]{3,}")
_WORD = re.compile(r"[^\s\"“”()\[\]*_|#>/]+")


def _to_bytes(charset: str) -> dict[int, str]:
    """Character to byte (as a character below 256); the control characters stand for bytes that the set leaves open."""
    table = {i: chr(i) for i in range(256)} if charset in ("cp1252", "cp1250", "cp1251") else {}
    table = {i: c for i, c in table.items() if 0x80 <= i < 0xA0}
    for b in range(128, 256):
        try:
            table[ord(bytes([b]).decode(charset))] = chr(b)
        except UnicodeDecodeError:
            pass
    return table


class _Bytes(dict):
    def __missing__(self, key: int) -> str:
        return "\uffff"


_TABLES = {name: _Bytes({i: chr(i) for i in range(128)} | _to_bytes(name)) for name, _ in SETS}
_LEADS = {name: re.compile("[" + "".join(re.escape(chr(k)) for k, v in table.items() if "\xc2" <= v <= "\xf4") + "]") for name, table in _TABLES.items()}
_DASHES = {"\u2013", "\u2014"}


def _forms() -> list[tuple[frozenset, frozenset, re.Pattern]]:
    """For each legacy set the characters that begin and continue a multibyte form, and the least form that a garbled span holds."""
    out = []
    for name, least in SETS:
        table = _TABLES[name].items()

        def those(low: str, high: str, table=table) -> str:
            return "".join(sorted(chr(k) for k, v in table if k >= 128 and low <= v <= high))

        common = those("\xc2", "\xc6") + those("\xce", "\xd1")
        if name == "mac_roman":
            common = re.sub("[\u2013\u2014]", "", common)
        rest, two, three = those("\x80", "\xbf"), those("\xc2", "\xdf"), those("\xe0", "\xf4")
        form = f"[{common}][{rest}]|[{three}][{rest}]{{2}}|(?:[{two}][{rest}]){{2}}" if least == 1 else f"(?:[{two}{three}][{rest}]+){{2}}[{two}{three}][{rest}]"
        out.append((frozenset(two + three), frozenset(rest), re.compile(form)))
    return out


_FORMS = _forms()
_HIGH = re.compile(r"[^\x00-\x7f]{2,}")
_CONTROLS = frozenset(map(chr, range(0x80, 0xA0))) | {"\xbf"}
_MARKS = frozenset("ŽŠŸ\u0192\u2018\u201a\u201c\u201d\u201e\u2020\u2021\u2022\u2030\u2039\u203a\u02c6\u02dc\u2122") | frozenset(map(chr, range(0xA1, 0xE0)))


def suspicious(text: str) -> bool:
    """Whether a text may hold a garbled span; false for most right texts, which are not looked at further.

    All multibyte forms but Shift_JIS stand in runs of characters beyond ASCII, so those runs are searched instead of the text.
    """
    chars = set(text)
    if "\ufffd" in chars or (not chars.isdisjoint(_CONTROLS) and _CONTROL.search(text)) or (not chars.isdisjoint(_MARKS) and _MARK.search(text)):
        return True
    if not chars.isdisjoint("\u201a\u0192") and _EAST_GATE.search(text):
        return True
    runs = " ".join(_HIGH.findall(text))
    if not runs:
        return False
    if _RUNS.search(runs) or _EAST_GATE.search(runs):
        return True
    chars = set(runs)
    return any(not chars.isdisjoint(begin) and not chars.isdisjoint(rest) and form.search(runs) for begin, rest, form in _FORMS)


@cache
def _script(char: str) -> str | None:
    """The script of a letter or mark, empty for other characters, null for those that text does not hold."""
    kind = unicodedata.category(char)
    if kind in ("Cn", "Co", "Cs"):
        return None
    if kind[0] not in "LM":
        return ""
    name = unicodedata.name(char, "").split(" ")[0]
    return "EAST" if name in _EAST else "" if name in ("COMBINING", "VARIATION", "FULLWIDTH", "HALFWIDTH") else "LATIN" if name in ("MICRO", "FEMININE", "MASCULINE", "MODIFIER") else name


def _fits(text: str, a: int, b: int, new: str) -> tuple[bool, int]:
    """Whether the decoded span can stand at its place, and its letters: assigned characters of one script, which a single letter shares with the
    word that it stands in."""
    scripts, letters = set(), 0
    for c in new:
        script = _script(c)
        if script is None:
            return False, 0
        if script:
            scripts.add(script)
            letters += 1
    if len(scripts) > 1:
        return False, 0
    if letters == 1 and scripts != {"LATIN"}:
        beside = (text[a - 1] if a else "") + (text[b] if b < len(text) else "")
        if any(_script(x) not in ("", *scripts) for x in beside):
            return False, 0
    return True, letters


def _utf8_spans(text: str) -> tuple[str, list[tuple[int, int, str]]]:
    """The legacy set whose bytes explain most of the text, and its (start, end, decoded) spans."""
    best: tuple[int, str, list[tuple[int, int, str]]] = (0, "", [])
    for name, least in SETS:
        if not _LEADS[name].search(text):
            continue
        every, sure = [], []
        for m in _UTF8.finditer(text.translate(_TABLES[name])):
            new = m.group().encode("latin-1").decode("utf-8")
            fits, letters = _fits(text, m.start(), m.end(), new)
            if not fits:
                continue
            usual = _PLAUSIBLE.fullmatch(new) is not None
            if usual or letters:
                every.append((m.start(), m.end(), new))
            if (usual or letters >= 2) and len(new) >= (3 if name == "mac_roman" and text[m.start()] in _DASHES else least):
                sure.append(every[-1])
        # where longer spans leave no doubt about the set, its short ones count as well
        spans = every if sum(len(x[2]) for x in sure) >= 6 else sure
        covered = sum(b - a for a, b, _ in spans)
        if covered > best[0]:
            best = (covered, name, spans)
    return best[1], best[2]


def _japanese_spans(text: str) -> tuple[str, list[tuple[int, int, str]]]:
    """The same for Japanese sets: spans with kana are sure, and settle the set for those that are short or hold none."""
    best: tuple[int, str, list[tuple[int, int, str]]] = (0, "", [])
    if not _EAST_GATE.search(text):
        return best[1], best[2]
    as_bytes = text.translate(_TABLES["cp1252"])
    for name, form in (("euc_jp", _EUC), ("cp932", _SJIS)):
        every, sure = [], []
        for m in form.finditer(as_bytes):
            try:
                new = m.group().encode("latin-1").decode(name)
            except UnicodeDecodeError:
                continue
            japanese = len(_JAPANESE.findall(new))
            if japanese == len(new):
                every.append((m.start(), m.end(), new))
            if len(new) >= 3 and len(_KANA.findall(new)) >= 2 and japanese >= 0.7 * len(new):
                sure.append((m.start(), m.end(), new))
        spans = sorted({*sure, *every}) if sum(len(x[2]) for x in sure) >= 12 else sure
        covered = sum(b - a for a, b, _ in spans)
        if covered > best[0]:
            best = (covered, name, spans)
    return best[1], best[2]


def _replace(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, new in spans:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]])


def _single_byte(text: str) -> tuple[str, int, int]:
    """Words with marks of a wrong single-byte set: new text, words found, words not restored."""
    if not (_MARK.search(text) or _CONTROL.search(text) or _RUNS.search(text)):
        return text, 0, 0
    marked = [m for m in _WORD.finditer(text) if _MARK.search(m.group()) or _CONTROL.search(m.group()) or _RUNS.search(m.group())]
    if not marked:
        return text, 0, 0
    # one word alone must be restored to letters, and not hold a sign that stands between letters in right text
    alone = len(marked) == 1 and not _CONTROL.search(marked[0].group())
    if alone and not _SIGNS.isdisjoint(marked[0].group()):
        return text, 0, 0
    best: tuple[int, list[tuple[int, int, str]]] = (-1, [])
    for source, name in ((s, n) for s in ("cp1252", "cp1251") for n in SINGLE if n != s):
        spans = []
        for m in marked:
            raw = m.group().translate(_TABLES[source])
            if "\uffff" in raw:
                continue
            new = raw.encode("latin-1").decode(name, "replace")
            mixed = re.search("[a-z]", new) and re.search("[\u0400-\u04ff]", new)
            if new != m.group() and "\ufffd" not in new and not mixed and not any(x.search(new) for x in (_CONTROL, _MARK, _RUNS)) and re.fullmatch(r"[\w’'‘“”„–—….,;:!?\-]+", new):
                spans.append((m.start(), m.end(), new))
        if len(spans) > best[0]:
            best = (len(spans), spans)
    if alone and not (best[1] and best[1][0][2].strip(".,;:!?").isalpha()):
        return text, 0, 0
    return _replace(text, best[1]), len(marked), len(marked) - len(best[1])


def repair(text: str | None) -> tuple[str | None, int, int, str]:
    """(restored text, garbled spans, spans not restored, legacy sets in the order undone). Null and empty text have none."""
    if not text or text.isascii() or not suspicious(text):
        return text, 0, 0, ""
    found = lost = 0
    kinds: list[str] = []
    parts = _CODE.split(text)
    for i in range(0, len(parts), 2):
        part = parts[i]
        while True:  # each round makes the text shorter
            name, spans = max(_utf8_spans(part), _japanese_spans(part), key=lambda x: sum(b - a for a, b, _ in x[1]))
            if not spans:
                break
            found += len(spans)
            kinds.append(name)
            part = _replace(part, spans)
        part, more, less = _single_byte(part)
        if more:
            kinds.append("single-byte")
        gone = part.count("\ufffd")
        if gone:
            kinds.append("replaced")
        found, lost = found + more + gone, lost + less + gone
        parts[i] = part
    return "".join(parts), found, lost, ",".join(dict.fromkeys(kinds))


def _batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        done = [repair(t) for t in batch["markdown"]]
        batch["restored"], batch["garbled"], batch["unrestored"], batch["charsets"] = ([x[i] for x in done] for i in range(4))
        yield batch.loc[batch["garbled"] > 0, ["doc_id", "version", "restored", "garbled", "unrestored", "charsets"]]


def restored(versions: DataFrame) -> DataFrame:
    """(doc_id, version, restored, garbled, unrestored, charsets) of every version with a garbled span; repeated rows give one row.

    Null and empty texts have no span. Texts of ASCII alone never leave the JVM.
    """
    some = versions.select("doc_id", "version", "markdown").where(F.col("markdown").rlike(r"[^\x00-\x7f]"))
    done = some.mapInPandas(_batches, "doc_id STRING, version INT, restored STRING, garbled INT, unrestored INT, charsets STRING")
    return done.dropDuplicates(["doc_id", "version"])


def found(versions: DataFrame) -> DataFrame:
    return restored(versions).select("doc_id", "version")
