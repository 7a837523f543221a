import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import boilerplate, langid, leakage, mojibake, residue, sitelines, splitter

SAMPLES = ["Größe über straße für Käse", "L’été déjà à l’école", "Não é raro que as lições", "Вчера мы говорили о погоде", "これは日本語の文章です。カタカナも", "It’s “about” naïve"]


@pytest.mark.parametrize("text", SAMPLES)
@pytest.mark.parametrize("charset", ["cp1252", "latin-1", "cp437", "mac_roman", "cp1251"])
def test_utf8_read_as_legacy_is_restored(text, charset):
    raw = text.encode("utf-8")
    if charset == "cp1252":
        wrong = "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in raw)
    else:
        wrong = raw.decode(charset, "strict") if charset != "cp1251" else None
    if wrong is None or wrong == text:
        return
    fixed, found, lost, _ = mojibake.repair(wrong)
    assert found and fixed == text and not lost


@pytest.mark.parametrize("charset", ["euc_jp", "cp932"])
def test_japanese_read_as_western_is_restored(charset):
    text = "このページではなぜカタカナがよく使われるのかを説明します"
    wrong = "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in text.encode(charset))
    assert mojibake.repair(wrong)[0] == text


SCRIPTS = ["안녕하세요 저는 한국에서 온 사람입니다. 그 책은 좋다", "مرحبا بكم في هذا الموقع و شكرا", "שלום לכולם זה אתר טוב", "नमस्ते दुनिया यह एक पाठ है", "Tiếng Việt là ngôn ngữ được nói ở Việt Nam", "สวัสดีชาวโลก", "Привет, Ελλάδα"]


@pytest.mark.parametrize("text", [*SAMPLES, *SCRIPTS])
def test_text_of_any_script_encoded_many_times_is_restored(text):
    wrong = text
    for times in range(1, 6):
        wrong = wrong.encode("utf-8").decode("latin-1")
        fixed, found, lost, _ = mojibake.repair(wrong)
        assert found and fixed == text and not lost, times


@pytest.mark.parametrize("text", ["Il est fatigué\xa0» dit-elle, « café\xa0»", "Das macht Spaß“, sagte er. „Groß…“ und „Maß“", "CAFÉ» à\xa0» ici", "one a×b and no more", *SCRIPTS])
def test_right_text_with_such_sequences_is_left_alone(text):
    assert mojibake.repair(text)[:2] == (text, 0)


def test_one_garbled_word_is_found():
    assert mojibake.repair("A word like f\u0178r alone.")[0] == "A word like für alone."


@pytest.mark.parametrize("text", [*SAMPLES, "", None, "A sign like `Ã©` or `â€™` is an example.", "```\nÃ©\n```", "Dziś żółw je źdźbło", "NÃO SEI, IRMÃO"])
def test_right_text_is_left_alone(text):
    assert mojibake.repair(text)[:2] == (text, 0)


def test_replacement_characters_are_found_but_not_restored():
    assert mojibake.repair("caf� de la gare")[1:3] == (1, 1)


@given(st.text(alphabet="ab .\n#-|`é̀‍漢\t1", max_size=400), st.integers(1, 60), st.integers(0, 70))
@settings(max_examples=300)
def test_pieces_fit_and_make_up_the_text(text, limit, overlap):
    got = list(splitter.pieces_of(text, limit, overlap))
    keep = min(overlap, limit - 1)
    assert all(len(p) <= limit for p, _, _ in got)
    assert "".join(p[min(keep, a) :] for p, a, _ in got) == text
    for (p, _, n), (q, a, _) in zip(got, got[1:]):
        assert n == a
        assert q[: min(keep, a)] == text[a - min(keep, a) : a]
    assert got[-1][2] is None


def test_cuts_fall_on_the_highest_boundary():
    text = "# A\n\nOne. Two.\n\n# B\n\nThree. Four.\n"
    assert [p for p, _, _ in splitter.pieces_of(text, 22, 0)] == ["# A\n\nOne. Two.\n\n", "# B\n\nThree. Four.\n"]
    assert list(splitter.pieces_of(text, None, None)) == [(text, 0, None)]
    assert list(splitter.pieces_of("", 5, 0)) == [("", 0, None)]


def test_large_sections_are_not_mixed_with_their_neighbours():
    section = lambda name, n: f"## {name}\n\n" + "\n\n".join(f"{name} block {i} with a few words." for i in range(n)) + "\n\n"
    text = section("A", 2) + section("B", 8) + section("C", 1) + section("D", 1)
    got = [p for p, _, _ in splitter.pieces_of(text, 100, 0)]
    assert got[0] == section("A", 2) and got[-1] == section("C", 1) + section("D", 1)
    assert got[1].startswith("## B\n\nB block 0") and all(p.startswith("B block") for p in got[2:-1])


def test_nested_lists_are_cut_between_items():
    items = [f"- item {i} of the list\n" + "".join(f"  - part {j} of item {i}\n" for j in range(5)) for i in range(3)]
    got = [p for p, _, _ in splitter.pieces_of("".join(items), 130, 0)]
    assert got == items
    parts = [p for p, _, _ in splitter.pieces_of(items[0], 60, 0)]
    assert all(p.lstrip().startswith("- ") for p in parts) and "".join(parts) == items[0] and len(parts) == 3


def test_pieces_with_much_overlap_are_streamed():
    text = "word " * 100_000
    got = splitter.pieces_of(text, 1_000, 999)
    assert len(next(got)[0]) == 1_000 and len(next(got)[0]) <= 1_000
    import pandas as pd

    batch = pd.DataFrame([(1, "d", 1, "word " * 4_000, 1_000, 999)], columns=["request_id", "doc_id", "version", "markdown", "max_chars", "overlap_chars"])
    frames = list(splitter._batches(iter([batch])))
    assert len(frames) > 2 and sum(map(len, frames)) == len(list(splitter.pieces_of("word " * 4_000, 1_000, 999)))


def test_forms_level_names_dates_and_case():
    same = ["Posted on 3 September 2023 by Brimorus Vetelel", "_Posted  on 29 August 2024 by Anna Smith…_"]
    assert sitelines.forms(same[0]) == sitelines.forms(same[1]) == ["posted on by"]
    assert sitelines.forms(same[0])[0] in sitelines.forms(same[1].upper())
    assert sitelines.forms("```python") == sitelines.forms("12 | 34") == sitelines.forms("") == []


def test_hashes_of_forms_are_equal_where_forms_are():
    lines = ["Posted on 3 September 2023 by Brimorus Vetelel", "POSTED ON 29 AUGUST 2024 BY ANNA SMITH", "A B C D", "ONE TWO THREE", "TWO THREE ONE TWO THREE", "one three", "x", "", "12"]
    for a in lines:
        assert len(sitelines.form_hashes(a)) == len(sitelines.forms(a))
        for b in lines:
            assert bool(set(sitelines.forms(a)) & set(sitelines.forms(b))) == bool(set(sitelines.form_hashes(a)) & set(sitelines.form_hashes(b)))
    long = " ".join(f"WORD{chr(65 + i % 26)}{'ABCDEFGH'[i % 8]}" for i in range(200_000))
    assert len(sitelines.form_hashes(long)) <= 200_000


def test_blocks_and_blank_lines_inside_them_go(spark):
    texts = [f"Own sentence {''.join(random.Random(i).choices('abcdefghij', k=9))}\n\nShare this page\n\n\nAll rights reserved\n\n12 | 34\n\nSend it on" for i in range(8)]
    df = spark.createDataFrame([(f"d{i}", 1, "https://s.example/x", t) for i, t in enumerate(texts)], "doc_id STRING, version INT, final_url STRING, markdown STRING")
    rows = sitelines.occurrences(df).where("doc_id = 'd0'").orderBy("line_no").collect()
    assert [r["line_no"] for r in rows] == [3, 6, 10]
    assert rows[0]["block"] == rows[1]["block"] != rows[2]["block"]  # the line of figures stands between
    got = {r["doc_id"]: (r["removed"], r["markdown"]) for r in sitelines.cleaned(df).collect()}
    assert got["d0"] == (3, texts[0].split("\n")[0] + "\n\n\n12 | 34\n")


def test_site_lines_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        site = "big.example" if i % 3 else "small.example"
        lines = [f"Own sentence number {rng.random()} of {''.join(rng.choices('abcdefghij', k=12))}"]
        lines += ["All rights reserved 2024."] * (rng.random() < 0.4) + ["Share this page"] * (rng.random() < 0.2)
        rows.append((f"d{i}", 1, f"https://WWW.{site}:443/x", "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id STRING, version INT, final_url STRING, markdown STRING")
    got = {tuple(r) for r in sitelines.found(df).collect()}
    want = set()
    for site in ("big.example", "small.example"):
        mine = [r for r in rows if site in r[2]]
        for text in ("All rights reserved 2024.", "Share this page"):
            held = [r for r in mine if text in r[3].split("\n")]
            if len(held) >= 5 and len(held) * 4 >= len(mine):
                want |= {(r[0], 1, r[3].split("\n").index(text) + 1) for r in held}
    assert got == want


@pytest.mark.parametrize(("text", "label"), [("Older {{ name }} tell you", "placeholder"), ("We {$region} go", "placeholder"), ("fewer NaN breaks", "placeholder"), ("# Page not found\n\nIt does not exist or has moved.", "message"), ("Bitte aktivieren Sie JavaScript, um diese Seite zu sehen.", "message"), ("asdf asdf asdf jkl jkl test test test 51", "filler"), ("Plain words about 100 % of {curly} things?", "placeholder"), ("Templates fill a hole such as `{{ name }}`.", None), ("Just a normal sentence about ponds and rivers.", None)])
def test_trusted_labels(text, label):
    clean = residue.prose(text)
    assert residue.trusted(clean, residue.masked(clean, None, None)) == label


def test_labels_spread_over_near_duplicates_only(spark):
    rng = random.Random(6)
    words = "this gadget page is resting while our small crew repairs the broken pump so come again on some other quiet day".split()
    changed = words[:-1] + ["morning"]
    content = [" ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(30)) for i in range(20)]
    rows = [(f"s{i}", 1, f"https://site{i}.example/x", 503 if i else 200, ("n",), " ".join(words)) for i in range(3)]
    rows += [("near", 1, "https://site9.example/x", 200, ("n",), " ".join(changed))] + [(f"c{i}", 1, "https://site9.example/y", 404, ("n",), t) for i, t in enumerate(content)]
    df = spark.createDataFrame(rows, "doc_id STRING, version INT, final_url STRING, http_status INT, meta STRUCT<siteName: STRING>, markdown STRING")
    assert {r["doc_id"]: r["label"] for r in residue.labelled(df).collect()} == {"s0": "message", "s1": "message", "s2": "message", "near": "message"}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=3))

    def edited(words, n):
        out = list(words)
        for k in rng.sample(range(len(out)), n):
            out[k] = word()
        return out

    rows, texts = [], {}
    for g in range(12):
        base = [word() for _ in range(rng.randint(60, 95))]
        rows += [(f"t{g}.{i}", f"https://site{i}.example/x", " ".join(base), 500) for i in range(3)]
        texts[f"t{g}.0"] = base
        for v in range(12):
            texts[f"n{g}.{v}"] = edited(base, v % 3) if v < 8 else edited(base[: len(base) - rng.randint(4, 20)], v % 2)
    texts["c0"] = edited(texts["t0.0"], 1)
    for i in range(1, 31):  # a chain, each link only near the one before
        at = 7 * i % len(texts["c0"])
        texts[f"c{i}"] = [*texts[f"c{i - 1}"][:at], word(), *texts[f"c{i - 1}"][at + 1 :]]
    rows += [(k, "https://site9.example/x", " ".join(t), 200) for k, t in texts.items() if not k.startswith("t")]
    sets = {k: set(residue.shingles(t).tolist()) for k, t in texts.items()}
    want = new = {k for k in texts if k.startswith("t")}
    while new:
        new = {k for k in sets.keys() - want if any(len(sets[k] & sets[x]) >= 0.8 * len(sets[k] | sets[x]) for x in new)}
        want = want | new
    assert "c30" in want and len(want) < len(texts)
    df = spark.createDataFrame([(k, 1, u, c, ("n",), t) for k, u, t, c in rows], "doc_id STRING, version INT, final_url STRING, http_status INT, meta STRUCT<siteName: STRING>, markdown STRING")
    got = {r["doc_id"] for r in residue.labelled(df).collect()}
    assert {k for k in got if k in texts} == want


@pytest.mark.parametrize("text", ["The page works best with JavaScript, said the author.", "Access to the site was forbidden in 1990 by the council.", "Older guides tell you to debug stack traces by hand; that advice still works. Readers asked how.", "Let a set {x} hold all of them."])
def test_prose_about_messages_is_content(text):
    clean = residue.prose(text)
    assert residue.trusted(clean, residue.masked(clean, None, None)) is None


def test_long_messages_and_fillers_have_labels():
    long = "# Page not found\n\n" + "Sorry, the page you asked for does not exist or has moved. Check the address or go back to the start page. " * 12
    filler = " ".join(random.Random(3).choices("lorem ipsum dolor astria venta nonde quemo sarcum fugam omnire".split(), k=900))
    assert len(long) > 1200
    for text, label in ((long, "message"), (long[:496], "message"), (filler, "filler"), (filler[:300], "filler")):
        assert residue.trusted(text, residue.masked(text, None, None)) == label


def test_simhash_tables_find_what_is_computed():
    rng = np.random.default_rng(7)
    bits = residue.table_bits(50_000)
    masks = residue.table_masks(bits)
    assert bits == 16 and all(bin(int(m)).count("1") == bits for m in masks)
    for distance in (0, 2, 6, 10):
        a = rng.integers(0, 2**64, 4000, np.uint64)
        flips = np.array([sum(1 << int(b) for b in rng.permutation(64)[:distance]) for _ in a], np.uint64)
        found = (residue.table_keys(a.view(np.int64), masks) == residue.table_keys((a ^ flips).view(np.int64), masks)).any(axis=1).mean()
        assert abs(found - (1 - residue.table_miss(distance, bits))) < 0.03
    same = residue.shingles([f"w{i}" for i in range(200)])
    assert residue.simhash(same) == residue.simhash(same.copy()) and residue.simhash(same[:0]) == 0


def test_leaks_against_brute_force():
    rng = random.Random(2)
    vocabulary = [f"word{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(30, 60)))) for i in range(40)]
    index = leakage.Index(items)
    for n in range(120):
        i, words = rng.choice(items)[0], rng.choices([f"other{j}" for j in range(900)] + vocabulary, k=rng.randint(50, 300))
        item = dict(items)[i].split()
        share = rng.choice([0.2, 0.35, 0.6, 0.8, 1.0])
        part = item[: round(len(item) * share)]
        for k in range(9, len(part) - 3, 10):
            part[k] = "changed"
        at = rng.randint(0, len(words))
        text = " ".join(words[:at] + [w.upper() if n % 2 else f"**{w}**" for w in part] + words[at:])
        found = {x[0] for x in leakage.leaks(index, text)}
        assert (i in found) == (share > 0.5), (n, share)
    assert leakage.leaks(index, None) == leakage.leaks(leakage.Index([]), "a") == []


def test_leaks_with_uneven_errors_against_brute_force():
    rng = random.Random(8)
    item = [f"word{i}" for i in range(40)]

    def errors(part, words):  # fewest errors between the part and any stretch of the words
        row = [0] * (len(words) + 1)
        for x in part:
            new = [row[0] + 1]
            for j, y in enumerate(words):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return min(row)

    def case(words):
        return any(errors(item[a:b], words) <= -(-(b - a) // 8) for a in range(40) for b in range(a + 20, 41))

    uneven = list(item)
    for k in (6, 13, 22, 25, 28, 31, 34):
        uneven[k] = "changed"
    texts = [uneven]
    for n in range(60):
        words = list(item)
        for k in rng.sample(range(20), rng.randint(1, 4)) + rng.sample(range(20, 40), rng.randint(2, 9)):
            words[k] = rng.choice(["changed", "changed words", ""])
        texts.append(" ".join(words).split())
    index = leakage.Index([(1, " ".join(item)), (2, "some other item of a few words")])
    wanted = [case(t) for t in texts]
    assert wanted[0] and 5 < sum(wanted) < 55
    around = [f"other{j}" for j in range(30)]
    assert [bool(leakage.leaks(index, " ".join(around + t + around))) for t in texts] == wanted


def test_half_an_item_with_changed_words_is_found_wherever_they_are():
    rng = random.Random(21)
    items = [(i, " ".join(f"word{rng.randint(0, 3000)}" for _ in range(60))) for i in range(300)]
    index = leakage.Index(items)
    for n in range(400):
        i, text = items[rng.randrange(300)]
        part = text.split()[n % 31 : n % 31 + 30]
        for k in rng.sample(range(30), 3) if n % 4 else (0, 1, 29):
            part[k] = "changed"
        around = [f"other{rng.randint(0, 900)}" for _ in range(rng.randint(0, 500))]
        at = rng.randint(0, len(around))
        assert i in {x[0] for x in leakage.leaks(index, " ".join([*around[:at], *part, *around[at:]]))}, n


def test_wand_retrieves_what_all_scores_would():
    rng = random.Random(4)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    index = leakage.Index([(i, " ".join(rng.choices(vocabulary, k=rng.randint(8, 40)))) for i in range(700)])
    for n in range(60):
        i = rng.randrange(700)
        own = index.sequence[i][: rng.randint(4, 40)]
        terms = np.unique(np.concatenate([own, index.terms_of(rng.choices(vocabulary, k=40))]))
        score = np.zeros(700)
        for t in terms[terms < len(index.vocabulary)]:
            at = slice(index.start[t], index.start[t + 1])
            score[index.items[at]] += index.weights[at]
        assert index.retrieve(terms).tolist() == np.flatnonzero(score >= index.threshold).tolist()


def test_items_beyond_one_index_give_the_same_rows(spark):
    rng = random.Random(9)
    items = [(i, " ".join(f"w{rng.randint(0, 400)}" for _ in range(20))) for i in range(40)]
    texts = [(i, " ".join([*t.split()[: 12 + i % 8], "and", "more"])) for i, t in items]
    d, b = spark.createDataFrame(texts, "doc_id BIGINT, text STRING"), spark.createDataFrame(items, "item_id BIGINT, text STRING")
    one, many = (sorted(map(tuple, leakage.contaminated(d, b, chars).collect())) for chars in (leakage.CHARS, 900))
    assert one == many and len(one) >= 40


PAGE = "<html><body><div class=n><a href=a>Home</a><a href=b>Shop</a><a href=c>Blog</a></div><div><h1>Ponds</h1>" + "".join(f"<p>Sentence {i} tells how water, reeds and quiet frogs share one old pond.</p>" for i in range(6)) + "<div>More<ul><li><a href=d>Other page</a><li><a href=e>Third page</a></ul></div></div><div class=f>(c) 2024 Someone</div></body></html>"


def test_main_body_leaves_out_menus_teasers_and_footers():
    texts = boilerplate.main_texts(PAGE)
    assert texts[0] == "Ponds" and len(texts) == 7
    assert boilerplate.main_texts("") == [] and boilerplate.main_texts("<body>only text</body>") == ["only text"]


@pytest.mark.parametrize(("charset", "lang", "text"), [("koi8-r", "ru", "Вчера мы говорили о погоде и реках"), ("iso-8859-2", "pl", "Łódź ąśź żółw gęślą jaźń"), ("windows-1251", "ru", "Вчера мы говорили о погоде"), ("euc-jp", "ja", "日本語のページです"), ("shift_jis", "ja", "日本語のページです"), ("iso-2022-jp", "ja", "日本語のページです"), ("utf-16", "en", "Some text")])
def test_declared_charsets_come_before_those_of_the_language(charset, lang, text):
    page = f'<html lang="{lang}"><head><meta charset="{charset}"></head><body><p>{text}</p></body></html>'
    body = page.encode(charset)
    assert boilerplate.main_texts(boilerplate.decoded(body, None)) == [text]
    assert boilerplate.main_texts(boilerplate.decoded(body, f"text/html; charset={charset}")) == [text]


def test_a_false_charset_is_not_believed():
    body = '<html lang="ru"><body><p>Вчера мы говорили о погоде и реках</p></body></html>'.encode("cp1251")
    assert boilerplate.main_texts(boilerplate.decoded(body, "text/html; charset=iso-8859-1")) == ["Вчера мы говорили о погоде и реках"]
    assert boilerplate.main_texts(boilerplate.decoded(body, "text/html; charset=utf-8")) == ["Вчера мы говорили о погоде и реках"]


def test_deep_pages_and_large_tables():
    deep = "<body>" + "<div>" * 10_000 + "one deep text" + "</div>" * 10_000
    assert boilerplate.main_texts(deep) == ["one deep text"]
    rows = "".join(f"<tr><td>cell {i}</td><td>value {i}</td></tr>" for i in range(500))
    page = "<body><div><a href=a>Home</a></div><div><h1>Ponds</h1><p>Water, reeds and quiet frogs share one old pond here.</p><table>" + rows + "</table></div></body>"
    assert boilerplate.main_texts(page)[:2] == ["Ponds", "Water, reeds and quiet frogs share one old pond here."]


def test_lists_and_garbled_blocks_are_compared_with_their_page(spark):
    page = "<body><div class=n><a href=a>Home</a><a href=b>Shop</a></div><div><h1>Über Teiche</h1>" + "".join(f"<p>Satz {i} erzählt, wie Wasser und Frösche einen Teich teilen.</p>" for i in range(6)) + "<ul><li>Frösche 12</li><li>Über Schilf 30</li></ul></div><div>Alle Rechte vorbehalten.</div></body>"
    wrong = lambda t: t.encode("utf-8").decode("latin-1")
    texts = [("heading", "# Über Teiche"), ("paragraph", wrong("Satz 1 erzählt, wie Wasser und Frösche einen Teich teilen.")), ("list", "1. Frösche 12\n2. Über Schilf 30"), ("paragraph", "Alle Rechte vorbehalten."), ("paragraph", "Warum alte Frösche wichtig sind!")]
    versions = spark.createDataFrame([("d", 1, "h")], "doc_id STRING, version INT, raw_hash STRING")
    pages = spark.createDataFrame([(i, "h", None, page.encode()) for i in range(3)], "arrival BIGINT, raw_hash STRING, content_type_header STRING, body BINARY")
    blocks = spark.createDataFrame([("d", 1, f"b{i}", kind, 1 if kind == "heading" else None, t) for i, (kind, t) in enumerate(texts)], "doc_id STRING, version INT, block_id STRING, block_type STRING, level INT, markdown STRING")
    got = {r["block_id"]: (r["furniture"], r["path"]) for r in boilerplate.judged(versions, pages, blocks).collect()}
    assert got == {"b0": (False, "title"), "b1": (False, "page"), "b2": (False, "page"), "b3": (True, "page"), "b4": (False, "slogan")}


def test_confidence_is_calibrated_on_lines_of_its_own():
    rng = random.Random(5)
    common, own = "a o e de que um la".split(), {"es": "muy pero donde hasta".split(), "pt": "muito mas onde ainda".split()}
    line = lambda lang, k: " ".join(rng.choices(common, k=6 - k) + rng.choices(own[lang], k=k))
    train = [(lang, line(lang, 2)) for lang in own for _ in range(200)]
    # the labels of a fifth of the held-out lines are wrong: what the model is sure of is right four times in five
    held = [(lang if rng.random() < 0.8 else other, line(lang, 2)) for lang, other in (("es", "pt"), ("pt", "es")) for _ in range(300)]
    model = langid.Model(train).calibrate(held)
    p = [float(model.posterior(model.score(line("es", 2))[0]).max()) for _ in range(200)]
    assert model.temperature > 1 and 0.6 < sum(p) / len(p) < 0.97
    assert langid.Model(train).calibrate([]).temperature == 1.0


def test_languages_with_held_out_text():
    train = {
        "en": "the cat sat on the mat and then it ran to the house with the dog because they were both very happy about the food",
        "de": "die katze saß auf der matte und dann lief sie mit dem hund zum haus weil beide sehr froh über das essen waren",
        "fr": "le chat était assis sur le tapis et puis il a couru vers la maison avec le chien parce que les deux étaient contents",
    }
    model = langid.Model([(k, v) for k, v in train.items() for _ in range(5)])
    for lang, text in {"en": "then they ran with the happy dog to that house", "de": "dann lief der frohe hund mit ihr zum essen", "fr": "puis le chien a couru avec les chats vers le tapis"}.items():
        assert langid.segments(model, None, text)[0][0] == lang
    mixed = "the cat and the dog ran to the house because they were happy.\n\ndie katze und der hund liefen zum haus weil sie sehr froh über das essen waren."
    assert [x[0] for x in langid.languages_of(langid.segments(model, None, mixed))] == ["de", "en"]
    assert langid.segments(model, None, None) == langid.segments(model, None, " ") == []
    assert [langid.named_language(x) for x in ("en_GB", "Deutsch", "fre", "日本語", "xx", "und", "", None)] == ["en", "de", "fr", "ja", None, None, None, None]
