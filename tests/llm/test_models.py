import os
import random

import pytest

from weftline.llm import mixing, subjects

TOPICS = {"law": "court judge appeal verdict statute contract lawyer tribunal".split(), "sport": "match goal referee league striker stadium coach trophy".split(), "food": "bread butter oven recipe soup garlic onion flour".split()}
COMMON = "the of and with more about often many people think that this was seen".split()


def document(rng, topics):
    out = []
    for t in topics:
        for _ in range(6):
            out.append(" ".join(rng.choices(COMMON, k=6) + rng.sample(TOPICS[t], 3)) + ".")
    return " ".join(out)


def test_subjects_of_held_out_documents(spark):
    rng = random.Random(1)
    names = list(TOPICS)
    truth = {i: {names[i % 3]} | ({names[(i + 1) % 3]} if i % 7 == 0 else set()) for i in range(300)}
    docs = [(i, document(rng, sorted(t)), "en") for i, t in truth.items()] + [(999, "Nothing here says much at all. We only send greetings today friends. Be well until the next note arrives.", "en")]
    labels = [(i, x.upper() if i % 5 else f" {x}") for i in range(60) for x in truth[i]] + [(3, None), (3, "unknown")]
    d = spark.createDataFrame(docs, "doc_id BIGINT, text STRING, lang STRING")
    s = spark.createDataFrame([(n, n) for n in names], "subject STRING, description STRING")
    got = {(r["doc_id"], r["subject"]) for r in subjects.found(d, s, spark.createDataFrame(labels, "doc_id BIGINT, subject STRING")).collect()}
    want = {(i, x) for i, t in truth.items() for x in t}
    assert len(got & want) / len(want) > 0.97 and len(got & want) / len(got) > 0.97


@pytest.mark.skipif(not os.path.exists(mixing.TOKENIZER), reason="no tokenizer")
def test_mix_keeps_caps_and_reaches_shares(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(COMMON, k=rng.randint(5, 60))), "a" if i < 100 else "b" if i < 400 else "c") for i in range(420)]
    rows += [(1000 + i, rows[0][1], "a") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING")
    targets = spark.createDataFrame([(1, "a", 0.5, 4, 0.8), (1, "b", 0.4, None, 0.8), (1, "c", 0.1, 1, 0.8), (1, "gone", 0.0, 1, 0.8)], "mix_id INT, source STRING, target_share DOUBLE, max_repeats INT, size_ratio DOUBLE")
    plan = [r.asDict() for r in mixing.mixed(docs, targets).collect()]
    assert [r["position"] for r in plan] == sorted(r["position"] for r in plan)
    assert all(0 <= r["position"] <= 1 for r in plan)
    by = {r["source"]: r.asDict() for r in mixing.shares(docs, targets).collect()}
    assert by["a"]["most_uses"] <= 4 and by["c"]["most_uses"] <= 1 and by["gone"]["used_tokens"] == 0
    assert by["a"]["texts"] == 100  # copies count once
    for s in ("a", "b"):
        assert abs(by[s]["used_tokens"] - by[s]["demand"]) < 60
    for s in by:
        assert sum(r["tokens"] for r in plan if r["source"] == s) == by[s]["used_tokens"]
    # half-way through, a source has had the integral of its schedule
    total = sum(r["tokens"] for r in plan)
    half = sum(r["tokens"] for r in plan if r["position"] <= 0.5)
    assert abs(half / total - 0.5) < 0.05


@pytest.mark.skipif(not os.path.exists(mixing.TOKENIZER), reason="no tokenizer")
def test_schedules_say_when_a_source_comes(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(COMMON, k=20)) + f" {i}", "early" if i < 200 else "late" if i < 400 else "step") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING")
    targets = spark.createDataFrame([(1, s, x, None, 0.9) for s, x in (("early", 0.4), ("late", 0.3), ("step", 0.3))], "mix_id INT, source STRING, target_share DOUBLE, max_repeats INT, size_ratio DOUBLE")
    points = [("early", 0.0, 1.0), ("early", 0.5, 0.0), ("early", 1.0, 0.0), ("late", 0.5, 0.0), ("late", 1.0, 2.0), ("step", 0.25, 1.0), ("step", 0.75, 1.0), ("step", 2.0, 5.0)]
    schedules = spark.createDataFrame([(1, *p) for p in points], "mix_id INT, source STRING, t DOUBLE, weight DOUBLE")
    plan = [r.asDict() for r in mixing.mixed(docs, targets, schedules=schedules).collect()]
    at = {s: [r["position"] for r in plan if r["source"] == s] for s in ("early", "late", "step")}
    assert max(at["early"]) <= 0.5 + 1e-9 and min(at["late"]) >= 0.5 and [r["position"] for r in plan] == sorted(r["position"] for r in plan)
    # a weight that falls from 1 to 0 up to one half has given three quarters of its tokens at one quarter
    share = lambda s, t: sum(r["tokens"] for r in plan if r["source"] == s and r["position"] <= t) / sum(r["tokens"] for r in plan if r["source"] == s)
    assert abs(share("early", 0.25) - 0.75) < 0.03 and abs(share("late", 0.75) - 0.25) < 0.03 and abs(share("step", 0.5) - 0.5) < 0.03


@pytest.mark.skipif(not os.path.exists(mixing.TOKENIZER), reason="no tokenizer")
def test_many_copies_are_made_in_runs(spark):
    docs = spark.createDataFrame([(1, "one small text", "a")] + [(i, "word " * 400 + str(i), "b") for i in range(2, 60)], "doc_id BIGINT, text STRING, source STRING")
    targets = spark.createDataFrame([(1, "a", 0.5, None, 1.0), (1, "b", 0.5, None, 1.0)], "mix_id INT, source STRING, target_share DOUBLE, max_repeats INT, size_ratio DOUBLE")
    got = mixing.mixed(docs, targets).where("source = 'a'").select("copy").collect()
    by = {r["source"]: r for r in mixing.shares(docs, targets).collect()}
    assert len(got) > 2 * mixing.RUN and sorted(r["copy"] for r in got) == list(range(1, len(got) + 1)) and by["a"]["most_uses"] == len(got)
    assert abs(by["a"]["reached_share"] - 0.5) < 0.01
