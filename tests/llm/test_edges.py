"""Nulls in any column, empty and very long texts, repeated rows, clashing columns and empty tables."""

import pytest

from weftline.llm import boilerplate, langid, leakage, mixing, mojibake, residue, sitelines, splitter, subjects

CASES = {
    "boilerplate": (boilerplate.found, ("versions", "fetch_log", "blocks"), []),
    "main bodies": (boilerplate.main_bodies, ("fetch_log",), None),
    "residue": (residue.found, ("versions",), []),
    "languages": (langid.found, ("versions", "documents", "fetch_log", "blocks"), None),
    "splitter": (splitter.found, ("slices", "versions"), [(1,), (2,)]),
    "site lines": (sitelines.found, ("versions",), []),
    "cleaned": (sitelines.cleaned, ("versions",), None),
    "mojibake": (mojibake.found, ("versions",), []),
    "leaks": (leakage.found, ("documents", "benchmark"), [(1, 1)]),
    "mix": (mixing.mixed, ("documents", "targets"), None),
    "shares": (mixing.shares, ("documents", "targets"), None),
    "subjects": (subjects.found, ("documents", "subjects", "subject_labels"), None),
}


@pytest.mark.parametrize("name", CASES)
def test_dirty_tables(tables, name):
    run, inputs, want = CASES[name]
    rows = [tuple(r) for r in run(*(tables[t] for t in inputs)).collect()]
    assert len(rows) == len({str(r) for r in rows})
    if want is not None:
        assert sorted(rows) == want


@pytest.mark.parametrize("name", CASES)
def test_empty_tables(tables, name):
    run, inputs, _ = CASES[name]
    assert run(*(tables[t].limit(0) for t in inputs)).count() == 0
