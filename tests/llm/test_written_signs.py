"""E-mail addresses with written signs and without a digit or "@": accepted, read wherever they stand, found."""

import pytest

from knotwork.llm import pii

FORMS = ["jane.doe [at] example [dot] com", "jane.doe (at) example (dot) org", "jane at example dot com"]


@pytest.mark.parametrize("form", FORMS)
def test_form(form):
    assert pii.plausible(0, form)
    for before in (0, 47, 48, 300):
        text = "x" * before + " " + form + " " + "y" * 300
        assert any(s <= before + 1 and before + 1 + len(form) <= e for s, e in pii._stretches(text, pii._cells(text)))


def test_long_name_is_read_whole():
    text = "z" * 100 + " " + "jane" * 30 + " [at] example [dot] com"
    assert any(s <= 101 and e == len(text) for s, e in pii._stretches(text, pii._cells(text)))


def test_prose_is_not_an_address():
    assert not pii.plausible(0, "look at the dot") and not pii.plausible(0, "jane at example.com") and not pii.plausible(0, "noon dot com")


def test_found():
    texts = [f"please write to {form} today" for form in FORMS] + ["we met at noon near the dot on the map"]
    got = [[t[s:e] for k, s, e in every if k == 0] for t, (_, every) in zip(texts, pii.all_spans(pii.tagger(), texts), strict=True)]
    assert got == [[f] for f in FORMS] + [[]]
