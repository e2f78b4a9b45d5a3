"""Base patterns against the contract's expressions, windows that are left out, and the tagger on lines made elsewhere."""

import random
import re

import pytest

from knotwork.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def contract(text):
    digits = lambda t: re.sub("[^0-9]", "", t)
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]


def test_base_patterns():
    rng = random.Random(3)
    some = ["@", ".", "-", "+", " ", "(", ")", "a", "B", "%", "_", "é", "²", "٣", "\n", "1.2.3.4", "255.1.0.9", "4111 1111 1111 1111", "+1 (743) 555-3824", "x@y.z", *"0123456789"]
    for _ in range(20_000):
        text = "".join(rng.choices(some, k=rng.randint(0, 24)))
        assert pii.base_spans(text) == contract(text), text


@pytest.fixture(scope="module")
def model():
    return pii.tagger()


def words(rng, n):
    return [rng.choice(["quarterly", "meeting", "the", "of", "Bericht", "maison", "señor", "and", "with", "river", "Ö", "old"]) for _ in range(n)]


def luhn_number(rng, n):
    body = "".join(rng.choices("0123456789", k=n - 1))
    return next(body + c for c in "0123456789" if pii.luhn(body + c))


NAMES = ["maria", "john.smith", "peter_k", "h.mueller", "lopez", "dupont", "anna"]
HOSTS = ["beispiel.de", "mail.example.org", "uni-ulm.de", "acme7.com", "correo.es"]


def made(rng, kind):
    """A span of a kind, by rules that the training lines do not share."""
    if kind == 0:
        at, dot = rng.choice([(" [at] ", " [dot] "), (" (at) ", " (dot) "), (" at ", " dot ")])
        return rng.choice(NAMES) + at + rng.choice(HOSTS).replace(".", dot)
    if kind == 2:
        n = luhn_number(rng, rng.choice([13, 14, 15]))
        return n if rng.random() < 0.5 else " ".join(n[i : i + 4] for i in range(0, len(n), 4))
    a, b, c = (str(rng.randint(10 ** (k - 1), 10**k - 1)) for k in (3, 3, 4))
    return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0044 {a} {b} {c}"])


def lines(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randint(0, 4)):
            text += " ".join(words(rng, rng.randint(3, 40))) + " "
            kind = rng.choice([0, 2, 3])
            span = made(rng, kind)
            spans.append((kind, len(text), len(text) + len(span)))
            text += span + rng.choice([" ", ", ", ". ", "\n"])
        out.append((text + " ".join(words(rng, 10)), spans))
    return out


def test_windows_left_out_change_nothing(model):
    texts = [t for t, _ in lines(120, 5)] + ["", "1", "x" * 500, "a@b.co " * 60, "7" * 200]
    assert pii.tagged(model, texts) == pii.tagged(model, texts, everything=True)
    alone = [pii.tagged(model, [t])[0] for t in texts]
    assert [sorted(x) for x in alone] == [sorted(x) for x in pii.tagged(model, texts)]


def test_recall_and_precision(model):
    """On lines made by other rules than the training lines."""
    hit, want, got = [0] * 4, [0] * 4, [0] * 4
    rows = lines(300, 9)
    for (_, spans), (base, every) in zip(rows, pii.all_spans(model, [t for t, _ in rows]), strict=True):
        added = set(every) - set(base)
        for k, s, e in spans:
            want[k] += 1
            hit[k] += (k, s, e) in added
        for k, *_ in added:
            got[k] += 1
    figures = {pii.KINDS[k]: (round(hit[k] / want[k], 2), round(hit[k] / max(1, got[k]), 2)) for k in (0, 2, 3)}
    print(figures)
    assert all(recall >= 0.7 and precision >= 0.9 for recall, precision in figures.values()), figures


def test_overlaps(model):
    text = "a@b.co 10.0.0.1 " * 5 + "mail john [at] example [dot] com now"
    base, every = pii.all_spans(model, [text])[0]
    assert base == contract(text) and set(base) <= set(every)
    flat = sorted((s, e) for _, s, e in every)
    assert all(a[1] <= b[0] for a, b in zip(flat, flat[1:], strict=False))
    assert any(text[s:e] == "john [at] example [dot] com" for _, s, e in every)
