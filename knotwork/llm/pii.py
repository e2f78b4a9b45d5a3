"""Personal data: exact base patterns plus spans of a character BiLSTM with CRF transitions, trained here in numpy.

The base patterns are matched in time linear in the text. The network is trained on labelled spans that are generated
with a fixed seed (forms the patterns miss: bracketed e-mail addresses, telephone numbers without a plus sign, 13- to
15-digit cards). It reads overlapping windows of WIDTH characters; the emissions of windows that overlap are averaged
by their distance from the window's edge, and one Viterbi pass over the text gives its tags, so a span that crosses
windows is decided once. An added span has a digit, "@" or a written at and dot sign (`plausible` asks for a format with
one), so characters that the name or host around such a sign, with a margin, does not reach are tagged as none; windows
over them only are not read, which changes nothing. An e-mail address is cut out of what the network marked by its
format. Base spans stay; an added span never overlaps one.

Defined results: null and empty texts have no spans; rows that repeat a doc_id or have none are read one by one; one very
long text is read whole, a run of windows at a time; of added spans that overlap each other the one that starts first
stays, then the shorter, then the kind listed first; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, released, small_batches

KINDS = ("email", "ip", "card", "phone")
WIDTH, STRIDE = 96, 48
HIDDEN, EMBED, STEPS, BATCH, SEED = 20, 12, 420, 48, 7
_RUN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HINT = re.compile(r"[0-9]|@|[\[(](?:at|dot)[\])]| at (?=[\w-]+ dot )| dot ", re.IGNORECASE)
#: " at " only with " dot "; a plain "." without spaces.
_SPELT = r"(?:[\w.%+-]++ at [\w-]++(?: dot [\w-]++)+)"
_SIGNED = r"[\w.%+-]++ ?(?:@|\[at\]|\(at\)) ?[\w-]++(?:(?:\.| ?(?:\[dot\]|\(dot\)) ?| dot )[\w-]++)+"
_EMAIL = re.compile(rf"{_SPELT}|{_SIGNED}", re.IGNORECASE)
_INSIDE = re.compile(rf"(?<![\w.%+-])(?:{_SPELT}|{_SIGNED})", re.IGNORECASE)
Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the base patterns, by kind and start."""
    out: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            end = m.end()
            at = text.find("@", end)
        else:
            end = max(end, at + 1)  # what precedes this sign cannot be a local part of a later one
            at = text.find("@", at + 1)
    for m in _RUN.finditer(text):
        if m[0].count(".") >= 3:
            parts, place = m[0].split("."), m.start()
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                size = sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                    out.append((1, place, place + size))
                place += size + 1
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


# --- the network -----------------------------------------------------------------------------------------------------

#: Characters by class: letters are told apart only where the forms need them.
_SPECIAL = " \n@.-+()[]{}<>:;,_/#|'\""
CLASSES = 4 + 10 + 26 + len(_SPECIAL)
TAGS = 1 + 2 * len(KINDS)


def classes(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _TABLE[np.minimum(code, len(_TABLE) - 1)]


def _table() -> np.ndarray:
    t = np.full(129, 1, np.int64)
    t[128] = 2  # beyond ASCII
    for c in range(10):
        t[48 + c] = 4 + c
    for c in range(26):
        t[97 + c] = t[65 + c] = 14 + c
    for i, c in enumerate(_SPECIAL):
        t[ord(c)] = 40 + i
    return t


_TABLE = _table()


@dataclass
class Tagger:
    """embed; (input, recurrent, bias) of either direction; output weights and bias; transitions, start."""

    params: list[np.ndarray]

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """x: windows by places -> scores of tags, float32."""
        return _forward(self.params, x, learn=False)[0]


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _lstm(w, u, b, e, back, learn=True):
    """e: places by windows by inputs. Returns the states and, to learn, what the gradient needs."""
    n, m, _ = e.shape
    h, c = np.zeros((m, HIDDEN), np.float32), np.zeros((m, HIDDEN), np.float32)
    out, kept = np.zeros((n, m, HIDDEN), np.float32), [None] * n
    for t in range(n - 1, -1, -1) if back else range(n):
        z = e[t] @ w + b + h @ u
        s = _sigmoid(z[:, : 3 * HIDDEN])
        g = np.tanh(z[:, 3 * HIDDEN :])
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        c_new = f * c + i * g
        tc = np.tanh(c_new)
        if learn:
            kept[t] = (i, f, o, g, c, tc, h)
        h, c = o * tc, c_new
        out[t] = h
    return out, kept


def _lstm_grad(w, u, e, kept, d_out, back):
    n, m, _ = e.shape
    dw, du, db, de = np.zeros_like(w), np.zeros_like(u), np.zeros(4 * HIDDEN, np.float32), np.zeros_like(e)
    dh, dc = np.zeros((m, HIDDEN), np.float32), np.zeros((m, HIDDEN), np.float32)
    for t in range(n) if back else range(n - 1, -1, -1):
        i, f, o, g, c, tc, h = kept[t]
        dh = dh + d_out[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
        dw += e[t].T @ dz
        du += h.T @ dz
        db += dz.sum(0)
        de[t] = dz @ w.T
        dh, dc = dz @ u.T, dc * f
    return dw, du, db, de


def _forward(p, x, learn=True):
    e = p[0][x.T]
    hf, kf = _lstm(p[1], p[2], p[3], e, False, learn)
    hb, kb = _lstm(p[4], p[5], p[6], e, True, learn)
    h = np.concatenate([hf, hb], 2)
    return h @ p[7] + p[8], (e, h, kf, kb)


def _lse(a, axis):
    top = a.max(axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis, keepdims=True))).squeeze(axis)


def _loss_grad(p, x, y):
    """Negative log likelihood of the CRF for a batch, and its gradients."""
    s, (e, h, kf, kb) = _forward(p, x)
    n, m, k = s.shape
    move, first = p[9], p[10]
    alpha = np.zeros((n, m, k), np.float32)
    alpha[0] = first + s[0]
    for t in range(1, n):
        alpha[t] = s[t] + _lse(alpha[t - 1][:, :, None] + move[None], 1)
    beta = np.zeros((n, m, k), np.float32)
    for t in range(n - 2, -1, -1):
        beta[t] = _lse(move[None] + (s[t + 1] + beta[t + 1])[:, None, :], 2)
    z = _lse(alpha[-1], 1)
    prob = np.exp(alpha + beta - z[None, :, None])
    yt = y.T
    rows = np.arange(m)
    gold = first[yt[0]] + s[0][rows, yt[0]]
    d_move = np.zeros_like(move)
    for t in range(1, n):
        gold += move[yt[t - 1], yt[t]] + s[t][rows, yt[t]]
        d_move += np.exp(alpha[t - 1][:, :, None] + move[None] + (s[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
        np.add.at(d_move, (yt[t - 1], yt[t]), -1)
    ds = prob.copy()
    ds[np.arange(n)[:, None], rows[None], yt] -= 1
    d_first = ds[0].sum(0)
    ds /= m
    dh = ds @ p[7].T
    dw7, db8 = np.tensordot(h, ds, ([0, 1], [0, 1])), ds.sum((0, 1))
    f = _lstm_grad(p[1], p[2], e, kf, dh[:, :, :HIDDEN], False)
    b = _lstm_grad(p[4], p[5], e, kb, dh[:, :, HIDDEN:], True)
    d_embed = np.zeros_like(p[0])
    np.add.at(d_embed, x.T, f[3] + b[3])
    return float((z - gold).mean()), [d_embed, *f[:3], *b[:3], dw7, db8, d_move / m, d_first / m]


def example(rng: np.random.Generator) -> tuple[str, list[Span]]:
    """One generated line with its labelled spans."""
    parts = ["the", "er", "in", "and", "tion", "de", "la", "ung", "es", "an", "on", "re", "ch", "st", "een", "ó", "é", "ü"]

    def word():
        w = "".join(rng.choice(parts, rng.integers(1, 4)))
        return w.capitalize() if rng.random() < 0.15 else w

    def digits(n):
        return "".join(map(str, rng.integers(0, 10, n)))

    def card(n):
        body = digits(n - 1)
        return next(body + str(c) for c in range(10) if luhn(body + str(c)))

    def label(low=2, high=9):
        """A made-up label of letters, sounding or not."""
        if rng.random() < 0.5:
            return word().lower()
        return "".join(rng.choice(list("aeiou" if i % 2 and rng.random() < 0.8 else "abcdefghijklmnopqrstuvwxyz")) for i in range(int(rng.integers(low, high))))

    def email():
        name = label() if rng.random() < 0.7 else word()
        name += ["", "", f".{digits(2)}", digits(int(rng.integers(1, 4))), f"{rng.choice(list('._-'))}{label(1, 9)}"][rng.integers(5)]
        if rng.random() < 0.15:
            name = f"{label(1, 2)[:1]}.{name}"
        host = label() + ["", "", f"{rng.integers(1, 99)}", f"-{label()}", f".{label()}"][rng.integers(5)]
        host += f".{rng.choice(['com', 'org', 'net', 'example.com', 'de', 'fr', 'es', 'io', 'co.uk', 'info', label(2, 4)])}"
        at, dot = [("@", "."), (" @ ", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) "), (" at ", " dot ")][rng.choice(5, p=[0.2, 0.15, 0.23, 0.22, 0.2])]
        return name + at + host.replace(".", dot)

    def phone():
        a, b, c = digits(3), digits(3), digits(4)
        return [f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{digits(2)} {a} {b} {c}", f"00{digits(2)} {a} {b} {c}"][rng.integers(6)]

    def number_card():
        n = int(rng.choice([13, 14, 15, 16, 16, 16]))
        d = card(n)
        return d if rng.random() < 0.5 else (rng.choice([" ", "-"])).join(d[i : i + 4] for i in range(0, n, 4))

    def ip():
        return ".".join(map(str, rng.integers(0, 256, 4)))

    def decoy():
        return [digits(int(rng.integers(1, 7))), f"{rng.integers(1, 30)}.{rng.integers(0, 30)}.{rng.integers(0, 30)}", "".join(rng.choice(list("0123456789abcdef"), 40)), f"{rng.integers(1900, 2030)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}", f"{digits(2)},{digits(3)}.{digits(2)}", f"Version {rng.integers(1, 9)}.0", f"@{word()}", f"{word()} at {word()}", f"{word()} (at) {word()}", f"{word()} dot {word()}"][rng.integers(10)]

    text, spans = "", []
    makers = (email, ip, number_card, phone)
    while len(text) < WIDTH:
        r = rng.random()
        if r < 0.72:
            piece = word() + rng.choice(["", "", "", ",", "."])
        elif r < 0.8:
            piece = decoy()
        else:
            k = int(rng.integers(len(makers)))
            piece = makers[k]()
            spans.append((k, len(text), len(text) + len(piece)))
        text += piece + (" " if rng.random() < 0.93 else rng.choice(["\n", ", ", ". ", "### "]))
    cut = int(rng.integers(0, len(text) - WIDTH + 1))
    return text[cut : cut + WIDTH], [(k, max(0, s - cut), min(WIDTH, e - cut)) for k, s, e in spans if s < cut + WIDTH and e > cut]


def _tags(spans: list[Span], n: int) -> np.ndarray:
    y = np.zeros(n, np.int64)
    for k, s, e in spans:
        y[s:e] = 2 + 2 * k
        y[s] = 1 + 2 * k
    return y


def train(steps: int = STEPS, seed: int = SEED) -> Tagger:
    """Adam on generated lines; about twenty seconds on one core."""
    rng = np.random.default_rng(seed)
    f = lambda *s: (rng.standard_normal(s) * 0.15).astype(np.float32)
    bias = np.zeros(4 * HIDDEN, np.float32)
    bias[HIDDEN : 2 * HIDDEN] = 1
    p = [f(CLASSES, EMBED), f(EMBED, 4 * HIDDEN), f(HIDDEN, 4 * HIDDEN), bias.copy(), f(EMBED, 4 * HIDDEN), f(HIDDEN, 4 * HIDDEN), bias.copy(), f(2 * HIDDEN, TAGS), f(TAGS), f(TAGS, TAGS), f(TAGS)]
    mean, square = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, steps + 1):
        lines = [example(rng) for _ in range(BATCH)]
        x = np.stack([classes(s) for s, _ in lines])
        y = np.stack([_tags(spans, WIDTH) for _, spans in lines])
        _, grads = _loss_grad(p, x, y)
        rate = 0.02 * (1 if t < 0.7 * steps else 0.25)
        norm = max(1.0, float(np.sqrt(sum((g**2).sum() for g in grads))) / 5)
        for a, g, m1, m2 in zip(p, grads, mean, square, strict=True):
            g = g / norm
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            a -= (rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return Tagger(p)


def viterbi(move: np.ndarray, first: np.ndarray, last: np.ndarray, s: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Best tags of many stretches at once: s is places by stretches by tags (padded to the longest), sizes their lengths,
    first and last what each stretch's first and last tag add. Ties go to the lowest tag."""
    n, m, k = s.shape
    back = np.zeros((n, m, k), np.int8)
    same = np.arange(k, dtype=np.int8)
    best = first + s[0]
    for t in range(1, n):
        got = best[:, :, None] + move
        live = (t < sizes)[:, None]
        back[t] = np.where(live, got.argmax(1).astype(np.int8), same)
        best = np.where(live, got.max(1) + s[t], best)
    tags = np.zeros((n, m), np.int64)
    tags[-1] = (best + last).argmax(1)
    rows = np.arange(m)
    for t in range(n - 1, 0, -1):
        tags[t - 1] = back[t, rows, tags[t]]
    return tags


def _spans_of(tags: np.ndarray) -> Iterator[Span]:
    start, kind = -1, -1
    for i, t in enumerate([*tags.tolist(), 0]):
        k = (t - 1) // 2 if t else -1
        if start >= 0 and (k != kind or t % 2 == 1):
            yield kind, start, i
            start = -1
        if t and start < 0:
            start, kind = i, k


def plausible(kind: int, text: str) -> bool:
    """What a span must have to be added, whatever the network says."""
    d = _digits(text)
    if kind == 0:
        return bool(_EMAIL.fullmatch(text))
    if kind == 1:
        return bool(re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", text)) and all(int(p) < 256 for p in text.split("."))
    if kind == 2:
        return bool(re.fullmatch(r"[0-9 .-]+", text)) and 13 <= len(d) <= 19 and luhn(d)
    return bool(re.fullmatch(r"(?:00[0-9]{1,3} |\+[0-9]{1,3} )?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", text))


def _reach(text: str, m: re.Match) -> tuple[int, int]:
    """The stretch of a digit, or of a sign with the name before it and the label after it."""
    s, e = m.span()
    if not text[s].isdigit():
        s -= s > 0 and text[s - 1] == " "
        while s > 0 and (text[s - 1].isalnum() or text[s - 1] in "_.%+-"):
            s -= 1
        e += text[e : e + 1] == " "
        while e < len(text) and (text[e].isalnum() or text[e] in "_.-"):
            e += 1
    return s, e


def _cells(text: str) -> list[int]:
    """The cells of STRIDE characters that a hint's reach touches, and one on each side: no span may be added elsewhere."""
    reach = {(s // STRIDE, (e - 1) // STRIDE) for s, e in (_reach(text, m) for m in _HINT.finditer(text))}
    return sorted({c for a, b in reach for c in range(max(0, a - 1), b + 2) if c * STRIDE < len(text)})


def _stretches(text: str, cells: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for c in cells:
        s, e = c * STRIDE, min(len(text), (c + 1) * STRIDE)
        if out and out[-1][1] == s:
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


_WEIGHT = np.minimum(np.arange(WIDTH) + 1, WIDTH - np.arange(WIDTH)).astype(np.float32)


def tagged(model: Tagger, texts: list[str], group: int = 512, everything: bool = False) -> list[list[Span]]:
    """Plausible spans of the network in each text.

    Window w covers the cells w and w + 1, so a cell is read by two windows. Outside of `_cells` every character is
    tagged as none, so only windows over those cells matter, and each stretch of cells is decoded by itself between
    characters of no tag. `everything` reads all windows of the text all the same (the result is the same: a test).
    """
    found: list[list[Span]] = [[] for _ in texts]
    at = 0
    todo = [(i, cells) for i, t in enumerate(texts) if (cells := _cells(t))]
    while at < len(todo):
        some, n = [], 0
        while at < len(todo) and (not some or n < group):
            some.append(todo[at])
            n += len(todo[at][1]) + 1
            at += 1
        _tag_some(model, texts, some, found, group, everything)
    return found


def _tag_some(model: Tagger, texts: list[str], some: list[tuple[int, list[int]]], found: list[list[Span]], group: int, everything: bool) -> None:
    work: list[tuple[int, int, int, int]] = []  # text, start, end, first row of its scores
    places, rows, used = [], [], 0
    slot: dict[tuple[int, int], int] = {}
    for i, cells in some:
        coded = classes(texts[i])
        final = max(0, -(-len(coded) // STRIDE) - 2)
        for s, e in _stretches(texts[i], cells):
            work.append((i, s, e, used))
            for c in range(s // STRIDE, -(-e // STRIDE)):
                slot[i, c] = used + c * STRIDE - s
            used += e - s
        for w in range(final + 1) if everything else sorted({w for c in cells for w in (c - 1, c) if 0 <= w <= final}):
            row = np.zeros(WIDTH, np.int64)
            piece = coded[w * STRIDE : w * STRIDE + WIDTH]
            row[: len(piece)] = piece
            places.append((i, w, len(piece)))
            rows.append(row)
    score, weight = np.zeros((used, TAGS), np.float32), np.zeros((used, 1), np.float32)
    for k in range(0, len(rows), group):
        out = model.emissions(np.stack(rows[k : k + group]))
        for r, (i, w, size) in enumerate(places[k : k + group]):
            for half in (0, 1):
                if (to := slot.get((i, w + half))) is not None and size > half * STRIDE:
                    a, b = half * STRIDE, min(size, (half + 1) * STRIDE)
                    score[to : to + b - a] += out[a:b, r] * _WEIGHT[a:b, None]
                    weight[to : to + b - a] += _WEIGHT[a:b, None]
    score /= weight
    work.sort(key=lambda x: x[2] - x[1])
    done = 0
    while done < len(work):
        part = work[done : done + max(1, 200_000 // (work[done][2] - work[done][1]))]
        part = [p for p in part if p[2] - p[1] <= 2 * (work[done][2] - work[done][1])]
        done += len(part)
        _decode(model, texts, part, score, found)


def _decode(model: Tagger, texts: list[str], part: list[tuple[int, int, int, int]], score: np.ndarray, found: list[list[Span]]) -> None:
    sizes = np.array([e - s for _, s, e, _ in part])
    s3 = np.zeros((sizes.max(), len(part), TAGS), np.float32)
    for j, (_, s, e, row) in enumerate(part):
        s3[: e - s, j] = score[row : row + e - s]
    move, start = model.params[9], model.params[10]
    first = np.stack([start if s == 0 else move[0] for _, s, _, _ in part])
    last = np.stack([np.zeros(TAGS, np.float32) if e == len(texts[i]) else move[:, 0] for i, _, e, _ in part])
    tags = viterbi(move, first, last, s3, sizes)
    for j, (i, s, e, _) in enumerate(part):
        text = texts[i]
        for kind, x, y in _spans_of(tags[: e - s, j]):
            piece = text[s + x : s + y]
            a = s + x + len(piece) - len(piece.lstrip(" "))
            piece = piece.strip(" ")
            if kind == 0 and not plausible(0, piece):
                found[i] += _cut_out(text, s + x, s + y)
            elif plausible(kind, piece) and not _glued(text, a, a + len(piece)):
                found[i].append((kind, a, a + len(piece)))


def _cut_out(text: str, s: int, e: int) -> list[Span]:
    """The e-mail addresses in whole words of a marked stretch."""
    while s > 0 and (text[s - 1].isalnum() or text[s - 1] in "_.%+-"):
        s -= 1
    while e < len(text) and (text[e].isalnum() or text[e] in "_-"):
        e += 1
    return [(0, s + m.start(), s + m.end()) for m in _INSIDE.finditer(text[s:e]) if not _glued(text, s + m.start(), s + m.end())]


def _glued(text: str, s: int, e: int) -> bool:
    """A span that is a part of a longer word or number."""
    return (s > 0 and text[s - 1].isalnum()) or (e < len(text) and text[e].isalnum())


def all_spans(model: Tagger, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text, both by kind and start."""
    base = [base_spans(t) if _HINT.search(t) else [] for t in texts]
    out = []
    for own, more in zip(base, tagged(model, texts), strict=True):
        taken = sorted((s, e) for _, s, e in own)  # base spans of two kinds may overlap
        reach = list(itertools.accumulate((e for _, e in taken), max))
        added: list[Span] = []
        free = 0
        for k, s, e in sorted(more, key=lambda x: (x[1], x[2], x[0])):  # of added spans that overlap, the first stays
            before = bisect.bisect_left(taken, (e, 0))
            if s >= free and (not before or reach[before - 1] <= s):
                free = e
                added.append((k, s, e))
        out.append((own, sorted(own + added)))
    return out


_trained: list[Tagger] = []


def tagger() -> Tagger:
    """Trained once a driver process; tasks get its weights (some 50 kB)."""
    if not _trained:
        _trained.append(train())
    return _trained[0]


def coded(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def found(docs: DataFrame, model: Tagger | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, counts of base spans by kind, base and spans as kind:start:end lists."""
    small_batches(docs.sparkSession)
    model = model or tagger()
    schema = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, spans string"

    def run(batches):
        for b in batches:
            base, every = zip(*all_spans(model, [t or "" for t in b.column(1).to_pylist()]), strict=True) if b.num_rows else ((), ())
            n = [pa.array([sum(s[0] == k for s in x) for x in base], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0), *n, pa.array(map(coded, base), pa.string()), pa.array(map(coded, every), pa.string())], [c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col(key).cast("long").alias("doc_id"), text).mapInArrow(released(run), schema)


def redacted(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """The documents with every span replaced by <EMAIL>, <IP>, <CARD> or <PHONE>; n_chars follows, a null text stays null."""
    small_batches(docs.sparkSession)
    model = model or tagger()
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            new = []
            for t, (_, every) in zip(texts, all_spans(model, [t or "" for t in texts]), strict=True):
                if every:
                    parts, done = [], 0
                    for s, e, k in sorted((s, e, k) for k, s, e in every):
                        if s >= done:
                            parts += [t[done:s], f"<{KINDS[k].upper()}>"]
                        done = max(done, e)
                    t = "".join([*parts, t[done:]])
                new.append(t)
            yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))

    out = docs.mapInArrow(released(run), docs.schema)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))) if "n_chars" in docs.columns else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = found(read(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")
