"""Quality rules against plain Python and a numpy estimate that takes the same steps."""

import collections
import math
import random
import re

import numpy as np
import pytest

from knotwork.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLS = "doc_id bigint, text string, lang string, source string, kept string, d2 int"


def corpus():
    rng = random.Random(8)
    words = ["alpha", "be", "gamma", "delta!", "Eps", "z#", "<b>", "eta", "of", "the"]
    rows = []
    for i in range(400):
        lines = [" ".join(rng.choices(words, k=rng.randint(1, 14))) for _ in range(rng.randint(1, 9))]
        if i % 9 == 0:
            lines += [lines[0]] * 3 + [""]
        if i % 40 == 0:
            lines += ["$$$ ### %%% | " * 40]
        lang = ["en", "en", "de", None, ""][i % 5]
        rows.append((i if i % 50 else None, "\n".join(lines), lang, ["hot", "hot", "rare", None][i % 4]))
    return [*rows, (1, None, "en", "hot"), (1, "", "fr", "x"), (3, "word " * 30_000, "en", "hot"), rows[4], rows[4]]


def plain(t):
    t = t or ""
    w = WORD.findall(t)
    n = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    again = {j for k in range(len(w) - 7) if n[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), len(lines), len(re.findall("[A-Z!]", t))


def axes(t):
    words, chars, symbols, dup, again, lines, capitals = plain(t)
    words, chars = max(1, words), max(1, chars)
    return [math.log(chars / words), math.log1p(symbols / chars * 20), math.sqrt(again / words), math.sqrt(dup / max(1, lines)), math.log1p(capitals / chars * 5)]


def at_share(x, p):
    return np.sort(x, 0)[math.ceil(p * len(x)) - 1]


def estimate(x):
    floor = np.array([Q.FLOOR[a] for a in Q.AXES])
    middle = at_share(x, 0.5)
    spread = np.sqrt((at_share(np.abs(x - middle), 0.5) * 1.4826) ** 2 + floor**2)
    t = np.tanh((x - middle) / spread)
    q = np.cov(t.T, bias=True)
    with np.errstate(all="ignore"):
        corr = np.nan_to_num(q / np.sqrt(np.outer(np.diag(q), np.diag(q))), posinf=0, neginf=0) * 0.99
    np.fill_diagonal(corr, 1)

    def factor(c):
        d = len(c)
        low = np.zeros((d, d))
        for j in range(d):
            for i in range(j, d):
                rest = c[i, j] - low[i, :j] @ low[j, :j]
                low[i, j] = math.sqrt(max(rest, 1e-6)) if i == j else rest / low[j, j]
        return low

    def step(state):
        m, low = state
        d2 = (np.linalg.solve(low, (x - m).T) ** 2).sum(0)
        near = x[d2 <= at_share(d2, Q.SUPPORT)]
        return near.mean(0), factor(np.cov(near.T, bias=True) * Q.CONSISTENCY + np.diag(floor**2))

    det = lambda s: np.prod(np.diag(s[1]))
    return min((step((middle, factor(c))) for c in (np.diag(spread**2), corr * np.outer(spread, spread))), key=det), step, det


@pytest.fixture(scope="module")
def judged(spark):
    docs = spark.createDataFrame([(*r, "x", 1) for r in corpus()], COLS)
    return Q.judged(docs, least=30).collect()


def test_base_counts(judged):
    key = lambda r: tuple(str(x) for x in r)
    got = sorted(key((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in judged)
    want = []
    for i, t, *_ in corpus():
        n, chars, symbols, dup, again, *_ = plain(t)
        want.append(key((i, n, chars, symbols, dup, again, n < 20 or 100 * again > 30 * n)))
    assert got == sorted(want)


def test_distances_and_verdicts(judged):
    rows = corpus()
    x = np.array([axes(t) for _, t, *_ in rows])
    names = [(("=" + r[2]) if r[2] is not None else "-", ("=" + r[3]) if r[3] is not None else "-") for r in rows]
    n, nl = collections.Counter(names), collections.Counter(a for a, _ in names)
    group = [(a if nl[a] >= 30 else "*", b if n[a, b] >= 30 else "*") for a, b in names]
    pool = {g: x[[(g[0] in ("*", a)) and (g[1] in ("*", b)) for a, b in names]] for g in set(group)}
    state = {g: estimate(p) for g, p in pool.items()}
    now = {g: s for g, (s, *_) in state.items()}
    for _ in range(Q.STEPS - 1):
        new = {g: state[g][1](s) for g, s in now.items()}
        change = max(abs(state[g][2](new[g]) / state[g][2](now[g]) - 1) for g in now)
        now = new
        if change <= Q.SETTLED:
            break
    got = collections.defaultdict(list)
    for r in judged:
        got[str(r.doc_id), r.n_words, r.word_chars, str(r.lang), str(r.source)].append((r.distance2, r.kept))
    for (i, t, lang, source), g, v in zip(rows, group, x, strict=True):
        z = np.linalg.solve(now[g][1], v - now[g][0])
        d2 = float(z @ z)
        side = float((np.maximum(z[1:], 0) ** 2).sum() + z[0] ** 2)
        words, chars, _, _, again, *_ = plain(t)
        kept = not (words < 20 or 100 * again > 30 * words) and not (d2 > Q.SPREADS**2 and side > Q.SPREADS**2)
        assert any(abs(a - d2) <= 1e-6 * max(1, d2) and b == kept for a, b in got[str(i), words, chars, str(lang), str(source)])


def test_empty(spark):
    assert Q.judged(spark.createDataFrame([], COLS)).count() == 0 and Q.keep_good(spark.createDataFrame([], COLS)).count() == 0
