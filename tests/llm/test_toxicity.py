"""Toxicity: scores against a plain recomputation window by window, and held-out accuracy."""

import math
import random

import numpy as np
import pytest
import zstandard

from knotwork.llm import toxicity

PARTS = ["al", "be", "cor", "du", "min", "tor", "sel", "van", "ix", "on", "um", "ura", "pe", "gri"]
BAD = ["zwitknob", "grolfing", "plumbschtak"]


def made(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = ["".join(rng.choices(PARTS, k=rng.randint(1, 4))) for _ in range(rng.randint(40, 160))]
        if i % 4 == 0:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(BAD)
        rows.append((" ".join(w).capitalize() + ".", int(i % 4 == 0)))
    return rows


@pytest.fixture(scope="module")
def model():
    return toxicity.fit(made(400, 5))


def test_held_out(model):
    rows = made(200, 99)
    score = model.scores([t for t, _ in rows])
    y = np.array([k for _, k in rows])
    assert (score[y == 1] >= 0.7).mean() > 0.9 and (score[y == 0] >= 0.7).mean() < 0.03
    assert ((model.scores([None, "", "  \n"]) >= 0) & (model.scores([None, "", "  \n"]) < 0.7)).all()


def test_against_plain_compression(model):
    """One window at a time, with the library's one-shot call."""

    def length(data, window):
        d = zstandard.ZstdCompressionDict(data + b" " * 9, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=toxicity.SCORING)
        packer = zstandard.ZstdCompressor(level=toxicity.SCORING, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(packer.compress(window))

    texts = [*[t for t, _ in made(12, 3)], None, "", "Zwitknob! " * 5, "x" * 300, "Ünï çödé zwitknob"]
    for t, s in zip(texts, model.scores(texts).tolist(), strict=True):
        w = "".join(c.lower() if c.isascii() else c for c in t or "").encode()
        w = bytes(c if 97 <= c <= 122 or c > 127 else 32 for c in w).split()
        w = [x[i : i + toxicity.WIDTH] for x in w for i in range(0, len(x), toxicity.WIDTH)]
        gains = []
        for i in range(0, len(w), toxicity.WORDS):
            one = (b" " + b" ".join(w[i : i + toxicity.WORDS])) * toxicity.REPEAT + b" "
            gains.append(length(model.ordinary, one) - length(model.toxic, one))
        x = [1.0]
        for k in model.thresholds:
            n = sum(g >= k for g in gains)
            x += [math.log1p(n), 100 * n / max(1, len(gains))]
        assert s == pytest.approx(1 / (1 + math.exp(-sum(a * b for a, b in zip(model.weights, x, strict=True)))), abs=1e-9)


def test_too_little_to_learn():
    assert toxicity.fit([]).scores(["x"]).tolist() == [0.0]
    assert toxicity.fit([("a b", 1), ("c d", 0)]).scores(["x", None]).tolist() == [0.5, 0.5]
    assert 0 <= toxicity.fit([(None, 1), ("", 0)] * 10).scores(["x"])[0] <= 1


def test_training_rows(spark, monkeypatch):
    """Null labels, documents without label, labels without document, repeated rows and the bounds of the sample."""
    docs = spark.createDataFrame([(i, f"text {i % 50} " * 5, 1) for i in range(100)] + [(7, "text 7 " * 5, 1)] * 20 + [(None, "x", 1), (4, None, 1), (200, "y" * 5000, 1)], "doc_id bigint, text string, toxic int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(7, 1), (7, 1), (300, 1), (None, 1), (200, 0), (8, None)], "doc_id bigint, toxic int")
    seen = {}
    monkeypatch.setattr(toxicity, "fit", lambda rows, weight: seen.update(rows=rows, weight=weight))
    toxicity.train(docs, labels, sample=10, sample_bytes=1000)
    rows = seen["rows"]
    assert sorted(y for _, y in rows) == [0] * 10 + [1] * 10 and all(len(t or "") <= 1000 for t, _ in rows) and seen["weight"][1] > 1
    toxicity.train(docs, labels, sample_bytes=10_000)
    import zlib

    usable = {i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1} | ({200} if zlib.crc32(b"200") % 3 != 1 else set())
    assert len(seen["rows"]) == len(usable) + (zlib.crc32(b"4") % 3 != 1)
    assert toxicity.scored(docs, toxicity.Model(b"", b"", (1, 1), (0.25,))).where("score = 0.25 and predicted = 0").count() == docs.count()
