"""Substring dedup against a brute-force count of all windows."""

import collections
import random

import pytest

from knotwork.llm import substring_dedup

WORDS = [f"w{i}" for i in range(400)]


def corpus(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    passage = rng.choices(WORDS, k=50)
    rows: list[tuple] = [(None, None), (None, ""), (1, " "), (2, "one word"), (3, "same " * 300)]
    for i in range(40):
        w = rng.choices(WORDS, k=rng.randint(1, 150))
        if i % 3 == 0:
            w[len(w) // 2 : len(w) // 2] = passage[rng.randint(0, 10) : rng.randint(40, 50)]
        rows.append((10 + i % 30, " ".join(w)))  # ids that repeat with other texts
    rows += [rows[20], rows[20], (None, rows[21][1]), (None, rows[22][1]), (None, rows[22][1])]
    return rows


@pytest.mark.parametrize("window", [7, 35])
@pytest.mark.parametrize("size", [1 << 20, 900])  # small sizes: many chunks and buckets
def test_against_all_windows(spark, window, size):
    rows = corpus(window)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, chunk string, bits int").repartition(3)
    words = [(t or "").split() for _, t in rows]
    n = collections.Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    want = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = {j for k in range(len(w) - window + 1) if n[tuple(w[k : k + window])] > 1 for j in range(k, k + window)}
        runs = [j for j in sorted(gone) if j - 1 not in gone]
        ends = [j + 1 for j in sorted(gone) if j + 1 not in gone]
        want.append((i, len(gone), " ".join(x for j, x in enumerate(w) if j not in gone), ",".join(f"{a}:{b}" for a, b in zip(runs, ends, strict=True))))
    got = substring_dedup.remove_repeats(docs, window=window, chunk_bytes=size, bucket_bytes=size).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert sum(x[1] > 0 for x in want) > 5
