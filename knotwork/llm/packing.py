"""Hierarchical multi-length packing.

A document's ids are cut into whole windows of the longest tier and a rest. The rest goes to the smallest tier (a power
of two) that holds it. Tiers are packed from long to short: a window is opened by its longest rest, its gap takes the
longest rests that fit, and where none fits the start of a longer one, whose remainder returns to its own tier. What is
left at the end of a pool is cut along the powers of two. Every window is full, so nothing is padded. Windows are dealt
to step groups of about equal ids.

Packing is local to a partition and needs no shuffle; a pool holds at most POOL ids, so memory is bounded. Defined
results: null and empty texts are one end id; a text longer than a pool makes a pool of its own, whole; rows that repeat
a doc_id (or have none) are packed one by one; rests of one length are taken in the order they came, last first; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, released, small_batches
from .tokens import BYTE_TOKENIZER, CACHE, batches_of, encoder, tokenizer_path

LONGEST = 1024
POOL = 4_000_000
#: Ids of a step group.
STEP = 64 * LONGEST


def pack(sizes: list[int], longest: int = LONGEST) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of pieces (document, start, length); every length of a window is longest or another power of two."""
    windows: list[list[tuple[int, int, int]]] = []
    rests: list[list[tuple[int, int]]] = [[] for _ in range(longest + 1)]
    some = 0  # bit n: there are rests of length n

    def put(doc: int, start: int, n: int) -> None:
        nonlocal some
        if n:
            rests[n].append((doc, start))
            some |= 1 << n

    def take(n: int) -> tuple[int, int]:
        nonlocal some
        got = rests[n].pop()
        if not rests[n]:
            some &= ~(1 << n)
        return got

    for doc, n in enumerate(sizes):
        full = n // longest
        windows += [[(doc, k * longest, longest)] for k in range(full)]
        put(doc, full * longest, n - full * longest)
    while some:
        n = some.bit_length() - 1
        tier = 1 << (n - 1).bit_length()
        doc, start = take(n)
        window, gap = [(doc, start, n)], tier - n
        while gap and some:
            fit = some & ((1 << (gap + 1)) - 1)
            if fit:
                m = fit.bit_length() - 1
                d, s = take(m)
                window.append((d, s, m))
                gap -= m
            else:
                m = (some & -some).bit_length() - 1  # the shortest of those that are too long
                d, s = take(m)
                window.append((d, s, gap))
                put(d, s + gap, m - gap)
                gap = 0
        if not gap:
            windows.append(window)
            continue
        pieces = window  # nothing is left to fill the gap: cut what there is along the powers of two
        room = 1 << ((tier - gap).bit_length() - 1)
        now: list[tuple[int, int, int]] = []
        left = tier - gap
        for d, s, m in pieces:
            while m:
                k = min(m, room)
                now.append((d, s, k))
                s, m, room, left = s + k, m - k, room - k, left - k
                if not room:
                    windows.append(now)
                    now, room = [], 1 << (left.bit_length() - 1) if left else 0
    return windows


def step_groups(totals: list[int], step: int = STEP) -> list[int]:
    """A group for each window: the longest first, each to the group with the fewest ids."""
    heap = [(0, g) for g in range(max(1, -(-sum(totals) // step)))]
    out = [0] * len(totals)
    for i in sorted(range(len(totals)), key=lambda i: -totals[i]):
        n, g = heapq.heappop(heap)
        out[i] = g
        heapq.heappush(heap, (n + totals[i], g))
    return out


_PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, tier bigint, step_group bigint"
_NAMES = [c.split()[0] for c in _PIECE.split(", ")]


def packed(docs: DataFrame, path: str, end: int = 0, text: str = "text", key: str = "doc_id", longest: int = LONGEST, cache: int = CACHE) -> DataFrame:
    """One row a piece; sequence_id counts from the partition's number times 2^33, offset is the piece's place there."""
    small_batches(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 33
        model = encoder(path, cache)
        groups = first
        keys: list = []
        coded: list[bytes] = []
        held = 0

        def flush():
            nonlocal first, groups, held
            sizes = [len(c) // 4 for c in coded]
            windows = pack(sizes, longest)
            totals = [sum(p[2] for p in w) for w in windows]
            group = step_groups(totals, 64 * longest)
            rows = []
            for w, total, g in zip(windows, totals, group, strict=True):
                at = 0
                for d, s, n in w:
                    rows.append((keys[d], s, n, zlib.crc32(coded[d][4 * s : 4 * (s + n)]), sizes[d], first, at, total, groups + g))
                    at += n
                first += 1
            groups += max(group, default=-1) + 1
            keys.clear()
            coded.clear()
            held = 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], _NAMES)

        stop = np.uint32(end).tobytes()
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for at, part in batches_of(texts):
                for k, c in zip(ids[at : at + len(part)], model.encode(part), strict=True):
                    keys.append(k)
                    coded.append(c + stop)
                    held += len(c) // 4 + 1
                    if held >= POOL:
                        yield from flush()
        yield from flush()

    return docs.select(F.col(key).cast("long"), text).mapInArrow(released(run), _PIECE)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"), tokenizer_path(BYTE_TOKENIZER))
