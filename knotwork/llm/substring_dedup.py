"""Exact substring dedup by fixed-block anchors.

Reference blocks are the non-overlapping BLOCK-word blocks at multiples of BLOCK in each document. A repeated window of
WINDOW = 2 * BLOCK - 1 or more words holds a whole block of each of its documents, so probing the index of blocks with
every rolling BLOCK-word window hits in all of them. Each hit is extended by the words around it: a WINDOW-word stretch
that holds the hit and whose 64-bit digest occurs a second time in the corpus belongs to a repeat, and stretches that
overlap or touch are joined, which gives the maximal exact repeats (`spans`).

Documents are dealt into chunks of about CHUNK_BYTES once (one shuffle of the texts, used three times). A chunk first
reduces its own digests to distinct ones, marked where they occur twice in it, and sends each bucket of the index those
that fall into it in one row: a passage in n documents costs at most one entry a chunk, however large n is. Buckets are
as many as the texts' bytes ask for, so a bucket's task is bounded and the rows do not depend on the number of
partitions. Answers come back as bit masks over a chunk's distinct digests. Probes are sent with four bytes; one that
collides only adds stretches that the 64-bit digest then rejects.

Defined results: null and empty texts have no words; fewer than WINDOW words cannot repeat; a stretch may repeat inside
its own document; rows that repeat a doc_id (null included) and text repeat each other; one very long text is a chunk of
its own and handled whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, grouped, partitions, read, small_batches
from .words import mix, text_slices, window_hashes, word_hashes, word_spans

WINDOW = 35
#: Text that a chunk of documents and a bucket of the index stand for, about.
CHUNK_BYTES, BUCKET_BYTES = 8 << 20, 16 << 20


class _Chunk:
    """The words of a chunk's rows, its probes and its stretches around hits; the order depends on the rows alone."""

    def __init__(self, rows: pa.Table, window: int):
        self.rows = rows.take(pa.array(np.argsort(rows["key"].to_numpy(), kind="stable")))
        self.window, self.block = window, (window + 1) // 2
        self.parts = []
        for first, data, off in text_slices(self.rows["text"]):
            starts, ends, ranges = word_spans(data, off)
            self.parts.append((first, data, starts, ends, ranges, word_hashes(data, starts, ends)))

    def probes(self) -> tuple[np.ndarray, np.ndarray]:
        """The rolling digests of BLOCK words, and which of them are reference blocks."""
        probes, blocks = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
        for *_, ranges, words in self.parts:
            h, at = window_hashes(words, ranges, self.block)
            probes.append(h)
            blocks.append((np.arange(len(h)) - np.repeat(at[:-1], np.diff(at))) % self.block == 0)
        return np.concatenate(probes), np.concatenate(blocks)

    def stretches(self, hits: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Digests of the WINDOW-word stretches with a hit in them, and for each part their first words."""
        out, firsts, used = [np.zeros(0, np.uint64)], [], 0
        for *_, ranges, words in self.parts:
            counts = np.maximum(np.diff(ranges) - self.block + 1, 0)
            mine = hits[used : used + counts.sum()]
            used += counts.sum()
            h, at = window_hashes(words, ranges, self.window)
            # stretch w of a row covers the probes w .. w + window - block of that row
            total = np.concatenate([[0], np.cumsum(mine)])
            n = np.diff(at)
            w = np.repeat(np.cumsum(counts) - counts - at[:-1], n) + np.arange(len(h))
            some = total[w + self.window - self.block + 1] > total[w]
            out.append(h[some])
            firsts.append((np.repeat(ranges[:-1] - at[:-1], n) + np.arange(len(h)))[some])
        return np.concatenate(out), firsts


class _Dealt:
    """A chunk's distinct digests in ascending order, and the range of each bucket of the index in them."""

    def __init__(self, values: np.ndarray, buckets: int):
        self.values, self.place, self.count = np.unique(values, return_inverse=True, return_counts=True)
        step = -(-(2**64) // buckets)
        edges = np.array([k * step for k in range(1, buckets)], np.uint64)
        self.edges = np.concatenate([[0], np.searchsorted(self.values, edges), [len(self.values)]])

    def rows(self, chunk: int, marked: np.ndarray | None, narrow: bool) -> pa.Table:
        """A row for each bucket that gets digests: the digests, which of them occur twice here, which are marked."""
        sent = mix(self.values).astype(np.uint32) if narrow else self.values
        twice = self.count > 1
        flag = np.zeros(len(sent), bool)
        if marked is not None:
            flag[self.place[marked]] = True
        cols: list[list] = [[], [], [], [], []]
        for k, (s, e) in enumerate(zip(self.edges[:-1].tolist(), self.edges[1:].tolist(), strict=True)):
            if e > s:
                for c, v in zip(cols, (k, chunk, sent[s:e].tobytes(), np.packbits(twice[s:e]).tobytes(), np.packbits(flag[s:e]).tobytes()), strict=True):
                    c.append(v)
        return pa.table([pa.array(c, t.type) for c, t in zip(cols, _SENT, strict=True)], schema=_SENT)

    def answered(self, answers: list[tuple[int, bytes]]) -> np.ndarray:
        """For each of the chunk's values, in their own order, whether a bucket's answer marks it."""
        mask = np.zeros(len(self.values), bool)
        for k, bits in answers:
            s, e = self.edges[k], self.edges[k + 1]
            mask[s:e] = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(e - s))
        return mask[self.place]


_SENT = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("digests", pa.binary()), ("twice", pa.binary()), ("marked", pa.binary())])
_SENT_DDL = "bucket bigint, chunk bigint, digests binary, twice binary, marked binary"


def _repeated(kind: int, narrow: bool):
    """In one bucket: the digests that occur twice or more (of probes, also in a reference block), as bits for each chunk."""

    def run(g: dict) -> list[tuple]:
        parts = [np.frombuffer(x, np.uint32 if narrow else np.uint64) for x in g["digests"]]
        bits = lambda name: np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)) for x, p in zip(g[name], parts, strict=True)])
        every = np.concatenate(parts)
        order = np.argsort(every, kind="stable")
        found = every[order]
        first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
        found = found[first]
        good = np.add.reduceat(1 + bits("twice")[order].astype(np.int64), first) > 1
        if narrow:
            good &= np.maximum.reduceat(bits("marked")[order], first) > 0
        found = found[good]
        if not len(found):
            return []
        out = []
        for chunk, p in zip(g["chunk"].tolist(), parts, strict=True):
            hit = found[np.minimum(np.searchsorted(found, p), len(found) - 1)] == p
            if hit.any():
                out.append((chunk, kind, int(g["bucket"][0]), np.packbits(hit).tobytes()))
        return out

    return run


_HITS = "chunk bigint, kind int, bucket bigint, bits binary"


def repeats(docs: DataFrame, emit: Callable, schema: str, text: str = "text", key: str = "doc_id", window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """emit(doc_id, words as bytes, mask of repeated words) -> tuple of schema, for every document; window must be odd."""
    if window % 2 == 0 or window < 3:
        raise ValueError("window must be odd, and three words or more")
    spark = docs.sparkSession
    small_batches(spark)
    whole = F.coalesce(F.col(text), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))
    chunks = max(partitions(spark), -(-size // chunk_bytes))
    keyed = docs.select(F.col(key).alias("doc_id"), whole.alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    # a row that is there many times is told apart only by where it is read
    dealt = keyed.withColumn("chunk", F.pmod(F.xxhash64("key", F.spark_partition_id()), F.lit(chunks))).repartition("chunk")
    out = pa.schema([(f.name, {"bigint": pa.int64(), "string": pa.string()}[f.dataType.simpleString()]) for f in _fields(schema)])

    def answers_of(answers: pa.Table, kind: int) -> list[tuple[int, bytes]]:
        return [(b, x) for k, b, x in zip(answers["kind"].to_pylist(), answers["bucket"].to_pylist(), answers["bits"].to_pylist(), strict=True) if k == kind]

    def probe(rows: pa.Table) -> pa.Table:
        values, blocks = _Chunk(rows, window).probes()
        sent = _Dealt(values, buckets).rows(rows["chunk"][0].as_py(), blocks, True)
        give_back()
        return sent

    def extended(c: _Chunk, answers: pa.Table):
        return c.stretches(_Dealt(c.probes()[0], buckets).answered(answers_of(answers, 0)))

    def extend(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows or not answers.num_rows:
            return _SENT.empty_table()
        digests, _ = extended(_Chunk(rows, window), answers)
        sent = _Dealt(digests, buckets).rows(rows["chunk"][0].as_py(), None, False)
        give_back()
        return sent

    def finish(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return out.empty_table()
        c = _Chunk(rows, window)
        digests, firsts = extended(c, answers)
        mask = _Dealt(digests, buckets).answered(answers_of(answers, 1))
        ids, result, used = c.rows["doc_id"].to_pylist(), [], 0
        for (first, data, starts, ends, ranges, words), at in zip(c.parts, firsts, strict=True):
            mine = at[mask[used : used + len(at)]]
            used += len(at)
            step = np.zeros(len(words) + 1, np.int32)
            np.add.at(step, mine, 1)
            np.add.at(step, mine + window, -1)
            gone = np.cumsum(step[:-1]) > 0
            raw = data.tobytes()
            for r in range(len(ranges) - 1):
                s, e = ranges[r], ranges[r + 1]
                result.append(emit(ids[first + r], [raw[a:b] for a, b in zip(starts[s:e].tolist(), ends[s:e].tolist(), strict=True)], gone[s:e]))
        made = pa.table([pa.array(x, t.type) for x, t in zip(zip(*result, strict=True), out, strict=True)], schema=out)
        give_back()
        return made

    sent = dealt.groupBy("chunk").applyInArrow(probe, _SENT_DDL)
    hits = grouped(sent, ["bucket"], _repeated(0, True), _HITS)
    far = dealt.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(extend, _SENT_DDL)
    masks = grouped(far, ["bucket"], _repeated(1, False), _HITS)
    return dealt.groupBy("chunk").cogroup(hits.union(masks).groupBy("chunk")).applyInArrow(finish, schema)


def _fields(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


def _digest(doc, words: list[bytes], gone: np.ndarray) -> tuple:
    kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if gone.any() else b" ".join(words)
    return doc, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest()


def _kept(doc, words: list[bytes], gone: np.ndarray) -> tuple:
    return doc, int(gone.sum()), b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g).decode(), _runs(gone)


def _runs(gone: np.ndarray) -> str:
    """The maximal runs of repeated words, as first:end, comma-joined."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    return ",".join(f"{s}:{e}" for s, e in edges.reshape(-1, 2).tolist())


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, **sizes: int) -> DataFrame:
    """doc_id, n_removed, the text that is left (words joined by one space) and the repeats' word ranges in the input."""
    return repeats(docs, _kept, "doc_id bigint, n_removed bigint, text string, spans string", text, key, window, **sizes)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(read(spark, sf_dir, "documents"), _digest, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")
