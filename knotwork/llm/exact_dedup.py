"""Exact dedup over a sharded cuckoo-filter index of text digests.

Digests are reduced inside each map task by a small index, so a group of copies that holds a third of all rows reaches
its shard as one row a task. Shards are partitions of the digests, as many as their number asks for. A fingerprint hit
is only a hint: it is verified against the keys stored for that bucket (SHA-256 and length of the normalised text, which
stand in for the content: no text is sent or compared).

Defined results: null text counts as empty; a very long text is one digest, made whole inside its row; all empty texts are one group; equal length ties go to the smallest doc_id
(null ids last); rows that repeat one doc_id with one text are one document and carry the same verdict; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, read, released, sized, written

SLOTS, KICKS = 4, 200
#: Distinct digests that a map task gathers before it passes its partial groups on.
LOCAL_KEYS = 200_000
#: Rows that a shard's index is made for, about (some 300 bytes each if all are distinct).
SHARD_KEYS = 1_000_000


class CuckooIndex:
    """A cuckoo filter of 16-bit fingerprints whose slots point at stored keys (bytes of 16 or more, well mixed)."""

    def __init__(self, buckets: int = 1024):
        self.keys: list[bytes | None] = []
        self.free: list[int] = []
        self.size = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = array("H", bytes(2 * SLOTS * buckets))
        self.refs = array("i", bytes(4 * SLOTS * buckets))

    def _place(self, key: bytes) -> tuple[int, int]:
        return int.from_bytes(key[:8], "little") & self.mask, int.from_bytes(key[8:10], "little") or 1

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def _slot(self, key: bytes) -> int:
        bucket, mark = self._place(key)
        for b in (bucket, self._other(bucket, mark)):
            for at in range(b * SLOTS, b * SLOTS + SLOTS):
                if self.prints[at] == mark and self.keys[self.refs[at]] == key:  # a hit counts once the stored key agrees
                    return at
        return -1

    def find(self, key: bytes) -> int:
        """The key's record number, or -1."""
        at = self._slot(key)
        return self.refs[at] if at >= 0 else -1

    def insert(self, key: bytes) -> tuple[int, bool]:
        """(record number, whether it is new); record numbers of deleted keys are used again."""
        if (at := self._slot(key)) >= 0:
            return self.refs[at], False
        if self.free:
            ref = self.free.pop()
            self.keys[ref] = key
        else:
            ref = len(self.keys)
            self.keys.append(key)
        self.size += 1
        if not self._seat(key, ref):
            self._grow()
        return ref, True

    def delete(self, key: bytes) -> bool:
        if (at := self._slot(key)) < 0:
            return False
        self.prints[at] = 0
        ref = self.refs[at]
        self.keys[ref] = None
        self.free.append(ref)
        self.size -= 1
        return True

    def _seat(self, key: bytes, ref: int) -> bool:
        bucket, mark = self._place(key)
        for b in (bucket, self._other(bucket, mark)):
            for at in range(b * SLOTS, b * SLOTS + SLOTS):
                if not self.prints[at]:
                    self.prints[at], self.refs[at] = mark, ref
                    return True
        for kick in range(KICKS):
            at = bucket * SLOTS + (ref + kick) % SLOTS
            mark, self.prints[at] = self.prints[at], mark
            ref, self.refs[at] = self.refs[at], ref
            bucket = self._other(bucket, mark)
            for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.prints[at]:
                    self.prints[at], self.refs[at] = mark, ref
                    return True
        return False

    def _grow(self) -> None:
        """Double until all stored keys have a seat."""
        buckets = self.mask + 1
        seated = False
        while not seated:
            buckets *= 2
            self._clear(buckets)
            seated = all(self._seat(k, r) for r, k in enumerate(self.keys) if k is not None)


def digests(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_chars of the original text, and the stored key: SHA-256 and length of the text without white space."""
    whole = F.coalesce(F.col(text), F.lit(""))
    plain = F.regexp_replace(whole, r"[\x20\x09-\x0D]+", "")
    return docs.select(F.col(key).alias("doc_id"), F.length(whole).cast("long").alias("n_chars"), plain.alias("plain")).select(
        "doc_id", "n_chars", F.concat(F.unhex(F.sha2("plain", 256)), F.substring(F.unhex(F.lpad(F.hex(F.length("plain")), 8, "0")), 1, 4)).alias("digest")
    )


def _merge(local: bool):
    """Merge (digest, n, n_chars, doc_id) rows by digest in a cuckoo index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, count, best = CuckooIndex(), [], []

        def out():
            keys = index.keys
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(count, pa.int64()), pa.array([-b[0] for b in best], pa.int64()), pa.array([None if b[1] else b[2] for b in best], pa.int64())], ["digest", "n", "n_chars", "keep_id"])

        for b in batches:
            for key, n, size, doc in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                mine = (-size, doc is None, doc or 0)
                ref, new = index.insert(key)
                if new:
                    count.append(n)
                    best.append(mine)
                else:
                    count[ref] += n
                    if mine < best[ref]:
                        best[ref] = mine
            if local and len(count) >= LOCAL_KEYS:
                yield out()
                index, count, best = CuckooIndex(), [], []
        if count:
            yield out()

    return run


_GROUP = "digest binary, n bigint, n_chars bigint, keep_id bigint"


def exact_groups(rows: DataFrame) -> DataFrame:
    """One row a distinct digest: (digest, n, n_chars, keep_id), by local and then by sharded cuckoo indexes."""
    one = rows.select("digest", F.lit(1).cast("long").alias("n"), "n_chars", "doc_id")
    shards = max(partitions(rows.sparkSession), -(-rows.count() // SHARD_KEYS))
    return one.mapInArrow(released(_merge(True)), _GROUP).repartition(shards, "digest").mapInArrow(released(_merge(False)), _GROUP)


def apply_changes(live: DataFrame, changes: DataFrame) -> DataFrame:
    """Replay changes (seq, op 'insert' or 'delete', digest) in seq order over the live digests: the digests that live then.

    Deleting an absent digest and inserting a live one change nothing; an unknown or null op is ignored.
    """
    both = live.select(F.lit(-1).cast("long").alias("seq"), F.lit("insert").alias("op"), "digest").union(changes.select(F.col("seq").cast("long"), "op", "digest"))

    def run(batches):
        index = CuckooIndex()
        for b in batches:
            for op, key in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if op == "insert":
                    index.insert(key)
                elif op == "delete":
                    index.delete(key)
        yield pa.RecordBatch.from_arrays([pa.array([k for k in index.keys if k is not None], pa.binary())], ["digest"])

    return both.where("digest is not null").repartition("digest").sortWithinPartitions("seq").mapInArrow(run, "digest binary")


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = written(digests(docs, text, key))
    groups = exact_groups(rows).select("digest", F.col("n").alias("group_size"), F.col("n_chars").alias("keep_chars"), "keep_id")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))
    return rows.join(groups, "digest").select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex(F.substring("digest", 1, 32))).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    gone = sized(exact_dedup(docs).where("not kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct())
    sha = F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", ""), 256)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]) & (sha == gone["_sha"]), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""
