"""Shared pieces: shared-folder tables, sorted-run grouping in Arrow, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper bound of one Arrow batch sent to a Python worker.
BATCH_BYTES = 4 << 20
#: Row groups of written tables: a task holds one while it writes.
ROW_GROUP = 16 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one is made for a master on
    this machine alone; on a cluster that would lose rows, so it is an error there."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(f"/tmp/knotwork-{uuid.uuid4().hex}")
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as a Parquet table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> None:
    """Remove all tables and token files that were written to the shared folder: once results have been read."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    for name in ("tables", "tokens"):
        path = fs_path(f"{shared_dir(spark)}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A list of ids is broadcast up to so many rows (its rows are counted first, some 100 bytes each); beyond, it is joined by shuffle.
BROADCAST_ROWS = 500_000


def sized(ids: DataFrame) -> DataFrame:
    """ids, written and counted; marked for broadcast if they are few enough."""
    ids = written(ids)
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def small_batches(spark: SparkSession) -> None:
    """Bound what is read and handed to workers at once, so that long texts do not pile up. These are settings of the
    session: they hold for its later queries too."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "512")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _plain(column: pa.Array):
    """Numbers as numpy, the rest as Python lists."""
    if pa.types.is_integer(column.type) or pa.types.is_floating(column.type):
        return column.to_numpy(zero_copy_only=False)
    return column.to_pylist()


def _joined(parts: list):
    if len(parts) == 1:
        return parts[0]
    return np.concatenate(parts) if isinstance(parts[0], np.ndarray) else [x for p in parts for x in p]


def released(run: Callable) -> Callable:
    """A function for mapInArrow whose worker gives what it no longer needs back to the system when the task ends."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def grouped(df: DataFrame, keys: list[str], fn: Callable[[dict], list[tuple] | None], schema: str, order: tuple[str, ...] = ()) -> DataFrame:
    """Call fn once for each run of equal (integer) keys, with the run's columns; rows come back as tuples.

    One shuffle on the keys and a sort; only one group at a time is held, so groups must be bounded by the caller.
    """
    names = df.columns
    out = pa.schema([(f.name, _ARROW[f.dataType.simpleString()]) for f in _struct(schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []  # the pieces of the group that is open
        mark: tuple | None = None
        rows: list[tuple] = []

        def emit():
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

        def close():
            whole = {n: _joined([p[n] for p in held]) for n in names}
            held.clear()
            rows.extend(fn(whole) or ())

        for b in batches:
            if not b.num_rows:
                continue
            cols = {n: _plain(b.column(i)) for i, n in enumerate(names)}
            n = len(cols[keys[0]])
            change = np.zeros(n - 1, bool)
            for k in keys:
                change |= cols[k][1:] != cols[k][:-1]
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), n]
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                here = tuple(cols[k][s] for k in keys)
                if held and here != mark:
                    close()
                held.append({m: c[s:e] for m, c in cols.items()})
                mark = here
                if len(rows) >= 5000:
                    yield emit()
                    rows = []
        if held:
            close()
        if rows:
            yield emit()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(released(run), schema)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}


def _struct(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


def connected_components(edges: DataFrame) -> DataFrame:
    """Nodes of the edges (u, v) with the smallest node that each can reach: (node, component).

    Alternating large-star and small-star steps; every round is written to the shared folder. The edges stay in
    Spark throughout. The hub of a star is a join key with many rows, which adaptive skew joins may split.
    """
    spark = edges.sparkSession
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        now = written(small)
        if (new := _mark(now)) == mark:
            break
        mark = new
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]
