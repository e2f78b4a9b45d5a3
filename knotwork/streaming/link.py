"""Linking a stream of records: every micro-batch is matched against the standing reference records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import linkage as L


def link_stream(records: DataFrame, reference: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, least: int = 0, margin: int = 0) -> StreamingQuery:
    """records and reference are normalised; a record's decision needs no state but the reference."""

    def batch(df: DataFrame, number: int) -> None:
        sink(L.accepted(L.best_per_record(L.candidates(reference.unionByName(df))), least, margin), number)

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
