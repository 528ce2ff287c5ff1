"""Display requests and patterns as streams, against a saved or static set of parsed sequences. No state is kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from seqloom.operators import search

REQUESTS = "req_id long, seq_id long, start long, end long"
PATTERNS = "pattern_id long, pattern string"


def answer(stream: DataFrame, target: str, checkpoint: str, work: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Run each batch of a stream through ``work``; a batch that runs again replaces its own output."""

    def batch(df: DataFrame, number: int) -> None:
        work(df).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def display(stream: DataFrame, parsed: DataFrame, ref: bytes, target: str, checkpoint: str) -> StreamingQuery:
    return answer(stream, target, checkpoint, lambda df: search.display(parsed, ref, df))


def count(stream: DataFrame, parsed: DataFrame, ref: bytes, target: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    return answer(stream, target, checkpoint, lambda df: search.count(parsed, ref, df, mode))


def locate(stream: DataFrame, parsed: DataFrame, ref: bytes, target: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    return answer(stream, target, checkpoint, lambda df: search.locate(parsed, ref, df, mode))
