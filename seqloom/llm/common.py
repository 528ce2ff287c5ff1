"""What the operators share: scratch tables, size-checked joins, digests and byte-balanced batches."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.scratch import bounded_batches, release, remove, shared_path, spread
from seqloom.scratch import written as materialize

#: Rows of at most 8-byte keys that may be broadcast; beyond it a shuffle join is used.
BROADCAST_KEYS = 1_000_000

__all__ = ["BROADCAST_KEYS", "bounded_batches", "by_bytes", "crc_mod", "fresh_names", "materialize", "maybe_broadcast", "release", "remove", "shared_path", "single_threaded", "slices", "small_enough", "spread", "table", "texts_of", "utf8_sizes"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; a small one in few files is dealt over the cores."""
    bounded_batches(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def small_enough(keys: DataFrame, most: int = BROADCAST_KEYS) -> bool:
    """Whether a table of keys stays within the bound for a broadcast; reads at most one row more than that."""
    return keys.limit(most + 1).count() <= most


def maybe_broadcast(keys: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """The table, marked for a broadcast when its size was checked, else as it is (a shuffle join follows)."""
    return F.broadcast(keys) if small_enough(keys, most) else keys


def crc_mod(column: str, mod: int) -> Column:
    """crc32 of an id written as text, modulo a number of folds."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % mod


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """A column's strings; null counts as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def utf8_sizes(texts: Iterable[str]) -> Iterator[int]:
    """Bytes of each text in UTF-8."""
    return (len(t) if t.isascii() else len(t.encode()) for t in texts)


def by_bytes(sizes: Iterable[int], budget: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose sizes sum to about the budget; one larger item is a range of its own."""
    start = held = 0
    end = -1
    for end, size in enumerate(sizes):
        if end > start and held + size > budget:
            yield start, end
            start, held = end, 0
        held += size
    if end >= start:
        yield start, end + 1


def fresh_names(df: DataFrame, count: int) -> list[str]:
    """Names that no column of the table has."""
    used = {c.lower() for c in df.columns}
    return [n for n in (f"_c{k}" for k in range(len(used) + count)) if n not in used][:count]


def slices(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows, to bound what a task holds beside them."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def single_threaded() -> None:
    """Keep native libraries to the one core that a task owns."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("OMP_NUM_THREADS", "1")
