"""Suffix sorting by prefix doubling over ranges of ranks, for a reference sequence that no single task sorts.

Suffixes are first ordered by a word of their first symbols. A row's place in an order is its place in a range of it plus the rows
of the ranges before, and equal keys share the place of the first of them. Those that still share one
are ordered by the pair of their own rank and the rank of the suffix that begins where their known symbols end; the known symbols double
each round. Every table is written to the shared folder; only the sizes of ranges, one row a range, are put in order in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.operators.matching import WORD_BITS, code_table, pack
from seqloom.operators.running import ROWS
from seqloom.scratch import release, small, written

#: Places of one task that makes the first words.
PIECE = 1 << 18


def first_words(spark: SparkSession, ref: bytes, piece: int = PIECE) -> tuple[DataFrame, int]:
    """(pos, key) of every suffix, the empty one too, and how many symbols a key holds. Tasks make the rows from pieces of the sequence."""
    codes, bits = code_table(ref)
    per, n = WORD_BITS // bits, len(ref)
    shared = spark.sparkContext.broadcast(ref)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                a, b = k * piece, min(n + 1, (k + 1) * piece)
                own = codes[np.frombuffer(shared.value, np.uint8, min(n, b + per) - a, a)] if a < n else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b)), pa.array(np.append(pack(own, bits, per), np.zeros(per + 1, np.int64))[: b - a])], ["pos", "key"])

    count = -(-(n + 1) // piece)
    return spark.range(0, count, 1, count).mapInArrow(run, "pos long, key long"), per


def shared_places(rows: DataFrame, by: list[str], every: int = ROWS) -> DataFrame:
    """Adds ``place``, how many rows have a smaller key: equal keys share it. Ranges are of about ``every`` rows."""
    ranges = max(1, -(-rows.count() // every))
    tagged = written(rows.repartitionByRange(ranges, *by).withColumn("_range", F.spark_partition_id()), "suffix-ranges")
    sizes = tagged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inner = F.rank().over(Window.partitionBy("_range").orderBy(*by))
    return tagged.join(small(bases), "_range").select(*rows.columns, (F.col("_base") + inner - 1).alias("place"))


def suffix_ranks(spark: SparkSession, ref: bytes, every: int = ROWS, piece: int = PIECE) -> DataFrame:
    """(rank, pos) of every suffix in order, the empty one first."""
    words, reach = first_words(spark, ref, piece)
    ranks = written(shared_places(words, ["key"], every).select("pos", F.col("place").alias("rank")), "ranks")
    while True:
        groups = ranks.groupBy("rank").agg(F.count("*").alias("c")).where("c > 1").select("rank")
        tied = written(ranks.join(groups, "rank"), "tied")
        if not tied.limit(1).count():
            release(tied)
            out = ranks.select("rank", "pos")
            out.scratch = ranks.scratch
            return out
        later = ranks.select((F.col("pos") - reach).alias("pos"), F.col("rank").alias("after"))
        # suffixes that end within the known symbols come first
        pairs = tied.join(later, "pos", "left").withColumn("after", F.coalesce("after", F.lit(-1)))
        placed = written(shared_places(pairs, ["rank", "after"], every), "placed")
        first = placed.groupBy("rank").agg(F.min("place").alias("first"))
        moved = placed.join(first, "rank").select("pos", (F.col("rank") + F.col("place") - F.col("first")).alias("rank"))
        done = ranks.join(tied.select("pos"), "pos", "left_anti").select("pos", "rank")
        after = written(done.unionByName(moved), "ranks")
        release(ranks, tied, placed)
        ranks, reach = after, 2 * reach
