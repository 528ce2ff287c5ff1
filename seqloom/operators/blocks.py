"""Parsing of long sequences in blocks, each a row of its own, so that one sequence is the work of many tasks.

A factor follows from the place where it starts. Every block is first parsed from a place a little before it, as if a factor started there: streams of
factors meet after a few, so where the first factor of the block starts is mostly right already. It is right for all once each block starts
where the one before it ends. Blocks that do not are parsed again from there, and so on until nothing changes; only their rows are written again.
A block that one factor covers has no factors and only passes the place on. A block carries so many symbols behind its end that its last factor
ends within them; if one does not, all is done again with more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from seqloom.scratch import release, small, written
from seqloom.sources import reference
from seqloom.sources.sequences import Collection, text_bytes

BLOCK, AHEAD = 1 << 20, 1 << 16
#: Bytes of pieces that leave a task together.
OUT = 1 << 22
LISTS = pa.list_(pa.int32())
PIECES = "seq_id long, block long, len long, base long, piece binary"
PARTS = "seq_id long, block long, entry long, exit long, open boolean, pos array<int>, size array<int>"
NAMES = [x.split()[0] for x in PARTS.split(", ")]
KEY, ENDS = ["seq_id", "block"], ["seq_id", "block", "entry", "exit"]


def pieces(c: Collection, block: int, ahead: int, behind: int) -> DataFrame:
    """seq_id, block, len (of the sequence), base and piece: the block's symbols and those beside it, and where they start; an empty sequence has one empty block."""

    symbols_of = c.symbols()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = symbols_of(batch.column(1))
            raw, at, n = data.tobytes(), bounds[:-1], np.diff(bounds)
            count = np.maximum(-(-n // block), 1)
            row = np.repeat(np.arange(len(n)), count)
            k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            low, high = np.maximum(k * block - behind, 0), np.minimum(n[row], (k + 1) * block + ahead)
            ids = batch.column(0).to_numpy()
            each = max(1, OUT // (block + ahead + behind))
            for a in range(0, len(row), each):
                r, own = row[a : a + each], slice(a, a + each)
                cut = [raw[x:y] for x, y in zip((at[r] + low[own]).tolist(), (at[r] + high[own]).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, (ids[r], k[own], n[r], low[own])), pa.array(cut, pa.binary())], [x.split()[0] for x in PIECES.split(", ")])

    return c.raw("seq_id").mapInArrow(run, PIECES)


@F.arrow_udf(ArrayType(LongType()))
def starts(entry: pa.Array, size: pa.Array) -> pa.Array:
    """Where factors start, from where the first one does and their lengths."""
    k, counts = size.flatten().to_numpy().astype(np.int64), np.diff(size.offsets.to_numpy())
    before = np.cumsum(k) - k
    first = np.append(before, 0)[np.minimum(np.cumsum(counts) - counts, len(k))]
    return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(counts))).astype(np.int32), pa.array(before + np.repeat(entry.to_numpy() - first, counts)))


def parse_blocks(c: Collection, block: int = BLOCK, ahead: int = AHEAD) -> DataFrame:
    """seq_id, block, pos, size, start (in the sequence): the same factors as ``factors.parse`` gives, those that start in a block in a row."""
    where = reference.stored(c.spark, c.ref)
    cut = pieces(c, block, ahead, min(block, ahead) // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks from their ``entry``, the first time from the start of their piece."""
        p = reference.parser(where)
        for batch in batches:
            if not batch.num_rows:
                continue
            data, bounds = text_bytes(batch.column(4))
            k, total, base, now = (batch.column(j).to_numpy(zero_copy_only=False) for j in (1, 2, 3, 5))
            # symbols before the entry are left out
            low = bounds[:-1] + np.maximum(now - base, 0).clip(0, np.diff(bounds))
            at, n = low - bounds[:-1] + base, bounds[1:] - low
            kept = np.repeat(np.stack([np.zeros(len(n), bool), np.ones(len(n), bool)], 1).ravel(), np.stack([low - bounds[:-1], n], 1).ravel())
            pos, size, start, counts = p.parse_texts(data[kept], np.concatenate(([0], np.cumsum(n))))
            last, out = np.cumsum(counts), []
            for row, (seq, b, t, place) in enumerate(zip(batch.column(0).to_pylist(), k.tolist(), total.tolist(), np.maximum(now, at).tolist(), strict=True)):
                own = slice(last[row] - counts[row], last[row])
                where_ = start[own] - (np.cumsum(n) - n)[row] + at[row]
                i, j = np.searchsorted(where_, (b * block, min((b + 1) * block, t)))
                ends = where_ + size[own]
                entry = int(where_[i]) if i < len(where_) else int(ends[-1]) if len(ends) else place
                exit_ = int(ends[j - 1]) if j > i else entry
                out.append((seq, b, entry, exit_, exit_ == int(at[row] + n[row]) < t, pos[own][i:j], size[own][i:j]))
            kinds = (*[pa.int64()] * 4, pa.bool_(), LISTS, LISTS)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], NAMES)

    done = written(cut.withColumn("entry", F.lit(-1).cast("long")).repartition(*KEY).mapInArrow(run, PARTS), "blocks")
    ends, again = done.select(*ENDS), None
    before = Window.partitionBy("seq_id").orderBy("block")
    latest = done
    while True:
        if latest.where("open").limit(1).count():
            release(done, *([again, ends] if again else []))
            return parse_blocks(c, block, 16 * ahead)
        moved = written(ends.select("seq_id", "block", "entry", F.coalesce(F.lag("exit").over(before), F.lit(0)).alias("now")).where("entry <> now").select(*KEY, F.col("now").alias("entry")), "moved")
        if not moved.limit(1).count():
            break
        latest = written(cut.join(small(moved), KEY).select(*cut.columns, "entry").repartition(*KEY).mapInArrow(run, PARTS), "again")
        keys = small(moved.select(*KEY))
        now = written(ends.join(keys, KEY, "left_anti").unionByName(latest.select(*ENDS)), "ends")
        all_ = latest if again is None else written(again.join(keys, KEY, "left_anti").unionByName(latest), "again")
        release(moved, *([again, ends, latest] if again else []))
        ends, again, latest = now, all_, all_
    rows = done if again is None else done.join(small(again.select(*KEY)), KEY, "left_anti").unionByName(again)
    lists = [F.col(x).cast("array<long>").alias(x) for x in ("pos", "size")]
    return rows.select(*KEY, *lists, starts("entry", "size").alias("start"))
