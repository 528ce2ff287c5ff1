"""Factor files: one encoded sequence each, text or binary, with or without literals and rising factors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import kernels
from seqloom.operators.running import running_sums
from seqloom.sources.sequences import write_files

ENDING = ".fac"
#: Factors of an output batch at most.
ROWS = 1 << 16


def encode(parsed: DataFrame, ref: bytes, text: bool = False, short: bool = False, liss: bool = False) -> DataFrame:
    """seq_id, name, content: the bytes of a factor file for each parsed sequence."""
    shared = parsed.sparkSession.sparkContext.broadcast(ref)
    make = kernels.encode_text if text else kernels.encode_binary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [make(shared.value, p, k, short, liss) for p, k in kernels.factor_lists(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary())], ["seq_id", "name", "content"])

    return parsed.select("seq_id", "name", "pos", "size").mapInArrow(run, "seq_id long, name string, content binary")


def factors(files: DataFrame, ref: bytes) -> DataFrame:
    """seq_id, fac_no, pos (null for literals), len, text of every factor of encoded files; the header says how to read."""
    shared = files.sparkSession.sparkContext.broadcast(ref)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seq_id, data in zip(batch.column(0), batch.column(1), strict=True):
                pos, size, texts, bounds = kernels.decode_arrays(shared.value, data.as_buffer().to_pybytes())
                for a in range(0, len(pos), ROWS):
                    p, k, at = pos[a : a + ROWS], size[a : a + ROWS], bounds[a : a + ROWS + 1]
                    text = pa.StringArray.from_buffers(len(p), pa.py_buffer((at - at[0]).astype(np.int32).tobytes()), pa.py_buffer(texts[at[0] : at[-1]].tobytes()))
                    ids, no = np.full(len(p), seq_id.as_py(), np.int64), np.arange(a, a + len(p))
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(no), pa.array(p, mask=p < 0), pa.array(k), text], ["seq_id", "fac_no", "pos", "len", "text"])

    return files.select("seq_id", "content").mapInArrow(run, "seq_id long, fac_no long, pos long, len long, text string")


def decode(files: DataFrame, ref: bytes) -> DataFrame:
    """seq_id, name, seq of encoded files."""
    shared = files.sparkSession.sparkContext.broadcast(ref)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = [kernels.decode_sequence(shared.value, d.as_buffer().to_pybytes()).decode() for d in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(seqs, pa.string())], ["seq_id", "name", "seq"])

    return files.select("seq_id", "name", "content").mapInArrow(run, "seq_id long, name string, seq string")


def write(files: DataFrame, folder: str) -> int:
    """One factor file a sequence, by its name with the ending .fac; the number of files."""
    return write_files(files.select(F.concat("name", F.lit(ENDING)).alias("name"), "content"), folder)


def read(spark: SparkSession, path: str) -> DataFrame:
    """seq_id, name, content of factor files in a folder or by a pattern; numbered from 1 in the order of their names."""
    raw = spark.read.format("binaryFile").load(path).select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.fac$", "").alias("name"), "content")
    names = running_sums(raw.select("name").distinct().withColumn("one", F.lit(1).cast("long")), "name", {"before": "one"}).select("name", (F.col("before") + 1).alias("seq_id"))
    return raw.join(names, "name").select("seq_id", "name", "content")
