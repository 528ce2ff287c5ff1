"""A reference sequence with its suffix array and packed words, made once and read by all workers.

The arrays are files in the folder that the cluster shares. Workers on the same file system map them, so that those of
one machine hold them once; others read them. A parser is kept in each worker for the reference sequence it met last.

Up to ``WHOLE`` symbols the driver sorts the suffixes. Longer sequences are sorted as a table, and tasks write the suffix array, in the
order of ranks, and the packed words as files of ``EACH`` rows. A place's match stands beside where its word belongs in the order of all
suffixes, so of the ranges only that one is searched, and equal matches in several ranges need no merging.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators.kernels import suffix_array
from seqloom.operators.matching import Parser
from seqloom.operators.ranges import Ranges
from seqloom.operators.running import ROWS
from seqloom.operators.suffixes import PIECE, first_words, suffix_ranks
from seqloom.scratch import qualified, release, shared_path, written

#: Symbols that the driver sorts at most; rows of one file of a longer sequence, which one task holds.
WHOLE = 64_000_000
EACH = 1 << 22
_places: dict[tuple[str, str], str] = {}


def digest(ref: bytes) -> str:
    return hashlib.sha256(ref).hexdigest()


def save(spark: SparkSession, ref: bytes, folder: str) -> None:
    """Write, to a folder with a scheme, the sequence, its suffix array and its words, by position and by rank."""
    if len(ref) > WHOLE:
        save_ranges(spark, ref, folder)
        return
    sa = suffix_array(ref)
    p = Parser(ref, sa)
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    for name, array in (("symbols", np.frombuffer(ref, np.uint8)), ("suffixes", sa), ("packed", p.packed), ("ranked", p.ranked)):
        _write(fs, f"{base}/{name}.npy", array)


def _write(fs: pafs.FileSystem, path: str, array: np.ndarray) -> None:
    with fs.open_output_stream(path, compression=None) as out:
        np.lib.format.write_array_header_1_0(out, np.lib.format.header_data_from_array_1_0(array))
        out.write(memoryview(np.ascontiguousarray(array)).cast("B") if array.size else b"")


def save_ranges(spark: SparkSession, ref: bytes, folder: str, each: int = EACH, every: int = ROWS, piece: int = PIECE) -> None:
    """The same in files of ``each`` rows, which tasks write from the table of suffix ranks; the driver holds the sequence alone."""
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    words = written(first_words(spark, ref, piece)[0], "words")
    ranks = suffix_ranks(spark, ref, every, piece)
    _write_ranges(words.withColumn("file", F.floor(F.col("pos") / each)), "pos", {"packed": ("key", np.int64)}, folder, each)
    kind = np.int32 if len(ref) < 1 << 31 else np.int64
    by_rank = ranks.join(words, "pos").withColumn("file", F.floor(F.col("rank") / each))
    _write_ranges(by_rank, "rank", {"suffixes": ("pos", kind), "ranked": ("key", np.int64)}, folder, each)
    release(words, ranks)
    _write(fs, f"{base}/symbols.npy", np.frombuffer(ref, np.uint8))


def _write_ranges(rows: DataFrame, order: str, columns: dict[str, tuple[str, type]], folder: str, each: int) -> None:
    """One file for each column and each value of ``file``, whose rows are ``each`` or, of the last, fewer. A file gets its name when it is complete."""

    def run(table: pa.Table) -> pa.Table:
        fs, base = pafs.FileSystem.from_uri(folder)
        k, at = table["file"][0].as_py(), table[order].to_numpy()
        for name, (column, kind) in columns.items():
            array = np.empty(len(at), kind)
            array[at - k * each] = table[column].to_numpy()
            part = f"{base}/.{name}.{uuid.uuid4().hex}"
            _write(fs, part, array)
            fs.move(part, f"{base}/{name}-{k:08d}.npy")
        return pa.table({"n": [len(at)]})

    picked = rows.select("file", order, *dict.fromkeys(c for c, _ in columns.values() if c != order))
    picked.groupBy("file").applyInArrow(run, "n long").agg(F.sum("n")).collect()


def use(spark: SparkSession, ref: bytes, folder: str) -> str:
    """Take the saved files of a folder for this sequence from now on."""
    folder = qualified(spark, folder)
    _places[spark.sparkContext.applicationId, digest(ref)] = folder
    return folder


def stored(spark: SparkSession, ref: bytes) -> str:
    """Where the files of this sequence lie; they are written when it is met for the first time."""
    place = _places.get((spark.sparkContext.applicationId, digest(ref)))
    if place is None:
        place = qualified(spark, shared_path(spark, "reference"))
        save(spark, ref, place)
        use(spark, ref, place)
    return place


@lru_cache(1)
def parser(folder: str) -> Parser:
    """The parser over saved files."""
    fs, base = pafs.FileSystem.from_uri(folder)

    def array(path: str) -> np.ndarray:
        if isinstance(fs, pafs.LocalFileSystem):
            try:
                return np.asarray(np.load(path, mmap_mode="r"))
            except ValueError:  # an empty array cannot be mapped
                return np.load(path)
        with fs.open_input_stream(path, compression=None) as source:
            return np.load(pa.BufferReader(source.read()))

    names = sorted(i.base_name for i in fs.get_file_info(pafs.FileSelector(base)) if i.base_name.endswith(".npy"))

    def whole(name: str) -> np.ndarray | Ranges:
        if f"{name}.npy" in names:
            return array(f"{base}/{name}.npy")
        return Ranges([array(f"{base}/{n}") for n in names if n.startswith(f"{name}-")])

    return Parser(whole("symbols").tobytes(), whole("suffixes"), whole("packed"), whole("ranked"))
