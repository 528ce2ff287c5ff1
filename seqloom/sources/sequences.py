"""Where sequences come from: raw files, tables of text, and the choice of a reference sequence.

The reference sequence is sequence 0. It is the one object that every task holds, so its length is checked.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import symbols
from seqloom.scratch import qualified

#: Symbols of a reference sequence at most: what one string of a row holds.
MOST_SYMBOLS = 2_000_000_000
HEAD = 10
#: The symbol of each first byte of a character in a text.
AS_SYMBOLS = np.full(256, ord("n"), np.uint8)
AS_SYMBOLS[list(symbols.LETTERS.encode())] = list(symbols.AS_BASES.encode())


@dataclass
class Collection:
    """The reference sequence and the targets (seq_id, name, seq), seq_id from 1 on; ``texts``: the same rows with any texts that are read as sequences."""

    ref: bytes
    targets: DataFrame
    texts: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.targets.sparkSession

    def sequences(self) -> DataFrame:
        """All sequences (seq_id, name, seq, len), the reference sequence as number 0."""
        first = self.spark.createDataFrame([(0, "reference", self.ref.decode())], "seq_id long, name string, seq string")
        return first.unionByName(self.targets).withColumn("len", F.length("seq").cast("long"))


    def raw(self, *columns: str) -> DataFrame:
        """Columns and the text of the targets, for Python steps, which take the symbols by ``symbols``."""
        if self.texts is not None:
            return self.texts.select(*columns, F.col("seq").alias("text"))
        return self.targets.select(*columns, F.lower("seq").alias("text"))

    def sizes(self) -> DataFrame:
        """seq_id and len of the targets."""
        return (self.targets if self.texts is None else self.texts).select("seq_id", F.length("seq").cast("long").alias("len"))

    def symbols(self) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
        """What gives the symbols of a column of texts and where each text starts in them; it is sent to tasks, without the tables."""
        return text_bytes if self.texts is None else text_symbols


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts, and where each one starts in them; null is an empty text."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def text_symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The same of any texts, read as sequences as ``symbols.sanitize_text`` does: a symbol for each character."""
    data, bounds = text_bytes(column)
    more = (data & 0xC0) == 0x80  # the bytes of a character behind its first
    if more.any():
        bounds = bounds - np.concatenate(([0], np.cumsum(more)))[bounds]
        data = data[~more]
    return AS_SYMBOLS[data], bounds


def bounded(ref: str) -> bytes:
    if len(ref) > MOST_SYMBOLS:
        raise ValueError(f"a reference sequence of {len(ref)} symbols; at most {MOST_SYMBOLS} fit a row")
    return ref.encode("ascii")


def from_documents(docs: DataFrame, head: int = HEAD, id_col: str = "doc_id", text_col: str = "text") -> Collection:
    """Texts as sequences. The first ``head`` by id, joined by n, are the reference sequence; the others are targets.

    Null text is an empty sequence; rows without an id are left out. The sequence of id i has number i + 1.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    seq = symbols.sanitize_text(F.col("text")).alias("seq")
    first = rows.orderBy("id").limit(head).select("id", seq).collect()  # only these texts are read as sequences here
    others = rows.where(~F.col("id").isin([r["id"] for r in first])) if first else rows
    targets, texts = (others.select((F.col("id") + 1).alias("seq_id"), F.concat(F.lit("doc"), F.col("id")).alias("name"), s.alias("seq")) for s in (seq, F.col("text")))
    return Collection(bounded("n".join(r["seq"] for r in first)), targets, texts)


def read_files(spark: SparkSession, paths: list[str], clean: bool = False) -> Collection:
    """One raw sequence a file, the first one the reference sequence. Symbols outside acgtn fail, or become n with ``clean``."""
    # one scan of all files, numbered by a join with the order of their paths
    order = spark.createDataFrame([(i, qualified(spark, p)) for i, p in enumerate(paths)], "seq_id long, path string")
    raw = spark.read.format("binaryFile").load(list(dict.fromkeys(paths)))
    one_form = F.regexp_replace("path", "^file:/+", "file:///")
    parts = raw.select(one_form.alias("path"), F.element_at(F.split("path", "/"), -1).alias("name"), F.decode("content", "ISO-8859-1").alias("raw")).join(F.broadcast(order), "path")
    seq = symbols.sanitize(F.col("raw")) if clean else symbols.checked(F.col("raw"), F.col("name"))
    rows = parts.select("seq_id", "name", seq.alias("seq"))
    ref = rows.where("seq_id = 0").first()["seq"]
    return Collection(bounded(ref), rows.where("seq_id > 0"))


def write_files(rows: DataFrame, folder: str) -> int:
    """One file a row of (name, content); the number of files. A file appears under its name when it is complete."""

    target = qualified(rows.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(target)
        fs.create_dir(base, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = f"{base}/.{name}.{uuid.uuid4().hex}"
                with fs.open_output_stream(part, compression=None) as out:
                    out.write(content)
                fs.move(part, f"{base}/{name}")
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    return rows.select("name", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_texts(sequences: DataFrame, folder: str) -> int:
    """One raw file a sequence, by name, without a line end; the number of files."""
    return write_files(sequences.select("name", F.encode("seq", "US-ASCII").alias("content")), folder)
