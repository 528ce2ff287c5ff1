"""Fill-in-middle: texts cut at two seeded places into prefix, middle and suffix, and put in another order.

Where a text can be cut is a list of byte offsets, kept as an Elias-Fano code. It is made once for each different text:
texts that occur once are a group of their own and stay where they are read; those whose digest repeats are grouped by
digest and content, so equal texts are known to be equal and not only their digests, and meet their documents again by a join.
A text of very many documents meets them in parts of about ``PART_BYTES`` each. A document's cuts are
then two selections in the list of its text.

Places are counted in units: ``char`` (code points), ``word`` (a word and the white space behind it; ASCII white space) or ``line``. With n
units the prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) units and the middle after the larger, h1 to h4
being the first four groups of 8 hexadecimal digits of sha256 of the seed, a colon and the id. A text stays ``plain`` if it is
empty, holds one of the marks, or h3 % 100 is at least ``rate``; else it is ``spm`` if h4 % 100 is below ``spm_rate`` and ``psm`` if not.

Null text counts as empty. A null id counts as an empty string in the seed. Rows that repeat an id are cut at the places of
that id, each in its own text. Of the input only ``doc_id`` and ``text`` are read, whatever other columns it has; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import by_bytes, materialize, maybe_broadcast

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
RATE, SPM_RATE = 90, 20
#: Documents of one text that are written by one task, in bytes of their output.
PART_BYTES = 32 << 20
#: Bytes of texts of one output batch.
BATCH_BYTES = 8 << 20
#: Ones of the upper bits between two samples of the selection.
STEP = 512
HEAD = struct.Struct("<QBII")
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


class EliasFano:
    """A rising list: the lower bits of each number as they are, the upper ones in unary, with samples for selection."""

    def __init__(self, size: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.size, self.low_bits, self.low, self.high, self.samples = size, low_bits, low, high, samples

    @classmethod
    def of(cls, numbers: np.ndarray) -> EliasFano:
        size = len(numbers)
        top = int(numbers[-1]) if size else 0
        low_bits = max(0, ((top + 1) // max(size, 1)).bit_length() - 1)
        numbers = numbers.astype(np.int64)
        ones = (numbers >> low_bits) + np.arange(size)
        bits = np.zeros(int(ones[-1]) + 1 if size else 0, np.uint8)
        bits[ones] = 1
        low = ((numbers[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8).ravel() if low_bits else np.zeros(0, np.uint8)
        return cls(size, low_bits, np.packbits(low, bitorder="little"), np.packbits(bits, bitorder="little"), ones[::STEP].astype("<u4" if size and ones[-1] < 1 << 32 else "<u8"))

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, i: int) -> int:
        """The i-th number, from the upper bits behind the sample before it."""
        if not 0 <= i < self.size:
            raise IndexError(i)
        start, left = int(self.samples[i // STEP]), i % STEP
        at, width = start >> 3, 2 * STEP // 8
        while True:
            ones = np.flatnonzero(np.unpackbits(self.high[at : at + width], bitorder="little"))
            ones = ones[ones >= (start & 7)]
            if len(ones) > left:
                break
            width *= 2
        upper = 8 * at + int(ones[left]) - i
        lower = 0
        for k in range(self.low_bits):
            bit = i * self.low_bits + k
            lower |= (int(self.low[bit >> 3]) >> (bit & 7) & 1) << k
        return upper << self.low_bits | lower

    def dump(self) -> bytes:
        return HEAD.pack(self.size, self.low_bits | (self.samples.dtype.itemsize == 8) << 7, len(self.low), len(self.samples)) + self.low.tobytes() + self.samples.tobytes() + self.high.tobytes()

    @classmethod
    def load(cls, raw: bytes) -> EliasFano:
        size, kind, low, samples = HEAD.unpack_from(raw)
        at, width = HEAD.size, 8 if kind >> 7 else 4
        parts = np.frombuffer(raw, np.uint8, low, at)
        picked = np.frombuffer(raw, f"<u{width}", samples, at + low)
        return cls(size, kind & 127, parts, np.frombuffer(raw, np.uint8, offset=at + low + samples * width), picked)


def boundaries(text: bytes, unit: str = "char") -> np.ndarray:
    """The byte offsets at which units end, 0 first; for an empty text 0 alone."""
    raw = np.frombuffer(text, np.uint8)
    if unit == "char":
        starts = np.flatnonzero((raw & 0xC0) != 0x80)
    elif unit == "word":
        gap = SPACE[raw]
        starts = np.flatnonzero(~gap[1:] & gap[:-1]) + 1
    elif unit == "line":
        starts = np.flatnonzero(raw[:-1] == 10) + 1
    else:
        raise ValueError(f"unit {unit}")
    starts = starts[starts > 0]
    return np.concatenate(([0], starts, [len(raw)] if len(raw) else [])).astype(np.int64)


def seeds(seed: int, doc_id: int | str | None) -> tuple[int, ...]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))


def chars(part: bytes) -> int:
    """Code points of a part of a text."""
    return len(part) if part.isascii() else int(np.count_nonzero((np.frombuffer(part, np.uint8) & 0xC0) != 0x80))


def cut(text: bytes, places: EliasFano, marked: bool, doc_id: int | str | None, seed: int, rate: int, spm_rate: int) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, code points of prefix and middle, output."""
    n = len(places) - 1
    h1, h2, h3, h4 = seeds(seed, doc_id)
    if not n or marked or h3 % 100 >= rate:
        return n, "plain", None, None, text
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = places[i], places[j]
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = MARKS
    spm = h4 % 100 < spm_rate
    out = s + suffix + p + prefix + m + middle if spm else p + prefix + s + suffix + m + middle
    return n, "spm" if spm else "psm", chars(prefix), chars(middle), out


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Outputs that are not plain hold each mark once, as their texts hold none."""

    def back(one: str, other: str) -> tuple[Column, Column, Column]:
        first = F.substring_index(F.substring(output, 4, 1 << 30), other, 1)
        rest = F.substring(output, F.length(first) + 7, F.lit(1 << 30))
        second = F.substring_index(rest, MIDDLE, 1)
        return first, second, F.substring(rest, F.length(second) + 4, F.lit(1 << 30))

    prefix, suffix, middle = back(PREFIX, SUFFIX)
    tail, head, core = back(SUFFIX, PREFIX)
    return F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix)).otherwise(F.concat(head, core, tail))


def index_texts(texts: DataFrame, unit: str) -> DataFrame:
    """Adds ``places``, the boundary list of each text, and ``marked``, whether the text holds a mark, to (digest, text, ...)."""
    names = [*texts.columns, "places", "marked"]
    at = texts.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(at).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([EliasFano.of(boundaries(t, unit)).dump() for t in data], pa.binary()), pa.array([any(m in t for m in MARKS) for t in data], pa.bool_())], names)

    return texts.mapInArrow(run, texts.select("*", F.lit(b"").alias("places"), F.lit(True).alias("marked")).schema)


def transform(docs: DataFrame, unit: str = "char", seed: int = 1, rate: int = RATE, spm_rate: int = SPM_RATE, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n (units), form, prefix_chars and middle_chars (null if plain), output of every row."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keys = rows.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").alias("size"))
    repeated = materialize(keys.groupBy("digest").agg(F.count("*").alias("n"), F.max("size").alias("size")).where("n > 1"), "repeated")
    few = maybe_broadcast(repeated.select("digest"))
    tagged = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    lone = tagged.join(few, "digest", "left_anti").select("doc_id", "text", F.lit(None).cast("binary").alias("places"), F.lit(False).alias("marked"))
    groups = tagged.join(few, "digest", "left_semi").groupBy("digest", "text").agg(F.count("*").alias("n"))
    index = materialize(index_texts(groups.select("digest", "text"), unit), "texts")
    if index.groupBy("digest").count().where("count > 1").limit(1).count():
        raise RuntimeError("two texts share a SHA-256 digest")
    # a text of many documents is copied for each part of them
    parts = F.least("n", F.ceil(F.col("n") * F.col("size") / part_bytes)).cast("int")
    heavy = maybe_broadcast(repeated.select("digest", parts.alias("parts")).where("parts > 1"))
    dealt = keys.join(few, "digest", "left_semi").join(heavy, "digest", "left").select("doc_id", "digest", F.pmod(F.xxhash64("doc_id"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    copied = index.join(heavy, "digest", "left").select("digest", "text", "places", "marked", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    met = dealt.join(copied, ["digest", "part"]).select("doc_id", "text", "places", "marked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for a, b in by_bytes(pc.binary_length(texts).to_pylist(), BATCH_BYTES):
                part = batch.slice(a, b - a)
                out = []
                for doc_id, text, places, marked in zip(part.column(0).to_pylist(), texts.slice(a, b - a).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    if places is None:
                        list_, marked = EliasFano.of(boundaries(text, unit)), any(m in text for m in MARKS)
                    else:
                        list_ = EliasFano.load(places)
                    out.append(cut(text, list_, marked, doc_id, seed, rate, spm_rate))
                n, form, prefix, middle, data = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(data, pa.binary()).cast(pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return lone.unionByName(met).mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
