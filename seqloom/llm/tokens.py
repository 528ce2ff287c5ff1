"""Token counts: Arrow batches go in, lengths alone come out.

Texts are encoded in batches balanced by bytes. A text longer than ``piece_chars`` is split before a white-space
character that follows another character: no match of the byte-level pattern spans such a place and none looks
back over it, so the counts of the pieces add up to the count of the text. A tokenizer for which that does not
hold (a normalizer, another pre-tokenizer, a .model file) gets its texts whole.

Null texts count as empty (0 bytes, 0 tokens). Each row is counted by itself, so repeated ids stay apart.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import by_bytes, single_threaded, slices, texts_of, utf8_sizes

PIECE_CHARS = 1 << 18
BATCH_BYTES = 1 << 20


def splits_safely(spec: dict) -> bool:
    """Whether a tokenizers file may have its texts cut before white space: byte-level, with its pattern, unnormalized."""
    pre = spec.get("pre_tokenizer") or {}
    plain = all(not (t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"])) for t in spec.get("added_tokens", []))
    return plain and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")


def pieces(text: str, limit: int) -> Iterator[str]:
    """Parts of a text, each cut before the first white space after ``limit`` characters that follows another character."""
    start = 0
    while len(text) - start > limit:
        cut = start + limit
        while cut < len(text) and not (text[cut] in " \n" and not text[cut - 1].isspace()):
            cut += 1
        yield text[start:cut]
        start = cut
    if start < len(text) or not text:
        yield text[start:]


def load(path: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    """The counting function of a tokenizer file, and whether texts may be split for it."""
    single_threaded()
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], False
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        safe = splits_safely(json.load(f))
    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)], safe


def lengths(texts: list[str], count: Callable[[list[str]], list[int]], safe: bool, piece_chars: int = PIECE_CHARS) -> np.ndarray:
    """Tokens of each text."""
    parts: list[str] = []
    owner: list[int] = []
    for i, text in enumerate(texts):
        for part in pieces(text, piece_chars) if safe and len(text) > piece_chars else (text,):
            parts.append(part)
            owner.append(i)
    out = np.zeros(len(texts), dtype=np.int64)
    for a, b in by_bytes(utf8_sizes(parts), BATCH_BYTES):
        np.add.at(out, owner[a:b], count(parts[a:b]))
    return out


def count_tokens(docs: DataFrame, tokenizer: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc id, n_bytes, n_tokens and over_limit of every row; other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, safe = load(tokenizer)
        for batch in slices(batches):
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            tokens = lengths(texts_of(batch, "text"), count, safe)
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(tokens), pa.array(tokens > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "id long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
