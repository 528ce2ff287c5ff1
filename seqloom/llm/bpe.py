"""BPE encoding and decoding: speculate and verify.

Greedy longest match proposes tokens for a word. A proposal is the true encoding exactly if each token is what the
merges make of its own bytes and no adjacent pair would have been merged across its border. Both are tests on the
merge tree: step back in time from a pair of tokens, undoing the later merge first, and look whether the two
tokens then at the border have a merge that comes before the merges which consumed them. The test runs on arrays,
over the pairs of all new words at once; only words with a failing pair are merged exactly.

Null and empty texts have no tokens. Special strings inside a text become their added token, as is the library's
default, and decode to themselves.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import by_bytes, slices, texts_of, utf8_sizes
from seqloom.llm.tokens import PIECE_CHARS, pieces

#: Fixed value: the split of byte-level BPE, with white space as Unicode has it.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
NEVER = np.int64(1) << 40
CACHE_WORDS = 200_000
CHUNK_BYTES = 1 << 20


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte, reversed: bytes without a glyph are moved above 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Bpe:
    """A byte-level BPE vocabulary with its merge tree as arrays."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("only plain byte-level BPE files are supported")
        alphabet, vocab = byte_alphabet(), model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.text: list[bytes] = [b""] * size
        for token, i in vocab.items():
            if token not in self.special:
                self.text[i] = bytes(alphabet[c] for c in token)
        for token, i in self.special.items():
            self.text[i] = token.encode()
        self.rank, self.left, self.right = np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.size, self.merge = size, {}
        sound = True
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.merge.setdefault((x, y), (r, z))
            sound &= self.rank[z] < 0 and max(self.rank[x], self.rank[y]) < r
            self.rank[z], self.left[z], self.right[z] = r, x, y
        keys = np.array([x * size + y for x, y in self.merge], np.int64)
        ranks = np.array([r for r, _ in self.merge.values()], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = np.append(keys[order], NEVER * size), np.append(ranks[order], NEVER)
        made = np.flatnonzero(self.rank >= 0)
        apart = self.separate(self.left[made], self.right[made], self.rank[made])
        own = np.ones(size, bool)
        for i in np.argsort(self.rank[made]):
            t = made[i]
            own[t] = apart[i] and own[self.left[t]] and own[self.right[t]]
        special = set(self.special.values())
        #: What greedy matching may propose: tokens that the merges make of their own bytes.
        self.known = {self.text[i]: i for i in vocab.values() if i not in special and (sound and own[i] or len(self.text[i]) == 1)}
        self.bytes = [self.known[bytes([b])] for b in range(256)]
        self.longest = max(map(len, self.known))
        self.split = regex.compile(WORDS)
        self.seen: dict[str, bytes] = {}
        self.failed = 0

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair, NEVER where there is none."""
        key = a * self.size + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def separate(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge crosses the border of each pair of tokens, before the rank ``until`` if given."""
        ok = np.ones(len(a), bool)
        at = np.arange(len(a))
        end_a = np.full(len(a), NEVER) if until is None else until.copy()
        end_b = end_a.copy()
        while at.size:
            m = self.rank_of(a, b)
            # among equal ranks the leftmost pair merges first: that of the left token goes before, that of the right one after
            crossed = (m < end_a) & (m <= end_b) & (m < NEVER)
            ok[at[crossed]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~crossed & ((ra >= 0) | (rb >= 0))
            at, a, b, end_a, end_b, ra, rb = (x[go] for x in (at, a, b, end_a, end_b, ra, rb))
            back = ra > rb
            a, end_a, b, end_b = np.where(back, self.right[a], a), np.where(back, ra, end_a), np.where(back, b, self.left[b]), np.where(back, end_b, rb)
        return ok

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        known, out, at, n = self.known, [], 0, len(word)
        if (whole := known.get(word)) is not None:
            return [whole]
        while at < n:
            end = min(n, at + self.longest)
            while (token := known.get(word[at:end])) is None:
                end -= 1
            out.append(token)
            at = end
        return out

    def exact(self, word: bytes) -> list[int]:
        """The merges in their order, with a heap over a linked list."""
        ids = [self.bytes[b] for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := self.merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y, z = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], ids[j] = z, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := self.merge.get((z, ids[k])):
                    heapq.heappush(heap, (m[0], i, z, ids[k], m[1]))
            if (h := before[i]) >= 0 and (m := self.merge.get((ids[h], z))):
                heapq.heappush(heap, (m[0], h, ids[h], z, m[1]))
        return [x for x in ids if x >= 0]

    def learn(self, words: list[str]) -> None:
        """Encode words that are not in the cache."""
        raw = [w.encode() for w in words]
        found = [self.propose(w) for w in raw]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((t for x in found for t in x), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(found)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        bad = np.unique(owner[inner[~self.separate(flat[inner], flat[inner + 1])]])
        for i in bad.tolist():
            found[i] = self.exact(raw[i])
        self.failed += len(bad)
        for w, x in zip(words, found, strict=True):
            self.seen[w] = np.array(x, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        parts: list[list[str]] = []
        for text in texts:
            words: list[str] = []
            for piece in pieces(text, PIECE_CHARS):
                if self.at_special and self.at_special.search(piece):
                    for k, run in enumerate(self.at_special.split(piece)):
                        words.extend((f"\0{run}",) if k % 2 else self.split.findall(run))
                else:
                    words.extend(self.split.findall(piece))
            parts.append(words)
        if len(self.seen) > CACHE_WORDS:
            self.seen = {}
        for s, i in self.special.items():
            self.seen[f"\0{s}"] = np.array([i], "<u4").tobytes()
        fresh = set().union(*parts) - self.seen.keys()
        if fresh:
            self.learn(list(fresh))
        return [b"".join(map(self.seen.__getitem__, words)) for words in parts]

    def decode(self, ids: bytes) -> str:
        """The text of encoded ids; broken UTF-8 becomes the replacement character."""
        return b"".join(map(self.text.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", outputs: bool = False) -> DataFrame:
    """Per row: id, n_tokens, and SHA-256 digests of ids and decoded text; with ``outputs`` the ids and the decoded text too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(tokenizer)
        for batch in slices(batches):
            texts = texts_of(batch, "text")
            for a, b in by_bytes(utf8_sizes(texts), CHUNK_BYTES):
                ids = bpe.encode(texts[a:b])
                back = [bpe.decode(x) for x in ids]
                cols = [batch.column(0).slice(a, b - a), pa.array([len(x) // 4 for x in ids], pa.int64())]
                cols += [pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back])]
                if outputs:
                    cols += [pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names)

    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * outputs
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * outputs
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, schema).withColumnRenamed("id", id_col)
