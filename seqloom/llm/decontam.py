"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

A document leaks an item if it holds a passage within an edit distance of ``EDITS`` percent of the item's length (both
in lower case, with white space collapsed). The CGK random walk copies a text into a longer one, stepping on or
staying by a shared random bit for each place and character, so that texts a few edits apart fall into step again
after each edit and differ in few places: edit distance becomes Hamming distance. Windows of a document as long as an
item (items are put into classes by length; a class is embedded up to its shortest item) start at its words, and every ``STRIDE`` characters in runs without a space that are
longer than what a window may be off its passage. A window
meets an item if it agrees with it on the sampled places of one of ``TABLES`` tables, and a bit-parallel
alignment of the item with the stretch about the window gives the exact distance.

Before embedding, stretches are passed over that cannot leak: a passage within k edits of an item of length L keeps at
least L - q + 1 - k q of its q-grams, counted here with a bitmap of all q-grams of the items. That is a necessary
condition, so it loses nothing, and the same count, of one item's q-grams, goes before an alignment. Many items that meet one
stretch, as those with a phrase in common do, are aligned with it together, their columns side by side in one long number, and only those
within their limit are aligned by themselves. Items too short for the condition are cut into one piece more than the edits they
may have; one of these stands in a text that leaks the item, so the others are passed over.

Items are gathered in groups of bounded size; with more items than one group holds, each group takes a pass over the
documents. Null or empty texts and items, and items without a character that is not white space, match nothing. Items
with equal texts are all reported. Repeated document ids count as one, and so do rows with a null id; items with a null id match nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import slices

EDITS = 6
GRAM = 9
TABLES = 64
PLACES = 3
STRIDE = 3
RATIO = 1.25
GROUP_BYTES = 16 << 20
BITS = 21
OWN = 1 << 12
#: Bytes of the columns that are aligned together, and how many items make it worth while.
PACK, FEW = 1 << 15, 4
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def chars(text: str) -> np.ndarray:
    """Characters as bytes; those beyond Latin-1 share its upper half. Only search uses this, distances use the characters."""
    try:
        return np.frombuffer(text.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return np.where(c < 256, c, 128 + (c * np.uint32(0x9E3779B1) >> np.uint32(25))).astype(np.uint8)


def starts_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where windows may start, and the length of the run that a start lies in; starts of words have more than any run."""
    first = np.concatenate(([0], np.flatnonzero(x[:-1] == 32) + 1))
    size = np.diff(np.append(first, len(x) + 1)) - 1
    more = np.maximum(size - 1, 0) // STRIDE
    at = np.repeat(first, more) + STRIDE * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1)
    every, run = np.concatenate([first, at]), np.concatenate([np.full(len(first), len(x) + 1), np.repeat(size, more)])
    order = np.argsort(every)
    return every[order], run[order]


def grams(x: np.ndarray) -> np.ndarray:
    """Places in the bitmap of the q-grams that start at each character: eight bytes as one word, and the rest."""
    n = len(x) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    word = x.astype(np.uint64)
    for step in (1, 2, 4):
        word = word[: len(word) - step] | (word[step:] << np.uint64(8 * step))
    h = word[:n] * MULTIPLIER
    for i in range(8, GRAM):
        h ^= h >> np.uint64(32)
        h += x[i : i + n]
        h *= MULTIPLIER
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def edits(length: int) -> int:
    """The largest distance that is a leak."""
    return length * EDITS // 100


def least_grams(length: int) -> int:
    """How many q-grams a leaked item keeps at least; 0 if the condition says nothing."""
    return max(0, length - GRAM + 1 - GRAM * edits(length))


@dataclass
class Walk:
    """A shared random walk over texts of ``length`` characters, and the sampled places of its tables."""

    length: int
    steps: np.ndarray  # places x 256: whether a character is left at that place
    places: np.ndarray  # tables x sampled places

    @classmethod
    def of(cls, length: int, seed: int = 3) -> Walk:
        rng = np.random.default_rng(seed + length)
        return cls(length, rng.integers(0, 2, (2 * length, 256)).astype(np.intp), rng.integers(0, 2 * length, (TABLES, PLACES)))

    def embed(self, rows: np.ndarray) -> np.ndarray:
        """The embedded rows; 0 once a row is used up."""
        n = len(rows)
        at, row = np.zeros(n, np.intp), np.arange(n)
        padded = np.concatenate([rows, np.zeros((n, 1), np.uint8)], 1)
        out = np.zeros((n, 2 * self.length), np.uint8)
        for j in range(2 * self.length):
            c = padded[row, at]
            out[:, j] = c
            at = np.minimum(at + self.steps[j, c], self.length)
        return out

    def keys(self, rows: np.ndarray) -> np.ndarray:
        """For each row and table a key of the sampled places."""
        e = self.embed(rows)[:, self.places].astype(np.int64)
        key = np.arange(TABLES)[None]
        for i in range(PLACES):
            key = key * 257 + e[:, :, i]
        return key


def distance(item: str, text: str) -> tuple[int, int]:
    """The least edit distance of the item to any passage of the text, and where the first such passage ends."""
    n = len(item)
    where: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        where[c] |= 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score, best, end = full, 0, n, n, 0
    for j, c in enumerate(text, 1):
        eq = where.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | (full & ~(diagonal | up)), up & diagonal
        score += 1 if plus & top else -1 if minus & top else 0
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = minus | (full & ~(diagonal | plus)), plus & diagonal
        if score < best:
            best, end = score, j
    return best, end


@lru_cache(1 << 12)
def columns(item: str) -> tuple[int, dict[str, bytes]]:
    """Bytes that the item takes in a long number, with a bit to spare, and the places of each of its characters."""
    where: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        where[c] |= 1 << i
    width = len(item) // 8 + 1
    return width, {c: m.to_bytes(width, "little") for c, m in where.items()}


def close(items: list[str], text: str) -> list[bool]:
    """Which items have a passage of the text within their limit; all are aligned at once.

    The columns of the items lie side by side, each with a spare bit that takes what an addition carries. How far an item is above its limit
    is a number in two's complement whose bits, at the place of the item's last character, lie in one long number each.
    """
    made = [columns(item) for item in items]
    widths = [w for w, _ in made]
    join = lambda parts: int.from_bytes(b"".join(parts), "little")
    full = join(((1 << len(i)) - 1).to_bytes(w, "little") for i, w in zip(items, widths, strict=True))
    lasts = [(1 << len(i) - 1).to_bytes(w, "little") for i, w in zip(items, widths, strict=True)]
    top, none = join(lasts), [bytes(w) for w in widths]
    where = {c: join(m.get(c, z) for (_, m), z in zip(made, none, strict=True)) for c in set(text)}
    above = [len(i) - edits(len(i)) - 1 for i in items]
    planes = [join(m if v >> b & 1 else z for m, z, v in zip(lasts, none, above, strict=True)) for b in range(max(above).bit_length() + 2)]
    up, down, hit = full, 0, planes[-1]
    for c in text:
        eq = where[c]
        diagonal = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | (full & ~(diagonal | up)), up & diagonal
        more, less = plus & top, minus & top
        for b in range(len(planes)):  # a carry out of the last one turns -1 to 0
            if not more and not less:
                break
            bits = planes[b]
            planes[b] = bits ^ more ^ less
            more, less = bits & more, ~bits & less
        hit |= planes[-1]
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = minus | (full & ~(diagonal | plus)), plus & diagonal
    out, at = [], 0
    for item, w in zip(items, widths, strict=True):
        out.append(bool(hit >> at + len(item) - 1 & 1))
        at += 8 * w
    return out


class Finder:
    """Items ready for search."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.items = [(i, t) for i, t in ((i, normal(t)) for i, t in items) if t]
        self.short = [k for k, (_, t) in enumerate(self.items) if not least_grams(len(t))]
        self.pieces: dict[int, dict[str, list[int]]] = defaultdict(lambda: defaultdict(list))
        for k in self.short:
            item = self.items[k][1]
            n, parts = len(item), edits(len(item)) + 1
            for j in range(parts):
                piece = item[n * j // parts : n * (j + 1) // parts]
                self.pieces[len(piece)][piece].append(k)
        rest = sorted((k for k in range(len(self.items)) if least_grams(len(self.items[k][1]))), key=lambda k: len(self.items[k][1]))
        self.bits = np.zeros(1 << BITS if rest else 1, bool)
        self.own: dict[int, np.ndarray] = {}
        self.classes: list[tuple[Walk, dict[int, list[int]], int, int]] = []
        while rest:
            length = len(self.items[rest[0]][1])
            own = [k for k in rest if len(self.items[k][1]) <= length * RATIO]
            rest = rest[len(own) :]
            walk = Walk.of(length)
            table: dict[int, list[int]] = defaultdict(list)
            for k, keys in zip(own, walk.keys(np.array([chars(self.items[k][1])[:length] for k in own])).tolist(), strict=True):
                for key in set(keys):
                    table[key].append(k)
                found = grams(chars(self.items[k][1]))
                self.bits[found] = True
                self.own[k] = np.zeros(OWN, bool)
                self.own[k][found & (OWN - 1)] = True
            longest = max(len(self.items[k][1]) for k in own)
            self.classes.append((walk, dict(table), longest + edits(longest), min(least_grams(len(self.items[k][1])) for k in own)))

        self.least = min((c[3] for c in self.classes), default=0)
        self.reach = max((c[2] + 2 * edits(c[0].length) + 2 for c in self.classes), default=0)

    def most_hits(self, total: np.ndarray) -> int:
        """No fewer than the hits of any stretch that a window may look at, from sums at every 64th place."""
        coarse, span = total[::64], -(-self.reach // 64) + 1
        return int(total[-1] if len(coarse) <= span else max((coarse[span:] - coarse[:-span]).max(), total[-1] - coarse[-span]))

    def short_in(self, text: str) -> list[int]:
        """The short items of which a piece stands in the text."""
        met: set[int] = set()
        for size, known in self.pieces.items():
            for piece in known.keys() & {text[i : i + size] for i in range(len(text) - size + 1)}:
                met.update(known[piece])
        return sorted(met)

    def within(self, text: str, asked: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
        """Of (from, to, item) those that may hold a leak; items that ask for stretches about one place are aligned together."""
        asked, a = sorted(asked), 0
        while a < len(asked):
            lo, hi = asked[a][:2]
            b, size = a, 0
            while b < len(asked) and size < PACK and asked[b][0] < hi and max(hi, asked[b][1]) - lo <= 2 * (asked[a][1] - lo):
                hi = max(hi, asked[b][1])
                size += len(self.items[asked[b][2]][1]) // 8 + 1
                b += 1
            own = asked[a:b]
            if len(own) < FEW:
                yield from own
            else:
                kept = close([self.items[k][1] for _, _, k in own], text[lo:hi])
                yield from (x for x, keep in zip(own, kept, strict=True) if keep)
            a = b

    def find(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """(text, item id, distance, end of the passage in the normal text) of every leak."""
        out = []
        windows: list[list[tuple[int, str, int]]] = [[] for _ in self.classes]
        codes: dict[int, np.ndarray] = {}
        for t, text in enumerate(texts):
            text = normal(text)
            for k in self.short_in(text):
                i, item = self.items[k]
                d, end = (0, text.find(item) + len(item)) if not edits(len(item)) else distance(item, text)
                if d <= edits(len(item)) and (d or item in text):
                    out.append((t, i, d, end))
            if not self.classes or len(text) < GRAM:
                continue
            x = chars(text)
            g = grams(x)
            hit = self.bits[g]
            total = np.concatenate(([0], np.cumsum(hit)))
            if self.most_hits(total) < self.least:
                continue
            every, run = starts_of(x)
            for c, (walk, _, span, least) in enumerate(self.classes):
                # a passage may start up to k characters before the word it is seen from
                lead = edits(walk.length) + 1
                starts = every[run > lead]
                a, b = np.clip(starts - lead, 0, len(hit)), np.minimum(starts + span + lead, len(hit))
                for s in starts[(total[b] - total[np.minimum(a, b)] >= least) & (starts + walk.length // 2 <= len(x))].tolist():
                    windows[c].append((t, text, s))
                    if t not in codes:
                        codes[t] = (g & (OWN - 1)).astype(np.uint16)
        for (walk, table, span, _), own in zip(self.classes, windows, strict=True):
            for a in range(0, len(own), 4096):
                part = own[a : a + 4096]
                rows = np.zeros((len(part), walk.length), np.uint8)
                for r, (_, text, s) in enumerate(part):
                    x = chars(text[s : s + walk.length])
                    rows[r, : len(x)] = x
                met: dict[tuple[int, int], list[int]] = defaultdict(list)
                for (t, _, s), keys in zip(part, walk.keys(rows).tolist(), strict=True):
                    for key in keys:
                        for k in table.get(key, ()):
                            met[t, k].append(s)
                texts_of = {t: text for t, text, _ in part}
                asked: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
                for (t, k), at in met.items():
                    size = len(self.items[k][1])
                    margin = size // 4 + 16
                    for lo, hi in stretches(sorted(set(at)), size + margin):
                        lo = max(0, lo - margin)
                        if np.count_nonzero(self.own[k][codes[t][lo:hi]]) >= least_grams(size):
                            asked[t].append((lo, hi, k))
                best: dict[tuple[int, int], tuple[int, int]] = {}
                for t, wanted in asked.items():
                    for lo, hi, k in self.within(texts_of[t], wanted):
                        item = self.items[k][1]
                        d, end = distance(item, texts_of[t][lo:hi])
                        if d <= edits(len(item)) and ((t, k) not in best or d < best[t, k][0]):
                            best[t, k] = (d, lo + end)
                out += [(t, self.items[k][0], *found) for (t, k), found in best.items()]
        return out


_last: list = [None, None]


def finder_of(group: list[tuple[int, str]]) -> Finder:
    """The finder of a group, made once in a worker for the group that it met last."""
    if _last[0] is not group:
        _last[:] = group, Finder(group)
    return _last[1]


def stretches(starts: list[int], span: int) -> Iterator[tuple[int, int]]:
    """The union of the spans from each start, as intervals."""
    lo = hi = None
    for s in starts:
        if hi is not None and s <= hi:
            hi = s + span
        else:
            if hi is not None:
                yield lo, hi
            lo, hi = s, s + span
    if hi is not None:
        yield lo, hi


def groups(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items in groups of bounded size."""
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("item_id is not null and text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // GROUP_BYTES)
    for g in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == g)
        yield sorted(set(map(tuple, part.collect())))


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """id, item_id, the least distance, and where the first such passage ends in the normal text; one row a pair."""
    spark = docs.sparkSession
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, item_id long, distance int, ends_at long"
    parts = []
    for group in groups(items, item_col, item_text):
        shared = spark.sparkContext.broadcast(group)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = finder_of(shared.value)
            for batch in slices(batches, 1000):
                got = finder.find(batch.column(1).to_pylist())
                ids = batch.column(0).take(pa.array([g[0] for g in got], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([g[k] for g in got], t) for k, t in ((1, pa.int64()), (2, pa.int32()), (3, pa.int64())))], ["doc_id", "item_id", "distance", "ends_at"])

        parts.append(picked.mapInArrow(run, schema))
    if not parts:
        return spark.createDataFrame([], schema).withColumnRenamed("doc_id", id_col)
    found = reduce(DataFrame.unionByName, parts).groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "ends_at")).alias("m"))
    return found.select(F.col("doc_id").alias(id_col), "item_id", "m.distance", "m.ends_at")


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` without a leak, with all their columns."""
    at = docs.columns.index(text_col)
    for group in groups(items, item_col, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(group)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = finder_of(shared.value)
            for batch in slices(batches, 1000):
                leaks = {g[0] for g in finder.find(batch.column(at).to_pylist())}
                yield batch.take(pa.array([i for i in range(batch.num_rows) if i not in leaks], pa.int64()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
