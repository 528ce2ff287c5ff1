"""Keys by which patterns meet factors: words of symbols beside the borders of factors, and dyadic parts of the reference sequence.

A hit lies in one factor, or has a first border between factors. A border has two words of up to 20 symbols: those of
the factor before it, from the border leftwards, and those behind it, over as many factors as it takes. A split of a
pattern has two words as well, so the longer part of it, or as many of its symbols as a word holds, is a key, and masks compare the rest.

What lies in one factor is a containment: an occurrence in the reference sequence and a factor that covers it. The reference sequence is
cut into cells of ``GRAIN`` symbols, cells into pairs, pairs into pairs of pairs and so on. A factor stands at the fewest of these
parts that cover it, at most two of each size, whatever its length; an occurrence asks at the part of each size that holds its start.

Words have three bits a symbol, the first symbol highest, and zeros behind the last, so that words in numeric order are texts
in order and the words that begin with some symbols are a range.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.matching import N, USUAL, Parser, Texts, pack, spans
from seqloom.sources import reference
from seqloom.sources.sequences import text_bytes

BITS, PER = 3, 20
#: Codes of symbols in words; any other symbol has one that no pattern has.
CODES = np.full(256, len(USUAL) + 1, np.int64)
CODES[list(USUAL)] = np.arange(1, len(USUAL) + 1)
#: Masks of the first 0 .. ``PER`` symbols.
HIGH = ((1 << BITS * PER) - 1) >> BITS * np.arange(PER, -1, -1) << BITS * np.arange(PER, -1, -1)
RUN_WORD = int(pack(np.full(PER, CODES[N]), BITS, PER)[0])
#: How many symbols of a part are its key: the most of these that it has.
CLASSES = np.array([1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 20])
GRAIN = 4  # as a power of two
LEVEL = 48
#: Keys of runs of n, and below it of single symbols that the reference sequence lacks.
RUN_KEY = -1
ROWS = 1 << 16
#: Pairs of a border and a split that are compared together.
PAIRS = 1 << 20

BORDERS = "seq_id long, at long, prev_len long, len long, meets_n boolean, left long, right long"
INSIDE = "key long, seq_id long, at long, pos long, len long"
SPLITS = "pattern_id long, m int, i int, tag int, key long, lo long, hi long, least long, left long, left_mask long, right long, right_mask long, more boolean"
POINTS = "pattern_id long, m int, key long, place long"


def names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def batches_of(columns: list[np.ndarray], schema: str) -> Iterator[pa.RecordBatch]:
    """Columns as batches of at most ``ROWS`` rows."""
    for a in range(0, len(columns[0]), ROWS):
        parts = [pa.array(c[a : a + ROWS]) for c in columns]
        yield pa.RecordBatch.from_arrays(parts, names(schema))


@lru_cache(1)
def reference_words(where: str) -> np.ndarray:
    """The word at each place of the reference sequence."""
    p = reference.parser(where)
    if set(p.ref) <= set(USUAL):
        return p.packed
    return np.append(pack(CODES[np.frombuffer(p.ref, np.uint8)], BITS, PER), 0)


def lists_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists of a column, and how many each list has; ``factors.packed`` lists are bytes of 32-bit numbers."""
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())
    bounds = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    values = np.frombuffer(column.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]] if len(column) else np.zeros(0, np.uint8)
    return values.view(np.int32).astype(np.int64), np.diff(bounds) // 4


def flat(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of parsed sequences (seq_id, pos, size): sequence, position, length and start of every factor, and where the factors of its sequence end."""
    (pos, counts), (size, _) = (lists_of(batch.column(c)) for c in (1, 2))
    stop, before = np.cumsum(counts), np.concatenate(([0], np.cumsum(size)))
    start = before[:-1] - np.repeat(before[stop - counts], counts)
    return np.repeat(batch.column(0).to_numpy(), counts), pos, size, start, np.repeat(stop, counts)


def words_from(words: np.ndarray, n: int, pos: np.ndarray, size: np.ndarray, stop: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The words that begin with factors ``own``, taken from as many factors of their sequences as they need."""
    out, have = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
    lanes, f = np.arange(len(own)), own.copy()
    while len(lanes):
        p = pos[f]
        part = np.where(p < 0, CODES[np.clip(-1 - p, 0, 255)] << BITS * (PER - 1), np.where(p == n, RUN_WORD, words[np.clip(p, 0, n)]))
        take = np.minimum(size[f], PER - have[lanes])
        out[lanes] |= (part & HIGH[take]) >> BITS * have[lanes]
        have[lanes] += take
        f = f + 1
        on = (have[lanes] < PER) & (f < stop[own[lanes]])
        lanes, f = lanes[on], f[on]
    return out


def words_before(words: np.ndarray, n: int, pos: np.ndarray, size: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The words of factors ``own`` read from their ends leftwards."""
    p, k = pos[own], size[own]
    end = np.where((p < 0) | (p == n), 0, p + k)
    reach = np.minimum(PER, end)
    w = words[end - reach] >> BITS * (PER - reach)
    out = np.zeros(len(own), np.int64)
    for _ in range(PER):
        out = out << BITS | w & (1 << BITS) - 1
        w = w >> BITS
    out = np.where(p < 0, CODES[np.clip(-1 - p, 0, 255)] << BITS * (PER - 1), np.where(p == n, RUN_WORD, out))
    return out & HIGH[np.minimum(k, PER)]


@dataclass
class Asked:
    """What splits ask of borders, those with a key of either side apart: the range of the key, both words with their masks, and the least length before."""

    right: tuple[np.ndarray, ...]
    left: tuple[np.ndarray, ...]

    @staticmethod
    def of(splits: DataFrame) -> Asked:
        """Of a table of bounded size."""
        columns = ["lo", "hi", "left", "left_mask", "right", "right_mask", "least"]
        got = splits.select((F.col("tag") > 0).alias("by_right"), *columns).distinct().toArrow()
        sides = (got.filter(pc.equal(got["by_right"], own)) for own in (True, False))
        return Asked(*(tuple(t[c].to_numpy() for c in columns) for t in sides))

    def met(self, left: np.ndarray, right: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Which borders, of their words and the length before them, some split asks for."""
        out = np.zeros(len(left), bool)
        for asked, word in ((self.right, right), (self.left, left)):
            order = np.argsort(word)
            ordered = word[order]
            first, stop = np.searchsorted(ordered, asked[0]), np.searchsorted(ordered, asked[1], "right")
            own = np.flatnonzero(stop > first)
            if not len(own):
                continue
            cuts = np.flatnonzero(np.diff(np.cumsum((stop - first)[own]) // PAIRS, prepend=-1))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(own)], strict=True):
                k = own[a:b]
                row, split = order[spans(first[k], (stop - first)[k])], np.repeat(k, (stop - first)[k])
                _, _, l, l_mask, r, r_mask, least = (x[split] for x in asked)
                out[row[((left[row] ^ l) & l_mask == 0) & ((right[row] ^ r) & r_mask == 0) & (before[row] >= least)]] = True
        return out


def borders(parsed: DataFrame, ref: bytes, asked: Asked | None = None, by: str | None = None, each: int = ROWS) -> DataFrame:
    """A row for each border between two factors of a sequence: where it is, the lengths beside it, and its words.

    ``asked``: only borders that some split asks for leave Python. ``by``: so many borders (``each``), one behind the other, are in the order of this column.
    """
    where = reference.stored(parsed.sparkSession, ref)
    shared = parsed.sparkSession.sparkContext.broadcast(asked) if asked else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = reference_words(where)
        n = len(words) - 1
        for batch in batches:
            seq, pos, size, start, stop = flat(batch)
            if not len(seq):
                continue
            own = np.flatnonzero(stop[1:] == stop[:-1]) + 1
            for a in range(0, len(own), each):
                j = own[a : a + each]
                left, right = words_before(words, n, pos, size, j - 1), words_from(words, n, pos, size, stop, j)
                if shared is not None:
                    kept = shared.value.met(left, right, size[j - 1])
                    j, left, right = j[kept], left[kept], right[kept]
                meets = (pos[j] == n) | (pos[j - 1] == n)
                columns = [seq[j], start[j], size[j - 1], size[j], meets, left, right]
                if by:
                    order = np.lexsort((start[j], seq[j], columns[names(BORDERS).index(by)]))
                    columns = [x[order] for x in columns]
                yield from batches_of(columns, BORDERS)

    return parsed.select("seq_id", "pos", "size").mapInArrow(run, BORDERS)


def parts(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For ranges of cells low .. high (exclusive) the fewest dyadic parts that make them up: which range, and the part's key."""
    lanes, low, high, level = np.arange(len(low)), low.copy(), high.copy(), 0
    while True:
        on = low < high
        lanes, low, high = lanes[on], low[on], high[on]
        if not len(lanes):
            return
        odd = (low & 1) == 1
        yield lanes[odd], level << LEVEL | low[odd]
        low = low + odd
        odd = ((high & 1) == 1) & (low < high)
        high = high - odd
        yield lanes[odd], level << LEVEL | high[odd]
        low, high, level = low >> 1, high >> 1, level + 1


@dataclass
class Held:
    """What points ask of factors: places in the reference sequence in order, and for each the least end of those from it on; keys of runs and literals."""

    place: np.ndarray
    end: np.ndarray
    keys: np.ndarray

    @staticmethod
    def of(points: DataFrame) -> Held:
        """Of a table of bounded size."""
        got = points.where(f"key >> {LEVEL} <= 0").select("key", "place", "m").distinct().toArrow()
        key, place, m = (got[c].to_numpy() for c in ("key", "place", "m"))
        usual = key >= 0
        place, end = place[usual], (place + m)[usual]
        order = np.argsort(place)
        return Held(place[order], np.minimum.accumulate(end[order][::-1])[::-1], np.unique(key[~usual]))

    def met(self, pos: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Which factors of the reference sequence hold one of the occurrences."""
        first = np.searchsorted(self.place, pos)
        return np.append(self.end, np.iinfo(np.int64).max)[first] <= pos + size


def inside(parsed: DataFrame, ref: bytes, least: int = 1, held: Held | None = None, ordered: int = 0) -> DataFrame:
    """A row for each part at which a factor of at least so many symbols stands; a run of n and a literal have one each.

    ``held``: only factors that some point asks for leave Python. ``ordered``: so many parts, one behind the other, are in the order of their keys.
    """
    where, n = reference.stored(parsed.sparkSession, ref), len(ref)
    shared = parsed.sparkSession.sparkContext.broadcast(held) if held else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seq, pos, size, start, _ = flat(batch)
            rows, keys = [], []
            plain = np.flatnonzero((pos >= 0) & (pos < n) & (size >= least))
            if shared is not None:
                plain = plain[shared.value.met(pos[plain], size[plain])]
            for lanes, key in parts(pos[plain] >> GRAIN, (pos[plain] + size[plain] - 1 >> GRAIN) + 1):
                rows.append(plain[lanes])
                keys.append(key)
            for own, key in ((np.flatnonzero(pos == n), lambda p: np.full(len(p), RUN_KEY)), (np.flatnonzero(pos < 0), lambda p: RUN_KEY + p)):
                own = own if shared is None else own[np.isin(key(pos[own]), shared.value.keys)]
                rows.append(own)
                keys.append(key(pos[own]))
            own, key = np.concatenate(rows), np.concatenate(keys).astype(np.int64)
            each = ordered or max(1, len(own))
            for a in range(0, len(own), each):
                j, k = own[a : a + each], key[a : a + each]
                if ordered:
                    order = np.lexsort((start[j], seq[j], k))
                    j, k = j[order], k[order]
                yield from batches_of([k, seq[j], start[j], pos[j], size[j]], INSIDE)

    assert where  # the files of the reference sequence are there before any task needs them
    return parsed.select("seq_id", "pos", "size").mapInArrow(run, INSIDE)


def split_places(p: Parser, t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where to look for the hits of patterns over borders: which pattern, at which split, and whether that may follow an earlier border.

    What stands before the first border of a hit lies in one factor, so it is no longer than the longest match of the pattern's
    start. From a border on the parse is known: if its factor ends within the pattern, there is the next border. So the borders from
    many splits on lead to few, and each hit is looked for once, at the last of its borders that has a whole word behind it,
    or at its first one if none has.
    """
    ends, m = t.bounds[1:], np.diff(t.bounds)
    _, size = p.matches(t, np.arange(t.n))
    size = np.where(size == 0, t.n, size)  # longer than a few words
    counts = np.minimum(size[t.bounds[:-1]], m - 1) if len(m) else m
    own = np.repeat(np.arange(len(m)), counts)
    at = t.bounds[own] + spans(np.ones(len(m), np.int64), counts)
    led = np.zeros(len(at), bool)
    while True:
        on = np.flatnonzero(at + size[at] <= ends[own] - PER)
        if not len(on):
            break
        at[on], led[on] = at[on] + size[at[on]], True
    order = np.lexsort((~led, at))
    own, at, led = own[order], at[order], led[order]
    one = np.diff(at, prepend=-1) > 0
    return own[one], at[one] - t.bounds[own[one]], led[one]


def splits(ref: bytes, patterns: DataFrame) -> DataFrame:
    """A row for each place at which a pattern (lower case, of the alphabet, not empty) may be parted by a border.

    ``tag`` says which side has the key and how many symbols, positive for the right side; ``lo`` .. ``hi`` are the words with that key;
    ``least``: symbols that the factor before the border has at least. ``more``: the words do not hold the whole pattern.
    """
    where = reference.stored(patterns.sparkSession, ref)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = reference.parser(where)
        for batch in batches:
            data, bounds = text_bytes(batch.column(1))
            m, n = np.diff(bounds), len(data)
            own, i, led = split_places(p, Texts(p, data, bounds))
            if not len(own):
                continue
            codes = CODES[data]
            at = bounds[own] + i
            left_size, right_size = np.where(led, 0, i), m[own] - i
            left_mask, right_mask = HIGH[np.minimum(left_size, PER)], HIGH[np.minimum(right_size, PER)]
            left, right = pack(codes[::-1], BITS, PER)[n - at] & left_mask, pack(codes, BITS, PER)[at] & right_mask
            by_right = right_size >= left_size
            size = CLASSES[np.searchsorted(CLASSES, np.minimum(np.maximum(left_size, right_size), PER), "right") - 1]
            lo = np.where(by_right, right, left) & HIGH[size]
            hi = lo | HIGH[PER] & ~HIGH[size]
            tag = np.where(by_right, size, -size).astype(np.int32)
            more = led | (left_size > PER) | (right_size > PER)
            ids = batch.column(0).to_numpy()[own]
            yield from batches_of([ids, m[own].astype(np.int32), i.astype(np.int32), tag, lo, lo, hi, left_size, left, left_mask, right, right_mask, more], SPLITS)

    return patterns.select("pattern_id", "pattern").mapInArrow(run, SPLITS)


def places(p: Parser, data: np.ndarray, bounds: np.ndarray, rows: int = ROWS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Where texts (none empty) stand in the reference sequence, about so many at a time: which text, and the place."""
    if len(bounds) < 2:
        return
    lo, hi = p.intervals(Texts(p, data, bounds), bounds[:-1], np.diff(bounds))
    pieces = -(-(hi - lo) // rows)
    own = np.repeat(np.arange(len(lo)), pieces)
    lo = lo[own] + rows * spans(np.zeros(len(pieces), np.int64), pieces)
    sizes = np.minimum(hi[own] - lo, rows)
    group = (np.cumsum(sizes) - sizes) // rows
    cuts = np.flatnonzero(np.diff(group, prepend=-1))
    if not len(own):
        return
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(own)], strict=True):
        yield np.repeat(own[a:b], sizes[a:b]), p.array[spans(lo[a:b], sizes[a:b])].astype(np.int64)


def points(ref: bytes, patterns: DataFrame) -> DataFrame:
    """A row for each part of the reference sequence at which a pattern (lower case, of the alphabet) asks for factors that hold it."""
    where = reference.stored(patterns.sparkSession, ref)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = reference.parser(where)
        levels = np.arange((len(p.ref) >> GRAIN).bit_length() + 1)
        lacking = np.array([c for c in USUAL if c not in p.ref], np.uint8)
        for batch in batches:
            data, bounds = text_bytes(batch.column(1))
            ids, m = batch.column(0).to_numpy(), np.diff(bounds)
            first = data[bounds[:-1]]
            n_before = np.concatenate(([0], np.cumsum(data == N)))
            n_of = n_before[bounds[1:]] - n_before[bounds[:-1]]
            alone = np.flatnonzero((n_of == m) | ((m == 1) & np.isin(first, lacking)))
            key = np.where(n_of == m, RUN_KEY, RUN_KEY - 1 - first.astype(np.int64))[alone]
            yield from batches_of([ids[alone], m[alone].astype(np.int32), key, np.zeros(len(alone), np.int64)], POINTS)
            usual = np.flatnonzero(n_of == 0)
            for own, place in places(p, data[spans(bounds[usual], m[usual])], np.concatenate(([0], np.cumsum(m[usual]))), ROWS // len(levels)):
                own, k = usual[own], len(levels)
                key = (levels[:, None] << LEVEL | place[None, :] >> (GRAIN + levels)[:, None]).ravel()
                yield from batches_of([np.tile(ids[own], k), np.tile(m[own].astype(np.int32), k), key, np.tile(place, k)], POINTS)

    return patterns.select("pattern_id", "pattern").mapInArrow(run, POINTS)


def ranges(asked: DataFrame, low: str, high: str) -> tuple[np.ndarray, np.ndarray]:
    """The ranges (low, high) that a table of bounded size asks for, by their start; ends are those of all ranges so far."""
    got = asked.select(F.col(low).alias("lo"), F.col(high).alias("hi")).distinct().toArrow()
    lo, hi = got["lo"].to_numpy(), got["hi"].to_numpy()
    by = np.argsort(lo)
    return lo[by], np.maximum.accumulate(hi[by]) if len(by) else hi


def merged(lo: np.ndarray, hi: np.ndarray, most: int) -> list[tuple[int, int]]:
    """At most so many ranges that cover all of them, parted at the widest gaps."""
    if not len(lo):
        return []
    gaps = lo[1:] - hi[:-1]
    cuts = np.sort(np.argsort(-gaps)[: most - 1])
    cuts = cuts[gaps[cuts] > 1]
    return list(zip(lo[np.append(0, cuts + 1)].tolist(), hi[np.append(cuts, len(hi) - 1)].tolist(), strict=True))
