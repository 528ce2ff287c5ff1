"""Greedy parsing against a reference sequence, for many places of many texts at once.

Symbols are numbered and packed into words of as many as fit 62 bits. The words of the suffixes, in suffix order, are a sorted array, so the match
of a place is found by a binary search of its own word: one of the two neighbours shares the most symbols, and the words
that begin with these are a range of ranks, of which the first counts. Where a whole word matches, the next words decide within the range.

A factor follows from the place where it starts alone. So texts are cut into blocks, and from the start of every block a stream of
factors is followed, all streams in step on arrays, until it leaves its block; then the places where streams
left are followed until they meet a factor that is known. Streams meet after a few factors. What remains is to walk from
factor to factor. Places whose match is longer than ``DEPTH`` words are left to that walk, which finds them one by one from bytes.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np

from seqloom.operators.ranges import Ranges

N = ord("n")
RUN = re.compile(rb"n+")
#: Symbols in the order of their codes, if the reference sequence has no others.
USUAL = b"acgnt"
WORD_BITS = 62
BLOCK = 1024
#: Factors that a stream follows within its block: with fewer the search for where streams meet weighs, with more there are few streams in step.
STREAM = 32
DEPTH = 4
#: Symbols that are parsed together, and those behind them that a match may reach into.
GROUP = 1 << 18
BEYOND = 1 << 12


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def code_table(ref: bytes) -> tuple[np.ndarray, int]:
    """The code of each byte, in byte order and 0 for those without one, and the bits that a code takes."""
    kinds = bytes(sorted(set(ref) | set(USUAL))) if set(ref) <= set(USUAL) else bytes(sorted(set(ref)))
    codes = np.zeros(256, np.int64)
    codes[list(kinds)] = np.arange(1, len(kinds) + 1)
    return codes, max(1, len(kinds).bit_length())


def pack(codes: np.ndarray, bits: int, per: int) -> np.ndarray:
    """For each place the codes of ``per`` symbols from there on in one number, zeros behind the end."""

    def moved(x: np.ndarray, k: int) -> np.ndarray:
        return np.concatenate((x[k:], np.zeros(min(k, len(x)), np.int64)))

    out, have, block, width = None, 0, codes.astype(np.int64), 1
    while per:
        if per & 1:
            out = block if out is None else block << bits * have | moved(out, width)
            have += width
        per >>= 1
        if per:
            block = block << bits * width | moved(block, width)
            width *= 2
    return out


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, .. for each start and size, one behind the other."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


class Texts:
    """Texts one behind the other, prepared for matching. ``open_end``: the last one goes on, so what reaches its end is not decided."""

    def __init__(self, p: Parser, data: np.ndarray, bounds: np.ndarray, open_end: bool = False) -> None:
        n = len(data)
        self.data, self.bounds, self.open_end, self.n = data, bounds, open_end, n
        codes = p.codes[data]
        self.words = pack(codes, p.bits, p.per)
        ends = bounds[1:][bounds[1:] > bounds[:-1]]
        every = np.arange(n, dtype=np.int64)
        self.stop = np.where((data == N) | (codes == 0), every, n)
        if n:
            self.stop[ends - 1] = np.minimum(self.stop[ends - 1], ends)
            self.stop = np.minimum.accumulate(self.stop[::-1])[::-1]
            self.run_end = self.stop
            if (data == N).any():
                run = np.where(data != N, every, n)
                run[ends - 1] = np.minimum(run[ends - 1], ends)
                self.run_end = np.minimum.accumulate(run[::-1])[::-1]


class Parser:
    """Parsing against one reference sequence, and the ranks and places of patterns in it. The arrays may be mapped from files, or be in ranges."""

    def __init__(self, ref: bytes, sa: np.ndarray | Ranges, packed: np.ndarray | Ranges | None = None, ranked: np.ndarray | Ranges | None = None) -> None:
        self.ref, self.array, self.sa = ref, sa, sa if isinstance(sa, Ranges) else memoryview(sa)
        self.codes, self.bits = code_table(ref)
        self.per = WORD_BITS // self.bits
        self.packed = self.pack_reference() if packed is None else packed
        self.ranked = self.packed[self.array] if ranked is None else ranked
        shifts = self.bits * (self.per - np.arange(self.per + 1))
        self.high = ((1 << self.bits * self.per) - 1) >> shifts << shifts  # masks of the first symbols
        self.steps = 1 << self.bits * np.arange(self.per)
        self.block = BLOCK  # of the next texts, from the factors of the last ones

    def pack_reference(self) -> np.ndarray:
        return np.append(pack(self.codes[np.frombuffer(self.ref, np.uint8)], self.bits, self.per), 0)

    def alike(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that two words have in common from the left."""
        return self.per - np.searchsorted(self.steps, a ^ b, "right")

    def lower(self, lo: np.ndarray, hi: np.ndarray, q: np.ndarray, off: int, above: bool = False) -> np.ndarray:
        """In ranges of ranks, the first whose word at an offset is at least q, or above it."""
        a, b = lo.copy(), hi.copy()
        open_ = np.flatnonzero(a < b)
        while len(open_):
            mid = (a[open_] + b[open_]) >> 1
            word = self.packed[self.array[mid].astype(np.int64) + off]
            less = word <= q[open_] if above else word < q[open_]
            a[open_] = np.where(less, mid + 1, a[open_])
            b[open_] = np.where(less, b[open_], mid)
            open_ = open_[a[open_] < b[open_]]
        return a

    def matches(self, t: Texts, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The factors that start at places of the texts: position and length, length 0 where that is not decided."""
        raw = t.data[i]
        cap = t.stop[i] - i
        pos, size = -1 - raw.astype(np.int64), np.ones(len(i), np.int64)
        run = raw == N
        if run.any():
            pos[run], size[run] = len(self.ref), t.run_end[i[run]] - i[run]
        own = np.flatnonzero(cap > 0)
        if len(own):
            p, k = self.longest_words(t, i[own], cap[own])
            # without a match it is a symbol that the reference sequence lacks
            pos[own], size[own] = np.where(k > 0, p, pos[own]), np.abs(k)
        if t.open_end:
            size[i + size >= t.n] = 0
        return pos, size

    def longest_words(self, t: Texts, i: np.ndarray, cap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position and length of the longest matches of places with ``cap`` symbols; length -1 without one, 0 beyond ``DEPTH``."""
        per, last = self.per, len(self.ranked) - 1
        c = np.minimum(per, cap)
        q = t.words[i] & self.high[c]
        at = np.searchsorted(self.ranked, q, "left")
        right = np.where(at <= last, np.minimum(self.alike(self.ranked[np.minimum(at, last)], q), c), 0)
        left = np.where(at > 0, np.minimum(self.alike(self.ranked[np.maximum(at - 1, 0)], q), c), 0)
        best = np.maximum(left, right)
        first = np.minimum(at, last)
        back = np.flatnonzero((left >= best) & (best > 0))
        first[back] = np.searchsorted(self.ranked, q[back] & self.high[best[back]], "left")
        pos, size = self.array[first].astype(np.int64), np.where(best > 0, best, -1)
        lanes = np.flatnonzero((best == per) & (cap > per))
        lo, hi = first[lanes], np.searchsorted(self.ranked, q[lanes], "right")
        size[lanes] = 0
        for depth in range(1, DEPTH + 1):
            if not len(lanes):
                break
            off = per * depth
            c = np.minimum(per, cap[lanes] - off)
            q = t.words[i[lanes] + off] & self.high[c]
            at = self.lower(lo, hi, q, off)
            word = lambda rank, off=off: self.packed[self.array[rank].astype(np.int64) + off]
            right = np.where(at < hi, np.minimum(self.alike(word(np.clip(at, lo, hi - 1)), q), c), 0)
            left = np.where(at > lo, np.minimum(self.alike(word(np.clip(at - 1, lo, hi - 1)), q), c), 0)
            best = np.maximum(left, right)
            first = np.where(best > 0, at, lo)
            back = np.flatnonzero((left >= best) & (best > 0))
            first[back] = self.lower(lo[back], at[back], q[back] & self.high[best[back]], off)
            on = (best == per) & (cap[lanes] > off + per)
            done = ~on
            pos[lanes[done]], size[lanes[done]] = self.array[first[done]], off + best[done]
            lanes, q, lo, hi = lanes[on], q[on], first[on], hi[on]
            hi = self.lower(lo, hi, q, off, above=True)
        return pos, size

    def longest(self, text: bytes, i: int, stop: int, lo: int, hi: int, known: int = 0) -> tuple[int, int]:
        """The longest match of text[i:stop] among ranks that all match ``known`` symbols, position and length, from bytes; (-1, 0) without one."""
        ref, sa, width, best = self.ref, self.sa, max(32, known), known
        while hi - lo > 1:
            want = text[i : min(stop, i + width)]
            at = bisect_left(sa, want, lo, hi, key=lambda p: ref[p : p + width])
            best = max(common(ref[sa[j] : sa[j] + width], want) for j in (at - 1, at) if lo <= j < hi)
            if best < width or i + best == stop:
                if not best:
                    return -1, 0
                want = text[i : i + best]
                return sa[bisect_left(sa, want, lo, hi, key=lambda p: ref[p : p + best])], best
            lo, hi, width = at, bisect_right(sa, want, at, hi, key=lambda p: ref[p : p + width]), width * 4
        p = sa[lo]
        while True:
            more = common(ref[p + best : p + best + width], text[i + best : min(stop, i + best + width)])
            best += more
            if more < width:
                return (p, best) if best else (-1, 0)
            width *= 4

    def follow(self, t: Texts, start: np.ndarray, limit: np.ndarray, pos: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Fill in the factors of streams from places up to limits or known factors; the places at or behind limits where they ended."""
        out = []
        while len(start):
            p, k = self.matches(t, start)
            pos[start], size[start] = p, k
            after = start + k
            inside = (k > 0) & (after < limit)
            out.append(after[(k > 0) & ~inside])
            start, limit = after[inside], limit[inside]
            new = size[start] == 0
            start, limit = start[new], limit[new]
        return np.concatenate(out) if out else start

    def parse_texts(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Positions, lengths and starts (in the data) of all factors of texts data[bounds[k]:bounds[k + 1]], and their number in each text."""
        found, counts = [], np.zeros(len(bounds) - 1, np.int64)
        k = 0
        while k < len(counts):
            # texts that fit one group, or one that may need several
            end = max(k + 1, int(np.searchsorted(bounds, bounds[k] + GROUP, "right")) - 1)
            at, last = int(bounds[k]), int(bounds[end])
            while True:
                upto = min(last, at + GROUP)
                stop = last if upto == last else min(last, upto + BEYOND)
                own = np.clip(bounds[k : end + 1], at, stop) - at
                pos, size, starts = self._parse_group(data[:last], at, upto - at, Texts(self, data[at:stop], own, stop < last))
                found.append((pos, size, starts))
                counts[k:end] += np.diff(np.searchsorted(starts, np.append(bounds[k:end], last)))
                at = int(starts[-1] + size[-1]) if len(starts) else last
                if at >= last:
                    break
            k = end
        none = np.zeros(0, np.int64)
        pos, size, starts = (np.concatenate([f[j] for f in found] or [none]) for j in range(3))
        return pos, size, starts, counts

    def parse_part(self, data: np.ndarray, upto: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions, lengths and starts of the factors of one text that start before ``upto``."""
        found, at, last = [], 0, len(data)
        while at < min(upto, last):
            end = min(upto, at + GROUP, last)
            stop = min(last, end + BEYOND)
            found.append(self._parse_group(data, at, end - at, Texts(self, data[at:stop], np.array([0, stop - at]), stop < last)))
            at = int(found[-1][2][-1] + found[-1][1][-1])
        none = np.zeros(0, np.int64)
        pos, size, starts = (np.concatenate([f[j] for f in found] or [none]) for j in range(3))
        return pos, size, starts

    def _parse_group(self, data: np.ndarray, base: int, upto: int, t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The factors from the start of each text on, those that start before ``upto``."""
        ends = t.bounds[1:]
        pos, size = np.zeros(t.n, np.int64), np.zeros(t.n, np.int64)
        # few symbols have many short blocks, as a step costs about the same for one stream and for a hundred
        block = min(self.block, max(64, upto // 64))
        blocks = -(-np.diff(t.bounds) // block)
        text_of = np.repeat(np.arange(len(blocks)), blocks)
        start = t.bounds[text_of] + block * spans(np.zeros(len(blocks), np.int64), blocks)
        start, text_of = start[start < upto], text_of[start < upto]
        left = self.follow(t, start, np.minimum(start + block, ends[text_of]), pos, size)
        left = np.unique(left[left < min(upto, t.n)])
        left = left[size[left] == 0]
        self.follow(t, left, ends[np.searchsorted(ends, left, "right")], pos, size)
        p, k, out = memoryview(pos), memoryview(size), []
        text, stop, real_ends = None, -1, ends
        i, last = int(t.bounds[0]), min(upto, t.n)
        while i < last:
            step = k[i]
            if not step:
                if text is None:
                    text = (data[base:] if t.open_end else data[base : base + t.n]).tobytes()
                    if t.open_end:
                        real_ends = np.append(ends[:-1], len(text))
                end = int(real_ends[np.searchsorted(real_ends, i, "right")])
                p[i], step, stop = self._one(text, i, stop, end, t)
                k[i] = step
            out.append(i)
            i += step
        starts = np.array(out, np.int64)
        self.block = min(BLOCK, max(64, STREAM * (last - int(t.bounds[0])) // max(1, len(out))))
        return pos[starts], size[starts], starts + base

    def _one(self, text: bytes, i: int, stop: int, end: int, t: Texts) -> tuple[int, int, int]:
        """The factor at a place, from bytes, and the next n, which is looked for only when the last one was passed."""
        if text[i] == N:
            return len(self.ref), RUN.match(text, i, end).end() - i, stop
        if stop <= i or stop > end:
            stop = text.find(b"n", i, end)
            stop = end if stop < 0 else stop
        lo, hi, known = 0, len(self.sa), 0
        if t.stop[i] - i >= self.per:
            own = slice(*np.searchsorted(self.ranked, t.words[i : i + 1] + (0, 1), "left").tolist())
            if own.start < own.stop:
                lo, hi, known = own.start, own.stop, self.per
        p, k = self.longest(text, i, stop, lo, hi, known)
        return (p, k, stop) if k else (-1 - text[i], 1, stop)

    def parse(self, text: bytes) -> tuple[list[int], list[int]]:
        """Positions and lengths of the factors of one lower-case sequence."""
        pos, size, _, _ = self.parse_texts(np.frombuffer(text, np.uint8), np.array([0, len(text)], np.int64))
        return pos.tolist(), size.tolist()

    def intervals(self, t: Texts, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For parts of texts (not empty, within their text) the ranks of the suffixes that start with them, end exclusive."""
        c = np.minimum(self.per, size)
        q = t.words[start] & self.high[c]
        lo = np.searchsorted(self.ranked, q, "left")
        hi = np.searchsorted(self.ranked, q | ~self.high[c] & self.high[-1], "right")
        lanes, off = np.flatnonzero((size > self.per) & (lo < hi)), self.per
        while len(lanes):
            c = np.minimum(self.per, size[lanes] - off)
            q = t.words[start[lanes] + off] & self.high[c]
            low = self.lower(lo[lanes], hi[lanes], q, off)
            hi[lanes] = self.lower(low, hi[lanes], q | ~self.high[c] & self.high[-1], off, above=True)
            lo[lanes] = low
            off += self.per
            lanes = lanes[(size[lanes] > off) & (lo[lanes] < hi[lanes])]
        unknown = np.flatnonzero(self.codes[t.data] == 0)
        if len(unknown):  # symbols without a code match nothing
            nearest = np.append(unknown, t.n)[np.searchsorted(unknown, start)]
            hi = np.where(nearest < start + size, lo, hi)
        return lo, hi

    def interval(self, pattern: bytes) -> tuple[int, int]:
        """The ranks of the suffixes that start with the pattern, end exclusive."""
        if not pattern:
            return 0, len(self.array)
        t = Texts(self, np.frombuffer(pattern, np.uint8), np.array([0, len(pattern)], np.int64))
        lo, hi = self.intervals(t, np.zeros(1, np.int64), np.array([len(pattern)]))
        return int(lo[0]), int(hi[0])

    def occurrences(self, pattern: bytes) -> np.ndarray:
        """All starts of a pattern, rising."""
        if not pattern:
            return np.zeros(0, np.int64)
        lo, hi = self.interval(pattern)
        return np.sort(self.array[lo:hi]).astype(np.int64)
