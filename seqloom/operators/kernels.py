"""Functions over bytes and arrays that no plan can express; used by the operators on Arrow batches.

A factor is (position, length) in the reference sequence. Position len(R) is a run of n; a negative position is a
literal symbol that the reference sequence lacks, as -(byte + 1).
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from seqloom.functions.symbols import LENGTH_DIVISOR, SHORT_DIVISOR
from seqloom.operators import bitcodec
from seqloom.operators.matching import N, USUAL, Parser, pack, spans

#: Words in which plain search looks texts up: symbols of each, bits of a symbol, and codes (one above all for symbols other than the usual).
WORD, WORD_BITS, WORD_SYMBOLS = 20, 3, USUAL
WORD_CODES = np.full(256, len(USUAL) + 1, np.int64)
WORD_CODES[list(USUAL)] = np.arange(1, len(USUAL) + 1)


def suffix_array(text: bytes) -> np.ndarray:
    """Starts of all suffixes in order, the empty one first.

    Suffixes are sorted by as many symbols as fit one word; those that still tie are sorted again by the ranks of what follows,
    and the reach of a rank doubles each round.
    """
    n = len(text)
    kind = np.int32 if n < 1 << 31 else np.int64
    raw = np.frombuffer(text, np.uint8)
    symbols, codes = np.unique(raw, return_inverse=True)
    bits = max(1, len(symbols).bit_length())
    reach = 62 // bits
    key = np.zeros(n + 1, np.int64)
    padded = np.concatenate([codes.astype(np.int64) + 1, np.zeros(reach + 1, np.int64)])
    for j in range(reach):
        key <<= bits
        key |= padded[j : j + n + 1]
    order = np.argsort(key, kind="stable").astype(kind)
    rank = np.empty(n + 1, kind)
    rank[order], tied = _groups(key[order])
    del key, padded, codes
    places = np.flatnonzero(tied)
    while len(places):
        own = order[places]
        # a suffix that ends within the reach comes before its equals
        after = np.where(own + reach <= n, rank[np.minimum(own + reach, n)].astype(np.int64) + 1, 0)
        both = rank[own].astype(np.int64) * (n + 2) + after
        by = np.argsort(both, kind="stable")
        own, both = own[by], both[by]
        order[places] = own
        first, tied = _groups(both)
        rank[own] = places[first]
        places = places[tied]
        reach *= 2
    return order


def _groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted values, where each one's group of equals starts, and whether it has equals."""
    new = np.concatenate(([True], values[1:] != values[:-1]))
    starts = np.flatnonzero(new)
    return np.repeat(starts, np.diff(np.append(starts, len(values)))), ~(new & np.append(new[1:], True))


@lru_cache(2)
def parser(ref: bytes) -> Parser:
    """A parser of a short reference sequence, for use in one process."""
    return Parser(ref, suffix_array(ref))


def factor_lists(pos: pa.ListArray, size: pa.ListArray) -> Iterator[tuple[list[int], list[int]]]:
    """Positions and lengths of the factors of one sequence after another; only one is held as lists."""
    for p, k in zip(pos, size, strict=True):
        yield p.values.to_numpy().tolist(), k.values.to_numpy().tolist()


def text_of(ref: bytes, p: int, k: int) -> bytes:
    """The text of one factor."""
    if p < 0:
        return bytes([-1 - p])
    return b"n" * k if p == len(ref) else ref[p : p + k]


def head_of(ref: bytes, p: int, k: int, m: int) -> bytes:
    """The first m symbols of one factor."""
    return text_of(ref, p, min(k, m))


def tail_of(ref: bytes, p: int, k: int, m: int) -> bytes:
    """The last m symbols of one factor."""
    return text_of(ref, p + k - min(k, m), min(k, m)) if 0 <= p < len(ref) else text_of(ref, p, min(k, m))


def expand(ref: bytes, pos: list[int], size: list[int]) -> bytes:
    """The sequence of its factors."""
    return b"".join([text_of(ref, p, k) for p, k in zip(pos, size, strict=True)])


def window(ref: bytes, pos: list[int], size: list[int], starts: np.ndarray, a: int, b: int) -> bytes:
    """Symbols a .. b of a sequence, from the factors that overlap them only."""
    if a >= b:
        return b""
    i, j = int(np.searchsorted(starts, a, "right")) - 1, int(np.searchsorted(starts, b, "left"))
    text = expand(ref, pos[i:j], size[i:j])
    return text[a - int(starts[i]) : b - int(starts[i])]


@lru_cache(1)
def sorted_words(ref: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The words of ``WORD`` symbols at all places of a reference sequence in order, and their places; by plain sorting."""
    words = pack(WORD_CODES[np.frombuffer(ref, np.uint8)], WORD_BITS, WORD)
    order = np.argsort(words).astype(np.int32 if len(ref) < 1 << 31 else np.int64)
    return words[order], order


def contained(ref: bytes, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the reference sequence holds data[at:at + size], each not empty. Up to ``WORD`` usual symbols are looked up
    in its sorted words; longer texts are compared at the places of their first word, where these are few, or searched for."""
    words, order = sorted_words(ref)
    codes = WORD_CODES[data]
    mask = ((1 << WORD_BITS * WORD) - 1) & ~((1 << WORD_BITS * (WORD - np.minimum(size, WORD))) - 1)
    q = pack(codes, WORD_BITS, WORD)[at] & mask
    first = np.searchsorted(words, q)
    out = np.zeros(len(at), bool)
    met = np.flatnonzero(first < len(words))
    out[met] = words[first[met]] & mask[met] == q[met]
    odd = np.concatenate(([0], np.cumsum(codes > len(WORD_SYMBOLS))))
    unusual = odd[at + np.minimum(size, len(data) - at)] > odd[at]
    for k in np.flatnonzero(unusual | out & (size > WORD)).tolist():
        own = data[at[k] : at[k] + size[k]].tobytes()
        lo, hi = int(first[k]), int(np.searchsorted(words, q[k], "right"))
        out[k] = own in ref if unusual[k] or hi - lo > 64 else any(ref.startswith(own, i) for i in order[lo:hi].tolist())
    return out


def faults(ref: bytes, data: np.ndarray, bounds: np.ndarray, pos: np.ndarray, size: np.ndarray, start: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each text data[bounds[k]:bounds[k + 1]] and its factors: runs of n, gaps, factors that read otherwise than the text, and factors that could be longer."""
    n, row = len(ref), np.repeat(np.arange(len(counts)), counts)
    length, last = np.diff(bounds), np.cumsum(counts)
    sums = lambda x: np.bincount(row[x], minlength=len(counts))
    due = np.concatenate(([0], (start + size)[:-1])) if len(start) else start.copy()
    due[(last - counts)[counts > 0]] = 0
    gaps = sums(start != due)
    end = np.zeros(len(counts), np.int64)
    end[counts > 0] = (start + size)[last[counts > 0] - 1]
    gaps += end != length
    run, literal = pos == n, pos < 0
    broken = (start < 0) | (size < 1) | (start + size > length[row]) | (pos > n) | literal & ((size != 1) | (pos < -256)) | ~run & ~literal & (pos + size > n)
    wrong, fine = broken.copy(), np.flatnonzero(~broken)
    source = np.concatenate([np.frombuffer(ref, np.uint8), np.frombuffer(b"n", np.uint8), np.arange(256, dtype=np.uint8)])
    at = spans(np.where(literal, n - pos, pos)[fine], size[fine])
    at[np.repeat(run[fine], size[fine])] = n
    own = np.repeat(fine, size[fine])
    wrong[own[source[at] != data[spans((bounds[row] + start)[fine], size[fine])]]] = True
    longer = np.zeros(len(pos), bool)
    base = np.clip(bounds[row] + start, 0, max(len(data) - 1, 0))
    goes_on = np.flatnonzero(~broken & (start + size < length[row]))
    after = data[(base + size)[goes_on]]
    longer[goes_on] = run[goes_on] & (after == N)
    plain = goes_on[~run[goes_on] & (after != N)]
    longer[plain] = contained(ref, data, base[plain], size[plain] + 1)
    alone = np.flatnonzero(literal & ~broken)
    longer[alone] |= contained(ref, data, base[alone], size[alone])
    return sums(run), gaps, sums(wrong), sums(longer)


def occurrences(text: bytes, pattern: bytes) -> list[int]:
    """All starts of a pattern, overlapping ones too."""
    out, at = [], text.find(pattern) if pattern else -1
    while at >= 0:
        out.append(at)
        at = text.find(pattern, at + 1)
    return out


def rising(pos: list[int], run: int) -> list[int]:
    """Indexes of a longest strictly rising run of positions; runs of n and literals are no part of it."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(pos)
    for i, p in enumerate(pos):
        if p < 0 or p == run:
            continue
        k = bisect_left(tails, p)
        before[i] = ends[k - 1] if k else -1
        tails[k : k + 1], ends[k : k + 1] = [p], [i]
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def deltas(pos: list[int], size: list[int], chosen: list[int]) -> list[int]:
    """For each chosen factor after the first, its position less the one that the factors since the last suggest."""
    starts = np.concatenate(([0], np.cumsum(size))).tolist()
    shift = [pos[i] - starts[i] for i in chosen]
    return [b - a for a, b in zip(shift, shift[1:], strict=False)]


def levels(pos: list[int], size: list[int]) -> list[int]:
    """For intervals by start, longer ones first: the first level on which no interval ends after this one's end."""
    last: list[int] = []  # the latest end on each level; falls from level to level
    out = []
    for p, k in zip(pos, size, strict=True):
        end = p + k
        lo, hi = 0, len(last)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if last[mid] <= end else (mid + 1, hi)
        last[lo : lo + 1] = [end]
        out.append(lo)
    return out


def width_of(ref: bytes) -> int:
    """Bits for a position; the mark of a run of n, len(R), always fits."""
    return max(1, len(ref).bit_length())


def short_limit(ref: bytes) -> int:
    return int(64.0 / 135 * (width_of(ref) + 3))


def is_short(ref: bytes, p: int, k: int) -> bool:
    """Whether a factor is written as a literal; symbols that the reference sequence lacks always are."""
    return p < 0 or (p != len(ref) and k <= short_limit(ref) and b"n" not in ref[p : p + k])


def plan(ref: bytes, pos: list[int], size: list[int], short: bool, liss: bool) -> list[tuple[str, int, int]]:
    """(kind, position or delta, length): f standard, s literal, h head of the rising factors, d one of the others."""
    if not short and any(p < 0 for p in pos):
        raise ValueError("the reference sequence lacks a symbol; only the short encoding can hold it")
    chosen = rising(pos, len(ref)) if liss else []
    later = dict(zip(chosen[1:], deltas(pos, size, chosen), strict=True))
    out = []
    for i, (p, k) in enumerate(zip(pos, size, strict=True)):
        if chosen and i == chosen[0]:
            out.append(("h", p, k))
        elif i in later:
            out.append(("d", later[i], k))
        else:
            out.append(("s" if short and is_short(ref, p, k) else "f", p, k))
    return out


def header(text: bool, short: bool, liss: bool) -> bytes:
    """The first byte of a factor file: bits for text, binary, short and rising factors."""
    return bytes([text << 7 | (not text) << 6 | short << 5 | liss << 4]) + b"\n" * text


def encode_text(ref: bytes, pos: list[int], size: list[int], short: bool = False, liss: bool = False) -> bytes:
    rows = []
    for kind, p, k in plan(ref, pos, size, short, liss):
        rows.append(f"{text_of(ref, p, k).decode()} {k}\n" if kind == "s" else f"* {p} {k}\n" if kind in "hd" else f"{p} {k}\n")
    return header(True, short, liss) + "".join(rows).encode()


def layout(ref: bytes, pos: list[int], size: list[int], short: bool, liss: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kinds, positions or changes, and lengths of the binary encoding's factors."""
    p, k = np.asarray(pos, np.int64), np.asarray(size, np.int64)
    chosen = np.array(rising(pos, len(ref)) if liss else [], np.int64)
    return *bitcodec.kinds(ref, p, k, chosen, short, short_limit(ref)), k


def encode_bits(ref: bytes, pos: list[int], size: list[int], short: bool = False, liss: bool = False) -> int:
    """How many bits the factors take, without the file's header and divisors; no bits are made."""
    return int(bitcodec.bit_lengths(*layout(ref, pos, size, short, liss), width_of(ref), short, liss).sum())


def encode_binary(ref: bytes, pos: list[int], size: list[int], short: bool = False, liss: bool = False) -> bytes:
    divisors = bytes([LENGTH_DIVISOR, SHORT_DIVISOR] if short else [LENGTH_DIVISOR])
    return header(False, short, liss) + divisors + bitcodec.encode(ref, *layout(ref, pos, size, short, liss), width_of(ref), short, liss)


def decode_file(ref: bytes, data: bytes) -> list[tuple[int, int, bytes]]:
    """(position, length, text) of the factors of a file; literals have position -1."""
    pos, size, texts, bounds = decode_arrays(ref, data)
    rows = zip(pos.tolist(), size.tolist(), bounds[:-1].tolist(), strict=True)
    texts = texts.tobytes()
    return [(p, k, texts[a : a + k]) for p, k, a in rows]


def decode_arrays(ref: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions (-1 for literals), lengths, the symbols of all factors of a file and where each factor's start in them; gathered at once."""
    if not data:
        raise ValueError("an empty file has no header")
    if data[0] >> 7 & 1:
        kind, value, size, literals = _read_text_arrays(data, bool(data[0] >> 5 & 1), bool(data[0] >> 4 & 1))
    else:
        kind, value, size, literals = _read_arrays(ref, data)
    pos, n = bitcodec.positions(kind, value, size), len(ref)
    own = np.where(kind == bitcodec.LITERAL, size, 0)
    start = np.where(kind == bitcodec.LITERAL, n + 1 + np.cumsum(own) - own, pos)
    if not (kept := size > 0).all():
        pos, size, start = pos[kept], size[kept], start[kept]
    source, out = np.frombuffer(ref + b"n" + literals, np.uint8), [np.zeros(0, np.uint8)]
    # about a million symbols at a time
    cuts = np.flatnonzero(np.diff(np.cumsum(size) >> 20, prepend=-1)).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(size)][: len(cuts)], strict=True):
        at = spans(start[a:b], size[a:b])
        run = pos[a:b] == n
        if run.any():
            at[np.repeat(run, size[a:b])] = n
        out.append(source[at])
    return pos, size, np.concatenate(out), np.concatenate(([0], np.cumsum(size)))


def decode_sequence(ref: bytes, data: bytes) -> bytes:
    """The sequence of a file."""
    return decode_arrays(ref, data)[2].tobytes()


def _read_arrays(ref: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    short, liss = bool(data[0] >> 5 & 1), bool(data[0] >> 4 & 1)
    long_divisor, short_divisor = (*data[1 : 2 + short], 0)[:2]
    return bitcodec.decode(data, 8 * (2 + short), width_of(ref), long_divisor, short_divisor, short, liss)


def _read_text_arrays(data: bytes, short: bool, liss: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Kinds, positions or changes, lengths, and the text of all literals, of a text file."""
    fields = data[2:].replace(b"\n", b" ").split()
    if liss:
        marks = np.array([f == b"*" for f in fields], bool)
        kept = np.flatnonzero(~marks)
        fields = [f for f in fields if f != b"*"]
        rising = (marks[kept - 1] & (kept > 0))[::2]
    heads, size = fields[::2], np.array(fields[1::2], "S20").astype(np.int64)
    kind, value = np.full(len(heads), bitcodec.PLAIN), np.zeros(len(heads), np.int64)
    if short:
        kind[[h.isalpha() for h in heads]] = bitcodec.LITERAL
    own = kind != bitcodec.LITERAL
    literals = b"" if own.all() else b"".join([h for h, p in zip(heads, own.tolist(), strict=True) if not p])
    value[own] = np.array(heads if own.all() else [h for h, p in zip(heads, own.tolist(), strict=True) if p], "S20").astype(np.int64)
    if liss and rising.any():
        kind[rising] = bitcodec.DELTA
        first = int(np.argmax(rising))
        kind[first] = bitcodec.HEAD
    return kind, value, size, literals
