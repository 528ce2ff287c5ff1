"""The binary factor codec on arrays: where each field lies follows from the lengths of the codes, then all bits are set at once.

A file is read the other way round. Where a factor that starts at a bit would end follows from the next zero behind it, so it
is found for all bits of a window at once; then the walk goes from end to end, and the fields of the factors met are read together.
"""

from __future__ import annotations

import numpy as np

from seqloom.functions.symbols import BASES, LENGTH_DIVISOR, SHORT_DIVISOR
from seqloom.operators.matching import spans

LONG, SHORT = LENGTH_DIVISOR.bit_length() - 1, SHORT_DIVISOR.bit_length() - 1
#: Kinds of factors: a position, a literal, the first of the rising factors, and the change of one of the others.
PLAIN, LITERAL, HEAD, DELTA = range(4)
#: Bits that are read together.
WINDOW = 1 << 21
_TWO_BIT = np.full(256, -1, np.int64)
_TWO_BIT[list(BASES.encode())] = np.arange(4)
_BASE = np.frombuffer(BASES.encode(), np.uint8)


def kinds(ref: bytes, pos: np.ndarray, size: np.ndarray, chosen: np.ndarray, short: bool, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """For each factor its kind, and its position or the change; ``chosen`` are the rising factors."""
    n = len(ref)
    kind, value = np.full(len(pos), PLAIN), pos.copy()
    if short:
        n_before = np.concatenate(([0], np.cumsum(np.frombuffer(ref, np.uint8) == ord("n"))))
        inside = np.flatnonzero((pos >= 0) & (pos < n) & (size <= limit))
        kind[inside[n_before[pos[inside] + size[inside]] == n_before[pos[inside]]]] = LITERAL
        kind[pos < 0] = LITERAL
    elif (pos < 0).any():
        raise ValueError("the reference sequence lacks a symbol; only the short encoding can hold it")
    if len(chosen):
        shift = pos[chosen] - (np.cumsum(size) - size)[chosen]
        kind[chosen], value[chosen[1:]] = DELTA, np.diff(shift)
        kind[chosen[0]] = HEAD
    return kind, value


def bit_lengths(kind: np.ndarray, value: np.ndarray, size: np.ndarray, width: int, short: bool, liss: bool) -> np.ndarray:
    """The bits of each factor."""
    literal = 1 + (size >> SHORT) + 1 + SHORT + 2 * size
    change = np.where(value == 0, 1, 2 + (np.abs(value) >> LONG) + 1 + LONG)
    length = (size >> LONG) + 1 + LONG
    return liss + np.where(kind == LITERAL, literal, np.where(kind == DELTA, change, short + width) + length)


def encode(ref: bytes, kind: np.ndarray, value: np.ndarray, size: np.ndarray, width: int, short: bool, liss: bool) -> bytes:
    """The factors' bits, from the first to the last, filled up with zeros; divisors and header are not among them."""
    lengths = bit_lengths(kind, value, size, width, short, liss)
    bits = np.zeros(int(lengths.sum()), np.uint8)
    at = np.cumsum(lengths) - lengths

    def fixed(at: np.ndarray, number: np.ndarray, width: int) -> np.ndarray:
        for j in range(width):
            bits[at + j] = number >> (width - 1 - j) & 1
        return at + width

    def rice(at: np.ndarray, number: np.ndarray, k: int) -> np.ndarray:
        bits[spans(at, number >> k)] = 1
        return fixed(at + (number >> k) + 1, number & (1 << k) - 1, k)

    if liss:
        bits[at] = kind >= HEAD
        at = at + 1
    own = np.flatnonzero((kind == PLAIN) | (kind == HEAD))
    if short:
        bits[at[own]] = 1
    rice(fixed(at[own] + short, value[own], width), size[own], LONG)
    own = np.flatnonzero(kind == DELTA)
    moved = value[own] != 0
    bits[at[own]] = moved
    bits[at[own[moved]] + 1] = value[own[moved]] > 0
    after = at[own] + 1
    after[moved] = rice(at[own[moved]] + 2, np.abs(value[own[moved]]), LONG)
    rice(after, size[own], LONG)
    own = np.flatnonzero(kind == LITERAL)
    start = rice(at[own] + 1, size[own], SHORT)
    lacking = value[own] < 0
    text = np.frombuffer(ref, np.uint8)[spans(np.where(lacking, 0, value[own]), np.where(lacking, 0, size[own]))].astype(np.int64)
    places = spans(start, 2 * size[own])[::2]
    symbols = np.empty(len(places), np.int64)
    of_ref = np.repeat(~lacking, size[own])
    symbols[of_ref], symbols[~of_ref] = text, -1 - value[own[lacking]]
    codes = _TWO_BIT[symbols]
    if (codes < 0).any():
        raise ValueError("a literal has a symbol other than a, c, g, t")
    bits[places], bits[places + 1] = codes >> 1, codes & 1
    return np.packbits(bits).tobytes()


def decode(body: bytes, first_bit: int, width: int, long_divisor: int, short_divisor: int, short: bool, liss: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Kinds, positions or changes, lengths, and the text of all literals, of the factors from a bit on."""
    lk, sk = long_divisor.bit_length() - 1, short_divisor.bit_length() - 1 if short else 0
    raw = np.frombuffer(body, np.uint8)
    total, at, span, seen = 8 * len(raw), first_bit, WINDOW, False
    out: list[tuple[np.ndarray, ...]] = []
    while at < total:
        base = at // 8 * 8
        stop = min(total, base + span)
        bits = np.unpackbits(raw[base // 8 : -(-stop // 8)])
        found, after, seen = _window(bits, at - base, stop == total, width, lk, sk, short, liss, seen)
        out.append(found)
        if after == at - base:
            if stop == total:
                break
            span *= 2  # one factor is longer than the window
            continue
        at, span = base + after, WINDOW
    kind, value, size = (np.concatenate([o[k] for o in out] or [np.zeros(0, np.int64)]) for k in range(3))
    return kind, value, size, b"".join(o[3] for o in out)


def _window(bits: np.ndarray, start: int, last: bool, width: int, lk: int, sk: int, short: bool, liss: bool, seen: bool) -> tuple[tuple, int, bool]:
    """The whole factors of a window of bits, the place behind them, and whether the first rising factor was met."""
    n = len(bits)
    far = 8 * n + 64  # behind every end
    zero = np.where(bits == 0, np.arange(n), far)
    zero = np.append(np.minimum.accumulate(zero[::-1])[::-1], far)
    bit = np.append(bits, 0).astype(np.int64)
    clip = lambda x: np.minimum(x, n)

    def number(at: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for j in range(k):
            out = out << 1 | bit[clip(at + j)]
        return out

    def rice(at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and the places behind them."""
        end = zero[clip(at)]
        return (end - at << k) + number(end + 1, k), end + 1 + k

    every = np.arange(n)
    # where a factor that starts at each bit ends, if it is no rising one
    own = every + liss
    ends = zero[clip(own + short + width)] + 1 + lk
    if short:
        size, after = rice(own + 1, sk)
        ends = np.where(bit[clip(own)] == 0, after + 2 * size, ends)
    if liss:
        # if it is the change of one
        change = np.where(bit[clip(own)] == 0, own + 1, zero[clip(own + 2)] + 1 + lk)
        ends = np.where(bit[:n] == 1, zero[clip(change)] + 1 + lk, ends)
    step, flag, at, met, head = memoryview(np.ascontiguousarray(ends)), memoryview(np.ascontiguousarray(bits)), start, [], -1
    while at < n:
        after = step[at]
        if liss and not seen and flag[at]:
            place = at + 1 + short + width
            after = int(zero[min(place, n)]) + 1 + lk
            if after <= n:
                seen, head = True, at
        if after > n:
            break
        met.append(at)
        at = after
    at_ = np.array(met, np.int64)
    kind, value, size = np.full(len(at_), PLAIN), np.zeros(len(at_), np.int64), np.zeros(len(at_), np.int64)
    own = at_ + liss
    if liss:
        kind[bit[at_] == 1] = DELTA
        kind[at_ == head] = HEAD
    if short:
        kind[(kind == PLAIN) & (bit[clip(own)] == 0)] = LITERAL
    k = np.flatnonzero((kind == PLAIN) | (kind == HEAD))
    value[k] = number(own[k] + short, width)
    size[k] = rice(own[k] + short + width, lk)[0]
    k = np.flatnonzero(kind == DELTA)
    moved = bit[clip(own[k])] == 1
    change, after = rice(own[k] + 2, lk)
    value[k] = np.where(moved, np.where(bit[clip(own[k] + 1)] == 1, change, -change), 0)
    size[k] = rice(np.where(moved, after, own[k] + 1), lk)[0]
    k = np.flatnonzero(kind == LITERAL)
    size[k], after = rice(own[k] + 1, sk)
    places = spans(after, 2 * size[k])[::2]
    return (kind, value, size, _BASE[bit[places] << 1 | bit[clip(places + 1)]].tobytes()), at, seen


def positions(kind: np.ndarray, value: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of all factors, those of rising ones from the changes; -1 for literals."""
    out = np.where(kind == LITERAL, -1, value)
    own = np.flatnonzero(kind >= HEAD)
    if len(own):
        starts = (np.cumsum(size) - size)[own]
        steps = value[own].copy()
        steps[0] -= starts[0]
        out[own] = np.cumsum(steps) + starts
    return out
