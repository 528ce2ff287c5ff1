import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.operators import bitcodec, matching
from seqloom.operators import kernels as K
from seqloom.operators.ranges import Ranges

REF, T = b"acgtacgn", b"acgtannncgtt"
seqs = st.text("acgnt", max_size=60).map(str.encode)


def naive_parse(ref, text):
    sa = sorted(range(len(ref) + 1), key=lambda i: ref[i:])
    out, i = [], 0
    while i < len(text):
        if text[i : i + 1] == b"n":
            j = i
            while text[j : j + 1] == b"n":
                j += 1
            out.append((len(ref), j - i))
            i = j
            continue
        k = 0
        while i + k < len(text) and text[i + k : i + k + 1] != b"n" and text[i : i + k + 1] in ref:
            k += 1
        out.append((next(p for p in sa if ref[p:].startswith(text[i : i + k])), k) if k else (-1 - text[i], 1))
        i += max(k, 1)
    return out


def test_worked_example():
    assert list(zip(*K.parser(REF).parse(T), strict=True)) == [(0, 5), (8, 3), (1, 3), (3, 1)]


@given(seqs)
@settings(max_examples=200, deadline=None)
def test_suffix_array(text):
    assert K.suffix_array(text).tolist() == sorted(range(len(text) + 1), key=lambda i: text[i:])


@given(st.text("acgnt", min_size=0, max_size=200).map(str.encode), st.text("acgnt", max_size=200).map(str.encode))
@settings(max_examples=300, deadline=None)
def test_parse_equals_naive_and_round_trips(ref, text):
    pos, size = K.Parser(ref, K.suffix_array(ref)).parse(text)
    assert list(zip(pos, size, strict=True)) == naive_parse(ref, text)
    assert K.expand(ref, pos, size) == text


@given(st.text("acgnt", max_size=300).map(str.encode), st.lists(st.text("acgntx", max_size=150).map(str.encode), max_size=5), st.data())
@settings(max_examples=300, deadline=None)
def test_many_texts_in_small_blocks_equal_naive(ref, texts, data):
    """Streams that leave their blocks, windows of long texts, matches beyond the words, several texts at once."""
    old = matching.BLOCK, matching.GROUP, matching.BEYOND, matching.DEPTH
    if len(ref) > 30:  # pieces of the reference sequence, so that matches are long
        at = [data.draw(st.integers(0, len(ref) - 30)) for _ in range(4)]
        pieces = [ref[a : a + data.draw(st.integers(1, 200))] for a in at]
        # the text behind one goes on as the reference sequence does
        texts = [*texts, *pieces, pieces[0], ref[at[0] + len(pieces[0]) :], ref + ref]
    try:
        matching.BLOCK, matching.GROUP, matching.BEYOND, matching.DEPTH = (data.draw(st.sampled_from(x)) for x in ((1, 4, 16), (10, 50, 10**6), (0, 3, 100), (0, 1, 4)))
        bounds = np.cumsum([0, *map(len, texts)]).astype(np.int64)
        pos, size, start, counts = K.Parser(ref, K.suffix_array(ref)).parse_texts(np.frombuffer(b"".join(texts), np.uint8), bounds)
        got, at = [], 0
        for t, n, base in zip(texts, counts.tolist(), bounds.tolist(), strict=False):
            rows = slice(at, at + n)
            got.append(list(zip(pos[rows].tolist(), size[rows].tolist(), strict=True)))
            assert (start[rows] - base).tolist() == [0, *np.cumsum(size[rows]).tolist()][:n] and int(size[rows].sum()) == len(t)
            at += n
        assert got == [naive_parse(ref, t) for t in texts] and at == len(pos)
    finally:
        matching.BLOCK, matching.GROUP, matching.BEYOND, matching.DEPTH = old


@given(st.text("acgnt", max_size=200).map(str.encode), st.text("acgntx", min_size=1, max_size=60).map(str.encode), st.integers(0, 150), st.integers(1, 90))
@settings(max_examples=300, deadline=None)
def test_intervals_equal_plain_search(ref, pattern, at, size):
    p = K.Parser(ref, K.suffix_array(ref))
    for part in (pattern, ref[at : at + size]):
        assert p.occurrences(part).tolist() == K.occurrences(ref, part)


@given(st.text("acgn", max_size=120).map(str.encode), seqs, st.integers(1, 5), st.text("acgn", min_size=1, max_size=6).map(str.encode))
@settings(max_examples=300, deadline=None)
def test_ranges_read_as_one_array(ref, text, k, pattern):
    """Parses and places against arrays in one to five ranges equal those against one."""
    one = K.Parser(ref, K.suffix_array(ref))
    each = -(-(len(ref) + 1) // k)
    cut = lambda x: Ranges([x[a : a + each] for a in range(0, len(x), each)])
    several = K.Parser(ref, cut(one.array), cut(one.packed), cut(one.ranked))
    assert several.parse(text + ref) == one.parse(text + ref)
    assert several.occurrences(pattern).tolist() == K.occurrences(ref, pattern)


@given(st.lists(st.integers(0, 9), min_size=1, max_size=40).map(sorted), st.lists(st.integers(-1, 10), max_size=20), st.integers(1, 12), st.sampled_from(["left", "right"]))
def test_ranges_search(values, asked, each, side):
    values, asked = np.array(values), np.array(asked, np.int64)
    got = Ranges([values[a : a + each] for a in range(0, len(values), each)]).searchsorted(asked, side)
    assert got.tolist() == np.searchsorted(values, asked, side).tolist()


def test_long_repeats():
    ref = b"acgt" * 500
    text = ref[3:1900] + b"n" + ref[1:1200]
    pos, size = K.Parser(ref, K.suffix_array(ref)).parse(text)
    assert size == [1897, 1, 1199] and K.expand(ref, pos, size) == text


@given(st.text("acgnt", min_size=1, max_size=80).map(str.encode), seqs, st.booleans(), st.booleans(), st.booleans())
@settings(max_examples=400, deadline=None)
def test_codecs_round_trip(ref, text, short, liss, as_text):
    pos, size = K.Parser(ref, K.suffix_array(ref)).parse(text)
    encode = K.encode_text if as_text else K.encode_binary
    if not short and any(p < 0 for p in pos):
        with pytest.raises(ValueError, match="lacks a symbol"):
            encode(ref, pos, size, short, liss)
        return
    data = encode(ref, pos, size, short, liss)
    assert data[0] == (as_text << 7) + ((not as_text) << 6) + (short << 5) + (liss << 4)
    assert b"".join(t for _, _, t in K.decode_file(ref, data)) == text


def slow_binary(ref, pos, size, short, liss):
    """The binary format, bit by bit."""
    w = K.width_of(ref)
    rice = lambda n, d: "1" * (n // d) + "0" + format(n % d, f"0{d.bit_length() - 1}b")
    out = format(64, "08b") + (format(8, "08b") if short else "")
    for kind, p, k in K.plan(ref, pos, size, short, liss):
        out += ("1" if kind in "hd" else "0") if liss else ""
        if kind == "d":
            out += ("0" if not p else ("11" if p > 0 else "10") + rice(abs(p), 64)) + rice(k, 64)
        elif kind == "s":
            out += "0" + rice(k, 8) + "".join(format("acgt".index(chr(c)), "02b") for c in K.text_of(ref, p, k))
        else:
            out += "1" * short + format(p, f"0{w}b") + rice(k, 64)
    out += "0" * (-len(out) % 8)
    return K.header(False, short, liss) + bytes(int(out[i : i + 8], 2) for i in range(0, len(out), 8))


@given(st.text("acgnt", min_size=1, max_size=200).map(str.encode), st.lists(st.text("acgnt", max_size=90), max_size=4), st.booleans(), st.booleans(), st.sampled_from([8, 64, 1 << 21]))
@settings(max_examples=400, deadline=None)
def test_binary_codec_equals_the_format_bit_by_bit(ref, parts, short, liss, window):
    """With windows that end within factors, long runs of n, and pieces of the reference sequence."""
    text = b"".join(p.encode() + b"n" * (70 * i) + ref[i:] for i, p in enumerate(parts))
    pos, size = K.Parser(ref, K.suffix_array(ref)).parse(text)
    if not short and any(p < 0 for p in pos):
        return
    data = K.encode_binary(ref, pos, size, short, liss)
    assert data == slow_binary(ref, pos, size, short, liss)
    old, bitcodec.WINDOW = bitcodec.WINDOW, window
    try:
        rows = K.decode_file(ref, data)
        assert K.decode_sequence(ref, data) == text
    finally:
        bitcodec.WINDOW = old
    assert b"".join(t for _, _, t in rows) == text and [k for _, k, _ in rows] == size
    assert all(p == q or p == -1 for (p, _, _), q in zip(rows, pos, strict=True))


def test_text_format():
    pos, size = K.parser(REF).parse(T)
    assert K.encode_text(REF, pos, size)[1:] == b"\n0 5\n8 3\n1 3\n3 1\n"
    assert K.encode_text(REF, pos, size, liss=True)[1:] == b"\n* 0 5\n8 3\n* -7 3\n* -1 1\n"
    assert K.encode_text(REF, pos, size, short=True)[1:] == b"\n0 5\n8 3\ncgt 3\nt 1\n"


@given(st.lists(st.integers(0, 12), max_size=14))
@settings(max_examples=200, deadline=None)
def test_rising_is_longest(pos):
    chosen = K.rising(pos, 9)
    picked = [pos[i] for i in chosen]
    assert all(a < b for a, b in zip(picked, picked[1:], strict=False)) and 9 not in picked
    best = [0] * len(pos)
    for i, p in enumerate(pos):
        if p != 9:
            best[i] = 1 + max([best[j] for j in range(i) if pos[j] != 9 and pos[j] < p], default=0)
    assert len(chosen) == max(best, default=0)


@given(st.lists(st.tuples(st.integers(0, 20), st.integers(1, 10)), max_size=25))
@settings(max_examples=200, deadline=None)
def test_levels_are_longest_chains(spans):
    spans = sorted(spans, key=lambda s: (s[0], -s[1]))
    got = K.levels([p for p, _ in spans], [k for _, k in spans])
    chain = []
    for i, (p, k) in enumerate(spans):
        chain.append(1 + max([chain[j] for j in range(i) if sum(spans[j]) > p + k], default=-1))
    assert got == chain


@given(seqs, st.integers(0, 60), st.integers(0, 60))
@settings(max_examples=200, deadline=None)
def test_window(text, a, b):
    pos, size = K.parser(REF).parse(text)
    a, b = min(a, len(text)), min(b, len(text))
    starts = np.concatenate(([0], np.cumsum(size)[:-1])) if size else np.zeros(0)
    assert K.window(REF, pos, size, starts, a, b) == text[a:b]


def test_occurrences_overlap():
    assert K.occurrences(b"aaaa", b"aa") == [0, 1, 2] and K.occurrences(b"a", b"") == []
