import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqloom.llm import fim

ROWS = [(i, t) for i, t in enumerate(["", None, "a", "ab", "é漢😀x" * 9, "same text here", "same text here", "with <P> mark", "<M>", "<<S>", "<", "><M", "q" * 300_000, "é" * 50, "tab\tand\nline\n\nend"])] + [(5, "same text here"), (5, "other text"), (None, "no id"), (None, None), (40, "same text here")] + [(100 + i, "copy of many " * 3) for i in range(60)] + [(200 + i, f"text {i} é <" + "x" * i) for i in range(60)]


def slow(doc_id, text, units=list, rate=90):
    """The definition, on lists of units."""
    text = text or ""
    s = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(s[k : k + 8], 16) for k in (0, 8, 16, 24)]
    u = units(text)
    n = len(u)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, e = "".join(u[:i]), "".join(u[i:j]), "".join(u[j:])
    return (doc_id, n, "spm", len(p), len(m), f"<S>{e}<P>{p}<M>{m}") if h[3] % 100 < 20 else (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{e}<M>{m}")


def words(text):
    out = []
    for c in text:
        if out and not (c not in "\t\n\x0b\x0c\r " and out[-1][-1] in "\t\n\x0b\x0c\r "):
            out[-1] += c
        else:
            out.append(c)
    return out


@pytest.mark.parametrize("unit,units", [("char", list), ("word", words), ("line", lambda t: t.splitlines(True) if "\x0b" not in t else [t])])
def test_equals_the_definition(spark, unit, units):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(4).select("*", F.lit(1).alias("places"), F.lit("x").alias("form"), F.lit(2).alias("digest"))
    got = fim.transform(df, unit, part_bytes=200)
    back = got.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = [slow(i, t, units) for i, t in ROWS]
    assert sorted(map(str, (tuple(r)[:-1] for r in back))) == sorted(map(str, want))
    assert {f for _, _, f, *_ in want} == {"plain", "psm", "spm"}
    texts = {w[-1]: t or "" for w, (_, t) in zip(want, ROWS, strict=True)}
    assert all(r.back == texts[r.output] for r in back)


def test_empty(spark):
    assert fim.transform(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=2000), st.integers(0, 3))
def test_elias_fano(gaps, scale):
    numbers = np.cumsum(np.array(gaps, np.int64) * (0, 1, 40, 10**7)[scale])
    packed = fim.EliasFano.of(numbers)
    again = fim.EliasFano.load(packed.dump())
    assert len(again) == len(numbers)
    for i in {0, 1, len(numbers) // 2, len(numbers) - 1, *range(0, len(numbers), 97)}:
        if 0 <= i < len(numbers):
            assert packed[i] == again[i] == numbers[i]


def test_lists_are_small():
    text = "é漢 plain text " * 5000
    assert len(fim.EliasFano.of(fim.boundaries(text.encode())).dump()) < len(text.encode()) / 2
