import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from seqloom.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][k : k + 8]) for k in range(0, len(out[-1]), 8)])
    return out


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        run = range(i - i % 8, min(i - i % 8 + 8, len(level)))
        out += [level[k] for k in run if k != i]
        i //= 8
    return out


def climb(levels, i, now):
    for level in levels[:-1]:
        a = i - i % 8
        now = digest(*(now if k == i else level[k] for k in range(a, min(a + 8, len(level)))))
        i //= 8
    return now


def slow(rows):
    names = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))) for g in names}
    trees = {g: levels_of([leaf_of(r) for r in groups[g]]) for g in names}
    upper = levels_of([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            text = r[4] if r[4] is None or not bad else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])
            root = climb(upper, k, climb(trees[g], i, leaf_of((*r[:4], text))))
            out.append((r[0], leaf_of(r), trees[g][-1][0], upper[-1][0], digest(*siblings(trees[g], i), *siblings(upper, k)), root, root == upper[-1][0]))
    return out


def rows_of(seed, n, langs):
    rng = random.Random(seed)
    rows = [(i, rng.choice(("web", None, "büro")), rng.choice(langs), rng.choice((None, i)), rng.choice(("Some Text É", "lower only", None, "", "Text " * i))) for i in range(n)]
    return [*rows, *rows[:3], (None, None, None, None, None), (None, "x", langs[0], 3, "A"), (5, "again", langs[0], 1, "Other Text of that id")]


@pytest.mark.parametrize("n,langs,bound", [(0, ["en"], 1 << 16), (7, ["en"], 1 << 16), (150, ["en", None, "é", "z", ""], 1 << 16), (150, ["en", "en", "en", "de"], 40), (120, [f"l{i}" for i in range(80)], 60), (120, [f"l{i}" for i in range(80)], 0)])
def test_equals_the_definition(spark, monkeypatch, n, langs, bound):
    """With all levels broadcast, some, and none."""
    monkeypatch.setattr(merkle, "BROADCAST_NODES", bound)
    rows = rows_of(n, n, langs)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).select("*", F.lit(1).alias("h"), F.lit(2).alias("tree"), F.lit("p").alias("proof"))
    suspect = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    got = [tuple(r) for r in merkle.verify(df, suspect, every=20).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]
    assert sorted(map(str, got)) == sorted(map(str, slow(rows)))
    assert n < 10 or {r[-1] for r in got} == {True, False}


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(3, "s", None, 1, "T")], SCHEMA)
    r = merkle.verify(one, F.lit(False)).first()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.proof_sha256 == digest() and r.verified
    assert merkle.verify(one.limit(0), F.lit(True)).collect() == []
