import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import jaccard
from seqloom.llm.components import components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def roots(nodes, edges):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    keys = sorted(sets)
    edges = [(a, b) for k, a in enumerate(keys) for b in keys[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = roots(keys, edges)
    return {i: (len(sets[i]), comp[i]) for i in keys}


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sig", F.lit("x")).withColumn("n", F.lit("x")).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(df).collect()}
    assert got == brute(rows)


def corpus(seed, n):
    """Copies, near copies about the limit, families with shared passages, and odd texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(1, 6)))
    passage = [word() for _ in range(40)]
    base = [[word() for _ in range(rng.choice([4, 6, 12, 40, 90]))] for _ in range(8)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one"), (5, "é É"), (6, "x " * 3000)]
    for i in range(7, n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            words[rng.randrange(len(words))] = word()
        if rng.random() < 0.3:
            words = words + passage[: rng.choice([20, 40])]
        rows.append((i, rng.choice([" ", "\n"]).join(words)))
    return rows


@pytest.mark.parametrize("hot", [48, 3])
def test_links_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(jaccard, "HOT", hot)
    check(spark, corpus(hot, 220))


def test_shared_page_with_little_else(spark, monkeypatch):
    """Many documents of one passage and a few own words: hot shingles fill every prefix, hardly any pair links."""
    monkeypatch.setattr(jaccard, "HOT", 5)
    rng = random.Random(1)
    page = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(90):
        words = list(page)
        for _ in range(rng.choice([1, 2, 3])):
            words[rng.randrange(60)] = f"u{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    check(spark, rows)


def test_repeated_rows_keep_every_candidate(spark, monkeypatch):
    """A shared page whose rows stand twice under their id, some in other letters: no linked pair may be left out."""
    monkeypatch.setattr(jaccard, "HOT", 5)
    rng = random.Random(2)
    page = [f"p{i}" for i in range(104)]
    rows = []
    for i in range(30):
        words = list(page)
        for at in rng.sample(range(5, 99), rng.choice([1, 2])):
            words[at] = f"u{i}x{at}"
        rows += [(i, " ".join(words)), (i, " ".join(words).upper() if i % 2 else " ".join(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = jaccard.materialize(jaccard.sets_of(docs), "sets")
    none = spark.createDataFrame([], "node long, comp long")
    got = {(r.a, r.b) for r in jaccard.candidate_pairs(docs, sets, jaccard.shared_entries(sets), none, []).collect()}
    made = {jaccard.class_of(x): set(x.tolist()) for x in (jaccard.Shingler()(t) for _, t in rows)}
    want = {(a, b) for a in made for b in made if a < b and 100 * len(made[a] & made[b]) >= 80 * len(made[a] | made[b])}
    assert want and want <= got
    wanted = spark.createDataFrame([(x,) for x in made], "sig long")
    assert jaccard.full_sets(docs, sets, wanted).count() == len(made)


def test_empty_table_and_repeats(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.link(df).collect() == []
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")]
    got = sorted(map(tuple, jaccard.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]


def test_pack_round_trip():
    x = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2))
    assert (jaccard.unpack(jaccard.pack(x)) == x.view(np.int64)).all()


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500 + rng.randrange(60), 500 + rng.randrange(60)) for _ in range(45)] + [(7, 7)] + [(900, i) for i in range(901, 950)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots({x for e in edges for x in e}, edges)
    assert got == {x: c for x, c in want.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_no_filter_for_too_many_tokens(spark, monkeypatch):
    """Without the filter more entries are written, but the links are the same."""
    monkeypatch.setattr(jaccard, "FILTER_BITS", 3)
    assert jaccard.token_filter(spark.range(3).withColumnRenamed("id", "token")) is None
    texts = [(i, " ".join(f"w{(i // 3) * 100 + k}" for k in range(40)) + f" end{i}") for i in range(12)]
    got = {r.doc_id: r.component_id for r in jaccard.link(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {i: i // 3 * 3 for i in range(12)}


def test_representatives_go_by_id_and_text(spark):
    """Of an id with two texts only the one that links to a smaller id goes; rows without an id stay."""
    page = " ".join(f"w{k}" for k in range(30))
    rows = [(1, page), (2, page), (2, "quite another text of its own words"), (3, page + " x"), (None, page), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as t", "8 as sig", "9 as n")
    kept = jaccard.representatives(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([rows[0], rows[2], rows[4], rows[5]], key=str)


def test_one_row_of_each_component_stays(spark):
    """Also where the least id has several rows, whatever their other columns and the names of these are."""
    page, other = " ".join(f"w{k}" for k in range(30)), " ".join(f"v{k}" for k in range(30))
    rows = [(1, page, "a"), (1, page, "b"), (1, page + " x", "c"), (1, other, "d"), (2, page, "e"), (3, other, "f"), (4, None, "g"), (4, None, "g"), (5, "own words", "h"), (5, "own words", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _c0 string").selectExpr("*", "map('k', 1) as m", "1 as comp").repartition(4)
    kept = jaccard.representatives(df)
    assert kept.columns == df.columns
    got = sorted((r.doc_id, (r.text or "-").split()[0], r._c0) for r in kept.collect())
    assert [g[:2] for g in got] == [(1, "v0"), (1, "w0"), (4, "-"), (4, "-"), (5, "own")]
    assert {g[2] for g in got if g[1] == "w0"} < {"a", "b", "c"}
