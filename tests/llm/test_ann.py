import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import ann


def brute(vecs, queries, k):
    out = {}
    for i in queries:
        scores = sorted((-float(np.float64(v) @ np.float64(vecs[i])), j) for j, v in vecs.items() if j != i)
        out[i] = [(j, -s) for s, j in scores[:k]]
    return out


def frame(spark, vecs):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in vecs.items()], "vec_id long, embedding array<float>").withColumn("score", F.lit(1))


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(30, 16))
    vecs = {i: (centres[i % 30] + 0.6 * rng.normal(size=16)).astype(np.float32) * (1 + i % 3) for i in range(3000)}
    df = frame(spark, vecs)
    got = answers(ann.search(ann.build(df, block=700), df.where(ann.is_query()), 20))
    want = brute(vecs, range(0, 3000, 20), 20)
    assert got.keys() == want.keys()
    assert np.mean([len({j for j, _ in got[i]} & {j for j, _ in want[i]}) / 20 for i in want]) > 0.9
    for i, hits in got.items():
        assert len(hits) == 20
        for j, s in hits:
            assert s == pytest.approx(float(np.float64(vecs[i]) @ np.float64(vecs[j])), abs=1e-9)


def test_copies_ties_and_bad_vectors(spark):
    vecs = {i: np.array([1, 0, 0], np.float32) for i in range(300)}
    vecs |= {300: np.array([0, 1, 0], np.float32), 320: np.array([2, 0, 0], np.float32)}
    bad = {400: None, 420: [0, 0, 0], 440: [float("nan"), 1, 1], 460: [float("inf"), 0, 0], 480: [1, 1], 500: []}
    df = frame(spark, vecs | bad)
    nulls = spark.createDataFrame([(520, [1.0, None, 2.0])], "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    df = df.unionByName(nulls)
    got = answers(ann.search(ann.build(df, block=100), df.where(ann.is_query()), 20))
    assert got == brute(vecs, [*range(0, 320, 20), 320], 20)


def test_few_and_none(spark):
    vecs = {0: np.array([1, 2], np.float32), 20: np.array([3, 4], np.float32), 7: np.array([-1, 0], np.float32)}
    df = frame(spark, vecs)
    assert answers(ann.search(ann.build(df), df.where(ann.is_query()), 20)) == brute(vecs, [0, 20], 20)
    twice = df.unionByName(df)
    assert answers(ann.search(ann.build(twice), twice.where(ann.is_query()), 20)) == brute(vecs, [0, 20], 20)
    assert ann.search(ann.build(df.limit(0)), df.limit(0), 20).collect() == []
    alone = df.where("vec_id = 0")
    assert ann.search(ann.build(alone), alone, 20).collect() == []


def test_beam_is_never_worse_than_greedy():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 12)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = ann.fit(x, stages=4, size=16)

    def error(beam):
        codes, _ = books.encode(x, beam)
        return ((x - sum(books.words[s][codes[:, s]] for s in range(4))) ** 2).sum(1).mean()

    assert error(8) <= error(1) + 1e-6


def test_clusters_need_few_cells(spark):
    """Where rows lie in clusters, a query probes a small part of the cells and meets a small part of the blocks."""
    rng = np.random.default_rng(5)
    centres = 3 * rng.normal(size=(200, 16))
    vecs = {i: (centres[i % 200] + 0.15 * rng.normal(size=16)).astype(np.float32) for i in range(6000)}
    df = frame(spark, vecs)
    index = ann.build(df, block=150)
    assert index.count >= 40 and index.cells.probes <= 40
    got, want = answers(ann.search(index, df.where(ann.is_query()), 20)), brute(vecs, range(0, 6000, 20), 20)
    assert np.mean([len({j for j, _ in got[i]} & {j for j, _ in want[i]}) / 20 for i in want]) > 0.9
    assert index.blocks.selectExpr("sum(length(ids))").first()[0] == 8 * len(vecs)


def test_cells_hold_every_row_once():
    """Large cells have blocks of their own, small ones share some, and no block is larger than asked for."""
    words = np.random.default_rng(0).normal(size=(2, 4, 3)).astype(np.float32)
    counts = [(c, n, 2.0 * n) for c, n in ((0, 10), (1, 95), (2, 1000), (5, 30), (6, 30), (7, 60), (15, 250))]
    cells, blocks = ann.deal(counts, words, 100)
    load = np.zeros(blocks)
    for c, n, _ in counts:
        load[cells.first[c] : cells.first[c] + cells.parts[c]] += n / cells.parts[c]
    assert (load > 0).all() and load.max() <= 100 and cells.size[2] == 2 and cells.size[3] == 0
    x = np.random.default_rng(1).normal(size=(500, 3)).astype(np.float32)
    cell, ids = cells.of(x), np.arange(500)
    block = cells.block(cell, ids)
    assert ((block >= cells.first[cell]) & (block < cells.first[cell] + cells.parts[cell])).all()
    order = cells.order(x)
    assert order.shape[1] == len(counts) and set(order.ravel()) == {c for c, _, _ in counts}


def test_rows_that_share_an_id(spark):
    """Of them the least vector counts, wherever their cells are; rows with a null id take no part."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(200)]
    rows += [(i, [float(x) for x in rng.normal(size=4)]) for i in range(0, 200, 10)] + [(None, [9.0, 9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    least = {}
    for i, v in rows[:-1]:
        v = np.array(v, np.float32)
        least[i] = v if i not in least or tuple(v) < tuple(least[i]) else least[i]
    assert answers(ann.search(ann.build(df), df.where(ann.is_query()), 20)) == brute(least, range(0, 200, 20), 20)


def test_doubles_are_scored_as_doubles(spark):
    """Scores come from the given doubles, also where single precision cannot tell rows apart or hold them."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=8)
    vecs = {i: base * (1 + i * 1e-12) for i in range(0, 60)} | {i: 1e60 * rng.normal(size=8) for i in range(60, 90)}
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vecs.items()], "vec_id long, embedding array<double>")
    got, want = answers(ann.search(ann.build(df), df.where(ann.is_query()), 20)), brute(vecs, range(0, 90, 20), 20)
    assert got.keys() == want.keys()
    for i in want:
        assert [s for _, s in got[i]] == pytest.approx([s for _, s in want[i]], rel=1e-14)
    assert [j for j, _ in got[60]] == [j for j, _ in want[60]]


@pytest.mark.parametrize("kind", ["many dimensions", "queries unlike the other rows"])
def test_recall_where_codes_or_probes_of_other_rows_would_miss(spark, kind):
    """Vectors that 12 codewords describe badly; queries that lie anywhere while the other rows lie in few clusters."""
    rng = np.random.default_rng(4)
    if kind == "many dimensions":
        rows = rng.normal(size=(4000, 192))
    else:
        rows = rng.normal(size=(30, 24))[rng.integers(0, 30, 6000)] + 0.02 * rng.normal(size=(6000, 24))
        rows[::20] = 1.5 * rng.normal(size=(300, 24))
    vecs = dict(enumerate(rows.astype(np.float32)))
    df = frame(spark, vecs)
    asked = df.where(ann.is_query())
    got, want = answers(ann.search(ann.build(df, queries=asked), asked, 20)), brute(vecs, range(0, len(rows), 20), 20)
    assert got.keys() == want.keys() and all(len(hits) == 20 for hits in got.values())
    assert np.mean([len({j for j, _ in got[i]} & {j for j, _ in want[i]}) / 20 for i in want]) > 0.9
