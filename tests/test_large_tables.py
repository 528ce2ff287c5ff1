"""What keeps work and memory in step with the tables: compared with plain definitions, or held by what a plan may not do."""

import random

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators import factors as O
from seqloom.operators import blocks, kernels, keys, search
from seqloom.plans import registry
from seqloom.sources import index
from seqloom.sources.sequences import Collection, from_documents


def collection(spark, seed=1, n=12, size=300):
    rng = random.Random(seed)
    ref = "".join(rng.choices("acgtn", [30, 30, 30, 30, 2], k=size))
    texts = [list(ref[rng.randrange(size // 3) :]) for _ in range(n)]
    for t in texts:
        for _ in range(rng.randrange(40)):
            t[rng.randrange(len(t))] = rng.choice("acgtn")
    rows = [(i + 1, f"s{i}", "".join(t)) for i, t in enumerate(texts)]
    return Collection(ref.encode(), spark.createDataFrame(rows, "seq_id long, name string, seq string").repartition(2)), rows


def slow_faults(ref, text, pos, size, start):
    at = runs = gaps = wrong = longer = 0
    for p, k, a in zip(pos, size, start, strict=True):
        own, after = text[a : a + k], text[a + k : a + k + 1]
        runs, gaps, wrong = runs + (p == len(ref)), gaps + (a != at), wrong + (kernels.text_of(ref, p, k) != own)
        longer += after == b"n" if p == len(ref) else after not in (b"", b"n") and own + after in ref or p < 0 and own in ref
        at = a + k
    return runs, gaps + (at != len(text)), wrong, longer


def test_faults_of_a_parse_equal_plain_search():
    """Also of parses that are wrong, with symbols that the words have no code for, and factors beyond the words."""
    rng = random.Random(1)
    for _ in range(200):
        ref = "".join(rng.choices(rng.choice(["acgtn", "ac", "acgtnxy"]), k=rng.randrange(120))).encode()
        texts = ["".join(rng.choices("acgtnx", k=rng.randrange(60))).encode() for _ in range(3)] + [ref[5:45] + b"n" + ref[2:40]]
        columns, counts, want = ([], [], []), [], []
        for t in texts:
            pos, size = kernels.parser(ref).parse(t)
            start = [sum(size[:i]) for i in range(len(size))]
            if pos and rng.random() < 0.6:
                j, kind = rng.randrange(len(pos)), rng.randrange(3)
                if kind == 0 and 0 <= pos[j] < len(ref):
                    pos[j] = rng.randrange(len(ref))
                elif kind == 1 and size[j] > 1:
                    size[j] -= 1
                elif kind == 2:
                    del pos[j], size[j], start[j]
            want.append(slow_faults(ref, t, pos, size, start))
            counts.append(len(pos))
            for c, x in zip(columns, (pos, size, start), strict=True):
                c += x
        bounds = np.cumsum([0, *map(len, texts)])
        got = kernels.faults(ref, np.frombuffer(b"".join(texts), np.uint8), bounds, *(np.array(c, np.int64) for c in columns), np.array(counts))
        assert list(zip(*(x.tolist() for x in got), strict=True)) == want


def test_ranks_leave_factors_in_arrays(spark):
    """Only the factors that were asked for become rows."""
    c, rows = collection(spark)
    places = spark.createDataFrame([(s, a) for s, _, t in rows for a in range(-1, len(t) + 2)] + [(1, None), (None, 1), (99, 0)], "seq_id long, at long")
    met = O.rank(O.parse(c), places, listed=50)
    assert "Generate" not in met._jdf.queryExecution().optimizedPlan().toString()
    want = {(r.seq_id, a): (r.fac_no, r.seq_start, r.len) for r in O.exploded(O.parse(c), len(c.ref)).collect() for a in range(r.seq_start, r.seq_start + r.len)}
    got = met.collect()
    assert {(r.seq_id, r["at"]): (r.fac_no, r.seq_start, r.len) for r in got} == want and len(got) == len(want)


def test_keys_are_written_without_a_shuffle(spark, tmp_path, monkeypatch):
    c, rows = collection(spark, 2)
    index.write(c, f"{tmp_path}/i")

    def never(*a):
        raise AssertionError("keys are dealt over the cluster")

    monkeypatch.setattr(DataFrame, "repartitionByRange", never)
    monkeypatch.setattr(DataFrame, "sortWithinPartitions", never)
    found = index.load(spark, f"{tmp_path}/i")
    index.write_keys(found.parsed, c.ref, f"{tmp_path}/i/keys", rows=50, group_bytes=1024)
    found = index.load(spark, f"{tmp_path}/i")
    n = O.exploded(found.parsed, len(c.ref)).count() - len(rows)
    assert found.keys.by_right.rows.count() == found.keys.by_left.rows.count() == n


@pytest.mark.parametrize("small", [0, 1 << 20])
def test_only_keys_that_are_asked_for_leave_the_tasks(spark, tmp_path, monkeypatch, small):
    """Few borders and parts become rows, from factors and where a saved index is too large for wide ranges; hits are as by definition."""
    c, rows = collection(spark, 3, n=40)
    monkeypatch.setattr(search, "SMALL", small)
    asked = [(0, "acgtt"), (1, "nn"), (2, rows[0][2][40:62]), (3, rows[1][2][10:90]), (4, "tg")]
    patterns = spark.createDataFrame(asked, "pattern_id long, pattern string")
    parsed = O.parse(c).cache()
    every = keys.borders(parsed, c.ref).count()
    long_ones = patterns.where("length(pattern) > 20")
    assert keys.borders(parsed, c.ref, keys.Asked.of(keys.splits(c.ref, long_ones))).count() < every / 5
    assert keys.inside(parsed, c.ref, 1, keys.Held.of(keys.points(c.ref, long_ones))).count() < keys.inside(parsed, c.ref).count() / 2
    index.write(c, f"{tmp_path}/i")
    want = sorted((i, s, a) for i, p in asked for s, t in [(0, c.ref.decode()), *((s, t) for s, _, t in rows)] for a in kernels.occurrences(t.encode(), p.encode()))
    for got in (search.locate(parsed, c.ref, patterns), index.load(spark, f"{tmp_path}/i").locate(patterns)):
        assert sorted(map(tuple, got.select("pattern_id", "seq_id", "pos").collect())) == want


def test_a_batch_is_not_held_as_lists(spark):
    """Factors of one sequence at a time become Python numbers."""
    c, rows = collection(spark, 4)
    batch = O.parse(c).toArrow().combine_chunks().to_batches()[0]
    lists = kernels.factor_lists(batch["pos"], batch["size"])
    assert iter(lists) is lists and next(lists) == (batch["pos"][0].as_py(), batch["size"][0].as_py())
    assert {r.seq_id: r.n for r in O.parse(c).select("seq_id", F.size("pos").alias("n")).collect()}.keys() == {s for s, _, _ in rows}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_blocks_that_start_elsewhere_are_written_again(spark, monkeypatch):
    rng = random.Random(3)
    ref = "".join(rng.choices("acgt", k=400))
    texts = [(i, f"s{i}", "".join(rng.choices("acgtn", [30, 30, 30, 30, 2], k=4000))) for i in range(1, 5)]
    c = Collection(ref.encode(), spark.createDataFrame(texts, "seq_id long, name string, seq string"))
    rows = []

    def counted(df, label):
        out = written(df, label)
        rows.append(out.count() if {"pos", "piece"} & set(out.columns) else 0)
        return out

    written = blocks.written
    monkeypatch.setattr(blocks, "written", counted)
    got = blocks.parse_blocks(c, 200, 100).collect()
    assert sum(rows) <= 1.25 * len(got)
    found = {}
    for r in sorted(got, key=lambda r: (r.seq_id, r.block)):
        found.setdefault(r.seq_id, []).extend(zip(r.pos, r.size, r.start, strict=True))
    for i, _, t in texts:
        pos, size = kernels.parser(c.ref).parse(t.encode())
        assert found[i] == list(zip(pos, size, np.cumsum([0, *size[:-1]]).tolist(), strict=True))


def test_rising_factors_are_restored_without_a_join(spark):
    c, _ = collection(spark, 5)
    parsed = O.parse(c).cache()
    want = O.restore_rising(O.rising(parsed, len(c.ref)), O.exploded(parsed, len(c.ref)))
    got = O.restore_rising(O.rising(parsed, len(c.ref), starts=True))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Join" not in plan_of(registry.QUERIES["rising_restored"](spark, "/root/testdata/sf0.001"))


def test_neighbours_of_factors_come_without_a_window(spark):
    c, _ = collection(spark, 6)
    c.targets = c.targets.unionByName(spark.createDataFrame([(90, "e", ""), (91, "o", "nx"), (92, "a", "a")], c.targets.schema))
    parsed = O.parse(c).cache()
    want, got = O.neighbours(O.exploded(parsed, len(c.ref))), O.with_neighbours(parsed, len(c.ref))
    assert got.columns == want.columns and got.dtypes == want.dtypes
    by = lambda r: (r.seq_id, r.fac_no)
    assert sorted(got.collect(), key=by) == sorted(want.collect(), key=by)
    assert "Window" not in plan_of(registry.QUERIES["factor_neighbours"](spark, "/root/testdata/sf0.001"))


def test_streams_of_a_parse_take_their_length_from_the_factors():
    rng = random.Random(4)
    ref = "".join(rng.choices("acgt", k=3000)).encode()
    short, long_ = "".join(rng.choices("acgt", k=200_000)).encode(), ref[5:2500] * 80
    p, want = kernels.parser(ref), {}
    for t in (short, long_, short):
        got = p.parse(t)
        assert b"".join(kernels.text_of(ref, *f) for f in zip(*got, strict=True)) == t
        assert want.setdefault(t, got) == got
        assert p.block == (1024 if t is long_ else min(1024, max(64, 32 * len(t) // len(got[0]))))
        assert p.block < 400 or t is long_


def test_texts_become_the_same_sequences_in_python_as_in_the_plan(spark):
    """Characters of one to four bytes, null, and rows behind an offset."""
    texts = ["", None, "The 3 Quick\tfoxes\n", "naïve 中文 \U0001f600x\U0001f600", "\x00\x7f{}~", "".join(map(chr, range(1, 800)))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 2)], "doc_id long, text string").coalesce(1)
    c = from_documents(docs, head=2)
    want = {r.seq_id: r.seq for r in c.targets.collect()}
    table = c.raw("seq_id").toArrow().combine_chunks()
    for a in (0, 3):
        part = table.slice(a).to_batches()[0]
        data, bounds = c.symbols()(part.column(1))
        got = [data[x:y].tobytes().decode() for x, y in zip(bounds, bounds[1:])]
        assert got == [want[i] for i in part.column(0).to_pylist()]
    assert {r.seq_id: r.len for r in c.sizes().collect()} == {i: len(s) for i, s in want.items()}
    assert "regexp_replace" not in plan_of(O.packed(c)) + plan_of(O.parse(c)) + plan_of(c.sizes())


def test_packed_factors_are_searched_as_lists_are(spark):
    c, rows = collection(spark, 8)
    c.targets = c.targets.unionByName(spark.createDataFrame([(90, "e", ""), (91, "o", "nx")], c.targets.schema))
    lists, bytes_ = O.parse(c).cache(), O.packed(c).cache()
    pieces = [(i, t[a : a + m]) for i, (a, m) in enumerate([(3, 2), (10, 9), (40, 30), (60, 80)]) for t in [rows[i][2]]]
    asked = spark.createDataFrame([*pieces, (9, "n"), (10, "a"), (11, "xa")], "pattern_id long, pattern string")
    for mode in ("complete", "strict"):
        got, want = (sorted(map(tuple, search.locate(x, c.ref, asked, mode).collect())) for x in (bytes_, lists))
        assert got == want and got
    windows = spark.createDataFrame([(k, s, a, b) for k, (s, a, b) in enumerate([(1, 0, 9), (2, 5, 100), (90, 0, 0), (91, 0, 2), (0, 2, 8), (1, 0, 9999)])], "req_id long, seq_id long, start long, end long")
    got, want = (sorted(search.display(x, c.ref, windows).collect(), key=lambda r: r.req_id) for x in (bytes_, lists))
    assert got == want


def test_patterns_are_drawn_by_many_tasks(spark):
    """The scan for the drawn sequences is not one task's."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(4).localCheckpoint()
    seen = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(registry, "written", lambda df, label: seen.append(plan_of(df)) or df)
        registry.patterns(from_documents(docs))
    assert "Coalesce" not in seen[0]
