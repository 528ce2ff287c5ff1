import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom import cli
from seqloom.functions import symbols as S
from seqloom.operators import factors as O
from seqloom.operators import blocks, kernels, keys, search, suffixes
from seqloom.operators.asof import asof_join
from seqloom.operators.range_join import range_join
from seqloom.operators.running import running_sums
from seqloom.sources import factor_files, index, reference
from seqloom.sources.sequences import Collection, from_documents, read_files, write_texts
from seqloom.streaming import requests as streams


def collection(spark, ref, targets):
    df = spark.createDataFrame([(i, f"s{i}", t) for i, t in targets], "seq_id long, name string, seq string").repartition(3)
    return Collection(ref.encode(), df)


def family(seed, n=12, size=120):
    rng = random.Random(seed)
    ref = "".join(rng.choices("acgtn", [30, 30, 30, 30, 2], k=size))
    out = []
    for i in range(1, n):
        t = list(ref[rng.randrange(size // 3) :])
        for _ in range(rng.randrange(8)):
            t[rng.randrange(len(t))] = rng.choice("acgtn")
        out.append((i, "".join(t)))
    return ref, [*out, (n, ""), (n + 1, "nnnn"), (n + 2, ref), (n + 3, ref.upper())]


def factor_rows(ref, text):
    pos, size = kernels.parser(ref.encode()).parse(text.lower().encode())
    out, at = [], 0
    for p, k in zip(pos, size, strict=True):
        out.append((p, k, at))
        at += k
    return out


def brute_hits(ref, targets, patterns):
    """(pattern, seq, pos, factors met, meets a run of n) by definition."""
    out = []
    for pid, p in patterns:
        p = p.lower()
        if not p or set(p) - set("acgnt"):
            continue
        for s, t in [(0, ref), *targets]:
            t = t.lower()
            rows = factor_rows(ref, t) if s else []
            for i in range(len(t) - len(p) + 1):
                if t[i : i + len(p)] == p:
                    met = [r for r in rows if r[2] < i + len(p) and r[2] + r[1] > i]
                    out.append((pid, s, i, len(met), any(r[0] == len(ref) for r in met)))
    return out


PATTERNS = [(0, "a"), (1, "ac"), (2, "gta"), (3, "nn"), (4, "ACGT"), (5, "tgcat"), (6, "xa"), (7, ""), (8, "n")]


def own_patterns(seed, targets):
    """Pieces of the targets of all lengths, so that they meet borders, chains of factors and runs of n."""
    rng = random.Random(seed)
    texts = [t for _, t in targets if len(t) > 60]
    pieces = [t[a : a + k] for t in texts for k in (2, 3, 5, 9, 17, 40, 60) for a in [rng.randrange(len(t) - k + 1)]]
    return [(100 + i, p) for i, p in enumerate(pieces)]


@pytest.mark.parametrize("seed", [1, 2])
def test_search_modes_equal_brute_force(spark, seed):
    ref, targets = family(seed)
    c = collection(spark, ref, targets)
    parsed = O.parse(c).cache()
    asked = PATTERNS + own_patterns(seed, targets)
    patterns = spark.createDataFrame(asked, "pattern_id long, pattern string")
    want = brute_hits(ref, targets, asked)
    got = lambda df: sorted(map(tuple, df.select("pattern_id", "seq_id", "pos").collect()))
    assert got(search.locate(parsed, c.ref, patterns)) == sorted(w[:3] for w in want)
    strict = sorted(w[:3] for w in want if not w[1] or w[3] <= 2 and not w[4])
    assert got(search.locate(parsed, c.ref, patterns, "strict")) == strict
    assert got(search.in_targets(parsed, c.ref, patterns, "in_factor")) == sorted(w[:3] for w in want if w[1] and w[3] == 1 and not w[4])
    assert got(search.in_targets(parsed, c.ref, patterns, "boundary")) == sorted(w[:3] for w in want if w[1] and w[3] == 2 and not w[4])
    counts = {r.pattern_id: r.n for r in search.count(parsed, c.ref, patterns).collect()}
    assert counts == {i: sum(w[0] == i for w in want) for i, _ in asked}


def test_worked_example(spark):
    c = collection(spark, "acgtacgn", [(1, "acgtannncgtt")])
    parsed = O.parse(c)
    rows = O.numbered(parsed, 8).orderBy("fac_id").collect()
    assert [(r.pos, r.len, r.is_n, r.abs_start) for r in rows] == [(0, 5, False, 0), (8, 3, True, 5), (1, 3, False, 8), (3, 1, False, 11)]
    one = lambda p, mode: sorted((r.seq_id, r.pos) for r in search.locate(parsed, c.ref, spark.createDataFrame([(0, p)], "pattern_id long, pattern string"), mode).collect())
    assert one("gta", "strict") == [(0, 2), (1, 2)] and one("gtt", "strict") == [(1, 9)] and one("ann", "strict") == [] and one("ann", "complete") == [(1, 4)]
    asked = [(10 * a + b, 1, a, b) for a in range(13) for b in range(13)]
    got = {r.req_id: r.text for r in search.display(parsed, c.ref, spark.createDataFrame(asked, "req_id long, seq_id long, start long, end long")).collect()}
    assert all(got[i] == ("" if a >= b else "acgtannncgtt"[a:b] if b <= 12 else None) for i, _, a, b in {q[0]: q for q in asked}.values() if list(x[0] for x in asked).count(i) == 1)


def test_parse_and_derived_tables(spark):
    ref, targets = family(3)
    targets.append((99, "acgx"))
    c = collection(spark, ref, targets)
    parsed = O.parse(c).cache()
    assert {r.seq_id: r.seq for r in O.expand(parsed, c.ref).collect()} == {i: t.lower() for i, t in targets}
    assert tuple(O.round_trip(c, parsed).first()) == (len(targets), sum(len(t) for _, t in targets), 0)
    want = {i: factor_rows(ref, t) for i, t in targets}
    rows = O.numbered(parsed, len(ref)).collect()
    assert sorted((r.seq_id, r.fac_no, -1 if r.pos is None else r.pos, r.len, r.seq_start) for r in rows) == sorted((i, n, max(p, -1), k, a) for i, fs in want.items() for n, (p, k, a) in enumerate(fs))
    assert [r.literal for r in rows if r.pos is None] == ["x"]
    ids = sorted(rows, key=lambda r: (r.seq_id, r.fac_no))
    assert [r.fac_id for r in ids] == list(range(len(ids)))
    base, at = 0, {}
    for i, t in sorted(targets):
        at[i], base = base, base + len(t)
    assert all(r.abs_start == at[r.seq_id] + r.seq_start for r in rows)
    stats = {r.seq_id: r for r in O.statistics(parsed, len(ref)).collect()}
    for i, fs in want.items():
        assert (stats[i].n_factors, stats[i].n_runs, stats[i].longest) == (len(fs), sum(p == len(ref) for p, _, _ in fs), max([k for p, k, _ in fs if p != len(ref)], default=0))
    near = {(r.seq_id, r.fac_no): (r.prev_len, r.next_len) for r in O.neighbours(O.exploded(parsed, len(ref))).collect()}
    assert all(v == (want[i][n - 1][1] if n else None, want[i][n + 1][1] if n + 1 < len(want[i]) else None) for (i, n), v in near.items())
    real = [(p, k) for fs in want.values() for p, k, _ in fs if 0 <= p < len(ref)]
    assert {(r.kind, r.pos): r.n for r in O.sites(O.exploded(parsed, len(ref))).collect()} == {(kind, x): n for kind, xs in (("start", [p for p, _ in real]), ("end", [p + k for p, k in real])) for x in set(xs) for n in [xs.count(x)]}
    spans = sorted(set(real), key=lambda s: (s[0], -s[1]))
    for block in (7, 4096):
        assert {(r.pos, r.len): r.level for r in O.nested_levels(O.exploded(parsed, len(ref)), block).collect()} == dict(zip(spans, kernels.levels([p for p, _ in spans], [k for _, k in spans]), strict=True))
    short = {(r.seq_id, r.fac_no): r.text for r in O.short_factors(O.exploded(parsed, len(ref)), c.ref).collect()}
    assert short == {(i, n): kernels.text_of(c.ref, p, k).decode() for i, fs in want.items() for n, (p, k, _) in enumerate(fs) if kernels.is_short(c.ref, p, k)}


def test_places_in_the_collection(spark):
    ref, targets = family(5)
    c = collection(spark, ref, targets)
    joined = [(i, k) for i, t in sorted(targets) for k in range(len(t))]
    got = O.in_sequences(spark.range(len(joined) + 5).withColumnRenamed("id", "abs_pos"), O.catalog(O.parse(c)))
    assert {r.abs_pos: (r.seq_id, r.pos) for r in got.collect()} == dict(enumerate(joined))


def test_literals_are_found(spark):
    """Symbols that the reference sequence lacks are factors of their own."""
    targets = [(1, "aactgat"), (2, "ttnnt")]
    c = collection(spark, "acaggc", targets)
    asked = [(i, p) for i, p in enumerate(["t", "at", "ta", "ctg", "ct", "tn", "tt", "nnt", "actga", "n", "g"])]
    got = search.locate(O.parse(c), c.ref, spark.createDataFrame(asked, "pattern_id long, pattern string")).collect()
    assert sorted(map(tuple, got)) == sorted(h[:3] for h in brute_hits("acaggc", targets, asked))
    rows = spark.createDataFrame([(0, "aca"), (1, "aca"), (5, "c"), (5, "cc"), (None, "c")], "p long, t string")
    assert sorted((r.p if r.p is not None else -1, r.t, r.same) for r in search.same_in_reference(rows, c.ref, F.col("p"), F.col("t")).collect()) == [(-1, "c", False), (0, "aca", True), (1, "aca", False), (5, "c", True), (5, "cc", False)]
    counted = search.count(O.parse(c), c.ref, spark.createDataFrame(asked, "pattern_id long, pattern string"))
    n = [sum(h[0] == i for h in brute_hits("acaggc", targets, asked)) for i, _ in asked]
    assert tuple(search.workload(counted, counted).first()) == (len(asked), sum(len(p) for _, p in asked), sum(n), max(n), n.count(0))


def test_search_in_a_saved_index_equals_brute_force(spark, tmp_path):
    """With the saved keys, over several files and many row groups; patterns that need texts beyond the words are among them."""
    ref, targets = family(11, n=30, size=400)
    c = collection(spark, ref, targets)
    index.write(c, f"{tmp_path}/i")
    found = index.load(spark, f"{tmp_path}/i")
    index.write_keys(found.parsed, c.ref, f"{tmp_path}/i/keys", rows=40, group_bytes=1024)
    asked = PATTERNS + own_patterns(11, targets)
    patterns = spark.createDataFrame(asked, "pattern_id long, pattern string")
    want = brute_hits(ref, targets, asked)
    found = index.load(spark, f"{tmp_path}/i")
    assert sorted(map(tuple, found.locate(patterns).collect())) == sorted(w[:3] for w in want)
    assert {r.pattern_id: r.n for r in found.count(patterns, "strict").collect()} == {i: sum(w[0] == i and (not w[1] or w[3] <= 2 and not w[4]) for w in want) for i, _ in asked}


def test_a_search_reads_a_part_of_the_keys(spark, tmp_path, monkeypatch):
    """Of the rows of the keys, fewer than a tenth leave the scans for 10 patterns of 20 symbols or more."""
    monkeypatch.setattr(search, "SMALL", 0)
    rng = random.Random(3)
    ref = "".join(rng.choices("acgt", k=20_000))
    targets = [(i, "".join(ref[a : a + rng.randrange(8, 60)] for _ in range(1500) for a in [rng.randrange(len(ref) - 60)])) for i in range(1, 121)]
    c = collection(spark, ref, targets)
    index.write(c, f"{tmp_path}/i")
    index.write_keys(index.load(spark, f"{tmp_path}/i").parsed, c.ref, f"{tmp_path}/i/keys", rows=1 << 14, group_bytes=1 << 12)
    found = index.load(spark, f"{tmp_path}/i")
    asked = [(i, targets[i][1][a : a + k]) for i, k in enumerate((20, 20, 21, 22, 25, 28, 30, 36, 44, 52)) for a in [rng.randrange(20_000)]]
    patterns = spark.createDataFrame(asked, "pattern_id long, pattern string")
    read = total = 0
    for table, rows, lo, hi in ((found.keys.by_right, keys.splits(c.ref, patterns).where("tag > 0"), "lo", "hi"), (found.keys.by_left, keys.splits(c.ref, patterns).where("tag < 0"), "lo", "hi"), (found.keys.inside, keys.points(c.ref, patterns), "key", "key")):
        pruned = table.within(*keys.ranges(rows, lo, hi))
        pruned.collect()
        scans = pruned._jdf.queryExecution().executedPlan().collectLeaves()
        read += sum(scans.apply(k).metrics().apply("numOutputRows").value() for k in range(scans.size()))
        total += table.rows.count()
    assert total > 100_000 and 0 < read < total / 10
    got = sorted(map(tuple, found.locate(patterns).collect()))
    assert got == sorted((i, s, a) for i, p in asked for s, t in [(0, ref), *targets] for a in kernels.occurrences(t.encode(), p.encode()))


def test_parts_of_a_factor_do_not_grow_with_its_length(spark):
    """At most two parts of each size cover factors of any length, and every place in one is in one part."""
    rng = random.Random(2)
    for size in (1, 15, 16, 17, 1000, 10**6):
        low = np.array([rng.randrange(10**7) for _ in range(20)])
        high = low + size
        rows = [(i, int(k) >> keys.LEVEL, int(k) & ((1 << keys.LEVEL) - 1)) for lanes, ks in keys.parts(low, high) for i, k in zip(lanes.tolist(), ks.tolist(), strict=True)]
        for i in range(20):
            own = sorted((at << level, (at + 1) << level) for j, level, at in rows if j == i)
            assert own[0][0] == low[i] and own[-1][1] == high[i] and all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False))
            assert len(own) <= 2 * max(1, size.bit_length())
    ref = "".join(rng.choices("acgt", k=1_500_000))
    c = collection(spark, ref, [(1, ref[1000:1_001_000] + ref[400_000:1_400_000])])
    parsed = O.parse(c).cache()
    assert keys.inside(parsed, c.ref).count() <= 40 * O.exploded(parsed, len(ref)).count()
    asked = [(0, ref[500_000:500_030]), (1, ref[999_000:1_000_900])]
    got = sorted(map(tuple, search.in_targets(parsed, c.ref, spark.createDataFrame(asked, "pattern_id long, pattern string")).collect()))
    assert got == [(0, 1, 499_000), (0, 1, 1_100_000), (1, 1, 998_000), (1, 1, 1_599_000)]


@pytest.mark.parametrize("block,ahead", [(16, 4), (64, 64), (1 << 20, 1 << 16)])
def test_blocks_give_the_same_factors(spark, block, ahead):
    """Also where one factor covers many blocks, or reaches further than a block's piece."""
    ref, targets = family(7, n=6, size=500)
    targets += [(50, ref * 3 + "n" * 100 + ref[17:] + "x"), (51, None), (52, "n" * 90)]
    c = collection(spark, ref, targets)
    got = {}
    for r in sorted(blocks.parse_blocks(c, block, ahead).collect(), key=lambda r: (r.seq_id, r.block)):
        assert all(r.block * block <= a < (r.block + 1) * block for a in r.start)
        got.setdefault(r.seq_id, []).extend(zip(r.pos, r.size, r.start, strict=True))
    assert got == {i: factor_rows(ref, t or "") for i, t in targets}


def test_a_saved_suffix_array_is_used(spark, tmp_path, monkeypatch):
    ref, targets = family(8, n=4)
    c = collection(spark, ref + "acgacg", targets)
    index.write(c, f"{tmp_path}/i")
    monkeypatch.setattr(reference, "_places", {})
    monkeypatch.setattr(reference, "suffix_array", None)  # building another one would fail
    asked = [(0, "acg"), (1, "nn")]
    got = index.load(spark, f"{tmp_path}/i").locate(spark.createDataFrame(asked, "pattern_id long, pattern string"))
    assert sorted(map(tuple, got.collect())) == sorted(h[:3] for h in brute_hits(ref + "acgacg", targets, asked))


def slow_bits(ref, pos, size, short, liss):
    """Bits by the lengths of the codes, factor by factor."""
    total = 0
    for kind, p, k in kernels.plan(ref, pos, size, short, liss):
        rice = lambda n, d: n // d + d.bit_length()
        total += liss + (short if kind in "fh" else 0)
        if kind == "s":
            total += 1 + rice(k, 8) + 2 * k
        else:
            total += rice(k, 64) + (kernels.width_of(ref) if kind in "fh" else 1 if not p else 2 + rice(abs(p), 64))
    return total


def test_encodings(spark):
    ref, targets = family(4)
    c = collection(spark, ref, targets)
    parsed = O.parse(c).cache()
    bits = {r.seq_id: r for r in O.encoded_bits(parsed, c.ref).collect()}
    for text in (False, True):
        for short in (False, True):
            for liss in (False, True):
                files = factor_files.encode(parsed, c.ref, text, short, liss)
                assert {r.seq_id: r.seq for r in factor_files.decode(files, c.ref).collect()} == {i: t.lower() for i, t in targets}
                joined = {}
                for r in sorted(factor_files.factors(files, c.ref).collect(), key=lambda r: (r.seq_id, r.fac_no)):
                    joined[r.seq_id] = joined.get(r.seq_id, "") + r.text
                assert joined == {i: t.lower() for i, t in targets if t}
    for i, t in targets:
        pos, size = kernels.parser(c.ref).parse(t.lower().encode())
        assert [bits[i].plain, bits[i].liss, bits[i].short, bits[i].short_liss] == [slow_bits(c.ref, pos, size, s, li) for s in (False, True) for li in (False, True)]
    chosen = O.rising(parsed, len(ref))
    assert all(r.pos == r.restored for r in O.restore_rising(chosen, O.exploded(parsed, len(ref))).collect())
    codes = O.code_strings(O.exploded(parsed, len(ref)), len(ref)).limit(50).collect()
    assert all(len(r.pos_bits) == kernels.width_of(c.ref) for r in codes)


def test_helpers(spark):
    df = spark.createDataFrame([(i * 37 % 1000, i) for i in range(200)], "k long, v long").repartition(5)
    got = {r.k: r.s for r in running_sums(df, "k", {"s": "v"}, rows=50).collect()}
    total, want = 0, {}
    for k, v in sorted((i * 37 % 1000, i) for i in range(200)):
        want[k], total = total, total + v
    assert got == want
    rng = random.Random(1)
    spans, points = [(i, a, a + rng.randrange(90)) for i in range(80) for a in [rng.randrange(300)]], [(i, rng.randrange(400)) for i in range(80)]
    found = range_join(spark.createDataFrame(points, "j long, p long"), spark.createDataFrame(spans, "i long, lo long, hi long"), "p", "lo", "hi", width=16)
    assert sorted((r.i, r.j) for r in found.collect()) == sorted((i, j) for i, lo, hi in spans for j, p in points if lo <= p < hi)


@pytest.mark.parametrize("ref", [b"", b"a", b"acgtacgn" * 30 + b"acgtt", b"a" * 150])
def test_suffix_ranks_equal_plain_sorting(spark, ref):
    """Over several ranges and pieces, with repeats longer than the words."""
    got = [(r.rank, r.pos) for r in suffixes.suffix_ranks(spark, ref, every=60, piece=50).collect()]
    assert sorted(got) == list(enumerate(sorted(range(len(ref) + 1), key=lambda i: ref[i:])))


@pytest.mark.parametrize("each", [1 << 20, 37])
def test_reference_in_ranges(spark, monkeypatch, tmp_path, each):
    """Files that tasks have written hold what the driver's do, and parses, searches and a saved index on them are the same."""
    ref, targets = family(12, n=5, size=90)
    ref += "acg" * 40
    targets.append((40, ref[20:] + ref))
    c = collection(spark, ref, targets)
    rows = lambda: sorted((r.seq_id, r.pos, r.size, r.start) for r in O.parse(c).collect())
    want, one = rows(), kernels.parser(c.ref)
    before = dict(reference._places)
    try:
        reference._places.clear()
        monkeypatch.setattr(reference, "WHOLE", 10)
        save = reference.save_ranges
        monkeypatch.setattr(reference, "save_ranges", lambda s, r, f: save(s, r, f, each, 50, 40))
        assert rows() == want
        several = reference.parser(reference.stored(spark, c.ref))
        for a, b in ((several.array, one.array), (several.packed, one.packed), (several.ranked, one.ranked)):
            assert a[np.arange(len(ref) + 1)].tolist() == b.tolist()
        assert len(several.array.parts) == -(-(len(ref) + 1) // each)
        index.write(c, str(tmp_path / "i"))
        ix = index.load(spark, str(tmp_path / "i"))
        p = spark.createDataFrame([(0, ref[30:48]), (1, "acgacg"), (2, "n")], "pattern_id long, pattern string")
        got = {r.pattern_id: r.n for r in ix.count(p).collect()}
        texts = [ref, *(t.lower() for _, t in targets)]
        assert got == {i: sum(len(kernels.occurrences(t.encode(), q.encode())) for t in texts) for i, q in ((0, ref[30:48]), (1, "acgacg"), (2, "n"))}
        assert {"suffixes", "ranked", "packed", "symbols"} <= {r.component for r in ix.sizes().collect()}
    finally:
        reference._places.clear()
        reference._places.update(before)


@pytest.mark.parametrize("every", [7, 1 << 17])
def test_asof_join_equals_definition(spark, every):
    rng = random.Random(every)
    spans = [(g, a, g * 1000 + a) for g in range(4) for a in rng.sample(range(60), 12)] + [(None, 3, 1)]
    requests = [(i, rng.choice((0, 1, 2, 3, 9, None)), rng.choice((None, rng.randrange(70)))) for i in range(200)]
    got = asof_join(spark.createDataFrame(requests, "i long, g long, at long"), spark.createDataFrame(spans, "g long, a long, v long"), "g", "at", "a", every)
    want = {i: max(((a, v) for h, a, v in spans if h == g and at is not None and a <= at), default=(None, None)) if g is not None else (None, None) for i, g, at in requests}
    assert {r.i: (r.a, r.v) for r in got.collect()} == want and got.columns == ["i", "g", "at", "a", "v"]


def test_many_places_of_one_sequence(spark):
    """A million places, all in one sequence, meet their factors."""
    ref, targets = family(9, n=3, size=400)
    text = "".join(t for _, t in targets) * 40
    c = collection(spark, ref, [(1, text), (2, "")])
    places = spark.range(1_000_000).select("id", F.lit(1).cast("long").alias("seq_id"), (F.col("id") % (len(text) + 50)).alias("at"))
    met = O.rank(O.parse(c), places).select("id", "at", "pos", "len", (F.col("at") - F.col("seq_start")).alias("offset"))
    found = O.symbols_at(met, c.ref).groupBy("at").agg(F.min("symbol").alias("low"), F.max("symbol").alias("high"), F.count("*").alias("n")).collect()
    assert {r["at"]: (r.low, r.high) for r in found} == {i: (x, x) for i, x in enumerate(text.lower())}
    assert sum(r.n for r in found) == sum(i % (len(text) + 50) < len(text) for i in range(1_000_000))


def test_times_of_a_workload(spark, tmp_path):
    ref, targets = family(3, n=4)
    c = collection(spark, ref, targets)
    asked = spark.createDataFrame([(0, "ac"), (1, "tttttttttt")], "pattern_id long, pattern string")
    times = search.timed(search.count(O.parse(c), c.ref, asked), F.col("n"), f"{tmp_path}/n")
    hits = len(brute_hits(ref, targets, [(0, "ac"), (1, "tttttttttt")]))
    assert (times.answers, times.units) == (2, hits) and times.seconds > 0 and abs(times.micros - 1e6 * times.seconds / hits) < 1e-6
    assert spark.read.parquet(f"{tmp_path}/n").count() == 2


def test_symbol_expressions(spark):
    row = spark.range(1).select(*[S.code(F.lit(x)).alias(f"c{i}") for i, x in enumerate("acgntAx")], S.two_bit(F.lit("t")), S.base_of(F.lit(2)), S.is_power_of_two(F.lit(64)), S.is_power_of_two(F.lit(1)), S.log2_of(F.lit(64)), S.position_bits(F.lit(8)), S.short_limit(F.lit(24)), S.rice_bits(F.lit(200), 64), S.rice(F.lit(130), 64), S.from_rice(S.rice(F.lit(130), 8), 8)).first()
    assert tuple(row) == (1, 2, 3, 4, 5, 1, 0, 3, "g", True, False, 6, 4, 12, 10, "110000010", 130)


def test_files_index_and_command_line(spark, tmp_path, capsys):
    ref, targets = family(5, n=4)
    paths = []
    for name, t in [("ref", ref), *((f"t{i}", t) for i, t in targets[:3])]:
        (tmp_path / name).write_text(t)
        paths.append(str(tmp_path / name))
    want = {f"t{i}": t for i, t in targets[:3]}
    cli.main(["compress", f"{tmp_path}/packed", *paths, "-s", "-l"], spark)
    cli.main(["decompress", f"{tmp_path}/texts", paths[0], f"{tmp_path}/packed"], spark)
    for name, t in want.items():
        assert (tmp_path / "texts" / name).read_text() == t.lower()
    cli.main(["index", f"{tmp_path}/full", *paths], spark)
    cli.main(["index", f"{tmp_path}/light", *paths, "-r"], spark)
    for where in ("full", "light"):
        assert cli.main(["display", f"{tmp_path}/{where}"], spark, ["1 3 9", "0 0 5", "", "0 0 1"]) == [targets[0][1][3:9], ref[:5]]
    hits = brute_hits(ref, targets[:3], [(0, "ac"), (1, "tttttttttt")])
    assert cli.main(["count", f"{tmp_path}/full"], spark, ["ac", "tttttttttt"]) == [f"ac : {sum(h[0] == 0 for h in hits)}", f"tttttttttt : {sum(h[0] == 1 for h in hits)}"]
    assert cli.main(["locate", f"{tmp_path}/full", "--times"], spark, ["ac"]) == [f"{s} {p}" for _, s, p in sorted(h[:3] for h in hits if h[0] == 0)]
    assert f"locate: {sum(h[0] == 0 for h in hits)} answers" in capsys.readouterr().err
    with pytest.raises(ValueError, match="display only"):
        cli.main(["count", f"{tmp_path}/light"], spark, ["ac"])
    full = index.load(spark, f"{tmp_path}/full")
    sizes = {r.component: (r.files, r.bytes) for r in full.sizes().collect()}
    assert set(sizes) == {"reference", "parsed", "catalog", "keys/by_right", "keys/by_left", "keys/inside", "keys/buckets", "symbols", "suffixes", "packed", "ranked"}
    on_disk = [f for f in (tmp_path / "full").rglob("*") if f.is_file() and f.name[0] not in "._"]
    assert sum(n for n, _ in sizes.values()) == len(on_disk) and sum(b for _, b in sizes.values()) == sum(f.stat().st_size for f in on_disk)
    assert {r.component for r in index.load(spark, f"{tmp_path}/light").sizes().collect()} == {"reference", "parsed", "catalog"}
    files = factor_files.encode(O.parse(read_files(spark, paths)), full.ref)
    assert factor_files.write(files, f"{tmp_path}/fac") == len(want) and {f.name for f in (tmp_path / "fac").iterdir() if f.suffix == ".fac"} == {f"{n}.fac" for n in want}
    back = factor_files.decode(factor_files.read(spark, f"{tmp_path}/fac"), full.ref)
    assert sorted(r.seq for r in back.collect()) == sorted(t.lower() for t in want.values())


def test_bad_symbols(spark, tmp_path):
    (tmp_path / "r").write_text("acgt")
    (tmp_path / "t").write_text("acgZt")
    paths = [str(tmp_path / "r"), str(tmp_path / "t")]
    with pytest.raises(Exception, match="invalid symbol 'Z' at 3 of t"):
        read_files(spark, paths).targets.collect()
    assert read_files(spark, paths, clean=True).targets.first().seq == "acgnt"


def test_documents_and_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Ab c"), (2, None), (3, "é!"), (None, "x"), (4, "abc")], "doc_id long, text string")
    c = from_documents(docs, head=2)
    assert c.ref == b"acggn" and {r.seq_id: r.seq for r in c.targets.collect()} == {4: "nn", 5: "acg"}
    empty = from_documents(docs.limit(0))
    assert empty.ref == b"" and O.parse(empty).collect() == []
    patterns = spark.createDataFrame(PATTERNS, "pattern_id long, pattern string")
    assert {r.n for r in search.count(O.parse(empty), b"", patterns).collect()} == {0}
    assert write_texts(c.targets.limit(0), f"{tmp_path}/none") == 0


def test_streams(spark, tmp_path):
    ref, targets = family(6, n=5)
    c = collection(spark, ref, targets)
    parsed = O.parse(c).cache()
    for k in range(3):
        spark.createDataFrame([(k, k + 1, k, 9)], streams.REQUESTS).write.parquet(f"{tmp_path}/in/{k}")
    spark.createDataFrame(PATTERNS, streams.PATTERNS).write.parquet(f"{tmp_path}/pat")
    src = spark.readStream.schema(streams.REQUESTS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    streams.display(src, parsed, c.ref, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert {r.req_id: r.text for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {k: targets[k][1][k:9] for k in range(3)}
    for f, name in ((streams.count, "n"), (streams.locate, "l")):
        f(spark.readStream.schema(streams.PATTERNS).parquet(f"{tmp_path}/pat"), parsed, c.ref, f"{tmp_path}/{name}", f"{tmp_path}/{name}s").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/n").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{tmp_path}/l").count()
