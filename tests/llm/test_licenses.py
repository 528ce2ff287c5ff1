import random

import pytest
from pyspark.sql import functions as F

from seqloom.llm import licenses


def brute(text):
    """Every window of a text against every template, with the share of its shingles and where the first such window starts."""
    words = licenses.words_of(text or "")
    out = {}
    for own in licenses.classes(licenses.TEMPLATES):
        for i in own.members:
            name, template = licenses.TEMPLATES[i]
            wanted = set(licenses.shingles_of(licenses.words_of(template)))
            for start in range(0, max(len(words) - (own.span - own.step), 1), own.step):
                share = len(wanted & set(licenses.shingles_of(words[start : start + own.span]))) / len(wanted)
                if words and share >= licenses.CONTAINED:
                    best, first = out.get(name, (0, start + 1))
                    out[name] = max(best, share), min(first, start + 1)
    return out


def noise(rng, n):
    return " ".join(rng.choice(["the", "of", "license", "public", "copy", "under", "version", "zzz", "work"]) for _ in range(n))


def test_anchors_cover_every_template():
    held = set(licenses.anchors())
    for _, t in licenses.TEMPLATES:
        s = licenses.shingles_of(licenses.words_of(t))
        assert sum(bool(held & set(x.split())) for x in s) > len(s) * (1 - licenses.CONTAINED)


@pytest.mark.parametrize("seed", [1, 2])
def test_scan_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(0, None), (1, ""), (2, "License"), (3, "plain words only " * 2000)]
    for i in range(4, 60):
        name, template = rng.choice(licenses.TEMPLATES)
        words = template.split()
        if rng.random() < 0.4:
            words[rng.randrange(len(words))] = "changed"
        if rng.random() < 0.1:
            words = words[: len(words) // 2]
        rows.append((i, f"{noise(rng, rng.randrange(40))}\n{' '.join(words)}\n{noise(rng, rng.randrange(60))}"))
    rows.append((4, rows[4][1]))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("x")).withColumn("start", F.lit(1))
    rows.append((None, rows[5][1]))
    rows.append((70, "word " * 60_000 + licenses.TEMPLATES[19][1] + " word" * 60_000 + " " + licenses.TEMPLATES[1][1]))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("x")).withColumn("start", F.lit(1)).withColumn("key", F.lit(2))
    got = {(r.doc_id, r.license): (r.containment, r.first_word) for r in licenses.scan(df).collect()}
    want = {(i, name): found for i, text in rows for name, found in brute(text).items()}
    assert got == want and {(70, "MIT")} <= set(got)


def test_keys_are_minhashes_alone():
    """Every band of a class is a MinHash, and there are enough for the least similarity in it."""
    for own in licenses.classes(licenses.TEMPLATES):
        for i in own.members:
            n = len(licenses.shingles_of(licenses.words_of(licenses.TEMPLATES[i][1])))
            least = licenses.least(n)
            similar = least / (own.span - licenses.SHINGLE + 1 + n - least)
            assert (1 - similar) ** own.bands <= 1.01 * licenses.MISSED


def test_sql_equals_brute_force(spark):
    import duckdb

    rows = [(i, noise(random.Random(i), 30) + " " + t + " " + noise(random.Random(-i), 20 + i)) for i, (_, t) in enumerate(licenses.TEMPLATES)] + [(90, None), (91, ""), (92, "License.")]
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar)")
    db.executemany("insert into documents values (?, ?)", rows)
    got = {(r[0], r[1]): r[2:] for r in db.execute(licenses.oracle()).fetchall()}
    assert got == {(i, name): found for i, text in rows for name, found in brute(text).items()}


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(0, "x")], "doc_id long, text string")
    plan = licenses.scan(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
