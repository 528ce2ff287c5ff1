import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqloom.llm import decontam


def slow_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row), row.index(min(row))


@given(st.text("abc", min_size=1, max_size=12), st.text("abc", max_size=25))
@settings(max_examples=300, deadline=None)
def test_distance(item, text):
    d, end = decontam.distance(item, text)
    want, at = slow_distance(item, text)
    assert d == want and (end == at or d == len(item))


@given(st.lists(st.text("abc", min_size=1, max_size=40), min_size=1, max_size=8), st.text("abc", max_size=70))
@settings(max_examples=400, deadline=None)
def test_items_aligned_together(items, text):
    text += items[0][:-1]  # often within a limit, or just beyond it
    assert decontam.close(items, text) == [decontam.distance(i, text)[0] <= decontam.edits(len(i)) for i in items]


def words(rng, n):
    return " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(n))


def edited(rng, text, n):
    for _ in range(n):
        i = rng.randrange(len(text))
        text = rng.choice([text[:i] + text[i + 1 :], text[:i] + "x" + text[i:], text[:i] + "q" + text[i + 1 :]])
    return text


def test_recall_within_the_limit():
    rng = random.Random(5)
    items = [(i, words(rng, rng.randint(14, 60))) for i in range(60)]
    finder = decontam.Finder(items)
    for share, least in ((0, 1.0), (2, 0.97), (4, 0.9)):
        texts = []
        for _, item in items:
            leak = edited(rng, item, len(item) * share // 100)
            texts.append(f"{words(rng, rng.randint(0, 60))} {leak.upper()}\n{words(rng, rng.randint(0, 30))}")
        got = {(t, i) for t, i, _, _ in finder.find(texts)}
        assert sum((k, k) in got for k in range(60)) >= least * 60, share
        for t, i, d, _ in finder.find(texts):
            assert slow_distance(decontam.normal(items[i][1]), decontam.normal(texts[t]))[0] == d


HAN = "".join(map(chr, range(0x4E00, 0x4E00 + 900)))
CYRILLIC = "абвгдеёжзийклмнопрстуфхцчшщъыьэюя"


def written(rng, kind, n):
    """About n characters of a kind: words, one run of letters, or one of Chinese characters."""
    if kind == "cyrillic":
        return " ".join("".join(rng.choices(CYRILLIC, k=rng.randint(2, 9))) for _ in range(n // 6 + 1))
    return words(rng, n // 6 + 1) if kind == "spaced" else "".join(rng.choices("etaoinshrdlu" if kind == "glued" else HAN, k=n))


@pytest.mark.parametrize("kind", ["spaced", "glued", "han", "cyrillic"])
def test_recall_at_the_limit(kind):
    """Leaks with as many edits as are allowed, against a search over all passages of every text for every item."""
    rng = random.Random(11)
    items = [(i, decontam.normal(written(rng, kind, rng.randint(80, 320)))) for i in range(40)]
    texts = []
    for _, item in items:
        leak = item
        for _ in range(decontam.edits(len(item))):
            at = rng.randrange(len(leak))
            leak = rng.choice([leak[:at] + leak[at + 1 :], leak[:at] + rng.choice(item) + leak[at:], leak[:at] + rng.choice(item) + leak[at + 1 :]])
        join = " " if kind in ("spaced", "cyrillic") else ""
        texts.append(join.join([written(rng, kind, rng.randint(1, 500)), leak, written(rng, kind, rng.randint(1, 300))]))
    found = {(t, i): d for t, i, d, _ in decontam.Finder(items).find(texts)}
    brute = {(t, i): d for t, text in enumerate(texts) for i, item in items for d, _ in [decontam.distance(item, decontam.normal(text))] if d <= decontam.edits(len(item))}
    assert len(brute) >= 40 and all(brute[k] == d for k, d in found.items())
    assert len(found) >= 0.95 * len(brute)


@pytest.mark.parametrize("alphabet", ["etaoinshrdlu", "的一是在不了有和人这中大为上个国"])
def test_runs_without_spaces(alphabet):
    """Exact items at any place in long runs without a space, spaced items or not, and other text of that kind."""
    rng = random.Random(9)
    run = lambda n: "".join(rng.choices(alphabet, k=n))
    items = [(i, run(rng.randint(90, 400)) if i % 2 else words(rng, 30)) for i in range(30)]
    finder = decontam.Finder(items)
    texts = [run(rng.randint(300, 3000)) + t + run(rng.randint(0, 600)) for _, t in items]
    assert {(t, i, d) for t, i, d, _ in finder.find(texts)} == {(k, k, 0) for k in range(30)}
    assert finder.find([run(3000) for _ in range(5)]) == []


def test_phrase_of_many_items():
    """Clean texts that hold a phrase of all items, and leaks among them, come out as with each item aligned by itself."""
    rng = random.Random(31)
    phrase = words(rng, 12)
    items = [(i, f"{words(rng, rng.randint(4, 10))} {phrase} {words(rng, rng.randint(4, 10))}") for i in range(300)]
    texts = [f"{words(rng, 40)} {phrase} {words(rng, 40)}" for _ in range(6)] + [f"{words(rng, 9)} {edited(rng, items[7][1], 3)} {words(rng, 9)} {items[8][1]}"]
    got = decontam.Finder(items).find(texts)
    want = {(t, i, d) for t, text in enumerate(texts) for i, item in items for d, _ in [decontam.distance(decontam.normal(item), decontam.normal(text))] if d <= decontam.edits(len(item))}
    assert {(t, i) for t, i, *_ in got} == {(6, 7), (6, 8)} and {x[:3] for x in got} == want


def test_short_items():
    """Each item that stands in a text, or of seventeen characters with one edit, is found, as by aligning all."""
    rng = random.Random(32)
    pool = ["".join(rng.choices("ab c", k=rng.choice((1, 3, 5, 8, 17)))) for _ in range(150)]
    items = [(i, t) for i, t in enumerate(pool) if decontam.normal(t)]
    texts = ["".join(rng.choices("abc ", k=60)) for _ in range(20)] + [edited(rng, f"xx {t} yy", 1) for _, t in items if len(t) == 17] + ["", None]
    got = {x[:3] for x in decontam.Finder(items).find(texts) if not decontam.least_grams(len(decontam.normal(pool[x[1]])))}
    normal = [(i, decontam.normal(t)) for i, t in items]
    want = {(t, i, d) for t, text in enumerate(texts) for i, item in normal if not decontam.least_grams(len(item)) for d in [decontam.distance(item, decontam.normal(text))[0]] if d <= decontam.edits(len(item))}
    assert got == want and len({d for _, _, d in got}) == 2


def test_no_false_alarm():
    rng = random.Random(6)
    items = [(i, words(rng, 40)) for i in range(40)]
    texts = [words(rng, 300) for _ in range(40)] + [items[3][1][: len(items[3][1]) // 2]]
    assert decontam.Finder(items).find(texts) == []


@pytest.mark.parametrize("group", [16 << 20, 300])
def test_rows(spark, monkeypatch, group):
    monkeypatch.setattr(decontam, "GROUP_BYTES", group)
    rng = random.Random(7)
    items = [(0, words(rng, 30)), (1, words(rng, 50)), (2, "short item"), (3, None), (4, " "), (5, None)]
    items[5] = (5, items[0][1])
    docs = [(0, None), (1, ""), (2, f"a {items[0][1]} b"), (2, f"a {items[0][1]} b"), (3, items[1][1].replace(" ", "\n\t ")), (4, "the Short  ITEM."), (5, words(rng, 30000) + " " + items[1][1]), (6, "clean"), (None, items[1][1]), (None, items[1][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = sorted((tuple(r)[:3] for r in decontam.find(df, bench.unionByName(spark.createDataFrame([(None, "clean", 1)], bench.schema))).collect()), key=str)
    assert got == [(2, 0, 0), (2, 5, 0), (3, 1, 0), (4, 2, 0), (5, 1, 0), (None, 1, 0)]
    kept = decontam.clean(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 6]
    assert decontam.find(df, bench.limit(0)).collect() == [] and decontam.clean(df, bench.limit(0)).count() == len(docs)
    assert decontam.find(df.limit(0), bench).collect() == []
