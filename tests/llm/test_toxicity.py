import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import toxicity
from seqloom.llm.common import crc_mod


def corpus(n=600):
    rng = np.random.default_rng(3)
    common, rude = [f"{a}{b}{c}" for a in "bdfgklmnp" for b in "aeiou" for c in "rstlnm"], ["rudea", "rudeb", "rudec", "ruded"]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        words = list(rng.choice(common, 60))
        if toxic:
            words[5:50:15] = rng.choice(rude, 3)
        docs.append((i, " ".join(words) + ".", "en", "s"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out(spark):
    docs, labels = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, toxic string").repartition(3)
    lab = spark.createDataFrame(labels + [(0, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(df, lab, crc_mod("doc_id", 5) != 0)
    odd = spark.createDataFrame([(9000, None), (9001, ""), (9002, "bar den " * 50_000), (9003, "Rudea, rudeb!"), (9003, "Rudea, rudeb!")], "doc_id long, text string")
    rows = {r.doc_id: r for r in toxicity.score(df.select("doc_id", "text").unionByName(odd), model).collect()}
    truth = {i: t for i, _, t in labels}
    held = [r.doc_id for r in df.where(crc_mod("doc_id", 5) == 0).collect()]
    assert sum(rows[i].predicted == truth[i] for i in held) >= 0.97 * len(held)
    assert rows[9003].predicted == 1 and [rows[i].predicted for i in (9000, 9001, 9002)] == [0, 0, 0]
    assert all(0 <= r.score <= 1 for r in rows.values())


@pytest.mark.parametrize("value", [0, 1, None])
def test_one_class_or_none(spark, value):
    df = spark.createDataFrame([(0, "a b"), (1, None)], "doc_id long, text string")
    lab = spark.createDataFrame([(0, value)], "doc_id long, toxic int")
    rows = toxicity.score(df, toxicity.learn(df, lab, F.lit(True))).collect()
    assert {r.predicted for r in rows} == {value or 0} and len(rows) == 2
    assert toxicity.score(df.limit(0), toxicity.learn(df, lab, F.lit(True))).collect() == []


def test_pairs_and_curve():
    words = toxicity.Words()("One two, ONE")
    keys = toxicity.pairs_of(words)
    assert len(keys) == 4 and words[0] == toxicity.EDGE and words[1] == words[3] and len(toxicity.pairs_of(toxicity.Words()(None))) == 1
    slope, shift = toxicity.fit_curve(np.array([0.0, 0.1, 0.9, 1.0] * 50), np.array([0, 0, 1, 1] * 50))
    assert slope > 0 and abs(slope * 0.5 + shift) < 0.5


class Slow:
    """The model as its docstring has it, with dictionaries, over (text, toxic)."""

    def __init__(self, rows):
        self.n = [Counter(), Counter()]
        for text, y in rows:
            self.n[int(y)].update(set(self.pairs(text)))
        self.both = self.n[0] + self.n[1]
        self.word, self.head = [Counter(), Counter()], [Counter(), Counter()]
        self.contexts, self.types = Counter(), Counter()
        for c in (0, 1):
            for (v, w), k in self.n[c].items():
                self.word[c][w] += k
                self.head[c][v] += k
        for v, w in self.both:
            self.contexts[w] += 1
            self.types[v] += 1
        self.total = [sum(x.values()) for x in self.n]
        ones, twos = (sum(k == i for k in self.both.values()) for i in (1, 2))
        self.d = ones / (ones + 2 * twos) if ones and twos else 0.5
        self.back = [1 - sum(self.more(self.word[c][w], self.word[0][w] + self.word[1][w], self.total[c] / sum(self.total)) for w in self.contexts) / self.total[c] for c in (0, 1)]

    @staticmethod
    def pairs(text):
        words = ["^", *re.findall(r"[a-z0-9]+", text.lower()), "^"]
        return list(zip(words, words[1:], strict=False))

    @staticmethod
    def more(own, both, part):
        return max(own - both * part - 1 - 3 * math.sqrt(both * part * (1 - part)), 0)

    def factor(self, c, w):
        """p_c(w) / shared(w)."""
        n = self.word[0][w] + self.word[1][w]
        if not n:
            return self.back[c]
        m = self.more(self.word[c][w], n, self.total[c] / sum(self.total))
        return m / self.total[c] / (n / sum(self.total)) + self.back[c]

    def excess(self, c, v, w):
        own = [self.head[k][v] * self.factor(k, w) for k in (0, 1)]
        return self.more(self.n[c][v, w], self.both[v, w], own[c] / sum(own)) if sum(own) else 0

    def llr(self, text):
        total = 0
        pairs = self.pairs(text)
        for v, w in pairs:
            h = self.head[0][v] + self.head[1][v]
            shared = (max(self.both[v, w] - self.d, 0) + self.d * self.types[v] * self.contexts[w] / len(self.both)) / h if h else 0
            logs = []
            for c in (0, 1):
                left = 1 - sum(self.excess(c, a, b) for a, b in self.both if a == v) / max(self.head[c][v], 1)
                # without a shared probability the two backed-off ones stand in the same proportion
                logs.append(math.log(self.excess(c, v, w) / max(self.head[c][v], 1) + left * (shared or 1) * self.factor(c, w)))
            total += logs[1] - logs[0]
        return total / len(pairs)


def phrases():
    """Texts in which a word, and a pair of words that both classes have, tell the classes apart."""
    rng = np.random.default_rng(8)
    common = [f"{a}{b}" for a in "bcdfgklmnprt" for b in "aeiou"]
    rows = []
    for i in range(900):
        words = list(rng.choice(common, 30))
        if i % 6 == 0:
            words[9] = "rude"
        text = " ".join(words).replace("ba ce", "ba di")
        rows.append((i, text.replace(words[20], "ba ce") if i % 6 == 0 and i < 144 else text, int(i % 6 == 0)))
    return rows


@pytest.mark.parametrize("hot", [2_000_000, 3])
def test_equals_the_slow_model(spark, monkeypatch, hot):
    """Also where most terms are met through the join, and where labels are too many for a broadcast."""
    monkeypatch.setattr(toxicity, "HOT", hot)
    if hot == 3:
        monkeypatch.setattr("seqloom.llm.common.BROADCAST_KEYS", 10)
    rows = phrases()
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    model = toxicity.learn(df, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"), F.lit(True))
    assert (model.rest is None) == (hot > 3)
    fold = {r.doc_id for r in df.where(crc_mod("doc_id", 7) == 0).collect()}
    slow = Slow([(t, y) for i, t, y in rows if i not in fold])
    ask = ["fo ba ce gu", "fo ce ba gu", "rude", "unknown words", "", "fo ba ce gu", rows[0][1], rows[1][1]]
    docs = spark.createDataFrame(list(enumerate(ask)), "doc_id long, text string").selectExpr("*", "1 as score", "'x' as llr", "2 as predicted", "7 as t", "'y' as key")
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    for i, text in enumerate(ask):
        assert got[i].llr == pytest.approx(slow.llr(text), abs=1e-9), text
    assert got[0].score > got[1].score and got[2].predicted == 1 and got[0].llr == got[5].llr
    assert sorted(got.values(), key=lambda r: r.llr) == sorted(got.values(), key=lambda r: (r.score, r.llr))
    kept = toxicity.clean(docs, model)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [i for i in range(len(ask)) if not got[i].predicted]


def test_null_ids(spark):
    docs, labels = corpus(120)
    df = spark.createDataFrame([d[:2] for d in docs] + [(None, "rudea rudeb rudec")], "doc_id long, text string")
    model = toxicity.learn(df, spark.createDataFrame([x[::2] for x in labels] + [(None, 0)], "doc_id long, toxic int"), F.lit(True))
    assert [r.predicted for r in toxicity.score(df, model).where("doc_id is null").collect()] == [1]
