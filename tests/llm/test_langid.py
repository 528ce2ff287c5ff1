import numpy as np
from pyspark.sql import functions as F

from seqloom.llm import langid
from seqloom.llm.common import crc_mod

WORDS = {"aa": "the of and thing to her".split(), "bb": "der die und nicht ein schon".split(), "cc": "que les pour dans être leur".split()}


def corpus(n=120):
    rng = np.random.default_rng(1)
    return [(i, " ".join(rng.choice(WORDS[lang], 30)), lang) for i in range(n) for lang in [sorted(WORDS)[i % 3]]]


def test_codewords_stand_apart():
    for n in (2, 3, 4, 5, 9, 30):
        code = langid.codewords(n)
        assert len({tuple(r) for r in code}) == n
        assert (abs(code.sum(0)) < n).all()
    apart = langid.codewords(9)
    assert min((apart[a] != apart[b]).sum() for a in range(9) for b in range(a)) >= 9


def test_features_of_pieces(monkeypatch):
    text = "Ünder the löng text " * 40
    whole = langid.features(text)
    monkeypatch.setattr(langid, "PIECE", 17)
    assert np.allclose(whole, langid.features(text))
    assert np.isfinite(langid.features("")).all()


def test_held_out(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string").repartition(3)
    model = langid.learn(df, crc_mod("doc_id", 4) != 2)
    odd = spark.createDataFrame([(900, None), (901, ""), (902, "12 34 !"), (903, "der die und " * 30000), (903, "der die und " * 30000)], "doc_id long, text string")
    clashing = df.select("doc_id", "text").unionByName(odd).selectExpr("*", "'x' as score", "1 as id", "2 as lang_pred", "'y' as ambiguous")
    got = {r.doc_id: r for r in langid.identify(clashing, model).collect()}
    assert langid.clean(clashing, model).columns == clashing.columns
    assert all(got[i].lang_pred == lang for i, _, lang in corpus())
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "bb"]
    assert all(0 <= r.score <= 1 for r in got.values()) and not got[903].ambiguous


def test_degenerate_training(spark):
    df = spark.createDataFrame([(0, "abc", "xx"), (1, None, "xx"), (2, "abc", None)], "doc_id long, text string, lang string")
    one = {r.doc_id: r.lang_pred for r in langid.identify(df, langid.learn(df, F.lit(True))).collect()}
    assert one == {0: "xx", 1: "und", 2: "xx"}
    none = langid.identify(df, langid.learn(df.limit(0), F.lit(True))).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert langid.identify(df.limit(0), langid.learn(df, F.lit(True))).collect() == []


def test_null_ids_are_identified_but_not_learned(spark):
    df = spark.createDataFrame([*corpus(), *[(None, "der die und " * 5, "aa")] * 60], "doc_id long, text string, lang string")
    model = langid.learn(df, F.lit(True))
    assert {r.lang_pred for r in langid.identify(df, model).where("doc_id is null").collect()} == {"bb"}


def test_trust_comes_from_unseen_rows():
    """A bit that is right on the rows of its fit alone weighs little."""
    rng = np.random.default_rng(4)
    x = np.sqrt(rng.dirichlet(np.full(langid.WIDTH, 0.01), 200)).astype(np.float32)
    model = langid.fit(x, [["aa", "bb"][i % 2] for i in range(200)])
    assert (model.trust < 0.7).all()
    sure = langid.fit(np.array([langid.features(t) for _, t, _ in corpus()]), [lang for _, _, lang in corpus()])
    assert (sure.trust > 0.75).all()
    assert langid.SAMPLE // 200 < langid.PER_LANG
