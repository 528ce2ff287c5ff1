import random
import re

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.test_jaccard import brute

SYLLABLES = {"en": "the an er on st th ing ed", "de": "sch ich ein ung er keit lich auf", "fr": "eau eux que ment tion aire ou les"}


def make(tmp_path, spark):
    """Documents with known toxic, unreadable, repeated and leaked ones."""
    rng = random.Random(11)
    text = lambda lang, n=50: " ".join("".join(rng.choices(SYLLABLES[lang].split(), k=rng.randint(1, 3))) for _ in range(n))
    item = text("en", 30)
    docs, labels, truth = [], [], {}
    for i in range(420):
        lang = rng.choice(sorted(SYLLABLES))
        body, kind = text(lang), "clean"
        if i % 7 == 0:
            words = body.split()
            words[3:40:9] = rng.choices(["vilest", "scumbo", "wretcha"], k=5)
            body, kind = " ".join(words), "toxic"
        elif i % 41 == 0:
            body, lang, kind = "12 34 -- !!" if i % 2 else None, None, "unreadable"
        elif i % 19 == 0:
            body, kind = f"{body} {item}", "leak"
        elif i % 13 == 0 and truth.get(i - 1) == "clean":
            body, kind = docs[-1][1] + " more", "copy"
        docs.append((i, body, lang, f"s{i % 3}", len(body or "")))
        truth[i] = kind
        labels.append((i, 1, int(kind == "toxic")))
    docs.append(docs[1])
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return docs, truth, item


def test_stages(tmp_path, spark):
    docs, truth, item = make(tmp_path, spark)
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = [d[0] for d in docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.schema == df.schema
        out.write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        rows = {d[0]: d[1] for d in docs}
        if name == "toxicity":
            left = [i for i in left if truth[i] != "toxic"]
        elif name == "language_id":
            left = [i for i in left if re.search(r"[^\W\d_]", rows[i] or "")]
        elif name == "jaccard_join":
            comp = brute([(i, rows[i]) for i in set(left)])
            left = sorted({i for i in left if comp[i][1] == i})
        else:
            left = [i for i in left if item not in rows[i]]
        assert sorted(r.doc_id for r in df.collect()) == sorted(left), name
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == sorted((i, len(tok.encode(rows[i], add_special_tokens=False).ids)) for i in left)


def test_empty_documents(tmp_path, spark):
    make(tmp_path / "full", spark)
    full = f"{tmp_path}/full"
    empty = spark.read.parquet(f"{full}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, full).collect() == []
