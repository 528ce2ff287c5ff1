import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seqloom.llm import bpe, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
OURS = bpe.Bpe(PATH)
TEXTS = ["", None, "a", " ", "aaaaaaa", "Hello world's  end\n\n x<|endoftext|> y", "é漢字 \u0085\x1c　 z", "thentheonan" * 50, "x" * 5000, "'s'll 123abc  ", "🙂" * 9]


def want(text):
    return LIB.encode(text or "", add_special_tokens=False).ids


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_encode_equals_library(text):
    ids = np.frombuffer(OURS.encode([text])[0], "<u4").tolist()
    assert ids == want(text)
    assert OURS.decode(OURS.encode([text])[0]) == LIB.decode(ids, skip_special_tokens=False)


@given(st.text(alphabet="aeinotrsthd' ", max_size=80))
@settings(max_examples=300, deadline=None)
def test_speculation_on_letters(text):
    assert np.frombuffer(OURS.encode([text])[0], "<u4").tolist() == want(text)


@given(st.text(alphabet="ab \n é1<|endoftext|>", max_size=90), st.integers(1, 20))
@settings(max_examples=200, deadline=None)
def test_pieces_add_up(text, limit):
    parts = list(tokens.pieces(text, limit))
    assert "".join(parts) == text
    assert sum(len(want(p)) for p in parts) == len(want(text))


def test_exact_merge_agrees():
    for text in ["thth", "aaaaaaaaa", "erererer", "onononthe"]:
        assert OURS.exact(text.encode()) == want(text)


def test_queries_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(1, "twice", "x"), (1, "twice", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, tokens.count_tokens(df, PATH, 3).collect()))
    assert got == sorted((i, len((t or "").encode()), len(want(t)), len(want(t)) > 3) for i, t, _ in rows)
    got = sorted(map(tuple, bpe.encode_decode(df, PATH).collect()))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == sorted((i, len(want(t)), sha(np.array(want(t), "<u4").tobytes()), sha(LIB.decode(want(t), skip_special_tokens=False).encode())) for i, t, _ in rows)
    assert tokens.count_tokens(df.limit(0), PATH, 3).collect() == [] == bpe.encode_decode(df.limit(0), PATH).collect()


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_other_tokenizers_stay_whole(spark, name):
    df = spark.createDataFrame([(0, "Some Words here"), (1, None)], "doc_id long, text string")
    got = dict(r[::2] for r in map(tuple, tokens.count_tokens(df, public_tokenizers.path(name), 1).select("doc_id", "n_bytes", "n_tokens").collect()))
    assert got[1] == 0 and got[0] >= 3
    assert not tokens.load(public_tokenizers.path(name))[1]
