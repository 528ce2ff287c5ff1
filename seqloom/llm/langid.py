"""Language identification with error-correcting output codes.

Each language gets a codeword of +1 and -1; a binary classifier over hashed byte trigrams predicts each bit, and
loss-weighted decoding picks the codeword that the margins fit best. The word of a language is as far from the
others' as a deterministic search makes it, so single wrong bits are outvoted. A text whose second-best language fits
nearly as well is flagged as ambiguous.

The weight of a bit in a language's loss is how well it was predicted for rows of that language that a first fit had not seen.

The classifiers are fitted on a sample of about ``PER_LANG`` labelled rows of each language, and ``SAMPLE`` rows in all, picked by a hash of the
id: a documented bound. All texts are read whole, for fitting and for prediction. Null texts and texts without a letter
are ``und`` with score 0. Rows with a null id are identified but not learned from. With one learned language every text with a letter gets it, with none every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import single_threaded, slices

PER_LANG = 500
SAMPLE = 20_000
UNSEEN = 5
BITS = 11
WIDTH = 1 << BITS
PIECE = 1 << 20
AMBIGUOUS = 0.05
HASHES = 1 << 40
LETTER = regex.compile(r"\p{L}")
#: ASCII that is no letter counts as a space, capitals as small letters; bytes of other characters stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SHAPES = regex.compile(rb" {2,}")


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams, over the whole text."""
    counts = np.zeros(WIDTH, np.int64)
    raw = b" " + SHAPES.sub(b" ", text.encode().translate(FOLD)) + b" "
    for a in range(0, max(len(raw) - 2, 1), PIECE):
        b = np.frombuffer(raw[a : a + PIECE + 2], np.uint8).astype(np.uint32)
        code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
        counts += np.bincount((code * np.uint32(2654435761)) >> np.uint32(32 - BITS), minlength=WIDTH)
    return np.sqrt(counts / max(counts.sum(), 1)).astype(np.float32)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """A codeword for each of n languages: all dichotomies for up to five, else the best of seeded random codes."""
    if n <= 5:
        return np.array([[1] + [1 if bits >> k & 1 else -1 for k in range(n - 1)] for bits in range(2 ** (n - 1) - 1)]).T
    rng, size, best = np.random.default_rng(seed), int(np.ceil(12 * np.log2(n))), None
    for _ in range(200):
        code = rng.choice([-1, 1], (n, size))
        apart = min(int((code[a] != code[b]).sum()) for a, b in combinations(range(n), 2))
        if (abs(code.sum(0)) < n).all() and (best is None or apart > best[0]):
            best = (apart, code)
    return best[1]


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # features x bits
    bias: np.ndarray
    trust: np.ndarray  # languages x bits: how well a bit is predicted for texts of a language

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, score and ambiguity of each row."""
        margin = x @ self.weights + self.bias
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None])
        loss = (loss * self.trust).sum(2) / self.trust.sum(1)
        share = np.exp(-(loss - loss.min(1, keepdims=True)) * 4)
        share /= share.sum(1, keepdims=True)
        order = np.sort(loss, 1)
        return loss.argmin(1), share.max(1), order[:, 1] - order[:, 0] < AMBIGUOUS

    def of_texts(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and ambiguity of each text."""
        lang, score, doubt = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        known = [i for i, t in enumerate(texts) if t and self.langs and LETTER.search(t)]
        for a in range(0, len(known), 512):
            part = known[a : a + 512]
            if len(self.langs) == 1:
                best, s, d = np.zeros(len(part), int), np.ones(len(part)), np.zeros(len(part), bool)
            else:
                best, s, d = self.predict(np.array([features(texts[i]) for i in part]))
            score[part], doubt[part] = s, d
            for i, k in zip(part, best.tolist(), strict=True):
                lang[i] = self.langs[k]
        return lang, score, doubt


def fit(x: np.ndarray, langs: list[str], rounds: int = 150, rate: float = 20.0, ridge: float = 1e-5) -> Model:
    """Logistic classifiers for all bits at once, by accelerated gradient steps."""
    names = sorted(set(langs))
    y = np.searchsorted(names, langs)
    code = codewords(len(names)) if len(names) > 1 else np.ones((len(names), 1))
    target = code[y].astype(np.float32)
    share = (1.0 / np.bincount(y)[y] / len(names)).astype(np.float32)[:, None] if len(y) else np.zeros((0, 1), np.float32)

    def steps(x: np.ndarray, target: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = np.zeros((WIDTH, code.shape[1]), np.float32)
        b = np.zeros(code.shape[1], np.float32)
        vw, vb = w.copy(), b.copy()
        for _ in range(rounds if len(names) > 1 else 0):
            g = share * -target / (1 + np.exp(np.clip((x @ w + b) * target, -30, 30)))
            vw, vb = 0.9 * vw - rate * (x.T @ g + ridge * w), 0.9 * vb - rate * g.sum(0)
            w, b = w + vw, b + vb
        return w, b

    trust = np.ones(code.shape)
    unseen = np.arange(len(y)) % UNSEEN == 0
    if len(names) > 1:
        w, b = steps(x[~unseen], target[~unseen], share[~unseen])
        right = (x[unseen] @ w + b) * target[unseen] > 0
        for k in range(len(names)):
            own = right[y[unseen] == k]
            # one right and one wrong prediction are added, so that few rows give no certainty
            trust[k] = (own.sum(0) + 1) / (len(own) + 2)
    w, b = steps(x, target, share)
    return Model(names, code, w, b, np.maximum(2 * trust - 1, 0.05))


def learn(docs: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> Model:
    """Fit on about ``per_lang`` rows of each language among the rows for which ``trains`` holds."""
    single_threaded()
    rows = docs.where(trains & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col)).count().collect()}
    if not sizes:
        return fit(np.zeros((0, WIDTH), np.float32), [])
    per_lang = max(1, min(per_lang, SAMPLE // len(sizes)))
    limit = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(HASHES, int(HASHES * per_lang / n) + 1))])
    hashed = F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(HASHES))
    picked = rows.where(hashed < limit[F.col(lang_col)]).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([features(t).tobytes() for t in texts], pa.binary())], ["id", "lang", "x"])

    # a third of all rows may share one picked id; so many rows at most come to the driver
    got = sorted(picked.mapInArrow(run, "id long, lang string, x binary").limit(2 * SAMPLE).toArrow().to_pylist(), key=lambda r: (r["lang"], r["id"], r["x"]))
    return fit(np.array([np.frombuffer(r["x"], np.float32) for r in got]).reshape(-1, WIDTH), [r["lang"] for r in got])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score from 0 to 1, ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single_threaded()
        for batch in slices(batches):
            lang, score, doubt = shared.value.of_texts(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang), pa.array(score), pa.array(doubt)], ["id", "lang_pred", "score", "ambiguous"])

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "id long, lang_pred string, score double, ambiguous boolean").withColumnRenamed("id", id_col)


def clean(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in a known language, with all their columns; ambiguous ones with a score under ``least`` go."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single_threaded()
        for batch in slices(batches):
            lang, score, doubt = shared.value.of_texts(batch.column(at).to_pylist())
            yield batch.filter(pa.array((np.array(lang, object) != "und") & ~(doubt & (score < least))))

    return docs.mapInArrow(run, docs.schema)
