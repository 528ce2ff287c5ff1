"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary labelled texts, score a text; the difference of the two log-likelihoods
per word, put through a rising logistic curve, is the score. Counts are of texts: an n-gram counts once a text.

Both models back off to one shared Kneser-Ney bigram, from the counts of both classes and with continuation counts (in
how many different contexts a word stands) below it::

    shared(w | v) = (max(n(vw) - D, 0) + D t(v) N(.w) / N(..)) / n(v)

A class adds to it what it has beyond its part of the shared counts, with an absolute discount, first for words and
then for pairs::

    p_c(w)     = m_c(w) / N_c + back_c shared(w)               m_c(w)  = max(n_c(w) - e_c(w) - d(e_c(w)), 0)
    p_c(w | v) = m_c(vw) / n_c(v) + back_c(v) adapted_c(w | v)   m_c(vw) = max(n_c(vw) - e_c(vw) - d(e_c(vw)), 0)

``adapted_c(w | v)`` is shared(w | v) p_c(w) / shared(w), the shared pair with the class's word probability; e_c is the
class's part of a shared count, by its size for words and in proportion to n_c(v) p_c(w) for pairs; the discount d is ``DISCOUNT``
texts and ``SPREAD`` standard deviations of how chance deals a shared count to the classes; the weights of backing off, back_c, are what the
discounts leave over. So a rare expression that stands in a class as often as chance may have it is smoothed by the shared
counts and tells the classes apart by nothing, and one that a class has in excess counts at any frequency. A word
outside the counts has the two weights of backing off alone. Nothing is cut off: an n-gram has a term of its own in the log ratio exactly
if a class has an excess of it, and all others have the terms of their words' weights of backing off.

The counts come from every labelled row that may be learned from, except one fold, on which the logistic curve is
fitted (on at most ``CURVE_ROWS`` rows of it). Spark makes the terms. The ``HOT`` most frequent terms, a bounded
number, are broadcast for scoring; texts meet the others, if there are more, through a join on the n-gram, so no task holds a model that grows with the
input. Words are 32-bit hashes, texts in that join 64-bit ones. Whole texts are counted and scored.

Null and empty texts have the end of a text as their one symbol. Without labels of both classes every text gets the
share of toxic labels, or 0 without labels. Rows with a null id are scored but not learned from. Rows that share an id
are scored one by one; an id with several labels counts as toxic if one is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import crc_mod, fresh_names, materialize, maybe_broadcast, release, single_threaded, slices

DISCOUNT = 1.0
SPREAD = 3.0
HOT = 2_000_000
CURVE_ROWS = 20_000
FLUSH = 1_000_000
CACHE = 200_000
EDGE = 1
#: Places of the filter of terms that are joined; fuller than that it lets more n-grams through to the join.
FILTER_BITS = 26
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 or b == 39 else 32 for b in range(256))


class Words:
    """Texts to arrays of 32-bit word hashes, with the edge of a text in front."""

    def __init__(self) -> None:
        self.seen: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").lower().encode().translate(FOLD).split()
        seen = self.seen
        if len(seen) > CACHE:
            seen.clear()
        out = [EDGE]
        for w in words:
            h = seen.get(w)
            if h is None:
                h = seen[w] = max(xxhash.xxh32_intdigest(w), EDGE + 1)
            out.append(h)
        return np.array(out, np.uint64)


def pairs_of(words: np.ndarray) -> np.ndarray:
    """Each word with the one behind it, as one 64-bit key; the last meets the edge."""
    return ((words << np.uint64(32)) | np.append(words[1:], np.uint64(EDGE))).view(np.int64)


@dataclass
class Model:
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # sorted words and pairs
    terms: np.ndarray = field(default_factory=lambda: np.zeros(0))  # what each adds to the log ratio
    base: float = 0.0  # what any word adds
    slope: float = 0.0
    shift: float = -30.0
    rest: DataFrame | None = None  # key, term of the words and pairs that are not among the keys
    bits: np.ndarray | None = None  # filter of their keys

    def shared(self) -> tuple:
        return self.keys, self.terms, self.base, self.bits


def looked_up(keys: np.ndarray, terms: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terms of the asked keys, 0 for others, and which keys are known."""
    if not len(keys):
        return np.zeros(len(asked)), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    known = keys[at] == asked
    return np.where(known, terms[at], 0.0), known


def place(keys: np.ndarray) -> np.ndarray:
    """A key's bit in the filter."""
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def ratios(texts: list[str | None], split: Words, keys: np.ndarray, terms: np.ndarray, base: float) -> tuple[np.ndarray, np.ndarray]:
    """For each text the sum of its known terms, and how many symbols it has."""
    parts = [split(t) for t in texts]
    if not parts:
        return np.zeros(0), np.zeros(0)
    sizes = np.array([len(p) for p in parts])
    words = np.concatenate(parts)
    found = looked_up(keys, terms, words.view(np.int64))[0] + looked_up(keys, terms, pairs_of(words))[0]
    return np.add.reduceat(found, np.cumsum(sizes) - sizes) + base * sizes, sizes


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a rising logistic curve, by Newton steps with a weak ridge."""
    scale = x.std() or 1.0
    a = np.column_stack([x / scale, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + 1e-2 * w
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2), g)
    return float(max(w[0], 1e-3) / scale), float(w[1])


def count_pairs(rows: DataFrame) -> DataFrame:
    """From (text, toxic): key, n0, n1 of every pair of neighbouring words: in how many texts of each class it stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Words()
        held: tuple[list, list] = ([], [])
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for c in (0, 1):
                if held[c]:
                    keys, n = np.unique(np.concatenate(held[c]), return_counts=True)
                    for a in range(0, len(keys), 100_000):
                        k, m = keys[a : a + 100_000], n[a : a + 100_000].astype(np.int32)
                        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(m if c == 0 else 0 * m), pa.array(m if c else 0 * m)], ["key", "n0", "n1"])
                    held[c].clear()

        for batch in slices(batches):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys = np.unique(pairs_of(split(text)))  # once a document: a line repeated in one text is no evidence
                held[1 if toxic else 0].append(keys)
                size += len(keys)
                if size > FLUSH:
                    yield from flush()
                    size = 0
        yield from flush()

    return rows.select("text", "toxic").mapInArrow(run, "key long, n0 int, n1 int").groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def word_counts(pairs: DataFrame) -> DataFrame:
    """Per word: n0, n1 and contexts as the second of a pair; h0, h1 and types as the first. Every word is both."""
    sums = lambda k: (F.sum("n0").alias(f"{k}0"), F.sum("n1").alias(f"{k}1"))
    after = pairs.groupBy(F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).alias("word")).agg(*sums("n"), F.count("*").alias("contexts"))
    return after.join(pairs.groupBy(F.shiftrightunsigned("key", 32).alias("word")).agg(*sums("h"), F.count("*").alias("types")), "word")


def excess(own: Column, both: Column, part: Column) -> Column:
    """What a class has beyond its part of a shared count, discounted."""
    return F.greatest(own - both * part - DISCOUNT - SPREAD * F.sqrt(both * part * (1 - part)), F.lit(0.0))


def make_terms(pairs: DataFrame) -> tuple[DataFrame, float] | None:
    """(key, term, n): every word and pair with a term of its own, and the term of any word; nothing without two classes."""
    t = pairs.agg(*[F.coalesce(F.sum(x).cast("double"), F.lit(0.0)) for x in (F.col("n0"), F.col("n1"), F.lit(1), (F.expr("n0 + n1") == 1).cast("int"), (F.expr("n0 + n1") == 2).cast("int"))]).first()
    n0, n1, kinds, ones, twos = t
    if not n0 or not n1:
        return None
    d = ones / (ones + 2 * twos) if ones and twos else 0.5
    total = {0: n0, 1: n1}
    words = word_counts(pairs).withColumn("n", F.expr("n0 + n1"))
    words = materialize(words.select("*", *[excess(F.col(f"n{c}"), F.col("n"), F.lit(total[c] / (n0 + n1))).alias(f"m{c}") for c in (0, 1)]), "toxic-words")
    back = [1 - x / total[c] for c, x in enumerate(words.agg(F.sum("m0"), F.sum("m1")).first())]
    # p_c(w) / shared(w), the class's factor of a word
    factor = [(F.col(f"m{c}") / F.lit(total[c]) / (F.col("n") / F.lit(n0 + n1)) + back[c]).alias(f"f{c}") for c in (0, 1)]
    second = words.select(F.col("word").alias("w"), "contexts", *factor)
    first = words.select(F.col("word").alias("v"), "h0", "h1", "types")
    # a pair below the discount in both classes cannot exceed it
    rows = pairs.where(F.greatest("n0", "n1") > DISCOUNT).withColumn("n", F.expr("n0 + n1"))
    rows = rows.withColumn("v", F.shiftrightunsigned("key", 32)).withColumn("w", F.col("key").bitwiseAND(F.lit(0xFFFFFFFF))).join(first, "v").join(second, "w")
    part = F.expr("h0 * f0 + h1 * f1")
    rows = rows.select("*", *[excess(F.col(f"n{c}"), F.col("n"), F.col(f"h{c}") * F.col(f"f{c}") / part).alias(f"m{c}") for c in (0, 1)])
    rows = materialize(rows.where("m0 > 0 or m1 > 0"), "toxic-excess")
    left = rows.groupBy("v").agg(*[(1 - F.sum(f"m{c}") / F.greatest(F.max(f"h{c}"), F.lit(1))).alias(f"b{c}") for c in (0, 1)])
    shared = (F.greatest(F.col("n") - d, F.lit(0.0)) + d * F.col("types") * F.col("contexts") / kinds) / F.expr("h0 + h1")
    p = [F.col(f"m{c}") / F.greatest(F.col(f"h{c}"), F.lit(1)) + F.col(f"b{c}") * shared * F.col(f"f{c}") for c in (0, 1)]
    of_pairs = rows.join(left, "v").select("key", (F.log(p[1] / p[0]) - F.expr("ln(f1 / f0) + ln(b1 / b0)")).alias("term"), "n")
    base = float(np.log(back[1] / back[0]))
    weights = words.join(left.withColumnRenamed("v", "word"), "word", "left").where("m0 > 0 or m1 > 0 or b0 is not null").select("word", "n", *factor, *[F.coalesce(f"b{c}", F.lit(1.0)).alias(f"b{c}") for c in (0, 1)])
    of_words = weights.select(F.col("word").alias("key"), (F.expr("ln(f1 / f0) + ln(b1 / b0)") - base).alias("term"), "n")
    terms = materialize(of_words.unionByName(of_pairs), "toxic-terms")
    release(words, rows)
    return terms, base


def model_of(terms: DataFrame, base: float) -> Model:
    """The most frequent terms, at most ``HOT``, as arrays; the others, if any, as a table with a filter of its keys."""
    rest = bits = None
    hot = terms
    if terms.count() > HOT:
        step = F.floor(F.log2("n") * 8).alias("step")
        least, held = 0, 0
        for r in sorted(terms.groupBy(step).count().collect(), reverse=True):
            held += r[1]
            if held > HOT:
                least = r[0] + 1
                break
        hot, rest = terms.where(F.floor(F.log2("n") * 8) >= least), terms.where(F.floor(F.log2("n") * 8) < least).select("key", "term")
        bits = key_filter(rest)
    got = hot.select("key", "term").toArrow()
    keys, values = got["key"].to_numpy(), got["term"].to_numpy()
    order = np.argsort(keys)
    return Model(keys[order], values[order], base, rest=rest, bits=bits)


def key_filter(rows: DataFrame) -> np.ndarray:
    """A bitmap of fixed size with a set bit for each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = place(batch.column(0).to_numpy())
            word, inverse = np.unique(at >> 6, return_inverse=True)
            bits = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(bits, inverse, np.uint64(1) << (at & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], ["word", "bits"])

    got = rows.select("key").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def learn(docs: DataFrame, labels: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on the labelled documents whose id passes ``trains`` (a condition on the column doc_id)."""
    single_threaded()
    y = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic")).where("doc_id is not null")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(trains & F.col("text").isNotNull())
    curve = crc_mod("doc_id", 7) == 0
    pairs = materialize(count_pairs(texts.join(maybe_broadcast(y.where(~curve)), "doc_id")), "toxic-pairs")
    made = make_terms(pairs)
    release(pairs)
    if made is None:
        share = labels.agg(F.avg(F.col(label_col).cast("double"))).first()[0] or 0.0
        return Model(shift=float(np.log(share / (1 - share))) if 0 < share < 1 else 30.0 if share else -30.0)
    model = model_of(*made)
    # ids are picked first, so that no texts are shuffled or sent for a sample of bounded size
    picked = texts.select("doc_id").join(maybe_broadcast(y.where(curve)), "doc_id").distinct().orderBy(F.xxhash64("doc_id")).limit(CURVE_ROWS)
    xy = llr(texts.join(F.broadcast(picked), "doc_id"), model, ("toxic",)).select("llr", "toxic").toArrow()
    x, t = xy["llr"].to_numpy(), xy["toxic"].to_numpy()
    if t.any() and not t.all():
        model.slope, model.shift = fit_curve(x, t)
    else:
        model.slope, model.shift = 30.0, 0.0
    return model


def llr(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the kept integer columns, and the log ratio per symbol; ``t``, a hash of the text, where terms are joined."""
    shared = docs.sparkSession.sparkContext.broadcast(model.shared())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Words()
        keys, terms, base, _ = shared.value
        for batch in slices(batches):
            total, size = ratios(batch.column(2).to_pylist(), split, keys, terms, base)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *batch.columns[3:], pa.array(total), pa.array(size.astype(float))], ["doc_id", "t", *keep, "total", "size"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Words()
        keys, terms, _, bits = shared.value
        for batch in slices(batches):
            for t, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = split(text)
                asked, times = np.unique(np.concatenate([words.view(np.int64), pairs_of(words)]), return_counts=True)
                at = place(asked)
                open_ = ~looked_up(keys, terms, asked)[1] & ((bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1)
                asked, times = asked[open_], times[open_]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(asked), t, np.int64)), pa.array(asked), pa.array(times)], ["t", "key", "times"])

    texts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), "text", *keep)
    kinds = "doc_id long, t long, " + "".join(f"{k} int, " for k in keep) + "total double, size double"
    rows = texts.mapInArrow(run, kinds)
    if model.rest is not None:
        # equal texts ask the same; a key's rows lie together after the join, so they are counted once there
        asked = texts.select("t", "text").mapInArrow(ask, "t long, key long, times long").join(model.rest, "key").dropDuplicates(["key", "t"])
        rows = rows.join(asked.groupBy("t").agg(F.sum(F.col("times") * F.col("term")).alias("more")), "t", "left").withColumn("total", F.expr("total + coalesce(more, 0.0)"))
    return rows.select("doc_id", "t", *keep, (F.col("total") / F.col("size")).alias("llr"))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, score from 0 to 1, predicted (1 from 0.5 on), and the log ratio per symbol."""
    rows = llr(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), model)
    bent = F.lit(model.slope) * F.col("llr") + F.lit(model.shift)
    out = rows.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), bent)))))
    return out.select(F.col("doc_id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "llr")


def clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    if model.rest is not None:
        scored = llr(docs.select(F.lit(0).cast("long").alias("doc_id"), F.col(text_col).alias("text")), model)
        name = fresh_names(docs, 1)[0]
        toxic = materialize(scored.where(F.lit(model.slope) * F.col("llr") + F.lit(model.shift) >= 0).select(F.col("t").alias(name)).distinct(), "toxic-texts")
        return docs.withColumn(name, F.xxhash64(F.coalesce(text_col, F.lit("")))).join(maybe_broadcast(toxic), name, "left_anti").select(*docs.columns)
    shared, at = docs.sparkSession.sparkContext.broadcast((*model.shared()[:3], model.slope, model.shift)), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Words()
        keys, terms, base, slope, shift = shared.value
        for batch in slices(batches):
            total, size = ratios(batch.column(at).to_pylist(), split, keys, terms, base)
            yield batch.filter(pa.array(slope * (total / size) + shift < 0))

    return docs.mapInArrow(run, docs.schema)
