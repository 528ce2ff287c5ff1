"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document's set holds the distinct five-word shingles of its whole text. Two documents link when 100 * intersection
is at least 80 * union. The order of shingles is that of their hashes, and for a match of ``l`` a set of n has a prefix
of n - ceil(0.8 n) + l shingles: two linked sets share at least l of them in prefixes of that kind.

Each document gets its own l. A shingle in more than ``HOT`` classes costs too many candidates, so it is not followed;
instead the prefix grows by one for each of them and as many more shared shingles would be needed, which leaves the
requirement on the others as it was. Where the rest still promises many candidates, the prefix grows further, in
proportion to them and up to a quarter, and as many more shared shingles are required before a pair is verified. The rule for a pair is the smaller requirement, which
loses no pair. A document with too few shingles that are not hot is handled apart: its full set, the exact order by
frequency among such documents, prefixes for the smaller and the larger side of a pair, and the positional bound.

Equal sets are one class, so copies are never paired. Before the join, a class is compared with one centre for each of
its ``STARS`` least shingles, and then with the plainest class of each of its hot shingles; what
links is one component, and only shingles that stand in several components are followed. So a group of thousands of near copies costs some comparisons a member, and no pair in it is listed; links
between different components are all found. Every candidate is verified on its full sets of 64-bit shingle hashes
(two different shingles of one pair agree with a chance below 1e-12 a pair; two different sets have one class id with a
chance of N^2 / 2^65 for N sets).

Null and empty texts, and texts without words, have empty sets, link with nothing and are their own components. Fewer
than five words make one shingle. Rows that share an id are separate texts of one document id: each is linked by its
own set, and the id's row shows what its own text is linked with. A row without an id has the component of the rows with an
equal text, if they have ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import BROADCAST_KEYS, fresh_names, materialize, maybe_broadcast, release, slices, small_enough
from seqloom.llm.components import components

SHINGLE = 5
HOT = 48
STARS = 4
HOT_ROUNDS = 1
CACHE = 100_000
#: Bits of the filter of shared tokens at most, and for each token at least; with more tokens there is none.
FILTER_BITS = 28
BITS_A_TOKEN = 4
TOKEN_BYTES = 8
#: Fixed odd multipliers, one for each place in a shingle.
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


class Shingler:
    """Texts to rising arrays of 64-bit shingle hashes. Only A-Z is lowered and only ASCII white space parts words."""

    def __init__(self) -> None:
        self.seen: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        seen = self.seen
        if len(seen) > CACHE:
            seen.clear()
        out = []
        for w in words:
            h = seen.get(w)
            if h is None:
                h = seen[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        w = np.array(out, np.uint64)
        if not len(w):
            return w
        size = min(SHINGLE, len(w))
        h = np.full(len(w) - size + 1, size, np.uint64)
        for i in range(size):
            x = w[i : len(w) - size + 1 + i] * ODD[i]
            h = (h ^ (x ^ (x >> np.uint64(32)))) * ODD[0]
            h ^= h >> np.uint64(29)
        return np.unique(h)


def need(n: np.ndarray | int):
    """The least intersection of a set of n with any linked set."""
    return (80 * n + 99) // 100


def prefix(n: np.ndarray | int):
    """The prefix for one shared shingle."""
    return n - need(n) + 1


def kept(n: int) -> int:
    """How many of the least shingles of a set are kept beside its row: the prefix and room for it to grow."""
    p = prefix(n)
    return min(n, p + max(8, p // 4))


def pack(tokens: np.ndarray) -> bytes:
    return tokens.tobytes()


def unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64)


def class_of(s: np.ndarray) -> int:
    """The class of a set: a hash of all its shingles."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def sets_of(docs: DataFrame) -> DataFrame:
    """From (doc_id, text): doc_id, n, sig (the class of equal sets, null for empty sets), pre (the least shingles), t (a hash of the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for batch in slices(batches):
            n, sig, pre = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle(text)
                n.append(len(s))
                sig.append(class_of(s) if len(s) else None)
                pre.append(pack(s[: kept(len(s))]) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.int64()), pa.array(pre, pa.binary()), batch.column(2)], ["doc_id", "n", "sig", "pre", "t"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("t")).mapInArrow(run, "doc_id long, n long, sig long, pre binary, t long")


def entries(sets: DataFrame, most: int | None = None, bits: np.ndarray | None = None) -> DataFrame:
    """token, sig, n and rank r of the kept shingles; of the first ``most``, or of those that the filter, if any, may hold."""
    shared = None if bits is None else sets.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sig, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            parts = [unpack(x if most is None else x[: most * TOKEN_BYTES]) for x in batch.column(2).to_pylist()]
            sizes = [len(x) for x in parts]
            token, row, r = np.concatenate(parts), np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(k) for k in sizes])
            if shared is not None:
                at = place(token, len(shared.value))
                held = (shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
                token, row, r = token[held], row[held], r[held]
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(sig[row]), pa.array(n[row]), pa.array(r.astype(np.int64))], ["token", "sig", "n", "r"])

    return sets.where("sig is not null").select("sig", "n", "pre").mapInArrow(run, "token long, sig long, n long, r long")


MAP = ("m0", "m1", "m2", "m3")


def parities(s: np.ndarray) -> np.ndarray:
    """256 bits: for each value of a shingle's last byte, whether an odd number of shingles has it.

    Two sets differ in at least as many shingles as their bits differ, which bounds their intersection from above.
    """
    odd = np.bincount((s & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def place(token: np.ndarray, words: int) -> np.ndarray:
    """A token's bit in a filter of so many 64-bit words, a power of two."""
    return ((token.astype(np.uint64) * ODD[1]) >> np.uint64(64 - 6 - (words.bit_length() - 1))).astype(np.int64)


def token_filter(tokens: DataFrame) -> np.ndarray | None:
    """A bitmap like that of a Bloom join, with a set bit for each token and about 16 bits a token; none for too many tokens."""
    n = tokens.count()
    if n * BITS_A_TOKEN > 1 << FILTER_BITS:
        return None
    words = 1 << max(0, min(FILTER_BITS, (16 * n).bit_length()) - 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = place(batch.column(0).to_numpy(), words)
            word, inverse = np.unique(at >> 6, return_inverse=True)
            bits = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(bits, inverse, np.uint64(1) << (at & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], ["word", "bits"])

    got = tokens.select("token").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(words, np.uint64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def sizes_fit(a: str, b: str) -> Column:
    return (F.col(a) * 100 >= F.col(b) * 80) & (F.col(b) * 100 >= F.col(a) * 80)


def full_sets(docs: DataFrame, sets: DataFrame, wanted: DataFrame, exploded: bool = False) -> DataFrame:
    """(sig, n, s) with all shingle hashes for the classes in ``wanted`` (sig), made again from one text of each.

    With ``exploded`` a row for each shingle instead: token, sig, n and the parity bits. A class comes out once, also
    if its text stands in several rows of one id.
    """
    few = small_enough(wanted, BROADCAST_KEYS)
    mark = F.broadcast if few else (lambda df: df)
    ids = sets.select("doc_id", "sig").join(mark(wanted), "sig").groupBy("sig", "doc_id").agg(F.count("*").alias("copies"))
    rep = materialize(ids.groupBy("sig").agg(F.min(F.struct("doc_id", "copies")).alias("m")).select("sig", "m.doc_id", "m.copies"), "jaccard-rep")
    again = rep.where("copies > 1")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        shingle = Shingler()
        for batch in slices(batches):
            for sig, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = shingle(text)
                # another text under the same id is not the class asked for
                if len(x) and class_of(x) == sig:
                    yield sig, x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []
        for item in found(batches):
            held.append(item)
            if len(held) >= 200:
                yield from packed(held)
                held = []
        if held:
            yield from packed(held)

    def packed(held: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.int64()), pa.array([len(x) for _, x in held], pa.int64()), pa.array([x.tobytes() for _, x in held], pa.binary())], ["sig", "n", "s"])

    def row_each(sig: int, x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(unpack(pack(x))), *(pa.array(np.full(len(x), v)) for v in (sig, len(x), *parities(x)))], ["token", "sig", "n", *MAP])

    def run_exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sig, x in found(batches):
            yield row_each(sig, x)

    def run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield from map(row_each, batch.column(0).to_pylist(), (np.frombuffer(s, np.uint64) for s in batch.column(1).to_pylist()))

    def texts(rep: DataFrame) -> DataFrame:
        return docs.join(mark(rep), "doc_id").select("sig", "text")

    kinds = "sig long, n long, s binary", "token long, sig long, n long, " + ", ".join(f"{m} long" for m in MAP)
    once = texts(rep.where("copies = 1")).mapInArrow(run_exploded if exploded else run, kinds[exploded])
    if again.isEmpty():
        return once
    repeated = texts(again).mapInArrow(run, kinds[0]).dropDuplicates(["sig"])
    return once.unionByName(repeated.select("sig", "s").mapInArrow(run_rows, kinds[1]) if exploded else repeated)


def verify(docs: DataFrame, sets: DataFrame, pairs: DataFrame, label: str) -> DataFrame:
    """Of candidate pairs (a, b) of classes, those that link."""
    pairs = materialize(pairs, f"{label}-pairs")
    wanted = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct()
    full = materialize(full_sets(docs, sets, wanted), f"{label}-sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            link = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                link.append(100 * same >= 80 * (len(both) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(link)], ["a", "b", "link"])

    left = pairs.join(full.select(F.col("sig").alias("b"), F.col("s").alias("y")), "b")
    both = left.join(full.select(F.col("sig").alias("a"), F.col("s").alias("x")), "a").select("a", "b", "x", "y")
    links = materialize(both.mapInArrow(run, "a long, b long, link boolean").where("link").select("a", "b"), f"{label}-links")
    release(pairs, full)
    return links


def star_pairs(sets: DataFrame) -> DataFrame:
    """Each class with a centre that it has in common for two of its least shingles; the centre is the least class."""
    first = entries(sets, STARS).select("token", "sig", "n").distinct()
    centre = first.groupBy("token").agg(F.min(F.struct("sig", "n")).alias("c"), F.max("sig").alias("last")).where("c.sig < last")
    pairs = first.join(centre.select("token", F.col("c.sig").alias("a"), F.col("c.n").alias("an")), "token").where(F.col("sig") != F.col("a"))
    met = pairs.where(sizes_fit("n", "an")).groupBy("a", F.col("sig").alias("b"), "n").agg(F.count("*").alias("c"))
    return met.where(F.col("c") >= F.least(F.lit(2), F.col("n"))).select("a", "b")


def shared_entries(sets: DataFrame) -> DataFrame:
    """token, sig, n, r of the kept shingles that more than one document has (and a few more that the filter lets pass)."""
    often = materialize(entries(sets).groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token"), "jaccard-often")
    found = entries(sets, bits=token_filter(often)).groupBy("token", "sig", "n", "r").agg(F.count("*").alias("copies")).drop("copies")
    out = materialize(found, "jaccard-entries")
    release(often)
    return out


def with_comp(shared: DataFrame, comp: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entries with their class's component, and (token, c) of the shingles that stand in several components."""
    named = shared.join(maybe_broadcast(comp.select(F.col("node").alias("sig"), "comp")), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    groups = named.groupBy("token").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token", "c")
    return named, groups


def hot_star_pairs(shared: DataFrame, comp: DataFrame) -> DataFrame:
    """For each hot shingle in several components its plainest class, and the classes of other components that have it.

    The plainest class is the one whose shingles are the most frequent ones: of a family of near copies, one with few
    changes of its own, to which most others link.
    """
    named, groups = with_comp(shared, comp)
    hot = materialize(named.join(groups.where(F.col("c") > HOT), "token"), "jaccard-hot")
    plain = hot.groupBy("sig").agg(F.sum("c").alias("weight"))
    hot = hot.join(plain, "sig")
    centre = hot.groupBy("token").agg(F.max(F.struct("weight", "sig", "n", "comp")).alias("m"))
    centre = materialize(centre.select("token", F.col("m.sig").alias("a"), F.col("m.n").alias("an"), F.col("m.comp").alias("acomp")), "jaccard-centre")
    met = hot.join(maybe_broadcast(centre), "token")
    met = met.where("comp <> acomp").where(sizes_fit("n", "an")).groupBy("a", F.col("sig").alias("b"), "n").agg(F.count("*").alias("c"))
    return met.where(F.col("c") >= F.least(F.lit(2), F.col("n"))).select("a", "b")


def candidate_pairs(docs: DataFrame, sets: DataFrame, shared: DataFrame, comp: DataFrame, scratch: list[DataFrame]) -> DataFrame:
    """Pairs of classes of different components that may link; ``scratch`` gets the tables that they are made from."""
    shared, groups = with_comp(shared, comp)
    followed = shared.join(groups, "token").withColumn("hot", (F.col("c") > HOT).cast("int"))
    in_order = Window.partitionBy("sig").orderBy("r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("sig").orderBy("r").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = F.col("n") - F.floor((80 * F.col("n") + 99) / 100) + 1
    room = F.least(F.col("n"), p + F.greatest(F.lit(8), F.floor(p / 4)))
    cost = F.sum(F.when(F.col("hot") == 0, F.col("c") - 1).otherwise(0)).over(whole)
    followed = followed.withColumn("at", F.col("r") - F.sum("hot").over(in_order)).withColumn("hots", F.sum("hot").over(whole)).withColumn("cost", cost)
    followed = followed.withColumn("p", p).withColumn("spare", room - p - F.col("hots"))
    match = F.greatest(F.lit(1), F.least(F.col("spare") + 1, F.floor(F.col("cost") / 4)))
    followed = materialize(followed.withColumn("match", match).select("token", "sig", "n", "comp", "hot", "at", "p", "match", (F.col("spare") < 0).alias("over")), "jaccard-followed")
    scratch.append(followed)
    used = followed.where("not over and hot = 0 and at < p + match - 1").select("token", "sig", "n", "comp", "match")

    def joined(x: DataFrame, y: DataFrame, extra: str) -> DataFrame:
        x, y = (d.select("token", *(F.col(c).alias(f"{c}{k}") for c in d.columns if c != "token")) for k, d in ((1, x), (2, y)))
        return x.join(y, "token").where(F.expr(extra)).where("comp1 <> comp2").where(sizes_fit("n1", "n2"))

    def pairs(found: DataFrame, enough: str) -> DataFrame:
        found = found.groupBy(F.least("sig1", "sig2").alias("a"), F.greatest("sig1", "sig2").alias("b")).agg(F.count("*").alias("shared"), F.min("match").alias("match"))
        return found.where(enough).select("a", "b")

    usual = pairs(joined(used, used, "sig1 < sig2").withColumn("match", F.least("match1", "match2")), "shared >= match")
    over = materialize(followed.where("over").select("sig", "comp").distinct(), "jaccard-over")
    scratch.append(over)
    if over.isEmpty():
        return usual

    full = full_sets(docs, sets, over.select("sig"), exploded=True)
    full = materialize(full.join(maybe_broadcast(over), "sig").select("token", "sig", "n", *MAP, "comp"), "jaccard-full")
    scratch.append(full)
    mixed = pairs(joined(used, full.drop(*MAP).withColumn("match", F.lit(1)), "true").withColumn("match", F.col("match1")), "shared >= match")
    counted = full.join(full.groupBy("token").agg(F.count("*").alias("c")), "token")
    ranked = counted.withColumn("at", F.row_number().over(Window.partitionBy("sig").orderBy("c", "token")) - 1).where("c > 1")
    large = ranked.where("at <= n - floor((80 * n + 99) / 100)").select("token", "sig", "n", *MAP, "comp", "at")
    small = large.where("at <= n - floor((160 * n + 179) / 180)")
    differ = " + ".join(f"bit_count({m}1 ^ {m}2)" for m in MAP)
    bound = f"(n1 < n2 or n1 = n2 and sig1 < sig2) and 180 * least(n1 - at1, n2 - at2) >= 80 * (n1 + n2) and 90 * (n1 + n2 - ({differ})) >= 80 * (n1 + n2)"
    rare = pairs(joined(small, large, bound).withColumn("match", F.lit(1)), "shared >= 1")
    return usual.unionByName(mixed).unionByName(rare).distinct()


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles and component_id, the least id reachable by links."""
    return linked(docs, id_col, text_col).select(F.col("doc_id").alias(id_col), "n_shingles", "component_id")


def linked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: doc_id, t (a hash of the text), n_shingles, component_id, and comp, the component of its class (null for empty sets)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = materialize(sets_of(docs), "jaccard-sets")
    # texts are read again by id, so classes are compared by their rows with one
    known = sets.where("doc_id is not null")
    links = verify(docs, known, star_pairs(known), "star")
    comp = materialize(components(links), "jaccard-comp")
    shared = shared_entries(known)
    for _ in range(HOT_ROUNDS):
        pairs = materialize(hot_star_pairs(shared, comp), "hot-pairs")
        if pairs.isEmpty():
            break
        found = verify(docs, known, pairs, "hot")
        if found.isEmpty():
            break
        links = links.unionByName(found)
        comp = materialize(components(links), "jaccard-comp")
    scratch = [shared]
    found = verify(docs, known, candidate_pairs(docs, known, shared, comp, scratch), "prefix")
    release(*scratch)
    comp = materialize(components(links.unionByName(found)), "jaccard-comp")
    classes = sets.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("least"))
    classes = classes.join(comp.withColumnRenamed("node", "sig"), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    least = classes.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = classes.join(least, "comp").select("sig", "component_id", "comp")
    out = sets.select("doc_id", "t", "n", "sig").join(named, "sig", "left")
    return out.select("doc_id", "t", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "comp")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component, with all its columns: that with the least id, and of its texts the one with the least hash.

    It is decided by id and text, so of an id with several texts only those go that link to a row that stays. Of repeated
    rows one stays. Rows without words link with nothing, and rows without an id take no part; all of those stay.
    """
    found = materialize(linked(docs, id_col, text_col).where("comp is not null and doc_id is not null").groupBy("comp", "doc_id", "t").agg(F.count("*").alias("copies")), "jaccard-rows")
    stays = found.groupBy("comp").agg(F.min(F.struct("doc_id", "t")).alias("m"), F.sum("copies").alias("rows")).where("rows > 1").drop("rows")
    # written first, so that the rows of a large component can be split where the join shuffles
    stays = materialize(stays, "jaccard-stays")
    marked = found.join(maybe_broadcast(stays), "comp").withColumn("stays", (F.col("doc_id") == F.col("m.doc_id")) & (F.col("t") == F.col("m.t")))
    row, t, at = fresh_names(docs, 3)
    marked = materialize(marked.where("not stays or copies > 1").select(F.col("doc_id").alias(row), F.col("t").alias(t), "stays"), "jaccard-gone")
    release(found, stays)
    named = docs.withColumn(row, F.col(id_col).cast("long")).withColumn(t, F.xxhash64(text_col))
    out = named.join(maybe_broadcast(marked.select(row, t)), [row, t], "left_anti")
    repeated = marked.where("stays").select(row, t)
    if not repeated.isEmpty():
        plain = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]
        again = named.join(maybe_broadcast(repeated), [row, t], "left_semi")
        first = F.row_number().over(Window.partitionBy(row, t).orderBy(F.xxhash64(*plain)))
        out = out.unionByName(again.withColumn(at, first).where(F.col(at) == 1).drop(at))
    return out.select(*docs.columns)
