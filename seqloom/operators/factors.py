"""Relative parsing of sequences, and what is derived from the factors.

A parsed sequence is one row with arrays of positions, lengths and starts; ``exploded`` gives one row a factor. Parsing
takes one stage without a shuffle: every worker maps the
reference sequence and its suffix array and parses the sequences it reads.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions import symbols
from seqloom.operators import kernels
from seqloom.operators.range_join import range_join
from seqloom.operators.running import running_sums
from seqloom.scratch import BROADCAST_ROWS, small
from seqloom.sources import reference
from seqloom.sources.sequences import Collection

PARSED = "seq_id long, name string, len long, pos array<long>, size array<long>, start array<long>"
PACKED = "seq_id long, name string, len long, pos binary, size binary"
LISTS = pa.list_(pa.int64())
LEVEL_BLOCK = 4096
#: Places of a sequence that meet its factors together.
PLACES = 10_000


def _parse(c: Collection, where: str | None, schema: str, lists: Callable[[np.ndarray, pa.Array], pa.Array], names: list[str]) -> DataFrame:
    """Every target as factors, whose lists are made of their values and offsets."""
    where, symbols_of = where or reference.stored(c.spark, c.ref), c.symbols()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = reference.parser(where)
        for batch in batches:
            data, bounds = symbols_of(batch.column(2))
            pos, size, start, counts = p.parse_texts(data, bounds)
            offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            found = (pos, size, start - np.repeat(bounds[:-1], counts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(bounds)), *(lists(x, offsets) for x in found[: len(names) - 3])], names)

    return c.raw("seq_id", "name").mapInArrow(run, schema)


def parse(c: Collection, where: str | None = None) -> DataFrame:
    """Every target as factors; ``where``: the folder of the reference sequence's files, if not the usual one."""
    return _parse(c, where, PARSED, lambda x, offsets: pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)), ["seq_id", "name", "len", "pos", "size", "start"])


def packed(c: Collection) -> DataFrame:
    """Every target as factors for a search, whose lists ``pos`` and ``size`` are bytes of 32-bit numbers, so that Spark passes them on as they are."""
    pack = lambda x, offsets: pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(4 * offsets), pa.py_buffer(x.astype(np.int32))])
    return _parse(c, None, PACKED, pack, ["seq_id", "name", "len", "pos", "size"])


def exploded(parsed: DataFrame, ref_len: int) -> DataFrame:
    """seq_id, fac_no, pos (null for literals), len, is_n, literal, seq_start."""
    rows = parsed.select("seq_id", F.posexplode(F.arrays_zip("pos", "size", "start")).alias("no", "f"))
    p = F.col("f.pos")
    return rows.select("seq_id", F.col("no").cast("long").alias("fac_no"), F.when(p >= 0, p).alias("pos"), F.col("f.size").alias("len"), (p == ref_len).alias("is_n"), F.when(p < 0, F.chr(-1 - p)).alias("literal"), F.col("f.start").alias("seq_start"))


def catalog(parsed: DataFrame) -> DataFrame:
    """seq_id, len, n_factors, and where the sequence and its factors start in the whole collection."""
    sizes = parsed.select("seq_id", "len", F.size("pos").cast("long").alias("n_factors"))
    return running_sums(sizes, "seq_id", {"abs_start": "len", "first_factor": "n_factors"})


def numbered(parsed: DataFrame, ref_len: int) -> DataFrame:
    """Factors with their number and start in the whole collection."""
    places = catalog(parsed).select("seq_id", "abs_start", "first_factor").withColumnRenamed("abs_start", "base")
    rows = exploded(parsed, ref_len).join(places, "seq_id")
    return rows.select("seq_id", (F.col("first_factor") + F.col("fac_no")).alias("fac_id"), "fac_no", "pos", "len", "is_n", "literal", "seq_start", (F.col("base") + F.col("seq_start")).alias("abs_start"))


def expand(parsed: DataFrame, ref: bytes) -> DataFrame:
    """seq_id, name, seq: the sequences of their factors."""
    shared = parsed.sparkSession.sparkContext.broadcast(ref)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = [kernels.expand(shared.value, p, k).decode("ascii") for p, k in kernels.factor_lists(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(seqs, pa.string())], ["seq_id", "name", "seq"])

    return parsed.select("seq_id", "name", "pos", "size").mapInArrow(run, "seq_id long, name string, seq string")


def neighbours(factors: DataFrame) -> DataFrame:
    """Each factor with position and length of the ones before and after it in its sequence."""
    from pyspark.sql import Window

    w = Window.partitionBy("seq_id").orderBy("fac_no")
    return factors.select("*", *[f(c).over(w).alias(f"{n}_{c}") for n, f in (("prev", F.lag), ("next", F.lead)) for c in ("pos", "len", "is_n")])


def with_neighbours(parsed: DataFrame, ref_len: int) -> DataFrame:
    """What ``neighbours`` gives of the factors of parsed sequences, from their arrays, without a shuffle."""
    some = parsed.where(F.size("pos") > 0)
    beside = {"prev": lambda c: F.concat(F.array(F.lit(None).cast("long")), F.slice(c, 1, F.size(c) - 1)), "next": lambda c: F.concat(F.slice(c, 2, F.size(c) - 1), F.array(F.lit(None).cast("long")))}
    lists = some.select("seq_id", "pos", "size", "start", *[f(F.col(c)).alias(f"{n}_{c}") for n, f in beside.items() for c in ("pos", "size")])
    rows = lists.select("seq_id", F.posexplode(F.arrays_zip(*lists.columns[1:])).alias("no", "f"))
    plain = lambda p: F.when(p >= 0, p)
    p = F.col("f.pos")
    own = ["seq_id", F.col("no").cast("long").alias("fac_no"), plain(p).alias("pos"), F.col("f.size").alias("len"), (p == ref_len).alias("is_n"), F.when(p < 0, F.chr(-1 - p)).alias("literal"), F.col("f.start").alias("seq_start")]
    near = [x for n in beside for x in (plain(F.col(f"f.{n}_pos")).alias(f"{n}_pos"), F.col(f"f.{n}_size").alias(f"{n}_len"), (F.col(f"f.{n}_pos") == ref_len).alias(f"{n}_is_n"))]
    return rows.select(*own, *near)


def statistics(parsed: DataFrame, ref_len: int) -> DataFrame:
    """Per sequence: symbols, factors, runs of n, the longest factor; from the arrays, without a shuffle."""
    n = F.size(F.filter("pos", lambda p: p == ref_len)).cast("long")
    return parsed.select("seq_id", "len", F.size("pos").cast("long").alias("n_factors"), n.alias("n_runs"), F.coalesce(F.array_max(F.transform(F.arrays_zip("pos", "size"), lambda f: F.when(f["pos"] != ref_len, f["size"]).otherwise(0))), F.lit(0)).cast("long").alias("longest"))


def sites(factors: DataFrame) -> DataFrame:
    """Positions of the reference sequence at which a factor starts or ends; runs of n end nowhere."""
    starts = factors.where("not is_n and pos is not null").select(F.lit("start").alias("kind"), "pos")
    ends = factors.where("not is_n and pos is not null").select(F.lit("end").alias("kind"), (F.col("pos") + F.col("len")).alias("pos"))
    return starts.unionByName(ends).groupBy("kind", "pos").agg(F.count("*").alias("n"))


def short_factors(factors: DataFrame, ref: bytes) -> DataFrame:
    """The factors that the short encoding writes as literals, with their text."""
    whole = F.lit(bytearray(ref))  # slices of bytes cost their own length, slices of a string what lies before them too
    text = F.coalesce("literal", F.decode(F.substring(whole, F.col("pos").cast("int") + 1, F.col("len").cast("int")), "US-ASCII"))
    limit = kernels.short_limit(ref)
    return factors.where(f"not is_n and (len <= {limit} or literal is not null)").withColumn("text", text).where("not contains(text, 'n')").select("seq_id", "fac_no", "len", "text")


def encoded_bits(parsed: DataFrame, ref: bytes) -> DataFrame:
    """Per sequence the bits of its four binary encodings, without headers, from the lengths of codes; no bits are made."""
    shared = parsed.sparkSession.sparkContext.broadcast(ref)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value

        def bits(pos: list[int], size: list[int], short: bool, liss: bool) -> int | None:
            if not short and any(p < 0 for p in pos):
                return None
            return kernels.encode_bits(r, pos, size, short, liss)

        for batch in batches:
            rows = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([bits(p, k, s, li) for p, k in rows], pa.int64()) for s in (False, True) for li in (False, True))], ["seq_id", "plain", "liss", "short", "short_liss"])

    return parsed.select("seq_id", "pos", "size").mapInArrow(run, "seq_id long, plain long, liss long, short long, short_liss long")


def rising(parsed: DataFrame, ref_len: int, starts: bool = False) -> DataFrame:
    """The factors of a longest rising run of each sequence: seq_id, fac_no, pos, delta to the suggested position; with ``starts`` also their seq_start."""
    names = ["seq_id", "fac_no", "pos", "delta", "seq_start"][: 4 + starts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[np.ndarray, ...]] = []
            for s, p, k in zip(*batch.columns, strict=True):
                pos, size = p.values.to_numpy(), k.values.to_numpy()
                chosen = np.array(kernels.rising(pos.tolist(), ref_len), np.int64)
                start = (np.cumsum(size) - size)[chosen]
                shift = pos[chosen] - start
                found.append((np.full(len(chosen), s.as_py(), np.int64), chosen, pos[chosen], np.diff(shift, prepend=shift[:1]), start))
            if found:
                # the first of each sequence has no delta
                first = np.concatenate([np.arange(len(f[1])) == 0 for f in found])
                columns = [np.concatenate(x) for x in zip(*found, strict=True)][: len(names)]
                yield pa.RecordBatch.from_arrays([pa.array(x, mask=first if n == "delta" else None) for n, x in zip(names, columns, strict=True)], names)

    return parsed.select("seq_id", "pos", "size").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def restore_rising(chosen: DataFrame, factors: DataFrame | None = None) -> DataFrame:
    """Positions from deltas: a running sum of the deltas plus the factor's start, which comes from a table of factors unless the chosen ones have it."""
    from pyspark.sql import Window

    rows = chosen if factors is None else chosen.join(factors.select("seq_id", "fac_no", "seq_start"), ["seq_id", "fac_no"])
    w = Window.partitionBy("seq_id").orderBy("fac_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col("delta").isNull(), F.col("pos") - F.col("seq_start")).otherwise(F.col("delta"))
    return rows.withColumn("restored", F.sum(step).over(w) + F.col("seq_start")).select("seq_id", "fac_no", "pos", "restored")


def nested_levels(factors: DataFrame, block: int = LEVEL_BLOCK) -> DataFrame:
    """Levels of the different intervals of the reference sequence, by start and falling length.

    An interval's level depends only on those that contain it, and all of these meet the place where it starts. So
    intervals are copied to every block of positions that they meet, and each block gives the levels of those that start in it.
    """
    spans = factors.where("not is_n and pos is not null").groupBy("pos", "len").agg(F.count("*").alias("n"))
    cut = spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("pos") / block), F.floor((F.col("pos") + F.col("len") - 1) / block))))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("pos", "ascending"), ("len", "descending")])
        got = kernels.levels(table["pos"].to_pylist(), table["len"].to_pylist())
        own = pa.array(table["pos"].to_numpy() // block == table["block"].to_numpy())
        return table.select(["pos", "len", "n"]).append_column("level", pa.array(got, pa.int64())).filter(own)

    return cut.groupBy("block").applyInArrow(run, "pos long, len long, n long, level long")


def in_sequences(places: DataFrame, catalog: DataFrame) -> DataFrame:
    """From positions in the whole collection (a column ``abs_pos``): the sequence and the position in it, as more columns."""
    spans = catalog.select("seq_id", F.col("abs_start").alias("_lo"), (F.col("abs_start") + F.col("len")).alias("_hi"))
    return range_join(places, spans, "abs_pos", "_lo", "_hi", width=1 << 16).select(*places.columns, "seq_id", (F.col("abs_pos") - F.col("_lo")).alias("pos"))


def code_strings(factors: DataFrame, ref_len: int) -> DataFrame:
    """Each standard factor's bits as text: position in fixed width, length in Rice code."""
    width = symbols.position_bits(F.lit(ref_len))
    return factors.where("pos is not null").select("seq_id", "fac_no", symbols.fixed_binary(F.col("pos"), width).alias("pos_bits"), symbols.rice(F.col("len"), symbols.LENGTH_DIVISOR).alias("len_bits"))


def rank(parsed: DataFrame, places: DataFrame, listed: int = PLACES) -> DataFrame:
    """Places (seq_id, at, ...) of sequences with the factor that holds them: fac_no, pos (negative for literals), len, seq_start. Places outside their sequence are left out.

    The places of a sequence meet its factors as lists of about ``listed`` at most, so factors stay arrays and are sent once for each list.
    """
    names = places.columns
    asked = places.where("seq_id is not null and at is not null")
    many = asked.groupBy("seq_id").agg(F.ceil(F.count("*") / listed).alias("lists"))
    part = F.pmod(F.xxhash64(*names), F.col("lists"))
    lists = asked.join(small(many), "seq_id").groupBy("seq_id", part.alias("list")).agg(F.collect_list(F.struct(*names)).alias("asked"))
    factors = parsed.select("seq_id", F.col("pos").cast("array<long>").alias("pos"), F.col("size").cast("array<int>").alias("size"))
    few = asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    met = factors.join(F.broadcast(lists) if few else lists, "seq_id").select("asked", "pos", "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, pos, size in zip(*batch.columns, strict=True):
                rows, pos, size = asked.values, pos.values.to_numpy(), size.values.to_numpy().astype(np.int64)
                at, end = rows.field("at").to_numpy(), np.cumsum(size)
                own = np.searchsorted(end, at, "right")
                inside = np.flatnonzero((at >= 0) & (own < len(end)))
                own, rows = own[inside], rows.take(pa.array(inside))
                found = (own, pos[own], size[own], end[own] - size[own])
                yield pa.RecordBatch.from_arrays([*(rows.field(n) for n in names), *map(pa.array, found)], [*names, "fac_no", "pos", "len", "seq_start"])

    nothing = F.lit(0).cast("long")
    schema = places.select("*", *[nothing.alias(n) for n in ("fac_no", "pos", "len", "seq_start")]).schema
    return met.mapInArrow(run, schema)


def symbols_at(rows: DataFrame, ref: bytes) -> DataFrame:
    """Adds ``symbol``: the one at ``offset`` in the factor (pos, len)."""
    shared = rows.sparkSession.sparkContext.broadcast(ref)
    names = [*rows.columns, "symbol"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        for batch in batches:
            cells = zip(*(batch.column(names.index(n)).to_pylist() for n in ("pos", "len", "offset")), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([kernels.tail_of(r, p, k, k - o)[:1].decode() for p, k, o in cells], pa.string())], names)

    return rows.mapInArrow(run, rows.select("*", F.lit("").alias("symbol")).schema)


def properties(c: Collection, parsed: DataFrame) -> DataFrame:
    """Per sequence: symbols, runs of n, gaps between factors, factors that read otherwise than the sequence, and factors
    that could be longer. Found from the sequences by plain search in the reference sequence, not by its suffix array."""
    shared, symbols_of = c.spark.sparkContext.broadcast(c.ref), c.symbols()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = symbols_of(batch.column(1))
            counts = np.diff(batch.column(2).offsets.to_numpy())
            found = kernels.faults(shared.value, data, bounds, *(batch.column(k).flatten().to_numpy() for k in (2, 3, 4)), counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (np.diff(bounds), *found))], names)

    names = ["seq_id", "len", "n_runs", "n_gaps", "n_wrong", "n_longer"]
    rows = c.raw("seq_id").join(parsed.select("seq_id", "pos", "size", "start"), "seq_id")
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def round_trip(c: Collection, parsed: DataFrame) -> DataFrame:
    """One row: sequences, symbols, and sequences that do not come back as they were."""
    back = expand(parsed, c.ref).select("seq_id", F.sha2("seq", 256).alias("after"))
    before = c.targets.select("seq_id", F.sha2(F.lower("seq"), 256).alias("before"), F.length("seq").alias("n"))
    return before.join(back, "seq_id", "full_outer").agg(F.count("*").alias("n_seqs"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_symbols"), F.count_if(~F.col("before").eqNullSafe(F.col("after"))).alias("n_diffs"))
