"""Reading windows and finding patterns in parsed sequences, from the factors alone; no sequence is expanded for a search.

A hit in a target lies within one factor, or it has a first border between factors at some split of the pattern. Both are equi-joins
of keys of the patterns and keys of the factors (see ``keys``): an occurrence of the pattern in the reference sequence with
the dyadic parts at which factors stand, and the longer part of a split with the words beside the borders. Masks compare what the
words hold on both sides within the join; only what reaches beyond them is read from the factors afterwards.

The keys of the factors are made when they are asked for, or come from a saved index, sorted, of which only
the ranges that a pattern asks for are read. ``strict`` leaves out, in targets, hits over more than two factors and whatever meets a run of n;
``complete`` keeps all.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from seqloom.operators import kernels, keys
from seqloom.operators.matching import Texts
from seqloom.scratch import BROADCAST_ROWS, written
from seqloom.sources import reference

#: By the number of factors that a hit meets: 1, 2, or 3 for more.
MODES = {"complete": "true", "strict": "not meets_n and met <= 2", "in_factor": "not meets_n and met = 1", "boundary": "not meets_n and met = 2"}
REQUESTS_A_ROW = 10_000
#: Ranges of keys that one scan of a saved index is told beside its buckets (so few that the check of a row stays small), scans of a
#: table, and sequences of which a scan is told the numbers.
RANGES, SCANS, SEQUENCES = 32, 8, 1000
#: Rows of a saved table that is scanned whole rather than in several scans.
SMALL = 1 << 20
#: How much of all words the ranges may have for which a saved table is read (words of any 20 symbols: 2 ** 60).
WIDE = 1 << 54


@dataclass
class Table:
    """A saved table of keys in runs that are sorted by a column; ``count``: the rows of each file."""

    rows: DataFrame
    column: str
    count: np.ndarray

    def serves(self, lo: np.ndarray, hi: np.ndarray) -> bool:
        """Whether a search should read this table: it is small, or the ranges take no more scans than it gives them and have few of the keys.

        For many or wide ranges most rows would be read, several times as many bytes as the factors that they were made from.
        """
        if self.count.sum() <= SMALL:
            return True
        apart = keys.merged(lo, hi, len(lo)) if len(lo) else []
        return len(apart) <= RANGES * SCANS and sum(b - a for a, b in apart) <= WIDE

    def within(self, lo: np.ndarray, hi: np.ndarray) -> DataFrame:
        """The rows in ranges of keys, from the row groups that meet them; at most ``SCANS`` scans with ``RANGES`` ranges each.

        Of a small table that would take several scans all rows come, in one.
        """
        if len(lo) > RANGES and self.count.sum() <= SMALL:
            return self.rows
        # ranges that do not overlap, so no row is in two scans
        ranges = keys.merged(lo, hi, RANGES * SCANS)
        out = None
        for a in range(0, max(1, len(ranges)), RANGES):
            rows = self.rows.where(in_ranges(self.column, ranges[a : a + RANGES]))
            out = rows if out is None else out.unionByName(rows)
        return out


@dataclass
class Keys:
    """Saved keys: borders by the word behind them, and by the word before them, and dyadic parts by key."""

    by_right: Table
    by_left: Table
    inside: Table


def valid(patterns: DataFrame) -> DataFrame:
    """pattern_id and pattern in lower case; empty ones and those with other symbols match nothing."""
    return patterns.select("pattern_id", F.lower("pattern").alias("pattern")).where("pattern rlike '^[acgnt]+$'")


def in_ranges(column: str, ranges: list[tuple[int, int]]) -> Column:
    """Whether a column lies in one of the ranges; as comparisons with constants, so that scans skip what holds none."""
    parts = [F.col(column).between(lo, hi) for lo, hi in ranges]
    while len(parts) > 1:
        parts = [reduce(lambda a, b: a | b, parts[k : k + 2]) for k in range(0, len(parts), 2)]
    return parts[0] if parts else F.lit(False)


def by_tags(borders: DataFrame, tags: list[int]) -> DataFrame:
    """Borders once for each side and size of a key."""
    side = lambda t: F.col("right" if t > 0 else "left").bitwiseAND(F.lit(int(keys.HIGH[abs(t)])))
    rows = F.array(*[F.struct(F.lit(t).alias("tag"), side(t).alias("key")) for t in tags])
    return borders.withColumn("k", F.explode(rows)).select("*", F.col("k.tag").alias("own_tag"), F.col("k.key").alias("key")).drop("k")


def border_rows(parsed: DataFrame, ref: bytes, asked: DataFrame, tags: list[int], saved: Keys | None, few: bool) -> DataFrame:
    """The borders with the keys that splits ask for; those that are saved only from the ranges in which some split has its key, if they are few.

    A bounded table of splits goes to the tasks that make the borders, so that no others leave them.
    """
    if saved is not None:
        wanted = {k: keys.ranges(asked.where(f"tag {sign} 0"), "lo", "hi") for k, sign in (("by_right", ">"), ("by_left", "<"))}
        if not all(getattr(saved, k).serves(*w) for k, w in wanted.items()):
            saved = None
    if saved is None:
        return by_tags(keys.borders(parsed, ref, keys.Asked.of(asked) if few else None), tags)
    out = None
    for name, own in (("by_right", [t for t in tags if t > 0]), ("by_left", [t for t in tags if t < 0])):
        if own:
            rows = by_tags(getattr(saved, name).within(*wanted[name]), own)
            out = rows if out is None else out.unionByName(rows)
    return out


def across(parsed: DataFrame, ref: bytes, patterns: DataFrame, saved: Keys | None) -> DataFrame | None:
    """pattern_id, seq_id, pos, met, meets_n of the hits over borders."""
    asked = written(keys.splits(ref, patterns), "splits")
    n, tags, more = asked.agg(F.count("*"), F.sort_array(F.collect_set("tag")), F.max("more")).first()
    if not n:
        return None
    few = n <= BROADCAST_ROWS
    rows = border_rows(parsed, ref, asked, tags, saved if few else None, few)
    agree = lambda side: F.col(side).bitwiseXOR(F.col(f"own_{side}")).bitwiseAND(F.col(f"{side}_mask")) == 0
    sides = asked.drop("lo", "hi").withColumnRenamed("left", "own_left").withColumnRenamed("right", "own_right")
    found = rows.join(F.broadcast(sides) if few else sides, "key").where((F.col("own_tag") - F.col("tag") == 0) & (F.col("prev_len") >= F.col("least")) & agree("left") & agree("right"))
    met = F.when((F.col("prev_len") >= F.col("i")) & (F.col("len") >= F.col("m") - F.col("i")), 2).otherwise(3)
    found = found.select("pattern_id", "seq_id", (F.col("at") - F.col("i")).alias("pos"), met.alias("met"), "meets_n", "more", "m")
    if not more:
        return found.drop("more", "m")
    found = written(found.withColumn("req_id", F.monotonically_increasing_id()), "candidates")
    open_ = found.where("more")
    if saved is not None:
        some = [r[0] for r in open_.select("seq_id").distinct().limit(SEQUENCES + 1).collect()]
        parsed = parsed.where(F.col("seq_id").isin(some)) if len(some) <= SEQUENCES else parsed
    texts = display(parsed, ref, open_.select("req_id", "seq_id", F.col("pos").alias("start"), (F.col("pos") + F.col("m")).alias("end")))
    same = open_.join(texts, "req_id").join(F.broadcast(patterns) if few else patterns, "pattern_id").where("text = pattern")
    columns = ["pattern_id", "seq_id", "pos", "met", "meets_n"]
    return found.where("not more").select(columns).unionByName(same.select(columns))


def within(parsed: DataFrame, ref: bytes, patterns: DataFrame, saved: Keys | None) -> DataFrame:
    """pattern_id, seq_id, pos, met, meets_n of the hits in one factor."""
    asked = written(keys.points(ref, patterns), "points")
    n, least = asked.agg(F.count("*"), F.coalesce(F.min("m"), F.lit(1))).first()
    few = n <= BROADCAST_ROWS
    wanted = keys.ranges(asked, "key", "key") if saved is not None and few else None
    if wanted is None or not saved.inside.serves(*wanted):
        rows = keys.inside(parsed, ref, least, keys.Held.of(asked) if few else None)
    else:
        rows = saved.inside.within(*wanted)
    run, usual = F.col("key") == keys.RUN_KEY, F.col("key") >= 0
    holds = (F.col("place") >= F.col("pos")) & (F.col("place") + F.col("m") <= F.col("pos") + F.col("len"))
    found = rows.join(F.broadcast(asked) if few else asked, "key").where(F.when(usual, holds).otherwise(F.col("len") >= F.col("m")))
    first = F.when(usual, F.col("at") + F.col("place") - F.col("pos")).otherwise(F.col("at"))
    more = F.when(run, F.col("len") - F.col("m")).otherwise(F.lit(0))
    return found.select("pattern_id", "seq_id", F.explode(F.sequence(first, first + more)).alias("pos"), F.lit(1).alias("met"), run.alias("meets_n"))


def hits(parsed: DataFrame, ref: bytes, patterns: DataFrame, saved: Keys | None = None, mode: str = "complete") -> DataFrame:
    """pattern_id, seq_id, pos, met (1, 2 or 3 for more factors), meets_n: the hits of a mode in the targets."""
    usable = written(valid(patterns), "usable")
    over = across(parsed, ref, usable, saved) if mode != "in_factor" else None
    inner = within(parsed, ref, usable, saved) if mode != "boundary" or over is None else None
    found = over if inner is None else inner if over is None else inner.unionByName(over)
    return found.where(MODES[mode])


def in_reference(ref: bytes, patterns: DataFrame) -> DataFrame:
    """pattern_id, seq_id (0), pos: hits in the reference sequence, from its suffix array."""
    where = reference.stored(patterns.sparkSession, ref)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = reference.parser(where)
        for batch in batches:
            data, bounds = keys.text_bytes(batch.column(1))
            ids = batch.column(0).to_numpy()
            for own, place in keys.places(p, data, bounds):
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(np.zeros(len(own), np.int64)), pa.array(place)], ["pattern_id", "seq_id", "pos"])

    return valid(patterns).mapInArrow(run, "pattern_id long, seq_id long, pos long")


def in_targets(parsed: DataFrame, ref: bytes, patterns: DataFrame, mode: str = "complete", saved: Keys | None = None) -> DataFrame:
    """pattern_id, seq_id, pos of the hits of a mode in the targets."""
    return hits(parsed, ref, patterns, saved, mode).select("pattern_id", "seq_id", "pos")


def locate(parsed: DataFrame, ref: bytes, patterns: DataFrame, mode: str = "complete", saved: Keys | None = None) -> DataFrame:
    """pattern_id, seq_id, pos of all hits, those in the reference sequence as sequence 0."""
    return in_reference(ref, patterns).unionByName(in_targets(parsed, ref, patterns, mode, saved))


def count(parsed: DataFrame, ref: bytes, patterns: DataFrame, mode: str = "complete", saved: Keys | None = None) -> DataFrame:
    """pattern_id, pattern, n; patterns without a hit have 0."""
    n = locate(parsed, ref, patterns, mode, saved).groupBy("pattern_id").agg(F.count("*").alias("n"))
    return patterns.join(n, "pattern_id", "left").select("pattern_id", "pattern", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def workload(patterns: DataFrame, counted: DataFrame) -> DataFrame:
    """One row about a run of patterns: queries, their symbols, all hits, the most of one pattern, and patterns without a hit."""
    rows = patterns.select("pattern_id", F.length("pattern").alias("m")).join(counted.select("pattern_id", "n"), "pattern_id")
    return rows.agg(F.count("*").alias("n_queries"), F.coalesce(F.sum("m"), F.lit(0)).cast("long").alias("n_symbols"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_hits"), F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("most_hits"), F.count_if(F.col("n") == 0).alias("n_without"))


@dataclass
class Times:
    """What a run of requests took: answers, what they count (symbols or hits), and seconds."""

    answers: int
    units: int
    seconds: float

    @property
    def micros(self) -> float:
        """Microseconds for each symbol or hit; all of them if there was none."""
        return 1e6 * self.seconds / max(self.units, 1)


def timed(answers: DataFrame, units: Column, target: str) -> Times:
    """Write the answers and observe them as they are written: how many, and the sum of their units."""
    seen = Observation("answers")
    watched = answers.observe(seen, F.count("*").alias("answers"), F.coalesce(F.sum(units), F.lit(0)).cast("long").alias("units"))
    began = time.perf_counter()
    watched.write.mode("overwrite").parquet(target)
    seconds = time.perf_counter() - began
    return Times(seen.get["answers"], seen.get["units"], seconds)


def intervals(ref: bytes, patterns: DataFrame) -> DataFrame:
    """pattern_id, lo, hi: the ranks in the suffix array whose suffixes start with the pattern; null without a hit."""
    where = reference.stored(patterns.sparkSession, ref)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = reference.parser(where)
        for batch in batches:
            data, bounds = keys.text_bytes(batch.column(1))
            lo, hi = p.intervals(Texts(p, data, bounds), bounds[:-1], np.diff(bounds)) if len(bounds) > 1 else (bounds[:0], bounds[:0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lo, mask=lo >= hi), pa.array(hi - 1, mask=lo >= hi)], ["pattern_id", "lo", "hi"])

    return patterns.select("pattern_id").join(valid(patterns).mapInArrow(run, "pattern_id long, lo long, hi long"), "pattern_id", "left")


def same_in_reference(rows: DataFrame, ref: bytes, pos: Column, text: Column) -> DataFrame:
    """Adds ``same``: whether the reference sequence reads the text from the position on."""
    whole = rows.sparkSession.sparkContext.broadcast(ref)
    names = rows.columns
    schema = rows.select("*", F.lit(True).alias("same")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = whole.value
        for batch in batches:
            same = [p is not None and t is not None and p >= 0 and r.startswith(t.encode(), p) for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(same, pa.bool_())], [*names, "same"])

    return rows.select(pos.cast("long").alias("_p"), text.alias("_t"), "*").mapInArrow(run, schema)


def display(parsed: DataFrame, ref: bytes, requests: DataFrame) -> DataFrame:
    """req_id, text of the windows (req_id, seq_id, start, end), end exclusive.

    A window that is empty or turned round is empty text; one outside its sequence, or of an unknown sequence, is null.
    The requests of a sequence meet it as lists of at most about ``REQUESTS_A_ROW``, so its factors are sent once for each list.
    """
    whole = requests.sparkSession.sparkContext.broadcast(ref)
    requests = requests.select("req_id", "seq_id", "start", "end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = whole.value
        for batch in batches:
            (all_pos, counts), (all_size, _) = (keys.lists_of(batch.column(c)) for c in (1, 2))
            for asked, n, stop in zip(batch.column(0).to_pylist(), counts.tolist(), np.cumsum(counts).tolist(), strict=True):
                pos, size = all_pos[stop - n : stop], all_size[stop - n : stop]
                starts, total = np.cumsum(size) - size, int(size.sum())
                text = ["" if q["a"] >= q["b"] else None if q["a"] < 0 or q["b"] > total else kernels.window(r, pos, size, starts, q["a"], q["b"]).decode() for q in asked]
                yield pa.RecordBatch.from_arrays([pa.array([q["req_id"] for q in asked], pa.int64()), pa.array(text, pa.string())], ["req_id", "text"])

    targets = requests.where("seq_id <> 0")
    few = targets.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    many = targets.groupBy("seq_id").agg(F.ceil(F.count("*") / REQUESTS_A_ROW).alias("lists"))
    listed = targets.join(F.broadcast(many) if few else many, "seq_id").withColumn("list", F.pmod(F.xxhash64("req_id", "start", "end"), F.col("lists")))
    listed = listed.groupBy("seq_id", "list").agg(F.collect_list(F.struct("req_id", F.col("start").alias("a"), F.col("end").alias("b"))).alias("asked")).select("seq_id", "asked")
    met = parsed.select("seq_id", "pos", "size").join(F.broadcast(listed) if few else listed, "seq_id")
    found = met.select("asked", "pos", "size").mapInArrow(run, "req_id long, text string")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = whole.value
        for batch in batches:
            out = ["" if a >= b else None if a < 0 or b > len(r) else r[a:b].decode() for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["req_id", "text"])

    own = requests.where("seq_id = 0").select("req_id", "start", "end").mapInArrow(cut, "req_id long, text string")
    return requests.select("req_id").join(found.unionByName(own), "req_id", "left")
