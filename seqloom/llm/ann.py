"""Approximate nearest neighbours by additive quantisation.

A vector is written as its norm times a sum of ``STAGES`` codewords, each over all dimensions. Codebooks are fitted one
after another to what the ones before leave over (on a documented, bounded sample); encoding keeps the ``BEAM`` best
partial sums at every stage, so a codeword that looks second best now can win later. Norms are stored beside the codes.
Rows lie in cells: the greedy first codeword of their direction, or the first two in tables of more than ``WORDS`` blocks.
A cell of more rows than a block holds has blocks of its own, which its rows share by a hash of the id; smaller cells
share a block with others near them. So blocks hold about ``BLOCK`` rows at most, whatever the data. A query probes the
cells with the largest inner product of query and centre times the mean norm in the cell. How many it probes is
measured: ``PROBED`` of the queries, if they are known, or else of the sample are searched exactly, in one pass over all rows, and as
many cells are probed as hold ``REACHED`` of their nearest rows.

In a probed block a query is scored against all codes through one table of inner products of the query with all codewords;
the best ``SHORTLIST`` are reranked exactly, in double precision, on the original vectors, and so is every other entry that
could still be among the nearest: how far codes are off for a query is measured on ``MEASURED`` entries of the block, and
an entry counts as long as ``SPREAD`` such deviations would lift it to the last one found. So vectors that the codes describe
badly, as those of many dimensions, cost more exact scores, not neighbours. A task holds one block and at most ``CHUNK`` queries at a time. Equal vectors of a block are one entry of the index with a list of their ids, so a
vector that fills a third of a table costs one entry a block, and ties come out by id.

Vectors that are null, empty or zero, that hold null or non-finite components, or that are not as long as most, take
no part, nor do rows with a null id. Vectors of doubles stay doubles where they are scored exactly. Of rows that share
an id the one with the smallest vector counts; a row is no neighbour of itself. With fewer candidates than asked for,
all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import materialize, maybe_broadcast, release, single_threaded

STAGES = 12
WORDS = 256
BEAM = 4
SAMPLE = 8192
BLOCK = 4096
CHUNK = 512
SHORTLIST = 128
MEASURED, SPREAD = 256, 3.0
PROBED = 128
REACHED = 0.97
NEAREST = 20
#: Queries with a copy for each probed block that a task holds before it sends them on.
ROUTED = 1 << 16
TILE = 256
HASHES = 1 << 30
#: Pairs of a query and an entry that are scored exactly at a time.
PAIRS = 1 << 15


@dataclass
class Codebooks:
    words: np.ndarray  # stages x words x dimensions, of unit vectors and their residuals

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows x stages) of unit vectors, by beam search, and the norms of the sums they stand for."""
        stages, size, dim = self.words.shape
        codes = np.zeros((len(x), stages), np.uint8)
        norms = np.ones(len(x), np.float32)
        step = max(1, (1 << 18) // (beam * size))
        for a in range(0, len(x), step):
            rest = x[a : a + step, None, :]  # rows x beams x dimensions
            path = np.zeros((len(rest), 1, 0), np.uint8)
            for words in self.words:
                cost = rest.reshape(-1, dim) @ (-2 * words.T)
                cost += (words**2).sum(1)
                cost += (rest**2).sum(2).reshape(-1, 1)
                flat = cost.reshape(len(rest), -1)
                best = np.empty((len(rest), min(beam, flat.shape[1])), np.int64)
                for j in range(best.shape[1]):  # a few passes for the least are faster than a partition
                    best[:, j] = flat.argmin(1)
                    flat[np.arange(len(rest)), best[:, j]] = np.inf
                row = np.arange(len(rest))[:, None]
                beams, word = best // size, best % size
                rest = rest[row, beams] - words[word]
                path = np.concatenate([path[row, beams], word[..., None].astype(np.uint8)], 2)
            win = (rest**2).sum(2).argmin(1)
            row = np.arange(len(rest))
            codes[a : a + step] = path[row, win]
            norms[a : a + step] = np.linalg.norm(x[a : a + step] - rest[row, win], axis=1)
        return codes, norms


def nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The nearest codeword of each vector."""
    cost = x @ (-2 * words.T)
    cost += (words**2).sum(1)
    return cost.argmin(1)


def fit(x: np.ndarray, stages: int = STAGES, size: int = WORDS, rounds: int = 12, seed: int = 5) -> Codebooks:
    """Residual k-means on unit vectors; with fewer vectors than codewords, the vectors themselves and zeros."""
    rng, rest, out = np.random.default_rng(seed), x.astype(np.float32), []
    for _ in range(stages):
        words = np.zeros((size, x.shape[1]), np.float32)
        start = rng.permutation(len(rest))[:size]
        words[: len(start)] = rest[start]
        for _ in range(rounds):
            near = nearest(rest, words)
            n = np.bincount(near, minlength=size)
            met = np.flatnonzero(n)
            words[met] = np.add.reduceat(rest[near.argsort(kind="stable")], (np.cumsum(n) - n)[met]) / n[met, None]
        rest = rest - words[nearest(rest, words)]
        out.append(words)
    return Codebooks(np.array(out))


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): finite, non-null, nonzero vectors, as arrays of floats, or of doubles if they are not given as floats."""
    v = F.col("v")
    kind = "array<float>" if rows.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    fine = F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(kind).alias("v")).where(F.col("vec_id").isNotNull()).where(fine)


def once(good: DataFrame) -> DataFrame:
    """One row an id, the one with the least vector; only ids are shuffled, unless some repeat."""
    again = materialize(good.groupBy("vec_id").count().where("count > 1").select("vec_id"), "ann-again")
    if again.isEmpty():
        release(again)
        return good
    again = maybe_broadcast(again)
    return good.join(again, "vec_id", "left_anti").unionByName(good.join(again, "vec_id").groupBy("vec_id").agg(F.min("v").alias("v")))


def as_matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions in single precision, and norms; a part of the largest component keeps squares within range."""
    x = x.astype(np.float64)
    most = np.abs(x).max(1, keepdims=True)
    x = x / most
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / size).astype(np.float32), (size * most)[:, 0]


def entries(ids: np.ndarray, vecs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids by entry and rising, the different vectors, and where each entry's ids start."""
    if len(np.unique(ids)) < len(ids):
        order = np.lexsort((*vecs.T[::-1], ids))
        ids, vecs = ids[order], vecs[order]
        first = np.concatenate(([True], ids[1:] != ids[:-1]))
        ids, vecs = ids[first], vecs[first]
    _, first, member = np.unique(np.ascontiguousarray(vecs).view(np.dtype((np.void, vecs.itemsize * vecs.shape[1]))).ravel(), return_index=True, return_inverse=True)
    order = np.lexsort((ids, member.ravel()))
    return ids[order], vecs[first], np.searchsorted(member.ravel()[order], np.arange(len(first) + 1)).astype(np.int64)


@dataclass
class Cells:
    """Cells by number: where their blocks start, how many they have, and the mean norm of their rows (0 without rows)."""

    words: np.ndarray  # 1 or 2 x words x dimensions: the first codebooks
    first: np.ndarray
    parts: np.ndarray
    size: np.ndarray
    probes: int = 1

    def of(self, x: np.ndarray) -> np.ndarray:
        """The cell of each direction."""
        cell = np.zeros(len(x), np.int64)
        for words in self.words:
            near = nearest(x, words)
            x = x - words[near]
            cell = cell * len(words) + near
        return cell

    def block(self, cell: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Where a row is kept, by its cell and id."""
        mixed = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return self.first[cell] + ((mixed >> np.uint64(33)) % self.parts[cell].astype(np.uint64)).astype(np.int64)

    def order(self, x: np.ndarray, most: int | None = None) -> np.ndarray:
        """For each query the cells that hold rows, or the nearest of them, nearest first."""
        used = np.flatnonzero(self.size)
        size = self.words.shape[1]
        centre = self.words[0][used] if len(self.words) == 1 else self.words[0][used // size] + self.words[1][used % size]
        near = -unit(x)[0] @ (centre * (self.size[used, None] / self.size.max())).astype(np.float32).T
        if most and most < len(used):
            part = np.argpartition(near, most - 1, 1)[:, :most]
            return used[np.take_along_axis(part, np.take_along_axis(near, part, 1).argsort(1, kind="stable"), 1)]
        return used[near.argsort(1, kind="stable")]


def chain(words: np.ndarray) -> np.ndarray:
    """The place of each codeword in a walk from each to the nearest one left."""
    place, left, at = np.zeros(len(words), np.int64), np.ones(len(words), bool), 0
    for step in range(len(words)):
        place[at], left[at] = step, False
        at = int(np.where(left, ((words - words[at]) ** 2).sum(1), np.inf).argmin())
    return place


def deal(counts: list[tuple[int, int, float]], words: np.ndarray, block: int) -> tuple[Cells, int]:
    """Blocks for cells of (number, rows, sum of norms), and how many there are."""
    size = words.shape[1]
    n = size ** len(words)
    cells = Cells(words, np.zeros(n, np.int64), np.ones(n, np.int64), np.zeros(n))
    place, under = chain(words[0]), n // size
    blocks, open_at, room = 0, -1, 0
    for c, rows, norms in sorted(counts, key=lambda x: (place[x[0] // under], x[0])):
        cells.size[c] = norms / rows
        if rows > block:
            cells.first[c], cells.parts[c] = blocks, -(-rows // block)
            blocks += int(cells.parts[c])
            continue
        if rows > room:
            open_at, room, blocks = blocks, block, blocks + 1
        cells.first[c], room = open_at, room - rows
    return cells, blocks


PACKED = ("ids", "starts", "vecs", "codes", "norms")


@dataclass
class Index:
    """Packed blocks (their ids, where the ids of each vector start, vectors, codes, norms), cells, codebooks and dimension."""

    blocks: DataFrame
    count: int
    books: Codebooks | None
    cells: Cells | None
    dim: int
    single: bool = True  # vectors are kept in single precision


def survey(good: DataFrame, cells: Cells, probe_ids: np.ndarray, probe: np.ndarray, dim: int, k: int) -> tuple[list[tuple[int, int, float]], np.ndarray]:
    """(cell, rows, sum of norms) of every cell with rows, and (probe, cell) of the exact k nearest rows of each probe."""
    shared = good.sparkSession.sparkContext.broadcast((cells, probe_ids, probe.astype(np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single_threaded()
        cells, own, probe = shared.value
        rows, norms = np.zeros(len(cells.first), np.int64), np.zeros(len(cells.first))
        best = np.full((len(own), k), -np.inf), np.full((len(own), k), -1, np.int64), np.zeros((len(own), k), np.int64)
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), as_matrix(batch.column(1), dim)
            way, size = unit(x)
            cell = cells.of(way)
            np.add.at(rows, cell, 1)
            np.add.at(norms, cell, size)
            score = np.where(ids[None] == own[:, None], -np.inf, probe @ x.T.astype(np.float64))
            all_of = [np.concatenate([kept, np.broadcast_to(new, score.shape)], 1) for kept, new in zip(best, (score, ids[None], cell[None]), strict=True)]
            top = np.argsort(-all_of[0], 1, kind="stable")[:, :k]
            best = tuple(np.take_along_axis(a, top, 1) for a in all_of)
        used = np.flatnonzero(rows)
        yield pa.RecordBatch.from_pydict({"probe": pa.nulls(len(used), pa.int32()), "cell": used, "n": rows[used], "value": norms[used]})
        found = np.isfinite(best[0])
        yield pa.RecordBatch.from_pydict({"probe": pa.array(np.nonzero(found)[0], pa.int32()), "cell": best[2][found], "n": best[1][found], "value": best[0][found]})

    seen = materialize(good.mapInArrow(run, "probe int, cell long, n long, value double"), "ann-survey")
    counts = [tuple(r) for r in seen.where("probe is null").groupBy("cell").agg(F.sum("n"), F.sum("value")).collect()]
    nearest = Window.partitionBy("probe").orderBy(F.desc("value"), "n")
    hits = seen.where("probe is not null").withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= k).select("probe", "cell").collect()
    release(seen)
    return counts, np.array(hits, np.int64).reshape(-1, 2)


def probes_for(cells: Cells, probe: np.ndarray, hits: np.ndarray) -> int:
    """How many cells hold ``REACHED`` of the nearest rows of the probes; all if there is nothing to measure."""
    order = cells.order(probe) if len(probe) else np.zeros((0, 1), np.int64)
    if not len(hits):
        return int((cells.size > 0).sum())
    rank = np.sort([int(np.flatnonzero(order[p] == c)[0]) for p, c in hits.tolist()])
    return int(rank[min(len(rank) - 1, int(np.ceil(REACHED * len(rank))) - 1)]) + 1


def build(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, k: int = NEAREST, queries: DataFrame | None = None) -> Index:
    """Fit on at most ``SAMPLE`` rows picked by a hash of the id; encode every row. ``queries``: rows of which some are searched exactly to measure how much must be probed."""
    single_threaded()
    good = usable(rows, id_col, vec_col)
    sizes = good.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim, n = (sizes[0][0], sizes[0][1]) if sizes else (0, 0)
    if not n:
        return Index(good.select(F.lit(0).alias("block")).limit(0), 0, None, None, 0)
    good = once(good.where(F.size("v") == dim))
    sample = good.where(F.pmod(F.xxhash64("vec_id"), F.lit(HASHES)) < int(min(1.0, SAMPLE * 1.1 / n) * HASHES)).limit(2 * SAMPLE)
    held = sample.orderBy("vec_id").toArrow().combine_chunks()
    if held.num_rows:
        sample_ids, x = held["vec_id"].to_numpy(), as_matrix(held["v"].combine_chunks(), dim)
        books = fit(unit(x)[0])
    else:
        sample_ids, x, books = np.zeros(0, np.int64), np.zeros((0, dim)), Codebooks(np.zeros((STAGES, WORDS, dim), np.float32))
    picked = np.random.default_rng(9).permutation(len(x))[:PROBED]
    probe_ids, probe = sample_ids[picked], x[picked]
    if queries is not None:
        asked = usable(queries, id_col, vec_col).where(F.size("v") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(PROBED).toArrow().combine_chunks()
        if asked.num_rows:
            probe_ids, probe = asked["vec_id"].to_numpy(), as_matrix(asked["v"].combine_chunks(), dim)
    cells, _ = deal([], books.words[: 1 if n <= WORDS * block else 2], block)
    counts, hits = survey(good, cells, probe_ids, probe, dim, k)
    cells, count = deal(counts, cells.words, block)
    cells.probes = probes_for(cells, probe, hits)
    shared = rows.sparkSession.sparkContext.broadcast((books, cells))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single_threaded()
        cells = shared.value[1]
        for batch in batches:
            cell = cells.of(unit(as_matrix(batch.column(1), dim))[0])
            yield pa.RecordBatch.from_arrays([pa.array(cells.block(cell, batch.column(0).to_numpy()), pa.int32()), *batch.columns], ["block", "vec_id", "v"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single_threaded()
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            number = batch.column(0).to_numpy()
            order = np.argsort(number, kind="stable")
            ids, vecs = batch.column(1).to_numpy()[order], as_matrix(batch.column(2), dim)[order]
            at, first = np.unique(number[order], return_index=True)
            for b, lo, hi in zip(at.tolist(), first, np.append(first[1:], len(number)), strict=True):
                held.setdefault(b, []).append((ids[lo:hi], vecs[lo:hi]))
        for b, parts in held.items():
            ids, vecs, starts = entries(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            way, size = unit(vecs)
            codes, norms = shared.value[0].encode(way)
            # only the order within a block counts, so norms are parts of its largest
            norms = (size / size.max() / np.maximum(norms, 1e-6)).astype(np.float32)
            yield pa.RecordBatch.from_pydict({"block": [b]} | {n: [x.tobytes()] for n, x in zip(PACKED, (ids, starts, vecs, codes, norms), strict=True)}, schema=pa.schema([("block", pa.int32())] + [(n, pa.binary()) for n in PACKED]))

    kind = good.schema["v"].dataType.simpleString()
    dealt = good.select("vec_id", "v").mapInArrow(place, f"block int, vec_id long, v {kind}").repartition(count, "block")
    packed = dealt.mapInArrow(pack, "block int, " + ", ".join(f"{n} binary" for n in PACKED))
    return Index(materialize(packed, "ann-index"), count, books, cells, dim, kind == "array<float>")


def with_likely(ways: np.ndarray, sizes: np.ndarray, q: np.ndarray, vecs: np.ndarray, near: np.ndarray, listed: np.ndarray, exact: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The listed entries of each query, and their exact scores, with those beside them that may be as near as the last of k + 1; -inf beyond a query's last one."""
    way, size = unit(vecs)
    part, scale = (size / size.max()).astype(np.float32), sizes * size.max()
    some = np.random.default_rng(len(vecs)).permutation(len(vecs))[:MEASURED]
    off = (ways @ way[some].T) - near[:, some] / np.maximum(part[some], np.finfo(np.float32).tiny)
    spread = SPREAD * np.sqrt(np.mean(off**2, 1))
    last = -np.partition(-exact, min(k, exact.shape[1] - 1), 1)[:, min(k, exact.shape[1] - 1)] / scale
    may = near + spread[:, None] * part >= last[:, None]
    np.put_along_axis(may, listed, False, 1)
    of, entry = np.nonzero(may)
    if not len(of):
        return listed, exact
    score = np.empty(len(of))
    for a in range(0, len(of), PAIRS):
        o, e = of[a : a + PAIRS], entry[a : a + PAIRS]
        score[a : a + PAIRS] = np.einsum("pd,pd->p", vecs[e].astype(np.float64), q[o].astype(np.float64))
    counts = np.bincount(of, minlength=len(q))
    at = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    more, scores = np.zeros((len(q), counts.max()), np.int64), np.full((len(q), counts.max()), -np.inf)
    more[of, at], scores[of, at] = entry, score
    return np.concatenate([listed, more], 1), np.concatenate([exact, scores], 1)


def search_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, starts: np.ndarray, vecs: np.ndarray, codes: np.ndarray, norms: np.ndarray, words: np.ndarray, k: int, shortlist: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, ids of their k nearest in the block, and exact scores."""
    ways, sizes = unit(q)
    table = np.einsum("swd,qd->swq", words, ways, optimize=True)
    near = np.zeros((len(vecs), len(q)), np.float32)
    for a in range(0, len(vecs), TILE):
        tile = near[a : a + TILE]
        for s in range(len(words)):
            tile += table[s].take(codes[a : a + TILE, s], 0)
    near *= norms[:, None]
    near = np.ascontiguousarray(near.T)
    take = min(shortlist, len(vecs))
    listed = np.argpartition(-near, take - 1, 1)[:, :take]
    exact = np.empty(listed.shape)
    for a in range(0, len(q), 64):
        exact[a : a + 64] = np.einsum("qld,qd->ql", vecs[listed[a : a + 64]].astype(np.float64), q[a : a + 64].astype(np.float64))
    if take < len(vecs):
        listed, exact = with_likely(ways, sizes, q, vecs, near, listed, exact, k)
    # an entry behind k + 1 others, by score and least id, has no id among the k nearest
    best = np.lexsort((ids[starts[listed]], -exact), axis=1)[:, : k + 1]
    entry, score = np.take_along_axis(listed, best, 1).ravel(), np.take_along_axis(exact, best, 1).ravel()
    size = np.where(score > -np.inf, np.minimum(starts[entry + 1] - starts[entry], k + 1), 0)
    of = np.repeat(np.arange(len(entry)), size)
    found = ids[starts[entry][of] + np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)]
    row, score = of // best.shape[1], score[of]
    other = found != q_ids[row]
    row, found, score = row[other], found[other], score[other]
    order = np.lexsort((found, -score, row))
    row, found, score = row[order], found[order], score[order]
    top = np.arange(len(row)) - np.searchsorted(row, row) < k
    return q_ids[row[top]], found[top], score[top]


def search(index: Index, queries: DataFrame, k: int = NEAREST, id_col: str = "vec_id", vec_col: str = "embedding", shortlist: int = SHORTLIST) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found for each query row, by inner product."""
    spark = queries.sparkSession
    empty = "query_id long, rank int, vec_id long, score double"
    if not index.count:
        return spark.createDataFrame([], empty)
    shared, dim = spark.sparkContext.broadcast((index.books, index.cells)), index.dim
    good = usable(queries, id_col, vec_col).where(F.size("v") == dim).groupBy("vec_id").agg(F.min("v").alias("v"))
    real = np.float32 if good.schema["v"].dataType.simpleString() == "array<float>" else np.float64

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single_threaded()
        cells = shared.value[1]
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        count = 0
        for batch in batches:
            ids, vecs = batch.column(0).to_numpy(), as_matrix(batch.column(1), dim)
            for a in range(0, len(ids), 128):
                x = vecs[a : a + 128]
                # a cell holds a row at least, so so many cells hold k others
                cell = cells.order(x, max(cells.probes, k + 1))
                row = np.repeat(np.arange(len(x)), cell.shape[1])
                parts = cells.parts[cell.ravel()]
                block = np.repeat(cells.first[cell.ravel()], parts) + np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                pairs = np.unique(block * len(x) + np.repeat(row, parts))
                block, row = pairs // len(x), pairs % len(x)
                at, first = np.unique(block, return_index=True)
                for b, lo, hi in zip(at.tolist(), first, np.append(first[1:], len(block)), strict=True):
                    held.setdefault(b, []).append((ids[a + row[lo:hi]], x[row[lo:hi]]))
                count += len(pairs)
                if count > ROUTED:
                    yield from sent(held)
                    held, count = {}, 0
        yield from sent(held)

    def sent(held: dict[int, list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        for b, parts in held.items():
            ids, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(real)
            cuts = range(0, len(ids), CHUNK)
            yield pa.RecordBatch.from_pydict({"block": pa.array([b] * len(cuts), pa.int32()), "q_ids": [ids[a : a + CHUNK].tobytes() for a in cuts], "q": [x[a : a + CHUNK].tobytes() for a in cuts]})

    stored = np.float32 if index.single else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single_threaded()
        words = shared.value[0].words
        kinds = {"q_ids": np.int64, "q": real, "ids": np.int64, "starts": np.int64, "vecs": stored, "codes": np.uint8, "norms": np.float32}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: np.frombuffer(batch.column(n)[i].as_buffer(), kind) for n, kind in kinds.items()}
                row |= {"q": row["q"].reshape(-1, dim), "vecs": row["vecs"].reshape(-1, dim), "codes": row["codes"].reshape(-1, len(words))}
                out = search_block(**row, words=words, k=k, shortlist=shortlist)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["query_id", "vec_id", "score"])

    # queries meet the blocks of the cells that they probe; a block and a chunk of queries are all that a call holds
    found = good.mapInArrow(route, "block int, q_ids binary, q binary").join(index.blocks, "block").select(*("q_ids", "q", *PACKED)).mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def is_query(id_col: str = "vec_id") -> Column:
    """The stated query set: every row whose id is divisible by 20."""
    return F.col(id_col) % 20 == 0
