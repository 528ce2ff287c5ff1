"""Merkle manifest of a table: a tree for each group of rows, and one over the groups' roots; proofs by lookup of coordinates.

A row's leaf is the digest of its fields, each as its UTF-8 byte count, a colon and its value, or ``-`` for null. In a group
the leaves stand by key and then digest, null keys first. While a level has more than one node, each run of ``FAN`` nodes
(the last one may be shorter, even of one) becomes their digest on the next level. What remains is the group's root, a lone
leaf itself. The groups' roots, by group name (null first, then by bytes), make the upper tree in the same way.

A node's coordinates are its tree, level and place. Leaves get their places from ranges of about ``running.ROWS`` rows
and the counts of the ranges before, so no group is sorted in one task. A level is an aggregate over runs of the one below, and is written before
the next. From its place and the size of its group a leaf knows the coordinates of all siblings of its path; they are exploded and
looked up in the table of nodes. Upper levels that hold at most ``BROADCAST_NODES`` nodes in all are broadcast, so what is asked by very many leaves
makes no hot key; a node of the lower levels is asked by the leaves of one run of its level only. In the upper tree
every leaf of a group asks the same nodes; where that tree is too large to be broadcast they are copied over ``SALTS``. The siblings of
a leaf, in order, are its proof, and folding them around the leaf gives the root.

Rows that repeat are leaves of their own; equal ones stand side by side. Null texts and keys are fields like any other. Columns that are no
fields are not read, whatever their names. An empty table has no nodes, no root (null) and no proofs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import materialize, small_enough
from seqloom.operators.running import ROWS

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes that are broadcast, of all levels together.
BROADCAST_NODES = 1 << 16
#: Levels of the groups' trees that are looked up by a shuffle at every size of the table.
SHUFFLED = 2
SALTS = 64
#: The number of the upper tree; the groups' trees are numbered from 0.
UPPER = -1
UPPER_STEP = 100


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: list[Column]) -> Column:
    """The digest of a row's fields."""
    return digest_of(F.concat(*map(field, fields)))


def placed(rows: DataFrame, by: str, order: list[str], every: int = ROWS) -> DataFrame:
    """Adds ``idx``, the place among the rows of equal ``by`` (no nulls) in the order, and ``size``, their number."""
    ranges = max(1, -(-rows.count() // every))
    tagged = materialize(rows.repartitionByRange(ranges, by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = tagged.groupBy("_range", by).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_range", by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(Window.partitionBy(by)).alias("size"))
    bases = F.broadcast(bases) if small_enough(bases, BROADCAST_NODES) else bases
    inner = Window.partitionBy("_range", by).orderBy(*order)
    return tagged.join(bases, ["_range", by]).select(*rows.columns, (F.col("_base") + F.row_number().over(inner) - 1).alias("idx"), "size")


def levels(leaves: DataFrame) -> Iterator[DataFrame]:
    """From (tree, idx, size, h): each level of the trees, (tree, level, idx, size, h), size being that of the level."""
    level, now = 0, leaves.withColumn("level", F.lit(0))
    while True:
        now = materialize(now.select("tree", "level", "idx", "size", "h"), f"nodes-{level}")
        yield now
        if not now.where("size > 1").limit(1).count():
            return
        level += 1
        runs = now.where("size > 1").groupBy("tree", "size", F.floor(F.col("idx") / FAN).alias("run")).agg(F.sort_array(F.collect_list(F.struct("idx", "h"))).alias("below"))
        now = runs.select("tree", F.lit(level).alias("level"), F.col("run").alias("idx"), F.ceil(F.col("size") / FAN).alias("size"), digest_of(F.array_join(F.transform("below", lambda x: hexed(x["h"])), "")).alias("h"))


@dataclass
class Manifest:
    """Leaves (the given columns, h, tree, idx, size), the nodes of all levels by (is upper, level), the number of trees, and the root."""

    leaves: DataFrame
    nodes: dict[tuple[bool, int], DataFrame]
    trees: int
    root: str | None


def build(rows: DataFrame, group: str, key: str, every: int = ROWS) -> Manifest:
    """The manifest of rows with a digest ``h``, a group and a key; other columns stay with the leaves."""
    # null groups come first, as the empty name
    rows = materialize(rows.withColumn("_name", F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))), "rows")
    names = materialize(placed(rows.select("_name").distinct().withColumn("_all", F.lit(0)), "_all", ["_name"], every).select("_name", F.col("idx").alias("tree")), "names")
    trees = names.count()
    few = F.broadcast(names) if trees <= BROADCAST_NODES else names
    leaves = materialize(placed(rows, "_name", [key, "h"], every).join(few, "_name").drop("_name"), "leaves")
    nodes = {(False, i): level for i, level in enumerate(levels(leaves.select("tree", "idx", "size", "h")))}
    roots = None
    for level in nodes.values():
        one = level.where("size = 1").select(F.lit(UPPER).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(trees).cast("long").alias("size"), "h")
        roots = one if roots is None else roots.unionByName(one)
    upper = list(levels(roots))
    nodes |= {(True, i): level for i, level in enumerate(upper)}
    top = upper[-1].select(hexed(F.col("h")).alias("h")).first()
    return Manifest(leaves, nodes, trees, top["h"] if top else None)


def height(size: Column) -> Column:
    """Levels above the leaves of a tree of so many."""
    return F.size(F.filter(F.array(*[F.lit(FAN**k) for k in range(21)]), lambda p: p < size))


def path(tree: Column, idx: Column, size: Column, first: int) -> Column:
    """The siblings on the way from a leaf to its root: (order, t, level, at), in order, counted from step ``first`` on."""
    powers = F.slice(F.array(*[F.lit(FAN**k) for k in range(21)]), F.lit(1), height(size))

    def of_level(p: Column, k: Column) -> Column:
        own = F.floor(idx / p)
        start = own - own % FAN
        stop = F.least(start + FAN, F.ceil(size / p)) - 1
        others = F.filter(F.sequence(start, stop), lambda x: x != own)
        return F.transform(others, lambda x: F.struct(((k + first) * FAN + (x - start).cast("int")).alias("order"), tree.alias("t"), k.alias("level"), x.alias("at")))

    return F.flatten(F.transform(powers, of_level))


def proofs(m: Manifest) -> DataFrame:
    """The leaves with ``subroot`` and ``proof``, the siblings' digests as text, in order."""
    tree, idx, size = F.col("tree"), F.col("idx"), F.col("size")
    own = F.array(F.struct(F.lit(-1).alias("order"), tree.alias("t"), height(size).alias("level"), F.lit(0).cast("long").alias("at")))
    whole = F.concat(own, path(tree, idx, size, 0), path(F.lit(UPPER).cast("long"), tree, F.lit(m.trees).cast("long"), UPPER_STEP))
    leaves = m.leaves.repartition("tree", "idx")
    asked = leaves.select("tree", "idx", F.explode(whole).alias("c")).select("tree", "idx", "c.order", "c.t", "c.level", "c.at")
    held, sent, shuffled = 0, [], [k for k in m.nodes if not k[0] and k[1] < SHUFFLED]
    for level, n in sorted(((k, t.count()) for k, t in m.nodes.items() if k not in shuffled), key=lambda x: x[1]):
        held += n
        (sent if held <= BROADCAST_NODES else shuffled).append(level)

    def nodes_of(keys: list[tuple[bool, int]]) -> DataFrame:
        out = None
        for k in keys:
            one = m.nodes[k].select(F.col("tree").alias("t"), "level", F.col("idx").alias("at"), "h")
            out = one if out is None else out.unionByName(one)
        return out

    def gathered(rows: DataFrame) -> DataFrame:
        return rows.groupBy("tree", "idx").agg(F.collect_list(F.struct("order", "h")).alias("found"))

    parts = []
    if sent:
        # leaves stay where they are, so their lists are gathered there
        parts.append(gathered(asked.where(among(sent)).join(F.broadcast(nodes_of(sent)), ["t", "level", "at"])))
    if shuffled:
        upper = F.col("t") == UPPER
        salted = asked.where(among(shuffled)).withColumn("salt", F.when(upper, F.pmod(F.xxhash64("tree", "idx"), F.lit(SALTS))).otherwise(0).cast("int"))
        copied = nodes_of(shuffled).withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(upper, SALTS - 1).otherwise(0))))
        parts.append(gathered(salted.join(copied, ["t", "level", "at", "salt"])))
    out, lists = leaves.withColumn("found", F.array().cast("array<struct<order:int,h:binary>>")), F.col("found")
    for k, part in enumerate(parts):
        out = out.join(part.withColumnRenamed("found", f"found{k}"), ["tree", "idx"], "left")
        lists = F.concat(lists, F.coalesce(f"found{k}", "found"))
    out = out.withColumn("found", F.sort_array(lists)).drop(*(f"found{k}" for k in range(len(parts))))
    # the group's root stands before the siblings
    rest = F.slice("found", F.lit(2), F.greatest(F.size("found") - 1, F.lit(0)))
    return out.withColumn("subroot", hexed(F.col("found")[0]["h"])).withColumn("proof", F.array_join(F.transform(rest, lambda x: hexed(x["h"])), "")).drop("found")


def among(levels_: list[tuple[bool, int]]) -> Column:
    """Whether a coordinate (t, level) is of one of the levels."""
    upper = F.col("t") == UPPER
    return (upper & F.col("level").isin([k for u, k in levels_ if u])) | (~upper & F.col("level").isin([k for u, k in levels_ if not u]))


def fold(leaf_hex: str, places: list[tuple[int, int]], proof: str) -> str:
    """The root that follows from a leaf, its (place, size) in each tree from below, and its siblings' digests in order."""
    now, at = leaf_hex, 0
    for idx, size in places:
        while size > 1:
            own = idx % FAN
            others = min(FAN, size - (idx - own)) - 1
            left, right = proof[at : at + 64 * own], proof[at + 64 * own : at + 64 * others]
            now, at = hashlib.sha256((left + now + right).encode()).hexdigest(), at + 64 * others
            idx, size = idx // FAN, -(-size // FAN)
    return now


def folded(rows: DataFrame, trees: int) -> DataFrame:
    """Adds ``folded_root`` to (leaf_in: hexadecimal digest, tree, idx, size, proof, ...), and leaves these five out."""
    kept = [c for c in rows.columns if c not in ("leaf_in", "tree", "idx", "size", "proof")]
    schema = rows.select(*kept, F.lit("").alias("folded_root")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = (batch.column(k).to_pylist() for k in range(5))
            roots = [fold(h, [(i, n), (t, trees)], proof) for h, t, i, n, proof in zip(*cells, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[5:], pa.array(roots, pa.string())], [*kept, "folded_root"])

    return rows.select("leaf_in", "tree", "idx", "size", "proof", *kept).mapInArrow(run, schema)


UPPER_CASE, LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tampered(fields: list[Column]) -> list[Column]:
    """The fields of a row whose text (the last one) has its A-Z lowered."""
    return [*fields[:-1], F.translate(fields[-1], UPPER_CASE, LOWER_CASE)]


def verify(docs: DataFrame, suspect: Column, every: int = ROWS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof, folded_root, verified of every document; where ``suspect`` holds, the leaf is folded after tampering with the text."""
    own = [F.col(c) for c in FIELDS]
    rows = docs.select("doc_id", "lang", leaf(own).alias("h"), F.when(suspect, leaf(tampered(own))).alias("bad"))
    m = build(rows, "lang", "doc_id", every)
    found = proofs(m).select("tree", "idx", "size", "doc_id", hexed(F.col("h")).alias("leaf"), hexed(F.coalesce("bad", "h")).alias("leaf_in"), "subroot", F.lit(m.root).alias("root"), "proof", F.sha2("proof", 256).alias("proof_sha256"))
    return folded(found, m.trees).withColumn("verified", F.col("folded_root") == F.col("root"))
