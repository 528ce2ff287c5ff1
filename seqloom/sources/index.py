"""A saved index: the reference sequence, parsed sequences, their catalog, the suffix array and the keys of the factors.

The keys lie in three tables, in runs that were sorted by the tasks that wrote them. A search reads the row groups that meet the ranges of keys
that its patterns have, and of the factors only those of sequences with a candidate are read. Where ranges are many or wide it goes over the factors instead.

The suffix array lies in a folder named after the digest of the reference sequence, so it is never used with
another one; a loaded index searches with it and does not build it again. A display-only index has no suffix array; searching one fails with a clear message.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import factors, search
from seqloom.operators import keys as factors_keys
from seqloom.scratch import qualified
from seqloom.sources import reference
from seqloom.sources.sequences import Collection


@dataclass
class Index:
    ref: bytes
    parsed: DataFrame
    catalog: DataFrame
    suffixes: str | None
    folder: str
    keys: search.Keys | None = None

    def display(self, requests: DataFrame) -> DataFrame:
        return search.display(self.parsed, self.ref, requests)

    def _search(self) -> None:
        if self.suffixes is None:
            raise ValueError("this index is for display only; build it without display_only to search")

    def count(self, patterns: DataFrame, mode: str = "complete") -> DataFrame:
        self._search()
        return search.count(self.parsed, self.ref, patterns, mode, self.keys)

    def locate(self, patterns: DataFrame, mode: str = "complete") -> DataFrame:
        self._search()
        return search.locate(self.parsed, self.ref, patterns, mode, self.keys)

    def factors(self) -> DataFrame:
        return factors.numbered(self.parsed, len(self.ref))

    def sizes(self) -> DataFrame:
        return size_report(self.parsed.sparkSession, self.folder)


def size_report(spark: SparkSession, folder: str) -> DataFrame:
    """component, files, bytes of a saved index, from the list of its files; none is read."""
    base = F.length(F.lit(qualified(spark, folder).rstrip("/"))) + 2
    path = F.substring(F.regexp_replace("path", "^file:/+", "file:///"), base, F.lit(1 << 20))
    part = F.split(path, "/")
    component = F.when(part[0] == "keys", F.concat_ws("/", part[0], part[1])).when(part[0].startswith("suffixes-"), F.regexp_replace(part[1], r"(-[0-9]+)?\.npy$", "")).otherwise(part[0])
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(component.alias("component"), "length")
    return rows.groupBy("component").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


#: Rows of keys that are sorted together, those of a file, and bytes of a row group of them.
RUN, KEY_ROWS, KEY_BYTES = 1 << 20, 1 << 22, 1 << 20
#: The tables of keys and the column that each is sorted by.
SORTED = {"by_right": "right", "by_left": "left", "inside": "key"}


def write_keys(parsed: DataFrame, ref: bytes, folder: str, rows: int = KEY_ROWS, group_bytes: int = KEY_BYTES) -> None:
    """The keys of parsed factors in files of at most ``rows``, with the least and greatest key of each. A task writes the keys of the factors that it reads in runs of
    at most ``RUN`` rows that were sorted together, so no row is shuffled or spilled; as runs are much longer than row groups, a search reads few groups of each."""
    narrow = parsed.select("seq_id", "pos", "size", "start")
    for name, column in SORTED.items():
        dealt = factors_keys.inside(narrow, ref, ordered=RUN) if name == "inside" else factors_keys.borders(narrow, ref, by=column, each=RUN)
        dealt.write.mode("overwrite").option("maxRecordsPerFile", rows).option("parquet.block.size", group_bytes).option("parquet.page.size", group_bytes // 4).option("parquet.writer.version", "v2").option("compression", "zstd").parquet(f"{folder}/{name}")
    spans = [_table(parsed.sparkSession, folder, name).groupBy(F.input_file_name().alias("file")).agg(F.min(c).alias("low"), F.max(c).alias("high"), F.count("*").alias("count")).select(F.lit(name).alias("name"), F.element_at(F.split("file", "/"), -1).alias("file"), "low", "high", "count") for name, c in SORTED.items()]
    spans[0].unionByName(spans[1]).unionByName(spans[2]).coalesce(1).write.mode("overwrite").parquet(f"{folder}/buckets")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    schema = factors_keys.INSIDE if name == "inside" else factors_keys.BORDERS
    return spark.read.schema(schema).parquet(f"{folder}/{name}")


def load_keys(spark: SparkSession, folder: str) -> search.Keys:
    """Saved keys; of their rows only the files' spans are read, one row a file."""
    spans = spark.read.parquet(f"{folder}/buckets").toArrow()
    tables = {}
    for name, column in SORTED.items():
        own = spans.filter(pc.equal(spans["name"], name))
        tables[name] = search.Table(_table(spark, folder, name), column, own["count"].to_numpy())
    return search.Keys(**tables)


def write(c: Collection, folder: str, display_only: bool = False) -> None:
    spark = c.spark
    key = reference.digest(c.ref)
    if not display_only:
        reference.save(spark, c.ref, place := qualified(spark, f"{folder}/suffixes-{key[:16]}"))
        reference.use(spark, c.ref, place)
    spark.createDataFrame([(key, c.ref.decode(), display_only)], "digest string, seq string, display_only boolean").coalesce(1).write.mode("overwrite").parquet(f"{folder}/reference")
    factors.parse(c).write.mode("overwrite").parquet(f"{folder}/parsed")
    if not display_only:
        write_keys(spark.read.parquet(f"{folder}/parsed"), c.ref, f"{folder}/keys")
    factors.catalog(spark.read.parquet(f"{folder}/parsed")).write.mode("overwrite").parquet(f"{folder}/catalog")


def load(spark: SparkSession, folder: str) -> Index:
    head = spark.read.parquet(f"{folder}/reference").first()
    ref = head["seq"].encode()
    suffixes = None if head["display_only"] else reference.use(spark, ref, f"{folder}/suffixes-{head['digest'][:16]}")
    saved = load_keys(spark, f"{folder}/keys") if suffixes else None
    return Index(ref, spark.read.parquet(f"{folder}/parsed"), spark.read.parquet(f"{folder}/catalog"), suffixes, folder, saved)
