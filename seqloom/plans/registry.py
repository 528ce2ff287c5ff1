"""Names of the queries, what runs them, and their DuckDB SQL.

All queries run over whole tables: the first ten documents by id are the reference sequence, every other one a target.
What follows from the greedy parse has no SQL that ends in reasonable time; those queries are tested by brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import symbols as S
from seqloom.operators import factors as O
from seqloom.operators import blocks, search, suffixes
from seqloom.operators.running import running_sums
from seqloom.scratch import bounded_batches, qualified, shared_path, spread, written
from seqloom.sources import factor_files, index, reference
from seqloom.sources.sequences import HEAD, Collection, from_documents
from seqloom.streaming import requests as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Patterns of a few symbols; pieces of the targets of the ``LENGTHS`` are added to them.
PATTERNS = ((0, "acgtgt"), (1, "nn"), (2, "gagag"), (3, "TCTGACG"), (4, "xa"), (5, "ctctctctc"))
LENGTHS, PIECES = (10, 23, 49, 82, 100), 50

#: The reference sequence and the targets of the documents table, for the SQL side.
WITH = f"""with docs as (select doc_id, regexp_replace(translate(coalesce(text, ''), '{S.LETTERS}', '{S.AS_BASES}'), '[^acgt]', 'n', 'g') as seq
  from documents where doc_id is not null),
head as (select doc_id, seq from docs order by doc_id limit {HEAD}),
ref as (select coalesce(string_agg(seq, 'n' order by doc_id), '') as ref from head),
targets as (select doc_id + 1 as seq_id, 'doc' || doc_id as name, seq, cast(length(seq) as bigint) as len from docs where doc_id not in (select doc_id from head)),
sequences as (select 0 as seq_id, 'reference' as name, ref as seq, cast(length(ref) as bigint) as len from ref union all select * from targets),
drawn as (select * from targets where len >= {max(LENGTHS)} order by (seq_id * 2654435761) % 4294967296, seq_id limit {PIECES}),
patterns(pattern_id, pattern) as (select * from (values {", ".join(f"({i}, '{p}')" for i, p in PATTERNS)})
  union all select 1000 + 8 * seq_id + k, substring(seq, (seq_id * 7919 + m * 104729) % (len - m + 1) + 1, m) from drawn, (values {", ".join(f"({k}, {m})" for k, m in enumerate(LENGTHS))}) as l(k, m)),
requests as (select 2 * seq_id + k as req_id, seq_id, (seq_id * 7919 + k * 104729) % (len + 1) as "start",
  least(len, (seq_id * 7919 + k * 104729) % (len + 1) + seq_id % 91) as "end" from sequences, (values (0), (1)) as t(k)) """


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[Collection], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            bounded_batches(spark)
            return f(from_documents(spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = WITH + sql
        return f

    return add


def drawn_patterns(c: Collection) -> DataFrame:
    """Pieces of the targets, for a workload: ``PIECES`` sequences by a hash of their number, a piece of each length from each."""
    sizes = c.sizes().where(F.col("len") >= max(LENGTHS))
    drawn = [r["seq_id"] for r in sizes.orderBy((F.col("seq_id") * 2654435761) % 4294967296, "seq_id").limit(PIECES).collect()]
    rows = c.targets.where(F.col("seq_id").isin(drawn)).select("seq_id", "seq", F.length("seq").cast("long").alias("len"), F.posexplode(F.array(*map(F.lit, LENGTHS))).alias("k", "m"))
    start = (F.col("seq_id") * 7919 + F.col("m") * 104729) % (F.col("len") - F.col("m") + 1)
    return rows.select((1000 + 8 * F.col("seq_id") + F.col("k")).alias("pattern_id"), F.substring("seq", (start + 1).cast("int"), F.col("m")).alias("pattern"))


def patterns(c: Collection) -> DataFrame:
    return written(c.spark.createDataFrame(list(PATTERNS), "pattern_id long, pattern string").unionByName(drawn_patterns(c)).repartition(1), "patterns")


def requests(c: Collection) -> DataFrame:
    """Two windows of each sequence, at places that follow from its number."""
    rows = c.sequences().select("seq_id", "len", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    start = (F.col("seq_id") * 7919 + F.col("k") * 104729) % (F.col("len") + 1)
    return rows.select((2 * F.col("seq_id") + F.col("k")).alias("req_id"), "seq_id", start.alias("start"), F.least("len", start + F.col("seq_id") % 91).alias("end"))


@query("select * from sequences")
def seq_sanitize(c):
    return c.sequences()


@query("select seq_id, len, " + ", ".join(f"cast(len - length(replace(seq, '{x}', '')) as bigint) as n_{x}" for x in S.ALPHABET) + " from sequences")
def seq_stats(c):
    return c.sequences().select("seq_id", "len", *[(F.col("len") - F.length(F.replace("seq", F.lit(x), F.lit("")))).cast("long").alias(f"n_{x}") for x in S.ALPHABET])


def seq_validate(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    rows = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", S.is_valid(text).alias("valid"), S.first_invalid(text).alias("first_invalid"), F.regexp_count(text, F.lit("[^acgntACGNT]")).cast("long").alias("n_invalid"))


QUERIES["seq_validate"] = seq_validate
ORACLE_SQL["seq_validate"] = """select doc_id, n_invalid = 0 as valid, case when n_invalid = 0 then -1 else cast(length(regexp_extract(t, '^[acgntACGNT]*')) as bigint) end as first_invalid, n_invalid
from (select doc_id, coalesce(text, '') as t, cast(length(regexp_replace(coalesce(text, ''), '[acgntACGNT]', '', 'g')) as bigint) as n_invalid from documents)"""


@query("select seq_id, len, cast(coalesce(sum(len) over (order by seq_id rows between unbounded preceding and 1 preceding), 0) as bigint) as abs_start from targets")
def seq_catalog(c):
    return running_sums(c.targets.select("seq_id", F.length("seq").cast("long").alias("len")), "seq_id", {"abs_start": "len"})


@query("""select seq_id, cast(min(i) as bigint) as start, cast(count(*) as bigint) as len from (select seq_id, i, i - row_number() over (partition by seq_id order by i) as g
from (select seq_id, unnest(range(len)) as i, seq from sequences) where substring(seq, i + 1, 1) = 'n') group by seq_id, g""")
def n_runs(c):
    runs = F.split("seq", "(?<=n)(?=[^n])|(?<=[^n])(?=n)")
    pieces = c.sequences().where("len > 0").select("seq_id", F.posexplode(F.transform(runs, lambda r: F.struct(F.substring(r, 1, 1).alias("c"), F.length(r).cast("long").alias("len")))).alias("no", "r"))
    from pyspark.sql import Window

    before = Window.partitionBy("seq_id").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.select("seq_id", F.coalesce(F.sum("r.len").over(before), F.lit(0)).cast("long").alias("start"), F.col("r.len").alias("len"), F.col("r.c").alias("c")).where("c = 'n'").drop("c")


@query("""select symbol, cast(instr('acgnt', symbol) as bigint) as code, cast(instr('acgt', symbol) - 1 as bigint) as two_bit, substring('acgnt', instr('acgnt', symbol), 1) as back, cast(n as bigint) as n
from (select symbol, sum(len - length(replace(seq, symbol, ''))) as n from sequences, (values ('a'), ('c'), ('g'), ('n'), ('t')) as s(symbol) group by symbol)""")
def symbol_codes(c):
    counts = c.sequences().select(F.explode(F.array(*[F.struct(F.lit(x).alias("symbol"), (F.col("len") - F.length(F.replace("seq", F.lit(x), F.lit("")))).alias("n")) for x in S.ALPHABET])).alias("r"))
    rows = counts.groupBy(F.col("r.symbol").alias("symbol")).agg(F.sum("r.n").cast("long").alias("n"))
    return rows.select("symbol", S.code(F.col("symbol")).alias("code"), S.two_bit(F.col("symbol")).alias("two_bit"), S.symbol_of(S.code(F.col("symbol"))).alias("back"), "n")


@query("select cast(row_number() over (order by substring(ref, i + 1)) - 1 as bigint) as rank, cast(i as bigint) as pos from (select ref, unnest(range(length(ref) + 1)) as i from ref)")
def suffix_array(c):
    return suffixes.suffix_ranks(c.spark, c.ref)


@query("select 1")
def sa_interval(c):
    return search.intervals(c.ref, patterns(c))


ORACLE_SQL["sa_interval"] = WITH + """, heads as (select row_number() over (order by substring(ref, i + 1)) - 1 as rank, substring(ref, i + 1, 100) as head from (select ref, unnest(range(length(ref) + 1)) as i from ref))
select p.pattern_id, min(rank) as lo, max(rank) as hi from patterns p left join heads on starts_with(head, lower(pattern)) and pattern <> '' group by p.pattern_id"""


@query()
def factorize(c):
    return O.numbered(written(O.parse(c), "parsed"), len(c.ref))


PARSE_PROPERTIES = """select seq_id, len, cast(len(regexp_extract_all(seq, 'n+')) as bigint) as n_runs, cast(0 as bigint) as n_gaps, cast(0 as bigint) as n_wrong, cast(0 as bigint) as n_longer from targets"""
#: Rows of a file of the reference sequence where it is put in ranges.
REF_ROWS = 1 << 13


@query(PARSE_PROPERTIES)
def parse_properties(c):
    """What makes a parse right, for each sequence: no gaps, every factor reads as the sequence does, none could be longer."""
    return O.properties(c, written(O.parse(c), "parsed"))


@query(PARSE_PROPERTIES)
def parse_properties_ranges(c):
    """The same of a parse against a suffix array in several files, which tasks have written."""
    place = qualified(c.spark, shared_path(c.spark, "reference"))
    reference.save_ranges(c.spark, c.ref, place, each=REF_ROWS)
    return O.properties(c, written(O.parse(c, place), "parsed"))


@query()
def factor_stats(c):
    return O.statistics(O.parse(c), len(c.ref))


@query()
def factor_neighbours(c):
    return O.with_neighbours(O.parse(c), len(c.ref))


@query()
def factor_sites(c):
    return O.sites(O.exploded(O.parse(c), len(c.ref)))


@query()
def factor_catalog(c):
    return O.catalog(written(O.parse(c), "parsed"))


@query("select seq_id, name, seq from targets")
def defactorize(c):
    return O.expand(O.parse(c), c.ref)


@query("select seq_id, seq from targets")
def defactorize_blocks(c):
    """Sequences parsed in blocks of 4,096 symbols, and put together again from the texts of their blocks."""
    texts = O.expand(blocks.parse_blocks(c, 4096, 1024).select("seq_id", F.col("block").cast("string").alias("name"), "pos", "size"), c.ref)
    rows = texts.groupBy("seq_id").agg(F.sort_array(F.collect_list(F.struct(F.col("name").cast("long").alias("block"), "seq"))).alias("parts"))
    return rows.select("seq_id", F.array_join(F.transform("parts", lambda x: x["seq"]), "").alias("seq"))


@query("select cast(count(*) as bigint) as n_seqs, cast(coalesce(sum(len), 0) as bigint) as n_symbols, cast(0 as bigint) as n_diffs from targets")
def round_trip(c):
    return O.round_trip(c, written(O.parse(c), "parsed"))


@query('select req_id, substring(seq, "start" + 1, "end" - "start") as text from requests join sequences using (seq_id) where seq_id = 0')
def display_ref(c):
    return search.display(O.packed(c), c.ref, requests(c).where("seq_id = 0"))


@query('select req_id, substring(seq, "start" + 1, "end" - "start") as text from requests join sequences using (seq_id)')
def display_target(c):
    return search.display(O.packed(c), c.ref, requests(c))


#: What stands at each place, cut from pieces of the sequences, as cutting from long texts is slow.
PLACES = f"""pieces as (select seq_id, 1000 * c as base, least(len - 1000 * c, 1000) as n, substring(seq, 1000 * c + 1, 1000 + {max(LENGTHS)}) as piece
  from (select seq_id, seq, len, unnest(range((len + 999) // 1000)) as c from sequences)),
places as (select seq_id, base + i as pos, substring(piece, i + 1, {max(LENGTHS)}) as head from (select seq_id, base, piece, unnest(range(n)) as i from pieces)) """
HITS = PLACES + f""", hits as (select pattern_id, seq_id, pos from patterns join places on starts_with(head, lower(pattern)) where length(pattern) < {min(LENGTHS)} and regexp_full_match(lower(pattern), '[acgnt]+')
  union all select pattern_id, seq_id, pos from patterns join places on substring(pattern, 1, {min(LENGTHS)}) = substring(head, 1, {min(LENGTHS)}) where length(pattern) >= {min(LENGTHS)} and starts_with(head, pattern)) """


@query("select 1")
def locate_patterns(c):
    return search.locate(written(O.packed(c), "parsed"), c.ref, patterns(c))


ORACLE_SQL["locate_patterns"] = WITH + ", " + HITS + "select pattern_id, seq_id, pos from hits"


@query("select 1")
def count_patterns(c):
    return search.count(written(O.packed(c), "parsed"), c.ref, patterns(c))


ORACLE_SQL["count_patterns"] = WITH + ", " + HITS + "select pattern_id, pattern, count(pos) as n from patterns left join hits using (pattern_id) group by all"


@query("select 1")
def workload_stats(c):
    """What a run of the patterns amounts to."""
    asked = patterns(c)
    return search.workload(asked, search.count(written(O.packed(c), "parsed"), c.ref, asked))


ORACLE_SQL["workload_stats"] = WITH + ", " + HITS + """, counted as (select pattern_id, length(pattern) as m, count(pos) as n from patterns left join hits using (pattern_id) group by all)
select count(*) as n_queries, cast(sum(m) as bigint) as n_symbols, cast(sum(n) as bigint) as n_hits, max(n) as most_hits, count(*) filter (n = 0) as n_without from counted"""


@query("select 1")
def count_lines(c):
    """Counts as the console shows them."""
    return search.count(written(O.packed(c), "parsed"), c.ref, patterns(c)).select(F.format_string("%s : %d", "pattern", "n").alias("line"))


ORACLE_SQL["count_lines"] = WITH + ", " + HITS + "select pattern || ' : ' || count(pos) as line from patterns left join hits using (pattern_id) group by pattern_id, pattern"


@query("select 1")
def count_by_regex(c):
    """Overlapping counts on plain sequences, by look-ahead."""
    usable = [(i, p.lower()) for i, p in PATTERNS if not set(p.lower()) - set(S.ALPHABET)]
    sums = c.sequences().agg(*[F.sum(F.regexp_count("seq", F.lit(f"(?={p})"))).cast("long").alias(f"n{i}") for i, p in usable])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(i).cast("long").alias("pattern_id"), F.col(f"n{i}").alias("n")) for i, _ in usable])))


ORACLE_SQL["count_by_regex"] = WITH + ", " + HITS + "select pattern_id, count(pos) as n from patterns left join hits using (pattern_id) where pattern_id < 1000 and pattern_id <> 4 group by pattern_id"


@query()
def count_strict(c):
    return search.count(written(O.packed(c), "parsed"), c.ref, patterns(c), "strict")


@query()
def locate_strict(c):
    return search.locate(written(O.packed(c), "parsed"), c.ref, patterns(c), "strict")


@query()
def locate_in_factor(c):
    return search.in_targets(written(O.packed(c), "parsed"), c.ref, patterns(c), "in_factor")


@query()
def locate_boundary(c):
    return search.in_targets(written(O.packed(c), "parsed"), c.ref, patterns(c), "boundary")


@query()
def rank_factor(c):
    """The factor that holds the first symbol of each requested window: the last start at or before it."""
    met = O.rank(O.parse(c), requests(c).select("req_id", "seq_id", F.col("start").alias("at")))
    return met.select("req_id", "seq_id", "fac_no", "seq_start")


@query("""select req_id, substring(seq, "start" + 1, 1) as symbol from requests join targets using (seq_id) where "start" < len""")
def rank_symbol(c):
    """The first symbol of each requested window of a target, from the factor that holds it."""
    met = O.rank(O.parse(c), requests(c).select("req_id", "seq_id", F.col("start").alias("at")))
    one = met.select("req_id", "pos", "len", (F.col("at") - F.col("seq_start")).alias("offset"))
    return O.symbols_at(one, c.ref).select("req_id", "symbol")


@query()
def select_factor(c):
    """The start of the k-th factor of each sequence, k from its number."""
    parsed = O.parse(c).where(F.size("pos") > 0)
    k = F.col("seq_id") % F.size("pos")
    return parsed.select("seq_id", k.cast("long").alias("fac_no"), F.element_at("start", (k + 1).cast("int")).alias("seq_start"))


@query()
def nested_levels(c):
    return O.nested_levels(O.exploded(O.parse(c), len(c.ref)))


@query()
def short_factors(c):
    return O.short_factors(O.exploded(O.parse(c), len(c.ref)), c.ref)


@query()
def encoded_bits(c):
    return O.encoded_bits(O.parse(c), c.ref)


@query()
def factor_codes(c):
    return O.code_strings(O.exploded(O.parse(c), len(c.ref)), len(c.ref))


@query("""select seq_id, len, repeat('1', len // 64) || '0' || lpad(bin(len % 64), 6, '0') as code, len // 64 + 7 as n_bits, len as back, lpad(bin(len), 40, '0') as fixed, len as fixed_back from sequences""")
def golomb_codes(c):
    rows = c.sequences().select("seq_id", "len", S.rice(F.col("len"), 64).alias("code"), S.rice_bits(F.col("len"), 64).cast("long").alias("n_bits"), S.fixed_binary(F.col("len"), F.lit(40)).alias("fixed"))
    return rows.select("*", S.from_rice(F.col("code"), 64).alias("back"), S.from_binary(F.col("fixed")).alias("fixed_back"))


@query()
def rising_factors(c):
    return O.rising(O.parse(c), len(c.ref))


@query("select seq_id, cast(0 as bigint) as n_falling, cast(0 as bigint) as n_unlike from targets")
def rising_properties(c):
    """For each sequence: chosen factors that do not rise, and those whose position does not come back from the deltas."""
    parsed = written(O.parse(c), "parsed")
    back = O.restore_rising(O.rising(parsed, len(c.ref), starts=True))
    from pyspark.sql import Window

    back = back.withColumn("before", F.lag("pos").over(Window.partitionBy("seq_id").orderBy("fac_no")))
    found = back.groupBy("seq_id").agg(F.count_if(F.col("before") >= F.col("pos")).alias("n_falling"), F.count_if(F.col("pos") != F.col("restored")).alias("n_unlike"))
    return parsed.select("seq_id").join(found, "seq_id", "left").na.fill(0)


@query()
def rising_restored(c):
    return O.restore_rising(O.rising(O.parse(c), len(c.ref), starts=True))


def codec(text: bool, short: bool, liss: bool) -> Callable[[Collection], DataFrame]:
    # files are complete before any is read, so a core's Python workers parse and encode, or they decode
    return lambda c: factor_files.decode(written(factor_files.encode(O.parse(c), c.ref, text, short, liss), "files"), c.ref)


for _text in (False, True):
    for _short in (False, True):
        for _liss in (False, True):
            _f = codec(_text, _short, _liss)
            _f.__name__ = "codec_" + ("text" if _text else "binary") + "_short" * _short + "_liss" * _liss
            query("select seq_id, name, seq from targets")(_f)


@query()
def factor_file_rows(c):
    return factor_files.factors(factor_files.encode(O.parse(c), c.ref, short=True, liss=True), c.ref)


@query("select req_id, substring(seq, \"start\" + 1, \"end\" - \"start\") as text from requests join sequences using (seq_id)")
def index_display(c):
    """Through a saved display-only index."""
    folder = shared_path(c.spark, "index")
    index.write(c, folder, display_only=True)
    return index.load(c.spark, folder).display(requests(c))


@query("select 1")
def index_count(c):
    """Through a saved index."""
    folder = shared_path(c.spark, "index")
    index.write(c, folder)
    return index.load(c.spark, folder).count(patterns(c))


ORACLE_SQL["index_count"] = ORACLE_SQL["count_patterns"]


@query("select 1")
def index_locate(c):
    """Through a saved index, of which only the keys of the patterns are read."""
    folder = shared_path(c.spark, "index")
    index.write(c, folder)
    return index.load(c.spark, folder).locate(patterns(c))


ORACLE_SQL["index_locate"] = ORACLE_SQL["locate_patterns"]


@query()
def index_sizes(c):
    folder = shared_path(c.spark, "index")
    index.write(c, folder)
    return index.size_report(c.spark, folder)


@query("select req_id, seq_id, \"start\", \"end\" from requests")
def display_requests(c):
    return requests(c)


@query("select req_id, substring(seq, \"start\" + 1, \"end\" - \"start\") as text from requests join sequences using (seq_id)")
def stream_display(c):
    """Requests as a stream of files."""
    spark, folder = c.spark, shared_path(c.spark, "stream")
    requests(c).write.parquet(f"{folder}/in")
    parsed = written(O.parse(c), "parsed")
    streams.display(spark.readStream.schema(streams.REQUESTS).parquet(f"{folder}/in"), parsed, c.ref, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema("req_id long, text string").parquet(f"{folder}/out/batch=*")


@query("select 1")
def stream_count(c):
    """Patterns as a stream of files."""
    spark, folder = c.spark, shared_path(c.spark, "stream")
    patterns(c).write.parquet(f"{folder}/in")
    parsed = written(O.parse(c), "parsed")
    streams.count(spark.readStream.schema(streams.PATTERNS).parquet(f"{folder}/in"), parsed, c.ref, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema("pattern_id long, pattern string, n long").parquet(f"{folder}/out/batch=*")


ORACLE_SQL["stream_count"] = ORACLE_SQL["count_patterns"]
