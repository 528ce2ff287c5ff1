"""Command line: compress, decompress, index, display, count, locate."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from seqloom.operators import factors, search
from seqloom.scratch import shared_path
from seqloom.sources import factor_files, index, sequences


def lines(source: Iterable[str]) -> list[str]:
    """Lines up to the first blank one."""
    out = []
    for line in source:
        if not line.strip():
            break
        out.append(line.strip())
    return out


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="seqloom")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("compress", "decompress", "index"):
        one = sub.add_parser(name)
        one.add_argument("out")
        one.add_argument("files", nargs="+", help="the reference sequence first")
        if name == "compress":
            one.add_argument("-e", dest="encoding", choices=["t", "b"], default="b")
            one.add_argument("-s", dest="short", action="store_true")
            one.add_argument("-l", dest="liss", action="store_true")
        if name == "index":
            one.add_argument("-r", dest="display_only", action="store_true")
    for name in ("display", "count", "locate"):
        one = sub.add_parser(name)
        one.add_argument("index")
        one.add_argument("--mode", choices=["complete", "strict"], default="complete")
        one.add_argument("--times", action="store_true", help="tell the microseconds for each symbol (display) or hit on the error output")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None, source: Iterable[str] = sys.stdin) -> list[str]:
    """Run one command; the printed lines are returned too."""
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    out: list[str] = []
    if a.command == "compress":
        c = sequences.read_files(spark, a.files)
        factor_files.write(factor_files.encode(factors.parse(c), c.ref, a.encoding == "t", a.short, a.liss), a.out)
    elif a.command == "decompress":
        ref = sequences.read_files(spark, a.files[:1]).ref
        sequences.write_texts(factor_files.decode(factor_files.read(spark, a.files[1]), ref), a.out)
    elif a.command == "index":
        index.write(sequences.read_files(spark, a.files), a.out, a.display_only)
    else:
        got = index.load(spark, a.index)
        asked = lines(source)
        if a.command == "display":
            rows = [(i, *map(int, x.split())) for i, x in enumerate(asked)]
            found, order, units = got.display(spark.createDataFrame(rows, "req_id long, seq_id long, start long, end long")), ["req_id"], F.length("text")
            line = F.coalesce("text", F.lit(""))
        else:
            patterns = spark.createDataFrame(list(enumerate(asked)), "pattern_id long, pattern string")
            if a.command == "count":
                found, order, units, line = got.count(patterns, a.mode), ["pattern_id"], F.col("n"), F.format_string("%s : %d", "pattern", "n")
            else:
                found, order, units, line = got.locate(patterns, a.mode), ["pattern_id", "seq_id", "pos"], F.lit(1), F.format_string("%d %d", "seq_id", "pos")
        target = shared_path(spark, "answers")
        times = search.timed(found, units, target)
        if a.times:
            print(f"{a.command}: {times.answers} answers, {times.units} {'symbols' if a.command == 'display' else 'hits'}, {times.micros:.3f} microseconds each", file=sys.stderr)
        # answers may be many, so they pass in parts
        answers = (r[0] for r in spark.read.schema(found.schema).parquet(target).orderBy(*order).select(line).toLocalIterator())
        for text in answers:
            print(text)
            out.append(text)
    return out


if __name__ == "__main__":
    main()
