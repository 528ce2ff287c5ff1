import gzip
import io
import zlib
from collections import defaultdict
from pathlib import Path

import pytest

from seqloom.llm import warc

ROWS = [(3, "http://a/ü x", "<p>é</p>"), (1, "u", "same"), (2, None, "same"), (7, "v", None), (5, "w", ""), (9, "u", "same"), (9, "u", "same"), (11, "z\r\nX: y", "z" * 300_000)]


def want(rows, least=0):
    lead = defaultdict(list)
    for i, _, h in rows:
        lead[h or ""].append(i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        first = min(lead[h or ""])
        again = len(b) >= least and first < i
        out.append((i, len(b), warc.base32_sha1(b), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 as first", "2 as sha")
    got = warc.round_trip(df, least, payloads=True).collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == want(ROWS, least)
    text = {i: h for i, _, h in ROWS}
    assert all(bytes(r.payload).decode() == (text[r.page_id] or "") for r in got if r.record_type == "response")


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_normaliser_reads_one_stream_or_many():
    recs = [warc.record(i, "u", b"x" * i, "D", None) for i in range(0, 3000, 100)]
    whole = gzip.compress(b"".join(recs))
    members = b"".join(map(gzip.compress, recs))
    for data in (whole, members):
        assert list(warc.records(warc.inflated(io.BytesIO(data)))) == recs
    with pytest.raises(ValueError, match="within a record"):
        list(warc.records(iter([recs[5][:-1]])))


def test_a_stream_that_ends_early_is_an_error():
    """Also one that is cut where a record ends, so that no record is broken."""
    recs = [warc.record(i, "u", bytes([i]) * 200_000, "D", None) for i in range(8)]
    zipper = zlib.compressobj(3, zlib.DEFLATED, 31)
    cut = b"".join(zipper.compress(r) + zipper.flush(zlib.Z_FULL_FLUSH) for r in recs[:5])
    with pytest.raises(ValueError, match="ends early"):
        list(warc.records(warc.inflated(io.BytesIO(cut))))
    assert list(warc.records(warc.inflated(io.BytesIO(gzip.compress(b""))))) == [] == list(warc.records(warc.inflated(io.BytesIO(b""))))


def test_records_repeat_themselves(spark):
    """Records have ids of their own, and the same ones when a task writes them again."""
    assert warc.record(1, "u", b"x", "D", None, "0 1") == warc.record(1, "u", b"x", "D", None, "0 1") != warc.record(1, "u", b"x", "D", None, "0 2")
    index, folder = warc.archive(spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(1))
    ids = [r.record_id for r in index.collect()]
    assert len(set(ids)) == len(ids) == len(ROWS) and not Path(folder.removeprefix("file://"), "whole").exists()
    many = warc.dealt(index)
    assert many.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and many.count() == len(ROWS)


def test_null_ids_are_responses(spark):
    got = warc.round_trip(spark.createDataFrame([(None, "u", "same"), (2, "v", "same"), (None, "w", "own")], "page_id long, url string, html string")).collect()
    assert sorted((str(r.page_id), r.record_type) for r in got) == [("2", "response"), ("None", "response"), ("None", "response")]


def test_members_stand_alone(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    index, folder = warc.archive(df)
    for r in index.collect():
        with open(r.path, "rb") as f:
            f.seek(r.offset)
            assert r.record_id.encode() in gzip.decompress(f.read(r.length))
        with open(r.path.replace(".warc.gz", ".idx")) as f:
            assert f"{r.offset}\t{r.length}\t{r.record_id}\n" in f.readlines()
