"""WARC archives: write, normalise, read back.

``write`` makes archives as careless tools do, one gzip stream over a whole file. ``normalise`` inflates such a stream
once, in pieces, rewrites every record as a gzip member of its own and writes a sidecar index (offset, length, record
id) beside the archive. ``read`` fetches single members by their offsets, in tasks of about equal bytes. A stream that ends
early, within a record or between two, is an error.

Files go to the folder that the cluster shares, each attempt of a task to files of its own, under a temporary name first and then moved, and the
index names the files of the attempt that counts; so a task that runs again, or twice at once, disturbs nothing. Files of
attempts that do not count are named by no index.

Of records with equal payloads of at least ``min_bytes`` bytes the one with the smallest page id is a response and the
others are revisits that refer to it. Null html is an empty payload; rows that share the smallest id are all responses, and so are
rows without an id. The digests that occur more than once are broadcast if a count bounds them; beyond it a sort-merge join on the
digest follows, whose large partitions Spark splits.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import materialize, maybe_broadcast, remove, shared_path

LEVEL = 3
PIECE = 1 << 20
#: Compressed bytes that lie together in a reading task, and that a task reads in all.
RUN_BYTES = 4 << 20
TASK_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, place: str = "") -> bytes:
    """One record; ``first`` is the page that a revisit refers to. Its id follows from what it holds and its place."""
    body = HTTP if first is not None else HTTP + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest} {place}')}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~\'')}")
    if first is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def headers(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in raw.decode("utf-8", "replace").split("\r\n")[1:])}


def records(stream: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an inflated stream, each with its closing line ends."""
    held = bytearray()
    need = -1
    for piece in stream:
        held += piece
        at = 0
        while True:
            if need < 0:
                end = held.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                need = end + 8 + int(headers(bytes(held[at:end]))["content-length"]) - at
            if len(held) - at < need:
                break
            yield bytes(held[at : at + need])
            at, need = at + need, -1
        del held[:at]
    if held:
        raise ValueError("the archive ends within a record")


def inflated(source) -> Iterator[bytes]:
    """Pieces of a gzip file's content, of one member or many; a member that does not end is an error."""
    unzip = zlib.decompressobj(31)
    fresh = True
    while piece := source.read(PIECE):
        while piece:
            if unzip.eof:
                unzip = zlib.decompressobj(31)
            fresh = False
            yield unzip.decompress(piece, PIECE)
            piece = unzip.unused_data if unzip.eof else unzip.unconsumed_tail
    # what is left when all input is in
    while not unzip.eof and (piece := unzip.decompress(b"", PIECE)):
        yield piece
    if not fresh and not unzip.eof:
        raise ValueError("the gzip stream ends early")


class Target:
    """A file that appears under its name only when it is complete."""

    def __init__(self, fs: pafs.FileSystem, path: str) -> None:
        self.fs, self.path, self.part = fs, path, f"{path}.{uuid.uuid4().hex}.part"
        self.out, self.at = fs.open_output_stream(self.part, compression=None), 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.path)


def plan(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html and ``first``: the page that a revisit refers to, null for a response."""
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    p = p.withColumn("size", F.octet_length("html").cast("long")).withColumn("sha", F.unhex(F.sha1("html")))
    lead = p.where(F.col("size") >= min_bytes).groupBy("sha", "size").agg(F.min("page_id").alias("lead"), F.count("*").alias("n")).where("n > 1 and lead is not null").drop("n")
    joined = p.join(maybe_broadcast(materialize(lead, "warc-lead")), ["sha", "size"], "left")
    return joined.select("page_id", "url", "html", F.when(F.col("lead") < F.col("page_id"), F.col("lead")).alias("first"))


def write(planned: DataFrame, folder: str) -> DataFrame:
    """Write one whole-file gzip stream for each partition; the paths and record counts of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        target = zipper = None
        count = 0
        task = TaskContext.get()
        path = f"{base}/whole-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        for batch in batches:
            for page_id, url, html, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if target is None:
                    target, zipper = Target(fs, path), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                payload = html.encode()
                target.write(zipper.compress(record(page_id, url, payload, base32_sha1(payload), first, f"{task.partitionId()} {count}")))
                count += 1
        if target is not None:
            target.write(zipper.flush())
            target.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [count]})

    return planned.mapInArrow(run, "path string, records long")


def normalise(files: DataFrame, folder: str, consume: bool = False) -> DataFrame:
    """Rewrite each file record by record; the index rows: path, offset, length, record id. Sidecars hold the same.

    With ``consume`` a file is deleted once it is rewritten, for files that the same task has written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                name = f"{base}/{path.rsplit('/', 1)[1].replace('whole-', 'records-').removesuffix('.warc.gz')}-{TaskContext.get().taskAttemptId()}.warc.gz"
                target, index = Target(fs, name), []
                with fs.open_input_stream(path, compression=None) as source:
                    for rec in records(inflated(source)):
                        zipper = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = zipper.compress(rec) + zipper.flush()
                        index.append((target.at, len(member), headers(rec[: rec.index(b"\r\n\r\n")])["warc-record-id"]))
                        target.write(member)
                target.close()
                side = Target(fs, name.replace(".warc.gz", ".idx"))
                side.write("".join(f"{o}\t{n}\t{r}\n" for o, n, r in index).encode())
                side.close()
                if consume:
                    fs.delete_file(path)
                yield pa.RecordBatch.from_pydict({"path": [name] * len(index), "offset": [x[0] for x in index], "length": [x[1] for x in index], "record_id": [x[2] for x in index]}, schema=pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string())]))

    return files.mapInArrow(run, "path string, offset long, length long, record_id string")


def read(index: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Read single members by offset: page_id, url, payload size and digest, type, and what a revisit refers to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        opened, source = None, None
        for batch in batches:
            rows = []
            for path, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path != opened:
                    opened, source = path, fs.open_input_file(path)
                source.seek(offset)
                rec = zlib.decompress(source.read(length), 31)
                cut = rec.index(b"\r\n\r\n")
                h = headers(rec[:cut])
                block = rec[cut + 4 : cut + 4 + int(h["content-length"])]
                payload = block[block.index(b"\r\n\r\n") + 4 :]
                page = h["warc-record-id"].split(":")[2]
                size, digest = int(h["x-payload-length"]), h["warc-payload-digest"].removeprefix("sha1:")
                if h["warc-type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
                    raise ValueError(f"damaged record in {path} at {offset}")
                first = h.get("warc-refers-to", "").strip("<>").rpartition(":")[2]
                rows.append((int(page) if page else None, h.get("warc-target-uri"), size, digest, h["warc-type"], int(first) if first else None) + ((payload,) if payloads else ()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])

    fields = [("page_id", pa.int64()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payloads
    schema = "page_id long, target_uri string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    return index.select("path", "offset", "length").mapInArrow(run, schema)


def archive(pages: DataFrame, min_bytes: int = 0, folder: str | None = None) -> tuple[DataFrame, str]:
    """Write and normalise; the index table and the folder of the archives."""
    folder = folder or shared_path(pages.sparkSession, "warc")
    index = materialize(normalise(write(plan(pages, min_bytes), f"{folder}/whole"), f"{folder}/records", consume=True), "warc-index")
    remove(pages.sparkSession, f"{folder}/whole")
    return index, folder


def dealt(index: DataFrame) -> DataFrame:
    """The index in tasks of about equal bytes, each reading runs of neighbouring records."""
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    run = F.floor(F.col("offset") / min(RUN_BYTES, max(total // (8 * tasks), 1)))
    return index.repartition(tasks, "path", run).sortWithinPartitions("path", "offset")


def round_trip(pages: DataFrame, min_bytes: int = 0, payloads: bool = False) -> DataFrame:
    """What the archives of a table say of each of its pages."""
    index, folder = archive(pages, min_bytes)
    return read(dealt(index), folder, payloads)
