"""WARC archives and a normaliser for monolithically compressed ones.

`write_archives` puts records into .warc.gz files that are one gzip stream each, as careless crawlers leave them.
`normalise` inflates such a stream once from end to end, rewrites each record as a gzip member of its own, and writes a
sidecar index (JSON lines: offset, length, type, id, digest) beside the archive. `read_records` fetches records by the
index alone. Every file is written under a name of the attempt and then renamed, so lost executors leave no half files;
files are in the shared folder, reached by open() for file: and by pyarrow's filesystems else.

Revisits: of records with equal payloads of at least 100 bytes that with the least page_id is a response; the others
become revisit records that name it and carry the payload's digest and length but no payload. Digests, not payloads, are
shuffled to find equal ones; only payloads that may be repeated then move.

Defined results: a null payload is empty; rows that repeat the least page_id of a payload are all responses; a null
page_id is written as an empty one and reads back null; an empty table writes no archive; payloads of any length are
written whole, records are read back one at a time; other columns, whatever their names, stay out.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import blocks, drop_path, materialise, scratch_path, told_apart

LEAST_REVISIT = 100
#: Payload bytes after which a task starts another archive.
ARCHIVE_BYTES = 128 << 20
SALTS = 16
CHUNK = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Store:
    """Files of the shared folder."""

    def __init__(self, uri: str):
        if uri.startswith("file:") or "://" not in uri:
            self.fs, self.root = None, "/" + uri.removeprefix("file:").lstrip("/")
        else:
            from pyarrow import fs

            self.fs, self.root = fs.FileSystem.from_uri(uri)

    def write(self, name: str):
        return _Renamed(self, f"{self.root}/{name}")

    def read(self, name: str):
        return open(f"{self.root}/{name}", "rb") if self.fs is None else self.fs.open_input_file(f"{self.root}/{name}")

    def make(self) -> None:
        import os

        os.makedirs(self.root, exist_ok=True) if self.fs is None else self.fs.create_dir(self.root, recursive=True)


class _Renamed:
    """A file that has its name only once it is whole."""

    def __init__(self, store: Store, path: str):
        self.store, self.path, self.own = store, path, f"{path}.{uuid.uuid4().hex}"

    def __enter__(self):
        self.file = open(self.own, "wb") if self.store.fs is None else self.store.fs.open_output_stream(self.own)
        return self.file

    def __exit__(self, kind, *_):
        import os

        self.file.close()
        if kind is not None:
            os.remove(self.own) if self.store.fs is None else self.store.fs.delete_file(self.own)
        elif self.store.fs is None:
            os.replace(self.own, self.path)
        else:
            self.store.fs.move(self.own, self.path)


def record(page_id, url: str | None, payload: bytes, size: int, digest: str, kind: str, refers_to) -> bytes:
    """One WARC record; a revisit has the size and the digest of its payload, but no payload."""
    body = payload if kind == "response" else b""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {quote(url or '', safe='%/:=&?~#+!$,;@()*[]')}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}", "Content-Type: text/html; charset=utf-8",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def inflate(source):
    """The bytes of a gzip file, member after member, in chunks."""
    z = zlib.decompressobj(31)
    while chunk := source.read(CHUNK):
        while chunk:
            if out := z.decompress(chunk, CHUNK):
                yield out
            if z.eof:
                chunk, z = z.unused_data, zlib.decompressobj(31)
            else:
                chunk = z.unconsumed_tail
    if out := z.flush():
        yield out


def split_records(chunks):
    """Whole records, one at a time, from inflated chunks."""
    held = bytearray()
    need = None  # bytes of the record at the front, once its head is there
    for chunk in chunks:
        held += chunk
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                fields, _ = parse(bytes(held[: end + 4]) + b"")
                need = end + 4 + int(fields["Content-Length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError(f"archive ends inside a record ({len(held)} bytes left)")


def page_number(urn: str):
    own = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(own) if own else None


def with_revisits(pages: DataFrame, page_id="page_id", url="url", html="html") -> DataFrame:
    """page_id, url, payload, payload_bytes, digest, kind, refers_to: which records become revisits (without their payload), and of which."""
    text = F.coalesce(F.col(html), F.lit(""))
    raw = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), text.alias("payload"), F.octet_length(text).cast("long").alias("payload_bytes"), F.sha2(text, 256).alias("digest"))
    light = materialise(raw.filter(F.col("payload_bytes") >= LEAST_REVISIT).select("page_id", "digest"), "digests")
    groups = light.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    groups = materialise(groups.select("digest", "first"), "repeated")
    alone, rest = told_apart(raw, "digest", groups.select(F.col("digest").alias("__gone")))
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = rest.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"], "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    columns = ["page_id", "url", "payload_bytes", "digest"]
    met = met.select(*columns, F.when(again, "").otherwise(F.col("payload")).alias("payload"), F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first")).alias("refers_to"))
    return alone.select(*columns, "payload", F.lit("response").alias("kind"), F.lit(None).cast("long").alias("refers_to")).unionByName(met)


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write each part's records into monolithic .warc.gz files of the folder; (archive, records) of each."""

    def run(batches):
        from pyspark import TaskContext

        store, part, k = Store(folder), TaskContext.get().partitionId(), 0
        parts = (p for p in blocks(batches, "payload", 1 << 20))
        block = next(parts, None)
        while block is not None:
            name, size, n = f"crawl-{part:06d}-{k:04d}.warc.gz", 0, 0
            z = zlib.compressobj(1, zlib.DEFLATED, 31)
            with store.write(name) as out:
                while block is not None and size < archive_bytes:
                    for page, url, payload, length, digest, kind, first in zip(*(c.to_pylist() for c in block.columns)):
                        raw = payload.encode()
                        out.write(z.compress(record(page, url, raw, length, digest, kind, first)))
                        size, n = size + len(raw), n + 1
                    block = next(parts, None)
                out.write(z.flush())
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["archive", "records"])
            k += 1

    return records.select("page_id", "url", "payload", "payload_bytes", "digest", "kind", "refers_to").mapInArrow(run, "archive string, records long")


def normalise(archives: DataFrame, source_folder: str, folder: str) -> DataFrame:
    """Rewrite each archive with a member per record and a sidecar index, into `folder`; (archive, index, records) of each."""

    def run(batches):
        sources, store = Store(source_folder), Store(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                done, at, n = name.replace("crawl-", "members-", 1), 0, 0
                index = done.removesuffix(".warc.gz") + ".index.jsonl"
                with sources.read(name) as source, store.write(done) as out, store.write(index) as side:
                    for raw in split_records(inflate(source)):
                        fields, _ = parse(raw[: raw.find(b"\r\n\r\n") + 4])
                        z = zlib.compressobj(1, zlib.DEFLATED, 31)
                        member = z.compress(raw) + z.flush()
                        out.write(member)
                        line = {"offset": at, "length": len(member), "type": fields["WARC-Type"], "id": fields["WARC-Record-ID"], "digest": fields["WARC-Payload-Digest"]}
                        side.write((json.dumps(line) + "\n").encode())
                        at, n = at + len(member), n + 1
                yield pa.RecordBatch.from_arrays([pa.array([done]), pa.array([index]), pa.array([n], pa.int64())], names=["archive", "index", "records"])

    return archives.select("archive").mapInArrow(run, "archive string, index string, records long")


def read_records(archives: DataFrame, folder: str) -> DataFrame:
    """Every record that the sidecar indexes name, read at its offset, with its payload as far as it has one."""
    names = ["page_id", "url", "kind", "refers_to", "payload_digest", "payload_bytes", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def run(batches):
        store = Store(folder)
        for batch in batches:
            for archive, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.read(archive) as source, store.read(index) as side:
                    rows, size = [], 0
                    for line in io.BufferedReader(side) if store.fs is not None else side:
                        entry = json.loads(line)
                        source.seek(entry["offset"])
                        fields, payload = parse(zlib.decompress(source.read(entry["length"]), 31))
                        kind, first = fields["WARC-Type"], fields.get("WARC-Refers-To")
                        digest = hashlib.sha256(payload).hexdigest() if kind == "response" else entry["digest"].removeprefix("sha256:")
                        length = len(payload) if kind == "response" else int(fields["X-Payload-Length"])
                        rows.append((page_number(entry["id"]), unquote(fields["WARC-Target-URI"]), kind, page_number(first) if first else None, digest, length, payload))
                        size += len(payload)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)

    return archives.select("archive", "index").mapInArrow(run, "page_id long, url string, kind string, refers_to long, payload_digest string, payload_bytes long, payload binary")


def through_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES, **columns) -> DataFrame:
    """Write pages to monolithic archives, normalise them, and read all records back by their indexes.

    The monolithic archives go once their members and indexes are whole and the stage that made them has ended."""
    spark = pages.sparkSession
    crawl, folder = scratch_path(spark, "crawl"), scratch_path(spark, "warc")
    Store(crawl).make()
    Store(folder).make()
    written = materialise(write_archives(with_revisits(pages, **columns), crawl, archive_bytes), "written")
    n = max(1, written.count())
    members = materialise(normalise(written.repartition(n, "archive"), crawl, folder), "members")
    drop_path(spark, crawl)
    return read_records(members.repartition(n, "archive"), folder)
