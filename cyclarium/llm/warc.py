"""WARC archives: deduplicating writer, and a reader into a table of chunks.

The writer takes a table of chunks: rows of a record's id, chunk number and
bytes, in order and side by side, so that a task holds a chunk of a record at a
time; the digest that it carries along must end as the one in the header. It
makes one gzipped WARC/1.1 file per task, each record a gzip member of its own.
Of records with equal payloads the one with the smallest id is a response and
the others are revisits that refer to it and hold no payload. A task writes to
a name of its own and returns it; the list of names (the manifest) is stored
once, so files of lost or repeated tasks are never read.

Payloads never move: digests are summed up, and only the ids of revisits are
joined to the pages, so a page with a third of all copies is no hot key.

The reader streams each file and yields a row per record and chunk number,
with the length and SHA-256 digest of the payload so far; no record is held in
memory as a whole. A record's last chunk so has its full length and digest.

Edge cases: null payloads are empty; an empty payload has one chunk of no
bytes; payloads under ``MIN_REVISIT`` bytes are never revisits; null urls are
left out of the record; line ends in urls are percent-encoded; records without
an id refer to the first with one and are revisits too; equal rows with equal
ids are all responses; an empty table writes no file that is read; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclarium.llm._common import cut, delete, scratch, shared_path, table, with_least

CHUNK, MIN_REVISIT = 1 << 20, 100
#: Revisits (of about 200 bytes in memory) that may be broadcast.
BROADCAST_ROWS = 50_000
ID = "urn:x-record:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
CHUNKS = "file string, record_id string, record_type string, target_uri string, refers_to string, declared_digest string, declared_bytes bigint, chunk_no bigint, chunk binary, bytes_so_far bigint, digest_so_far string, is_last boolean"
_ARROW = pa.schema([("file", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("declared_digest", pa.string()), ("declared_bytes", pa.int64()), ("chunk_no", pa.int64()), ("chunk", pa.binary()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("is_last", pa.bool_())])


def header(record_id: str, kind: str, url: str | None, digest: str, size: int, refers_to: str | None) -> bytes:
    """A record's WARC and HTTP headers."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{ID}{record_id}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <{ID}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    block = len(http) + (size if kind == "response" else 0)
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {block}", "", ""]
    return "\r\n".join(lines).encode() + http


def write(parts: DataFrame, path: str) -> DataFrame:
    """Write the chunks of ``records`` below ``path``; the manifest: file, records."""

    def run(batches):
        store, folder = pafs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        name, n, out = f"{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in batches:
            for i in range(batch.num_rows):
                if out is None:
                    out = store.open_output_stream(f"{folder}/{name}", compression=None)
                number, n_chunks, declared, refers = (batch.column(c)[i].as_py() for c in ("chunk_no", "n_chunks", "digest", "refers_to"))
                if number == 0:
                    squeeze, digest = zlib.compressobj(1, zlib.DEFLATED, 31), hashlib.sha256()
                    record, url, size = (batch.column(c)[i].as_py() for c in ("record_id", "url", "size"))
                    out.write(squeeze.compress(header(record or "", "response" if refers is None else "revisit", url, declared, size, refers)))
                chunk = batch.column("chunk")[i].as_buffer()
                digest.update(chunk)
                out.write(squeeze.compress(chunk))
                if number + 1 == n_chunks:
                    if refers is None and digest.hexdigest() != declared:
                        raise ValueError(f"the chunks of record {record} don't have its digest")
                    out.write(squeeze.compress(b"\r\n\r\n") + squeeze.flush())
                    n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{name}"]), pa.array([n], pa.int64())], ["file", "records"])

    return cut(parts.mapInArrow(run, "file string, records bigint"))


def _fields(stream: io.BufferedReader) -> tuple[str, dict[str, str]]:
    """First line and headers up to the empty line; an empty first line at the end of the stream."""
    first = stream.readline()
    while first in (b"\r\n", b"\n"):
        first = stream.readline()
    fields: dict[str, str] = {}
    while line := stream.readline().rstrip(b"\r\n"):
        name, _, value = line.partition(b":")
        fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return first.decode("utf-8", "replace").strip(), fields


def _open(file: str) -> io.BufferedReader:
    store, at = pafs.FileSystem.from_uri(file)
    raw = store.open_input_stream(at, compression=None, buffer_size=1 << 16)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 16) if file.endswith(".gz") else io.BufferedReader(raw, 1 << 16)


class _Counted:
    """At most ``left`` bytes of a stream."""

    def __init__(self, stream: io.BufferedReader, left: int) -> None:
        self.stream, self.left = stream, left

    def readline(self) -> bytes:
        line = self.stream.readline(self.left)
        self.left -= len(line)
        return line

    def read(self, n: int) -> bytes:
        data = self.stream.read(min(n, self.left))
        self.left -= len(data)
        return data


def _named(text: str | None) -> str | None:
    """An id without its brackets and prefix."""
    return text.strip("<>").removeprefix(ID) if text is not None else None


def chunks(file: str, size: int = CHUNK) -> Iterator[tuple]:
    """Rows of ``CHUNKS`` for one file's response, resource and revisit records."""
    with _open(file) as stream:
        while True:
            version, fields = _fields(stream)
            if not version:
                return
            block = _Counted(stream, int(fields.get("content-length", 0)))
            kind = fields.get("warc-type")
            if kind in ("response", "resource", "revisit"):
                if fields.get("content-type", "").startswith("application/http"):
                    _fields(block)
                digest, done, number = hashlib.sha256(), 0, 0
                declared = fields.get("warc-payload-digest", "").rpartition(":")[2] or None
                length = int(fields["x-payload-length"]) if "x-payload-length" in fields else None
                head = (file, _named(fields.get("warc-record-id")), kind, fields.get("warc-target-uri"), _named(fields.get("warc-refers-to")), declared, length)
                while True:
                    data = block.read(size)
                    digest.update(data)
                    done += len(data)
                    last = block.left == 0 or not data
                    yield (*head, number, data, done, digest.hexdigest(), last)
                    number += 1
                    if last:
                        break
            while block.read(1 << 16):
                pass


def read(manifest: DataFrame, *, size: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunk table of the files in ``manifest``; without data the column chunk is null."""
    n = max(1, manifest.count())

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            for file in batch.column("file").to_pylist():
                for row in chunks(file, size):
                    held += len(row[8]) + 200
                    rows.append(row if with_data else (*row[:8], None, *row[9:]))
                    if held >= 4 * CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    return manifest.select("file").coalesce(1).repartition(n).mapInArrow(run, CHUNKS)


def records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = MIN_REVISIT, broadcast_rows: int = BROADCAST_ROWS, size: int = CHUNK) -> DataFrame:
    """What ``write`` takes: record_id, url, digest, size, refers_to (for repeated payloads), chunk_no, n_chunks, chunk of payloads in UTF-8.

    A record's chunks follow each other in its partition. The digests are kept
    in the shared folder meanwhile.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumns({"digest": F.sha2("payload", 256), "size": F.length("payload").cast("bigint")})
    known = cut(own.where(F.col("size") >= min_revisit).select("id", "digest"))
    repeated = with_least(known, ["digest"], "id").where("size > 1 and rep is not null")
    revisits = cut(repeated.where(~F.col("id").eqNullSafe(F.col("rep"))).distinct())
    revisits = revisits.select(F.col("id").alias("own"), F.col("digest").alias("same"), F.col("rep").alias("first"))
    few = revisits.count() <= broadcast_rows
    own = own.join(F.broadcast(revisits) if few else revisits, F.col("id").eqNullSafe(F.col("own")) & (F.col("digest") == F.col("same")), "left")
    own = own.withColumns({"refers_to": F.col("first").cast("string"), "n_chunks": F.when(F.col("first").isNotNull(), F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(F.col("size") / size))).cast("bigint")})
    own = own.withColumn("chunk_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_chunks") - 1)))
    chunk = F.when(F.col("first").isNotNull(), F.lit(b"")).otherwise(F.substring("payload", (F.col("chunk_no") * size + 1).cast("int"), F.lit(size)))
    return own.select(F.col("id").cast("string").alias("record_id"), "url", "digest", "size", "refers_to", "chunk_no", "n_chunks", chunk.alias("chunk"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4_warc: all pages through archives and back; the archives are deleted once they are read."""
    path = shared_path(spark)
    with scratch():
        manifest = write(records(table(spark, sf_dir, "pages")), path)
        last = read(manifest, with_data=False).where("is_last")
        own = F.col("record_type") == "response"
        out = last.select(
            F.nullif(F.col("record_id"), F.lit("")).cast("bigint").alias("page_id"),
            F.when(own, F.col("bytes_so_far")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
            F.when(own, F.col("digest_so_far")).otherwise(F.col("declared_digest")).alias("payload_digest"),
            "record_type",
            F.col("refers_to").cast("bigint").alias("refers_to"),
            (~own | (F.col("digest_so_far") == F.col("declared_digest"))).alias("digest_holds"),
        )
        out = cut(out, outside=True)
    delete(spark, path)
    return out


ORACLE_SQL = f"""
WITH own AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT payload_digest, min(page_id) AS first_id FROM own WHERE payload_bytes >= {MIN_REVISIT} GROUP BY payload_digest),
kinds AS (SELECT page_id, payload_bytes, own.payload_digest, CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type, first_id FROM own LEFT JOIN firsts ON own.payload_digest = firsts.payload_digest AND payload_bytes >= {MIN_REVISIT})
SELECT page_id, payload_bytes, payload_digest, record_type, CASE WHEN record_type = 'revisit' THEN first_id END AS refers_to, TRUE AS digest_holds FROM kinds
"""
