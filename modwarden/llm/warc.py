"""WARC archives through a table of payload chunks.

A record's payload is a set of rows ``(record id, chunk number, bytes)``, so a payload of any size is written
and read in pieces: digests are carried from chunk to chunk and no task holds a whole record. Writing tasks
stream chunk rows, in order, into gzip members of one archive file each, under a temporary name that is renamed
when complete; a repeated task writes the same file again. Files are reached through ``pyarrow.fs``, so the
folder may be in any store it knows. Readers stream the archives back into chunk rows.

Of records with equal payloads the one with the smallest id is the response and the others revisit it.

Defined results: a null payload counts as empty; an empty table gives no archive; payloads below ``least`` bytes are never revisits; rows without
an id are left out, and of rows with one id every one is written, as its own record; a null target is empty.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modwarden.session import materialize, shared_dir

CHUNK = 256 * 1024
LEAST = 100
_READ = 1 << 20
RESPONSE, REVISIT = "response", "revisit"
# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CHUNKS = "page_id bigint, chunk int, last boolean, record_type string, refers_to bigint, url string, payload_bytes bigint, payload_digest string, running_bytes bigint, data binary"


def planned(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST) -> DataFrame:
    """One row per record: its type, the response it refers to, size and digest of the payload, and the payload of responses."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"),
        F.octet_length(payload).cast("bigint").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"),
    )
    # Only digests and ids are grouped; a payload moves when its record is written.
    narrow = materialize(rows.select("page_id", "payload_digest", "payload_bytes").filter(F.col("payload_bytes") >= least), "digests")
    first = narrow.groupBy(F.col("payload_digest").alias("digest")).agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    revisits = narrow.join(first, F.col("payload_digest") == F.col("digest")).filter("page_id > first_id").select(F.col("page_id").alias("_rid"), F.col("first_id").alias("refers_to"), F.col("digest").alias("_rdigest")).distinct()
    joined = rows.join(revisits, (F.col("page_id") == F.col("_rid")) & (F.col("payload_digest") == F.col("_rdigest")), "left")
    kind = F.when(F.col("refers_to").isNotNull(), REVISIT).otherwise(RESPONSE)
    return joined.select("page_id", "url", kind.alias("record_type"), "refers_to", "payload_bytes", "payload_digest", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"))


def chunked(records: DataFrame, size: int = CHUNK) -> DataFrame:
    """The record table as chunk rows, each record's in a row; a record without payload is one empty chunk."""
    n = F.greatest(F.lit(1), F.ceil(F.coalesce(F.length("payload"), F.lit(0)) / size)).cast("int")
    rows = records.withColumn("chunks", n)
    flat = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    data = F.coalesce(F.expr(f"substring(payload, chunk * {size} + 1, {size})"), F.lit(b""))
    return flat.select("page_id", "chunk", (F.col("chunk") == F.col("chunks") - 1).alias("last"), "url", "record_type", "refers_to", "payload_bytes", "payload_digest", data.alias("data"))


def _header(row: dict, length: int) -> bytes:
    lines = [
        VERSION, f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <urn:page:{row['page_id']}>", f"WARC-Target-URI: {(row['url'] or '').translate(_BREAKS)}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{row['payload_digest']}", f"X-Payload-Length: {row['payload_bytes']}",
    ]
    if row["record_type"] == REVISIT:
        lines += [f"WARC-Refers-To: <urn:page:{row['refers_to']}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join([*lines, "Content-Type: text/html", f"Content-Length: {length}", "", ""]).encode()


_BREAKS = {10: "%0A", 13: "%0D"}


def _rows(batch: pa.RecordBatch):
    names = batch.schema.names
    for values in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
        yield dict(zip(names, values, strict=True))


def _writer(folder: str, level: int):
    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        name = uuid.uuid4().hex
        out = pack = digest = None
        records = total = 0
        for batch in batches:
            for row in _rows(batch):
                if out is None:
                    out = fs.open_output_stream(f"{root}/{name}.tmp")
                if row["chunk"] == 0:
                    records += 1
                    pack, digest = zlib.compressobj(level, zlib.DEFLATED, 31), hashlib.sha256()
                    length = 0 if row["record_type"] == REVISIT else row["payload_bytes"]
                    out.write(pack.compress(_header(row, length)))
                digest.update(row["data"])
                out.write(pack.compress(row["data"]))
                if row["last"]:
                    if row["record_type"] == RESPONSE and digest.hexdigest() != row["payload_digest"]:
                        raise ValueError(f"page {row['page_id']}: the chunks do not make up its payload")
                    out.write(pack.compress(b"\r\n\r\n") + pack.flush())
        if out is None:
            return
        total = out.tell()
        out.close()
        fs.move(f"{root}/{name}.tmp", f"{root}/{name}.warc.gz")
        yield pa.RecordBatch.from_arrays([pa.array([f"{name}.warc.gz"]), pa.array([records]), pa.array([total])], ["file", "records", "bytes"])

    return run


def write(records: DataFrame, folder: str, chunk: int = CHUNK, level: int = 1) -> DataFrame:
    """Archives of all records in ``folder``; returns the manifest ``(file, records, bytes)``, the files that count.

    Chunk rows are made where their record is, one record after the other, so they reach the writer in order
    without a shuffle. Files that a lost or repeated task left are in no manifest.
    """
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    return materialize(chunked(records, chunk).mapInArrow(_writer(folder, level), "file string, records bigint, bytes bigint"), "manifest")


class _Stream:
    """Decompressed bytes of an archive of gzip members, read in pieces."""

    def __init__(self, source):
        self.source, self.pack, self.held, self.more = source, zlib.decompressobj(31), bytearray(), b""

    def fill(self) -> bool:
        raw = self.more or self.source.read(_READ)
        if not raw:
            return False
        # A member's output is bounded too: what is left of the input waits.
        self.held += self.pack.decompress(raw, _READ)
        if self.pack.eof:
            self.more, self.pack = self.pack.unused_data, zlib.decompressobj(31)
        else:
            self.more = self.pack.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes:
        while (at := self.held.find(mark)) < 0:
            if not self.fill():
                return b""
        out = bytes(self.held[: at + len(mark)])
        del self.held[: at + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while not self.held and self.fill():
            pass
        out = bytes(self.held[:n])
        del self.held[: len(out)]
        return out


def records_of(source, size: int = CHUNK):
    """Chunk rows of one archive: header fields, bytes so far, and on the last chunk the digest of all of them."""
    stream = _Stream(source)
    while head := stream.until(b"\r\n\r\n"):
        lines = head.decode().split("\r\n")
        if lines[0] != VERSION:
            raise ValueError(f"not a record: {lines[0]!r}")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:] if x)}
        number = lambda v: int(v.removeprefix("<urn:page:").removesuffix(">")) if v else None
        left, done, chunk, digest = int(fields["content-length"]), 0, 0, hashlib.sha256()
        while True:
            data = bytearray()
            while len(data) < min(size, left):
                part = stream.take(min(size, left) - len(data))
                if not part:
                    raise ValueError("the archive ends early")
                data += part
            left, done = left - len(data), done + len(data)
            digest.update(data)
            kind = fields["warc-type"]
            named = fields["warc-payload-digest"].removeprefix("sha256:")
            if not left and kind == RESPONSE and digest.hexdigest() != named:
                raise ValueError(f"record {fields['warc-record-id']}: the payload does not match its digest")
            yield (
                number(fields["warc-record-id"]), chunk, not left, kind, number(fields.get("warc-refers-to", "")), fields["warc-target-uri"],
                done if kind == RESPONSE else int(fields["x-payload-length"]), digest.hexdigest() if kind == RESPONSE else named, done, bytes(data),
            )
            if not left:
                break
            chunk += 1
        if stream.until(b"\r\n\r\n") != b"\r\n\r\n":
            raise ValueError("a record does not end where it should")


def read(manifest: DataFrame, folder: str, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """Chunk rows of all archives in the manifest; ``payload_bytes`` and ``payload_digest`` are final on the last chunk.

    A revisit has one empty chunk and names size and digest of the payload it stands for.
    """
    schema = pa.schema([("page_id", pa.int64()), ("chunk", pa.int32()), ("last", pa.bool_()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("running_bytes", pa.int64()), ("data", pa.binary())])

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                held, size = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as source:
                    for row in records_of(source, chunk):
                        held.append(row if with_data else (*row[:-1], None))
                        size += 200 + (len(row[-1]) if with_data else 0)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    files = manifest.select("file").repartition(max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "file")
    return files.mapInArrow(run, CHUNKS)


def round_trip(pages: DataFrame, folder: str | None = None, **columns) -> DataFrame:
    """Writes the pages as archives and reads them back: one row per record."""
    folder = folder or shared_dir(pages.sparkSession, "warc")
    back = read(write(planned(pages, **columns), folder), folder, with_data=False)
    return back.filter("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
