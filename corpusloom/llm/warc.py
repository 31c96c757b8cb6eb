"""WARC archives as a chunked record table.

Payloads go to and from archives as rows of record and chunk number. Writer and reader hold one chunk of a
record and keep a running digest over its chunks: the writer's must come to what the record's head declares,
the reader gives its digest and length up to and with each chunk in that chunk's row.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import partitions, shared_dir, table, written
from corpusloom.llm.files import new_file, opened

CHUNK = 1 << 16
#: Digests that several pages share are broadcast up to so many; beyond that pages are shuffled by their digest.
BROADCAST_ROWS = 1_000_000
#: A task starts a new archive beyond so many bytes.
ARCHIVE_BYTES = 1 << 30
_BLOCK = 1 << 18


def sha1_name(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def assigned(pages: DataFrame, page_id: str = "page_id", payload: str = "html", uri: str = "url", least: int = 0) -> DataFrame:
    """(record_id, uri, payload binary, sha1 hex, n_bytes, refers_to) for every row.

    Rows with equal payloads of at least `least` bytes refer to the least page_id among them; refers_to is null
    for the responses. A null payload is empty. Rows with the same page_id and payload (repeats) are all
    responses if that id is the least; a row with a null page_id refers to the least that is not null, and if there is none
    all are responses. A payload may be as long as a row of the table allows. No rows, no records; columns other than the
    three named are not read.
    """
    p = pages.select(F.col(page_id).alias("record_id"), F.coalesce(F.col(uri).cast("string"), F.lit("")).alias("uri"), F.coalesce(F.encode(F.col(payload), "UTF-8"), F.lit(b"")).alias("payload"))
    p = p.withColumns({"sha1": F.sha1("payload"), "n_bytes": F.octet_length("payload").cast("long")})
    # Only a payload's least id and count are aggregated, combined before the shuffle, and those that several rows share
    # are sent to the rows, so that payloads stay where they are. Too many of them are joined by an exchange of their own,
    # so that adaptive execution can split a payload that many rows share.
    groups = p.where(F.col("n_bytes") >= least).groupBy("sha1", "n_bytes").agg(F.min("record_id").alias("first"), F.count("*").alias("n"))
    shared = written(groups.where("n > 1 and first is not null").select("sha1", "n_bytes", "first"), "payloads")
    joined = p.join(F.broadcast(shared) if shared.count() <= BROADCAST_ROWS else shared, ["sha1", "n_bytes"], "left")
    return joined.withColumn("refers_to", F.when(~F.col("first").eqNullSafe(F.col("record_id")), F.col("first"))).drop("first")


def chunked(records: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    """A row per record and chunk of its payload; empty payloads and revisits have one empty chunk."""
    n = F.when(F.col("refers_to").isNull(), F.greatest(F.ceil(F.col("n_bytes") / chunk_bytes), F.lit(1))).otherwise(F.lit(1)).cast("int")
    rows = records.withColumn("n_chunks", n).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
    piece = F.when(F.col("refers_to").isNull(), F.substring(F.col("payload"), F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes))).otherwise(F.lit(b""))
    return rows.select("record_id", "uri", "sha1", "n_bytes", "refers_to", "chunk_no", "n_chunks", piece.alias("chunk"))


def _head(row: dict) -> bytes:
    revisit, rid = row["refers_to"] is not None, "" if row["record_id"] is None else row["record_id"]
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{rid}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {row['uri'].translate({10: '%0A', 13: '%0D'})}",
        f"WARC-Payload-Digest: sha1:{sha1_name(bytes.fromhex(row['sha1']))}",
        f"X-Payload-Length: {row['n_bytes']}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {0 if revisit else row['n_bytes']}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{row['refers_to']}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*lines, "", ""]).encode("utf-8", "surrogatepass")


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, uri, packer, sha, size, records, done = None, "", None, None, 0, 0, []

        def closed() -> None:
            nonlocal out, size, records
            out.close()
            done.append((uri, records, size))
            out, size, records = None, 0, 0

        def put(data: bytes) -> None:
            nonlocal size
            size += len(data)
            out.write(data)

        for batch in batches:
            for i in range(batch.num_rows):
                no, of = batch["chunk_no"][i].as_py(), batch["n_chunks"][i].as_py()
                if no == 0:
                    if out is None:
                        system, path, uri = new_file(folder, ".warc.gz")
                        out = system.open_output_stream(path)
                    packer, sha = zlib.compressobj(3, zlib.DEFLATED, 31), hashlib.sha1()
                    put(packer.compress(_head({k: batch[k][i].as_py() for k in ("record_id", "uri", "sha1", "n_bytes", "refers_to")})))
                chunk = batch["chunk"][i].as_buffer()
                sha.update(chunk)
                put(packer.compress(chunk))
                if no == of - 1:
                    if batch["refers_to"][i].as_py() is None and sha.hexdigest() != batch["sha1"][i].as_py():
                        raise ValueError("a record's chunks differ from its digest")
                    put(packer.compress(b"\r\n\r\n") + packer.flush())
                    records += 1
                    if size >= ARCHIVE_BYTES:
                        closed()
        if out is not None:
            closed()
        yield pa.record_batch([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    return write


def write_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """Writes the chunk rows (each record's together and in order) as gzipped WARC archives; (path, records, bytes) of those that count.

    Only archives in the returned, committed table count: what a lost or repeated task left is never read.
    """
    return written(chunks.mapInArrow(_writer(folder), "path string, records long, bytes long"), "archives")


class _Stream:
    """The unpacked bytes of an archive, a block at a time."""

    def __init__(self, file) -> None:
        self.file, self.rest, self.packed, self.unpacker = file, b"", b"", None

    def more(self) -> bool:
        while True:
            if not self.packed:
                self.packed = self.file.read(_BLOCK)
                if not self.packed:
                    return False
            self.unpacker = self.unpacker or zlib.decompressobj(31)
            data = self.unpacker.decompress(self.packed, _BLOCK)
            self.packed = self.unpacker.unconsumed_tail
            if self.unpacker.eof:
                self.packed, self.unpacker = self.unpacker.unused_data, None
            if data:
                self.rest += data
                return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.rest.find(mark)) < 0:
            if not self.more():
                return None
        data, self.rest = self.rest[:at], self.rest[at + len(mark) :]
        return data

    def take(self, n: int) -> bytes:
        """Up to n bytes; fewer only at the end of a block."""
        if not self.rest and not self.more():
            raise EOFError("the archive ends within a record")
        data, self.rest = self.rest[:n], self.rest[n:]
        return data


_FIELDS = [("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("uri", pa.string()), ("declared_digest", pa.string()), ("declared_bytes", pa.int64()), ("chunk_no", pa.int32()), ("last", pa.bool_()), ("bytes_so_far", pa.int64()), ("sha1_so_far", pa.string()), ("chunk", pa.binary())]
CHUNK_SCHEMA = "record_id string, record_type string, refers_to string, uri string, declared_digest string, declared_bytes long, chunk_no int, last boolean, bytes_so_far long, sha1_so_far string, chunk binary"


def _reader(chunk_bytes: int, keep: bool):
    def rows(stream: _Stream) -> Iterator[tuple]:
        while (head := stream.until(b"\r\n\r\n")) is not None:
            h = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
            name = lambda k: h[k][len("<urn:page:") : -1] if k in h else None
            left, sha, seen, no = int(h["Content-Length"]), hashlib.sha1(), 0, 0
            while True:
                parts, want = [], min(chunk_bytes, left)
                while want:
                    parts.append(stream.take(want))
                    want -= len(parts[-1])
                piece = b"".join(parts)
                left, seen = left - len(piece), seen + len(piece)
                sha.update(piece)
                yield (name("WARC-Record-ID"), h["WARC-Type"], name("WARC-Refers-To"), h["WARC-Target-URI"], h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"]), no, not left, seen, sha1_name(sha.copy().digest()), piece if keep else None)
                no += 1
                if not left:
                    break
            if stream.until(b"\r\n\r\n") is None:
                raise EOFError("the archive ends within a record")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch["path"].to_pylist():
                system, path = opened(uri)
                with system.open_input_stream(path) as file:
                    held, size = [], 0
                    for row in rows(_Stream(file)):
                        held.append(row)
                        size += len(row[-1] or b"")
                        if len(held) >= 4096 or size >= 1 << 23:
                            yield pa.record_batch([pa.array(x, t) for x, (_, t) in zip(zip(*held), _FIELDS)], [n for n, _ in _FIELDS])
                            held, size = [], 0
                    if held:
                        yield pa.record_batch([pa.array(x, t) for x, (_, t) in zip(zip(*held), _FIELDS)], [n for n, _ in _FIELDS])

    return read


def read_archives(archives: DataFrame, chunk_bytes: int = CHUNK, payloads: bool = True) -> DataFrame:
    """The chunked record table of the archives: a row per record and chunk, in CHUNK_SCHEMA.

    bytes_so_far and sha1_so_far cover the payload up to and with the row's chunk, so the row with last
    has those of the whole; a task never holds more of a record than a chunk.
    """
    spread = archives.select("path").repartition(partitions(archives.sparkSession), "path")
    return spread.mapInArrow(_reader(chunk_bytes, payloads), CHUNK_SCHEMA)


def summary(chunks: DataFrame) -> DataFrame:
    """A row per record: a response's length and digest as read, a revisit's as declared."""
    own = F.col("record_type") == "response"
    digest = F.when(own, F.col("sha1_so_far")).otherwise(F.col("declared_digest"))
    ids = [F.when(F.col(c) != "", F.col(c)).try_cast("long").alias(n) for c, n in (("record_id", "page_id"), ("refers_to", "refers_to"))]
    whole = chunks.where("last").withColumn("digest", F.when(own & (F.col("declared_digest") != F.col("sha1_so_far")), F.raise_error(F.lit("a payload differs from its digest"))).otherwise(digest))
    return whole.select(ids[0], F.when(own, F.col("bytes_so_far")).otherwise(F.col("declared_bytes")).alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", ids[1])


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages to WARC archives and reads them back."""
    records = assigned(table(spark, sf_dir, "pages"))
    archives = write_archives(chunked(records), shared_dir(spark, "warc"))
    return summary(read_archives(archives, payloads=False))


_HEX = "upper(sha1(encode(coalesce(html, ''))))"
_BASE32 = "list_aggregate(list_transform(range(8), lambda j: list_aggregate(list_transform(range(4), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 5 * j + 1, 5))::BIGINT >> (15 - 5 * k)) & 31)::INT, 1)), 'string_agg', '')), 'string_agg', '')"
ORACLE = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, {_HEX} AS hex FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM q
"""
