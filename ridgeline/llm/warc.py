"""WARC archives and revisit resolution.

``write_pages`` writes one response record for each page.  ``deduplicate`` reads the headers of
such archives (never the payloads), shuffles them by payload digest, makes the newest capture
of each payload the response and turns the others into revisit records, and writes new
archives with fresh record ids and dates.  ``read_archives`` streams archives back, one record
at a time, and ``resolve`` joins revisit records to their responses.

Every record is a gzip member of its own, as archive readers expect.  Files are written by the
tasks; a Parquet index, committed by Spark, says which files and records count.  Archives are
read by pieces of about ``PIECE_BYTES``, so tasks follow the bytes of the archives and not the
number of files.

Defined results: null html is an empty payload and a null url an empty target; payloads are
equal if their SHA-1 and length are; of equal payloads the largest ``page_id`` is the response
(null is smallest), and of rows that share it one, so repeated rows are revisits of one of them;
revisits shorter than ``least_bytes`` are not made; a very long payload is one record, which its
task holds whole; line breaks in a url are percent-encoded; an empty table gives no records;
other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import files
from ridgeline.llm.skew import join_counted
from ridgeline.session import materialize, run_path

LEAST_BYTES = 1000
ROLL_BYTES = 256 << 20
CHUNK = 1 << 20
PIECE_BYTES = 4 << 20  # of an archive, read by one task
GZIP_LEVEL = 6
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "record_id string, record_type string, page_id long, url string, payload_digest string, payload_bytes long, file string, offset long, n_bytes long"
_INDEX_ARROW = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("n_bytes", pa.int64())])
RECORD = "record_id string, record_type string, page_id long, url string, payload_digest string, payload_bytes long, refers_to_id string, warc_date string"
_RECORD_ARROW = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to_id", pa.string()), ("warc_date", pa.string())])


def _one_line(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")


def pack(kind: str, record_id: str, date: str, page_id: int | None, url: str, digest: str, payload: bytes, refers_to: str | None = None) -> bytes:
    """A record as a gzip member; ``digest`` is hexadecimal, of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) if kind == "response" else b""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {_one_line(url)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    packer = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n") + packer.flush()


def unpack(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and payload of an unpacked record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError(f"record {fields['warc-record-id']} has a wrong length")
    return fields, rest[:size].partition(b"\r\n\r\n")[2] if fields["warc-type"] == "response" else rest[:size]


def members(source) -> Iterator[bytes]:
    """Unpacked gzip members of a stream, one at a time."""
    left = b""
    while left or (left := source.read(CHUNK)):
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            parts.append(unpacker.decompress(left))
            if not unpacker.eof and not (left := source.read(CHUNK)):
                raise ValueError("an archive ends inside a record")
        left = unpacker.unused_data
        yield b"".join(parts)


class _Writer:
    """Appends records to files of this task attempt and makes their index rows."""

    def __init__(self, target: str):
        self.store, self.folder = files.open_store(target)
        self.out, self.name, self.at, self.rows = None, "", 0, []

    def add(self, record: bytes, **row) -> None:
        if self.out is None or self.at >= ROLL_BYTES:
            self.close()
            self.store.create_dir(self.folder, recursive=True)
            self.name, self.at = files.attempt_name(TaskContext.get().partitionId(), ".warc.gz"), 0
            self.out = self.store.open_output_stream(f"{self.folder}/{self.name}", compression=None)
        self.out.write(record)
        self.rows.append(row | {"file": self.name, "offset": self.at, "n_bytes": len(record)})
        self.at += len(record)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_pylist(rows, schema=_INDEX_ARROW)


def write_pages(pages: DataFrame, target: str, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write one response record for each row; returns the committed index."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Writer(target)
        try:
            for batch in batches:
                for page_id, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary())):
                    payload, record_id = html.as_py() or b"", f"urn:uuid:{uuid.uuid4()}"
                    digest = hashlib.sha1(payload).hexdigest()
                    out.add(pack("response", record_id, date, page_id, url, digest, payload), record_id=record_id, record_type="response", page_id=page_id, url=url or "", payload_digest=digest, payload_bytes=len(payload))
                yield out.take()
        finally:
            out.close()

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return materialize(rows.mapInArrow(write, INDEX), "warc-index")


def _fresh(record_id: str):
    h = F.md5(F.concat(F.lit("fresh "), F.col(record_id)))
    return F.concat(F.lit("urn:uuid:"), *(x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-") if a < 21 else F.lit(""))))


def decide(index: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Index rows with ``new_id``, and ``refers_to_id`` (a new id) for those that become revisits.

    Only headers move.  The grouping by digest keeps one row for each digest and task; the join
    back is on digests that occur more than once, and those that a large share of all pages
    have are broadcast, so no task gathers the pages of one payload.
    """
    order = F.struct("page_id", "record_id")
    groups = index.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes").agg(F.max(order).alias("original"), F.count("*").alias("n")).where("n > 1")
    joined = join_counted(index, materialize(groups, "equal-payloads"), ["payload_digest", "payload_bytes"]).withColumn("original_id", F.col("original.record_id"))
    revisit = F.col("original_id").isNotNull() & (F.col("original_id") != F.col("record_id"))
    return joined.select(*(F.col(c) for c in index.columns), _fresh("record_id").alias("new_id"), F.when(revisit, _fresh("original_id")).alias("refers_to_id"))


def _piece():
    return F.floor(F.col("offset") / PIECE_BYTES)


def _pieces(index: DataFrame) -> int:
    """How many tasks the archives that ``index`` names are worth."""
    return max(1, -(-(index.agg(F.sum("n_bytes")).first()[0] or 0) // PIECE_BYTES))


def deduplicate(index: DataFrame, source: str, target: str, date: str = "2024-01-02T00:00:00Z", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write archives of responses and revisits from the archives that ``index`` names; returns their index.

    Tasks read the payloads of responses from the old archives by offset; payloads of revisits
    are not read at all, and no payload is shuffled.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = files.open_store(source)
        out, held, opened = _Writer(target), None, ""
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    kind, payload = "revisit" if row["refers_to_id"] else "response", b""
                    if kind == "response":
                        if opened != row["file"]:
                            if held is not None:
                                held.close()
                            held, opened = store.open_input_file(f"{folder}/{row['file']}"), row["file"]
                        _, payload = unpack(zlib.decompress(held.read_at(row["n_bytes"], row["offset"]), 31))
                    record = pack(kind, row["new_id"], date, row["page_id"], row["url"], row["payload_digest"], payload, row["refers_to_id"])
                    out.add(record, record_id=row["new_id"], record_type=kind, **{k: row[k] for k in ("page_id", "url", "payload_digest", "payload_bytes")})
                yield out.take()
        finally:
            out.close()
            if held is not None:
                held.close()

    # A stated number of partitions: left to itself, Spark would size them by the few bytes of the index.
    placed = decide(index, least_bytes).repartition(_pieces(index), "file", _piece()).sortWithinPartitions("file", "offset")
    return materialize(placed.mapInArrow(rewrite, INDEX), "warc-index")


def read_archives(index: DataFrame, source: str) -> DataFrame:
    """The records of the files that ``index`` names, each piece of a file streamed from front to back.

    A response's length and digest are taken from its payload, and the digest must be the one
    in its header; a revisit has no payload, so its length is null.  A piece must hold as many
    records as the index says.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = files.open_store(source)
        for batch in batches:
            for piece in batch.to_pylist():
                rows, n = [], 0
                with store.open_input_file(f"{folder}/{piece['file']}") as whole:
                    for record in members(_Span(whole, piece["first"], piece["past"])):
                        n += 1
                        fields, payload = unpack(record)
                        digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                        full = fields["warc-type"] == "response"
                        if full and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"record {fields['warc-record-id']} has a damaged payload")
                        page_id = fields.get("x-page-id")
                        rows.append({
                            "record_id": fields["warc-record-id"].strip("<>"), "record_type": fields["warc-type"], "page_id": None if page_id is None else int(page_id), "url": fields["warc-target-uri"],
                            "payload_digest": digest, "payload_bytes": len(payload) if full else None, "refers_to_id": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None, "warc_date": fields["warc-date"],
                        })
                        if len(rows) >= 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema=_RECORD_ARROW)
                            rows = []
                if n != piece["n"]:
                    raise ValueError(f"{piece['file']} has {n} records from byte {piece['first']} to {piece['past']}, not {piece['n']}")
                yield pa.RecordBatch.from_pylist(rows, schema=_RECORD_ARROW)

    spans = index.groupBy("file", _piece().alias("piece")).agg(F.min("offset").alias("first"), F.max(F.col("offset") + F.col("n_bytes")).alias("past"), F.count("*").alias("n"))
    return spans.repartition(_pieces(index), "file", "piece").select("file", "first", "past", "n").mapInArrow(read, RECORD)


class _Span:
    """The bytes of an open file between two places."""

    def __init__(self, whole, at: int, past: int):
        self.whole, self.at, self.past = whole, at, past

    def read(self, n: int) -> bytes:
        got = self.whole.read_at(min(n, self.past - self.at), self.at)
        self.at += len(got)
        return got


def resolve(records: DataFrame) -> DataFrame:
    """Records with ``refers_to`` (the response's page id) and the full payload's length for revisits."""
    responses = records.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", "record_id", F.lit(None).cast("long").alias("refers_to"))
    revisits = records.where("record_type = 'revisit'")
    wanted = revisits.groupBy("refers_to_id").agg(F.count("*").alias("n"))
    originals = responses.select(F.col("record_id").alias("refers_to_id"), F.col("payload_bytes").alias("full_bytes"), F.col("page_id").alias("original"))
    found = materialize(wanted.join(originals, "refers_to_id"), "originals")
    resolved = join_counted(revisits.drop("payload_bytes"), found, ["refers_to_id"])
    return responses.unionByName(resolved.select("page_id", F.col("full_bytes").alias("payload_bytes"), "payload_digest", "record_type", "record_id", F.col("original").alias("refers_to")))


def round_trip(spark: SparkSession, pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Pages to archives, to deduplicated archives, and the resolved records read back from those."""
    first, second = run_path(spark, "warc-pages"), run_path(spark, "warc-deduplicated")
    index = deduplicate(write_pages(pages, first), first, second, least_bytes=least_bytes)
    return resolve(materialize(read_archives(index, second), "warc-records"))


#: DuckDB SQL over ``pages`` for ``page_id, payload_bytes, payload_digest, record_type, refers_to``.
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
o AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS original FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id <> original THEN original END AS refers_to
FROM o
"""
