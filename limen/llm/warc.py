"""WARC archives as a chunked record table.

A payload is a stream of rows (record, chunk number, bytes) of bounded size; each row carries how many bytes and
what digest the record has so far. The payload itself is a cell of the table that is written; beside it, writing and
reading hold a few chunks. In the archive each chunk is a record segment
(WARC 1.1, segmentation): the first has the record's own type, the others are of type continuation. A chunk ends
inside any version line that a payload holds, and never in one that the line end behind a block would complete (nor
does a header line, see target()), so that line parts the records of an archive: Spark's own text reader then streams
archives of any size from any store.

Archives are written by Spark's committed writer, gzipped, each file by one task, so a record's segments follow
each other in one file and reading needs no shuffle.

Defined results: a null payload is empty; records with equal payloads are one response (the smallest id; every row
that has that id) and revisits, which hold no payload and refer to it; payloads shorter than ``least`` are all
responses; a null id is a response that nothing refers to unless its payload has no other id; a null url writes no
target; an empty table writes an empty archive. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, work_dir

VERSION = b"WARC/1.1\r\n"
#: Bytes of a chunk at most.
CHUNK = 1 << 16
#: Chunks that are written at once.
HELD_CHUNKS = 16

CHUNKS = "payload_bytes long, payload_digest string, last boolean, chunk_no int, record_type string, record_id string, refers_to string, data binary"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def chunks(payload: memoryview, most: int = CHUNK) -> Iterator[memoryview]:
    """payload in parts of at most ``most`` bytes, none of which holds a version line; one empty part if empty."""
    at, end = 0, len(payload)
    while True:
        part = bytes(payload[at : min(end, at + most)])
        held = part.find(VERSION)
        stop = at + (held + len(VERSION) - 1 if held >= 0 else len(part))
        if part[: stop - at].endswith(VERSION[:-2]):
            stop -= 1  # the CR LF that follows a block would make it a version line
        yield payload[at:stop]
        at = stop
        if at >= end:
            return


def write_archive(records: DataFrame, path: str, chunk: int = CHUNK) -> None:
    """records: record_type, record_id, url, refers_to, digest (all strings), payload binary (null: empty)."""
    ship(records.sparkSession)

    def run(batches):
        import pyarrow as pa

        from limen.llm.warc import HELD_CHUNKS, segments

        for b in batches:
            for row in range(b.num_rows):
                kind, name, url, refers, digest = (b.column(i)[row].as_py() for i in range(5))
                payload = b.column(5)[row].as_buffer()
                blocks = segments(kind, name, url, refers, digest, memoryview(payload) if payload is not None else memoryview(b""), chunk)
                while some := list(islice(blocks, HELD_CHUNKS)):
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary())], ["block"])

    plain = records.select("record_type", "record_id", "url", "refers_to", "digest", F.coalesce("payload", F.lit(b"")).alias("payload"))
    # the line separator that the writer adds ends the record: CR LF CR LF
    plain.mapInArrow(run, "block binary").select(F.col("block").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def target(url: str) -> str:
    """A url as a header's value: without line ends, and with its last character escaped where the line would end like
    a version line."""
    plain = " ".join(url.split())
    return plain[:-1] + "%31" if plain.endswith("WARC/1.1") else plain


def segments(kind: str, name: str, url: str | None, refers: str | None, digest: str, payload: memoryview, most: int) -> Iterator[bytes]:
    """The segment records of one record, without the CR LF CR LF after each."""
    seen, number = 0, 0
    for part in chunks(payload, most):
        number += 1
        seen += len(part)
        last = seen == len(payload)
        head = [f"WARC-Type: {kind if number == 1 else 'continuation'}", f"WARC-Record-ID: <{name if number == 1 else f'{name}:{number}'}>", "WARC-Date: 1970-01-01T00:00:00Z"]
        if number == 1:
            head += [f"WARC-Payload-Digest: sha1:{digest}"]
            head += [f"WARC-Target-URI: {target(url)}"] if url else []
            head += [f"WARC-Refers-To: <{refers}>"] if refers else []
        else:
            head += [f"WARC-Segment-Origin-ID: <{name}>"]
        if number > 1 or not last:
            head += [f"WARC-Segment-Number: {number}"]
            head += [f"WARC-Segment-Total-Length: {len(payload)}"] if last else []
        yield VERSION + "\r\n".join([*head, "Content-Type: application/octet-stream", f"Content-Length: {len(part)}", "", ""]).encode() + bytes(part)


class Running:
    """Digest and length of the record that a stream of its segments has reached."""

    def __init__(self):
        self.name, self.state, self.bytes, self.number, self.kind, self.refers = None, hashlib.sha1(), 0, 0, "", None

    def take(self, record: bytes) -> tuple | None:
        """(bytes so far, digest so far, last, chunk number, type, record, refers to, data) of one parted record."""
        if not record.strip():
            return None
        head, _, rest = record.partition(b"\r\n\r\n")
        field = {}
        for line in head.split(b"\r\n"):
            k, _, v = line.partition(b":")
            field[k.strip().lower()] = v.strip().decode("utf-8", "replace")
        length = int(field[b"content-length"])
        if length > len(rest):
            raise ValueError(f"record {field.get(b'warc-record-id')}: {len(rest)} of {length} bytes")
        data = rest[:length]
        number = int(field.get(b"warc-segment-number", 1))
        if number == 1:
            self.name, self.state, self.bytes = field[b"warc-record-id"].strip("<>"), hashlib.sha1(), 0
            self.kind, self.refers = field[b"warc-type"], field.get(b"warc-refers-to", "").strip("<>") or None
        elif field.get(b"warc-segment-origin-id", "").strip("<>") != self.name or number != self.number + 1:
            raise ValueError(f"segment {number} of {field.get(b'warc-segment-origin-id')} follows {self.number} of {self.name}")
        self.number = number
        self.state.update(data)
        self.bytes += length
        last = b"warc-segment-number" not in field or b"warc-segment-total-length" in field
        if b"warc-segment-total-length" in field and int(field[b"warc-segment-total-length"]) != self.bytes:
            raise ValueError(f"record {self.name}: {self.bytes} bytes of {field[b'warc-segment-total-length']}")
        return self.bytes, base32(self.state.digest()), last, number - 1, self.kind, self.name, self.refers, data


def read_archive(spark: SparkSession, path: str, data: bool = True) -> DataFrame:
    """The chunk rows of gzipped archives below path. data=False leaves the bytes out of the rows."""
    ship(spark)

    def run(batches):
        import pyarrow as pa

        from limen.llm.warc import Running

        running = Running()
        types = [pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in CHUNKS.split(", ")]
        for b in batches:
            rows = [r[:7] + (r[7] if data else b"",) for x in b.column(0) if (r := running.take(x.as_py()))]
            cols = list(zip(*rows)) if rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    blocks = spark.read.option("lineSep", VERSION.decode()).text(path).select(F.col("value").cast("binary").alias("block"))
    return blocks.mapInArrow(run, CHUNKS)


def payload_digests(df: DataFrame, id_col: str, payload_col: str, chunk: int = CHUNK) -> DataFrame:
    """id, digest, bytes of each payload, by chunks."""
    ship(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches):
        import hashlib

        import pyarrow as pa

        from limen.llm.warc import base32

        for b in batches:
            digests, sizes = [], []
            for x in b.column(1):
                view, state = memoryview(x.as_buffer()), hashlib.sha1()
                for at in range(0, len(view), chunk):
                    state.update(view[at : at + chunk])
                digests.append(base32(state.digest()))
                sizes.append(len(view))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.string()), pa.array(sizes, pa.int64()), b.column(1)], ["id", "digest", "bytes", "payload"])

    return rows.mapInArrow(run, f"id {id_type}, digest string, bytes long, payload binary")


RECORD = "urn:limen:page:"


def archive_pages(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> None:
    """One record per row of df: a response, or a revisit of the response with the same payload."""
    keyed = payload_digests(df.select(F.col(id_col).alias("id"), F.col(payload_col).alias("payload")), "id", "payload")
    firsts = keyed.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.min("id").alias("first"))
    urls = payload_digests(df.select(F.struct(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")).alias("key"), F.col(payload_col).alias("payload")), "key", "payload")
    rows = urls.select("id.id", "id.url", "digest", "bytes", "payload")
    found = rows.join(firsts, ["digest", "bytes"], "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    name = F.concat(F.lit(RECORD), F.coalesce(F.col("id").cast("string"), F.lit("")))
    records = found.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        name.alias("record_id"),
        "url",
        F.when(again, F.concat(F.lit(RECORD), F.col("first").cast("string"))).alias("refers_to"),
        "digest",
        F.when(~again, F.col("payload")).alias("payload"),
    )
    write_archive(records, path)


def page_records(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """Per record read back: page_id, payload_bytes, payload_digest, record_type, refers_to; revisits have the
    length and digest of what they refer to."""
    whole = read_archive(spark, path, data=False).where("last")
    number = lambda c: F.expr(f"try_cast(nullif(substring({c}, {len(RECORD) + 1}), '') as {id_type})")
    rows = whole.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
    kept = rows.where("record_type = 'response'")
    # rows that repeat a response are equal: one stands for them
    known = kept.groupBy(F.col("page_id").alias("_of")).agg(F.struct(F.first("payload_bytes").alias("b"), F.first("payload_digest").alias("d")).alias("_p"))
    again = rows.where("record_type <> 'response'").join(known, F.col("refers_to") == F.col("_of"))
    return kept.unionByName(again.select("page_id", F.col("_p.b").alias("payload_bytes"), F.col("_p.d").alias("payload_digest"), "record_type", "refers_to"))


def round_trip(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    spark = df.sparkSession
    path = work_dir(spark, "warc")
    archive_pages(df, path, id_col, url_col, payload_col)
    return page_records(spark, path, df.schema[id_col].dataType.simpleString())
