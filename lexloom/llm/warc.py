"""WARC archives written and read as a chunked record table.

A payload is cut into chunks of CHUNK_CHARS code points, and each chunk is one WARC record: the first is the response, the
rest are `continuation` records of the same origin with a segment number (WARC 1.1 record segmentation).  So no record is
large, whatever the page.  Spark's text writer puts the records down with the record terminator as line separator, commits
them task by task and starts a new file after FILE_RECORDS records, which bounds a file to FILE_RECORDS * CHUNK_CHARS * 4 bytes.

Every page row has a record id of its own (a random UUID, the origin of its continuations), so rows with one page id or
without one stay apart; the page ids stand in header fields of their own (Page-ID, Refers-To-Page-ID).  Reading gives rows
(record_id, chunk_no, chunk).  Chunks of one record meet sorted by number and are digested one after another; a record of
one chunk needs no exchange.

Of records with equal payloads the one with the largest page_id is the response and the others are revisits without a
payload of their own.  Null html: empty payload.  A null id is written as a response of its own and never referred to;
repeated rows with one id and one payload are written once for each row, as responses if the id is the largest.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.shared import join_small, pick, settle

CHUNK_CHARS, FILE_RECORDS = 1 << 16, 256
_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SCHEMA = "record_id string, page_id long, record_type string, refers_to long, declared_digest string, chunk_no int, chunks int, chunk binary"


def base32_sha1(text: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of the UTF-8 bytes: four groups of 40 bits."""
    h = F.sha1(text.cast("binary"))
    groups = [F.lpad(F.conv(F.substring(h, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), _HEX32, _BASE32)


def plan_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, digest, record_type, refers_to."""
    rows = pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload")))
    big = F.octet_length("payload") >= least_bytes
    best = settle(rows.where(big & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max("page_id").alias("best"), F.count("*").alias("n")).where("n > 1").drop("n"), "payload-owners")
    joined = join_small(rows, best, ["digest"], "left")
    revisit = F.coalesce(big & (F.col("page_id") < F.col("best")), F.lit(False))
    return joined.select("page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("best")).alias("refers_to"))


def write_archives(records: DataFrame, path: str) -> None:
    """Valid uncompressed WARC files under `path`."""
    body = F.when(F.col("record_type") == "revisit", "").otherwise(F.col("payload"))
    pieces = F.when(F.length(body) > CHUNK_CHARS, F.regexp_extract_all(body, F.lit(rf"(?s).{{1,{CHUNK_CHARS}}}"), F.lit(0))).otherwise(F.array(body))  # one pass over the payload
    df = records.select("page_id", "url", "digest", "record_type", "refers_to", F.octet_length("payload").alias("bytes"), F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")).alias("record_id"), pieces.alias("pieces"))
    df = df.withColumn("chunks", F.size("pieces"))
    df = df.select("page_id", "url", "digest", "record_type", "refers_to", "bytes", "record_id", "chunks", F.posexplode("pieces").alias("no", "chunk"))
    one_line = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ")
    field = lambda key, value, when=None: F.when(F.lit(True) if when is None else when, F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))).otherwise("")
    first, many = F.col("no") == 0, F.col("chunks") > 1
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        field("WARC-Type", F.when(first, F.col("record_type")).otherwise("continuation")),
        field("WARC-Record-ID", F.when(first, F.col("record_id")).otherwise(F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")))),
        field("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        field("WARC-Target-URI", one_line),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")), first),
        field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), F.col("record_type") == "revisit"),
        field("Page-ID", F.col("page_id").cast("string"), first & F.col("page_id").isNotNull()),
        field("Refers-To-Page-ID", F.col("refers_to").cast("string"), F.col("record_type") == "revisit"),
        field("WARC-Segment-Number", (F.col("no") + 1).cast("string"), many),
        field("WARC-Segment-Origin-ID", F.col("record_id"), ~first),
        field("WARC-Segment-Total-Length", F.col("bytes").cast("string"), many & (F.col("no") + 1 == F.col("chunks"))),
        field("Content-Type", F.lit("text/html; charset=utf-8")),
        field("Content-Length", F.octet_length("chunk").cast("string")),
        F.lit("\r\n"),
    )
    df.select(F.concat(head, F.col("chunk")).alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse_warc(data: memoryview) -> Iterator[tuple[dict[str, str], memoryview]]:
    """(header fields, block) of each record of an uncompressed WARC file."""
    at, whole = 0, bytes(data)
    while at < len(whole):
        end = whole.index(b"\r\n\r\n", at)
        lines = whole[at:end].decode("utf-8").split("\r\n")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        size = int(fields["Content-Length"])
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def _number(text: str | None) -> int | None:
    return int(text) if text else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for fields, block in parse_warc(memoryview(content.as_buffer())):
                more = fields["WARC-Type"] == "continuation"
                name = fields["WARC-Segment-Origin-ID"] if more else fields["WARC-Record-ID"]
                number = int(fields.get("WARC-Segment-Number", 1))
                rows.append((name, _number(fields.get("Page-ID")), None if more else fields["WARC-Type"], _number(fields.get("Refers-To-Page-ID")), fields.get("WARC-Payload-Digest", "")[5:] or None, number, 2 if "WARC-Segment-Number" in fields else 1, bytes(block)))
                if len(rows) >= 64:
                    yield _chunk_rows(rows)
                    rows = []
            if rows:
                yield _chunk_rows(rows)


def _chunk_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["record_id", "page_id", "record_type", "refers_to", "declared_digest", "chunk_no", "chunks", "chunk"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The chunked record table: record_id, page_id, record_type, refers_to, declared_digest (these four: first chunk only), chunk_no, chunks (2: several), chunk."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("content").mapInArrow(_read, SCHEMA)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by record and number; one hash state is carried along."""
    out: list[tuple] = []
    head, state, size = None, None, 0

    def close() -> None:
        if head is not None:
            own = head[2] == "response"
            computed = base64.b32encode(state.digest()).decode() if own else head[4]
            out.append((head[1], size if own else None, computed, head[2], head[3]))

    def rows() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("record_id", "page_id", "record_type", "refers_to", "declared_digest")), batch.column("chunk"), strict=True):
            if head is None or row[0] != head[0]:
                close()
                head, state, size = row, hashlib.sha1(), 0
            data = row[5].as_buffer()
            state.update(data)
            size += data.size
        if len(out) >= 1024:
            yield rows()
            out = []
    close()
    if out:
        yield rows()


def summarise(chunks: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record read; a revisit has those of its response."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    single = chunks.where("chunks = 1").mapInArrow(_digest, schema)
    several = chunks.where("chunks > 1").repartition("record_id").sortWithinPartitions("record_id", "chunk_no").mapInArrow(_digest, schema)
    records = settle(single.unionByName(several), "records")
    owner = records.where("record_type = 'response' AND page_id IS NOT NULL").groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("owner_digest")).agg(F.max("payload_bytes").alias("owner_bytes"))
    owner = settle(owner, "responses")
    revisits = records.where("record_type = 'revisit'").join(owner, (records["refers_to"] == owner["refers_to"]) & (records["payload_digest"] == owner["owner_digest"]), "left")
    told = revisits.select(records["page_id"], owner["owner_bytes"].alias("payload_bytes"), "payload_digest", "record_type", records["refers_to"])
    return records.where("record_type = 'response'").unionByName(told)
