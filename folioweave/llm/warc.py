"""WARC archives: written in segments with chunked bodies, read back, reassembled and verified.

Archives are text files that Spark writes and reads, so they can lie in any store that Spark reaches: each row is a
record without its last line break, and CRLF parts the rows.
"""

from __future__ import annotations

import re
from base64 import b32encode
from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.llm.shared import SharedTables, pieces, text_or_empty

#: Bytes of an HTTP chunk, of a record's block before it goes on in the next segment; records of an archive file, which
#: so has about 64 MB at most before compression.
CHUNK, SEGMENT, RECORDS = 8_192, 65_536, 1_000
#: Payloads of fewer bytes are never revisited.
LEAST = 0
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_FORMAT = "version string, headers map<string,string>, block binary"
_DATE = "2000-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """Base32 SHA-1."""
    return b32encode(sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing."""
    parts = [b"%x\r\n%s\r\n" % (len(p := payload[a : a + size]), p) for a in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are skipped, a framing error raises ValueError."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk without an end")
        out.append(body[at : at + size])
        at += size + 2


def record(headers: dict[str, str | int], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return b"WARC/1.0\r\n%sContent-Length: %d\r\n\r\n%s\r\n\r\n" % (head.encode(), len(block), block)


def records_of(key: str, url: str | None, payload: bytes, refers: str | None, segment: int = SEGMENT) -> list[bytes]:
    """A page's records: a revisit, or a response and as many continuations as its block needs."""
    about = {"WARC-Record-ID": f"<urn:fw:{key}>", "WARC-Date": _DATE}
    if url is not None and not re.search(r"[\x00-\x1f]", url):
        about["WARC-Target-URI"] = url
    about["WARC-Payload-Digest"] = f"sha1:{digest(payload)}"
    if refers is not None:
        return [record({"WARC-Type": "revisit", **about, "WARC-Refers-To": f"<urn:fw:{refers}>", "WARC-Profile": "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"}, b"")]
    block = _HTTP + chunked(payload)
    parts = [block[a : a + segment] for a in range(0, len(block), segment)]
    if len(parts) == 1:
        return [record({"WARC-Type": "response", **about, "Content-Type": "application/http;msgtype=response"}, block)]
    out = [record({"WARC-Type": "response", **about, "Content-Type": "application/http;msgtype=response", "WARC-Segment-Number": 1}, parts[0])]
    for k, part in enumerate(parts[1:], 2):
        last = {"WARC-Segment-Total-Length": len(block)} if k == len(parts) else {}
        out.append(record({"WARC-Type": "continuation", "WARC-Record-ID": f"<urn:fw:{key}.{k}>", "WARC-Date": _DATE, "WARC-Segment-Origin-ID": f"<urn:fw:{key}>", "WARC-Segment-Number": k, **last}, part))
    return out


def parse(data: bytes) -> Iterator[tuple[str, dict[str, str], bytes]]:
    """(version, headers, block) of the records of an archive. A malformed record raises ValueError."""
    at = 0
    while at < len(data):
        if data.startswith(b"\r\n", at):
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no record at byte {at}")
        version, *lines = data[at:end].decode().split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines)
        stop = end + 4 + int(headers["Content-Length"])
        if stop > len(data) or data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut short")
        yield version, headers, data[end + 4 : stop]
        at = stop + 4


def write_archives(tables: SharedTables, pages: DataFrame, least: int = LEAST) -> str:
    """Writes a record per page (page_id, url, payload as binary; long ones in segments) and returns the archives' folder.

    Of pages with equal payloads of at least `least` bytes the one with the largest page_id is the response (a null id
    is the smallest; of rows with equal ids one), the others revisit it.
    """
    source = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", F.col("page_id").cast("long").alias("_n"))

    keyed = source.withColumn("key", F.concat_ws("-", F.coalesce("page_id", F.lit("null")), F.monotonically_increasing_id()))
    keyed = tables.write(keyed.withColumn("bytes", F.length("payload").cast("long")), "keyed")
    slim = tables.write(keyed.select("key", "_n", "bytes", F.unhex(F.sha1("payload")).alias("sha1")), "sums")
    best = F.max(F.struct("_n", "key")).alias("best")
    same = slim.where(F.col("bytes") >= least).groupBy("sha1", "bytes").agg(best, F.count("*").alias("n")).where("n > 1")
    same = tables.write(same.select("sha1", "bytes", F.col("best.key").alias("first")), "same")
    refers = slim.join(same, ["sha1", "bytes"]).where("key <> first").select("key", F.col("first").alias("refers"))
    refers = tables.write(refers, "refers")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "payload"):
            columns = [batch.column(c).to_pylist() for c in ("key", "url", "payload", "refers")]
            rows = [r[:-2] for x in zip(*columns, strict=True) for r in records_of(*x)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["value"])

    whole = keyed.select("key", "url", "payload").join(refers, "key", "left").mapInArrow(build, "value binary")
    at = tables.path("warc")
    # the bytes go as they are; the text writer ends each record with the line break that it still lacks
    (
        whole.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\r\n")
        .option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(at)
    )
    tables.drop(keyed, slim, same, refers)
    return at


def read_archives(spark: SparkSession, at: str) -> DataFrame:
    """(version, headers, block) of every record in the folder's archives, gzip or plain; a file at a time in a task."""
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                data = content.as_py()
                if data[:2] == b"\x1f\x8b":
                    members = []
                    while data:
                        d = zlib.decompressobj(31)
                        members.append(d.decompress(data))
                        data = d.unused_data
                    data = b"".join(members)
                rows = list(parse(data))
                for a in range(0, len(rows), 256):
                    part = rows[a : a + 256]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[0] for r in part]), pa.array([list(r[1].items()) for r in part], pa.map_(pa.string(), pa.string())), pa.array([r[2] for r in part], pa.binary())],
                        names=["version", "headers", "block"],
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(at).select("content")
    return files.mapInArrow(run, _FORMAT)


def reassemble(records: DataFrame) -> DataFrame:
    """(record_id, type, refers_to, stated, payload): continuations joined to their origins, framing decoded.

    Records of one segment pass by; the others meet by origin identifier, are ordered by segment number, and must be
    numbered without gaps and have the total length that the last one states: else the query fails. payload is null
    for revisits.
    """
    h = lambda name: F.col("headers")[f"WARC-{name}"]
    r = records.select(
        h("Record-ID").alias("id"), h("Type").alias("type"), h("Refers-To").alias("refers_to"), h("Payload-Digest").alias("stated"),
        h("Segment-Number").cast("int").alias("segment"), h("Segment-Origin-ID").alias("origin"), h("Segment-Total-Length").cast("long").alias("total"), "block",
    )
    kept = ["id", "type", "refers_to", "stated", "blocks"]
    one = r.where("segment IS NULL").withColumn("blocks", F.array("block")).select(kept)
    many = (
        r.where("segment IS NOT NULL")
        .groupBy(F.coalesce("origin", "id").alias("id"))
        .agg(
            F.max(F.when(F.col("segment") == 1, F.col("type"))).alias("type"),
            F.max(F.when(F.col("segment") == 1, F.col("stated"))).alias("stated"),
            F.max("total").alias("total"),
            F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"),
        )
        .withColumn("size", F.aggregate("parts.block", F.lit(0).cast("long"), lambda s, x: s + F.length(x)))
    )
    numbers = F.col("parts.segment") == F.sequence(F.lit(1), F.size("parts"))
    sound = numbers & (F.col("size") == F.col("total")) & F.col("type").isNotNull()
    broken = F.raise_error(F.concat(F.lit("segments of "), F.col("id"), F.lit(" are incomplete"))).cast("array<binary>")
    many = many.withColumns({"blocks": F.when(sound, F.col("parts.block")).otherwise(broken), "refers_to": F.lit(None).cast("string")}).select(kept)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = []
            for i, (kind, stated) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("type", "stated")), strict=True)):
                if kind == "revisit":
                    payloads.append(None)
                    continue
                block = b"".join(batch.column("blocks")[i].as_py())  # the segments meet once, whatever their number
                head, _, body = block.partition(b"\r\n\r\n")
                payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                if stated and stated != f"sha1:{digest(payload)}":
                    raise ValueError("payload and digest differ")
                payloads.append(payload)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "type", "refers_to", "stated")), pa.array(payloads, pa.binary())], names=["record_id", "type", "refers_to", "stated", "payload"])

    return one.unionByName(many).mapInArrow(decode, "record_id string, type string, refers_to string, stated string, payload binary")


def page_of(record_id: str):
    """The page_id in a record identifier that write_archives made."""
    return F.nullif(F.regexp_extract(record_id, r"<urn:fw:(.*)-\d+>", 1), F.lit("null")).cast("long")


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: written as archives and read back.

    Null html is the empty payload; payload_bytes and payload_digest are of the full payload, for a revisit those of
    its response. Rows that repeat page_id and html are records of their own. An empty table gives no record.
    """
    tables = SharedTables(pages.sparkSession)
    at = write_archives(tables, pages.select("page_id", F.col("url").cast("string").alias("url"), text_or_empty("html").cast("binary").alias("payload")), least)
    back = reassemble(read_archives(pages.sparkSession, at))
    back = tables.write(back.select("record_id", "type", "refers_to", F.expr("substring(stated, 6)").alias("digest"), F.length("payload").cast("long").alias("bytes")), "back")
    # only revisits are joined: a response needs none, and its null reference would be one hot key
    full = back.where("type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("bytes").alias("full_bytes"), F.col("digest").alias("full_digest"))
    again = back.where("type = 'revisit'").join(full, "refers_to", "left")
    first = back.where("type <> 'revisit'").withColumns({"full_bytes": F.col("bytes"), "full_digest": F.col("digest")})
    return again.unionByName(first).select(
        page_of("record_id").alias("page_id"), F.col("full_bytes").alias("payload_bytes"), F.col("full_digest").alias("payload_digest"),
        F.col("type").alias("record_type"), page_of("refers_to").alias("refers_to"),
    )
