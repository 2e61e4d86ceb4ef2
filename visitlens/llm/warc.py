"""WARC archives: write, normalise, index, read back.

``write_archives`` writes records as whole-file gzip streams, as a plain crawler leaves
them. ``normalise`` inflates each such stream once, from front to back, rewrites every
record as a gzip member of its own, and writes a sidecar index with the place of every
member beside each archive. ``read_records`` cuts members out by that index. Files are
read and written by Spark's own sources, so they may lie in any store that Spark reaches.

Defined cases: a null payload is empty. Of records with equal payloads that with the
smallest id is the response and the others revisit it; rows that repeat that id are
responses too; null ids come last. A null url becomes ``urn:page:<id>``; line ends in a url
are escaped. An empty table gives archives without records and an empty result. A damaged
archive is an error that names it. Other columns of the input are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORDS_PER_ARCHIVE = 5_000
CHUNK = 1 << 20
LEVEL = 6
INDEX_BROADCAST_BYTES = 32 << 20
RECORD = (
    "page_id long, url string, record_type string, payload_bytes long, payload_digest string, "
    "refers_to long, archive string, offset long, length long"
)


def gzip_member(data: bytes, level: int = LEVEL) -> bytes:
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


#: Spark's text writer puts this after each archive: a gzip member of no bytes.
EMPTY_MEMBER = gzip_member(b"")


def base32_of_hex(hexed: Column) -> Column:
    """Five hex digits are 20 bits, which are four base32 digits."""
    return F.array_join(
        F.transform(
            F.sequence(F.lit(0), F.lit(31)),
            lambda i: F.substring(
                F.lit(BASE32),
                (
                    F.expr("1")
                    + F.call_function(
                        "shiftright",
                        F.conv(F.substring(hexed, (i / 4).cast("int") * 5 + 1, F.lit(5)), 16, 10).cast("int"),
                        F.lit(15) - (i % 4) * 5,
                    ).bitwiseAND(F.lit(31))
                ),
                F.lit(1),
            ),
        ),
        "",
    )


def with_revisits(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, digest, first_id``: the id of the response for the payload.

    Only ids and digests are grouped, with partial sums; payloads meet the few digests that
    occur twice in a join whose large keys Spark can split.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(
            F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")),
            F.concat(F.lit("urn:page:"), F.col("page_id").cast("string")),
            F.lit("urn:page:null"),
        ).alias("url"),
        F.coalesce(F.col("html"), F.lit("")).alias("payload"),
    )
    rows = rows.withColumn("digest", F.sha1(F.encode("payload", "UTF-8")))
    repeated = (
        rows.groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    return rows.join(repeated, "digest", "left")


def record_text(rows: DataFrame) -> DataFrame:
    """One WARC record a row, without the two line ends that close a record."""
    number = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("payload").cast("string"),
        F.lit("\r\n\r\n"),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"),
        number,
        F.lit(">\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: "),
        F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        base32_of_hex(F.col("digest")),  # past the join, so that the hash is not taken again
        F.when(
            revisit,
            F.concat(
                F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                F.lit("\r\nWARC-Refers-To: <urn:page:"),
                F.col("first_id").cast("string"),
                F.lit(">"),
            ),
        ).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length("block").cast("string"),
        F.lit("\r\n\r\n"),
    )
    return rows.withColumn("block", block).select(F.concat(head, F.col("block")).alias("value"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Whole-file gzip archives of at most ``RECORDS_PER_ARCHIVE`` records."""
    (
        record_text(with_revisits(pages))
        .write.option("lineSep", "\r\n\r\n")
        .option("compression", "gzip")
        .option("maxRecordsPerFile", RECORDS_PER_ARCHIVE)
        .text(path)
    )


def inflated(data: bytes) -> Iterator[bytes]:
    """The bytes of a gzip stream of any number of members, in chunks."""
    stream = zlib.decompressobj(31)
    for start in range(0, len(data), CHUNK):
        part = data[start : start + CHUNK]
        while part:
            yield stream.decompress(part)
            part = stream.unused_data
            if stream.eof:
                stream = zlib.decompressobj(31)
                part = part.lstrip(b"\0") if not part.strip(b"\0") else part
            else:
                break
    yield stream.flush()


def headers_of(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    fields = (line.split(":", 1) for line in lines[1:] if ":" in line)
    return {name.strip().lower(): value.strip() for name, value in fields}


def records(data: bytes, name: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and whole bytes of every record of one gzip stream, read once."""
    held, chunks, ended = bytearray(), inflated(data), False

    def need(test) -> bool:
        nonlocal ended
        while not test() and not ended:
            part = next(chunks, None)
            if part is None:
                ended = True
            else:
                held.extend(part)
        return test()

    while need(lambda: len(held) > 0):
        if not need(lambda: held.find(b"\r\n\r\n") >= 0) or not held.startswith(b"WARC/"):
            raise ValueError(f"{name}: no WARC record where one should begin")
        end = held.find(b"\r\n\r\n") + 4
        fields = headers_of(bytes(held[: end - 4]))
        whole = end + int(fields["content-length"]) + 4
        if not need(lambda: len(held) >= whole):
            raise ValueError(f"{name}: the last record is cut off")
        yield fields, bytes(held[:whole])
        del held[:whole]


def _normalised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            name = path.rsplit("/", 1)[-1].split(".")[0]
            members, index, offset = [], [], 0
            for fields, whole in records(content, name):
                member = gzip_member(whole)
                index.append(
                    {
                        "offset": offset,
                        "length": len(member),
                        "id": fields["warc-record-id"],
                        "type": fields["warc-type"],
                        "url": fields.get("warc-target-uri"),
                    }
                )
                members.append(member)
                offset += len(member)
            lines = "".join(json.dumps(entry) + "\n" for entry in index).encode()
            yield pd.DataFrame(
                {
                    "archive": [name, name],
                    "kind": ["warc", "index"],
                    "value": [b"".join(members), gzip_member(lines)],
                }
            )


def normalise(spark: SparkSession, source: str, target: str) -> None:
    """Rewrite every archive of ``source`` member by member under ``target``, with its index.

    An archive and its index come out of one pass and one write: two files in the folders
    ``archive=<name>/kind=warc`` and ``kind=index``, both gzip.
    """
    whole = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source)
    rows = whole.select("path", "content").mapInPandas(
        _normalised, "archive string, kind string, value binary"
    )
    (
        rows.select(F.col("value").cast("string").alias("value"), "archive", "kind")
        .write.partitionBy("archive", "kind")
        .option("lineSep", EMPTY_MEMBER.decode("latin-1"))
        .option("encoding", "ISO-8859-1")
        .text(target)
    )


def _number(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text.lstrip("-").isdigit() else None


def _cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for name, content, index in zip(batch["archive"], batch["content"], batch["idx"], strict=True):
            rows = []
            for line in b"".join(inflated(index)).splitlines():
                entry = json.loads(line)
                at, length = entry["offset"], entry["length"]
                member = b"".join(inflated(content[at : at + length]))
                head, _, block = member.partition(b"\r\n\r\n")
                fields = headers_of(head)
                http, _, payload = block[: int(fields["content-length"])].partition(b"\r\n\r\n")
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                size = int(headers_of(http)["content-length"])
                if fields["warc-type"] == "response":
                    found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if found != digest or len(payload) != size:
                        raise ValueError(f"{name}: record at {at} does not match its digest")
                rows.append(
                    (
                        _number(fields["warc-record-id"]),
                        fields.get("warc-target-uri"),
                        fields["warc-type"],
                        size,
                        digest,
                        _number(fields.get("warc-refers-to")),
                        name,
                        at,
                        length,
                    )
                )
            columns = [c.split()[0] for c in RECORD.split(", ")]
            out = pd.DataFrame(rows, columns=columns)
            for c in ("page_id", "refers_to", "payload_bytes", "offset", "length"):
                out[c] = out[c].astype("Int64")
            yield out


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of normalised archives, cut out by the index and held against its digest."""
    files = spark.read.format("binaryFile").schema(
        "path string, modificationTime timestamp, length long, content binary, "
        "archive string, kind string"
    ).load(path)
    index = files.where("kind = 'index'")
    content = files.where("kind = 'warc'").select("archive", "content")
    index_bytes = index.agg(F.sum("length")).first()[0] or 0
    index = index.select("archive", F.col("content").alias("idx"))
    # A small index goes to the archives; a large one meets them by name in a shuffle.
    index = F.broadcast(index) if index_bytes <= INDEX_BROADCAST_BYTES else index
    return content.join(index, "archive").mapInPandas(_cut_out, RECORD)
