"""A content-addressed web archive: payloads once, exact record headers apart, records by joins.

``write_archive`` makes three tables: ``headers`` (the exact bytes of each record's WARC and HTTP header, with the
SHA-256 of its payload), ``payloads`` (each distinct payload once, by SHA-256) and ``spread`` (the few payloads that
very many records share, and over how many shards their records are dealt).  ``read_archive`` joins them to the
records again, parses the records, and verifies every payload: against the SHA-256 that it is stored by,
and against the SHA-1 and the length in the record's own header, which were made of the record's own payload.  Two
payloads that shared a SHA-256 would differ in these, and reading raises.

``export_warc`` writes the records as WARC/1.1 files of plain text parts, ``read_warc`` parses such files.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeweave.llm.shared import LAST_ID, cut, discard, join_counted, keep_decided, lean, new_folder

DATE = "1970-01-01T00:00:00Z"
END = b"\r\n\r\n"

# Names of the WARC 1.1 format, and the digits of base 32 in two alphabets.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32_HEX = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: More records of one payload than this, and than ``1 / MOST_SPREAD`` of all records, are dealt over shards.
SHARD_RECORDS = 1024
MOST_SPREAD = 100_000


def base32_sha1(data: Column) -> Column:
    """Upper-case base 32 of SHA-1: 40 bits are 10 hex digits and 8 digits of base 32."""
    return F.concat(*(F.translate(F.lpad(F.conv(F.substring(F.sha1(data), 10 * k + 1, 10), 16, 32), 8, "0"), BASE32_HEX, BASE32) for k in range(4)))


def _record_id(page_id: Column, digest: Column, row: Column) -> Column:
    hexes = F.md5(F.concat_ws("|", page_id.cast("string"), digest, row.cast("string")).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(hexes, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line; empty where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _header(date: str) -> Column:
    """The WARC and HTTP header of a row of ``_listed`` with its marks, as text."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.octet_length(http) + F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("payload_bytes"))
    uri = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), "\t", "%09"), " ", "%20")
    again = lambda value: F.when(F.col("revisit"), value)
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("sha256"), F.col("row"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", uri),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Profile", again(F.lit(PROFILE))),
        _line("WARC-Refers-To", again(_record_id(F.col("first_id"), F.col("sha256"), F.col("first_row")))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", block.cast("string")),
        _line("Page-ID", F.col("page_id").cast("string")),
        _line("Refers-To-Page-ID", again(F.col("first_id").cast("string"))),
        F.lit("\r\n"),
        http,
    )


def _payload_digests(texts: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256((t or "").encode()).hexdigest() for t in texts.to_pylist()], pa.string())


def write_archive(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = DATE) -> None:
    """Write ``pages(page_id, url, html)`` as an archive below ``folder``; a null text is an empty payload.

    Of records with equal payloads of ``least_bytes`` or more, that with the smallest page id (null last, then any one) is
    the response and the others revisit it; smaller payloads are all responses.  The bytes of copies
    never move: a bitmap of ids lets pages that have no copy pass to the store without a shuffle.
    """
    spark, pages = pages.sparkSession, pages.select("page_id", "url", "html")
    body = F.coalesce("html", F.lit("")).cast("binary")
    listed = cut(pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), "url", F.octet_length(body).cast("long").alias("payload_bytes"), base32_sha1(body).alias("sha1"), F.sha2(body, 256).alias("sha256")))
    total = listed.count()
    first = F.min(F.struct(F.coalesce("page_id", F.lit(LAST_ID)), "page_id", "row"))
    groups = cut(listed.groupBy("sha256").agg(F.count("*").alias("records"), first.alias("f")).where("records > 1").select("sha256", "records", F.col("f.page_id").alias("first_id"), F.col("f.row").alias("first_row")))
    most = max(SHARD_RECORDS, -(-total // MOST_SPREAD))
    shards = F.expr(f"cast((records + {most - 1}) div {most} as int)")
    marked = join_counted(listed, groups, "sha256", "records", total, "left")
    marked = cut(marked.withColumn("shard", F.coalesce(F.pmod(F.xxhash64("row"), shards), F.lit(0)).cast("int")).withColumn("keeper", F.coalesce(F.col("row") == F.col("first_row"), F.lit(True))))
    marked_type = marked.withColumn("revisit", ~F.col("keeper") & (F.col("payload_bytes") >= least_bytes))
    marked_type.select("sha256", "shard", _header(date).alias("header")).write.parquet(f"{folder}/headers")
    groups.where(F.col("records") > most).select("sha256", shards.alias("shards")).write.parquet(f"{folder}/spread")

    # A page's name is its id and digest; the store keeps the keeper's row, or one row of its name.
    names = marked.where("records IS NOT NULL").groupBy(F.coalesce("page_id", F.lit(LAST_ID)).alias("id"), "sha256").agg(F.max("keeper").alias("kept"), F.count("*").alias("n"))
    decided = names.where("NOT kept OR n > 1").select("id", "sha256", "kept")
    kept = keep_decided(pages, "page_id", "html", decided, _payload_digests)
    kept.select(F.sha2(body, 256).alias("sha256"), body.alias("payload")).write.parquet(f"{folder}/payloads")
    discard(listed, groups, marked)


def _joined(spark: SparkSession, folder: str) -> DataFrame:
    """``sha256, header, payload``: headers met with their payloads; records of a spread payload meet copies of it."""
    headers = spark.read.schema("sha256 string, shard int, header string").parquet(f"{folder}/headers")
    payloads = spark.read.schema("sha256 string, payload binary").parquet(f"{folder}/payloads")
    spread = spark.read.schema("sha256 string, shards int").parquet(f"{folder}/spread")  # MOST_SPREAD rows at most
    copies = payloads.join(F.broadcast(spread), "sha256", "left").select("sha256", "payload", F.explode(F.sequence(F.lit(0), F.coalesce("shards", F.lit(1)) - 1)).alias("shard"))
    return headers.join(copies, ["sha256", "shard"], "left").select("sha256", "header", "payload")


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """The named fields and the block of the record at ``at``, and where the next one begins; raises where the format is broken."""
    end = data.find(END, at)
    lines = data[at:end].decode().split("\r\n")
    if end < 0 or lines[0] != "WARC/1.1":
        raise ValueError(f"no record at byte {at}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    begin = end + len(END)
    over = begin + int(fields["Content-Length"])
    if data[over : over + len(END)] != END:
        raise ValueError(f"record at byte {at} does not end where it says")
    return fields, data[begin:over], over + len(END)


_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def read_archive(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """Every record of an archive with its full payload (revisits too): ``page_id, url, record_type, refers_to, payload_bytes, payload_digest`` and, if asked for, ``payload``.

    Length and digest are made anew of the bytes read; any that differ from what the record or the store
    says raise, as does a header without a payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[] for _ in range(6)]
            for stored, header, payload in zip(*(b.column(k) for k in range(3)), strict=True):
                head, data = header.as_buffer().to_pybytes(), payload.as_py()
                if data is None or hashlib.sha256(data).hexdigest() != stored.as_py():
                    raise ValueError(f"payload {stored.as_py()} is missing or damaged")
                revisit = b"\r\nWARC-Type: revisit\r\n" in head[: head.find(END)]
                fields, block, _ = parse_record(head + (b"" if revisit else data) + END)
                http, _, own = block.partition(END)
                said = int(http.rsplit(b"Content-Length: ", 1)[1])
                sha1 = base64.b32encode(hashlib.sha1(data).digest()).decode()
                if fields["WARC-Payload-Digest"] != f"sha1:{sha1}" or said != len(data) or (not revisit and own != data):
                    raise ValueError(f"payload of {fields['WARC-Record-ID']} is not its own")
                as_int = lambda v: int(v) if v is not None else None
                for column, value in zip(rows, (as_int(fields.get("Page-ID")), fields.get("WARC-Target-URI"), fields["WARC-Type"], as_int(fields.get("Refers-To-Page-ID")), len(data), sha1), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
            arrays = [pa.array(x, k) for x, k in zip(rows, kinds, strict=True)]
            names = [x.split()[0] for x in _SCHEMA.split(", ")]
            yield pa.record_batch([*arrays, b.column(2)], names=[*names, "payload"]) if with_payload else pa.record_batch(arrays, names=names)

    return _joined(spark, folder).mapInArrow(lean(run), _SCHEMA + (", payload binary" if with_payload else ""))


def export_warc(spark: SparkSession, folder: str, to: str, records_per_file: int = 10_000) -> None:
    """Write the records of an archive as WARC files below ``to``: what stands between two records is the writer's line end."""
    revisit = F.col("header").contains("\r\nWARC-Type: revisit\r\n")
    record = F.concat("header", F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string")))
    _joined(spark, folder).select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file).text(to)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``fields, block`` of every record of WARC files, a file in one task (``records_per_file`` bounds its size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                data, at = content.as_py(), 0
                while at < len(data):
                    fields, block, at = parse_record(data, at)
                    yield pa.record_batch([pa.array([list(fields.items())], pa.map_(pa.string(), pa.string())), pa.array([block], pa.binary())], names=["fields", "block"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "fields map<string,string>, block binary")


def archive_and_read(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` to an archive in the shared folder and read its records back."""
    folder = new_folder(spark, "archive")
    write_archive(pages, folder)
    return read_archive(spark, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
