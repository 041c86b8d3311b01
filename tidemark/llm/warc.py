"""A content-addressed WARC archive: payload bytes once each, record headers apart, records rebuilt by joins.

`payloads` holds every distinct payload under its SHA-256, in buckets by it; `headers` holds the exact header bytes of
every record, and the digest of its payload. A response carries its payload; a revisit refers to the response with the
same one. Reading verifies each digest, rebuilds the records, and checks them against their own headers. Payload bytes
are shuffled once, after each task has brought equal ones down to one; the buckets then meet the headers in place.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm.common import settle, work_dir
from tidemark.sources import files

#: Payloads of fewer bytes are always stored as responses of their own.
LEAST = 1000
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"


def record_id(page_id: Column) -> Column:
    """A name-based UUID of the page, so that reruns give the same records."""
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit(""))).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, i, n) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _headers(kind: str) -> Column:
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20")
    page, n, sha1 = F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("payload_bytes").cast("string"), F.col("payload_digest")
    http = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", F.concat(F.lit("Content-Length: "), n), "", ""]
    top = ["WARC/1.1", f"WARC-Type: {kind}", F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page_id"))), f"WARC-Date: {DATE}", F.concat(F.lit("WARC-Target-URI: "), uri), F.concat(F.lit("X-Page-ID: "), page), F.concat(F.lit("WARC-Payload-Digest: sha1:"), sha1)]
    join = lambda xs: F.concat_ws(END, *(F.lit(x) if isinstance(x, str) else x for x in xs))
    if kind == "revisit":
        refers = [F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("owner"))), F.concat(F.lit("X-Refers-To-Page-ID: "), F.coalesce(F.col("owner").cast("string"), F.lit(""))), f"WARC-Profile: {REVISIT}"]
        return join([*top, *refers, "Content-Length: 0", "", ""])
    block = join(http)
    return join([*top, "Content-Type: application/http; msgtype=response", F.concat(F.lit("Content-Length: "), (F.col("payload_bytes") + F.octet_length(block)).cast("string")), "", block])


def write(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """Write `path/payloads` (sha256, payload, and what the headers say of it) and `path/headers` (page_id, sha256,
    header) of all rows.

    pages has page_id, url and html. Equal payloads are those of equal SHA-256; the largest id of their pages owns them.
    """
    spark = pages.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha256", F.sha2("payload", 256))
    held = rows.groupBy("sha256").agg(F.max("page_id").alias("owner"), F.first("payload").alias("payload"))
    held = held.select("sha256", "owner", F.sha1("payload").alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"), "payload")
    name = _name()
    held.write.format("parquet").bucketBy(buckets, "sha256").option("path", f"{path}/payloads").option("compression", "zstd").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, and need no catalogue
    kind = pages.schema["page_id"].dataType.simpleString()
    files.write_json(spark, f"{path}/archive.json", {"buckets": buckets, "page_id": kind})
    known = spark.read.schema(f"sha256 string, owner {kind}, payload_digest string, payload_bytes long").parquet(f"{path}/payloads")
    type_of = F.when((F.col("payload_bytes") < least) | F.col("page_id").eqNullSafe(F.col("owner")), _headers("response")).otherwise(_headers("revisit"))
    joined = rows.select("page_id", "url", "sha256").join(known, "sha256")
    joined.select("page_id", "sha256", type_of.cast("binary").alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")


def _name() -> str:
    return f"tidemark_{uuid.uuid4().hex}"


def _bucketed(spark: SparkSession, path: str) -> DataFrame:
    """The payloads of an archive, which Spark knows to be in buckets."""
    name, buckets = _name(), files.read_json(spark, f"{path}/archive.json")["buckets"]
    spark.sql(f"CREATE TABLE {name} (sha256 STRING, payload BINARY) USING parquet CLUSTERED BY (sha256) INTO {buckets} BUCKETS LOCATION '{path}/payloads'")
    rows = spark.table(name)
    rows.schema  # resolved, so that the name isn't needed any more
    spark.sql(f"DROP TABLE {name}")
    return rows


def _sound(rows: DataFrame) -> DataFrame:
    right = F.sha2("payload", 256) == F.col("sha256")
    return rows.select("sha256", F.when(right, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("corrupt payload "), F.col("sha256"))).cast("binary")).alias("payload"))


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """sha256 and payload, each digest verified; a payload that doesn't match ends the job."""
    return _sound(spark.read.schema("sha256 string, payload binary").parquet(f"{path}/payloads"))


def _field(name: str, text: str = "head") -> Column:
    return F.regexp_extract(text, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)


def headers(spark: SparkSession, path: str) -> DataFrame:
    """page_id, sha256, header, record_type and refers_to, the last two as the header bytes say."""
    kind = files.read_json(spark, f"{path}/archive.json")["page_id"]
    rows = spark.read.schema(f"page_id {kind}, sha256 string, header binary").parquet(f"{path}/headers").withColumn("head", F.col("header").cast("string"))
    refers = _field("X-Refers-To-Page-ID")
    return rows.select("page_id", "sha256", "header", _field("WARC-Type").alias("record_type"), F.when(refers != "", refers.cast(kind)).alias("refers_to"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type, refers_to, record: the whole records as they stand in a WARC file.

    Only responses meet their payload, so a payload that many pages have moves once and not once for each revisit.
    """
    known = headers(spark, path)
    full = known.filter("record_type = 'response'").join(_sound(_bucketed(spark, path)), "sha256")
    bare = known.filter("record_type <> 'response'").withColumn("payload", F.lit(b""))
    row = ["page_id", "record_type", "refers_to", F.concat("header", "payload", F.lit(b"\r\n\r\n")).alias("record")]
    return full.select(row).unionByName(bare.select(row))


def _read(rows: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of records, from their bytes alone.

    A record's length must be what its header says, and a response's payload must have the digest that its header says.
    """
    text, own = F.col("record").cast("string"), F.col("record_type") == "response"
    rows = rows.withColumn("head", F.concat(F.substring_index(text, "\r\n\r\n", 1), F.lit(END)))
    start = F.octet_length("head") + len(END)
    rows = rows.withColumns({"block": F.substring("record", start + 1, F.octet_length("record") - start - 2 * len(END)), "digest": F.substring(_field("WARC-Payload-Digest"), 6, 40)})
    skip = F.octet_length(F.substring_index(F.col("block").cast("string"), "\r\n\r\n", 1)) + 2 * len(END)
    rows = rows.withColumn("payload", F.when(own, F.substring("block", skip + 1, F.octet_length("block"))))
    rows = rows.select("page_id", "record_type", "refers_to", "digest", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), (_field("Content-Length").cast("long") == F.octet_length("block")).alias("whole"))
    right = F.col("whole") & F.coalesce(F.col("payload_digest") == F.col("digest"), F.lit(True))
    checked = F.when(right, F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("corrupt record of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))))
    return rows.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")


def facts(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, read from the rebuilt records.

    A revisit has no payload of its own: its digest is that of its header, and its length that of the response that it
    refers to and that has this digest.
    """
    built = records(spark, path)
    own = settle(_read(built.filter("record_type = 'response'")))
    seen = own.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    again = _read(built.filter("record_type <> 'response'")).drop("payload_bytes").join(seen, ["refers_to", "payload_digest"])
    return own.unionByName(again.select(own.columns))


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Archive all pages in the shared folder, rebuild the records and read their facts.

    Defined cases: a null html is an empty payload; a null url is an empty address; a null page_id is below all others,
    and responds only to payloads that no page with an id has; rows that share the largest id all respond, with one
    stored payload; other columns are ignored; an empty table gives no rows; payloads may have any length.
    """
    path = work_dir(pages.sparkSession, "warc")
    write(pages, path, least)
    return facts(pages.sparkSession, path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, header bytes, block) of each record in a WARC file, plain or compressed by gzip."""
    import gzip

    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        while data[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(data):
            return
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        head = data[at : stop + 4]
        fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
        size = int(fields["Content-Length"])
        yield fields, head, data[stop + 4 : stop + 4 + size]
        at = stop + 4 + size


def read_files(spark: SparkSession, paths: str) -> DataFrame:
    """WARC files as rows: path, target_uri, record_type, digest, header, block. A file is one task's work."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                for f, head, block in parse(content.as_py()):
                    row = [path, f.get("WARC-Target-URI"), f.get("WARC-Type"), f.get("WARC-Payload-Digest"), head, block]
                    yield pa.RecordBatch.from_arrays([pa.array([x]) if x is not None else pa.array([None], pa.string()) for x in row], names=["path", "target_uri", "record_type", "digest", "header", "block"])

    return files.mapInArrow(run, "path string, target_uri string, record_type string, digest string, header binary, block binary")
