"""WARC archives with revisit records: write, read back, and resolve revisits by payload digest.

Archives are written by Spark's text writer, one record a row (a record ends with CR LF CR LF, whose last LF is the row's
line end), so any file system and the commit protocol for retried tasks serve them. Reading parses by Content-Length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import HOT, HOT_KEYS, counted, cut, left_join_hot, new_path, small_side

#: Fixed values of the WARC 1.1 format and of base32.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
#: Bytes of payload of one archive file at most, unless it is one record, and records of one file at most.
ARCHIVE_BYTES, RECORDS = 64 << 20, 4096
#: Payloads are written by size, so that a number of records bounds the bytes of a file: upper ends of the classes but the last.
CLASSES = (16 << 10, 256 << 10, 4 << 20)
#: Repeated payloads up to which their digests are broadcast.
DIGESTS = 200_000


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1: every 5 hexadecimal digits give 4 letters."""
    digest = F.sha1(payload)
    letters = []
    for k in range(0, 40, 5):
        five = F.conv(F.substring(digest, k + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(ALPHABET), F.shiftright(five, bits).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for bits in (15, 10, 5, 0)]
    return F.concat(*letters)


def record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws(":", F.coalesce(page_id.cast("string"), F.lit("null")), digest))
    return F.concat(F.lit("<urn:uuid:"), *(x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.lit("-" if a > 1 else ""), F.substring(h, a, n))), F.lit(">"))


def assign_roles(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_payload_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, payload_digest, payload_bytes, refers_to): refers_to is the smallest page_id of an equal payload for revisits, else null.

    A null payload is empty. Payloads under `min_payload_bytes` are all responses. Rows that repeat the smallest page_id of a
    payload are responses each. A null page_id comes after all others.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    digest, size = base32_sha1(F.encode("payload", "UTF-8")), F.octet_length("payload").cast("long")
    headers = p.select("page_id", digest.alias("payload_digest"), size.alias("payload_bytes"))
    # headers alone meet by digest
    first, found = counted(headers.where(F.col("payload_bytes") >= min_payload_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    rows = p.withColumns({"payload_digest": digest, "payload_bytes": size})
    if found <= DIGESTS:
        rows = rows.join(F.broadcast(first.drop("n")), "payload_digest", "left")
    else:
        # payloads on many pages are few: they are broadcast, and their pages dealt by page
        hot = small_side(first.where(F.col("n") >= HOT).select("payload_digest", F.col("first_id").alias("hot_id")), HOT_KEYS)
        rows = rows.join(hot, "payload_digest", "left").withColumn("key", F.when(F.col("hot_id").isNull(), F.col("payload_digest")).otherwise(F.concat(F.lit("#"), F.xxhash64("page_id").cast("string"))))
        rows = rows.join(first.select(F.col("payload_digest").alias("key"), F.col("first_id").alias("cold_id")), "key", "left").withColumn("first_id", F.coalesce("hot_id", "cold_id"))
    again = F.col("first_id").isNotNull() & (F.col("payload_bytes") >= min_payload_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.select("page_id", "url", "payload", "payload_digest", "payload_bytes", F.when(again, F.col("first_id")).alias("refers_to"))


def write_archives(roles: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes a record per row of `assign_roles` with fresh headers; a revisit has the HTTP head of its page but no payload.

    Files are gzip streams of ARCHIVE_BYTES of payload at most, but for a larger payload, which has a file of its own.
    """
    revisit = F.col("refers_to").isNotNull()
    url = F.coalesce(F.regexp_replace("url", r"[\x00-\x20]+", "%20"), F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    body = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    head = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page_id"), F.col("payload_digest"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Page-ID: "), F.col("page_id").cast("string")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("refers_to"), F.col("payload_digest")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("__body").cast("string")),
    ]
    text = F.concat(F.concat_ws(CRLF, *head), F.lit(CRLF * 2), F.col("__body"), F.lit("\r\n\r"))
    at = sum((F.when(F.col("payload_bytes") > x, 1).otherwise(0) for x in CLASSES), F.lit(0))
    lines = roles.withColumn("__body", body).select(text.alias("value"), at.alias("class"))
    for k in sorted(r[0] for r in roles.select(at.alias("class")).distinct().collect()) or [0]:
        most = min(RECORDS, ARCHIVE_BYTES // CLASSES[k]) if k < len(CLASSES) else 1
        lines.where(F.col("class") == k).select("value").write.option("compression", "gzip").option("maxRecordsPerFile", most).text(f"{path}/size-{k}")


def records_of(data: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record in a stream of bytes; a cut record raises."""
    held = bytearray()

    def fill(n: int) -> bool:
        while len(held) < n:
            more = next(data, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not fill(len(held) + 1):
                if held.strip():
                    raise ValueError("an archive ends inside a record's headers")
                return
        lines = bytes(held[:end]).decode().split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError("a record does not start with its version")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        stop = end + 4 + int(headers["content-length"])
        if not fill(stop + 4) or held[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield headers, bytes(held[end + 4 : stop])
        del held[: stop + 4]


def unzipped(content: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    while content:  # one member after the other
        z = zlib.decompressobj(31)
        for k in range(0, len(content), step):
            if out := z.decompress(content[k : k + step]):
                yield out
            if z.eof:
                content = z.unused_data + content[k + step :]
                break
        else:
            content = b""


READ = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to_record", pa.string()), ("url", pa.string()), ("header_digest", pa.string()), ("payload", pa.binary())])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, record_type, record_id, refers_to_record, url, header_digest, payload (what follows the HTTP head)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                held = 0
                for h, block in records_of(unzipped(content.as_py())):
                    page = h.get("warc-page-id")
                    payload = block.partition(b"\r\n\r\n")[2]
                    rows.append((int(page) if page else None, h["warc-type"], h["warc-record-id"], h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-payload-digest", "").removeprefix("sha1:"), payload))
                    held += len(payload) + 300
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), READ, strict=True)], schema=READ)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), READ, strict=True)], schema=READ)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(run, "page_id long, record_type string, record_id string, refers_to_record string, url string, header_digest string, payload binary")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): size and digest from the payload itself, a revisit's from the response it names.

    A revisit whose response is missing keeps its header's digest and has null bytes and refers_to.
    """
    slim = cut(records.select("page_id", "record_type", "record_id", "refers_to_record", "header_digest", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest")))
    whole = slim.where("record_type = 'response'")
    by_id = cut(whole.groupBy(F.col("record_id").alias("refers_to_record")).agg(F.first("page_id").alias("to"), F.first("payload_bytes").alias("b"), F.first("payload_digest").alias("d")))
    back = left_join_hot(slim.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to_record", "header_digest"), by_id, "refers_to_record")
    return whole.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(
        back.select("page_id", F.col("b").alias("payload_bytes"), F.coalesce("d", "header_digest").alias("payload_digest"), "record_type", F.col("to").alias("refers_to"))
    )


def roundtrip(pages: DataFrame, **columns) -> DataFrame:
    """Writes `pages` as deduplicated archives into a new folder of the shared one, and resolves what is read back."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(assign_roles(pages, **columns), path)
    return resolve_revisits(read_archives(spark, path))
