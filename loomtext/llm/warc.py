"""WARC archives: writing captures with deduplicated payloads, reading records, assembling transactions.

write_captures() writes a request, a response (or revisit) and a metadata record for each page, JVM-side: a page's records are one
value of Spark's text sink, whose line separator is the blank lines that end a record, so any shared file system will do. Of pages
with equal payloads of at least `least_revisit` bytes, the one with the smallest page_id is the response.

read_records() reads archives (plain or gzip, also one member a record, of less than 2 GB each) by their Content-Length. assemble() joins the records of a
transaction through WARC-Concurrent-To, in either direction, and gives a nested row for each capture; revisits find the
response, and with it their length, by the record that they refer to, and those that name none by their payload's digest.

A record whose length is missing or no number ends where the next one starts, and one that its archive ends within has what is there; both have intact
false, as has the last record before a damaged place of a gzip file. A record may be concurrent to several: all are kept, in
concurrent_to with a space between.

A null html is an empty payload; a null url leaves out WARC-Target-URI. Repeated rows are captures of their own, and those that
repeat the smallest page_id are all responses; a null page_id comes after all others. A very long page is one record. An
empty table gives no records. Columns other than page_id, url and html are not archived.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.llm.common import materialize, shared_path, table

CRLF = "\r\n"
RECORD = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, content_type string, payload_bytes long, payload_digest string, block binary, intact boolean"
#: Up to so many groups of equal payloads (about 60 bytes each) are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 200_000
#: A file of an archive stays below so many bytes of payloads, unless one record is longer; pages over LONG_PAGE go to files of their own.
FILE_BYTES = 1 << 30
LONG_PAGE = FILE_BYTES // 4000
_HTTP_OK = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"


def _record_id(page: Column, digest: Column, salt: Column, part: str) -> Column:
    h = F.md5(F.concat_ws(":", F.coalesce(page.cast("string"), F.lit("null")), digest, salt, F.lit(part)))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.concat(F.lit(f"{k}: "), v, F.lit(CRLF)) for k, v in headers]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF))
    return F.concat(F.lit(f"WARC/1.1{CRLF}"), *(F.coalesce(x, F.lit("")) for x in lines), length, F.lit(CRLF), block)


def write_captures(pages: DataFrame, path: str, least_revisit: int = 100, date: str = "2024-01-01T00:00:00Z", records_a_file: int = 4000) -> None:
    """Archive pages (page_id, url, html) under path as gzip files of at most records_a_file records, and FILE_BYTES of payloads."""
    rows = pages.select(F.col("page_id"), F.regexp_replace("url", r"[\r\n]+", " ").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("size", F.octet_length("html"))
    keys = rows.groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("c"))
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id"), F.col("c"))).alias("first")
    groups = keys.groupBy("digest").agg(first, F.sum("c").alias("n"), F.max("c").alias("most")).filter("n > 1").drop("n").persist()
    small = groups.count() <= MOST_BROADCAST
    rows = rows.join(F.broadcast(groups) if small else groups, "digest", "left")

    leads = F.col("page_id").eqNullSafe(F.col("first.page_id"))
    revisit = F.col("first").isNotNull() & (F.col("size") >= least_revisit) & ~leads
    # where rows repeat an id, chance tells their records apart
    repeated = (F.col("most") > 1) & ~(leads & (F.col("first.c") == 1))
    rows = rows.withColumn("salt", F.when(F.coalesce(repeated, F.lit(False)), F.expr("uuid()")).otherwise(""))
    own = lambda part: _record_id(F.col("page_id"), F.col("digest"), F.col("salt"), part)
    uri = ("WARC-Target-URI", F.col("url"))
    at = ("WARC-Date", F.lit(date))
    answer = [
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID", own("response")), at, uri,
        ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ("WARC-Refers-To", F.when(revisit & (F.col("first.c") == 1), _record_id(F.col("first.page_id"), F.col("digest"), F.lit(""), "response"))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
    ]
    asked = [("WARC-Type", F.lit("request")), ("WARC-Record-ID", own("request")), at, uri, ("WARC-Concurrent-To", own("response")), ("Content-Type", F.lit("application/http; msgtype=request"))]
    more = [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", own("metadata")), at, uri, ("WARC-Concurrent-To", own("response")), ("Content-Type", F.lit("application/warc-fields"))]
    parts = [
        _record(asked, F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(f" HTTP/1.1{CRLF}{CRLF}"))),
        _record(answer, F.concat(F.lit(_HTTP_OK), F.when(revisit, "").otherwise(F.col("html")))),
        _record(more, F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF))),
    ]
    most = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    for chosen, records in [("size is not null", records_a_file)] if most <= LONG_PAGE else [(f"size <= {LONG_PAGE}", records_a_file), (f"size > {LONG_PAGE}", max(1, min(records_a_file, FILE_BYTES // most)))]:
        out = rows.filter(chosen).select(F.concat_ws(CRLF * 2, *parts).alias("value"))
        writer = out.write.mode("append").option("lineSep", CRLF * 2).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
        writer.option("maxRecordsPerFile", records).text(path)
    groups.unpersist()


class _Archive:
    """Lines and blocks of a stream that may be damaged: what can't be read ends it."""

    def __init__(self, stream):
        self.stream, self.line, self.damaged = stream, b"", False

    def _call(self, f, *args) -> bytes:
        try:
            return b"" if self.damaged else f(*args)
        except (EOFError, OSError, zlib.error):
            self.damaged = True
            return b""

    def readline(self) -> bytes:
        line, self.line = self.line, b""
        return line or self._call(self.stream.readline)

    def back(self, line: bytes) -> None:
        self.line = line

    def read(self, n: int) -> bytes:
        parts = []
        while n and (part := self._call(self.stream.read1, min(n, 1 << 20))):
            parts.append(part)
            n -= len(part)
        return b"".join(parts)

    def to_next(self) -> bytes:
        """All up to the line that starts a record, without the line ends before it."""
        lines = []
        while line := self.readline():
            if line.startswith(b"WARC/"):
                self.back(line)
                break
            lines.append(line)
        return b"".join(lines).rstrip(b"\r\n")


def parse(stream, with_block: bool) -> Iterator[tuple]:
    """Records of an archive, as RECORD has them; what stands between records and isn't a version line is skipped."""
    archive = _Archive(stream)
    while line := archive.readline():
        if not line.startswith(b"WARC/"):
            continue
        headers: dict[str, str] = {}
        concurrent = []
        while line := archive.readline().rstrip(b"\r\n"):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            name, value = name.strip().lower(), value.strip()
            headers[name] = value
            if name == "warc-concurrent-to" and value:
                concurrent.append(value)
        length = headers.get("content-length", "")
        if length.isascii() and length.isdigit():
            block = archive.read(int(length))
            intact = len(block) == int(length)
        else:
            block, intact = archive.to_next(), False
        kind = headers.get("content-type", "")
        http = kind.startswith("application/http")
        payload = block.partition(b"\r\n\r\n")[2] if http else block
        digest = headers.get("warc-payload-digest", "").partition(":")
        if headers.get("warc-type") == "revisit":
            size, found = None, digest[2] or None
        else:
            size, found = len(payload), hashlib.sha256(payload).hexdigest()
        keep = with_block or headers.get("warc-type") == "metadata"
        named = (headers.get("warc-record-id"), headers.get("warc-type"), " ".join(concurrent) or None, headers.get("warc-refers-to"), headers.get("warc-target-uri"), headers.get("warc-date"))
        yield (*named, kind, size, found, payload if keep else None, intact)


def _parsed(with_block: bool):
    names = [x.split(" ")[0] for x in RECORD.split(", ")]
    kinds = {"payload_bytes": pa.int64(), "block": pa.binary(), "intact": pa.bool_()}

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*found, strict=True), strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                data = content.as_py()
                stream = io.BytesIO(data)
                if data[:2] == b"\x1f\x8b":
                    stream = io.BufferedReader(gzip.GzipFile(fileobj=stream))
                found: list[tuple] = []
                for record in parse(stream, with_block):
                    found.append(record)
                    if len(found) >= 1000:
                        yield rows(found)
                        found = []
                if found:
                    yield rows(found)

    return run


def read_records(spark: SparkSession, path: str, with_block: bool = True) -> DataFrame:
    """Records of the archives under path. Without with_block only metadata records keep theirs; lengths and digests are always of what was read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(_parsed(with_block), RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row for each response, revisit or resource: its fields, and arrays `requests` and `metadata` of the records concurrent to it.

    A record that is concurrent to no capture is left out; one concurrent to several by chains belongs to the one it names.
    """
    part = F.struct("record_id", "date", "content_type", "payload_bytes", "block", "type")
    main = records.filter("type in ('response', 'revisit', 'resource')")
    rest = records.filter("type not in ('response', 'revisit', 'resource', 'warcinfo')").select("record_id", "concurrent_to", part.alias("part"))
    each = lambda rows: rows.withColumn("other", F.explode(F.array_distinct(F.split("concurrent_to", " "))))
    after = each(rest.filter("concurrent_to is not null")).select(F.col("other").alias("record_id"), "part")
    # records that name no other may be named by a capture; a capture that names none takes no part in that join
    naming = each(main.filter("concurrent_to is not null").select("record_id", "concurrent_to")).select("record_id", F.col("other").alias("key"))
    before = naming.join(rest.filter("concurrent_to is null").select(F.col("record_id").alias("key"), "part"), "key").select("record_id", "part")
    # a capture's own records are few
    found = main.join(after.unionAll(before).groupBy("record_id").agg(F.collect_list("part").alias("parts")), "record_id", "left")
    parts = F.coalesce("parts", F.array().cast(found.schema["parts"].dataType))
    of = lambda *kinds: F.array_sort(F.filter(parts, lambda p: p["type"].isin(*kinds)))
    return found.select("record_id", "type", "refers_to", "target_uri", "date", "content_type", "payload_bytes", "payload_digest", "block", "intact", of("request").alias("requests"), of("metadata", "conversion", "continuation").alias("metadata"))


def captures(spark: SparkSession, path: str, with_block: bool = True) -> DataFrame:
    """assemble() with page_id from the metadata, and for revisits the length, and page, of the response that they refer to."""
    field = F.expr("aggregate(metadata, cast(null as string), (a, m) -> coalesce(a, nullif(regexp_extract(cast(m.block as string), '(?m)^page-id: (.*?)\\\\r?$', 1), '')))")
    records = read_records(spark, path, with_block)
    # without blocks records are short: read the archives once
    rows = assemble(records if with_block else materialize(records, "records")).withColumn("page_id", field.cast("long"))
    named = F.col("refers_to").isNotNull()
    answers = rows.filter("type = 'response'").select("record_id", "payload_digest", F.struct(F.col("page_id").isNull().alias("none"), "page_id", "payload_bytes").alias("first"))
    revisits = rows.filter("type = 'revisit'")
    told = revisits.filter(named).join(answers.select(F.col("record_id").alias("refers_to"), "first"), "refers_to", "left")
    least = answers.groupBy("payload_digest").agg(F.min("first").alias("first"))
    untold = revisits.filter(~named).join(least, "payload_digest", "left")
    revisits = told.unionByName(untold).withColumns({"first_page": F.col("first.page_id"), "first_bytes": F.col("first.payload_bytes")}).drop("first")
    plain = rows.filter("type <> 'revisit'").withColumns({"first_page": F.lit(None).cast("long"), "first_bytes": F.col("payload_bytes")})
    both = plain.unionByName(revisits)
    return both.withColumn("payload_bytes", F.coalesce("payload_bytes", "first_bytes")).withColumnRenamed("first_page", "refers_to_page").drop("first_bytes")


def op1_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_captures(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    rows = captures(spark, path, with_block=False)
    return rows.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to_page").alias("refers_to"))


OP1_SQL = """
with p as (select page_id, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as d from pages),
f as (select d, min(page_id) as first from p where n >= 100 group by d)
select page_id, n as payload_bytes, d as payload_digest,
       case when n >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
       case when n >= 100 and page_id <> first then first end as refers_to
from p left join f using (d)
"""
