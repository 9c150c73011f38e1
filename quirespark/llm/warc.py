"""Operator 1: WARC 1.1 archives by way of a table of chunks.

write(): every payload becomes rows (record, chunk number, chunk) of at most
`chunk_bytes` bytes before it leaves the scan; a streaming step adds to each row the
SHA-1 and length of the payload up to and including that chunk, keeping only a digest
state from row to row. A payload of several chunks is written as a segmented record
(a first segment, then continuation records), as the format provides, so no
record in an archive and no row in a task exceeds a chunk. Payloads of at least
`least_bytes` that are alike are stored once: the largest id is the response, the
others are revisits that refer to it. Which payloads repeat is decided on (digest, id)
alone; only the digests that repeat meet the payloads again. Files are compressed, so
Spark reads each of them from its beginning; there is one for each task that writes.

read(): lines of the files go to a streaming parser that follows the standard alone: header
fields by name, the block by Content-Length, the payload after the block's HTTP head. It holds
a header and a digest state, never a record, and gives chunks again, with the length and digest
so far. Nothing in a payload can be taken for a record. The one field of our own is X-Page-ID,
null for archives made elsewhere. Segments are put in order and hashed as they stream by,
in whatever files they are; revisits find the record that WARC-Refers-To names by a join.

Defined cases: a null payload is an empty one; a null id is kept as null; rows with
equal ids and payloads are both responses if theirs is the largest id, a null id being
smaller than all others; control characters of a URL are percent-encoded, a null URL becomes
NO_URI, which reads as null; an empty table gives an empty archive and no rows; a revisit of
a record that is not there has null payload_bytes and refers_to; records of other kinds
than response, resource and revisit are skipped; a payload that does not fit the SHA-1 of
its header raises an error, other digests are not checked; so do a file that ends within a
record, as one does that is not compressed and exceeds spark.sql.files.maxPartitionBytes, and
one that does not begin with a record; other columns are not read, and chunk_table() raises
ValueError for a table with columns of the names that it adds.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import STEP_BYTES, bounded, cut, fresh_path, steps, table

#: Fixed values of the format.
VERSION = "WARC/1.1\r\n"
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_URI = "about:blank"

CHUNK_BYTES = 65_536
LEAST_BYTES = 1_000
#: Bytes that a record's header may have.
HEADER_BYTES = 1 << 20
ADDED = ("last", "chunk", "chunk_no", "running_bytes", "running_digest")


def decide(pages: DataFrame, least_bytes: int) -> DataFrame:
    """pages (page_id, url, payload, record) with payload_bytes, payload_digest and kept (page_id, record, url of the response that a revisit refers to; else null)."""
    sized = pages.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1(F.col("payload").cast("binary"))})
    repeats = (
        sized.where(F.col("payload_bytes") >= least_bytes)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct("page_id", "record", "url")).alias("kept"))
        .where("_n > 1 and kept.page_id is not null")
        .drop("_n")
    )
    met = sized.join(bounded(repeats), ["payload_digest", "payload_bytes"], "left")
    return met.withColumn("kept", F.when(F.coalesce(F.col("page_id") < F.col("kept.page_id"), F.lit(True)), F.col("kept")))


def chunk_table(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A row for each chunk of `payload`, in order: the other columns, chunk_no (from 0), last, chunk, running_bytes, running_digest."""
    others = [c for c in records.columns if c != "payload"]
    if not set(ADDED).isdisjoint(others):
        raise ValueError(f"columns of these names are added: {', '.join(ADDED)}")
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("payload") / chunk_bytes)).cast("int")
    rows = records.withColumns({"_bytes": F.col("payload").cast("binary"), "_n": n}).drop("payload").withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    rows = rows.select(*(F.col(f"`{c}`") for c in others), "chunk_no", (F.col("chunk_no") == F.col("_n") - 1).alias("last"), F.substring("_bytes", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes)).alias("chunk"))

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, total = hashlib.sha1(), 0
        for b in batches:
            totals, digests = [], []
            for number, chunk in zip(b.column("chunk_no").to_pylist(), b.column("chunk"), strict=True):
                if not number:
                    state, total = hashlib.sha1(), 0
                view = chunk.as_buffer()
                state.update(view)
                total += view.size
                totals.append(total)
                digests.append(state.hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(totals, pa.int64()), pa.array(digests, pa.string())], names=[*b.schema.names, "running_bytes", "running_digest"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(running, ", ".join([*(f"`{c}` {kinds[c]}" for c in rows.columns), "running_bytes long, running_digest string"]))


def header(name: str, value: Column) -> Column:
    """A header line, or nothing where value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def record_id(run: str, record: Column, chunk: Column) -> Column:
    """A UUID for a record of a run, the same however often a task is repeated."""
    h = F.md5(F.concat_ws(":", F.lit(run), record.cast("string"), chunk.cast("string")).cast("binary"))
    return F.when(record.isNotNull(), F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-8$3-8$4-$5"), F.lit(">")))


def encoded(url: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A"), "[\\x00-\\x1F\\x7F]", "%20")
    return F.coalesce(F.nullif(F.trim(plain), F.lit("")), F.lit(NO_URI))


def write(pages: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES, least_bytes: int = LEAST_BYTES, at: datetime | None = None) -> None:
    """Archives in `path` of pages (page_id, url, payload string), all captured at the time `at` (now)."""
    run, date = uuid.uuid4().hex, (at or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")
    records = pages.select("page_id", "url", F.coalesce("payload", F.lit("")).alias("payload"), F.monotonically_increasing_id().alias("record"))
    records = decide(records, least_bytes).withColumn("payload", F.when(F.col("kept").isNull(), F.col("payload")).otherwise(""))
    rows = chunk_table(records, chunk_bytes)
    segmented, opening, revisit = (F.col("chunk_no") > 0) | ~F.col("last"), F.col("chunk_no") == 0, F.col("kept").isNotNull()
    http = F.when(opening, F.lit(HTTP)).otherwise("")
    head = F.concat(
        F.lit(VERSION),
        header("WARC-Type", F.when(~opening, "continuation").when(revisit, "revisit").otherwise("response")),
        header("WARC-Record-ID", record_id(run, F.col("record"), F.col("chunk_no"))),
        header("WARC-Date", F.lit(date)),
        header("WARC-Target-URI", encoded(F.col("url"))),
        header("WARC-Payload-Digest", F.when(opening, F.concat(F.lit("sha1:"), "payload_digest"))),
        header("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        header("WARC-Refers-To", record_id(run, F.col("kept.record"), F.lit(0))),
        header("WARC-Refers-To-Target-URI", F.when(revisit, encoded(F.col("kept.url")))),
        header("WARC-Refers-To-Date", F.when(revisit, F.lit(date))),
        header("WARC-Segment-Number", F.when(segmented, F.col("chunk_no") + 1)),
        header("WARC-Segment-Origin-ID", F.when(~opening, record_id(run, F.col("record"), F.lit(0)))),
        header("WARC-Segment-Total-Length", F.when(segmented & F.col("last"), F.col("running_bytes") + len(HTTP))),
        header("X-Page-ID", F.when(opening, F.col("page_id"))),
        header("Content-Type", F.when(opening, F.lit("application/http; msgtype=response"))),
        header("Content-Length", F.octet_length("chunk") + F.octet_length(http)),
        F.lit("\r\n"),
        http,
    )
    rows.select(F.concat(head.cast("binary"), "chunk").cast("string").alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


FIELDS = ("record_id string, type string, url string, page_id long, refers string, stated string, segment int, origin string, chunk_no int, last boolean, chunk binary, running_bytes long, running_digest string").split(", ")
_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}


class Parser:
    """Takes the bytes of a file in parts of any size and gives the chunks of its records, as rows of FIELDS."""

    def __init__(self, name: str, chunk_bytes: int, singles: bool):
        self.name, self.chunk_bytes, self.singles = name, chunk_bytes, singles
        self.rest, self.left, self.fields = b"", None, {}

    def feed(self, data: bytes) -> Iterator[tuple]:
        data, at = self.rest + data, 0
        while True:
            if self.left is None:
                while at < len(data) and data[at] in b"\r\n":
                    at += 1
                end = data.find(b"\r\n\r\n", at)
                if end < 0:
                    if len(data) - at > HEADER_BYTES or not data[at : at + 7].startswith(b"WARC/1."[: len(data) - at]):
                        raise ValueError(f"no record where one must begin: {self.name}")
                    break
                self.open(data[at:end])
                at = end + 4
            part = memoryview(data)[at : at + self.left]
            at += len(part)
            self.left -= len(part)
            yield from self.body(part)
            if self.left:
                break
            yield from self.finish()
        self.rest = data[at:]

    def open(self, head: bytes) -> None:
        first, *lines = head.decode("utf-8", "replace").split("\r\n")
        if first not in ("WARC/1.0", "WARC/1.1"):
            raise ValueError(f"no record where one must begin: {self.name}")
        self.fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        if not self.fields.get("content-length", "").isdigit():
            raise ValueError(f"a record without length: {self.name}")
        self.left = int(self.fields["content-length"])
        self.http = b"" if self.fields.get("content-type", "").lower().startswith("application/http") else None  # the last bytes of an HTTP head that goes on
        self.state, self.total, self.number, self.held = hashlib.sha1(), 0, 0, []
        self.wanted = "warc-segment-number" in self.fields or self.singles

    def body(self, part: memoryview) -> Iterator[tuple]:
        if self.http is not None:
            seen = self.http + bytes(part)
            end = seen.find(b"\r\n\r\n")
            if end < 0:
                self.http = seen[-3:]
                return
            part, self.http = memoryview(seen)[end + 4 :], None
        for n in range(0, len(part), self.chunk_bytes):
            chunk = part[n : n + self.chunk_bytes]
            self.state.update(chunk)
            self.total += len(chunk)
            if self.wanted:
                if self.held:
                    yield self.row(False)
                self.held = [bytes(chunk)]

    def row(self, last: bool) -> tuple:
        f = self.fields
        url, page, number = f.get("warc-target-uri"), f.get("x-page-id"), f.get("warc-segment-number")
        chunk = (self.held or [b""])[0] if self.wanted else None
        self.number += 1
        return (f.get("warc-record-id"), f.get("warc-type"), None if url == NO_URI else url and url.strip("<>"), int(page) if page else None, f.get("warc-refers-to"), f.get("warc-payload-digest"), int(number) if number else None, f.get("warc-segment-origin-id"), self.number - 1, last, chunk, self.total, self.state.hexdigest())

    def finish(self) -> Iterator[tuple]:
        yield self.row(True)
        self.left, self.held = None, []

    def close(self) -> None:
        if self.left is not None or self.rest.strip(b"\r\n"):
            raise ValueError(f"a file ends within a record: {self.name}")


def read_chunks(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES, singles: bool = True) -> DataFrame:
    """The chunks of the payloads in the archives in `path`, and what the header of their record says.

    `stated` is the digest of the header; chunk_no counts within the record, and running_bytes and
    running_digest are those of its payload so far. Without `singles` a record that is not segmented is one row without chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = None
        for b in batches:
            files, value = b.column("file").to_pylist(), b.column("value")
            edges = [0, *(i for i in range(1, len(files)) if files[i] != files[i - 1]), len(files)]
            for start, stop in zip(edges, edges[1:], strict=False):
                if start == stop:
                    continue
                if parser is None or parser.name != files[start]:
                    if parser:
                        parser.close()
                    parser = Parser(files[start], chunk_bytes, singles)
                own = value.slice(start, stop - start)
                for s in steps([x.as_buffer().size + 1 for x in own], STEP_BYTES):
                    yield rows(list(parser.feed(b"\n".join(own.slice(s.start, s.stop - s.start).to_pylist()) + b"\n")))
        if parser:
            parser.close()

    def rows(found: list[tuple]) -> pa.RecordBatch:
        columns = zip(*found, strict=True) if found else [()] * len(FIELDS)
        return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[f.split()[1]]) for c, f in zip(columns, FIELDS, strict=True)], names=[f.split()[0] for f in FIELDS])

    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    return lines.mapInArrow(run, ", ".join(FIELDS))


def digests(chunks: DataFrame) -> DataFrame:
    """(origin, payload_bytes, payload_digest, segments) of segmented records: chunks in order of segment and number, hashed one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, total, n = None, hashlib.sha1(), 0, 0
        for b in batches:
            done = []
            for origin, number, chunk in zip(b.column("origin").to_pylist(), b.column("chunk_no").to_pylist(), b.column("chunk"), strict=True):
                if origin != now:
                    if now is not None:
                        done.append((now, total, state.hexdigest(), n))
                    now, state, total, n = origin, hashlib.sha1(), 0, 0
                view = chunk.as_buffer()
                state.update(view)
                total += view.size
                n += not number
            yield rows(done)
        yield rows([] if now is None else [(now, total, state.hexdigest(), n)])

    def rows(done: list) -> pa.RecordBatch:
        r, n, d, k = zip(*done, strict=True) if done else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(r, pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.string()), pa.array(k, pa.int32())], names=["origin", "payload_bytes", "payload_digest", "segments"])

    dealt = chunks.select("origin", "segment", "chunk_no", "chunk").repartition("origin").sortWithinPartitions("origin", "segment", "chunk_no")
    return dealt.select("origin", "chunk_no", "chunk").mapInArrow(run, "origin string, payload_bytes long, payload_digest string, segments int")


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each response, resource and revisit in the archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, segments.

    Length and digest of a response are those of the payload as read; those of a revisit are those of
    the record that it refers to, or the digest of its header.
    """
    found = cut(read_chunks(spark, path, singles=False).withColumn("origin", F.coalesce("origin", "record_id")))  # each file is parsed once
    single = found.where("segment is null and type in ('response', 'resource', 'revisit')").withColumns({"payload_bytes": F.col("running_bytes"), "payload_digest": F.col("running_digest"), "segments": F.lit(1)})
    parts = found.where("segment is not null")
    heads = parts.where("segment = 1 and chunk_no = 0 and type in ('response', 'resource', 'revisit')").select("origin", "record_id", "page_id", "url", "type", "refers", "stated")
    kept = ["record_id", "page_id", "url", "type", "refers", "stated", "payload_bytes", "payload_digest", "segments"]
    both = single.select(*kept).unionByName(heads.join(digests(parts), "origin").select(*kept))
    bare = F.regexp_replace("stated", "(?i)^sha1:", "")
    fits = F.col("stated").isNull() | (F.col("type") == "revisit") | ~F.lower("stated").startswith("sha1:") | F.lower(bare).eqNullSafe(F.col("payload_digest")) | (F.upper(bare) == base32(F.col("payload_digest")))
    sound = both.withColumn("payload_digest", F.when(fits, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("a payload does not fit its digest: "), F.col("stated"))).cast("string")))
    stored = sound.where("type <> 'revisit'")
    target = stored.select(F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("_b"), F.col("payload_digest").alias("_d"))
    again = sound.where("type = 'revisit'").drop("payload_bytes", "payload_digest").join(target, "refers", "left")
    shown = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "segments"]
    first = stored.withColumns({"record_type": F.col("type"), "refers_to": F.lit(None).cast("long")}).select(*shown)
    return first.unionByName(again.withColumns({"record_type": F.lit("revisit"), "payload_bytes": F.col("_b"), "payload_digest": F.coalesce("_d", F.lower(bare))}).select(*shown))


def base32(digest: Column) -> Column:
    """A hexadecimal SHA-1 in the base 32 that most archives have it in, 32 characters of five bits."""
    bits = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.lpad(F.conv(F.substr(digest, i, F.lit(1)), 16, 2), 4, "0")), "")
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.substr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.conv(F.substr(bits, i * 5 + 1, F.lit(5)), 2, 10).cast("int") + 1, F.lit(1))), "")


def op1_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write(table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").alias("payload")), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "segments")


#: DuckDB SQL for op1_warc_chunks; a page of several chunks has several segments.
SQL = f"""
with p as (select page_id, coalesce(html, '') as h, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as d from pages),
k as (select d, n, max(page_id) as kept from p where n >= {LEAST_BYTES} group by d, n)
select page_id, n as payload_bytes, d as payload_digest, case when kept > page_id or (page_id is null and kept is not null) then 'revisit' else 'response' end as record_type,
    case when kept > page_id or page_id is null then kept end as refers_to,
    cast(case when kept > page_id or (page_id is null and kept is not null) then 1 else greatest(1, ceil(n / {CHUNK_BYTES}.0)) end as int) as segments
from p left join k using (d, n)
"""
