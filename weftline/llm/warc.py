"""Operator 8: WARC archives, written from pages and read back with segment reassembly.

Writing: equal payloads are found by digest, the smallest page is a response and the others are revisits, which name it;
payloads longer than a segment are continued in further records (Segment-Number, Segment-Origin-ID, the total length in the
last), and the HTTP body is framed in chunks. Every record is a gzip member of its own. Members go through Spark's text
writer, whose line separator is an empty gzip member, so that the files are plain concatenations of members, which any
reader of archives takes, and Spark can split them between records.
Reading: members are inflated and records framed by their Content-Length, whatever their bodies hold. Continuation
records are grouped by the identifier of their origin, ordered by number, checked against the total length, and the chunk
framing is decoded. Revisits are resolved to the response that they name and take its digest and length.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.lineage import Shelf, shared_folder

#: A payload of fewer bytes is always written in full.
LEAST_REVISIT = 100
#: Bytes of a record's block, beyond which it is continued.
SEGMENT = 16_384
CHUNK = 4_096
VERSION = b"WARC/1.1\r\n"
#: Effort of the compression.
LEVEL = 3
#: Bytes that are inflated at a time.
WINDOW = 1 << 16
#: Fixed value: a gzip member without content, each byte a character of Latin-1.
SEPARATOR = "\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """HTTP chunk framing of a payload."""
    parts = [payload[k : k + size] for k in range(0, len(payload), size)]
    return b"".join([b"%x\r\n%b\r\n" % (len(p), p) for p in parts] + [b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunk-framed body; ValueError if the framing is broken or incomplete. Extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size missing")
        size = int(body[at:end].split(b";", 1)[0], 16)
        at = end + 2
        if not size:
            if body[at:] != b"\r\n" and not body.endswith(b"\r\n\r\n"):
                raise ValueError("body goes on after its last chunk")
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk shorter than its size")
        out.append(body[at : at + size])
        at += size + 2


def record(kind: str, name: str, block: bytes, **headers) -> bytes:
    """One record."""
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", "WARC-Date: 1970-01-01T00:00:00Z", f"Content-Length: {len(block)}"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in headers.items() if v is not None]
    return VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(content: bytes) -> bytes:
    """A gzip member."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(content) + z.flush()


def _url(url: str | None) -> str:
    return "".join(c for c in url or "about:blank" if c > " ")


def _name(*parts) -> str:
    return f"urn:uuid:{uuid.UUID(bytes=hashlib.md5('/'.join(map(str, parts)).encode()).digest())}"


def records_of(page: int | None, url: str | None, payload: bytes, refers_to: int | None, name: str, target: str | None = None, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one page. target: the identifier of the response that a revisit refers to, where one record has it."""
    digest = hashlib.sha256(payload).hexdigest()
    common = {"WARC_Target_URI": _url(url), "WARC_Payload_Digest": f"sha256:{digest}", "Content_Type": "application/http;msgtype=response", "X_Page_Id": page}
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        block = head + b"\r\n"
        yield record("revisit", name, block, **common, WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", WARC_Refers_To=target and f"<{target}>", X_Refers_To_Page=refers_to)
        return
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        yield record("response", name, block, **common)
        return
    parts = [block[k : k + segment] for k in range(0, len(block), segment)]
    yield record("response", name, parts[0], **common, WARC_Segment_Number=1)
    for k, part in enumerate(parts[1:], 2):
        total = len(block) if k == len(parts) else None
        yield record("continuation", f"{name}-{k}", part, WARC_Target_URI=common["WARC_Target_URI"], WARC_Segment_Number=k, WARC_Segment_Origin_ID=f"<{name}>", WARC_Segment_Total_Length=total)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", segment: int = SEGMENT) -> None:
    """Writes gzip archives of all pages into the folder (a path that all executors share).

    Null html is an empty payload. Repeated rows make a record each; of equal payloads the rows with the smallest id
    (null ids last) are responses. A very long html is one record in segments of ``segment`` bytes, of which each is written whole;
    an empty table writes no record. Other columns are not read.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    named = rows.withColumn("digest", F.sha2("payload", 256))
    # only the narrow digests are grouped; groups of one page need no row
    by_page = named.where(F.length("payload") >= LEAST_REVISIT).groupBy("digest", "page_id").agg(F.count("*").alias("times"))
    first = by_page.groupBy("digest").agg(F.min("page_id").alias("first"), F.min_by("times", "page_id").alias("times"), F.sum("times").alias("n")).where("n > 1 and first is not null").select("digest", "first", (F.col("times") == 1).alias("single"))
    refers = F.when((F.col("page_id") != F.col("first")) | (F.col("page_id").isNull() & F.col("first").isNotNull()), F.col("first"))
    ready = named.join(first, "digest", "left").select("page_id", "url", "payload", refers.alias("refers_to"), F.when(F.col("single"), F.col("digest")).alias("known_by"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, k = task.partitionId() if task else 0, 0
        for batch in batches:
            out, held = [], 0
            for page, url, payload, refers, known_by in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                k += 1
                # a response that revisits refer to is named by its digest, unless its row is repeated: names are unique
                target = known_by and _name("response", known_by)
                name = target if known_by and refers is None else _name(part, k, page)
                for r in records_of(page, url, payload, refers, name, target, segment):
                    out.append(member(r))
                    held += len(out[-1])
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    # the text writer puts bytes as they are
    ready.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", SEPARATOR).option("encoding", "ISO-8859-1").text(folder)


def inflated(raw: bytes) -> Iterator[bytes]:
    """The content of gzip members one after the other, in parts; of bytes that are not compressed, themselves."""
    if raw[:2] != b"\x1f\x8b":
        yield raw
        return
    view, at = memoryview(raw), 0
    while at < len(raw):
        z = zlib.decompressobj(31)
        while not z.eof:
            if at >= len(raw):
                raise ValueError("a gzip member is incomplete")
            part = z.decompress(view[at : at + WINDOW])
            at = min(len(raw), at + WINDOW) - len(z.unused_data)
            if part:
                yield part


def parse_records(parts: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a stream, framed by Content-Length; any version of the format."""
    held, parts = bytearray(), iter(parts)

    def more() -> bool:
        part = next(parts, None)
        if part is not None:
            held.extend(part)
        return part is not None

    while True:
        while held[:2] == b"\r\n":  # the lines that close a record
            del held[:2]
        if len(held) < 2:
            if more():
                continue
            if held:
                raise ValueError("bytes after the last record")
            return
        seen = 0
        while (end := held.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(held) - 3)
            if not more():
                raise ValueError("a record's header is incomplete")
        version, *lines = bytes(held[:end]).decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record begins with {version[:20]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(headers["content-length"])
        while len(held) < end + 4 + size:
            if not more():
                raise ValueError(f"record {headers.get('warc-record-id')} is shorter than its length")
        block = bytes(held[end + 4 : end + 4 + size])
        del held[: end + 4 + size]
        yield headers, block


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP message, its transfer framing decoded."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


_RECORD = "type string, name string, origin string, segment int, total long, page_id long, refers_to long, target string, digest string, block binary"


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the archives in the folder, one row each.

    Files of write_archives are split between records. Other archives, compressed by record, as a whole or not at all, are read
    too, each file by one task that holds its bytes as stored (as inflated, if Spark takes them for a gzip file by their name).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _RECORD.split(", ")]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            rows, held = [], 0
            for raw in batch.column(0).to_pylist():
                for h, block in parse_records(inflated(raw)) if raw else ():
                    number = lambda k, h=h: int(h[k]) if k in h else None
                    bare = lambda k, h=h: h[k].strip("<>") if k in h else None
                    name = bare("warc-record-id")
                    origin = bare("warc-segment-origin-id") or (name if "warc-segment-number" in h else None)
                    algorithm, _, digest = h.get("warc-payload-digest", "").rpartition(":")
                    rows.append((h["warc-type"], name, origin, number("warc-segment-number"), number("warc-segment-total-length"), number("x-page-id"), number("x-refers-to-page"), bare("warc-refers-to"), digest if algorithm == "sha256" else None, block))
                    held += len(block)
                    if held > 8 << 20:
                        yield table(rows)
                        rows, held = [], 0
            if rows:
                yield table(rows)

    lines = spark.read.option("lineSep", SEPARATOR).option("encoding", "ISO-8859-1").text(folder).select(F.col("value").cast("binary").alias("value"))
    return lines.mapInArrow(run, _RECORD)


def reassemble(records: DataFrame) -> DataFrame:
    """Records with segmented ones whole again: continuation records join their origin in the order of their numbers.

    A missing segment or a wrong total length is an error. A group holds one payload's segments, so it is as
    large as one record.
    """
    whole = records.where("origin is null")
    first = lambda c: F.max_by(c, -F.col("segment")).alias(c)
    parts = records.where("origin is not null").groupBy("origin").agg(
        *[first(c) for c in ("type", "name", "page_id", "refers_to", "target", "digest")],
        F.max("total").alias("total"), F.count("*").alias("n"), F.max("segment").alias("last"),
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"),
    )
    block = F.array_join(F.transform("parts", lambda p: p["block"].cast("string")), "").cast("binary")  # bytes as they are, joined once
    joined = parts.withColumn("block", block).withColumn("block", F.when((F.length("block") == F.col("total")) & (F.col("n") == F.col("last")), F.col("block")).otherwise(F.raise_error(F.concat(F.lit("segments of "), "origin", F.lit(" do not add up"))).cast("binary")))
    return whole.unionByName(joined.select("type", "name", "origin", F.lit(1).alias("segment"), "total", "page_id", "refers_to", "target", "digest", "block"))


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """One row per page record: page_id, payload_bytes, payload_digest, record_type, refers_to (and the payload; null for revisits).

    A response's length and digest are computed from the payload read; the digest must equal the one that its record states. A
    revisit takes both from the response that it refers to, found by digest and page, whose identifier must be the one it
    names, if it names one: a revisit without its response is an error. Other kinds of records are passed over. Null ids come
    back null, repeated rows each as a row, very long payloads whole, and a folder without records as no rows.
    """
    records = reassemble(read_records(spark, folder)).where("type in ('response', 'revisit')").select("page_id", "name", "type", "refers_to", "target", "digest", "block")
    schema = "page_id long, name string, record_type string, refers_to long, target string, digest string, bytes long" + (", payload binary" if with_payload else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, payloads = [], [], []
            for kind, stated, block in zip(*(batch.column(c).to_pylist() for c in ("type", "digest", "block")), strict=True):
                payload, size, digest = None, None, stated
                if kind == "response":
                    payload = http_payload(block)
                    size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    if stated is not None and stated != digest:
                        raise ValueError("a payload differs from its record's digest")
                sizes.append(size)
                digests.append(digest)
                payloads.append(payload)
            columns = [*(batch.column(c) for c in ("page_id", "name", "type", "refers_to", "target")), pa.array(digests, pa.string()), pa.array(sizes, pa.int64())]
            names = ["page_id", "name", "record_type", "refers_to", "target", "digest", "bytes"]
            if with_payload:
                columns.append(pa.array(payloads, pa.binary()))
                names.append("payload")
            yield pa.RecordBatch.from_arrays(columns, names)

    found = Shelf(spark).put(records.mapInArrow(run, schema))
    revisits = found.where("record_type = 'revisit'")
    # only responses that are referred to, so one narrow row for each
    wanted = revisits.select("digest", F.col("refers_to").alias("page")).distinct()
    responses = found.where("record_type = 'response'").select("digest", F.col("page_id").alias("page"), "name", "bytes").join(wanted, ["digest", "page"], "left_semi")
    responses = responses.groupBy("digest", "page").agg(F.max("bytes").alias("found_bytes"), F.min("name").alias("least"), F.max("name").alias("most"))
    joined = revisits.join(responses, (revisits["digest"] == responses["digest"]) & (revisits["refers_to"] == responses["page"]), "left").drop(responses["digest"])
    wrong = F.col("found_bytes").isNull() | (F.col("target").isNotNull() & ~F.col("target").between(F.col("least"), F.col("most")))
    resolved = joined.withColumn("bytes", F.when(wrong, F.raise_error(F.concat(F.lit("a revisit does not find its response: "), F.coalesce("name", F.lit("?")))).cast("long")).otherwise(F.col("found_bytes")))
    more = ["payload"] if with_payload else []
    columns = ["page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to", *more]
    return found.where("record_type = 'response'").select(*columns).unionByName(resolved.select(*columns))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(spark, folder)


ORACLE = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
