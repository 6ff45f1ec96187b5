"""WARC archives: writing pages as segmented records and reading them back by segment reassembly.

``write`` turns each page into an HTTP response in chunked transfer framing, cuts blocks over ``segment`` bytes into one
first record and continuation records, and leaves gzip-compressed archives in a folder. Of pages with equal payloads of
at least ``least`` bytes, the one with the smallest id is a response and the others are revisit records without a body.
``read`` parses every archive (plain, or gzip of any number of members), groups continuation records by their origin's id, orders them by segment number, verifies
the total length, and decodes the chunked framing. A record whose segments are missing or too short comes out with
``complete`` false and no payload, never half a payload. Broken numbers read as none; behind a broken length a record ends
where the next begins.

Null payloads are empty; a null id or url leaves its field out and reads back as null; rows that are repeated exactly
give equal records, of which each is read back; rows of one id with different payloads stay apart; an empty table gives
archives without records; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import cut

SEGMENT = 64 << 10
CHUNK = 16 << 10
LEAST = 100
#: Records of one archive; with SEGMENT this bounds an archive's size.
RECORDS = 1024
#: Most repeated digests that are sent to all executors, and the tasks over which a common one is dealt beyond it.
BROADCAST_DIGESTS = 100_000
SALT = 32
DATE = "2024-01-01T00:00:00Z"
END = b"\r\n\r\n"

RECORD = "record_id string, origin_id string, segment int, total bigint, kind string, page_id bigint, url string, refers_to bigint, payload_bytes bigint, payload_digest string, block binary"
PAGE = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, complete boolean, payload binary"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Payload in HTTP/1.1 chunked transfer framing."""
    parts = []
    for a in range(0, len(payload), size):
        piece = payload[a : a + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes | None:
    """Payload of chunked framing, extensions and trailers ignored; None if it is broken or cut short."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            return None
        try:
            size = int(body[at:line].split(b";")[0].strip(), 16)
        except ValueError:
            return None
        if size == 0:
            return b"".join(out)
        at = line + 2
        if size < 0 or body[at + size : at + size + 2] != b"\r\n":
            return None
        out.append(body[at : at + size])
        at += size + 2


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"{head}Content-Length: {len(block)}\r\n\r\n".encode() + block


def _name(page_id: int | None, url: str | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{hashlib.sha256(repr(url).encode()).hexdigest()[:8]}{digest[:24]}>"


def records_of(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, segment: int, refers_url: str | None = None) -> list[bytes]:
    """The records of one page, without the blank lines that end them; a revisit names the response by its id and url."""
    target = None if url is None else quote(url, safe=":/?#[]@!$&'()*+,;=%~-._")
    own = _name(page_id, url, digest)
    common = [("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Target-URI-Raw", None if url is None or unquote(target) == url else url.encode().hex()), ("Page-Id", page_id), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if refers_to is not None:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        return [_record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _name(refers_to, refers_url, digest)), ("WARC-Refers-To-Target-URI", None if refers_url is None else quote(refers_url, safe=":/?#[]@!$&'()*+,;=%~-._")), ("Content-Type", "application/http; msgtype=response")], block)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    pieces = [block[a : a + segment] for a in range(0, len(block), segment)]
    first = [("WARC-Type", "response"), ("WARC-Record-ID", own), *common, ("Content-Type", "application/http; msgtype=response")]
    if len(pieces) == 1:
        return [_record(first, block)]
    out = [_record([*first, ("WARC-Segment-Number", 1)], pieces[0])]
    for k, piece in enumerate(pieces[1:], 2):
        last = len(block) if k == len(pieces) else None
        out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{own[:-1]}:{k}>"), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", last), ("WARC-Date", DATE), ("WARC-Target-URI", target)], piece))
    return out


def plan(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST) -> DataFrame:
    """Pages with payload, digest, and the id that a revisit refers to."""
    own = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    own = own.withColumn("digest", F.sha2("payload", 256))
    named = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    shared = own.where(F.length("payload") >= least).groupBy(F.col("digest").alias("_d")).agg(F.count("*").alias("_n"), F.min(named).alias("_f")).where("_n > 1 AND _f IS NOT NULL")
    shared = cut(shared.select("_d", F.col("_f.page_id").alias("_first"), F.col("_f.url").alias("_url")))
    if shared.count() <= BROADCAST_DIGESTS:  # no payload is shuffled
        joined = own.join(F.broadcast(shared), F.col("digest") == F.col("_d"), "left")
    else:  # the rows of a common digest are dealt over SALT tasks
        salted = shared.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        joined = own.withColumn("_p", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int")).join(salted, (F.col("digest") == F.col("_d")) & (F.col("_p") == F.col("_s")), "left")
    revisit = ~F.col("page_id").eqNullSafe(F.col("_first"))
    return joined.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("_first")).alias("refers_to"), F.when(revisit, F.col("_url")).alias("refers_url"))


def write(pages: DataFrame, folder: str, segment: int = SEGMENT, records: int = RECORDS, **names) -> None:
    """Archives of all pages under folder, through Spark's own writer, so that any store it knows will do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                rows = batch.slice(a, 256).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([x for r in rows for x in records_of(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"], segment, r["refers_url"])], pa.binary())], ["record"])

    made = plan(pages, **names).mapInArrow(run, "record binary")
    # each line of the text sink is one record, parted by the blank lines that the format asks for
    made.select(F.col("record").cast("string").alias("value")).write.mode("overwrite").option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", records).text(folder)


def unpacked(raw: bytes) -> bytes:
    """Content of an archive: of all its gzip members, of which standard archives have one for each record."""
    if raw[:2] != b"\x1f\x8b":
        return raw
    with gzip.GzipFile(fileobj=io.BytesIO(raw)) as members:
        return members.read()


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record; blocks are taken by their stated length."""
    at = 0
    while at < len(data):
        stop = data.find(END, at)
        if stop < 0:
            return
        lines = data[at:stop].decode("utf-8", "replace").split("\r\n")
        fields = {}
        for line in lines[1:]:
            k, _, v = line.partition(":")
            fields[k.strip().lower()] = v.strip()
        size = _number(fields.get("content-length"))
        if size is None:  # a broken length: the block ends where the next record begins
            after = data.find(END + b"WARC/", stop + 4)
            size = (after if after >= 0 else len(data)) - stop - 4
        yield fields, data[stop + 4 : stop + 4 + size]
        at = stop + 4 + size
        while data[at : at + 2] == b"\r\n":
            at += 2


def _number(value: str | bytes | None) -> int | None:
    """A count or id; None where there is none or it is broken."""
    try:
        return int(value) if value else None
    except ValueError:
        return None


def _page_of(name: str | None) -> int | None:
    """Page id that a record name of this writer holds."""
    parts = (name or "").strip("<>").split(":")
    return _number(parts[2]) if parts[:2] == ["urn", "page"] and len(parts) > 3 else None


def _parsed(fields: dict[str, str], block: bytes) -> tuple:
    raw, target = fields.get("warc-target-uri-raw"), fields.get("warc-target-uri")
    try:
        url = bytes.fromhex(raw).decode() if raw else unquote(target) if target is not None else None
    except ValueError:
        url = target
    kind, own = fields.get("warc-type", ""), fields.get("warc-record-id", "")
    size = None
    if kind == "revisit":
        for line in block.split(b"\r\n"):
            if line.lower().startswith(b"content-length:"):
                size = _number(line.split(b":")[1])
    number = lambda k: _number(fields.get(k))
    page_id = number("page-id") if "page-id" in fields else _page_of(own)
    return own, fields.get("warc-segment-origin-id", own), number("warc-segment-number"), number("warc-segment-total-length"), kind, page_id, url, _page_of(fields.get("warc-refers-to")), size, fields.get("warc-payload-digest", "").removeprefix("sha256:"), block


def _page(head: tuple, block: bytes | None) -> tuple:
    """Row of a whole record; block is None if segments are missing."""
    _, _, _, _, kind, page_id, url, refers_to, size, digest, _ = head
    if kind == "revisit":
        return page_id, url, kind, refers_to, size, digest, True, None
    payload = None
    if block is not None:
        top, _, body = block.partition(END)
        payload = unchunked(body) if b"transfer-encoding: chunked" in top.lower() else body
    if payload is None:
        return page_id, url, kind, None, None, digest, False, None
    return page_id, url, kind, None, len(payload), hashlib.sha256(payload).hexdigest(), True, payload


def assemble(rows: list[tuple]) -> list[tuple]:
    """Pages of the segments of one origin; equal rows written more than once give as many equal pages."""
    parts: dict[int, list[tuple]] = {}
    for row in rows:
        parts.setdefault(row[2] or 1, []).append(row)
    heads = parts.get(1, [])
    copies = len(heads)
    last = max(parts)
    total = next((r[3] for r in parts[last] if r[3] is not None), None)
    whole = copies and all(k in parts and len(parts[k]) == copies for k in range(1, last + 1))
    block = b"".join(parts[k][0][10] for k in range(1, last + 1)) if whole else None
    if block is not None and total is not None and len(block) != total or total is None:
        block = None
    return [_page(h, block) for h in heads]


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


RECORD_ARROW = pa.schema([("record_id", pa.string()), ("origin_id", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("kind", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("block", pa.binary())])
PAGE_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("complete", pa.bool_()), ("payload", pa.binary())])


def _scan(archives: DataFrame, segmented: bool) -> DataFrame:
    """Whole records as pages, or the segments of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                raw = data.as_py()
                rows, held = [], 0
                for fields, block in parse(unpacked(raw)):
                    if fields.get("warc-type") not in ("response", "revisit", "continuation"):
                        continue
                    if bool(fields.get("warc-segment-number")) is segmented:
                        row = _parsed(fields, block)
                        rows.append(row if segmented else _page(row, block))
                        held += len(block)
                        if held > 4 << 20:
                            yield _arrow(rows, RECORD_ARROW if segmented else PAGE_ARROW)
                            rows, held = [], 0
                yield _arrow(rows, RECORD_ARROW if segmented else PAGE_ARROW)

    return archives.mapInArrow(run, RECORD if segmented else PAGE)


def read(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """Pages of all archives under folder. Only records in segments are shuffled; payload=False leaves the payloads in the workers."""
    archives = spark.read.format("binaryFile").load(folder).where(F.col("length") > 0).select("content")

    def join(key: tuple, rows: pa.Table) -> pa.Table:
        made = assemble([tuple(r.values()) for r in rows.to_pylist()])
        return pa.Table.from_batches([_arrow(made, PAGE_ARROW)])

    pages = _scan(archives, False).unionByName(_scan(archives, True).groupBy("origin_id").applyInArrow(join, PAGE))
    return pages if payload else pages.drop("payload")
