"""WARC archives: deduplicated writing in segments, and reassembly of what was written."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._spark import keyed_join, new_path, numbered_copies, small_batches, stage, with_might_hold

#: Payloads of at least this many bytes may be stored once.
REVISIT_BYTES = 1000
#: Largest block of one record; longer responses, most pages, continue in further records.
SEGMENT_BYTES = 2 << 10
#: Largest chunk of the chunked transfer framing.
CHUNK_BYTES = 1 << 10
#: Records go to files in groups of about GROUP_BYTES before compression, GROUPS_A_FILE of them in a file.
GROUP_BYTES, GROUPS_A_FILE = 4 << 20, 8
#: Digests up to this number are broadcast.
BROADCAST_ROWS = 200_000
#: A gzip member without content: what Spark's writer puts after each group.
NO_MEMBER = b"\x1f\x8b\x08" + bytes(6) + b"\x03\x03" + bytes(9)
#: Bytes of a file that are looked at in one step.
STEP = 16 << 10
CRLF2 = b"\r\n\r\n"


def _head(fields: list[tuple[str, object]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields)).encode() + b"\r\n"


def _uri(url: str | None) -> str:
    """A target URI that fits a header line."""
    return "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "about:blank")


def _chunked(body: bytes) -> bytes:
    out = [b"%x\r\n%s\r\n" % (len(c := body[i : i + CHUNK_BYTES]), c) for i in range(0, len(body), CHUNK_BYTES)]
    return b"".join(out) + b"0\r\n\r\n"


def dechunk(body: bytes) -> bytes:
    """Undo chunked transfer framing; raises ValueError when it is cut short or malformed."""
    out, at = [], 0
    while True:
        eol = body.index(b"\r\n", at)
        n = int(body[at:eol].split(b";")[0], 16)
        at = eol + 2
        if n == 0:
            return b"".join(out)
        if len(body) < at + n + 2 or body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk cut short")
        out.append(body[at : at + n])
        at += n + 2


def records_of(page_id, url, html: bytes, sha1: str, keep_id) -> Iterator[bytes]:
    """The WARC records of one page, each with its closing CRLFs; a revisit if keep_id is given."""
    rid = f"<urn:page:{page_id}:{sha1[:16]}>"
    common = [("WARC-Target-URI", _uri(url)), ("WARC-Date", "2000-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{sha1}")]
    if keep_id is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html)
        yield _head([("WARC-Type", "revisit"), ("WARC-Record-ID", rid), *common, ("WARC-Refers-To", f"<urn:page:{keep_id}:{sha1[:16]}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block))]) + block + CRLF2
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + _chunked(html)
    parts = [block[i : i + SEGMENT_BYTES] for i in range(0, len(block), SEGMENT_BYTES)]
    for k, part in enumerate(parts, 1):
        kind = [("WARC-Type", "response" if k == 1 else "continuation"), ("WARC-Record-ID", rid if k == 1 else f"<urn:page:{page_id}:{sha1[:16]}:{k}>"), *common]
        if len(parts) > 1:
            kind.append(("WARC-Segment-Number", k))
            if k > 1:
                kind.append(("WARC-Segment-Origin-ID", rid))
            if k == len(parts):
                kind.append(("WARC-Segment-Total-Length", len(block)))
        yield _head([*kind, ("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(part))]) + part + CRLF2


def member(record: bytes) -> bytes:
    """A record as one gzip member."""
    z = zlib.compressobj(3, zlib.DEFLATED, 31, 8)
    return z.compress(record) + z.flush()


def info_record() -> bytes:
    """What opens each group of records."""
    block = b"software: tallyline\r\nformat: WARC File Format 1.1\r\n"
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:info:group>"), ("WARC-Date", "2000-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields"), ("Content-Length", len(block))]
    return _head(fields) + block + CRLF2


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = REVISIT_BYTES) -> None:
    """Write WARC files of all pages to the folder `path`, a gzip member a record.

    Payload: html in UTF-8, null is empty. Of records with equal payloads (SHA-256, as
    SHA-1 can be made to collide) of min_bytes at least, those with the largest id are
    responses and the others revisits of them; smaller payloads are all responses. A null
    id is a response. Digests are grouped with a map-side aggregate, and those that repeat
    are staged. While few they are broadcast; beyond that only pages that may have one
    (told by a bitmap) meet them by a shuffle, hot digests apart, see keyed_join. Spark's
    own writer makes the files, so any file system that it knows will do; it ends each
    group of records with its line separator, here a gzip member without content.
    """
    small_batches(pages.sparkSession)
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    src = src.withColumn("sha", F.when(F.length("html") >= min_bytes, F.unhex(F.sha2("html", 256))))
    digest = src.filter("sha is not null").groupBy("sha").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("n"))
    twice = stage(digest.filter("n > 1"), "digests")
    n_twice, n_rows = twice.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if n_twice <= BROADCAST_ROWS:
        full = src.join(F.broadcast(twice), "sha", "left")
    else:
        told = with_might_hold(src, F.xxhash64("sha"), twice.select(F.xxhash64("sha").alias("k")), n_twice, "may").withColumn("may", F.col("may") & F.col("sha").isNotNull())
        alone = told.filter(~F.col("may")).withColumn("keep", F.lit(None).cast(twice.schema["keep"].dataType)).withColumn("n", F.lit(0).cast("bigint"))
        full = keyed_join(told.filter("may"), twice, ["sha"], "n", n_rows).unionByName(alone)
    full = full.select("id", "url", "html", F.sha1("html").alias("sha1"), F.when(F.col("id") < F.col("keep"), F.col("keep")).alias("keep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, size = [member(info_record())], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([b"".join(group)], pa.binary())], ["value"])

        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                for r in batch.slice(at, 16).to_pylist():
                    for rec in records_of(r["id"], r["url"], r["html"], r["sha1"], r["keep"]):
                        group.append(member(rec))
                        size += len(rec)
                        if size >= GROUP_BYTES:
                            yield flush()
                            group, size = [member(info_record())], 0
        if size:
            yield flush()

    blocks = full.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    # one byte a character: the separator's bytes as they are
    w = blocks.write.option("encoding", "ISO-8859-1").option("lineSep", NO_MEMBER.decode("latin-1"))
    w.option("maxRecordsPerFile", GROUPS_A_FILE).text(path)


def parse_warc(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of a decompressed stream."""
    buf = b""

    def more() -> bool:
        nonlocal buf
        nxt = next(chunks, None)
        if nxt is None:
            return False
        buf += nxt
        return True

    while True:
        while (end := buf.find(CRLF2)) < 0:
            if not more():
                if buf.strip():
                    raise ValueError("record header cut short")
                return
        head = buf[:end].decode("utf-8", "replace").split("\r\n")
        if not head[0].startswith("WARC/"):
            raise ValueError(f"not a record: {head[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
        size = int(fields["content-length"])
        need = end + 4 + size + 4
        got, held = len(buf), [buf]
        while got < need:
            nxt = next(chunks, None)
            if nxt is None:
                raise ValueError("record block cut short")
            held.append(nxt)
            got += len(nxt)
        buf = b"".join(held)
        yield fields, buf[end + 4 : need - 4]
        buf = buf[need:]


def _inflate(content: bytes) -> Iterator[bytes]:
    """Decompressed parts of a gzip file with one or many members; other bytes pass as they are."""
    at = 0
    while at < len(content):
        if content[:2] != b"\x1f\x8b":
            yield content[at : at + STEP]
            at += STEP
            continue
        d = zlib.decompressobj(31)
        while not d.eof:
            part = content[at : at + STEP]
            if not part:
                raise ValueError("gzip member cut short")
            out = d.decompress(part)
            at += len(part) - len(d.unused_data)
            if out:
                yield out


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of all files: record_id, type, origin, segment, total, refers_to, digest, block, copies.

    Records that a file holds more than once within about GROUP_BYTES come as one row,
    copies says how many they are; so a record that an archive repeats without end does
    not fill a task that gathers its parts.
    """
    schema = "record_id string, type string, origin string, segment int, total bigint, refers_to string, digest string, block binary, copies bigint"
    types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64()]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(found):
            rows = [(*row, n) for row, n in found.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            for content in batch.column("content"):
                found, size = {}, 0
                for f, block in parse_warc(_inflate(content.as_py())):
                    num = f.get("warc-segment-number")
                    total = f.get("warc-segment-total-length")
                    rid = f["warc-record-id"]
                    row = (rid, f["warc-type"], f.get("warc-segment-origin-id") or rid, int(num) if num else None, int(total) if total else None, f.get("warc-refers-to"), f.get("warc-payload-digest"), block)
                    found[row] = found.get(row, 0) + 1
                    size += len(block)
                    if size >= GROUP_BYTES:
                        yield flush(found)
                        found, size = {}, 0
                if found:
                    yield flush(found)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def _payload(block: bytes) -> tuple[bytes, dict[str, str]]:
    """HTTP body without transfer framing, and the HTTP header fields."""
    head, _, body = block.partition(CRLF2)
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
    return (dechunk(body) if "chunked" in fields.get("transfer-encoding", "").lower() else body), fields


def reassemble(records: DataFrame) -> DataFrame:
    """record_id, type, refers_to, payload, payload_bytes, payload_digest, complete: one row per logical record.

    Unsegmented records are decoded where they are read. Segments are grouped by origin
    identifier, put in order of segment number and checked: numbers 1 to n without gap,
    a stated total length equal to what is there. A record that fails, or whose framing
    is broken, comes back with complete = false and a null payload. A revisit has no
    payload; its digest and length are those its headers state. warcinfo records hold no
    payload and give no row. Segments travel once, by origin; there a record that the
    archive repeats is counted before it is grouped, so a group is one record, never more
    than one page, and it comes back as often.
    """
    shape = "record_id string, type string, refers_to string, payload binary, payload_bytes bigint, payload_digest string, complete boolean, copies bigint"

    def finish(rid, kind, refers, digest, block) -> tuple:
        try:
            body, http = _payload(block)
        except ValueError:
            return rid, kind, refers, None, None, None, False
        if kind == "revisit":
            return rid, kind, refers, None, int(http.get("content-length", 0)), (digest or "").removeprefix("sha1:"), True
        sha = hashlib.sha1(body).hexdigest()
        return rid, kind, refers, body, len(body), sha, not (digest or "").startswith("sha1:") or digest == f"sha1:{sha}"

    types = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.int64()]
    names = [x.split()[0] for x in shape.split(", ")]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(*finish(r["record_id"], r["type"], r["refers_to"], r["digest"], r["block"]), r["copies"]) for r in b.to_pylist()]
            if rows:
                yield table(rows)

    def joined(origin: str, parts: list[dict]) -> tuple:
        first, last = parts[0], parts[-1]
        block = b"".join(p["block"] for p in parts)
        whole = [p["segment"] for p in parts] == list(range(1, len(parts) + 1)) and last["total"] == len(block) and len({p["copies"] for p in parts}) == 1
        row = finish(origin, first["type"], first["refers_to"], first["digest"], block) if whole else (origin, first["type"], None, None, None, None, False)
        return *row, min(p["copies"] for p in parts)

    def join_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                yield table([joined(r["origin"], sorted(r["parts"], key=lambda p: p["segment"])) for r in b.slice(at, 64).to_pylist()])

    small_batches(records.sparkSession)
    some = records.filter("type <> 'warcinfo'")
    alone = some.filter("segment is null").mapInArrow(single, shape)
    same = [F.first(c).alias(c) for c in ("type", "refers_to", "digest", "block")]
    # dealt by origin alone, which both groupings can use
    dealt = some.filter("segment is not null").repartition("origin")
    parts = dealt.groupBy("origin", "segment").agg(*same, F.max("total").alias("total"), F.sum("copies").alias("copies"))
    part = F.struct("segment", "type", "refers_to", "digest", "block", "total", "copies")
    long = parts.groupBy("origin").agg(F.collect_list(part).alias("parts")).mapInArrow(join_parts, shape)
    return numbered_copies(alone.unionByName(long), "copies", "copy").drop("copies", "copy")


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the pages' archive to the shared folder and read it back: see write_warc and reassemble.

    Adds page_id and refers_to_page, taken from the record identifiers. Repeated page
    rows have a record each.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_warc(pages, path, id_col, url_col, html_col)
    out = reassemble(read_warc(spark, path))

    def page(c: str):
        return F.regexp_extract(c, r"^<urn:page:(-?\d+|None):", 1).try_cast("bigint")

    return out.withColumn("page_id", page("record_id")).withColumn("refers_to_page", F.when(F.col("refers_to").isNotNull(), page("refers_to")))
