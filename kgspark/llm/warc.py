"""WARC archives: a writer that stores equal payloads once, and a reader that salvages damaged archives.

Records are gzip members of their own. Spark's text writer commits them, so that a lost executor leaves no half archive:
each row is one member, read as characters of one byte each, and the line separator is a gzip member without content,
which readers of concatenated members skip.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm.common import attach, new_path, written

#: A gzip member without content: fixed by the gzip format.
EMPTY = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1.1\r\n"
#: Compressed bytes after which a task goes on to its next archive; an archive is read whole by one task.
ARCHIVE_BYTES = 32 << 20
#: A member that unpacks to more is a gap: a record's payload must fit into a cell.
MEMBER_BYTES = 1 << 30
DATE = "2024-01-01T00:00:00Z"
PARSED = "file string, offset long, length long, inner long, inner_length long, state string, record_id string, record_type string, refers_to string, payload_digest string, payload_bytes long, payload binary"
_START = re.compile(rb"WARC/1\.[01]\r\n")


def member(data: bytes) -> bytes:
    made = zlib.compressobj(3, zlib.DEFLATED, 31)
    return made.compress(data) + made.flush()


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, uri: str, digest: str, n_bytes: int, payload: bytes, refers_to: str | None = None) -> bytes:
    """An uncompressed record. The block of a revisit is empty; its payload's digest and length are in its header."""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:page:{record_id}>", "WARC-Date": DATE, "WARC-Target-URI": re.sub(r"[\r\n]", "", uri), "WARC-Payload-Digest": f"sha1:{digest}", "WARC-Payload-Length": n_bytes, "WARC-Block-Digest": f"sha1:{digest_of(payload)}"}
    if refers_to is not None:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    head |= {"Content-Type": "text/html", "Content-Length": len(payload)}
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode("utf-8", "surrogatepass") + b"\r\n" + payload + b"\r\n\r\n"


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes a record for each row of pages (page_id, url, html) to .warc.gz-style archives below path.

    Of rows with equal payloads the one with the largest page_id is the response and the others revisit it. A null html is
    an empty payload and a null url an empty one. Rows that repeat a page_id and its payload are responses like it; a row
    without a page_id revisits a row that has one, or is a response. Each task counts its archives from 0: archive N of
    task T is path/archive=N/part-T, of archive_bytes and at most one record more.
    """

    def responses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                out: dict[str, list] = {k: [] for k in ("page_id", "url", "sha1", "n_bytes", "body", "row")}
                for page_id, url, html, row in zip(*(c.to_pylist() for c in batch.slice(a, 256).columns), strict=True):
                    payload = (html or "").encode("utf-8", "surrogatepass")
                    digest = digest_of(payload)
                    body = member(record("response", "" if page_id is None else str(page_id), url or "", digest, len(payload), payload))
                    for k, v in zip(out, (page_id, url or "", hashlib.sha1(payload).hexdigest(), len(payload), body, row), strict=True):
                        out[k].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out["page_id"], pa.int64()), pa.array(out["url"], pa.string()), pa.array(out["sha1"], pa.string()), pa.array(out["n_bytes"], pa.int64()), pa.array(out["body"], pa.binary()), pa.array(out["row"], pa.int64())], names=list(out))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written_bytes = 0
        for batch in batches:
            bodies, archives = [], []
            for page_id, url, sha1, n_bytes, body, ref in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ref is not None and ref != page_id:
                    body = member(record("revisit", "" if page_id is None else str(page_id), url, base64.b32encode(bytes.fromhex(sha1)).decode(), n_bytes, b"", str(ref)))
                bodies.append(body)
                archives.append(written_bytes // archive_bytes)
                written_bytes += len(body)
            yield pa.RecordBatch.from_arrays([pa.array(bodies, pa.binary()), pa.array(archives, pa.int32())], names=["value", "archive"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.monotonically_increasing_id().alias("row"))
    digests = rows.select("page_id", F.sha1(F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))).alias("sha1"))
    equal = written(digests.groupBy("sha1").agg(F.max("page_id").alias("ref"), F.count("*").alias("n")).where("n > 1"), "equal-payloads")
    made = rows.mapInArrow(responses, "page_id long, url string, sha1 string, n_bytes long, body binary, row long")
    settled = attach(made, equal, "sha1", "n", digests.count(), "row")
    bodies = settled.select("page_id", "url", "sha1", "n_bytes", "body", F.col("found.ref").alias("ref")).mapInArrow(chosen, "value binary, archive int")
    lines = bodies.select(F.col("value").cast("string").alias("value"), "archive")
    lines.write.partitionBy("archive").option("lineSep", EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


def parse(data: bytes, at: int = 0) -> dict | None:
    """The fields of the uncompressed record that begins at a place of data, with its size, or None if a check fails."""
    found = _START.match(data, at)
    stop = data.find(b"\r\n\r\n", at) if found else -1
    if stop < 0:
        return None
    fields = {}
    for line in data[found.end() : stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        key = name.strip().lower().decode("latin-1")
        if not colon or (key in fields and key != "warc-concurrent-to"):  # a header that runs into another record's
            return None
        fields[key] = value.strip().decode("utf-8", "replace")
    try:
        n = int(fields["content-length"])
        known = int(fields.get("warc-payload-length", n))
    except (KeyError, ValueError):
        return None
    block = data[stop + 4 : stop + 4 + n] if n >= 0 else b""
    end = stop + 4 + n
    if len(block) != n or data[end : end + 4] != b"\r\n\r\n" or ("warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{digest_of(block)}"):
        return None
    own = lambda x: m[1] if (m := re.fullmatch(r"<urn:page:(.*)>", fields.get(x, ""))) else None
    return {
        "record_id": own("warc-record-id"), "record_type": fields.get("warc-type"), "refers_to": own("warc-refers-to"), "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:"), "payload_bytes": known,
        "payload": block, "size": end + 4 - at,
    }


def _member_at(data: bytes, at: int, most: int) -> tuple[bytes, int] | None:
    """The content of the gzip member at a place, and its end; None if it is damaged or unpacks to more than most bytes."""
    opened, parts, size = zlib.decompressobj(31), [], 0
    try:
        for a in range(at, len(data), 1 << 18):
            rest = data[a : a + (1 << 18)]
            while rest and not opened.eof:
                parts.append(opened.decompress(rest, most + 1 - size))
                size += len(parts[-1])
                if size > most:
                    return None
                rest = opened.unconsumed_tail
            if opened.eof:
                return b"".join(parts), min(a + (1 << 18), len(data)) - len(opened.unused_data)
    except zlib.error:
        pass
    return None


def _inside(content: bytes) -> Iterator[dict]:
    """The records of a member's content, and the gaps between them: inner and inner_length say where in the content."""
    at = gap = 0
    while at < len(content):
        if found := parse(content, at):
            if gap < at:
                yield {"state": "gap", "inner": gap, "inner_length": at - gap}
            yield {"state": "record", "inner": at, "inner_length": found["size"]} | found
            at = gap = at + found["size"]
        else:
            line = _START.search(content, at + 1)
            at = line.start() if line else len(content)
    if gap < at:
        yield {"state": "gap", "inner": gap, "inner_length": at - gap}


def salvage(data: bytes, most: int = MEMBER_BYTES) -> Iterator[dict]:
    """The records of an archive, plain or of gzip members, and the gaps that no record could be read from.

    offset and length are places in data, and the lengths of all rows add up to data's, but for empty members. A member
    may hold several records: its rows share its offset, the first has its length and the others 0, and inner and
    inner_length are places in what it unpacks to. Bytes of a member that are no record are a gap like any other.
    """
    at, bad = 0, None
    line = magic = -1  # the next version line and member after a place, so that each is searched for once
    while at < len(data):
        found, end = [], at
        if data.startswith(MAGIC, at):
            if (opened := _member_at(data, at, most)) is not None:
                found = list(_inside(opened[0]))
                if not opened[0] or any(x["state"] == "record" for x in found):
                    end = opened[1]
        elif _START.match(data, at) and (plain := parse(data, at)):
            found, end = [{"state": "record", "inner": None, "inner_length": None} | plain], at + plain["size"]
        if end > at:
            if bad is not None:
                yield {"state": "gap", "offset": bad, "length": at - bad}
                bad = None
            for i, row in enumerate(found):
                yield row | {"offset": at, "length": 0 if i else end - at}
            at = end
            continue
        bad = at if bad is None else bad
        if line <= at:
            line = found.start() if (found := _START.search(data, at + 1)) else len(data)
        if magic <= at:
            magic = place if (place := data.find(MAGIC, at + 1)) >= 0 else len(data)
        at = min(line, magic)
    if bad is not None:
        yield {"state": "gap", "offset": bad, "length": len(data) - bad}


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records and gaps (state) of all archives below path, as PARSED; an archive is one task's, whole.

    A failed check (member, version line, header, length or block digest) starts a search for the next member or version
    line that gives a valid record; the bytes between are one row with state gap, and are logged nowhere else. Spark
    refuses files over 2 GiB here (spark.sql.sources.binaryFile.maxLength).
    """
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("inner", pa.int64()), ("inner_length", pa.int64()), ("state", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows: list[dict] = []
                held = 0
                for row in salvage(content.as_buffer().to_pybytes()):
                    rows.append({f.name: row.get(f.name) for f in schema} | {"file": name.as_py()})
                    held += len(row.get("payload") or b"")
                    if len(rows) >= 1000 or held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(read, PARSED)


def archived(pages: DataFrame) -> DataFrame:
    """Writes pages to archives in the shared folder and returns what a reader finds there.

    A record that was lost, or bytes that are no record, are an error: what is read back must be what was written.
    """
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    found = read_archives(pages.sparkSession, path)
    found = written(found.select("state", F.col("record_id").try_cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to")), "warc-records")
    rows, gaps, records = pages.count(), *found.agg(F.count_if(F.col("state") == "gap"), F.count_if(F.col("state") == "record")).first()
    if gaps or records != rows:
        raise RuntimeError(f"{rows} pages were archived; {records} records and {gaps} gaps were read back")
    return found.drop("state")
