"""WARC archives: a writer, and a reader that splits compressed files.

A record is a gzip member of its own. The reader deals each file out in byte ranges; a task looks for gzip's magic bytes
in its range, takes a place for a member's start only if what it inflates begins as a WARC record, reads that member to
its end (beyond the range, if need be) and goes on behind it. A record belongs to the range that it starts in, so each is
read once, whatever the ranges.

Cases: a null payload is empty; null and control characters in a url are escaped; magic bytes within compressed data are
no start, as they don't inflate to a record's header; a damaged or cut-off member is passed over; repeated rows are written
as records of their own, all of them responses if theirs is the largest id; a null id is the smallest, and pages that
all have none are responses; no pages make no archive and an empty result. Other columns are ignored. A task holds one record
at a time, whatever its length. Writers of lost tasks leave files that no listing names, and so no reader sees.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator
from hashlib import sha1
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm.common import cut, shared_dir, shuffle_width

MAGIC = b"\x1f\x8b\x08"
START = b"WARC/1."
#: Bytes of a range; and those that are read at a time.
RANGE, CHUNK = 4 << 20, 1 << 18
#: Payloads of fewer bytes are always written whole.
LEAST_BYTES = 0
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(sha1(payload).digest()).decode()


def record(record_id: str, url: str | None, payload: bytes, refers_to: str | None, revisit: bool) -> bytes:
    """One compressed record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (b"" if revisit else payload)
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:page:{record_id}>",
        "WARC-Target-URI": quote(url or "", safe="/:?#[]@!$&'()*+,;=%-._~"),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Payload-Digest": f"sha1:{digest_of(payload)}",
        **({"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": PROFILE} if revisit else {}),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n") + z.flush()


def roles(pages: DataFrame, id_col: str, payload_col: str, least: int = LEAST_BYTES) -> DataFrame:
    """pages with revisit and refers_to: of equal payloads that with the largest id is kept whole, and the others refer to it."""
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    narrow = pages.select(F.col(id_col).alias("_id"), F.sha1(payload).alias("_digest"), F.length(payload).alias("_n")).where(F.col("_n") >= least)
    best = narrow.groupBy("_digest").agg(F.max("_id").alias("_best"))
    chosen = narrow.distinct().join(best, "_digest").where("_best is not null and not (_id <=> _best)")
    same = pages[id_col].eqNullSafe(chosen["_id"]) & (F.sha1(payload) == chosen["_digest"])
    return pages.join(chosen.select("_id", "_digest", "_best"), same, "left").select(*(pages[c] for c in pages.columns), F.col("_best").isNotNull().alias("revisit"), F.col("_best").alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """(path, bytes, records) of the archives written to folder, a uri that pyarrow can open: one for each task."""
    rows = roles(pages.select(id_col, url_col, payload_col), id_col, payload_col, least)
    rows = rows.select(F.col(id_col).cast("string"), url_col, F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8"), F.col("refers_to").cast("string"), "revisit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        path, out, size, n = f"{top}/{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for b in batches:
            for row in zip(*(c for c in b.columns)):
                if out is None:
                    store.create_dir(top, recursive=True)
                    out = store.open_output_stream(path, compression=None)
                page, url, payload, refers_to, revisit = (v.as_py() for v in row)
                made = record(page if page is not None else "", url, payload, refers_to, revisit)
                out.write(made)
                size, n = size + len(made), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "records": [n]})

    return cut(rows.mapInArrow(run, "path string, bytes bigint, records bigint"))


def next_magic(file: pa.NativeFile, at: int, end: int) -> int | None:
    """The first place in [at, end) where magic bytes begin."""
    while at < end:
        file.seek(at)
        got = file.read(min(CHUNK, end - at) + len(MAGIC) - 1)
        if (found := got.find(MAGIC)) >= 0:
            return at + found
        if len(got) < len(MAGIC):
            return None
        at += len(got) - len(MAGIC) + 1
    return None


def member(file: pa.NativeFile, at: int) -> tuple[bytes, int] | None:
    """The record that begins at this place, inflated, and its compressed length; None if there is none."""
    z, out, length = zlib.decompressobj(31), [], 0
    file.seek(at)
    try:
        while not z.eof:
            if not (got := file.read(CHUNK)):
                return None
            out.append(z.decompress(got))
            length += len(got)
            head = out[0] if len(out[0]) >= len(START) else b"".join(out[:64])
            if not (START.startswith(head) if len(head) < len(START) else head.startswith(START)):
                return None
    except zlib.error:
        return None
    return b"".join(out), length - len(z.unused_data)


def records(file: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of the records that begin in [start, end)."""
    at = next_magic(file, start, end)
    while at is not None and at < end:
        if got := member(file, at):
            yield at, got[0]
            at += got[1]
        else:
            at += 1
        at = next_magic(file, at, end)


def parsed(raw: bytes, whole: bool) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    h = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    http, _, payload = rest[: int(h.get("content-length", 0))].partition(b"\r\n\r\n")
    said = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
    revisit = h.get("warc-type") == "revisit"
    name = lambda v: v.removeprefix("<urn:page:").removesuffix(">") or None
    return {
        "record_id": name(h.get("warc-record-id", "")),
        "url": unquote(h.get("warc-target-uri", "")),
        "record_type": h.get("warc-type"),
        "refers_to": name(h.get("warc-refers-to", "")),
        "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else digest_of(payload),
        "payload_bytes": said if revisit else len(payload),
        "payload": payload if whole and not revisit else None,
    }


def read_archives(listing: DataFrame, folder: str, payload: bool = True, range_bytes: int = RANGE) -> DataFrame:
    """The records of archives (path, bytes), read in ranges: where each lies, what its header says, and its payload if asked for."""
    ranges = listing.select("path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(range_bytes).cast("bigint"))).alias("start"))
    ranges = ranges.repartition(shuffle_width(listing.sparkSession) * 2, "path", "start")
    kind = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with store.open_input_file(path) as file:
                    rows, held = [], 0
                    for at, raw in records(file, start, start + range_bytes):
                        rows.append({"path": path, "offset": at} | parsed(raw, payload))
                        held += len(raw)
                        if held > CHUNK * 16 or len(rows) >= 2000:
                            yield pa.RecordBatch.from_pylist(rows, schema=kind)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return ranges.mapInArrow(run, "path string, offset bigint, record_id string, url string, record_type string, refers_to string, payload_digest string, payload_bytes bigint, payload binary")


def new_folder(pages: DataFrame) -> str:
    """A folder of its own within the shared one, as a uri."""
    top = shared_dir(pages.sparkSession).rstrip("/")
    return f"{top if '://' in top or top.startswith('file:/') else f'file://{top}'}/warc-{uuid.uuid4().hex}"
