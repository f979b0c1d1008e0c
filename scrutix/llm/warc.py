"""WARC revisit resolution.

``write_archives`` turns rows into WARC/1.1 archives: rows of about
``ARCHIVE_BYTES`` that each hold a self-contained archive of gzip members, so
Spark's own writers place, commit and retry them on any store.  Headers alone
are then shuffled by payload digest; the response with the smallest page_id is
the original and the others become revisits.  Decisions go back to their
archive (at most ``ARCHIVE_RECORDS`` each) and deduplicated archives are
written with fresh headers.

Skew: the digest with a third of all rows is pre-aggregated before its
shuffle, and the join back moves header rows only, which Spark may split.

Defined results: null html is an empty payload; a null page_id comes after
all others among equal payloads; equal ids go by archive and position; a
revisit of the input stays one and refers to its payload's original, or where
no response holds that payload to what it referred to; an empty table gives no
archive; extra columns are ignored.  A response that becomes a revisit gets a
new record id; other records keep theirs.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, materialize

ARCHIVE_BYTES = 1 << 20
ARCHIVE_RECORDS = 2048
FEED = 1 << 14
DATE = "2024-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, payload_bytes: int, digest: str, refers: dict | None = None, ident: str | None = None) -> bytes:
    """One record as a gzip member; a revisit has an empty block.

    ``ident`` is its id; without one it follows from page and payload.
    """
    block = b"" if kind == "revisit" else payload
    ident = ident or f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}:{digest}')}>"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {ident}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{digest_of(block) if kind == 'revisit' else digest}", f"Payload-Length: {payload_bytes}"]
    if kind == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
    if refers:
        lines += [f"WARC-Refers-To: {refers['record_id']}", f"WARC-Refers-To-Date: {DATE}"]
        if refers["page_id"] is not None:
            lines.append(f"Refers-To-Page-ID: {refers['page_id']}")
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def _members(archive: bytes):
    """The decompressed gzip members of an archive, in one pass over its bytes."""
    view, at = memoryview(archive), 0
    while at < len(view):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(view):
                raise ValueError("a gzip member is cut off")
            fed = view[at : at + FEED]
            parts.append(z.decompress(fed))
            # what a member didn't take is fed to the next one
            at += len(fed) - len(z.unused_data)
        yield b"".join(parts)


def records(archive: bytes):
    """Yield ``(headers, block)`` of an archive of gzip members."""
    for raw in _members(archive):
        at = 0
        while at < len(raw):
            end = raw.find(b"\r\n\r\n", at)
            if end < 0 or not raw.startswith(b"WARC/", at):
                raise ValueError("not a WARC record")
            headers = dict(line.split(": ", 1) for line in raw[at:end].decode().split("\r\n")[1:])
            n, start = int(headers["Content-Length"]), end + 4
            if start + n > len(raw):
                raise ValueError("a WARC record is cut off")
            yield headers, raw[start : start + n]
            at = start + n + 4


def _archiver(items):
    """Group records into archives ``(id, n, content)`` of bounded size; an item makes its record from archive and position."""
    from pyspark import TaskContext

    base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
    held: list[bytes] = []
    size = k = 0
    for make in items:
        item = make(base + k, len(held))
        held.append(item)
        size += len(item)
        if size >= ARCHIVE_BYTES or len(held) >= ARCHIVE_RECORDS:
            yield base + k, len(held), b"".join(held)
            held, size, k = [], 0, k + 1
    if held:
        yield base + k, len(held), b"".join(held)


def _archives(df: DataFrame, columns: list[str], make) -> DataFrame:
    """Archives from ``make(*row values)``, which yields functions of archive and position that make a record."""
    import pyarrow as pa

    def run(batches):
        def items():
            for b in batches:
                cols = [b.column(b.schema.get_field_index(c)) for c in columns]
                for i in range(b.num_rows):
                    yield from make(*(c[i].as_py() for c in cols))

        for row in _archiver(items()):
            yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), pa.array([row[1]], pa.int64()), pa.array([row[2]], pa.binary())], names=["archive", "n_records", "content"])

    return df.select(*columns).mapInArrow(run, "archive long, n_records long, content binary")


def write_archives(pages: DataFrame) -> DataFrame:
    """Archives with a response record for every row of ``pages``.

    A record's id comes from the run and the record's place in it, so no two share one.
    """
    run = uuid.uuid4().hex

    def make(page_id, url, html):
        payload = (html or "").encode("utf-8", "surrogatepass")
        yield lambda archive, pos: record("response", page_id, url, payload, len(payload), digest_of(payload), ident=f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{run}:{archive}:{pos}')}>")

    return _archives(pages, ["page_id", "url", "html"], make)


def read_headers(archives: DataFrame) -> DataFrame:
    """One row per record: position, ids, type, full payload's length and digest, referred page."""
    import pyarrow as pa

    def one(archive, content):
        for pos, (h, block) in enumerate(records(content)):
            digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
            if h["WARC-Type"] == "response" and digest_of(block) != digest:
                raise ValueError(f"record {h['WARC-Record-ID']} doesn't have its digest")
            number = lambda k: int(h[k]) if k in h else None
            yield 200, (archive, pos, number("Page-ID"), h["WARC-Type"], int(h["Payload-Length"]), digest, h["WARC-Record-ID"], number("Refers-To-Page-ID"), h.get("WARC-Refers-To"))

    schema = pa.schema([("archive", pa.int64()), ("pos", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_id", pa.string()), ("refers_to", pa.int64()), ("refers_to_record", pa.string())])
    return archives.select("archive", "content").mapInArrow(arrow_rows(one, schema, ["archive", "content"]), "archive long, pos long, page_id long, record_type string, payload_bytes long, payload_digest string, record_id string, refers_to long, refers_to_record string")


def resolve(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``headers`` with ``original``: the first response of equal payloads.

    Responses have it for payloads of ``min_bytes`` or more, revisits always.
    """
    place = F.struct(F.col("page_id").isNull().alias("last"), F.col("page_id"), "archive", "pos", "record_id")
    key = ["payload_digest", "payload_bytes"]
    found = headers.groupBy(*key).agg(F.min(F.when(F.col("record_type") == "response", place)).alias("original"))
    wanted = (F.col("record_type") == "revisit") | ((F.col("record_type") == "response") & (F.col("payload_bytes") >= min_bytes))
    return headers.join(found, key, "left").withColumn("original", F.when(wanted, F.col("original")))


def deduplicate(archives: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Fresh archives in which repeated payloads are revisit records."""
    h = resolve(read_headers(archives), min_bytes)
    o = F.col("original")
    is_original = o.isNull() | ((o["archive"] == F.col("archive")) & (o["pos"] == F.col("pos")))
    decisions = h.select("archive", F.struct("pos", F.when(~is_original, F.struct(o["page_id"].alias("page_id"), o["record_id"].alias("record_id"))).alias("refers")).alias("d"))
    # at most ARCHIVE_RECORDS decisions meet in one row
    decisions = decisions.groupBy("archive").agg(F.collect_list("d").alias("decisions"))

    def make(content, chosen):
        refers = {d["pos"]: d["refers"] for d in chosen}
        for pos, (head, block) in enumerate(records(content)):
            page_id = int(head["Page-ID"]) if "Page-ID" in head else None
            digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
            kind, to, ident = head["WARC-Type"], refers[pos], head["WARC-Record-ID"]
            if to and kind == "response":
                # another record from now on; an original keeps its id
                kind, ident = "revisit", f"<urn:uuid:{uuid.uuid5(NAMESPACE, ident)}>"
            elif not to and kind == "revisit" and "WARC-Refers-To" in head:
                to = {"page_id": int(head["Refers-To-Page-ID"]) if "Refers-To-Page-ID" in head else None, "record_id": head["WARC-Refers-To"]}
            made = record(kind, page_id, head.get("WARC-Target-URI"), block, int(head["Payload-Length"]), digest, to, ident)
            yield lambda archive, pos, made=made: made

    return _archives(archives.join(decisions, "archive"), ["content", "decisions"], make)


def op5_warc(pages: DataFrame) -> DataFrame:
    """Write archives, resolve revisits, write deduplicated archives and read them back."""
    archives = materialize(write_archives(pages), "warc-raw")
    fresh = materialize(deduplicate(archives), "warc-dedup")
    return read_headers(fresh).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
