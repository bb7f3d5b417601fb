"""WARC: writer and salvage reader.

`write` makes archives of one gzip member per record: `response` records that hold an HTTP response with the payload, and
`revisit` records for payloads of 100 bytes or more that an earlier page has. `salvage` reads an archive's bytes, gzip or
plain. A record is checked in full: member CRC, version line, header fields, block length, payload length and digest.
After a failed check it searches for the next valid member or version line, in the archive and within members that hold
several records, goes on from there, and logs the bytes between as a quarantined gap; no record after the damage is
lost, nor are whole records before it in a member that breaks off. `op2_warc` reads archives written a moment ago: a gap
or a number of records other than the manifest's is an error there, not a page less.

Of records with equal payloads of at least 100 bytes that with the smallest page_id is the response; rows that repeat
this page_id are responses too. Null html is an empty payload, and empty payloads are always responses. Null urls
are left out of the header; a null page_id gives a record whose page_id reads back as null. An empty table gives no
archive. Columns other than page_id, url, html aren't read.
"""

from __future__ import annotations

import hashlib
import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import get_file, new_folder, put_file, small_batches, table, written

ARCHIVE_BYTES = 8 << 20
LEAST = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
KINDS = {"warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation"}
GZ = b"\x1f\x8b\x08"
ID = re.compile(r"<urn:page:(-?\d+)>")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None) -> bytes:
    """One uncompressed record. A revisit has the HTTP header only, and says how long the payload is."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (b"" if refers_to is not None else payload)
    head = ["WARC/1.1", "WARC-Type: " + ("response" if refers_to is None else "revisit"), f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record that begins at `at` and where it ends; ValueError says which check failed."""
    m = VERSION.match(data, at)
    if not m:
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n", m.end() - 2)
    if end < 0:
        raise ValueError("header cut off")
    fields: dict[str, str] = {}
    for line in data[m.end() : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not re.fullmatch(rb"[!#-'*+.^-z|~A-Z0-9-]+", name):
            raise ValueError("bad header line")
        fields[name.decode("ascii").lower()] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"\d{1,15}", fields.get("content-length", "")):
        raise ValueError("no content length")
    body, n = end + 4, int(fields["content-length"])
    if data[body + n : body + n + 4] != b"\r\n\r\n":
        raise ValueError("block length doesn't fit")
    block = data[body : body + n]
    said = fields.get("warc-block-digest", "")
    if said.startswith("sha256:") and said[7:] != hashlib.sha256(block).hexdigest():
        raise ValueError("block digest doesn't fit")
    kind = fields.get("warc-type")
    if kind not in KINDS or "warc-record-id" not in fields:
        raise ValueError("no record type or id")
    if kind in ("response", "revisit"):
        head, gap, payload = block.partition(b"\r\n\r\n")
        size = re.search(rb"(?im)^content-length:[ \t]*(\d{1,15})\r?$", head)
        if not gap or not size:
            raise ValueError("no HTTP header")
        full = int(size[1])
        digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
        if kind == "response":
            if full != len(payload):
                raise ValueError("payload length doesn't fit")
            own = hashlib.sha256(payload).hexdigest()
            if digest and digest != own:
                raise ValueError("payload digest doesn't fit")
            digest = own
        page, refers = ID.fullmatch(fields.get("warc-record-id", "")), ID.fullmatch(fields.get("warc-refers-to", ""))
        return {"page_id": int(page[1]) if page else None, "url": fields.get("warc-target-uri"), "payload_bytes": full, "payload_digest": digest, "record_type": kind, "refers_to": int(refers[1]) if refers else None, "payload": payload}, body + n + 4
    return {"record_type": kind, "payload": block}, body + n + 4


def member(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What the gzip member that begins at `at` decompresses to, where it ends, and why it is damaged, if it is; then the
    bytes are those before the damage."""
    z, out, pos, view = zlib.decompressobj(31), [], at, memoryview(data)
    try:
        while not z.eof:
            if pos >= len(data):
                return b"".join(out), pos, "member cut off"
            out.append(z.decompress(view[pos : pos + 4096]))
            pos += 4096
    except zlib.error as e:
        return b"".join(out), pos, f"member: {e}"
    return b"".join(out), min(pos, len(data)) - len(z.unused_data), ""


def inside(inner: bytes, damaged: bool) -> tuple[list[dict], list[tuple[int, int, str]]]:
    """(records, gaps) of a decompressed member: after a failed check the next version line is looked for. Of a damaged
    member only records with another one's version line behind them count."""
    got, gaps, k, bad, why = [], [], 0, None, ""
    while k < len(inner):
        try:
            rec, end = parse(inner, k)
            if damaged and not VERSION.match(inner, end):
                raise ValueError("member damaged")
            if bad is not None:
                gaps.append((bad, k - bad, why))
                bad = None
            got.append(rec)
            k = end
        except ValueError as e:
            if bad is None:
                bad, why = k, str(e)
            m = VERSION.search(inner, k + 1)
            k = m.start() if m else len(inner)
    if bad is not None:
        gaps.append((bad, len(inner) - bad, why))
    return got, gaps


def salvage(data: bytes):
    """Yields ("record", offset, fields) and ("gap", offset, length, reason) for an archive's bytes, in order. A gap within
    a whole member that holds good records too has the member's offset, its own length there, and says so."""
    at, bad, why = 0, None, ""
    start = re.compile(re.escape(GZ) + b"|" + VERSION.pattern)  # an archive may mix both
    while at < len(data):
        got: list[dict] = []
        inner_gaps: list[tuple[int, int, str]] = []
        failed = ""
        if data[at : at + 2] == GZ[:2]:
            inner, end, failed = member(data, at)
            got, inner_gaps = inside(inner, bool(failed))
            if not got and not failed:
                failed = inner_gaps[0][2] if inner_gaps else "empty member"
        else:
            try:
                rec, end = parse(data, at)
                got = [rec]
            except ValueError as e:
                failed = str(e)
        if bad is not None and (got or not failed):
            yield "gap", bad, at - bad, why
            bad = None
        for rec in got:
            yield "record", at, rec
        if failed:
            if bad is None:
                bad, why = at, failed
            m = start.search(data, at + 1)
            at = m.start() if m else len(data)
            continue
        for k, n, reason in inner_gaps:
            yield "gap", at, n, f"in a member, from byte {k} of what it decompresses to: {reason}"
        at = end
    if bad is not None:
        yield "gap", bad, len(data) - bad, why


def plan(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, refers_to (null: a response). Digests alone are grouped, with partial sums before
    the shuffle; the table of repeated digests is written, so the join knows its size: small, it is broadcast and html
    isn't shuffled; large, both sides are, and a digest with a third of all rows is split by the skew join."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    first = rows.filter(F.octet_length("html") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = written(first.filter("n > 1").drop("n"), "repeated")
    return rows.join(first, "digest", "left").select("page_id", "url", "html", "digest", F.expr("CASE WHEN page_id <> first THEN first END").alias("refers_to"))


def write(pages: DataFrame, uri: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archives below `uri` and returns the written manifest: file, n_records, n_bytes. Files bear the task
    attempt's number: of tasks that run twice only one attempt's files are in the manifest."""
    import pyarrow as pa

    def run(batches):
        from pyspark import TaskContext

        name, k, held, n = f"{uri}/part-{TaskContext.get().taskAttemptId():08d}", 0, bytearray(), 0

        def flush():
            nonlocal k, held, n
            file = f"{name}-{k:05d}.warc.gz"
            put_file(file, bytes(held))
            row = pa.RecordBatch.from_arrays([pa.array([file]), pa.array([n], pa.int64()), pa.array([len(held)], pa.int64())], names=["file", "n_records", "n_bytes"])
            k, held, n = k + 1, bytearray(), 0
            return row

        for b in batches:
            for page, url, html, digest, refers in zip(*[c.to_pylist() for c in b.columns]):
                held += gzip_member(record(page, url, html.encode(), digest, refers))
                n += 1
                if len(held) >= archive_bytes:
                    yield flush()
        if n:
            yield flush()

    return written(plan(pages).mapInArrow(run, "file string, n_records long, n_bytes long"), "archives")


def read(manifest: DataFrame, whole: bool = False) -> DataFrame:
    """Every record and gap of the archives: file, offset, kind, page_id, url, payload_bytes, payload_digest,
    record_type, refers_to, gap_bytes, reason. Payloads stay out; `salvage` yields them. With `whole`, an archive with a
    gap or without all of the manifest's records is refused."""
    import pyarrow as pa

    fields = [("file", pa.string()), ("offset", pa.int64()), ("kind", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("gap_bytes", pa.int64()), ("reason", pa.string())]

    def run(batches):
        for b in batches:
            for file, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = []
                for kind, at, *rest in salvage(get_file(file)):
                    r = rest[0] if kind == "record" else {"gap_bytes": rest[0], "reason": rest[1]}
                    rows.append({"file": file, "offset": at, "kind": kind} | {k: r.get(k) for k, _ in fields[3:]})
                if whole and [r["kind"] for r in rows] != ["record"] * n:
                    raise ValueError(f"{file} was written with {n} records; read: {sum(r['kind'] == 'record' for r in rows)}, gaps: {[r['reason'] for r in rows if r['kind'] == 'gap']}")
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in fields], names=[k for k, _ in fields])

    spread = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("file", "n_records").repartition(spread, "file").mapInArrow(run, "file string, offset long, kind string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, gap_bytes long, reason string")


def op2_warc(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    got = read(write(table(spark, sf_dir, "pages"), new_folder(spark, "warc")), whole=True)
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS d, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN first IS NOT NULL AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (d)
"""
