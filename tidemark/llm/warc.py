"""WARC archives of pages: a deduplicating writer and a splittable reader.

Writing: rows are keyed by the SHA-1 of their payload (UTF-8 of the html; null is empty). The row of the largest
page_id of a payload is a response record, the others are revisit records that refer to it and carry no payload;
payloads under `min_bytes` are all responses. Each task writes one file of one gzip member a record, under a name
that no other attempt uses, and returns it as a row of the manifest; files of failed attempts are in no manifest.

Reading: tasks get byte ranges of the files. A task scans its range for the gzip magic, takes a candidate only if the
member inflates to a WARC version line with a readable header, and owns every record that starts inside its range,
reading past the range's end to finish the last one. After a valid member the next one starts where it ended. One window
of bytes moves over the range, so every byte is read once (and a little past the end twice).
UTF-8 payloads can't hold the magic (1F 8B), so no payload imitates a member.

Files are reached through pyarrow.fs by the URI of the shared folder (file:, s3:, hdfs:, gs:).

Cases: a null url is written as an empty target; a null page_id is marked in the record's id, is never the largest,
and comes back as null. Repeated rows of one page_id each get a record; if that id is the payload's largest, each
is a response. Empty tables give no files and an empty result. Other columns are ignored. In archives from elsewhere, a
record whose id isn't of this writer's form has a null page_id; records of other kinds are passed over; a member with a
good header that doesn't inflate to its end comes back as a row of record_type `damaged` with what its header says.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch_path, tidy

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id: int | None) -> str:
    """A version-8 UUID that carries the 64-bit id; variant digit 9 marks null."""
    raw = f"{(page_id or 0) & (1 << 64) - 1:016x}"
    return f"urn:uuid:7469646d-{raw[:4]}-8000-{'9' if page_id is None else '8'}000-{raw[4:]}"


_OWN_ID = re.compile(r"<?urn:uuid:7469646d-([0-9a-f]{4})-8000-([89])000-([0-9a-f]{12})>?")


def page_of(urn: str) -> int | None:
    """The page id in a record's id; None where it marks null or isn't of this writer's form."""
    m = _OWN_ID.fullmatch(urn.strip())
    if m is None or m.group(2) == "9":
        return None
    n = int(m.group(1) + m.group(3), 16)
    return n - (1 << 64) if n >> 63 else n


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def record(page_id: int | None, url: str, digest: bytes, size: int, refers: int | None, payload: bytes | None, revisit: bool, date: str = "2024-01-01T00:00:00Z") -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (b"" if revisit else payload)
    target = " ".join(url.split())
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_id(page_id)}>", f"WARC-Date: {date}", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}", "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(refers)}>"]
    raw = "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _with_holders(rows: DataFrame, broadcast_rows: int) -> DataFrame:
    """rows (page_id, sha1, ...) with holder: the largest page_id of the payload where more than one row has it, else null.

    Few shared payloads (counted) go to the rows. Otherwise ids and digests alone are joined by payload, and rows are
    joined by (page_id, sha1), so that no html of a payload that many pages share has to meet in one place.
    """
    shared = rows.groupBy("sha1").agg(F.max("page_id").alias("holder"), F.count("*").alias("many")).where("many > 1 AND holder IS NOT NULL")
    shared = materialize(shared.select("sha1", "holder"), "holders")
    if shared.count() <= broadcast_rows:
        return rows.join(F.broadcast(shared), "sha1", "left")
    again = rows.select("page_id", "sha1").join(shared, "sha1").distinct().select(F.col("page_id").alias("_p"), F.col("sha1").alias("_s"), "holder")
    return rows.join(again, F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("sha1") == F.col("_s")), "left").drop("_p", "_s")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, broadcast_rows: int = 200_000) -> DataFrame:
    """Write the archives; returns the manifest (file, size, records), itself stored in the shared folder."""
    html = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), html.alias("html"), F.sha1(html).alias("sha1"))
    rows = _with_holders(rows, broadcast_rows)
    revisit = (F.octet_length("html") >= min_bytes) & F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    rows = rows.select("page_id", "url", F.unhex("sha1").alias("sha1"), F.octet_length("html").cast("long").alias("size"), revisit.alias("revisit"), F.when(revisit, F.col("holder")).alias("holder"), F.when(~revisit, F.col("html")).alias("html"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, n, path = None, 0, f"{folder}/{uuid.uuid4().hex}.warc.gz"
        size = 0
        for b in batches:
            for p, url, sha1, length, again, holder, page in zip(b.page_id, b.url, b.sha1, b["size"], b.revisit, b.holder, b.html, strict=True):
                if out is None:
                    fs, at = _fs(path)
                    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    out = fs.open_output_stream(at, compression=None)
                own = None if p is None or p is pd.NA else int(p)
                data = record(own, url, bytes(sha1), int(length), None if holder is None or holder is pd.NA else int(holder), None if page is None else bytes(page), bool(again))
                out.write(data)
                size += len(data)
                n += 1
        if out is not None:
            out.close()
            yield pd.DataFrame({"file": [path], "size": [size], "records": [n]})

    # Ids travel as decimal strings: pandas would turn a column with nulls into floats.
    rows = rows.withColumns({"page_id": F.col("page_id").cast("string"), "holder": F.col("holder").cast("string")})
    return materialize(rows.mapInPandas(tidy("warc", write), "file string, size long, records long"), "manifest")


class Window:
    """The bytes of a file from `base` on that are held; it moves forward only."""

    def __init__(self, read, start: int, stop: int, size: int, step: int, tail: int = 1 << 13):
        self.read, self.base, self.stop, self.size, self.step, self.tail = read, start, stop, size, step, tail
        self.held = bytearray()

    def fill(self) -> bool:
        """Read on: by `step` up to the range's end, then by `tail`, doubled each time; False at the file's end."""
        at = self.base + len(self.held)
        if at < self.stop:
            much = min(self.step, self.stop - at)
        else:
            much = min(self.tail, self.size - at)
            self.tail = min(self.tail * 2, self.step)
        data = self.read(at, much) if much > 0 else b""
        self.held += data
        return bool(data)

    def drop(self, n: int) -> None:
        del self.held[:n]
        self.base += n


def _inflate(window: Window, k: int) -> tuple[bytearray, int | None, bool]:
    """(inflated bytes, place in the window after the member or None, whether its header is good) of the candidate at k."""
    z, out, pos, piece, checked = zlib.decompressobj(31), bytearray(), k, 1 << 9, False
    while not z.eof:
        if pos == len(window.held) and not window.fill():
            return out, None, checked
        data = window.held[pos : pos + piece]
        try:
            out += z.decompress(data)
        except zlib.error:
            return out, None, checked
        pos += len(data)
        piece = min(piece * 2, 1 << 20)
        if not checked and (b"\r\n\r\n" in out or len(out) >= 1 << 16 or z.eof):
            checked = header(out) is not None
            if not checked:
                return out, None, False
    return out, pos - len(z.unused_data), checked


def members(read, start: int, stop: int, size: int, step: int = 1 << 20) -> Iterator[tuple[bytes, bool]]:
    """(inflated bytes, whether whole) of the records that start in [start, stop) of a file; read(at, n) gives its bytes."""
    window, k = Window(read, start, stop, size, step), 0
    while window.base + k < stop:
        k = window.held.find(MAGIC, k)
        if k < 0:
            # The magic's first bytes may stand at the end of what is held.
            window.drop(max(0, len(window.held) - 2))
            k = 0
            if not window.fill():
                return
            continue
        if window.base + k >= stop:
            return
        window.drop(k)
        out, after, good = _inflate(window, 0)
        if good:
            yield bytes(out), after is not None
        if good and after is not None:
            window.drop(after)
            k = 0
        else:
            k = 1


def header(raw: bytes) -> tuple[dict[str, str], int] | None:
    """The named fields and the block's place, or None where raw doesn't start with a WARC header."""
    end = raw.find(b"\r\n\r\n")
    if not raw.startswith(b"WARC/1.") or end < 0:
        return None
    fields = {}
    for line in bytes(raw[:end]).decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    return (fields, end + 4) if fields.get("content-length", "").isdigit() and "warc-type" in fields else None


def parse(raw: bytes, whole: bool = True) -> tuple | None:
    """A record as a row of FIELDS; None for other kinds of record. A response's digest and length are of what it holds."""
    fields, at = header(raw)
    kind = fields["warc-type"]
    if whole and kind not in ("response", "revisit"):
        return None
    block = raw[at : at + int(fields["content-length"])]
    head, _, payload = block.partition(b"\r\n\r\n")
    digest = fields.get("warc-payload-digest", "sha1:").partition(":")[2]
    if not whole:
        kind, size = "damaged", 0
    elif kind == "response":
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    else:
        size = next((int(x.partition(b":")[2]) for x in head.split(b"\r\n") if re.fullmatch(rb"(?i)content-length:\s*\d+\s*", x)), 0)
    refers = page_of(fields["warc-refers-to"]) if "warc-refers-to" in fields else None
    return page_of(fields.get("warc-record-id", "")), fields.get("warc-target-uri", ""), size, digest, kind, refers


def read_archives(manifest: DataFrame, split_bytes: int = 16 << 20) -> DataFrame:
    """The records of the manifest's files (FIELDS), read by byte ranges of `split_bytes` at most.

    Small archives get smaller ranges, so that all cores read, and the ranges are dealt evenly over a stated number of
    tasks, which adaptive execution leaves alone.
    """
    cores = manifest.sparkSession.sparkContext.defaultParallelism
    total, files = manifest.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    split = int(min(split_bytes, max(1 << 18, total // (2 * cores))))
    n = F.greatest(F.lit(1), F.ceil(F.col("size") / split)).cast("long")
    ranges = manifest.select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("k"))
    ranges = ranges.select("file", "size", (F.col("k") * split).alias("start"), F.least("size", (F.col("k") + 1) * split).alias("stop"))
    ranges = ranges.repartition(max(1, min(100_000, total // split + files)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, size, start, stop in zip(b.file, b["size"], b.start, b.stop, strict=True):
                fs, at = _fs(path)
                rows = []
                with fs.open_input_file(at) as f:

                    def get(where: int, much: int, f=f) -> bytes:
                        f.seek(where)
                        return f.read(much)

                    for raw, whole in members(get, int(start), int(stop), int(size)):
                        if row := parse(raw, whole):
                            rows.append(json.dumps(row))
                        if len(rows) >= 5000:
                            yield pd.DataFrame({"row": rows})
                            rows = []
                if rows:
                    yield pd.DataFrame({"row": rows})

    rows = ranges.mapInPandas(tidy("warc", read), "row string")
    got = F.from_json("row", "array<string>")
    names = [x.split() for x in FIELDS.split(", ")]
    return rows.select(got.alias("r")).select(*[F.get("r", i).cast(kind).alias(name) for i, (name, kind) in enumerate(names)])


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to for every page, read back from its archives."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    manifest = write_archives(pages, scratch_path(spark, "warc"))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 of SHA-1: eight groups of five hexadecimal digits, four letters each.
ORACLE: dict[str, str] = {
    "op8_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), h AS (
  SELECT hex, max(page_id) AS holder FROM p GROUP BY hex
), d AS (
  SELECT hex, array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(hex, i * 5 + 1, 5))::INTEGER >> b::INTEGER) % 32 + 1, 1)), '')), '') AS digest FROM h
)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id IS DISTINCT FROM holder AND holder IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM holder THEN holder END AS refers_to
FROM p JOIN h USING (hex) JOIN d USING (hex)""",
}
