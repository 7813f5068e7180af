"""WARC archives with an index: written, then read back by coalesced byte ranges.

Tasks write archives of gzip members (one record each, files rotated at a size) into a shared
folder; the index holds file, offset, length, url and digest of every record and is itself
written as Parquet, so that it names only the files of tasks that succeeded. Readers take the
selected index rows sorted by file and offset, join neighbouring ranges into one read each and
parse the records. Files are reached through ``pyarrow.fs``, whose store is named by the URI.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import saved

FILE_BYTES = 64 << 20
MAX_GAP = 1 << 16
TASK_BYTES = 16 << 20  # of archive read by a task
MAX_READ = 8 << 20
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs in RFC 4122
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, url string, digest string, record_type string, refers_to long, file string, offset long, length long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(url: str | None) -> str:
    """A header value must stay on its line."""
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, date: str) -> bytes:
    """One record; ``first`` is the page that a revisit refers to (None: response). A revisit keeps the HTTP header only."""
    def name(i) -> str:
        return f"<urn:uuid:{uuid.uuid5(NAMES, f'page:{i}')}>"

    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}",
            "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if first is None:
        block += payload
    else:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(first)}", f"X-Refers-To-Page-Id: {first}"]
    head.append(f"Content-Length: {len(block)}")
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Record headers, HTTP headers (names in lower case) and payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode().split("\r\n")[1:])}
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    return fields, {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")[1:])}, payload


def _gzip(raw: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def mark_revisits(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, digest, first: ``first`` is the smallest page_id with an equal payload, where the row is to revisit it.

    A null html is an empty payload. Payloads below ``min_bytes`` are never revisits, nor are rows
    without page_id or repeated rows of the first page_id. Other columns are dropped.
    The few bytes of (digest, page_id) are added up first, so a common payload is one row per task
    when it is shuffled; the join of the pages themselves splits a hot digest at run time.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("_sha"))
    firsts = saved(pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(html.cast("binary")).alias("_sha"), F.octet_length(html).alias("n"))
                   .where(F.col("n") >= min_bytes).groupBy("_sha").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
                   .where("_n > 1").select("_sha", "_first"), folder, "firsts")
    joined = rows.join(firsts, "_sha", "left")
    return joined.select("page_id", "url", "html", F.when(F.col("page_id") > F.col("_first"), F.col("_first")).alias("first"))


def write_archives(rows: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the marked rows below ``folder``/archives and return the index (read from ``folder``/index)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(f"{folder}/archives" if "://" in folder else f"file://{folder}/archives")
        fs.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                made = []
                for page_id, url, html, first in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0  # never an earlier attempt's file
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    payload = html.encode()
                    digest = base32_sha1(payload)
                    data = _gzip(record(page_id, url, payload, digest, first, date))
                    out.write(data)
                    made.append((page_id, url, digest, "response" if first is None else "revisit", first, name, at, len(data)))
                    at += len(data)
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                                                     names=[x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    return saved(rows.select("page_id", "url", "html", "first").mapInArrow(run, INDEX), folder, "index")


def ranges(entries: list[tuple[str, int, int]], max_gap: int = MAX_GAP, max_read: int = MAX_READ) -> Iterator[tuple[str, int, int, int, int]]:
    """(file, from, to, first entry, past last entry) of sorted (file, offset, length): neighbours closer than ``max_gap`` in one read."""
    i = 0
    while i < len(entries):
        file, a, n = entries[i]
        z, j = a + n, i + 1
        while j < len(entries) and entries[j][0] == file and entries[j][1] - z <= max_gap and entries[j][1] + entries[j][2] - a <= max_read:
            z = max(z, entries[j][1] + entries[j][2])
            j += 1
        yield file, a, z, i, j
        i = j


def read_records(index: DataFrame, folder: str, keep_html: bool = False) -> DataFrame:
    """The records that the given index rows name. A payload that does not match its digest raises."""
    schema = RECORD + ", html string" * keep_html

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(f"{folder}/archives" if "://" in folder else f"file://{folder}/archives")
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()] + [pa.string()] * keep_html
        names = [x.split()[0] for x in schema.split(", ")]
        opened, f = None, None
        for batch in batches:
            entries = list(zip(*(c.to_pylist() for c in batch.columns)))
            for file, a, z, i, j in ranges(entries):
                if file != opened:
                    if f is not None:
                        f.close()
                    opened, f = file, fs.open_input_file(f"{root}/{file}")
                raw, made = f.read_at(z - a, a), []
                for _, offset, length in entries[i:j]:
                    fields, http, payload = parse(zlib.decompress(raw[offset - a : offset - a + length], 31))
                    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and base32_sha1(payload) != digest:
                        raise ValueError(f"{file} at {offset}: the payload does not match its digest")
                    page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
                    row = (None if page is None else int(page), fields.get("warc-target-uri"), kind, None if refers is None else int(refers), int(http["content-length"]), digest)
                    made.append(row + (payload.decode(),) * keep_html)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), kinds)], names=names)

    # the index is small beside what it names, so the number of tasks follows from the bytes to be read
    tasks = index.agg(F.ceil(F.sum("length") / TASK_BYTES)).first()[0] or 1
    place = index.select("file", "offset", "length").repartitionByRange(int(tasks), "file", "offset").sortWithinPartitions("file", "offset")
    return place.mapInArrow(run, schema)
