"""WARC archives: written with an index first, read back by coalesced byte ranges.

``write_archives`` writes one gzip member per record into ``.warc.gz`` files and
returns the index, one row per record: archive, offset, length, url, digest. Of
records with equal payloads the one with the largest id is a response, the others
are revisits that hold headers only and refer to it.

``read_records`` takes the index rows that someone selected. Sorted by archive
and offset, rows whose gap is small become one byte range; a task reads a range
at once and cuts the records out of it, so it touches only the bytes asked for.

What crosses the network: the rows without payloads, to find equal ones; then
each payload once at most, to the task that writes it. Archives are written by
the tasks through ``pyarrow.fs``, under names of the attempt's own: an attempt
that was lost leaves a file that no index row names. ``path`` must be a folder
that all executors share.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadframe.llm.common import Scratch

ARCHIVE_BYTES = 1 << 30     # an archive is closed beyond this size
MAX_GAP = 64 << 10          # unselected bytes that a read may carry along between two records
MAX_READ = 8 << 20          # a range ends at each multiple of this
TASK_BYTES = 64 << 20       # selected bytes for a reading task, about
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_INDEX = ("archive string, offset long, length long, record_type string, record_id string, id string, url string, "
          "payload_digest string")
_RECORD = ("archive string, offset long, record_type string, record_id string, id string, url string, payload_digest string, "
           "payload_bytes long, refers_to_record string, refers_to_id string, payload binary")


def file_system(path: str):
    """(pyarrow file system, path in it) of a folder's URI or plain path."""
    from pyarrow import fs
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _field(value: str | None) -> str | None:
    """A header's value on one line; null: no header."""
    return value if value is None else value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _value(field: str | None) -> str | None:
    return field if field is None else field.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record_id(digest: str) -> str:
    """Of the one response with this payload digest."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'response:' + digest)}>"


def format_record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))] if v is not None]
    return b"WARC/1.1\r\n" + "".join(lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record."""
    head, rest = data.split(b"\r\n\r\n", 1)
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, v in (x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)}
    return headers, rest[:int(headers["content-length"])]


def _http(payload: bytes | None, length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode() + (payload or b"")


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _write(path: str, archive_bytes: int):
    """Rows id, url, payload, digest (hex), bytes, response, to_id, to_url -> index rows."""
    def run(batches):
        from pyspark import TaskContext
        attempt = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}"
        system, folder = file_system(path)
        system.create_dir(folder, recursive=True)
        out, at, files, n = None, 0, 0, 0
        try:
            for b in batches:
                index = {k: [] for k in ("archive", "offset", "length", "record_type", "record_id", "id", "url", "payload_digest")}
                for r in b.to_pylist():
                    if out is not None and at >= archive_bytes:
                        out.close()
                        out = None
                    if out is None:
                        name, files, at = f"{attempt}-{files:04d}.warc.gz", files + 1, 0
                        out = system.open_output_stream(f"{folder}/{name}", compression=None)
                        info = b"software: leadframe\r\nformat: WARC File Format 1.1\r\n"
                        first = _gzip(format_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
                                                     ("WARC-Date", DATE), ("WARC-Filename", name),
                                                     ("Content-Type", "application/warc-fields")], info))
                        out.write(first)
                        at = len(first)
                    digest = base64.b32encode(bytes.fromhex(r["digest"])).decode()
                    kind = "response" if r["response"] else "revisit"
                    rid = record_id(digest) if r["response"] else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{attempt}:{n}')}>"
                    n += 1
                    headers = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", DATE), ("WARC-Target-URI", _field(r["url"])),
                               ("WARC-Source-ID", _field(r["id"])), ("WARC-Payload-Digest", f"sha1:{digest}"),
                               ("Content-Type", "application/http; msgtype=response")]
                    if not r["response"]:
                        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(digest)),
                                    ("WARC-Refers-To-Source-ID", _field(r["to_id"])),
                                    ("WARC-Refers-To-Target-URI", _field(r["to_url"]))]
                    member = _gzip(format_record(headers, _http(r["payload"], r["bytes"])))
                    out.write(member)
                    for v, x in zip(index.values(), (name, at, len(member), kind, rid, r["id"], r["url"], digest)):
                        v.append(x)
                    at += len(member)
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64() if k in ("offset", "length") else pa.string())
                                                  for k, v in index.items()})
        finally:
            if out is not None:
                out.close()
    return run


def write_archives(df: DataFrame, path: str, scratch: Scratch, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """A WARC record for each row, in archives under ``path``; returns the written index.

    A null payload counts as empty, and empty payloads are equal to each other.
    Null ids come before all others; rows that share an id and a payload are
    records of their own, of which one is the response. A null url or id leaves
    the header out. An empty table gives an empty index and no archive; other
    columns aren't read.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    pages = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"),
                      F.sha1(payload).alias("digest"))
    narrow = scratch.put(pages.select("id", "url", F.octet_length("payload").cast("long").alias("bytes"), "digest",
                                      F.monotonically_increasing_id().alias("row")), "narrow")
    best = narrow.groupBy("digest").agg(F.max(F.struct("id", "row", "url")).alias("best"))
    roles = scratch.put(narrow.join(best, "digest").withColumn("response", F.col("row") == F.col("best.row")), "roles")
    same = F.col("id").eqNullSafe(F.col("best.id")) & F.col("url").eqNullSafe(F.col("best.url"))
    # equal rows in every column: any of them is the response
    tied = scratch.put(roles.filter(~F.col("response") & same).select("digest").distinct(), "tied")
    responses = roles.filter("response")
    p, r = pages.alias("p"), responses.join(tied, "digest", "left_anti").select("digest", "id", "url").alias("r")
    match = ((F.col("p.digest") == F.col("r.digest")) & F.col("p.id").eqNullSafe(F.col("r.id"))
             & F.col("p.url").eqNullSafe(F.col("r.url")))
    found = p.join(r, match, "left_semi").select("id", "url", "payload", "digest")
    if not tied.isEmpty():
        one = (pages.join(tied, "digest", "left_semi").groupBy("digest").agg(F.any_value("payload").alias("payload")))
        found = found.unionByName(responses.select("id", "url", "digest").join(one, "digest").select(*found.columns))
    none = F.lit(None).cast("string")
    rows = (found.select(F.col("id").cast("string").alias("id"), "url", "payload", "digest",
                         F.octet_length("payload").cast("long").alias("bytes"), F.lit(True).alias("response"),
                         none.alias("to_id"), none.alias("to_url"))
            .unionByName(roles.filter("NOT response").select(
                F.col("id").cast("string").alias("id"), "url", F.lit(None).cast("binary").alias("payload"), "digest", "bytes",
                "response", F.col("best.id").cast("string").alias("to_id"), F.col("best.url").alias("to_url"))))
    return scratch.put(rows.mapInArrow(_write(path, archive_bytes), _INDEX), "index")


def byte_ranges(selected: DataFrame, max_gap: int = MAX_GAP, max_read: int = MAX_READ) -> DataFrame:
    """Index rows -> archive, start, stop and the (offset, length) of the records in the range.

    A window sees the index rows of one archive, whose size is bounded.
    """
    w = W.partitionBy("archive").orderBy("offset")
    before = F.lag("offset").over(w)
    new = (before.isNull() | (F.col("offset") - before - F.lag("length").over(w) > max_gap)
           | (F.floor(F.col("offset") / max_read) != F.floor(before / max_read)))
    return (selected.select("archive", "offset", "length").withColumn("new", new.cast("int"))
            .withColumn("range", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
            .groupBy("archive", "range")
            .agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop"),
                 F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records")).drop("range"))


def _read(path: str, with_payload: bool):
    def run(batches):
        system, folder = file_system(path)
        schema = pa.schema([(f, pa.int64() if f in ("offset", "payload_bytes") else pa.binary() if f == "payload" else pa.string())
                            for f in (x.split()[0] for x in _RECORD.split(", "))])
        for b in batches:
            for r in b.to_pylist():
                with system.open_input_file(f"{folder}/{r['archive']}") as f:
                    f.seek(r["start"])
                    data = f.read(r["stop"] - r["start"])
                out = {f.name: [] for f in schema}
                for rec in r["records"]:
                    at = rec["offset"] - r["start"]
                    headers, block = parse_record(zlib.decompress(data[at:at + rec["length"]], 31))
                    http, payload = block.split(b"\r\n\r\n", 1)
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
                    kind = headers["warc-type"]
                    if kind == "response" and (len(payload) != size or base32_digest(payload) != digest):
                        raise ValueError(f"{r['archive']} at {rec['offset']}: payload differs from its digest")
                    row = (r["archive"], rec["offset"], kind, headers["warc-record-id"], _value(headers.get("warc-source-id")),
                           _value(headers.get("warc-target-uri")), digest, size, headers.get("warc-refers-to"),
                           _value(headers.get("warc-refers-to-source-id")), payload if with_payload and kind == "response" else None)
                    for v, x in zip(out.values(), row):
                        v.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)
    return run


def read_records(selected: DataFrame, path: str, with_payload: bool = True, max_gap: int = MAX_GAP,
                 max_read: int = MAX_READ) -> DataFrame:
    """The records of the selected index rows (see ``_RECORD``), read from the archives under ``path``.

    A response's payload is checked against its length and digest. A revisit has
    no payload here; its length and digest are those of the full payload, from
    its headers. A row selected twice is returned twice.
    """
    spark = selected.sparkSession
    total = selected.agg(F.sum("length").alias("n")).first().n or 0
    tasks = max(spark.sparkContext.defaultParallelism, total // TASK_BYTES)
    return (byte_ranges(selected, max_gap, max_read).repartition(int(tasks), "archive", "start")
            .mapInArrow(_read(path, with_payload), _RECORD))
