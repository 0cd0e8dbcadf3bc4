"""WARC archives: a writer with revisit records and a splittable reader.

Archives are gzip files with one member a record. A reader task gets a byte range, scans it for gzip
magic, and takes a candidate for a member only if its first decompressed bytes are a WARC header. It
owns the records that start inside its range and reads on past the range's end to finish the last.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideflow.llm._shared import materialize, scratch_path, table

#: A task starts a new file when the current one has this many bytes.
FILE_BYTES = 64 << 20
SPLIT_BYTES = 8 << 20
#: Reading tasks at most; beyond, a task reads many splits.
MAX_TASKS = 20_000
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
_CHUNK = 1 << 18
_PROBE = 1 << 12
_DATE = "1970-01-01T00:00:00Z"


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP headers, with the payload's length, and drops the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = "none" if page_id is None else str(page_id)
    head = [
        VERSION.decode(), f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    raw = "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse(raw: bytes) -> tuple:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of a decompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda s: None if s is None or s == "<urn:page:none>" else int(s.removeprefix("<urn:page:").removesuffix(">"))
    revisit = fields["WARC-Type"] == "revisit"
    size = int(http.rpartition(b"Content-Length: ")[2]) if revisit else len(payload)
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and base32_sha1(payload) != digest:
        raise ValueError(f"digest mismatch in record {fields['WARC-Record-ID']}")
    return number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), fields["WARC-Type"], number(fields.get("WARC-Refers-To")), size, digest, None if revisit else payload


def write_archives(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Archive ``pages`` (page_id, url, html); returns the manifest (file, bytes, records).

    Of records with equal payloads of at least ``min_revisit_bytes``, that with the largest page_id
    is a response and the others revisit it. Each task attempt writes files of its own; only those
    of the attempt whose manifest rows were committed are ever read, so retries do no harm.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    base = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload")).withColumn("n", F.octet_length("payload"))
    groups = base.select("page_id", "digest", "n").groupBy("digest", "n").agg(F.max("page_id").alias("keep_id"), F.count("*").alias("copies"))
    groups = materialize(groups, "payloads")
    total = groups.agg(F.sum(F.col("n") * F.col("copies"))).first()[0] or 0
    marked = base.join(groups.hint("merge"), ["digest", "n"])
    other = (F.col("n") >= min_revisit_bytes) & F.col("keep_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep_id"))
    marked = marked.select("page_id", "url", "payload", F.col("keep_id").alias("refers_to"), other.alias("revisit"))
    folder = scratch_path(pages.sparkSession, "warc")

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        fs, path = open_store(folder)
        fs.create_dir(path, recursive=True)
        out, done, size, count = None, [], 0, 0
        for batch in it:
            for page_id, url, body, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name = f"{path}/{uuid.uuid4().hex}.warc.gz"
                    out, size, count = fs.open_output_stream(name, compression=None), 0, 0
                member = record(page_id, url, body, base32_sha1(body), refers_to, revisit)
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= FILE_BYTES:
                    out.close()
                    done.append((name.rpartition("/")[2], size, count))
                    out = None
        if out is not None:
            out.close()
            done.append((name.rpartition("/")[2], size, count))
        if done:
            yield pa.RecordBatch.from_pylist([{"file": f"{folder}/{n}", "bytes": s, "records": c} for n, s, c in done])

    # whole archives rather than a small one for every shuffle partition
    tasks = min(MAX_TASKS, max(pages.sparkSession.sparkContext.defaultParallelism * 4, -(-total // FILE_BYTES)))
    return materialize(marked.coalesce(tasks).mapInArrow(write, "file string, bytes long, records long"), "manifest")


def read_range(fs: pafs.FileSystem, path: str, start: int, end: int) -> Iterator[bytes]:
    """Decompressed records whose gzip member starts in [start, end)."""
    with fs.open_input_file(path) as f:
        total = f.size()
        at = start
        while at < end:
            f.seek(at)
            window = f.read(min(_CHUNK, end - at + len(MAGIC) - 1))
            hit = window.find(MAGIC)
            if hit < 0 or at + hit >= end:
                at += max(1, len(window) - len(MAGIC) + 1)
                continue
            at += hit
            raw, used = _member(f, at, total)
            if raw is None:
                at += 1
            else:
                yield raw
                at += used


def _member(f: pa.NativeFile, at: int, total: int) -> tuple[bytes | None, int]:
    """The member at ``at`` and its compressed length; None if it isn't a whole WARC record."""
    f.seek(at)
    unpack, parts, fed, known = zlib.decompressobj(31), [], 0, 0
    try:
        while not unpack.eof:
            data = f.read(_CHUNK if known >= len(VERSION) else _PROBE)
            if not data:
                return None, 0
            fed += len(data)
            parts.append(unpack.decompress(data))
            known += len(parts[-1])
            if known >= 5 and not b"".join(parts[:2])[:5] == VERSION[:5]:
                return None, 0
    except zlib.error:
        return None, 0
    return b"".join(parts), fed - len(unpack.unused_data)


def read_archives(manifest: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest and, if asked for, payload of every record."""
    splits = manifest.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))
    splits = splits.select("file", "start", F.least(F.col("start") + split_bytes, F.col("bytes")).alias("end"))
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    if not payloads:
        names, kinds = names[:-1], kinds[:-1]
    kind = pa.schema(list(zip(names, kinds)))

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for file, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                rows, held = [], 0
                for raw in read_range(*open_store(file), start, end):
                    rows.append(parse(raw)[: len(names)])
                    held += len(raw) if payloads else 64
                    if held > (4 << 20):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kind.types)], schema=kind)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kind.types)], schema=kind)

    ddl = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * payloads
    n = splits.count()
    return splits.repartition(max(1, min(n, MAX_TASKS))).mapInArrow(read, ddl)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null html is an empty payload; repeated rows are records of their own; a null page_id is
    written as none and never the target of a revisit; an empty table gives no archives and no rows."""
    manifest = write_archives(table(spark, sf_dir, "pages"))
    return read_archives(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
g AS (SELECT t, max(page_id) AS keep FROM p GROUP BY t),
x AS (SELECT page_id, strlen(t) AS n, sha1(t) AS h, keep FROM p JOIN g USING (t))
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda j: array_to_string(list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * j::INT + 1, 5))::INT >> s::INT) & 31) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = keep THEN NULL ELSE keep END AS refers_to
FROM x
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op9_warc": op9_warc}
SQL = {"op9_warc": OP9_SQL}
