"""WARC archives in seekable Zstandard bundles.

A task writes one bundle: records grouped into independent frames, then a footer frame
with the seek table (compressed and plain size of every frame). The index maps a record's
id to bundle, frame and place in the plain frame, and says nothing of where frames lie: a
reader takes that from the bundle's own footer. So one record costs one read of the footer a
bundle and task, one ranged read and one frame to decompress. Bundles are written through a file-system URI under a name that is
unique to the attempt; only bundles that the index names count, so retried or doubled
tasks leave nothing wrong.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch_path

FRAME_BYTES = 256 << 10
LEAST_REVISIT_BYTES = 0
#: Fixed values of the seekable Zstandard format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
DATE = "2024-01-01T00:00:00Z"
_INDEX = "record_id string, page_id long, bundle string, frame int, record_offset long, record_length long"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def warc_record(kind: str, record_id: str, url: str | None, payload: bytes, digest: str, page_id, refers_to) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}"]
    if url:
        lines.append("WARC-Target-URI: " + " ".join(url.split()))
    if page_id is not None:
        lines.append(f"WARC-Page-ID: {page_id}")
    body = payload
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        body = b""
    lines += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    body = rest[: int(headers["Content-Length"])]
    if rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("a WARC record of wrong length")
    return headers, body


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer frame for (compressed, plain) sizes."""
    entries = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(entries)) + entries


def read_seek_table(file) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of every frame, from the footer of an open bundle.

    An error if the footer is none, or if its frames do not end where it begins.
    """
    end = file.size()
    if end < 17:
        raise ValueError("not a seekable bundle")
    file.seek(end - 9)
    count, flags, magic = struct.unpack("<IBI", file.read(9))
    start = end - 17 - 8 * count
    if magic != SEEKABLE_MAGIC or flags or start < 0:
        raise ValueError("not a seekable bundle")
    file.seek(start)
    head = struct.unpack("<II", file.read(8))
    sizes = list(struct.iter_unpack("<II", file.read(8 * count)))
    offsets = list(itertools.accumulate((packed for packed, _ in sizes), initial=0))
    if head != (SKIPPABLE_MAGIC, 8 * count + 9) or offsets[-1] != start:
        raise ValueError("a seek table that does not fit its bundle")
    return [(at, packed, plain) for at, (packed, plain) in zip(offsets, sizes, strict=False)]


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}") if not uri.startswith("file:/") or uri.startswith("file://") else fs.FileSystem.from_uri("file://" + uri[5:])


def _writer(folder: str):
    def run(batches):
        import zstandard

        store = bundle = None
        frames, open_, size = [], [], 0
        pack = zstandard.ZstdCompressor(level=3, write_content_size=True)

        def flush():
            nonlocal open_, size
            plain = b"".join(x[2] for x in open_)
            data = pack.compress(plain)
            out.write(data)
            rows, place = [], 0
            for record_id, page_id, record in open_:
                rows.append((record_id, page_id, bundle, len(frames), place, len(record)))
                place += len(record)
            frames.append((len(data), len(plain)))
            open_, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], [x.split()[0] for x in _INDEX.split(", ")])

        out = None
        for batch in batches:
            for row in range(batch.num_rows):
                page_id, url, html, first = (batch.column(c)[row].as_py() for c in ("page_id", "url", "html", "first_id"))
                payload = (html or "").encode("utf-8", "surrogatepass")
                digest = sha1_base32(payload)
                kind = "revisit" if first is not None and first != page_id and len(payload) >= LEAST_REVISIT_BYTES else "response"
                record_id = f"urn:page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"
                if out is None:
                    bundle = f"{folder}/bundle-{uuid.uuid4().hex}.warc.zst"
                    store, path = _open(bundle)
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(path, compression=None)  # else the name would have it compressed again
                open_.append((record_id, page_id, warc_record(kind, record_id, url, payload, digest, page_id, first)))
                size += len(open_[-1][2])
                if size >= FRAME_BYTES:
                    yield flush()
        if out is not None:
            if open_:
                yield flush()
            out.write(seek_table(frames))
            out.close()

    return run


def write_archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write every page as a WARC record under ``folder``; returns the index of records, as a table.

    Of pages with equal payloads the one with the smallest id is the response, others revisit
    it. Null html is the empty payload; a null id gets a random record id and, if its payload
    has a page with an id, revisits that. Rows that repeat an id repeat its record type.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    digest = F.sha1(F.encode(F.coalesce("html", F.lit("")), "utf-8"))
    # only payloads that occur more than once; mostly few, so the planner can send them to every task by their size
    twice = materialize(base.select(digest.alias("digest"), "page_id").groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("digest", "first_id"), "twice")
    marked = base.withColumn("digest", digest).join(twice, "digest", "left").select("page_id", "url", "html", "first_id")
    return materialize(marked.mapInArrow(_writer(folder), _INDEX), "warc-index")


def _reader(batches):
    import zstandard

    unpack, held = zstandard.ZstdDecompressor(), (None, b"")
    file, name, frames = None, None, []
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            if name != row["bundle"]:
                if file is not None:
                    file.close()
                store, path = _open(row["bundle"])
                file, name = store.open_input_file(path), row["bundle"]
                frames = read_seek_table(file)
            if held[0] != (name, row["frame"]):
                at, packed, plain = frames[row["frame"]]
                file.seek(at)
                held = ((name, row["frame"]), unpack.decompress(file.read(packed)))
                if len(held[1]) != plain:
                    raise ValueError(f"{name}: frame {row['frame']} and the seek table differ")
            headers, body = parse_record(held[1][row["record_offset"] : row["record_offset"] + row["record_length"]])
            digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
            if kind == "response" and sha1_base32(body) != digest:
                raise ValueError(f"{row['record_id']}: payload and digest differ")
            refers = headers.get("WARC-Refers-To", "").strip("<>").removeprefix("urn:page:")
            page = headers.get("WARC-Page-ID")
            rows.append((None if page is None else int(page), int(headers["WARC-Payload-Length"]), digest, kind, int(refers) if refers else None, headers.get("WARC-Target-URI"), body.decode("utf-8", "surrogatepass") if kind == "response" else None))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "html"])
    if file is not None:
        file.close()


def read_archive(index: DataFrame) -> DataFrame:
    """Records named by ``index``: page_id, payload_bytes, payload_digest, record_type, refers_to, url, html.

    html is null for revisits. Any subset of an index reads only the frames it needs; rows of
    one frame are read together. A digest that does not fit its payload fails the task.
    """
    near = index.select(*[x.split()[0] for x in _INDEX.split(", ")]).repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "record_offset")
    return near.mapInArrow(_reader, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, html string")
