"""Seekable Zstandard bundles of WARC records (operator 8).

Records are grouped into frames that are compressed each for itself, so that a frame can be
read alone. A bundle ends with a skippable frame that holds the seek table of the Zstandard
seekable format: any decoder reads the bundle as one stream, and a reader that knows the table
jumps to a frame. The index has a row for each record: its bundle and frame, and where it is
within the decompressed frame.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialize, shared_dir

#: A frame is closed when it has so many bytes before compression, a bundle after it.
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 18, 1 << 26, 3
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = ("page_id bigint, bundle string, frame int, frame_offset bigint, frame_bytes bigint, "
         "record_offset bigint, record_bytes bigint")


def record(page_id: int | None, url: str | None, html: str | None, date: str = "1970-01-01T00:00:00Z", unique: str = "") -> bytes:
    """A WARC/1.1 resource record. What is null is named in an extension field, as the target URI
    is mandatory; a null id is replaced by one made of ``unique``."""
    body = (html or "").encode()
    uri = "".join(c for c in url or "" if c not in "\r\n") or "urn:none"
    nulls = ",".join(n for n, v in (("id", page_id), ("url", url), ("html", html)) if v is None)
    name = f"urn:page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, unique)}"
    head = (f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <{name}>\r\nWARC-Date: {date}\r\n"
            f"WARC-Target-URI: {uri}\r\n" + (f"X-Null: {nulls}\r\n" if nulls else "") + ("X-Empty: url\r\n" if url == "" else "")
            + f"Content-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n")
    return head.encode() + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and content of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer for frames of (compressed, decompressed) bytes."""
    entries = b"".join(struct.pack("<II", c, d) for c, d in frames)
    footer = struct.pack("<IBI", len(frames), 0, _SEEKABLE)
    return struct.pack("<II", _SKIPPABLE, len(entries) + len(footer)) + entries + footer


def read_seek_table(bundle: bytes) -> list[tuple[int, int]]:
    """(offset, compressed bytes) of each frame, read from a bundle's end."""
    n, _, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != _SEEKABLE:
        raise ValueError("not a seekable bundle")
    at, out, table = 0, [], bundle[-9 - 8 * n : -9]
    for k in range(n):
        c, _ = struct.unpack_from("<II", table, 8 * k)
        out.append((at, c))
        at += c
    return out


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Bundle:
    """One file under construction."""

    def __init__(self, uri: str, name: str):
        self.name = name
        files, path = _filesystem(uri)
        self.out = files.open_output_stream(f"{path}/{name}", compression=None)  # the frames are compressed already
        self.frames: list[tuple[int, int]] = []
        self.size = 0

    def add(self, data: bytes) -> tuple[int, int, int]:
        import zstandard

        packed = zstandard.ZstdCompressor(level=LEVEL).compress(data)
        self.out.write(packed)
        at, k = self.size, len(self.frames)
        self.frames.append((len(packed), len(data)))
        self.size += len(packed)
        return k, at, len(packed)

    def close(self) -> None:
        self.out.write(seek_table(self.frames))
        self.out.close()


def write_bundles(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, date: str | None = None) -> DataFrame:
    """Write all rows as bundles into ``folder`` (a URI that all executors reach) and return the
    index, which is written there too.

    Each task writes its own partition's bundles, without a shuffle; a bundle's name holds the
    task attempt, so that a repeated or speculative task never touches the files that the
    index of another attempt names. ``date`` is the records' WARC-Date, by default the time of the call. Null ids, URLs and
    contents are marked in their records and read again as nulls (line breaks of URLs are lost); ids are
    cast to bigint, where one that isn't a number fails in ANSI mode and is null else; other columns are ignored;
    repeated rows make a record each; a record longer than a frame is a frame of its own; an
    empty table makes no bundle and an empty index.
    """
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    names = [x.split()[0] for x in INDEX.split(", ")]
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    files, path = _filesystem(folder)
    files.create_dir(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        tag = f"{task.partitionId():06d}-{task.taskAttemptId():08d}" if task else uuid.uuid4().hex
        bundle, made, buffer, inside, size = None, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal bundle, made, buffer, inside, size
            if bundle is None:
                bundle = _Bundle(folder, f"bundle-{tag}-{made:04d}.warc.zst")
                made += 1
            k, at, n = bundle.add(b"".join(buffer))
            out = [(i, bundle.name, k, at, n, o, m) for i, o, m in inside]
            if bundle.size >= bundle_bytes:
                bundle.close()
                bundle = None
            buffer, inside, size = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], names)

        kinds = [pa.int64(), pa.string(), pa.int32(), *[pa.int64()] * 4]
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                for i, url, html in zip(*(c.to_pylist() for c in part.columns)):
                    data = record(i, url, html, date, f"{tag}/{made}/{0 if bundle is None else len(bundle.frames)}/{len(inside)}")
                    inside.append((i, size, len(data)))
                    buffer.append(data)
                    size += len(data)
                    if size >= frame_bytes:
                        yield flush()
        if buffer:
            yield flush()
        if bundle is not None:
            bundle.close()

    return materialize(rows.mapInArrow(run, INDEX), "warc-index")


def fetch(index: DataFrame, folder: str) -> DataFrame:
    """(page_id, url, html) of the records that ``index`` names; each frame is read once for
    each run of its rows, so sorted indexes are read fastest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        files, path = _filesystem(folder)
        last, frame = None, b""
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                key = (r["bundle"], r["frame"])
                if key != last:
                    with files.open_input_file(f"{path}/{r['bundle']}") as f:
                        f.seek(r["frame_offset"])
                        frame = zstandard.ZstdDecompressor().decompress(f.read(r["frame_bytes"]))
                    last = key
                fields, body = parse(frame[r["record_offset"] : r["record_offset"] + r["record_bytes"]])
                null = fields.get("X-Null", "").split(",")
                url = None if "url" in null else "" if "X-Empty" in fields else fields["WARC-Target-URI"]
                out.append((r["page_id"], url, None if "html" in null else body.decode()))
            cols = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string()))], ["page_id", "url", "html"])

    ordered = index.repartition("bundle").sortWithinPartitions("bundle", "frame", "record_offset")
    return ordered.mapInArrow(run, "page_id bigint, url string, html string")


def op8_seekable_warc(spark, sf_dir: str) -> DataFrame:
    """The index of bundles with all pages, which are written into the shared folder."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    return write_bundles(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder).withColumn("folder", F.lit(folder))


QUERIES = {"op8_seekable_warc": op8_seekable_warc}
SQL: dict[str, str] = {}
