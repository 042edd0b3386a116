"""Seekable Zstandard bundles of WARC records.

A bundle is a row of independent Zstandard frames, each with whole records, and a seek table in a skippable frame
at its end (the public seekable format), so any frame can be read alone. The index maps a record to its bundle,
frame and place within the decompressed frame. Payloads that occur again are written once, the rest as revisits.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import in_arrow, new_path, written

INDEX = "page_id bigint, bundle string, frame bigint, frame_at bigint, frame_bytes bigint, record_at bigint, record_bytes bigint"
RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
#: Fixed values of the public seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def record(page_id, url: str | None, digest: str, payload: bytes, size: int, first) -> bytes:
    """One record; first: (page_id of the response,) for a revisit, else None. An id of null is written as -."""
    name = lambda i: f"<urn:page:{'-' if i is None else i}>"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if first else 'response'}",
        f"WARC-Record-ID: {name(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        *([target(url)] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {size}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(first[0])}"] if first else []),
        "Content-Type: text/html",
        f"Content-Length: {len(payload)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def target(url: str) -> str:
    """The header of a URL; one that a header line can't hold as it is goes in base64."""
    if url and url.isascii() and url.isprintable() and url == url.strip():
        return f"WARC-Target-URI: {url}"
    return f"X-Target-Base64: {base64.b64encode(url.encode()).decode()}"


def url_of(head: dict) -> str | None:
    if "X-Target-Base64" in head:
        return base64.b64decode(head["X-Target-Base64"]).decode()
    return head.get("WARC-Target-URI")


def parse(data: bytes, at: int = 0) -> tuple[dict, bytes, int]:
    """Headers and payload of the record at a place, and where the next begins."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    assert lines[0] == "WARC/1.1"
    head = dict(x.partition(": ")[::2] for x in lines[1:])
    stop = end + 4 + int(head["Content-Length"])
    return head, data[end + 4 : stop], stop + 4


def page_id_of(name: str):
    return None if name == "<urn:page:->" else int(name[10:-1])


def write_bundles(pages: DataFrame, folder: str, frame_bytes: int = 256 * 1024, least_payload: int = 0, level: int = 3) -> DataFrame:
    """Writes pages (page_id, url, html) to bundles below folder, a URI that all executors reach; returns the index.

    The payload is html in UTF-8, null: empty. Of rows with equal payloads of at least least_payload bytes, those
    with the largest page_id are responses and the others revisit it (null ids are the smallest; rows that repeat the
    largest id are all responses); smaller payloads are always responses. Other columns are ignored.
    Records are sorted, and each attempt of a task writes a bundle of its own name, which its rows of the index give. So
    an attempt that is repeated, or lost with its executor, never changes a bundle that the index knows; what it
    left stays unnamed (see forget_unnamed()).
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    p = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    p = p.withColumn("sha1", F.sha1("payload")).withColumn("size", F.length("payload"))
    copies = p.where(F.col("size") >= least_payload).groupBy("sha1", "size").agg(F.count("*").alias("n"), F.max("page_id").alias("first"))
    copies = copies.where("n > 1").select("sha1", "size", "first", F.lit(True).alias("copy"))
    revisit = F.coalesce("copy", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first"))
    p = p.join(copies, ["sha1", "size"], "left").select("page_id", "url", "payload", "sha1", revisit.alias("revisit"), "first")
    p = p.sortWithinPartitions("sha1", "page_id", "url")
    names = [x.split()[0] for x in INDEX.split(", ")]

    def run(batches):
        import zstandard

        out, pack = None, zstandard.ZstdCompressor(level=level)
        fs, root = file_system(folder)
        task = TaskContext.get()
        bundle = f"bundle-{task.partitionId():06d}-{task.taskAttemptId()}.warc.zst"
        frames, open_frame, open_rows, rows, size = [], bytearray(), [], [], 0

        def close():
            nonlocal open_frame, open_rows, size
            packed = pack.compress(bytes(open_frame))
            out.write(packed)
            for r in open_rows:
                rows.append((r[0], bundle, len(frames), size, len(packed), *r[1:]))
            frames.append((len(packed), len(open_frame)))
            size += len(packed)
            open_frame, open_rows = bytearray(), []

        def batch():
            cols = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "bundle" else pa.int64()) for c, n in zip(cols, names, strict=True)], names)

        for b in batches:
            for page_id, url, payload, sha1, revisit, first in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{bundle}", compression=None)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                data = record(page_id, url, digest, b"" if revisit else payload, len(payload), (first,) if revisit else None)
                open_rows.append((page_id, len(open_frame), len(data)))
                open_frame += data
                if len(open_frame) >= frame_bytes:
                    close()
            if len(rows) >= 10_000:
                yield batch()
        if out is None:
            return
        if open_rows:
            close()
        table = b"".join(struct.pack("<II", *f) for f in frames)
        out.write(struct.pack("<II", SKIPPABLE, len(table) + 9) + table + struct.pack("<IBI", len(frames), 0, SEEKABLE))
        out.close()
        yield batch()

    return written(in_arrow(p, run, INDEX), "warc-index")


def forget_unnamed(index: DataFrame, folder: str) -> int:
    """Deletes the bundles below folder that the index doesn't name, left by lost attempts; how many. No writer may be at work there."""
    fs, root = file_system(folder)
    named = {r[0] for r in index.select("bundle").distinct().collect()}  # a name for each task
    found = [f.path for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.base_name.endswith(".warc.zst")]
    lost = [f for f in found if f.rsplit("/", 1)[-1] not in named]
    for f in lost:
        fs.delete_file(f)
    return len(lost)


def seek_table(f) -> list[tuple[int, int, int]]:
    """(place, packed bytes, bytes) of each frame of an open bundle, from its footer."""
    size = f.size()
    n, _, magic = struct.unpack("<IBI", f.read_at(9, size - 9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    out, at = [], 0
    for packed, plain in struct.iter_unpack("<II", f.read_at(8 * n, size - 9 - 8 * n)):
        out.append((at, packed, plain))
        at += packed
    return out


def read_record(folder: str, entry) -> tuple[dict, bytes]:
    """Headers and payload of the record that a row of the index points to; reads its frame alone."""
    import zstandard

    fs, root = file_system(folder)
    with fs.open_input_file(f"{root}/{entry['bundle']}") as f:
        at, packed, plain = seek_table(f)[entry["frame"]]
        assert (at, packed) == (entry["frame_at"], entry["frame_bytes"])
        data = zstandard.ZstdDecompressor().decompress(f.read_at(packed, at), max_output_size=plain)
    return parse(data, entry["record_at"])[:2]


def read_bundles(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """A row per record of the bundles that index names, in RECORDS; frames are the unit of work.

    A response's payload is checked against its digest. payloads=False leaves the payload column null.
    """
    frames = index.groupBy("bundle", "frame").agg(F.first("frame_at").alias("frame_at"), F.first("frame_bytes").alias("frame_bytes"), F.count("*").alias("records"))
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        fs, root = file_system(folder)
        name, f, table = None, None, []
        for b in batches:
            for e in b.to_pylist():
                if e["bundle"] != name:
                    name, f = e["bundle"], fs.open_input_file(f"{root}/{e['bundle']}")
                    table = seek_table(f)
                at, packed, plain = table[e["frame"]]
                data, rows, here = unpack.decompress(f.read_at(packed, at), max_output_size=plain), [], 0
                while here < len(data):
                    head, payload, here = parse(data, here)
                    digest, kind = head["WARC-Payload-Digest"][5:], head["WARC-Type"]
                    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"{name}, frame {e['frame']}: a payload doesn't match its digest")
                    refers = page_id_of(head["WARC-Refers-To"]) if kind == "revisit" else None
                    rows.append((page_id_of(head["WARC-Record-ID"]), url_of(head), int(head["WARC-Payload-Length"]), digest, kind, refers, payload if payloads and kind == "response" else None))
                if len(rows) != e["records"]:
                    raise ValueError(f"{name}, frame {e['frame']}: {len(rows)} records, {e['records']} in the index")
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    parts = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by count: the index's bytes say nothing of the bundles'
    return in_arrow(frames.repartition(parts, "bundle").sortWithinPartitions("bundle", "frame"), run, RECORDS)


def bundle_and_read(pages: DataFrame, **options) -> DataFrame:
    """Writes pages to bundles in the shared folder and reads them back."""
    folder = new_path(pages.sparkSession, "warc")
    return read_bundles(write_bundles(pages, folder, **options), folder, payloads=False)
