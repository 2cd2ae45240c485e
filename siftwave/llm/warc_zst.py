"""WARC (2): Zstandard archive reader, and the writer that makes its input.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the
dictionary, raw or itself a Zstandard frame; then follows one frame per record.
A file is read in ranges of ``split_bytes``: each task loads the dictionary from
the file's head, looks for the first frame that starts in its range (a magic
number there whose frame decodes to the start of a WARC record) and decodes the
frames that start before the range's end, one at a time, so a large archive is
read by many tasks and none holds more than one record.

Each record is held against the format: version line, WARC-Type, WARC-Record-ID,
WARC-Date and Content-Length, the block's length, the two line ends after it and
nothing beyond.

Defined results: what fails gives a row with ``error`` set and whatever could be
read; after a frame that can't be decoded the reader goes on at the next frame
that starts a record; a missing dictionary is an error of each frame that needs
it; an empty file gives no rows; skippable frames after the first are passed
over; header names match in any case, the first of repeated ones counts.  The
writer leaves out rows with a null URL, takes a null payload as empty, and
writes repeated rows as often as they occur; an empty table gives no archive.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwave.llm.common import materialise, reachable, shared_dir

DICT_MAGIC = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length")
SCHEMA = (
    "path string, offset bigint, frame_bytes bigint, warc_type string, record_id string, warc_date string, target_uri string, "
    "content_type string, content_length bigint, payload binary, error string"
)
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_TYPES = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
_SHAPE = pa.schema([(x.split()[0], _TYPES[x.split()[1]]) for x in SCHEMA.split(", ")])


def _open(path: str):
    where, inner = fs.FileSystem.from_uri(path)
    return where.open_input_file(inner)


def load_dictionary(head: bytes):
    """(dictionary or None, bytes that its frame takes)."""
    import zstandard

    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != DICT_MAGIC:
        return None, 0
    size = struct.unpack("<I", head[4:8])[0]
    body = head[8 : 8 + size]
    if len(body) < size:
        raise ValueError("dictionary frame is cut off")
    if body[:4] == FRAME:
        body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
    return zstandard.ZstdCompressionDict(body), 8 + size


def parse_record(raw: bytes) -> dict:
    """Fields of one decoded frame; ``error`` where it isn't a valid record."""
    out: dict = dict.fromkeys(_NAMES)
    end = raw.find(b"\r\n\r\n")
    if not re.match(rb"WARC/1\.[01]\r\n", raw):
        return out | {"error": "no WARC version line"}
    if end < 0:
        return out | {"error": "headers don't end"}
    head: dict[str, str] = {}
    for line in raw[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return out | {"error": "header without a colon"}
        head.setdefault(name.strip().lower(), value.strip())
    out |= {
        "warc_type": head.get("warc-type"), "record_id": head.get("warc-record-id"), "warc_date": head.get("warc-date"),
        "target_uri": head.get("warc-target-uri"), "content_type": head.get("content-type"),
    }
    missing = [k for k in NEEDED if not head.get(k)]
    if missing:
        return out | {"error": f"no {missing[0]}"}
    if not re.fullmatch(r"[0-9]{1,18}", head["content-length"]):
        return out | {"error": "content-length isn't a number"}
    size, body = int(head["content-length"]), raw[end + 4 :]
    out["content_length"] = size
    if len(body) < size:
        return out | {"payload": body, "error": "block is shorter than content-length"}
    out["payload"] = body[:size]
    if body[size : size + 4] != b"\r\n\r\n":
        return out | {"error": "no two line ends after the block"}
    if len(body) > size + 4:
        return out | {"error": "frame holds more than one record"}
    return out


class _Window:
    """The file's bytes from ``at`` on, read ahead in steps."""

    def __init__(self, file, size: int, step: int = 1 << 20):
        self.file, self.size, self.step, self.at, self.data, self.skip = file, size, step, 0, b"", 0

    def seek(self, at: int) -> None:
        begin = self.at - self.skip
        if begin <= at <= begin + len(self.data):
            self.skip = at - begin
        else:
            self.data, self.skip = b"", 0
        self.at = at

    def more(self) -> bool:
        begin = self.at - self.skip + len(self.data)
        if begin >= self.size:
            return False
        self.file.seek(begin)
        held = self.data[self.skip :]
        new = self.file.read(min(max(self.step, len(held)), self.size - begin))
        self.data, self.skip = held + new, 0
        return bool(new)

    def have(self, n: int) -> bytes:
        while len(self.data) - self.skip < n and self.more():
            pass
        return self.data[self.skip : self.skip + n]

    def find(self, mark: bytes) -> int:
        hit = self.data.find(mark, self.skip)
        return hit - self.skip if hit >= 0 else -1


def _frame(window: _Window, decoder, step: int = 1 << 14) -> tuple[bytes, int]:
    """Decoded bytes of the frame at the window's start, and its length."""
    import zstandard

    part, fed, out = decoder.decompressobj(), 0, []
    while True:
        chunk = window.data[window.skip + fed : window.skip + fed + step]
        if not chunk:
            if not window.more():
                raise zstandard.ZstdError("frame is cut off")
            continue
        out.append(part.decompress(chunk))
        fed += len(chunk)
        if part.eof:
            return b"".join(out), fed - len(part.unused_data)


def _starts_record(window: _Window, decoder) -> bool:
    import zstandard

    try:
        head = decoder.decompressobj().decompress(window.have(1 << 17))
    except zstandard.ZstdError:
        return False
    return head.startswith(b"WARC/1.")


def _next_frame(window: _Window, at: int, end: int, decoder) -> int:
    """Where the next frame of a record starts, from ``at`` on; ``end`` if none does before."""
    while at < end:
        window.seek(at)
        if len(window.have(4)) < 4:
            return end
        hit = window.find(FRAME)
        if hit < 0:
            at += max(1, len(window.data) - window.skip - 3)
            continue
        at += hit
        if at >= end:
            return end
        window.seek(at)
        if _starts_record(window, decoder):
            return at
        at += 1
    return end


def read_range(path: str, size: int, begin: int, end: int) -> Iterator[dict]:
    """Records of the frames that start in [begin, end)."""
    import zstandard

    with _open(path) as file:
        head = file.read(8)
        try:
            if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICT_MAGIC:
                head += file.read(struct.unpack("<I", head[4:8])[0])
            shared, first = load_dictionary(head)
        except (ValueError, zstandard.ZstdError) as e:
            if begin == 0:
                yield dict.fromkeys(_NAMES) | {"path": path, "offset": 0, "frame_bytes": size, "error": f"dictionary: {e}"}
            return
        decoder = zstandard.ZstdDecompressor(dict_data=shared) if shared else zstandard.ZstdDecompressor()
        window = _Window(file, size)
        at = first if begin <= first else _next_frame(window, begin, end, decoder)
        while at < end and at < size:
            window.seek(at)
            mark = window.have(8)
            if len(mark) == 8 and struct.unpack("<I", mark[:4])[0] & 0xFFFFFFF0 == 0x184D2A50:
                at += 8 + struct.unpack("<I", mark[4:8])[0]
                continue
            try:
                raw, taken = _frame(window, decoder)
            except zstandard.ZstdError as e:
                after = _next_frame(window, at + 1, size, decoder)
                yield dict.fromkeys(_NAMES) | {"path": path, "offset": at, "frame_bytes": after - at, "error": f"frame: {e}"}
                at = after
                continue
            yield parse_record(raw) | {"path": path, "offset": at, "frame_bytes": taken}
            at += taken


def _batches(rows: Iterator[dict], most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r["payload"] or b"") + 200
        if size >= most:
            yield pa.RecordBatch.from_pylist(held, _SHAPE)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, _SHAPE)


def read(spark: SparkSession, files: DataFrame, split_bytes: int = 64 << 20) -> DataFrame:
    """One row per record of the archives in ``files`` (path string, size bigint)."""
    reachable(spark)
    ranges = files.select("path", "size", F.explode(F.sequence(F.lit(0), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split_bytes))).alias("begin")).where("size > 0")
    # a range is a task's worth of work, whatever its row weighs
    ranges = ranges.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path", "begin")

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                yield from _batches(read_range(r["path"], r["size"], r["begin"], min(r["begin"] + split_bytes, r["size"])))

    return ranges.mapInArrow(run, SCHEMA)


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(path, size) of the ``.warc.zst`` files in a folder, for ``read``."""
    where, inner = fs.FileSystem.from_uri(path)
    found = [(f"{path.rstrip('/')}/{x.path[len(inner.rstrip('/')) + 1 :]}", x.size) for x in where.get_file_info(fs.FileSelector(inner, recursive=True)) if x.path.endswith(".warc.zst")]
    return spark.createDataFrame(sorted(found), "path string, size bigint")


def train_dictionary(samples: list[bytes], size: int = 64 << 10) -> bytes:
    """Empty where there's too little to learn from."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, level=3).as_bytes() if len(samples) >= 64 else b""
    except zstandard.ZstdError:
        return b""


def dictionary_frame(body: bytes) -> bytes:
    import zstandard

    packed = zstandard.ZstdCompressor(level=9).compress(body)
    return struct.pack("<II", DICT_MAGIC, len(packed)) + packed


def record(url: str, payload: bytes, row_id: str, date: str = "2024-01-01T00:00:00Z") -> bytes:
    url = re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url)
    mark = hashlib.blake2b(f"{row_id}\0{url}".encode() + payload, digest_size=16).digest()
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:{uuid.UUID(bytes=mark)}>\r\nWARC-Date: {date}\r\nWARC-Target-URI: {url}\r\nContent-Type: text/html\r\nContent-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload + b"\r\n\r\n"


def write(
    df: DataFrame, where: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", sample: int = 400, level: int = 3
) -> DataFrame:
    """Writes an archive per partition; (path, size) of those written.

    ``sample`` bounds the payloads that the dictionary is trained on.  A task
    names its file anew on every attempt, and only the names of the attempts
    that counted come back, so lost executors leave no half archive behind.
    """
    spark = df.sparkSession
    where = where or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    fs.FileSystem.from_uri(where)[0].create_dir(fs.FileSystem.from_uri(where)[1], recursive=True)
    slim = df.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload")).where("url is not null")
    body = train_dictionary([bytes(r[0]) for r in slim.select("payload").limit(sample).collect()])
    head = dictionary_frame(body) if body else b""

    def run(batches):
        import zstandard

        shared = zstandard.ZstdCompressionDict(body) if body else None
        maker = zstandard.ZstdCompressor(level=level, dict_data=shared) if shared else zstandard.ZstdCompressor(level=level)
        path, out, size = f"{where}/{uuid.uuid4().hex}.warc.zst", None, 0
        for batch in batches:
            for i, url, payload in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if out is None:
                    target, inner = fs.FileSystem.from_uri(path)
                    out = target.open_output_stream(inner, compression=None)
                    size += out.write(head)
                size += out.write(maker.compress(record(url, payload, i or "")))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "size": [size]})

    return materialise(slim.mapInArrow(run, "path string, size bigint"))
