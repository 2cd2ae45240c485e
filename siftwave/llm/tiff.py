"""Media columns (3): TIFF files in a binary column, one row per page.

The image directories of each file are walked (both byte orders, classic and
BigTIFF); strips and tiles stored plain, as PackBits, LZW or deflate are decoded
and their horizontal or floating-point predictor is undone.  ``pixels`` has the
page's samples row by row, all samples of a pixel together, in little-endian
order; samples under 8 bits take a byte each.

Defined results: a null file gives no rows; one that isn't a TIFF, or is empty,
gives one row of page null with ``error``; a page that can't be decoded (cut
off, of an unknown compression, larger than ``max_page_bytes``) has null pixels
and ``error``, and the walk goes on; a directory that was walked already ends
the walk with an error row; null ids and repeated rows pass through alike; an
empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwave.llm.common import cuts

NONE, LZW, DEFLATE, PACKBITS = 1, 5, 8, 32773
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 13: "I", 16: "Q", 17: "q", 18: "Q"}
SCHEMA = "id bigint, page int, width int, height int, samples int, bits int, sample_format int, photometric int, compression int, predictor int, tiled boolean, pixels binary, error string"
_SHAPE = pa.schema([(n, {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}[t]) for n, t in (x.split() for x in SCHEMA.split(", "))])


class Bad(ValueError):
    pass


def unpack_bits(data: bytes) -> bytes:
    out, at, n = [], 0, len(data)
    while at < n:
        head = data[at]
        if head < 128:
            out.append(data[at + 1 : at + 2 + head])
            at += head + 2
        else:
            if head > 128:
                out.append(data[at + 1 : at + 2] * (257 - head))
            at += 2 if head > 128 else 1
    return b"".join(out)


def unpack_lzw(data: bytes) -> bytes:
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, held, bits, prev, out = base.copy(), 9, 0, 0, None, []
    for byte in data:
        held = held << 8 | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 256:
            table, width, prev = base.copy(), 9, None
            continue
        if code == 257:
            break
        if prev is None:
            if code > 255:
                raise Bad("LZW code before its entry")
            entry = table[code]
        else:
            if code < len(table):
                entry = table[code]
                table.append(prev + entry[:1])
            elif code == len(table):
                entry = prev + prev[:1]
                table.append(entry)
            else:
                raise Bad("LZW code before its entry")
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        out.append(entry)
        prev = entry
    return b"".join(out)


def pack_bits(data: bytes) -> bytes:
    out, at, n, plain = [], 0, len(data), 0
    while at < n:
        run = 1
        while run < 128 and at + run < n and data[at + run] == data[at]:
            run += 1
        if run >= 3 or at + run == n and run > 1:
            while plain < at:
                k = min(128, at - plain)
                out.append(bytes([k - 1]) + data[plain : plain + k])
                plain += k
            out.append(bytes([257 - run, data[at]]))
            plain = at + run
        at += run
    while plain < n:
        k = min(128, n - plain)
        out.append(bytes([k - 1]) + data[plain : plain + k])
        plain += k
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    base = {bytes([i]): i for i in range(256)}
    table, width, nxt, held, bits, out = base.copy(), 9, 258, 256, 9, bytearray()

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    word = b""
    for i in range(len(data)):
        more = word + data[i : i + 1]
        if more in table:
            word = more
            continue
        put(table[word])
        table[more] = nxt
        nxt += 1
        if nxt == 4094:
            put(256)
            table, width, nxt = base.copy(), 9, 258
        elif nxt > (1 << width) - 1:
            width += 1
        word = data[i : i + 1]
    if word:
        put(table[word])
        if nxt + 1 > (1 << width) - 1 and width < 12:
            width += 1
    put(257)
    return bytes(out) + (bytes([held << 8 - bits & 255]) if bits else b"")


def _decoded(data: bytes, compression: int, want: int) -> bytes:
    if compression == NONE:
        out = data
    elif compression == PACKBITS:
        out = unpack_bits(data)
    elif compression == LZW:
        out = unpack_lzw(data)
    elif compression in (DEFLATE, 32946):
        try:
            out = zlib.decompressobj().decompress(data, want)
        except zlib.error as e:
            raise Bad(f"deflate: {e}") from None
    else:
        raise Bad(f"compression {compression} isn't supported")
    if len(out) < want:
        raise Bad("strip or tile is cut off")
    return out[:want]


def _samples(data: bytes, rows: int, width: int, samples: int, bits: int, predictor: int, order: str) -> np.ndarray:
    """(rows, width, samples) of one strip or tile, predictor undone."""
    if bits < 8:
        line = np.frombuffer(data, np.uint8).reshape(rows, -1)
        flat = np.unpackbits(line, axis=1).reshape(rows, -1, bits)
        weight = 1 << np.arange(bits - 1, -1, -1, dtype=np.uint8)
        x = (flat * weight).sum(axis=2, dtype=np.uint8)[:, : width * samples].reshape(rows, width, samples)
        return np.bitwise_and(np.cumsum(x, axis=1, dtype=np.uint8), (1 << bits) - 1) if predictor == 2 else x
    size = bits // 8
    if predictor == 3:
        line = np.frombuffer(data, np.uint8).reshape(rows, -1, samples)
        line = np.cumsum(line, axis=1, dtype=np.uint8).reshape(rows, size, width * samples)
        return np.ascontiguousarray(line[:, ::-1].transpose(0, 2, 1)).view(f"<u{size}").reshape(rows, width, samples)
    x = np.frombuffer(data, f"{order}u{size}").reshape(rows, width, samples).astype(f"<u{size}")
    return np.cumsum(x, axis=1, dtype=f"<u{size}") if predictor == 2 else x


class File:
    def __init__(self, data: bytes):
        self.data = data
        if data[:2] not in (b"II", b"MM") or len(data) < 8:
            raise Bad("not a TIFF")
        self.order = "<" if data[:2] == b"II" else ">"
        magic = self.take("H", 2)
        if magic == 42:
            self.big, self.first = False, self.take("I", 4)
        elif magic == 43 and self.take("H", 4) == 8:
            self.big, self.first = True, self.take("Q", 8)
        else:
            raise Bad("not a TIFF")

    def take(self, code: str, at: int):
        try:
            return struct.unpack_from(self.order + code, self.data, at)[0]
        except struct.error:
            raise Bad("offset beyond the file") from None

    def directory(self, at: int) -> tuple[dict[int, list], int]:
        """Integer fields of the directory at ``at``, and where the next one is."""
        count, at = (self.take("Q", at), at + 8) if self.big else (self.take("H", at), at + 2)
        step, head, code = (20, 8, "Q") if self.big else (12, 4, "I")
        if at + count * step + head > len(self.data):
            raise Bad("directory is cut off")
        fields: dict[int, list] = {}
        for k in range(count):
            p = at + k * step
            tag, kind, n = self.take("H", p), self.take("H", p + 2), self.take(code, p + 4)
            if kind not in _CODES:
                continue
            q, size = p + 4 + head, n * _SIZES[kind]
            if size > head:
                q = self.take(code, q)
            if q + size > len(self.data):
                raise Bad(f"values of tag {tag} are beyond the file")
            fields[tag] = list(struct.unpack_from(f"{self.order}{n}{_CODES[kind]}", self.data, q))
        return fields, self.take(code, at + count * step)

    def pixels(self, f: dict[int, list], page: dict, max_bytes: int) -> bytes:
        width, height, samples, bits = page["width"], page["height"], page["samples"], page["bits"]
        if not width or not height or not samples:
            raise Bad("page has no size")
        if len(set(f.get(258, [1]))) > 1:
            raise Bad("samples of different bits aren't supported")
        if bits not in (1, 2, 4, 8, 16, 32, 64) or page["predictor"] not in (1, 2, 3) or (page["predictor"] == 3 and bits < 16):
            raise Bad(f"{bits} bits with predictor {page['predictor']} aren't supported")
        size = max(bits // 8, 1)
        if width * height * samples * size > max_bytes:
            raise Bad(f"page is larger than {max_bytes} bytes")
        tiled = page["tiled"]
        w, h = (f[322][0], f.get(323, [0])[0]) if tiled else (width, min(f.get(278, [height])[0], height))
        offsets, counts = (f.get(324), f.get(325)) if tiled else (f.get(273), f.get(279))
        if not w or not h or not offsets:
            raise Bad("page has no strips or tiles")
        across, down = -(-width // w), -(-height // h)
        planes = samples if f.get(284, [1])[0] == 2 else 1
        each = samples // planes
        if w * h * each * size > max_bytes:
            raise Bad(f"page is larger than {max_bytes} bytes")
        if counts is None:
            if page["compression"] != NONE or len(offsets) != 1:
                raise Bad("strips have no byte counts")
            counts = [len(self.data) - offsets[0]]
        if len(offsets) < across * down * planes or len(counts) < len(offsets):
            raise Bad("too few strips or tiles")
        out = np.zeros((height, width, samples), f"<u{size}")
        for k in range(across * down * planes):
            plane, at = divmod(k, across * down)
            y, x = at // across * h, at % across * w
            rows = h if tiled else min(h, height - y)
            want = rows * (-(-w * each * bits // 8))
            if offsets[k] + counts[k] > len(self.data):
                raise Bad("strip or tile is beyond the file")
            body = _decoded(self.data[offsets[k] : offsets[k] + counts[k]], page["compression"], want)
            part = _samples(body, rows, w, each, bits, page["predictor"], self.order)
            part = part[: height - y, : width - x]
            out[y : y + part.shape[0], x : x + part.shape[1], plane * each : (plane + 1) * each] = part
        return out.tobytes()


#: the longest binary value that a row can hold
MOST = 2**31 - 1024


def walk(data: bytes, max_bytes: int = MOST):
    """A dict per page, or one with page None for a file that isn't a TIFF."""
    empty = dict.fromkeys(_SHAPE.names)
    try:
        file = File(data)
    except Exception as e:  # noqa: BLE001
        yield empty | {"error": str(e) or type(e).__name__}
        return
    at, seen, n = file.first, set(), 0
    while at:
        page = empty | {"page": n}
        if at in seen:
            yield page | {"error": "directories form a loop"}
            return
        seen.add(at)
        try:
            fields, at = file.directory(at)
        except Exception as e:  # noqa: BLE001 - bytes of any kind: whatever they upset is an error of the file
            yield page | {"error": str(e) or type(e).__name__}
            return
        one = lambda tag, default, f=fields: (f.get(tag) or [default])[0]
        page |= {
            "width": one(256, 0), "height": one(257, 0), "samples": one(277, 1), "bits": one(258, 1), "sample_format": one(339, 1),
            "photometric": one(262, 0), "compression": one(259, 1), "predictor": one(317, 1), "tiled": bool(fields.get(322)),
        }
        try:
            page["pixels"] = file.pixels(fields, page, max_bytes)
        except Exception as e:  # noqa: BLE001
            page["error"] = str(e) or type(e).__name__
        # what a column can't hold is null, and an error
        for k in ("width", "height", "samples", "bits", "sample_format", "photometric", "compression", "predictor"):
            if not -(2**31) <= page[k] < 2**31:
                page |= {k: None, "pixels": None, "error": f"{k} of {page[k]} is out of range"}
        yield page
        n += 1


def pages(files: DataFrame, id_col: str = "id", bytes_col: str = "tiff", max_page_bytes: int = MOST) -> DataFrame:
    """One row per page of the TIFF files in ``bytes_col``; a page of more bytes than a
    value can have is reported with an error."""

    def run(batches):
        for batch in batches:
            for a, b in cuts(batch.column(1), 1 << 22):
                held, size = [], 0
                for i, data in zip(batch.column(0)[a:b].to_pylist(), batch.column(1)[a:b].to_pylist()):
                    for page in walk(data, max_page_bytes) if data is not None else ():
                        held.append(page | {"id": i})
                        size += len(page["pixels"] or b"")
                        if size > 1 << 24:
                            yield pa.RecordBatch.from_pylist(held, _SHAPE)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, _SHAPE)

    slim = files.select(F.col(id_col).cast("bigint").alias("id"), F.col(bytes_col).cast("binary").alias("tiff"))
    return slim.mapInArrow(run, SCHEMA)


# ------------------------------------------------------------- making TIFF files


def page_of(x: np.ndarray, compression: int = NONE, predictor: int = 1, tile: int = 0, rows: int = 16, order: str = "<", sample_format: int = 1) -> tuple[dict[int, list], list[bytes]]:
    """(fields, strips or tiles) of an (height, width, samples) array."""
    height, width, samples = x.shape
    size = x.dtype.itemsize
    bits = x.astype(f"<u{size}") if x.dtype.kind == "u" else x.view(f"<u{size}")
    parts = []
    step_y, step_x = (tile, tile) if tile else (rows, width)
    for y in range(0, height, step_y):
        for left in range(0, width, step_x):
            part = bits[y : y + step_y, left : left + step_x]
            if tile:
                part = np.pad(part, ((0, tile - part.shape[0]), (0, tile - part.shape[1]), (0, 0)))
            if predictor == 2:
                part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1)
            if predictor == 3:
                line = np.ascontiguousarray(part).view(np.uint8).reshape(part.shape[0], -1, size)[:, :, ::-1].transpose(0, 2, 1).reshape(part.shape[0], -1, samples)
                body = np.concatenate([line[:, :1], np.diff(line, axis=1)], axis=1).tobytes()
            else:
                body = part.astype(f"{order}u{size}").tobytes()
            parts.append({NONE: bytes, PACKBITS: pack_bits, LZW: pack_lzw, DEFLATE: zlib.compress}[compression](body))
    where = {322: [tile], 323: [tile], 324: None, 325: None} if tile else {273: None, 278: [rows], 279: None}
    return {256: [width], 257: [height], 258: [8 * size] * samples, 259: [compression], 262: [1], 277: [samples], 317: [predictor], 339: [sample_format] * samples} | where, parts


def assemble(made: list[tuple[dict[int, list], list[bytes]]], order: str = "<", big: bool = False) -> bytes:
    """A TIFF file of the pages ``made`` by ``page_of``."""
    code, head = ("Q", 8) if big else ("I", 4)
    out = bytearray((b"II" if order == "<" else b"MM") + (struct.pack(order + "HHH", 43, 8, 0) if big else struct.pack(order + "H", 42)))
    link = len(out)
    out += struct.pack(order + code, 0)
    for fields, parts in made:
        at = []
        for p in parts:
            at.append(len(out))
            out += p
        fields = {k: v if v is not None else at if k in (273, 324) else [len(p) for p in parts] for k, v in fields.items()}
        entries = []
        for tag, v in sorted(fields.items()):
            kind = (16 if big else 4) if tag in (273, 279, 324, 325) else 3 if max(v) < 65536 else 4
            body = struct.pack(f"{order}{len(v)}{_CODES[kind]}", *v)
            if len(body) > head:
                body, spot = struct.pack(order + code, len(out)), body
                out += spot
            entries.append(struct.pack(order + "HH" + code, tag, kind, len(v)) + body.ljust(head, b"\0"))
        struct.pack_into(order + code, out, link, len(out))
        out += struct.pack(order + ("Q" if big else "H"), len(entries)) + b"".join(entries)
        link = len(out)
        out += struct.pack(order + code, 0)
    return bytes(out)


_WAYS = [(NONE, 1, 0), (PACKBITS, 1, 0), (LZW, 1, 0), (LZW, 2, 16), (DEFLATE, 2, 0), (DEFLATE, 1, 32), (PACKBITS, 1, 16), (LZW, 2, 0)]


def rendered(texts: DataFrame, group_col: str = "conv_id", order_by: tuple[str, ...] = ("turn", "role"), text_col: str = "text", width: int = 64) -> DataFrame:
    """(id, tiff): a file per group with a page per row, whose 8-bit samples are
    the text's UTF-8 bytes in lines of ``width``; compression, predictor, strips
    and tiles take turns."""
    place = F.row_number().over(Window.partitionBy(group_col).orderBy(*order_by, text_col))
    slim = texts.select(F.col(group_col).cast("bigint").alias("id"), place.alias("n"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("body"))
    files = slim.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "body"))).alias("pages"))

    def make(batches):
        for batch in batches:
            made = []
            for i, group in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out = []
                for p in group:
                    height = max(1, -(-len(p["body"]) // width))
                    x = np.frombuffer(bytes(p["body"]).ljust(height * width, b"\0"), np.uint8).reshape(height, width, 1)
                    compression, predictor, tile = _WAYS[((i or 0) + p["n"]) % len(_WAYS)]
                    out.append(page_of(x, compression, predictor, tile, order="<" if (i or 0) % 2 else ">"))
                made.append(assemble(out, "<" if (i or 0) % 2 else ">", big=(i or 0) % 3 == 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["id", "tiff"])

    return files.mapInArrow(make, "id bigint, tiff binary")
