"""Image columns: Netpbm and BMP to numpy, area resizing by integral images, NPY tiles, difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches

#: Samples in a row of a stored payload.
ROW = 64
#: Rows and columns compared by the difference hash.
HASH_ROWS, HASH_COLUMNS = 8, 8

_FIELD = re.compile(rb"(?:[ \t\r\n\v\f]|#[^\r\n]*[\r\n])*([0-9]+)")


class NotAnImage(ValueError):
    pass


def encode_pgm(samples: np.ndarray) -> bytes:
    """A grey 8-bit image (height, width) as binary Netpbm (P5)."""
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + np.ascontiguousarray(samples, np.uint8).tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """A grey (height, width) or RGB (height, width, 3) 8-bit image as an uncompressed BMP."""
    height, width = samples.shape[:2]
    bits = 8 if samples.ndim == 2 else 24
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256)) if bits == 8 else b""
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    body = samples if bits == 8 else samples[:, :, ::-1]
    rows[:, : width * bits // 8] = body.reshape(height, -1)
    at = 54 + len(palette)
    head = struct.pack("<2sIHHI", b"BM", at + rows.size, 0, 0, at)
    head += struct.pack("<IiiHHIIiiII", 40, width, height, 1, bits, 0, rows.size, 2835, 2835, len(palette) // 4, 0)
    return head + palette + rows[::-1].tobytes()


def decode(data: bytes) -> np.ndarray:
    """The 8-bit samples of a Netpbm (P1 to P6) or uncompressed BMP (1, 4, 8, 24, 32 bits) image.

    (height, width) for bitmaps and grey, (height, width, 3) for colour. Bits become 0 and 255;
    deeper samples are scaled to 255. Anything else raises NotAnImage: other formats, null, sizes that the
    bytes don't hold, samples above the largest that the header allows.
    """
    if data is None:
        raise NotAnImage("null")
    try:
        if re.match(rb"P[1-6]\s", data):
            return _netpbm(data)
        if data[:2] == b"BM":
            return _bmp(data)
    except (IndexError, OverflowError, ValueError, struct.error) as e:
        raise NotAnImage(str(e)) from e
    raise NotAnImage("neither Netpbm nor BMP")


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, fields = data[1] - 48, 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        field = _FIELD.match(data, at)
        if not field:
            raise NotAnImage("header")
        fields.append(int(field[1]))
        at = field.end()
    width, height, most = (*fields, 1)[:3]
    if width < 1 or height < 1 or not 0 < most < 65536:
        raise NotAnImage("size")
    depth = 3 if kind in (3, 6) else 1
    n = width * height * depth
    stride = (width + 7) // 8
    held = stride * height if kind == 4 else n * 2 if kind > 4 and most > 255 else n
    if held > len(data) - at:  # before numpy reserves what no file holds
        raise NotAnImage("too short")
    if kind == 1:
        bits = re.sub(rb"#[^\r\n]*|[^01]", b"", data[at:])[:n]
        samples = 1 - (np.frombuffer(bits, np.uint8) - 48)
    elif kind in (2, 3):
        samples = np.array(re.sub(rb"#[^\r\n]*", b"", data[at:]).split()[:n], dtype=np.int64)
    elif kind == 4:
        rows = np.frombuffer(data, np.uint8, stride * height, at + 1).reshape(height, stride)
        samples = 1 - np.unpackbits(rows, axis=1)[:, :width].ravel()
    else:
        samples = np.frombuffer(data, ">u2" if most > 255 else np.uint8, n, at + 1)
    if len(samples) != n:
        raise NotAnImage("too short")
    if kind not in (1, 4) and not 0 <= samples.min() <= samples.max() <= most:
        raise NotAnImage("sample")
    if kind not in (1, 4) and most != 255:
        samples = (samples.astype(np.int64) * 255 + most // 2) // most
    elif kind in (1, 4):
        samples = samples * 255
    samples = samples.astype(np.uint8)
    return samples.reshape((height, width, 3) if depth == 3 else (height, width))


def _bmp(data: bytes) -> np.ndarray:
    at, header, width, height, _, bits, packing = struct.unpack_from("<I I i i H H I", data, 10)
    if packing not in (0, 3) or bits not in (1, 4, 8, 24, 32) or width < 1 or height == 0:
        raise NotAnImage("kind of BMP")
    if packing == 3 and (bits != 32 or struct.unpack_from("<III", data, 54) != (0xFF0000, 0xFF00, 0xFF)):
        raise NotAnImage("masks")
    tall, stride = abs(height), (width * bits + 31) // 32 * 4
    if stride * tall > len(data) - at:
        raise NotAnImage("too short")
    rows = np.frombuffer(data, np.uint8, stride * tall, at).reshape(tall, stride)
    rows = rows[::-1] if height > 0 else rows
    if bits >= 24:
        return rows[:, : width * bits // 8].reshape(tall, width, bits // 8)[:, :, 2::-1].copy()
    used = struct.unpack_from("<I", data, 46)[0] or 1 << bits
    palette = np.frombuffer(data, np.uint8, 4 * used, 14 + header).reshape(used, 4)[:, 2::-1]
    if bits == 8:
        index = rows[:, :width]
    else:
        index = np.unpackbits(rows, axis=1).reshape(tall, -1, bits)
        index = (index @ (1 << np.arange(bits)[::-1]))[:, :width]
    colours = palette[index]
    grey = (palette[:, 0] == palette[:, 1]).all() and (palette[:, 1] == palette[:, 2]).all()
    return colours[:, :, 0].copy() if grey else colours


def resize(samples: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the area under each target pixel, parts of pixels by their share, from an integral image.

    Of the integral image only the rows beside the targets' edges are held.
    """
    planes = samples if samples.ndim == 3 else samples[:, :, None]

    def edges(axis: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        place = np.arange(n + 1) * (planes.shape[axis] / n)
        low = np.minimum(place.astype(np.int64), planes.shape[axis] - 1)
        return low, (place - low).reshape([-1 if i == axis else 1 for i in range(3)])

    low, share = edges(0, height)
    rows = np.union1d(low, low + 1)
    sums = np.zeros((len(rows), planes.shape[1] + 1, planes.shape[2]))
    total, done = np.zeros(planes.shape[1:], np.int64), 0
    for i, row in enumerate(rows):
        total += planes[done:row].sum(0, dtype=np.int64)
        sums[i, 1:], done = total.cumsum(0), row
    at = np.searchsorted(rows, low)
    grid = sums[at] * (1 - share) + sums[at + 1] * share
    low, share = edges(1, width)
    grid = grid.take(low, 1) * (1 - share) + grid.take(low + 1, 1) * share
    area = (planes.shape[0] / height) * (planes.shape[1] / width)
    out = (grid[1:, 1:] - grid[:-1, 1:] - grid[1:, :-1] + grid[:-1, :-1]) / area
    out = np.clip(np.rint(out), 0, 255).astype(np.uint8)
    return out if samples.ndim == 3 else out[:, :, 0]


def grey(samples: np.ndarray) -> np.ndarray:
    if samples.ndim == 2:
        return samples
    return (samples @ np.array([299, 587, 114]) // 1000).astype(np.uint8)


def tile(samples: np.ndarray) -> np.ndarray:
    """The grey thumbnail of which neighbours are compared."""
    return resize(grey(samples), HASH_ROWS, HASH_COLUMNS + 1)


def difference_hash(thumbnail: np.ndarray) -> str:
    """A bit for each pair of neighbours in a row: 1 if the left one is darker; hexadecimal."""
    return np.packbits(thumbnail[:, :-1] < thumbnail[:, 1:]).tobytes().hex()


def npy(samples: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, samples, allow_pickle=False)
    return out.getvalue()


def tile_table(images: DataFrame, column: str = "media") -> DataFrame:
    """Decode an image column: height, width, channels, tile (NPY bytes) and feature, a row each.

    The image column is kept in front. A null, empty, cut off or unknown image gives nulls. Repeated
    rows are kept, an empty table gives none; other columns are not looked at.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for data in batch.column(0).to_pylist():
            try:
                samples = decode(data)
                small = tile(samples)
                rows.append((*samples.shape[:2], samples.shape[2] if samples.ndim == 3 else 1, npy(small), difference_hash(small)))
            except NotAnImage:
                rows.append((None,) * 5)
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string())
        arrays = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        names = [column, "height", "width", "channels", "tile", "feature"]
        return pa.RecordBatch.from_arrays([batch.column(0), *arrays], names)

    schema = f"`{column}` binary, height int, width int, channels int, tile binary, feature string"
    return images.select(column).mapInArrow(lambda batches: map(run, batches), schema)


def store(text: bytes, kind: str = "pgm") -> bytes:
    """Bytes as the samples of an image of ROW columns, filled up with zeros."""
    padded = text + bytes(-len(text) % ROW or (0 if text else ROW))
    samples = np.frombuffer(padded, np.uint8).reshape(-1, ROW)
    return encode_bmp(samples) if kind == "bmp" else encode_pgm(samples)


def text_images(docs: DataFrame, kind: str = "pgm") -> DataFrame:
    """doc_id, n_bytes and media (the image that stores the text losslessly) of each document.

    A null text counts as empty; the shortest payload is one row of zeros. Repeated rows and ids are
    kept, an empty table gives no rows; other columns are not looked at.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [(t or "").encode() for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(map(len, raw), pa.int64()), pa.array([store(r, kind) for r in raw], pa.binary())],
            ["doc_id", "n_bytes", "media"],
        )

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, media binary")


def digest_table(images: DataFrame) -> DataFrame:
    """What text_images stored, read back from the stored bytes: digests and features, a row each.

    Media that is null or no image gives nulls beside doc_id and n_bytes. Repeated rows and ids are
    kept, an empty table gives no rows.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(7)]
        for media in batch.column("media").to_pylist():
            try:
                samples = decode(media)
            except NotAnImage:
                for column in out:
                    column.append(None)
                continue
            payload, small = samples.tobytes(), tile(samples)
            row = (
                len(payload),
                hashlib.sha256(payload).hexdigest(),
                zlib.crc32(payload[-ROW:]),
                len(media),
                hashlib.sha256(media).hexdigest(),
                difference_hash(small),
                hashlib.sha256(npy(small)).hexdigest(),
            )
            for column, value in zip(out, row):
                column.append(value)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile_sha256"]
        arrays = [pa.array(c, kind) for c, kind in zip(out, kinds)]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_bytes"), *arrays], ["doc_id", "n_bytes", *names]
        )

    schema = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string, tile_sha256 string"
    )
    return images.mapInArrow(lambda batches: map(run, batches), schema)
