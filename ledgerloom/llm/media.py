"""Operator 5: media columns. Netpbm and BMP bytes become numpy arrays, are area-resized by integral images,
and are written as NPY tiles with difference hashes.

A binary column holds the media; rows are decoded in Arrow batches, an image at a time. Pixels are 8-bit
samples (grey or RGB), scaled from the image's own maximum; a maximum above 255 is not supported.

Defined results: null or undecodable media (short rasters, samples above the maximum, broken numbers or palettes) have
null features (``features``) or no tiles (``tiles``), and are never guessed; an empty text is one padded block; a text of any
length is one image, of which a task holds some ten times the size; repeated rows give equal values; an empty table gives
an empty one; extra columns are kept, and an output column whose name is taken gets a leading underscore.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import free_name, small_batches
from .wordhash import chunks

#: A payload's block: an image row is 24 samples wide and a block 24 rows high. Thumbnail and tile edge.
BLOCK_EDGE, THUMB, TILE = 24, 32, 16
PADDING = 255


class MediaError(ValueError):
    """The bytes are no image of a kind that is read here."""


def _header(data: bytes, count: int) -> tuple[list[int], int]:
    """Numbers after a Netpbm magic (comments skipped), and where the raster begins."""
    out: list[int] = []
    at = 2
    while len(out) < count:
        while at < len(data) and data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            end = data.find(b"\n", at)
            at = len(data) if end < 0 else end + 1
            continue
        start = at
        while at < len(data) and data[at : at + 1].isdigit():
            at += 1
        if start == at:
            raise MediaError("bad Netpbm header")
        if at - start > 9:
            raise MediaError("too large a number in a Netpbm header")
        out.append(int(data[start:at]))
    return out, at + 1


def _scaled(samples: np.ndarray, most: int) -> np.ndarray:
    """Samples of 0 to ``most`` as samples of 0 to 255."""
    if samples.max(initial=0) > most:
        raise MediaError("a sample above the maximum")
    return samples.astype(np.uint8, copy=False) if most == 255 else ((samples.astype(np.uint32) * 510 + most) // (2 * most)).astype(np.uint8)


def _netpbm(data: bytes) -> np.ndarray:
    kind = data[1:2]
    bitmap = kind in b"14"
    numbers, at = _header(data, 2 if bitmap else 3)
    width, height = numbers[:2]
    if width < 1 or height < 1 or (not bitmap and not 0 < numbers[2] < 256):
        raise MediaError("bad Netpbm size or depth")
    bands = 3 if kind in b"36" else 1
    n = width * height * bands
    if kind == b"1":
        plain = np.frombuffer(bytes(c for c in data[at - 1 :] if c in b"01"), dtype=np.uint8)[:n]
        if len(plain) < n:
            raise MediaError("short raster")
        out = np.where(plain == 49, 0, 255).astype(np.uint8)
    elif kind in b"23":
        values = data[at - 1 :].split()[:n]
        if len(values) < n:
            raise MediaError("short raster")
        if not all(v.isdigit() and len(v) < 10 for v in values):
            raise MediaError("a sample is no number")
        out = _scaled(np.array([int(v) for v in values]), numbers[2])
    elif kind == b"4":
        stride = (width + 7) // 8
        if len(data) < at + stride * height:
            raise MediaError("short raster")
        bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8, count=stride * height, offset=at).reshape(height, stride), axis=1)[:, :width]
        out = np.where(bits == 1, 0, 255).astype(np.uint8)
    elif kind in b"56":
        if len(data) < at + n:
            raise MediaError("short raster")
        out = _scaled(np.frombuffer(data, dtype=np.uint8, count=n, offset=at), numbers[2])
    else:
        raise MediaError("not a Netpbm kind that is read here")
    return out.reshape(height, width, bands) if bands == 3 else out.reshape(height, width)


def _bmp(data: bytes) -> np.ndarray:
    if len(data) < 54:
        raise MediaError("short BMP header")
    offset, _, width, height, planes, depth, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if planes != 1 or depth not in (8, 24, 32) or packing not in (0,) or width < 1 or height == 0:
        raise MediaError("not a BMP kind that is read here")
    rows, stride = abs(height), (width * depth // 8 + 3) // 4 * 4
    if len(data) < offset + stride * rows:
        raise MediaError("short BMP raster")
    raster = np.frombuffer(data, dtype=np.uint8, count=stride * rows, offset=offset).reshape(rows, stride)
    raster = raster[::-1] if height > 0 else raster
    if depth == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        start = 14 + struct.unpack_from("<I", data, 14)[0]
        if used > 256 or len(data) < start + used * 4:
            raise MediaError("short BMP palette")
        palette = np.frombuffer(data, dtype=np.uint8, count=used * 4, offset=start).reshape(used, 4)[:, 2::-1]
        index = raster[:, :width]
        if index.max(initial=0) >= used:
            raise MediaError("colour outside the palette")
        out = palette[index]
        return out[:, :, 0] if (palette[:, 0] == palette[:, 1]).all() and (palette[:, 1] == palette[:, 2]).all() else out
    return raster[:, : width * depth // 8].reshape(rows, width, depth // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    """Height x width (grey) or height x width x 3 samples of a Netpbm (P1 to P6) or BMP (8, 24, 32 bits) image."""
    if data[:2] == b"BM":
        return _bmp(data)
    if len(data) > 2 and data[:1] == b"P" and data[1:2] in b"123456":
        return _netpbm(data)
    raise MediaError("neither Netpbm nor BMP")


def encode_pgm(samples: np.ndarray) -> bytes:
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + samples.astype(np.uint8).tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """A grey image as an 8-bit BMP, bottom row first."""
    height, width = samples.shape
    stride = (width + 3) // 4 * 4
    raster = np.zeros((height, stride), dtype=np.uint8)
    raster[:, :width] = samples[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1)
    palette[:, 3] = 0
    head = b"BM" + struct.pack("<IHHI", 1078 + raster.size, 0, 0, 1078) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, raster.size, 2835, 2835, 256, 0)
    return head + palette.tobytes() + raster.tobytes()


def grey(image: np.ndarray) -> np.ndarray:
    """Luma of RGB in integers."""
    if image.ndim == 2:
        return image
    r, g, b = (image[:, :, i].astype(np.uint32) for i in range(3))
    return ((299 * r + 587 * g + 114 * b + 500) // 1000).astype(np.uint8)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Each output pixel is the mean over its exact (fractional) area, from differences of an integral image."""
    h, w = image.shape
    total = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(image, axis=0, dtype=np.float64), axis=1, out=total[1:, 1:])

    def at(edges: np.ndarray, table: np.ndarray, n: int) -> np.ndarray:
        low = np.minimum(edges.astype(np.int64), n - 1)
        part = (edges - low)[:, None]
        return table[low] * (1 - part) + table[low + 1] * part

    rows = at(np.arange(height + 1) * (h / height), total, h)
    both = at(np.arange(width + 1) * (w / width), rows.T, w).T
    sums = both[1:, 1:] - both[:-1, 1:] - both[1:, :-1] + both[:-1, :-1]
    return sums * (height * width / (h * w))


def difference_hash(image: np.ndarray) -> str:
    """64 bits: whether each of 8 x 8 cells is darker than its right neighbour."""
    small = np.round(area_resize(image, 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, tile, allow_pickle=False)
    return out.getvalue()


def cut(image: np.ndarray, thumb: int = THUMB, tile: int = TILE) -> list[tuple[int, int, np.ndarray]]:
    """The image resized to ``thumb`` x ``thumb`` samples and cut into tiles: row, column, samples."""
    small = np.clip(np.round(area_resize(grey(image), thumb, thumb)), 0, 255).astype(np.uint8)
    return [(y // tile, x // tile, small[y : y + tile, x : x + tile]) for y in range(0, thumb, tile) for x in range(0, thumb, tile)]


def tiles(df: DataFrame, key: str, media: str = "media", thumb: int = THUMB, tile: int = TILE) -> DataFrame:
    """A row per tile: key, tile_row, tile_col, npy (the bytes of an .npy file), dhash."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, m in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    got = cut(decode(m.as_py()), thumb, tile) if m.is_valid else []
                except MediaError:
                    got = []
                if got:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k.as_py()] * len(got), batch.schema.field(0).type), pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.int32()), pa.array([npy(g[2]) for g in got], pa.binary()), pa.array([difference_hash(g[2]) for g in got])],
                        names=[key, "tile_row", "tile_col", "npy", "dhash"],
                    )

    return df.select(key, media).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, tile_row int, tile_col int, npy binary, dhash string")


def text_to_media(df: DataFrame, text: str = "text", media: str = "media", form: str = "pgm") -> DataFrame:
    """``df`` with the text's UTF-8 bytes, padded to whole blocks, as an image of 8-bit samples, and n_bytes."""
    small_batches(df.sparkSession)
    spot, encode, block = df.columns.index(text), {"pgm": encode_pgm, "bmp": encode_bmp}[form], BLOCK_EDGE * BLOCK_EDGE
    n_bytes, media = free_name(df.columns, "n_bytes"), free_name(df.columns, media)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(a, b - a) for whole in batches for a, b in chunks(whole.column(spot))):
            raw = [(x.as_py() or "").encode("utf-8") for x in batch.column(spot)]
            images = [encode(np.frombuffer(b + bytes([PADDING]) * (max(block, -(-len(b) // block) * block) - len(b)), dtype=np.uint8).reshape(-1, BLOCK_EDGE)) for b in raw]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(b) for b in raw], pa.int64()), pa.array(images, pa.binary())], names=[*batch.schema.names, n_bytes, media])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(n_bytes, T.LongType()), T.StructField(media, T.BinaryType())]))


FEATURES = {"payload_bytes": T.LongType(), "payload_sha256": T.StringType(), "tail_crc32": T.LongType(), "media_bytes": T.LongType(), "media_sha256": T.StringType(), "feature": T.StringType(), "npy_bytes": T.LongType(), "npy_sha256": T.StringType()}


def features(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """``keep`` and, of the decoded samples, their digests, the difference hashes of the image and its tiles, and the tiles' digest."""
    small_batches(df.sparkSession)
    n, names = len(keep), [free_name(list(keep), c) for c in FEATURES]

    def of(data: bytes | None) -> tuple:
        try:
            image = decode(data) if data is not None else None
        except MediaError:
            image = None
        if image is None:
            return (None,) * 8
        payload, flat = image.tobytes(), grey(image)
        cells = [t for _, _, t in cut(flat)]
        files = b"".join(npy(t) for t in cells)
        feature = "-".join([difference_hash(flat), *(difference_hash(t) for t in cells)])
        return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature, len(files), hashlib.sha256(files).hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [of(x.as_py()) for x in batch.column(n)]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=[*keep, *names])

    rows = df.select(*keep, media)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:n], *(T.StructField(name, kind) for name, kind in zip(names, FEATURES.values(), strict=True))]))
