"""Texts as PNG images in binary columns, and low-frequency cosine-transform hashes of images.

A payload becomes an 8-bit grey image: signature, IHDR, IDAT chunks of one zlib stream, IEND, each chunk with its CRC. The
reader tests every CRC, inflates, and undoes the five row filters in numpy (Sub and Up for whole runs of rows at once,
Average and Paeth along anti-diagonals).
A hash is the sign pattern, around the median, of the 8 x 8 lowest frequencies of the image brought to 32 x 32.

Defined cases: null and empty texts are a payload of 576 bytes 255; a very long text is one image of as many rows as it
needs; repeated rows give repeated rows; a null doc_id stays null; a media column that is null gives null payload and
hash, a broken one an error that names the fault or, if asked for, null and the fault; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, quoted

#: Samples a row; payloads are filled with 255 up to a positive multiple of it.
WIDTH = 576
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_IDAT = 1 << 16
#: Samples a pixel by colour type: grey, RGB, palette, grey and alpha, RGB and alpha.
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_png(pixels: np.ndarray, level: int = 6) -> bytes:
    """An 8-bit grey image of the rows of pixels; of None, Sub and Up each row gets the filter with the least sum of magnitudes."""
    height, width = pixels.shape
    options = np.zeros((3, height, width), np.uint8)
    options[0] = options[1] = options[2] = pixels
    options[1, :, 1:] -= pixels[:, :-1]
    options[2, 1:] -= pixels[:-1]
    cost = np.abs(options.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int64)
    best = cost.argmin(axis=0)
    rows = np.empty((height, width + 1), np.uint8)
    rows[:, 0], rows[:, 1:] = best, options[best, np.arange(height)]
    data = zlib.compress(rows.tobytes(), level)
    parts = [_chunk(b"IDAT", data[i : i + _IDAT]) for i in range(0, len(data), _IDAT)]
    return b"".join([_SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)), *parts, _chunk(b"IEND", b"")])


def _along_diagonals(kind: np.ndarray, rows: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """Rows of Average and Paeth filters undone; the pixels of an anti-diagonal need only those of the two before it."""
    height, width = len(rows), rows.shape[1] // step
    raw, average = rows.reshape(height, width, step), (kind == 3)[:, None]
    out = np.zeros((height + 1, width + 1, step), np.int16)
    out[0, 1:] = above.reshape(width, step)
    for t in range(height + width - 1):
        y = np.arange(max(0, t - width + 1), min(height, t + 1))
        x = t - y
        a, b, c = out[y + 1, x], out[y, x + 1], out[y, x]
        far_a, far_b, far_c = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
        paeth = np.where((far_a <= far_b) & (far_a <= far_c), a, np.where(far_b <= far_c, b, c))
        out[y + 1, x + 1] = (raw[y, x] + np.where(average[y], (a + b) >> 1, paeth)) & 255
    return out[1:, 1:].reshape(height, -1).astype(np.uint8)


def unfilter(rows: np.ndarray, step: int) -> np.ndarray:
    """Samples of filtered rows (first byte: the filter); step is the samples of a pixel."""
    kind, out = rows[:, 0], rows[:, 1:].copy()
    if kind.max(initial=0) > 4:
        raise ValueError("PNG: unknown row filter")
    sub = kind == 1
    for c in range(step):
        out[sub, c::step] = np.cumsum(out[sub, c::step], axis=1, dtype=np.uint8)
    i, n = 0, len(kind)
    while i < n:
        if kind[i] < 2:
            i += 1
        elif kind[i] == 2:
            j = i
            while j < n and kind[j] == 2:
                j += 1
            first = out[i - 1 : i] if i else np.zeros((1, out.shape[1]), np.uint8)
            out[i:j] = np.cumsum(np.concatenate([first, out[i:j]]), axis=0, dtype=np.uint8)[1:]
            i = j
        else:
            j = i
            while j < n and kind[j] > 2:
                j += 1
            out[i:j] = _along_diagonals(kind[i:j], out[i:j], out[i - 1] if i else np.zeros_like(out[0]), step)
            i = j
    return out


def decode_png(data: bytes) -> np.ndarray:
    """Rows of samples of an 8-bit image without interlacing; every checksum is tested. A broken image is a ValueError that names the fault."""
    if data[:8] != _SIGNATURE:
        raise ValueError("PNG: no signature")
    at, head, parts, ended = 8, None, [], False
    while at < len(data) and not ended:
        if len(data) < at + 12:
            raise ValueError("PNG: cut short")
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(body, zlib.crc32(kind))):
            raise ValueError(f"PNG: checksum of {kind.decode('latin-1')} is wrong")
        at += 12 + size
        if kind == b"IHDR":
            if len(body) != 13:
                raise ValueError("PNG: header of a wrong length")
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        ended = kind == b"IEND"
    if head is None or not ended:
        raise ValueError("PNG: cut short")
    if at < len(data):
        raise ValueError("PNG: bytes after the end")
    width, height, depth, colour, _, _, interlaced = head
    if depth != 8 or interlaced:
        raise ValueError("PNG: only 8 bits a sample, not interlaced")
    if colour not in _SAMPLES:
        raise ValueError(f"PNG: no samples of colour type {colour}")
    if not width or not height:
        raise ValueError("PNG: no rows or columns")
    step = _SAMPLES[colour]
    inflate, need = zlib.decompressobj(), height * (width * step + 1)
    try:
        raw = inflate.decompress(b"".join(parts), need + 1)  # not more than the header tells, however far it would inflate
    except zlib.error as e:
        raise ValueError("PNG: broken compressed data") from e
    if len(raw) != need or not inflate.eof or inflate.unused_data:
        raise ValueError("PNG: samples don't fill the rows of the header")
    rows = np.frombuffer(raw, np.uint8)
    return unfilter(rows.reshape(height, width * step + 1), step)


def _area(n: int, to: int = 32) -> np.ndarray:
    """Weights that bring n samples to ``to`` by the share of each that an interval covers."""
    left = np.arange(to)[:, None] * n / to
    cover = np.minimum(np.arange(n) + 1, left + n / to) - np.maximum(np.arange(n), left)
    return np.maximum(cover, 0) * to / n


_COSINE = np.cos(np.pi / 32 * (np.arange(32) + 0.5)[None, :] * np.arange(8)[:, None])


def cosine_hash(pixels: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest frequencies, to four places, are above their median."""
    height, width = pixels.shape
    small = _area(height) @ pixels.astype(np.float64) @ _area(width).T
    low = np.round(_COSINE @ small @ _COSINE.T, 4).ravel()  # what should be 0 is 0 on every machine
    return np.packbits(low > np.median(low[1:])).tobytes()


def texts_as_png(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text) and media, the PNG of the filled payload."""

    def fn(batch):
        sizes, media = [], []
        for text in batch.column("text"):
            data = np.frombuffer(text.as_buffer() if text.is_valid else b"", np.uint8)
            rows = max(1, -(-len(data) // WIDTH))
            payload = np.full(rows * WIDTH, 255, np.uint8)
            payload[: len(data)] = data
            sizes.append(len(data))
            media.append(encode_png(payload.reshape(rows, WIDTH)))
        yield pa.Table.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), fn, "doc_id long, n_bytes long, media binary")


def decoded(images: DataFrame, broken: str = "raise") -> DataFrame:
    """images (with a binary column media) with payload, the samples read back, and hash.

    A broken image ends the job, or with broken="null" has neither and tells why in one more column, fault (else null).
    """
    own = ["payload", "hash", *(["fault"] if broken == "null" else [])]
    names = [c for c in images.columns if c not in own]

    def fn(batch):
        payload, hashes, faults = [], [], []
        for media in batch.column("media"):
            pixels, fault = None, None
            try:
                pixels = decode_png(media.as_py()) if media.is_valid else None
            except ValueError as e:
                if broken == "raise":
                    raise
                fault = str(e)
            faults.append(fault)
            payload.append(None if pixels is None else pixels.tobytes())
            hashes.append(None if pixels is None else cosine_hash(pixels))
        made = [pa.array(payload, pa.binary()), pa.array(hashes, pa.binary()), pa.array(faults, pa.string())][: len(own)]
        yield pa.Table.from_arrays([*(batch.column(c) for c in names), *made], [*names, *own])

    kept = images.select(*quoted(names))
    kinds = [T.BinaryType(), T.BinaryType(), T.StringType()]
    return map_arrow(kept, fn, T.StructType([*kept.schema.fields, *(T.StructField(n, k) for n, k in zip(own, kinds, strict=False))]), by="media")
