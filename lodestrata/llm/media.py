"""Binary media columns: PNG files in a column, read back, with perceptual hashes.

A payload of bytes becomes an 8-bit greyscale PNG, WIDTH samples a row. Reading checks the
signature, every chunk's CRC-32 and the zlib stream's Adler-32, inflates and undoes the row
filters with numpy. The feature is the sign pattern of the 63 lowest frequencies of a cosine
transform over the picture scaled to 32 x 32, as 16 hex digits.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import row_map

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
#: Bytes of compressed data in one IDAT chunk.
CHUNK = 1 << 16
SIDE, LOW = 32, 8


def padded(data: bytes, block: int = WIDTH) -> bytes:
    """data with zero bytes up to a positive multiple of block."""
    return data + b"\0" * (-len(data) % block if data else block)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def png_encode(payload: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """A greyscale PNG of a payload whose length is a positive multiple of width."""
    raw = np.frombuffer(payload, np.uint8).reshape(-1, width)
    left, above = raw.copy(), raw.copy()
    left[:, 1:] -= raw[:, :-1]
    above[1:] -= raw[:-1]
    # the filter with the smallest sum of absolute differences, as encoders do; lowest type wins ties
    costs = [int(np.abs(x.view(np.int8).astype(np.int16)).sum(dtype=np.int64)) for x in (raw, left, above)]
    kind = int(np.argmin(costs))
    rows = np.empty((len(raw), width + 1), np.uint8)
    rows[:, 0] = kind
    rows[:, 1:] = (raw, left, above)[kind]
    packed = zlib.compress(rows.tobytes(), level)
    head = struct.pack(">IIBBBBB", width, len(raw), 8, 0, 0, 0, 0)
    parts = [_chunk(b"IDAT", packed[i : i + CHUNK]) for i in range(0, len(packed), CHUNK)]
    return b"".join([SIGNATURE, _chunk(b"IHDR", head), *parts, _chunk(b"IEND", b"")])


def unfilter(rows: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Samples of 8-bit greyscale rows from their filtered form, all five filter types."""
    out = rows.copy()
    n = len(rows)
    edges = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), n]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        if lo == hi:
            continue
        kind = int(kinds[lo])
        if kind == 1:
            out[lo:hi] = np.cumsum(out[lo:hi], axis=1, dtype=np.uint8)
        elif kind == 2:
            if lo:
                out[lo] += out[lo - 1]
            out[lo:hi] = np.cumsum(out[lo:hi], axis=0, dtype=np.uint8)
        elif kind in (3, 4):
            for y in range(lo, hi):
                before = out[y - 1].tolist() if y else [0] * out.shape[1]
                line, a, c = out[y].tolist(), 0, 0
                for x, b in enumerate(before):
                    if kind == 3:
                        guess = (a + b) >> 1
                    else:
                        pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                        guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                    a, c = (line[x] + guess) & 255, b
                    line[x] = a
                out[y] = line
        elif kind:
            raise ValueError(f"no such PNG filter: {kind}")
    return out


def png_decode(data: bytes) -> np.ndarray:
    """The samples of an 8-bit greyscale PNG; ValueError if anything in it is damaged."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, body, ended = 8, None, [], False
    while at + 12 <= len(data):
        (size,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + size]
        if len(part) != size or zlib.crc32(part, zlib.crc32(kind)) != struct.unpack(">I", data[at + 8 + size : at + 12 + size] or b"\0" * 4)[0]:
            raise ValueError(f"damaged chunk {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            ended = True
            break
        at += 12 + size
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a whole, plain 8-bit greyscale PNG")
    try:
        flat = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    except zlib.error as e:
        raise ValueError(str(e)) from e
    width, height = head[:2]
    if flat.size != height * (width + 1):
        raise ValueError("the samples don't fill the picture")
    rows = flat.reshape(height, width + 1)
    return unfilter(rows[:, 1:], rows[:, 0])


#: The LOW lowest cosine waves over SIDE samples.
_WAVES = np.cos(np.pi * np.outer(np.arange(LOW), 2 * np.arange(SIDE) + 1) / (2 * SIDE))


def scaled(picture: np.ndarray, side: int = SIDE) -> np.ndarray:
    """side x side means over equal parts; short axes repeat their samples."""

    def along(x: np.ndarray) -> np.ndarray:
        n = len(x)
        if n < side:
            return x[np.arange(side) * n // side]
        starts = np.arange(side + 1) * n // side
        return np.add.reduceat(x, starts[:-1], axis=0) / np.diff(starts)[:, None]

    return along(along(picture.astype(np.float64)).T).T


def cosine_hash(picture: np.ndarray) -> str:
    """16 hex digits: which low frequencies lie above their median; the constant one counts as not."""
    low = np.round(_WAVES @ scaled(picture) @ _WAVES.T, 6).ravel()
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes().hex()


def encode_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes long, media binary: the PNG of each row's UTF-8 text, one row out for each row in.

    Null and empty texts become one row of zero samples. Ids may be null or repeated; other columns
    are not read. Equal texts give equal files. A text of any length is one file.
    """

    def one(data: bytes | None) -> tuple[int, bytes]:
        return len(data or b""), png_encode(padded(data or b""))

    return row_map(df, [F.col(id_col)], F.col(text_col).cast("binary"), lambda: one, "n_bytes long, media binary")


def decode_media(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Reads a column `media` back: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    A damaged file raises: a column of files that this engine wrote holds none.
    """

    def one(media: bytes) -> tuple:
        picture = png_decode(media)
        payload = picture.tobytes()
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(picture)

    shape = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return row_map(df, [F.col(id_col), F.col("n_bytes")], F.col("media"), lambda: one, shape)
