"""Media columns: byte payloads stored as PNG, read back, and hashed by low-frequency cosines.

``store`` turns a text or binary column into a binary column of greyscale PNGs;
``load`` reads such a column: chunk by chunk with the checksum tests, zlib for
the pixels, numpy for the row filters, and a cosine-transform hash as feature.
Both are row-local, so no row moves between tasks and a lost task is redone alone.

Defined results: null or empty content is stored as one row of zero bytes; a
null file, or one that is damaged or no such image, is read as null payload and
feature with the reason in ``error``, and stops nothing; a null id stays null; equal payloads give equal files and features; repeated rows
are stored each. Content of any length becomes more rows of the image.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.plans.arrow import map_rows

#: Pixels in a row of the image, and so the unit of padding.
WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes of compressed pixels in one IDAT chunk.
CHUNK = 1 << 16
#: Bytes that a packed byte stands for at most: two bits for a match of 258.
DENSEST = 1032
#: Side of the block means that are transformed, and of the low-frequency corner that is kept.
GRID, CORNER = 32, 8


def pad(content: bytes) -> bytes:
    """``content`` with zero bytes up to a positive multiple of the width."""
    return content + bytes(-len(content) % WIDTH if content else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def filter_rows(image: np.ndarray, kind: int) -> np.ndarray:
    """Each row of ``image`` after PNG row filter ``kind`` (0 none, 1 left, 2 up, 3 mean, 4 Paeth)."""
    left = np.pad(image, ((0, 0), (1, 0)))[:, :-1]
    up = np.pad(image, ((1, 0), (0, 0)))[:-1]
    if kind == 0:
        return image
    if kind == 1:
        return image - left
    if kind == 2:
        return image - up
    if kind == 3:
        return image - ((left.astype(np.int16) + up) >> 1).astype(np.uint8)
    corner = np.pad(image, ((1, 0), (1, 0)))[:-1, :-1]
    return image - _paeth(left.astype(np.int16), up.astype(np.int16), corner.astype(np.int16))


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    p = a + b - c
    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c)).astype(np.uint8)


def unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The pixels again: runs of rows with one filter are undone at once where the filter allows it."""
    out = np.empty_like(rows)
    above = np.zeros(rows.shape[1], np.uint8)
    if kinds.max(initial=0) > 4:
        raise ValueError(f"unknown row filter {kinds.max()}")
    how = np.minimum(kinds, 3)  # 3 and 4 are undone together
    edges = [0, *(np.flatnonzero(np.diff(how)) + 1).tolist(), len(how)]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        if lo == hi:
            continue
        kind, part = int(how[lo]), rows[lo:hi]
        if kind == 0:
            out[lo:hi] = part
        elif kind == 1:
            np.cumsum(part, axis=1, dtype=np.uint8, out=out[lo:hi])
        elif kind == 2:
            out[lo:hi] = np.cumsum(np.vstack([above, part]), axis=0, dtype=np.uint8)[1:]
        else:
            out[lo:hi] = _by_diagonals(kinds[lo:hi] == 4, part, above)
        above = out[hi - 1]
    return out


def _by_diagonals(paeth: np.ndarray, rows: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Mean and Paeth filters undone: pixels of one diagonal need only those of the two before it."""
    height, width = rows.shape
    whole = np.zeros((height + 1, width + 1), np.int16)
    whole[0, 1:] = above
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        x = d - y
        left, up = whole[y + 1, x], whole[y, x + 1]
        guess = np.where(paeth[y], _paeth(left, up, whole[y, x]), (left + up) >> 1)
        whole[y + 1, x + 1] = (rows[y, x] + guess) & 255
    return whole[1:, 1:].astype(np.uint8)


def encode_png(payload: bytes, level: int = 6) -> bytes:
    """``payload`` (a multiple of the width) as an 8-bit greyscale PNG.

    One row filter serves the image: of none, left and up, the one whose
    residuals are smallest in sum.
    """
    image = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    tried = [filter_rows(image, k) for k in (0, 1, 2)]
    kind = int(np.argmin([np.abs(x.view(np.int8).astype(np.int16)).sum() for x in tried]))
    lines = np.empty((len(image), WIDTH + 1), np.uint8)
    lines[:, 0] = kind
    lines[:, 1:] = tried[kind]
    packed = zlib.compress(lines.tobytes(), level)
    head = struct.pack(">IIBBBBB", WIDTH, len(image), 8, 0, 0, 0, 0)
    body = b"".join(_chunk(b"IDAT", packed[i : i + CHUNK]) for i in range(0, len(packed), CHUNK))
    return SIGNATURE + _chunk(b"IHDR", head) + body + _chunk(b"IEND", b"")


def decode_png(stored: bytes) -> np.ndarray:
    """The pixels of an 8-bit greyscale PNG; ValueError where a checksum or the structure is wrong."""
    if stored[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, size, parts, ended = 8, None, [], False
    while at + 12 <= len(stored):
        (n,) = struct.unpack_from(">I", stored, at)
        kind, body = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + n]
        if stored[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError(f"checksum of chunk {kind!r} at {at}")
        if kind == b"IHDR":
            if n != 13:
                raise ValueError("wrong header")
            width, height, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", body)
            if (depth, colour, laced) != (8, 0, 0) or not width or not height:
                raise ValueError("not 8-bit greyscale")
            size = (height, width)
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            ended = True
            break
        at += 12 + n
    if size is None or not ended:
        raise ValueError("a chunk is missing")
    wanted, packed = size[0] * (size[1] + 1), b"".join(parts)
    if wanted > DENSEST * len(packed):
        raise ValueError("more pixels than the file can hold")
    stream = zlib.decompressobj()
    try:  # no more is unpacked than the header says
        raw = stream.decompress(packed, wanted + 1)
    except zlib.error as e:
        raise ValueError(f"pixels can't be unpacked: {e}") from e
    if len(raw) != wanted:
        raise ValueError("wrong number of pixels")
    if not stream.eof or stream.unused_data:
        raise ValueError("the pixels don't end where their stream does")
    lines = np.frombuffer(raw, np.uint8).reshape(size[0], size[1] + 1)
    return unfilter(lines[:, 0], lines[:, 1:])


def _cosines(n: int) -> np.ndarray:
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    basis = np.cos(np.pi * (2 * x + 1) * k / (2 * n)) * np.sqrt(2 / n)
    basis[0] /= np.sqrt(2)
    return basis


_BASIS = _cosines(GRID)[:CORNER]


def cosine_hash(image: np.ndarray) -> str:
    """64 bits as hex: the low-frequency cosine coefficients of the block means, against their median.

    Some columns are repeated where their number is no multiple of the grid.
    """
    if image.shape[1] % GRID:
        image = image[:, np.arange(-(-image.shape[1] // GRID) * GRID) * image.shape[1] // (-(-image.shape[1] // GRID) * GRID)]
    rows = np.linspace(0, len(image), GRID + 1).astype(np.int64)
    low, high = np.minimum(rows[:-1], len(image) - 1), np.maximum(rows[1:], np.minimum(rows[:-1], len(image) - 1) + 1)
    sums = np.vstack([np.zeros((1, GRID), np.int64), np.cumsum(image.reshape(len(image), GRID, -1).sum(axis=2, dtype=np.int64), axis=0)])
    means = (sums[high] - sums[low]) / ((high - low)[:, None] * (image.shape[1] // GRID))
    low_freq = (_BASIS @ means @ _BASIS.T).ravel()
    bits = np.round(low_freq[1:], 6) > np.round(np.median(low_freq[1:]), 6)
    return np.packbits(np.concatenate([[False], bits])).tobytes().hex()


def store(df: DataFrame, id_col: str = "doc_id", content_col: str = "text", level: int = 6) -> DataFrame:
    """``df`` as rows (id, n_bytes, media): each content padded and stored as PNG."""
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def make():
        def work(ids, contents):
            contents = [x or b"" for x in contents]
            return {"id": ids, "n_bytes": [len(x) for x in contents], "media": [encode_png(pad(x), level) for x in contents]}

        return work

    return map_rows(df.select(F.col(id_col), F.col(content_col).cast("binary")), make, schema)


def _read(stored: bytes | None) -> tuple[bytes | None, str | None, str | None]:
    """(payload, feature, error) of a file."""
    if stored is None:
        return None, None, "no file"
    try:
        image = decode_png(stored)
    except ValueError as e:
        return None, None, str(e)
    return image.tobytes(), cosine_hash(image), None


def load(media: DataFrame) -> DataFrame:
    """Rows of ``store`` read back: (id, n_bytes, media_bytes, media_sha256, payload, feature, error).

    Null files have null in all but id, n_bytes and error, damaged ones in payload and feature.
    """
    kinds = (("n_bytes", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("payload", T.BinaryType()), ("feature", T.StringType()), ("error", T.StringType()))
    schema = T.StructType([T.StructField("id", media.schema["id"].dataType)] + [T.StructField(k, t) for k, t in kinds])

    def make():
        def work(ids, lengths, files):
            found = [_read(x) for x in files]
            return {
                "id": ids,
                "n_bytes": lengths,
                "media_bytes": [None if x is None else len(x) for x in files],
                "media_sha256": [None if x is None else hashlib.sha256(x).hexdigest() for x in files],
                **{k: [x[i] for x in found] for i, k in enumerate(("payload", "feature", "error"))},
            }

        return work

    return map_rows(media.select("id", "n_bytes", "media"), make, schema)


def op2_media(spark, sf_dir: str) -> DataFrame:
    """Every text of documents stored as PNG and read back, as digests."""
    back = load(store(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return back.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        "feature",
    )
