"""Byte payloads kept as lossless WebP images, and pixel features read back."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from granary.llm import common, webp

UNIT = 64
#: Bits that a transform's own image takes.
TABLE = 120
#: Share of bytes that a neighbour repeats, or of a channel's variance that green tells, from which on a transform is tried.
PROMISE = 0.2
#: Pixels of the largest image that is decoded from a file of unknown origin.
LARGEST = 1 << 26
SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def estimated(image: np.ndarray) -> float:
    """Bits that the four channels of an image take by themselves."""
    own = image.ravel().view(np.uint8).reshape(-1, 4) + np.array([0, 256, 512, 768], np.int64)
    counts = np.bincount(own.ravel(), minlength=1024)
    counts = counts[counts > 0]
    return 4 * image.size * np.log2(image.size) - float((counts * np.log2(counts)).sum())


def _cross(pixels: np.ndarray) -> tuple[int, int, int]:
    """How much of red and of blue green tells, in 32nds, as the format has it; 0 where that is a small part of the variance."""
    c = pixels.reshape(-1, 4).view(np.int8).astype(np.float32)
    mean = np.ones(len(c), np.float32) @ c / len(c)
    both = (c.T @ c - len(c) * np.outer(mean, mean)).tolist()  # red, green, blue, alpha
    green, out = both[1][1], []
    for k in (0, 2):
        xy = both[1][k]
        out.append(max(-128, min(127, round(32 * xy / green))) if green > 0 and xy * xy > PROMISE * green * both[k][k] else 0)
    return (*out, 0)


def transforms(pixels: np.ndarray) -> dict:
    """The predictor (the left or the upper pixel) and the cross-colour factors that promise anything and make the estimate less."""
    flat = pixels.ravel()
    image, out, best = None, {}, None
    for mode, back in ((1, 4), (2, UNIT)):
        if np.count_nonzero(flat[back:] == flat[:-back]) > PROMISE * flat.size:
            image = webp._packed(pixels[..., [2, 1, 0, 3]])
            best = estimated(image) if best is None else best
            rest = webp.residuals(image, mode)
            if (bits := estimated(rest) + TABLE) < best:
                best, out["predictor"], kept = bits, mode, rest
    cross = _cross(webp._channels(kept)[..., [2, 1, 0, 3]] if "predictor" in out else pixels)
    if any(cross):
        image = kept if "predictor" in out else webp._packed(pixels[..., [2, 1, 0, 3]])
        best = estimated(image) if best is None else best
        table = np.full((webp._blocks(image.shape[0], 9), 1), (cross[0] & 255) | (cross[1] & 255) << 8, np.uint32)
        if estimated(webp.cross_colour(image, table, 9, False)) + TABLE < best:
            out["cross"] = cross
    return out


def image(payload: bytes) -> bytes:
    """A lossless WebP file of bytes, whose number is a multiple of 64. How it is stored follows from the bytes alone.

    A row is 64 bytes: 16 pixels of four (red, green, blue, alpha) if most pixels then occur again or a transform
    pays, with a palette for up to 256 colours, else a colour cache; otherwise 64 pixels whose green is the byte,
    with a palette for up to 16 values, which then share bytes.
    """
    four = np.frombuffer(payload, np.uint8).reshape(-1, UNIT // 4, 4)
    ordered = np.sort(four.view("<u4"), axis=None)
    colours = 1 + int(np.count_nonzero(ordered[1:] != ordered[:-1]))
    again = 2 * colours <= ordered.size
    if again and colours <= 256:
        return webp.encode(four, 0, palette=True)
    pays = transforms(four)
    if again or pays:
        return webp.encode(four, int(np.clip(np.log2(ordered.size) - 3, 1, 10)), bits=9, **pays)
    green = four.reshape(-1, UNIT)
    one = np.zeros((*green.shape, 4), np.uint8)
    one[..., 1] = green
    one[..., 3] = 255
    return webp.encode(one, 0, palette=np.count_nonzero(np.bincount(green.ravel())) <= 16, shortest=8)


def store(data: bytes) -> bytes:
    """data, padded with zeros to a positive multiple of 64, as lossless WebP files one after another.

    An image has 16,384 rows of 64 bytes at most; what goes beyond is the next file.
    """
    payload = data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b"\0")
    return b"".join(image(payload[i : i + UNIT * webp.MOST]) for i in range(0, len(payload), UNIT * webp.MOST))


def load(media: bytes) -> tuple[list[np.ndarray], bytes]:
    """The pixels of stored files, and the payload that they make: all bytes of 16 pixels a row, the green ones of 64."""
    out, at = [], 0
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        out.append(webp.decode(media[at : at + size]))
        at += size
    return out, b"".join((p if p.shape[1] < UNIT else p[..., 1]).tobytes() for p in out)


def feature(pixels: np.ndarray) -> str:
    """Size, sums of red, green, blue and alpha, and how many byte values occur."""
    sums = pixels.reshape(-1, 4).sum(0, dtype=np.int64)
    kinds = int(np.count_nonzero(np.bincount(pixels.ravel(), minlength=256)))
    return f"{pixels.shape[1]}x{pixels.shape[0]}:{','.join(map(str, sums.tolist()))}:{kinds}"


def digest(text: str | None) -> tuple:
    data = (text or "").encode("utf-8", "surrogatepass")
    media = store(data)
    pixels, payload = load(media)
    return (
        len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]),
        len(media), hashlib.sha256(media).hexdigest(), ";".join(map(feature, pixels)),
    )


def media_digests(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the digest columns of its texts stored as WebP and read back.

    The columns are those of SCHEMA; columns of df with these names are
    replaced, all others stay. A null text counts as empty: 64 zero bytes. A
    long text takes several images, of a mebibyte each but the last.
    Rows are independent and stay where they lie, so repeated rows and ties
    need no rule; an empty table gives an empty one.
    """
    common.prepare(df.sparkSession)
    fields = pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in SCHEMA.split(", ")])
    df = df.drop(*fields.names)
    at = df.columns.index(text)

    def run(batches):
        for batch in batches:
            rows = [digest(batch.column(at)[i].as_py()) for i in range(batch.num_rows)]
            own = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=[f"c{i}" for i in range(batch.num_columns + len(own))])

    return common.map_arrow(df, run, SCHEMA)


def pixel_arrays(df: DataFrame, media: str = "media", largest: int = LARGEST) -> DataFrame:
    """df with width, height and pixels (RGBA bytes, row by row) of lossless WebP files in a binary column.

    Null files, bytes that aren't a lossless WebP file, and images of more than `largest` pixels (a few bytes can claim 2 ** 28) give nulls.
    Columns of df with these names are replaced, all others stay.
    """
    common.prepare(df.sparkSession)
    df = df.drop("width", "height", "pixels")
    at = df.columns.index(media)

    def one(data):
        try:
            p = webp.decode(bytes(data), largest) if data is not None else None
        except webp.Corrupt:
            p = None
        return (None, None, None) if p is None else (p.shape[1], p.shape[0], p.tobytes())

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # one image at a time: pixels may be large
                w, h, p = one(batch.column(at)[i].as_py())
                own = [pa.array([w], pa.int32()), pa.array([h], pa.int32()), pa.array([p], pa.binary())]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, *own], names=[f"c{j}" for j in range(batch.num_columns + 3)])

    return common.map_arrow(df, run, "width int, height int, pixels binary")
