"""Media columns: 8-bit images as PNG bytes in binary columns, and cosine-transform hashes of them.

Writing: rows of samples are filtered (none, sub or up, whichever leaves the least), compressed with zlib and wrapped in chunks
with CRCs.  Reading tests signature, chunk order, CRCs, the zlib checksum and the sizes, then undoes all five row filters in
numpy.  The hash takes the low frequencies of a two-dimensional cosine transform of the grey image shrunk to 32 x 32.

Defined results: a null text is empty; an empty payload is one row of blanks; damaged bytes raise ``ValueError``; equal bytes
give equal images, files and hashes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from leafmill.llm.rows import free_names

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples per pixel by the format's colour type; palettes (3) are not 8-bit samples.
SAMPLES = {0: 1, 2: 3, 4: 2, 6: 4}
#: Bytes of one image row: 64 pixels of three samples.
ROW = 192
#: Largest width and height that the format can state.
MOST = 2**31 - 1


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(samples: np.ndarray, level: int = 6, idat: int = 1 << 20) -> bytes:
    """samples: uint8 (height, width, 1 to 4 samples)."""
    height, width, per = samples.shape
    colour = {n: c for c, n in SAMPLES.items()}[per]
    if not 0 < height <= MOST or not 0 < width <= MOST:
        raise ValueError("an image needs 1 to 2**31 - 1 rows and columns")
    rows = np.ascontiguousarray(samples).reshape(height, width * per)
    packer, parts, step = zlib.compressobj(level), [], max(1, (1 << 22) // rows.shape[1])
    for lo in range(0, height, step):
        part = rows[lo : lo + step]
        above = np.vstack([rows[lo - 1 : lo] if lo else np.zeros_like(rows[:1]), part[:-1]])
        sub = part.copy()
        sub[:, per:] -= part[:, :-per]
        ways = [part, sub, part - above]
        cost = np.stack([np.abs(w.view(np.int8).astype(np.int16)).sum(axis=1) for w in ways])
        best = cost.argmin(axis=0)
        out = np.empty((len(part), rows.shape[1] + 1), np.uint8)
        out[:, 0] = best
        for k, w in enumerate(ways):
            out[best == k, 1:] = w[best == k]
        parts.append(packer.compress(out.tobytes()))
    body = b"".join(parts) + packer.flush()
    head = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    data = b"".join(_chunk(b"IDAT", body[i : i + idat]) for i in range(0, len(body), idat))
    return SIGNATURE + _chunk(b"IHDR", head) + data + _chunk(b"IEND", b"")


def _chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    if png[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at = 8
    while at < len(png):
        if at + 12 > len(png):
            raise ValueError("a chunk is cut off")
        n = struct.unpack_from(">I", png, at)[0]
        kind, data, crc = png[at + 4 : at + 8], png[at + 8 : at + 8 + n], png[at + 8 + n : at + 12 + n]
        if len(crc) < 4 or zlib.crc32(kind + data) != struct.unpack(">I", crc)[0]:
            raise ValueError(f"checksum of chunk {kind!r} is wrong")
        yield kind, data
        at += 12 + n
        if kind == b"IEND":
            if at != len(png):
                raise ValueError("bytes after the end chunk")
            return
    raise ValueError("no end chunk")


def decode_png(png: bytes) -> np.ndarray:
    """uint8 (height, width, samples) of an 8-bit image without palette or interlacing."""
    head, body = b"", []
    for i, (kind, data) in enumerate(_chunks(png)):
        if (kind == b"IHDR") != (i == 0):
            raise ValueError("the header chunk must come first, once")
        if kind == b"IHDR":
            head = data
        elif kind == b"IDAT":
            body.append(data)
        elif kind != b"IEND" and not kind[0] & 32:
            raise ValueError(f"unknown critical chunk {kind!r}")
    if len(head) != 13:
        raise ValueError("the header has a wrong length")
    width, height, depth, colour, packing, filtering, interlace = struct.unpack(">IIBBBBB", head)
    if depth != 8 or colour not in SAMPLES or packing or filtering or interlace or not width or not height:
        raise ValueError("only 8-bit images without palette or interlacing")
    per = SAMPLES[colour]
    size, unpacker = height * (width * per + 1), zlib.decompressobj()
    try:  # never more than the header states: a small file cannot fill the memory
        raw = unpacker.decompress(b"".join(body), size + 1)
    except zlib.error as e:
        raise ValueError(f"compressed data: {e}") from e
    if len(raw) != size:
        raise ValueError("the data do not fill the image")
    if not unpacker.eof or unpacker.unused_data:
        raise ValueError("compressed data: cut off, or followed by others")
    lines = np.frombuffer(raw, np.uint8).reshape(height, width * per + 1)
    return unfilter(lines[:, 0], lines[:, 1:], per).reshape(height, width, per)


def unfilter(kinds: np.ndarray, lines: np.ndarray, per: int) -> np.ndarray:
    """Undo the row filters: runs of rows with the same filter at once where rows do not depend on each other."""
    if len(kinds) and kinds.max() > 4:
        raise ValueError("unknown row filter")
    out = lines.copy()
    n, width = out.shape
    starts = np.concatenate(([0], np.flatnonzero(np.diff(kinds)) + 1, [n]))
    zero = np.zeros(width, np.uint8)
    for a, b in zip(starts, starts[1:], strict=False):
        kind, above = (int(kinds[a]) if a < n else 0), out[a - 1] if a else zero
        if kind == 1:
            part = out[a:b].reshape(b - a, -1, per)
            np.add.accumulate(part, axis=1, out=part, dtype=np.uint8)
        elif kind == 2:
            out[a] += above
            np.add.accumulate(out[a:b], axis=0, out=out[a:b], dtype=np.uint8)
        elif kind in (3, 4):
            for y in range(a, b):
                _sequential(out[y], out[y - 1] if y else zero, per, kind)
    return out


def _sequential(line: np.ndarray, above: np.ndarray, per: int, kind: int) -> None:
    """Average and Paeth rows: each pixel needs the one before."""
    cur, up = line.reshape(-1, per), above.reshape(-1, per).astype(np.int16)
    left = corner = np.zeros(per, np.int16)
    for x in range(len(cur)):
        if kind == 3:
            guess = (left + up[x]) // 2
        else:
            p = left + up[x] - corner
            da, db, dc = abs(p - left), abs(p - up[x]), abs(p - corner)
            guess = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, up[x], corner))
        cur[x] += guess.astype(np.uint8)
        left, corner = cur[x].astype(np.int16), up[x]


def _shrink(grey: np.ndarray, side: int) -> np.ndarray:
    """Means over a side x side grid; an axis shorter than the grid repeats its samples."""
    for axis in (0, 1):
        n = grey.shape[axis]
        if n < side:
            grey = np.take(grey, np.arange(side) * n // side, axis=axis)
        else:
            at = np.arange(side) * n // side
            sums = np.add.reduceat(grey, at, axis=axis)
            size = np.diff(np.append(at, n))
            grey = sums / (size[:, None] if axis == 0 else size[None, :])
    return grey


def _cosines(side: int, keep: int) -> np.ndarray:
    k, x = np.arange(keep)[:, None], np.arange(side)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * side))


_LOW = _cosines(32, 8)


def cosine_hash(image: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest frequencies lie above their median (the constant term left out of the median)."""
    grey = _shrink(image.mean(axis=2, dtype=np.float64), 32)
    low = np.round(_LOW @ grey @ _LOW.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def payload_of(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, the text padded with blanks to a positive multiple of a row)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + b" " * (max(1, -(-len(data) // ROW)) * ROW - len(data))


def write_media(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", level: int = 6) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as the samples of a PNG, 64 pixels of three samples a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, files = [], []
            for t in b.column(1):
                n, data = payload_of(t.as_py())
                sizes.append(n)
                files.append(encode_png(np.frombuffer(data, np.uint8).reshape(-1, ROW // 3, 3), level))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = dict(docs.dtypes)[doc_id]
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def read_media(table: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """The kept columns, the file, ``samples`` read back from it, and ``feature`` (the 8-byte hash); null files give nulls.

    Of a kept column and an added one of the same name, the added one gets a number behind its name.
    """
    keep = tuple(k for k in keep if k.lower() != media.lower())
    names = [*keep, media, *free_names([*keep, media], "samples", "feature")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, feature = [], []
            for f in b.column(len(keep)):
                image = None if f.as_py() is None else decode_png(f.as_py())
                data.append(None if image is None else image.tobytes())
                feature.append(None if image is None else cosine_hash(image))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(data, pa.binary()), pa.array(feature, pa.binary())], names)

    schema = StructType([table.schema[k] for k in keep])
    for n in names[len(keep) :]:
        schema = schema.add(n, BinaryType())
    return table.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{media}`")).mapInArrow(run, schema)


def digests(table: DataFrame) -> DataFrame:
    """What read_media gives, as sizes and digests: payload, its last 16 bytes, the stored file and the hash."""
    tail = F.substring("samples", -16, 16)
    return table.select(
        "doc_id",
        "n_bytes",
        F.length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.lower(F.hex("feature")).alias("feature"),
    )


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
