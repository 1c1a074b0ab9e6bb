import struct
import zlib

import numpy as np
import pytest

from leafmill.llm import media as M


def refilter(img, kinds):
    """Plain filters of the format, row by row and byte by byte."""
    h, w, per = img.shape
    rows = img.reshape(h, w * per).astype(int)
    out = b""
    for y in range(h):
        line = []
        for x in range(w * per):
            a = rows[y][x - per] if x >= per else 0
            b = rows[y - 1][x] if y else 0
            c = rows[y - 1][x - per] if y and x >= per else 0
            p = a + b - c
            paeth = min((a, b, c), key=lambda v: abs(p - v))
            line.append((rows[y][x] - [0, a, b, (a + b) // 2, paeth][kinds[y]]) % 256)
        out += bytes([kinds[y], *line])
    return out


@pytest.mark.parametrize("per", [1, 2, 3, 4])
def test_every_filter(per):
    r = np.random.default_rng(per)
    img = r.integers(0, 256, (12, 7, per), dtype=np.uint8)
    kinds = [0, 1, 1, 2, 2, 3, 4, 4, 3, 2, 0, 4]
    colour = {n: c for c, n in M.SAMPLES.items()}[per]
    z = zlib.compress(refilter(img, kinds))
    png = M.SIGNATURE + M._chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 12, 8, colour, 0, 0, 0)) + M._chunk(b"tEXt", b"k\0v")
    png += M._chunk(b"IDAT", z[:5]) + M._chunk(b"IDAT", z[5:]) + M._chunk(b"IEND", b"")
    assert (M.decode_png(png) == img).all()
    assert (M.decode_png(M.encode_png(img, idat=16)) == img).all()


def test_damage_is_found():
    png = M.encode_png(np.arange(192, dtype=np.uint8).reshape(1, 64, 3))
    for i in range(0, len(png), 3):
        bad = bytearray(png)
        bad[i] ^= 4
        with pytest.raises(ValueError):
            M.decode_png(bytes(bad))
    for n in (0, 7, 20, len(png) - 1):
        with pytest.raises(ValueError):
            M.decode_png(png[:n])
    with pytest.raises(ValueError):
        M.decode_png(png + b"x")
    with pytest.raises(ValueError):
        M.encode_png(np.zeros((0, 3, 3), np.uint8))


def test_cosines_against_sums():
    r = np.random.default_rng(0)
    g = r.integers(0, 256, (32, 32, 1)).astype(np.uint8)
    low = [[sum(float(g[y, x, 0]) * np.cos(np.pi * u * (2 * y + 1) / 64) * np.cos(np.pi * v * (2 * x + 1) / 64) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)]
    flat = np.round(np.array(low).ravel(), 6)
    assert M.cosine_hash(g) == np.packbits(flat > np.median(flat[1:])).tobytes()
    big = np.kron(g[:, :, 0], np.ones((3, 3), np.uint8))[:, :, None]
    assert M.cosine_hash(big) == M.cosine_hash(g)


def test_tables(spark):
    texts = [None, "", "x", "é" * 96, "é" * 97, "same", "same", "long " * 100000]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(None, "same", 0), (2, "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media int")
    written = M.write_media(docs)
    got = M.digests(M.read_media(written)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r)
    for i, t in enumerate(texts):
        data = (t or "").encode()
        pad = data + b" " * (max(1, -(-len(data) // 192)) * 192 - len(data))
        r = by[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(pad), M.sha256_hex(pad), zlib.crc32(pad[-16:]))
        png = M.encode_png(np.frombuffer(pad, np.uint8).reshape(-1, 64, 3))
        assert (r.media_bytes, r.media_sha256) == (len(png), M.sha256_hex(png)) and len(r.feature) == 16
    assert by[5][1:] == by[6][1:] == by[None][1:]
    assert M.digests(M.read_media(M.write_media(docs.limit(0)))).count() == 0
    assert M.read_media(written.selectExpr("doc_id", "n_bytes", "cast(null as binary) media")).filter("samples is null and feature is null").count() == len(rows)


def test_a_small_file_cannot_fill_the_memory(monkeypatch):
    """A file that unpacks to more than its header states is refused after one byte too many."""
    z = zlib.compress(bytes(50_000_000), 9)
    head = struct.pack(">IIBBBBB", 64, 1, 8, 2, 0, 0, 0)
    bomb = M.SIGNATURE + M._chunk(b"IHDR", head) + M._chunk(b"IDAT", z) + M._chunk(b"IEND", b"")
    seen = []
    real = zlib.decompressobj

    class Watch:
        def __init__(self):
            self.inner = real()

        def decompress(self, data, most):
            out = self.inner.decompress(data, most)
            seen.append(len(out))
            return out

        eof = property(lambda self: self.inner.eof)
        unused_data = property(lambda self: self.inner.unused_data)

    monkeypatch.setattr(M.zlib, "decompressobj", Watch)
    with pytest.raises(ValueError):
        M.decode_png(bomb)
    assert seen == [194]


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "abc", 5)], "doc_id long, text string, samples int")
    files = M.write_media(docs).join(docs.select("doc_id", "samples"), "doc_id")
    got = M.read_media(files, keep=("doc_id", "n_bytes", "samples", "media"))
    assert got.columns == ["doc_id", "n_bytes", "samples", "media", "samples_1", "feature"]
    r = got.first()
    assert r.samples == 5 and bytes(r.samples_1) == b"abc" + b" " * 189
