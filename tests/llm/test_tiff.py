import random
import struct

import numpy as np
import pytest

from quire.llm import tiff


def _texts():
    rng = random.Random(3)
    yield b""
    yield b"a" * 1000
    for n in (1, 63, 64, 65, 4096, 50_000):
        yield bytes(rng.choice(b"abc  ") for _ in range(n))
        yield bytes(rng.randrange(256) for _ in range(n))


@pytest.mark.parametrize("coded", [(tiff.packbits, tiff.unpackbits), (tiff.lzw, tiff.unlzw)])
def test_codecs_round_trip(coded):
    for raw in _texts():
        assert coded[1](coded[0](raw), len(raw)) == raw


def test_lzw_known_codes():
    # the example of the TIFF 6.0 specification, section 13: 7 7 7 8 8 7 7 6 6
    raw = bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    want = bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))
    assert tiff.lzw(raw) == want
    assert tiff.unlzw(want, len(raw)) == raw


@pytest.mark.parametrize("codec", [tiff.NONE, tiff.LZW, tiff.PACKBITS, tiff.DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tiles", [False, True])
def test_pages_round_trip(codec, predictor, tiles):
    for raw in _texts():
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        pages = tiff.read_tiff(tiff.write_tiff(payload, codec, predictor, tiles, page_rows=100))
        assert b"".join(p.data for p in pages) == payload
        assert len(pages) == -(-len(payload) // 6400)


def test_big_endian_16_bit_colour():
    data = (np.arange(2 * 3 * 3).reshape(2, 3, 3) * 300).astype(">u2")
    diff = data.copy()
    diff[:, 1:] -= data[:, :-1]
    tags = [(256, 3, 3), (257, 3, 2), (258, 3, 16), (259, 3, 1), (273, 4, 8), (277, 3, 3), (278, 3, 2), (279, 4, 36), (317, 3, 2)]
    body = diff.tobytes()
    file = b"MM\0*" + struct.pack(">I", 8 + len(body)) + body + struct.pack(">H", len(tags))
    for tag, kind, value in tags:
        file += struct.pack(">HHI", tag, kind, 1) + (struct.pack(">HH", value, 0) if kind == 3 else struct.pack(">I", value))
    (page,) = tiff.read_tiff(file + b"\0\0\0\0")
    assert (page.width, page.height, page.samples, page.bits) == (3, 2, 3, 16)
    assert np.array_equal(np.frombuffer(page.data, np.uint16).reshape(2, 3, 3), data.astype(np.uint16))


def test_broken_files():
    good = tiff.write_tiff(b"x" * 640, tiff.DEFLATE)
    for bad in (b"", b"PK\3\4", good[:20], good[:-30]):
        with pytest.raises(ValueError):
            tiff.read_tiff(bad)


def _tagged(**other):
    """A file of one grey page of 4 x 2 samples, with other values of some tags (None leaves a tag out)."""
    tags = {256: 4, 257: 2, 258: 8, 259: 1, 273: 8, 277: 1, 278: 1, 279: 4} | {int(k[1:]): v for k, v in other.items()}
    body = b"12345678"
    tags = {k: v for k, v in tags.items() if v is not None}
    return b"II*\0" + struct.pack("<I", 16) + body + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", k, 4, 1, v) for k, v in sorted(tags.items())) + b"\0\0\0\0"


def test_files_without_samples_or_strips():
    for bad in ({"t256": 0}, {"t257": 0}, {"t277": 0}, {"t278": 0}, {"t273": None}, {}):  # of two strips, one is told
        with pytest.raises(ValueError):
            tiff.read_tiff(_tagged(**bad))
    assert tiff.read_tiff(_tagged(t278=2, t279=8))[0].data == b"12345678"


def test_a_broken_file_stops_nothing(spark):
    rows = [(1, tiff.write_tiff(b"x" * 64, tiff.LZW)), (2, b"PK"), (3, None), (4, b"")]
    files = spark.createDataFrame(rows, "doc_id long, media binary")
    out = {r["doc_id"]: r for r in tiff.with_pages(files).collect()}
    assert len(out[1]["pages"]) == 1 and out[1]["fault"] is None and out[3]["fault"] is None
    assert all(out[i]["pages"] == [] and out[i]["fault"] for i in (2, 4))
    assert [r["doc_id"] for r in tiff.tiff_pages(files).collect()] == [1]


def test_each_codec_serves_a_third():
    rng = random.Random(1)
    seen = [tiff.read_tiff(tiff.store(bytes(rng.randrange(97, 100) for _ in range(64))))[0].compression for _ in range(300)]
    assert all(seen.count(c) > 70 for c in (tiff.LZW, tiff.PACKBITS, tiff.DEFLATE))
