import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parlance.llm import tiff

IMAGES = [
    (np.arange(100 * 37) % 251).reshape(100, 37).astype(np.uint8),
    np.random.default_rng(0).integers(0, 65536, (50, 33, 3), dtype=np.uint16),
    np.full((1, 1), 7, np.uint8),
    np.repeat(np.arange(40, dtype=np.uint8), 50).reshape(20, 100),
]


@pytest.mark.parametrize("compression", list(tiff.ENCODERS))
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("order", ["<", ">"])
def test_round_trip(compression, predictor, tile, order):
    read = list(tiff.pages(tiff.encode(IMAGES, compression, predictor, 16, tile, order)))
    assert len(read) == len(IMAGES)
    for image, page in zip(IMAGES, read):
        assert np.array_equal(page.pixels, image if image.ndim == 3 else image[:, :, None])
        assert page.tiled == (tile is not None) and page.compression == compression


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400) | st.lists(st.integers(0, 3), max_size=9000).map(bytes))
def test_codecs(data):
    assert tiff.unpack_bits(tiff.pack_bits(data), len(data)) == data
    assert tiff.unlzw(tiff.lzw(data), len(data)) == data


def test_long_lzw_data_uses_all_widths():
    data = np.random.default_rng(1).integers(0, 256, 60000, dtype=np.uint8).tobytes()
    assert tiff.unlzw(tiff.lzw(data), len(data)) == data


def test_broken_files(spark):
    good = tiff.encode(IMAGES[:1])
    circle = bytearray(good)
    circle[-4:] = circle[4:8]
    rows = [(1, good), (2, b"no image"), (3, None), (4, b""), (5, good[:200]), (6, bytes(circle)), (1, good)]
    out = tiff.explode_pages(spark.createDataFrame([(*r, 9) for r in rows], "id int, media binary, page int"), "id", "media").collect()
    by = {k: [r for r in out if r.id == k] for k in range(1, 7)}
    assert len(by[1]) == 2 and by[1][0] == by[1][1] and by[1][0].error is None
    assert [r.error is not None for r in by[2]] == [True] and not by[3] and not by[4]
    assert by[5][-1].error and [r.error is None for r in by[6]] == [True, False]


def test_texts_are_kept_whole(spark):
    texts = ["", None, "a", "é" * 288, "x" * 576, "x" * 577, "long " * 300_000, "a"]
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, page int")
    out = {r.doc_id: r for r in tiff.digests(tiff.explode_pages(tiff.store_texts(docs), "key", "media")).collect()}
    for i, text in enumerate(texts):
        data = (text or "").encode()
        padded = data + b"\xff" * ((-len(data) % 576) if data else 576)
        r = out[i]
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-32:])
    assert (out[2].media_sha256, out[2].feature) == (out[7].media_sha256, out[7].feature)
    assert tiff.digests(tiff.explode_pages(tiff.store_texts(docs.limit(0)), "key", "media")).collect() == []


def test_unknown_fields_are_skipped():
    data = bytearray(tiff.encode(IMAGES[:1]))
    (at,) = struct.unpack_from("<I", data, 4)
    n = struct.unpack_from("<H", data, at)[0]
    rest = bytes(data[at + 2 : at + 2 + 12 * n])
    data[at:] = struct.pack("<H", n + 1) + rest + struct.pack("<HHII", 700, 13, 1, 0) + bytes(4)
    assert np.array_equal(next(tiff.pages(bytes(data))).pixels[:, :, 0], IMAGES[0])
