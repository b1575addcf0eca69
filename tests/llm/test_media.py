"""Images that are odd, broken or very long; the query's stored form and feature against plain Python."""

import hashlib
import io
import resource
import struct

import numpy as np
import pytest

from recordloom.llm import media_tiles as m
from recordloom.llm import queries
from tests.llm.test_queries import DATA, db, texts  # noqa: F401


def palette_bmp(values, used):
    raw = bytearray(m.bmp(np.array([values], np.uint8)))
    struct.pack_into("<I", raw, 46, used)
    return bytes(raw)


BROKEN = [
    palette_bmp([1, 200], 16), b"P5 0 0 255\n", b"P5 3 0 255\n", b"P2 1 1 9\n10 ", b"P2 1 1 9\n-1 ", b"P2 1 1 9\nx ", b"P5 1 1 9\n\x0a", b"P6 999999999 999999999 255\n", b"BM" + b"\0" * 60,
    m.bmp(np.zeros((2, 2), np.uint8))[:60], b"P5", b"\xff" * 99,
]


@pytest.mark.parametrize("raw", BROKEN)
def test_broken_images_are_value_errors(raw):
    with pytest.raises(ValueError):
        m.decode(raw)


def test_smaller_maxima_are_scaled():
    assert m.decode(b"P2 4 1 3\n0 1 2 3 ").tolist() == [[0, 85, 170, 255]]
    assert m.decode(b"P5 2 1 15\n\x00\x0f").tolist() == [[0, 255]]


def test_broken_images_have_null_features(spark):
    rows = [(i, 0, bytearray(x)) for i, x in enumerate(BROKEN)] + [(99, 1, bytearray(m.netpbm(np.arange(576, dtype=np.uint8).reshape(24, 24)))), (98, 1, None)]
    out = {r["doc_id"]: r for r in m.features(m.store(spark.createDataFrame(rows, "doc_id string, n_bytes bigint, image binary"))).collect()}
    assert len(out) == len(rows) and out["99"]["feature"] is not None
    assert all(r["feature"] is None and r["payload"] is None for i, r in out.items() if i != "99")


def plain_resize(x, height, width):
    """By the integral image of all samples, a sample at a time."""
    full = np.zeros((x.shape[0] + 1, x.shape[1] + 1))
    full[1:, 1:] = x.astype(np.int64).cumsum(0).cumsum(1)

    def at(r, c):
        i, j = min(int(r), x.shape[0] - 1), min(int(c), x.shape[1] - 1)
        a, b = r - i, c - j
        return (full[i, j] * (1 - a) + full[i + 1, j] * a) * (1 - b) + (full[i, j + 1] * (1 - a) + full[i + 1, j + 1] * a) * b

    rs, cs = np.linspace(0, x.shape[0], height + 1), np.linspace(0, x.shape[1], width + 1)
    return np.array([[at(rs[i + 1], cs[j + 1]) - at(rs[i], cs[j + 1]) - at(rs[i + 1], cs[j]) + at(rs[i], cs[j]) for j in range(width)] for i in range(height)]) / (x.size / (height * width))


@pytest.mark.parametrize("shape", [(1, 1), (24, 24), (7, 5), (240, 24), (3, 100)])
def test_resize_against_the_whole_integral_image(shape):
    x = np.random.default_rng(3).integers(0, 256, shape).astype(np.uint8)
    assert m.resize_area(x, 8, 9) == pytest.approx(plain_resize(x, 8, 9))


def test_a_long_image_takes_little_room():
    x = np.zeros((2_000_000, 24), np.uint8)  # 48 MB
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    m.dhash(x)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000  # KB


def test_the_query_s_stored_form_and_feature(spark, texts):  # noqa: F811
    got = {r["doc_id"]: r for r in queries.QUERIES["op9_media_tiles"](spark, str(DATA)).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        raw = text.encode()
        x = np.frombuffer(raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff"), np.uint8).reshape(-1, 24)
        out = io.BytesIO()
        np.save(out, x.reshape(-1, 24, 24))
        small = np.floor(plain_resize(x, 8, 9) * 10 + 0.5)
        bits = "".join("1" if a < b else "0" for row in small for a, b in zip(row, row[1:], strict=False))
        assert (got[i]["media_bytes"], got[i]["media_sha256"], got[i]["feature"]) == (len(out.getvalue()), hashlib.sha256(out.getvalue()).hexdigest(), f"{int(bits, 2):016x}")
