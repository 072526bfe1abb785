import hashlib
import zlib

import numpy as np
import pytest

from tessera.llm import jpeg
from tessera.llm.media import UNIT, decode_images, encode_texts, read_back
from tests.llm.fixtures import empty, frame, rows


def test_texts_come_back_whole(spark):
    got = read_back(encode_texts(frame(spark))).collect()
    want = []
    for d, t, *_ in rows():
        raw = (t or "").encode()
        p = raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT)
        want.append((d, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)
    media = {r.doc_id: r.media for r in encode_texts(frame(spark)).filter("doc_id is not null").collect()}
    for r in got:
        if r.doc_id is not None:
            assert (r.media_bytes, r.media_sha256) == (len(media[r.doc_id]), hashlib.sha256(media[r.doc_id]).hexdigest())


def test_empty_table(spark):
    assert read_back(encode_texts(empty(spark))).collect() == []


def test_unreadable_images_have_a_message(spark):
    good = jpeg.encode(b"\x80" * 384)
    data = [(1, bytearray(good), 5), (2, bytearray(b"nonsense"), 5), (3, None, 5), (4, bytearray(good[:200]), 5)]
    out = {r.k: r for r in decode_images(spark.createDataFrame(data, "k int, media binary, width int")).collect()}
    assert (out[1].width, out[1].height, len(out[1].rgb), out[1].error) == (16, 16, 768, None)
    assert out[2].rgb is None and "not a JPEG" in out[2].error
    assert out[3].rgb is None and out[3].error is None


class Writer:
    """A plain bit writer, and scans as the standard writes them, for files that the encoder here never makes."""

    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        self.bits += format(value, f"0{n}b") if n else ""

    def number(self, v):
        n = abs(v).bit_length()
        self.put(v if v > 0 else v + (1 << n) - 1, n)

    def done(self):
        bits = self.bits + "1" * (-len(self.bits) % 8)
        return int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00") if bits else b""


def flat_table(kind, symbols):
    """Eight-bit codes in order."""
    return jpeg._segment(0xC4, bytes([kind]) + bytes([0] * 7 + [len(symbols)] + [0] * 8) + bytes(symbols))


def general_file(coef, wide, high):
    """One component: spectral selection with zero runs and block runs, then one more bit by refinement with new coefficients."""
    symbols = sorted({(r << 4) | s for r in range(16) for s in range(11)})
    code = {s: i for i, s in enumerate(symbols)}
    out = [b"\xff\xd8", jpeg._segment(0xDB, b"\x00" + b"\x01" * 64), flat_table(0x00, range(12)), flat_table(0x10, symbols)]
    out.append(jpeg._segment(0xC2, bytes([8]) + (8 * high).to_bytes(2, "big") + (8 * wide).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])))
    w, last = Writer(), 0
    for b in coef:
        d = (b[0] >> 1) - last
        last = b[0] >> 1
        w.put(abs(d).bit_length(), 8)
        w.number(d)
    out.append(jpeg._segment(0xDA, bytes([1, 1, 0, 0, 0, 0x01])) + w.done())
    w = Writer()
    half = [[int(np.sign(v)) * (abs(v) >> 1) for v in b] for b in coef]
    waiting = 0

    def flush():
        nonlocal waiting
        if waiting:
            n = waiting.bit_length() - 1
            w.put(code[n << 4], 8)
            w.put(waiting - (1 << n), n)
            waiting = 0

    for b in half:
        run = 0
        k = 1
        nonzero = [i for i in range(1, 64) if b[i]]
        if nonzero:
            flush()
        for i in nonzero:
            run = i - k
            while run > 15:
                w.put(code[0xF0], 8)
                run -= 16
            w.put(code[run << 4 | abs(b[i]).bit_length()], 8)
            w.number(b[i])
            k = i + 1
        if k < 64:
            waiting += 1
    flush()
    out.append(jpeg._segment(0xDA, bytes([1, 1, 0, 1, 63, 0x01])) + w.done())
    w = Writer()
    for b in coef:
        w.put(b[0] & 1, 1)
    out.append(jpeg._segment(0xDA, bytes([1, 1, 0, 0, 0, 0x10])) + w.done())
    w = Writer()
    for b in coef:  # new coefficients are those of magnitude one
        pending, zeros, k = [], 0, 1
        new = [i for i in range(1, 64) if abs(b[i]) == 1]
        for i in range(1, 64):
            if abs(b[i]) > 1:
                pending.append(abs(b[i]) & 1)
            elif i in new:
                w.put(code[zeros << 4 | 1], 8)
                w.put(1 if b[i] > 0 else 0, 1)
                for bit in pending:
                    w.put(bit, 1)
                pending, zeros, k = [], 0, i + 1
            else:
                zeros += 1
                if zeros == 16 and any(j > i for j in new):
                    w.put(code[0xF0], 8)
                    for bit in pending:
                        w.put(bit, 1)
                    pending, zeros, k = [], 0, i + 1
        if k < 64:
            w.put(code[0x00], 8)
            for bit in pending:
                w.put(bit, 1)
    out.append(jpeg._segment(0xDA, bytes([1, 1, 0, 1, 63, 0x10])) + w.done())
    return b"".join([*out, b"\xff\xd9"])


@pytest.mark.parametrize("seed", range(4))
def test_general_progressive_files(seed):
    r = np.random.default_rng(seed)
    coef = np.where(r.random((12, 64)) < (0.02, 0.1, 0.4, 0.9)[seed], r.integers(-60, 61, (12, 64)), 0)
    coef[3, 1:] = 0
    coef[4, 1:] = 0
    image = jpeg.decode(general_file(coef.tolist(), 4, 3))
    assert np.array_equal(image.components[0].coef, coef)
    n = np.arange(8)
    basis = np.cos((2 * n[:, None] + 1) * n * np.pi / 16) / 2
    basis[:, 0] /= np.sqrt(2)
    natural = np.zeros((12, 64))
    natural[:, jpeg.ZIGZAG] = coef
    plain = np.array([basis @ b.reshape(8, 8) @ basis.T for b in natural]) + 128
    assert np.allclose(jpeg.plane(image, image.components[0])[:8, :8], plain[0], atol=1e-2)
    assert jpeg.rgb(image).shape == (24, 32, 3)


def test_chroma_is_widened():
    image = jpeg.decode(jpeg.encode(bytes(np.random.default_rng(1).integers(0, 256, 64 * 12, dtype=np.uint8))))
    assert [(c.wide, c.high) for c in image.components] == [(2, 4), (1, 2), (1, 2)]
    assert jpeg.rgb(image).shape == (32, 16, 3)
