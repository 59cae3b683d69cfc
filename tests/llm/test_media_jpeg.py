import hashlib
import random
import zlib

import numpy as np
import pytest

from cantle.llm import media_jpeg as mj


class _Bits:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def bytes(self):
        b = self.bits + [1] * (-len(self.bits) % 8)
        return np.packbits(np.array(b, np.uint8)).tobytes()


# a flat code: each symbol in use gets eight bits
SYMBOLS = sorted({r << 4 | s for r in range(16) for s in range(11)} | {r << 4 for r in range(15)} | {0xF0})
CODE = {s: i for i, s in enumerate(SYMBOLS)}
TABLE = mj._segment(0xC4, bytes([0x10, *([0] * 7), len(SYMBOLS), *([0] * 8), *SYMBOLS]))


def _flush(out, run, bits):
    if run:
        n = run.bit_length() - 1
        out.put(CODE[n << 4], 8)
        out.put(run - (1 << n), n)
        out.bits += bits


def _encode_first(blocks, low, high, al):
    out, run = _Bits(), 0
    for b in blocks:
        zeros = 0
        for k in range(low, high + 1):
            v = abs(int(b[k])) >> al
            if not v:
                zeros += 1
                continue
            _flush(out, run, [])
            run = 0
            while zeros > 15:
                out.put(CODE[0xF0], 8)
                zeros -= 16
            n = v.bit_length()
            out.put(CODE[zeros << 4 | n], 8)
            out.put(v if b[k] > 0 else v ^ ((1 << n) - 1), n)
            zeros = 0
        if zeros:
            run += 1
    _flush(out, run, [])
    return out.bytes()


def _encode_refine(blocks, low, high, al):
    out, run, later = _Bits(), 0, []
    for b in blocks:
        t = [abs(int(v)) >> al for v in b]
        last = max((k for k in range(low, high + 1) if t[k] == 1), default=-1)
        zeros, held = 0, []
        for k in range(low, high + 1):
            if t[k] == 0:
                zeros += 1
                continue
            while zeros > 15 and k <= last:
                _flush(out, run, later)
                run, later = 0, []
                out.put(CODE[0xF0], 8)
                zeros -= 16
                out.bits += held
                held = []
            if t[k] > 1:
                held.append(t[k] & 1)
                continue
            _flush(out, run, later)
            run, later = 0, []
            out.put(CODE[zeros << 4 | 1], 8)
            out.put(int(b[k] > 0), 1)
            out.bits += held
            zeros, held = 0, []
        if zeros or held:
            run += 1
            later += held
    _flush(out, run, later)
    return out.bytes()


def _stream(coef, width, height, restart=0):
    """One gray component, any coefficients, through several spectral and bit-plane scans."""
    out = [b"\xff\xd8", mj._segment(0xDB, bytes([0]) + bytes(range(1, 65))), mj._DC_TABLE, TABLE]
    out.append(mj._segment(0xC2, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([1, 7, 0x11, 0])))
    if restart:
        out.append(mj._segment(0xDD, restart.to_bytes(2, "big")))
    parts = [coef[i : i + (restart or len(coef))] for i in range(0, len(coef), restart or len(coef))]

    def scan(low, high, before, al, encode):
        data = b"".join((bytes([0xFF, 0xD0 + (i - 1) % 8]) if i else b"") + encode(p).replace(b"\xff", b"\xff\x00") for i, p in enumerate(parts))
        head = bytes([1, 7, 0, low, high, before << 4 | al])
        out.append(mj._segment(0xDA, head) + data)

    def dc(al):
        def run(blocks):
            bits, last = _Bits(), 0
            for b in blocks:
                v = int(b[0]) >> al
                d, last = v - last, v
                n = abs(d).bit_length()
                bits.put(n, 4)
                bits.put(d if d > 0 else d + (1 << n) - 1, n)
            return bits.bytes()

        return run

    def dc_fine(al):
        return lambda blocks: np.packbits(np.array([int(b[0]) >> al & 1 for b in blocks] + [1] * (-len(blocks) % 8), np.uint8)).tobytes()

    scan(0, 0, 0, 1, dc(1))
    scan(1, 5, 0, 2, lambda p: _encode_first(p, 1, 5, 2))
    scan(6, 63, 0, 2, lambda p: _encode_first(p, 6, 63, 2))
    scan(1, 63, 2, 1, lambda p: _encode_refine(p, 1, 63, 1))
    scan(0, 0, 1, 0, dc_fine(0))
    scan(1, 63, 1, 0, lambda p: _encode_refine(p, 1, 63, 0))
    return b"".join([*out, b"\xff\xd9"])


@pytest.mark.parametrize("restart", [0, 3])
@pytest.mark.parametrize("density", [0.02, 0.3, 1.0])
def test_general_scans(restart, density):
    rng = np.random.default_rng(5)
    wide, high = 5, 4
    coef = rng.integers(-60, 61, (wide * high, 64)) * (rng.random((wide * high, 64)) < density)
    coef[3:9, 1:] = 0
    picture = mj.Picture(_stream(coef, wide * 8 - 3, high * 8 - 5, restart))
    assert (picture.components[0].coef == coef).all()
    tensor = picture.tensor()
    assert tensor.shape == (high * 8 - 5, wide * 8 - 3, 3)
    # the inverse transform against its definition
    freq = np.zeros((8, 8))
    freq.ravel()[mj.zigzag()] = coef[0] * np.arange(1, 65)
    x = np.arange(8)
    basis = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) * np.where(x == 0, np.sqrt(0.5), 1)[:, None] / 2
    want = np.clip(np.rint(basis.T @ freq @ basis + 128), 0, 255)
    assert np.abs(want - tensor[:8, :8, 0]).max() <= 1


def test_zigzag_starts_as_published():
    assert mj.zigzag()[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24]
    assert sorted(mj.zigzag()) == list(range(64))


@pytest.mark.parametrize("blocks", [1, 2, 6, 7, 50, 1201])
def test_payload_round_trip_on_both_paths(blocks, monkeypatch):
    payload = random.Random(blocks).randbytes(64 * blocks)
    media = mj.store(payload)
    fast = mj.Picture(media)
    monkeypatch.setattr(mj.Picture, "_fixed_width", lambda *a: False)
    slow = mj.Picture(media)
    assert fast.payload() == slow.payload() == payload
    assert (fast.tensor() == slow.tensor()).all()


def test_chroma_is_upsampled():
    picture = mj.Picture(mj.store(bytes(range(256)) * 6))
    y, cb, cr = picture.planes()
    assert y.shape == (2 * cb.shape[0], 2 * cb.shape[1]) and cb.shape == cr.shape
    assert picture.tensor().shape[:2] == y.shape


def test_digest_rows(spark):
    texts = [None, "", "abc", "é" * 33, "x" * 64, "y" * 70000, "abc"]
    df = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "doc_id long, text string, feature string")
    rows = {r["doc_id"]: r for r in mj.digest(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        want = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(want))
        assert r["payload_sha256"] == hashlib.sha256(want).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(want[-64:])
    assert rows[2]["media_sha256"] == rows[6]["media_sha256"] and rows[2]["feature"] == rows[6]["feature"]
    assert rows[0]["feature"] == rows[1]["feature"]
    assert mj.digest(df.limit(0)).count() == 0


def test_columns_and_errors(spark):
    df = spark.createDataFrame([(1, "abc", 5)], "doc_id long, text string, tensor int")
    stored = mj.store_texts(df)
    got = mj.decode_media(stored).collect()[0]
    assert len(got["tensor"]["data"]) == got["tensor"]["height"] * got["tensor"]["width"] * 3 and got["error"] is None
    whole = stored.collect()[0]["media"]
    bad = spark.createDataFrame([(1, whole[:200]), (2, b"xyz"), (3, None), (4, whole.replace(b"\xff\xc2", b"\xff\xc0"))], "doc_id long, media binary")
    rows = mj.decode_media(bad).collect()
    assert all(r["tensor"] is None and r["error"] for r in rows)
