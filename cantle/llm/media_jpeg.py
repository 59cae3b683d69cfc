"""Media columns as progressive JPEG: bytes in coefficients, scans decoded in numpy, RGB tensors out.

Reading. Every scan of a progressive stream adds to the components' coefficient arrays: DC and
AC bands (spectral selection) at a coarse precision first, later scans the lower bits
(successive approximation). Then one integer matrix product inverse-transforms all blocks,
chroma planes are upsampled by repetition, and YCbCr becomes an RGB tensor of full size. All
arithmetic is on integers (held exactly in float64 for the product), so equal bytes give equal
tensors on any machine and in any batch.

Writing. A lossy image cannot hold bytes in its samples, so a payload goes into the format's own
unit, the quantised coefficients: 64 bytes fill one 8x8 block. Byte b becomes the coefficient
of magnitude 128 + (b mod 128), negative from 128 up. All coefficients of the first AC scans
then have one size class and all refinements are plain correction bits, so these scans are
fixed-width fields that numpy reads at once; any other stream takes the general scan readers.

Edge cases: null text is empty text; an empty payload is 64 zero bytes; spare blocks of the last
row hold byte 0 and are cut off by the length in the comment segment; equal texts give equal
stored bytes; a broken or non-progressive stream gives a null tensor and an error text; an empty
table gives an empty result; input columns with the output's names are replaced.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cantle.session import ship

BLOCK = 64
_FIX = 14
_MARKER = re.compile(rb"\xff[^\x00\xff\xd0-\xd7]", re.S)
_RESTART = re.compile(rb"\xff[\xd0-\xd7]", re.S)
#: Blocks inverse-transformed at a time; bounds the working memory of one large picture.
CHUNK_BLOCKS = 8192


class JpegError(ValueError):
    """The stream is not a whole progressive JPEG."""


@lru_cache(1)
def zigzag() -> np.ndarray:
    """Raster position (row * 8 + column) of each coefficient in zigzag order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in cells])


@lru_cache(1)
def _inverse() -> np.ndarray:
    """Zigzag coefficients to pixels, as whole numbers scaled by 2 ** _FIX."""
    x = np.arange(8)
    basis = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) * np.where(x == 0, np.sqrt(0.5), 1.0)[:, None] / 2
    full = np.einsum("vy,ux->vuyx", basis, basis).reshape(64, 64)
    return np.rint(full[zigzag()] * (1 << _FIX))


# -- writing -----------------------------------------------------------------------------------
def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _table(kind: int, slot: int, lengths: dict[int, int]) -> bytes:
    counts = [0] * 16
    for n in lengths.values():
        counts[n - 1] += 1
    return _segment(0xC4, bytes([kind << 4 | slot, *counts, *sorted(lengths, key=lambda s: (lengths[s], s))]))


#: Size classes of DC differences, four bits each; a first AC symbol "seven bits, no run"; an end of block.
_DC_TABLE = _table(0, 0, dict.fromkeys(range(12), 4))
_AC_FIRST = _table(1, 0, {0x07: 1})
_AC_REFINE = _table(1, 0, {0x00: 1})


def _scan(components: list[int], low: int, high: int, before: int, shift: int, data: bytes) -> bytes:
    head = bytes([len(components), *[x for c in components for x in (c, 0)], low, high, before << 4 | shift])
    return _segment(0xDA, head) + data.replace(b"\xff", b"\xff\x00")


@lru_cache(256)
def _mcu_order(wide: int, high: int) -> np.ndarray:
    """Block numbers, luma plane first, in the order of an interleaved 4:2:0 scan."""
    n = wide * high
    luma = np.arange(4 * n).reshape(high, 2, wide, 2).transpose(0, 2, 1, 3).reshape(n, 4)
    return np.concatenate([luma, 4 * n + np.arange(n)[:, None], 5 * n + np.arange(n)[:, None]], axis=1).ravel()


def shape_for(blocks: int) -> tuple[int, int]:
    """Units of 16 by 16 pixels across and down that hold so many blocks."""
    units = max(1, -(-blocks // 6))
    high = -(-units // 4095)
    if high > 4095:
        raise JpegError("payload too large for one picture")
    return -(-units // high), high


def store(payload: bytes) -> bytes:
    """A progressive JPEG that holds the payload, a positive multiple of 64 bytes."""
    if not payload or len(payload) % BLOCK:
        raise ValueError("payload must be a positive multiple of 64 bytes")
    wide, high = shape_for(len(payload) // BLOCK)
    n = wide * high
    raw = np.zeros((6 * n, BLOCK), np.uint8)
    raw.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    low7, negative = raw & 0x7F, raw > 127

    dc = 128 + low7[:, 0].astype(np.int32)
    dc[negative[:, 0]] *= -1
    order = _mcu_order(wide, high)
    coarse = dc >> 1
    diff = np.empty(6 * n, np.int32)
    for a, b, per in ((0, 4 * n, 4), (4 * n, 5 * n, 1), (5 * n, 6 * n, 1)):
        own = (order >= a) & (order < b)
        diff[own] = np.diff(coarse[order[own]], prepend=0)
    size = np.ceil(np.log2(np.abs(diff) + 1)).astype(np.int64)
    value = (size << size) | np.where(diff > 0, diff, diff + (1 << size) - 1)  # four bits of class, then the difference
    length = 4 + size
    ends = np.cumsum(length)
    owner = np.repeat(np.arange(6 * n), length)
    bits = (value[owner] >> (ends[owner] - 1 - np.arange(ends[-1]))) & 1
    dc_first = np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.int64)]).astype(np.uint8)).tobytes()

    first = np.where(negative, 63 - (low7 >> 1), 64 + (low7 >> 1)).astype(np.uint8)
    fine = low7 & 1
    fine[:, 0] = 0
    refine = np.packbits(fine, axis=1)
    planes = [slice(0, 4 * n), slice(4 * n, 5 * n), slice(5 * n, 6 * n)]
    dc_fine = np.packbits(np.concatenate([dc[order] & 1, np.ones(-6 * n % 8, np.int32)]).astype(np.uint8)).tobytes()

    out = [b"\xff\xd8", _segment(0xFE, b"payload %d" % len(payload)), _segment(0xDB, bytes([0]) + bytes([1] * 64))]
    out.append(_segment(0xC2, bytes([8]) + (16 * high).to_bytes(2, "big") + (16 * wide).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    out += [_DC_TABLE, _AC_FIRST, _scan([1, 2, 3], 0, 0, 0, 1, dc_first)]
    for c, low, top in ((1, 1, 5), (1, 6, 63), (2, 1, 63), (3, 1, 63)):
        out.append(_scan([c], low, top, 0, 1, first[planes[c - 1], low : top + 1].tobytes()))
    out.append(_AC_REFINE)
    out += [_scan([c], 1, 63, 1, 0, refine[planes[c - 1]].tobytes()) for c in (1, 2, 3)]
    out += [_scan([1, 2, 3], 0, 0, 1, 0, dc_fine), b"\xff\xd9"]
    return b"".join(out)


# -- reading -----------------------------------------------------------------------------------
class _Codes:
    """One Huffman table: symbol and length for each 16-bit window."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.symbols = symbols
        self.only = symbols[0] if len(symbols) == 1 and counts[0] == 1 else None
        symbol, length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        code = at = 0
        for n, many in enumerate(counts, 1):
            for s in symbols[at : at + many]:
                lo, hi = code << (16 - n), (code + 1) << (16 - n)
                if hi > 1 << 16:
                    raise JpegError("overfull Huffman table")
                symbol[lo:hi], length[lo:hi] = s, n
                code += 1
            at += many
            code <<= 1
        self.symbol, self.length = symbol.tolist(), length.tolist()


_codes = lru_cache(64)(_Codes)


class _Component:
    def __init__(self, number: int, across: int, down: int, table: int):
        self.number, self.across, self.down, self.table = number, across, down, table

    def lay_out(self, width: int, height: int, most_across: int, most_down: int, units: tuple[int, int]) -> None:
        self.stride, rows = units[0] * self.across, units[1] * self.down
        self.own_wide = -(-(-(-width * self.across // most_across)) // 8)
        self.own_high = -(-(-(-height * self.down // most_down)) // 8)
        self.coef = np.zeros((rows * self.stride, 64), np.int32)

    def own_blocks(self) -> np.ndarray:
        """Blocks of a scan of this component alone: raster order, without padding."""
        return (np.arange(self.own_high)[:, None] * self.stride + np.arange(self.own_wide)).ravel()


class Picture:
    """The coefficient arrays of one stream, filled scan by scan."""

    def __init__(self, data: bytes):
        self.components: list[_Component] = []
        self.quant: dict[int, np.ndarray] = {}
        self.codes: dict[int, _Codes] = {}
        self.comment = b""
        self.restart = 0
        if data[:2] != b"\xff\xd8":
            raise JpegError("no start of image")
        at, scans = 2, 0
        while True:
            m = _MARKER.search(data, at)
            if m is None:
                raise JpegError("no end of image")
            marker, at = data[m.start() + 1], m.end()
            if marker == 0xD9:
                break
            size = int.from_bytes(data[at : at + 2], "big")
            body, at = data[at + 2 : at + size], at + size
            if size < 2 or at > len(data):
                raise JpegError("cut off")
            if marker == 0xDB:
                self._quant(body)
            elif marker == 0xC4:
                self._huffman(body)
            elif marker == 0xC2:
                self._frame(body)
            elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
                raise JpegError("not a progressive Huffman stream")
            elif marker == 0xDD:
                self.restart = int.from_bytes(body[:2], "big")
            elif marker == 0xFE:
                self.comment = body
            elif marker == 0xDA:
                end = _MARKER.search(data, at)
                if end is None or not self.components:
                    raise JpegError("scan without frame or end")
                self._scan(body, data[at : end.start()])
                at, scans = end.start(), scans + 1
        if not scans:
            raise JpegError("no scan")

    def _quant(self, body: bytes) -> None:
        while body:
            wide = body[0] >> 4
            n = 64 * (1 + wide)
            self.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int32)
            body = body[1 + n :]

    def _huffman(self, body: bytes) -> None:
        while body:
            n = sum(body[1:17])
            self.codes[body[0]] = _codes(body[1:17], body[17 : 17 + n])
            body = body[17 + n :]

    def _frame(self, body: bytes) -> None:
        if body[0] != 8:
            raise JpegError("not 8-bit")
        self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        if not self.height or not self.width:
            raise JpegError("no size")
        self.components = [_Component(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
        self.most_across, self.most_down = max(c.across for c in self.components), max(c.down for c in self.components)
        self.units = (-(-self.width // (8 * self.most_across)), -(-self.height // (8 * self.most_down)))
        for c in self.components:
            c.lay_out(self.width, self.height, self.most_across, self.most_down, self.units)

    def _scan(self, body: bytes, data: bytes) -> None:
        chosen = [(next(c for c in self.components if c.number == body[i]), body[i + 1]) for i in range(1, 1 + 2 * body[0], 2)]
        low, high, approx = body[1 + 2 * body[0] : 4 + 2 * body[0]]
        before, shift = approx >> 4, approx & 15
        parts = _RESTART.split(data) if self.restart else [data]
        parts = [p.replace(b"\xff\x00", b"\xff") for p in parts]
        if low == 0:
            self._dc(chosen, parts, before, shift)
            return
        if len(chosen) != 1:
            raise JpegError("AC scans have one component")
        c, tables = chosen[0]
        codes = self.codes[0x10 | tables & 15]
        blocks = c.own_blocks()
        if not self.restart and self._fixed_width(c, codes, blocks, parts[0], low, high, before, shift):
            return
        step = self.restart or len(blocks)
        for i, part in enumerate(parts):
            own = blocks[i * step : (i + 1) * step]
            coef = c.coef[own].tolist()
            (_refine if before else _first)(coef, _windows(part), codes, low, high, shift)
            c.coef[own] = coef

    def _fixed_width(self, c: _Component, codes: _Codes, blocks: np.ndarray, data: bytes, low: int, high: int, before: int, shift: int) -> bool:
        """Scans with a one-bit code for their only symbol, where that makes all fields equally wide."""
        n, band = len(blocks), high - low + 1
        whole = c.own_wide == c.stride and n == len(c.coef)
        if not whole:
            return False
        if not before and codes.only == 0x07 and len(data) == n * band:
            field = np.frombuffer(data, np.uint8).reshape(n, band)
            if field.max(initial=0) > 127:
                return False
            value = field.astype(np.int32)
            c.coef[:, low : high + 1] = np.where(value > 63, value, value - 127) << shift
            return True
        if before and codes.only == 0x00 and band == 63 and len(data) == 8 * n:
            bits = np.unpackbits(np.frombuffer(data, np.uint8)).reshape(n, 64)
            held = c.coef[:, 1:]
            if bits[:, 0].any() or not held.all():
                return False
            held += np.sign(held) * (bits[:, 1:].astype(np.int32) << shift)
            return True
        return False

    def _dc(self, chosen: list, parts: list[bytes], before: int, shift: int) -> None:
        if len(chosen) == 1:
            c = chosen[0][0]
            owner, block = np.zeros(c.own_wide * c.own_high, np.int64), c.own_blocks()
            per = 1
        else:
            owner, block, per = self._interleaved([c for c, _ in chosen])
        step = self.restart * per or len(block)
        for i, part in enumerate(parts):
            own, at = owner[i * step : (i + 1) * step], block[i * step : (i + 1) * step]
            if before:
                bits = np.unpackbits(np.frombuffer(part, np.uint8))[: len(own)].astype(np.int32)
                if len(bits) < len(own):
                    raise JpegError("DC scan cut off")
                for k, (c, _) in enumerate(chosen):
                    c.coef[at[own == k], 0] |= bits[own == k] << shift
                continue
            diff = _differences(_windows(part), [self.codes[t >> 4] for _, t in chosen], own.tolist())
            for k, (c, _) in enumerate(chosen):
                c.coef[at[own == k], 0] = np.cumsum(diff[own == k]) << shift

    def _interleaved(self, components: list[_Component]) -> tuple[np.ndarray, np.ndarray, int]:
        wide, high = self.units
        owner, block = [], []
        for k, c in enumerate(components):
            grid = np.arange(len(c.coef)).reshape(high, c.down, wide, c.across).transpose(0, 2, 1, 3).reshape(wide * high, -1)
            block.append(grid)
            owner.append(np.full_like(grid, k))
        return np.concatenate(owner, 1).ravel(), np.concatenate(block, 1).ravel(), sum(b.shape[1] for b in block)

    def payload(self) -> bytes:
        """The bytes that ``store`` put into the coefficients."""
        m = re.fullmatch(rb"payload (\d+)", self.comment)
        if m is None:
            raise JpegError("holds no payload")
        coef = np.concatenate([c.coef for c in self.components])
        raw = (np.abs(coef) - 128).astype(np.uint8) | np.where(coef < 0, 128, 0).astype(np.uint8)
        return raw.tobytes()[: int(m[1])]

    def planes(self) -> list[np.ndarray]:
        """Each component's samples at its own resolution, padded to whole blocks."""
        half = (128 << _FIX) + (1 << (_FIX - 1))
        out = []
        for c in self.components:
            pixels = np.empty((len(c.coef), 64), np.uint8)
            for i in range(0, len(pixels), CHUNK_BLOCKS):
                exact = (c.coef[i : i + CHUNK_BLOCKS] * self.quant[c.table]).astype(np.float64) @ _inverse()
                pixels[i : i + CHUNK_BLOCKS] = np.clip(np.floor((exact + half) / (1 << _FIX)), 0, 255)
            out.append(pixels.reshape(-1, c.stride, 8, 8).transpose(0, 2, 1, 3).reshape(-1, c.stride * 8))
        return out

    def tensor(self) -> np.ndarray:
        """Height x width x 3 bytes."""
        planes = []
        for c, p in zip(self.components, self.planes(), strict=True):
            down, across = self.most_down // c.down, self.most_across // c.across
            p = p.repeat(down, axis=0) if down > 1 else p
            p = p.repeat(across, axis=1) if across > 1 else p
            planes.append(p[: self.height, : self.width].astype(np.int32))
        if len(planes) == 1:
            return np.repeat(planes[0][:, :, None], 3, axis=2).astype(np.uint8)
        if len(planes) != 3:
            raise JpegError("one or three components are read")
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        half = 1 << 15
        rgb = np.empty((*y.shape, 3), np.uint8)
        # fixed values: the JFIF colour matrix, scaled by 2 ** 16
        rgb[:, :, 0] = np.clip(y + ((91881 * cr + half) >> 16), 0, 255)
        rgb[:, :, 1] = np.clip(y - ((22554 * cb + 46802 * cr + half) >> 16), 0, 255)
        rgb[:, :, 2] = np.clip(y + ((116130 * cb + half) >> 16), 0, 255)
        return rgb


def _windows(data: bytes) -> list[int]:
    """The 16 bits from each bit on; behind the end come ones."""
    b = np.frombuffer(data + b"\xff" * 12, np.uint8).astype(np.int64)
    word = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    return ((word[:, None] >> (8 - np.arange(8))) & 0xFFFF).ravel().tolist()


def _differences(win: list[int], codes: list[_Codes], owner: list[int]) -> np.ndarray:
    out, at = [], 0
    tables = [(c.symbol, c.length) for c in codes]
    try:
        for k in owner:
            symbol, length = tables[k]
            w = win[at]
            s = symbol[w]
            at += length[w]
            if s:
                v = win[at] >> (16 - s)
                at += s
                out.append(v if v >> (s - 1) else v - (1 << s) + 1)
            else:
                out.append(0)
    except IndexError as e:
        raise JpegError("DC scan cut off") from e
    return np.array(out, np.int64)


def _first(coef: list[list[int]], win: list[int], codes: _Codes, low: int, high: int, shift: int) -> None:
    """A first AC scan of one component."""
    symbol, length, at, ended = codes.symbol, codes.length, 0, 0
    try:
        for block in coef:
            if ended:
                ended -= 1
                continue
            k = low
            while k <= high:
                w = win[at]
                run, size = symbol[w] >> 4, symbol[w] & 15
                at += length[w]
                if size:
                    k += run
                    v = win[at] >> (16 - size)
                    at += size
                    block[k] = (v if v >> (size - 1) else v - (1 << size) + 1) * (1 << shift)
                    k += 1
                elif run == 15:
                    k += 16
                else:
                    ended = (1 << run) - 1
                    if run:
                        ended += win[at] >> (16 - run)
                        at += run
                    break
    except IndexError as e:
        raise JpegError("AC scan cut off") from e


def _refine(coef: list[list[int]], win: list[int], codes: _Codes, low: int, high: int, shift: int) -> None:
    """A later AC scan: one more bit of known coefficients, and those that only now leave zero."""
    symbol, length, at, ended, unit = codes.symbol, codes.length, 0, 0, 1 << shift

    def pass_over(block: list[int], k: int, zeros: int) -> int:
        """Correct known coefficients up to the zero after so many zeros; its place, or high + 1."""
        nonlocal at
        while k <= high:
            v = block[k]
            if v:
                if win[at] >> 15:
                    block[k] = v + unit if v > 0 else v - unit
                at += 1
            else:
                if zeros == 0:
                    return k
                zeros -= 1
            k += 1
        return k

    try:
        for block in coef:
            k = low
            while k <= high and not ended:
                w = win[at]
                run, size = symbol[w] >> 4, symbol[w] & 15
                at += length[w]
                if size == 0 and run < 15:
                    ended = 1 << run
                    if run:
                        ended += win[at] >> (16 - run)
                        at += run
                    break
                fresh = 0
                if size:
                    fresh = unit if win[at] >> 15 else -unit
                    at += 1
                k = pass_over(block, k, run)
                if fresh and k <= high:
                    block[k] = fresh
                k += 1
            if ended:
                pass_over(block, k, 64)
                ended -= 1
    except IndexError as e:
        raise JpegError("AC scan cut off") from e


# -- columns -----------------------------------------------------------------------------------
def padded(text: str | None) -> tuple[bytes, int]:
    """The text's UTF-8 with zero bytes up to a positive multiple of 64, and its own length."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw)), len(raw)


def feature(tensor: np.ndarray) -> str:
    """Size, and per channel the sum, the sum of squares and eight brightness counts."""
    flat = tensor.reshape(-1, 3)
    parts = [f"{tensor.shape[0]}x{tensor.shape[1]}"]
    for ch in range(3):
        counts = np.bincount(flat[:, ch], minlength=256)
        level = np.arange(256)
        parts.append(f"{counts @ level},{counts @ (level * level)}," + "-".join(map(str, counts.reshape(8, 32).sum(1))))
    return ";".join(parts)


TENSOR = T.StructType(
    [
        T.StructField("height", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("channels", T.IntegerType()),
        T.StructField("data", T.BinaryType()),
    ]
)


def _replaced(df: DataFrame, fields: list[T.StructField]) -> T.StructType:
    new = {f.name for f in fields}
    return T.StructType([f for f in df.schema.fields if f.name not in new] + fields)


def _emit(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = [i for i, n in enumerate(batch.schema.names) if n not in new]
    return pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + list(new.values()), names=[batch.schema.names[i] for i in kept] + list(new))


def store_texts(df: DataFrame, text_col: str = "text", out: str = "media") -> DataFrame:
    """``df`` with its texts' padded UTF-8 stored as progressive JPEG."""
    ship(df.sparkSession)

    def run(batches):
        for b in batches:
            yield _emit(b, {out: pa.array([store(padded(t)[0]) for t in b.column(text_col).to_pylist()], pa.binary())})

    return df.mapInArrow(run, _replaced(df, [T.StructField(out, T.BinaryType())]))


def decode_media(df: DataFrame, media_col: str = "media", out: str = "tensor") -> DataFrame:
    """``df`` with the RGB tensor of each progressive JPEG, and ``error`` where there is none."""
    ship(df.sparkSession)
    kind = pa.struct([("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("data", pa.binary())])

    def one(data):
        if data is None:
            return None, "no media"
        try:
            t = Picture(data).tensor()
        except (JpegError, KeyError, IndexError, ValueError, StopIteration) as e:
            return None, f"{type(e).__name__}: {e}"
        return {"height": t.shape[0], "width": t.shape[1], "channels": 3, "data": t.tobytes()}, None

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 64):  # tensors are large; few at a time
                part = b.slice(i, 64)
                done = [one(x) for x in part.column(media_col).to_pylist()]
                yield _emit(part, {out: pa.array([x for x, _ in done], kind), "error": pa.array([x for _, x in done], pa.string())})

    return df.mapInArrow(run, _replaced(df, [T.StructField(out, TENSOR), T.StructField("error", T.StringType())]))


DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: store the text, read the stored bytes back, and report what came back."""
    ship(df.sparkSession)
    spark_id = df.schema[id_col].dataType.simpleString()
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(text_col):
                payload, n = padded(text.as_py())
                media = store(payload)
                picture = Picture(media)
                back = picture.payload()
                rows.append((n, len(back), sha(back), zlib.crc32(back[-BLOCK:]), len(media), sha(media), feature(picture.tensor())))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(id_col), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=[id_col, *[f.split()[0] for f in DIGEST.split(", ")]])

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {spark_id}, {DIGEST}")
