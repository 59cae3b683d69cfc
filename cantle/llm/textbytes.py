"""Whole batches of texts as one byte buffer: word boundaries and word hashes without a Python loop."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Bytes of text handled at a time; a longer text is handled alone.
CHUNK = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
# Fixed value: the six ASCII white-space bytes.
SPACES = b" \t\n\x0b\x0c\r"


def chunks(texts: list[str | None], most: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first text, encoded texts) with about ``most`` bytes each."""
    first, part, n = 0, [], 0
    for i, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass")
        if part and n + len(raw) > most:
            yield first, part
            first, part, n = i, [], 0
        part.append(raw)
        n += len(raw) + 1
    if part:
        yield first, part


def sliced(batches, rows: int = 1024) -> Iterator:
    """Arrow batches of at most so many rows: what a batch turns into takes many times its size."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def pack(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with a newline after each text, and the start of each text."""
    buf = np.frombuffer(b"\n".join([*raws, b""]), np.uint8)
    lengths = np.fromiter(map(len, raws), np.int64, len(raws)) + 1
    return buf, np.cumsum(lengths) - lengths


@lru_cache(1)
def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def lower(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return _lower()[buf]


@lru_cache(4)
def _mask(kind: str) -> np.ndarray:
    table = np.ones(256, bool)
    if kind == "spaced":
        table[list(SPACES)] = False
    else:  # letters and digits, and all bytes of non-ASCII characters
        table[:128] = [chr(b).isalnum() for b in range(128)]
    return table


def words(buf: np.ndarray, kind: str = "spaced") -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of word bytes."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = _mask(kind)[buf]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _power_rows(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(CHUNK.bit_length(), int(n).bit_length()))


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    out = []
    for base in (_P, pow(_P, -1, 1 << 64)):
        a = np.full(n, base, np.uint64)
        a[0] = 1
        out.append(np.cumprod(a))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = h ^ (h >> np.uint64(33))
    h = h * _M1
    h = h ^ (h >> np.uint64(33))
    h = h * _M2
    return h ^ (h >> np.uint64(33))


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial from prefix sums, then mixed."""
    up, down = _power_rows(len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
    poly = (total[end] - total[start]) * down[start]
    return mix(poly + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
