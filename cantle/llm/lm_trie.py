"""Language-model scores from an Elias-Fano n-gram trie.

Words and the end mark are 64-bit hashes; the vocabulary, sorted, numbers them. Level k of the trie
holds the k-grams as (number of the context's (k-1)-gram, word number) in order. As context numbers
ascend, ``context * V + word`` ascends over the whole level, so one Elias-Fano code keeps it: low bits
packed, high bits as unary steps. To look up a successor, its context-relative place is found
from the zeros of the high bits, and the few entries with those high bits are compared. The start
of a context's successors is the same search for its first possible word, which makes the code its own
monotone pointer array. Probabilities and back-off weights are log10 values in 8 bits, by quantiles
of each file.

P(w | c) = max(n(cw) - D, 0) / n(c) + D * t(c) / n(c) * P(w | shorter c), down to the add-one unigram
(n + 1) / (N + V + 1); t(c) is the number of different successors.

Counting is distributed: each task counts its own k-grams (numpy, sorted keys), sends one packed row
per shard, and a shard, a contiguous range of words (level 1) or contexts, merges what it gets and
writes its file. Files lie in the folder that spark.checkpoint.dir names; scoring tasks map
them, so a task's memory holds only the pages it touches. A file is written under a temporary name
and renamed, so a task that runs again after an executor is lost does no harm.

Edge cases: null and empty texts are the end mark alone; an empty training fold leaves N = V = 0 and
probabilities of 1 / (V + 1); a null id is in training (its remainder is unknown); repeated rows count as
often as they occur; texts of any length are counted whole; extra columns are not read.
"""

from __future__ import annotations

import itertools
import mmap
import os
import shutil
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantle.llm import textbytes as tb
from cantle.session import scratch, ship, tidy

ORDER = 3
DISCOUNT = 0.75
#: The end mark's place among the word hashes; a word with this very hash would be taken for it.
END = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Occurrences that a shard gets on average.
SHARD_TOKENS = 1_500_000
#: Bytes of text that a task counts or scores at a time: each look-up goes through all shards once.
GATHER_BYTES = 6_000_000
SCORE_BYTES = 6_000_000
_POP = np.array([bin(b).count("1") for b in range(256)], np.uint8)
#: Place of the k-th set bit of each byte, 8 where there are fewer.
_NTH = np.array([([i for i in range(8) if b >> i & 1] + [8] * 8)[:8] for b in range(256)], np.int64)


def _in_word(bits: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th set bit of each 64-bit word, from 0: its byte by running counts, then a table."""
    parts = bits.view(np.uint8).reshape(-1, 8)
    until = np.cumsum(_POP[parts], axis=1, dtype=np.uint8)
    byte = np.minimum((until <= k[:, None]).sum(1), 7)
    row = np.arange(len(k))
    before = np.where(byte > 0, until[row, np.maximum(byte - 1, 0)], 0)
    return byte * 8 + _NTH[parts[row, byte], np.minimum(k - before, 7)]


# -- Elias-Fano ------------------------------------------------------------------------------------
class EliasFano:
    """An ascending sequence of whole numbers below ``universe``."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.zeros = n, low_bits, low, high, zeros

    @staticmethod
    def parts(values: np.ndarray, universe: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """(low bits, packed low halves, high bitmap, zeros before each 64-bit word of it)."""
        n = len(values)
        bits = max(0, int(universe // max(n, 1)).bit_length() - 1)
        v = values.astype(np.uint64)
        top = (v >> np.uint64(bits)).astype(np.int64)
        length = n + int(universe >> bits) + 1
        words = -(-length // 64) + 1
        flags = np.zeros(words * 64, np.uint8)
        flags[top + np.arange(n)] = 1
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        ones = _POP[high.view(np.uint8)].reshape(-1, 8).sum(1, dtype=np.int64)
        zeros = np.cumsum(64 - ones) - (64 - ones)
        spots = np.arange(n, dtype=np.int64) * bits
        low = np.zeros(-(-n * bits // 64) + 2, np.uint64)
        part = v & np.uint64((1 << bits) - 1) if bits else np.zeros(n, np.uint64)
        word, off = spots >> 6, (spots & 63).astype(np.uint64)
        np.bitwise_or.at(low, word, part << off)
        spill = np.where(off > 0, part >> (np.uint64(64) - np.maximum(off, np.uint64(1))), np.uint64(0))
        np.bitwise_or.at(low, word + 1, spill)
        return bits, low, high, zeros

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.low_bits
        word, off = at >> 6, (at & 63).astype(np.uint64)
        got = self.low[word] >> off
        more = np.where(off > 0, self.low[word + 1] << (np.uint64(64) - np.maximum(off, np.uint64(1))), np.uint64(0))
        return (got | more) & np.uint64((1 << self.low_bits) - 1)

    def _select_zero(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th zero of the high bitmap, from 0."""
        word = np.searchsorted(self.zeros, k, "right") - 1
        return word * 64 + _in_word(~self.high[word], k - self.zeros[word])

    def _span(self, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last-but-one place of the entries with these high bits: the run of ones behind a zero."""
        at = np.where(top > 0, self._select_zero(np.maximum(top - 1, 0)) + 1, 0)
        word, off = at >> 6, (at & 63).astype(np.uint64)
        last = len(self.high) - 1
        bits = self.high[np.minimum(word, last)] >> off
        bits |= np.where(off > 0, self.high[np.minimum(word + 1, last)] << (np.uint64(64) - np.maximum(off, np.uint64(1))), np.uint64(0))
        stop = ~bits
        run = np.log2(np.maximum(stop & (~stop + np.uint64(1)), np.uint64(1)).astype(np.float64)).astype(np.int64)
        begin = at - top
        end = begin + run
        long = np.flatnonzero(stop == 0)  # 64 ones or more
        if len(long):
            end[long] = self._select_zero(top[long]) - top[long]
        return begin, end

    def _bound(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each value's lower bound, the end of the entries that share its high bits, and its low bits."""
        top = (v >> np.uint64(self.low_bits)).astype(np.int64)
        low = v & np.uint64((1 << self.low_bits) - 1) if self.low_bits else np.zeros(len(v), np.uint64)
        begin, last = self._span(top)
        end = last.copy()
        open_ = np.flatnonzero(begin < end)
        while len(open_):  # halving, among the few entries with the same high bits
            b, e = begin[open_], end[open_]
            mid = (b + e) >> 1
            under = self.lows(mid) < low[open_]
            b, e = np.where(under, mid + 1, b), np.where(under, e, mid)
            begin[open_], end[open_] = b, e
            open_ = open_[b < e]
        return begin, last, low

    def rank(self, v: np.ndarray) -> np.ndarray:
        """Number of entries below each value."""
        return self._bound(v)[0] if self.n else np.zeros(len(v), np.int64)

    def find(self, v: np.ndarray) -> np.ndarray:
        """Each value's place, or -1."""
        if not self.n:
            return np.full(len(v), -1)
        at, last, low = self._bound(v)
        out = np.full(len(v), -1)
        near = np.flatnonzero(at < last)
        hit = near[self.lows(at[near]) == low[near]]
        out[hit] = at[hit]
        return out


# -- files -------------------------------------------------------------------------------------------
def _local(path: str) -> str:
    """The shared folder as a path that can be mapped."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        raise ValueError(f"the trie's levels are memory-mapped; {path} must be a mounted folder")
    return path


def _write(path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of named arrays, each on a 64-byte boundary, put in place whole."""
    head, at = [], 0
    for k, a in arrays.items():
        head.append(f"{k} {a.dtype.str} {len(a)} {at}")
        at += -(-a.nbytes // 64) * 64
    top = "\n".join(head).encode().ljust(1024)
    temp = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(temp, "wb") as f:
        f.write(top)
        for a in arrays.values():
            f.write(a.tobytes().ljust(-(-a.nbytes // 64) * 64, b"\0"))
    os.replace(temp, path)


#: Files that a worker keeps mapped: one mapping each, without a file descriptor from Python 3.13 on.
UNTRACKED = {"trackfd": False} if sys.version_info >= (3, 13) else {}
MOST_OPEN = 30_000 if UNTRACKED else 512
_OPEN: dict[str, dict[str, np.ndarray]] = {}


def _mapped(path: str) -> dict[str, np.ndarray]:
    if path not in _OPEN:
        # files of another model, or too many, are let go
        root = path.rpartition("/")[0]
        if len(_OPEN) > MOST_OPEN or any(p.rpartition("/")[0] != root for p in itertools.islice(_OPEN, 1)):
            _OPEN.clear()
        with open(path, "rb") as f:
            whole = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **UNTRACKED)
        out = {}
        for line in whole[:1024].decode().split("\n"):
            name, kind, n, at = line.split()
            out[name] = np.frombuffer(whole, np.dtype(kind), int(n), 1024 + int(at)) if int(n) else np.zeros(0, np.dtype(kind))
        _OPEN[path] = out
    return _OPEN[path]


def _codebook(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Up to 256 levels, by quantiles, and each value's nearest."""
    if not len(values):
        return np.zeros(1), np.zeros(0, np.uint8)
    some = np.sort(values)
    book = np.unique(some[np.linspace(0, len(some) - 1, 256).astype(np.int64)])
    middle = (book[1:] + book[:-1]) / 2
    return book, np.searchsorted(middle, values).astype(np.uint8)


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places) of each shard that occurs."""
    if not len(shard):
        return
    order = np.arange(len(shard)) if (shard[1:] >= shard[:-1]).all() else np.argsort(shard, kind="stable")
    sorted_ = shard[order]
    cuts = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
    for a, b in zip(cuts, [*cuts[1:], len(shard)], strict=True):
        yield int(sorted_[a]), order[a:b]


# -- texts -------------------------------------------------------------------------------------------
def token_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of the texts in order, ends included, and the first token of each text."""
    hashes, many, i = [], [], 0
    while i < len(raws):  # hashing takes many bytes for one of text, so some texts at a time
        j, n = i + 1, len(raws[i])
        while j < len(raws) and n + len(raws[j]) <= tb.CHUNK:
            n += len(raws[j])
            j += 1
        buf, begin = tb.pack(raws[i:j])
        buf = tb.lower(buf)
        start, end = tb.words(buf)
        count = np.bincount(np.searchsorted(begin, start, "right") - 1, minlength=j - i) + 1
        out = np.full(int(count.sum()), END, np.uint64)
        inner = np.ones(len(out), bool)
        inner[np.cumsum(count) - 1] = False
        out[inner] = tb.word_hashes(buf, start, end)
        hashes.append(out)
        many.append(count)
        i = j
    many = np.concatenate(many) if many else np.zeros(0, np.int64)
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.cumsum(many) - many


class Model:
    """The trie's files, opened as they are needed."""

    def __init__(self, root: str, tokens: int, words: list[int], bounds: list[list[int]], grams: list[list[int]]):
        """``words``: words per level-1 shard, which split the hash space evenly; for each higher level the
        first context number and the number of grams of each shard."""
        self.root, self.tokens, self.words, self.bounds, self.grams = root, tokens, words, bounds, grams
        self.vocab = sum(words)
        self.word_base = np.cumsum([0, *words])
        self.gram_base = [np.cumsum([0, *g]) for g in grams]

    def remove(self) -> None:
        """Delete the trie's files, once all that is to be scored has been."""
        shutil.rmtree(self.root, ignore_errors=True)

    def word_numbers(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and training count of each hash; -1 and 0 for unknown words."""
        number, count = np.full(len(h), -1), np.zeros(len(h), np.int64)
        for s, who in _by_shard(_word_shard(h, len(self.words))):
            f = _mapped(f"{self.root}/1-{s}")
            if not len(f["hash"]):
                continue
            at = np.minimum(np.searchsorted(f["hash"], h[who]), len(f["hash"]) - 1)
            hit = f["hash"][at] == h[who]
            number[who[hit]] = self.word_base[s] + at[hit]
            count[who[hit]] = f["count"][at[hit]]
        return number, count

    def find(self, level: int, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the gram (context, word) at this level, or -1, and its log10 probability."""
        number, logp = np.full(len(context), -1), np.zeros(len(context))
        bound = self.bounds[level - 2]
        known = np.flatnonzero((context >= 0) & (word >= 0))
        for s, places in _by_shard(np.searchsorted(bound, context[known], "right") - 1):
            who = known[places]
            f = _mapped(f"{self.root}/{level}-{s}")
            ef = EliasFano(len(f["p"]), int(f["bits"][0]), f["low"], f["high"], f["zeros"])
            at = ef.find((context[who] - bound[s]).astype(np.uint64) * np.uint64(self.vocab) + word[who].astype(np.uint64))
            hit = at >= 0
            number[who[hit]] = self.gram_base[level - 2][s] + at[hit]
            logp[who[hit]] = f["book"][f["p"][at[hit]]]
        return number, logp

    def backoff(self, level: int, context: np.ndarray) -> np.ndarray:
        """log10 weight of the shorter context at this level; 0 for contexts without successors."""
        out = np.zeros(len(context))
        bound = self.bounds[level - 2]
        known = np.flatnonzero(context >= 0)
        for s, places in _by_shard(np.searchsorted(bound, context[known], "right") - 1):
            who = known[places]
            f = _mapped(f"{self.root}/{level}-{s}")
            inner = context[who] - bound[s]
            ok = inner < len(f["w"])
            out[who[ok]] = f["wbook"][f["w"][inner[ok]]]
        return out

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.tokens + self.vocab + 1))

    def walk(self, number: np.ndarray, first: np.ndarray, upto: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For k = 2 .. upto: (found gram, value) at each token, the value being the gram's log10 p, or the
        back-off weight of its context where there is no such gram; contexts stay inside texts."""
        pos = np.arange(len(number)) - np.repeat(first, np.diff(np.r_[first, len(number)]))
        gram = number
        for k in range(2, upto + 1):
            context = np.r_[-1, gram[:-1]] if len(gram) else gram
            context = np.where(pos >= k - 1, context, -1)
            before, word, back = _distinct(context, number)
            got, value = self.find(k, before, word)
            lost = np.flatnonzero(got < 0)
            value[lost] = self.backoff(k, before[lost])
            gram = got[back]
            yield gram, value[back]

    def score(self, raws: list[bytes]) -> tuple[np.ndarray, ...]:
        """Tokens, known tokens, base score and model score of each text."""
        h, first = token_hashes(raws)
        names, back = np.unique(h, return_inverse=True)
        number, count = self.word_numbers(names)
        number, count = number[back], count[back]
        base = self.unigram(count)
        logp = base.copy()
        for got, value in self.walk(number, first, len(self.bounds) + 1):
            logp = np.where(got >= 0, value, logp + value)
        many = np.diff(np.r_[first, len(h)])
        return many, np.add.reduceat((count > 0).astype(np.int64), first), np.add.reduceat(base, first), np.add.reduceat(logp, first)


def _word_shard(h: np.ndarray, n: int) -> np.ndarray:
    """Even ranges of the hash space."""
    return np.minimum((h >> np.uint64(32)).astype(np.int64) * n >> 32, n - 1)


# -- building ----------------------------------------------------------------------------------------
def held_out(doc_id):
    """crc32 of the id as text, modulo 7, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _counted(keys: np.ndarray, second: np.ndarray | None, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Distinct keys, or pairs of keys and seconds, in order, and how often each occurs or the sum of its weights."""
    if not len(keys):
        return keys, second, np.zeros(0, np.int64)
    wide = int(second.max()) + 1 if second is not None else 1
    one = second is None or int(keys.max()) < (1 << 63) // wide  # both in one whole number
    if one:
        mixed = keys if second is None else keys.astype(np.int64) * wide + second
        if weight is None:
            mixed = np.sort(mixed)
        else:
            order = np.argsort(mixed, kind="stable")
            mixed, weight = mixed[order], weight[order]
        new = np.flatnonzero(np.r_[True, mixed[1:] != mixed[:-1]])
        names = mixed[new]
        names, others = (names, None) if second is None else (names // wide, names % wide)
    else:
        order = np.lexsort((second, keys))
        keys, second = keys[order], second[order]
        weight = None if weight is None else weight[order]
        new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (second[1:] != second[:-1])])
        names, others = keys[new], second[new]
    return names, others, np.diff(np.r_[new, len(mixed if one else keys)]) if weight is None else np.add.reduceat(weight, new)


def _sent(keys: np.ndarray, second: np.ndarray | None, shard_of) -> Iterator[tuple[int, bytes]]:
    """Sorted keys with counts, one packed row per shard; shards are ascending ranges of keys."""
    names, others, count = _counted(keys, second)
    own = shard_of(names)
    cuts = np.r_[np.flatnonzero(np.r_[True, own[1:] != own[:-1]]), len(own)] if len(own) else []
    if others is not None:
        others = others.astype(np.uint32) if not len(others) or others.max() < 1 << 32 else others
    for a, b in zip(cuts, cuts[1:], strict=False):
        many = count[a:b]
        wide = many > 255  # counts in a byte, large ones listed behind
        spots = np.flatnonzero(wide)
        size = 0 if others is None else others.itemsize
        cols = [names[a:b]] if others is None else [names[a:b], others[a:b]]
        yield int(own[a]), b"".join([np.array([b - a, len(spots), size], np.int64).tobytes(), *[c.tobytes() for c in cols], np.where(wide, 0, many).astype(np.uint8).tobytes(), spots.astype(np.int64).tobytes(), many[spots].astype(np.int64).tobytes()])


def _received(rows: list[bytes], key_type) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    keys, second, count = [], [], []
    for r in rows:
        n, big, size = np.frombuffer(r, np.int64, 3)
        at = 24
        keys.append(np.frombuffer(r, key_type, n, at))
        at += 8 * n
        if size:
            second.append(np.frombuffer(r, np.uint32 if size == 4 else np.int64, n, at).astype(np.int64))
            at += size * n
        c = np.frombuffer(r, np.uint8, n, at).astype(np.int64)
        at += n
        spots = np.frombuffer(r, np.int64, big, at)
        c[spots] = np.frombuffer(r, np.int64, big, at + 8 * big)
        count.append(c)
    return _counted(np.concatenate(keys), np.concatenate(second) if second else None, np.concatenate(count))


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs in order, and each row's place among them; numbers are -1 or more, of any size."""
    if not len(a):
        return a, b, np.zeros(0, np.int64)
    wide = int(b.max()) + 2
    if int(a.max()) + 1 < (1 << 63) // wide - 1:  # both in one whole number
        pairs, back = np.unique((a + 1) * wide + b + 1, return_inverse=True)
        return pairs // wide - 1, pairs % wide - 1, back
    order = np.lexsort((b, a))
    new = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]
    back = np.empty(len(a), np.int64)
    back[order] = np.cumsum(new) - 1
    return a[order][new], b[order][new], back


def _texts(batch: pa.RecordBatch, most: int) -> Iterator[list[bytes]]:
    for _, raws in tb.chunks(batch.column("body").to_pylist(), most):
        yield raws


def _gather(batches, count) -> Iterator[pa.RecordBatch]:
    """Run ``count`` over a partition's tokens, some millions at a time, and send what it packs."""
    held, n = [], 0

    def flush():
        rows = list(count(held))
        return pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.binary())], names=["shard", "body"])

    for b in batches:
        for raws in _texts(b, GATHER_BYTES):
            held += raws
            n += sum(map(len, raws))
            if n > GATHER_BYTES:
                yield flush()
                held, n = [], 0
    if held:
        yield flush()


def _built(sent: DataFrame, shards: int, build) -> list[tuple]:
    """Merge each shard's rows where they meet; one small row per shard comes to the driver."""
    out = sent.repartition(shards, "shard").sortWithinPartitions("shard")

    def run(batches):
        shard, rows, done = None, [], []
        for b in batches:
            for s, body in zip(b.column("shard").to_pylist(), b.column("body").to_pylist(), strict=True):
                if s != shard and rows:
                    done.append((shard, *build(shard, rows)))
                    rows = []
                shard = s
                rows.append(body)
        if rows:
            done.append((shard, *build(shard, rows)))
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.int64()) for i in range(3)], names=["shard", "n", "total"])

    with tidy(sent.sparkSession):
        return sorted(tuple(r) for r in out.mapInArrow(run, "shard long, n long, total long").collect())


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> Model:
    """Count, smooth and write the trie of the texts that are not held out."""
    spark = docs.sparkSession
    ship(spark)
    root = _local(scratch(spark, "lm-trie"))
    os.makedirs(root, exist_ok=True)
    rows = docs.where(~held_out(F.col(id_col))).select(F.col(text_col).alias("body"))
    size = rows.agg(F.sum(F.octet_length("body"))).collect()[0][0] or 0
    n1 = max(1, int(size // (4 * SHARD_TOKENS)))

    def words(held):
        return _sent(token_hashes(held)[0], None, lambda h: _word_shard(h, n1))

    def write_words(shard, bodies):
        name, _, count = _received(bodies, np.uint64)
        _write(f"{root}/1-{shard}", {"hash": name, "count": count})
        return len(name), int(count.sum())

    sizes = {s: (n, t) for s, n, t in _built(rows.mapInArrow(lambda it: _gather(it, words), "shard long, body binary"), n1, write_words)}
    for s in range(n1):
        if s not in sizes:
            _write(f"{root}/1-{s}", {"hash": np.zeros(0, np.uint64), "count": np.zeros(0, np.int64)})
    model = Model(root, sum(t for _, t in sizes.values()), [sizes.get(s, (0, 0))[0] for s in range(n1)], [], [])
    for level in range(2, order + 1):
        model = _level(model, rows, level, n1)
    return model


def _level(model: Model, rows: DataFrame, level: int, shards: int) -> Model:
    """One more level: shards are equal ranges of context numbers."""
    contexts = model.vocab if level == 2 else sum(model.grams[-1])
    per = max(1, -(-contexts // shards))
    bound = list(range(0, max(contexts, 1), per))

    def grams(held):
        h, first = token_hashes(held)
        names, back = np.unique(h, return_inverse=True)
        number = model.word_numbers(names)[0][back]
        gram = number
        for got, _ in model.walk(number, first, level - 1):
            gram = got
        inside = np.ones(len(h), bool)
        inside[first] = False
        for k in range(1, level - 1):  # a text's first level - 1 tokens have too short a context
            inside[np.minimum(first + k, len(h) - 1)[first + k < np.r_[first[1:], len(h)]]] = False
        at = np.flatnonzero(inside)
        return _sent(gram[at - 1], number[at], lambda c: c // per)

    def write(shard, bodies):
        c, w, n = _received(bodies, np.int64)
        own = min(per, contexts - shard * per)
        inner = c - bound[shard]
        total = np.bincount(inner, weights=n, minlength=own)
        kinds = np.bincount(inner, minlength=own)
        weight = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        shorter = _shorter(model, level, c, w)
        p = np.maximum(n - DISCOUNT, 0) / total[inner] + weight[inner] * shorter
        book, code = _codebook(np.log10(p))
        wbook, wcode = _codebook(np.log10(weight))
        bits, low, high, zeros = EliasFano.parts(inner.astype(np.uint64) * np.uint64(model.vocab) + w.astype(np.uint64), own * model.vocab)
        _write(f"{model.root}/{level}-{shard}", {"bits": np.array([bits]), "low": low, "high": high, "zeros": zeros, "p": code, "book": book, "w": wcode, "wbook": wbook})
        return len(c), int(n.sum())

    done = {s: n for s, n, _ in _built(rows.mapInArrow(lambda it: _gather(it, grams), "shard long, body binary"), len(bound), write)}
    for s in range(len(bound)):
        if s not in done:
            none = np.zeros(0, np.uint64)
            book = np.zeros(1)
            own = min(per, contexts - s * per)
            _write(f"{model.root}/{level}-{s}", {"bits": np.array([0]), "low": none, "high": none, "zeros": none.astype(np.int64), "p": np.zeros(0, np.uint8), "book": book, "w": np.zeros(max(own, 0), np.uint8), "wbook": book})
    return Model(model.root, model.tokens, model.words, [*model.bounds, bound], [*model.grams, [done.get(s, 0) for s in range(len(bound))]])


def _shorter(model: Model, level: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """P(word | the context without its first word), from the levels below."""
    count = np.zeros(len(word), np.int64)
    for s, who in _by_shard(np.searchsorted(model.word_base, word, "right") - 1):
        count[who] = _mapped(f"{model.root}/1-{s}")["count"][word[who] - model.word_base[s]]
    logp = model.unigram(count)
    if level == 2:
        return 10**logp
    # the context's own words, read back from the trie once, then the chain of shorter contexts
    names, back = np.unique(context, return_inverse=True)
    tail = [t[back] for t in _spell(model, level - 1, names)[1:]]
    if len(tail) == 1:  # look-ups in order run through the files
        order = np.lexsort((word, tail[0]))
        got, p = model.find(2, tail[0][order], word[order])
        lost = np.flatnonzero(got < 0)
        p[lost] = logp[order][lost] + model.backoff(2, tail[0][order][lost])
        logp[order] = p
        return 10**logp
    chains = [tail[-k:] for k in range(1, len(tail) + 1)]
    for k, chain in enumerate(chains, 2):
        gram = chain[0]
        for depth, nxt in enumerate(chain[1:], 2):
            gram = model.find(depth, gram, nxt)[0]
        got, p = model.find(k, gram, word)
        logp = np.where(got >= 0, p, logp + model.backoff(k, gram))
    return 10**logp


def _spell(model: Model, level: int, gram: np.ndarray) -> list[np.ndarray]:
    """The word numbers of grams, first word first: entry i of a level gives context and last word."""
    out = []
    while level > 1:
        base, bound = model.gram_base[level - 2], model.bounds[level - 2]
        word, context = np.zeros(len(gram), np.int64), np.zeros(len(gram), np.int64)
        for s, who in _by_shard(np.searchsorted(base, gram, "right") - 1):
            f = _mapped(f"{model.root}/{level}-{s}")
            ef = EliasFano(len(f["p"]), int(f["bits"][0]), f["low"], f["high"], f["zeros"])
            i = gram[who] - base[s]
            value = (_select_one(ef, i) - i).astype(np.uint64) << np.uint64(ef.low_bits) | ef.lows(i)
            word[who] = (value % np.uint64(model.vocab)).astype(np.int64)
            context[who] = (value // np.uint64(model.vocab)).astype(np.int64) + bound[s]
        out.append(word)
        gram, level = context, level - 1
    return [gram, *out[::-1]]


def _select_one(ef: EliasFano, k: np.ndarray) -> np.ndarray:
    """Position of the k-th one of the high bitmap, from 0."""
    ones = np.arange(len(ef.zeros), dtype=np.int64) * 64 - ef.zeros
    word = np.searchsorted(ones, k, "right") - 1
    return word * 64 + _in_word(ef.high[word], k - ones[word])


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row."""
    base = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("body"))

    def run(batches):
        for b in tb.sliced(batches, 4096):
            parts = [model.score(raws) for raws in _texts(b, SCORE_BYTES)]
            if not parts:
                continue
            many, known, plain, logp = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(many.astype(np.int64)), pa.array(known), pa.array(np.full(len(many), model.tokens, np.int64)), pa.array(plain), pa.array(logp)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
