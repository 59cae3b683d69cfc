"""Byte-level BPE by speculation: propose greedily, verify all adjacent pairs, repair the rest.

A word's tokens are proposed by greedy longest match. A proposal is the true merge result
exactly if every token is the merge result of its own bytes and no adjacent pair would have
merged across its boundary. The first holds for each vocabulary entry that a merge creates;
the second is tested for all pairs of a batch at once, by walking the facing edges of the two
tokens' merge trees in numpy. Only words with a failing pair go through exact merging.

Edge cases: null text is empty text (no tokens, empty decoded text); the special tokens of the
file are recognised in the text as the file says; very long words merge through a heap, in
n log n; equal rows give equal results; other columns are passed through untouched, and an
output name that clashes with an input column replaces it.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cantle.llm import textbytes as tb
from cantle.session import ship, trim

# Fixed value: the public pre-tokenisation pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept per Python worker between batches; a full cache is emptied, which only costs time.
CACHE_WORDS = 600_000
#: Bytes up to which failing words are merged many at a time; longer ones go through a heap.
SHORT_WORD = 48
#: Failing words that are merged together, as each takes a row as wide as the longest.
TOGETHER = 4096
#: Characters handled at a time inside a batch.
SLICE_CHARS = 1_000_000


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte in vocabulary files, built by the published rule."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Table:
    """Whole numbers by 64-bit key: open hashing over arrays, so that many keys are looked up at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(4 * max(1, len(keys))).bit_length())
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.none = np.int64(-1)
        while len(keys):
            # of keys with one slot the last stays, the others go to the next level
            slot = self._slot(keys, len(self.levels))
            held = np.full(1 << self.bits, -1, np.int64)
            held[slot] = np.arange(len(keys))
            at, used = held[slot] == np.arange(len(keys)), held >= 0
            level_keys, level_values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
            level_keys[used], level_values[used] = keys[held[used]], values[held[used]]
            self.levels.append((level_keys, level_values))
            keys, values = keys[~at], values[~at]

    def _slot(self, keys: np.ndarray, level: int) -> np.ndarray:
        spread = (keys.astype(np.uint64) + np.uint64(level)) * np.uint64(0x9E3779B97F4A7C15 + 2 * level)
        return (spread >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, or -1."""
        out = np.full(len(keys), -1, np.int32)
        open_ = None
        for level, (names, values) in enumerate(self.levels):
            asked = keys if open_ is None else keys[open_]
            slot = self._slot(asked, level)
            found = names[slot]
            hit = found == asked
            if open_ is None:
                out = np.where(hit, values[slot], -1)
                open_ = np.flatnonzero(~hit & (found >= 0))
            else:
                out[open_[hit]] = values[slot[hit]]
                open_ = open_[~hit & (found >= 0)]
            if not len(open_):
                break
        return out


def _spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each span, one span after another."""
    total = int(length.sum())
    jump = np.repeat(start - (np.cumsum(length) - length), length)
    return jump + np.arange(total)


def _room(array: np.ndarray, used: int, wanted: int) -> np.ndarray:
    """The array, or a longer one with its first entries."""
    if wanted <= len(array):
        return array
    out = np.zeros(max(1 << 16, 2 * wanted), array.dtype)
    out[:used] = array[:used]
    return out


class _Numbers(dict):
    """Numbers for names, given out as names are asked for."""

    def __init__(self, count):
        self.count, self.fresh, self.given = count, [], []

    def __missing__(self, name: str) -> int:
        self[name] = n = next(self.count)
        self.fresh.append(name)
        self.given.append(n)
        return n

    def taken(self) -> tuple[list[str], list[int]]:
        """The names that are new since the last call, and their numbers."""
        out = self.fresh, self.given
        self.fresh, self.given = [], []
        return out


class SpeculativeBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, spec: bytes):
        doc = json.loads(spec)
        vocab, merges = doc["model"]["vocab"], doc["model"]["merges"]
        alphabet = byte_alphabet()
        size = max([*vocab.values(), *(t["id"] for t in doc.get("added_tokens", []))]) + 1
        self.bytes = [b""] * size
        for s, i in vocab.items():
            self.bytes[i] = bytes(alphabet[c] for c in s) if all(c in alphabet for c in s) else s.encode()
        self.special = {t["content"]: t["id"] for t in doc.get("added_tokens", [])}
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        # each id in decimal with a comma, filled up with zero bytes
        self.decimal = np.array([f"{i},".encode() for i in range(size)])
        self.byte_id = np.array([vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])], np.int64)
        # merge trees: when a token is made, and of what; single bytes are there from the start
        self.rank = np.full(size, -1, np.int64)
        self.left = np.full(size, -1, np.int64)
        self.right = np.full(size, -1, np.int64)
        self.pair_rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, m in enumerate(merges):
            a, b = m if isinstance(m, (list, tuple)) else m.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.pair_rank.setdefault((x, y), (r, z))
            if self.rank[z] < 0:
                self.rank[z], self.left[z], self.right[z] = r, x, y
        self.made_by = np.full(len(merges) + 1, -1, np.int64)
        for r, z in self.pair_rank.values():
            self.made_by[r] = z
        keys = np.array([(x << 32) | y for x, y in self.pair_rank], np.int64)
        self.pairs = _Table(keys, np.array([r for r, _ in self.pair_rank.values()], np.int32))
        made = {self.bytes[i]: int(i) for i in self.byte_id} | {self.bytes[z]: int(z) for z in np.flatnonzero(self.rank >= 0)}
        # proposals use only tokens that are the merge result of their own bytes
        self._trie({b: i for b, i in made.items() if len(b) == 1 or self.merge(b) == [i]})
        # the pair test presumes that a merge comes after those that make its two sides
        self.regular = all(r > self.rank[x] and r > self.rank[y] for (x, y), (r, _) in self.pair_rank.items())
        self.words = regex.compile(PATTERN)
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.crowded = regex.compile(r" \s|\s ")
        self.most = CACHE_WORDS
        self._forget()

    def _trie(self, known: dict[bytes, int]) -> None:
        """A number for each prefix of a known token, the steps between them, and the token at each, or -1."""
        nodes = {b"": 0}
        for b in known:
            for n in range(1, len(b) + 1):
                nodes.setdefault(b[:n], len(nodes))
        self.token_at = np.full(len(nodes), -1, np.int64)
        for b, i in known.items():
            self.token_at[nodes[b]] = i
        steps = np.array([(nodes[b[:-1]] << 8) | b[-1] for b in nodes if b], np.int64)
        self.steps = _Table(steps, np.array([n for b, n in nodes.items() if b], np.int32))

    # -- speculation -------------------------------------------------------------------------
    def propose(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of the words buf[start:end], all words one byte further at a time:
        (word number, token), in order."""
        word, pos, stop = np.arange(len(start)), start.copy(), end
        word, pos, stop = word[pos < stop], pos[pos < stop], stop[pos < stop]
        at, node = pos.copy(), np.zeros(len(word), np.int64)
        best, best_end = np.full(len(word), -1, np.int64), pos.copy()
        owners, tokens = [], []
        while len(word):
            inside = at < stop
            step = self.steps.get((node << 8) | buf[np.minimum(at, len(buf) - 1)])
            go = inside & (step >= 0)
            node = np.where(go, step, 0)
            at = at + go
            token = self.token_at[node]
            better = go & (token >= 0)
            best, best_end = np.where(better, token, best), np.where(better, at, best_end)
            stuck = np.flatnonzero(~go)
            if len(stuck):
                owners.append(word[stuck])
                tokens.append(best[stuck])
                at[stuck] = best_end[stuck]
                if (best_end[stuck] >= stop[stuck]).any():
                    left = go | (best_end < stop)
                    word, stop, at, node, best, best_end = word[left], stop[left], at[left], node[left], best[left], best_end[left]
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        token = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        return owner[order], token[order]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair, whether its tokens stay apart when their bytes stand side by side.

        Along the boundary, the piece on the left is a node of the right edge of a's tree, from
        its own merge until its parent's; likewise on the right. Going back in time, undo the
        later of the two merges and look whether the facing pieces had a merge of their own
        before either was absorbed. Equal ranks go to the leftmost pair.
        """
        never = np.int64(1) << 40
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        x, y = a.copy(), b.copy()
        until_x = np.full(len(a), never)
        until_y = np.full(len(a), never)
        while live.size:
            found = self.pairs.get((x << 32) | y).astype(np.int64)
            r = np.where(found >= 0, found, never)
            clash = (r < until_x) & (r <= until_y) & (r < never)
            ok[live[clash]] = False
            rx, ry = self.rank[x], self.rank[y]
            undo_x = rx > ry  # of two equal merges the left one came first, so the right goes back first
            done = clash | ((rx < 0) & (ry < 0))
            until_x = np.where(undo_x, rx, until_x)
            until_y = np.where(undo_x, until_y, ry)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
            keep = ~done
            live, x, y, until_x, until_y = live[keep], x[keep], y[keep], until_x[keep], until_y[keep]
        return ok

    # -- exact merging -------------------------------------------------------------------------
    def merge(self, word: bytes) -> list[int]:
        """Lowest rank first, leftmost first among equals, through a heap over a linked list."""
        ids: list[int] = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(p[0], i, ids[i], ids[i + 1], p[1]) for i in range(n - 1) if (p := self.pair_rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y, z = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j < 0 or ids[j] != y:
                continue
            ids[i], ids[j] = z, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if p := self.pair_rank.get((z, ids[k])):
                    heapq.heappush(heap, (p[0], i, z, ids[k], p[1]))
            if (h := before[i]) >= 0 and (p := self.pair_rank.get((ids[h], z))):
                heapq.heappush(heap, (p[0], h, ids[h], z, p[1]))
        return [t for t in ids if t >= 0]

    def merge_many(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for many words of at most SHORT_WORD bytes at once: one merge of each word at a time.
        (word number, token), in order."""
        never = np.iinfo(np.int32).max
        n, width = len(start), int((end - start).max(initial=1))
        cols = np.arange(width)
        filled = cols[None, :] < (end - start)[:, None]
        ids = np.full((n, width), -1, np.int64)
        ids[filled] = self.byte_id[buf[_spans(start, end - start)]]
        after = np.where(filled & (cols[None, :] + 1 < (end - start)[:, None]), cols[None, :] + 1, -1)
        before = np.broadcast_to(cols - 1, (n, width)).copy()
        rank = np.full((n, width), never, np.int32)
        r, c = np.nonzero(after >= 0)
        found = self.pairs.get((ids[r, c] << 32) | ids[r, c + 1])
        rank[r, c] = np.where(found >= 0, found, never)
        live = np.arange(n)
        while len(live):
            i = rank[live].argmin(1)
            best = rank[live, i]
            going = best < never
            live, i, best = live[going], i[going], best[going]
            if not len(live):
                break
            z, j = self.made_by[best], after[live, i]
            k = after[live, j]
            ids[live, i], ids[live, j] = z, -1
            rank[live, j] = never
            after[live, i] = k
            right = k >= 0
            before[live[right], k[right]] = i[right]
            h = before[live, i]
            left = h >= 0
            keys = np.r_[(z[right] << 32) | ids[live[right], k[right]], (ids[live[left], h[left]] << 32) | z[left]]
            found = self.pairs.get(keys)
            found = np.where(found >= 0, found, never)
            rank[live, i] = never
            rank[live[right], i[right]] = found[: int(right.sum())]
            rank[live[left], h[left]] = found[int(right.sum()) :]
        r, c = np.nonzero(ids >= 0)
        return r, ids[r, c]

    def learn(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the words, one word after another, and how many each has: propose, verify, repair."""
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        buf = np.frombuffer(b"".join(raw), np.uint8)
        end = np.cumsum(size)
        start = end - size
        owner, token = self.propose(buf, start, end)
        if self.regular:
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            bad = np.zeros(len(raw), bool)
            bad[owner[inner[~self.compatible(token[inner], token[inner + 1])]]] = True
        else:
            bad = size > 1
        parts = [(owner[~bad[owner]], token[~bad[owner]])]
        # words of like lengths together, so that rows are filled well
        least = 0
        for most in (8, 16, SHORT_WORD):
            some = np.flatnonzero(bad & (size > least) & (size <= most))
            for at in range(0, len(some), TOGETHER):
                few = some[at : at + TOGETHER]
                r, t = self.merge_many(buf, start[few], end[few])
                parts.append((few[r], t))
            least = most
        for k in np.flatnonzero(bad & (size > SHORT_WORD)):
            t = np.array(self.merge(raw[k]), np.int64)
            parts.append((np.full(len(t), k), t))
        owner, token = (np.concatenate(x) for x in zip(*parts, strict=True))
        return token[np.argsort(owner, kind="stable")].astype(np.int32), np.bincount(owner, minlength=len(raw))

    # -- what is known -------------------------------------------------------------------------
    def _forget(self) -> None:
        """Words and units have numbers in common; arrays keep where each one's tokens are."""
        count = itertools.count()
        self.cache, self.units = _Numbers(count), _Numbers(count)
        self.tokens, self.first, self.many = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.used = 0

    def _put(self, number: np.ndarray, tokens: np.ndarray, many: np.ndarray) -> None:
        self.tokens = _room(self.tokens, self.used, self.used + len(tokens))
        self.tokens[self.used : self.used + len(tokens)] = tokens
        held = int(number.max(initial=-1)) + 1
        self.first, self.many = _room(self.first, len(self.first), held), _room(self.many, len(self.many), held)
        self.first[number], self.many[number] = self.used + np.cumsum(many) - many, many
        self.used += len(tokens)

    def _tokens_of(self, number: np.ndarray) -> np.ndarray:
        return self.tokens[_spans(self.first[number], self.many[number])]

    def _settle(self) -> None:
        """Put down the tokens of all words and units that have a number but none yet."""
        names, number = self.units.taken()
        # a unit of letters alone is one word
        one = [" " + u for u in names if u.isalpha()]
        one_at = [n for u, n in zip(names, number, strict=True) if u.isalpha()]
        more = [self.words.findall(" " + u) for u in names if not u.isalpha()]
        more_at = [n for u, n in zip(names, number, strict=True) if not u.isalpha()]
        size = np.fromiter(map(len, more), np.int64, len(more))
        inner = np.fromiter(map(self.cache.__getitem__, chain.from_iterable(more)), np.int64, int(size.sum()))
        names, number = self.cache.taken()
        raw = [w.encode("utf-8", "surrogatepass") for w in chain(one, names)]
        if raw:
            self._put(np.array([*one_at, *number], np.int64), *self.learn(raw))
        if more:
            many = np.add.reduceat(self.many[inner], np.cumsum(size) - size)
            self._put(np.array(more_at, np.int64), self._tokens_of(inner), many)

    # -- texts -----------------------------------------------------------------------------------
    def encode_arrays(self, texts: list[str]) -> list[np.ndarray]:
        """The token ids of each text."""
        if len(self.units) + len(self.cache) > self.most:
            self._forget()
        word, unit = self.cache.__getitem__, self.units.__getitem__
        number, size = [], []
        for t in texts:
            n = 0
            for kind, part in self._pieces(t):
                if kind == "id":  # special tokens are negative
                    number.append((-1 - part,))
                    n += 1
                else:
                    number.append(map(word if kind == "words" else unit, part))
                    n += len(part)
            size.append(n)
        number = np.fromiter(chain.from_iterable(number), np.int64, sum(size))
        self._settle()
        special = number < 0
        if special.any():
            many = np.ones(len(number), np.int64)
            many[~special] = self.many[number[~special]]
            ids = np.empty(int(many.sum()), np.int32)
            mine = np.repeat(special, many)
            ids[mine], ids[~mine] = -1 - number[special], self._tokens_of(number[~special])
        else:
            many, ids = self.many[number], self._tokens_of(number)
        whole = np.cumsum(np.r_[0, many])[np.cumsum(np.r_[0, size]).astype(np.int64)]
        return [ids[i:j] for i, j in zip(whole, whole[1:], strict=False)]

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        return [x.tolist() for x in self.encode_arrays(texts)]

    def _pieces(self, text: str) -> list[tuple]:
        """(kind, parts): words as the pattern finds them, or units, each a space and what follows up to the next.

        Where every space stands between characters that are no white space, the pattern never
        matches across the start of a unit, so units can be looked up whole.
        """
        if self.split is not None and any(s in text for s in self.special):
            return [x for s in self.split.split(text) if s for x in ([("id", self.special[s])] if s in self.special else self._plain(s))]
        return self._plain(text)

    def _plain(self, text: str) -> list[tuple]:
        if text[-1:] == " " or self.crowded.search(text):
            return [("words", self.words.findall(text))]
        head, *rest = text.split(" ")
        return [("words", self.words.findall(head)), ("units", rest)]

    def joined(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return self.decimal[ids].tobytes().replace(b"\0", b"")[:-1]

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode("utf-8", "replace")


_LOADED: dict[str, SpeculativeBpe] = {}


def load(spec: bytes) -> SpeculativeBpe:
    """One codec per vocabulary and Python worker."""
    key = hashlib.sha256(spec).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = SpeculativeBpe(spec)
    return _LOADED[key]


def _slices(texts: list[str]) -> Iterator[list[str]]:
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t)
        if n >= SLICE_CHARS:
            yield part
            part, n = [], 0
    if part:
        yield part


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def _spec(df: DataFrame, path: str):
    """The vocabulary file, of fixed size, read once on the driver."""
    spark = df.sparkSession
    ship(spark)
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _with(df: DataFrame, fields: list[T.StructField]) -> T.StructType:
    new = {f.name for f in fields}
    return T.StructType([f for f in df.schema.fields if f.name not in new] + fields)


def _emit(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = [i for i, n in enumerate(batch.schema.names) if n not in new]
    return pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + list(new.values()), names=[batch.schema.names[i] for i in kept] + list(new))


def encode(df: DataFrame, path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the token ids of the whole text."""
    spec = _spec(df, path)

    def run(batches):
        codec = load(spec.value)
        for b in tb.sliced(batches):
            ids = [x for part in _slices(_texts(b.column(text_col))) for x in codec.encode_arrays(part)]
            yield _emit(b, {out: pa.array(ids, pa.list_(pa.int32()))})

    return df.mapInArrow(run, _with(df, [T.StructField(out, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text that the ids stand for; null ids give empty text."""
    spec = _spec(df, path)

    def run(batches):
        codec = load(spec.value)
        for b in tb.sliced(batches):
            yield _emit(b, {out: pa.array([codec.decode(x or []) for x in b.column(ids_col).to_pylist()], pa.string())})

    return df.mapInArrow(run, _with(df, [T.StructField(out, T.StringType())]))


def round_trip(df: DataFrame, path: str, text_col: str = "text", keep_ids: bool = False, cache_words: int = CACHE_WORDS) -> DataFrame:
    """``df`` without its text, with the size and digests of its ids and of what they decode to.

    Fewer ``cache_words`` take less memory in each worker, and more time.
    """
    spec = _spec(df, path)
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else []
    narrow = df.drop(*[f.name for f in fields])
    schema = T.StructType([f for f in narrow.schema.fields if f.name != text_col] + fields)

    def run(batches):
        trim()  # of what the worker did before
        codec = load(spec.value)
        codec.most = cache_words
        for b in tb.sliced(batches):
            n, ids_sha, text_sha, kept = [], [], [], []
            for part in _slices(_texts(b.column(text_col))):
                for ids in codec.encode_arrays(part):
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(codec.joined(ids)).hexdigest())
                    text_sha.append(hashlib.sha256(codec.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
                    if keep_ids:
                        kept.append(ids)
            new = {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
            if keep_ids:
                new["ids"] = pa.array(kept, pa.list_(pa.int32()))
            yield _emit(b.drop_columns([text_col]), new)
        codec.most = CACHE_WORDS
        codec._forget()  # the worker may go on with other work
        trim()

    return narrow.mapInArrow(run, schema)
