import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from cantle.llm import packing as pk

PATH = public_tokenizers.path("byte_bpe_50k.json")


def _plain(lengths, room, linear, quadratic):
    """The same rule with plain lists."""
    cost, free, used, out = [0.0] * len(room), list(room), [0] * len(room), []
    for t in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at, n = 0, lengths[t]
        while n:
            fitting = [(cost[s], s) for s in range(len(room)) if free[s] >= n]
            s = min(fitting)[1] if fitting else max(range(len(room)), key=lambda i: (free[i], -i))
            if not free[s]:
                break
            part = min(n, free[s])
            out.append((t, at, part, s, used[s]))
            free[s] -= part
            used[s] += part
            cost[s] += linear * part + quadratic * part * part
            at, n = at + part, n - part
    return out, cost


def test_assignment_equals_plain_lists():
    rng = random.Random(1)
    for _ in range(30):
        lengths = [rng.choice([1, 5, 5, 60, 90, rng.randrange(1, 100)]) for _ in range(rng.randrange(1, 120))]
        total = sum(lengths)
        room = [100] * (total // 100) + pk.powers(total % 100)
        placed, left = pk.assign(lengths, room, 1.0, 0.25)
        assert placed == _plain(lengths, room, 1.0, 0.25)[0] and not left
        placed, left = pk.assign(lengths, [100] * (total // 100), 1.0, 0.25)
        assert sum(p[2] for p in placed) + sum(lengths[t] - at for t, at in left) == total and sum(lengths[t] - at for t, at in left) == total % 100


def test_costs_are_balanced():
    """Attention makes long pieces dear: first fit puts long tails together, the lowest cost spreads them."""
    rng = np.random.default_rng(2)
    lengths = rng.integers(20, 1000, 2000)
    room = [2048] * int(lengths.sum() // 2048)
    free, first_fit, balanced = list(room), np.zeros(len(room)), np.zeros(len(room))
    for n in sorted(lengths.tolist(), reverse=True):
        s = next((i for i, f in enumerate(free) if f >= n), None)
        if s is not None:
            free[s] -= n
            first_fit[s] += pk.LINEAR * n + pk.QUADRATIC * n * n
    placed, left = pk.assign(lengths, room)
    for _, _, n, s, _ in placed:
        balanced[s] += pk.LINEAR * n + pk.QUADRATIC * n * n
    assert balanced.std() < 0.6 * first_fit.std() and balanced.max() < first_fit.max()
    assert len(placed) - len(lengths) < len(room)  # less than a cut a sequence
    assert sum(int(lengths[t]) - at for t, at in left) == int(lengths.sum()) % 2048


def test_every_id_in_exactly_one_piece(spark, monkeypatch):
    monkeypatch.setattr(pk, "GROUP_TOKENS", 6000)
    rng = random.Random(4)
    words = ["alpha", "beta", "Straße", "日本語", " ", "\n", "<|endoftext|>", "123456", "x" * 50, "é"]
    texts = [None, "", " ", "a", "<|endoftext|>"] + [" ".join(rng.choice(words) for _ in range(rng.choice([1, 10, 100, 700, 3000]))) for _ in range(120)]
    texts += ["long " * 60000] + texts[5:15]
    rows = [(i if i != 7 else None, t, 9, "z") for i, t in enumerate(texts)] + [(3, "another text of an id", 9, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int, ids string").repartition(3)
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    got = pk.pack(df, PATH).collect()
    want = sorted((-1 if i is None else i, tuple([*library.encode(t or "", add_special_tokens=False).ids, 1])) for i, t, *_ in rows)

    seqs, docs = {}, {}
    for r in got:
        assert r["length"] == len(r["ids"]) > 0
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        docs.setdefault((-1 if r["doc_id"] is None else r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["ids"]))
    for pieces in seqs.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at == 2048 or at < 2048 and at & (at - 1) == 0
    assert sum(sum(n for _, n in p) == 2048 for p in seqs.values()) >= 0.6 * len(seqs)
    # documents of one id and size (repeated rows) are told apart by their texts alone
    found = []
    for (i, n), pieces in docs.items():
        by_start = {}
        for start, ids in pieces:
            by_start.setdefault(start, []).append(ids)
        assert sum(len(ids) for _, ids in pieces) % n == 0
        if sum(len(ids) for _, ids in pieces) == n:
            found.append((i, tuple(t for _, ids in sorted(pieces) for t in ids)))
    assert sorted(found) == want
    assert pk.pack(df.limit(0), PATH).count() == 0
    digest = pk.pack(df, PATH, keep_ids=False)
    assert digest.columns == pk._FIELDS and digest.count() == len(got)
