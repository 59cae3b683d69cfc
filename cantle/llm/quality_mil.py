"""Quality by attention-based multiple-instance learning.

A text is a bag of passages of ``PASSAGE_WORDS`` words. Every passage is described by its mix of
byte classes, the transitions between them, and how its words repeat, and encoded by a small
tanh layer. Gated attention, softmax of u.(tanh(V h) * sigmoid(W h)), weighs the passages of a
text; a logistic unit scores the weighted sum. Only the text's own label trains all of it,
attention included. No label, language, source or id is an input.

The fit sees at most ``SAMPLE_ROWS`` labelled texts of the training fold (crc32 of the id as
text, modulo 5, not 0), those with the least hash, each with all its passages; every text is scored
over all its passages, too.

Edge cases: null and empty texts are one passage without words; null labels are unlabelled,
repeated labels of an id count as their least; without two classes in the sample every
text gets the share of label 1 (one half without labels); repeated rows are scored alike; an
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantle.llm import textbytes as tb
from cantle.session import materialise, ship

PASSAGE_WORDS = 64
#: Labelled texts used to fit, at most.
SAMPLE_ROWS = 6000
HIDDEN, GATE = 24, 16
EPOCHS, BATCH, RATE = 12, 256, 0.01
ACCEPT = 0.3
CLASSES = 9
FACTS = CLASSES + CLASSES * CLASSES + 6


def _classes() -> np.ndarray:
    t = np.full(256, 7, np.int64)  # other ASCII signs
    t[128:] = 8
    t[[b for b in range(128) if chr(b).islower()]] = 0
    t[[b for b in range(128) if chr(b).isupper()]] = 1
    t[[b for b in range(128) if chr(b).isdigit()]] = 2
    t[list(b" \t")] = 3
    t[list(b"\n\r\x0b\x0c")] = 4
    t[list(b".,;:")] = 5
    t[list(b"?!'\"()-")] = 6
    return t


_CLASS = _classes()


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, facts) of every passage; texts are in order and each has at least one."""
    who, facts = [], []
    for first, raws in tb.chunks(texts):
        buf, begin = tb.pack(raws)
        n = len(raws)
        start, end = tb.words(buf)
        doc = np.searchsorted(begin, start, "right") - 1
        h = tb.word_hashes(tb.lower(buf), start, end)
        many = np.bincount(doc, minlength=n)
        base = np.cumsum(many) - many
        place = np.arange(len(start)) - base[doc]
        per = np.maximum(1, -(-many // PASSAGE_WORDS))
        pbase = np.cumsum(per) - per
        total = int(per.sum())
        owner = np.repeat(np.arange(n), per)
        pid = pbase[doc] + place // PASSAGE_WORDS
        # a passage's bytes reach from its first word to the next passage's
        opens = begin[owner].copy()
        heads = place % PASSAGE_WORDS == 0
        later = heads & (place > 0)
        opens[pid[later]] = start[later]
        ends = np.r_[opens[1:], len(buf)]
        last = np.r_[owner[1:] != owner[:-1], True]
        ends[last] -= 1  # the separator behind each text
        size = np.maximum(ends - opens, 0)

        x = np.zeros((total, FACTS))
        kind = _CLASS[buf]
        where = np.repeat(np.arange(total), np.diff(np.r_[opens, len(buf)]))
        inside = np.ones(len(buf), bool)
        inside[np.r_[begin[1:], len(buf)] - 1] = False
        x[:, :CLASSES] = np.bincount((where * CLASSES + kind)[inside], minlength=total * CLASSES).reshape(total, CLASSES)
        pair = inside[1:] & inside[:-1]
        both = (where[1:] * CLASSES * CLASSES + kind[:-1] * CLASSES + kind[1:])[pair]
        x[:, CLASSES : CLASSES + CLASSES * CLASSES] = np.bincount(both, minlength=total * CLASSES * CLASSES).reshape(total, -1)
        x /= np.maximum(size, 1)[:, None]

        words = np.bincount(pid, minlength=total)
        some = np.maximum(words, 1)
        order = np.lexsort((h, pid))
        new = np.r_[True, (h[order][1:] != h[order][:-1]) | (pid[order][1:] != pid[order][:-1])] if len(h) else np.zeros(0, bool)
        distinct = np.bincount(pid[order][new], minlength=total)
        again = np.zeros(total)
        if len(h) > 1:
            same = (h[1:] == h[:-1]) & (pid[1:] == pid[:-1])
            again = np.bincount(pid[1:][same], minlength=total)
        length = np.bincount(pid, weights=end - start, minlength=total) / some
        x[:, -6] = distinct / some
        x[:, -5] = again / some
        x[:, -4] = length / 10
        x[:, -3] = np.log1p(words) / 4
        x[:, -2] = words == 0
        x[:, -1] = np.bincount(pid, weights=~_alnum_ends(buf, end), minlength=total) / some
        who.append(first + owner)
        facts.append(x.astype(np.float32))
    return np.concatenate(who), np.concatenate(facts)


def _alnum_ends(buf: np.ndarray, end: np.ndarray) -> np.ndarray:
    k = _CLASS[buf[end - 1]]
    return (k <= 2) | (k == 8)


@dataclass
class MilModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray] | None
    prior: float

    def score(self, who: np.ndarray, facts: np.ndarray, n: int) -> np.ndarray:
        if self.weights is None:
            return np.full(n, self.prior)
        x = np.clip((facts - self.mean) * self.scale, -6, 6)
        return _sigmoid(_forward(self.weights, x, np.searchsorted(who, np.arange(n)))[-1])


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -40, 40)))


def _forward(p: dict[str, np.ndarray], x: np.ndarray, at: np.ndarray) -> tuple:
    """``at``: the first passage of each bag."""
    h = np.tanh(x @ p["E"] + p["e"])
    t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["W"])
    raw = (t * g) @ p["u"]
    size = np.diff(np.r_[at, len(x)])
    weight = np.exp(raw - np.repeat(np.maximum.reduceat(raw, at), size))
    weight /= np.repeat(np.add.reduceat(weight, at), size)
    z = np.add.reduceat(weight[:, None] * h, at, axis=0)
    return h, t, g, weight, size, z, z @ p["c"] + p["b"]


def _gradients(p: dict[str, np.ndarray], x: np.ndarray, at: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    h, t, g, a, size, z, logit = _forward(p, x, at)
    d = (_sigmoid(logit) - y) / len(y)
    dz = np.repeat(d, size)[:, None] * p["c"]
    value = (h * dz).sum(1)
    draw = a * (value - np.repeat(np.add.reduceat(a * value, at), size))
    dtg = draw[:, None] * p["u"]
    dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
    dh = (a[:, None] * dz + dt @ p["V"].T + dg @ p["W"].T) * (1 - h * h)
    return {"E": x.T @ dh, "e": dh.sum(0), "V": h.T @ dt, "W": h.T @ dg, "u": (t * g).T @ draw, "c": z.T @ d, "b": np.array([d.sum()])}


def fit(bags: list[np.ndarray], label: np.ndarray, seed: int = 7) -> MilModel:
    """Adam over mini-batches of whole bags, from a fixed seed."""
    if not len(label):
        return MilModel(np.zeros(1), np.ones(1), None, 0.5)
    prior = float(label.mean())
    if prior in (0.0, 1.0):
        return MilModel(np.zeros(1), np.ones(1), None, prior)
    every = np.concatenate(bags)
    mean, scale = every.mean(0), 1 / np.maximum(every.std(0), 1e-3)
    bags = [np.clip((b - mean) * scale, -6, 6).astype(np.float32) for b in bags]
    rng = np.random.default_rng(seed)
    shapes = {"E": (FACTS, HIDDEN), "e": (HIDDEN,), "V": (HIDDEN, GATE), "W": (HIDDEN, GATE), "u": (GATE,), "c": (HIDDEN,), "b": (1,)}
    p = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if k not in "eb" else np.zeros(s) for k, s in shapes.items()}
    p["b"][:] = np.log(prior / (1 - prior))
    m, v, step = {k: np.zeros(s) for k, s in shapes.items()}, {k: np.zeros(s) for k, s in shapes.items()}, 0
    epochs = max(EPOCHS, min(200, -(-300 * BATCH // len(bags))))
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), BATCH):
            part = order[i : i + BATCH]
            size = [len(bags[k]) for k in part]
            grads = _gradients(p, np.concatenate([bags[k] for k in part]).astype(np.float64), np.cumsum(size) - size, label[part])
            step += 1
            for k, gr in grads.items():
                gr = gr + 1e-4 * p[k] * (k not in "eb")
                m[k] = 0.9 * m[k] + 0.1 * gr
                v[k] = 0.999 * v[k] + 0.001 * gr * gr
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return MilModel(mean, scale, p, prior)


def held_out(doc_id) -> F.Column:
    """The held-out fold: crc32 of the id as text, modulo 5, is 0. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> MilModel:
    """Fit on labelled texts of the training fold."""
    ship(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("double").alias("label"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS)
    joined = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id").select(F.xxhash64("id", "text").alias("rank"), "label", "text")

    # repeated ids can give more rows than labels: the least ranks, cut at a value
    ranks = joined.select("rank").orderBy("rank").limit(SAMPLE_ROWS + 1).toArrow().column("rank")
    if len(ranks) > SAMPLE_ROWS:
        joined = joined.where(F.col("rank") < ranks[SAMPLE_ROWS].as_py())

    def run(batches):
        for b in tb.sliced(batches):
            for first, raws in tb.chunks(b.column("text").to_pylist()):
                who, facts = passages([r.decode("utf-8", "surrogatepass") for r in raws])
                at = np.searchsorted(who, np.arange(len(raws) + 1))
                bags = [facts[i:j].tobytes() for i, j in zip(at, at[1:], strict=False)]
                part = b.slice(first, len(raws))
                yield pa.RecordBatch.from_arrays([part.column("rank"), part.column("label"), pa.array(bags, pa.binary())], names=["rank", "label", "bag"])

    rank, label, bags = [], [], []
    for r in materialise(joined.mapInArrow(run, "rank long, label double, bag binary")).toLocalIterator():
        rank.append(r["rank"])
        label.append(float(r["label"] >= 1))
        bags.append(np.frombuffer(r["bag"], np.float32).reshape(-1, FACTS))
    order = np.lexsort((label, rank))
    return fit([bags[i] for i in order], np.array(label)[order])


def scores(docs: DataFrame, model: MilModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted``, one row per row of ``docs``."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    base = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))

    def run(batches):
        for b in tb.sliced(batches):
            out = np.zeros(b.num_rows)
            for first, raws in tb.chunks(b.column("text").to_pylist()):
                who, facts = passages([r.decode("utf-8", "surrogatepass") for r in raws])
                out[first : first + len(raws)] = sent.value.score(who, facts, len(raws))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(out), pa.array((out >= ACCEPT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
