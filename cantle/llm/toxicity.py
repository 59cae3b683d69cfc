"""Toxicity as an ordinal severity: cumulative-link regression over sparse word features.

A text's features are the words it holds, each with log(1 + count). One weight vector serves
all grades: P(grade <= k) is logistic(threshold_k - w.x) with ordered thresholds. The fit is by
proximal gradient steps with an L1 penalty, so most words get no weight and a long clean text
gathers no score. A text's expected severity is the sum over k of P(grade > k).

Words are identified by 64-bit hashes of their lower-cased letters and digits, not by buckets,
so an unseen word never shares a weight. The fit sees at most ``SAMPLE_ROWS`` labelled texts,
those with the least hash of their id, and every word of theirs that can get a weight: a word whose
summed feature is no more than the L1 penalty times the number of texts has a gradient that never
exceeds the penalty, so its weight is 0 in any fit, and Spark's count of words leaves it out. The
driver gets the sample as word numbers, four bytes a number and four a feature, one partition after
another. All texts are scored.

Edge cases: null and empty texts, and those without any known word, get the base severity, grade 0
and are never toxic; labels that are
null are unlabelled, repeated labels of an id count as their largest; with no labelled text, or
only one grade, all severities are 0; repeated rows are scored alike; an empty table gives an
empty result; extra columns are ignored by ``severity`` and kept by ``drop_toxic``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cantle.llm import textbytes as tb
from cantle.session import materialise, ship, trim

#: Labelled texts used to fit, at most.
SAMPLE_ROWS = 16000
#: Grades count tokens of words that occur in so many sampled texts.
LEAST_TEXTS = 3
PENALTY = 5e-5
#: The fit stops after so many steps, or once no weight moves by more than STILL in a step.
STEPS = 1000
STILL = 2e-5
#: Neighbouring thresholds stay so far apart at least.
GAP = 0.05
#: Texts with at least this probability of a grade above 0 are toxic.
REJECT = 0.3


@dataclass
class OrdinalModel:
    words: np.ndarray  # sorted 64-bit hashes
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than grades

    def above(self, eta: np.ndarray) -> np.ndarray:
        """P(grade > k) per text and threshold."""
        return 1 / (1 + np.exp(-np.clip(eta[:, None] - self.thresholds[None, :], -40, 40)))


def bags(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, word hash, count) of each text's distinct words."""
    who, what, many = [], [], []
    for first, raws in tb.chunks(texts):
        buf, begin = tb.pack(raws)
        buf = tb.lower(buf)
        start, end = tb.words(buf, "alnum")
        if not len(start):
            continue
        h = tb.word_hashes(buf, start, end)
        doc = np.searchsorted(begin, start, "right") - 1
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
        at = np.flatnonzero(new)
        who.append(first + doc[at])
        what.append(h[at])
        many.append(np.diff(np.r_[at, len(h)]))
    if not who:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(who), np.concatenate(what), np.concatenate(many)


def matched(texts: list[str | None], model: OrdinalModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, feature number, count) of the words that the model knows."""
    who, what, many = [], [], []
    known = model.words
    for first, raws in tb.chunks(texts):
        if not len(known):
            break
        buf, begin = tb.pack(raws)
        buf = tb.lower(buf)
        start, end = tb.words(buf, "alnum")
        h = tb.word_hashes(buf, start, end)
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        hit = np.flatnonzero(known[at] == h)
        doc = np.searchsorted(begin, start[hit], "right") - 1
        key, n = np.unique((first + doc) * len(known) + at[hit], return_counts=True)
        who.append(key // len(known))
        what.append(key % len(known))
        many.append(n)
    if not who:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(who), np.concatenate(what), np.concatenate(many)


class _Sparse:
    """A matrix of non-negative features by row and by column, for products with either side."""

    def __init__(self, at: np.ndarray, col: np.ndarray, x: np.ndarray, width: int):
        """``at``: where each row begins, and the end; ``col`` and ``x``: columns and features, row by row."""
        self.rows, self.width = len(at) - 1, width
        self.full = np.flatnonzero(np.diff(at))
        self.at, self.col, self.x = at[self.full], col, x
        order = np.argsort(col, kind="stable").astype(np.int32)
        owner = np.repeat(np.arange(self.rows, dtype=np.int32), np.diff(at))
        self.own, self.down = owner[order], x[order]
        many = np.bincount(col, minlength=width)
        self.used = np.flatnonzero(many)
        self.start = (np.cumsum(many) - many)[self.used]

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.rows, np.float64)
        if len(self.full):
            out[self.full] = np.add.reduceat(self.x * w.astype(np.float32)[self.col], self.at)
        return out

    def back(self, r: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width, np.float64)
        if len(self.used):
            out[self.used] = np.add.reduceat(self.down * r.astype(np.float32)[self.own], self.start)
        return out


def nothing_learnt(grades: int = 1) -> OrdinalModel:
    return OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.full(max(1, grades - 1), 40.0))


def _logistic(t: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(t, -40, 40)))


def fit_sparse(names: np.ndarray, m: _Sparse, grade: np.ndarray, penalty: float | None = None) -> OrdinalModel:
    """Weights and thresholds from features of the words ``names`` and grades 0, 1, ... of the texts."""
    penalty = PENALTY if penalty is None else penalty
    n, d = len(grade), len(names)
    grades = int(grade.max()) + 1 if n else 1
    if grades < 2 or not (grade == 0).any() or not d:
        return nothing_learnt(grades)
    probe, size = np.ones(d), 0.0
    for _ in range(12):  # the largest curvature, for the step length
        probe = m.back(m.times(probe))
        size = np.linalg.norm(probe)
        probe /= max(size, 1e-30)
    step = 1 / (0.5 * size / n + 1e-9)

    shares = np.array([(grade > k).mean() for k in range(grades - 1)]).clip(1e-4, 1 - 1e-4)
    theta = np.log((1 - shares) / shares)
    w, seen, momentum = np.zeros(d), np.zeros(d), 1.0
    lower_at, upper_at = np.maximum(grade - 1, 0), np.minimum(grade, grades - 2)
    top, bottom = grade == grades - 1, grade == 0
    for _ in range(STEPS):
        eta = m.times(seen)
        hi = np.where(top, 1.0, _logistic(theta[upper_at] - eta))
        lo = np.where(bottom, 0.0, _logistic(theta[lower_at] - eta))
        p = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        ahead = seen - step * m.back(1 - hi - lo) / n
        ahead = np.sign(ahead) * np.maximum(np.abs(ahead) - step * penalty, 0)
        later = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        moved = np.abs(ahead - w).max()
        seen = ahead + (momentum - 1) / later * (ahead - w)
        w, momentum = ahead, later
        slope = np.bincount(lower_at[~bottom], dlo[~bottom], grades - 1) - np.bincount(upper_at[~top], dhi[~top], grades - 1)
        before = theta
        theta = theta - np.clip(slope / n / np.maximum(shares * (1 - shares), 0.02), -0.1, 0.1)
        theta = np.maximum.accumulate(theta - GAP * np.arange(grades - 1)) + GAP * np.arange(grades - 1)
        if max(moved, np.abs(theta - before).max()) < STILL:
            break
    kept = np.flatnonzero(w)
    return OrdinalModel(names[kept], w[kept], theta)


def fit(row: np.ndarray, word: np.ndarray, count: np.ndarray, grade: np.ndarray) -> OrdinalModel:
    """The same from (text number, word hash, count), in the order of texts."""
    names, col = np.unique(word, return_inverse=True)
    at = np.r_[0, np.cumsum(np.bincount(row, minlength=len(grade)))]
    return fit_sparse(names, _Sparse(at, col.astype(np.int32), np.log1p(count).astype(np.float32), len(names)), grade)


def dose_grades(dose: np.ndarray, toxic: np.ndarray, grades: int = 3) -> np.ndarray:
    """Ordered grades: toxic texts ranked by dose and cut into equal parts; other texts have grade 0."""
    out = np.zeros(len(toxic), np.int64)
    if not toxic.any():
        return out
    cuts = np.quantile(dose[toxic > 0], [k / grades for k in range(1, grades)])
    out[toxic > 0] = 1 + np.searchsorted(cuts, dose[toxic > 0], "left")
    # grades in use stay gapless
    return np.unique(out, return_inverse=True)[1] if (out == 0).any() else out


def tied(texts: np.ndarray, toxic_texts: np.ndarray) -> np.ndarray:
    """Words tied to the label: in LEAST_TEXTS texts or more, at least four in five of them toxic."""
    return (toxic_texts >= 0.8 * texts) & (texts >= LEAST_TEXTS)


def severity_grades(row: np.ndarray, word: np.ndarray, count: np.ndarray, toxic: np.ndarray, grades: int = 3) -> np.ndarray:
    """Grades from 0/1 labels: a text's dose is its number of tokens of words tied to the label."""
    if not len(word):
        return toxic.astype(np.int64)
    _, column, texts = np.unique(word, return_inverse=True, return_counts=True)
    hot = tied(texts, np.bincount(column, weights=toxic[row]))
    return dose_grades(np.bincount(row, weights=np.where(hot[column], count, 0), minlength=len(toxic)), toxic, grades)


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``label, text`` of at most SAMPLE_ROWS labelled rows, those with the least ranks."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS)
    rank = F.xxhash64(F.col("id"), F.col("text"))
    joined = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id").select("label", "text", rank.alias("rank"))
    # repeated ids can give more rows than labels: the least ranks, cut at a value
    ranks = joined.select("rank").orderBy("rank").limit(SAMPLE_ROWS + 1).toArrow().column("rank")
    return joined if len(ranks) <= SAMPLE_ROWS else joined.where(F.col("rank") < ranks[SAMPLE_ROWS].as_py())


def _word_totals(sample: DataFrame) -> DataFrame:
    """``h, texts, toxic_texts, mass`` of each word of the sample, summed up in each batch first."""

    def run(batches):
        for b in tb.sliced(batches):
            who, what, many = bags(b.column("text").to_pylist())
            if not len(what):
                continue
            label = b.column("label").to_numpy(zero_copy_only=False) > 0
            names, back = np.unique(what, return_inverse=True)
            out = [names.view(np.int64), np.bincount(back), np.bincount(back, label[who]).astype(np.int64), np.bincount(back, np.log1p(many))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["h", "texts", "toxic_texts", "mass"])

    rows = sample.mapInArrow(run, "h long, texts long, toxic_texts long, mass double")
    return rows.groupBy("h").agg(F.sum("texts").alias("texts"), F.sum("toxic_texts").alias("toxic_texts"), F.sum("mass").alias("mass"))


def _numbered(sample: DataFrame, names: np.ndarray, hot: np.ndarray) -> DataFrame:
    """``rank, label, dose, words, x`` per text: numbers among ``names`` (int32) and log(1 + count) (float32)."""
    sent = sample.sparkSession.sparkContext.broadcast((names, hot))

    def run(batches):
        known, warm = sent.value
        for b in tb.sliced(batches):
            who, what, many = bags(b.column("text").to_pylist())
            at = np.minimum(np.searchsorted(known, what), len(known) - 1)
            hit = known[at] == what
            who, at, many = who[hit], at[hit], many[hit]
            dose = np.bincount(who, np.where(warm[at], many, 0), b.num_rows)
            cut = np.r_[0, np.cumsum(np.bincount(who, minlength=b.num_rows))]
            number, x = at.astype(np.int32), np.log1p(many).astype(np.float32)
            parts = [[v[i:j].tobytes() for i, j in zip(cut, cut[1:], strict=False)] for v in (number, x)]
            yield pa.RecordBatch.from_arrays([b.column("rank"), b.column("label"), pa.array(dose), *[pa.array(p, pa.binary()) for p in parts]], names=["rank", "label", "dose", "words", "x"])

    return sample.mapInArrow(run, "rank long, label int, dose double, words binary, x binary")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> OrdinalModel:
    """Fit on the labelled texts among ``docs``; what reaches the driver is bounded by SAMPLE_ROWS."""
    ship(docs.sparkSession)
    sample = _sample(docs, labels, id_col, text_col, label_col)
    many = sample.count()
    weighty = (F.col("mass") > PENALTY * many) | (F.col("texts") >= LEAST_TEXTS)
    totals = _word_totals(sample).where(weighty).toArrow()
    if not totals.num_rows:
        return nothing_learnt()
    names = totals.column("h").to_numpy().view(np.uint64)
    order = np.argsort(names)
    names = names[order]
    hot = tied(totals.column("texts").to_numpy()[order], totals.column("toxic_texts").to_numpy()[order])
    del totals, order
    rank, label, dose, words, x = [], [], [], [], []
    for r in materialise(_numbered(sample, names, hot)).toLocalIterator():
        rank.append(r["rank"])
        label.append(r["label"])
        dose.append(r["dose"])
        words.append(np.frombuffer(r["words"], np.int32))
        x.append(np.frombuffer(r["x"], np.float32))
    order = np.argsort(np.array(rank), kind="stable")
    toxic = (np.array(label)[order] > 0).astype(np.int64)
    at = np.r_[0, np.cumsum([len(words[i]) for i in order])]
    col, feature = np.concatenate([words[i] for i in order]), np.concatenate([x[i] for i in order])
    del words, x
    model = fit_sparse(names, _Sparse(at, col, feature, len(names)), dose_grades(np.array(dose)[order], toxic))
    del col, feature
    trim()
    return model


SCORES = "severity double, grade int, p_toxic double, toxic int"


def severity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Per row: expected severity, likeliest grade, P(grade > 0) and the 0/1 decision.

    With ``keep`` the columns of ``docs`` stay; of clashing names the new one stays.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    new = T._parse_datatype_string(SCORES)
    base = docs.drop(*new.fieldNames()) if keep else docs.select(id_col, text_col)
    left = [f for f in base.schema.fields if keep or f.name == id_col]
    kinds = [pa.float64(), pa.int32(), pa.float64(), pa.int32()]

    def run(batches):
        m = sent.value
        for b in tb.sliced(batches):
            who, what, many = matched(b.column(text_col).to_pylist(), m)
            eta = np.bincount(who, weights=m.weights[what] * np.log1p(many), minlength=b.num_rows) if len(who) else np.zeros(b.num_rows)
            above = m.above(eta)
            mass = np.c_[np.ones(len(above)), above] - np.c_[above, np.zeros(len(above))]
            told = np.bincount(who, minlength=b.num_rows) > 0
            out = [above.sum(1), np.where(told, mass.argmax(1), 0), above[:, 0], told & (above[:, 0] >= REJECT)]
            yield pa.RecordBatch.from_arrays([b.column(f.name) for f in left] + [pa.array(a.astype(k.to_pandas_dtype()), k) for a, k in zip(out, kinds, strict=True)], names=[f.name for f in left] + new.fieldNames())

    return base.mapInArrow(run, T.StructType(left + new.fields))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not toxic, with their columns as they are."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    text, key = names[docs.columns.index(text_col)], names[docs.columns.index(id_col)]
    scored = severity(docs.toDF(*names), train(docs, labels, id_col, text_col), key, text, keep=True)
    return scored.where("toxic = 0").select(*[F.col(n).alias(o) for n, o in zip(names, docs.columns, strict=True)])
