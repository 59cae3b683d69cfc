"""Mixing to target weights with soft domain membership, in DataFrame functions only.

The label table names each labelled text's domain: ``toxic`` (toxic = 1), ``low`` (quality = 0) or
``clean``. A naive Bayes classifier learns from a bounded sample which words and word shapes mark a
domain, and gives every text a posterior p over the domains. A text of n tokens with rate r adds
r * n * p to the domains' expected token totals. Rates minimise the squared distance of these totals
to the targets, subject to 0 <= r <= ``max_rate`` (if given), by projected gradient steps from r = 1.

In the token-weighted inner product the gradient at a text is p.e, with e the totals' error over N,
so a text's rate depends on p alone: it is a chain of clipped steps with the K errors of each
iteration, all constants. An iteration is one aggregation of a few sums over a narrow table, and no
rates are ever stored. The gradient is scaled by the inverse Gram matrix of the texts whose rate is
not at a bound, which the same aggregation sums; a step that does not lower the distance is shortened.

``copies`` realises a rate: floor(r + u) with u uniform, from a hash of id and text.

Edge cases: null and empty texts have no tokens, the prior as posterior, and a rate like any other;
null labels are unlabelled; repeated labels count as the worst; without labelled texts all are clean;
a domain without mass leaves its target unmet; repeated rows get equal rates and copies; an empty
table gives an empty result; extra columns are kept by ``resample`` whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantle.session import materialise

DOMAINS = ("clean", "low", "toxic")
#: Labelled texts used to fit the classifier, at most.
SAMPLE_ROWS = 12000
#: Buckets of each of the two hash tables that hold the evidence of words.
BUCKETS = 1 << 14
#: Evidence counts only from so many standard deviations on, and in at least so many texts.
LEAST_Z, LEAST_TEXTS = 5.0, 4
MAX_RATE = 4.0
STEPS, TOLERANCE = 40, 1e-5


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def _featured(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with ``words`` (all of them) and ``fs``, the text's distinct features: words without
    outer punctuation, what is left of words without their Latin letters, and how much of the text
    is not repetition, in tenths.

    Each step is a column of its own, so that what several later columns use is worked out once.
    """
    df = df.withColumn("low", F.lower(F.coalesce(text, F.lit("")))).withColumn("words", _tokens(F.col("low")))
    shapes = F.transform(F.array_distinct(_tokens(F.translate("low", "abcdefghijklmnopqrstuvwxyz", ""))), lambda s: F.concat(F.lit("\x01"), s))
    df = df.withColumn("forms", F.array_distinct("words")).withColumn("shapes", shapes)
    fresh = F.floor(F.lit(10.0) * F.size("forms") / F.greatest(F.size("words"), F.lit(1)))
    bare = F.transform("forms", lambda w: F.btrim(w, F.lit(".,;:!?()\"'")))
    fs = F.concat(F.array_distinct(bare), "shapes", F.array(F.concat(F.lit("\x02"), fresh.cast("string"))))
    return df.withColumn("fs", fs).drop("low", "forms", "shapes")


def _bucket(feature: Column, table: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(table), feature), F.lit(BUCKETS)).cast("int")


@dataclass
class DomainModel:
    """Log prior odds against clean, the same among texts without evidence, and per domain two
    evidence tables in hundredths."""

    prior: dict[str, float]
    bare: dict[str, float]
    tables: dict[str, list[list[int]]]

    def with_evidence(self, df: DataFrame) -> DataFrame:
        """``df`` (with ``fs``) and a column e_<domain> per known domain."""
        df = df.withColumn("at", F.transform("fs", lambda f: F.struct(_bucket(f, 0).alias("a"), _bucket(f, 1).alias("b"))))
        return df.withColumns({f"e_{d}": F.aggregate("at", F.lit(0), self._added(d)) for d in self.tables}).drop("at")

    def with_posterior(self, df: DataFrame) -> DataFrame:
        """``df`` (with ``fs``) and P(domain) as p_<domain>; the steps are columns, worked out once each."""
        df = self.with_evidence(df)
        odds = {f"o_{d}": F.lit(0.0) for d in DOMAINS[1:]}
        for d in self.tables:
            e = F.col(f"e_{d}")
            odds[f"o_{d}"] = F.exp(F.when(e > 0, F.least(F.lit(self.prior[d]) + e / 100, F.lit(30.0))).otherwise(F.lit(self.bare[d])))
        df = df.withColumns(odds).withColumn("o_all", F.lit(1.0) + F.col("o_low") + F.col("o_toxic"))
        named = {"p_clean": F.lit(1.0) / F.col("o_all"), "p_low": F.col("o_low") / F.col("o_all"), "p_toxic": F.col("o_toxic") / F.col("o_all")}
        return df.withColumns(named).drop("fs", "o_all", *odds, *[f"e_{d}" for d in self.tables])

    def _added(self, domain: str):
        """The fold of the lesser evidence of the two tables."""
        one, two = [F.split(F.lit(",".join(map(str, t))), ",").cast("array<int>") for t in self.tables[domain]]
        return lambda s, x: s + F.least(F.element_at(one, x["a"] + 1), F.element_at(two, x["b"] + 1))


def _labelled(labels: DataFrame, id_col: str) -> DataFrame:
    """``id, domain``, a row per labelled id."""
    known = labels.where(F.col(id_col).isNotNull() & (F.col("quality").isNotNull() | F.col("toxic").isNotNull()))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").alias("t"), F.min("quality").alias("q"))
    domain = F.when(F.col("t") == 1, "toxic").when(F.col("q") == 0, "low").otherwise("clean")
    return known.select("id", domain.alias("domain"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DomainModel:
    """Fit on at most SAMPLE_ROWS labelled texts of ``docs``; the driver gets 2 * BUCKETS counts."""
    known = _labelled(labels, id_col).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")
    found = _featured(texts, F.col("text")).select("domain", "fs")
    # a text counts once for each bucket of either table
    keys = F.array_distinct(F.flatten(F.transform("fs", lambda f: F.array(_bucket(f, 0), _bucket(f, 1) + BUCKETS))))
    counted = found.select("domain", F.explode(F.concat(F.array(F.lit(-1)), keys)).alias("k"))
    rows = counted.groupBy("k").agg(*[F.count_if(F.col("domain") == d).alias(d) for d in DOMAINS]).collect()
    many = {r["k"]: r for r in rows}
    texts_of = {d: many[-1][d] if -1 in many else 0 for d in DOMAINS}
    model = DomainModel({}, {}, {})
    if not texts_of["clean"]:
        return model
    for d in DOMAINS[1:]:
        if not texts_of[d]:
            continue
        model.prior[d] = math.log(texts_of[d] / texts_of["clean"])
        flat = [0] * (2 * BUCKETS)
        for k, r in many.items():
            if k >= 0:
                flat[k] = _evidence(r[d], texts_of[d], r["clean"], texts_of["clean"])
        model.tables[d] = [flat[:BUCKETS], flat[BUCKETS:]]
    if model.tables:  # how often each domain shows no evidence
        none = model.with_evidence(found)
        counts = none.agg(*[F.count_if((F.col("domain") == x) & (F.col(f"e_{d}") == 0)).alias(f"{d}_{x}") for d in model.tables for x in (d, "clean")]).collect()[0]
        model.bare = {d: math.log((counts[f"{d}_{d}"] + 0.5) / (counts[f"{d}_clean"] + 0.5)) for d in model.tables}
    return model


def _evidence(a: int, n: int, b: int, m: int) -> int:
    """Hundredths of log odds for a feature in a of n texts of the domain and b of m clean ones."""
    if a < LEAST_TEXTS:
        return 0
    share = (a + b) / (n + m)
    z = (a / n - b / m) / math.sqrt(max(share * (1 - share), 1e-12) * (1 / n + 1 / m))
    odds = math.log((a + 0.5) / (n + 1)) - math.log((b + 0.5) / (m + 1))
    return int(100 * odds) if z >= LEAST_Z and odds > 0 else 0


@dataclass
class RateFit:
    """The steps of the descent: one coefficient per domain and step."""

    steps: list[list[float]]
    max_rate: float
    totals: list[float]
    targets: list[float]

    def rate(self, p: list[Column]) -> Column:
        r = F.lit(1.0)
        for step in self.steps:
            move = sum((F.lit(a) * q for a, q in zip(step[1:], p[1:], strict=True)), F.lit(step[0]) * p[0])
            r = F.least(F.greatest(r - move, F.lit(0.0)), F.lit(self.max_rate))
        return r


def fit_rates(members: DataFrame, weights: dict[str, float], budget: float = 1.0, max_rate: float | None = MAX_RATE) -> RateFit:
    """``members``: n_tokens and p_<domain> per text. Targets: weights, scaled to budget * all tokens. No bound if ``max_rate`` is None."""
    max_rate = math.inf if max_rate is None else max_rate
    p = [F.col(f"p_{d}") for d in DOMAINS]
    n = F.col("n_tokens").cast("double")
    whole = sum(weights.get(d, 0.0) for d in DOMAINS)
    total = members.agg(F.sum(n)).collect()[0][0] or 0.0
    targets = [budget * weights.get(d, 0.0) / whole for d in DOMAINS]
    fit = RateFit([], max_rate, [0.0] * len(DOMAINS), [t * total for t in targets])
    if not total:
        return fit

    pairs = [(i, j) for i in range(len(p)) for j in range(i, len(p))]

    def measure() -> tuple[list[float], list[float]]:
        """Errors of the shares, and the Gram matrix of the texts whose rate can still move."""
        rate = fit.rate(p)
        free = ((rate > 0) & (rate < max_rate)).cast("double")
        sums = [F.sum(n * rate * q) for q in p] + [F.sum(n * free * p[i] * p[j]) for i, j in pairs]
        values = [v / total for v in members.agg(*sums).collect()[0]]
        fit.totals = [v * total for v in values[: len(p)]]
        return [v - t for v, t in zip(values, targets, strict=False)], values[len(p) :]

    error, gram = measure()
    cost = sum(e * e for e in error)
    damp = 1e-6
    for _ in range(STEPS):
        if max(map(abs, error)) < TOLERANCE or damp > 1e3:
            break
        whole_gram = [[0.0] * len(p) for _ in p]
        for (i, j), v in zip(pairs, gram, strict=True):
            whole_gram[i][j] = whole_gram[j][i] = v
        fit.steps.append(_solve(whole_gram, error, damp))
        totals = fit.totals
        new_error, new_gram = measure()
        new_cost = sum(e * e for e in new_error)
        if new_cost >= cost:  # too long a step: take it back, and come nearer to the plain gradient
            fit.steps.pop()
            fit.totals, damp = totals, damp * 30
            continue
        done = new_cost > cost * (1 - 1e-5)
        error, gram, cost, damp = new_error, new_gram, new_cost, max(damp / 10, 1e-6)
        if done:
            break
    return fit


def _solve(gram: list[list[float]], error: list[float], damp: float) -> list[float]:
    """The gradient's coefficients, scaled by the damped inverse of a K x K Gram matrix."""
    k = len(error)
    m = [[gram[i][j] + damp * (i == j) for j in range(k)] + [error[i]] for i in range(k)]
    for i in range(k):
        top = max(range(i, k), key=lambda r: abs(m[r][i]))
        m[i], m[top] = m[top], m[i]
        for r in range(k):
            if r != i:
                f = m[r][i] / m[i][i]
                m[r] = [x - f * y for x, y in zip(m[r], m[i], strict=True)]
    return [m[i][k] / m[i][i] for i in range(k)]


def _unit(*cols: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(29), *cols), F.lit(1 << 52)) / F.lit(float(1 << 52))


def members(docs: DataFrame, model: DomainModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The narrow table: id, token count, posteriors, and the text's uniform number; written once."""
    base = docs.select(F.col(id_col).alias("doc_id"), _unit(F.col(id_col), F.col(text_col)).alias("u"), F.col(text_col).alias("text"))
    rows = model.with_posterior(_featured(base, F.col("text")))
    return materialise(rows.select("doc_id", F.size("words").cast("long").alias("n_tokens"), *[f"p_{d}" for d in DOMAINS], "u"))


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], budget: float = 1.0, id_col: str = "doc_id", text_col: str = "text", max_rate: float | None = MAX_RATE) -> DataFrame:
    """Per text: token count, posteriors, rate and copies; in every row the domains' expected and target token totals."""
    table = members(docs, train(docs, labels, id_col, text_col), id_col, text_col)
    fit = fit_rates(table, weights, budget, max_rate)
    rated = table.withColumn("rate", fit.rate([F.col(f"p_{d}") for d in DOMAINS]))
    sums = {f"{k}_{d}": F.lit(v) for k, found in (("reached", fit.totals), ("target", fit.targets)) for d, v in zip(DOMAINS, found, strict=True)}
    return rated.withColumn("copies", F.floor(F.col("rate") + F.col("u")).cast("long")).drop("u").withColumns(sums)


def resample(docs: DataFrame, labels: DataFrame, weights: dict[str, float], budget: float = 1.0, id_col: str = "doc_id", text_col: str = "text", keep_clean: bool = False) -> DataFrame:
    """``docs`` with each row as often as its copies say; no shuffle, as a rate needs its own text only.

    With ``keep_clean`` clean texts have a rate of at least 1: those labelled so, and of the unlabelled
    those whose greatest posterior is clean. This looks up the labels, a join by id.
    """
    model = train(docs, labels, id_col, text_col)
    fit = fit_rates(members(docs, model, id_col, text_col), weights, budget)
    names = [f"c{i}" for i in range(len(docs.columns))]
    text, key = names[docs.columns.index(text_col)], names[docs.columns.index(id_col)]
    p = [F.col(f"p_{d}") for d in DOMAINS]
    rows = docs.toDF(*names)
    if keep_clean:
        known = _labelled(labels, id_col).toDF("label_id", "label_domain")
        rows = rows.join(known, F.col(key) == F.col("label_id"), "left")
    rows = model.with_posterior(_featured(rows, F.col(text)))
    rate = fit.rate(p)
    if keep_clean:
        clean = F.coalesce(F.col("label_domain") == "clean", p[0] >= F.greatest(*p[1:]))
        rate = F.when(clean, F.greatest(rate, F.lit(1.0))).otherwise(rate)
    rows = rows.withColumn("copies", F.floor(rate + _unit(F.col(key), F.col(text))).cast("int"))
    rows = rows.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
    return rows.select(*[F.col(n).alias(o) for n, o in zip(names, docs.columns, strict=True)])
