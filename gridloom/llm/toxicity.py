"""Severity of toxic texts by cumulative-link ordinal regression over sparse text features."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import text_of, without, written

OUT = ("severity", "grade", "toxic")
WORDS = re.compile(r"[^\W\d_]+").findall


@dataclass(frozen=True)
class OrdinalModel:
    """P(grade > k) = sigmoid(w . x - theta[k]): one weight vector for all thresholds, which ascend.

    A text is toxic from P(grade > 0) > ``cut`` on; ``recall`` and ``precision`` are of the held-out rows that chose it.
    """

    vocabulary: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = 0.5
    recall: float = float("nan")
    precision: float = float("nan")


def tokens_of(text: str | None) -> set[str]:
    """Sparse features of a whole text, lower-cased: its words, their first 5 and 7 letters (word*), and any of these
    that two words or more share (#2). Runs of letters are words, so marks around them do not hide them."""
    counts = Counter(WORDS((text or "").lower()))
    stems: Counter[str] = Counter(counts)
    for w, n in counts.items():
        for k in (5, 7):
            if len(w) > k:
                stems[w[:k] + "*"] += n
    return set(stems) | {t + "#2" for t, n in stems.items() if n > 1}


def features(text: str | None, vocabulary: dict[str, int]) -> list[int]:
    """Indices of the vocabulary's features that a text has."""
    return sorted(vocabulary[t] for t in tokens_of(text) if t in vocabulary)


def grades_from_labels(quality: Column, toxic: Column) -> Column:
    """Severity grade 0 (not toxic), 1 (toxic in a text of quality), 2 (toxic and of low quality); null if unlabelled."""
    return F.when(toxic == 0, 0).when((toxic == 1) & (quality == 1), 1).when(toxic == 1, 2)


def choose_vocabulary(labelled: DataFrame, *, size: int = 2000, min_docs: int = 5, bar: float = 10.83) -> dict[str, int]:
    """The ``size`` features whose presence depends most on grade > 0 (chi-square, ``min_docs`` documents or more).

    Features below ``bar`` (10.83: one in a thousand by chance) are left out, so that ordinary words do not outvote others.

    ``labelled`` has text and grade (not null). Counted by a pre-aggregated groupBy; ``size`` bounds the result.
    """

    @F.pandas_udf("array<string>")
    def tokens(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(tokens_of(t)))

    rows = labelled.select((F.col("grade") > 0).cast("long").alias("y"), text_of().alias("t"))
    n, pos = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("p")).first()
    if not n or not 0 < pos < n:
        return {}
    c = rows.select("y", F.explode(tokens("t")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("d"), F.sum("y").alias("a")).where(F.col("d") >= min_docs)
    expected = F.col("d") * F.lit(pos / n)
    chi = (F.col("a") - expected) ** 2 / (expected * F.lit(1 - pos / n) * F.greatest(1 - F.col("d") / F.lit(n), F.lit(1e-9)))
    top = c.withColumn("chi", F.round(chi, 9)).where(F.col("chi") >= bar).orderBy(F.desc("chi"), "w").limit(size)
    return {r["w"]: k for k, r in enumerate(sorted(top.collect(), key=lambda r: r["w"]))}


def fit_ordinal(x: list[list[int]], grade: np.ndarray, vocabulary: dict[str, int], *, grades: int = 3, ridge: float = 1.0, steps: int = 400) -> OrdinalModel:
    """Maximum likelihood with a ridge on the weights, by adaptive gradient steps that shrink to nothing; deterministic.

    A row of grade g says yes at thresholds below g and no at the others. With the weights shared, every threshold's
    residuals pull the same vector. Thresholds are kept in order by fitting the first and positive gaps.
    """
    n, d = len(x), len(vocabulary)
    row = np.repeat(np.arange(n), [len(r) for r in x])
    col = np.array([c for r in x for c in r], dtype=np.int64)
    yes = (grade[:, None] > np.arange(grades - 1)).astype(float)
    rate = np.clip(yes.mean(0), 1e-3, 1 - 1e-3)
    theta = -np.log(rate / (1 - rate))
    par = np.r_[np.zeros(d), theta[0], np.log(np.maximum(np.diff(theta), 1e-2))]
    m, v = np.zeros_like(par), np.zeros_like(par)
    for t in range(1, steps + 1):
        w, th = par[:d], np.cumsum(np.r_[par[d], np.exp(par[d + 1 :])])
        score = np.bincount(row, w[col], n)
        p = 1 / (1 + np.exp(-np.clip(score[:, None] - th, -30, 30)))
        res = p - yes
        gw = np.bincount(col, res.sum(1)[row], d) + ridge * w
        gt = -res.sum(0)
        gth = np.array([gt[k:].sum() for k in range(grades - 1)])
        g = np.r_[gw, gth[0], gth[1:] * np.exp(par[d + 1 :])] / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        par = par - 0.05 * (1 - (t - 1) / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return OrdinalModel(vocabulary, par[:d], np.cumsum(np.r_[par[d], np.exp(par[d + 1 :])]))


def choose_cut(p: np.ndarray, toxic: np.ndarray, floor: float, false_alarms: float) -> float:
    """The least cut at which at most a share ``false_alarms`` of the clean rows is above; from ``floor`` to 0.5."""
    clean = np.sort(p[~toxic])[::-1]
    return 0.5 if not len(clean) else float(np.clip(clean[min(int(false_alarms * len(clean)), len(clean) - 1)], min(floor, 0.5), 0.5))


def fit(labelled: DataFrame, *, max_rows: int = 20_000, max_words: int = 2000, seed: int = 5, false_alarms: float = 0.01, **how) -> OrdinalModel:
    """Fit on about ``max_rows`` labelled documents (text, grade) at most, with ``max_words`` features.

    Beyond ``max_rows`` a seeded hash of the text takes the share that leaves so many, which bounds the driver's part
    whatever the table's size. Rows without a grade are left out. Without both toxic and clean rows the model has no
    feature and finds nothing toxic.

    The cut is chosen on a fifth of the rows by a model (features and weights) of the others: most toxic rows found at
    a share of ``false_alarms`` of the clean ones, and never so low that a text without features is toxic.
    """
    rows = labelled.where("grade IS NOT NULL")
    total = rows.count()
    if total > max_rows:
        rows = rows.where(F.pmod(F.xxhash64(F.lit(seed), text_of()), F.lit(1 << 40)) < int((1 << 40) * max_rows / total))
    held = F.pmod(F.xxhash64(F.lit(seed + 1), text_of()), F.lit(5)) == 0  # copies of a text go to the same part
    sample = written(rows.select("grade", text_of().alias("text"), held.alias("held")), "labelled")

    def indexed(rows: DataFrame, vocabulary: dict[str, int]) -> tuple[list[list[int]], np.ndarray]:
        @F.pandas_udf("array<int>")
        def index(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: features(t, vocabulary))

        got = sorted((r["grade"], r["x"]) for r in rows.select("grade", index("text").alias("x")).collect())
        return [x for _, x in got], np.array([g for g, _ in got], dtype=int)

    vocabulary = choose_vocabulary(sample, size=max_words)
    if not vocabulary:
        return OrdinalModel({}, np.zeros(0), np.array([30.0, 31.0]))
    model = fit_ordinal(*indexed(sample, vocabulary), vocabulary, **how)
    others, fifth = sample.where("NOT held"), sample.where("held")
    part = choose_vocabulary(others, size=max_words)
    if not part:
        return model
    trial = fit_ordinal(*indexed(others, part), part, **how)
    x, grade = indexed(fifth, part)
    p = 1 / (1 + np.exp(trial.thresholds[0] - np.array([trial.weights[r].sum() for r in x])))
    floor = float(1 / (1 + np.exp(min(trial.thresholds[0], model.thresholds[0]))))
    cut = choose_cut(p, grade > 0, floor, false_alarms)
    found, toxic = p > cut, grade > 0
    hits = float((found & toxic).sum())
    return replace(model, cut=cut, recall=hits / max(toxic.sum(), 1), precision=hits / max(found.sum(), 1))


def score(docs: DataFrame, model: OrdinalModel, *, text_col: str = "text") -> DataFrame:
    """Add severity (expected grade, the sum of P(grade > k)), grade (thresholds passed, the first at the model's cut) and
    toxic (grade > 0).

    Whole texts of any length are read; null and empty ones have no feature and the base rate's severity. Equal texts
    score alike, and every repeated row is scored. An empty table gives an empty one. Input columns named like an output
    column are replaced. No shuffle.
    """
    docs = without(docs, *[c for c in OUT if c != text_col.lower()])
    vocabulary, weights, thresholds = model.vocabulary, model.weights, model.thresholds
    cuts = np.r_[model.cut, np.full(len(thresholds) - 1, 0.5)]

    @F.pandas_udf("severity double, grade int")
    def run(texts: pd.Series) -> pd.DataFrame:
        s = np.array([weights[features(t, vocabulary)].sum() if len(weights) else 0.0 for t in texts])
        p = 1 / (1 + np.exp(-np.clip(s[:, None] - thresholds, -30, 30)))
        return pd.DataFrame({"severity": np.round(p.sum(1), 9), "grade": (p > cuts).sum(1).astype("int32")})

    return docs.withColumn("_gl_s", run(text_of(text_col))).select(*docs.columns, "_gl_s.*").withColumn("toxic", F.col("grade") > 0)
