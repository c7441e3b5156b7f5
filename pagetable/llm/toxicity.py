"""Toxicity severity by cumulative-link ordinal regression over sparse text features.

The chance that a text's grade is at most k is ``sigmoid(threshold_k - w . x)``: all thresholds
share the weights ``w``, and the score is the expected grade. Features are words and word beginnings
of 4 to 7 letters with the logarithm of their count, picked by how differently toxic and clean
texts have them, and the logarithm of the text's length.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pagetable.llm.common import Memory, sole
from pagetable.session import Stage

SAMPLE = 3000  # labelled texts of each class that the model is fitted to, at most
FEATURES = 1024  # features of a model, at most
SUPPORT = 6  # sampled texts that must have a feature
BEGINNINGS = (4, 5, 6, 7)
GRADES = 4  # 0 is clean; toxic texts are graded 1 to 3
REJECTED_FROM = 0.35  # chance of a grade over 0 from which a text counts as toxic

_WORD = re.compile(r"\w+")


class Model(NamedTuple):
    features: tuple[str, ...]
    weights: tuple[float, ...]  # of the features, then of the length
    thresholds: tuple[float, ...]


def features_of(word: str) -> list[str]:
    return [f"={word}", *(f"^{word[:k]}" for k in BEGINNINGS if len(word) > k)]


def feature_counts(text: str | None) -> tuple[Counter, int]:
    words = Counter(_WORD.findall((text or "").lower()))
    found: Counter = Counter()
    for word, n in words.items():
        for f in features_of(word):
            found[f] += n
    return found, sum(words.values())


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``toxic, text`` of at most ``SAMPLE`` labelled documents per class, by smallest hash."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    hashed = known.withColumn("_hash", F.xxhash64("doc_id"))
    picked = None
    for toxic in (0, 1):
        part = hashed.filter(F.col("toxic") == toxic).orderBy("_hash", "doc_id").limit(SAMPLE)
        picked = part if picked is None else picked.union(part)
    # The limits bound the picked side: 2 * SAMPLE rows of two numbers.
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    rows = rows.select("toxic", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", "text").alias("_hash"))
    # A doc_id that very many rows share brings them all: the bound holds for rows too.
    kept = [rows.filter(F.col("toxic") == toxic).orderBy("_hash", "text").limit(SAMPLE) for toxic in (0, 1)]
    return kept[0].union(kept[1]).drop("_hash")


def _select(sample: DataFrame, n: dict[int, int]) -> list[str]:
    """Features with the largest two-proportion z-scores, toxic against clean."""

    def present(batches):
        for pdf in batches:
            for toxic, text in zip(pdf["toxic"], pdf["text"]):
                names = list(feature_counts(text)[0])
                yield pd.DataFrame({"feature": names, "toxic": np.full(len(names), toxic)})

    rows = sample.mapInPandas(present, "feature string, toxic int")
    counted = rows.groupBy("feature").agg(
        F.sum("toxic").alias("t"), F.count("*").alias("n")
    ).filter(F.col("n") >= SUPPORT)
    share = F.col("n") / (n[0] + n[1])
    gap = F.col("t") / n[1] - (F.col("n") - F.col("t")) / n[0]
    z = gap / F.sqrt(share * (1 - share) * (1 / n[0] + 1 / n[1]) + 1e-9)
    best = counted.withColumn("z", z).orderBy(F.desc(F.abs("z")), "feature").limit(FEATURES)
    return [r["feature"] for r in best.collect()]


class _Scorer:
    """Feature values of texts, with what each word adds remembered."""

    def __init__(self, model: Model) -> None:
        self._at = {f: i for i, f in enumerate(model.features)}
        self._words = Memory()
        self._weights = np.array(model.weights)
        self._thresholds = np.array(model.thresholds)

    def awake(self) -> _Scorer:
        """To be called by a task: what other operators remembered in this worker goes."""
        sole("toxicity", self._words)
        return self

    def values(self, text: str | None) -> tuple[dict[int, float], float]:
        words = _WORD.findall((text or "").lower())
        counts: dict[int, int] = {}
        known = self._words
        for word in words:
            hit = known.get(word)
            if hit is None:
                hit = tuple(self._at[f] for f in features_of(word) if f in self._at)
                known.keep(word, hit, 2 * len(word) + 8 * len(hit))
            for i in hit:
                counts[i] = counts.get(i, 0) + 1
        return {i: np.log2(1 + n) for i, n in counts.items()}, np.log2(1 + len(words))

    def chances(self, text: str | None) -> np.ndarray:
        """Chance of each grade."""
        values, length = self.values(text)
        score = sum(self._weights[i] * v for i, v in values.items()) + self._weights[-1] * length
        at_most = 1 / (1 + np.exp(-np.clip(self._thresholds - score, -40, 40)))
        return np.diff(at_most, prepend=0.0, append=1.0)


@lru_cache(maxsize=2)
def _scorer(model: Model) -> _Scorer:
    return _Scorer(model)


def _grades(x: np.ndarray, toxic: np.ndarray, n_features: int) -> np.ndarray:
    """Grades of labelled texts: 0 when clean; toxic ones by thirds of their dose.

    The labels tell toxic from clean only. The dose of a toxic text is its weight of evidence: how much more its
    features occur in toxic texts than in clean ones, for its length.
    """
    hot = x[toxic == 1].mean(0) - x[toxic == 0].mean(0)
    dose = x[:, :n_features] @ np.maximum(hot[:n_features], 0) / np.maximum(x[:, -1], 1)
    cuts = np.quantile(dose[toxic == 1], [1 / 3, 2 / 3])
    return np.where(toxic == 1, 1 + np.searchsorted(cuts, dose, side="right"), 0)


def fit_ordinal(x: np.ndarray, grades: np.ndarray, weight: np.ndarray, n_grades: int = GRADES,
                rounds: int = 400, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of a proportional-odds model, by Adam on the whole sample."""
    n, d = x.shape
    w = np.zeros(d)
    # Thresholds are a first one and positive steps, which keeps their order.
    free = np.concatenate([[0.0], np.zeros(n_grades - 2)])
    share = weight / weight.sum()
    moments = [np.zeros(d), np.zeros(d), np.zeros(len(free)), np.zeros(len(free))]

    def sigmoid(v):
        return 1 / (1 + np.exp(-np.clip(v, -40, 40)))

    for t in range(1, rounds + 1):
        steps = np.exp(free[1:])
        cuts = np.concatenate([[free[0]], free[0] + np.cumsum(steps)])
        upper = np.concatenate([cuts, [np.inf]])[grades]
        lower = np.concatenate([[-np.inf], cuts])[grades]
        score = x @ w
        up, low = sigmoid(np.where(np.isinf(upper), 40, upper - score)), sigmoid(
            np.where(np.isinf(lower), -40, lower - score))
        p = np.maximum(up - low, 1e-12)
        du, dl = up * (1 - up) * (grades < n_grades - 1), low * (1 - low) * (grades > 0)
        per_score = share * (du - dl) / p  # of the loss, by the score
        grad_w = x.T @ per_score + decay * w
        per_cut = np.zeros(n_grades - 1)
        np.add.at(per_cut, np.minimum(grades, n_grades - 2), -share * du / p)
        np.add.at(per_cut, np.maximum(grades - 1, 0), share * dl / p)
        grad_free = np.concatenate([[per_cut.sum()], steps * np.cumsum(per_cut[:0:-1])[::-1]])
        for value, grad, m, v in ((w, grad_w, *moments[:2]), (free, grad_free, *moments[2:])):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    steps = np.exp(free[1:])
    return w, np.concatenate([[free[0]], free[0] + np.cumsum(steps)])


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); null without both classes.

    The sample is bounded by ``SAMPLE``; it is written once, features are counted over it in Spark, and the
    driver gets its vectors over the chosen features.
    """
    stage = Stage(docs.sparkSession, "toxicity")
    sample = stage.save(_sample(docs, labels), "sample")
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return None
    chosen = _select(sample, n)
    blank = Model(tuple(chosen), (0.0,) * (len(chosen) + 1), (0.0,))

    def vectors(batches):
        scorer = _scorer(blank).awake()
        for pdf in batches:
            got = [scorer.values(t) for t in pdf["text"]]
            yield pd.DataFrame({
                "toxic": pdf["toxic"],
                "at": [list(v) for v, _ in got],
                "value": [list(map(float, v.values())) for v, _ in got],
                "length": [float(length) for _, length in got],
            })

    rows = sample.mapInPandas(
        vectors, "toxic int, at array<int>, value array<double>, length double"
    ).collect()
    # In one order whatever the tasks' order was, so that sums come out alike.
    rows.sort(key=lambda r: (r["toxic"], r["length"], r["at"], r["value"]))
    x = np.zeros((len(rows), len(chosen) + 1))
    for i, r in enumerate(rows):
        x[i, r["at"]] = r["value"]
        x[i, -1] = r["length"]
    toxic = np.array([r["toxic"] for r in rows])
    grades = _grades(x, toxic, len(chosen))
    weights, thresholds = fit_ordinal(x, grades, np.ones(len(rows)))
    return Model(tuple(chosen), tuple(map(float, weights)), tuple(map(float, thresholds)))


def score(docs: DataFrame, model: Model | None, column: str = "text") -> DataFrame:
    """Adds ``severity`` (expected grade, 0 to 3), ``grade`` (the likeliest), ``p_toxic`` and ``toxic``.

    Without a model all is 0 and clean; a null text is scored like an empty one. Map-only. Columns
    of ``docs`` with these names give way.
    """
    if model is None:
        zero = F.lit(0.0)
        return docs.withColumns({
            "severity": zero, "grade": F.lit(0), "p_toxic": zero, "toxic": F.lit(False)
        })

    @F.pandas_udf("severity double, grade int, p_toxic double")
    def scored(texts: pd.Series) -> pd.DataFrame:
        scorer = _scorer(model).awake()
        p = np.array([scorer.chances(t) for t in texts]).reshape(len(texts), -1)
        return pd.DataFrame({
            "severity": p @ np.arange(p.shape[1]),
            "grade": p.argmax(1).astype(np.int32),
            "p_toxic": 1 - p[:, 0],
        })

    got = docs.withColumn("_toxicity", scored(F.col(column)))
    return got.withColumns({
        "severity": F.col("_toxicity.severity"),
        "grade": F.col("_toxicity.grade"),
        "p_toxic": F.col("_toxicity.p_toxic"),
        "toxic": F.col("_toxicity.p_toxic") >= REJECTED_FROM,
    }).drop("_toxicity")


def grade_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, severity, grade, p_toxic, toxic`` of every document.

    A null text is graded like an empty one, rows that repeat a doc_id each by their own text; without labels of
    both classes all are clean, and an empty table gives no rows.
    """
    model = fit(docs, labels)
    return score(docs.select("doc_id", "text"), model).drop("text")
