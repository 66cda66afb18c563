"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic examples and unlabelled text (drawn from all documents, so that the class prior holds for it) train a linear model over the presence of words. Its risk is
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`` with the logistic loss: the unlabelled risk, corrected by the class
prior, may not turn negative; where it does, the step goes against that part (as published for non-negative PU learning).

The model is fitted in numpy on a bounded sample (``max_positive`` and ``max_unlabelled`` documents, whole texts); its
vocabulary is chosen by Spark from all words of that sample and has ``max_words`` words at most. All documents are
scored where they lie.

Defined cases: null and blank texts hold no word and get the score of the intercept; very long texts count each word once; without a
positive or an unlabelled example every score is the prior; repeated label rows count once, and of rows that repeat a learned
doc_id one trains; a null doc_id is scored, never learned from; equally telling words enter by name; an empty table gives no rows, and
trains nothing; other columns, whatever their names, pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import stored

MAX_POSITIVE = 4_000
MAX_UNLABELLED = 12_000
MAX_WORDS = 2_000
THRESHOLD = 0.7
PRIOR = 0.1
_LETTERS = re.compile(r"[^\W\d_]+")


def text_words(text: str | None) -> set[str]:
    return set(_LETTERS.findall((text or "").lower()))


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    intercept: float

    def score(self, text: str | None) -> float:
        get = self.weights.get
        total = self.intercept + sum(get(w, 0.0) for w in sorted(text_words(text) & self.weights.keys()))
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values between starts."""
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[starts[1:]] - total[starts[:-1]]


def descent(g: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """What a step lowers, given the scores g (before the logistic function), and its slope for each score: the risk, or, where
    the corrected part is negative, that part with its sign turned."""
    p, u = positive, ~positive
    s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
    minus = np.logaddexp(0, g)  # the loss of g as a negative; its slope is s, the slope of the positive loss s - 1
    corrected = minus[u].mean() - prior * minus[p].mean()
    slope = np.zeros(len(g))
    if corrected >= 0:
        slope[p] = prior * ((s[p] - 1) - s[p]) / p.sum()
        slope[u] = s[u] / u.sum()
        return float(prior * np.logaddexp(0, -g[p]).mean() + corrected), slope
    slope[p] = prior * s[p] / p.sum()
    slope[u] = -s[u] / u.sum()
    return float(-corrected), slope


def fit_nnpu(features: list[np.ndarray], positive: np.ndarray, n_words: int, prior: float, *, rounds: int = 400, rate: float = 0.05, ridge: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and intercept. features: the word numbers of each document; positive: which documents are confirmed."""
    sizes = np.array([len(f) for f in features])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.concatenate([*features, np.empty(0, np.int64)]).astype(np.int64)
    w, b = np.zeros(n_words), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros(n_words), np.zeros(n_words), 0.0, 0.0
    for t in range(1, rounds + 1):
        _, slope = descent(_sums(w[flat], starts) + b, positive, prior)
        gw = np.bincount(flat, np.repeat(slope, sizes), n_words) + ridge * w
        gb = slope.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w, b


def train(docs: DataFrame, positive: DataFrame, learn: Column, *, prior: float = PRIOR, id_col: str = "doc_id", text_col: str = "text", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, max_words: int = MAX_WORDS) -> Model:
    """docs: all texts; positive: ids (column doc_id) of confirmed toxic documents; learn: a condition over doc_id."""
    own = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    chosen = positive.select("doc_id").where(learn & F.col("doc_id").isNotNull()).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_positive)
    ids = own.select("doc_id").where(learn & F.col("doc_id").isNotNull()).distinct()
    share = F.pmod(F.xxhash64("doc_id", F.lit("unlabelled")), F.lit(1 << 20)) < int(min(1.0, 1.5 * max_unlabelled / max(1, ids.count())) * (1 << 20))
    others = ids.where(share).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_unlabelled)
    picked = chosen.withColumn("positive", F.lit(True)).unionAll(others.withColumn("positive", F.lit(False)))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"positive": pdf["positive"], "words": [sorted(text_words(t)) for t in pdf["text"]]})

    # picked has max_positive + max_unlabelled rows of two columns at most
    rows = own.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "positive").agg(F.min("text").alias("text"))  # of rows that share an id one
    sample = stored(rows.select("positive", "text").mapInPandas(sets, "positive boolean, words array<string>"))
    n = sample.agg(F.count_if("positive"), F.count_if(~F.col("positive"))).first()
    if not n[0] or not n[1]:
        return Model({}, float(np.log(prior / (1 - prior))))
    counts = sample.select("positive", F.explode("words").alias("word")).groupBy("word").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u"))
    both = (F.col("p") + F.col("u")) / F.lit(n[0] + n[1])
    spread = F.sqrt(both * (1 - both) * F.lit(1 / n[0] + 1 / n[1]) + 1e-12)
    z = F.abs(F.col("p") / n[0] - F.col("u") / n[1]) / spread
    top = counts.where((F.col("p") + F.col("u") >= 5) & (z > 4)).orderBy(z.desc(), "word").limit(max_words).select("word")
    vocabulary = sorted(r[0] for r in top.collect())  # max_words at most
    number = {w: k for k, w in enumerate(vocabulary)}

    def numbers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"positive": pdf["positive"], "f": [sorted(number[w] for w in ws if w in number) for ws in pdf["words"]]})

    rows = sample.mapInPandas(numbers, "positive boolean, f array<int>").toPandas()  # the sample's documents, vocabulary words only
    order = sorted(range(len(rows)), key=lambda k: (not rows["positive"][k], tuple(rows["f"][k])))  # Spark gives no order; sums shall not differ
    features = [np.asarray(rows["f"][k], np.int64) for k in order]
    w, b = fit_nnpu(features, rows["positive"].to_numpy(bool)[order], len(vocabulary), prior)
    return Model({x: float(w[k]) for x, k in number.items()}, b)


def scored(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a score from 0 to 1, higher for toxic text; a column of that name is replaced."""

    @pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(model.score, na_action=None).astype(float)

    return docs.withColumn(score_col, score(docs[text_col]))


def confirmed(labels: DataFrame) -> DataFrame:
    return labels.where("toxic = 1").select("doc_id")


def label_prior(labels: DataFrame, learn: Column, default: float = PRIOR) -> float:
    """The share of toxic documents among the labelled rows to learn from."""
    share = labels.where(learn & F.col("toxic").isNotNull()).agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    return float(min(0.9, max(0.01, share))) if share is not None else default
