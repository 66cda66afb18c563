"""Quality scores by compression.

Two zstandard dictionaries are built, from good and from bad labelled texts. The difference of a text's compressed sizes with
either, over its length to the power ``POWER``, tells which kind it resembles (over the plain length, or the sum of the sizes, long
texts all seem alike); a logistic calibration on labelled texts that built no dictionary turns that one number
into a score, which rises with it. Nothing else of a text enters.

Dictionaries and calibration use ``max_rows`` labelled documents of each label at most, of any length. A dictionary holds a stretch of
each of its documents, at a place by hash: ``WINDOW`` characters, or more where its documents are too few to fill ``DICT_BYTES``; the others are compressed whole where they lie, and send
back two numbers. All documents are scored, over whole texts, where they lie.

Defined cases: null and empty texts have the difference 0 and get the calibrated score of that; very long texts are compressed whole;
without both labels every score is the share of good labels (one half if there are none); repeated label rows count once, and of
rows that repeat a learned doc_id one trains; a null doc_id is scored, never learned from; an empty table gives no rows, and
trains nothing; other columns, whatever their names, pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import stored

MAX_ROWS = 3_000
WINDOW = 200
DICT_BYTES = 256 * 1024
LEVEL = 7
POWER = 0.7
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    intercept: float


class Sizes:
    """Compressed sizes with both dictionaries."""

    def __init__(self, good: bytes, bad: bytes, level: int = LEVEL):
        held = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for d in (good, bad)]
        self.pair = [zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False) for d in held]

    def of(self, text: str | None) -> float:
        """The normalised difference; positive: like good text."""
        data = (text or "").encode("utf-8", "surrogatepass")
        g, b = (len(c.compress(data)) for c in self.pair)
        return (b - g) / (len(data) + 16) ** POWER


def _expanded(d: np.ndarray) -> np.ndarray:
    """The one input of the calibration, so that a better difference never scores lower."""
    return np.column_stack([d])


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps, each halved until it lowers the penalised loss."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])

    def loss(w: np.ndarray) -> float:
        z = a @ w
        return float((np.logaddexp(0, z) - y * z).mean() + ridge / 2 * w @ w)

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = a.T @ (a * (p * (1 - p) + 1e-9)[:, None]) / len(x) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (p - y) / len(x) + ridge * w)
        t = 1.0
        while t > 1e-9 and (new := loss(w - t * step)) > now:
            t /= 2
        if t <= 1e-9 or np.abs(t * step).max() < 1e-9:
            break
        w, now = w - t * step, new
    return w[:-1], float(w[-1])


def dictionary(texts: list[str], dict_bytes: int = DICT_BYTES) -> bytes:
    return b"\n".join(t.encode("utf-8", "surrogatepass") for t in texts)[:dict_bytes].ljust(8, b" ")


def calibrated(pair: tuple[bytes, bytes], differences: np.ndarray, good: np.ndarray, share: float) -> Model:
    """share: of good texts in the labelled rows, where the sample given holds another."""
    x, y = _expanded(differences), good.astype(float)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    w, b = _fit((x - mean) / scale, y, ridge=1e-4)
    if 0 < share < 1:  # from the sample's shares to those of the rows
        b += float(np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean())))
    return Model(*pair, tuple(mean), tuple(scale), tuple(w), b)


def train(docs: DataFrame, labels: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> Model | float:
    """labels: doc_id and quality (1 good, 0 bad); learn: a condition over doc_id. A number where one label is missing."""
    own = labels.where(learn & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = {r["quality"]: r["count"] for r in own.groupBy("quality").count().collect()}
    share = n.get(1, 0) / sum(n.values()) if n else 0.5
    some = [own.where(F.col("quality") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows) for y in (0, 1)]
    picked = some[0].unionAll(some[1])
    mine = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    # picked has 2 * max_rows rows of two columns at most; of rows that share an id one stays
    rows = mine.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = stored(rows.withColumn("builds", F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)) == 0))
    wide = [max(WINDOW, 2 * DICT_BYTES // max(1, min(max_rows, n.get(y, 0)))) for y in (0, 1)]  # half of the documents build
    width = F.when(F.col("quality") == 0, wide[0]).otherwise(wide[1])
    start = F.pmod(F.xxhash64(F.lit("place"), "doc_id"), F.greatest(F.lit(1), F.length("text") - width + 1)).cast("int") + 1
    # some 2 * DICT_BYTES characters for each label
    parts = rows.where("builds").select("doc_id", "quality", F.substr("text", start, width).alias("part")).where("part <> ''").toPandas()
    parts = parts.sort_values("doc_id", kind="stable")
    pair = tuple(dictionary(parts["part"][parts["quality"] == y].tolist()) for y in (1, 0))

    @pandas_udf("double")
    def difference(texts: pd.Series) -> pd.Series:
        sizes = Sizes(*pair)
        return texts.map(sizes.of).astype(float)

    for rest in (rows.where("NOT builds"), rows):  # too few labels leave the other half without one
        found = rest.select("doc_id", "quality", difference("text").alias("d")).toPandas().sort_values("doc_id", kind="stable")
        good = found["quality"].to_numpy() == 1
        if 0 < good.sum() < len(good):
            return calibrated(pair, found["d"].to_numpy(float), good, share)
    return share


def scored(docs: DataFrame, model: Model | float, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a score from 0 to 1, higher for good text; a column of that name is replaced."""
    if not isinstance(model, Model):
        return docs.withColumn(score_col, F.lit(float(model)))

    @pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype=float)
        sizes = Sizes(model.good, model.bad)
        x = _expanded(np.array([sizes.of(t) for t in texts]))
        z = ((x - np.array(model.mean)) / np.array(model.scale)) @ np.array(model.weights) + model.intercept
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return docs.withColumn(score_col, score(docs[text_col]))
