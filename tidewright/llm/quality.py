"""Quality by naive Bayes support vectors over n-grams of words and word shapes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import importable, materialise, table
from .linear import fit_hinge_dual, fit_platt, sigmoid
from .words_np import split_words

#: Parameters of the model: labelled rows that it is fitted on, features that it keeps of those in three of them at least
#: (by the strength of their ratio), the threshold, the longest run of shapes, and closing marks that a shape tells apart.
SAMPLE_ROWS = 20_000
FEATURES = 8_192
THRESHOLD = 0.3
LONGEST_GRAM = 3
CLOSING_MARKS = 3


class Shapes(dict):
    """Shape of a word: case class of its letters, then its closing marks; cached for so many words."""

    limit = 300_000

    def __missing__(self, word: bytes) -> str:
        if len(self) >= self.limit:
            self.clear()
        w = word.decode("utf-8", "replace")
        core = w.rstrip("".join(c for c in w if not c.isalnum())) if not w[-1].isalnum() else w
        tail = w[len(core) :][:CLOSING_MARKS]
        if not core:
            kind = "p"
        elif core.isupper() and len(core) > 1:
            kind = "U"
        elif any(c.isdigit() for c in core):
            kind = "d"
        elif core[:1].isupper():
            kind = "C"
        else:
            kind = "l"
        self[word] = shape = kind + tail
        return shape


def features_of(text: str | None, shapes: Shapes) -> set[str]:
    """N-gram indicators: words (lower case), and runs of up to LONGEST_GRAM shapes in which R marks a repeated word."""
    words = split_words(text)
    if not words:
        return {"#empty"}
    low = [w.lower() for w in words]
    marks = [shapes[w] for w in words]
    for i in range(1, len(low)):
        if low[i] == low[i - 1]:
            marks[i] = "R" + marks[i][1:]
    found = {"w:" + w.decode("utf-8", "replace") for w in set(low)}
    found.update("1:" + m for m in set(marks))
    for n in range(2, LONGEST_GRAM + 1):
        found.update(f"{n}:" + " ".join(g) for g in set(zip(*[marks[j:] for j in range(n)], strict=False)))
    return found


@dataclass(frozen=True)
class Model:
    """weight of each feature (ratio times support-vector weight), intercept, and the scaling of margins to scores."""

    weights: dict[str, float]
    intercept: float
    a: float
    b: float

    def margin(self, found: set[str]) -> float:
        get = self.weights.get
        return self.intercept + sum(v for v in map(get, found) if v is not None)

    def score(self, margins: np.ndarray) -> np.ndarray:
        return sigmoid(self.a * margins + self.b)


def held_out(doc_id: str = "doc_id"):
    """Rows kept from training: crc32 of the id as text is a multiple of 5; a null id isn't held out, and has no label either."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def fit(rows: list[np.ndarray], names: list[str], y01: np.ndarray, folds: np.ndarray, c: float = 1.0) -> Model:
    """Log-count ratios scale the indicators; a hinge-loss linear model on them by dual coordinate descent; Platt scaling on out-of-fold margins."""

    def weights(index: np.ndarray) -> tuple[np.ndarray, float]:
        y = y01[index]
        pos, neg = np.ones(len(names)), np.ones(len(names))
        for i in index:
            (pos if y01[i] else neg)[rows[i]] += 1
        ratio = np.log((pos / (y.sum() + 2)) / (neg / ((1 - y).sum() + 2)))
        # Rows differ by orders of magnitude in length: scaled to keep one row's norm near 1.
        scale = ratio / np.sqrt(max(1.0, float(np.median([len(rows[i]) for i in index]))))
        w, b = fit_hinge_dual([rows[i] for i in index], scale, np.where(y > 0, 1.0, -1.0), c)
        return w * scale, b

    margins = np.zeros(len(rows))
    for f in np.unique(folds):
        inside, outside = np.flatnonzero(folds != f), np.flatnonzero(folds == f)
        if len(inside):
            w, b = weights(inside)
            margins[outside] = [b + w[rows[i]].sum() for i in outside]
    w, b = weights(np.arange(len(rows)))
    return Model(dict(zip(names, w.tolist(), strict=True)), b, *fit_platt(margins, y01))


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS, n_features: int = FEATURES) -> Model | None:
    """Fitted on `bound` labelled rows at most (by hash), never on held-out ones; None without labels. The features (in 3 sampled
    documents at least, ratios farthest from 1 for their count) are chosen by a distributed aggregate."""
    importable(docs.sparkSession)
    known = labels.select("doc_id", F.col("quality").cast("int").alias("y")).dropna().groupBy("doc_id").agg(F.max("y").alias("y"))
    known = known.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    chosen = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id"])

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        shapes = Shapes()
        for s in parts:
            yield s.map(lambda t: list(features_of(t, shapes)))

    chosen = materialise(chosen.select("doc_id", "y", found("text").alias("f")), "quality-sample")
    n, pos = chosen.agg(F.count(F.lit(1)), F.sum("y")).first()
    if not n:
        return None
    pos = float(pos or 0)
    per = chosen.select(F.explode("f").alias("f"), "y").groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p")).where("n >= 3")
    p, q = (F.col("p") + 0.5) / (pos + 1), (F.col("n") - F.col("p") + 0.5) / (n - pos + 1)
    z = F.abs(F.log(p / q)) / F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("n") - F.col("p") + 0.5))
    names = [r[0] for r in per.orderBy(z.desc(), "f").limit(n_features).collect()]
    number = {f: i for i, f in enumerate(names)}

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def numbers(s: pd.Series) -> pd.Series:
        return s.map(lambda fs: sorted(number[f] for f in fs if f in number))

    got = chosen.select("doc_id", "y", numbers("f").alias("x")).toPandas().sort_values("doc_id")
    folds = np.arange(len(got)) % 5
    return fit([np.asarray(x, dtype=np.int64) for x in got["x"]], names, got["y"].to_numpy(), folds)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (likeness to label 1) and predicted (score at least threshold).

    Whole texts, one pass, no shuffle. Null and empty texts share one feature and so one score; without labels every
    score is 0.5; repeated rows score alike; columns of these names are replaced.
    """
    model = train(docs, labels)
    base = docs.drop("score", "predicted")
    if model is None:
        scored = base.withColumn("score", F.lit(0.5))
    else:
        sent = docs.sparkSession.sparkContext.broadcast(model)

        @F.pandas_udf(T.DoubleType())
        def score_of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            shapes, m = Shapes(), sent.value
            for s in parts:
                yield pd.Series(m.score(np.array([m.margin(features_of(t, shapes)) for t in s], dtype=float)), dtype=float)

        scored = base.withColumn("score", score_of(F.col("text").cast("string")))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of the quality query: doc_id, held_out, score, predicted; a null doc_id isn't held out, other edge cases as in quality()."""
    out = quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
