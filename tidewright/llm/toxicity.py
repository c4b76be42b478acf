"""Toxicity by a chain of linear classifiers over words and their beginnings."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, importable, materialise, slices, table
from .linear import Sparse, fit_logistic, sigmoid

#: Bound of the labelled sample that the models are fitted on.
SAMPLE_ROWS = 20_000
FOLDS = 5
#: A feature is kept if it is in so many sampled documents, and the square root of its likelihood ratio statistic
#: (G squared) for some category is LEAST at least. Which of CUTS and PENALTIES a model uses is tried out of fold.
LEAST_DOCS, LEAST = 5, 4.0
CUTS, PENALTIES = (9.0, 6.0, 4.0), (0.3, 2.0)
#: A laxer cut is tried as long as it lowers the log loss by this share.
WORTH = 0.02
#: Lengths in bytes of the beginnings of words that are features beside the words: stems take many endings.
STEMS = (3, 4, 5, 6, 7, 8)
#: Log odds are held between these bounds.
BOUND = 8.0
#: Lower-cases A-Z and turns ASCII punctuation and control characters into blanks.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> set[bytes]:
    return set(text.lower().encode("utf-8", "surrogatepass").translate(_FOLD).split()) if text else set()


def features_of(words: set[bytes]) -> set[bytes]:
    """The words; beginnings of longer words, marked by a star, or by two as well where several words begin so."""
    once: set[bytes] = set()
    twice: set[bytes] = set()
    for w in words:
        for n in STEMS:
            if len(w) <= n:
                break
            stem = w[:n] + b"*"
            if stem in once:
                twice.add(stem + b"*")
            else:
                once.add(stem)
    return words | once | twice


@dataclass(frozen=True)
class Chain:
    """Models in order: weights over the vocabulary, weights of the earlier categories' log odds, intercept; thresholds tuned out of fold, and what was measured there."""

    categories: tuple[str, ...]
    words: dict[bytes, int]
    models: tuple[tuple[np.ndarray, np.ndarray, float], ...]
    thresholds: tuple[float, ...]
    report: tuple[dict, ...] = ()

    def starts(self) -> set[bytes]:
        """First bytes of the features: other words have none."""
        return {w.rstrip(b"*")[: STEMS[0]] for w in self.words}

    def probabilities(self, active: np.ndarray) -> list[float]:
        odds: list[float] = []
        for w, d, b in self.models:
            z = b + float(w[active].sum()) + sum(x * y for x, y in zip(d, odds, strict=True))
            odds.append(float(np.clip(z, -BOUND, BOUND)))
        return [float(sigmoid(np.array(z))) for z in odds]

    def active(self, text: str | None, starts: set[bytes]) -> np.ndarray:
        find, head = self.words.get, STEMS[0]
        found = map(find, features_of({w for w in words_of(text) if w[:head] in starts}))
        return np.array([k for k in found if k is not None], dtype=np.int64)


def _log_loss(y: np.ndarray, odds: np.ndarray) -> float:
    return float((np.logaddexp(0, odds) - y * odds).mean())


def _threshold(y: np.ndarray, odds: np.ndarray) -> float:
    """The probability that best tells the labels apart out of fold (caught less wrongly rejected); of equally good ones that nearest to a half."""
    if not 0 < y.sum() < len(y):
        return 0.5
    p, grid = sigmoid(odds), np.linspace(0.02, 0.98, 97)
    gain = np.array([(p[y > 0] >= t).mean() - (p[y < 1] >= t).mean() for t in grid])
    best = grid[gain >= gain.max() - 1e-3]
    return float(best[np.argmin(np.abs(best - 0.5))])


def fit_chain(x: Sparse, labels: np.ndarray, folds: np.ndarray, strength: np.ndarray, words: dict[bytes, int], categories: Sequence[str], compare: bool = False) -> Chain:
    """One model a category in the order given; later ones are trained with the earlier ones' out-of-fold log odds, as they'll meet them on new rows.

    strength (category, fold or all, feature): the statistics that choose features, each fold's without its own rows,
    so nothing of a row is known to the model that rates it out of fold. The cut, and then the penalty, are those of the
    least out-of-fold log loss. compare: also measure each link without the earlier ones, for the report.
    """
    n, width = len(labels), x.width
    earlier = np.zeros((n, 0))
    models, thresholds, report = [], [], []
    every = np.ones(n, dtype=bool)
    for j, name in enumerate(categories):
        y = labels[:, j].astype(float)

        def fitted(rows: np.ndarray, fold: int, cut: float, l2: float, dense: np.ndarray, near: tuple | None = None, j: int = j, y: np.ndarray = y) -> tuple[np.ndarray, np.ndarray, float]:
            keep = strength[j, fold] >= cut
            start = None if near is None else np.concatenate([near[0][keep], near[1], [near[2]]])
            w, d, b = fit_logistic(x.part(rows, keep), y[rows], dense[rows], l2, start=start)
            full = np.zeros(width)
            full[keep] = w
            return full, d, b

        def out_of_fold(cut: float, l2: float, dense: np.ndarray, fitted=fitted) -> tuple[np.ndarray, tuple]:
            odds, near = np.zeros(n), fitted(every, FOLDS, cut, l2, dense)
            for f in range(FOLDS):
                outside = folds == f
                if outside.any() and not outside.all():
                    w, d, b = fitted(~outside, f, cut, l2, dense, near)
                    odds[outside] = (x.dot(w) + dense @ d + b)[outside]
            return np.clip(odds, -BOUND, BOUND), near

        tried, best, least = {}, CUTS[0], float("inf")
        for c in CUTS:
            tried[c, PENALTIES[0]] = out_of_fold(c, PENALTIES[0], earlier)
            loss = _log_loss(y, tried[c, PENALTIES[0]][0])
            if loss > least * (1 - WORTH):
                break
            best, least = c, loss
        tried.update({(best, p): out_of_fold(best, p, earlier) for p in PENALTIES[1:]})
        cut, l2 = min(tried, key=lambda k: (_log_loss(y, tried[k][0]), k))
        odds, model = tried[cut, l2]
        models.append(model)
        thresholds.append(_threshold(y, odds))
        report.append({"category": name, "cut": cut, "penalty": l2, "log_loss": _log_loss(y, odds)})
        if compare:
            report[-1]["log_loss_without_earlier"] = _log_loss(y, out_of_fold(cut, l2, earlier[:, :0])[0])
        earlier = np.column_stack([earlier, odds])
    return Chain(tuple(categories), words, tuple(models), tuple(thresholds), tuple(report))


def labelled_sample(labels: DataFrame, categories: Sequence[tuple[str, Column]], bound: int) -> DataFrame:
    """doc_id, fold and a 0/1 column a category: at most `bound` documents, chosen by hash; a repeated doc_id counts once, null ids or labels don't count."""
    rows = labels.select("doc_id", *[c.cast("int").alias(n) for n, c in categories]).dropna()
    rows = rows.groupBy("doc_id").agg(*[F.max(n).alias(n) for n, _ in categories])
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).cast("int"))


def g_roots(n: np.ndarray, p: np.ndarray, total: float, pos: float) -> np.ndarray:
    """Root of the likelihood ratio statistic of features in n of total documents, p of which are among the pos positive ones."""
    if not 0 < pos < total:
        return np.zeros(len(n))

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-300))

    share, rest = pos / total, total - n
    found = part(p, n * share) + part(n - p, n * (1 - share)) + part(pos - p, rest * share) + part(rest - (pos - p), rest * (1 - share))
    return np.sqrt(2 * np.maximum(found, 0))


def train(docs: DataFrame, labels: DataFrame, categories: Sequence[tuple[str, Column]], bound: int = SAMPLE_ROWS, compare: bool = False) -> Chain:
    """Fits the chain on a bounded sample: features are counted by fold and category in a distributed aggregate, which
    leaves those that tell some category apart; the driver sees these and one short array of feature numbers for each
    sampled document."""
    spark = docs.sparkSession
    importable(spark)
    names = [n for n, _ in categories]
    c = len(names)
    sample = labelled_sample(labels, categories, bound)
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"])
    chosen = materialise(chosen.select("doc_id", "fold", *names, "text"), "toxic-sample")
    cells = FOLDS * (c + 1)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for piece in slices(part, c + 1, 1 << 20):
                number: dict[bytes, int] = {}
                at: list[int] = []
                sizes = []
                for t in piece.column(c + 1).to_pylist():
                    found = features_of(words_of(t))
                    sizes.append(len(found))
                    at.extend(number.setdefault(w, len(number)) for w in found)
                feature, fold = np.array(at, dtype=np.int64), np.repeat(piece.column(0).to_numpy(zero_copy_only=False), sizes)
                out = np.zeros((cells, len(number)), dtype=np.int32)
                for j in range(c + 1):
                    weight = np.repeat(piece.column(j).to_numpy(zero_copy_only=False), sizes) if j else np.ones(len(feature))
                    got = np.bincount(fold * len(number) + feature, weight, FOLDS * len(number)) if len(number) else np.zeros(0)
                    out[j * FOLDS : (j + 1) * FOLDS] = got.reshape(FOLDS, len(number)) if len(number) else 0
                yield pa.RecordBatch.from_arrays([pa.array(list(number), pa.binary()), *map(pa.array, out)], names=["feature", *[f"c{i}" for i in range(cells)]])

    per = chosen.select("fold", *names, "text").mapInArrow(count, "feature binary, " + ", ".join(f"c{i} int" for i in range(cells)))
    per = per.groupBy("feature").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(cells)])
    sums = {(r["fold"]): [r["n"], *[r[x] for x in names]] for r in chosen.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(x) for x in names]).collect()}
    total = np.array([sums.get(f, [0] * (c + 1)) for f in range(FOLDS)], dtype=float)
    if not total[:, 0].sum():
        discard(chosen)
        return Chain(tuple(names), {}, tuple((np.zeros(0), np.zeros(j), 0.0) for j in range(c)), (0.5,) * c)

    strengths = [f"g{j}_{f}" for j in range(c) for f in range(FOLDS + 1)]

    def strong(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            counts = np.array([part.column(1 + i).to_numpy(zero_copy_only=False) for i in range(cells)], dtype=float).reshape(c + 1, FOLDS, part.num_rows)
            roots = []
            for j in range(c):
                for f in range(FOLDS + 1):  # without the rows of fold f, and last over all
                    rest = np.arange(FOLDS) != f
                    roots.append(g_roots(counts[0, rest].sum(axis=0), counts[j + 1, rest].sum(axis=0), total[rest, 0].sum(), total[rest, j + 1].sum()))
            keep = (counts[0].sum(axis=0) >= LEAST_DOCS) & (np.max(roots, axis=0) >= LEAST)
            yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(keep)), *[pa.array(g[keep]) for g in roots]], names=["feature", *strengths])

    top = per.mapInArrow(strong, "feature binary, " + ", ".join(f"{g} double" for g in strengths)).toArrow().sort_by("feature")
    words = {w: i for i, w in enumerate(top.column("feature").to_pylist())}
    strength = np.array([[top.column(f"g{j}_{f}").to_numpy() for f in range(FOLDS + 1)] for j in range(c)])
    sent = spark.sparkContext.broadcast(Chain(tuple(names), words, (), ()))

    def active(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = sent.value
        starts = chain.starts()
        for part in parts:
            for piece in slices(part, c + 2, 1 << 20):
                xs = [np.sort(chain.active(t, starts)).astype(np.int32).tobytes() for t in piece.column(c + 2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[piece.column(i) for i in range(c + 2)], pa.array(xs, pa.binary())], names=["doc_id", "fold", *names, "x"])

    rows = chosen.select(F.col("doc_id").cast("string").alias("doc_id"), "fold", *names, "text").mapInArrow(active, "doc_id string, fold int, " + ", ".join(f"{x} int" for x in names) + ", x binary")
    got = rows.toArrow().sort_by("doc_id")
    lists = got.column("x").to_pylist()
    x = Sparse.of(np.frombuffer(b"".join(lists), dtype=np.int32), np.array([len(v) // 4 for v in lists]), len(words))
    del lists
    marks = np.column_stack([got.column(n).to_numpy() for n in names])
    folds = got.column("fold").to_numpy()
    del got
    discard(chosen)
    return fit_chain(x, marks, folds, strength, words, names, compare)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """docs (with a column text) with p_<category> for each category of the chain; a null or empty text gets the intercepts' probabilities. Columns of these names are replaced."""
    importable(docs.sparkSession)
    names = [f"p_{c}" for c in chain.categories]
    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in names])
    sent = docs.sparkSession.sparkContext.broadcast(chain)

    @F.pandas_udf(schema)
    def chain_of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = sent.value
        starts = model.starts()
        for s in parts:
            yield pd.DataFrame([model.probabilities(model.active(t, starts)) for t in s], columns=names, dtype=float)

    kept = [c for c in docs.columns if c not in names]
    own = {c: f"__own{i}" for i, c in enumerate(kept)}
    found = docs.select(*[F.col(c).alias(n) for c, n in own.items()], chain_of(F.col("text").cast("string")).alias("__p"))
    return found.select(*[F.col(n).alias(c) for c, n in own.items()], *[F.col("__p")[n].alias(n) for n in names])


def label_categories() -> list[tuple[str, Column]]:
    """The chain over this corpus' labels, which have one mark for toxic text and one for quality: abuse within junk, abuse within prose, and toxic text of any kind, which learns from both."""
    toxic, good = F.col("toxic") == 1, F.col("quality") == 1
    return [("toxic_junk", toxic & ~good), ("toxic_prose", toxic & good), ("toxic", toxic)]


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float | None = None, bound: int = SAMPLE_ROWS) -> DataFrame:
    """docs with p_toxic_junk, p_toxic_prose, p_toxic and is_toxic (p_toxic at least threshold; by default the one tuned out of fold).

    Every whole text, however long, is scored in one pass without a shuffle. Null and empty texts score alike, so do
    repeated rows; without any label every text gets probability 0.5 for each category and is_toxic is 0; empty tables
    stay empty; columns of these names are replaced, all others come back as they were, whatever their names.
    """
    chain = train(docs, labels, label_categories(), bound)
    out = score(docs.drop("is_toxic"), chain)
    least = chain.thresholds[-1] if threshold is None else threshold
    return out.withColumn("is_toxic", ((F.col("p_toxic") >= least) & F.lit(bool(chain.words))).cast("int"))


def toxicity_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity query: doc_id, a probability for each category, is_toxic of every document; edge cases as in toxicity()."""
    out = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "p_toxic", "is_toxic", "p_toxic_junk", "p_toxic_prose")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that aren't toxic, with their own columns, whatever their names; rows with null ids or texts are kept unless their text is rejected."""
    own = {c: f"__col{i}" for i, c in enumerate(docs.columns) if c != "text"}
    renamed = docs.select(*[F.col(c).alias(n) for c, n in own.items()], "doc_id", "text")
    kept = toxicity(renamed, labels).where("is_toxic = 0")
    return kept.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])
