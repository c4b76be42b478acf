"""Clustering around centroids: float32 products narrow down the nearest centroid within proven error bounds, integers decide the rest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, importable, materialise

COMPONENTS, CENTROIDS, ROUNDS, SCALE = 64, 16, 3, 64
#: Largest integer component: squared distances of 64 such components stay within 63 bits.
LARGEST = 2**27
#: Unit roundoff of float32 and float64.
_U32, _U64 = 2.0**-24, 2.0**-53
#: Rows that are screened at once.
ROWS = 4_096


def quantised(embeddings: DataFrame) -> DataFrame:
    """vec_id, v (64 integers of 4 bytes) of the rows whose vectors have 64 components, all finite."""

    def floors(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            lists = part.column(1)
            fits = np.asarray(lists.value_lengths().fill_null(-1)) == COMPONENTS
            ids, kept = part.column(0).filter(pa.array(fits)), lists.filter(pa.array(fits))
            x = kept.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, COMPONENTS)  # nulls become nan
            finite = np.isfinite(x).all(axis=1)
            q = np.floor(SCALE * x[finite])
            if len(q) and np.abs(q).max() > LARGEST:
                raise ValueError(f"a component beyond {LARGEST // SCALE}: squared distances would leave 63 bits")
            q = q.astype("<i4")
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(finite)).cast(pa.int64()), pa.array([row.tobytes() for row in q], pa.binary())], names=["vec_id", "v"])

    return embeddings.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>")).mapInArrow(floors, "vec_id bigint, v binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i4").reshape(-1, COMPONENTS).astype(np.int64)


class Screen:
    """The nearest of some integer centroids, the smaller number among equals."""

    def __init__(self, centroids: np.ndarray):
        self.exact = centroids
        self.single = centroids.astype(np.float32).T
        self.squares = (centroids * centroids).sum(axis=1)
        self.lengths = np.sqrt(self.squares.astype(np.float64))
        self.settled = 0

    def intervals(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of |c|^2 - 2 x.c for each row and centroid, which order the centroids as their distances do.

        A product of n terms summed in any order, its factors rounded to float32 before, is off by gamma(n + 2) times
        the sum of the terms' magnitudes at most, gamma(k) = k u / (1 - k u), and that sum is |x| |c| at most.
        """
        k = COMPONENTS + 2
        gamma = k * _U32 / (1 - k * _U32)
        size = np.sqrt((x * x).sum(axis=1).astype(np.float64))[:, None] * self.lengths
        near = self.squares.astype(np.float64) - 2.0 * (x.astype(np.float32) @ self.single).astype(np.float64)
        # The second term covers the float64 steps: squares, lengths, their product, the difference.
        off = 2.0 * gamma * (1 + 16 * _U64) * size + 16 * _U64 * (self.squares + 2.0 * size)
        return near - off, near + off

    def nearest(self, x: np.ndarray) -> np.ndarray:
        low, high = self.intervals(x)
        open_ = low <= high.min(axis=1)[:, None]
        out = open_.argmax(axis=1)
        several = np.flatnonzero(open_.sum(axis=1) > 1)
        self.settled += len(x) - len(several)
        if len(several):
            row, c = np.nonzero(open_[several])
            gap = x[several][row] - self.exact[c]
            exact = np.full((len(several), len(self.exact)), np.iinfo(np.int64).max)
            exact[row, c] = (gap * gap).sum(axis=1)
            out[several] = exact.argmin(axis=1)
        return out

    def distances(self, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        gap = x - self.exact[cluster]
        return (gap * gap).sum(axis=1)


def _sums(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster, rows and total (64 exact sums) of the vectors nearest to each centroid; a task adds up its batches before they are dealt."""

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = Screen(centroids)
        for part in parts:
            rows, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), COMPONENTS), np.int64)
            for at in range(0, part.num_rows, ROWS):
                x = _matrix(part.column(0).slice(at, ROWS))
                cluster = screen.nearest(x)
                rows += np.bincount(cluster, minlength=len(centroids))
                for c in np.unique(cluster):
                    total[c] += x[cluster == c].sum(axis=0)
            hit = np.flatnonzero(rows)
            yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(rows[hit]), pa.array(list(total[hit]), pa.list_(pa.int64()))], names=["cluster", "rows", "total"])

    parts = vectors.select("v").mapInArrow(add, "cluster int, rows bigint, total array<bigint>")
    wide = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"t{i}") for i in range(COMPONENTS)]
    return parts.groupBy("cluster").agg(F.sum("rows").alias("rows"), *wide)


def starts(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors whose ids hash lowest, in that order; rows of one id by their components' bytes; a null id starts none."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.where("vec_id is not null").select(rank.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([np.frombuffer(r["v"], dtype="<i4") for r in first], dtype=np.int64).reshape(-1, COMPONENTS)


def clusters(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = "1") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every vector of embeddings (vec_id, embedding) that is kept.

    Only vectors of 64 components, none null or not finite, are kept; a component beyond LARGEST / SCALE is an error.
    With fewer than k different starts there are fewer centroids, with equal ones the smaller number wins; an empty
    centroid stays where it is. Repeated rows count as often as they come. Null ids are clustered and start no centroid;
    if all are null, nothing can start and no row is returned, as from an empty table. Other columns aren't read.

    A round is one pass without a shuffle of vectors: tasks send a row a batch and cluster, and the driver gets k rows
    of 64 sums, whatever the table's size. Float32 products narrow each row down to the centroids whose error intervals
    overlap; those are told apart by exact integers.
    """
    spark = embeddings.sparkSession
    importable(spark)
    vectors = materialise(quantised(embeddings), "quantised")
    centroids = starts(vectors, k, seed)
    empty = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not len(centroids):
        discard(vectors)
        return spark.createDataFrame([], empty)
    for _ in range(rounds):
        centroids = centroids.copy()
        for r in _sums(vectors, centroids).collect():
            centroids[r["cluster"]] = [int(r[f"t{i}"]) // r["rows"] for i in range(COMPONENTS)]

    def assign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = Screen(centroids)
        for part in parts:
            for at in range(0, part.num_rows, ROWS):
                piece = part.slice(at, ROWS)
                x = _matrix(piece.column(1))
                cluster = screen.nearest(x)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(cluster, pa.int32()), pa.array(screen.distances(x, cluster))], names=["vec_id", "cluster", "distance"])

    assigned = materialise(vectors.mapInArrow(assign, "vec_id bigint, cluster int, distance bigint"), "assigned")
    discard(vectors)
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    about = [(c, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    small = spark.createDataFrame(about, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # k rows at most.
    return assigned.join(F.broadcast(small), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
