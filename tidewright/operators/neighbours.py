"""Exact nearest rows by cosine without meeting every row: balls around sampled centres, opened only where the triangle inequality can't rule them out."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.ledger import shared_folder
from .workers import importable, spread

#: Centres at most, whatever the number of rows; queries that a task holds; rows of a ball that it reads.
CENTRES, ASKED, READ = 1_024, 2_048, 50_000
#: Scores are told to so many decimals; a ball is opened if it can hold a row that comes within the last of them.
DECIMALS, SLACK = 6, 2e-6

_BALL = "grp string, id bigint, ball int, r double, v binary"


def _units(column: pa.Array) -> np.ndarray:
    rows = np.array(column.to_pylist(), dtype=np.float64).reshape(len(column), -1)
    size = np.linalg.norm(rows, axis=1)
    return rows / np.where(size > 0, size, 1)[:, None]


def _apart(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances of every row and centre."""
    both = (rows * rows).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None]
    return np.sqrt(np.maximum(both - 2 * rows @ centres.T, 0))


def _written(df: DataFrame, label: str) -> DataFrame:
    path = shared_folder(df.sparkSession, f"neighbours-{label}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _centres(rows: DataFrame, n: int) -> np.ndarray:
    """Unit vectors of the rows whose ids hash lowest: CENTRES at most."""
    k = min(CENTRES, max(1, math.isqrt(n)))
    found = rows.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(k).collect()
    return _units(pa.array([list(r["v"]) for r in found]))


def _in_balls(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """Rows with the centre they are nearest to, their distance to it, and their unit vector."""

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 4_096):
                piece = part.slice(at, 4_096)
                unit = _units(piece.column(2))
                far = _apart(unit, centres)
                ball = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(ball, pa.int32()), pa.array(far[np.arange(len(ball)), ball]), pa.array([u.tobytes() for u in unit], pa.binary())], names=["grp", "id", "ball", "r", "v"])

    return spread(rows.select("grp", "id", "v")).mapInArrow(place, _BALL)


def _openings(queries: DataFrame, centres: np.ndarray, balls: list[tuple[str, int, int, float]], k: int) -> DataFrame:
    """grp, id, ball of the balls that each query (grp, id, v, opened, least) opens; balls: grp, ball, rows, radius.

    Without a bound (least is null) the nearest balls that hold k + 1 rows together; with one, all others that may hold a
    row as good as it.
    """
    of: dict[str, tuple[np.ndarray, ...]] = {}
    for g, own in groupby(sorted(balls), key=lambda b: b[0]):
        _, ball, n, radius = zip(*own, strict=True)
        of[g] = (np.array(ball), np.array(n), np.array(radius))

    def pick(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out: list[tuple] = []
            for g, q, v, least in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                if g not in of:
                    continue
                ball, n, radius = of[g]
                far = _apart(np.frombuffer(v, np.float64)[None], centres[ball])[0]
                order = np.argsort(far, kind="stable")
                enough = int(np.searchsorted(np.cumsum(n[order]), k + 1)) + 1
                first = order[:enough]
                if least is None:
                    chosen = first
                else:
                    reach = math.sqrt(max(0.0, 2 - 2 * (least - SLACK))) + 1e-9
                    chosen = np.setdiff1d(np.flatnonzero(far - radius <= reach), first)
                out += [(g, q, int(b)) for b in ball[chosen]]
            columns = zip(*out, strict=True) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32()), strict=True)], names=["grp", "id", "ball"])

    return queries.select("grp", "id", "v", "least").mapInArrow(pick, "grp string, id bigint, ball int")


def _best(rows: DataFrame, queries: DataFrame, opened: DataFrame, loads: DataFrame, k: int) -> DataFrame:
    """q, key, score: the k best of each task for each query that opens a ball. A ball of many rows or queries is dealt to several tasks: its rows by their id, its queries by theirs."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = opened.groupBy("grp", "ball").agg(F.count(F.lit(1)).alias("asked"))
    cuts = loads.join(asked, ["grp", "ball"]).select("grp", "ball", F.ceil(F.col("rows") / READ).cast("int").alias("a"), F.ceil(F.col("asked") / ASKED).cast("int").alias("b"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    cell = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    ours = rows.join(cuts, ["grp", "ball"]).select("grp", "ball", cell("a").alias("x"), every("b").alias("y"), F.lit(1).alias("kind"), "id", "v")
    theirs = opened.join(queries.select("grp", "id", "v"), ["grp", "id"]).join(cuts, ["grp", "ball"])
    theirs = theirs.select("grp", "ball", every("a").alias("x"), cell("b").alias("y"), F.lit(0).alias("kind"), "id", "v")

    def meet(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cells() -> Iterator[tuple]:
            for part in parts:
                yield from zip(*(part.column(i).to_pylist() for i in range(7)), strict=True)

        for _, cell_ in groupby(cells(), key=lambda r: r[:4]):
            ids, vectors = [], []
            keys: list[int] = []
            held: list[bytes] = []
            found: tuple[np.ndarray, ...] | None = None

            def count(ids=ids, vectors=vectors) -> None:
                nonlocal found
                asked_ids, block = np.array(ids), np.frombuffer(b"".join(vectors), np.float64).reshape(len(ids), -1)
                got = np.frombuffer(b"".join(held), np.float64).reshape(len(keys), -1)
                score = np.round(block @ got.T, DECIMALS) + 0.0
                key = np.broadcast_to(np.array(keys), score.shape)
                score = np.where(key == asked_ids[:, None], -np.inf, score)
                if found is not None:
                    key, score = np.hstack([found[0], key]), np.hstack([found[1], score])
                order = np.lexsort((key, -score), axis=1)[:, :k]
                found = np.take_along_axis(key, order, 1), np.take_along_axis(score, order, 1)

            for *_, kind, i, v in cell_:
                if kind == 0:
                    ids.append(i)
                    vectors.append(v)
                elif ids:
                    keys.append(i)
                    held.append(v)
                    if len(keys) == 1_024:
                        count()
                        keys, held = [], []
            if ids and keys:
                count()
            if found is not None:
                key, score = found
                real = np.isfinite(score)
                q = np.broadcast_to(np.array(ids)[:, None], score.shape)
                yield pa.RecordBatch.from_arrays([pa.array(q[real]), pa.array(key[real]), pa.array(score[real])], names=["q", "key", "score"])

    dealt = ours.unionByName(theirs).repartition(n, "grp", "ball", "x", "y").sortWithinPartitions("grp", "ball", "x", "y", "kind")
    return dealt.select("grp", "ball", "x", "y", "kind", "id", "v").mapInArrow(lambda parts: meet(parts), "q bigint, key bigint, score double")


def nearest(rows: DataFrame, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The k rows (grp, id, v) most like each query (grp, id, v) of the same grp by cosine, without the query itself, and what was opened.

    hits: q, key, score (six decimals, ties by key), place. opened: q, ball, rows. Rows lie in balls around sampled
    centres. A query first opens the nearest balls that hold k other rows; the k-th best of those bounds what can still
    win, and a ball is opened then only if its distance less its radius is within that bound. So the result is that of
    scoring every row. Rows of zeros score 0. Centres and the balls' radii are bounded in number (CENTRES a grp) and go
    to the tasks with the plan; rows and queries meet by equality of their ball, and a large ball is dealt to several
    tasks.
    """
    spark = rows.sparkSession
    importable(spark)
    rows = rows.select("grp", "id", "v")
    n = rows.count()
    empty = spark.createDataFrame([], "q bigint, key bigint, score double, place int")
    if not n:
        return empty, spark.createDataFrame([], "q bigint, ball int, rows bigint")
    centres = _centres(rows, n)
    placed, asked = _written(_in_balls(rows, centres), "rows"), _written(_in_balls(queries, centres), "queries")
    loads = _written(placed.groupBy("grp", "ball").agg(F.count(F.lit(1)).alias("rows"), F.max("r").alias("radius")), "balls")
    balls = [tuple(r) for r in loads.select("grp", "ball", "rows", "radius").collect()]
    first = _written(_openings(asked.withColumn("least", F.lit(None).cast("double")), centres, balls, k), "first")
    some = _written(_best(placed, asked, first, loads, k), "some")
    least = top_k(some, k).groupBy("q").agg(F.min("score").alias("least"), F.max("place").alias("n")).where(F.col("n") == k)
    bounded = asked.join(least.withColumnRenamed("q", "id"), "id", "left").withColumn("least", F.coalesce("least", F.lit(-1.0)))
    second = _written(_openings(bounded, centres, balls, k), "second")
    hits = top_k(some.unionByName(_best(placed, asked, second, loads, k)), k)
    opened = first.unionByName(second).join(loads, ["grp", "ball"]).select(F.col("id").alias("q"), "ball", "rows")
    return hits, opened


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k best rows (q, key, score) of each query with their place; Spark keeps k a task before it shuffles."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "key"))
    return scored.withColumn("place", place).where(F.col("place") <= k)


def with_readings(hits: DataFrame, objects: DataFrame, readings: DataFrame) -> DataFrame:
    """hits with repo, path and symbol of each object (id, repo, path, symbol) and the summary of its last reading (id, object, summary); null without one."""
    last = readings.groupBy("object").agg(F.max_by("summary", "id").alias("summary"))
    j = hits.join(objects.withColumnRenamed("id", "key"), "key").join(last.withColumnRenamed("object", "key"), "key", "left")
    return j.select("q", "key", "score", "place", "repo", "path", "symbol", "summary")
