"""Sharding along a Hilbert curve over quantised metadata, cut into runs of equal row counts."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import importable, materialise, partitions

#: monotonically_increasing_id() puts the partition above so many bits.
_LOCAL_BITS = 33


def curve_index(axes: Sequence[np.ndarray], bits: int) -> np.ndarray:
    """Hilbert indices of points with coordinates below 2**bits (Skilling's transform, on whole columns)."""
    x = [np.asarray(a, dtype=np.uint64).copy() for a in axes]
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q, low = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for i in range(len(x)):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn = np.where((x[-1] & np.uint64(1 << b)) != 0, turn ^ np.uint64((1 << b) - 1), turn)
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for a in x:
            index = (index << one) | (((a ^ turn) >> np.uint64(b)) & one)
    return index


#: Bytes of a category's values, behind what all of them begin with, that place it; as many as a double tells apart.
_PLACED_BYTES = 6


def _text_places(df: DataFrame, names: Sequence[str]) -> list[Column]:
    """Numbers in the order of the strings: their first bytes behind the beginning that the least and the largest value share."""
    if not names:
        return []
    ends = df.select(*[f(F.col(c).cast("string")) for c in names for f in (F.min, F.max)]).first()
    out = []
    for i, c in enumerate(names):
        shared = len(os.path.commonprefix([ends[2 * i] or "", ends[2 * i + 1] or ""]))
        raw = F.hex(F.substring(F.encode(F.substring(F.col(c).cast("string"), shared + 1, _PLACED_BYTES), "UTF-8"), 1, _PLACED_BYTES))
        out.append(F.conv(F.rpad(raw, 2 * _PLACED_BYTES, "0"), 16, 10).cast("double"))
    return out


def with_curve(df: DataFrame, numeric: Sequence[str], category: Sequence[str], bits: int, out: str) -> DataFrame:
    """Adds the curve index. Every axis is cut by its quantiles (2**bits - 1 bounds at most reach the driver), categories in the order of their values, so files' statistics prune on them too; null counts as the first cell."""
    importable(df.sparkSession)
    cells = 1 << bits
    axes = [F.col(c).cast("double") for c in numeric] + _text_places(df, category)
    probes = F.array(*[F.lit(k / cells) for k in range(1, cells)])
    row = df.select(*[F.percentile_approx(a, probes, 10_000) for a in axes]).first()
    bounds = [np.unique(np.array(b or [], dtype=float)) for b in row]

    @F.pandas_udf(T.LongType())
    def index(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in parts:
            whole = []
            for s, known in zip(columns, bounds, strict=True):
                v = s.to_numpy(dtype=float, na_value=np.nan)
                cell = np.where(np.isnan(v), 0, np.searchsorted(known, v, side="left"))
                whole.append((cell * (cells - 1) // max(1, len(known))).astype(np.uint64))
            yield pd.Series(curve_index(whole, bits).astype(np.int64))

    return df.withColumn(out, index(*axes))


def ranked(df: DataFrame, order: Sequence[str], label: str, out: str = "__rank") -> tuple[DataFrame, int]:
    """df with each row's place (from 0) in the order given, and the number of rows.

    One range shuffle; no task sees more than its range. The placed rows are written to the shared folder,
    so that a retry can't deal ties differently. The driver sees one count for each partition.
    """
    spark = df.sparkSession
    placed = df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn(out, F.monotonically_increasing_id())
    placed = materialise(placed, label)
    part = F.shiftright(F.col(out), _LOCAL_BITS)
    counts = sorted(placed.groupBy(part.alias("part")).count().collect())
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    first = spark.createDataFrame(starts, "__part bigint, __start bigint")
    local = F.col(out).bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    joined = placed.withColumn("__part", part).join(F.broadcast(first), "__part")
    return joined.withColumn(out, F.col("__start") + local).drop("__part", "__start"), total


def hilbert_shards(
    df: DataFrame, n_shards: int = 40, numeric: Sequence[str] = ("n_chars",), category: Sequence[str] = ("source", "lang"), ties: Sequence[str] = ("doc_id",), bits: int = 8
) -> DataFrame:
    """df with shard (0 .. n_shards - 1) and slot (from 0 within the shard).

    Rows sorted by curve index, then by ties, are cut into n_shards runs whose row counts differ by one at most, so
    each shard covers a compact region of the metadata and its files' min/max statistics prune on any of the columns.
    Null metadata falls into the first cell; equal curve cells are ordered by ties, and rows that tie in these as well
    in some order that is settled once; repeated rows keep separate slots; very long texts are only carried along; with
    fewer rows than shards some shards are empty; an empty table gives an empty result. Columns named shard or slot in
    df are replaced, all others come back as they were, whatever their names.
    """
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    own = {c: f"__own{i}" for i, c in enumerate(kept)}
    axes = [*numeric, *category]
    keys = [f"__tie{i}" for i in range(len(ties))]
    light = df.select(*[F.col(c).alias(f"__axis{i}") for i, c in enumerate(axes)], *[F.col(c).alias(k) for c, k in zip(ties, keys, strict=True)], *[F.col(c).alias(n) for c, n in own.items()])
    named = [f"__axis{i}" for i in range(len(axes))]
    curve = with_curve(light, named[: len(numeric)], named[len(numeric) :], bits, "__curve").drop(*named)
    place, n = ranked(curve, ["__curve", *keys], "hilbert")
    n = max(n, 1)
    placed = place.withColumn("__shard", F.expr(f"cast(__rank * {n_shards} div {n} as int)"))
    start = F.expr(f"(cast(__shard as bigint) * {n} + {n_shards - 1}) div {n_shards}")
    return placed.select(*[F.col(n).alias(c) for c, n in own.items()], F.col("__shard").alias("shard"), (F.col("__rank") - start).alias("slot"))


def write_shards(df: DataFrame, path: str, **options) -> None:
    """Writes df as Parquet with a folder a shard, rows in curve order, so that row groups' statistics prune on any of the axes."""
    placed = hilbert_shards(df, **options)
    placed.repartitionByRange(partitions(df.sparkSession), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_digest(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """Contract of the sharding query over documents: only ids, sizes, checksums and metadata are shuffled, never texts; a null text has 16 bytes, other edge cases as in hilbert_shards()."""
    raw = F.encode(F.col("text"), "UTF-8")
    light = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(16)).cast("bigint").alias("size"),
        F.crc32(F.coalesce(raw, F.encode(F.lit(""), "UTF-8"))).alias("text_crc32"),
        "source",
        "lang",
    )
    out = hilbert_shards(light, n_shards, ["size"], ["source", "lang"], ["text_crc32", "doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
