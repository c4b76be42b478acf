"""Ranked selection: channels, fractional ranks, reciprocal rank fusion, and how the result is built."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.features import Hashed, identifiers, slots
from .ordering import running
from .workers import importable, spread

RRF_OFFSET = 60
#: Default weights of the channels.
WEIGHTS = {"lexical": 1.0, "semantic": 1.0, "boost": 1.0, "recency": 0.3, "prior": 0.3, "utility": 0.3}


def fractional_rank(scored: DataFrame, score: str, by: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """scored with the average rank of each score, largest first; groups of one distinct score abstain and leave.

    Ranks come from counts by distinct score, so only those are sorted, and hot groups are pre-aggregated. Without by
    the distinct scores are dealt by ranges, and only the counts of the ranges are summed in one place.
    """
    counts = scored.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count(F.lit(1)).alias("__n"))
    if by:
        order = Window.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
        before, kinds = F.coalesce(F.sum("__n").over(order), F.lit(0)), F.count(F.lit(1)).over(Window.partitionBy(*by))
        ranks = counts.withColumn(out, before + (F.col("__n") + 1) / 2).withColumn("__kinds", kinds)
    else:
        ranks = running(counts, [], [F.desc(score)], "__n", "__upto").withColumn(out, F.col("__upto") - F.col("__n") + (F.col("__n") + 1) / 2)
        ranks = ranks.withColumnRenamed("__rows", "__kinds").drop("__upto", "__total")
    return scored.join(ranks.where("__kinds > 1").drop("__n", "__kinds"), [*by, score])


def vote(rank: Column, weight: float) -> Column:
    return F.lit(float(weight)) / (F.lit(RRF_OFFSET) + rank)


def lexical_hits(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """q, key, hits: distinct query tokens that a text has, by an equi-join on tokens; pairs without any are left out."""
    asked = queries.select("q", F.explode(F.array_distinct(tx.identifiers(F.col("text")))).alias("token"))
    has = docs.select("key", F.explode(F.array_distinct(tx.identifiers(F.col("text")))).alias("token"))
    return has.join(asked, "token").groupBy("q", "key").agg(F.count(F.lit(1)).alias("hits"))


def first_of_each_text(docs: DataFrame, static: DataFrame) -> DataFrame:
    """key, votes, copies: of the rows of docs (key, text) with an equal text, the best by (votes, key), and how many there are.

    Equal texts have equal hits for every query, so this is the best placed one of each, whatever is asked.
    """
    rows = docs.select("key", text_sha().alias("sha")).join(static, "key")
    best = F.min(F.struct((-F.col("votes")).alias("neg"), "key"))
    return rows.groupBy("sha").agg(best.alias("best"), F.count(F.lit(1)).alias("copies")).select("best.key", (-F.col("best.neg")).alias("votes"), "copies")


def text_sha() -> Column:
    """Hash of the column text; a null text is empty."""
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def copies_passed(docs: DataFrame, pool: DataFrame, cap: int) -> DataFrame:
    """q, pool, deduped from what a ranking of different texts (lexical_top with distinct) gives for k=cap, without static votes: its size, and the rows that a walk over the whole ranking skips as copies before it holds cap texts."""
    last = F.max(F.when(F.col("place") == cap, F.struct("score", "key")))
    ends = pool.groupBy("q").agg(F.count(F.lit(1)).alias("pool"), last.alias("last"))
    placed = pool.join(ends, "q")
    above = placed.groupBy("q", "pool").agg(F.coalesce(F.sum(F.when(F.col("last").isNull() | (F.col("score") > F.col("last.score")), F.col("copies") - 1)), F.lit(0)).alias("above"))
    # Copies that tie with the last text go before it where their key is less.
    tied = placed.where("score = last.score AND key < last.key AND copies > 1").select("q", "key", F.col("last.key").alias("end"))
    shas = docs.select("key", text_sha().alias("sha"))
    tied = shas.join(shas.join(tied, "key").withColumnRenamed("key", "first"), "sha").where("key > first AND key < end")
    between = tied.groupBy("q").agg(F.count(F.lit(1)).alias("tied"))
    return above.join(between, "q", "left").select("q", F.col("pool").cast("bigint"), (F.col("above") + F.coalesce("tied", F.lit(0))).cast("bigint").alias("deduped"))


def top(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query by (score, key as text); Spark keeps k a task before it shuffles."""
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "key"))
    return scored.withColumn("place", place).where(F.col("place") <= k)


def verbatim(docs: DataFrame, items: DataFrame) -> DataFrame:
    """q, key: which texts hold an item's text as it stands. Pairs come from an equi-join on the longest token within the item
    (one that has neighbours on both sides is a whole token wherever the item stands) and are then looked at; only items
    without such a token meet every row."""
    words = tx.tokens(F.col("text"))
    inner = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("token"))))["token"]
    asked = items.select("q", F.col("text").alias("asked"), longest.alias("token"))
    has = docs.select("key", F.explode(F.array_distinct(words)).alias("token")).join(asked.where("token is not null"), "token").select("q", "key", "asked")
    met = docs.select("key", "text").join(has, "key").where(F.contains(F.col("text"), F.col("asked"))).select("q", "key")
    short = asked.where("token is null").select("q", "asked")
    if not short.limit(1).count():
        return met
    return met.unionByName(docs.join(short, F.contains(F.col("text"), F.col("asked"))).select("q", "key"))


def static_votes(pool: DataFrame, channels: dict[str, float]) -> DataFrame:
    """key, votes: the sum of the query-independent channels named, each a numeric column of pool (null: unranked, last)."""
    total, joined = F.lit(0.0), pool.select("key", *channels)
    n = pool.count()
    for name, weight in channels.items():
        if weight <= 0:
            continue
        ranks = fractional_rank(pool.select("key", name), name, out=f"__{name}").select("key", f"__{name}")
        joined = joined.join(ranks, "key", "left")
        spread = pool.agg(F.min(name) < F.max(name)).first()[0]
        if spread:
            total = total + vote(F.coalesce(F.col(f"__{name}"), F.lit(n + 1.0)), weight)
    return joined.select("key", total.alias("votes"))


def utility(uses: DataFrame) -> DataFrame:
    """key, utility from (key, state): Laplace estimate of being done."""
    done, failed = (F.sum((F.col("state") == s).cast("int")) for s in ("done", "failed"))
    return uses.groupBy("key").agg(done.alias("d"), failed.alias("f")).select("key", ((F.col("d") + 1) / (F.col("d") + F.col("f") + 2)).alias("utility"))


def dedup_exact(ranked: DataFrame, by: Sequence[str] = ("q",)) -> DataFrame:
    """Of equal texts the better placed stays. ranked: q, key, place, text."""
    first = Window.partitionBy(*by, F.sha2(F.col("text"), 256)).orderBy("place")
    return ranked.withColumn("__twin", F.row_number().over(first)).where("__twin = 1").drop("__twin")


def pool_cap(k: int) -> int:
    return max(50, 4 * k)


def pack_bytes(chosen: DataFrame, limit: int) -> DataFrame:
    """q, key, place, bytes, packed: rows are taken in order while they fit; the first always, one that doesn't is skipped and later ones may still fit. chosen holds few rows a query (a result list)."""
    rows = F.array_sort(F.collect_list(F.struct("place", "key", F.octet_length("display").cast("bigint").alias("bytes"))))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<boolean>").alias("fits"))

    def step(acc: Column, row: Column) -> Column:
        fits = (F.size(acc["fits"]) == 0) | (acc["used"] + row["bytes"] <= limit)
        return F.struct((acc["used"] + F.when(fits, row["bytes"]).otherwise(F.lit(0).cast("bigint"))).alias("used"), F.concat(acc["fits"], F.array(fits)).alias("fits"))

    folded = chosen.groupBy("q").agg(rows.alias("rows")).withColumn("fits", F.aggregate("rows", start, step)["fits"])
    return folded.select("q", F.explode(F.arrays_zip("rows", "fits")).alias("x")).select("q", "x.rows.key", "x.rows.place", "x.rows.bytes", F.col("x.fits").alias("packed"))


def display(text: Column, max_chars: int) -> tuple[Column, Column]:
    """Text as shown, and whether it was cut."""
    return F.substring(text, 1, max_chars), F.length(text) > max_chars


def mmr(pool: DataFrame, k: int = 5, diversify: float = 0.5) -> DataFrame:
    """q, key, step: rows picked for relevance less redundancy. pool: q, key, score, slots and weights (sparse unit vector), at most pool_cap(k) rows a query.

    Sequential by nature; each query's bounded pool is one pandas group.
    """

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "key"], ascending=[False, True]).reset_index(drop=True)
        low, high = rows["score"].min(), rows["score"].max()
        rel = (rows["score"] - low) / (high - low) if high > low else rows["score"] * 0 + 1.0
        dim = 1 + max((max(s) for s in rows["slots"] if len(s)), default=0)
        vectors = np.zeros((len(rows), dim))
        for i, (s, w) in enumerate(zip(rows["slots"], rows["weights"], strict=True)):
            vectors[i, np.asarray(s, dtype=int)] = w
        size = np.linalg.norm(vectors, axis=1)
        vectors /= np.where(size > 0, size, 1)[:, None]
        if diversify == 0 or len(rows) <= 1 or k <= 1:
            order = list(range(min(k, len(rows))))
        else:
            order, red = [0], np.round(vectors @ vectors[0], 9)
            while len(order) < min(k, len(rows)):
                rest = [i for i in range(len(rows)) if i not in order]
                best = min(rest, key=lambda i: (-round(rel[i] - diversify * red[i], 9), -rows["score"][i], rows["key"][i]))
                order.append(best)
                red = np.maximum(red, np.round(vectors @ vectors[best], 9))
        return pd.DataFrame({"q": rows["q"].iloc[order].to_numpy(), "key": rows["key"].iloc[order].to_numpy(), "step": range(1, len(order) + 1)})

    return pool.groupBy("q").applyInPandas(pick, "q long, key string, step int")


def hash_vectors(docs: DataFrame, key: str = "key", dim: int = 256) -> DataFrame:
    """key, slot, weight: signed feature counts of identifiers and their pairs, zero sums included, a text at a time without a shuffle; each feature is hashed once a task."""
    importable(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def parse(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Hashed(dim)
        for part in parts:
            for at in range(0, part.num_rows, 256):
                piece = part.slice(at, 256)
                found = [slots(identifiers(t), hashed) for t in piece.column(1).to_pylist()]
                hit = [np.unique(s) for s, _ in found]
                weight = [np.bincount(s, sign, minlength=dim)[h].astype(np.int64) for (s, sign), h in zip(found, hit, strict=True)]
                keys = piece.column(0).take(pa.array(np.repeat(np.arange(len(hit)), [len(h) for h in hit])))
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.concatenate([*hit, []]).astype(np.int32)), pa.array(np.concatenate([*weight, []]).astype(np.int64))], names=[key, "slot", "weight"])

    return spread(docs.select(key, "text")).mapInArrow(parse, f"`{key}` {kind}, slot int, weight bigint")


def missing_vectors(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows (key, text) of which kept (key, model_sha, text_sha) has no vector of the present text under the present model."""
    now = rows.withColumn("model_sha", tx.model_identity()).withColumn("text_sha", F.sha2(F.col("text"), 256))
    return now.join(kept.select("key", "model_sha", "text_sha"), ["key", "model_sha", "text_sha"], "left_anti")
