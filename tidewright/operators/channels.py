"""Channels that score every row of a pool for every query, and their fusion with static ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx
from ..functions.features import Hashed, counts, identifiers
from .selection import RRF_OFFSET
from .workers import importable, spread

#: Bytes of query vectors that one job broadcasts; more queries are scored in several blocks.
BLOCK_BYTES = 32 << 20


def dense_vectors(rows: DataFrame, key: str, dim: int = 256) -> DataFrame:
    """key, v: hashed feature counts as one array a row; a text without identifiers has zeros. One pass, no shuffle."""
    importable(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()

    def parse(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Hashed(dim)
        for part in parts:
            for at in range(0, part.num_rows, 512):
                piece = part.slice(at, 512)
                v = [counts(identifiers(t), hashed).astype(np.float64) for t in piece.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(v, pa.list_(pa.float64()))], names=[key, "v"])

    return spread(rows.select(key, "text")).mapInArrow(parse, f"`{key}` {kind}, v array<double>")


def cosine_scores(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """q, key, semantic: cosine of every row (key, v) with every query (q, v), six decimals, 0 where a vector is. The queries
    are a stated set; their vectors are broadcast in blocks of BLOCK_BYTES and multiplied a batch of rows at a time."""
    importable(docs.sparkSession)
    asked = sorted((r["q"], r["v"]) for r in queries.select("q", "v").collect())
    parts = []
    width = max(1, BLOCK_BYTES // (8 * max(1, len(asked[0][1]) if asked else 1)))
    for i in range(0, len(asked), width):
        names, matrix = [q for q, _ in asked[i : i + width]], _unit(np.array([v for _, v in asked[i : i + width]], dtype=float))

        def score(batches: Iterator[pa.RecordBatch], names=names, matrix=matrix) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 512):
                    piece = b.slice(at, 512)
                    rows = _unit(np.array(piece.column(1).to_pylist(), dtype=float))
                    cos = np.round(rows @ matrix.T, 6) + 0.0
                    keys = piece.column(0).take(pa.array(np.repeat(np.arange(len(rows)), len(names))))
                    yield pa.RecordBatch.from_arrays([pa.array(np.tile(names, len(rows)), pa.int64()), keys, pa.array(cos.ravel())], names=["q", "key", "semantic"])

        parts.append(docs.select("key", "v").mapInArrow(score, "q bigint, key string, semantic double"))
    if not parts:
        return docs.sparkSession.createDataFrame([], "q bigint, key string, semantic double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1)
    return m / np.where(size > 0, size, 1)[:, None]


def ranked_votes(pairs: DataFrame, channel: str, weight: float) -> DataFrame:
    """pairs with <channel>_vote: weight / (60 + average rank among the query's rows); 0 where all score alike. Ranks come from counts a score."""
    kinds = pairs.groupBy("q", channel).agg(F.count(F.lit(1)).alias("__n"))
    order = Window.partitionBy("q").orderBy(F.desc(channel)).rowsBetween(Window.unboundedPreceding, -1)
    rank = F.coalesce(F.sum("__n").over(order), F.lit(0)) + (F.col("__n") + 1) / 2
    many = F.count(F.lit(1)).over(Window.partitionBy("q"))
    vote = F.when(many > 1, F.lit(float(weight)) / (F.lit(RRF_OFFSET) + rank)).otherwise(F.lit(0.0))
    return pairs.join(kinds.select("q", channel, rank.alias(f"{channel}_rank"), vote.alias(f"{channel}_vote")), ["q", channel])


def fuse(pairs: DataFrame, weights: dict[str, float], static: DataFrame | None = None) -> DataFrame:
    """q, key, score and each channel's rank: the votes of several channels of every pair, and static ones (key, votes); channels of weight 0 or less don't vote."""
    total, ranks = F.lit(0.0), []
    for channel, weight in weights.items():
        if weight > 0:
            pairs = ranked_votes(pairs, channel, weight)
            total, ranks = total + F.col(f"{channel}_vote"), [*ranks, f"{channel}_rank"]
    if static is not None:
        pairs, total = pairs.join(static, "key"), total + F.col("votes")
    return pairs.select("q", "key", F.round(total, 6).alias("score"), *ranks)


def rerank(ranked: DataFrame, judged: DataFrame, window: int) -> DataFrame:
    """ranked (q, key, score, place) anew: the first `window` places by (judge, score, key), a missing judgement counting -1; the rest keep their order.

    judged: q, key, judge (0 to 10; clamped). Without any judgement for a query its order stays.
    """
    j = judged.select("q", "key", F.greatest(F.lit(0), F.least(F.lit(10), F.col("judge").cast("int"))).alias("judge"))
    rows = ranked.join(j, ["q", "key"], "left").withColumn("judge", F.coalesce("judge", F.lit(-1)))
    any_ = F.max("judge").over(Window.partitionBy("q")) >= 0
    inside = (F.col("place") <= window) & any_
    order = [F.when(inside, 0).otherwise(1), F.when(inside, -F.col("judge")).otherwise(F.col("place")), F.desc("score"), "key"]
    return rows.withColumn("reranked", inside).withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(*order)))


def shown(rows: DataFrame, summaries: DataFrame, max_chars: int) -> DataFrame:
    """rows (key, text) with display, summarized and truncated: the text if short enough, else its kept summary if that is of this very text, else the text cut. summaries: key, text_sha, summary."""
    j = rows.withColumn("text_sha", F.sha2("text", 256)).join(summaries, ["key", "text_sha"], "left")
    long = F.length("text") > max_chars
    summarized = long & F.col("summary").isNotNull()
    display = F.when(summarized, F.col("summary")).otherwise(F.substring("text", 1, max_chars))
    return j.withColumn("display", display).withColumn("summarized", summarized).withColumn("truncated", long & ~summarized)


def record_uses(chosen: DataFrame, kept: DataFrame, tracked: bool = True) -> DataFrame:
    """Rows (task_id, key) that the selection ledger doesn't have yet; none in a preview or for no task."""
    new = chosen.where(F.col("task_id").isNotNull() & F.lit(tracked)).select("task_id", "key").distinct()
    return new.join(kept.select("task_id", "key"), ["task_id", "key"], "left_anti")


def store_vectors(new: DataFrame, kept: DataFrame) -> DataFrame:
    """The vector table after a batch: of each (object_id, model_sha) the new row where there is one, of several the last. Columns: object_id, model_sha, seq, vec."""
    last = new.groupBy("object_id", "model_sha").agg(F.max_by(F.struct("seq", "vec"), "seq").alias("r")).select("object_id", "model_sha", "r.seq", "r.vec")
    return kept.join(last.select("object_id", "model_sha"), ["object_id", "model_sha"], "left_anti").unionByName(last)


def bucket_of(token: Column, count: int) -> Column:
    """A token's SHA-256, read as one number, modulo count (up to 2^31): a remainder carried over the hex digits, seven at a time, so nothing leaves 63 bits."""
    digest = F.sha2(token, 256)
    rest = F.lit(0).cast("bigint")
    for at in range(0, 64, 7):
        width = min(7, 64 - at)
        digits = F.conv(F.substring(digest, at + 1, width), 16, 10).cast("bigint")
        rest = F.pmod(rest * F.lit(pow(16, width)) + digits, F.lit(count).cast("bigint"))
    return rest


def weights_vectors(rows: DataFrame, key: str, vocab: DataFrame, buckets: DataFrame | None = None, dim: int | None = None) -> DataFrame:
    """key, v: sums of the vectors of a text's tokens, scaled to length 1 (zeros stay). vocab: token, vec; a token outside it
    takes the bucket of its SHA-256 modulo their number, if there are buckets (bucket, vec), else nothing."""
    tokens = rows.select(key, F.explode(tx.tokens(F.col("text"))).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))
    j = tokens.join(vocab, "token", "left")
    if buckets is not None:
        other = buckets.select("bucket", F.col("vec").alias("__other"))
        j = j.withColumn("bucket", bucket_of(F.col("token"), buckets.count())).join(other, "bucket", "left").withColumn("vec", F.coalesce("vec", "__other"))
    parts = j.where("vec is not null").select(key, "n", F.posexplode("vec").alias("i", "x")).groupBy(key, "i").agg(F.sum(F.col("n") * F.col("x")).alias("x"))
    sums = parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda r: r["x"]).alias("v"))
    zeros = F.array_repeat(F.lit(0.0), F.lit(dim or len(vocab.first()["vec"])))
    return rows.select(key).join(sums, key, "left").select(key, vx.unit(F.coalesce("v", zeros)).alias("v"))
