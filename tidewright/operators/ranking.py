"""Ranking of a whole pool for many queries without its pairs: scores are made, counted and cut inside map tasks, and only counts and the few rows that can win are shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import DIM, Hashed, counts, identifiers
from ..sources.ledger import shared_folder
from .selection import RRF_OFFSET, first_of_each_text
from .workers import importable, spread

#: Queries (of one text each) that are ranked in one go; bins of a cosine's coarse counts; rows that meet the queries at once.
QUERIES, BINS, ROWS = 512, 2_048, 512
#: Scores of the result have six decimals.
HALF = 1e-6
def _unit(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    size = np.linalg.norm(m, axis=1)
    return m / np.where(size > 0, size, 1)[:, None]


def _written(df: DataFrame, label: str) -> DataFrame:
    path = shared_folder(df.sparkSession, f"ranking-{label}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Asked:
    """A block of queries: their names, the texts (lanes) of each one after another, the tokens of all, which of them each lane has, and the lanes' unit vectors, if cosines are asked for."""

    names: np.ndarray
    first: np.ndarray
    shares: np.ndarray
    vocab: dict[str, int]
    has: np.ndarray
    vectors: np.ndarray | None

    @classmethod
    def of(cls, queries: list[tuple[int, list[str]]], cosines: bool = True) -> Asked:
        words, hashed = [identifiers(t) for _, ts in queries for t in ts], Hashed()
        vocab = {w: i for i, w in enumerate(sorted({w for ws in words for w in ws}))}
        has = np.zeros((len(vocab) + 1, len(words)), dtype=np.int16)
        for j, ws in enumerate(words):
            has[[vocab[w] for w in set(ws)], j] = 1
        lanes = np.array([len(ts) for _, ts in queries], dtype=np.int64)
        first = np.concatenate([[0], np.cumsum(lanes)[:-1]])
        vectors = _unit(np.array([counts(ws, hashed) for ws in words])) if cosines else None
        return cls(np.array([q for q, _ in queries], dtype=np.int64), first, np.repeat(1.0 / lanes, lanes), vocab, has, vectors)

    @property
    def lanes(self) -> int:
        return len(self.shares)

    def of_lane(self) -> np.ndarray:
        """Which query each lane belongs to."""
        return np.repeat(np.arange(len(self.names)), np.diff(np.append(self.first, self.lanes)))

    def scores(self, ids: list[bytes], vectors: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hits and cosines (six decimals; zeros if they aren't asked for) of some rows with every lane."""
        hits = np.array([self.has[np.frombuffer(x, np.int32)].sum(axis=0) for x in ids], dtype=np.int32).reshape(len(ids), -1)
        if self.vectors is None:
            return hits, np.zeros(hits.shape)
        rows = _unit(np.frombuffer(b"".join(vectors), np.int32).reshape(len(vectors), DIM))
        return hits, np.clip(np.round(rows @ self.vectors.T, 6), -1, 1) + 0.0


def _blocks(queries: DataFrame, cosines: bool) -> Iterator[Asked]:
    """Queries (q, text; a q may have several texts) QUERIES at a time."""
    texts: dict[int, list[str]] = {}
    for q, t in sorted((r["q"], r["text"] or "") for r in queries.select(F.col("q").cast("bigint").alias("q"), "text").collect()):
        texts.setdefault(q, []).append(t)
    asked = list(texts.items())
    for at in range(0, len(asked), QUERIES):
        yield Asked.of(asked[at : at + QUERIES], cosines)


def _prepared(pool: DataFrame, asked: Asked) -> DataFrame:
    """key, votes, copies, ids (tokens of the queries that the text, or what column more adds to it, has) and v (the text's counts, if cosines are asked for), each text read once."""
    more = F.col("more") if "more" in pool.columns else F.lit(None).cast("string")

    def parse(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, get = Hashed(), asked.vocab.get
        for part in parts:
            for at in range(0, part.num_rows, ROWS):
                piece = part.slice(at, ROWS)
                words = [identifiers(t) for t in piece.column(3).to_pylist()]
                added = [identifiers(t) if t else [] for t in piece.column(4).to_pylist()]
                ids = [np.array([i for w in {*ws, *more_} if (i := get(w)) is not None], dtype=np.int32).tobytes() for ws, more_ in zip(words, added, strict=True)]
                v = [b""] * len(words) if asked.vectors is None else [counts(ws, hashed).tobytes() for ws in words]
                yield pa.RecordBatch.from_arrays([*piece.columns[:3], pa.array(ids, pa.binary()), pa.array(v, pa.binary())], names=["key", "votes", "copies", "ids", "v"])

    return _written(spread(pool.select("key", "votes", "copies", "text", more.alias("more"))).mapInArrow(parse, "key string, votes double, copies bigint, ids binary, v binary"), "rows")


def _pieces(parts: Iterator[pa.RecordBatch], asked: Asked) -> Iterator[tuple]:
    """Keys, votes, copies, hits and cosines of some rows at a time."""
    for part in parts:
        for at in range(0, part.num_rows, ROWS):
            p = part.slice(at, ROWS)
            yield p.column(0).to_pylist(), np.asarray(p.column(1)), np.asarray(p.column(2)), *asked.scores(p.column(3).to_pylist(), p.column(4).to_pylist())


def _bin(cos: np.ndarray) -> np.ndarray:
    return np.minimum(((cos + 1) * (BINS / 2)).astype(np.int32), BINS - 1)


def _counted(rows: DataFrame, asked: Asked) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows by hits, rows by a cosine's bin, and the least and largest cosine, for each lane; a task sends what it has counted, the driver gets one count a lane and bin."""
    q, most = asked.lanes, int(asked.has.sum(axis=0).max(initial=0)) + 1

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((q, most + BINS), dtype=np.int64)
        low, high = np.full(q, 2.0), np.full(q, -2.0)
        lane = np.arange(q)
        for _, _, copies, hits, cos in _pieces(parts, asked):
            np.add.at(both, (lane[None], hits), copies[:, None])
            np.add.at(both, (lane[None], most + _bin(cos)), copies[:, None])
            low, high = np.minimum(low, cos.min(axis=0)), np.maximum(high, cos.max(axis=0))
        i, b = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(b, pa.int32()), pa.array(both[i, b]), pa.array(low[i]), pa.array(high[i])], names=["i", "b", "n", "low", "high"])

    got = rows.mapInArrow(count, "i int, b int, n bigint, low double, high double").groupBy("i", "b").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).toPandas()
    both, ends = np.zeros((q, most + BINS), dtype=np.int64), np.tile([2.0, -2.0], (q, 1))
    both[got["i"], got["b"]] = got["n"]
    np.minimum.at(ends[:, 0], got["i"], got["low"])
    np.maximum.at(ends[:, 1], got["i"], got["high"])
    return both[:, :most], both[:, most:], ends


def _above(n: np.ndarray) -> np.ndarray:
    """How many rows have a higher bin."""
    return n[:, ::-1].cumsum(axis=1)[:, ::-1] - n


@dataclass(frozen=True)
class Votes:
    """For each lane the vote by hits with its rank, and the bounds of the vote by a cosine's bin; zeros where the channel abstains."""

    lexical: np.ndarray
    rank: np.ndarray
    least: np.ndarray
    most: np.ndarray
    semantic: np.ndarray


def _votes(asked: Asked, hits: np.ndarray, bins: np.ndarray, ends: np.ndarray, weights: dict[str, float]) -> Votes:
    """A query's lanes share the weight of each channel."""
    rank = _above(hits) + (hits + 1) / 2
    w = weights.get("lexical", 0) * asked.shares
    speaks = ((hits > 0).sum(axis=1) > 1) & (w > 0)
    lexical = np.where(speaks[:, None], w[:, None] / (RRF_OFFSET + rank), 0.0)
    w, before = weights.get("semantic", 0) * asked.shares, _above(bins)
    speaks = (ends[:, 0] < ends[:, 1]) & (w > 0)
    least, most = (np.where(speaks[:, None], w[:, None] / (RRF_OFFSET + before + x), 0.0) for x in (np.maximum(bins, 1), 1))
    return Votes(lexical, rank, least, most, speaks)


_FOUND = pa.schema([("i", pa.int32()), ("key", pa.string()), ("votes", pa.float64()), ("copies", pa.int64()), ("hits", pa.list_(pa.int32())), ("cos", pa.list_(pa.float64())), ("low", pa.float64()), ("high", pa.float64())])


class _Held:
    """The rows of a query that a task holds while they still can win: thinned whenever they have doubled, so a few times k."""

    def __init__(self, k: int):
        self.k, self.rows, self.room = k, [], 4 * k + 64

    def add(self, row: tuple, sure: float) -> None:
        self.rows.append(row)
        if len(self.rows) > self.room:
            self.rows = self.thinned(sure)
            self.room = max(4 * self.k + 64, 2 * len(self.rows))

    def thinned(self, sure: float) -> list[tuple]:
        """Rows that k others don't surely beat, at most k of each score."""
        kept, alike = [], {}
        for r in sorted(r for r in self.rows if r[6] >= sure - 2 * HALF):
            same = (r[1], r[3], r[4])
            alike[same] = alike.get(same, 0) + 1
            if alike[same] <= self.k:
                kept.append(r)
        return kept


def _candidates(rows: DataFrame, asked: Asked, votes: Votes, k: int) -> DataFrame:
    """i, key, votes, copies, hits, cos, low, high: rows that no k others of their task surely beat, with their scores lane by lane; of rows alike in all scores the first k by key."""

    def pick(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, lane = len(asked.names), np.arange(asked.lanes)
        until = np.append(asked.first, asked.lanes)[1:]
        sure = np.full((q, k), -np.inf)
        held = [_Held(k) for _ in range(q)]
        for keys, own, copies, hits, cos in _pieces(parts, asked):
            b = _bin(cos)
            summed = lambda x, own=own: np.add.reduceat(x, asked.first, axis=1) + own[:, None]
            lexical = votes.lexical[lane[None], hits]
            low, high = summed(lexical + votes.least[lane[None], b]), summed(lexical + votes.most[lane[None], b])
            sure = np.sort(np.vstack([sure.T, low]), axis=0)[-k:].T
            for r, i in zip(*np.nonzero(high >= sure[:, 0][None] - 2 * HALF), strict=True):
                span = slice(asked.first[i], until[i])
                held[i].add((keys[r], float(own[r]), int(copies[r]), tuple(hits[r, span].tolist()), tuple(cos[r, span].tolist()), float(low[r, i]), float(high[r, i])), sure[i, 0])
        out = [(i, *r) for i in range(q) for r in held[i].thinned(sure[i, 0])]
        columns = zip(*out, strict=True) if out else [[] for _ in _FOUND]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND, strict=True)], schema=_FOUND)

    found = rows.mapInArrow(pick, "i int, key string, votes double, copies bigint, hits array<int>, cos array<double>, low double, high double")
    alike = Window.partitionBy("i", "votes", "hits", "cos").orderBy("key")
    best = Window.partitionBy("i").orderBy(F.desc("low"))
    found = _written(found.withColumn("n", F.row_number().over(alike)).where(F.col("n") <= k).drop("n"), "candidates")
    sure = found.select("i", "low", F.row_number().over(best).alias("n")).where(F.col("n") == k).select("i", F.col("low").alias("sure"))
    return found.join(sure, "i", "left").where(F.col("sure").isNull() | (F.col("high") >= F.col("sure") - 2 * HALF)).drop("sure")


def _exact(rows: DataFrame, asked: Asked, wanted: list[np.ndarray]) -> DataFrame:
    """lane, cos, rank of the cosines wanted of each lane, counted over all rows."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over = [np.zeros(len(w) + 1, dtype=np.int64) for w in wanted]
        same = [np.zeros(len(w), dtype=np.int64) for w in wanted]
        for _, _, copies, _, cos in _pieces(parts, asked):
            for i, w in enumerate(wanted):
                # Rows above the j-th wanted cosine are those that come after more than j of them.
                below, upto = np.searchsorted(w, cos[:, i], "left"), np.searchsorted(w, cos[:, i], "right")
                over[i] += np.bincount(below, copies, minlength=len(w) + 1).astype(np.int64)
                hit = below < upto
                same[i] += np.bincount(below[hit], copies[hit], minlength=len(w)).astype(np.int64)
        for i, w in enumerate(wanted):
            more = over[i][::-1].cumsum()[::-1][1:]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), i), pa.int32()), pa.array(w), pa.array(more), pa.array(same[i])], names=["lane", "cos", "more", "same"])

    got = rows.mapInArrow(count, "lane int, cos double, more bigint, same bigint").groupBy("lane", "cos").agg(F.sum("more").alias("more"), F.sum("same").alias("same"))
    return got.select("lane", "cos", (F.col("more") + (F.col("same") + 1) / 2).alias("rank"))


def best_ranks(pool: DataFrame, queries: DataFrame) -> DataFrame:
    """key, lexical, semantic: the best average rank of each row (key, text) in either channel over all queries (q, text).

    No pairs are shuffled: ranks by hits come from counts. Ranks by cosine are bounded by coarse bins first, so a row
    asks for its exact rank only where it can be its best, and cosines are counted one by one only in bins in which
    some row asks. Queries are a stated set, ranked QUERIES at a time.
    """
    spark = pool.sparkSession
    importable(spark)
    out = spark.createDataFrame([], "key string, lexical double, semantic double")
    rows = pool.select("key", "text", F.lit(0.0).alias("votes"), F.lit(1).cast("bigint").alias("copies"))
    for asked in _blocks(queries, True):
        held = _prepared(rows, asked)
        hits, bins, _ = _counted(held, asked)
        lexical, before, lane = _above(hits) + (hits + 1) / 2, _above(bins), np.arange(asked.lanes)

        def ask(parts: Iterator[pa.RecordBatch], asked=asked, lexical=lexical, before=before, bins=bins, lane=lane) -> Iterator[pa.RecordBatch]:
            for keys, _, _, hit, cos in _pieces(parts, asked):
                b = _bin(cos)
                least, most = before[lane[None], b] + 1, before[lane[None], b] + bins[lane[None], b]
                can = least <= most.min(axis=1)[:, None]
                best = lexical[lane[None], hit].min(axis=1)
                r, i = np.nonzero(can)
                at = np.append(0, np.cumsum(can.sum(axis=1))).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x)) for x in (i.astype(np.int32), b[r, i].astype(np.int32), _micro(cos[r, i]))]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(best), *lists], names=["key", "lexical", "lane", "bin", "cos"])

        found = _written(held.mapInArrow(ask, "key string, lexical double, lane array<int>, bin array<int>, cos array<bigint>"), "asking")
        each = found.select("key", "lexical", F.explode(F.arrays_zip("lane", "bin", "cos")).alias("x")).select("key", "lexical", "x.*")
        wanted = np.zeros(bins.shape, dtype=bool)
        for i, b in each.select("lane", "bin").distinct().collect():
            wanted[i, b] = True

        def count(parts: Iterator[pa.RecordBatch], asked=asked, wanted=wanted, lane=lane) -> Iterator[pa.RecordBatch]:
            for _, _, _, _, cos in _pieces(parts, asked):
                b = _bin(cos)
                r, i = np.nonzero(wanted[lane[None], b])
                one, n = np.unique(np.stack([i, b[r, i], _micro(cos[r, i])]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([*[pa.array(x, t) for x, t in zip(one, (pa.int32(), pa.int32(), pa.int64()), strict=True)], pa.array(n)], names=["lane", "bin", "cos", "n"])

        counted = held.mapInArrow(count, "lane int, bin int, cos bigint, n bigint").groupBy("lane", "bin", "cos").agg(F.sum("n").alias("n"))
        higher = F.coalesce(F.sum("n").over(Window.partitionBy("lane", "bin").orderBy(F.desc("cos")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = spark.createDataFrame([(int(i), int(b), int(before[i, b])) for i, b in zip(*np.nonzero(wanted), strict=True)], "lane int, bin int, before bigint")
        ranks = counted.withColumn("higher", higher).join(starts, ["lane", "bin"]).select("lane", "cos", (F.col("before") + F.col("higher") + (F.col("n") + 1) / 2).alias("rank"))
        out = out.unionByName(each.join(ranks, ["lane", "cos"]).groupBy("key").agg(F.min("lexical").alias("lexical"), F.min("rank").alias("semantic")))
    return out.groupBy("key").agg(F.min("lexical").alias("lexical"), F.min("semantic").alias("semantic"))


def _micro(cos: np.ndarray) -> np.ndarray:
    """Cosines of six decimals as whole numbers."""
    return np.rint(cos * 1e6).astype(np.int64)


def fused(pool: DataFrame, queries: DataFrame, k: int, weights: dict[str, float]) -> DataFrame:
    """q, key, score, lexical_rank, semantic_rank, copies, asked (the votes of channels that ask), place of the k best rows of the pool (key, text, votes, copies) for each query (q, text), by reciprocal rank fusion.

    Every row is scored with every query inside map tasks, in passes over the rows' tokens and vectors: the first counts
    hits and coarse bins of cosines, which bound every vote; the second keeps the rows whose bound the k-th best can't
    beat; the third, if cosines vote, counts the exact ranks of these. So the result is that of ranking all pairs, ties
    by average rank and score ties by key, while what is shuffled are counts a task and the rows that can win.

    A q may come with several texts: each votes with its share of a channel's weight, and the ranks told are the best
    over them. A column more adds tokens to a row's text. copies is how many rows a row stands for; votes are those of
    channels that don't ask. Channels of weight 0, and those in which all rows score alike, abstain. Queries are a
    stated set, ranked QUERIES at a time.
    """
    spark = pool.sparkSession
    importable(spark)
    cosines = weights.get("semantic", 0) > 0
    out = spark.createDataFrame([], "q bigint, key string, score double, lexical_rank double, semantic_rank double, copies bigint, asked double, place int")
    for asked in _blocks(queries, cosines):
        rows = _prepared(pool, asked)
        hits, bins, ends = _counted(rows, asked)
        votes = _votes(asked, hits, bins, ends, weights)
        found = _written(_candidates(rows, asked, votes, k), "winners")
        lanes = found.select("i", "key", "votes", "copies", F.posexplode(F.arrays_zip("hits", "cos")).alias("n", "x")).select("i", "key", "votes", "copies", "n", "x.hits", "x.cos")
        firsts = [(i, int(n), int(f)) for i, (n, f) in enumerate(zip(asked.names, asked.first, strict=True))]
        lanes = lanes.join(spark.createDataFrame(firsts, "i int, q bigint, first int"), "i").withColumn("lane", F.col("first") + F.col("n"))
        table = [(int(i), int(h), float(votes.lexical[i, h]), float(votes.rank[i, h])) for i, h in zip(*np.nonzero(hits), strict=True)]
        lanes = lanes.join(spark.createDataFrame(table, "lane int, hits int, lexical double, lexical_rank double"), ["lane", "hits"])
        if cosines:
            wanted: list[list[float]] = [[] for _ in range(asked.lanes)]
            for i, c in lanes.select("lane", "cos").distinct().collect():
                wanted[i].append(c)
            ranks = _exact(rows, asked, [np.array(sorted(w), dtype=np.float64) for w in wanted])
            weigh = [(i, float(weights["semantic"] * s) if votes.semantic[i] else 0.0) for i, s in enumerate(asked.shares)]
            lanes = lanes.join(ranks, ["lane", "cos"]).join(spark.createDataFrame(weigh, "lane int, weight double"), "lane").withColumn("semantic", F.col("weight") / (F.lit(RRF_OFFSET) + F.col("rank")))
        else:
            lanes = lanes.withColumn("rank", F.lit(None).cast("double")).withColumn("semantic", F.lit(0.0))
        per = lanes.groupBy("q", "key", "votes", "copies").agg(F.sum("lexical").alias("l"), F.sum("semantic").alias("s"), F.min("lexical_rank").alias("lexical_rank"), F.min("rank").alias("semantic_rank"))
        scored = per.select("q", "key", F.round(F.col("l") + F.col("s") + F.col("votes"), 6).alias("score"), "lexical_rank", "semantic_rank", "copies", (F.col("l") + F.col("s")).alias("asked"))
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "key"))
        out = out.unionByName(_written(scored.withColumn("place", place).where(F.col("place") <= k), "best"))
    return out


def copies_before(rows: DataFrame, walked: DataFrame, cap: int) -> DataFrame:
    """q, deduped: the rows that a walk over the whole ranking skips as copies before it holds cap texts.

    rows: key, text_sha, votes of all rows; walked: q, key, score, asked, place, text_sha of the first cap different texts of each
    query. Copies of a text have its votes of the channels that ask, and their own others. They are counted where they
    are read; the walked texts, cap for each of a stated set of queries, go to the tasks with the plan.
    """
    importable(rows.sparkSession)
    got = walked.select("q", "key", "score", "asked", "place", "text_sha").collect()
    last = {r["q"]: (r["score"], r["key"]) for r in got if r["place"] == cap}
    of: dict[str, list[tuple]] = {}
    for r in got:
        of.setdefault(r["text_sha"], []).append((r["q"], r["key"], r["asked"], *last.get(r["q"], (None, None))))

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skipped: dict[int, int] = {}
        for part in parts:
            for key, sha, votes in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                for q, first, asked, score, end in of.get(sha, ()):
                    own = round(asked + votes, 6)
                    if key != first and (score is None or own > score or (own == score and key < end)):
                        skipped[q] = skipped.get(q, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(skipped), pa.int64()), pa.array(list(skipped.values()), pa.int64())], names=["q", "n"])

    return rows.select("key", "text_sha", "votes").mapInArrow(count, "q bigint, n bigint").groupBy("q").agg(F.sum("n").alias("deduped"))


def lexical_top(docs: DataFrame, queries: DataFrame, static: DataFrame, k: int = 5, weight: float = 1.0, distinct: bool = False) -> DataFrame:
    """q, key, score, place of the k best rows for each query: the lexical channel and the votes in static (key, votes: one row for every row of the pool). With distinct, the k best rows of different texts, with copies, the number of rows of each text; ranks are still those among all rows."""
    if distinct:
        static = first_of_each_text(docs, static)
    pool = docs.select("key", "text").join(static, "key")
    pool = pool if distinct else pool.withColumn("copies", F.lit(1).cast("bigint"))
    best = fused(pool, queries, k, {"lexical": weight})
    return best.select("q", "key", "score", *(["copies"] if distinct else []), "place")


def nearest_texts(pool: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """q, key, score, place of the k rows (key, text) whose hashed vectors are most like each query's (q, text): a task keeps its k best, in one pass."""
    spark = pool.sparkSession
    importable(spark)
    out = spark.createDataFrame([], "q bigint, key string, score double")
    for asked in _blocks(queries, True):
        out = out.unionByName(spread(pool.select("key", "text")).mapInArrow(_best_of(asked, k), "q bigint, key string, score double"))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "key"))
    return out.withColumn("place", place).where(F.col("place") <= k)


def _best_of(asked: Asked, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def go(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Hashed()
        held: list[list[tuple[float, str]]] = [[] for _ in asked.names]
        for part in parts:
            for at in range(0, part.num_rows, ROWS):
                piece = part.slice(at, ROWS)
                keys = piece.column(0).to_pylist()
                rows = _unit(np.array([counts(identifiers(t), hashed) for t in piece.column(1).to_pylist()]))
                cos = np.round(rows @ asked.vectors.T, 6) + 0.0
                for i in range(len(asked.names)):
                    c = cos[:, i]
                    least = -held[i][-1][0] if len(held[i]) == k else -np.inf
                    if len(new := np.flatnonzero(c >= least)):
                        held[i] = sorted([*held[i], *((-float(c[r]), keys[r]) for r in new)])[:k]
        out = [(int(q), key, -s + 0.0) for q, own in zip(asked.names, held, strict=True) for s, key in own]
        columns = zip(*out, strict=True) if out else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.float64()), strict=True)], names=["q", "key", "score"])

    return go
