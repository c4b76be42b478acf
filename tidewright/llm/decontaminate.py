"""Benchmark decontamination: BM25 over word pairs of the test items, searched with block-max WAND."""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, importable, materialise, table

K1, B = 1.2, 0.75
BLOCK = 64
#: A pair's number is BASE times its first word's plus its second word's; BASE - 1 stands for no second word.
BASE = 1 << 31
#: Share of an item's score against itself that a passage must reach, and shares of 3-word runs that must be found: of the answer, if there is one, and of the question or of the item as a whole.
THETA, QUESTION, ANSWER, OVERALL = 0.35, 0.5, 0.5, 0.7
#: Bytes of test items in one index, which takes about 80 times as much memory; more items are searched by several, one pass each.
INDEX_BYTES = 4 << 20
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_LEAKS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in ("score", "question_overlap", "answer_overlap")]]))


def folded(text: str | None) -> list[bytes]:
    """Words for matching, in lower case; ASCII punctuation separates."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def question_and_answer(text: str) -> tuple[str, str]:
    """The last sentence is the answer, what stands before it the question; one sentence is all question."""
    parts = [p for p in re.split(r"(?<=[.?!])\s+|\n+", text.strip()) if p.strip()]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, "")


def runs_of(words: list[bytes], n: int = 3) -> tuple[int, np.ndarray]:
    """Length and 64-bit hashes of the distinct runs of n words; a shorter text is one run of its own length."""
    n = min(n, len(words))
    if not n:
        return 0, np.empty(0, dtype=np.uint64)
    return n, np.unique(np.array([xxhash.xxh64_intdigest(b"\0".join(words[i : i + n])) for i in range(len(words) - n + 1)], dtype=np.uint64))


class Passage:
    """The runs of a passage, of each length once asked for."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.runs: dict[int, np.ndarray] = {}

    def share(self, asked: tuple[int, np.ndarray], none: float = 0.0) -> float:
        """Which share of the runs of a text stands here; none for a text without words."""
        n, runs = asked
        if not n:
            return none
        if n not in self.runs:
            self.runs[n] = runs_of(self.words, n)[1] if len(self.words) >= n else np.empty(0, dtype=np.uint64)
        return len(np.intersect1d(runs, self.runs[n], assume_unique=True)) / len(runs)


def word_pairs(words: list[bytes]) -> list[bytes]:
    """Neighbouring words, joined by a blank; a single word stands for itself."""
    return [a + b" " + b for a, b in zip(words, words[1:], strict=False)] or words


@dataclass
class Collection:
    """Counts over all items of a benchmark: how many there are, their mean number of pairs, the longest one's words, and in how many items each pair is."""

    items: int
    mean: float
    longest: int
    df: dict[bytes, int]

    @classmethod
    def of(cls, items: Iterable[list[bytes]]) -> Collection:
        n = total = longest = 0
        df: Counter = Counter()
        for words in items:
            found = word_pairs(words)
            n, total, longest = n + 1, total + len(found), max(longest, len(words))
            df.update(set(found))
        return cls(n, total / n if n else 1.0, max(longest, 1), df)


class BlockMaxIndex:
    """Postings of word pairs (an item of one word has that word as its pair) with each posting's BM25 impact as a share of its item's own score, in blocks with their largest impact."""

    def __init__(self, items: list[tuple[int, str]], whole: Collection | None = None):
        """items: the test items of this index; whole: what is counted over all items, where these are a part of them."""
        self.items = [(i, folded(t), t) for i, t in items]
        self.items = [x for x in self.items if x[1]]
        whole = whole or Collection.of(w for _, w, _ in self.items)
        self.word_ids: dict[bytes, int] = {}
        for _, words, _ in self.items:
            for w in words:
                self.word_ids.setdefault(w, len(self.word_ids))
        pairs = [Counter(self.pairs(np.array([self.word_ids[w] for w in words], dtype=np.int64))) for _, words, _ in self.items]
        lengths = np.array([sum(p.values()) for p in pairs] or [1], dtype=float)
        words_of = list(self.word_ids)
        df = {t: whole.df[self.named(t, words_of)] for p in pairs for t in p}
        n, mean = max(1, whole.items), whole.mean
        idf = {t: math.log(1 + (n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
        self.keys = np.array(sorted(df), dtype=np.int64)
        self.lone = self.keys[self.keys % BASE == BASE - 1] // BASE
        docs, terms, shares = array("i"), array("q"), array("d")
        for d, p in enumerate(pairs):
            raw = [idf[t] * c * (K1 + 1) / (c + K1 * (1 - B + B * lengths[d] / mean)) for t, c in p.items()]
            own = sum(raw) or 1.0
            docs.extend([d] * len(raw))
            terms.extend(p)
            shares.extend(v / own for v in raw)
        # All postings in one run, by term and then by item; those of a term are at starts[t] to starts[t + 1].
        term = np.searchsorted(self.keys, np.array(terms, dtype=np.int64))
        order = np.lexsort((np.array(docs), term))
        self.docs, self.impacts = array("i", np.array(docs, np.int32)[order].tobytes()), array("d", np.array(shares, np.float64)[order].tobytes())
        count = np.bincount(term, minlength=len(self.keys))
        self.starts = np.concatenate([[0], np.cumsum(count)]).tolist()
        self.first_block = np.concatenate([[0], np.cumsum(-(-count // BLOCK))]).tolist()
        edges = np.concatenate([np.arange(a, b, BLOCK) for a, b in zip(self.starts, self.starts[1:], strict=False)] or [np.empty(0, int)]).astype(int)
        impacts = np.array(self.impacts)
        self.block_max = array("d", np.maximum.reduceat(impacts, edges).tobytes() if len(edges) else b"")
        self.upper = np.maximum.reduceat(impacts, self.starts[:-1]) if len(self.keys) else np.zeros(1)
        self.window = max(128, 2 * whole.longest)
        self.checks = []
        for _, words, text in self.items:
            q, a = question_and_answer(text)
            self.checks.append((runs_of(folded(q)), runs_of(folded(a)), runs_of(words)))
        # What a search needs no more isn't sent along.
        self.items = [(i,) for i, _, _ in self.items]

    @staticmethod
    def named(pair: int, words: list[bytes]) -> bytes:
        """The pair of a number, as word_pairs() has it."""
        a, b = divmod(pair, BASE)
        return words[a] if b == BASE - 1 else words[a] + b" " + words[b]

    def pairs(self, ids: np.ndarray) -> list[int]:
        return (ids[:-1] * BASE + ids[1:]).tolist() if len(ids) > 1 else (ids * BASE + BASE - 1).tolist()

    def posting(self, t: int) -> list[tuple[int, float]]:
        """Item and impact of a term's postings."""
        a, b = self.starts[t], self.starts[t + 1]
        return list(zip(self.docs[a:b], self.impacts[a:b], strict=True))

    def search(self, terms: list[int], theta: float) -> list[tuple[int, float]]:
        """All items whose impacts over the terms (numbers of keys, each once) sum to theta at least, by block-max WAND."""
        docs, starts, first_block, block_max = self.docs, self.starts, self.first_block, self.block_max
        cursors = [[docs[starts[t]], starts[t], t] for t in terms]
        found = []
        end = len(self.checks)
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += self.upper[c[2]]
                if bound >= theta - 1e-12:
                    pivot = k
                    break
            if pivot < 0:
                break
            doc = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == doc:
                pivot += 1
            # Shallow move: the blocks that could hold doc, and where the nearest of them ends.
            blocks, nearest = 0.0, end
            for _, at, t in cursors[: pivot + 1]:
                last = starts[t + 1]
                b = (bisect_left(docs, doc, at, last) - starts[t]) // BLOCK
                if first_block[t] + b < first_block[t + 1]:
                    blocks += block_max[first_block[t] + b]
                    nearest = min(nearest, docs[min(last, starts[t] + (b + 1) * BLOCK) - 1] + 1)
            if blocks >= theta - 1e-12:
                if cursors[0][0] == doc:
                    score = sum(self.impacts[c[1]] for c in cursors[: pivot + 1])
                    if score >= theta - 1e-12:
                        found.append((doc, score))
                    target = doc + 1
                else:
                    target = doc
            else:
                target = max(doc + 1, min(nearest, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else end))
            for c in cursors[: pivot + 1]:
                if c[0] < target:
                    last = starts[c[2] + 1]
                    c[1] = bisect_left(docs, target, c[1], last)
                    c[0] = docs[c[1]] if c[1] < last else end
            cursors = [c for c in cursors if c[0] < end]
        return found

    def leaks(self, text: str | None) -> list[tuple[int, float, float, float]]:
        """Verified items of a whole text: every passage (half overlapping) is a query."""
        words = folded(text)
        if not words or not len(self.keys):
            return []
        get = self.word_ids.get
        ids = np.array([get(w, -1) for w in words], dtype=np.int64)
        a, b = ids[:-1], ids[1:]
        at = np.flatnonzero((a >= 0) & (b >= 0))
        keys = a[at] * BASE + b[at]
        if len(self.lone):
            # A word alone is placed as the pair that it ends, so that a passage has it where it has that pair.
            single = np.flatnonzero(np.isin(ids, self.lone))
            at, keys = np.concatenate([at, np.maximum(single - 1, 0)]), np.concatenate([keys, ids[single] * BASE + BASE - 1])
            order = np.argsort(at, kind="stable")
            at, keys = at[order], keys[order]
        k = np.searchsorted(self.keys, keys)
        k[k == len(self.keys)] = 0
        hit = self.keys[k] == keys
        at, k = at[hit], k[hit]
        if not len(at) or self.upper[k].sum() < THETA:
            return []
        run = np.concatenate([[0.0], np.cumsum(self.upper[k])])
        best: dict[int, tuple[float, float, float]] = {}
        step = self.window // 2
        for start in range(0, len(words), step):
            i, j = np.searchsorted(at, start), np.searchsorted(at, start + self.window - 1)
            if run[j] - run[i] >= THETA:
                terms = np.unique(k[i:j])
                if self.upper[terms].sum() >= THETA:
                    passage = Passage(words[start : start + self.window])
                    for d, s in self.search(terms.tolist(), THETA):
                        q, a_, whole = self.checks[d]
                        qs, as_ = passage.share(q), passage.share(a_, none=1.0)
                        if as_ >= ANSWER and (qs >= QUESTION or passage.share(whole) >= OVERALL):
                            best[d] = max(best.get(d, (0.0, 0.0, 0.0)), (s, qs, as_))
            if start + self.window >= len(words):
                break
        return [(self.items[d][0], float(s), qs, as_) for d, (s, qs, as_) in sorted(best.items())]


_COUNTED = T.StructType([T.StructField("words", T.IntegerType()), T.StructField("pairs", T.IntegerType()), T.StructField("distinct", T.ArrayType(T.BinaryType()))])


def _counted(texts: pd.Series) -> pd.DataFrame:
    found = [folded(t) for t in texts]
    pairs = [word_pairs(w) for w in found]
    return pd.DataFrame({"words": [len(w) for w in found], "pairs": [len(p) for p in pairs], "distinct": [list(set(p)) for p in pairs]})


def indices(benchmark: DataFrame) -> Iterator[BlockMaxIndex]:
    """Indices over the items, each of about INDEX_BYTES of them, so what a worker holds doesn't grow with the benchmark; null ids or texts have nothing to match.

    Scores are those of one index over all items: number, mean length, longest item and each pair's count are
    aggregates over all. The driver holds one index's items at a time, and the counts of their pairs.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").dropna().distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, math.ceil(size / INDEX_BYTES))
    if n == 1:
        yield BlockMaxIndex([(r[0], r[1]) for r in items.orderBy("item_id", "text").collect()])
        return
    importable(benchmark.sparkSession)
    slice_ = F.pmod(F.xxhash64("item_id"), F.lit(n)).cast("int").alias("slice")
    parsed = materialise(items.select(slice_, F.pandas_udf(_counted, _COUNTED)("text").alias("c")).select("slice", "c.*").where("words > 0"), "item-pairs")
    number, mean, longest = parsed.agg(F.count(F.lit(1)), F.avg("pairs"), F.max("words")).first()
    pairs = parsed.select("slice", F.explode("distinct").alias("pair"))
    df = pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(pairs.distinct().join(df, "pair"), "pair-counts")
    for i in range(n):
        own = {bytes(r[0]): r[1] for r in counts.where(F.col("slice") == i).select("pair", "n").collect()}
        part = [(r[0], r[1]) for r in items.where(slice_ == i).orderBy("item_id", "text").collect()]
        yield BlockMaxIndex(part, Collection(number, mean, longest, own))
    discard(parsed)
    discard(counts)


def _searcher(sent):
    @F.pandas_udf(_LEAKS)
    def search(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = sent.value
        for s in parts:
            yield pd.Series([[dict(zip(("item_id", "score", "question_overlap", "answer_overlap"), x, strict=True)) for x in own.leaks(t)] for t in s], dtype=object)

    return search


def with_leaks(docs: DataFrame, benchmark: DataFrame, out: str = "leaks") -> DataFrame:
    """docs with out, an array of (item_id, score, question_overlap, answer_overlap) of the items that a passage of the text holds.

    Whole texts, no shuffle. Null and empty texts hold none; repeated rows are searched alike; an empty benchmark or
    table gives empty arrays; a column of this name is replaced.
    """
    spark = docs.sparkSession
    importable(spark)
    own = {c: f"__own{i}" for i, c in enumerate(c for c in docs.columns if c != out)}
    found = docs.select(*[F.col(c).alias(n) for c, n in own.items()], F.col("text").cast("string").alias("__text"), F.array().cast(_LEAKS).alias("__found"))
    for k, index in enumerate(indices(benchmark)):
        # A benchmark of several indices is searched with one after another, so workers hold one at a time.
        before = found
        found = materialise(before, "searched") if k else before
        if k > 1:
            discard(before)
        search = _searcher(spark.sparkContext.broadcast(index))
        found = found.withColumn("__found", F.concat(F.col("__found"), search(F.col("__text"))))
    return found.select(*[F.col(n).alias(c) for c, n in own.items()], F.col("__found").alias(out))


def leak_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and test item that one of its passages holds; edge cases as in with_leaks()."""
    docs = with_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return docs.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.item_id", "x.score", "x.question_overlap", "x.answer_overlap")


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without a passage of any test item, with their own columns, whatever their names; edge cases as in with_leaks()."""
    own = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), "text")
    return with_leaks(own, benchmark).where(F.size("leaks") == 0).select("row.*")
