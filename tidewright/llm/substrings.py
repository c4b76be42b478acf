"""Substring deduplication: FM-indices over shards of possibly repeated passages, searched backwards for windows that an earlier document has."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, importable, materialise, partitions, slices
from .fm_index import FMIndex
from .words_np import WordHashes, grams, hashes_of, sliding_min, split_words

WINDOW = 50
#: Words of an anchor. Each window is dealt by the least hash of its anchors, so equal windows meet.
ANCHOR = 8
#: An index is built once so many words have come together; an anchor holds less, as one with more different passages than HOT is taken apart.
INDEX_WORDS, HOT = 400_000, 4_000


def passages(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """anchor, start, windows of the maximal runs of windows with one anchor."""
    least = sliding_min(grams(h, ANCHOR), WINDOW - ANCHOR + 1)
    if not len(least):
        return least, np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    return least[starts], starts, np.diff(np.concatenate([starts, [len(least)]]))


def _content(h: np.ndarray, start: int, windows: int) -> np.ndarray:
    return h[start : start + windows + WINDOW - 1]


def _signed(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.uint64).view(np.int64), pa.int64())


def passage_rows(docs: DataFrame) -> DataFrame:
    """doc_id, anchor, start, windows, content (hash of the passage's words) of every passage of every document with an id."""

    def parse(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for part in (piece for whole in parts for piece in slices(whole, 1)):
            ids, anchors, starts, sizes, contents = [], [], [], [], []
            for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                h = hashes_of(split_words(t), known)
                if len(h) < WINDOW:
                    continue
                a, s, n = passages(h)
                ids.append(np.full(len(a), d, dtype=np.int64))
                anchors.append(a)
                starts.append(s)
                sizes.append(n)
                contents.extend(xxhash.xxh64_intdigest(_content(h, i, k)) for i, k in zip(s.tolist(), n.tolist(), strict=True))
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(ids)), _signed(np.concatenate(anchors)), pa.array(np.concatenate(starts), pa.int32()), pa.array(np.concatenate(sizes), pa.int32()), _signed(contents)],
                    names=["doc_id", "anchor", "start", "windows", "content"],
                )

    return docs.where("doc_id is not null").mapInArrow(parse, "doc_id bigint, anchor bigint, start int, windows int, content bigint")


def _words_of(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """anchor, content, doc_id, words (hashes, 8 bytes each) of the passages that stand for all with the same words."""

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for part in (piece for whole in parts for piece in slices(whole, 1)):
            rows: list[tuple] = []
            for d, t, found in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                h = hashes_of(split_words(t), known)
                for x in found:
                    words = _content(h, x["start"], x["windows"])
                    if len(words) == x["windows"] + WINDOW - 1 and np.uint64(xxhash.xxh64_intdigest(words)).astype(np.int64) == x["content"]:
                        rows.append((x["anchor"], x["content"], d, words.tobytes()))
                if len(rows) > 5_000:
                    yield _piece_batch(rows)
                    rows = []
            yield _piece_batch(rows)

    per_doc = firsts.groupBy(F.col("first.doc_id").alias("id")).agg(F.collect_list(F.struct("first.start", "windows", "anchor", "content")).alias("found"))
    # What is shared grows with the corpus: merge joins at every size.
    rows = docs.join(per_doc.hint("merge"), docs["doc_id"] == per_doc["id"]).select("doc_id", "text", "found")
    return rows.mapInArrow(cut, "anchor bigint, content bigint, doc_id bigint, words binary")


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["anchor", "content", "doc_id", "words"])


def _searched(pieces: DataFrame) -> DataFrame:
    """content, at, least: from window `at` of a passage on, `least` is the smallest doc_id in which that window starts.

    Each task gets whole anchors in order and builds one index after another, each of about INDEX_WORDS words; every
    passage of the shard is then searched in the index by backward search.
    """

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[np.ndarray] = []
        ids: list[int] = []
        contents: list[int] = []
        total, last = 0, None

        def flush() -> pa.RecordBatch:
            index = FMIndex(words, np.array(ids, dtype=np.int64), WINDOW)
            ats, docs = [], []
            for x in index.statistics(words, own=True)[1]:
                x = x[: len(x) - WINDOW + 1]
                at = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1])
                ats.append(at.tolist())
                docs.append(x[at].tolist())
            return pa.RecordBatch.from_arrays([pa.array(contents, pa.int64()), pa.array(ats, pa.list_(pa.int32())), pa.array(docs, pa.list_(pa.int64()))], names=["content", "at", "least"])

        for part in parts:
            for a, c, d, w in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                if a != last and total >= INDEX_WORDS:
                    yield flush()
                    words, ids, contents, total = [], [], [], 0
                last = a
                words.append(np.frombuffer(w, dtype=np.uint64))
                ids.append(d)
                contents.append(c)
                total += len(words[-1])
        if words:
            yield flush()

    dealt = pieces.repartition(partitions(pieces.sparkSession), "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(search, "content bigint, at array<int>, least array<bigint>")


def covered(n_words: int, found: list[dict], doc_id: int) -> np.ndarray:
    """Which words lie in a window that starts in a document with a smaller id."""
    edge = np.zeros(n_words + 1, dtype=np.int64)
    for x in found:
        ends = [*x["at"][1:], x["windows"]]
        for a, b, least in zip(x["at"], ends, x["least"], strict=True):
            if least < doc_id:
                edge[x["start"] + a] += 1
                edge[min(n_words, x["start"] + b + WINDOW - 1)] -= 1
    return np.cumsum(edge[:-1]) > 0


def _alike(rows: DataFrame) -> DataFrame:
    """Equal passages as one row: anchor, content, first (doc_id, start), last doc_id, windows."""
    return rows.groupBy("anchor", "content").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.max("doc_id").alias("last"), F.first("windows").alias("windows"))


def _single_windows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The windows of passages (doc_id, start, windows) as passages of their own, dealt by their words."""

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for part in parts:
            for piece in slices(part, 1):
                ids, starts, contents = [], [], []
                for d, t, found in zip(*(piece.column(i).to_pylist() for i in range(3)), strict=True):
                    h = hashes_of(split_words(t), known)
                    for at in sorted({x["start"] + i for x in found for i in range(x["windows"])}):
                        if at + WINDOW <= len(h):
                            ids.append(d)
                            starts.append(at)
                            contents.append(xxhash.xxh64_intdigest(_content(h, at, 1)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), _signed(contents), pa.array(starts, pa.int32()), pa.array([1] * len(ids), pa.int32()), _signed(contents)],
                    names=["doc_id", "anchor", "start", "windows", "content"],
                )

    # Written first: where few documents have hot anchors, Spark sees so and doesn't shuffle the texts of all.
    per_doc = materialise(rows.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("start", "windows")).alias("found")), "hot-documents")
    texts = docs.join(per_doc, docs["doc_id"] == per_doc["id"]).select("doc_id", "text", "found")
    return texts.mapInArrow(cut, "doc_id bigint, anchor bigint, start int, windows int, content bigint")


def shared_passages(docs: DataFrame, rows: DataFrame, hot_from: int = HOT) -> tuple[DataFrame, DataFrame]:
    """rows as dealt in the end, and one row (anchor, content, first, last, windows) for each different passage of the anchors that several documents have.

    An anchor with more different passages than hot_from (a passage of very many documents, each in its own
    surroundings) is taken apart: its windows are dealt by their own words, so equal windows are one row and no
    anchor's passages outgrow a task. Nothing is dropped.
    """
    alike = materialise(_alike(rows), "passages-alike")
    per = alike.groupBy("anchor").agg(F.count(F.lit(1)).alias("k"), F.min("first.doc_id").alias("lo"), F.max("last").alias("hi")).where("lo < hi")
    per = materialise(per.select("anchor", (F.col("k") > hot_from).alias("hot")), "shared-anchors")
    firsts = alike.join(per.where("not hot").select("anchor").hint("merge"), "anchor")
    hot = per.where("hot").select("anchor")
    if hot.limit(1).count():
        fine = materialise(_single_windows(docs, rows.join(hot, "anchor")), "hot-windows")
        firsts = firsts.unionByName(_alike(fine).where("first.doc_id < last"))
        rows = rows.join(hot, "anchor", "left_anti").select(fine.columns).unionByName(fine)
    found = materialise(firsts.select("anchor", "content", "first", "last", "windows"), "shared-passages")
    discard(alike)
    return rows, found


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, found: for documents with a window that an earlier document has, the passages concerned (start, windows, at, least)."""
    importable(docs.sparkSession)
    parsed = materialise(passage_rows(docs), "passages")
    rows, firsts = shared_passages(docs, parsed)
    pieces = _words_of(docs, firsts.select("anchor", "content", "first", "windows"))
    least = materialise(_searched(pieces), "matches").dropDuplicates(["content"])
    earlier = F.exists("least", lambda x: x < F.col("doc_id"))
    hit = rows.join(least.hint("merge"), "content").where(earlier)
    out = materialise(hit.groupBy("doc_id").agg(F.collect_list(F.struct("start", "windows", "at", "least")).alias("found")), "repeated-spans")
    for t in (parsed, firsts):
        discard(t)
    return out


def remove_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with_text, kept_text for every row of docs (doc_id, text).

    Every word covered by a window of WINDOW words that also starts in a document with a smaller doc_id goes; kept words
    are joined by one blank. Null and empty texts have no words; a null doc_id is smaller and larger than none, so those
    rows stay whole; rows that repeat a doc_id don't remove each other; very long texts are many passages, dealt like
    others; an empty table gives an empty result; other columns aren't read.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spans = repeated_spans(docs).withColumnRenamed("doc_id", "id")

    def keep(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (piece for whole in parts for piece in slices(whole, 1)):
            out: list[list] = [[], [], [], []]
            for d, t, found in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                words = split_words(t)
                gone = covered(len(words), [x for x in found if x["start"] + x["windows"] + WINDOW - 1 <= len(words)], d) if found else None
                text = b" ".join(words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                out[0].append(len(words))
                out[1].append(0 if gone is None else int(gone.sum()))
                out[2].append(hashlib.sha256(text).hexdigest())
                if with_text:
                    out[3].append(text.decode("utf-8", "surrogatepass"))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())[: 3 + with_text]
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(v, k) for v, k in zip(out, kinds, strict=False)]], names=["doc_id", *names])

    names = ["n_words", "n_removed", "kept_sha256", "kept_text"][: 3 + with_text]
    joined = docs.join(spans.hint("merge"), docs["doc_id"] == spans["id"], "left").select("doc_id", "text", "found")
    return joined.mapInArrow(keep, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * with_text)


def substring_digest(docs: DataFrame) -> DataFrame:
    """Contract of the substring query: doc_id, n_words, n_removed, kept_sha256; edge cases as in remove_repeats()."""
    return remove_repeats(docs, with_text=False)
