"""SimHash near-duplicates: fingerprints that differ in few bits, found by comparing bit planes of whole blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, importable, materialise, partitions, slices
from .jaccard import components

SHINGLE, SEED, RADIUS, BITS = 3, 42, 3, 64
#: Shingles whose bits are counted at once.
COUNTED = 1 << 16
#: Fingerprints that a group holds at most, and about how many the first cut aims at.
GROUP, AIM = 4_096, 512
#: Words of 64 fingerprints that are compared at once, and bit planes between two looks at what is still within the radius.
WORDS, PLANES = 8_192, 8
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None) -> int:
    """64 bits, each set if it is in more than half of the shingles' hashes; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(words) - SHINGLE + 1)
    last = ends[min(SHINGLE, len(words)) - 1 :] - 1
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, COUNTED):
        spans = map(slice, starts[at : min(n, at + COUNTED)].tolist(), last[at : at + COUNTED].tolist())
        h = np.fromiter(map(xxhash.xxh64_intdigest, map(line.__getitem__, spans), repeat(SEED)), dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a bigint of the same bits)."""
    importable(docs.sparkSession)

    def parse(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for piece in slices(part, 1):
                found = np.array([fingerprint(t) for t in piece.column(1).to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(parse, "doc_id bigint, fp bigint")


def planes(fps: np.ndarray) -> np.ndarray:
    """The bits of some fingerprints stored vertically: row p holds bit p of all, 64 of them a word; the last word is filled up with copies of the last one."""
    words = -(-len(fps) // BITS)
    full = np.append(fps, np.repeat(fps[-1:], words * BITS - len(fps)))
    bits = np.unpackbits(full.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def near_words(vertical: np.ndarray, asked: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query, word, lanes: the words in which some of 64 fingerprints are within RADIUS of a query, and a bit for each of them.

    Two planes of a carry-save counter hold each lane's distance up to 3; a carry out of them marks the lane as beyond
    the radius for good, and words whose lanes all are beyond it are left. order: the bits, those that tell most apart first.
    """
    query, word = (x.ravel() for x in np.meshgrid(np.arange(len(asked)), np.arange(vertical.shape[1]), indexing="ij"))
    ones, twos, beyond = (np.zeros(len(query), dtype=np.uint64) for _ in range(3))
    for at, p in enumerate(order):
        wanted = np.where((asked >> np.uint64(p)) & np.uint64(1), _ONES, np.uint64(0))
        differ = vertical[p][word] ^ wanted[query]
        carry = ones & differ
        ones ^= differ
        beyond |= twos & carry
        twos ^= carry
        if at % PLANES == PLANES - 1:
            left = np.flatnonzero(beyond != _ONES)
            if len(left) < len(query):
                query, word, ones, twos, beyond = (x[left] for x in (query, word, ones, twos, beyond))
                if not len(left):
                    break
    return query, word, ~beyond


def stars(fps: np.ndarray, fixed: int) -> np.ndarray:
    """For each of some different fingerprints the first that it reaches by links within the group; fixed: bits in which all agree."""
    m = len(fps)
    lead = np.arange(m)
    if m == 1:
        return lead
    vertical = planes(fps)
    free = np.array([p for p in range(BITS) if not fixed >> p & 1], dtype=np.int64)
    set_ = ((fps[:, None] >> free.astype(np.uint64)) & np.uint64(1)).sum(axis=0)
    order = free[np.argsort(np.abs(2 * set_.astype(np.int64) - m), kind="stable")]
    step = max(1, WORDS // vertical.shape[1])
    for at in range(0, m, step):
        query, word, lanes = near_words(vertical, fps[at : at + step], order)
        bits = np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, lane = np.nonzero(bits)
        a, b = query[row] + at, word[row] * BITS + lane
        keep = (b < m) & (b > a)
        a, b = a[keep], b[keep]
        for q, first in zip(*np.unique(a, return_index=True), strict=True):
            near = np.append(b[first : np.searchsorted(a, q, side="right")], q)
            labels = np.unique(lead[near])
            if len(labels) > 1:
                lead[np.isin(lead, labels)] = labels[0]
    return lead


def parts_of(free: list[int], n: int) -> list[int]:
    """free bits in n runs of nearly equal length, as masks; empty runs are left out."""
    cuts = [len(free) * i // n for i in range(n + 1)]
    return [sum(1 << p for p in free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


@lru_cache(maxsize=65_536)
def children(mask: int, segment: int) -> list[tuple[int, int]]:
    """mask, segment of the next cut of a group that agrees on mask.

    The group stands for the pairs that agree on its segment: on the rest of that first, and then, as they differ in
    RADIUS bits at most, on one at least of RADIUS + 1 parts of the other bits.
    """
    if mask & segment != segment:
        return [(mask | segment, segment)]
    free = [p for p in range(BITS) if not mask >> p & 1]
    return [(mask | part, mask | part) for part in parts_of(free, RADIUS + 1)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _cut(rows: DataFrame) -> DataFrame:
    """The groups that the members of a group go on to."""

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            mask, segment, fp = (part.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(3))
            out: list[tuple[np.ndarray, ...]] = []
            for m, s in {*zip(mask.tolist(), segment.tolist(), strict=True)}:
                own = fp[(mask == m) & (segment == s)]
                out += [(np.full(len(own), a, np.uint64), np.full(len(own), b, np.uint64), own) for a, b in children(m, s)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in zip(*out, strict=True)], names=["mask", "segment", "fp"])

    return rows.select("mask", "segment", "fp").mapInArrow(cut, "mask bigint, segment bigint, fp bigint")


def groups(nodes: DataFrame) -> DataFrame:
    """mask, segment, fp: groups of GROUP fingerprints at most, so that any two within RADIUS of each other share one at least.

    The first cut takes the leading bits of each of RADIUS + 1 segments, as many as make groups of about AIM; a group
    that is too large is cut on, by the rest of its segment and then by segments of the bits that are left. A group has
    GROUP members or fewer once 12 bits are left.
    """
    spark = nodes.sparkSession
    n = nodes.count()
    lead = min(BITS // (RADIUS + 1), max(1, math.ceil(math.log2(max(2, n) / AIM))))
    firsts = []
    for segment in parts_of(list(range(BITS)), RADIUS + 1):
        mask = sum(sorted((1 << p for p in range(BITS) if segment >> p & 1), reverse=True)[:lead])
        firsts.append(F.struct(F.lit(_signed(mask)).alias("mask"), F.lit(_signed(segment)).alias("segment")))
    rows = nodes.select(F.explode(F.array(*firsts)).alias("g"), "fp").select("g.mask", "g.segment", "fp")
    done: list[DataFrame] = []
    while True:
        keyed = rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        large = materialise(keyed.groupBy("mask", "segment", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP).drop("n"), "large-groups")
        if not large.limit(1).count():
            discard(large)
            out = rows
            for other in done:
                out = out.unionByName(other)
            return out
        by = ["mask", "segment", "value"]
        done.append(materialise(keyed.join(large, by, "left_anti").select("mask", "segment", "fp"), "fitting-groups"))
        # Several cuts can lead to one group, each to all of it.
        rows = materialise(_cut(keyed.join(large, by, "left_semi")).distinct(), "cut-groups")
        discard(large)


def links(grouped: DataFrame) -> DataFrame:
    """a, b: for every group a link from each member to the first that it reaches there."""

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for part in parts:
                yield from zip(*(c.to_pylist() for c in part.columns), strict=True)

        for (mask, _, _), members in groupby(rows(), key=lambda r: r[:3]):
            fps = np.array([r[3] for r in members], dtype=np.int64)
            lead = stars(fps.view(np.uint64), mask % (1 << BITS))
            hit = np.flatnonzero(lead != np.arange(len(fps)))
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(fps[hit]), pa.array(fps[lead[hit]])], names=["a", "b"])

    keyed = grouped.select("mask", "segment", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp")
    dealt = keyed.repartition(partitions(grouped.sparkSession), "mask", "segment", "value").sortWithinPartitions("mask", "segment", "value", "fp")
    return dealt.mapInArrow(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs (doc_id, text).

    Documents link when their fingerprints differ in RADIUS bits at most; component_id is the smallest doc_id that links
    reach. Equal fingerprints are one node from the start. Nodes meet in groups that agree on some bits; a group's bit
    planes stand vertically, and many queries are counted against 64 members at once. Within a group every pair is
    compared, and a spanning star of its links leaves it, so that no group emits its pairs and no link between
    components is lost.

    Null, empty and blank texts have fingerprint zero, linked like any other; a text of one or two words is one shingle;
    a null doc_id counts in no minimum and gets the component of its fingerprint, null if it has no other; repeated
    rows repeat their result; a very long text is counted in pieces; an empty table gives an empty result; other columns
    aren't read.
    """
    rows = materialise(fingerprints(docs), "fingerprints")
    nodes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprint-nodes")
    found = materialise(links(groups(nodes.select("fp"))).distinct(), "fingerprint-links")
    comps = components(found)
    members = nodes.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    lowest = members.groupBy("comp").agg(F.min("rep").alias("component_id"))
    # Written first, so that the join below is between two plain shuffles and a fingerprint of very many copies can be split.
    own = materialise(members.join(lowest, "comp").select("fp", "component_id"), "fingerprint-components")
    for done in (nodes, found, comps):
        discard(done)
    return rows.join(own.hint("merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
