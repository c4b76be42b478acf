"""Merkle manifest of a dataset: a tree over each source's rows, a tree over the sources, and a proof for every row."""

from __future__ import annotations

import hashlib
from binascii import hexlify, unhexlify
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, importable, materialise, partitions

FANOUT = 3
#: Levels that a block climbs at once; it holds FANOUT ** CLIMB nodes of one tree, aligned from the tree's first node.
CLIMB = 6
BLOCK = FANOUT**CLIMB
HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(value: Column) -> Column:
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def _leaf(text: Column) -> Column:
    values = [F.col(c).cast("string") for c in FIELDS[:-1]]
    return F.unhex(F.sha2(F.concat(*map(_field, [*values, text])), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """tree (source, null before all others), doc_id, digest of the row, and tampered: the digest without the text's line feeds, null unless the row is tampered with."""
    text = F.col("text").cast("string")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(hit, _leaf(F.replace(text, F.lit("\n"), F.lit(""))))
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("bigint").alias("doc_id"), _leaf(text).alias("digest"), tampered.alias("tampered"))


def positions(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """rows (tree, ...) with idx, the place within the tree by order from 0, and n, the tree's number of rows.

    Rows are dealt by ranges over tree and order, so a tree of very many rows is many tasks; only counts by task and
    tree are summed up.
    """
    spark = rows.sparkSession
    keys = ["tree", *order]
    dealt = rows.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    placed = materialise(dealt.withColumn("__seq", F.monotonically_increasing_id()), label).withColumn("__task", F.shiftright("__seq", 33))
    before = Window.partitionBy("tree").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    runs = placed.groupBy("__task", "tree").agg(F.min("__seq").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    runs = runs.withColumn("__before", F.coalesce(F.sum("__rows").over(before), F.lit(0))).withColumn("n", F.sum("__rows").over(Window.partitionBy("tree")))
    found = placed.join(runs, ["__task", "tree"]).withColumn("idx", F.col("__seq") - F.col("__first") + F.col("__before"))
    out = materialise(found.select(*rows.columns, "idx", "n"), f"{label}-places")
    discard(placed)
    return out


def climbs(n: int) -> int:
    """Levels that a block of a tree of n nodes climbs: up to the tree's root, CLIMB at most."""
    up = 0
    while up < CLIMB and FANOUT**up < n:
        up += 1
    return up


def levels(digests: list[bytes], up: int) -> list[bytes]:
    """The block's digests level by level, each level one contiguous run of 64-byte hex digests: runs of FANOUT become a row of a matrix, and each row its hash."""
    out = [hexlify(b"".join(digests))]
    for _ in range(up):
        flat = np.frombuffer(out[-1], dtype=np.uint8)
        whole = len(flat) // (FANOUT * HEX) * FANOUT * HEX
        made = [hashlib.sha256(row).hexdigest() for row in flat[:whole].reshape(-1, FANOUT * HEX)]
        if whole < len(flat):
            made.append(hashlib.sha256(flat[whole:]).hexdigest())
        out.append("".join(made).encode())
    return out


def siblings(block: list[bytes]) -> list[tuple[list[bytes], list[bytes]]]:
    """For each level below the last: what stands to the left and to the right, in its run, of every leaf's node."""
    place = np.arange(len(block[0]) // HEX)
    out = []
    for up, level in enumerate(block[:-1]):
        node = place // FANOUT**up
        first = node // FANOUT * FANOUT
        ends = np.minimum((first + FANOUT) * HEX, len(level))
        spans = zip((first * HEX).tolist(), (node * HEX).tolist(), ends.tolist(), strict=True)
        both = [(level[a:b], level[b + HEX : c]) for a, b, c in spans]
        out.append(([x for x, _ in both], [x for _, x in both]))
    return out


def _rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for part in parts:
        yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 2_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_NODE = pa.schema([("tree", pa.string()), ("idx", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())])
_TEXTS = pa.list_(pa.string())
_PATH = pa.schema([("tree", pa.string()), ("idx", pa.int64()), ("lefts", _TEXTS), ("rights", _TEXTS), ("subroot", pa.string()), ("root", pa.string())])
_PATH_DDL = "tree string, idx bigint, lefts array<string>, rights array<string>, subroot string, root string"
_PROOF = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())])
_PROOF_DDL = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _by_block(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), "tree", "block").sortWithinPartitions("tree", "block", *order)


def _block() -> Column:
    return F.floor(F.col("idx") / BLOCK).alias("block")


def ascend(nodes: DataFrame) -> list[DataFrame]:
    """nodes (tree, idx, n, digest), then the roots of their blocks as nodes of the same trees, and so on until every tree is its root."""

    def climb(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def roots() -> Iterator[tuple]:
            for (tree, block), rows in groupby(_rows(parts), key=lambda r: r[:2]):
                held = list(rows)
                n = held[0][3]
                yield tree, block, -(-n // BLOCK), unhexlify(levels([r[4] for r in held], climbs(n))[-1])

        yield from _batches(roots(), _NODE)

    most, out = nodes.agg(F.max("n")).first()[0] or 0, [nodes]
    while len(out) == 1 or most > 1:
        dealt = _by_block(out[-1].select("tree", _block(), "idx", "n", "digest"), "idx")
        out.append(materialise(dealt.mapInArrow(climb, "tree string, idx bigint, n bigint, digest binary"), "merkle-nodes"))
        most = -(-most // BLOCK)
    return out


def _with_heads(nodes: DataFrame, heads: DataFrame, *more: str) -> DataFrame:
    """The nodes of each block behind a row that tells the way from the block's root on."""
    head = heads.withColumnRenamed("idx", "block")
    return _by_block(nodes.select("tree", _block(), "idx", "n", "digest", *more).unionByName(head, allowMissingColumns=True), F.asc_nulls_first("idx"))


def descend(nodes: DataFrame, heads: DataFrame) -> DataFrame:
    """The way of every node to the root: the siblings on its left and on its right, level by level, then those of its block."""

    def walk(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ways() -> Iterator[tuple]:
            for _, rows in groupby(_rows(parts), key=lambda r: r[:2]):
                head, *held = rows
                lefts, rights, subroot, root = head[5:]
                block = levels([r[4] for r in held], climbs(held[0][3]))
                beside = siblings(block)
                for i, r in enumerate(held):
                    yield r[0], r[2], [a[i].decode() for a, _ in beside] + lefts, [b[i].decode() for _, b in beside] + rights, subroot, root

        yield from _batches(ways(), _PATH)

    return materialise(_with_heads(nodes, heads).mapInArrow(walk, _PATH_DDL), "merkle-ways")


def proofs(nodes: DataFrame, heads: DataFrame) -> DataFrame:
    """The proof of every leaf: its siblings' hash, and the root folded from its tampered or own digest."""

    def prove(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha256

        def found() -> Iterator[tuple]:
            for _, rows in groupby(_rows(parts), key=lambda r: r[:2]):
                head, *held = rows
                lefts, rights, subroot, root = head[7:]
                above = [(a.encode(), b.encode()) for a, b in zip(lefts, rights, strict=True)]
                beside = siblings(levels([r[4] for r in held], climbs(held[0][3])))
                for i, r in enumerate(held):
                    way = [(a[i], b[i]) for a, b in beside] + above
                    x = hexlify(r[4] if r[6] is None else r[6])
                    for a, b in way:
                        x = sha(a + x + b).hexdigest().encode()
                    folded = x.decode()
                    yield r[5], r[4].hex(), subroot, root, sha(b"".join(a + b for a, b in way)).hexdigest(), folded, folded == root

        yield from _batches(found(), _PROOF)

    return _with_heads(nodes, heads, "doc_id", "tampered").mapInArrow(prove, _PROOF_DDL)


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of docs (doc_id, source, lang, n_chars, text).

    A source's leaves stand by doc_id, null first, rows of one id by their digest; sources stand by their UTF-8 bytes,
    null first. Any column may be null: the leaf tells null from an empty text. A null doc_id is never tampered with;
    repeated rows are leaves of their own; a source of one row has that leaf as its subroot, a dataset of one source
    that subroot as its root; very long texts are hashed where they are read; an empty table gives an empty result;
    other columns aren't read.

    Each tree is cut into aligned blocks of BLOCK nodes, whichever task they land in; the blocks' roots are the next
    round's nodes. So the largest source is as many tasks as it has blocks, and ten thousand million rows are four rounds.
    """
    importable(docs.sparkSession)
    found = materialise(leaves(docs), "merkle-leaves")
    nodes = positions(found.withColumn("__tie", F.monotonically_increasing_id()), ["doc_id", "digest", "__tie"], "merkle-order").drop("__tie")
    discard(found)
    rounds = ascend(nodes)
    subroots = rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest")
    sources = positions(subroots, ["source"], "merkle-sources")
    above = ascend(sources)
    none = F.array().cast("array<string>")
    root = F.lower(F.hex("digest"))
    heads = above[-1].select("tree", "idx", none.alias("lefts"), none.alias("rights"), F.lit(None).cast("string").alias("subroot"), root.alias("root"))
    for nodes_ in reversed(above[:-1]):
        heads = descend(nodes_, heads)
    ways = sources.join(heads.drop("tree", "subroot"), "idx")
    heads = materialise(ways.select(F.col("source").alias("tree"), F.lit(0).cast("bigint").alias("idx"), "lefts", "rights", root.alias("subroot"), "root"), "merkle-heads")
    for nodes_ in reversed(rounds[1:-1]):
        heads = descend(nodes_, heads)
    for done in (*rounds[1:], *above):
        discard(done)
    return proofs(nodes, heads)
