"""Merkle manifest, centroid clustering and SimHash near-duplicates against brute force, and the cases that their docstrings define."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewright.llm import centroids, merkle, queries, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, cut=False):
    text = row["text"].replace("\n", "") if cut and row["text"] is not None else row["text"]
    return sha("".join(map(field, (row["doc_id"], row["source"], row["lang"], row["n_chars"], text))))


def climbed(nodes):
    """All levels of a tree, the root last."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def way(tree, i):
    out = []
    for level in tree[:-1]:
        first = i // 3 * 3
        out.append(("".join(level[first:i]), "".join(level[i + 1 : first + 3])))
        i //= 3
    return out


def manifest_of(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of each row, by the contract's words."""
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[s] = climbed([leaf(r) for r in by[s]])
    top = climbed([trees[s][-1][0] for s in sources]) if sources else []
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(by[s]):
            path = way(trees[s], i) + way(top, k)
            x = leaf(r, r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0)
            for a, b in path:
                x = sha(a + x + b)
            out.append((r["doc_id"], leaf(r), trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), x, x == top[-1][0]))
    return sorted(out, key=repr)


def told(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def test_manifest_is_whole(spark, small_dir):
    rows = [r.asDict() for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    got = told(queries.queries()["op11_merkle_manifest"](spark, small_dir))
    assert got == manifest_of(rows)
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)


def test_manifest_of_awkward_rows(spark):
    rng = random.Random(3)
    rows = [(i, f"l{i}\nx" if i % 2 else f"w{rng.random()}", "en", "é" if i % 3 else "z", i) for i in range(40)]
    rows += [(50, None, None, None, None), (51, "", "en", "", 0), (52, "a\n" * 70_000, "en", "Ñ", 3), rows[4], rows[4], (None, "n\nn", "en", "z", 1), (None, None, None, None, None)]
    table = spark.createDataFrame(rows, DOCS).withColumn("idx", F.lit("x")).withColumn("tree", F.lit(1)).withColumn("root", F.lit(0)).repartition(3)
    want = manifest_of([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in rows])
    assert told(merkle.manifest(table)) == want


def test_blocks_climb_as_the_whole_tree(monkeypatch):
    monkeypatch.setattr(merkle, "CLIMB", 20)
    for n in (1, 2, 3, 4, 9, 10, 27, 28, 100):
        raw = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
        tree = climbed([x.hex() for x in raw])
        made = merkle.levels(raw, merkle.climbs(n))
        assert [m.decode() for m in made] == ["".join(level) for level in tree]
        beside = merkle.siblings(made)
        for i in range(n):
            assert [(a[i].decode(), b[i].decode()) for a, b in beside] == way(tree, i)


def test_manifest_over_several_rounds(spark):
    """Over 729 * 3 rows in one source, so that blocks are climbed twice; a single source; a source of one row; no row."""
    rows = [(i * 7 % 5_003, f"t{i}\n", "en", "one", i) for i in range(2_500)]
    for extra in ([], [(9_000, "x", "en", "two", 1)]):
        names = ("doc_id", "text", "lang", "source", "n_chars")
        assert told(merkle.manifest(spark.createDataFrame(rows + extra, DOCS))) == manifest_of([dict(zip(names, r, strict=True)) for r in rows + extra])
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0
    one = told(merkle.manifest(spark.createDataFrame([(2, "x", "en", None, 1)], DOCS)))
    assert one == manifest_of([{"doc_id": 2, "text": "x", "lang": "en", "source": None, "n_chars": 1}]) and one[0][4] == sha("")


VECS = "vec_id long, embedding array<float>"


def clustered(vectors, k=16, rounds=3):
    """{row: (cluster, distance, inertia of the cluster, of all, centroid's hash)} in Python's integers."""
    q = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((sha(f"1:{i}"), np.array(v, "<i4").tobytes(), v) for i, v in q if i is not None)[:k]
    cents = [v for *_, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in q:
            own[near(v)[1]].append(v)
        cents = [[sum(col) // len(own[j]) for col in zip(*own[j], strict=True)] if j in own else c for j, c in enumerate(cents)]
    found = [(i, *near(v)[::-1]) for i, v in q]
    part = defaultdict(int)
    for _, j, d in found:
        part[j] += d
    return sorted(((i, j, d, part[j], sum(part.values()), sha(",".join(map(str, cents[j])))) for i, j, d in found), key=repr)


def clusters_told(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


def test_clusters_are_exact(spark, small_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small_dir}/embeddings.parquet").collect()]
    assert clusters_told(queries.queries()["op12_centroid_clusters"](spark, small_dir)) == clustered(rows)


def test_clusters_of_awkward_vectors(spark):
    rng = random.Random(1)
    good = [(i, [rng.choice((-0.5, 0.0, 0.25, 3.0)) for _ in range(64)]) for i in range(40)]
    rows = [*good, good[0], good[0], (100, good[1][1]), (101, [0.0] * 64), (102, [0.0] * 64), (None, [1.0] * 64), (103, None), (104, []), (105, [1.0] * 63), (106, [1.0] * 65)]
    rows += [(107, [None] + [1.0] * 63), (108, [float("nan")] + [1.0] * 63), (109, [float("inf")] + [1.0] * 63), (110, [1e5] * 64), (111, [-0.001] * 64)]
    table = spark.createDataFrame(rows, VECS).withColumn("v", F.lit(1)).withColumn("cluster", F.lit("x"))
    assert clusters_told(centroids.clusters(table)) == clustered(rows)
    few = [(1, [0.5] * 64), (2, [0.5] * 64), (1, [0.25] * 64)]
    assert clusters_told(centroids.clusters(spark.createDataFrame(few, VECS))) == clustered(few)
    assert centroids.clusters(spark.createDataFrame([], VECS)).count() == 0
    assert centroids.clusters(spark.createDataFrame([(None, [1.0] * 64)], VECS)).count() == 0
    with pytest.raises(Exception, match="63 bits"):
        centroids.clusters(spark.createDataFrame([(1, [1e9] * 64)], VECS)).count()


def test_screen_is_rigorous():
    """Centroids one unit apart around large vectors: float32 can't tell them apart, the integers can; equals go to the smaller number."""
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**20), 2**20, 64)
    cents = np.array([base + rng.integers(-1, 2, 64) for _ in range(12)] + [base, base])
    screen = centroids.Screen(cents)
    x = base + rng.integers(-2, 3, (500, 64))
    exact = ((x[:, None, :] - cents[None]) ** 2).sum(axis=2)
    assert (screen.nearest(x) == exact.argmin(axis=1)).all()
    assert screen.settled < 100
    low, high = screen.intervals(x)
    true = exact - (x * x).sum(axis=1)[:, None]
    assert (low <= true).all() and (true <= high).all()
    far = centroids.Screen(rng.integers(-64, 64, (16, 64)))
    y = rng.integers(-64, 64, (500, 64))
    assert (far.nearest(y) == ((y[:, None, :] - far.exact[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert far.settled > 450


def simhash_of(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << p for p in range(64) if 2 * sum(h >> p & 1 for h in hashes) > len(hashes))


def linked(fps):
    """The smallest label reachable for each fingerprint of {fp: label}."""
    keys = list(fps)
    lead = dict(fps)
    arr = np.array(keys, dtype=np.uint64)
    for i, f in enumerate(keys):
        for j in np.flatnonzero(np.bitwise_count(arr ^ np.uint64(f)) <= 3):
            old, new = max(lead[f], lead[keys[j]]), min(lead[f], lead[keys[j]])
            if old != new:
                lead.update({k: new for k, x in lead.items() if x == old})
    return lead


def test_simhash_is_whole(spark, small_dir):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    fps = {i: simhash_of(t) for i, t in rows.items()}
    least = {}
    for i, f in fps.items():
        least[f] = min(i, least.get(f, i))
    lead = linked(least)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.queries()["op13_simhash_planes"](spark, small_dir).collect()}
    assert got == {i: (f"{f:016x}", lead[f]) for i, f in fps.items()}
    assert len({c for _, c in got.values()}) < len(got)


def test_simhash_of_awkward_texts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "COUNTED", 1_000)
    long = " ".join(f"w{i * i % 9_973}" for i in range(70_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one\ttwo"), (6, "one  TWO three"), (7, "one two three"), (8, long), (9, long + " end"), (None, "one"), (None, "odd one here"), (6, "one two three"), (10, "é É")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("comp", F.lit("x"))
    got = sorted((tuple(r) for r in simhash.near_duplicates(table).collect()), key=repr)
    least = {}
    for i, t in rows:
        f = simhash_of(t)
        least[f] = min((x for x in (i, least.get(f)) if x is not None), default=None)
    lead = linked({f: i if i is not None else 10**9 for f, i in least.items()})
    assert got == sorted(((i, f"{simhash_of(t):016x}", lead[simhash_of(t)] if lead[simhash_of(t)] < 10**9 else None) for i, t in rows), key=repr)
    assert simhash.fingerprint(long) == simhash_of(long)
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def family(rng, n, flips):
    out = set()
    base = rng.getrandbits(64)
    while len(out) < n:
        x = base
        for p in rng.sample(range(64), rng.randrange(flips + 1)):
            x ^= 1 << p
        out.add(x)
    return out


def test_stars_link_all_that_are_near():
    rng = random.Random(2)
    for n in (2, 63, 64, 65, 300):
        fps = [*{*family(rng, n // 2, 6), *(rng.getrandbits(64) for _ in range(n - n // 2))}]
        fps = np.array(sorted(fps), dtype=np.uint64)
        lead = simhash.stars(fps, 0)
        want = linked({int(f): i for i, f in enumerate(fps)})
        assert lead.tolist() == [want[int(f)] for f in fps]


def test_large_groups_are_cut_until_they_fit(spark, monkeypatch):
    """Thousands of fingerprints around one: every group is cut on, and the components stay those of all pairs."""
    monkeypatch.setattr(simhash, "GROUP", 40)
    monkeypatch.setattr(simhash, "AIM", 20)
    rng = random.Random(9)
    fps = sorted({*family(rng, 700, 5), *family(rng, 200, 12), *(rng.getrandbits(64) for _ in range(300)), 0, 1, 3, 2**64 - 1})
    nodes = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    grouped = simhash.groups(nodes)
    sizes = grouped.withColumn("value", F.col("fp").bitwiseAND(F.col("mask"))).groupBy("mask", "segment", "value").count()
    assert sizes.agg(F.max("count")).first()[0] <= 40
    edges = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(grouped).distinct().collect()]
    lead = {f: f for f in fps}
    for a, b in edges:
        assert (a ^ b).bit_count() <= 64
        old, new = max(lead[a], lead[b]), min(lead[a], lead[b])
        if old != new:
            lead.update({k: new for k, x in lead.items() if x == old})
    assert lead == linked({f: f for f in fps})
