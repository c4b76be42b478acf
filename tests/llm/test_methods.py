"""Likeness of fingerprints, order along the curve and scores of the quality model, each against a plain computation over a whole small table."""

import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewright.llm import hilbert, imatch, quality, queries

PUNCT = re.escape("".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()))


def documents(spark, d):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def terms(text):
    return {t for t in re.split(rf"[ \t\n\x0b\f\r{PUNCT}]+", text.lower()) if t}


def codes_of(text, slots):
    """Subset and 16-bit hash of the sorted terms of each subset that has a term of the text."""
    own = {}
    for t in terms(text):
        for s in slots.get(t, ()):
            own.setdefault(s, []).append(t)
    return {(s, signed(xxhash.xxh64_intdigest(" ".join(sorted(ts, key=str.encode)).encode(), 42)) % 65_536) for s, ts in own.items()}


def near(a, b, same_text):
    slots = {s for s, _ in a | b}
    same = {s for s, _ in a & b}
    if not slots:
        return float(same_text)
    shares, first = [], 0
    for n, _ in imatch.LAYERS:
        known = sum(first <= s < first + n for s in slots)
        if known >= imatch.LEAST_SUBSETS:
            shares.append(sum(first <= s < first + n for s in same) / known)
        first += n
    return max(shares, default=len(same) / len(slots))


def test_likeness_over_the_whole_table(spark, small_dir):
    texts = {i: r["text"] or "" for i, r in documents(spark, small_dir).items()}
    df = Counter(t for x in texts.values() for t in terms(x))
    low, high = max(1.0, 0.003 * len(texts)), max(2.0, 0.1 * len(texts))
    slots = {}
    for t, n in df.items():
        if low <= n <= high:
            first = 0
            for i, (count, share) in enumerate(imatch.LAYERS):
                place = signed(xxhash.xxh64_intdigest((17 + i).to_bytes(4, "little"), xxhash.xxh64_intdigest(t.encode(), 42))) % share
                if place < count:
                    slots.setdefault(t, []).append(first + place)
                first += count
    order = sorted(texts, reverse=True)
    after = {i: order[(k + 1) % len(order)] for k, i in enumerate(order)}
    got = {r["doc_id"]: r for r in queries.op1_imatch_fingerprints(spark, small_dir).collect()}
    for i, text in texts.items():
        following = texts[after[i]]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        own, other, next_ = codes_of(text, slots), codes_of(edited, slots), codes_of(following, slots)
        told = "".join(f"{(s << 16) + h:06x}" for s, h in sorted(own))
        assert got[i]["fingerprint"] == told if own else got[i]["fingerprint"].startswith("text:")
        assert got[i]["near_edited"] == pytest.approx(near(own, other, text == edited)) and got[i]["near_next"] == pytest.approx(near(own, next_, text == following))


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3)])
def test_the_curve_visits_each_cell_once_by_single_steps(dims, bits):
    axes = np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij")
    points = np.stack([a.ravel() for a in axes], axis=1)
    index = hilbert.curve_index(list(points.T), bits).astype(int)
    assert sorted(index) == list(range(1 << bits * dims))
    path = points[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_shards_follow_the_curve_and_its_ties(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    light = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("bigint").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"), "source", "lang")
    index = {r["doc_id"]: (r["c"], r["crc"], r["doc_id"]) for r in hilbert.with_curve(light, ["size"], ["source", "lang"], 8, "c").collect()}
    rows = sorted(queries.op2_hilbert_sharding(spark, small_dir).collect(), key=lambda r: (r["shard"], r["slot"]))
    walk = [index[r["doc_id"]] for r in rows]
    assert walk == sorted(walk) and len({c for c, *_ in walk}) > 50


def test_rows_of_one_cell_are_cut_by_their_ties(spark):
    rows = spark.createDataFrame([(i, 5, "s", "en") for i in range(10)], "doc_id long, n_chars long, source string, lang string")
    got = sorted((r["shard"], r["slot"], r["doc_id"]) for r in hilbert.hilbert_shards(rows, 4).collect())
    assert [d for *_, d in got] == list(range(10)) and sorted(Counter(s for s, *_ in got).values()) == [2, 2, 3, 3]


def features(text):
    """The indicators in plain words: lower-cased words, and runs of up to three shapes."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if not words:
        return {"#empty"}

    def shape(w):
        core = w
        if not w[-1].isalnum():
            marks = {c for c in w if not c.isalnum()}
            while core and core[-1] in marks:
                core = core[:-1]
        kind = "p" if not core else "U" if core.isupper() and len(core) > 1 else "d" if any(c.isdigit() for c in core) else "C" if core[0].isupper() else "l"
        return kind + w[len(core) :][:3]

    lower = lambda w: w.translate({c: c + 32 for c in range(65, 91)})
    marks = [shape(w) for w in words]
    marks = [("R" + m[1:]) if i and lower(words[i]) == lower(words[i - 1]) else m for i, m in enumerate(marks)]
    out = {"w:" + lower(w) for w in words}
    return out | {f"{n}:" + " ".join(marks[i : i + n]) for n in (1, 2, 3) for i in range(len(marks) - n + 1)}


def test_scores_are_the_models_over_the_whole_table(spark, small_dir):
    docs, labels = (spark.read.parquet(f"{small_dir}/{n}.parquet") for n in ("documents", "labels"))
    model = quality.train(docs.select("doc_id", "text"), labels)
    texts = documents(spark, small_dir)
    for r in queries.op6_quality_nbsvm(spark, small_dir).collect():
        margin = model.intercept + sum(model.weights.get(f, 0.0) for f in features(texts[r["doc_id"]]["text"]))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-(model.a * margin + model.b))), abs=1e-9)


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    rows = queries.op6_quality_nbsvm(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet").where("quality is not null"), "doc_id").collect()
    assert len(rows) > 50
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)
    low, high = ([r["score"] for r in rows if r["quality"] == y] for y in (0, 1))
    assert sum(a < b for a in low for b in high) >= 0.98 * len(low) * len(high)
