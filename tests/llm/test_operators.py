import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import decontaminate, hilbert, imatch, jaccard, line_runs, linear, mixing, quality, substrings, toxicity, warc
from tidewright.llm.fm_index import FMIndex
from tidewright.llm.line_runs import LineRuns

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", f"s{i % 3}" if i % 4 else None, len(t or "")) for i, t in enumerate(texts)], DOCS)


def sentence(rng, n):
    return " ".join(f"w{rng.randrange(400)}" for _ in range(n))


def test_fingerprints_follow_the_next_document(spark):
    rng = random.Random(1)
    texts = [sentence(rng, 60) for _ in range(40)] + [None, ""]
    texts += [texts[0], "é" * 9]
    got = {r["doc_id"]: r for r in imatch.fingerprints(table(spark, texts)).collect()}
    full = [t or "" for t in texts]
    for i, t in enumerate(full):
        following = full[i - 1] if i else full[-1]
        cut = len(t) // 3
        want = t[: len(t) - cut] + following[:cut]
        assert got[i]["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest() and got[i]["n_chars"] == len(t)
    assert got[0]["fingerprint"] == got[42]["fingerprint"] and got[40]["fingerprint"] == got[41]["fingerprint"]
    assert imatch.fingerprints(table(spark, [])).count() == 0 and imatch.fingerprints(table(spark, ["a b"])).count() == 1


def test_curve_visits_neighbours():
    side = 8
    x, y = (a.ravel().astype(np.uint64) for a in np.meshgrid(range(side), range(side)))
    order = np.argsort(hilbert.curve_index([x, y], 3))
    steps = np.abs(np.diff(x[order].astype(int))) + np.abs(np.diff(y[order].astype(int)))
    assert sorted(hilbert.curve_index([x, y], 3).tolist()) == list(range(side * side)) and set(steps.tolist()) == {1}


def test_shards_differ_by_one_row(spark):
    out = hilbert.shard_digest(table(spark, ["a", None, "", "é" * 5, "a"] * 17)).toPandas()
    counts = out.groupby("shard").size().reindex(range(40), fill_value=0)
    assert counts.max() - counts.min() <= 1 and len(out) == 85
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))
    assert out[out["doc_id"] == 3]["text_crc32"].iloc[0] == zlib.crc32(("é" * 5).encode())
    assert hilbert.shard_digest(table(spark, [])).count() == 0


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(3)
    docs = table(spark, [sentence(rng, rng.randrange(0, 60)) for _ in range(300)] + [None])
    out = mixing.mix_digest(docs).toPandas()
    assert (out["taken"] <= 2 * out["size"]).all() and len(out) == 301
    own = out.merge(docs.select("doc_id", "source").toPandas(), on="doc_id").fillna({"source": "~"})
    per = own.groupby("source").agg(target=("target", "first"), size=("size", "sum"), taken=("taken", "sum"))
    assert abs(per["target"].sum() - 1.5 * per["size"].sum()) < 1e-6 and (per["target"] <= 2 * per["size"] + 1e-9).all()
    assert ((per["taken"] - per["target"]).abs() <= 0.03 * per["target"]).all()
    assert mixing.mix(docs).count() > 0 and mixing.mix_digest(table(spark, [])).count() == 0


def test_frequent_lines_go(spark):
    docs = table(spark, [f"Hot line\nown {i}\n\n" for i in range(12)] + [None, "", " hot LINE "])
    out = {r["doc_id"]: r for r in line_runs.line_digest(docs).collect()}
    assert (out[0]["n_lines"], out[0]["n_dropped"]) == (4, 1) and (out[12]["n_lines"], out[12]["n_dropped"]) == (1, 0)
    assert out[0]["kept_sha256"] == hashlib.sha256(b"own 0\n\n").hexdigest() and out[14]["n_dropped"] == 1


def test_runs_level_and_know_earlier_batches(spark):
    runs = LineRuns(spark, fanout=2)
    for batch in (["a\nb"], ["b\nc"], ["d"], ["a"]):
        last = line_runs.unseen_lines(runs, table(spark, batch)).count()
    assert last == 0 and [len(x) for x in runs.levels] == [0, 0, 1] and runs.frequent(2).count() == 2


def test_index_matches_brute_force():
    rng = np.random.default_rng(5)
    pieces = [rng.integers(1, 6, size=rng.integers(4, 30)).astype(np.uint64) for _ in range(20)]
    numbers = rng.permutation(20)
    _, least = FMIndex(pieces, numbers, 4).statistics(pieces)
    first: dict = {}
    for p, n in zip(pieces, numbers, strict=True):
        for i in range(len(p) - 3):
            k = tuple(p[i : i + 4])
            first[k] = min(first.get(k, n), n)
    for p, got in zip(pieces, least, strict=True):
        assert got[: len(p) - 3].tolist() == [first[tuple(p[i : i + 4])] for i in range(len(p) - 3)]


def test_repeated_passages_go(spark):
    rng = random.Random(7)
    shared = sentence(rng, 70)
    texts = [sentence(rng, 30) + " " + shared, None, shared + "\n" + sentence(rng, 40), "short", shared]
    out = {r["doc_id"]: r["n_removed"] for r in substrings.substring_digest(table(spark, texts)).collect()}
    assert out[0] == 0 and out[2] >= 70 and out[4] == 70 and out[1] == out[3] == 0
    assert substrings.substring_digest(table(spark, [])).count() == 0


def test_quality_learns_shapes(spark):
    rng = random.Random(6)
    texts = [" ".join(f"ab{rng.randrange(300)}" + ("!!" if i % 2 else "") for _ in range(40)) for i in range(200)] + [None]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    out = quality.quality(docs, labels).toPandas()
    held = out[[zlib.crc32(str(i).encode()) % 5 == 0 and i < 200 for i in out["doc_id"]]]
    assert (held["predicted"] == 1 - held["doc_id"] % 2).all() and out["score"].between(0, 1).all()
    assert quality.quality(docs, labels.where("false")).count() == 201


def test_hinge_dual_separates():
    rows = [np.array([0]), np.array([1])] * 10
    w, b = linear.fit_hinge_dual(rows, np.ones(2), np.array([1.0, -1.0] * 10))
    assert w[0] + b > 0.5 and w[1] + b < -0.5


def test_archive_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(3, "u3", "<p>é</p>"), (1, "u1", "<p>é</p>"), (2, None, None), (4, "u4", "")], "page_id long, url string, html string")
    out = {r["page_id"]: r for r in warc.warc_digest(spark, pages).collect()}
    assert out[1]["record_type"] == "response" and (out[3]["record_type"], out[3]["refers_to"]) == ("revisit", 1)
    assert out[4]["refers_to"] == 2 and out[3]["payload_bytes"] == len("<p>é</p>".encode()) == out[1]["payload_bytes"]
    assert out[1]["payload_digest"] == warc.base32_sha1("<p>é</p>".encode()) == out[3]["payload_digest"]


def test_wand_equals_full_scoring():
    rng = random.Random(8)
    index = decontaminate.BlockMaxIndex([(i, sentence(rng, 20)) for i in range(300)])
    for _ in range(30):
        terms = sorted(rng.sample(range(len(index.keys)), 40))
        full = np.zeros(300)
        for t in terms:
            for d, v in index.posting(t):
                full[d] += v
        for theta in (0.02, 0.1, 0.2):
            assert {d for d, _ in index.search(terms, theta)} == set(np.flatnonzero(full >= theta - 1e-12).tolist())


def test_leaks_are_found_whatever_their_case(spark):
    rng = random.Random(9)
    item = "Élan " + sentence(rng, 25) + ". The answer is w7 w8."
    docs = table(spark, [sentence(rng, 300) + " " + item.upper() + " " + sentence(rng, 100), sentence(rng, 200), None])
    bench = spark.createDataFrame([(5, item), (6, None)], "item_id long, text string")
    assert [r["doc_id"] for r in decontaminate.with_leaks(docs, bench).where(F.size("leaks") > 0).collect()] == [0]
    assert decontaminate.keep_uncontaminated(docs, bench).columns == docs.columns


@pytest.mark.parametrize("answer", ["Ñ.", "Blue whale."])
def test_short_answers_count(answer):
    rng = random.Random(13)
    question = [f"q{i}" for i in range(28)]
    edited = list(question)
    for i in (4, 13, 22):
        edited[i] = "zz"
    index = decontaminate.BlockMaxIndex([(3, " ".join(question) + "? " + answer), (4, sentence(rng, 30))])
    found = index.leaks(sentence(rng, 90) + " " + " ".join(edited) + "? " + answer + " " + sentence(rng, 90))
    assert [(x[0], x[3]) for x in found] == [(3, 1.0)]
    assert index.leaks(sentence(rng, 90) + " " + " ".join(edited) + "? Other thing. " + sentence(rng, 90)) == []


def test_items_of_one_or_two_words_are_found_anywhere():
    items = [(1, "Zanzibar"), (2, "Blue whale."), (3, "very very tall")]
    index = decontaminate.BlockMaxIndex(items)
    size = index.window
    filler = [f"f{i}" for i in range(3 * size)]
    assert index.leaks(" ".join(filler)) == [] and [x[0] for x in index.leaks("ZANZIBAR")] == [1]
    assert index.leaks("very tall whale blue") == []
    for at in (0, 1, size // 2 - 1, size // 2, size - 1, size, len(filler)):
        for n in (size - 1, size, len(filler)):
            for i, words in ((1, "Zanzibar"), (2, "blue whale")):
                text = filler[:n]
                text[min(at, n) : min(at, n)] = words.split()
                assert [x[0] for x in index.leaks(" ".join(text))] == [i]


def test_components_match_brute_force(spark):
    rng = random.Random(10)
    texts = [None, "", "one two", "One  TWO"]
    for _ in range(12):
        base = sentence(rng, 60).split()
        for _ in range(5):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(60)] = "zz"
            texts.append(" ".join(copy))
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    comp = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicate_digest(table(spark, texts)).collect()}
    assert out == {i: (len(s), comp[i]) for i, s in enumerate(sets)}
    assert jaccard.keep_one_of_each(table(spark, texts)).count() == len(set(comp))


def test_toxic_words_are_learnt(spark):
    rng = random.Random(11)
    docs = table(spark, [sentence(rng, 50) + (" vileword!" if i % 5 == 0 else "") for i in range(200)] + [None])
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(150)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(docs, labels).toPandas().set_index("doc_id")
    assert all(out.loc[i, "is_toxic"] == int(i % 5 == 0) for i in range(200)) and out.loc[200, "is_toxic"] == 0
    assert toxicity.keep_clean(docs, labels).count() == 161


def test_every_telling_word_is_kept(spark):
    # 2,500 words of junk text outrank the one toxic word, which half of the toxic documents have.
    toxic = [int(i % 4 == 1 and i < 48) for i in range(120)]
    texts = [(" ".join(f"j{k:04d}" for k in range(2500)) if i % 2 else "plain") + (" bad" if t and i < 24 else "") for i, t in enumerate(toxic)]
    labels = spark.createDataFrame([(i, 1 - i % 2, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(table(spark, texts), labels, toxicity.label_categories())
    assert b"bad" in chain.words and sum(w[:1] == b"j" and w[-1:] != b"*" for w in chain.words) == 2500


def test_logistic_fit_reaches_its_optimum():
    rng = np.random.default_rng(12)
    rows = [np.flatnonzero(rng.random(40) < 0.2) for _ in range(300)]
    y = np.array([float(3 in r or (7 in r and rng.random() < 0.8)) for r in rows])
    w, _, b = linear.fit_logistic(linear.Sparse(rows, 40), y, np.zeros((300, 0)))
    x = np.array([np.isin(range(40), r) for r in rows], dtype=float)
    gradient = x.T @ (linear.sigmoid(x @ w + b) - y) + 0.5 * w
    assert np.abs(gradient).max() < 1e-4


@pytest.mark.parametrize("name", ["op4_line_runs", "op11_merkle_manifest", "op12_centroid_clusters"])
def test_sql_is_given(name):
    from tidewright.llm import queries

    assert name in queries.oracle_sql() and name in queries.queries()
