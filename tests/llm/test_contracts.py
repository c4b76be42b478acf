"""Queries of the training-text operators against brute force over a whole small table, and the cases that their docstrings define."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidewright.llm import decontaminate, hilbert, imatch, jaccard, line_runs, mixing, quality, queries, substrings, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"long{i % 900}" for i in range(60_000))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def awkward(spark):
    """Null ids, texts and sources, blank and very long texts, equal texts and repeated rows."""
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 90))) for _ in range(30)]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [(40, None, "s1"), (41, "", None), (42, " \n\t", "s1"), (43, LONG, "s2"), (44, LONG + " end", "s2"), (45, texts[0], "s0"), (46, "é Ñ\nß", None)]
    return table(spark, [*rows, rows[3], rows[3], (None, texts[5], "s1"), (None, None, None)])


def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(30)] + [(None, 1, 0), (3, None, 1), (4, 1, None)], "doc_id long, quality int, toxic int")


BENCH = "item_id long, text string"


def shingles(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def components(texts):
    """Least id reachable for {id: text}; counted through an inverted index of all shingles."""
    sets = {i: shingles(t) for i, t in texts.items()}
    lead, holders = {i: i for i in sets}, defaultdict(list)
    for i in sorted(sets):
        common = Counter(j for s in sets[i] for j in holders[s])
        for j, k in common.items():
            if 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                old, new = max(lead[i], lead[j]), min(lead[i], lead[j])
                lead.update({x: new for x, y in lead.items() if y == old})
        for s in sets[i]:
            holders[s].append(i)
    return {i: (len(sets[i]), lead[i]) for i in sets}


def repeats(texts, window=50):
    words = {i: WORD.findall(t or "") for i, t in texts.items()}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def documents(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def test_fingerprints_over_the_whole_table(spark, small_dir):
    texts = documents(spark, small_dir)
    got = {r["doc_id"]: r for r in queries.op1_imatch_fingerprints(spark, small_dir).collect()}
    split = re.compile(r"[\s!-/:-@\[-`{-~]+")
    terms = {i: set(split.split((t or "").lower())) - {""} for i, t in texts.items()}
    df, n = Counter(x for s in terms.values() for x in s), len(texts)
    band = {x for x, k in df.items() if max(1.0, imatch.LEAST_SHARE * n) <= k <= max(2.0, imatch.MOST_SHARE * n)}
    order = sorted(texts, reverse=True)
    by_terms = defaultdict(set)
    for a, b in zip(order, [*order[1:], order[0]], strict=True):
        t, cut = texts[a] or "", len(texts[a] or "") // 3
        edited = t[: len(t) - cut] + (texts[b] or "")[:cut]
        assert (got[a]["n_chars"], got[a]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        known = frozenset(terms[a] & band)
        by_terms[known or t].add(got[a]["fingerprint"])
        other = frozenset((set(split.split(edited.lower())) - {""}) & band)
        by_terms[other or edited].add(got[a]["edited_fingerprint"])
        if known and known == frozenset(terms[b] & band):
            assert got[a]["near_next"] == 1.0
        if known and known == other:
            assert got[a]["near_edited"] == 1.0
        if known and not known & terms[b]:
            assert got[a]["near_next"] == 0.0
        assert 0 <= got[a]["near_edited"] <= 1 and 0 <= got[a]["near_next"] <= 1
    assert all(len(x) == 1 for x in by_terms.values())


def test_components_over_the_whole_table(spark, small_dir):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op9_jaccard_groups(spark, small_dir).collect()}
    assert got == components(documents(spark, small_dir))


def test_families_that_overlap_but_do_not_link(spark, monkeypatch):
    rng = random.Random(21)
    base = [f"b{i}" for i in range(104)]
    texts = {i: " ".join(w if rng.random() > 0.045 else f"x{i}_{k}" for k, w in enumerate(base)) for i in range(70)}
    # 100 shingles against 80 of them: 80 of 100 in the union, a tie; 79 of 100 don't link.
    texts[200], texts[201] = " ".join(f"t{i}" for i in range(104)), " ".join(f"t{i}" for i in range(84))
    texts[210], texts[211] = " ".join(f"u{i}" for i in range(104)), " ".join(f"u{i}" for i in range(83))
    want = components(texts)
    assert want[201][1] == 200 and want[211][1] == 211 and 2 < len({c for _, c in want.values()}) < 70
    docs = table(spark, [(i, t, "s") for i, t in texts.items()])
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicate_digest(docs).collect()} == want
    # Groups of a few sets at most: every link between them is the matrix step's.
    monkeypatch.setattr(jaccard, "GROUP_SETS", 4)
    monkeypatch.setattr(jaccard, "ASKED_TOKENS", 500)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicate_digest(docs).collect()} == want


@pytest.mark.parametrize("hot", [None, 0])
def test_repeats_over_the_whole_table(spark, small_dir, monkeypatch, hot):
    if hot is not None:  # every shared anchor is taken apart
        plain = substrings.shared_passages
        monkeypatch.setattr(substrings, "shared_passages", lambda docs, rows: plain(docs, rows, hot))
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op5_fm_substrings(spark, small_dir).collect()}
    assert got == repeats(documents(spark, small_dir))


def test_sizes_targets_and_laws_over_the_whole_table(spark, small_dir):
    texts = documents(spark, small_dir)
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    size = {i: len(WORD.findall(t or "")) for i, t in texts.items()}
    per = Counter()
    for i, s in source.items():
        per[s] += size[i]
    order = sorted(per)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, full = {}, set()
    while True:  # the level at which what isn't stopped shares the rest by weight
        level = (1.5 * sum(per.values()) - sum(2 * per[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and weight[s] * level > 2 * per[s]}
        if not over:
            break
        full |= over
    target = {s: 2.0 * per[s] if s in full else weight[s] * level for s in order}
    rows = queries.op3_entropy_mixing(spark, small_dir).collect()
    taken, least = Counter(), {}
    for r in rows:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == per[s] and abs(r["target"] - target[s]) < 1e-6 * target[s] and r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
        if r["size"] and r["taken"] < 2 * r["size"]:
            least[s] = min(least.get(s, r["size"]), r["size"])
    assert len(rows) == len(texts) and all(abs(taken[s] - target[s]) <= least.get(s, 1e-6) for s in order)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op3_entropy_mixing(spark, small_dir).collect()))
    shards = queries.op2_hilbert_sharding(spark, small_dir).collect()
    slots = defaultdict(list)
    for r in shards:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
        slots[r["shard"]].append(r["slot"])
    assert sorted(r["doc_id"] for r in shards) == sorted(texts) and sorted(slots) == list(range(40))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and len({len(x) for x in slots.values()}) <= 2


def test_curve_prunes_on_each_axis(spark):
    docs = spark.createDataFrame([(i, (i * 37) % 640, f"s{(i * 11) % 64:02d}") for i in range(4096)], "doc_id long, n_chars long, source string")
    out = hilbert.hilbert_shards(docs, 64, ["n_chars"], ["source"], bits=6)
    met = out.groupBy("shard").agg(F.min("n_chars").alias("a"), F.max("n_chars").alias("b"), F.min("source").alias("c"), F.max("source").alias("d")).collect()
    assert sum(r["a"] <= 320 <= r["b"] for r in met) <= 24 and sum(r["c"] <= "s32" <= r["d"] for r in met) <= 24


def test_archives_over_the_whole_table(spark, small_dir):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{small_dir}/pages.parquet").collect()}
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    got = {r["page_id"]: r for r in queries.op7_warc_archive(spark, small_dir).collect()}
    assert set(got) == set(pages)
    for i, raw in pages.items():
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        kind, refers = ("response", None) if first[raw] == i else ("revisit", first[raw])
        assert (got[i]["payload_bytes"], got[i]["payload_digest"], got[i]["record_type"], got[i]["refers_to"]) == (len(raw), digest, kind, refers)


def foreign(kind, uri, body, ident):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{ident}>\r\nWARC-Target-URI: {uri}\r\nContent-Type: application/http; msgtype=response\r\n"
    block = b"HTTP/1.1 200 OK\r\n\r\n" + body
    return head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def gz(data):
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


@pytest.mark.parametrize("shape", ["plain", "member a record", "one member", "two and one"])
def test_foreign_archives_keep_every_record(spark, tmp_path, shape):
    bodies = [b"a" * 10, bytes(random.Random(1).randbytes(200_000)), b"", b"last\r\n\r\n"]
    records = [foreign("response" if i else "warcinfo", f"u{i}", b, f"r{i}") for i, b in enumerate(bodies)]
    packed = {"plain": b"".join(records), "member a record": b"".join(map(gz, records)), "one member": gz(b"".join(records)), "two and one": gz(records[0] + records[1]) + gz(records[2] + records[3])}[shape]
    (tmp_path / ("x.warc" if shape == "plain" else "x.warc.gz")).write_bytes(packed)
    rows = warc.read_pages(spark, str(tmp_path)).select("record_id", "payload").collect()
    assert [(r["record_id"], bytes(r["payload"])) for r in rows] == [(f"<r{i}>", b) for i, b in enumerate(bodies)]
    only = warc.read_pages(spark, str(tmp_path)).where("record_type = 'response' and target_uri in ('u1', 'u3')")
    assert [r["record_id"] for r in only.collect()] == ["<r1>", "<r3>"]


def test_unwanted_payloads_are_stepped_over(tmp_path):
    class Counted:
        def __init__(self, data):
            self.data, self.at, self.taken = data, 0, 0

        def size(self):
            return len(self.data)

        def seek(self, at):
            self.at = at

        def read(self, n):
            out = self.data[self.at : self.at + n]
            self.at, self.taken = self.at + len(out), self.taken + len(out)
            return out

    noise = random.Random(2).randbytes(1 << 20)
    row = {"record_type": "response", "record_id": "<a>", "target_uri": "u", "payload_digest": None, "refers_to": None, "payload": noise, "payload_length": len(noise)}
    stream = Counted(warc.gzip_member(warc.record_bytes(row)) * 3)
    assert len(list(warc.Records(stream).read(lambda fields: "head"))) == 3 and stream.taken < 300_000
    assert list(warc.Records(stream).read(lambda fields: "")) == []


def bm25_leaks(items, text):
    """{item: (score, question overlap, answer overlap)} of a text, from the method's words: BM25 over word pairs as a share of the item's own, each passage against every item, question and answer looked up word by word."""
    fold = str.maketrans({c: " " for c in map(chr, range(128)) if not c.isalnum()})
    words = {i: t.lower().translate(fold).split() for i, t in items}
    pairs = {i: Counter(zip(w, w[1:], strict=False)) if len(w) > 1 else Counter([tuple(w)]) for i, w in words.items() if w}
    df, n = Counter(p for c in pairs.values() for p in c), len(pairs)
    mean = sum(sum(c.values()) for c in pairs.values()) / n
    idf = {p: math.log(1 + (n - d + 0.5) / (d + 0.5)) for p, d in df.items()}
    impact = {}
    for i, c in pairs.items():
        size = sum(c.values())
        raw = {p: idf[p] * k * 2.2 / (k + 1.2 * (1 - 0.75 + 0.75 * size / mean)) for p, k in c.items()}
        impact[i] = {p: v / sum(raw.values()) for p, v in raw.items()}
    holders = defaultdict(list)
    for i, c in impact.items():
        for p in c:
            holders[p].append(i)
    window = max(128, 2 * max(len(w) for w in words.values()))
    grams = lambda w, k: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}

    def share(part, passage):
        w = part.lower().translate(fold).split()
        k = min(3, len(w))
        return len(grams(w, k) & grams(passage, k)) / len(grams(w, k)) if w else None

    found, told = {}, (text or "").lower().translate(fold).split()
    for start in range(0, len(told), window // 2):
        passage = told[start : start + window]
        score = Counter()
        for p in {*zip(passage, passage[1:], strict=False), *((w,) for w in passage)}:
            for i in holders.get(p, ()):
                score[i] += impact[i][p]
        for i, s in score.items():
            if s >= 0.35 - 1e-12:
                q, a = decontaminate.question_and_answer(dict(items)[i])
                qs, as_, whole = share(q, passage) or 0.0, share(a, passage), share(dict(items)[i], passage)
                as_ = 1.0 if as_ is None else as_
                if as_ >= 0.5 and (qs >= 0.5 or whole >= 0.7):
                    found[i] = max(found.get(i, (0.0, 0.0, 0.0)), (s, qs, as_))
        if start + window >= len(told):
            break
    return found


def test_leaks_over_the_whole_table(spark, small_dir):
    """Every passage against every item, scored in full by a model of its own."""
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()]
    want = {(i, k): tuple(round(x, 9) for x in v) for i, t in documents(spark, small_dir).items() for k, v in bm25_leaks(items, t).items()}
    got = {(r["doc_id"], r["item_id"]): tuple(round(v, 9) for v in r[2:]) for r in queries.op8_benchmark_leaks(spark, small_dir).collect()}
    assert got == want and want


def test_an_item_without_its_answer_is_no_leak():
    rng = random.Random(21)
    question = " ".join(f"q{i}" for i in range(40))
    items = [(1, f"{question}? The answer is blue whale."), (2, " ".join(f"z{i}" for i in range(30)))]
    index = decontaminate.BlockMaxIndex(items)
    filler = " ".join(f"f{rng.randrange(50)}" for _ in range(60))
    assert [x[0] for x in index.leaks(f"{filler} {question}? the answer is blue whale {filler}")] == [1]
    assert index.leaks(f"{filler} {question}? none of it {filler}") == [] == [*bm25_leaks(items, f"{filler} {question}? none of it {filler}")]


def test_a_sliced_benchmark_finds_the_same(spark, small_dir, monkeypatch):
    docs, bench = (spark.read.parquet(f"{small_dir}/{n}.parquet") for n in ("documents", "benchmark"))
    one = decontaminate.with_leaks(docs.select("doc_id", "text"), bench)
    one = {(r["doc_id"], tuple(sorted((x["item_id"], round(x["score"], 9)) for x in r["leaks"]))) for r in one.collect()}
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 4000)
    several = decontaminate.with_leaks(docs.select("doc_id", "text"), bench)
    assert {(r["doc_id"], tuple(sorted((x["item_id"], round(x["score"], 9)) for x in r["leaks"]))) for r in several.collect()} == one


def test_held_out_rows_of_the_whole_table(spark, small_dir):
    rows = queries.op6_quality_nbsvm(spark, small_dir).collect()
    assert {r["doc_id"] for r in rows} == set(documents(spark, small_dir))
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)


def test_toxicity_on_held_out_rows(spark):
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 0
    chain = toxicity.train(docs.select("doc_id", "text"), marks.where(~held), toxicity.label_categories())
    rows = toxicity.score(docs.select("doc_id", "text").join(marks.where(held), "doc_id"), chain).collect()
    caught = [r["p_toxic"] >= chain.thresholds[-1] for r in rows if r["toxic"]]
    spared = [r["p_toxic"] < chain.thresholds[-1] for r in rows if not r["toxic"]]
    assert sum(caught) >= 0.5 * len(caught) and sum(spared) >= 0.9 * len(spared)
    assert [x["category"] for x in chain.report] == ["toxic_junk", "toxic_prose", "toxic"] and all(x["log_loss"] > 0 for x in chain.report)


def results(spark, docs, sf_dir=None):
    """Each operator's rows over docs, by name."""
    bench = spark.createDataFrame([(1, "long1 long2 long3 long4 long5 long6? long7 long8"), (None, "x"), (2, None), (3, "")], BENCH)
    pages = docs.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"))
    return {
        "imatch": imatch.fingerprints(docs),
        "hilbert": hilbert.shard_digest(docs),
        "mixing": mixing.mix_digest(docs),
        "lines": line_runs.line_digest(docs),
        "substrings": substrings.substring_digest(docs),
        "quality": quality.quality(docs.select("doc_id", "text"), labels(spark)),
        "warc": warc.warc_digest(spark, pages),
        "leaks": decontaminate.with_leaks(docs.select("doc_id", "text"), bench),
        "jaccard": jaccard.near_duplicate_digest(docs),
        "toxicity": toxicity.toxicity(docs.select("doc_id", "text"), labels(spark)),
    }


def test_awkward_rows_get_a_result_each(spark):
    docs = awkward(spark)
    out = {name: df.collect() for name, df in results(spark, docs).items()}
    n = docs.count()
    assert {name: len(rows) for name, rows in out.items()} == dict.fromkeys(out, n)
    near = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out["jaccard"] if r["doc_id"] is not None}
    assert near[45][1] == 0 and near[44][1] == 43 and near[40] == (0, 40) and near[42] == (0, 42) and near[41] == (0, 41)
    assert sum(r["component_id"] is None for r in out["jaccard"]) == 1
    assert {r["doc_id"]: r["n_removed"] for r in out["substrings"]}[44] == 60_000
    assert {(r["n_lines"], r["n_dropped"]) for r in out["lines"] if r["doc_id"] in (40, 41)} == {(1, 0)}
    assert len({r["score"] for r in out["quality"] if r["doc_id"] in (40, 41)}) == 1
    assert len({r["p_toxic"] for r in out["toxicity"] if r["doc_id"] in (40, 41)}) == 1
    assert {r["doc_id"] for r in out["leaks"] if r["leaks"]} == {43, 44}
    assert sum(r["record_type"] == "response" for r in out["warc"] if r["page_id"] == 3) in (1, 3)


def test_empty_tables_stay_empty(spark):
    found = {name: df.count() for name, df in results(spark, awkward(spark).where("false")).items()}
    assert len(found) == 10 and set(found.values()) == {0}


def test_rows_that_repeat_an_id_are_one_document(spark):
    docs = table(spark, [(i // 2, "same line", "s") for i in range(18)])
    assert {r["n_dropped"] for r in line_runs.line_digest(docs).collect()} == {0}
    more = docs.unionByName(table(spark, [(9, "SAME line ", "s")]))
    assert {r["n_dropped"] for r in line_runs.line_digest(more).collect()} == {1}


CLASHES = ["__id", "__rank", "__part", "__curve", "__p", "__hot", "__text", "__own0", "id", "node", "size", "copies", "leaks_", "p_junk_", "row"]


def test_columns_of_any_name_pass_through(spark):
    docs = awkward(spark)
    for i, c in enumerate(CLASHES):
        docs = docs.withColumn(c, F.concat(F.lit(f"v{i}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    bench = spark.createDataFrame([(1, "long1 long2 long3 long4 long5 long6? long7 long8")], BENCH)
    kept = {
        "mix": mixing.mix(docs),
        "lines": line_runs.drop_frequent_lines(docs),
        "shards": hilbert.hilbert_shards(docs),
        "clean": toxicity.keep_clean(docs, labels(spark)),
        "quality": quality.quality(docs, labels(spark)),
        "once": jaccard.keep_one_of_each(docs),
        "leaks": decontaminate.keep_uncontaminated(docs, bench),
    }
    for name, df in kept.items():
        assert df.columns[: len(docs.columns)] == docs.columns, name
        rows = df.collect()
        assert rows and all(r[c] == f"v{i}-{'none' if r['doc_id'] is None else r['doc_id']}" for r in rows for i, c in enumerate(CLASHES)), name


def test_pipeline_over_a_small_folder(spark, tmp_path):
    """All five stages: what each drops is what brute force over its own input drops."""
    import corpus_pipeline as pipeline

    rng = random.Random(31)
    rows, marks = [], []
    for i in range(160):
        words = [f"w{rng.randrange(3000)}" for _ in range(60)]
        toxic = i % 8 == 0
        if toxic:
            words[7] = words[31] = "vileword"
        rows.append((i, " ".join(words), f"s{i % 4}"))
        marks.append((i, 1, int(toxic)))
    item = " ".join(f"q{k}" for k in range(20)) + "? Answer is forty two."
    rows += [(200 + k, rows[1 + 8 * k][1] + " more", "s1") for k in range(5)] + [(300, rows[3][1][:150] + " " + item, "s2"), (301, None, "s0"), (302, None, "s0")]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], BENCH).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        after = stage(spark, docs, str(tmp_path))
        if name != "sharding":
            assert after.columns == docs.columns
        path = f"{tmp_path}/{name}"
        after.write.parquet(path)
        seen[name] = ({r["doc_id"]: r["text"] for r in docs.collect()}, spark.read.parquet(path).collect())
        docs = spark.read.parquet(path)
    ids = {name: {r["doc_id"] for r in rows_} for name, (_, rows_) in seen.items()}
    assert ids["toxicity"] == {i for i, _, _ in rows if not (i < 160 and i % 8 == 0)}
    before = seen["near_duplicates"][0]
    assert ids["near_duplicates"] == {i for i, (n, c) in components(before).items() if n == 0 or c == i}
    assert ids["decontamination"] == set(seen["decontamination"][0]) - {300}
    assert ids["mixing"] <= ids["decontamination"] and max(Counter(r["doc_id"] for r in seen["mixing"][1]).values()) <= 2
    shards = Counter(r["shard"] for r in seen["sharding"][1])
    assert len(seen["sharding"][1]) == len(seen["mixing"][1]) and max(shards.values()) - min(shards.values()) <= 1
    assert Counter(r["doc_id"] for r in pipeline.run(spark, str(tmp_path)).collect()) == Counter(r["doc_id"] for r in seen["sharding"][1])
