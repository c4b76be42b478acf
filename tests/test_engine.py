from pyspark.sql import functions as F
import pytest

from tidewright.functions import text as tx
from tidewright.operators import queue as qu
from tidewright.operators import ranking as rk
from tidewright.operators import selection as sel
from tidewright.plans import definitions as de
from tidewright.plans import ledger_views as lv
from tidewright.plans import panels
from tidewright.plans import retrieval as re


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_identifiers_split_camel_and_snake(spark):
    df = spark.createDataFrame([("flagSkipReason flag_skip a",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.identifiers(F.col("t"))).collect()] == [["flag", "skip", "reason", "flag", "skip"], []]


def test_every_seconds(spark):
    df = spark.createDataFrame([(x,) for x in ("90", "30s", "5m", "6h", "1d", "0s", "5x", "m5", "", None)], "t string")
    assert [r[0] for r in df.select(tx.every_seconds(F.col("t"))).collect()] == [90, 30, 300, 21600, 86400, None, None, None, None, None]


def test_fractional_rank_shares_ties_and_abstains(spark):
    df = spark.createDataFrame([(1, "a", 3), (1, "b", 1), (1, "c", 1), (2, "a", 5), (2, "b", 5)], "q int, key string, s int")
    assert rows(sel.fractional_rank(df, "s", ["q"]).select("q", "key", "rank")) == [(1, "a", 1.0), (1, "b", 2.5), (1, "c", 2.5)]


def test_pack_keeps_first_and_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([(1, "a", 1, "x" * 9), (1, "b", 2, "x" * 9), (1, "c", 3, "x")], "q int, key string, place int, display string")
    assert [r["packed"] for r in sel.pack_bytes(df, 10).orderBy("place").collect()] == [True, False, True]


def test_mmr_prefers_the_complement(spark):
    pool = [(0, "a", 1.0, [1], [1.0]), (0, "b", 0.99, [1], [1.0]), (0, "c", 0.6, [2], [1.0]), (0, "d", 0.0, [3], [1.0])]
    df = spark.createDataFrame(pool, "q long, key string, score double, slots array<int>, weights array<double>")
    assert [r["key"] for r in sel.mmr(df, 2).orderBy("step").collect()] == ["a", "c"]
    assert [r["key"] for r in sel.mmr(df, 2, 0).orderBy("step").collect()] == ["a", "b"]


def save_copies(spark, path):
    """130 copies of the best text, then 60 different ones with a hit, one of them three times; a text without identifiers; others without a hit."""
    texts = ["alpha beta"] * 130 + [f"alpha w{i:02d}" for i in range(60)] + ["alpha w07"] * 2 + ["!"] + ["gamma"] * 5
    docs = [(1000 + i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(7, "alpha beta"), (8, "delta")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs


def walked(docs, query, cap=50):
    """Pool and skipped copies of a walk over the whole ranking, as the reference goes."""
    asked = set(query.split())
    scores = {str(i): len(asked & set(t.split())) for i, t, *_ in docs}
    kinds = sorted(scores.values())
    rank = {s: sum(x > s for x in kinds) + (kinds.count(s) + 1) / 2 for s in set(kinds)}
    fused = {k: round(1 / (60 + rank[s]), 6) if len(rank) > 1 else 0.0 for k, s in scores.items()}
    text, seen, pool, skipped = {str(i): t for i, t, *_ in docs}, set(), [], 0
    for k in sorted(fused, key=lambda k: (-fused[k], k)):
        if text[k] in seen:
            skipped += 1
            continue
        seen.add(text[k])
        pool.append(k)
        if len(pool) == cap:
            break
    return pool, skipped


def test_pool_holds_fifty_texts_whatever_their_copies(spark, tmp_path):
    docs = save_copies(spark, tmp_path)
    want = {q: walked(docs, text) for q, text in ((7, "alpha beta"), (8, "delta"))}
    assert len(want[7][0]) == 50 and want[7][1] == 129
    got = {r["q"]: r for r in re.funnel_counts(spark, str(tmp_path)).collect()}
    for q, (pool, skipped) in want.items():
        assert (got[q]["pool"], got[q]["deduped"], got[q]["chosen"]) == (len(pool), skipped, 5)
        assert got[q]["gathered"] == got[q]["considered"] == len(docs)
    base = re.corpus(spark, str(tmp_path))
    for cap in (3, 70):
        ranked = rk.lexical_top(base, re.asked(spark, str(tmp_path)), re._flat(base), k=cap, distinct=True)
        found = sel.copies_passed(base, ranked, cap).collect()
        rows_of = {q: [r["key"] for r in ranked.where(F.col("q") == q).orderBy("place").collect()] for q in (7, 8)}
        for r in found:
            pool, skipped = walked(docs, {7: "alpha beta", 8: "delta"}[r["q"]], cap)
            assert rows_of[r["q"]] == pool and (r["pool"], r["deduped"]) == (len(pool), skipped)


def test_knn_asks_every_fiftieth_row(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(2)
    ids = [*range(0, 8000, 10), 1, 2]
    vectors = np.round(rng.normal(size=(len(ids), 4)), 3).astype(np.float32).astype(float)
    rows_ = [(i, v.tolist(), 0) for i, v in zip(ids, vectors, strict=True)]
    spark.createDataFrame(rows_, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    want = set()
    for q in range(0, 8000, 50):
        scores = np.round(unit @ unit[ids.index(q)], 6)
        best = sorted((x for x in zip(-scores, ids, strict=True) if x[1] != q))[:5]
        want |= {(q, key, place) for place, (_, key) in enumerate(best, 1)}
    got = re.knn_top5(spark, str(tmp_path)).collect()
    assert {(r["q"], r["key"], r["place"]) for r in got} == want and len(got) == 5 * 160


def test_mmr_gets_five_different_texts(spark, tmp_path):
    text = {str(i): t for i, t, *_ in save_copies(spark, tmp_path)}
    picked = re.mmr_select(spark, str(tmp_path)).where("q = 7").collect()
    assert len({text[r["key"]] for r in picked}) == len(picked) == 5


def test_enqueue_is_idempotent(spark):
    df = spark.createDataFrame([(2, "k", "h"), (1, "k", "h"), (3, "k", "g")], "event_id long, kind string, payload_hash string")
    first = qu.enqueue(df)
    assert rows(first.select("event_id", "arrivals")) == [(1, 2), (3, 1)]
    assert qu.enqueue(df, first).count() == 0


def test_retry_ladder(spark):
    df = spark.createDataFrame([(i, "forge_server", i) for i in range(11)] + [(99, "nobody", 0)], "id int, error_class string, attempts int")
    out = {r["id"]: (r["new_state"], r["next_attempt"]) for r in qu.fail(df, qu.policy_table(spark), F.lit(0)).collect()}
    assert out[0] == ("retry_wait", 10) and out[9] == ("retry_wait", 600) and out[10] == ("parked", None) and out[99] == ("failed", None)


def test_barriers_fire_once(spark):
    members = spark.createDataFrame([(1, "done"), (1, "failed"), (2, None)], "group_id int, state string")
    groups = qu.barriers(members)
    assert rows(qu.fire(groups, groups.where("false")).select("group_id", "total", "done", "failed")) == [(1, 2, 1, 1)]
    assert qu.fire(groups, groups).count() == 0


def test_rosters_are_cut_at_200_and_say_so(spark, tmp_path):
    lines = [(1, n, "O" if n == 205 else "F", "R" if n % 2 else "A") for n in range(1, 206)] + [(2, 1, "F", "N")]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber long, l_linestatus string, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = [(1, n, "failed" if n % 2 else "done", 205, True) for n in range(1, 201)] + [(2, 1, "deferred", 1, False)]
    assert rows(lv.join_roster(spark, str(tmp_path)).select("group_id", "task_id", "state", "total", "truncated")) == want


def test_schedule_fires_once_a_window(spark):
    ticks = spark.createDataFrame([(t,) for t in (1000, 1001, 1199, 1200)], "at long")
    assert rows(qu.schedule_fires(ticks, 300)) == [(900, 1000, 3), (1200, 1200, 1)]


def test_panels_are_single_selects(spark):
    assert panels.run_panel(spark, "select :x AS x", {"x": 3}).first()[0] == 3
    for bad in ("drop table x", "select 1; select 2"):
        with pytest.raises(ValueError):
            panels.guard(bad)


def test_definitions_are_proved(spark):
    good = {"kind": "k", "steps": {"a": {"block": "b", "outcomes": ["ok"], "on": {"ok": "done"}}}}
    assert de.prove(de.workflow(good)) == []
    bad = {"kind": "k", "steps": {"a": {"block": "b", "outcomes": ["ok", "no"], "on": {"ok": "a"}}}}
    assert len(de.prove(de.workflow(bad))) == 2
    with pytest.raises(ValueError):
        de.workflow(good | {"odd": 1})


def test_flagship_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 200
