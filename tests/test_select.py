"""Selections from end to end on a small corpus."""

import json

import pytest
from pyspark.sql import functions as F

from tidewright.operators import select as se

BODIES = [
    ("a", "the include parser crashes on empty files", "2026-01-01 00:00:00", 0.5, "alpha"),
    ("b", "static int flagSkipReason(void) decides", "2026-01-02 00:00:00", 0.5, "alpha"),
    ("c", "release notes of the last week", "2020-01-01 00:00:00", 0.1, "beta"),
    ("d", "release notes of the last week", "2026-06-01 00:00:00", 0.9, "beta"),
    ("e", "build logs " + "x" * 300, None, None, None),
]


def corpus(spark, rows=BODIES):
    return spark.createDataFrame(rows, "key string, text string, ts string, weight double, repo string")


def tasks(spark, *texts):
    return spark.createDataFrame([(i, list(t) if isinstance(t, tuple) else [t], json.dumps({"q": i})) for i, t in enumerate(texts)], "q long, texts array<string>, payload string")


def keys(found, q=0):
    return [r["key"] for r in found.entries.where(F.col("q") == q).orderBy("place").collect()]


def test_what_is_asked_comes_first(spark):
    found = se.select(corpus(spark), tasks(spark, "crash in the include parser", "why is skip reason flagged", ("include parser", "skip reason"), "release notes"), se.Spec(k=2, max_chars=100))
    assert keys(found)[0] == "a" and keys(found, 1)[0] == "b" and set(keys(found, 2)) == {"a", "b"}
    # Of the twins the newer and heavier one stays.
    assert "d" in keys(found, 3) and "c" not in keys(found, 3)
    f = {r["q"]: r.asDict() for r in found.funnel.collect()}[3]
    assert (f["considered"], f["gathered"], f["deduped"], f["pool"], f["chosen"], f["packed"], f["dropped"], f["reranked"], f["included_all"]) == (5, 5, 1, 4, 2, 2, 0, 0, False)
    assert sorted(r["key"] for r in found.uses.where("task_id = 0").collect()) == sorted(keys(found))


def test_channels_filter_boost_and_weights(spark):
    off = {"lexical": 0, "semantic": 0}
    rows, ask = corpus(spark), tasks(spark, "release notes")
    assert keys(se.select(rows, ask, se.Spec(k=1, weights=off | {"prior": 0}, diversify=0))) == ["d"]  # the newest; without a time last
    assert keys(se.select(rows, ask, se.Spec(k=1, weights=off | {"recency": 0}, diversify=0))) == ["d"]
    found = se.select(rows.drop("ts", "weight"), ask, se.Spec(k=5, weights=off, boost={"repo": "beta"}, filter={"repo": "beta"}, dedup=False))
    assert keys(found) == ["c", "d"] and found.funnel.first()["considered"] == 2
    assert keys(se.select(rows.drop("ts", "weight"), ask, se.Spec(k=1, weights=off, boost={"repo": "alpha"}, diversify=0))) == ["a"]
    uses = spark.createDataFrame([("b", "done"), ("a", "failed")], "key string, state string")
    assert keys(se.select(rows.drop("ts", "weight"), ask, se.Spec(k=1, weights=off, diversify=0), uses=uses)) == ["b"]
    for spec in (se.Spec(filter={"odd": 1}), se.Spec(boost={"odd": 1})):
        with pytest.raises(ValueError, match="no column odd"):
            se.select(rows, ask, spec)


def test_times_are_numbers_only_if_all_are(spark):
    rows = spark.createDataFrame([("a", "x", "9"), ("b", "y", "10"), ("c", "z", None)], "key string, text string, ts string")
    spec = se.Spec(weights={"lexical": 0, "semantic": 0})
    order = lambda df: [r["key"] for r in se.static_votes(df, spec, None).orderBy(F.desc("votes"), "key").collect()]
    assert order(rows) == ["b", "a", "c"]
    assert order(rows.withColumn("ts", F.when(F.col("key") == "a", "9x").otherwise(F.col("ts")))) == ["a", "b", "c"]


def test_small_corpora_are_shown_whole(spark):
    found = se.select(corpus(spark), tasks(spark, "anything", "else"), se.Spec(include_all_under=10_000, max_chars=100, k=1))
    assert keys(found) == keys(found, 1) == list("abcde")
    last = found.entries.where("q = 0 and key = 'e'").first()
    assert last["truncated"] and len(last["text"]) == 100 and found.funnel.first()["included_all"]
    assert not se.select(corpus(spark), tasks(spark, "anything"), se.Spec(include_all_under=50, k=1)).funnel.first()["included_all"]


def judge(prompt, ask):
    _, payload, entries = prompt.split("\n")[:3]
    if json.loads(payload)["q"] == 1:
        raise ConnectionError("gone")
    if ask == 1:
        return "not JSON"
    return json.dumps({"scores": {e["key"]: 99 if e["key"] == "e" else "7" if e["key"] == "a" else 1 for e in json.loads(entries)} | {"stranger": 10}})


def shorten(prompt, ask):
    if "release" in prompt:
        raise ConnectionError("gone")
    return json.dumps({"summary": "logs in short" if "build" in prompt else "something else"})


def test_judges_summaries_budgets_and_previews(spark):
    rows, ask = corpus(spark), tasks(spark, "include parser", "include parser")
    spec = se.Spec(k=3, max_chars=25, diversify=0, max_bytes=45, judge=judge, summarise=shorten)
    found = se.select(rows, ask, spec)
    f = {r["q"]: r.asDict() for r in found.funnel.collect()}
    assert (f[0]["reranked"], f[0]["rerank_error"], f[1]["reranked"], f[1]["rerank_error"]) == (5, None, 0, "agent_backend")
    assert keys(found)[0] == "e" and keys(found, 1)[0] == "a"
    first = found.entries.where("q = 0 and key = 'e'").first()
    assert (first["text"], first["summarized"], first["truncated"], first["judged"]) == ("logs in short", True, False, 10)
    assert all(r["chosen"] == 3 == r["packed"] + r["dropped"] for r in f.values()) and f[0]["dropped"] == 1
    kept = found.summaries.collect()
    assert {r["key"]: r["summary"] for r in kept}["e"] == "logs in short" and not {"c", "d"} & {r["key"] for r in kept}
    again = se.select(rows, tasks(spark, "logs in short"), se.Spec(k=1, max_chars=25, diversify=0, summarise=shorten, weights={"semantic": 0, "recency": 0, "prior": 0}), summaries=found.summaries)
    assert keys(again) == ["e"] and again.summaries.count() == 0  # found by the words of its summary, which isn't made again
    look = se.select(rows, ask, se.Spec(k=3, max_chars=25, judge=judge, summarise=shorten, preview=True))
    assert look.uses.count() == 0 and look.summaries.count() == 0 and look.funnel.first()["reranked"] == 0
    told = {r["q"]: json.loads(r["value"]) for r in se.json_entries(found.entries).collect()}
    assert told[0][0]["rerank"] == 10 and told[0][0]["summarized"] is True and "truncated" not in told[0][0] and "semantic" in told[0][0]["channels"]


def test_diversity_lets_a_complement_in(spark):
    near = [(f"n{i}", f"parser crash in the include path number {i} parser crash", None, None, None) for i in range(4)]
    noise = [(f"x{i}", f"noise {i} words {i * 7} of {i * 3} nothing", None, None, None) for i in range(20)]
    rows = corpus(spark, [*noise, *near, ("z", "linker memory layout explains the crash", None, None, None)]).drop("ts", "weight")
    ask = tasks(spark, "parser crash include linker memory")
    assert "z" in keys(se.select(rows, ask, se.Spec(k=3))) and "z" not in keys(se.select(rows, ask, se.Spec(k=3, diversify=0)))
