"""Operators of steps, channels, checks and the ledger on small frames."""

import pytest
from pyspark.sql import functions as F

from tidewright.functions import checks as ck
from tidewright.functions import text as tx
from tidewright.functions import vectors as vx
from tidewright.operators import blocks
from tidewright.operators import channels as ch
from tidewright.operators import queue as qu
from tidewright.operators import steps as st
from tidewright.plans import catalogue, definitions
from tidewright.sources import files
from tidewright.sources.ledger import Ledger


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_every_query_has_sql_or_needs_none():
    without = set(catalogue.queries()) - set(catalogue.oracle_sql())
    assert without == set() and len(catalogue.queries()) > 90


def test_a_step_commits_once_and_together(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    frame = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    assert ledger.table("a", "id long").count() == 0 and ledger.steps() == []
    ledger.stage("s1", {"a": frame(9), "b": frame(9)})  # a crash before the manifest
    assert ledger.table("a", "id long").count() == 0
    assert ledger.commit("s1", {"a": frame(1, 2), "b": frame(3)}) and not ledger.commit("s1", {"a": frame(1, 2)})
    assert ledger.commit("s2", {"a": frame(4)})
    assert rows(ledger.table("a", "id long"), "id") == [(1,), (2,), (4,)] and rows(ledger.table("b", "id long"), "id") == [(3,)]
    assert Ledger(spark, f"file://{tmp_path}/ledger").steps() == ["s1", "s2"]


def test_resume_replays_to_the_first_gap(spark):
    recorded = spark.createDataFrame([(1, 1), (1, 2), (1, 4), (2, 2), (3, 1), (3, 1)], "task_id long, step long")
    assert rows(st.frontier(recorded, 5, (1,)), "task_id", "replayed", "next_step") == [(1, 1, 3), (2, 0, 1), (3, 0, 2)]


def test_expected_members(spark):
    parents = spark.createDataFrame([(1, "a", 2), (2, "b", 0), (3, "c", 1)], "id long, event string, n long")
    subs = spark.createDataFrame([("a", "x"), ("a", "y")], "event string, kind string")
    assert rows(st.expected(parents, subs), "id", "expected") == [(1, 4), (2, 0), (3, 0)]


def test_failed_members_reopen_until_their_group_fires(spark):
    roster = spark.createDataFrame([(1, 1, "failed"), (1, 2, None), (2, 1, "failed")], "group_id long, task_id long, state string")
    assert rows(st.reopened(roster, spark.createDataFrame([(2,)], "group_id long")), "group_id", "task_id") == [(1, 1)]
    capped = st.roster_cap(roster, 1)
    assert rows(capped, "group_id", "task_id", "total", "truncated") == [(1, 1, 2, True), (2, 1, 1, False)]


def test_retry_unpark_and_orphans(spark):
    tasks = spark.createDataFrame([(1, "failed", "timeout", 3), (2, "parked", "agent_limit", 1), (3, "parked", "forge_auth", 0), (4, "running", None, 0)], "id long, state string, error_class string, attempts int")
    assert rows(st.retried(tasks), "id", "state", "error_class", "attempts") == [(1, "pending", None, 4)]
    assert rows(st.unparked(tasks, ("agent_limit",)), "id", "attempts") == [(2, 2)] and st.unparked(tasks).count() == 2
    assert rows(st.reset_orphans(tasks).where("state = 'pending'"), "id") == [(4,)]


def test_running_tasks_take_up_their_lane(spark):
    tasks = spark.createDataFrame([(1, "running", None, "a"), (2, "pending", None, "a"), (3, "pending", None, "a"), (4, "pending", None, "b")], "id long, state string, next_attempt long, lane string")
    lanes = spark.createDataFrame([("a", 2), ("b", 1)], "lane string, cap int")
    assert rows(qu.claim(tasks, F.lit(0), lanes), "id") == [(2,), (4,)]


def test_rerank_keeps_the_order_without_a_judge(spark):
    ranked = spark.createDataFrame([(q, k, 1.0 - p / 10, p) for q in (1, 2) for p, k in enumerate("abc", 1)], "q long, key string, score double, place int")
    judged = spark.createDataFrame([(1, "b", 99), (1, "c", 3)], "q long, key string, judge int")
    out = {(r["q"], r["place"]): r["key"] for r in ch.rerank(ranked, judged, 2).collect()}
    assert [out[1, p] for p in (1, 2, 3)] == ["b", "a", "c"] and [out[2, p] for p in (1, 2, 3)] == ["a", "b", "c"]


def test_channels_vote_by_average_rank_and_abstain(spark):
    pairs = spark.createDataFrame([(1, "a", 2, 0.5), (1, "b", 2, 0.5), (1, "c", 0, 0.5)], "q long, key string, lexical int, semantic double")
    got = {r["key"]: r["score"] for r in ch.fuse(pairs, {"lexical": 1.0, "semantic": 1.0}).collect()}
    assert got == {"a": round(1 / 61.5, 6), "b": round(1 / 61.5, 6), "c": round(1 / 63, 6)}


def test_cosines_of_texts(spark):
    docs = spark.createDataFrame([("1", "crash parser"), ("2", "docs readme"), ("3", "")], "key string, text string")
    asked = spark.createDataFrame([(7, "crash parser")], "q long, text string")
    got = {r["key"]: r["semantic"] for r in ch.cosine_scores(ch.dense_vectors(docs, "key"), ch.dense_vectors(asked, "q")).collect()}
    assert got["1"] == 1.0 and got["3"] == 0.0 and got["2"] < 0.9


def test_the_last_vector_of_a_batch_replaces_the_kept_one(spark):
    schema = "object_id long, model_sha string, seq long, vec string"
    kept = spark.createDataFrame([(1, "m", 1, "old"), (2, "m", 2, "stays")], schema)
    new = spark.createDataFrame([(1, "m", 5, "a"), (1, "m", 6, "b"), (1, "n", 7, "c")], schema)
    assert rows(ch.store_vectors(new, kept), "object_id", "model_sha", "vec") == [(1, "m", "b"), (1, "n", "c"), (2, "m", "stays")]


def test_uses_are_recorded_once_and_not_in_a_preview(spark):
    chosen = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (2, "c")], "task_id long, key string")
    kept = spark.createDataFrame([(2, "c")], "task_id long, key string")
    assert rows(ch.record_uses(chosen, kept), "task_id", "key") == [(1, "a")] and ch.record_uses(chosen, kept, tracked=False).count() == 0


def test_filters_are_loud(spark):
    frame = spark.createDataFrame([(1, None), (2, "x")], "a long, b string")
    assert rows(st.where_equal(frame, {"b": None}), "a") == [(1,)]
    with pytest.raises(ValueError, match="no column c"):
        st.where_equal(frame, {"c": 1})


def test_templates_ages_and_errors(spark):
    frame = spark.createDataFrame([('{"a": {"b": 7}}', 5400, 429)], "p string, s long, h int")
    got = frame.select(tx.template("x{a.b}y", F.col("p")), tx.age(F.col("s")), tx.backend_error(F.col("h")), ck.exit_error(F.lit(1), F.lit(0))).first()
    assert tuple(got) == ("x7y", "1h", "agent_limit", "agent_limit")
    with pytest.raises(Exception, match="unknown template path"):
        frame.select(tx.template("{nope}", F.col("p"))).collect()
    assert [r[0] for r in spark.createDataFrame([(59,), (90,), (172800,)], "s long").select(tx.age(F.col("s"))).collect()] == ["59s", "1m", "2d"]


def test_terminal_effects_and_unit_vectors(spark):
    frame = spark.createDataFrame([("done", None), ("failed", "timeout"), ("failed", "odd"), ("parked", "odd")], "t string, e string")
    assert [r[0] for r in frame.select(qu.terminal_effect(F.col("t"), F.col("e"), F.col("e") == "timeout")).collect()] == ["done", "policy", "failed", "parked"]
    got = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(vx.unit(F.col("v"))).collect()
    assert [r[0] for r in got] == [[0.6, 0.8], [0.0, 0.0]]


FLOW = """
kind: file
consumes: [item.found]
emits: [item.filed]
steps:
  check: {block: check.recheck, outcomes: [ok, red], on: {ok: done, red: failed}}
"""


def test_definitions_load_and_change_with_any_part():
    found = definitions.load([FLOW])
    assert list(found) == ["file"] and found["file"].consumes == ("item.found",)
    changed = definitions.load([FLOW.replace("red: failed", "red: parked")])["file"]
    assert definitions.fingerprint(found["file"]) == definitions.fingerprint(definitions.load([FLOW])["file"]) != definitions.fingerprint(changed)
    with pytest.raises(ValueError, match="has no target"):
        definitions.load([FLOW.replace(", red: failed", "")])
    with pytest.raises(ValueError, match="declared twice"):
        definitions.load([FLOW, FLOW])


def test_blocks_have_closed_outcomes(spark):
    @blocks.block("test.half", ("even", "odd"))
    def half(payload, params):
        if payload["n"] > 9:
            return "large", {}
        return ("odd" if payload["n"] % 2 else "even"), {"half": payload["n"] // params["by"]}

    assert blocks.run_one(blocks.REGISTRY["test.half"], {"n": 4}, {"by": 2}) == ("even", '{"half":2}', None)
    assert blocks.run_one(blocks.REGISTRY["test.half"], {}, {"by": 2})[2] == "framework_bug"
    tasks = spark.createDataFrame([(1, '{"n": 3}'), (2, '{"n": 12}'), (3, '{"n": 1}')], "id long, payload string")
    assert rows(blocks.run_block(tasks, "test.half", {"by": 1}), "id", "outcome", "error_class") == [(1, "odd", None), (2, "failed", "framework_bug"), (3, "odd", None)]
    with pytest.raises(ValueError, match="registered twice"):
        blocks.block("test.half", ("a",))


def test_agents_are_asked_again_with_the_objection(spark):
    def backend(prompt, ask):
        if "down" in prompt:
            raise ConnectionError
        return "{}" if "JSON" in prompt else "plain"

    prompts = spark.createDataFrame([(1, "a"), (2, "in JSON"), (3, "down")], "id long, prompt string")
    out = blocks.run_agent(prompts, backend, lambda answer: None if answer == "{}" else "Answer in JSON.")
    assert rows(out, "id", "verdict", "asked", "error_class") == [(1, "{}", 2, None), (2, "{}", 1, None), (3, None, 1, "agent_backend")]


def test_small_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# a\nb")
    assert rows(files.notes(spark, [f"file://{tmp_path}/a.md"]), "name", "content") == [("a.md", "# a\nb")]
    assert rows(files.tree(spark, f"file://{tmp_path}", "*.md"), "line_no", "line") == [(1, "# a"), (2, "b")]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.notes(spark, [f"file://{tmp_path}/none.md"]).collect()
    secret = tmp_path / "s"
    secret.write_text("# c\nKEY = v=1\n")
    secret.chmod(0o644)
    with pytest.raises(PermissionError):
        files.secrets(str(secret))
    secret.chmod(0o600)
    assert files.secrets(str(secret)) == {"KEY": "v=1"}
    model = tmp_path / "w.json"
    model.write_text('{"dim": 2, "vocab": {"a": [1, 0]}, "buckets": [[0, 1], [1]]}')
    with pytest.raises(ValueError, match="hasn't 2 numbers"):
        files.weights(str(model))
    model.write_text('{"dim": 2, "vocab": {"a": [1, 0]}}')
    assert len(files.weights(str(model))["model_sha"]) == 64
    with pytest.raises(ValueError, match="pinned"):
        files.weights(str(model), "0")


def test_weights_fall_back_to_buckets(spark):
    docs = spark.createDataFrame([(1, "known other"), (2, ""), (3, "other")], "key long, text string")
    vocab = spark.createDataFrame([("known", [3.0, 4.0])], "token string, vec array<double>")
    buckets = spark.createDataFrame([(i, [0.0, 1.0]) for i in range(4)], "bucket long, vec array<double>")
    got = dict(rows(ch.weights_vectors(docs, "key", vocab), "key", "v"))
    assert got == {1: [0.6, 0.8], 2: [0.0, 0.0], 3: [0.0, 0.0]}
    assert dict(rows(ch.weights_vectors(docs, "key", vocab, buckets), "key", "v"))[3] == [0.0, 1.0]


def test_foreign_roots_of_a_template_stay(spark):
    frame = spark.createDataFrame([('{"a": 1}',)], "p string")
    assert frame.select(tx.template("{a}-{prev.x}", F.col("p"), ("a",))).first()[0] == "1-{prev.x}"


def test_recent_events_are_the_last_ten_of_each_name(spark, tmp_path):
    from tidewright.plans import step_queries as sq

    table = [(i, "rare" if i < 12 else "often") for i in range(100)]
    spark.createDataFrame(table, "event_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    want = sorted([(i, "rare") for i in range(2, 12)] + [(i, "often") for i in range(90, 100)])
    assert rows(sq.recent_events(spark, str(tmp_path)), "event_id", "event_type") == want
