"""Policies, health, barriers' results, audits, retention, commands, panels and envelopes on small frames."""

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from tidewright.functions import json_values as jv
from tidewright.operators import blocks, reports
from tidewright.operators import queue as qu
from tidewright.operators.ordering import running
from tidewright.plans import panels
from tidewright.sources.ledger import Ledger


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_policies_are_tuned_and_checked():
    found = {r[0]: r for r in qu.build_policy({"timeout": {"max_attempts": 3}, "own_class": {"max_attempts": 1, "park": True, "unpark_s": None}})}
    assert found["timeout"] == ("timeout", 3, 60, 3600, False, False, 600) and found["own_class"] == ("own_class", 1, 0, 0, True, False, None)
    assert qu.build_policy() == qu.POLICY
    for bad in ({"Bad": {"max_attempts": 1}}, {"timeout": {}}, {"timeout": {"consume": True}}, {"timeout": {"max_attempts": -1}}, {"timeout": {"max_attempts": True}}, {"timeout": {"park": 1}}, {"framework_bug": {"max_attempts": 1}}, {"own": {"max_attempts": 1}}, {"timeout": {"base_s": None}}, []):
        if bad:
            with pytest.raises(ValueError):
                qu.build_policy(bad)


def test_a_doctor_finds_what_is_stuck(spark):
    tasks = spark.createDataFrame([("running", None), ("retry_wait", 50), ("retry_wait", 500), ("done", None), ("retry_wait", 100 + 172_801)], "state string, next_attempt long")
    assert rows(reports.doctor(tasks, 100, 95), "issue", "n") == [("waits beyond two days", 1)]
    assert rows(reports.doctor(tasks, 100, None), "issue", "n") == [("overdue without a daemon", 1), ("running without a daemon", 1), ("waits beyond two days", 1)]
    assert ("heartbeat is stale", 500) in rows(reports.doctor(tasks, 600, 100), "issue", "n")
    assert ("heartbeat is from the future", 100) in rows(reports.doctor(tasks, 100, 200, free_mb=5, least_mb=10), "issue", "n")
    assert reports.doctor(tasks.where("state = 'done'"), 100, 99, free_mb=50, least_mb=10).count() == 0


def test_barriers_hand_on_their_members_results(spark):
    members = spark.createDataFrame([(1, 10, "done"), (1, 11, None), (1, 12, "done"), (2, 20, "failed")], "group_id long, task_id long, state string")
    tasks = spark.createDataFrame([(i, "k", f"r{i}") for i in (10, 11, 12, 20)], "id long, kind string, result string")
    groups = spark.createDataFrame([(1, "e", 5), (2, "e", None), (3, "e", None)], "group_id long, event string, fired_at long")
    got = {r["group_id"]: r for r in reports.collected(members, tasks, groups, limit=2).collect()}
    assert (got[1]["total"], got[1]["counts"], got[1]["truncated"]) == (3, {"done": 2, "waiting": 1}, True)
    assert [tuple(m) for m in got[1]["members"]] == [(10, "done", "k", "r10"), (11, None, "k", "r11")]
    assert (got[2]["total"], got[2]["truncated"], got[3]["total"], got[3]["members"]) == (1, False, 0, None)


def test_retention_keeps_what_is_live(spark, tmp_path):
    day = 86_400
    frames = {
        "tasks": spark.createDataFrame([(1, "done", 0), (2, "running", 0), (3, "done", 99 * day)], "id long, state string, updated_at long"),
        "runs": spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "id long, task long"),
        "events": spark.createDataFrame([(1, 0), (2, 99 * day), (3, None)], "id long, at long"),
        "groups": spark.createDataFrame([(1, 0), (2, None), (3, 99 * day)], "group_id long, fired_at long"),
        "members": spark.createDataFrame([(1, 1), (1, 2), (2, 3), (3, 4)], "group_id long, task_id long"),
    }
    schemas = {k: ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) for k, df in frames.items()}
    ledger = Ledger(spark, f"file://{tmp_path}/l")
    ledger.commit("one", {k: df.limit(1) for k, df in frames.items()})
    ledger.commit("two", {k: df.exceptAll(df.limit(1)) for k, df in frames.items()})
    left, gone = reports.swept({k: ledger.table(k, s) for k, s in schemas.items()}, F.lit(100 * day).cast("bigint"), 14)
    assert rows(gone, "kind", "n") == [("events", 1), ("groups", 1), ("members", 2), ("runs", 1)]
    assert ledger.rewrite("sweep", left) and not ledger.rewrite("sweep", left)
    assert rows(ledger.table("runs", schemas["runs"]), "id") == [(2,), (3,)] and rows(ledger.table("events", schemas["events"]), "id") == [(2,), (3,)]
    assert rows(ledger.table("members", schemas["members"]), "group_id") == [(2,), (3,)] and ledger.table("tasks", schemas["tasks"]).count() == 3
    ledger.commit("three", {"events": frames["events"].where("id = 1")})
    assert rows(ledger.table("events", schemas["events"]), "id") == [(1,), (2,), (3,)]


def test_a_crash_in_a_rewrite_leaves_the_table(spark, tmp_path):
    ledger, frame = Ledger(spark, f"file://{tmp_path}/l"), spark.createDataFrame([(1,), (2,)], "id long")
    ledger.commit("one", {"a": frame, "b": frame})
    real = Ledger._tell

    def dying(self, step, lines):
        raise KeyboardInterrupt

    Ledger._tell = dying
    try:
        with pytest.raises(KeyboardInterrupt):
            ledger.rewrite("two", {"a": frame.where("id = 1"), "b": frame.limit(0)})
    finally:
        Ledger._tell = real
    assert rows(ledger.table("a", "id long"), "id") == rows(ledger.table("b", "id long"), "id") == [(1,), (2,)]


def test_commands_run_without_a_shell(spark):
    table = [(1, 1, "echo", ["echo", "a b", "$HOME"], None), (2, 1, "bad", ["test", "1", "-gt", "2"], None), (3, 1, "none", ["no-such-command"], None), (4, 1, "slow", ["sleep", "5"], None), (5, 1, "where", ["pwd"], "/")]
    ran = blocks.run_commands(spark.createDataFrame(table, "id long, place int, name string, cmd array<string>, cwd string"), timeout_s=1)
    got = {r["id"]: r for r in ran.collect()}
    assert (got[1]["exit_code"], got[1]["out"]) == (0, "a b $HOME\n") and got[2]["exit_code"] == 1 and got[3]["exit_code"] is None and got[4]["err"] == "timeout" and got[5]["out"] == "/\n"


def test_a_runner_starts_processes_itself_and_ends_as_subprocess_does(monkeypatch):
    runner, odd = blocks.Runner(1), "head -c 200000 /dev/zero; head -c 200000 /dev/zero >&2; kill -9 $$"
    cases = [["echo", "a b", "é"], ["sh", "-c", odd], ["sh", "-c", "exit 3"], ["/bin/sh", "-c", "read x || echo no input"]]
    want = [subprocess.run(c, capture_output=True, stdin=subprocess.DEVNULL, check=False) for c in cases]
    open_before = len(os.listdir("/proc/self/fd"))
    with pytest.raises(FileNotFoundError, match="no-such-command"):
        runner.run(["no-such-command"], None)
    monkeypatch.setattr(subprocess, "run", None)
    for c, w in zip(cases, want, strict=True):
        assert runner.run(c, None) == (w.returncode, w.stdout, w.stderr)
    for overruns in ("sleep 5", "exec >&- 2>&-; sleep 5", "while true; do echo x; done"):
        with pytest.raises(subprocess.TimeoutExpired):
            runner.run(["sh", "-c", overruns], None)
    assert len(os.listdir("/proc/self/fd")) == open_before


def test_checks_are_told_by_exit_codes(spark):
    ran = spark.createDataFrame([(1, 1, "a", 0, "x"), (1, 2, "b", 0, ""), (2, 1, "a", 0, ""), (2, 2, "b", 3, ""), (2, 3, "c", 1, ""), (3, 1, "a", 2, ""), (4, 1, "a", None, "")], "id long, place int, name string, exit_code int, out string")
    assert rows(blocks.suite(ran, {"b": [3]}), "id", "outcome", "failed") == [(1, "green", None), (2, "red_retryable", "b"), (3, "red", "a"), (4, "timeout", "a")]
    one = ran.where("place = 1")
    expect = spark.createDataFrame([(1, 0, None, None), (2, None, True, None), (3, 2, None, None), (4, 0, None, None)], "id long, exit_code int, nonzero boolean, out_sha string")
    assert rows(blocks.rechecked(one, expect), "id", "outcome") == [(1, "confirmed"), (2, "refuted"), (3, "confirmed"), (4, "timeout")]
    shas = spark.createDataFrame([(1, None, None, "0")], "id long, exit_code int, nonzero boolean, out_sha string")
    assert rows(blocks.rechecked(one.where("id = 1"), shas.withColumn("out_sha", F.sha2(F.lit("x"), 256))), "outcome") == [("confirmed",)]
    assert rows(blocks.rechecked(one.where("id = 1"), shas), "outcome") == [("refuted",)]


def test_panels_of_each_kind(spark):
    assert [tuple(r) for r in panels.show(spark, "kv", "SELECT :a AS x, 'y' AS `link:part`", {"a": 3}).orderBy("place").collect()] == [(0, "x", "3"), (1, "link:part", "y")]
    grid = panels.show(spark, "status_grid", "SELECT * FROM VALUES ('r', 'c', 'old'), ('r', 'c', 'new'), ('r', 'd', 'x') AS t(row, column, state)", {})
    assert rows(grid, "row", "column", "state") == [("r", "c", "new"), ("r", "d", "x")]
    assert panels.links(spark.sql("SELECT 1 AS `link:part`, 2 AS other")) == {"link:part": "part"}
    assert panels.entity(spark, {"part": "SELECT :key AS id"}, "part", 7).first()["value"] == "7"
    for call in (lambda: panels.show(spark, "pie", "SELECT 1", {}), lambda: panels.show(spark, "status_grid", "SELECT 1 AS a", {}), lambda: panels.entity(spark, {}, "part", 1), lambda: panels.entity(spark, {"p": "SELECT 1"}, "p", 1)):
        with pytest.raises(ValueError):
            call()


def test_envelopes_and_their_errors(spark):
    texts = ["plain", '{"result":"r","session_id":"s","subtype":"success"}', '{"result":"r","subtype":"error_max_turns"}', '{"is_error":true,"api_error_status":401}', '{"is_error":true,"api_error_status":500}', "[1]", '{"result":"r"}']
    frame = spark.createDataFrame([(i, t, int(i == 6)) for i, t in enumerate(texts)], "i int, t string, code int").withColumn("e", jv.envelope(F.col("t")))
    got = rows(frame.select("i", "e.result", "e.session_id", jv.envelope_error(F.col("code"), F.col("e")).alias("error")), "i", "result", "session_id", "error")
    assert got == [(0, "plain", None, None), (1, "r", "s", None), (2, "r", None, "agent_limit"), (3, "", None, "agent_limit"), (4, "", None, "agent_backend"), (5, "[1]", None, None), (6, "r", None, "agent_backend")]


def test_running_sums_over_hot_and_null_groups(spark):
    data = [("hot", i, i % 7) for i in range(300)] + [(None, i, 1) for i in range(5)] + [("", 1, 2), ("one", 3, None)]
    found = running(spark.createDataFrame(data, "g string, k long, v long").repartition(5), ["g"], [F.col("k")], "v", "used")
    want = []
    for g in ("hot", None, "", "one"):
        own, used = sorted((k, v) for h, k, v in data if h == g), None
        total = sum(v for _, v in own if v is not None) if any(v is not None for _, v in own) else None
        for k, v in own:
            used = v if used is None else used + (v or 0)
            want.append((g, k, used, total, len(own)))
    assert rows(found, "g", "k", "used", "__total", "__rows") == sorted(want, key=repr)


def test_cards_status_and_notifications(spark):
    tasks = spark.createDataFrame([("t", 1, "a", "done", None), ("t", 2, "a", "parked", "awaiting_human"), ("u", 3, "b", "done", None)], "thread string, id long, kind string, state string, error_class string")
    progress = spark.createDataFrame([(1, 2, 3), (3, 1, 1)], "id long, done long, total long")
    asks = spark.createDataFrame([(2, "pick one")], "id long, title string")
    got = [tuple(r) for r in reports.run_cards(tasks, progress, asks).orderBy("thread").collect()]
    assert got == [("t", 2, "a:parked", 2, 3, "pick one", "needs-human", 2), ("u", 1, "b:done", 1, 1, None, "complete", 3)]
    members = spark.createDataFrame([(1, "done"), (1, None), (2, None)], "group_id long, state string")
    events = spark.createDataFrame([(i, f"e.{i}") for i in range(4)], "event_id long, name string")
    told = rows(reports.status(tasks, members, members.where("group_id = 2").select("group_id"), tasks.select("state"), events, 2), "section", "key", "n")
    assert told == [("events", "e.2", 2), ("events", "e.3", 3), ("items", "done", 2), ("items", "parked", 1), ("open joins", "groups", 1), ("open joins", "waiting", 1), ("parked", "awaiting_human", 1), ("tasks", "a done", 1), ("tasks", "a parked", 1), ("tasks", "b done", 1)]
    frame = spark.createDataFrame([(1, "user.x", '{"a":{"b":5}}'), (2, "item.y", "{}")], "id long, name string, payload string")
    found = blocks.notifications(frame, [("one", "user.*", ["say", "{payload.a.b} of {event.id}"]), ("all", "*.?", ["no"]), ("dot", "item.y", ["{event.name}"])])
    assert rows(found, "id", "name", "cmd") == [(1, "one", ["say", "5 of 1"]), (2, "dot", ["item.y"])]
