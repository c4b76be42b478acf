"""JSON values, walks, decisions, staged effects, traces, providers, neighbours, kept vectors and keyed streams on small frames."""

import hashlib
import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tidewright.functions import json_values as jv
from tidewright.operators import channels as ch
from tidewright.operators import decisions, effects, neighbours, providers, trace, upkeep, walk
from tidewright.operators import steps as st
from tidewright.plans import flow_queries as fq
from tidewright.sources.ledger import Ledger
from tidewright.streaming import state


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


TEXTS = [
    '{"b":1,"a":{"z":1.10,"y":[3,1.0,1e3,-0.0]}}', '{"a":1,"a":2}', "5", '"5"', "not json", "", None, '[1, "x\\u00e9\\n", {"b": 2, "a": null}]',
    '{"a":12345678901234567890123456789012345678901234567890}', '{"\\ud83d\\ude00": 1.5, "é": true, "_": "x.5"}', "{}", "[]", " null ",
]


def test_canonical_json_is_pythons(spark):
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS)], "i int, x string")

    def want(x):
        try:
            return json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except (ValueError, TypeError):
            return None

    got = dict(rows(frame.select("i", jv.canonical(F.col("x")).alias("c")), "i", "c"))
    assert got == {i: want(x) for i, x in enumerate(TEXTS)}


SCHEMA = {"type": "object", "required": ["n", "s"], "properties": {"n": {"type": "integer"}, "s": {"enum": ["a", None]}, "o": {"type": "array", "items": {"type": "object", "required": ["x"], "properties": {"x": {"type": ["number", "null"]}}}}}, "additionalProperties": False}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"n": 3, "s": "a"}', []),
        ('{"n": "3", "s": null}', ["$.n: expected integer, got string"]),
        ('{"n": 3.0, "s": "b"}', ["$.n: expected integer, got number", '$.s: "b" is not allowed']),
        ('{"n": true, "s": "a", "t": 1}', ["$.n: expected integer, got boolean", "$: t is unexpected"]),
        ("{}", ["$: n is missing", "$: s is missing"]),
        ('{"n": 1, "s": "a", "o": [{"x": 1.5}, {"x": "1"}, {}, 4]}', ["$.o[1].x: expected number or null, got string", "$.o[2]: x is missing", "$.o[3]: expected object, got integer"]),
        ("[1]", ["$: expected object, got array"]),
        ("{", ["$: not JSON"]),
        (None, ["$: not JSON"]),
    ],
)
def test_json_is_checked_against_a_schema(spark, text, want):
    assert spark.createDataFrame([(text,)], "v string").select(jv.problems(F.col("v"), SCHEMA)).first()[0] == want


def test_templates_keep_native_types(spark):
    frame = spark.createDataFrame([('{"a":{"b":7,"c":[1,{"d":"x"}],"n":null,"t":true},"s":"y"}',)], "p string")
    roots = {"payload": F.parse_json("p")}
    one = lambda pattern, **k: json.loads(frame.select(F.to_json(jv.filled(pattern, roots, **k))).first()[0])
    assert one("{payload.a.b}") == 7 and one("{payload.a.c}") == [1, {"d": "x"}] and one("{payload.a.n}") is None and one("{payload.a.t}") is True
    assert one("x{payload.a.b}{payload.s} {payload.a.t} {payload.a.n}") == "x7y True None"
    assert one({"k": ["{payload.s}", 3], "e": []}) == {"k": ["y", 3], "e": []}
    assert one("{prev.x}-{payload.s}", partial=True) == "{prev.x}-y" and one("{prev.x}", partial=True) == "{prev.x}"
    with pytest.raises(Exception, match="unresolved template"):
        one("{payload.nope}")
    with pytest.raises(KeyError):
        one("{prev.x}")


def test_prompts_have_sections_in_order_and_a_contract(spark):
    sections = spark.createDataFrame([(1, "Do it. \n", "b", '{"y": 1, "x": [ ]}'), (1, "Do it. \n", "a", "5"), (2, "Alone", None, None)], "id long, base string, name string, value string")
    got = dict(rows(st.prompt(sections, {"b": 1, "a": 2}), "id", "prompt"))
    contract = f'## output contract\n{jv.CONTRACT}\n{{"a":2,"b":1}}\n'
    assert got == {1: f'Do it.\n\n## context: a\n5\n\n## context: b\n{{"x":[],"y":1}}\n\n{contract}', 2: f"Alone\n\n{contract}"}


@pytest.mark.parametrize(("text", "want"), [("x\n```json\n{1}\n```\n```json\n{2}\n ```", "{2}"), ("```\n{3}\n```", "{3}"), ("```json {4}```", "{4}"), (" {5}\n", "{5}"), (" \n", None), (None, None)])
def test_verdicts_are_taken_from_fences(spark, text, want):
    assert spark.createDataFrame([(text,)], "v string").select(jv.verdict_text(F.col("v"))).first()[0] == want


def test_fan_outs_are_known_by_task_name_and_payloads(spark):
    schema = "task long, name string, join_event string, payloads array<string>"
    ops = spark.createDataFrame([(1, "a.x", "j.d", ['{"n":1}', '{"n":1}']), (1, "a.x", "j.d", ['{"n":1}', '{"n":1}']), (1, "a.x", "j.d", ['{"n":2}']), (2, "a.x", "j.d", []), (3, "b.x", "j.d", ["{}"])], schema)
    subs = spark.createDataFrame([("a.x", "p"), ("a.x", "q")], "event string, kind string")
    groups, children = st.fanned_out(ops, subs)
    key = lambda t, n, ps: hashlib.sha256(json.dumps({"task": t, "name": n, "join_event": "j.d", "payloads": ps}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    one, other = key(1, "a.x", [{"n": 1}, {"n": 1}]), key(1, "a.x", [{"n": 2}])
    assert rows(groups, "group_id", "expect", "complete") == sorted([(one, 4, False), (other, 2, False), (key(2, "a.x", []), 0, True), (key(3, "b.x", [{}]), 0, True)], key=repr)
    assert rows(children.where("kind = 'p'"), "group_id", "idx", "payload") == sorted([(g, i, f'{{"_join":{{"group":"{g}","index":{i}}},"n":{n}}}') for g, i, n in ((one, 0, 1), (one, 1, 1), (other, 0, 2))], key=repr)


def test_retry_by_id_and_kind_and_clocks_start_again(spark):
    schema = "id long, kind string, state string, error_class string, attempts int, next_attempt long, updated_at long"
    tasks = spark.createDataFrame([(1, "a", "failed", "timeout", 3, 9, 1), (2, "b", "failed", "timeout", 0, None, 1), (3, "a", "parked", "agent_limit", 1, 5, 1)], schema)
    assert rows(st.retried(tasks, ids=[2]), "id", "attempts") == [(2, 1)] and rows(st.retried(tasks, kind="a"), "id", "attempts", "next_attempt", "error_class") == [(1, 4, None, None)]
    assert rows(st.unparked(tasks, ids=[3]), "id", "attempts", "next_attempt", "state") == [(3, 2, None, "pending")] and st.unparked(tasks, ids=[1]).count() == 0
    again = st.rearmed(tasks, spark.createDataFrame([(3,), (1,)], "id long"), F.lit(50).cast("bigint"))
    assert rows(again, "id", "updated_at") == [(1, 1), (2, 1), (3, 50)]


DECISION = "id long, key string, round long, task long, status string, verdict string, consumed boolean"


def test_gates_consume_wait_stick_and_open(spark):
    kept = spark.createDataFrame(
        [(1, "a", 1, 7, "resolved", "picked", False), (2, "b", 1, 7, "resolved", "picked", True), (3, "c", 1, 7, "resolved", "picked", True), (4, "c", 2, 7, "resolved", "revise", True), (5, "d", 1, 1, "open", None, False), (6, "e", 3, 7, "superseded", None, False)],
        DECISION,
    )
    visits = spark.createDataFrame([(7, "a", True), (7, "b", True), (8, "bb", False), (7, "c", True), (7, "d", True), (7, "e", True)], "task long, key string, asks boolean")
    got = decisions.gate(visits, kept)
    assert rows(got, "key", "outcome", "decision", "round", "effect") == [
        ("a", "picked", 1, 1, "consume"), ("b", "picked", 2, 1, "sticky"), ("bb", "framework_bug", None, None, "fault"),
        ("c", "awaiting_human", None, 3, "open"), ("d", "awaiting_human", 5, 1, "point"), ("e", "awaiting_human", None, 4, "open"),
    ]
    other = decisions.gate(spark.createDataFrame([(9, "b", True)], "task long, key string, asks boolean"), kept)
    assert rows(other, "outcome", "round", "effect") == [("awaiting_human", 2, "open")]  # a pick stands for its own task only
    after = decisions.after_gate(kept, got, F.col("round") + 100)
    assert rows(after.where("id in (1, 5) or id > 100"), "id", "key", "task", "status", "consumed") == [(1, "a", 7, "resolved", True), (103, "c", 7, "open", False), (104, "e", 7, "open", False), (5, "d", 7, "open", False)]
    assert rows(decisions.gate(visits.where("key = 'a'"), after), "outcome", "effect") == [("picked", "sticky")]


def test_answers_are_taken_once_and_wake_their_task(spark):
    kept = spark.createDataFrame([(1, "a", 1, 7, "open", None, False), (2, "b", 1, 8, "resolved", "picked", True), (3, "c", 1, None, "open", None, False)], DECISION)
    answers = spark.createDataFrame([(1, "revise"), (1, "picked"), (2, "picked"), (9, "picked"), (3, "maybe"), (3, "abandon")], "id long, verdict string")
    out, woken, refused = decisions.resolved(kept, answers)
    assert rows(out, "id", "status", "verdict") == [(1, "resolved", "picked"), (2, "resolved", "picked"), (3, "resolved", "abandon")]
    assert rows(woken, "task") == [(7,)]
    assert rows(refused, "id", "problem") == [(1, "answered already"), (2, "it is resolved"), (3, "unknown verdict"), (9, "no such decision")]


def test_walks_resume_along_outcomes(spark):
    dispatch = {("a", "ok"): "b", ("b", "ok"): "c", ("b", "again"): "a", ("c", "ok"): "done"}
    recorded = spark.createDataFrame(
        [(1, 0, "a", "ok", 1), (1, 0, "b", "again", 2), (2, 0, "a", "ok", 1), (2, 0, "b", "ok", 2), (2, 0, "c", "ok", 3), (3, 0, "a", "ok", 1), (3, 0, "b", "ok", 2), (4, 1, "a", "odd", 1), (5, 1, "b", "ok", 1), (6, 1, "a", "ok", 1), (6, 1, "a", "odd", 2)],
        "task long, attempt int, step string, outcome string, seq int",
    )
    tasks = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1), (5, 1), (6, 1), (7, 0)], "task long, attempt int")
    got = walk.resumed(recorded, tasks, dispatch, "a", resumable=("a",))
    assert rows(got, "task", "replayed", "at", "state") == [
        (1, ["a", "b"], "a", "running"), (2, ["a", "b", "c"], "c", "done"), (3, ["a"], "b", "running"),
        (4, [], "a", "failed"), (5, [], "a", "running"), (6, [], "a", "failed"), (7, [], "a", "running"),
    ]
    assert rows(walk.resumed(recorded, tasks.where("task = 2"), dispatch, "a", fresh=("b",)), "replayed", "at") == [(["a"], "b")]


def test_a_drive_goes_on_where_it_was_killed(spark, tmp_path):
    tasks = spark.createDataFrame([(i, 0, json.dumps({"event_type": "view", "props": {"k": k}})) for i, k in enumerate((0, 3, 5, 6, 7))], "task long, attempt long, payload string")
    ledger = Ledger(spark, f"file://{tmp_path}/l")
    whole = rows(walk.drive(Ledger(spark, f"file://{tmp_path}/whole"), tasks, fq.FLOW), "task", "state", "error_class", "steps", "last_step")
    assert whole == [(0, "done", None, 1, "sort"), (1, "failed", "step_budget_exhausted", 5, "look"), (2, "done", None, 2, "look"), (3, "done", None, 3, "look"), (4, "done", None, 4, "look")]
    real, calls = Ledger.commit, []

    def dying(self, name, effects_):
        calls.append(name)
        if len(calls) == 3:
            self.stage(name, effects_)
            raise KeyboardInterrupt
        return real(self, name, effects_)

    Ledger.commit = dying
    try:
        with pytest.raises(KeyboardInterrupt):
            walk.drive(ledger, tasks, fq.FLOW)
    finally:
        Ledger.commit = real
    assert len(ledger.steps()) == 2
    assert rows(walk.drive(ledger, tasks, fq.FLOW), "task", "state", "error_class", "steps", "last_step") == whole


def test_the_result_of_a_walk_is_read_without_a_shuffle(spark, tmp_path):
    tasks = spark.createDataFrame([(i, 0, json.dumps({"event_type": "view", "props": {"k": i % 8}})) for i in range(200)], "task long, attempt long, payload string")
    ledger = Ledger(spark, f"file://{tmp_path}/l")
    out = walk.drive(ledger, tasks, fq.FLOW)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 200 and out.select("task").distinct().count() == 200
    told = ledger.table("walk", walk.MOVED)
    assert told.where("target in ('done', 'failed') and (payload is not null or visits is not null)").count() == 0


def test_traces_end_in_loops_and_at_their_depth(spark):
    edges = spark.createDataFrame([(1, 10, 2), (2, 20, 3), (3, 30, 1), (3, 31, 4), (5, 50, 5)], "parent long, task long, event long")
    got = rows(trace.descendants(edges).where("ancestor = 1"), "event", "task", "depth")
    assert got == [(2, 10, 1), (3, 20, 2), (4, 31, 3)]
    assert rows(trace.descendants(edges, 1).where("ancestor = 1"), "event") == [(2,)]


SUBS = [("user.click", "session"), ("item.triaged", "notify")]


def op(task, seq, name, /, **args):
    return (task, "s", "ok", seq, name, json.dumps(args) if name else None)


EFFECTS = "task long, step string, outcome string, seq long, op string, args string"
OPS = [
    op(1, 1, "upsert_item", key="i", title="t", source="s", repo="r"),
    op(1, 2, "transition", item="i", to_state="triaged"),
    op(2, 3, "transition", item="i", to_state="merged"),
    op(3, 4, "transition", item="i", to_state="triaged"),
    op(3, 5, "emit_event", name="user.click", payload={}),
    op(4, 6, "emit_event", name="user.click", payload={"b": 1, "a": [1.5]}),
    op(5, 7, "emit_event", name="user.click", payload={"a": [1.5], "b": 1}),
    op(6, 8, "emit_event", name="undotted", payload={}),
    op(7, 9, "fanout", name="user.click", join_event="all.done", payloads=[]),
    op(8, 10, "frobnicate"),
    op(9, 11, None),
    op(10, 12, "upsert_item", key="j", title="t", source="s", repo="r"),
    op(10, 13, "transition", item="nobody", to_state="triaged"),
    op(11, 14, "transition", item="j", to_state="triaged"),
    op(12, 15, "store_embedding", repo="r", path="p", symbol=None, model_sha="m", vector=[1, 2.5]),
    op(13, 16, "store_embedding", repo="r", path="p", symbol=None, model_sha="m", vector=[3]),
]


def test_moves_of_a_hot_item_pass_as_a_stream(spark):
    edges, n = {"a": ["b"], "b": ["a", "c"], "c": ["a"]}, 3000
    moves = spark.range(n).select(F.when(F.col("id") % 10 == 0, F.lit(None).cast("string")).otherwise(F.when(F.col("id") % 7 == 0, "j").otherwise("i")).alias("item"), (n - F.col("id")).alias("seq"), F.substring(F.lit("abcax"), (F.col("id") * 31 % 5 + 1).cast("int"), F.lit(1)).alias("to_state"), F.col("id").alias("task"), F.lit("s").alias("step"))
    got = effects.moved(moves, spark.createDataFrame([("i", "a")], "item string, state string"), edges)
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
    at, want = {"i": "a"}, []
    for r in moves.orderBy("seq").collect():
        here = at.get(r["item"])
        legal = r["to_state"] in edges.get(here, ())
        want.append((*r, here, legal))
        at[r["item"]] = r["to_state"] if legal else here
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and any(w[-1] for w in want)


def test_arguments_of_effects_are_parsed_once(spark, small_dir):
    plan = effects.checked(fq.staged(spark, small_dir))._jdf.queryExecution().optimizedPlan()
    parsed = sum(len(re.findall(r"(?i)parse_?json", plan.apply(i).expressions().mkString())) for i in range(3) if plan.apply(i) is not None)
    assert parsed == 1


def tables(ledger):
    return {t: rows(ledger.table(t, schema), *[c.split()[0] for c in schema.split(", ")]) for t, schema in effects.TABLES.items()}


def test_effects_of_a_step_come_together_or_not_at_all(spark, tmp_path):
    subs = spark.createDataFrame(SUBS, "event string, kind string")
    frame, ledger = spark.createDataFrame(OPS, EFFECTS), Ledger(spark, f"file://{tmp_path}/a")
    assert effects.commit(ledger, "one", frame, subs, fq.EDGES) and not effects.commit(ledger, "one", frame, subs, fq.EDGES)
    got = tables(ledger)
    # The step that inserts j fails over another item, so the step that moves j fails with it.
    assert {r[0]: r[4] for r in got["outcomes"] if r[3]} == {
        3: "$.to_state: merged to triaged is no legal move", 6: "$.name: no event name: undotted", 8: "unknown operation frobnicate",
        10: "$.to_state: no item to triaged is no legal move", 11: "$.to_state: no item to triaged is no legal move",
    }
    assert [r[:3] for r in got["transitions"]] == [("i", "found", "triaged"), ("i", "triaged", "merged")] and [r[0] for r in got["items"]] == ["i"]
    assert sorted({(r[0], r[1]) for r in got["events"]} - {r[:2] for r in got["events"] if r[0] == "all.done"}) == [("item.merged", '{"from":"triaged","item":"i"}'), ("item.triaged", '{"from":"found","item":"i"}'), ("user.click", '{"a":[1.5],"b":1}')]
    assert len(got["events"]) == 5 and sorted(r[0] for r in got["tasks"]) == ["notify", "session"]  # equal payloads are one task
    assert rows(effects.current_vectors(ledger), "path", "symbol", "vector") == [("p", None, [3.0])]
    again = spark.createDataFrame([op(20, 1, "upsert_item", key="i", title="other", source="s", repo="r"), op(21, 2, "transition", item="i", to_state="triaged"), op(22, 3, "store_embedding", repo="r", path="p", symbol=None, model_sha="m", vector=[9])], EFFECTS)
    assert effects.commit(ledger, "two", again.withColumn("seq", F.col("seq") + 100), subs, fq.EDGES)
    assert [r[0] for r in tables(ledger)["items"]] == ["i"] and rows(effects.current_vectors(ledger), "vector") == [([9.0],)] and len(tables(ledger)["objects"]) == 1


def test_nothing_that_grows_is_sent_through_the_driver(spark, tmp_path, monkeypatch):
    """Of all that a commit writes, only subscriptions (by an event's name) are broadcast, however small the rest is."""
    plans, kept, stage = [], Ledger.kept, Ledger.stage
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(Ledger, "kept", lambda self, label, df: plans.append(plan(df)) or kept(self, label, df))
    monkeypatch.setattr(Ledger, "stage", lambda self, step, found: plans.extend(map(plan, found.values())) or stage(self, step, found))
    subs, ledger = spark.createDataFrame(SUBS, "event string, kind string"), Ledger(spark, f"file://{tmp_path}/a")
    for i, name in enumerate(("one", "two")):
        assert effects.commit(ledger, name, spark.createDataFrame(OPS, EFFECTS).withColumn("task", F.col("task") + 100 * i), subs, fq.EDGES)
    plans.append(plan(effects.current_vectors(ledger)))
    assert {k for p in plans for k in re.findall(r"(?:BroadcastHashJoin \[|BroadcastNestedLoopJoin )(\w*)", p)} == {"name"}
    assert any("SortMergeJoin" in p for p in plans)


def test_where_an_item_is_comes_ahead_of_its_moves(spark):
    edges = {"a": ["b"], "b": ["c"]}
    moves = spark.createDataFrame([("i", 2, "c", 1), ("i", 1, "b", 2), ("new", 3, "b", 3), (None, 4, "b", 4)], "item string, seq long, to_state string, task long")
    states = spark.createDataFrame([("i", "a"), ("idle", "a"), (None, "a"), ("j", None)], "item string, state string")
    got = effects.moved(moves, states, edges)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.select("task", "item", "from_state", "legal").collect())) == [(1, "i", "b", True), (2, "i", "a", True), (3, "new", None, False), (4, None, None, False)]


@pytest.mark.parametrize("writes", [0, 4])
def test_a_crash_between_writes_leaves_nothing(spark, tmp_path, writes):
    subs, frame, ledger = spark.createDataFrame(SUBS, "event string, kind string"), spark.createDataFrame(OPS[:6], EFFECTS), Ledger(spark, f"file://{tmp_path}/a")
    real = Ledger.stage

    def dying(self, step, found):
        real(self, step, dict(list(found.items())[:writes]))
        raise KeyboardInterrupt

    Ledger.stage = dying
    try:
        with pytest.raises(KeyboardInterrupt):
            effects.commit(ledger, "one", frame, subs, fq.EDGES)
    finally:
        Ledger.stage = real
    assert all(not x for x in tables(ledger).values())
    assert effects.commit(ledger, "one", frame, subs, fq.EDGES)
    assert len(tables(ledger)["outcomes"]) == 4 and len(tables(ledger)["transitions"]) == 2


def test_specs_of_contexts_are_checked():
    there = lambda p: p == "a.md"
    assert providers.notes_problem({"files": ["a.md", "{payload.x}"]}, there) is None
    assert all(providers.notes_problem({"files": f}, there) for f in ([], None, [3], ["b.md"]))
    assert providers.retrieval_problem({"model": "m", "query": "q"}, {"m": {}}) is None
    assert all(providers.retrieval_problem(s, {"m": {}}) for s in ({}, {"model": "n", "query": "q"}, {"model": "m", "query": ""}, {"model": "m", "query": "q", "k": 0}, {"model": "m", "query": "q", "k": True}))
    good = {"corpus": "c", "query": ["a"], "k": 3, "diversify": 0, "weights": {"lexical": 0}, "rerank": {"llm": "j", "window": 5}, "filter": {"a": 1}, "dedup": False}
    assert providers.select_problem(good, {"c": {}}, {"j": {}}) is None
    for bad in ({"corpus": "x"}, {"query": []}, {"query": [""]}, {"k": 0}, {"k": True}, {"diversify": 2}, {"dedup": 1}, {"weights": {"odd": 1}}, {"weights": {"lexical": -1}}, {"rerank": {"llm": "z"}}, {"rerank": {"llm": "j", "odd": 1}}, {"rerank": {"llm": "j", "window": 0}}, {"filter": []}):
        assert providers.select_problem(good | bad, {"c": {}}, {"j": {}}), bad


def test_providers_see_their_rows_in_order(spark):
    frame = spark.createDataFrame([("a", 2, "y"), ("a", 1, "xx"), ("b", 1, "z")], "conv string, turn int, text string").withColumn("role", F.concat(F.lit("r"), F.col("turn").cast("string")))
    got = rows(providers.provided(spark, "turns", frame, "conv", "turn"), "id", "name", "value")
    assert got == [("a", "turns", '{"chars":3,"roles":["r1","r2"],"turns":2}'), ("b", "turns", '{"chars":1,"roles":["r1"],"turns":1}')]
    with pytest.raises(ValueError, match="no context provider"):
        providers.provided(spark, "nobody", frame, "conv", "turn")
    with pytest.raises(ValueError, match="registered twice"):
        providers.context_provider("turns")(object)
    tasks = spark.createDataFrame([(1, '{"a":1}')], "id long, payload string")
    notes = spark.createDataFrame([("b.md", "x"), ("a.md", "y")], "name string, content string")
    parts = providers.payload_sections(tasks).unionByName(providers.pack_sections(tasks, {"p": 1})).unionByName(providers.notes_sections(tasks, notes))
    assert rows(parts, "name", "value") == [("notes", '{"a.md":"y","b.md":"x"}'), ("pack", '{"p":1}'), ("payload", '{"a":1}')]


def test_nearest_rows_are_exact(spark, monkeypatch):
    """Clusters, one vector very many times, zeros and groups; small cells, so balls are dealt to several tasks."""
    monkeypatch.setattr(neighbours, "READ", 40)
    monkeypatch.setattr(neighbours, "ASKED", 7)
    rng = random.Random(6)
    centre = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    vectors = [[x + rng.gauss(0, 0.05) for x in rng.choice(centre)] for _ in range(400)] + [centre[0]] * 200 + [[0.0] * 8] * 5
    data = [("g" if i % 3 else "h", i, v) for i, v in enumerate(vectors)] + [("alone", 9_999, centre[1])]
    frame = spark.createDataFrame(data, "grp string, id long, v array<double>")
    hits, opened = neighbours.nearest(frame, frame.where("id % 10 = 0 or id > 600"), 5)

    def cos(a, b):
        size = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b, strict=True)) / size if size else 0.0

    want = []
    for g, q, v in data:
        if q % 10 == 0 or q > 600:
            best = sorted((-round(cos(v, w), 6), i) for h, i, w in data if h == g and i != q)[:5]
            want += [(q, i, p) for p, (_, i) in enumerate(best, 1)]
    assert rows(hits, "q", "key", "place") == sorted(want, key=repr)
    shares = opened.groupBy("q").agg(F.sum("rows").alias("n")).agg(F.avg("n")).first()[0]
    assert shares < 300  # of 605 rows
    assert neighbours.nearest(frame.where("false"), frame, 5)[0].count() == 0


def test_vectors_are_kept_up(spark, tmp_path):
    store = upkeep.VectorStore(spark, f"file://{tmp_path}/v")
    model = tmp_path / "m.json"
    model.write_text(json.dumps({"dim": 2, "vocab": {"crash": [1, 0], "docs": [0, 1]}, "buckets": [[0.5, 0.5], [0.2, 0.8], [1, 1]]}))
    sha = hashlib.sha256(model.read_bytes()).hexdigest()
    by = upkeep.embedder(spark, "small", {"small": {"path": str(model), "sha256": sha}})
    frame = lambda *r: spark.createDataFrame(list(r), "key string, text string")
    first = frame(("a", "crash crash"), ("b", "docs"), ("c", None), (None, "docs"))
    assert store.maintain("k", first, by) == 3 and store.maintain("k", first, by) == 0
    assert store.maintain("other", first, by) == 3
    assert store.maintain("k", frame(("a", "docs"), ("b", "docs")), by) == 1
    got = {r["key"]: r["v"] for r in store.vectors("k", sha).collect()}
    assert got == {"a": [0.0, 1.0], "b": [0.0, 1.0], "c": [0.0, 0.0]}
    assert {r["key"]: r["v"] for r in store.vectors("other", sha).collect()}["a"] == [1.0, 0.0]
    hashing = upkeep.embedder(spark, "hashing", {})
    assert hashing.model_sha == hashlib.sha256(b"hashing:v1:dim=256").hexdigest()
    assert store.maintain("k", first, hashing) == 3 and store.vectors("k", sha).count() == 3
    for name, models in (("x", {}), ("x", {"x": {"base_url": "u", "model": "m"}})):
        with pytest.raises(ValueError):
            upkeep.embedder(spark, name, models)
    with pytest.raises(ValueError, match="pinned"):
        upkeep.embedder(spark, "small", {"small": {"path": str(model), "sha256": "0"}})


def test_buckets_of_any_count(spark):
    tokens = ["a", "crash", "ñ", "x" * 50]
    frame = spark.createDataFrame([(t,) for t in tokens], "t string")
    for n in (1, 2, 3, 1000, 65536, 2**31 - 1):
        want = {t: int(hashlib.sha256(t.encode()).hexdigest(), 16) % n for t in tokens}
        assert dict(rows(frame.select("t", ch.bucket_of(F.col("t"), n).alias("b")), "t", "b")) == want


def streamed(spark, path, frame_of, until):
    """Rows of each run of a stream over files that come one after another, with a restart from its checkpoint between them."""
    found = []
    for part in until:
        part()
        out = frame_of().writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
        out.awaitTermination()
        found.append(sorted(tuple(r) for r in spark.read.schema(frame_of().schema).parquet(f"{path}/out").collect()))
    return found


def test_barriers_fire_once_over_batches_and_restarts(spark, tmp_path):
    schema = "group_id long, task_id long, state string, expect long"
    put = lambda n, *r: lambda: spark.createDataFrame(list(r), schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    (tmp_path / "in").mkdir()
    frame = lambda: state.fire_once(spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    found = streamed(spark, tmp_path, frame, [
        put(1, (1, 1, "done", 2), (1, 2, None, 2), (2, 1, "failed", 1), (3, 1, "failed", 2)),
        put(2, (1, 2, "failed", 2), (2, 1, "done", 1), (3, 1, "done", 2)),
        put(3, (1, 2, "done", 2), (3, 2, "deferred", 2), (1, 3, "done", 2)),
    ])
    assert found == [[(2, 1, 0, 1, 0)], [(1, 2, 1, 1, 0), (2, 1, 0, 1, 0)], [(1, 2, 1, 1, 0), (2, 1, 0, 1, 0), (3, 2, 1, 0, 1)]]


def test_parked_tasks_leave_once_and_a_failed_probe_starts_the_clock_again(spark, tmp_path):
    """The watermark is the clock: tasks are due after 100 s, reports of health come as a second stream."""
    tasks, health = "error_class string, id long, every long, sec long", "error_class string, ok boolean, sec long"

    def put(n, parked, reports):
        def go():
            spark.createDataFrame(parked, tasks).coalesce(1).write.parquet(f"{tmp_path}/t/{n}")
            spark.createDataFrame(reports, health).coalesce(1).write.parquet(f"{tmp_path}/h/{n}")

        return go

    for x in "th":
        (tmp_path / x).mkdir()

    def frame():
        read = lambda schema, x: spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/{x}").withColumn("at", F.timestamp_seconds("sec")).drop("sec")
        return state.come_due(read(tasks, "t"), read(health, "h"))

    clock = lambda sec: [("clock", 0, None, sec)]
    found = streamed(spark, tmp_path, frame, [
        put(1, [("limit", 1, 100, 1_000), ("limit", 2, 100, 1_050), ("human", 3, None, 1_000), ("server", 4, 100, 1_000)], [("limit", False, 1_020)]),
        put(2, clock(1_120), []),
        put(3, clock(1_190), [("limit", True, 1_180)]),
        put(4, clock(1_300), []),
        put(5, clock(2_000), []),
    ])
    assert found[0] == [] and found[1] == [("server", 4, 1_100)] and found[2] == found[1]
    assert found[3] == found[4] == [("limit", 1, 1_200), ("limit", 2, 1_250), ("server", 4, 1_100)]


def test_windows_fire_once_over_restarts(spark, tmp_path):
    schema = "schedule string, every int, sec long"
    put = lambda n, *r: lambda: spark.createDataFrame(list(r), schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    (tmp_path / "in").mkdir()
    frame = lambda: state.fire_windows(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in").withColumn("at", F.timestamp_seconds("sec")), "10 minutes")
    found = streamed(spark, tmp_path, frame, [put(1, ("s", 300, 1000), ("s", 300, 1001), ("s", 300, 1199)), put(2, ("s", 300, 1200), ("s", 300, 1100)), put(3, ("s", 300, 1201), ("s", 300, 1500), ("s", 300, 99_999))])
    assert found == [[("s", 900, 1000)], [("s", 900, 1000), ("s", 1200, 1200)], [("s", 900, 1000), ("s", 1200, 1200), ("s", 1500, 1500), ("s", 99_900, 99_999)]]


def test_upkeep_embeds_each_row_once(spark, tmp_path):
    import pyarrow as pa

    seen = spark.sparkContext.accumulator(0)

    def embed(rows):
        def go(parts):
            for p in parts:
                seen.add(p.num_rows)
                yield pa.RecordBatch.from_arrays([p.column(0), pa.array([[1.0]] * p.num_rows, pa.list_(pa.float64()))], names=["key", "v"])

        return rows.select("key", "text").mapInArrow(go, "key string, v array<double>")

    store = upkeep.VectorStore(spark, f"{tmp_path}/kept")
    rows = [spark.createDataFrame([(f"k{i}", x) for i in range(8)], "key string, text string") for x in ("a", "b")]
    for n, r in enumerate((rows[0], rows[1], rows[1])):
        assert store.maintain("c", r, upkeep.Embedder("m", embed)) == (8, 8, 0)[n] and seen.value == (8, 16, 16)[n]
    assert store.vectors("c", "m").count() == 8


def test_a_trace_without_a_way_back_carries_no_way(spark):
    frame = lambda *r: spark.createDataFrame(list(r), "parent long, event long, task long")
    ahead = trace.descendants(frame((1, 2, 10), (1, 3, 11), (2, 4, 20), (3, 4, 30), (4, 4, 40), (4, 9, 41)))
    assert "array_append" not in ahead._jdf.queryExecution().analyzed().toString()
    assert rows(ahead.where("ancestor = 1"), "event", "task", "depth") == [(2, 10, 1), (3, 11, 1), (4, 20, 2), (4, 30, 2), (9, 41, 3), (9, 41, 3)]
    back = trace.descendants(frame((1, 2, 10), (2, 3, 20), (3, 1, 30)))
    assert rows(back.where("ancestor = 1"), "event", "depth") == [(2, 1), (3, 2)]
