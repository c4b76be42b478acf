"""Queries of walks, decisions, staged effects, traces, context and kept vectors over the given tables, and their SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import json_values as jv
from ..operators import blocks, decisions, effects, neighbours, providers, select, trace, upkeep, walk
from ..operators import channels as ch
from ..operators import queue as qu
from ..operators import steps as st
from ..sources.ledger import Ledger, shared_folder
from .definitions import workflow
from .ledger_views import PAYLOAD_SQL, SUBS_SQL, events, subscriptions
from .retrieval import asked, corpus, t
from .step_queries import FULL, triage

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


#: A schema with each kind of rule, and the kinds of damage that every eighth payload has.
SCHEMA = {
    "type": "object",
    "required": ["event_type", "props", "user_id"],
    "properties": {
        "event_type": {"enum": ["click", "purchase", "signup", "view"]},
        "props": {"type": "object", "required": ["k"], "properties": {"k": {"type": ["integer", "null"]}}},
        "user_id": {"type": "integer"},
    },
    "additionalProperties": False,
}


@query("""WITH p AS (SELECT event_id, event_id % 8 AS m, event_type FROM events),
a AS (SELECT event_id, m, [CASE WHEN event_type = 'error' THEN '$.event_type: "error" is not allowed' END, CASE WHEN m = 4 THEN '$.props: expected object, got array' END,
 CASE WHEN m = 2 THEN '$.props.k: expected integer or null, got number' END, CASE WHEN m = 6 THEN '$.props: k is missing' END, CASE WHEN m = 1 THEN '$.user_id: expected integer, got string' END, CASE WHEN m = 0 THEN '$: user is unexpected' END] AS found FROM p)
SELECT event_id, CASE WHEN m = 3 THEN '$: not JSON' ELSE array_to_string(list_concat(CASE WHEN m = 0 THEN ['$: user_id is missing'] ELSE [] END, list_filter(found, lambda x: x IS NOT NULL)), ';') END AS problems FROM a""")
def schema_problems(spark, d):
    """Payloads with a name amiss, a number in quotes, a fraction, a cut end, a list for an object, a null and a lost field."""
    m = F.col("event_id") % 8
    swap = lambda a, b: F.regexp_replace("payload", a, b)
    damaged = (
        F.when(m == 0, swap('"user_id"', '"user"'))
        .when(m == 1, swap(r'"user_id":(\d+)', '"user_id":"$1"'))
        .when(m == 2, swap(r'"props":\{[^}]*\}', '"props":{"k":1.5}'))
        .when(m == 3, F.expr("substring(payload, 1, length(payload) - 1)"))
        .when(m == 4, swap(r'"props":\{[^}]*\}', '"props":[1]'))
        .when(m == 5, swap(r'"props":\{[^}]*\}', '"props":{"k":null}'))
        .when(m == 6, swap(r'"props":\{[^}]*\}', '"props":{}'))
        .otherwise(F.col("payload"))
    )
    return events(spark, d).select("event_id", F.array_join(jv.problems(damaged, SCHEMA), ";").alias("problems"))


@query("""WITH e AS (SELECT event_id, user_id, event_type, json_extract_string(props, '$.k') AS k FROM events),
c AS (SELECT event_id, '{"Z":[{"a":null,"b":' || event_id || '},"é' || event_type || '"],"é":{"x":"q\\"' || user_id || '","y":' || CASE WHEN event_id % 3 = 0 THEN k || '.5' ELSE k END || '}}' AS canonical FROM e)
SELECT event_id, canonical, sha256(canonical) AS sha FROM c""")
def canonical_nested(spark, d):
    """Nested values with keys in disorder, blanks, escapes and (every third) a fraction."""
    k = F.get_json_object("props", "$.k")
    y = F.when(F.col("event_id") % 3 == 0, F.concat(k, F.lit(".5"))).otherwise(k)
    text = F.concat(F.lit('{ "é" : {"y": '), y, F.lit(', "x":"q\\"'), F.col("user_id").cast("string"), F.lit('"},\n "Z" : [ {"b": '), F.col("event_id").cast("string"), F.lit(', "a":null}, "\\u00e9'), F.substring("name", 6, 99), F.lit('" ] }'))
    return events(spark, d).select("event_id", jv.canonical(text).alias("canonical")).withColumn("sha", F.sha2("canonical", 256))


PATTERN = {"title": "{payload.event_type} of {payload.user_id} in {pack.name} ({prev.ok}, {prev.none})", "k": "{payload.props.k}", "all": "{payload.props}", "deep": ["{pack.limits.most}", "{later.on}", {"flag": "{prev.ok}"}]}


@query("""SELECT event_id, '{"all":{"k":' || k || '},"deep":[7,"{later.on}",{"flag":' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || '}],"k":' || k || ',"title":"' || event_type || ' of ' || user_id || ' in demo ('
 || CASE WHEN event_id % 2 = 0 THEN 'True' ELSE 'False' END || ', None)"}' AS value FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)""")
def template_values(spark, d):
    """Payload, pack and previous result in a nested template: whole placeholders keep numbers, objects and flags."""
    roots = {"payload": F.try_parse_json("payload"), "pack": F.parse_json(F.lit('{"name":"demo","limits":{"most":7}}')), "prev": F.try_parse_json(F.concat(F.lit('{"none":null,"ok":'), (F.col("event_id") % 2 == 0).cast("string"), F.lit("}")))}
    return events(spark, d).select("event_id", F.to_json(jv.filled(PATTERN, roots, partial=True)).alias("value"))


OUTPUT = {"type": "object", "required": ["ok"], "properties": {"ok": {"type": "boolean"}}}


@query(f"""WITH s AS (SELECT conv_id AS id, role || '.' || lpad(CAST(turn AS VARCHAR), 4, '0') AS name, '{{"text":' || to_json(text) || ',"turn":' || turn || '}}' AS body FROM conversations)
SELECT id, sha256('Review ' || id || chr(10) || chr(10) || string_agg('## context: ' || name || chr(10) || body || chr(10) || chr(10), '' ORDER BY name, body)
 || '## output contract' || chr(10) || '{jv.CONTRACT}' || chr(10) || '{jv.dumped(OUTPUT)}' || chr(10)) AS prompt_sha FROM s GROUP BY id""")
def prompt_shas(spark, d):
    """A conversation's turns as context sections between a base text and the output contract."""
    rows = t(spark, d, "conversations")
    name = F.concat("role", F.lit("."), F.lpad(F.col("turn").cast("string"), 4, "0"))
    value = F.to_json(F.struct("turn", "text"))
    sections = rows.select(F.col("conv_id").alias("id"), F.concat(F.lit("Review "), F.col("conv_id").cast("string"), F.lit(" \n")).alias("base"), name.alias("name"), value.alias("value"))
    return st.prompt(sections, OUTPUT).select("id", F.sha2("prompt", 256).alias("prompt_sha"))


@query("""WITH x AS (SELECT conv_id, turn, turn % 5 AS m, '{"ok": ' || CASE WHEN turn % 3 = 0 THEN 'true' ELSE '"yes"' END || '}' AS j FROM conversations)
SELECT conv_id, turn, CASE m WHEN 3 THEN role_text WHEN 4 THEN NULL ELSE j END AS verdict, CASE WHEN m = 3 THEN '$: not JSON' WHEN m = 4 THEN '$: not JSON' WHEN turn % 3 = 0 THEN '' ELSE '$.ok: expected boolean, got string' END AS problem
FROM (SELECT x.*, 'no answer' AS role_text FROM x)""")
def verdict_extract(spark, d):
    """Answers with a json fence after another, with a bare fence, without one, with none that is JSON, and empty ones."""
    turn, ok = F.col("turn"), F.when(F.col("turn") % 3 == 0, F.lit('{"ok": true}')).otherwise(F.lit('{"ok": "yes"}'))
    m = turn % 5
    text = (
        F.when(m == 0, F.concat(F.lit('first\n```json\n{"ok": 1}\n```\nthen\n```json\n'), ok, F.lit("\n```\n")))
        .when(m == 1, F.concat(F.lit(" ```\n"), ok, F.lit("\n``` \n")))
        .when(m == 2, F.concat(F.lit("\n"), ok, F.lit(" ")))
        .when(m == 3, F.lit("no answer\n"))
        .otherwise(F.lit(" \n"))
    )
    body = jv.verdict_text(text)
    return t(spark, d, "conversations").select("conv_id", "turn", body.alias("verdict"), F.array_join(jv.problems(body, OUTPUT), ";").alias("problem"))


FAN_SQL = """p AS (SELECT event_id AS task, 'user.' || event_type AS name, list_transform(range(CAST(json_extract_string(props, '$.k') AS BIGINT) % 4), lambda i: '{"n":' || i || '}') AS payloads FROM events),
g AS (SELECT *, sha256('{"join_event":"all.done","name":"' || name || '","payloads":[' || coalesce(array_to_string(payloads, ','), '') || '],"task":' || task || '}') AS group_id FROM p),
c AS (SELECT event AS name, count(*) AS n FROM subs GROUP BY event)"""


def fan_ops(spark, d):
    n = F.get_json_object("props", "$.k").cast("bigint") % 4
    each = F.transform(F.sequence(F.lit(1).cast("bigint"), n), lambda i: F.concat(F.lit('{"n":'), (i - 1).cast("string"), F.lit("}")))
    payloads = F.when(n > 0, each).otherwise(F.array().cast("array<string>"))
    return events(spark, d).select(F.col("event_id").alias("task"), "name", F.lit("all.done").alias("join_event"), payloads.alias("payloads"))


@query(f"""WITH {SUBS_SQL}, {FAN_SQL}, m AS (SELECT group_id, name, unnest(range(len(payloads))) AS idx FROM g),
x AS (SELECT group_id, kind, idx, '{{"_join":{{"group":"' || group_id || '","index":' || idx || '}},"n":' || idx || '}}' AS payload FROM m JOIN subs ON subs.event = m.name)
SELECT group_id, kind, idx, payload, sha256(payload) AS payload_hash FROM x""")
def fanout_join(spark, d):
    """Children of the events' fan-outs; each is staged twice, as by a replay."""
    ops = fan_ops(spark, d)
    return st.fanned_out(ops.unionByName(ops), subscriptions(spark))[1].select("group_id", "kind", "idx", "payload", "payload_hash")


@query(f"""WITH {SUBS_SQL}, {FAN_SQL} SELECT group_id, task, len(payloads) * coalesce(n, 0) AS expect, len(payloads) * coalesce(n, 0) = 0 AS complete FROM g LEFT JOIN c USING (name)""")
def fanout_groups(spark, d):
    """Their groups; one without items or consumers is complete at once."""
    return st.fanned_out(fan_ops(spark, d), subscriptions(spark))[0].select("group_id", "task", "expect", "complete")


VERDICT_SQL = "['picked', 'revise', 'reframe', 'abandon'][length(text) % 4 + 1]"
DECISIONS_SQL = f"""r AS (SELECT conv_id AS key, turn, row_number() OVER w AS round, lead(turn) OVER w AS next, length(text) AS n, {VERDICT_SQL} AS verdict FROM conversations WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
d AS (SELECT key * 1000 + turn AS id, key, round, key * 10 + turn % 2 AS task, CASE WHEN n % 3 < 2 THEN 'resolved' WHEN next IS NULL THEN 'open' ELSE 'superseded' END AS status,
 CASE WHEN n % 3 < 2 THEN verdict END AS verdict, n % 3 = 0 AS consumed FROM r)"""


def asked_rounds(spark, d):
    """User turns as rounds of their conversation: by their length answered, answered and consumed, or still open (superseded if another followed)."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    n = F.length("text")
    rows = t(spark, d, "conversations").where("role = 'user'").withColumn("round", F.row_number().over(w)).withColumn("next", F.lead("turn").over(w))
    verdict = F.element_at(F.array(*map(F.lit, decisions.VERDICTS)), n % 4 + 1)
    return rows.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.col("conv_id").alias("key"),
        F.col("round").cast("bigint").alias("round"),
        (F.col("conv_id") * 10 + F.col("turn") % 2).alias("task"),
        F.when(n % 3 < 2, "resolved").when(F.col("next").isNull(), "open").otherwise("superseded").alias("status"),
        F.when(n % 3 < 2, verdict).alias("verdict"),
        (n % 3 == 0).alias("consumed"),
    )


@query(f"""WITH {DECISIONS_SQL}, v AS (SELECT DISTINCT conv_id AS key, conv_id * 10 + 1 AS task, conv_id % 3 <> 0 AS asks FROM conversations),
now AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY round DESC) AS n FROM d WHERE status IN ('open', 'resolved') AND NOT consumed) WHERE n = 1),
las AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY round DESC) AS n FROM d WHERE status = 'resolved') WHERE n = 1),
m AS (SELECT key, max(round) AS rounds FROM d GROUP BY key),
j AS (SELECT v.*, now.id AS nid, now.round AS nround, now.status AS nstatus, now.verdict AS nverdict, las.id AS lid, las.round AS lround, coalesce(las.verdict = 'picked' AND las.task = v.task, false) AS sticky, coalesce(rounds, 0) AS rounds
 FROM v LEFT JOIN now USING (key) LEFT JOIN las USING (key) LEFT JOIN m USING (key))
SELECT task, key, CASE WHEN nstatus = 'resolved' THEN nverdict WHEN nid IS NOT NULL THEN 'awaiting_human' WHEN sticky THEN 'picked' WHEN asks THEN 'awaiting_human' ELSE 'framework_bug' END AS outcome,
 CASE WHEN nid IS NOT NULL THEN nid WHEN sticky THEN lid END AS decision, CASE WHEN nid IS NOT NULL THEN nround WHEN sticky THEN lround WHEN asks THEN rounds + 1 END AS round,
 CASE WHEN nstatus = 'resolved' THEN 'consume' WHEN nid IS NOT NULL THEN 'point' WHEN sticky THEN 'sticky' WHEN asks THEN 'open' ELSE 'fault' END AS effect FROM j""")
def decision_picks(spark, d):
    """A task of every conversation comes to its gate; every third brings no question."""
    visits = t(spark, d, "conversations").select(F.col("conv_id").alias("key")).distinct()
    visits = visits.select((F.col("key") * 10 + 1).alias("task"), "key", (F.col("key") % 3 != 0).alias("asks"))
    return decisions.gate(visits, asked_rounds(spark, d))


@query(f"""WITH {DECISIONS_SQL}, a AS (SELECT conv_id * 1000 + turn - 1 AS id, CASE WHEN turn % 7 = 0 THEN 'maybe' ELSE {VERDICT_SQL} END AS verdict FROM conversations WHERE role = 'assistant'),
x AS (SELECT a.id, a.verdict, d.id AS known, d.status, d.task FROM a LEFT JOIN d USING (id))
SELECT id, verdict, CASE WHEN verdict = 'maybe' THEN 'unknown verdict' WHEN known IS NULL THEN 'no such decision' WHEN status <> 'open' THEN 'it is ' || status ELSE 'taken' END AS result,
 CASE WHEN verdict <> 'maybe' AND status = 'open' THEN task END AS woken FROM x""")
def decision_answers(spark, d):
    """Assistant turns as answers to the turn before them: taken if that round is open; each wakes its task."""
    v = F.element_at(F.array(*map(F.lit, decisions.VERDICTS)), F.length("text") % 4 + 1)
    answers = t(spark, d, "conversations").where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn") - 1).alias("id"), F.when(F.col("turn") % 7 == 0, "maybe").otherwise(v).alias("verdict"))
    out, woken, refused = decisions.resolved(asked_rounds(spark, d), answers)
    took = out.where("status = 'resolved'").join(answers.withColumnRenamed("verdict", "given"), "id").join(refused.select("id"), "id", "left_anti")
    return refused.select("id", "verdict", F.col("problem").alias("result"), F.lit(None).cast("bigint").alias("woken")).unionByName(
        took.join(woken.distinct(), "task").select("id", F.col("given").alias("verdict"), F.lit("taken").alias("result"), F.col("task").alias("woken"))
    )


#: A workflow's edges; an outcome of `file` leads nowhere, as after a change of its definition.
DISPATCH = {
    ("scan", "ok"): "check", ("scan", "again"): "scan", ("scan", "bad"): "failed",
    ("check", "ok"): "file", ("check", "again"): "scan", ("check", "bad"): "deferred",
    ("file", "ok"): "notify", ("file", "again"): "check",
    ("notify", "ok"): "done", ("notify", "again"): "file", ("notify", "bad"): "parked",
}
STEP_SQL = "['scan', 'check', 'file', 'notify'][l_linenumber % 4 + 1]"


@query(f"""WITH RECURSIVE rec AS (SELECT l_orderkey AS task, l_suppkey % 2 AS attempt, {STEP_SQL} AS step, CASE l_returnflag WHEN 'A' THEN 'ok' WHEN 'N' THEN 'again' ELSE 'bad' END AS outcome, l_linenumber AS seq FROM lineitem),
u AS (SELECT task, step, max({{'a': attempt, 's': seq, 'o': outcome}}).o AS outcome FROM rec WHERE step <> 'notify' AND (attempt = 1 OR step IN ('scan', 'check')) GROUP BY ALL),
d(step, outcome, target) AS (VALUES {', '.join(str((*k, v)) for k, v in DISPATCH.items())}),
walk(task, n, here, state, replayed, moves) AS (
 SELECT DISTINCT task, 0, 'scan', 'running', CAST([] AS VARCHAR[]), true FROM rec
 UNION ALL
 SELECT w.task, n + 1, CASE WHEN target IS NULL OR target IN ('done', 'failed', 'deferred', 'parked') THEN w.here ELSE target END, CASE WHEN target IS NULL THEN 'failed' WHEN target IN ('done', 'failed', 'deferred', 'parked') THEN target ELSE 'running' END,
  CASE WHEN target IS NULL THEN replayed ELSE list_append(replayed, w.here) END, target IS NOT NULL AND target NOT IN ('done', 'failed', 'deferred', 'parked')
 FROM walk w JOIN u ON u.task = w.task AND u.step = w.here LEFT JOIN d ON d.step = w.here AND d.outcome = u.outcome WHERE w.moves AND NOT list_contains(replayed, w.here)),
z AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY n DESC) AS last FROM walk)
SELECT task, array_to_string(replayed, ',') AS replayed, here AS "at", state FROM z WHERE last = 1""")
def resume_walk(spark, d):
    """Line items as recorded steps of two attempts; the second goes on along its own outcomes and those of steps that can be resumed."""
    flag, step = F.col("l_returnflag"), F.element_at(F.array(*map(F.lit, ("scan", "check", "file", "notify"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    recorded = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("task"), (F.col("l_suppkey") % 2).alias("attempt"), step.alias("step"), F.when(flag == "A", "ok").when(flag == "N", "again").otherwise("bad").alias("outcome"), F.col("l_linenumber").alias("seq"))
    tasks = recorded.select("task").distinct().withColumn("attempt", F.lit(1))
    out = walk.resumed(recorded, tasks, DISPATCH, "scan", fresh=("notify",), resumable=("scan", "check"))
    return out.withColumn("replayed", F.array_join("replayed", ","))


@blocks.block("demo.look", ("found", "again"))
def look(payload: dict, params: dict) -> tuple[str, dict]:
    """A demonstration block that looks as often as its number says."""
    before = params["prev"]
    n = before.get("n", 0)
    return ("found" if n >= before["k"] % 5 else "again"), {"k": before["k"], "n": n + 1}


#: Names under which the demonstration blocks are registered.
BLOCKS = {b.run: name for name, b in blocks.REGISTRY.items()}
FLOW = workflow({
    "kind": "triage",
    "steps": {
        "sort": {"block": BLOCKS[triage], "outcomes": ["high", "low", "skip"], "on": {"high": "look", "low": "done", "skip": "deferred"}, "params": {"least": 3}},
        "look": {"block": BLOCKS[look], "outcomes": ["found", "again"], "on": {"found": "done", "again": "look"}, "max_visits": 3},
    },
})


@query("""SELECT event_id AS task, CASE WHEN bad THEN 'failed' WHEN event_type = 'click' THEN 'deferred' WHEN k >= 3 AND k % 5 > 2 THEN 'failed' ELSE 'done' END AS state,
 CASE WHEN bad THEN 'framework_bug' WHEN event_type <> 'click' AND k >= 3 AND k % 5 > 2 THEN 'step_budget_exhausted' END AS error_class,
 CASE WHEN bad OR event_type = 'click' OR k < 3 THEN 1 WHEN k % 5 > 2 THEN 5 ELSE 2 + k % 5 END AS steps, CASE WHEN bad OR event_type = 'click' OR k < 3 THEN 'sort' ELSE 'look' END AS last_step
FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k, event_type = 'error' AND json_extract_string(props, '$.k')::BIGINT % 9 = 0 AS bad FROM events)""")
def walk_to_end(spark, d):
    """Every event as a task of a workflow with a loop and a budget, driven until none moves."""
    tasks = events(spark, d).select(F.col("event_id").alias("task"), F.lit(0).cast("bigint").alias("attempt"), "payload")
    return walk.drive(Ledger(spark, shared_folder(spark, "walk")), tasks, FLOW)


@query("""WITH RECURSIVE e AS (SELECT event_id // 4 AS parent, event_id AS event, (event_id // 4) * 10 + event_id % 4 AS task FROM events WHERE event_id // 4 <> event_id),
w(ancestor, event, task, depth) AS (SELECT parent, event, task, 1 FROM e UNION ALL SELECT w.ancestor, e.event, e.task, w.depth + 1 FROM w JOIN e ON e.parent = w.event WHERE w.depth < 32) SELECT * FROM w""")
def trace_tree(spark, d):
    """All descendants of every event with their depth; an event's tasks emit up to four others."""
    e = t(spark, d, "events").select(F.floor(F.col("event_id") / 4).alias("parent"), F.col("event_id").alias("event"))
    return trace.descendants(e.select("parent", "event", (F.col("parent") * 10 + F.col("event") % 4).alias("task")))


@query(f"""WITH {SUBS_SQL}, em AS (SELECT user_id AS task, event_id AS event, 'user.' || event_type AS name FROM events)
SELECT o_orderkey AS task, 0 AS place, 'task' AS what, CAST(o_orderkey AS VARCHAR) AS ref, o_orderpriority || ' ' || o_orderstatus AS detail FROM orders
UNION ALL SELECT event_id, 1, 'origin', CAST(event_id AS VARCHAR), 'user.' || event_type FROM events JOIN orders ON o_orderkey = event_id
UNION ALL SELECT l_orderkey, 2, 'step', CAST(l_linenumber AS VARCHAR), (l_suppkey % 2) || ' ' || l_linestatus || ' ' || l_returnflag FROM lineitem
UNION ALL SELECT l_orderkey, 3, 'run', CAST(l_orderkey * 10 + l_linenumber AS VARCHAR), 'm' || (l_suppkey % 3) || ' ' || l_linestatus FROM lineitem WHERE l_returnflag = 'R'
UNION ALL SELECT task, 4, 'emitted', CAST(event AS VARCHAR), name FROM em
UNION ALL SELECT em.task, 5, 'opened', CAST(em.event + 1000000 AS VARCHAR), kind || ' pending' FROM em JOIN subs ON subs.event = em.name""")
def trace_story(spark, d):
    """Orders as tasks: their state, origin, steps, runs, emissions, and the tasks these opened."""
    o, lines, ev = t(spark, d, "orders"), t(spark, d, "lineitem"), events(spark, d)
    tasks = o.select(F.col("o_orderkey").alias("task"), F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("state"))
    origins = ev.select(F.col("event_id").alias("task"), F.col("event_id").alias("event"), "name").join(tasks.select("task"), "task")
    steps = lines.select(F.col("l_orderkey").alias("task"), (F.col("l_suppkey") % 2).alias("attempt"), F.col("l_linestatus").alias("step"), F.col("l_returnflag").alias("outcome"), F.col("l_linenumber").alias("seq"))
    runs = lines.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("task"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("run"), F.concat(F.lit("m"), (F.col("l_suppkey") % 3).cast("string")).alias("model"), F.col("l_linestatus").alias("verdict"))
    emitted = ev.select(F.col("user_id").alias("task"), F.col("event_id").alias("event"), "name")
    children = qu.fan_out(ev.select("event_id", "name"), subscriptions(spark)).select(F.col("event_id").alias("event"), (F.col("event_id") + 1_000_000).alias("task"), "kind", F.lit("pending").alias("state"))
    return trace.task_story(tasks, steps, runs, origins, emitted, children)


EDGES = {"found": ["triaged", "rejected"], "triaged": ["merged"]}


def staged(spark, d):
    """Events as steps that stage effects: an item and an event, an event, a move, a vector, or a fan-out; some are malformed."""
    k = F.get_json_object("props", "$.k")
    i, item = F.col("event_id").cast("string"), F.concat(F.lit("i"), (F.col("event_id") % 97).cast("string"))
    m = F.col("event_id") % 5
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    op = lambda name, args: F.struct(F.lit(name).alias("op"), args.alias("args"))
    emit = op("emit_event", text('{"payload":{"k":', k, '},"name":"', F.col("name"), '"}'))
    upsert = op("upsert_item", text('{"key":"', item, '","title":"t', i, '","source":"s","repo":"r"}'))
    move = op("transition", F.when(F.col("event_id") % 50 == 7, text('{"item":"', item, '"}')).otherwise(text('{"item":"', item, '","to_state":"triaged"}')))
    vector = op("store_embedding", text('{"repo":"r","path":"', F.col("name"), '","symbol":', F.when(F.col("event_id") % 2 == 0, F.lit("null")).otherwise(F.lit('"f"')), ',"model_sha":"m","vector":[', k, ",1.5]}"))
    items = F.when(k.cast("int") % 3 == 0, F.lit("")).when(k.cast("int") % 3 == 1, F.lit('{"n":0}')).otherwise(F.lit('{"n":0},{"n":1}'))
    fan = op("fanout", text('{"name":"user.click","join_event":"all.done","payloads":[', items, "]}"))
    ops = F.when(m == 0, F.array(upsert, emit)).when(m == 1, F.array(emit)).when(m == 2, F.array(move)).when(m == 3, F.array(vector)).otherwise(F.array(fan))
    rows = events(spark, d).select("event_id", F.posexplode(ops).alias("place", "o"))
    return rows.select(F.col("event_id").alias("task"), F.lit("s").alias("step"), F.lit("ok").alias("outcome"), (F.col("event_id") * 10 + F.col("place")).alias("seq"), "o.op", "o.args")


@query(f"""WITH {SUBS_SQL}, e AS (SELECT event_id, event_id % 5 AS m, event_id % 2 AS c, 'user.' || event_type AS name, json_extract_string(props, '$.k') AS k, 'i' || (event_id % 97) AS item FROM events),
it AS (SELECT item, min({{'c': c, 'i': event_id}}) AS f FROM e WHERE m = 0 GROUP BY item),
mv AS (SELECT e.item, e.event_id, e.c, row_number() OVER (PARTITION BY e.item ORDER BY e.c, e.event_id) AS n FROM e JOIN it ON it.item = e.item AND it.f.c <= e.c WHERE m = 2 AND event_id % 50 <> 7),
bad AS (SELECT event_id, CASE WHEN event_id % 50 = 7 THEN '$: to_state is missing' ELSE '$.to_state: ' || CASE WHEN mv.n IS NULL THEN 'no item' ELSE 'triaged' END || ' to triaged is no legal move' END AS problem
 FROM e LEFT JOIN mv USING (event_id) WHERE m = 2 AND (event_id % 50 = 7 OR mv.n IS NULL OR mv.n > 1)),
fn AS (SELECT event_id, list_transform(range(CAST(k AS BIGINT) % 3), lambda i: '{{"n":' || i || '}}') AS p FROM e WHERE m = 4),
gr AS (SELECT event_id, p, sha256('{{"join_event":"all.done","name":"user.click","payloads":[' || coalesce(array_to_string(p, ','), '') || '],"task":' || event_id || '}}') AS g FROM fn),
ev AS (SELECT name, '{{"k":' || k || '}}' AS payload, event_id AS task FROM e WHERE m IN (0, 1)
 UNION ALL SELECT 'item.triaged', '{{"from":"found","item":"' || item || '"}}', event_id FROM mv WHERE n = 1
 UNION ALL SELECT 'user.click', '{{"_join":{{"group":"' || g || '","index":' || i || '}},"n":' || i || '}}', event_id FROM (SELECT g, event_id, unnest(range(len(p))) AS i FROM gr)
 UNION ALL SELECT 'all.done', '{{"join_group":"' || g || '","total":0}}', event_id FROM gr WHERE len(p) = 0),
ve AS (SELECT name AS path, c, arg_max(k, event_id) AS k, CASE WHEN event_id % 2 = 0 THEN '-' ELSE 'f' END AS symbol FROM e WHERE m = 3 GROUP BY ALL)
SELECT 'outcome' AS what, CAST(event_id AS VARCHAR) AS key, CASE WHEN problem IS NULL THEN 'ok' ELSE 'failed framework_bug ' || problem END AS detail FROM e LEFT JOIN bad USING (event_id)
UNION ALL SELECT 'item', item, 't' || f.i || ' found' FROM it
UNION ALL SELECT 'transition', item, 'found triaged ' || event_id FROM mv WHERE n = 1
UNION ALL SELECT 'event', name, payload || ' ' || task FROM ev
UNION ALL SELECT DISTINCT 'task', kind, sha256(name || chr(10) || payload) FROM ev JOIN subs ON subs.event = ev.name
UNION ALL SELECT 'group', g, event_id || ' ' || len(p) * 2 FROM gr
UNION ALL SELECT 'vector', path || ' ' || symbol, k FROM (SELECT path, symbol, arg_max(k, c) AS k FROM ve GROUP BY ALL)""")
def staged_effects(spark, d):
    """Two commits, the first of them asked for twice: every table as it stands after."""
    ops, ledger = staged(spark, d), Ledger(spark, shared_folder(spark, "effects"))
    for name, rest in (("a", 0), ("b", 1), ("a", 0)):
        effects.commit(ledger, name, ops.where(F.col("task") % 2 == rest), subscriptions(spark), EDGES)
    tab = lambda x: ledger.table(x, effects.TABLES[x])
    say = lambda what, df, key, *detail: df.select(F.lit(what).alias("what"), F.col(key).cast("string").alias("key"), F.concat_ws(" ", *[F.col(c).cast("string") if isinstance(c, str) else c for c in detail]).alias("detail"))
    vectors = effects.current_vectors(ledger).withColumn("place", F.concat_ws(" ", "path", F.coalesce("symbol", F.lit("-"))))
    parts = [
        say("outcome", tab("outcomes"), "task", "outcome", "error_class", "problem"),
        say("item", tab("items"), "key", "title", "state"),
        say("transition", tab("transitions"), "item", "from_state", "to_state", "task"),
        say("event", tab("events"), "name", "payload", "task"),
        say("task", tab("tasks"), "kind", "payload_hash"),
        say("group", tab("groups"), "group_id", "task", "expect"),
        say("vector", vectors, "place", F.col("vector")[0].cast("bigint").cast("string")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""WITH r AS (SELECT conv_id AS id, turn, role, text FROM conversations), s AS (SELECT id, count(*) AS turns, max(turn) AS last FROM r GROUP BY id)
SELECT id, 'turns' AS name, '{"chars":' || sum(length(coalesce(text, ''))) || ',"roles":[' || string_agg(DISTINCT '"' || role || '"', ',' ORDER BY '"' || role || '"') || '],"turns":' || count(*) || '}' AS value FROM r GROUP BY id""")
def provided_sections(spark, d):
    """A user's provider over all conversations: a table function that sees each one's turns in order."""
    rows = t(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    return providers.provided(spark, "turns", rows, "conv_id", "turn")


@providers.context_provider("turns")
class Turns:
    """A demonstration provider: how many turns, characters and which roles."""

    def __init__(self):
        self.turns, self.chars, self.roles = 0, 0, set()

    def eval(self, row):
        self.turns += 1
        self.chars += len(row["text"])
        self.roles.add(row["role"])

    def terminate(self):
        yield {"turns": self.turns, "chars": self.chars, "roles": sorted(self.roles)}


@query("""WITH w AS (SELECT DISTINCT lower(p_brand) AS token FROM part), x AS (SELECT token, unnest([2, 3, 256, 1000]) AS n FROM (SELECT unnest(regexp_extract_all(token, '[a-z0-9_]+')) AS token FROM w)),
h AS (SELECT DISTINCT token, n, list_transform(range(1, 65), lambda i: strpos('0123456789abcdef', substr(sha256(token), i, 1)) - 1) AS hex FROM x)
SELECT token, n, CAST(list_reduce(list_prepend(0, hex), lambda a, b: (a * 16 + b) % n) AS BIGINT) AS bucket FROM h""")
def token_buckets(spark, d):
    """Buckets of tokens for several numbers of buckets."""
    tokens = t(spark, d, "part").select(F.explode(F.regexp_extract_all(F.lower("p_brand"), F.lit("[a-z0-9_]+"), F.lit(0))).alias("token")).distinct()
    counts = (2, 3, 256, 1000)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), ch.bucket_of(F.col("token"), n).alias("bucket")) for n in counts])).alias("x")
    return tokens.select("token", each).select("token", "x.n", "x.bucket")


@query("""WITH now AS (SELECT CAST(doc_id AS VARCHAR) AS key, coalesce(text, '') || CASE WHEN doc_id % 7 = 0 THEN ' edited' ELSE '' END AS text FROM documents)
SELECT key, sha256(text) AS text_sha, CASE WHEN len(regexp_extract_all(lower(text), '[a-z0-9]{2}')) > 0 THEN 1 ELSE 0 END AS some,
 (SELECT count(*) FROM documents) AS first, (SELECT count(*) FROM documents WHERE doc_id % 7 = 0) AS second, 0 AS third FROM now""")
def vector_upkeep(spark, d):
    """All documents are embedded; a seventh are edited, and only these again; a third call embeds nothing."""
    docs = corpus(spark, d).select("key", "text")
    edited = docs.select("key", F.concat(F.coalesce("text", F.lit("")), F.when(F.col("key").cast("bigint") % 7 == 0, " edited").otherwise("")).alias("text"))
    by, store = upkeep.embedder(spark, "hashing", {}), upkeep.VectorStore(spark, f"{shared_folder(spark, 'vectors')}/kept")
    counts = [store.maintain("docs", rows, by) for rows in (docs, edited, edited)]
    told = [F.lit(n).cast("bigint").alias(c) for n, c in zip(counts[:2], ("first", "second"), strict=True)]
    some = F.when(F.aggregate("v", F.lit(0.0), lambda a, x: a + F.abs(x)) > 0, 1).otherwise(0)
    return store.vectors("docs", by.model_sha).select("key", "text_sha", some.alias("some"), *told, F.lit(counts[2]).alias("third"))


OBJECTS = "CASE WHEN vec_id % 3 = 0 THEN NULL ELSE 'f' || vec_id % 11 END"


@query(f"""WITH e AS (SELECT vec_id AS id, 'm' || (label % 2) AS grp, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
p AS (SELECT a.id AS q, b.id AS key, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a JOIN e b ON a.grp = b.grp AND a.id <> b.id WHERE a.id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, key) AS place FROM p),
s AS (SELECT doc_id % 300 AS key, arg_max(lang || doc_id, doc_id) AS summary FROM documents GROUP BY 1)
SELECT q, r.key, score, place, 'repo' || vec_id % 5 AS repo, 'src/' || vec_id AS path, {OBJECTS} AS symbol, summary FROM r JOIN embeddings ON vec_id = r.key LEFT JOIN s ON s.key = r.key WHERE place <= 5""")
def retrieval_top5(spark, d):
    """The five code objects of the same model most like each query vector, with their last reading."""
    e = t(spark, d, "embeddings").select(F.concat(F.lit("m"), (F.col("label") % 2).cast("string")).alias("grp"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    hits, _ = neighbours.nearest(e, e.where("id % 50 = 0"), 5)
    objects = e.select("id", F.concat(F.lit("repo"), (F.col("id") % 5).cast("string")).alias("repo"), F.concat(F.lit("src/"), F.col("id").cast("string")).alias("path"), F.when(F.col("id") % 3 != 0, F.concat(F.lit("f"), (F.col("id") % 11).cast("string"))).alias("symbol"))
    readings = t(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 300).alias("object"), F.concat("lang", F.col("doc_id").cast("string")).alias("summary"))
    return neighbours.with_readings(hits, objects, readings)


def stub_judge(prompt: str, ask: int) -> str:
    """A judge for demonstrations: scores by key, leaves out every fourth, and fails for every fifth task."""
    _, payload, entries = prompt.split("\n")[:3]
    if json.loads(payload)["q"] % 5 == 0:
        raise ConnectionError("nobody answers")
    return jv.dumped({"scores": {e["key"]: int(e["key"]) % 12 for e in json.loads(entries) if int(e["key"]) % 4}})


SELECT_SQL = f"""WITH RECURSIVE {FULL[5:]},
ju AS (SELECT *, CASE WHEN place <= 20 AND q % 5 <> 0 THEN 0 ELSE 1 END AS part, CASE WHEN place <= 20 AND q % 5 <> 0 AND key::BIGINT % 4 <> 0 THEN least(10, key::BIGINT % 12)::INT END AS judged FROM pl),
od AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY part, CASE WHEN part = 0 THEN -coalesce(judged, -1) ELSE 0 END, score DESC, key) AS o FROM ju),
tw AS (SELECT od.*, d.text, row_number() OVER (PARTITION BY q, d.text ORDER BY o) AS twin, row_number() OVER (PARTITION BY q, d.text ORDER BY od.place) AS copy FROM od JOIN d USING (key)),
nt AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY o) AS step FROM tw WHERE twin = 1),
cp AS (SELECT q, place, row_number() OVER (PARTITION BY q ORDER BY place) AS n FROM tw WHERE copy = 1),
en AS (SELECT q, max(place) AS last, count(*) AS pool FROM cp WHERE n <= 50 GROUP BY q),
chosen AS (SELECT *, CASE WHEN length(text) <= 2000 THEN text WHEN key::BIGINT % 2 = 0 THEN '..' ELSE substr(text, 1, 2000) END AS display FROM nt WHERE step <= 5),
b AS (SELECT *, strlen(display)::BIGINT AS bytes FROM chosen),
fold AS (SELECT q, step, TRUE AS packed, bytes AS used FROM b WHERE step = 1
 UNION ALL SELECT b.q, b.step, f.used + b.bytes <= 5000, f.used + CASE WHEN f.used + b.bytes <= 5000 THEN b.bytes ELSE 0 END FROM fold f JOIN b ON b.q = f.q AND b.step = f.step + 1)"""


def selected(spark, d):
    """Documents for every benchmark text: recency from their ids, prior from their length, kept summaries for every second one, a judge, and a budget."""
    docs = corpus(spark, d)
    number = F.col("key").cast("bigint")
    rows = docs.select("key", "text", (number * 7919 % 365).alias("ts"), F.col("n_chars").alias("weight"))
    kept = docs.where(number % 2 == 0).select("key", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha"), F.lit("..").alias("summary"))
    tasks = asked(spark, d).select("q", F.array("text").alias("texts"), F.to_json(F.struct("q")).alias("payload"))
    spec = select.Spec(k=5, max_chars=2_000, diversify=0, max_bytes=5_000, judge=stub_judge)
    return select.select(rows, tasks, spec, summaries=kept)


@query(f"""{SELECT_SQL} SELECT b.q, b.step::INT AS place, key, sha256(display) AS text_sha, score, round(lexical_rank, 1) AS lexical, round(semantic_rank, 1) AS semantic, length(text) > 2000 AND key::BIGINT % 2 <> 0 AS truncated,
 length(text) > 2000 AND key::BIGINT % 2 = 0 AS summarized, judged FROM b JOIN fold ON fold.q = b.q AND fold.step = b.step WHERE packed""")
def select_entries(spark, d):
    """What each task is shown, from ranking to budget."""
    return selected(spark, d).entries.withColumn("text_sha", F.sha2("text", 256)).drop("text")


@query(f"""{SELECT_SQL}, sums AS (SELECT q, count(*) AS chosen, count(*) FILTER (WHERE packed) AS packed FROM fold GROUP BY q)
SELECT en.q, (SELECT count(*) FROM d) AS considered, false AS included_all, (SELECT count(*) FROM d) AS gathered, CASE WHEN en.q % 5 = 0 THEN 0 ELSE 20 END AS reranked,
 (SELECT count(*) FROM tw WHERE tw.q = en.q AND copy > 1 AND (en.pool < 50 OR tw.place < en.last)) AS deduped, en.pool, chosen, packed, chosen - packed AS dropped, CASE WHEN en.q % 5 = 0 THEN 'agent_backend' END AS rerank_error FROM en JOIN sums USING (q)""")
def select_funnel(spark, d):
    """Where rows were left behind on the way, and which judge failed."""
    return selected(spark, d).funnel
