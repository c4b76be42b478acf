"""Queries of the event and workflow ledger, mapped onto the star-schema tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import queue as qu
from ..operators import steps
from .retrieval import t

Q: dict = {}
SQL: dict[str, str] = {}
NOW = "2024-06-01 00:00:00"


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


#: Which kinds of task consume which event.
SUBSCRIPTIONS = [("user.click", "profile"), ("user.click", "session"), ("user.error", "triage"), ("user.purchase", "billing"), ("user.purchase", "profile"), ("user.signup", "profile"), ("user.view", "session")]
SUBS_SQL = "subs(event, kind) AS (VALUES " + ", ".join(map(str, SUBSCRIPTIONS)) + ")"
PAYLOAD_SQL = """'{"event_type":"' || event_type || '","props":' || props || ',"user_id":' || user_id || '}'"""
TASKS_SQL = f"""{SUBS_SQL}, ev AS (SELECT event_id, 'user.' || event_type AS name, sha256({PAYLOAD_SQL}) AS payload_hash, value, user_id, ts FROM events),
tasks AS (SELECT min(event_id) AS id, kind, payload_hash, count(*) AS arrivals FROM ev JOIN subs ON subs.event = ev.name GROUP BY kind, payload_hash)"""


def events(spark, d):
    payload = tx.canonical_json({"event_type": tx.json_text(F.col("event_type")), "props": F.col("props"), "user_id": F.col("user_id").cast("string")})
    return t(spark, d, "events").select("event_id", F.concat(F.lit("user."), F.col("event_type")).alias("name"), payload.alias("payload"), F.sha2(payload, 256).alias("payload_hash"), "value", "user_id", "ts", "props")


def subscriptions(spark):
    return spark.createDataFrame(SUBSCRIPTIONS, "event string, kind string")


def tasks(spark, d):
    return qu.enqueue(qu.fan_out(events(spark, d), subscriptions(spark))).withColumnRenamed("event_id", "id")


@query(f"SELECT event_id, {PAYLOAD_SQL} AS payload, sha256({PAYLOAD_SQL}) AS payload_hash FROM events")
def payload_hashes(spark, d):
    return events(spark, d).select("event_id", "payload", "payload_hash")


@query(f"WITH {SUBS_SQL} SELECT event_id, kind FROM events JOIN subs ON subs.event = 'user.' || event_type")
def fanout_subscriptions(spark, d):
    return qu.fan_out(events(spark, d), subscriptions(spark)).select("event_id", "kind")


@query(f"WITH {TASKS_SQL} SELECT * FROM tasks")
def idempotent_enqueue(spark, d):
    return tasks(spark, d)


STATE_SQL = "CASE id % 5 WHEN 0 THEN 'done' WHEN 1 THEN 'pending' WHEN 2 THEN 'retry_wait' WHEN 3 THEN 'parked' ELSE 'failed' END"
NEXT_SQL = "CASE WHEN id % 5 = 2 THEN 1000 + id % 1000 END"


def stated(spark, d):
    m = F.col("id") % 5
    state = F.when(m == 0, "done").when(m == 1, "pending").when(m == 2, "retry_wait").when(m == 3, "parked").otherwise("failed")
    return tasks(spark, d).withColumn("state", state).withColumn("next_attempt", F.when(m == 2, 1000 + F.col("id") % 1000))


@query(f"""WITH {TASKS_SQL}, lanes(lane, cap) AS (VALUES ('billing', 3), ('profile', 5), ('session', 4), ('triage', 2)),
s AS (SELECT id, kind AS lane, {STATE_SQL} AS state, {NEXT_SQL} AS next_attempt FROM tasks),
r AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY id) AS turn FROM s WHERE state IN ('pending', 'retry_wait') AND (next_attempt IS NULL OR next_attempt <= 1500))
SELECT id, lane, turn FROM r JOIN lanes USING (lane) WHERE turn <= cap""")
def eligible_claim(spark, d):
    lanes = spark.createDataFrame([("billing", 3), ("profile", 5), ("session", 4), ("triage", 2)], "lane string, cap int")
    return qu.claim(stated(spark, d).withColumnRenamed("kind", "lane"), F.lit(1500), lanes).select("id", "lane", "turn")


POLICY_SQL = "policy(error_class, max_attempts, base_s, cap_s, park, consume, unpark_s) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else str(x).upper() if isinstance(x, bool) else repr(x) for x in r) + ")" for r in qu.POLICY) + ")"
CLASSES = [r[0] for r in qu.POLICY] + ["unheard_of"]
CLASS_SQL = "[" + ", ".join(map(repr, CLASSES)) + "]"


@query(f"""WITH {TASKS_SQL}, {POLICY_SQL},
f AS (SELECT id, {CLASS_SQL}[(id % 14)::INT + 1] AS error_class, (id % 12)::INT AS attempts FROM tasks),
n AS (SELECT f.*, base_s, cap_s, CASE WHEN max_attempts IS NULL OR consume THEN 'failed' WHEN attempts + 1 <= max_attempts THEN 'retry_wait' WHEN park THEN 'parked' ELSE 'failed' END AS new_state FROM f LEFT JOIN policy USING (error_class))
SELECT id, error_class, new_state, CASE WHEN new_state = 'retry_wait' THEN attempts + 1 ELSE attempts END AS new_attempts,
 CASE WHEN new_state = 'retry_wait' THEN 1000 + least(base_s * power(2, attempts), cap_s)::BIGINT END AS next_attempt FROM n""")
def retry_backoff(spark, d):
    failed = tasks(spark, d).withColumn("error_class", F.element_at(F.array(*map(F.lit, CLASSES)), (F.col("id") % 14 + 1).cast("int"))).withColumn("attempts", (F.col("id") % 12).cast("int"))
    return qu.fail(failed, qu.policy_table(spark), F.lit(1000)).select("id", "error_class", "new_state", "new_attempts", "next_attempt")


@query(f"""WITH {TASKS_SQL}, {POLICY_SQL},
p AS (SELECT id, {CLASS_SQL}[(id % 14)::INT + 1] AS error_class, id % 3000 AS updated_at FROM tasks)
SELECT id, p.error_class FROM p LEFT JOIN policy ON policy.error_class = p.error_class
WHERE 3000 - updated_at >= CASE WHEN policy.error_class IS NULL THEN 600 ELSE unpark_s END AND p.error_class NOT IN ('agent_limit', 'agent_backend')""")
def parked_due(spark, d):
    parked = tasks(spark, d).withColumn("error_class", F.element_at(F.array(*map(F.lit, CLASSES)), (F.col("id") % 14 + 1).cast("int"))).withColumn("updated_at", F.col("id") % 3000)
    return qu.parked_due(parked, qu.policy_table(spark), F.lit(3000), healthy=False).select("id", "error_class")


@query(f"WITH {TASKS_SQL} SELECT id, CASE WHEN id * 100 > 1000 + 172800 THEN 1000 + 3600 ELSE id * 100 END AS next_attempt FROM tasks")
def clock_clamp(spark, d):
    return tasks(spark, d).select("id", qu.clamp(F.col("id") * 100, F.lit(1000).cast("bigint")).alias("next_attempt"))


@query("""WITH e AS (SELECT floor(epoch(ts))::BIGINT AS sec FROM events)
SELECT sec - sec % 300 AS window_start, min(sec) AS fired_at, count(*) AS ticks FROM e GROUP BY 1""")
def schedule_windows(spark, d):
    return qu.schedule_fires(t(spark, d, "events").select(F.unix_seconds(F.col("ts").cast("timestamp")).alias("at")), 300)


MEMBER_SQL = "CASE WHEN l_linestatus = 'O' THEN NULL WHEN l_returnflag = 'R' THEN 'failed' WHEN l_returnflag = 'A' THEN 'done' ELSE 'deferred' END"


def members(spark, d):
    state = F.when(F.col("l_linestatus") == "O", F.lit(None).cast("string")).when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "done").otherwise("deferred")
    return t(spark, d, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.col("l_linenumber").alias("task_id"), state.alias("state"))


BARRIER_SQL = f"""m AS (SELECT l_orderkey AS group_id, l_linenumber AS task_id, {MEMBER_SQL} AS state FROM lineitem),
g AS (SELECT group_id, count(*) AS total, count(*) - count(state) AS waiting, count(*) FILTER (WHERE state = 'done') AS done, count(*) FILTER (WHERE state = 'failed') AS failed,
 count(*) FILTER (WHERE state = 'deferred') AS deferred, count(*) = count(state) AS complete FROM m GROUP BY group_id)"""


@query(f"WITH {BARRIER_SQL} SELECT * FROM g")
def join_barrier(spark, d):
    return qu.barriers(members(spark, d))


@query(f"WITH {BARRIER_SQL} SELECT group_id FROM g WHERE complete AND group_id % 7 <> 0")
def join_fire(spark, d):
    """Complete groups fire once; every seventh has fired before."""
    groups = qu.barriers(members(spark, d))
    return qu.fire(groups, groups.where(F.col("group_id") % 7 == 0)).select("group_id")


@query(f"""WITH {BARRIER_SQL} SELECT group_id, task_id, state, total, total > 200 AS truncated
FROM (SELECT group_id, task_id, coalesce(state, 'waiting') AS state, count(*) OVER (PARTITION BY group_id) AS total, row_number() OVER (PARTITION BY group_id ORDER BY task_id, coalesce(state, 'waiting')) AS n FROM m) WHERE n <= 200""")
def join_roster(spark, d):
    """The first 200 members of each group, with its exact total."""
    roster = members(spark, d).select("group_id", "task_id", F.coalesce("state", F.lit("waiting")).alias("state"))
    return steps.roster_cap(roster, 200)


@query(f"WITH {BARRIER_SQL} SELECT o_orderkey AS group_id, coalesce(n, 0) AS terminal FROM orders LEFT JOIN (SELECT group_id, count(state) AS n FROM m GROUP BY 1) x ON x.group_id = o_orderkey WHERE o_orderstatus <> 'F'")
def open_joins(spark, d):
    ended = members(spark, d).groupBy("group_id").agg(F.count("state").alias("terminal"))
    return t(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("group_id")).join(ended, "group_id", "left").select("group_id", F.coalesce("terminal", F.lit(0)).alias("terminal"))


EDGES = [("found", "O"), ("O", "P"), ("P", "F"), ("O", "F")]
MOVE_SQL = """mv AS (SELECT o_custkey AS item, o_orderkey AS id, o_orderstatus AS to_state, coalesce(lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 'found') AS from_state FROM orders)"""


@query(f"WITH {MOVE_SQL}, e(f, t) AS (VALUES {', '.join(map(str, EDGES))}) SELECT id, item, from_state, to_state, e.f IS NOT NULL AS legal FROM mv LEFT JOIN e ON e.f = from_state AND e.t = to_state")
def item_transitions(spark, d):
    before = F.lag("o_orderstatus").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    moves = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("item"), F.coalesce(before, F.lit("found")).alias("from_state"), F.col("o_orderstatus").alias("to_state"))
    return qu.transitions(moves, spark.createDataFrame(EDGES, "from_state string, to_state string")).select("id", "item", "from_state", "to_state", "legal")


@query("SELECT o_custkey AS key, min(o_orderkey) AS first_order FROM orders WHERE o_custkey % 10 <> 0 GROUP BY 1")
def upsert_items(spark, d):
    new = t(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("first_order"))
    old = t(spark, d, "customer").where(F.col("c_custkey") % 10 == 0).select(F.col("c_custkey").alias("key"))
    return qu.upsert(new, old, "key", "first_order")


@query("SELECT conv_id, role, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id, role")
def latest_per_key(spark, d):
    return qu.latest(t(spark, d, "conversations").groupBy("conv_id", "role", "turn").agg(F.max("text").alias("text")), ["conv_id", "role"], "turn")


@query("""SELECT conv_id AS key, turn AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS round, CASE WHEN lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL THEN 'open' ELSE 'superseded' END AS status FROM conversations""")
def decision_rounds(spark, d):
    return qu.decision_rounds(t(spark, d, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("id")))


@query(f"""WITH {TASKS_SQL} SELECT id, kind, CASE WHEN id % 4 = 0 THEN 'adopt' WHEN id % 4 = 1 OR id % 3 = 0 THEN 'keep' ELSE 'park' END AS action FROM tasks""")
def version_gate(spark, d):
    m = F.col("id") % 4
    held = tasks(spark, d).withColumn("def_hash", F.when(m == 0, F.lit(None).cast("string")).when(m == 1, "new").otherwise("old")).withColumn("steps", F.col("id") % 3)
    current = spark.createDataFrame([(k, "new") for k in ("billing", "profile", "session", "triage")], "kind string, hash string")
    return qu.version_gate(held, current).select("id", "kind", "action")


@query(f"WITH {TASKS_SQL} SELECT kind, {STATE_SQL} AS state, count(*) AS n FROM tasks GROUP BY ALL")
def status_by_kind(spark, d):
    return stated(spark, d).groupBy("kind", "state").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_brand AS model, count(*) AS runs, count(*) FILTER (WHERE l_returnflag = 'N') AS no_verdict, trunc(avg(l_quantity))::BIGINT AS avg_ms, max(l_quantity) AS max_ms,
 sum(l_linenumber)::BIGINT AS reasks, round(avg((l_returnflag = 'R')::INT), 6) AS error_rate FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def metrics_models(spark, d):
    runs = t(spark, d, "lineitem").select("l_partkey", "l_quantity", "l_returnflag", "l_linenumber").join(t(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    flag = lambda x: (F.col("l_returnflag") == x).cast("int")
    return runs.groupBy(F.col("p_brand").alias("model")).agg(F.count(F.lit(1)).alias("runs"), F.sum(flag("N")).alias("no_verdict"), F.avg("l_quantity").cast("bigint").alias("avg_ms"), F.max("l_quantity").alias("max_ms"), F.sum("l_linenumber").cast("bigint").alias("reasks"), F.round(F.avg(flag("R")), 6).alias("error_rate"))


@query("""SELECT l_returnflag AS kind, l_linestatus AS step, round(avg(l_quantity), 6) AS avg_wall, count(*) AS n FROM lineitem GROUP BY 1, 2 ORDER BY avg_wall DESC, kind, step LIMIT 8""")
def slow_steps(spark, d):
    per = t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("step")).agg(F.round(F.avg("l_quantity"), 6).alias("avg_wall"), F.count(F.lit(1)).alias("n"))
    return per.orderBy(F.desc("avg_wall"), "kind", "step").limit(8)


@query("""WITH m AS (SELECT max(ts) AS now FROM events)
SELECT event_type, count(*) FILTER (WHERE ts > now - INTERVAL 1 HOUR) AS last_hour, count(*) FILTER (WHERE ts > now - INTERVAL 24 HOUR) AS last_day, count(*) AS total FROM events, m GROUP BY 1""")
def throughput_windows(spark, d):
    rows = t(spark, d, "events").select("event_type", "ts")
    now = rows.agg(F.max("ts")).first()[0]
    within = lambda h: F.sum((F.col("ts") > F.lit(now) - F.expr(f"INTERVAL {h} HOURS")).cast("int")).cast("bigint")
    return rows.groupBy("event_type").agg(within(1).alias("last_hour"), within(24).alias("last_day"), F.count(F.lit(1)).alias("total"))


@query("""WITH old AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1997-01-01')
SELECT 'orders' AS kind, count(*) AS n FROM old UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM old) UNION ALL SELECT 'events', count(*) FROM events WHERE ts < TIMESTAMP '2024-01-15'""")
def gc_candidates(spark, d):
    """What a collection would remove, as a dry run."""
    old = t(spark, d, "orders").where("o_orderstatus = 'F' AND o_orderdate < TIMESTAMP_NTZ '1997-01-01 00:00:00'").select("o_orderkey")
    lines = t(spark, d, "lineitem").join(old, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    count = lambda df, n: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("kind"), "n")
    return count(old, "orders").union(count(lines, "lineitem")).union(count(t(spark, d, "events").where("ts < TIMESTAMP_NTZ '2024-01-15 00:00:00'"), "events"))


@query(f"""WITH {TASKS_SQL} SELECT ev.event_id, ev.name, tasks.id AS task_id, tasks.kind, ev.event_id = tasks.id AS origin FROM ev JOIN subs ON subs.event = ev.name JOIN tasks ON tasks.kind = subs.kind AND tasks.payload_hash = ev.payload_hash""")
def trace_lineage(spark, d):
    """Each event with the tasks that it opened or met."""
    out = qu.fan_out(events(spark, d), subscriptions(spark)).join(tasks(spark, d).select(F.col("id").alias("task_id"), "kind", "payload_hash"), ["kind", "payload_hash"])
    return out.select("event_id", "name", "task_id", "kind", (F.col("event_id") == F.col("task_id")).alias("origin"))


CHIP_SQL = "CASE WHEN bool_or(state = 'parked') THEN 'needs-human' WHEN bool_or(state = 'retry_wait') THEN 'running' WHEN bool_or(state = 'failed') THEN 'failed' WHEN bool_and(state = 'done') THEN 'complete' ELSE 'queued' END"


@query(f"""WITH {TASKS_SQL}, s AS (SELECT t.*, {STATE_SQL.replace('id %', 't.id %')} AS state, e.user_id AS thread FROM tasks t JOIN ev e ON e.event_id = t.id),
l AS (SELECT thread, kind, arg_max(state, id) AS state, max(id) AS id FROM s GROUP BY ALL)
SELECT thread, count(*) AS kinds, max(id) AS newest, {CHIP_SQL} AS chip FROM l GROUP BY thread""")
def threads_latest(spark, d):
    rows = stated(spark, d).join(events(spark, d).select(F.col("event_id").alias("id"), F.col("user_id").alias("thread")), "id")
    last = qu.latest(rows.select("thread", "kind", "id", "state"), ["thread", "kind"], "id")
    any_ = lambda s: F.bool_or(F.col("state") == s)
    chip = F.when(any_("parked"), "needs-human").when(any_("retry_wait"), "running").when(any_("failed"), "failed").when(F.bool_and(F.col("state") == "done"), "complete").otherwise("queued")
    return last.groupBy("thread").agg(F.count(F.lit(1)).alias("kinds"), F.max("id").alias("newest"), chip.alias("chip"))


@query("""SELECT event_id, event_type, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE json_extract_string(props, '$.k') = '7'""")
def audit_events(spark, d):
    k = F.get_json_object("props", "$.k")
    return t(spark, d, "events").where(k == "7").select("event_id", "event_type", k.cast("bigint").alias("k"))


@query(f"""WITH {TASKS_SQL}, s AS (SELECT id, kind, {STATE_SQL} AS state FROM tasks)
SELECT 'parked' AS issue, kind, count(*) AS n FROM s WHERE state = 'parked' GROUP BY kind UNION ALL SELECT 'failed', kind, count(*) FROM s WHERE state = 'failed' GROUP BY kind""")
def doctor_issues(spark, d):
    bad = stated(spark, d).where(F.col("state").isin("parked", "failed"))
    return bad.groupBy(F.col("state").alias("issue"), "kind").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT r_name AS region, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1 ORDER BY 1 LIMIT 500""")
def panel_regions(spark, d):
    """A user panel: a read-only statement with a bound parameter, capped at 500 rows."""
    from .panels import run_panel

    for name in ("customer", "nation", "region"):
        t(spark, d, name).createOrReplaceTempView(f"panel_{name}")
    sql = """SELECT r_name AS region, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM panel_customer JOIN panel_nation ON n_nationkey = c_nationkey
             JOIN panel_region ON r_regionkey = n_regionkey WHERE c_mktsegment = :segment GROUP BY 1 ORDER BY 1"""
    return run_panel(spark, sql, {"segment": "BUILDING"})


#: Roles as kinds of task: one consumes what follows the role before it and emits what follows itself.
FLOW_SQL = "w AS (SELECT DISTINCT role AS kind, 'after.' || lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role) AS consumes, 'after.' || role AS emits FROM conversations)"


def flows(spark, d):
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn", "role"))
    rows = t(spark, d, "conversations").select(F.col("role").alias("kind"), F.concat(F.lit("after."), before).alias("consumes"), F.concat(F.lit("after."), "role").alias("emits"))
    return rows.distinct()


@query(f"WITH {FLOW_SQL} SELECT DISTINCT a.kind AS source, b.kind AS target, a.emits AS event FROM w a JOIN w b ON a.emits = b.consumes")
def workflow_edges(spark, d):
    from .definitions import edges

    return edges(flows(spark, d))


@query(f"""WITH RECURSIVE {FLOW_SQL}, e AS (SELECT DISTINCT a.kind AS s, b.kind AS g FROM w a JOIN w b ON a.emits = b.consumes WHERE a.kind <> b.kind),
r AS (SELECT DISTINCT kind FROM w WHERE kind NOT IN (SELECT g FROM e)), f AS (SELECT kind FROM r UNION ALL SELECT min(kind) FROM w WHERE NOT EXISTS (SELECT 1 FROM r)),
walk(kind, depth) AS (SELECT kind, 0 FROM f WHERE kind IS NOT NULL UNION SELECT e.g, walk.depth + 1 FROM walk JOIN e ON e.s = walk.kind WHERE walk.depth < 10)
SELECT w.kind, coalesce(min(depth), 0)::INT AS depth FROM w LEFT JOIN walk USING (kind) GROUP BY w.kind""")
def workflow_depth(spark, d):
    """How far each role is from one that nothing leads to; edges back don't push a role down."""
    from .definitions import depths, edges

    found = flows(spark, d)
    return depths(found.select("kind"), edges(found))


TARGETS = [(kind, outcome) for kind in ("click", "error", "purchase", "signup", "view") for outcome in ("o0", "o1", "o2", "late")]


@query(f"""WITH disp(step, outcome) AS (VALUES {', '.join(map(str, TARGETS))}), decl AS (SELECT DISTINCT event_type AS step, 'o' || json_extract_string(props, '$.k')::BIGINT % 4 AS outcome FROM events)
SELECT step, outcome, 'missing' AS problem FROM (SELECT * FROM decl EXCEPT SELECT * FROM disp) UNION ALL SELECT step, outcome, 'phantom' FROM (SELECT * FROM disp EXCEPT SELECT * FROM decl)""")
def totality_check(spark, d):
    """Outcomes that events tell of against the targets of a definition: one has no target, one never comes."""
    from .definitions import outcome_problems

    outcome = F.concat(F.lit("o"), (F.get_json_object("props", "$.k").cast("bigint") % 4).cast("string"))
    told = t(spark, d, "events").select(F.col("event_type").alias("step"), outcome.alias("outcome")).distinct()
    return outcome_problems(told, spark.createDataFrame(TARGETS, "step string, outcome string"))
