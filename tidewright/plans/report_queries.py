"""Queries of reports, retention, commands, panels and model calls over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import json_values as jv
from ..operators import blocks, reports
from ..operators import queue as qu
from ..operators import ranking as rk
from ..operators import selection as sel
from ..sources.ledger import Ledger, shared_folder
from . import panels
from .flow_queries import DECISIONS_SQL, asked_rounds
from .ledger_views import CLASS_SQL, CLASSES, MEMBER_SQL, NEXT_SQL, STATE_SQL, TASKS_SQL, events, members, stated, tasks
from .retrieval import LEX, _flat, asked, corpus, t

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


OVERRIDES = {"forge_server": {"max_attempts": 2, "cap_s": 15}, "agent_limit": {"park": False}, "unheard_of": {"max_attempts": 5, "park": True, "base_s": 7, "cap_s": 100}}
POLICY_SQL = "policy(error_class, max_attempts, base_s, cap_s, park, consume, unpark_s) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else str(x).upper() if isinstance(x, bool) else repr(x) for x in r) + ")" for r in qu.build_policy(OVERRIDES)) + ")"


@query(f"""WITH {TASKS_SQL}, {POLICY_SQL}, f AS (SELECT id, {CLASS_SQL}[(id % 14)::INT + 1] AS error_class, (id % 12)::INT AS attempts FROM tasks),
n AS (SELECT f.*, base_s, cap_s, CASE WHEN max_attempts IS NULL OR consume THEN 'failed' WHEN attempts + 1 <= max_attempts THEN 'retry_wait' WHEN park THEN 'parked' ELSE 'failed' END AS new_state FROM f LEFT JOIN policy USING (error_class))
SELECT id, error_class, new_state, CASE WHEN new_state = 'retry_wait' THEN 1000 + least(base_s * power(2, attempts), cap_s)::BIGINT END AS next_attempt FROM n""")
def retry_overrides(spark, d):
    """The retry ladder under a pack's own policies: two classes tuned, one of its own."""
    failed = tasks(spark, d).withColumn("error_class", F.element_at(F.array(*map(F.lit, CLASSES)), (F.col("id") % 14 + 1).cast("int"))).withColumn("attempts", (F.col("id") % 12).cast("int"))
    return qu.fail(failed, qu.policy_table(spark, OVERRIDES), F.lit(1000)).select("id", "error_class", "new_state", "next_attempt")


@query(f"""WITH {TASKS_SQL}, s AS (SELECT CASE WHEN id % 11 = 0 THEN 'running' ELSE {STATE_SQL} END AS state, {NEXT_SQL} + CASE WHEN id % 97 = 0 THEN 200000 ELSE 0 END AS next_attempt FROM tasks),
i AS (SELECT 'waits beyond two days' AS issue, count(*) FILTER (WHERE next_attempt > 1500 + 172800) AS n FROM s UNION ALL SELECT 'running without a daemon', count(*) FILTER (WHERE state = 'running') FROM s
 UNION ALL SELECT 'overdue without a daemon', count(*) FILTER (WHERE state = 'retry_wait' AND next_attempt <= 1500) FROM s UNION ALL SELECT 'heartbeat is stale', 500)
SELECT * FROM i WHERE n > 0""")
def doctor_report(spark, d):
    """Health of the queue with a heartbeat of 500 seconds ago: some tasks run, some wait beyond all backoff."""
    rows = stated(spark, d).withColumn("state", F.when(F.col("id") % 11 == 0, "running").otherwise(F.col("state")))
    rows = rows.withColumn("next_attempt", F.col("next_attempt") + F.when(F.col("id") % 97 == 0, 200_000).otherwise(0))
    return reports.doctor(rows, 1_500, 1_000)


@query(f"""WITH m AS (SELECT l_orderkey AS group_id, l_partkey AS task_id, {MEMBER_SQL} AS state, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, {MEMBER_SQL}) AS n FROM lineitem),
u AS (SELECT group_id, task_id, state FROM m WHERE n = 1), w AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY task_id) AS n FROM u JOIN part ON p_partkey = task_id),
c AS (SELECT group_id, coalesce(state, 'waiting') AS state, count(*) AS n FROM u GROUP BY ALL), cs AS (SELECT group_id, sum(n)::BIGINT AS total, string_agg(state || ':' || n, ',' ORDER BY state) AS counts FROM c GROUP BY 1),
l AS (SELECT group_id, string_agg(task_id || ' ' || coalesce(state, '-') || ' ' || p_brand || ' ' || p_size, ';' ORDER BY task_id) AS members FROM w WHERE n <= 2 GROUP BY 1)
SELECT o_orderkey AS group_id, 'all.done' AS event, coalesce(total, 0) AS total, counts, members, coalesce(total, 0) > 2 AS truncated FROM orders LEFT JOIN cs ON cs.group_id = o_orderkey LEFT JOIN l ON l.group_id = o_orderkey""")
def collected_joins(spark, d):
    """Orders as groups of parts: counts by state and the first two members with their results."""
    from pyspark.sql import Window

    state = F.when(F.col("l_linestatus") == "O", F.lit(None).cast("string")).when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "done").otherwise("deferred")
    lines = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.col("l_partkey").alias("task_id"), state.alias("state"), "l_linenumber")
    turn = F.row_number().over(Window.partitionBy("group_id", "task_id").orderBy("l_linenumber", F.asc_nulls_last("state")))
    roster = lines.withColumn("n", turn).where("n = 1").select("group_id", "task_id", "state")
    groups = t(spark, d, "orders").select(F.col("o_orderkey").alias("group_id"), F.lit("all.done").alias("event"), F.lit(None).cast("bigint").alias("fired_at"))
    parts = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("kind"), F.col("p_size").cast("string").alias("result"))
    out = reports.collected(roster, parts, groups, limit=2)
    told = F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    each = F.array_join(F.transform("members", lambda m: F.concat_ws(" ", m["task_id"].cast("string"), F.coalesce(m["state"], F.lit("-")), m["kind"], m["result"])), ";")
    return out.select("group_id", "event", "total", told.alias("counts"), each.alias("members"), "truncated")


@query(f"""WITH {DECISIONS_SQL}, s AS (SELECT DISTINCT conv_id * 10 + m AS task, conv_id AS thread, m FROM conversations, (SELECT unnest([0, 1]) AS m))
SELECT thread, 0 AS part, d.id AS at, 'decision' AS what, d.key || ' ' || round || ' ' || coalesce(verdict, 'open') AS detail FROM d JOIN s USING (task)
UNION ALL SELECT thread, 1, task, 'task', CASE m WHEN 0 THEN 'ask' ELSE 'tell' END || ' done' FROM s
UNION ALL SELECT thread, 2, task, 'step', '0 ' || turn || ' ' || role || ' ' || length(text) FROM (SELECT conv_id * 10 + turn % 2 AS task, turn, role, text FROM conversations) JOIN s USING (task)
UNION ALL SELECT user_id, 3, event_id, 'event', 'user.' || event_type FROM events""")
def run_audit(spark, d):
    """Conversations as runs of two tasks, their turns as steps, their rounds of decisions, and the events of the same thread."""
    rows = t(spark, d, "conversations")
    own = rows.select(F.col("conv_id").alias("thread")).distinct().select("thread", F.explode(F.array(F.lit(0), F.lit(1))).alias("m"))
    own = own.select("thread", (F.col("thread") * 10 + F.col("m")).alias("task"), F.when(F.col("m") == 0, "ask").otherwise("tell").alias("kind"), F.lit("done").alias("state"))
    steps = rows.select((F.col("conv_id") * 10 + F.col("turn") % 2).alias("task"), F.lit(0).alias("attempt"), F.col("turn").alias("seq"), F.col("role").alias("step"), F.length("text").alias("outcome"))
    told = events(spark, d).select(F.col("user_id").alias("thread"), F.col("event_id").alias("event"), "name")
    return reports.run_audit(own, steps, asked_rounds(spark, d), told)


SWEPT_SQL = f"""now AS (SELECT max(floor(epoch(ts))::BIGINT) AS now FROM events), k AS (SELECT o_orderkey AS id, floor(epoch(o_orderdate))::BIGINT % 4000000 + now - 4000000 AS updated_at, o_orderstatus FROM orders, now),
old AS (SELECT id FROM k, now WHERE o_orderstatus IN ('F', 'O') AND updated_at < now - 14 * 86400),
m AS (SELECT l_orderkey AS group_id, l_linenumber, {MEMBER_SQL} AS state FROM lineitem), f AS (SELECT group_id FROM m GROUP BY 1 HAVING count(state) = count(*)),
g AS (SELECT DISTINCT m.group_id, CASE WHEN f.group_id IS NOT NULL THEN k.updated_at END AS fired_at FROM m LEFT JOIN f USING (group_id) LEFT JOIN k ON k.id = m.group_id),
go AS (SELECT group_id FROM g, now WHERE fired_at < now - 14 * 86400)"""


@query(f"""WITH {SWEPT_SQL}
SELECT 'runs' AS kind, (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT id FROM old)) AS gone, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM old)) AS kept
UNION ALL SELECT 'events', (SELECT count(*) FROM events, now WHERE floor(epoch(ts))::BIGINT < now - 14 * 86400), (SELECT count(*) FROM events, now WHERE floor(epoch(ts))::BIGINT >= now - 14 * 86400)
UNION ALL SELECT 'groups', (SELECT count(*) FROM go), (SELECT count(*) FROM g WHERE group_id NOT IN (SELECT group_id FROM go))
UNION ALL SELECT 'members', (SELECT count(*) FROM m WHERE group_id IN (SELECT group_id FROM go)), (SELECT count(*) FROM m WHERE group_id NOT IN (SELECT group_id FROM go))""")
def retention(spark, d):
    """A ledger's tables are written, swept of what ended two weeks ago, and read again: what went and what is left."""
    ev = t(spark, d, "events").select("event_id", F.floor(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("at"))
    now = ev.agg(F.max("at")).first()[0] or 0
    at = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) % 4_000_000 + F.lit(now - 4_000_000)
    state = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "failed").otherwise("pending")
    done = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), state.alias("state"), at.alias("updated_at"))
    roster = members(spark, d)
    fired = qu.barriers(roster).where("complete").select("group_id", F.lit(True).alias("fired"))
    groups = roster.select("group_id").distinct().join(fired, "group_id", "left").join(done.select(F.col("id").alias("group_id"), "updated_at"), "group_id", "left")
    groups = groups.select("group_id", F.when(F.col("fired"), F.col("updated_at")).alias("fired_at"))
    runs = t(spark, d, "lineitem").select(F.col("l_linenumber").cast("bigint").alias("id"), F.col("l_orderkey").alias("task"))
    ledger, schemas = Ledger(spark, shared_folder(spark, "retention")), {}
    written = {"tasks": done, "runs": runs, "events": ev, "groups": groups, "members": roster.select("group_id", F.col("task_id").cast("bigint").alias("task_id"), "state")}
    schemas = {k: ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) for k, df in written.items()}
    ledger.commit("all", written)
    now_ = {k: ledger.table(k, s) for k, s in schemas.items()}
    left, gone = reports.swept(now_, F.lit(now).cast("bigint"), 14)
    gone = ledger.kept("gone", gone)
    ledger.rewrite("sweep", left)
    counts = [ledger.table(k, schemas[k]).agg(F.count(F.lit(1)).alias("kept")).select(F.lit(k).alias("kind"), "kept") for k in left]
    kept = counts[0]
    for c in counts[1:]:
        kept = kept.unionByName(c)
    return gone.withColumnRenamed("n", "gone").join(kept, "kind")


@query("""SELECT s_suppkey AS id, CASE WHEN s_nationkey >= 12 THEN 'refuted' ELSE 'confirmed' END AS recheck,
 CASE WHEN s_nationkey >= 20 THEN 'red_retryable' WHEN s_suppkey % 7 = 0 THEN 'red' ELSE 'green' END AS suite, CASE WHEN s_nationkey >= 20 THEN 'nation' WHEN s_suppkey % 7 = 0 THEN 'seven' END AS failed FROM supplier""")
def command_checks(spark, d):
    """Commands for every supplier, run in the workers: one that is rechecked, and a suite of two of which the first failure decides."""
    rows = t(spark, d, "supplier")
    text = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    test = lambda a, op, b: F.array(F.lit("test"), text(a), F.lit(op), F.lit(b))
    none = F.lit(None).cast("string").alias("cwd")
    ids = F.col("s_suppkey").alias("id")
    once = blocks.run_commands(rows.select(ids, F.lit(1).alias("place"), F.lit("recheck").alias("name"), test("s_nationkey", "-lt", "12").alias("cmd"), none))
    expect = rows.select(ids, F.lit(0).alias("exit_code"), F.lit(False).alias("nonzero"), F.sha2(F.lit(""), 256).alias("out_sha"))
    both = F.explode(F.array(F.struct(F.lit(1).alias("place"), F.lit("nation").alias("name"), test("s_nationkey", "-lt", "20").alias("cmd")), F.struct(F.lit(2).alias("place"), F.lit("seven").alias("name"), test(F.col("s_suppkey") % 7, "-ne", "0").alias("cmd")))).alias("x")
    ran = blocks.run_commands(rows.select(ids, both).select("id", "x.*", none))
    return blocks.rechecked(once, expect).withColumnRenamed("outcome", "recheck").join(blocks.suite(ran, {"nation": [1]}).withColumnRenamed("outcome", "suite"), "id")


@query("""SELECT * FROM (SELECT 0 AS place, 'orders' AS key, CAST(count(*) AS VARCHAR) AS value FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 1, 'first', CAST(min(o_orderkey) AS VARCHAR) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 2, 'link:order', CAST(max(o_orderkey) AS VARCHAR) FROM orders WHERE o_orderstatus = 'F')""")
def panel_kv(spark, d):
    """A panel of keys and values, one of them a link."""
    t(spark, d, "orders").createOrReplaceTempView("panel_orders")
    return panels.show(spark, "kv", "SELECT count(*) AS orders, min(o_orderkey) AS first, max(o_orderkey) AS `link:order` FROM panel_orders WHERE o_orderstatus = :status", {"status": "F"})


@query("""SELECT p_brand AS "row", split_part(p_type, ' ', 1) AS "column", arg_max('s' || p_size % 3, p_partkey) AS state FROM part WHERE p_size <= 50 GROUP BY 1, 2""")
def panel_grid(spark, d):
    """A grid of states, a cell for each brand and first word of a type; a cell shows its last one."""
    t(spark, d, "part").createOrReplaceTempView("panel_part")
    sql = """SELECT p_brand AS row, split_part(p_type, ' ', 1) AS column, max_by(concat('s', p_size % 3), p_partkey) AS state FROM panel_part WHERE p_size <= :most GROUP BY 1, 2 ORDER BY 1, 2"""
    return panels.show(spark, "status_grid", sql, {"most": 50})


@query("""WITH x AS (SELECT conv_id, turn, role, turn % 6 AS m FROM conversations)
SELECT conv_id, turn, CASE m WHEN 0 THEN 'plain ' || role WHEN 4 THEN '' ELSE role END AS result, CASE WHEN m IN (1, 3) THEN 's' || conv_id END AS session,
 CASE m WHEN 1 THEN NULL WHEN 2 THEN 'agent_limit' WHEN 3 THEN 'agent_backend' WHEN 4 THEN 'agent_limit' WHEN 5 THEN 'agent_backend' END AS error_class FROM x""")
def envelope_errors(spark, d):
    """Envelopes of model calls: plain text, success, out of turns, an error, a refusal, and a process that failed."""
    m, role = F.col("turn") % 6, F.col("role")
    text = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    conv = F.col("conv_id").cast("string")
    told = (
        F.when(m == 0, text("plain ", role))
        .when(m == 1, text('{"result":"', role, '","session_id":"s', conv, '","subtype":"success"}'))
        .when(m == 2, text('{"result":"', role, '","subtype":"error_max_turns"}'))
        .when(m == 3, text('{"result":"', role, '","session_id":"s', conv, '","is_error":true}'))
        .when(m == 4, F.lit('{"result":null,"is_error":true,"api_error_status":429}'))
        .otherwise(text('{"result":"', role, '"}'))
    )
    rows = t(spark, d, "conversations").select("conv_id", "turn", m.alias("m"), jv.envelope(told).alias("e"))
    code = F.when(F.col("m") == 5, 1).otherwise(0)
    return rows.select("conv_id", "turn", F.col("e.result").alias("result"), F.col("e.session_id").alias("session"), jv.envelope_error(code, F.col("e")).alias("error_class"))


@query("WITH " + LEX.format(where="") + """, sc AS (SELECT q, key, row_number() OVER (PARTITION BY q ORDER BY round(CASE WHEN votes THEN 1.0 / (60 + r) ELSE 0 END, 6) DESC, key) AS place FROM lr),
 golden AS (SELECT b.item_id AS q, CAST(d.doc_id AS VARCHAR) AS key, CASE WHEN length(b.text) < 200 THEN 'short' WHEN length(b.text) < 400 THEN 'middle' ELSE 'long' END AS category FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
 f AS (SELECT g.q, category, min(place) AS best FROM golden g JOIN sc ON sc.q = g.q AND sc.key = g.key GROUP BY ALL)
 SELECT category, count(*) AS queries, round(avg((best = 1)::INT), 6) AS recall_1, round(avg((best <= 5)::INT), 6) AS recall_5 FROM f GROUP BY category""")
def recall_by_category(spark, d):
    """Benchmark texts that stand verbatim in documents, by their length: how often one of these is first, or among the best five."""
    docs, items = corpus(spark, d), asked(spark, d)
    n = F.length("text")
    kinds = items.select("q", F.when(n < 200, "short").when(n < 400, "middle").otherwise("long").alias("category"))
    best = rk.lexical_top(docs, items, _flat(docs)).select("q", "key", "place")
    per = sel.verbatim(docs, items).join(best, ["q", "key"], "left").groupBy("q").agg(F.min("place").alias("best")).join(kinds, "q")
    hit = lambda k: F.round(F.avg(F.coalesce(F.col("best") <= k, F.lit(False)).cast("int")), 6)
    return per.groupBy("category").agg(F.count(F.lit(1)).alias("queries"), hit(1).alias("recall_1"), hit(5).alias("recall_5"))


CLASSED_SQL = f"""k AS (SELECT id, kind, {STATE_SQL} AS state, CASE id % 3 WHEN 0 THEN 'agent_limit' WHEN 1 THEN 'forge_auth' ELSE 'awaiting_human' END AS error_class FROM tasks)"""


def classed(spark, d):
    m = F.col("id") % 3
    return stated(spark, d).withColumn("error_class", F.when(m == 0, "agent_limit").when(m == 1, "forge_auth").otherwise("awaiting_human"))


@query(f"""WITH {TASKS_SQL}, {CLASSED_SQL}, m AS (SELECT l_orderkey AS group_id, {MEMBER_SQL} AS state FROM lineitem WHERE l_orderkey % 7 <> 0)
SELECT 'tasks' AS section, kind || ' ' || state AS key, count(*) AS n FROM k GROUP BY kind, state UNION ALL SELECT 'parked', error_class, count(*) FROM k WHERE state = 'parked' GROUP BY 2
UNION ALL SELECT 'open joins', 'groups', count(DISTINCT group_id) FROM m UNION ALL SELECT 'open joins', 'waiting', count(*) - count(state) FROM m
UNION ALL SELECT 'items', o_orderstatus, count(*) FROM orders GROUP BY 2 UNION ALL SELECT * FROM (SELECT 'events', 'user.' || event_type, event_id FROM events ORDER BY event_id DESC LIMIT 10)""")
def status_report(spark, d):
    """The whole status in one table; every seventh group has fired."""
    roster = members(spark, d)
    items = t(spark, d, "orders").select(F.col("o_orderstatus").alias("state"))
    return reports.status(classed(spark, d), roster, roster.where("group_id % 7 = 0").select("group_id").distinct(), items, events(spark, d).select("event_id", "name"))


@query(f"""WITH {TASKS_SQL}, {CLASSED_SQL}, u AS (SELECT k.*, user_id AS thread FROM k JOIN events ON event_id = k.id),
p AS (SELECT l_orderkey AS id, count(DISTINCT CASE WHEN l_returnflag <> 'N' THEN l_linenumber END) AS done, count(DISTINCT l_linenumber) AS total FROM lineitem GROUP BY 1),
l AS (SELECT thread, string_agg(kind || ':' || state, ' ' ORDER BY kind || ':' || state) AS kinds FROM (SELECT thread, kind, arg_max(state, id) AS state FROM u GROUP BY ALL) GROUP BY 1),
c AS (SELECT thread, count(*) AS tasks, max(id) AS newest, coalesce(sum(done), 0)::BIGINT AS done, coalesce(sum(total), 0)::BIGINT AS total, min(CASE WHEN id % 9 = 0 THEN 'question ' || id END) AS asks,
 CASE WHEN bool_or(state = 'parked' AND error_class = 'awaiting_human') THEN 'needs-human' WHEN bool_or(state IN ('running', 'retry_wait')) THEN 'running' WHEN bool_or(state = 'failed') THEN 'failed' WHEN bool_or(state = 'parked') THEN 'parked' WHEN bool_and(state = 'done') THEN 'complete' ELSE 'queued' END AS chip
 FROM u LEFT JOIN p USING (id) GROUP BY thread)
SELECT thread, tasks, kinds, done, total, asks, chip, newest FROM c JOIN l USING (thread)""")
def run_cards(spark, d):
    """Users as runs: their tasks, steps from line items, and a question that every ninth task asks."""
    rows = classed(spark, d).join(events(spark, d).select(F.col("event_id").alias("id"), F.col("user_id").alias("thread")), "id")
    flag = F.col("l_returnflag")
    steps = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.countDistinct(F.when(flag != "N", F.col("l_linenumber"))).alias("done"), F.countDistinct("l_linenumber").alias("total"))
    asks = rows.where("id % 9 = 0").select("id", F.concat(F.lit("question "), F.col("id").cast("string")).alias("title"))
    return reports.run_cards(rows.select("thread", "id", "kind", "state", "error_class"), steps, asks)


@query("""SELECT event_id AS id, 'mail' AS name, 'user.' || event_type || ' ' || event_id || ' of ' || user_id || chr(10) AS out FROM events WHERE event_type = 'signup'
UNION ALL SELECT event_id, 'page', json_extract_string(props, '$.k') || chr(10) FROM events WHERE event_type = 'purchase'""")
def notify_matching(spark, d):
    """Every event is told to the commands whose pattern it matches, with its payload in their words."""
    rows = events(spark, d).select(F.col("event_id").alias("id"), "name", "payload")
    rules = [("mail", "*.signup", ["echo", "{event.name} {event.id} of {payload.user_id}"]), ("page", "user.p*ch*", ["echo", "{payload.props.k}"])]
    return blocks.run_commands(blocks.notifications(rows, rules)).select("id", "name", "out")
