"""Queries of steps, barriers, ledger effects and selection channels over the star-schema tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks as ck
from ..functions import text as tx
from ..functions import vectors as vx
from ..operators import blocks
from ..operators import channels as ch
from ..operators import queue as qu
from ..operators import ranking as rk
from ..operators import selection as sel
from ..operators import steps as st
from ..sources.ledger import Ledger, shared_folder
from .ledger_views import STATE_SQL, SUBS_SQL, TASKS_SQL, events, stated, subscriptions
from .retrieval import FEATURES, LEX, PRIOR, _flat, asked, corpus, t

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@query("SELECT event_id, 'user.' || event_type AS name FROM events WHERE event_id > 5000")
def event_tail(spark, d):
    return st.tail(events(spark, d), 5000).select("event_id", "name")


@query("SELECT o_orderstatus AS state, count(*) AS n FROM orders GROUP BY 1")
def items_by_state(spark, d):
    return t(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("state")).agg(F.count(F.lit(1)).alias("n"))


CLASS_SQL = "CASE id % 3 WHEN 0 THEN 'agent_limit' WHEN 1 THEN 'forge_auth' ELSE 'awaiting_human' END"


def classed(spark, d):
    m = F.col("id") % 3
    return stated(spark, d).withColumn("error_class", F.when(m == 0, "agent_limit").when(m == 1, "forge_auth").otherwise("awaiting_human")).withColumn("attempts", (F.col("id") % 4).cast("int"))


@query(f"WITH {TASKS_SQL} SELECT {CLASS_SQL} AS error_class, count(*) AS n FROM tasks WHERE {STATE_SQL} = 'parked' GROUP BY 1 ORDER BY n DESC, 1")
def parked_by_class(spark, d):
    rows = classed(spark, d).where("state = 'parked'")
    return rows.groupBy("error_class").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "error_class")


@query(f"""WITH {TASKS_SQL}, s AS (SELECT {STATE_SQL} AS state FROM tasks)
SELECT count(*) FILTER (WHERE state = 'pending') AS pending, count(*) FILTER (WHERE state = 'parked') AS parked,
 round(100.0 * count(*) FILTER (WHERE state = 'failed') / greatest(1, count(*) FILTER (WHERE state IN ('done', 'failed', 'parked'))), 6) AS failed_pct,
 round(100.0 * count(*) FILTER (WHERE state = 'parked') / greatest(1, count(*) FILTER (WHERE state IN ('done', 'failed', 'parked'))), 6) AS parked_pct FROM s""")
def status_shares(spark, d):
    n = {s: F.coalesce(F.sum((F.col("state") == s).cast("bigint")), F.lit(0)) for s in ("pending", "done", "failed", "parked")}
    ended = F.greatest(F.lit(1), n["done"] + n["failed"] + n["parked"])
    return stated(spark, d).agg(n["pending"].alias("pending"), n["parked"].alias("parked"), F.round(100.0 * n["failed"] / ended, 6).alias("failed_pct"), F.round(100.0 * n["parked"] / ended, 6).alias("parked_pct"))


@query("""SELECT l_orderkey AS run_order, l_linenumber AS run_line, o_orderpriority AS task_priority FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON o_orderkey = l_orderkey
ORDER BY l_shipdate DESC, l_orderkey, l_linenumber LIMIT 20""")
def recent_runs(spark, d):
    """The last twenty runs with their task, if it is a finished one."""
    last = t(spark, d, "lineitem").orderBy(F.desc("l_shipdate"), "l_orderkey", "l_linenumber").limit(20)
    tasks = t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("task_priority"))
    return last.join(tasks, "l_orderkey", "left").select(F.col("l_orderkey").alias("run_order"), F.col("l_linenumber").alias("run_line"), "task_priority")


RECENT_SQL = "SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n FROM events) WHERE n <= 10"


@query(RECENT_SQL)
def recent_events(spark, d):
    """The last ten events of each name; each task keeps ten of a name before they are dealt."""
    from pyspark.sql import Window

    turn = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("event_id")))
    return t(spark, d, "events").select("event_id", "event_type").withColumn("n", turn).where("n <= 10").drop("n")


@query(RECENT_SQL)
def recent_by_name(spark, d):
    """The last ten events by name, as recent_events gives them."""
    return recent_events(spark, d)


ITEMS_SQL = "json_extract_string(props, '$.k')::BIGINT % 4"


def parents(spark, d):
    return events(spark, d).select(F.col("event_id").alias("id"), F.col("name").alias("event"), (F.get_json_object("props", "$.k").cast("bigint") % 4).alias("n"))


@query(f"""WITH {SUBS_SQL}, c AS (SELECT event, count(*) AS n FROM subs GROUP BY event)
SELECT event_id AS id, {ITEMS_SQL} AS items, coalesce(c.n, 0) AS consumers, {ITEMS_SQL} * coalesce(c.n, 0) AS expected FROM events LEFT JOIN c ON c.event = 'user.' || event_type""")
def fanout_expected(spark, d):
    return st.expected(parents(spark, d), subscriptions(spark)).select("id", F.col("n").alias("items"), "consumers", "expected")


RECORDED_SQL = "SELECT l_orderkey AS task_id, (l_linenumber + CASE WHEN l_orderkey % 5 = 0 THEN 1 ELSE 0 END)::BIGINT AS step FROM lineitem"


@query(f"""WITH r AS (SELECT DISTINCT * FROM ({RECORDED_SQL}) WHERE step BETWEEN 1 AND 7),
p AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY step) AS place FROM r),
f AS (SELECT task_id, sum((step <> 3)::INT)::BIGINT AS replayed, max(step) + 1 AS next_step FROM p WHERE place = step GROUP BY task_id)
SELECT DISTINCT l_orderkey AS task_id, coalesce(replayed, 0) AS replayed, coalesce(next_step, 1) AS next_step FROM lineitem LEFT JOIN f ON f.task_id = l_orderkey""")
def resume_steps(spark, d):
    """Line items as recorded steps; every fifth task lost its first; step 3 is run afresh."""
    late = F.when(F.col("l_orderkey") % 5 == 0, 1).otherwise(0)
    recorded = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("task_id"), (F.col("l_linenumber") + late).cast("bigint").alias("step"))
    return st.frontier(recorded, 7, (3,))


@query("""SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS visit, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) > 2 AS exhausted FROM conversations""")
def visit_counts(spark, d):
    return st.visits(t(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id", "role"], "turn", 2)


@query(f"WITH {TASKS_SQL} SELECT id, kind, 'pending' AS state, (id % 4 + 1)::INT AS attempts FROM tasks WHERE {STATE_SQL} = 'failed'")
def retry_failed(spark, d):
    return st.retried(classed(spark, d)).select("id", "kind", "state", "attempts")


@query("""WITH m AS (SELECT l_orderkey AS group_id, l_linenumber AS task_id, CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'done' END AS state FROM lineitem),
fired AS (SELECT group_id FROM m GROUP BY group_id HAVING count(state) = count(*) AND group_id % 2 = 0)
SELECT group_id, task_id FROM m WHERE state = 'failed' AND group_id NOT IN (SELECT group_id FROM fired)""")
def reopen_joins(spark, d):
    flag = F.col("l_returnflag")
    m = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.col("l_linenumber").alias("task_id"), F.when(flag == "R", "failed").when(flag == "A", "done").alias("state"))
    fired = m.groupBy("group_id").agg(F.count("state").alias("ended"), F.count(F.lit(1)).alias("n")).where("ended = n AND group_id % 2 = 0")
    return st.reopened(m, fired).select("group_id", "task_id")


@query(f"WITH {TASKS_SQL} SELECT id, kind, (id % 4 + 1)::INT AS attempts FROM tasks WHERE {STATE_SQL} = 'parked' AND {CLASS_SQL} IN ('agent_limit', 'forge_auth')")
def unpark_tasks(spark, d):
    return st.unparked(classed(spark, d), ("agent_limit", "forge_auth")).select("id", "kind", "attempts")


@query(f"WITH {TASKS_SQL}, s AS (SELECT id, kind, CASE WHEN id % 7 = 0 THEN 'running' ELSE {STATE_SQL} END AS state FROM tasks) SELECT CASE WHEN state = 'running' THEN 'pending' ELSE state END AS state, count(*) AS n FROM s GROUP BY 1")
def orphan_reset(spark, d):
    rows = stated(spark, d).withColumn("state", F.when(F.col("id") % 7 == 0, "running").otherwise(F.col("state")))
    return st.reset_orphans(rows).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


ALLOWED = [("O", "P"), ("P", "F"), ("O", "F")]


@query(f"""WITH e(from_state, to_state) AS (VALUES {', '.join(map(str, ALLOWED))}),
m AS (SELECT o_orderkey AS id, o_custkey AS key, o_orderstatus AS to_state, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS from_state FROM orders)
SELECT id, key, m.from_state, m.to_state, 'item.' || lower(m.to_state) AS event FROM m JOIN e USING (from_state, to_state)""")
def transition_audit(spark, d):
    """A customer's orders as moves of one item: legal ones are audited and told."""
    from pyspark.sql import Window

    before = F.lag("o_orderstatus").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    moves = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"), before.alias("from_state"), F.col("o_orderstatus").alias("to_state"))
    allowed = spark.createDataFrame(ALLOWED, "from_state string, to_state string")
    return st.audited(qu.transitions(moves, allowed))


@query(f"WITH {TASKS_SQL} SELECT id, CASE WHEN id % 4 IN (0, 1, 2) THEN ['done', 'deferred', 'parked'][id % 4 + 1] WHEN id % 3 = 0 THEN 'policy' ELSE 'failed' END AS effect FROM tasks")
def terminal_effects(spark, d):
    target = F.element_at(F.array(*map(F.lit, ("done", "deferred", "parked", "failed"))), (F.col("id") % 4 + 1).cast("int"))
    error = F.when(F.col("id") % 3 == 0, "timeout").when(F.col("id") % 3 == 1, "unheard_of")
    return stated(spark, d).select("id", qu.terminal_effect(target, error, error == "timeout").alias("effect"))


@query("""SELECT l_orderkey AS task_id, count(DISTINCT CASE WHEN l_returnflag <> 'N' THEN l_linenumber END) AS done, count(DISTINCT l_linenumber) AS total, max(l_linenumber)::BIGINT AS last_step,
 (max({'s': l_linenumber, 'o': l_returnflag}) FILTER (WHERE l_returnflag <> 'N')).o AS last_outcome,
 CASE WHEN bool_or(l_returnflag = 'R') THEN 'R' WHEN bool_or(l_returnflag = 'A') THEN 'A' END AS worst FROM lineitem GROUP BY 1""")
def step_progress(spark, d):
    flag = F.col("l_returnflag")
    rows = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("step"), F.when(flag != "N", flag).alias("outcome"))
    return st.progress(rows, ["R", "A"])


@query("""SELECT lang AS scope, CAST(doc_id AS VARCHAR) AS key, strlen(text)::BIGINT AS bytes, sha256(text) AS sha, sum(strlen(text)) OVER (PARTITION BY lang ORDER BY CAST(doc_id AS VARCHAR))::BIGINT AS used,
 sum(strlen(text)) OVER (PARTITION BY lang)::BIGINT AS total, sum(strlen(text)) OVER (PARTITION BY lang ORDER BY CAST(doc_id AS VARCHAR)) > 100000 AS over FROM documents""")
def context_manifest(spark, d):
    return st.manifest(corpus(spark, d).select(F.col("lang").alias("scope"), "key", "text"), 100_000).select("scope", "key", "bytes", "sha", "used", "total", F.col("over"))


@query("""WITH r AS (SELECT sha256(text) AS prompt_sha, max(conv_id * 1000 + turn) AS run_id FROM conversations WHERE role <> 'user' GROUP BY 1)
SELECT conv_id * 1000 + turn AS id, sha256(text) AS prompt_sha, run_id FROM conversations LEFT JOIN r ON r.prompt_sha = sha256(text)""")
def replay_lookup(spark, d):
    rows = t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.sha2("text", 256).alias("prompt_sha"), "role")
    runs = rows.where("role <> 'user'").select("prompt_sha", F.col("id").alias("run_id"))
    return st.latest_run(runs, rows.select("id", "prompt_sha")).select("id", "prompt_sha", "run_id")


OBJECTS_SQL = "SELECT p_partkey AS object_id, p_brand AS path, CASE WHEN p_size % 2 = 0 THEN p_type END AS symbol FROM part"


@query(f"""WITH p AS ({OBJECTS_SQL}), o AS (SELECT path, symbol, min(object_id) AS object_id FROM p WHERE object_id % 3 = 0 GROUP BY ALL)
SELECT p.object_id AS asked, o.object_id FROM p LEFT JOIN o ON o.path = p.path AND o.symbol IS NOT DISTINCT FROM p.symbol""")
def symbol_lookup(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").alias("object_id"), F.col("p_brand").alias("path"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("symbol"))
    return st.lookup(p.withColumnRenamed("object_id", "asked"), p.where("object_id % 3 = 0")).select("asked", "object_id")


VEC_SQL = "SELECT vec_id % 100 AS object_id, CASE WHEN label % 2 = 0 THEN 'm0' ELSE 'm1' END AS model_sha, vec_id AS seq FROM embeddings"


@query(f"""WITH v AS ({VEC_SQL}) SELECT object_id, model_sha, coalesce(max(seq) FILTER (WHERE seq >= 200), max(seq)) AS seq FROM v GROUP BY ALL""")
def store_embeddings(spark, d):
    """Vectors 0 to 199 are kept (the last of each object and model), the others come as a batch."""
    v = t(spark, d, "embeddings").select((F.col("vec_id") % 100).alias("object_id"), F.when(F.col("label") % 2 == 0, "m0").otherwise("m1").alias("model_sha"), F.col("vec_id").alias("seq"), F.col("embedding").alias("vec"))
    kept = ch.store_vectors(v.where("seq < 200"), v.where("false"))
    return ch.store_vectors(v.where("seq >= 200"), kept).select("object_id", "model_sha", "seq")


@query(f"""WITH v AS ({VEC_SQL}), o AS (SELECT p_partkey AS object_id, p_name AS path FROM part)
SELECT v.seq, o.path FROM v JOIN o USING (object_id) WHERE v.model_sha = 'm1'""")
def embedding_objects(spark, d):
    v = t(spark, d, "embeddings").select((F.col("vec_id") % 100).alias("object_id"), (F.col("label") % 2).alias("m"), F.col("vec_id").alias("seq")).where("m = 1")
    return v.join(t(spark, d, "part").select(F.col("p_partkey").alias("object_id"), F.col("p_name").alias("path")), "object_id").select("seq", "path")


@query("""WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT vec_id, round(sqrt(sum(x * x)), 6) AS size, round(sqrt(sum((x / n) * (x / n))), 6) AS unit_size FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS n FROM e) GROUP BY vec_id""")
def unit_vectors(spark, d):
    v = t(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return v.select("vec_id", F.round(vx.norm(F.col("v")), 6).alias("size"), F.round(vx.norm(vx.unit(F.col("v"))), 6).alias("unit_size"))


@query("SELECT event_id, user_id || '/' || event_type || '#' || json_extract_string(props, '$.k') AS title FROM events")
def template_titles(spark, d):
    return events(spark, d).select("event_id", tx.template("{user_id}/{event_type}#{props.k}", F.col("payload")).alias("title"))


@query("""SELECT o_orderkey, CASE WHEN a < 90 THEN a || 's' WHEN a < 5400 THEN (a // 60) || 'm' WHEN a < 172800 THEN (a // 3600) || 'h' ELSE (a // 86400) || 'd' END AS age
FROM (SELECT o_orderkey, (o_orderkey * 7919) % 400000 AS a FROM orders)""")
def compact_ages(spark, d):
    return t(spark, d, "orders").select("o_orderkey", tx.age(F.col("o_orderkey") * 7919 % 400000).alias("age"))


@query("""SELECT event_id, CASE WHEN s IN (401, 403, 429) THEN 'agent_limit' WHEN s < 200 OR s >= 300 THEN 'agent_backend' END AS by_status,
 CASE WHEN s % 3 = 0 THEN NULL WHEN s % 5 = 0 THEN 'agent_limit' ELSE 'agent_backend' END AS by_exit FROM (SELECT event_id, 190 + (event_id * 37) % 260 AS s FROM events)""")
def backend_errors(spark, d):
    s = F.lit(190) + F.col("event_id") * 37 % 260
    return t(spark, d, "events").select("event_id", tx.backend_error(s).alias("by_status"), ck.exit_error(s % 3, s % 5).alias("by_exit"))


@query(f"""SELECT p_partkey, regexp_matches(p_brand, '{ck.IDENTIFIER}') AS brand_ok, regexp_matches(lower(replace(p_type, ' ', '.')), '{ck.EVENT_NAME}') AS event_ok, regexp_matches(lower(p_name), '{ck.CLASS_NAME}') AS class_ok FROM part""")
def name_checks(spark, d):
    return t(spark, d, "part").select("p_partkey", ck.is_identifier(F.col("p_brand")).alias("brand_ok"), ck.is_event_name(F.lower(F.replace("p_type", F.lit(" "), F.lit(".")))).alias("event_ok"), ck.is_class_name(F.lower("p_name")).alias("class_ok"))


@query("""SELECT event_id FROM events WHERE props LIKE '%"k": 7%' OR props LIKE '%"k":7%'""")
def payload_like(spark, d):
    return t(spark, d, "events").where(F.col("props").contains('"k": 7') | F.col("props").contains('"k":7')).select("event_id")


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'""")
def equal_filter(spark, d):
    return st.where_equal(t(spark, d, "orders"), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}).select("o_orderkey")


@query("""SELECT a.page_id, count(b.page_id) - 1 AS twins FROM pages a JOIN pages b ON sha256(coalesce(a.html, '')) = sha256(coalesce(b.html, '')) GROUP BY 1""")
def same_files(spark, d):
    sha = F.sha2(F.coalesce("html", F.lit("")), 256)
    pages = t(spark, d, "pages").select("page_id", sha.alias("sha"))
    return pages.join(pages.groupBy("sha").agg((F.count(F.lit(1)) - 1).alias("twins")), "sha").select("page_id", "twins")


@query("""WITH s AS (SELECT CAST(doc_id AS VARCHAR) AS key, text, doc_id % 2 = 0 AND doc_id % 3 <> 0 AS kept FROM documents)
SELECT key, CASE WHEN length(text) > 200 AND kept THEN 'about ' || key ELSE substr(text, 1, 200) END AS display, length(text) > 200 AND kept AS summarized, length(text) > 200 AND NOT kept AS truncated FROM s""")
def display_summary(spark, d):
    """Every second text has a kept summary; every third has changed since."""
    docs = corpus(spark, d).select("key", "text")
    number = F.col("key").cast("bigint")
    old = F.when(number % 3 == 0, F.concat("text", F.lit(" before"))).otherwise(F.col("text"))
    kept = docs.where(number % 2 == 0).select("key", F.sha2(old, 256).alias("text_sha"), F.concat(F.lit("about "), "key").alias("summary"))
    return ch.shown(docs, kept, 200).select("key", "display", "summarized", "truncated")


@query("""SELECT DISTINCT l_orderkey AS task_id, CAST(l_partkey AS VARCHAR) AS key FROM lineitem WHERE (l_orderkey, l_partkey) NOT IN (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber = 1)""")
def context_uses(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_partkey").cast("string").alias("key"), "l_linenumber")
    return ch.record_uses(rows, rows.where("l_linenumber = 1"))


@query("""WITH u AS (SELECT CAST(l_partkey AS VARCHAR) AS key, o_orderstatus AS s FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus IN ('F', 'P'))
SELECT key, round((sum((s = 'F')::INT) + 1.0) / (count(*) + 2.0), 6) AS utility FROM u GROUP BY key""")
def utility_scores(spark, d):
    """Uses joined to their tasks, those that ended only."""
    ended = t(spark, d, "orders").where(F.col("o_orderstatus").isin("F", "P")).select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("failed").alias("state"))
    uses = t(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").cast("string").alias("key")).join(ended, "l_orderkey")
    return sel.utility(uses).select("key", F.round("utility", 6).alias("utility"))


@query("SELECT event_id, 'user.' || event_type AS name FROM events WHERE event_id % 4 <> 3")
def staged_commit(spark, d):
    """Three steps are committed, one of them twice as after a crash; a fourth is staged and its manifest never written."""
    ledger, rows = Ledger(spark, shared_folder(spark, "ledger")), events(spark, d).select("event_id", "name")
    for step in (0, 1, 2, 1):
        ledger.commit(f"step-{step}", {"events": rows.where(F.col("event_id") % 4 == step)})
    ledger.stage("step-3", {"events": rows.where("event_id % 4 = 3")})
    return ledger.table("events", "event_id bigint, name string")


SEMANTIC = f"""
{FEATURES.format('documents')}, dv AS (SELECT CAST(doc_id AS VARCHAR) AS key, slot, weight FROM v),
{FEATURES.format('(SELECT item_id AS doc_id, text FROM benchmark)').replace('w AS (', 'w2 AS (').replace('f AS (', 'f2 AS (').replace('h AS (', 'h2 AS (').replace('v AS (', 'v2 AS (').replace('FROM w ', 'FROM w2 ').replace('FROM f)', 'FROM f2)').replace('FROM h ', 'FROM h2 ')},
qv AS (SELECT doc_id AS q, slot, weight FROM v2),
dn AS (SELECT key, sqrt(sum(weight * weight)) AS n FROM dv GROUP BY key), qn AS (SELECT q, sqrt(sum(weight * weight)) AS n FROM qv GROUP BY q),
dots AS (SELECT q, key, sum(dv.weight * qv.weight) AS x FROM dv JOIN qv USING (slot) GROUP BY ALL),
sem AS (SELECT b.item_id AS q, CAST(d.doc_id AS VARCHAR) AS key, round(coalesce(x / nullif(dn.n * qn.n, 0), 0), 6) AS semantic FROM benchmark b CROSS JOIN documents d
 LEFT JOIN dots ON dots.q = b.item_id AND dots.key = CAST(d.doc_id AS VARCHAR) LEFT JOIN dn ON dn.key = CAST(d.doc_id AS VARCHAR) LEFT JOIN qn ON qn.q = b.item_id)"""


def semantic_pairs(spark, d):
    docs = corpus(spark, d)
    queries = asked(spark, d).select(F.col("q").cast("bigint").alias("q"), "text")
    return docs, queries, ch.cosine_scores(ch.dense_vectors(docs, "key"), ch.dense_vectors(queries, "q"))


@query(f"WITH {SEMANTIC}, p AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY semantic DESC, key) AS place FROM sem) SELECT q, key, semantic AS score, place FROM p WHERE place <= 5")
def semantic_top5(spark, d):
    """Hashed vectors of every document against every benchmark text; a task keeps its five best a query."""
    return rk.nearest_texts(corpus(spark, d), asked(spark, d), 5)


@query("""WITH r AS (SELECT o_orderkey AS key, rank() OVER (ORDER BY o_orderdate DESC) + (count(*) OVER (PARTITION BY o_orderdate) - 1) / 2.0 AS rank FROM orders)
SELECT key, round(0.3 / (60 + rank), 9) AS vote FROM r""")
def recency_rank(spark, d):
    rows = t(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("ts"))
    return sel.fractional_rank(rows, "ts").select("key", F.round(sel.vote(F.col("rank"), 0.3), 9).alias("vote"))


FULL = f"""WITH {LEX.format(where='').strip()}, {PRIOR.strip()}, {SEMANTIC.strip()},
re AS (SELECT key, rank() OVER (ORDER BY ts DESC) + (count(*) OVER (PARTITION BY ts) - 1) / 2.0 AS r FROM (SELECT key, CAST(key AS BIGINT) * 7919 % 365 AS ts FROM d)),
sr AS (SELECT *, rank() OVER (PARTITION BY q ORDER BY semantic DESC) + (count(*) OVER (PARTITION BY q, semantic) - 1) / 2.0 AS r, min(semantic) OVER (PARTITION BY q) < max(semantic) OVER (PARTITION BY q) AS votes FROM sem),
fu AS (SELECT lr.q, lr.key, round(CASE WHEN lr.votes THEN 1.0 / (60 + lr.r) ELSE 0 END + CASE WHEN sr.votes THEN 1.0 / (60 + sr.r) ELSE 0 END + 0.3 / (60 + pr.r) + 0.3 / (60 + re.r), 6) AS score, lr.r AS lexical_rank, sr.r AS semantic_rank
 FROM lr JOIN sr ON sr.q = lr.q AND sr.key = lr.key JOIN pr ON pr.key = lr.key JOIN re ON re.key = lr.key),
pl AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, key) AS place FROM fu)"""


def full_pairs(spark, d):
    docs, queries, pairs = semantic_pairs(spark, d)
    hits = sel.lexical_hits(docs, queries)
    pairs = pairs.join(hits, ["q", "key"], "left").withColumn("lexical", F.coalesce("hits", F.lit(0))).drop("hits")
    static = sel.static_votes(docs.withColumn("recency", F.col("key").cast("bigint") * 7919 % 365), {"n_chars": 0.3, "recency": 0.3})
    return ch.fuse(pairs, {"lexical": 1.0, "semantic": 1.0}, static)


@query(f"{FULL} SELECT q, key, score, round(lexical_rank, 1) AS lexical_rank, round(semantic_rank, 1) AS semantic_rank, place FROM pl WHERE place <= 5")
def full_rrf_top5(spark, d):
    """Lexical and semantic channels of their own for each query, prior and recency for all, fused."""
    docs = corpus(spark, d)
    static = sel.static_votes(docs.withColumn("recency", F.col("key").cast("bigint") * 7919 % 365), {"n_chars": 0.3, "recency": 0.3})
    pool = docs.select("key", "text").join(static, "key").withColumn("copies", F.lit(1).cast("bigint"))
    best = rk.fused(pool, asked(spark, d), 5, {"lexical": 1.0, "semantic": 1.0})
    return best.select("q", "key", "score", F.round("lexical_rank", 1).alias("lexical_rank"), F.round("semantic_rank", 1).alias("semantic_rank"), "place")


@query(f"{FULL} SELECT key, round(min(lexical_rank), 1) AS lexical, round(min(semantic_rank), 1) AS semantic FROM fu GROUP BY key")
def channel_best_ranks(spark, d):
    """Each document's best rank in either channel over all queries."""
    best = rk.best_ranks(corpus(spark, d), asked(spark, d))
    return best.select("key", F.round("lexical", 1).alias("lexical"), F.round("semantic", 1).alias("semantic"))


@query("WITH " + LEX.format(where="") + """, sc AS (SELECT q, key, round(CASE WHEN votes THEN 1.0 / (60 + r) ELSE 0 END, 6) AS score FROM lr),
 pl AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, key) AS place FROM sc), th AS (SELECT * FROM pl WHERE place <= 30),
 ju AS (SELECT *, CASE WHEN CAST(key AS BIGINT) % 4 = 0 OR q % 5 = 0 THEN -1 ELSE least(10, CAST(key AS BIGINT) % 12) END AS judge FROM th),
 wi AS (SELECT *, place <= 20 AND max(judge) OVER (PARTITION BY q) >= 0 AS reranked FROM ju)
 SELECT q, key, reranked, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN reranked THEN 0 ELSE 1 END, CASE WHEN reranked THEN -judge ELSE place END, score DESC, key) AS place FROM wi""")
def rerank_window(spark, d):
    """Judgements of the best twenty; a fourth of them are missing, and every fifth query has none."""
    docs = corpus(spark, d)
    best = rk.lexical_top(docs, asked(spark, d), _flat(docs), k=30)
    number = F.col("key").cast("bigint")
    judged = best.where((number % 4 != 0) & (F.col("q") % 5 != 0)).select("q", "key", (number % 12).alias("judge"))
    return ch.rerank(best, judged, 20).select("q", "key", "reranked", "place")


@query("""WITH s AS (SELECT 'events' AS what, count(*) AS n FROM events UNION ALL SELECT 'items', count(*) FROM orders UNION ALL SELECT 'items open', count(*) FROM orders WHERE o_orderstatus <> 'F'
 UNION ALL SELECT 'runs', count(*) FROM lineitem UNION ALL SELECT 'runs without verdict', count(*) FROM lineitem WHERE l_returnflag = 'N') SELECT * FROM s""")
def status_overview(spark, d):
    count = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    orders, runs = t(spark, d, "orders"), t(spark, d, "lineitem")
    parts = [count(t(spark, d, "events"), "events"), count(orders, "items"), count(orders.where("o_orderstatus <> 'F'"), "items open"), count(runs, "runs"), count(runs.where("l_returnflag = 'N'"), "runs without verdict")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"""WITH {TASKS_SQL}, s AS (SELECT {STATE_SQL.replace('id %', 't.id %')} AS state, e.user_id AS thread, t.id FROM tasks t JOIN ev e ON e.event_id = t.id)
SELECT thread, count(*) AS tasks, CASE WHEN bool_or(state = 'parked' AND id % 3 = 2) THEN 'needs-human' WHEN bool_or(state = 'retry_wait') THEN 'running' WHEN bool_or(state = 'failed') THEN 'failed'
 WHEN bool_or(state = 'parked') THEN 'parked' WHEN bool_and(state = 'done') THEN 'complete' ELSE 'queued' END AS chip FROM s GROUP BY thread""")
def run_chips(spark, d):
    """Runs by the whole ladder; parked for a human counts first."""
    rows = classed(spark, d).join(events(spark, d).select(F.col("event_id").alias("id"), F.col("user_id").alias("thread")), "id")
    any_ = lambda c: F.bool_or(c)
    state = F.col("state")
    ladder = {
        "needs-human": any_((state == "parked") & (F.col("error_class") == "awaiting_human")),
        "running": any_(state == "retry_wait"),
        "failed": any_(state == "failed"),
        "parked": any_(state == "parked"),
        "complete": F.bool_and(state == "done"),
    }
    return rows.groupBy("thread").agg(F.count(F.lit(1)).alias("tasks"), st.chip(ladder).alias("chip"))


@blocks.block("demo.triage", ("high", "low", "skip"))
def triage(payload: dict, params: dict) -> tuple[str, dict]:
    """A demonstration block: clicks are skipped, every ninth error fails."""
    k = payload["props"]["k"]
    if payload["event_type"] == "error" and k % 9 == 0:
        raise ValueError("odd")
    if payload["event_type"] == "click":
        return "skip", {}
    return ("high" if k >= params["least"] else "low"), {"k": k}


@query("""SELECT event_id AS id, CASE WHEN event_type = 'error' AND k % 9 = 0 THEN 'failed' WHEN event_type = 'click' THEN 'skip' WHEN k >= 5 THEN 'high' ELSE 'low' END AS outcome,
 CASE WHEN event_type = 'error' AND k % 9 = 0 THEN '{"error": "odd"}' WHEN event_type = 'click' THEN '{}' ELSE '{"k":' || k || '}' END AS result,
 CASE WHEN event_type = 'error' AND k % 9 = 0 THEN 'framework_bug' END AS error_class FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events)""")
def run_blocks(spark, d):
    return blocks.run_block(events(spark, d).select(F.col("event_id").alias("id"), "payload"), "demo.triage", {"least": 5})


def stub_backend(prompt: str, ask: int) -> str:
    """A backend for demonstrations: its first answer is bare, later ones are JSON unless the prompt is too short."""
    if not prompt:
        raise ConnectionError("nothing to send")
    return "ok" if ask == 1 and len(prompt) % 3 else ("?" if len(prompt) < 60 else '{"ok": true}')


def json_check(answer: str) -> str | None:
    return None if answer.startswith("{") else "Answer in JSON."


@query("""SELECT conv_id * 1000 + turn AS id, CASE WHEN n >= 60 AND n % 3 = 0 THEN 1 WHEN n + 17 >= 60 THEN 2 ELSE 3 END::INT AS asked,
 CASE WHEN n + 17 >= 60 THEN NULL ELSE 'agent_invalid_output' END AS error_class FROM (SELECT *, length(text) AS n FROM conversations)""")
def agent_runs(spark, d):
    """Conversation turns as prompts: a bare answer is asked for again with what was wrong."""
    rows = t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("prompt"))
    return blocks.run_agent(rows, stub_backend, json_check).select("id", "asked", "error_class")


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN NULL WHEN turn % 3 = 1 THEN role ELSE '{"text": "' || role || '"}' END AS body
FROM conversations""")
def envelopes(spark, d):
    wrapped = F.when(F.col("turn") % 3 == 0, F.concat(F.lit('{"is_error": true, "result": "'), "role", F.lit('"}'))).when(F.col("turn") % 3 == 1, F.concat(F.lit('{"result": "'), "role", F.lit('"}'))).otherwise(F.concat(F.lit('{"text": "'), "role", F.lit('"}')))
    return t(spark, d, "conversations").select("conv_id", "turn", tx.envelope(wrapped).alias("body"))


@query(r"""WITH l AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '# ' WHEN 1 THEN '- ' ELSE '' END || 'a < **' || role || '** & `' || turn || '`' AS line FROM conversations),
e AS (SELECT conv_id, turn, regexp_replace(regexp_replace(replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\*\*([^*]+)\*\*', '<b>\1</b>', 'g'), '`([^`]+)`', '<code>\1</code>', 'g') AS x FROM l)
SELECT conv_id, turn, CASE WHEN x LIKE '# %' THEN '<h1>' || substr(x, 3) || '</h1>' WHEN x LIKE '- %' THEN '<li>' || substr(x, 3) || '</li>' ELSE '<p>' || x || '</p>' END AS html FROM e""")
def markdown_html(spark, d):
    mark = F.when(F.col("turn") % 3 == 0, "# ").when(F.col("turn") % 3 == 1, "- ").otherwise("")
    line = F.concat(mark, F.lit("a < **"), "role", F.lit("** & `"), F.col("turn").cast("string"), F.lit("`"))
    return t(spark, d, "conversations").select("conv_id", "turn", tx.markdown_line(line).alias("html"))


@query(f"WITH {TASKS_SQL} SELECT id FROM tasks WHERE {STATE_SQL} = 'parked' AND {CLASS_SQL} = 'awaiting_human' AND id % 2 = 0")
def resume_decisions(spark, d):
    rows = classed(spark, d)
    return st.resumed(rows, rows.where("id % 2 = 0")).select("id")


@query("""SELECT l_orderkey AS task_id, l_suppkey % 2 AS attempt, l_linenumber % 3 AS step, max(l_partkey * 10 + l_linenumber) AS seq FROM lineitem GROUP BY ALL""")
def step_writes(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("task_id"), (F.col("l_suppkey") % 2).alias("attempt"), (F.col("l_linenumber") % 3).alias("step"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_returnflag").alias("outcome"))
    return st.last_writes(rows).select("task_id", "attempt", "step", "seq")


@query("""WITH vocab AS (SELECT p_brand AS token, p_size AS a, p_partkey % 7 AS b FROM (SELECT lower(replace(p_brand, '#', '_')) AS p_brand, min(p_size)::DOUBLE AS p_size, min(p_partkey) AS p_partkey FROM part GROUP BY 1)),
x AS (SELECT p_partkey, lower(replace(p_brand, '#', '_')) AS t1, p_size % 5 AS k FROM part),
s AS (SELECT p_partkey, a * (1 + k) AS a, b * (1.0 + k) AS b FROM x JOIN vocab ON token = t1)
SELECT p_partkey, round(coalesce(a / nullif(sqrt(a * a + b * b), 0), 0), 6) AS a, round(coalesce(b / nullif(sqrt(a * a + b * b), 0), 0), 6) AS b FROM s""")
def weights_embed(spark, d):
    """Part brands as a vocabulary of vectors; a brand named several times counts as often."""
    part = t(spark, d, "part").select("p_partkey", F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))).alias("brand"), "p_size")
    vocab = part.groupBy(F.col("brand").alias("token")).agg(F.array(F.min("p_size").cast("double"), (F.min("p_partkey") % 7).cast("double")).alias("vec"))
    rows = part.select("p_partkey", F.array_join(F.array_repeat("brand", (F.col("p_size") % 5 + 1).cast("int")), " ").alias("text"))
    v = ch.weights_vectors(rows, "p_partkey", vocab)
    return v.select("p_partkey", F.round(F.col("v")[0], 6).alias("a"), F.round(F.col("v")[1], 6).alias("b"))
