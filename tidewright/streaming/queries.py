"""Streaming forms of enqueueing, barriers and schedules over the event tables, run until the input is used up."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import state

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def work_dir(spark: SparkSession) -> str:
    """Where checkpoints and results go: the shared folder, or a temporary one in a local session without it."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/streams/{uuid.uuid4().hex}"
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="tidewright-stream-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a streaming plan over all that is there now; the file sink and its log make a restart exactly once."""
    spark, at = stream.sparkSession, work_dir(stream.sparkSession)
    if mode == "append":
        done = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
        done.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{at}/out")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    done = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
    done.awaitTermination()
    # In complete mode each batch holds the whole state: the last one is the result.
    rows = spark.read.parquet(f"{at}/out")
    last = rows.agg(F.max("batch")).first()[0]
    return rows.where(F.col("batch") == last).drop("batch")


def source(spark: SparkSession, d: str, name: str) -> DataFrame:
    path = f"{d}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).format("parquet").option("pathGlobFilter", "*.parquet").load(path if d.startswith("viewfs") else f"{d}/{name}.parque[t]")


@query("SELECT user_id, event_type, props FROM events GROUP BY ALL")
def stream_dedup(spark, d):
    """Idempotent enqueueing of a stream: the first arrival of each payload passes."""
    rows = source(spark, d, "events").select("user_id", "event_type", "props")
    return drain(rows.dropDuplicates(["user_id", "event_type", "props"]))


@query("""SELECT floor(epoch(ts))::BIGINT - floor(epoch(ts))::BIGINT % 300 AS window_start, count(*) AS ticks FROM events GROUP BY 1""")
def stream_schedule(spark, d):
    """Tumbling windows over event time."""
    rows = source(spark, d, "events").select(F.col("ts").cast("timestamp").alias("at"))
    per = rows.groupBy(F.window("at", "300 seconds").alias("w")).agg(F.count(F.lit(1)).alias("ticks"))
    return drain(per.select(F.unix_seconds("w.start").alias("window_start"), "ticks"), "complete")


MEMBER_SQL = "CASE WHEN l_linestatus = 'O' THEN NULL WHEN l_returnflag = 'R' THEN 'failed' WHEN l_returnflag = 'A' THEN 'done' ELSE 'deferred' END"


def member_state():
    flag = F.col("l_returnflag")
    return F.when(F.col("l_linestatus") == "O", F.lit(None).cast("string")).when(flag == "R", "failed").when(flag == "A", "done").otherwise("deferred")


@query(f"""SELECT l_orderkey AS group_id, count(*) AS total, count(*) FILTER (WHERE s = 'done') AS done, count(*) FILTER (WHERE s = 'failed') AS failed, count(*) FILTER (WHERE s = 'deferred') AS deferred
FROM (SELECT *, {MEMBER_SQL} AS s FROM lineitem) GROUP BY 1 HAVING count(s) = count(*)""")
def stream_join_fire(spark, d):
    """Barriers fire once each, when their last member ends; the roster's size comes from a static table."""
    rows = source(spark, d, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.xxhash64("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate").alias("task_id"), member_state().alias("state"))
    expect = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("group_id")).agg(F.count(F.lit(1)).alias("expect"))
    return drain(state.fire_once(rows.join(expect, "group_id")))


@query("""WITH e AS (SELECT event_type, floor(epoch(ts))::BIGINT AS sec, CASE event_type WHEN 'click' THEN 300 WHEN 'view' THEN 3600 ELSE 86400 END AS every FROM events)
SELECT DISTINCT event_type AS schedule, sec - sec % every AS window_start FROM e""")
def stream_fires(spark, d):
    """A schedule for each type of event; every window that a tick falls in fires once."""
    every = F.when(F.col("event_type") == "click", 300).when(F.col("event_type") == "view", 3600).otherwise(86_400)
    ticks = source(spark, d, "events").select(F.col("event_type").alias("schedule"), every.alias("every"), F.col("ts").cast("timestamp").alias("at"))
    # The driver's tables come in no order of time: nothing is late here.
    return drain(state.fire_windows(ticks, "10000 days")).select("schedule", "window_start")


UNPARK_SQL = """e AS (SELECT event_id, event_type, ['agent_limit', 'agent_backend', 'forge_server', 'awaiting_human'][event_id % 4 + 1] AS error_class, floor(epoch(ts))::BIGINT AS sec FROM events),
h AS (SELECT error_class, sec, max(event_type = 'signup') AS ok FROM e WHERE event_type IN ('error', 'signup') AND error_class IN ('agent_limit', 'agent_backend') GROUP BY ALL),
p AS (SELECT error_class, event_id AS id, sec, CASE error_class WHEN 'agent_limit' THEN 43200 WHEN 'agent_backend' THEN 86400 WHEN 'forge_server' THEN 600 END AS every FROM e WHERE event_type NOT IN ('error', 'signup')),
now AS (SELECT max(sec) AS now FROM e),
c AS (SELECT p.*, unnest(range(1, (now - sec) // every + 1)) AS n FROM p, now WHERE every IS NOT NULL),
a AS (SELECT c.error_class, c.id, c.sec + c.n * c.every AS due, coalesce(h.ok, true) AS ok FROM c ASOF LEFT JOIN h ON h.error_class = c.error_class AND c.sec + c.n * c.every >= h.sec)"""


@query(f"WITH {UNPARK_SQL} SELECT error_class, id, min(due) AS due FROM a, now WHERE ok AND due < now GROUP BY 1, 2")
def stream_unpark(spark, d):
    """Events as parked tasks; errors and signups of the two gated classes are failed and good health reports."""
    kind = F.element_at(F.array(*map(F.lit, ("agent_limit", "agent_backend", "forge_server", "awaiting_human"))), (F.col("event_id") % 4 + 1).cast("int"))
    rows = source(spark, d, "events").select(F.col("event_id").alias("id"), "event_type", kind.alias("error_class"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("at"))
    report = F.col("event_type").isin("error", "signup")
    every = F.when(F.col("error_class") == "agent_limit", 43_200).when(F.col("error_class") == "agent_backend", 86_400).when(F.col("error_class") == "forge_server", 600)
    parked = rows.where(~report).select("error_class", "id", every.cast("bigint").alias("every"), "at")
    health = rows.where(report & F.col("error_class").isin("agent_limit", "agent_backend")).select("error_class", (F.col("event_type") == "signup").alias("ok"), "at")
    return drain(state.come_due(parked, health)).select("error_class", "id", "due")
