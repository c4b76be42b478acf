"""Queue algebra: enqueueing, claiming, failing, parking, schedules and barriers as set operations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.checks import CLASS_NAME

#: Class, attempts, base and cap of the delay in seconds, park when exhausted, consume, seconds until unparked (none: never).
POLICY = [
    ("forge_auth", 20, 30, 3600, True, False, None),
    ("forge_server", 10, 10, 600, True, False, 600),
    ("agent_limit", 0, 0, 0, True, False, 1800),
    ("agent_backend", 3, 60, 3600, True, False, 300),
    ("agent_invalid_output", 2, 0, 0, False, False, 600),
    ("verify_red", 1, 0, 0, False, False, 600),
    ("timeout", 1, 60, 3600, False, False, 600),
    ("definition_changed", 0, 0, 0, True, False, None),
    ("awaiting_human", 0, 0, 0, True, False, None),
    ("workspace_dirty", 0, 0, 0, False, True, 600),
    ("agent_noop", 0, 0, 0, False, True, 600),
    ("framework_bug", 0, 0, 0, False, True, 600),
    ("step_budget_exhausted", 0, 0, 0, False, True, 600),
]
POLICY_SCHEMA = "error_class string, max_attempts int, base_s int, cap_s int, park boolean, consume boolean, unpark_s int"
HEALTH_GATED = ("agent_limit", "agent_backend")
DEFAULT_UNPARK_S = 600


TUNABLE = ("max_attempts", "base_s", "cap_s", "park", "unpark_s")
_FIELDS = ("error_class", "max_attempts", "base_s", "cap_s", "park", "consume", "unpark_s")


def build_policy(overrides: dict[str, dict] | None = None) -> list[tuple]:
    """POLICY with a pack's overrides (class to fields) and its own classes, which need max_attempts and park at least.

    Refused are: names that aren't of lower-case letters, digits and underscores, fields that can't be tuned, values
    that aren't whole numbers from 0 (park: a flag; unpark_s may be null), and classes that end a task by design.
    """
    rows = {r[0]: dict(zip(_FIELDS, r, strict=True)) for r in POLICY}
    if not isinstance(overrides or {}, dict):
        raise ValueError("retry policies are a mapping of classes to fields")
    for name, given in (overrides or {}).items():
        if not isinstance(name, str) or not re.fullmatch(CLASS_NAME, name):
            raise ValueError(f"{name!r} is no name of an error class")
        if not isinstance(given, dict) or not given:
            raise ValueError(f"policy of {name}: no fields")
        if unknown := sorted(set(given) - set(TUNABLE)):
            raise ValueError(f"policy of {name}: {', '.join(unknown)} can't be set")
        known = rows.get(name)
        if known and known["consume"]:
            raise ValueError(f"policy of {name}: the class ends a task by design")
        for field, value in given.items():
            whole = isinstance(value, int) and not isinstance(value, bool) and value >= 0
            if not (isinstance(value, bool) if field == "park" else whole or (field == "unpark_s" and value is None)):
                raise ValueError(f"policy of {name}: {field} can't be {value!r}")
        if known is None:
            if lacking := sorted({"max_attempts", "park"} - set(given)):
                raise ValueError(f"policy of {name}: a new class needs {' and '.join(lacking)}")
            known = {"error_class": name, "base_s": 0, "cap_s": 0, "consume": False, "unpark_s": DEFAULT_UNPARK_S}
        rows[name] = known | given
    return [tuple(row[f] for f in _FIELDS) for row in rows.values()]


def policy_table(spark: SparkSession, overrides: dict[str, dict] | None = None) -> DataFrame:
    return spark.createDataFrame(build_policy(overrides), POLICY_SCHEMA)


def fan_out(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """A row for each event and kind that consumes it."""
    return events.join(subscriptions, events["name"] == subscriptions["event"]).drop("event")


def enqueue(arrivals: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """First arrival of each (kind, payload_hash) that known doesn't have; arrivals: event_id, kind, payload_hash."""
    first = arrivals.groupBy("kind", "payload_hash").agg(F.min("event_id").alias("event_id"), F.count(F.lit(1)).alias("arrivals"))
    return first if known is None else first.join(known.select("kind", "payload_hash"), ["kind", "payload_hash"], "left_anti")


def eligible(tasks: DataFrame, now: Column) -> DataFrame:
    return tasks.where(F.col("state").isin("pending", "retry_wait") & (F.col("next_attempt").isNull() | (F.col("next_attempt") <= now)))


def claim(tasks: DataFrame, now: Column, lanes: DataFrame) -> DataFrame:
    """Oldest eligible tasks up to what each lane's cap leaves beside its running tasks; lanes: lane, cap. Ranks are cut inside tasks before the shuffle."""
    busy = tasks.where("state = 'running'").groupBy("lane").agg(F.count(F.lit(1)).alias("busy"))
    lanes = lanes.join(busy, "lane", "left").select("lane", (F.col("cap") - F.coalesce("busy", F.lit(0))).alias("cap"))
    turn = F.row_number().over(Window.partitionBy("lane").orderBy("id"))
    most = lanes.agg(F.max("cap")).first()[0] or 0
    return eligible(tasks, now).withColumn("turn", turn).where(F.col("turn") <= int(most)).join(lanes, "lane").where("turn <= cap").drop("cap")


def delay(base: Column, cap: Column, attempt: Column) -> Column:
    return F.least(base * F.pow(F.lit(2), attempt - 1), cap).cast("bigint")


def fail(tasks: DataFrame, policy: DataFrame, now: Column) -> DataFrame:
    """What becomes of failed tasks (id, error_class, attempts): new_state, new_attempts, next_attempt."""
    j = tasks.join(policy, "error_class", "left")
    again = F.col("attempts") + 1
    state = F.when(F.col("max_attempts").isNull() | F.col("consume"), "failed").when(again <= F.col("max_attempts"), "retry_wait").when(F.col("park"), "parked").otherwise("failed")
    j = j.withColumn("new_state", state).withColumn("new_attempts", F.when(F.col("new_state") == "retry_wait", again).otherwise(F.col("attempts")))
    wait = delay(F.col("base_s"), F.col("cap_s"), F.col("new_attempts"))
    return j.withColumn("next_attempt", F.when(F.col("new_state") == "retry_wait", now + wait))


def parked_due(parked: DataFrame, policy: DataFrame, now: Column, healthy: bool = True) -> DataFrame:
    """Parked tasks (id, error_class, updated_at in seconds) whose class' cadence has passed; unknown classes wait the default."""
    j = parked.join(policy.select("error_class", F.lit(True).alias("known"), "unpark_s"), "error_class", "left")
    cadence = F.when(F.col("known").isNull(), F.lit(DEFAULT_UNPARK_S)).otherwise(F.col("unpark_s"))
    due = j.where(now - F.col("updated_at") >= cadence)
    return due if healthy else due.where(~F.coalesce(F.col("error_class").isin(*HEALTH_GATED), F.lit(False)))


def clamp(next_attempt: Column, now: Column) -> Column:
    """Waits beyond two days, as after a clock jump, become an hour."""
    return F.when(next_attempt > now + 172800, now + 3600).otherwise(next_attempt)


def window_start(at: Column, every: int) -> Column:
    return at - F.pmod(at, F.lit(every))


def schedule_fires(ticks: DataFrame, every: int) -> DataFrame:
    """One firing for each window that a tick falls in; the first tick of a window fires, missed windows are skipped. ticks: at."""
    return ticks.groupBy(window_start(F.col("at"), every).alias("window_start")).agg(F.min("at").alias("fired_at"), F.count(F.lit(1)).alias("ticks"))


def barriers(members: DataFrame) -> DataFrame:
    """group_id, total, waiting, done, failed, deferred, complete from a roster (group_id, state; null waits)."""
    per = [F.sum((F.col("state") == s).cast("int")).alias(s) for s in ("done", "failed", "deferred")]
    out = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("total"), (F.count(F.lit(1)) - F.count("state")).alias("waiting"), *per)
    return out.select("group_id", "total", "waiting", *[F.coalesce(s, F.lit(0)).cast("bigint").alias(s) for s in ("done", "failed", "deferred")], (F.col("waiting") == 0).alias("complete"))


def fire(groups: DataFrame, fired: DataFrame) -> DataFrame:
    """Complete groups that haven't fired: each fires exactly once."""
    return groups.where("complete").join(fired.select("group_id"), "group_id", "left_anti")


def terminal_effect(target: Column, error_class: Column, known: Column) -> Column:
    """done, deferred and parked stand; failed under a known class goes to the policy."""
    return F.when(target.isin("done", "deferred", "parked"), target).when((target == "failed") & error_class.isNotNull() & known, "policy").otherwise("failed")


def version_gate(tasks: DataFrame, current: DataFrame) -> DataFrame:
    """adopt, keep or park (definition_changed) for tasks (id, kind, def_hash, steps) against current (kind, hash)."""
    j = tasks.join(current, "kind", "left")
    act = F.when(F.col("def_hash").isNull(), "adopt").when((F.col("def_hash") == F.col("hash")) | (F.col("steps") == 0), "keep").otherwise("park")
    return j.withColumn("action", act)


def decision_rounds(asked: DataFrame, by: str = "key") -> DataFrame:
    """asked (key, id, ...) with round and status: a later round supersedes the open ones before it."""
    order = Window.partitionBy(by).orderBy("id")
    last = F.lead("id").over(order).isNull()
    return asked.withColumn("round", F.row_number().over(order)).withColumn("status", F.when(last, "open").otherwise("superseded"))


def transitions(moves: DataFrame, allowed: DataFrame) -> DataFrame:
    """moves (from_state, to_state, ...) with legal, by an equi-join on the allowed edges."""
    edges = allowed.select("from_state", "to_state", F.lit(True).alias("legal"))
    return moves.join(edges, ["from_state", "to_state"], "left").withColumn("legal", F.coalesce("legal", F.lit(False)))


def upsert(new: DataFrame, old: DataFrame | None, key: str, order: str) -> DataFrame:
    """Rows of new to insert: the first of each key that old doesn't have; existing items never regress."""
    first = new.groupBy(key).agg(F.min_by(F.struct(*[c for c in new.columns if c != key]), order).alias("__r")).select(key, "__r.*").select(*new.columns)
    return first if old is None else first.join(old.select(key), key, "left_anti")


def latest(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """The last row of each key; max of a struct, so hot keys are combined before the shuffle."""
    rest = [c for c in rows.columns if c not in by and c != order]
    picked = rows.groupBy(*by).agg(F.max(F.struct(order, *rest)).alias("__r"))
    return picked.select(*by, *[F.col("__r")[c].alias(c) for c in [order, *rest]])
