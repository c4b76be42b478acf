"""Steps of tasks: resuming, retrying, fan-out with barriers, audit and progress as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import json_values as jv
from .ordering import running


def tail(events: DataFrame, cursor: int, key: str = "event_id") -> DataFrame:
    """Events after the cursor; the next cursor is the largest key of what was taken."""
    return events.where(F.col(key) > cursor)


def expected(items: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """items (event, n) with consumers and expected = n times them; an event that nothing consumes expects none."""
    per = subscriptions.groupBy("event").agg(F.count(F.lit(1)).alias("consumers"))
    j = items.join(per, "event", "left").withColumn("consumers", F.coalesce("consumers", F.lit(0)).cast("bigint"))
    return j.withColumn("expected", F.col("n") * F.col("consumers"))


def group_key(task: Column, name: Column, join_event: Column, payloads: Column) -> Column:
    """Key of a fan-out's group over its task, event names and payloads (an array of canonical JSON): a replay meets the same group, other payloads another."""
    members = F.concat(F.lit("["), F.array_join(payloads, ","), F.lit("]"))
    parts = ['{"join_event":"', join_event, '","name":"', name, '","payloads":', members, ',"task":', task.cast("string"), "}"]
    return F.sha2(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]), 256)


def fanned_out(ops: DataFrame, subscriptions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups and children of staged fan-outs (task, name, join_event, payloads: an array of canonical JSON objects).

    groups: group_id, task, join_event, expect (payloads times consumers of the event), complete (nothing is expected: it
    fires at once). children: group_id, name, kind, idx, payload with the reserved _join (group and index) in its place
    among the sorted keys, payload_hash. The same fan-out staged twice is one group.
    Subscriptions are definitions and go to all tasks: dealt by its name, a frequent event would be one task's.
    """
    per = subscriptions.groupBy(F.col("event").alias("name")).agg(F.count(F.lit(1)).alias("consumers"))
    keyed = ops.select(group_key(F.col("task"), F.col("name"), F.col("join_event"), F.col("payloads")).alias("group_id"), "task", "name", "join_event", "payloads").dropDuplicates(["group_id"])
    expect = (F.size("payloads") * F.coalesce("consumers", F.lit(0))).cast("bigint")
    groups = keyed.join(F.broadcast(per), "name", "left").select("group_id", "task", "join_event", expect.alias("expect"), (expect == 0).alias("complete"))
    each = keyed.select("group_id", "name", F.posexplode("payloads").alias("idx", "item"))
    told = each.join(F.broadcast(subscriptions.select(F.col("event").alias("name"), "kind")), "name")
    join = F.concat(F.lit('"_join":{"group":"'), F.col("group_id"), F.lit('","index":'), F.col("idx").cast("string"), F.lit("}"))
    # The payload is canonical; _join stands where its name sorts.
    payload = jv.canonical(F.concat(F.lit("{"), join, F.when(F.col("item") == "{}", "").otherwise(","), F.substr("item", F.lit(2))))
    children = told.withColumn("payload", payload).select("group_id", "name", "kind", F.col("idx").cast("bigint").alias("idx"), "payload")
    return groups, children.withColumn("payload_hash", F.sha2("payload", 256))


def frontier(recorded: DataFrame, steps: int, fresh: tuple[int, ...] = ()) -> DataFrame:
    """task_id, replayed, next_step: a crashed task replays its recorded steps (1 .. steps) up to the first gap and goes on there; fresh steps run again."""
    order = Window.partitionBy("task_id").orderBy("step")
    steps_done = recorded.where(F.col("step").between(1, steps)).select("task_id", "step").distinct()
    solid = steps_done.withColumn("place", F.row_number().over(order)).where("place = step")
    again = F.col("step").isin(*fresh) if fresh else F.lit(False)
    found = solid.groupBy("task_id").agg(F.sum((~again).cast("bigint")).alias("replayed"), (F.max("step") + 1).cast("bigint").alias("next_step"))
    all_ = recorded.select("task_id").distinct().join(found, "task_id", "left")
    return all_.select("task_id", F.coalesce("replayed", F.lit(0)).cast("bigint").alias("replayed"), F.coalesce("next_step", F.lit(1)).cast("bigint").alias("next_step"))


def visits(walk: DataFrame, by: list[str], order: str, cap: int) -> DataFrame:
    """walk with visit (how often its step was come to until then) and exhausted (more often than cap)."""
    turn = F.row_number().over(Window.partitionBy(*by).orderBy(order)).cast("bigint")
    return walk.withColumn("visit", turn).withColumn("exhausted", F.col("visit") > cap)


def _chosen(rows: DataFrame, ids: list[int] | None, kind: str | None) -> DataFrame:
    rows = rows if ids is None else rows.where(F.col("id").isin(*ids))
    return rows if kind is None else rows.where(F.col("kind") == kind)


def retried(tasks: DataFrame, ids: list[int] | None = None, kind: str | None = None) -> DataFrame:
    """Failed tasks (those named, those of a kind, or all) as they are queued again: pending in a fresh attempt, so that no step of the failed one is replayed, without a waiting time or error."""
    rows = _chosen(tasks.where("state = 'failed'"), ids, kind).withColumn("state", F.lit("pending"))
    return _at_once(rows.withColumn("attempts", F.col("attempts") + 1)).withColumn("error_class", F.lit(None).cast("string"))


def _at_once(tasks: DataFrame) -> DataFrame:
    return tasks.withColumn("next_attempt", F.lit(None).cast("bigint")) if "next_attempt" in tasks.columns else tasks


def reopened(roster: DataFrame, fired: DataFrame) -> DataFrame:
    """Failed members of groups that haven't fired wait again; those of fired groups stay as they are."""
    return roster.where("state = 'failed'").join(fired.select("group_id"), "group_id", "left_anti").withColumn("state", F.lit(None).cast("string"))


def unparked(tasks: DataFrame, classes: tuple[str, ...] = (), ids: list[int] | None = None) -> DataFrame:
    """Parked tasks (of the classes or ids named, or all) as they are taken up again: pending, in a fresh attempt, without a waiting time."""
    rows = _chosen(tasks.where("state = 'parked'"), ids, None)
    rows = rows.where(F.col("error_class").isin(*classes)) if classes else rows
    return _at_once(rows.withColumn("state", F.lit("pending")).withColumn("attempts", F.col("attempts") + 1))


def rearmed(tasks: DataFrame, failed: DataFrame, now: Column) -> DataFrame:
    """tasks with the clock of those parked ones set to now whose id is in failed: after a failed probe the next is a whole cadence away."""
    again = failed.select("id", F.lit(True).alias("__again")).distinct()
    reset = (F.col("state") == "parked") & F.col("__again")
    return tasks.join(again, "id", "left").withColumn("updated_at", F.when(reset, now).otherwise(F.col("updated_at"))).drop("__again")


def reset_orphans(tasks: DataFrame) -> DataFrame:
    """At a start nothing runs yet: running tasks are pending again."""
    return tasks.withColumn("state", F.when(F.col("state") == "running", "pending").otherwise(F.col("state")))


def audited(moves: DataFrame) -> DataFrame:
    """The audit row and the event item.<state> of every legal move (id, key, from_state, to_state, legal)."""
    return moves.where("legal").select("id", "key", "from_state", "to_state", F.concat(F.lit("item."), F.lower("to_state")).alias("event"))


def progress(steps: DataFrame, worst: list[str]) -> DataFrame:
    """task_id, done, total, last_step, last_outcome (of the last ended step), worst from steps (task_id, step, outcome; null: open). worst lists outcomes, the worst first."""
    rank = F.lit(len(worst))
    for i, o in reversed(list(enumerate(worst))):
        rank = F.when(F.col("outcome") == o, i).otherwise(rank)
    per = steps.groupBy("task_id").agg(
        F.countDistinct(F.when(F.col("outcome").isNotNull(), F.col("step"))).alias("done"),
        F.countDistinct("step").alias("total"),
        F.max("step").cast("bigint").alias("last_step"),
        F.max(F.when(F.col("outcome").isNotNull(), F.struct("step", "outcome")))["outcome"].alias("last_outcome"),
        F.min(rank).alias("__worst"),
    )
    return per.withColumn("worst", F.try_element_at(F.array(*map(F.lit, worst)), F.col("__worst") + 1)).drop("__worst")


def latest_run(runs: DataFrame, prompts: DataFrame) -> DataFrame:
    """Replay: prompts (id, prompt_sha) with the run of the same prompt recorded last; without one, null."""
    last = runs.groupBy("prompt_sha").agg(F.max("run_id").alias("run_id"))
    return prompts.join(last, "prompt_sha", "left")


def lookup(wanted: DataFrame, objects: DataFrame) -> DataFrame:
    """wanted (path, symbol) with the object_id of the object at that place; a null symbol is the file itself and equals null."""
    o = objects.groupBy("path", "symbol").agg(F.min("object_id").alias("object_id")).alias("o")
    w = wanted.alias("w")
    return w.join(o, (F.col("w.path") == F.col("o.path")) & F.col("w.symbol").eqNullSafe(F.col("o.symbol")), "left").select("w.*", "o.object_id")


def roster_cap(roster: DataFrame, cap: int = 200) -> DataFrame:
    """The first `cap` members of each group by (task_id, state), with the group's exact total and whether it was cut."""
    turn = F.row_number().over(Window.partitionBy("group_id").orderBy("task_id", "state"))
    totals = roster.groupBy("group_id").agg(F.count(F.lit(1)).alias("total"))
    return roster.withColumn("__n", turn).where(F.col("__n") <= cap).drop("__n").join(totals, "group_id").withColumn("truncated", F.col("total") > cap)


def manifest(sections: DataFrame, budget: int) -> DataFrame:
    """sections (scope, key, text) with bytes, sha, used (running bytes by key within the scope), total and over (beyond the budget)."""
    rows = sections.select("scope", "key", F.octet_length("text").cast("bigint").alias("bytes"), F.sha2("text", 256).alias("sha"))
    rows = running(rows, ["scope"], [F.col("key")], "bytes", "used").withColumnRenamed("__total", "total")
    return rows.drop("__rows").withColumn("over", F.col("used") > budget)


def prompt(sections: DataFrame, schema: dict) -> DataFrame:
    """id, prompt from sections (id, base, name, value: JSON text): the base text, a context section of canonical JSON for each name in order, then the output contract with its schema. A row without a name has no section."""
    part = F.when(F.col("name").isNotNull(), F.struct("name", jv.canonical(F.col("value")).alias("said")))
    per = sections.groupBy("id").agg(F.first("base").alias("base"), F.array_sort(F.collect_list(part)).alias("parts"))
    told = F.transform("parts", lambda p: F.concat(F.lit("## context: "), p["name"], F.lit("\n"), p["said"], F.lit("\n\n")))
    contract = f"## output contract\n{jv.CONTRACT}\n{jv.dumped(schema)}\n"
    return per.select("id", F.concat(F.regexp_replace("base", r"\s+$", ""), F.lit("\n\n"), F.array_join(told, ""), F.lit(contract)).alias("prompt"))


def where_equal(rows: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """Rows equal to all values wanted; null matches null; an unknown column is an error."""
    for name, value in wanted.items():
        if name not in rows.columns:
            raise ValueError(f"no column {name}; there are {', '.join(rows.columns)}")
        rows = rows.where(F.col(name).eqNullSafe(F.lit(value)))
    return rows


def chip(any_: dict[str, Column]) -> Column:
    """Status of a run from whether any of its tasks is so: needs-human, running, failed, parked, complete, queued."""
    return F.when(any_["needs-human"], "needs-human").when(any_["running"], "running").when(any_["failed"], "failed").when(any_["parked"], "parked").when(any_["complete"], "complete").otherwise("queued")


def resumed(tasks: DataFrame, answered: DataFrame) -> DataFrame:
    """Tasks that wait for a decision which has come: pending again within the same attempt. answered: id."""
    return tasks.where("state = 'parked' AND error_class = 'awaiting_human'").join(answered.select("id"), "id", "left_semi").withColumn("state", F.lit("pending"))


def last_writes(steps: DataFrame) -> DataFrame:
    """The row of each (task_id, attempt, step) written last (seq): a step that is come to again replaces what it recorded."""
    rest = [c for c in steps.columns if c not in ("task_id", "attempt", "step", "seq")]
    picked = steps.groupBy("task_id", "attempt", "step").agg(F.max_by(F.struct("seq", *rest), "seq").alias("__r"))
    return picked.select("task_id", "attempt", "step", "__r.*")
