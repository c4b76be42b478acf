"""Reports over the ledger: health, the audit of a run, collected barriers, and what retention leaves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A wait beyond so many seconds comes of a clock that jumped; states that end a task.
FAR_S = 172_800
ENDED = ("done", "failed", "deferred")


def doctor(tasks: DataFrame, now: int, heartbeat: int | None, stale_s: int = 120, free_mb: int | None = None, least_mb: int = 0) -> DataFrame:
    """issue, n of all that is wrong: no rows if nothing is. tasks: state, next_attempt (seconds).

    A heartbeat older than stale_s, or none, means that nothing runs: then tasks that run are stuck, and waiting ones
    that are due are left. One from the future, or waits beyond two days, tell of a clock that jumped. One pass.
    """
    age = None if heartbeat is None else now - heartbeat
    dead = age is None or age >= stale_s
    due = (F.col("state") == "retry_wait") & (F.col("next_attempt") <= now)
    found = {
        "waits beyond two days": F.col("next_attempt") > now + FAR_S,
        "running without a daemon": (F.col("state") == "running") & F.lit(dead),
        "overdue without a daemon": due & F.lit(dead),
    }
    counts = tasks.agg(*[F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("bigint")), F.lit(0)).alias(k) for k, c in found.items()])
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("issue"), F.col(f"`{k}`").alias("n")) for k in found])).alias("x")).select("x.issue", "x.n").where("n > 0")
    fixed = [("heartbeat is stale", age)] if age is not None and age >= stale_s else []
    fixed += [("heartbeat is from the future", -age)] if age is not None and age < -60 else []
    fixed += [("disk is low", free_mb)] if free_mb is not None and free_mb < least_mb else []
    return rows.unionByName(tasks.sparkSession.createDataFrame([(k, int(n)) for k, n in fixed], "issue string, n bigint"))


def collected(members: DataFrame, tasks: DataFrame, groups: DataFrame, limit: int = 200) -> DataFrame:
    """What the step behind a barrier reads of each group (groups: group_id, event, fired_at): group_id, event, fired_at, total, counts by state (waiting for null), members (task_id, state, kind, result) by task up to limit, truncated.

    members: group_id, task_id, state; tasks: id, kind, result. Counts are exact; a group's list holds limit rows at
    most, and each task keeps no more of a group before they are dealt.
    """
    state = F.coalesce("state", F.lit("waiting"))
    per = members.groupBy("group_id", state.alias("state")).agg(F.count(F.lit(1)).alias("n"))
    counts = per.groupBy("group_id").agg(F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("state", "n")))).alias("counts"))
    turn = F.row_number().over(Window.partitionBy("group_id").orderBy("task_id"))
    first = members.withColumn("__n", turn).where(F.col("__n") <= limit).drop("__n")
    named = first.join(tasks.select(F.col("id").alias("task_id"), "kind", "result"), "task_id")
    lists = named.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("task_id", "state", "kind", "result"))).alias("members"))
    j = groups.join(counts, "group_id", "left").join(lists, "group_id", "left")
    total = F.coalesce("total", F.lit(0))
    return j.select("group_id", "event", "fired_at", total.alias("total"), "counts", "members", (total > limit).alias("truncated"))


def run_audit(tasks: DataFrame, steps: DataFrame, decisions: DataFrame, events: DataFrame) -> DataFrame:
    """The whole story of every run (thread) as rows (thread, part, at, what, detail): its decisions, its tasks by age with the steps of all attempts, its events.

    tasks: thread, task, kind, state; steps: task, attempt, step, outcome, seq; decisions: task, id, key, round, verdict;
    events: thread, event, name. Steps and decisions meet their tasks by equality; a thread's rows aren't gathered.
    """
    own = tasks.select("thread", "task")
    text = lambda *c: F.concat_ws(" ", *[F.col(x).cast("string") for x in c])
    row = lambda df, part, at, what, detail: df.select("thread", F.lit(part).alias("part"), at.cast("bigint").alias("at"), F.lit(what).alias("what"), detail.alias("detail"))
    parts = [
        row(decisions.join(own, "task"), 0, F.col("id"), "decision", F.concat_ws(" ", F.col("key").cast("string"), F.col("round").cast("string"), F.coalesce("verdict", F.lit("open")))),
        row(tasks, 1, F.col("task"), "task", text("kind", "state")),
        row(steps.join(own, "task"), 2, F.col("task"), "step", text("attempt", "seq", "step", "outcome")),
        row(events, 3, F.col("event"), "event", F.col("name")),
    ]
    return reduce(DataFrame.unionByName, parts)


def outlived(tasks: DataFrame, now: Column, days: int) -> DataFrame:
    """Tasks (id, state, updated_at in seconds) that ended more than so many days ago."""
    return tasks.where(F.col("state").isin(*ENDED) & (F.col("updated_at") < now - F.lit(days * 86_400)))


def swept(tables: dict[str, DataFrame], now: Column, days: int) -> tuple[dict[str, DataFrame], DataFrame]:
    """What retention leaves of the tables, and kind, n of what goes.

    tables: tasks (id, state, updated_at), runs (id, task), events (at), groups (group_id, fired_at), members (group_id);
    times in seconds. Runs of tasks that ended long ago go, events that are old, and groups that fired long ago with
    their members; a group that hasn't fired is live and stays, whatever its age. Tasks stay: they are what repeats are
    known by.
    """
    limit = now - F.lit(days * 86_400)
    ended = outlived(tables["tasks"], now, days).select(F.col("id").alias("task"))
    old = tables["groups"].where(F.col("fired_at") < limit).select("group_id")
    gone = {
        "runs": (tables["runs"].join(ended, "task", "left_semi"), tables["runs"].join(ended, "task", "left_anti")),
        "events": (tables["events"].where(F.col("at") < limit), tables["events"].where(F.coalesce(F.col("at") >= limit, F.lit(True)))),
        "groups": (tables["groups"].join(old, "group_id", "left_semi"), tables["groups"].join(old, "group_id", "left_anti")),
        "members": (tables["members"].join(old, "group_id", "left_semi"), tables["members"].join(old, "group_id", "left_anti")),
    }
    counts = [g.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n") for k, (g, _) in gone.items()]
    return {k: kept for k, (_, kept) in gone.items()}, reduce(DataFrame.unionByName, counts)


def status(tasks: DataFrame, members: DataFrame, fired: DataFrame, items: DataFrame, events: DataFrame, recent: int = 10) -> DataFrame:
    """section, key, n: tasks by kind and state, parked ones by class, open groups with the members they wait for, items by state, the last events.

    tasks: kind, state, error_class; members: group_id, state; fired: group_id; items: state; events: event_id, name.
    Every part is pre-aggregated, or a bounded heap a task.
    """
    n = F.count(F.lit(1)).alias("n")
    say = lambda df, section, key: df.select(F.lit(section).alias("section"), key.cast("string").alias("key"), F.col("n").cast("bigint").alias("n"))
    open_ = members.join(fired.select("group_id"), "group_id", "left_anti").groupBy("group_id").agg(F.sum(F.col("state").isNull().cast("bigint")).alias("w")).agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("w"), F.lit(0)).alias("waiting"))
    parts = [
        say(tasks.groupBy("kind", "state").agg(n), "tasks", F.concat_ws(" ", "kind", "state")),
        say(tasks.where("state = 'parked'").groupBy("error_class").agg(n), "parked", F.coalesce("error_class", F.lit("-"))),
        say(open_.select(F.explode(F.create_map(F.lit("groups"), "groups", F.lit("waiting"), "waiting")).alias("k", "n")), "open joins", F.col("k")),
        say(items.groupBy("state").agg(n), "items", F.coalesce("state", F.lit("-"))),
        say(events.orderBy(F.desc("event_id")).limit(recent).withColumn("n", F.col("event_id")), "events", F.col("name")),
    ]
    return reduce(DataFrame.unionByName, parts)


def run_cards(tasks: DataFrame, progress: DataFrame, waiting: DataFrame) -> DataFrame:
    """A card for every run (thread): tasks, kinds with the state of their last task, steps done of all, what it waits for, chip, newest task.

    tasks: thread, id, kind, state, error_class; progress: id, done, total; waiting: id, title of a question that is open. The
    first of these holds: needs-human, running, failed, parked, complete, queued.
    """
    j = tasks.join(progress, "id", "left").join(waiting.groupBy("id").agg(F.min("title").alias("title")), "id", "left")
    last = tasks.groupBy("thread", "kind").agg(F.max_by("state", "id").alias("state")).groupBy("thread").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "kind", "state"))), " ").alias("kinds"))
    is_ = lambda s: F.col("state") == s
    human = F.bool_or(is_("parked") & F.coalesce(F.col("error_class") == "awaiting_human", F.lit(False)))
    chip = F.when(human, "needs-human").when(F.bool_or(F.col("state").isin("running", "retry_wait")), "running").when(F.bool_or(is_("failed")), "failed").when(F.bool_or(is_("parked")), "parked").when(F.bool_and(is_("done")), "complete").otherwise("queued")
    per = j.groupBy("thread").agg(
        F.count(F.lit(1)).alias("tasks"), F.max("id").alias("newest"), F.coalesce(F.sum("done"), F.lit(0)).cast("bigint").alias("done"), F.coalesce(F.sum("total"), F.lit(0)).cast("bigint").alias("total"), F.min("title").alias("asks"), chip.alias("chip")
    )
    return per.join(last, "thread").select("thread", "tasks", "kinds", "done", "total", "asks", "chip", "newest")
