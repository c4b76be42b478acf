"""Traces: from an event over the tasks it opened to the events that these emitted, and on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Levels that a trace follows at most; deeper ones are told by whoever asks for more.
DEPTH = 32


def descendants(emitted: DataFrame, depth: int = DEPTH) -> DataFrame:
    """ancestor, event, task (the one that emitted it), depth: all events that came of each event, by a recursive query.

    emitted: parent (event), task, event: a task that parent opened has emitted event. A walk stops at depth levels, and
    where it would come to an event that is on its way already, so loops end. A frame a level, each one equi-join. Where
    every event has a larger id than its parent there are no loops, and rows carry no way.
    """
    spark = emitted.sparkSession
    conf = {"spark.sql.cteRecursionLevelLimit": str(depth + 1), "spark.sql.cteRecursionRowLimit": "-1"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    loops = bool(emitted.where("event < parent").limit(1).count())
    start, longer, new = (", array(parent, event)", ", array_append(w.way, e.event)", " AND NOT array_contains(w.way, e.event)") if loops else ("", "", " AND e.parent <> e.event")
    return spark.sql(
        f"""WITH RECURSIVE walk(ancestor, event, task, depth{", way" if loops else ""}) AS (
             SELECT parent, event, task, 1{start} FROM {{emitted}} WHERE parent <> event
             UNION ALL
             SELECT w.ancestor, e.event, e.task, w.depth + 1{longer}
             FROM walk w JOIN {{emitted}} e ON e.parent = w.event WHERE w.depth < {{depth}}{new})
           SELECT ancestor, event, task, depth FROM walk""",
        emitted=emitted,
        depth=depth,
    )


def task_story(tasks: DataFrame, steps: DataFrame, runs: DataFrame, origins: DataFrame, emitted: DataFrame, children: DataFrame) -> DataFrame:
    """The story of every task as rows (task, place, what, ref, detail), in the order in which it is told.

    tasks: task, kind, state; origins: task, event, name; steps: task, attempt, step, outcome, seq; runs: task, run, model, verdict;
    emitted: task, event, name; children: event, task, kind, state (tasks that an emitted event opened). Each part is
    projected and united; nothing but the children of emitted events is joined.
    """
    say = lambda df, place, what, ref, *detail: df.select("task", F.lit(place).alias("place"), F.lit(what).alias("what"), F.col(ref).cast("string").alias("ref"), F.concat_ws(" ", *[F.col(c).cast("string") for c in detail]).alias("detail"))
    opened = emitted.select("task", "event").join(children.select("event", F.col("task").alias("child"), "kind", "state"), "event")
    parts = [
        say(tasks, 0, "task", "task", "kind", "state"),
        say(origins, 1, "origin", "event", "name"),
        say(steps, 2, "step", "seq", "attempt", "step", "outcome"),
        say(runs, 3, "run", "run", "model", "verdict"),
        say(emitted, 4, "emitted", "event", "name"),
        say(opened, 5, "opened", "child", "kind", "state"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
