"""Walks of tasks along the outcomes of their steps: resuming a recorded walk, and driving tasks step by step until none moves."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.definitions import TERMINALS, Workflow
from ..sources.ledger import Ledger
from . import blocks
from .workers import importable


def authoritative(recorded: DataFrame, tasks: DataFrame, resumable: tuple[str, ...] = ()) -> DataFrame:
    """task, step, outcome that a walk of each task (task, attempt) may replay: what its present attempt recorded last for a step, and for a resumable step without such a row the last of the attempts before. recorded: task, attempt, step, outcome, seq."""
    j = recorded.select("task", "step", "outcome", "seq", F.col("attempt").alias("__a")).join(tasks.select("task", "attempt"), "task")
    before = F.col("step").isin(*resumable) if resumable else F.lit(False)
    usable = j.where((F.col("__a") == F.col("attempt")) | ((F.col("__a") < F.col("attempt")) & before))
    return usable.groupBy("task", "step").agg(F.max(F.struct("__a", "seq", "outcome"))["outcome"].alias("outcome"))


def resumed(recorded: DataFrame, tasks: DataFrame, dispatch: dict[tuple[str, str], str], first: str, fresh: tuple[str, ...] = (), resumable: tuple[str, ...] = ()) -> DataFrame:
    """task, replayed (steps in the order of the walk), at, state: where each task (task, attempt) goes on after a crash.

    The walk starts at the first step and follows recorded outcomes through dispatch ((step, outcome): target). A step is
    replayed once: one that is come to again, a fresh one, or one without a record is where work goes on (state
    running). A terminal target ends it in that state; an outcome that leads nowhere is failed (at stays there). A task
    has at most one row a step of the definition here, so the walk is one expression over a small map: one shuffle of
    the records, however long the walk.
    """
    edges = [x for (step, outcome), target in dispatch.items() for x in (F.lit(f"{step}\x1f{outcome}"), F.lit(target))]
    steps = len({s for s, _ in dispatch} | {t for t in dispatch.values() if t not in TERMINALS} | {first})
    rows = authoritative(recorded, tasks, resumable).where(~F.col("step").isin(*fresh) if fresh else F.lit(True))
    per = rows.groupBy("task").agg(F.map_from_entries(F.collect_list(F.struct("step", "outcome"))).alias("had"))
    j = tasks.select("task").join(per, "task", "left")
    start = F.struct(F.array().cast("array<string>").alias("replayed"), F.lit(first).alias("at"), F.lit("running").alias("state"), F.lit(True).alias("on"))

    def move(acc: Column, _: Column) -> Column:
        outcome = F.try_element_at(F.col("had"), acc["at"])
        target = F.try_element_at(F.create_map(*edges), F.concat(acc["at"], F.lit("\x1f"), outcome))
        goes = acc["on"] & outcome.isNotNull() & ~F.array_contains(acc["replayed"], acc["at"])
        ends = target.isin(*TERMINALS)
        return F.struct(
            F.when(goes & target.isNotNull(), F.concat(acc["replayed"], F.array(acc["at"]))).otherwise(acc["replayed"]).alias("replayed"),
            F.when(goes & target.isNotNull() & ~ends, target).otherwise(acc["at"]).alias("at"),
            F.when(goes & target.isNull(), "failed").when(goes & ends, target).otherwise(acc["state"]).alias("state"),
            (goes & F.coalesce(~ends, F.lit(False))).alias("on"),
        )

    walked = j.withColumn("w", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, move))
    return walked.select("task", "w.replayed", "w.at", "w.state")


_MOVED = pa.schema([("task", pa.int64()), ("attempt", pa.int64()), ("seq", pa.int64()), ("step", pa.string()), ("outcome", pa.string()), ("result", pa.string()), ("target", pa.string()), ("error_class", pa.string()), ("payload", pa.string()), ("visits", pa.string())])
MOVED = "task bigint, attempt bigint, seq bigint, step string, outcome string, result string, target string, error_class string, payload string, visits string"


def _moved(active: DataFrame, w: Workflow, seq: int) -> DataFrame:
    """One step of every active task (task, attempt, at, payload, prev, visits: JSON of counts by step); a step that ends a task hands on no payload and no counts."""
    steps = {s.name: (s, blocks.REGISTRY[s.block]) for s in w.steps}

    def go(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for task, attempt, at, payload, prev, told in zip(*(c.to_pylist() for c in part.columns), strict=True):
                s, b = steps[at]
                visits = json.loads(told)
                visits[at] = visits.get(at, 0) + 1
                if visits[at] > s.max_visits:
                    outcome, result, error, target = None, None, "step_budget_exhausted", "failed"
                else:
                    outcome, result, error = blocks.run_one(b, json.loads(payload), s.params | {"prev": json.loads(prev)})
                    target = "failed" if error else s.on[outcome]
                handed = (None, None) if target in TERMINALS else (payload, json.dumps(visits, sort_keys=True))
                out.append((task, attempt, seq, at, outcome, result, target, error, *handed))
            columns = zip(*out, strict=True) if out else [[] for _ in _MOVED]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _MOVED, strict=True)], schema=_MOVED)

    return active.select("task", "attempt", "at", "payload", "prev", "visits").mapInArrow(go, MOVED)


def drive(ledger: Ledger, tasks: DataFrame, w: Workflow) -> DataFrame:
    """Runs tasks (task, attempt, payload: JSON) through a workflow until none moves; returns task, state, error_class, steps, last_step.

    All active tasks take their next step together, in one pass without a shuffle; its rows are one commit, so a driver
    that starts anew with the same ledger goes on after the last committed step and no step runs twice into it. A step
    visited more than its max_visits ends the task with step_budget_exhausted, so every walk ends. A task takes a step in
    every pass until one ends it: the row of that step tells all of the result, without a shuffle of the walk.
    """
    importable(tasks.sparkSession)
    empty = F.lit("{}")
    active = tasks.select("task", "attempt", F.lit(w.steps[0].name).alias("at"), "payload", empty.alias("prev"), empty.alias("visits"))
    seq, known = 0, set(ledger.steps())
    while True:
        seq += 1
        name = f"walk-{w.kind}-{seq:06d}"
        if name not in known:
            ledger.commit(name, {"walk": _moved(active, w, seq)})
        rows = ledger.of(name, "walk", MOVED)
        active = rows.where(~F.col("target").isin(*TERMINALS)).select("task", "attempt", F.col("target").alias("at"), "payload", F.coalesce("result", empty).alias("prev"), "visits")
        if not active.limit(1).count():
            break
    ended = ledger.table("walk", MOVED)
    last = ended.where(F.col("target").isin(*TERMINALS))
    return last.select("task", F.col("target").alias("state"), "error_class", F.col("seq").alias("steps"), F.col("step").alias("last_step"))
