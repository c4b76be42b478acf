"""Keyed state of streams: barriers that fire once, schedules that fire once a window, parked tasks that come due under a health gate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.workers import importable

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE = "spark.sql.streaming.stateStore.providerClass"
#: Tasks of one error class are dealt to so many shards, each with a copy of the class's health reports.
SHARDS = 16
#: Seconds of clocks or reports that are kept as one value; last bits of a group's id that don't tell keys apart.
SLOT, BLOCK_BITS = 3_600, 9
#: States in which a member counts, beside its group's total.
ENDS = {"done": 1, "failed": 2, "deferred": 3}
_MEMBER = np.dtype([("group", "i8"), ("task", "i8"), ("state", "i1")])
_TASK, _REPORT = np.dtype([("id", "i8"), ("due", "i8"), ("every", "i8")]), np.dtype([("at", "i8"), ("ok", "?")])


def prepared(spark: SparkSession) -> None:
    """Keyed state with several variables lives in RocksDB: beside the heap, spilling to disk, with changelogs in the checkpoint."""
    importable(spark)
    spark.conf.set(STORE, ROCKS)


def _filled(kind: np.dtype, **columns) -> np.ndarray:
    rows = np.zeros(len(next(iter(columns.values()))), kind)
    for name, c in columns.items():
        rows[name] = c
    return rows


def _load(state, kind) -> np.ndarray:
    had = state.get()
    return np.frombuffer(had[0] if had else b"", kind)


class _Barrier(StatefulProcessor):
    """Members' last states of a block's groups until all that a group expects have ended; after that only which have fired."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fired = handle.getValueState("fired", "ids binary")
        self.ended = handle.getValueState("ended", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        fired = _load(self.fired, np.int64)
        new = new[~np.isin(new["group_id"].to_numpy(), fired)]
        if new.empty:
            return
        old = _load(self.ended, _MEMBER)
        said = new[new["state"].notna()]
        told = np.zeros(len(said), _MEMBER)
        told["group"], told["task"] = said["group_id"].to_numpy(), said["task_id"].to_numpy()
        told["state"] = said["state"].map(ENDS).fillna(0).to_numpy()
        now = pd.DataFrame(np.concatenate([old, told])).drop_duplicates(["group", "task"], keep="last")
        sums = pd.DataFrame({"total": 1, **{s: now["state"] == n for s, n in ENDS.items()}}, index=now.index).groupby(now["group"]).sum()
        expect = new.groupby("group_id")["expect"].last()
        sums = sums.reindex(expect.index, fill_value=0)
        whole = sums[sums["total"] >= expect].reset_index()
        if len(whole):
            self.fired.update((np.concatenate([fired, whole["group_id"].to_numpy(np.int64)]).tobytes(),))
            now = now[~now["group"].isin(whole["group_id"])]
        if len(old) or len(now):
            self.ended.update((now.to_records(index=False).astype(_MEMBER).tobytes(),))
        if len(whole):
            yield whole[["group_id", "total", *ENDS]].astype("int64")

    def close(self) -> None:
        pass


def fire_once(members: DataFrame) -> DataFrame:
    """group_id, total, done, failed, deferred of each group, in append mode, in the batch in which its last member ends, and never again.

    members: group_id, task_id, state (null waits), expect (members that the group waits for; none is known where it is
    null). A member that ends anew before its group fires counts with its last state; later rows of a fired group are
    ignored. Of a fired group its id stays. Groups with ids that differ in their last BLOCK_BITS bits only are one key,
    so a call of the worker and its reads and writes of state are for many groups.
    """
    prepared(members.sparkSession)
    out = "group_id bigint, total bigint, done bigint, failed bigint, deferred bigint"
    rows = members.where("group_id is not null").select(F.shiftright("group_id", BLOCK_BITS).alias("block"), F.col("group_id").cast("bigint"), F.col("task_id").cast("bigint"), "state", F.coalesce(F.col("expect").cast("bigint"), F.lit(1 << 62)).alias("expect"))
    return rows.groupBy("block").transformWithStateInPandas(_Barrier(), out, "Append", "None")


class _Windows(StatefulProcessor):
    """Which windows of a schedule have fired, until the watermark has passed them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fired = handle.getValueState("fired", "at bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = min(r["sec"] for r in rows)
        if self.fired.exists():
            return
        self.fired.update((first,))
        self.handle.registerTimer((key[1] + key[2]) * 1000)
        yield Row(schedule=key[0], window_start=key[1], fired_at=first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # Ticks of the window are late from now on and don't come here.
        self.fired.clear()
        return iter(())

    def close(self) -> None:
        pass


def fire_windows(ticks: DataFrame, late: str = "1 day") -> DataFrame:
    """schedule, window_start, fired_at of each window of each schedule that a tick falls in, once, with the first batch that has one; ticks: schedule, every (seconds), at (timestamp). Ticks later than the watermark are dropped with the state of their windows, so a window fires at most once."""
    prepared(ticks.sparkSession)
    sec = F.unix_seconds("at")
    keyed = ticks.withWatermark("at", late).select("schedule", (sec - F.pmod(sec, "every")).alias("window_start"), F.col("every").cast("bigint").alias("every"), sec.alias("sec"), "at")
    out = "schedule string, window_start bigint, fired_at bigint"
    return keyed.groupBy("schedule", "window_start", "every").transformWithState(_Windows(), out, "Append", "EventTime")


class _Unpark(StatefulProcessor):
    """Parked tasks of a class' shard by the time they are due, and the class's health reports, in slots of SLOT seconds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parked = handle.getMapState("parked", "slot bigint", "rows binary")
        self.health = handle.getMapState("health", "slot bigint", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        reports, tasks = new[new["report"]], new[~new["report"] & (new["every"] > 0)]
        if len(reports):
            self._add(self.health, "at", _filled(_REPORT, at=reports["sec"], ok=reports["ok"]))
        if len(tasks):
            # A task that is parked anew has its new clock only.
            tasks = tasks.drop_duplicates("id", keep="last")
            ids = tasks["id"].to_numpy()
            for slot, had in self._slots(self.parked, _TASK):
                self._put(self.parked, slot, had, had[~np.isin(had["id"], ids)])
            waiting = _filled(_TASK, id=ids, due=tasks["sec"] + tasks["every"], every=tasks["every"])
            self._add(self.parked, "due", waiting)
            self._wake(waiting["due"].min())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # All that is due until the watermark, each by its own clock: neither the order of timers nor the batches matter.
        mark = timerValues.getCurrentWatermarkInMs()
        now = mark // 1000
        slots = sorted(k[0] for k in self.parked.keys()) if self.parked.exists() else []
        open_ = [(slot, np.frombuffer(self.parked.getValue((slot,))[0], _TASK)) for slot in slots if slot * SLOT < now]
        due = np.concatenate([np.zeros(0, _TASK), *[had[had["due"] < now] for _, had in open_]])
        if len(due):
            for slot, had in open_:
                self._put(self.parked, slot, had, had[had["due"] >= now])
            known = self._slots(self.health, _REPORT) if self.health.exists() else []
            at, good = _last(np.concatenate([np.zeros(0, _REPORT), *[had for _, had in known]]))
            asks = np.arange(len(due))
            while len(asks):
                last = np.searchsorted(at, due["due"][asks], "right")
                asks = asks[~good[last]]
                due["due"][asks] += due["every"][asks]
                asks = asks[due["due"][asks] < now]
            leaves = due["due"] < now
            self._add(self.parked, "due", due[~leaves])
            if leaves.any():
                yield pd.DataFrame({"error_class": key[0], "id": due["id"][leaves], "due": due["due"][leaves]})
        first = min([*(had["due"].min() for _, had in self._slots(self.parked, _TASK))], default=None) if self.parked.exists() else None
        if first is not None:
            self._wake(first, mark)
        if len(due) and known:
            # Of the slots before the earliest clock still running only the last can count.
            before = sorted(slot for slot, _ in known if (slot + 1) * SLOT <= (now if first is None else min(first, now)))
            for slot in before[:-1]:
                self.health.removeKey((slot,))

    def _wake(self, due: int, mark: int = -1) -> None:
        """Once the watermark has passed the second in which something is due."""
        self.handle.registerTimer(max(int(due) * 1000 + 999, mark + 1))

    @staticmethod
    def _slots(state, kind: np.dtype) -> list[tuple[int, np.ndarray]]:
        return [(k[0], np.frombuffer(v[0], kind)) for k, v in state.iterator()] if state.exists() else []

    @staticmethod
    def _put(state, slot: int, had: np.ndarray, now: np.ndarray) -> None:
        if not len(now):
            state.removeKey((slot,))
        elif len(now) != len(had):
            state.updateValue((slot,), (now.tobytes(),))

    @staticmethod
    def _add(state, by: str, rows: np.ndarray) -> None:
        """Rows into their slots; a slot that isn't touched is neither read nor written."""
        of = rows[by] // SLOT
        order = np.argsort(of, kind="stable")
        slots, starts = np.unique(of[order], return_index=True)
        for slot, part in zip(slots.tolist(), np.split(rows[order], starts[1:]), strict=True) if len(rows) else ():
            had = state.getValue((slot,))
            state.updateValue((slot,), ((had[0] if had else b"") + part.tobytes(),))

    def close(self) -> None:
        pass


def _last(reports: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The seconds of reports in order, and whether the last report was good by how many of them have passed: good before the first; of several in one second, one of them."""
    at, place = np.unique(reports["at"], return_inverse=True)
    good = np.zeros(len(at) + 1, dtype=bool)
    good[0] = True
    np.logical_or.at(good, place + 1, reports["ok"])
    return at, good


def come_due(parked: DataFrame, health: DataFrame, late: str = "0 seconds") -> DataFrame:
    """error_class, id, due of parked tasks once their class's cadence has passed, each once.

    parked: error_class, id, every (seconds; null never comes due), at; health: error_class, ok, at: the second stream.
    Timers run on event time, so the watermark is the clock: when something is due a task leaves if the class's
    last report until then was good (of several in one second, one of them; or there is none), else its clock starts again and the next probe is a whole
    cadence away. Classes are dealt to SHARDS, and each has the reports of its class. A shard wakes for its earliest
    clock and then takes all that is due at once; its state is rows in slots of time, so a batch costs what it touches.
    """
    prepared(parked.sparkSession)
    shard = F.pmod(F.xxhash64("id"), F.lit(SHARDS)).cast("int")
    zero = F.lit(0).cast("bigint")
    tasks = parked.where("id is not null").select("error_class", shard.alias("shard"), F.lit(False).alias("report"), "id", F.coalesce(F.col("every").cast("bigint"), zero).alias("every"), F.lit(False).alias("ok"), "at")
    reports = health.select("error_class", F.explode(F.sequence(F.lit(0), F.lit(SHARDS - 1))).alias("shard"), F.lit(True).alias("report"), zero.alias("id"), zero.alias("every"), F.coalesce("ok", F.lit(False)).alias("ok"), "at")
    both = tasks.unionByName(reports).where("at is not null").withWatermark("at", late).withColumn("sec", F.unix_seconds("at"))
    return both.groupBy("error_class", "shard").transformWithStateInPandas(_Unpark(), "error_class string, id bigint, due bigint", "Append", "EventTime")
