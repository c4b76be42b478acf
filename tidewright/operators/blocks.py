"""Blocks: user functions with closed outcomes, run over rows in batches; and model calls that are checked and asked again."""

from __future__ import annotations

import json
import os
import re
import select
import shutil
import signal
import subprocess
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workers import importable, spread

RESULT = "id bigint, outcome string, result string, error_class string"


@dataclass(frozen=True)
class Block:
    """run(payload, params) gives (outcome, result); an outcome that isn't declared, or an exception, is the framework's fault."""

    name: str
    outcomes: tuple[str, ...]
    run: Callable[[dict, dict], tuple[str, dict]]


REGISTRY: dict[str, Block] = {}


def block(name: str, outcomes: tuple[str, ...]):
    """Registers a function as a block; a name is given once, and there is an outcome."""
    if name in REGISTRY:
        raise ValueError(f"block {name} is registered twice")
    if not outcomes:
        raise ValueError(f"block {name} has no outcome")

    def put(f: Callable[[dict, dict], tuple[str, dict]]) -> Callable[[dict, dict], tuple[str, dict]]:
        REGISTRY[name] = Block(name, tuple(outcomes), f)
        return f

    return put


def run_one(b: Block, payload: dict, params: dict | None = None) -> tuple[str, str | None, str | None]:
    """outcome, result as JSON, error class of one payload; also what tests of a block call."""
    try:
        outcome, result = b.run(payload, params or {})
    except Exception as e:
        return "failed", json.dumps({"error": str(e)}), "framework_bug"
    if outcome not in b.outcomes:
        return "failed", json.dumps({"error": f"undeclared outcome {outcome}"}), "framework_bug"
    return outcome, json.dumps(result, sort_keys=True, separators=(",", ":"), ensure_ascii=False), None


def run_block(tasks: DataFrame, name: str, params: dict | None = None) -> DataFrame:
    """id, outcome, result, error_class for tasks (id, payload as JSON), in batches in the workers; no shuffle."""
    importable(tasks.sparkSession)
    b = REGISTRY[name]

    def go(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = [run_one(b, json.loads(p), params) for p in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([o[i] for o in out], pa.string()) for i in range(3)]], names=["id", "outcome", "result", "error_class"])

    return tasks.select(F.col("id").cast("bigint"), "payload").mapInArrow(go, RESULT)


def run_agent(prompts: DataFrame, backend: Callable[[str, int], str], check: Callable[[str], str | None], asks: int = 3) -> DataFrame:
    """id, verdict, asked, error_class for prompts (id, prompt).

    The backend is asked up to `asks` times; each answer that check() objects to goes back with the objection. A
    prompt without a valid answer ends as agent_invalid_output, one whose backend fails as agent_backend.
    """

    importable(prompts.sparkSession)

    def one(prompt: str) -> tuple[str | None, int, str | None]:
        text = prompt
        for n in range(1, asks + 1):
            try:
                answer = backend(text, n)
            except Exception:
                return None, n, "agent_backend"
            problem = check(answer)
            if problem is None:
                return answer, n, None
            text = f"{prompt}\n\n{problem}"
        return None, asks, "agent_invalid_output"

    def go(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = [one(p) for p in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.string())], names=["id", "verdict", "asked", "error_class"])

    return prompts.select(F.col("id").cast("bigint"), "prompt").mapInArrow(go, "id bigint, verdict string, asked int, error_class string")


class Runner:
    """Runs commands one after another, each as a process of its own, as subprocess.run does but for less: a program is looked up once, the environment is made once, and posix_spawn() starts the child."""

    def __init__(self, timeout_s: float):
        self.timeout_s, self.env, self.programs = timeout_s, dict(os.environb), {}

    def run(self, cmd: list[str], cwd: str | None) -> tuple[int, bytes, bytes]:
        """Exit code (negative: a signal), output, errors; raises what subprocess.run raises.

        posix_spawn() knows no folder; what has one, isn't found or doesn't start goes to subprocess.run, which also
        tells why.
        """
        started = self._started(cmd) if cmd and cwd is None and hasattr(os, "pidfd_open") else None
        if started:
            return self._ended(cmd, *started)
        done = subprocess.run(cmd, cwd=cwd, capture_output=True, timeout=self.timeout_s, stdin=subprocess.DEVNULL, check=False)
        return done.returncode, done.stdout, done.stderr

    def _started(self, cmd: list[str]) -> tuple[int, int, int] | None:
        """Process, and where its output and errors are read; None if it didn't start."""
        if cmd[0] not in self.programs:
            self.programs[cmd[0]] = shutil.which(cmd[0])
        if self.programs[cmd[0]] is None:
            return None
        (out, out_end), (err, err_end) = os.pipe(), os.pipe()
        files = [(os.POSIX_SPAWN_OPEN, 0, os.devnull, os.O_RDONLY, 0), (os.POSIX_SPAWN_DUP2, out_end, 1), (os.POSIX_SPAWN_DUP2, err_end, 2)]
        try:
            return os.posix_spawn(self.programs[cmd[0]], cmd, self.env, file_actions=files, setsigdef=(signal.SIGPIPE, signal.SIGXFSZ)), out, err
        except BaseException as e:
            os.close(out)
            os.close(err)
            if isinstance(e, OSError):
                return None
            raise
        finally:
            os.close(out_end)
            os.close(err_end)

    def _ended(self, cmd: list[str], pid: int, out: int, err: int) -> tuple[int, bytes, bytes]:
        """Reads until both ends are closed and the process is gone; one that overruns is killed."""
        end, told, waits, gone = time.monotonic() + self.timeout_s, {out: [], err: []}, select.poll(), os.pidfd_open(pid)

        def ready() -> list[int]:
            left = end - time.monotonic()
            found = waits.poll(left * 1000) if left > 0 else None
            if not found:
                raise subprocess.TimeoutExpired(cmd, self.timeout_s)
            return [fd for fd, _ in found]

        try:
            for fd in told:
                waits.register(fd, select.POLLIN)
            open_ends = len(told)
            while open_ends:
                for fd in ready():
                    data = os.read(fd, 65536)
                    if data:
                        told[fd].append(data)
                    else:
                        waits.unregister(fd)
                        open_ends -= 1
            waits.register(gone, select.POLLIN)
            ready()
        except BaseException:
            signal.pidfd_send_signal(gone, signal.SIGKILL)
            os.waitpid(pid, 0)
            raise
        finally:
            for fd in (out, err, gone):
                os.close(fd)
        return os.waitstatus_to_exitcode(os.waitpid(pid, 0)[1]), b"".join(told[out]), b"".join(told[err])


RAN = "id bigint, place int, name string, exit_code int, out string, err string"


def run_commands(commands: DataFrame, timeout_s: float = 60, kept: int = 10_000) -> DataFrame:
    """id, place, name, exit_code, out, err of commands (id, place, name, cmd: array of words, cwd or null), run in the workers without a shell, in batches and without a shuffle; out and err are the last `kept` characters. A command that overruns or can't start has no exit code, and err tells why.

    Spark may run a task again: a command is for looking, or leaves the same when it is run twice.
    """
    importable(commands.sparkSession)

    def one(runner: Runner, cmd: list[str], cwd: str | None) -> tuple[int | None, str, str]:
        try:
            code, out, err = runner.run(cmd, cwd)
        except subprocess.TimeoutExpired:
            return None, "", "timeout"
        except OSError as e:
            return None, "", str(e)
        return code, out.decode("utf-8", "replace")[-kept:], err.decode("utf-8", "replace")[-kept:]

    def go(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runner = Runner(timeout_s)
        for part in parts:
            found = [one(runner, c, w) for c, w in zip(part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], *[pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int32(), pa.string(), pa.string()))]], names=["id", "place", "name", "exit_code", "out", "err"])

    return spread(commands.select(F.col("id").cast("bigint"), F.col("place").cast("int"), "name", "cmd", F.col("cwd").cast("string"))).mapInArrow(go, RAN)


def rechecked(ran: DataFrame, expect: DataFrame) -> DataFrame:
    """id, outcome (confirmed, refuted, timeout) of commands that were run once an id: confirmed if all that is expected holds. expect: id, exit_code (null: any), nonzero (null or false: any), out_sha (null: any)."""
    j = ran.join(expect.withColumnRenamed("exit_code", "want"), "id", "left")
    holds = F.coalesce(F.col("exit_code") == F.col("want"), F.col("want").isNull()) & (~F.coalesce("nonzero", F.lit(False)) | (F.col("exit_code") != 0)) & F.coalesce(F.sha2("out", 256) == F.col("out_sha"), F.col("out_sha").isNull())
    return j.select("id", F.when(F.col("exit_code").isNull(), "timeout").when(holds, "confirmed").otherwise("refuted").alias("outcome"))


def suite(ran: DataFrame, retryable: dict[str, list[int]]) -> DataFrame:
    """id, outcome (green, red, red_retryable, timeout), failed: the first check by place that failed decides; retryable lists exit codes by check."""
    bad = F.col("exit_code").isNull() | (F.col("exit_code") != 0)
    first = F.min(F.when(bad, F.struct("place", "name", "exit_code")))
    per = ran.groupBy("id").agg(first.alias("f"))
    soft = F.lit(False)
    for name, codes in retryable.items():
        soft = soft | ((F.col("f.name") == name) & F.col("f.exit_code").isin(*codes))
    outcome = F.when(F.col("f").isNull(), "green").when(F.col("f.exit_code").isNull(), "timeout").when(soft, "red_retryable").otherwise("red")
    return per.select("id", outcome.alias("outcome"), F.col("f.name").alias("failed"))


def notifications(events: DataFrame, rules: list[tuple[str, str, list]]) -> DataFrame:
    """Commands (id, place, name, cmd, cwd) for run_commands(): one for each event (id, name, payload: JSON) and rule that it matches.

    rules: name, pattern of event names (`*` stands for any part of them), argv. Words of argv may hold {event.name},
    {event.id} and {payload.x}; a value that isn't there is an error.
    """
    from ..functions import json_values as jv

    event = F.to_variant_object(F.struct("name", F.col("id").alias("id")))
    roots = {"event": event, "payload": F.try_parse_json("payload")}
    found = []
    for place, (name, pattern, argv) in enumerate(rules):
        hits = F.col("name").rlike("^" + ".*".join(re.escape(p) for p in pattern.split("*")) + "$")
        cmd = F.array(*[jv.spoken(jv.filled(w, roots)) for w in argv])
        found.append(events.where(hits).select("id", F.lit(place).alias("place"), F.lit(name).alias("name"), cmd.alias("cmd"), F.lit(None).cast("string").alias("cwd")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
