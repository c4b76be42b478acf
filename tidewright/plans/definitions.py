"""Workflow definitions: loading, proof of totality, fingerprints, and the graph between workflows."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where a step's outcome may lead besides another step.
TERMINALS = ("done", "failed", "deferred", "parked")


@dataclass(frozen=True)
class Step:
    name: str
    block: str
    outcomes: tuple[str, ...]
    on: dict[str, str]
    params: dict = field(default_factory=dict)
    max_visits: int = 5


@dataclass(frozen=True)
class Workflow:
    kind: str
    consumes: tuple[str, ...]
    emits: tuple[str, ...]
    steps: tuple[Step, ...]


def workflow(definition: dict) -> Workflow:
    """A workflow from its parsed YAML; unknown keys are refused."""
    extra = set(definition) - {"kind", "consumes", "emits", "steps"}
    if extra:
        raise ValueError(f"unknown keys: {', '.join(sorted(extra))}")
    steps = []
    for name, given in definition["steps"].items():
        s = {"on" if k is True else k: v for k, v in given.items()}  # YAML 1.1 reads a bare `on` as true
        bad = set(s) - {"block", "outcomes", "on", "params", "max_visits"}
        if bad:
            raise ValueError(f"{name}: unknown keys: {', '.join(sorted(bad))}")
        steps.append(Step(name, s["block"], tuple(s["outcomes"]), dict(s["on"]), s.get("params", {}), s.get("max_visits", 5)))
    return Workflow(definition["kind"], tuple(definition.get("consumes", ())), tuple(definition.get("emits", ())), tuple(steps))


def load(texts: list[str]) -> dict[str, Workflow]:
    """Workflows of YAML texts by kind; a kind declared twice is refused."""
    import yaml

    found: dict[str, Workflow] = {}
    for text in texts:
        w = workflow(yaml.safe_load(text))
        if w.kind in found:
            raise ValueError(f"kind {w.kind} is declared twice")
        problems = prove(w)
        if problems:
            raise ValueError(f"{w.kind}: " + "; ".join(problems))
        found[w.kind] = w
    return found


def prove(w: Workflow) -> list[str]:
    """What keeps a workflow from always ending: missing and phantom outcomes, unknown targets, unreachable steps, steps that no path leads out of."""
    problems, names = [], {s.name for s in w.steps}
    if not w.steps:
        return ["no steps"]
    for s in w.steps:
        problems += [f"{s.name}: outcome {o} has no target" for o in s.outcomes if o not in s.on]
        problems += [f"{s.name}: {o} is no outcome of {s.block}" for o in s.on if o not in s.outcomes]
        problems += [f"{s.name}: unknown target {t}" for t in s.on.values() if t not in names and t not in TERMINALS]
    after = {s.name: set(s.on.values()) for s in w.steps}
    seen, todo = set(), [w.steps[0].name]
    while todo:
        at = todo.pop()
        if at not in seen and at in names:
            seen.add(at)
            todo += after[at]
    problems += [f"{n}: can't be reached" for n in sorted(names - seen)]
    ends = {n for n in names if after[n] & set(TERMINALS)}
    while more := {n for n in names - ends if after[n] & ends}:
        ends |= more
    return problems + [f"{n}: no path ends" for n in sorted(names - ends)]


def fingerprint(w: Workflow) -> str:
    """SHA-256 of the definition with sorted keys; a change means running tasks must be looked at."""
    rows = [[s.name, s.block, sorted(s.outcomes), sorted(s.on.items()), s.params, s.max_visits] for s in w.steps]
    return hashlib.sha256(json.dumps([w.kind, rows], sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def edges(flows: DataFrame) -> DataFrame:
    """source, target, event from flows (kind, consumes, emits)."""
    a, b = flows.alias("a"), flows.alias("b")
    return a.join(b, F.col("a.emits") == F.col("b.consumes")).select(F.col("a.kind").alias("source"), F.col("b.kind").alias("target"), F.col("a.emits").alias("event")).distinct()


def depths(kinds: DataFrame, links: DataFrame) -> DataFrame:
    """kind, depth: steps from a root by breadth, each kind placed when first reached, so feedback edges don't push a kind down. Workflow graphs are small; the driver walks them."""
    names = [r[0] for r in kinds.distinct().orderBy("kind").collect()]
    after: dict[str, list[str]] = {}
    into = set()
    for s, g in links.select("source", "target").distinct().collect():
        after.setdefault(s, []).append(g)
        into |= {g} if g != s else set()
    depth = {n: 0 for n in names if n not in into} or {n: 0 for n in names[:1]}
    front = sorted(depth)
    while front:
        reached = sorted({g for s in front for g in after.get(s, ()) if g not in depth})
        depth |= {g: depth[front[0]] + 1 for g in reached}
        front = reached
    rows = [(n, depth.get(n, 0)) for n in names]
    return kinds.sparkSession.createDataFrame(rows, "kind string, depth int")


def outcome_problems(declared: DataFrame, dispatched: DataFrame) -> DataFrame:
    """Outcomes without a target (missing) and targets without an outcome (phantom)."""
    missing = declared.select("step", "outcome").subtract(dispatched.select("step", "outcome")).withColumn("problem", F.lit("missing"))
    phantom = dispatched.select("step", "outcome").subtract(declared.select("step", "outcome")).withColumn("problem", F.lit("phantom"))
    return missing.unionByName(phantom)
