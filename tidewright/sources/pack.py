"""A pack: one YAML file of settings for everything that reads the ledger, checked as a whole when it is loaded."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions.checks import EVENT_NAME, IDENTIFIER
from ..functions.json_values import PLACEHOLDER
from ..operators.providers import notes_problem, retrieval_problem, select_problem
from ..operators.queue import POLICY_SCHEMA, build_policy
from ..plans.definitions import Workflow, load
from ..plans.panels import KINDS, guard

SECTIONS = ("name", "paths", "params", "models", "corpora", "agents", "retry", "schedule", "lanes", "item_states", "panels", "contexts", "workflows")
#: What an entry of each section may and must have.
FIELDS = {
    "models": ({"hashing", "path", "sha256", "base_url", "model"}, set()),
    "corpora": ({"table", "text", "key", "ts", "weight", "embed_with", "summarize_with", "track"}, {"table", "text"}),
    "panels": ({"kind", "sql", "title"}, {"kind", "sql"}),
}
_EVERY = re.compile(r"([0-9]+)([smhd])")
_UNITS = {"s": 1, "m": 60, "h": 3_600, "d": 86_400}


class PackError(ValueError):
    """What is wrong with a pack, and where."""


def seconds(spec: object) -> int:
    """Seconds of 90, '30s', '5m', '6h' or '1d'; anything else, zero included, is refused."""
    if isinstance(spec, int) and not isinstance(spec, bool) and spec > 0:
        return spec
    m = _EVERY.fullmatch(spec) if isinstance(spec, str) else None
    if m is None or not int(m[1]):
        raise PackError(f"every: {spec!r} is no span of time")
    return int(m[1]) * _UNITS[m[2]]


def _placed(value: object, paths: dict[str, str]) -> object:
    """value with {paths.x} filled in; other placeholders stay for the run."""
    if isinstance(value, dict):
        return {k: _placed(v, paths) for k, v in value.items()}
    if isinstance(value, list):
        return [_placed(v, paths) for v in value]
    if not isinstance(value, str):
        return value

    def fill(m: re.Match) -> str:
        root, _, name = m[1].partition(".")
        if root != "paths":
            return m[0]
        if name not in paths:
            raise PackError(f"no path {name}; there are {', '.join(sorted(paths)) or 'none'}")
        return paths[name]

    return PLACEHOLDER.sub(fill, value)


@dataclass(frozen=True)
class Pack:
    """A checked pack; tables() gives what Spark joins with."""

    name: str
    params: dict = field(default_factory=dict)
    models: dict = field(default_factory=dict)
    corpora: dict = field(default_factory=dict)
    agents: dict = field(default_factory=dict)
    policy: list = field(default_factory=list)
    schedule: list = field(default_factory=list)
    lanes: dict = field(default_factory=dict)
    item_states: dict = field(default_factory=dict)
    panels: dict = field(default_factory=dict)
    contexts: dict = field(default_factory=dict)
    workflows: dict[str, Workflow] = field(default_factory=dict)

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """policy, lanes, schedule, subscriptions and moves as tables for the operators of the queue."""
        subscribed = [(event, w.kind) for w in self.workflows.values() for event in w.consumes]
        moves = [(a, b) for a, bs in self.item_states.items() for b in bs]
        return {
            "policy": spark.createDataFrame(self.policy, POLICY_SCHEMA),
            "lanes": spark.createDataFrame(list(self.lanes.items()), "lane string, cap int"),
            "schedule": spark.createDataFrame(self.schedule, "event string, every int"),
            "subscriptions": spark.createDataFrame(subscribed, "event string, kind string"),
            "moves": spark.createDataFrame(moves, "from_state string, to_state string"),
        }


def _entries(doc: dict, section: str) -> dict:
    found = doc.get(section) or {}
    if not isinstance(found, dict) or not all(isinstance(k, str) for k in found):
        raise PackError(f"{section}: a mapping of names")
    known, needed = FIELDS.get(section, (None, set()))
    for name, entry in found.items():
        if known is not None:
            if not isinstance(entry, dict):
                raise PackError(f"{section}.{name}: a mapping")
            if unknown := sorted(set(entry) - known):
                raise PackError(f"{section}.{name}: unknown keys {', '.join(unknown)}")
            if lacking := sorted(needed - set(entry)):
                raise PackError(f"{section}.{name}: {', '.join(lacking)} missing")
    return found


def pack(text: str, workflows: list[str] | None = None, root: str = ".") -> Pack:
    """A pack of YAML text and the texts of its workflows. Every section is checked, and what refers to another: nothing is found out at run time that can be now."""
    import yaml

    doc = yaml.safe_load(text)
    if not isinstance(doc, dict) or not isinstance(doc.get("name"), str):
        raise PackError("a pack is a mapping with a name")
    if unknown := sorted(set(map(str, doc)) - set(SECTIONS)):
        raise PackError(f"unknown sections {', '.join(unknown)}")
    doc = _placed(doc, {k: os.path.join(root, v) for k, v in (doc.get("paths") or {}).items()})
    models, corpora, agents, panels = (_entries(doc, s) for s in ("models", "corpora", "agents", "panels"))
    for name, m in models.items():
        if len(ways := {"hashing", "path", "base_url"} & set(m)) != 1 or ("path" in ways and "sha256" not in m) or ("base_url" in ways and "model" not in m):
            raise PackError(f"models.{name}: hashing, or a path with its sha256, or a base_url with its model")
    for name, c in corpora.items():
        for f in ("table", "text", "key", "ts", "weight"):
            if f in c and not re.fullmatch(IDENTIFIER, str(c[f])):
                raise PackError(f"corpora.{name}: {c[f]!r} is no name of a column or table")
        if c.get("embed_with", "hashing") != "hashing" and c["embed_with"] not in models:
            raise PackError(f"corpora.{name}: no model {c['embed_with']}")
        if "summarize_with" in c and c["summarize_with"] not in agents:
            raise PackError(f"corpora.{name}: no agent {c['summarize_with']}")
    for name, p in panels.items():
        if p["kind"] not in KINDS:
            raise PackError(f"panels.{name}: no kind {p['kind']}")
        try:
            guard(p["sql"])
        except ValueError as e:
            raise PackError(f"panels.{name}: {e}") from e
    try:
        policy = build_policy(doc.get("retry"))
        flows = load(workflows or [])
    except ValueError as e:
        raise PackError(str(e)) from e
    lanes = _entries(doc, "lanes")
    if any(isinstance(c, bool) or not isinstance(c, int) or c < 1 for c in lanes.values()):
        raise PackError("lanes: a positive number of workers each")
    states = _entries(doc, "item_states")
    if lost := sorted({b for bs in states.values() for b in bs or ()} - set(states)):
        raise PackError(f"item_states: {', '.join(lost)} lead on but aren't there")
    schedule = []
    for i, e in enumerate(doc.get("schedule") or []):
        if not isinstance(e, dict) or set(e) - {"event", "every", "data"} or not re.fullmatch(EVENT_NAME, str(e.get("event"))):
            raise PackError(f"schedule[{i}]: event (a dotted name), every, and data")
        schedule.append((e["event"], seconds(e.get("every"))))
    contexts = _entries(doc, "contexts")
    checks = {"notes": lambda s: notes_problem(s, os.path.exists), "retrieval": lambda s: retrieval_problem(s, models), "select": lambda s: select_problem(s, corpora, agents)}
    for name, spec in contexts.items():
        kind = spec.get("provider") if isinstance(spec, dict) else None
        if kind not in checks:
            raise PackError(f"contexts.{name}: provider is one of {', '.join(sorted(checks))}")
        if problem := checks[kind]({k: v for k, v in spec.items() if k != "provider"}):
            raise PackError(f"contexts.{name}: {problem}")
    return Pack(doc["name"], doc.get("params") or {}, models, corpora, agents, policy, schedule, lanes, {k: list(v or ()) for k, v in states.items()}, panels, contexts, flows)
