"""Staged effects of steps: one frame of operations, checked, split by kind, and committed together."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import checks as ck
from ..functions import json_values as jv
from ..sources.ledger import Ledger
from . import steps as st
from .workers import importable

_TEXT, _TEXTS = {"type": "string"}, {"type": ["string", "null"]}


def _args(required: dict, optional: dict | None = None) -> dict:
    return {"type": "object", "required": list(required), "properties": required | (optional or {}), "additionalProperties": False}


#: What each operation's arguments are.
OPERATIONS = {
    "upsert_item": _args({"key": _TEXT, "title": _TEXT, "source": _TEXT, "repo": _TEXT}, {"detail": _TEXTS, "severity": _TEXTS}),
    "transition": _args({"item": _TEXT, "to_state": _TEXT}, {"evidence": _TEXTS}),
    "emit_event": _args({"name": _TEXT, "payload": {"type": "object"}}),
    "store_embedding": _args({"repo": _TEXT, "path": _TEXT, "symbol": _TEXTS, "model_sha": _TEXT, "vector": {"type": "array", "items": {"type": "number"}}}),
    "fanout": _args({"name": _TEXT, "join_event": _TEXT, "payloads": {"type": "array", "items": {"type": "object"}}}),
}
TABLES = {
    "outcomes": "task bigint, step string, outcome string, error_class string, problem string",
    "items": "key string, title string, source string, repo string, severity string, state string, seq bigint",
    "transitions": "item string, from_state string, to_state string, task bigint, seq bigint",
    "events": "name string, payload string, task bigint, seq bigint",
    "tasks": "kind string, payload_hash string, event string, seq bigint",
    "groups": "group_id string, task bigint, join_event string, expect bigint",
    "objects": "object_id string, repo string, path string, symbol string",
    "embeddings": "object_id string, model_sha string, vector array<double>, seq bigint",
}


def checked(effects: DataFrame) -> DataFrame:
    """effects (task, step, outcome, seq, op, args: JSON text) with value (args as a VARIANT) and problem: what keeps an operation from being applied, null if nothing does. A row without an op is a step that staged nothing."""
    effects = effects.withColumn("value", F.try_parse_json("args"))
    name = _text("name")
    problem = F.when(F.col("op").isNull(), F.lit(None).cast("string"))
    for op, schema in OPERATIONS.items():
        of = F.try_element_at(jv.problems_of(F.col("value"), schema), F.lit(1))
        if op in ("emit_event", "fanout"):
            of = F.coalesce(of, F.when(~ck.is_event_name(name), F.concat(F.lit("$.name: no event name: "), name)))
        problem = problem.when(F.col("op") == op, of)
    return effects.withColumn("problem", problem.otherwise(F.concat(F.lit("unknown operation "), F.col("op"))))


def _text(path: str) -> Column:
    return F.try_variant_get("value", f"$.{path}", "string")


#: Arguments that are texts, by their columns; an event's or a fan-out's name is `event`.
_TEXT_ARGS = {c: c for c in ("key", "title", "source", "repo", "severity", "item", "to_state", "join_event", "path", "symbol", "model_sha")} | {"event": "name"}


def read_out(ops: DataFrame) -> DataFrame:
    """checked() operations with their arguments as columns, null where an operation has none: nothing later parses them again."""
    payload = F.to_json(F.try_variant_get("value", "$.payload", "variant")).alias("payload")
    payloads = F.transform(F.try_variant_get("value", "$.payloads", "array<variant>"), lambda p: F.to_json(p)).alias("payloads")
    vector = F.try_variant_get("value", "$.vector", "array<double>").alias("vector")
    return ops.select("task", "step", "outcome", "seq", "op", "problem", *[_text(a).alias(c) for c, a in _TEXT_ARGS.items()], payload, payloads, vector)


def moved(moves: DataFrame, states: DataFrame, edges: dict[str, list[str]]) -> DataFrame:
    """moves (item, to_state, seq, ...) with from_state and legal, taken one after another by seq from the items' states (item, state; an unknown item has none).

    A move that isn't legal leaves the item where it is. An item's moves of one commit pass in order through one task, which
    holds a batch of them and where the item is.
    """
    importable(moves.sparkSession)
    rest = [c for c in moves.columns if c not in ("item", "seq", "to_state")]
    listed = moves.select("item", "seq", "to_state", *rest, F.lit(None).cast("string").alias("state"), F.lit(True).alias("moves"))
    # Where an item is comes as a row ahead of its moves: no join, so neither side of one has to fit anywhere.
    others = [F.lit(None).cast(listed.schema[c].dataType).alias(c) for c in ("seq", "to_state", *rest)]
    at_first = states.where("item is not null").select("item", *others, F.col("state").cast("string").alias("state"), F.lit(False).alias("moves"))
    ordered = listed.unionByName(at_first).repartition("item").sortWithinPartitions("item", "moves", "seq", "to_state", *rest)
    schema = T.StructType([*listed.drop("state", "moves").schema.fields, T.StructField("from_state", T.StringType()), T.StructField("legal", T.BooleanType())])

    def go(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = at = None
        for part in parts:
            told, legal = [], []
            for now, to_state, state, move in zip(*(part.column(c).to_pylist() for c in ("item", "to_state", "state", "moves")), strict=True):
                if now != item:
                    item, at = now, None
                if not move:
                    at = state
                    continue
                told.append(at)
                legal.append(to_state in edges.get(at, ()))
                at = to_state if legal[-1] else at
            kept = part.filter(part.column("moves")).drop_columns(["state", "moves"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(told, pa.string()), pa.array(legal, pa.bool_())], names=[*kept.schema.names, "from_state", "legal"])

    return ordered.mapInArrow(go, schema)


def object_id(repo: Column, path: Column, symbol: Column) -> Column:
    """Identity of a code object; a null symbol is the file itself."""
    return F.sha2(F.concat_ws("\x1f", repo, path, F.coalesce(F.concat(F.lit("s"), symbol), F.lit("f"))), 256)


def commit(ledger: Ledger, name: str, effects: DataFrame, subscriptions: DataFrame, edges: dict[str, list[str]], first_state: str = "found") -> bool:
    """Applies the effects that steps have staged (task, step, outcome, seq, op, args) as one commit; False if it was there already.

    A step's effects are applied together or not at all: one operation that is malformed, unknown or an illegal move
    fails the step as framework_bug, its outcome row tells why, and nothing else of it is seen. Otherwise: items are
    inserted unless their key is known; moves are audited and told as item.<state>; events are appended, and every kind
    that consumes one gets a task unless a task of that kind and payload is known; fan-outs open their group, one child
    event a payload, and an empty group's join event at once; vectors are stored under their object, which is made if
    it isn't known. Each table's rows are staged as files, and one manifest makes all of them visible.

    Whatever grows with the effects or the ledger is merge-joined: Spark judges it by its compressed files, which are far
    smaller than its rows in the driver's memory. Only the subscriptions, part of the definitions, are sent to all tasks.
    """
    if name in ledger.steps():
        return False
    importable(ledger.spark)
    known = {t: ledger.table(t, schema) for t, schema in TABLES.items()}
    ops = ledger.kept(f"{name}-checked", read_out(checked(effects)))
    wrong = ops.where("problem is not null").select("task", "step", "problem", "seq")
    born = known["items"].select(F.col("key").alias("item"), F.col("state"), F.lit(-1).cast("bigint").alias("seq"))
    gone = known["transitions"].select("item", F.col("to_state").alias("state"), "seq")
    new = ops.where("op = 'upsert_item'").select("task", "step", "seq", F.col("key").alias("item"))
    moves = ops.where("op = 'transition'").select("task", "step", "seq", "item", "to_state")

    def legal_moves(without: DataFrame) -> DataFrame:
        kept = moves.join(without.hint("merge"), ["task", "step"], "left_anti")
        added = new.join(without.hint("merge"), ["task", "step"], "left_anti").select("item", F.lit(first_state).alias("state"), F.lit(-2).cast("bigint").alias("seq"))
        states = born.unionByName(gone).unionByName(added).groupBy("item").agg(F.max_by("state", "seq").alias("state"))
        return moved(kept, states, edges)

    # A step that fails takes its moves and items with it, which can make moves of others illegal: until no more steps fail.
    failed = wrong
    while True:
        bad = failed.select("task", "step").distinct()
        taken = ledger.kept(f"{name}-moves", legal_moves(bad))
        text = F.concat(F.lit("$.to_state: "), F.coalesce("from_state", F.lit("no item")), F.lit(" to "), "to_state", F.lit(" is no legal move"))
        more = taken.where("not legal").select("task", "step", text.alias("problem"), "seq")
        if not more.limit(1).count():
            break
        failed = ledger.kept(f"{name}-failed", failed.unionByName(more))
    why = failed.groupBy("task", "step").agg(F.min_by("problem", "seq").alias("why"))
    ops = ledger.kept(f"{name}-settled", ops.drop("problem").join(why.hint("merge"), ["task", "step"], "left"))
    steps = ops.groupBy("task", "step").agg(F.min_by("outcome", "seq").alias("outcome"), F.min("why").alias("problem"))
    fault = F.col("problem").isNotNull()
    outcomes = steps.select("task", "step", F.when(fault, "failed").otherwise(F.col("outcome")).alias("outcome"), F.when(fault, "framework_bug").alias("error_class"), "problem")
    good = ops.where("why is null and op is not null")
    items = good.where("op = 'upsert_item'").select("key", "title", "source", "repo", "severity", F.lit(first_state).alias("state"), "seq")
    first = items.groupBy("key").agg(F.min_by(F.struct("title", "source", "repo", "severity", "state", "seq"), "seq").alias("r")).select("key", "r.*")
    items = first.join(known["items"].select("key").hint("merge"), "key", "left_anti")
    payload = lambda *pairs: jv.canonical(F.concat(F.lit("{"), *pairs, F.lit("}")))
    quoted = lambda c: F.to_json(c.cast("variant"))
    told = taken.select(F.concat(F.lit("item."), F.lower("to_state")).alias("name"), payload(F.lit('"from":'), F.coalesce(quoted(F.col("from_state")), F.lit("null")), F.lit(',"item":'), quoted(F.col("item"))).alias("payload"), "task", "seq")
    said = good.where("op = 'emit_event'").select(F.col("event").alias("name"), jv.canonical(F.col("payload")).alias("payload"), "task", "seq")
    fans = good.where("op = 'fanout'").select("task", F.col("event").alias("name"), "join_event", "payloads")
    groups, _ = st.fanned_out(fans, subscriptions)
    new_groups = ledger.kept(f"{name}-groups", groups.join(known["groups"].select("group_id").hint("merge"), "group_id", "left_anti"))
    # A child is one event however many kinds consume it.
    _, children = st.fanned_out(fans, subscriptions.groupBy("event").agg(F.min("kind").alias("kind")))
    each = children.join(new_groups.select("group_id", "task").hint("merge"), "group_id")
    fired = new_groups.where("complete").select(F.col("join_event").alias("name"), payload(F.lit('"join_group":"'), F.col("group_id"), F.lit('","total":0')).alias("payload"), "task", F.lit(0).cast("bigint").alias("seq"))
    events = ledger.kept(f"{name}-events", told.unionByName(said).unionByName(each.select("name", "payload", "task", F.col("idx").alias("seq"))).unionByName(fired))
    arrivals = events.join(F.broadcast(subscriptions.withColumnRenamed("event", "name")), "name").select("kind", F.sha2(F.concat("name", F.lit("\n"), "payload"), 256).alias("payload_hash"), F.col("name").alias("event"), "seq")
    opened = arrivals.groupBy("kind", "payload_hash", "event").agg(F.min("seq").alias("seq"))  # a hash has one event: it is in it
    opened = opened.join(known["tasks"].select("kind", "payload_hash").hint("merge"), ["kind", "payload_hash"], "left_anti")
    vectors = good.where("op = 'store_embedding'").select("repo", "path", "symbol", "model_sha", "vector", "seq")
    vectors = vectors.withColumn("object_id", object_id(F.col("repo"), F.col("path"), F.col("symbol")))
    objects = vectors.select("object_id", "repo", "path", "symbol").distinct().join(known["objects"].select("object_id").hint("merge"), "object_id", "left_anti")
    stored = vectors.groupBy("object_id", "model_sha").agg(F.max(F.struct("seq", "vector")).alias("r")).select("object_id", "model_sha", "r.vector", "r.seq")
    staged = {
        "outcomes": outcomes,
        "items": items,
        "transitions": taken.select("item", "from_state", "to_state", "task", "seq"),
        "events": events,
        "tasks": opened,
        "groups": new_groups.select("group_id", "task", "join_event", "expect"),
        "objects": objects,
        "embeddings": stored,
    }
    done = ledger.commit(name, {t: df.select(*known[t].columns) for t, df in staged.items()})
    ledger.forget(name)
    return done


def current_vectors(ledger: Ledger) -> DataFrame:
    """object_id, repo, path, symbol, model_sha, vector: of each object and model the vector stored last."""
    order = Window.partitionBy("object_id", "model_sha").orderBy(F.desc("seq"))
    last = ledger.table("embeddings", TABLES["embeddings"]).withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n", "seq")
    return ledger.table("objects", TABLES["objects"]).join(last.hint("merge"), "object_id")
