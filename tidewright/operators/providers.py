"""Context of tasks: providers registered by name turn rows into sections (id, name, value as JSON); checks of what a definition asks of them."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeResult

from ..functions import json_values as jv
from .workers import importable

#: The channels that a selection can weigh.
CHANNELS = ("lexical", "semantic", "recency", "prior", "boost", "utility")
PROVIDERS: dict[str, type] = {}


def context_provider(name: str) -> Callable[[type], type]:
    """Registers a table function as the provider of a name, once. It has eval(row) for each row of its partition, in order, and may have terminate(); both yield values that JSON can hold."""
    if name in PROVIDERS:
        raise ValueError(f"context provider {name} is registered twice")

    def put(cls: type) -> type:
        PROVIDERS[name] = cls
        return cls

    return put


def provided(spark: SparkSession, name: str, rows: DataFrame, by: str, order: str) -> DataFrame:
    """id, name, value: what the provider of a name makes of all rows with one id (column by), in an order.

    The provider runs as a table function over TABLE ... PARTITION BY: Spark deals the rows by their id and each
    partition is streamed through it, so it holds what it keeps itself and no group is collected. The columns come
    from analyze().
    """
    if name not in PROVIDERS:
        raise ValueError(f"no context provider {name}; there are {', '.join(sorted(PROVIDERS)) or 'none'}")
    importable(spark)
    inner, kind = PROVIDERS[name], rows.schema[by].dataType

    class Section:
        @staticmethod
        def analyze(*_) -> AnalyzeResult:
            return AnalyzeResult(StructType([StructField("id", kind), StructField("value", StringType())]))

        def __init__(self):
            self._inner, self._id = inner(), None

        def _told(self, values):
            for v in values or ():
                yield self._id, json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)

        def eval(self, row):
            self._id = row[by]
            yield from self._told(self._inner.eval(row))

        def terminate(self):
            if hasattr(self._inner, "terminate"):
                yield from self._told(self._inner.terminate())

    view = f"provided_{name.replace('.', '_')}"
    spark.udtf.register(f"context_{name.replace('.', '_')}", F.udtf(Section))
    rows.createOrReplaceTempView(view)
    out = spark.sql(f"SELECT id, value FROM context_{name.replace('.', '_')}(TABLE({view}) PARTITION BY `{by}` ORDER BY `{order}`)")
    return out.select("id", F.lit(name).alias("name"), "value")


def payload_sections(tasks: DataFrame) -> DataFrame:
    """The payload of each task (id, payload: JSON) as it is."""
    return tasks.select("id", F.lit("payload").alias("name"), F.col("payload").alias("value"))


def pack_sections(tasks: DataFrame, params: dict) -> DataFrame:
    """The pack's parameters, the same for every task."""
    return tasks.select("id", F.lit("pack").alias("name"), F.lit(jv.dumped(params)).alias("value"))


def notes_sections(tasks: DataFrame, notes: DataFrame) -> DataFrame:
    """Declared files (name, content) as one object by name, the same for every task."""
    one = notes.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "content"))))).alias("value"))
    # One row.
    return tasks.select("id").crossJoin(F.broadcast(one)).select("id", F.lit("notes").alias("name"), "value")


def _positive(v: object) -> bool:
    return isinstance(v, int) and not isinstance(v, bool) and v >= 1


def _number(v: object) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def _names(v: object) -> bool:
    return isinstance(v, dict) and all(isinstance(k, str) for k in v)


def notes_problem(spec: dict, exists: Callable[[str], bool]) -> str | None:
    """What keeps a notes context from being used; a path with a placeholder is looked up when its task runs."""
    paths = spec.get("files")
    if not isinstance(paths, list) or not paths:
        return "notes: `files` is a list of paths and not empty"
    for p in paths:
        if not isinstance(p, str):
            return f"notes: {p!r} is no path"
        if "{" not in p and not exists(p):
            return f"notes: {p} doesn't exist"
    return None


def retrieval_problem(spec: dict, models: dict) -> str | None:
    """What keeps a retrieval context from being used."""
    if spec.get("model") not in models:
        return f"retrieval: `model` names one of {', '.join(sorted(models)) or 'no models'}"
    if not isinstance(spec.get("query"), str) or not spec["query"]:
        return "retrieval: `query` is a text and not empty"
    return None if _positive(spec.get("k", 5)) else "retrieval: `k` is a positive integer"


def select_problem(spec: dict, corpora: dict, agents: dict | None = None) -> str | None:
    """What keeps a select context from being used."""
    if spec.get("corpus") not in corpora:
        return f"select: `corpus` names one of {', '.join(sorted(corpora)) or 'no corpora'}"
    asked = spec.get("query")
    asked = asked if isinstance(asked, list) else [asked]
    if not asked or not all(isinstance(q, str) and q for q in asked):
        return "select: `query` is a text, or a list of texts, and none is empty"
    rules: list[tuple[str, Callable[[object], bool], str]] = [
        *((f, _positive, "a positive integer") for f in ("k", "max_chars", "include_all_under", "max_bytes")),
        ("dedup", lambda v: isinstance(v, bool), "true or false"),
        ("diversify", lambda v: _number(v) and 0 <= v <= 1, "a number from 0 to 1"),
        *((f, _names, "a mapping of columns to values") for f in ("filter", "boost")),
        ("weights", lambda v: _names(v) and all(_number(x) and x >= 0 for x in v.values()), "a mapping of channels to numbers from 0"),
        ("rerank", _names, "a mapping"),
    ]
    for name, good, what in rules:
        if spec.get(name) is not None and not good(spec[name]):
            return f"select: `{name}` is {what}"
    if unknown := sorted(set(spec.get("weights") or {}) - set(CHANNELS)):
        return f"select: no channel {', '.join(unknown)}; there are {', '.join(CHANNELS)}"
    if (judge := spec.get("rerank")) is not None:
        if unknown := sorted(set(judge) - {"llm", "window", "timeout_s"}):
            return f"select: rerank has no {', '.join(unknown)}"
        if judge.get("llm") not in (agents or {}):
            return f"select: `rerank.llm` names one of {', '.join(sorted(agents or {})) or 'no agents'}"
        for f in ("window", "timeout_s"):
            if judge.get(f) is not None and not _positive(judge[f]):
                return f"select: `rerank.{f}` is a positive integer"
    return None
