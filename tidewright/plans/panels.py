"""Read-only SQL panels with bound parameters."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_CAP = 500


def parameters(sql: str) -> list[str]:
    """Names of :parameters, in order of first use."""
    return list(dict.fromkeys(re.findall(r"(?<![:\w]):([A-Za-z_]\w*)", sql)))


def guard(sql: str) -> str:
    """The statement, if it is a single SELECT."""
    body = sql.strip().rstrip(";").strip()
    if not re.match(r"(?is)select\b", body) or ";" in body:
        raise ValueError("a panel is one SELECT statement")
    return body


def run_panel(spark: SparkSession, sql: str, values: dict[str, object]) -> DataFrame:
    body = guard(sql)
    missing = [p for p in parameters(body) if p not in values]
    if missing:
        raise ValueError(f"no value for {', '.join(missing)}")
    return spark.sql(body, args={p: values[p] for p in parameters(body)}).limit(ROW_CAP)


KINDS = ("table", "kv", "status_grid")


def show(spark: SparkSession, kind: str, sql: str, values: dict[str, object]) -> DataFrame:
    """A panel by its kind, its rows in the order of the statement.

    table: the statement's rows, ROW_CAP at most. kv: place, key, value of the first row's columns. status_grid: row, column,
    state of a statement with these three columns, the last state of a cell. A column named link:<view> holds keys of
    another view and comes back as it is.
    """
    if kind not in KINDS:
        raise ValueError(f"no panel of kind {kind}; there are {', '.join(KINDS)}")
    rows = run_panel(spark, sql, values)
    if kind == "table":
        return rows
    if kind == "kv":
        pairs = [F.struct(F.lit(i).alias("place"), F.lit(c).alias("key"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(rows.columns)]
        return rows.limit(1).select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
    if rows.columns[:3] != ["row", "column", "state"]:
        raise ValueError("a status grid's statement has row, column and state")
    numbered = rows.select("row", "column", "state", F.monotonically_increasing_id().alias("n"))
    return numbered.groupBy("row", "column").agg(F.max_by("state", "n").alias("state"))


def links(rows: DataFrame) -> dict[str, str]:
    """Columns that link to a view, by the convention link:<view>."""
    return {c: c.split(":", 1)[1] for c in rows.columns if c.startswith("link:") and len(c) > 5}


def entity(spark: SparkSession, views: dict[str, str], view: str, key: object) -> DataFrame:
    """The entity view of a key: the view's statement with its one parameter bound, as key and value."""
    if view not in views:
        raise ValueError(f"no view {view}; there are {', '.join(sorted(views))}")
    names = parameters(guard(views[view]))
    if len(names) != 1:
        raise ValueError(f"view {view} has one parameter")
    return show(spark, "kv", views[view], {names[0]: key})
