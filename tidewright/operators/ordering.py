"""Running sums over groups that may hold any share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.ledger import shared_folder


def running(rows: DataFrame, by: list[str], order: list[Column], value: str, out: str) -> DataFrame:
    """rows with out, the sum of value up to the row within its group (by, none: all rows) in an order, and __total and __rows, the sum and number of the group's rows.

    Rows are dealt by ranges over group and order, so a group of very many rows is many tasks, each with a running sum of
    its own; what is summed across tasks is one row a task and group. The ranges are written, so that they stay as they
    are however often they are read.
    """
    spark = rows.sparkSession
    keys = [*map(F.col, by), *order]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_folder(spark, "running")
    dealt = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("__seq", F.monotonically_increasing_id())
    dealt.write.parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path).withColumn("__task", F.shiftright("__seq", 33))
    tasks = dealt.groupBy("__task", *by).agg(F.sum(value).alias("__own"), F.count(F.lit(1)).alias("__some"))
    ahead = Window.partitionBy(*by).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    tasks = tasks.withColumn("__ahead", F.coalesce(F.sum("__own").over(ahead), F.lit(0))).withColumn("__total", F.sum("__own").over(whole)).withColumn("__rows", F.sum("__some").over(whole)).drop("__own", "__some")
    here = Window.partitionBy("__task", *by).orderBy("__seq").rowsBetween(Window.unboundedPreceding, 0)
    told, sums = dealt.withColumn(out, F.sum(value).over(here)).alias("d"), tasks.alias("t")
    same = F.col("d.__task") == F.col("t.__task")
    for c in by:
        same = same & F.col(f"d.{c}").eqNullSafe(F.col(f"t.{c}"))
    found = told.join(sums, same)
    return found.select(*[F.col(f"d.{c}") for c in rows.columns], (F.col(f"d.{out}") + F.col("t.__ahead")).alias(out), F.col("t.__total"), F.col("t.__rows"))
