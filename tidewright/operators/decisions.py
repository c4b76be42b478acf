"""Questions that wait for a person: rounds by key, answers, and what a gate makes of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a person can answer.
VERDICTS = ("picked", "revise", "reframe", "abandon")


def resolved(decisions: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """decisions (id, key, round, task, status, verdict, consumed) with the answers (id, verdict) taken in, the tasks (task) that go on within their attempt, and the answers refused (id, verdict, problem).

    Only an open decision can be answered, with one of VERDICTS; of two answers to it the smaller verdict in that order counts and the others are refused.
    """
    order = F.array_position(F.array(*map(F.lit, VERDICTS)), F.col("verdict"))
    known = decisions.select("id", F.col("status").alias("__status"))
    j = answers.select("id", "verdict").join(known, "id", "left")
    bad = F.when(~F.col("verdict").isin(*VERDICTS), "unknown verdict").when(F.col("__status").isNull(), "no such decision").when(F.col("__status") != "open", F.concat(F.lit("it is "), "__status"))
    j = j.withColumn("problem", bad)
    first = j.where("problem is null").groupBy("id").agg(F.min_by("verdict", order).alias("__verdict"), F.count(F.lit(1)).alias("__n"))
    late = first.where("__n > 1").select("id", F.col("__verdict").alias("verdict"), F.lit("answered already").alias("problem"))
    refused = j.where("problem is not null").select("id", "verdict", "problem").unionByName(late)
    out = decisions.join(first.drop("__n"), "id", "left")
    hit = F.col("__verdict").isNotNull()
    woken = out.where(hit & F.col("task").isNotNull()).select("task")
    out = out.withColumn("status", F.when(hit, "resolved").otherwise(F.col("status"))).withColumn("verdict", F.coalesce("__verdict", "verdict"))
    return out.drop("__verdict"), woken, refused


def gate(visits: DataFrame, decisions: DataFrame) -> DataFrame:
    """What tasks that come to a gate (task, key, asks: whether the step before carries a question) get there.

    outcome, decision (id of the round concerned), round, effect:
    - the key's last round that is open or answered and not consumed: an answered one is consumed, its verdict is the outcome; an open one goes on waiting and is pointed at this task;
    - else a pick stands for the task that got it, when it is the key's last answer: nothing is asked again (sticky);
    - else the next round opens and the task waits; without a question that is a fault.
    One visit a key at a time. Rounds of a key are pre-aggregated, so a key of very many rounds is a row a task.
    """
    row = F.struct("round", "id", "status", "verdict", "task")
    live = F.col("status").isin("open", "resolved") & ~F.col("consumed")
    per = decisions.groupBy("key").agg(
        F.max(F.when(live, row)).alias("now"), F.max(F.when(F.col("status") == "resolved", row)).alias("last"), F.max("round").alias("rounds")
    )
    j = visits.join(per, "key", "left")
    answered = F.col("now.status") == "resolved"
    waits = F.col("now").isNotNull()
    sticky = (F.col("last.verdict") == "picked") & (F.col("last.task") == F.col("task"))
    case = lambda a, b, c, d, e: F.when(answered, a).when(waits, b).when(sticky, c).when(F.col("asks"), d).otherwise(e)
    none = F.lit(None).cast("bigint")
    return j.select(
        "task",
        "key",
        case(F.col("now.verdict"), F.lit("awaiting_human"), F.lit("picked"), F.lit("awaiting_human"), F.lit("framework_bug")).alias("outcome"),
        case(F.col("now.id"), F.col("now.id"), F.col("last.id"), none, none).cast("bigint").alias("decision"),
        case(F.col("now.round"), F.col("now.round"), F.col("last.round"), F.coalesce("rounds", F.lit(0)) + 1, none).cast("bigint").alias("round"),
        case(F.lit("consume"), F.lit("point"), F.lit("sticky"), F.lit("open"), F.lit("fault")).alias("effect"),
    )


def after_gate(decisions: DataFrame, passed: DataFrame, new_id) -> DataFrame:
    """decisions once the effects of gate() are in: rounds consumed, pointed at their task, or opened (older open rounds of the key are superseded). new_id is the expression that numbers opened rounds, over task, key and round."""
    hit = passed.where(F.col("effect").isin("consume", "point")).select(F.col("decision").alias("id"), F.col("effect").alias("__effect"), F.col("task").alias("__task"))
    opened = passed.where("effect = 'open'")
    j = decisions.join(hit, "id", "left").join(opened.select("key", F.lit(True).alias("__asked")).distinct(), "key", "left")
    j = j.withColumn("consumed", F.col("consumed") | F.coalesce(F.col("__effect") == "consume", F.lit(False)))
    j = j.withColumn("task", F.when(F.col("__effect") == "point", F.col("__task")).otherwise(F.col("task")))
    j = j.withColumn("status", F.when(F.col("__asked") & (F.col("status") == "open"), "superseded").otherwise(F.col("status")))
    fresh = opened.select(new_id.alias("id"), "key", "round", "task", F.lit("open").alias("status"), F.lit(None).cast("string").alias("verdict"), F.lit(False).alias("consumed"))
    return j.select(*fresh.columns).unionByName(fresh)
