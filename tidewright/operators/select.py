"""A selection from end to end, for many tasks in one plan: filter, ranking, judging, deduplication, diversity, display, budget, and what is recorded of it."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import json_values as jv
from ..sources.ledger import shared_folder
from . import blocks
from . import channels as ch
from . import ranking as rk
from . import selection as sel
from . import steps as st

#: Characters of an entry that a judge sees.
GLANCE = 400


@dataclass(frozen=True)
class Spec:
    """What is asked of a selection. filter and boost: column to value; weights: channel to weight; judge and summarise: backends (prompt, ask) that answer in JSON; window: rows that are judged."""

    k: int = 5
    max_chars: int = 2_000
    diversify: float = 0.5
    dedup: bool = True
    include_all_under: int | None = None
    max_bytes: int | None = None
    filter: dict = field(default_factory=dict)
    boost: dict = field(default_factory=dict)
    weights: dict = field(default_factory=dict)
    judge: Callable[[str, int], str] | None = None
    window: int | None = None
    summarise: Callable[[str, int], str] | None = None
    preview: bool = False
    track: bool = True


@dataclass(frozen=True)
class Selection:
    """entries: q, place, key, text, score, lexical, semantic (best ranks, one decimal), truncated, summarized, judged; funnel: a row a task; uses: task_id, key to record; summaries: key, text_sha, summary to keep."""

    entries: DataFrame
    funnel: DataFrame
    uses: DataFrame
    summaries: DataFrame


def comparable(ts: Column, numeric: bool) -> Column:
    """A time as it is compared: as a number where all are numbers, else as text."""
    return ts.cast("string").try_cast("double") if numeric else ts.cast("string")


def static_votes(rows: DataFrame, spec: Spec, uses: DataFrame | None) -> DataFrame:
    """key, votes of the channels that don't ask: recency (ts, nulls unranked), prior (weight, numbers only), boost (how many columns are as wanted), utility (what became of tasks that were shown a row; 0.5 without any)."""
    pool, weights = rows, sel.WEIGHTS | spec.weights
    channels: dict[str, float] = {}
    if "ts" in rows.columns:
        told = rows.where("ts is not null").agg(F.count("ts"), F.count(F.col("ts").cast("string").try_cast("double"))).first()
        pool, channels["recency"] = pool.withColumn("recency", comparable(F.col("ts"), told[0] == told[1])), weights["recency"]
    if "weight" in rows.columns:
        pool, channels["prior"] = pool.withColumn("prior", F.col("weight").cast("double")), weights["prior"]
    if spec.boost:
        hits = sum((F.coalesce((F.col(c).cast("string") == str(v)).cast("int"), F.lit(0)) for c, v in sorted(spec.boost.items())), F.lit(0))
        pool = pool.withColumn("boost", hits)
        channels["boost"] = weights["boost"]
    if uses is not None:
        known = sel.utility(uses)
        pool, channels["utility"] = pool.join(known, "key", "left").withColumn("utility", F.coalesce("utility", F.lit(0.5))), weights["utility"]
    return sel.static_votes(pool, channels) if channels else pool.select("key", F.lit(0.0).alias("votes"))


def _aside(df: DataFrame, label: str) -> DataFrame:
    path = shared_folder(df.sparkSession, f"select-{label}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _scores_problem(answer: str) -> str | None:
    try:
        told = json.loads(answer)
    except ValueError:
        return "Answer in JSON."
    return None if isinstance(told, dict) and isinstance(told.get("scores"), dict) else 'Answer with {"scores": {key: 0 to 10}}.'


def judged(window: DataFrame, tasks: DataFrame, backend: Callable[[str, int], str]) -> tuple[DataFrame, DataFrame]:
    """q, key, judge of the window's rows (q, key, place, text), and q, rerank_error of the tasks whose judge failed: these keep their order.

    One prompt a task: its payload (tasks: q, payload) and the entries in the order of their places. A score that isn't
    a number, or is of a key outside the window, doesn't count; others are cut to 0 to 10.
    """
    entry = F.struct("place", F.to_json(F.struct("key", F.substring("text", 1, GLANCE).alias("text"))).alias("told"))
    listed = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["told"]), ","), F.lit("]"))
    prompts = window.groupBy("q").agg(listed.alias("entries")).join(tasks.select("q", "payload"), "q", "left")
    prompt = F.concat(F.lit("Score how useful each entry is for the task, from 0 to 10.\n"), F.coalesce("payload", F.lit("{}")), F.lit("\n"), "entries")
    runs = _aside(blocks.run_agent(prompts.select(F.col("q").alias("id"), prompt.alias("prompt")), backend, _scores_problem), "judged")
    scores = F.try_variant_get(F.try_parse_json("verdict"), "$.scores", "variant")
    keys = F.json_object_keys(F.to_json(scores))
    each = runs.where("error_class is null").select(F.col("id").alias("q"), scores.alias("s"), F.explode(keys).alias("key"))
    value = F.try_variant_get("s", F.concat(F.lit("$['"), "key", F.lit("']")), "variant")
    each = each.select("q", "key", value.alias("v")).where(jv.kind(F.col("v")).isin("integer", "number"))
    numbers = each.select("q", "key", F.try_variant_get("v", "$", "double").alias("judge"))
    return numbers.join(window.select("q", "key"), ["q", "key"], "left_semi").select("q", "key", F.floor("judge").cast("int").alias("judge")), runs.where("error_class is not null").select(F.col("id").alias("q"), F.col("error_class").alias("rerank_error"))


def written(rows: DataFrame, backend: Callable[[str, int], str], max_chars: int) -> DataFrame:
    """key, text_sha, summary of long texts (key, text) by a backend; a row whose summary fails or is empty is left out, and its text is cut instead."""
    prompt = F.concat(F.lit(f"Condense the record to {max_chars} characters.\n"), "text")
    numbered = _aside(rows.select("key", "text").withColumn("id", F.monotonically_increasing_id()), "to-summarise")

    def problem(answer: str) -> str | None:
        try:
            told = json.loads(answer)
        except ValueError:
            return "Answer in JSON."
        return None if isinstance(told, dict) and isinstance(told.get("summary"), str) and told["summary"].strip() else 'Answer with {"summary": text}.'

    runs = blocks.run_agent(numbered.select("id", prompt.alias("prompt")), backend, problem)
    done = runs.where("error_class is null").select("id", F.try_variant_get(F.try_parse_json("verdict"), "$.summary", "string").alias("summary"))
    return _aside(numbered.join(done, "id").select("key", F.sha2("text", 256).alias("text_sha"), "summary"), "summaries")


def select(corpus: DataFrame, tasks: DataFrame, spec: Spec, uses: DataFrame | None = None, summaries: DataFrame | None = None, recorded: DataFrame | None = None) -> Selection:
    """The rows of a corpus (key, text; ts, weight and others) that each task (q, texts: array of queries; payload) is shown.

    - Rows pass the filter; if all of them together are within include_all_under bytes, all are shown by key and nothing
      is ranked. - Lexical and semantic channels vote once a query, others once; ranks are fused over the whole pool.
      A kept summary of the present text (summaries: key, text_sha, summary) adds its words to the lexical match. - A
      judge sees the best `window` rows; if it fails the order stays and the funnel tells the error. - Of equal texts
      the better placed stays; of the first max(50, 4 k) different texts k are picked for relevance less redundancy.
      - A long text shows its summary, made now if there is a backend for it, else it is cut and marked. - Entries are
      packed while they fit into max_bytes. - The keys shown are told for recording (recorded: task_id, key has those
      that are). A preview calls no backend and records nothing.

    The queries are a stated set; the corpus is scored in map tasks, and only a task's candidates are shuffled.
    """
    spark = corpus.sparkSession
    rows = st.where_equal(corpus, spec.filter) if spec.filter else corpus
    rows = rows.withColumn("key", F.col("key").cast("string")).withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    for c in spec.boost:
        if c not in rows.columns:
            raise ValueError(f"no column {c}; there are {', '.join(rows.columns)}")
    size, considered = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    kept = summaries if summaries is not None else spark.createDataFrame([], "key string, text_sha string, summary string")
    asked = tasks.select(F.col("q").cast("bigint").alias("q"), "texts", *[c for c in ("payload",) if c in tasks.columns])
    asked = asked if "payload" in asked.columns else asked.withColumn("payload", F.lit("{}"))
    none = lambda t: F.lit(None).cast(t)
    track = spec.track and not spec.preview
    record = lambda shown: ch.record_uses(shown.select(F.col("q").alias("task_id"), "key"), recorded if recorded is not None else spark.createDataFrame([], "task_id bigint, key string"), tracked=track)
    if spec.include_all_under is not None and size <= spec.include_all_under:
        all_ = ch.shown(rows, kept.limit(0), spec.max_chars).select("key", F.col("display").alias("text"), "truncated")
        # Within include_all_under bytes.
        each = asked.select("q").crossJoin(F.broadcast(all_)).withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("key")))
        entries = each.select("q", "place", "key", "text", none("double").alias("score"), none("double").alias("lexical"), none("double").alias("semantic"), "truncated", F.lit(False).alias("summarized"), none("int").alias("judged"))
        n = F.lit(considered).cast("bigint")
        zero = F.lit(0).cast("bigint")
        funnel = asked.select("q", n.alias("considered"), F.lit(True).alias("included_all"), n.alias("gathered"), zero.alias("reranked"), zero.alias("deduped"), n.alias("pool"), n.alias("chosen"), n.alias("packed"), zero.alias("dropped"), none("string").alias("rerank_error"))
        return Selection(entries, funnel, record(entries), kept.limit(0))
    said = rows.select("key", "text", F.sha2("text", 256).alias("text_sha")).join(kept, ["key", "text_sha"], "left")
    votes = static_votes(rows, spec, uses)
    base = rows.select("key", "text").join(said.select("key", F.col("summary").alias("more")), "key")
    queries = asked.select("q", F.explode("texts").alias("text"))
    cap, weights = sel.pool_cap(spec.k), {c: (sel.WEIGHTS | spec.weights)[c] for c in ("lexical", "semantic")}
    window = (spec.window or max(20, 2 * spec.k)) if spec.judge is not None and not spec.preview else 0
    static = sel.first_of_each_text(rows, votes) if spec.dedup else votes.withColumn("copies", F.lit(1).cast("bigint"))
    ranked = rk.fused(base.join(static, "key"), queries, cap + window, weights)
    # Copies are counted along the fused order, before a judge changes it.
    walked = ranked.where(F.col("place") <= cap).join(said.select("key", "text_sha"), "key")
    errors, reranked = spark.createDataFrame([], "q bigint, rerank_error string"), spark.createDataFrame([], "q bigint, reranked bigint")
    judge = spark.createDataFrame([], "q bigint, key string, judge int")
    if window:
        # The window is that of all rows, copies included; behind it the best of each text follow.
        whole = rk.fused(base.join(votes, "key").withColumn("copies", F.lit(1).cast("bigint")), queries, window, weights) if spec.dedup else ranked.where(F.col("place") <= window)
        looked = whole.join(base, "key").select("q", "key", "place", F.coalesce("more", "text").alias("text"))
        judge, errors = judged(looked, asked, spec.judge)
        judge = _aside(judge.withColumn("judge", F.greatest(F.lit(0), F.least(F.lit(10), "judge"))), "scores")
        good = whole.join(errors, "q", "left_anti")
        reranked = good.groupBy("q").agg(F.count(F.lit(1)).alias("reranked"))
        ordered = good.join(judge, ["q", "key"], "left").withColumn("o", F.struct(F.lit(0), -F.coalesce("judge", F.lit(-1)), -F.col("score"), "key")).drop("judge")
        rest = ranked.join(good.select("q", "key"), ["q", "key"], "left_anti").withColumn("o", F.struct(F.lit(1), F.lit(0), -F.col("score"), "key"))
        both = ordered.unionByName(rest)
        ranked = both.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("o"))).drop("o")
    texts = ranked.join(said.select("key", "text", "text_sha"), "key")
    if spec.dedup:
        twin = Window.partitionBy("q", "text_sha").orderBy("place")
        texts = texts.withColumn("twin", F.row_number().over(twin)).where("twin = 1").drop("twin")
    texts = texts.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("place"))).where(F.col("n") <= cap).drop("n")
    pool = _aside(texts, "pool")
    if spec.diversify > 0 and spec.k > 1:
        chosen = sel.mmr(pool.select("q", "key", "score", "place").join(_vectors(pool), "key"), spec.k, spec.diversify)
    else:
        order = Window.partitionBy("q").orderBy("place")
        chosen = pool.select("q", "key", F.row_number().over(order).alias("step")).where(F.col("step") <= spec.k)
    chosen = _aside(chosen.join(pool.drop("copies"), ["q", "key"]), "chosen")
    fresh = kept.limit(0)
    if spec.summarise is not None and not spec.preview:
        long = chosen.where(F.length("text") > spec.max_chars).select("key", "text", "text_sha").distinct()
        fresh = written(long.join(kept, ["key", "text_sha"], "left_anti"), spec.summarise, spec.max_chars)
    shown = ch.shown(chosen.drop("text_sha"), kept.unionByName(fresh), spec.max_chars).withColumn("display", F.substring("display", 1, spec.max_chars))
    packed = sel.pack_bytes(shown.select("q", "key", F.col("step").alias("place"), "display"), spec.max_bytes if spec.max_bytes is not None else 2**62)
    last = shown.drop("place").join(packed.select("q", "key", F.col("place"), "packed"), ["q", "key"]).join(judge, ["q", "key"], "left")
    last = _aside(last.select("q", "place", "key", F.col("display").alias("text"), "score", F.round("lexical_rank", 1).alias("lexical"), F.round("semantic_rank", 1).alias("semantic"), "truncated", "summarized", F.col("judge").alias("judged"), "packed"), "last")
    counts = last.groupBy("q").agg(F.count(F.lit(1)).alias("chosen"), F.sum(F.col("packed").cast("bigint")).alias("packed"))
    copies = rk.copies_before(said.select("key", "text_sha").join(votes, "key"), walked, cap) if spec.dedup else pool.select("q").distinct().withColumn("deduped", F.lit(0).cast("bigint"))
    sizes = pool.groupBy("q").agg(F.count(F.lit(1)).alias("pool"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    n = F.lit(considered).cast("bigint")
    joined = asked.select("q").join(counts, "q", "left").join(copies, "q", "left").join(sizes, "q", "left").join(reranked, "q", "left").join(errors, "q", "left")
    funnel = joined.select("q", n.alias("considered"), F.lit(False).alias("included_all"), n.alias("gathered"), zero("reranked"), zero("deduped"), zero("pool"), zero("chosen"), zero("packed"), (F.coalesce("chosen", F.lit(0)) - F.coalesce("packed", F.lit(0))).cast("bigint").alias("dropped"), "rerank_error")
    entries = last.where("packed").drop("packed")
    return Selection(entries, funnel, record(entries), fresh)


def _vectors(pool: DataFrame) -> DataFrame:
    found = sel.hash_vectors(pool.select("key", "text").distinct()).groupBy("key").agg(F.collect_list("slot").alias("slots"), F.collect_list(F.col("weight").cast("double")).alias("weights"))
    filled = [F.coalesce(c, F.array().cast(f"array<{t}>")).alias(c) for c, t in (("slots", "int"), ("weights", "double"))]
    return pool.select("key").distinct().join(found, "key", "left").select("key", *filled)


def json_entries(entries: DataFrame) -> DataFrame:
    """q, value: a task's entries as they go into its context, canonical JSON in order; flags only where they are set."""
    flag = lambda c: F.when(F.col(c), F.lit(True)).alias(c)
    channels = F.when(F.col("lexical").isNotNull() | F.col("semantic").isNotNull(), F.struct("lexical", "semantic")).alias("channels")
    told = F.to_json(F.struct("key", "text", "score", channels, flag("truncated"), flag("summarized"), F.col("judged").alias("rerank")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", told.alias("told")))), lambda e: e["told"])
    return entries.groupBy("q").agg(jv.canonical(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]"))).alias("value"))
