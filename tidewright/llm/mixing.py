"""Mixing sources to token targets by entropy balancing, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, word_count

#: A document is taken this often at most, and a source's target stops at so many times its size.
CAP = 2.0
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
NEWTON_STEPS = 24
TOLERANCE = 1e-7
#: Cells of one unit of the rounding order; documents of more than COARSE of a target are settled before the finer ones.
CELLS = 4096
COARSE = 0.02


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target from rows (source, size, ...): weights by code point order of the sources, null last.

    Targets are weight times a common level, stopped at CAP times the source's size. The level is found in one pass
    over the sources in the order in which they reach their stop. One row a source; documents are pre-aggregated.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.pmod(F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1, F.lit(len(WEIGHTS)))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (turn + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("stop", F.col("source_size") * CAP)
    by_stop = Window.orderBy(F.col("stop") / F.col("weight"), F.asc_nulls_last("source"))
    everything = Window.partitionBy()
    stopped = F.coalesce(F.sum("stop").over(by_stop.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_stop.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything) * SHARE - stopped) / left
    per = per.withColumn("level", level)
    free = F.when(F.col("level") * F.col("weight") <= F.col("stop"), F.col("level"))
    # Before the level is reached rows are not free, after it the quotient only falls: the largest is the level.
    per = per.withColumn("level", F.max(free).over(everything))
    target = F.least(F.col("stop"), F.coalesce(F.col("level") * F.col("weight"), F.col("stop")))
    return per.select("source", "source_size", target.alias("target"))


def _rate(tilt: Column, x: Column) -> Column:
    """Bounded exponential tilt: CAP * e^(tilt x) / (1 + e^(tilt x)), 1 where the tilt is 0."""
    return CAP / (1.0 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -tilt * x))))


def tilts(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """The tilt of each source at which the expected words meet its target.

    Minimises, over rates between 0 and CAP, the relative entropy to taking every document once, under one token
    constraint a source. The convex dual has one variable a source; Newton steps on it (kept inside a bracket) read
    gradient and curvature from the pre-aggregated histogram of document sizes. scale is the source's mean size.
    A target at the stop has no finite tilt: those sources get rate CAP (full).
    """
    hist = materialise(sizes.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-hist")
    mean = hist.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"))
    state = targets.join(mean, targets["source"].eqNullSafe(mean["source"]), "left").select(
        targets["source"],
        "source_size",
        "target",
        F.coalesce("scale", F.lit(1.0)).alias("scale"),
        (F.col("target") >= CAP * F.col("source_size") * (1 - 1e-9)).alias("full"),
        F.lit(0.0).alias("tilt"),
        F.lit(-1e4).alias("low"),
        F.lit(1e4).alias("high"),
    )
    state = materialise(state, "mix-state")
    for _ in range(NEWTON_STEPS):
        s, h = state.alias("s"), hist.alias("h")
        x = F.col("h.size") / F.col("s.scale")
        r = _rate(F.col("s.tilt"), x)
        moved = h.join(s, F.col("h.source").eqNullSafe(F.col("s.source"))).where("not s.full")
        sums = moved.groupBy(F.col("h.source").alias("source")).agg(F.sum(r * x * F.col("n")).alias("got"), F.sum(r * (1 - r / CAP) * x * x * F.col("n")).alias("bend"))
        g = sums.alias("g")
        want = F.col("target") / F.col("scale")
        over, met = F.col("got") > want, F.abs(F.col("got") - want) <= TOLERANCE * want
        low, high = F.when(over, F.col("low")).otherwise(F.col("tilt")), F.when(over, F.col("tilt")).otherwise(F.col("high"))
        step = F.col("tilt") + (want - F.col("got")) / F.col("bend")
        inside = F.col("bend").isNotNull() & (F.col("bend") > 1e-300) & (step > low) & (step < high)
        wide = F.when(low < -9e3, F.least(F.col("tilt") * 4, F.lit(-1.0))).when(high > 9e3, F.greatest(F.col("tilt") * 4, F.lit(1.0))).otherwise((low + high) / 2)
        after = s.join(g, F.col("s.source").eqNullSafe(F.col("g.source")), "left").select(
            F.col("s.source").alias("source"),
            "source_size",
            "target",
            "scale",
            "full",
            F.when(F.col("got").isNull() | met, F.col("tilt")).otherwise(F.when(inside, step).otherwise(F.greatest(low, F.least(high, wide)))).alias("tilt"),
            F.when(F.col("got").isNull(), F.col("low")).otherwise(low).alias("low"),
            F.when(F.col("got").isNull(), F.col("high")).otherwise(high).alias("high"),
            F.coalesce(F.abs(F.col("got") - want) / want, F.lit(0.0)).alias("gap"),
        )
        after = materialise(after, "mix-state")
        discard(state)
        state = after.drop("gap")
        if (after.agg(F.max("gap")).first()[0] or 0.0) <= TOLERANCE:
            break
    discard(hist)
    return state.select("source", "source_size", "target", "scale", "full", "tilt")


def _place(doc_id: Column, size: Column, salt: int, cells: int) -> Column:
    return F.pmod(F.xxhash64(doc_id, size, F.lit(salt)), F.lit(cells))


def _with_plan(rows: DataFrame, plan: DataFrame, *columns: str) -> DataFrame:
    r, p = rows.alias("r"), plan.alias("p")
    return r.join(p, F.col("r.source").eqNullSafe(F.col("p.source")), "left").select("r.*", *[F.col(f"p.{c}") for c in columns])


def _rounding(rows: DataFrame, plan: DataFrame, salt: int) -> DataFrame:
    """rows joined to their source's plan, with whole (copies for certain), and cell, the place in the order in which documents get one more copy.

    Coarse documents come first where their own hash favours them, then the fine ones by hash less remainder, then the
    other coarse ones: moving the cut along this order settles the total on small documents.
    """
    joined = _with_plan(rows, plan, *[c for c in plan.columns if c != "source"])
    rate = F.when(F.col("full"), F.lit(CAP)).otherwise(_rate(F.col("tilt"), F.col("size") / F.col("scale")))
    whole = F.least(F.floor(rate), F.lit(int(CAP) - 1))
    u = _place(F.col("doc_id"), F.col("size"), salt, 1 << 52) / F.lit(float(1 << 52))
    z = u - (rate - whole)
    cell = F.floor((z + 1) * CELLS).cast("int")
    coarse = F.col("size") > COARSE * F.col("target")
    place = F.when(~coarse, cell + CELLS).when(z < 0, cell).otherwise(cell + 2 * CELLS)
    return joined.withColumn("whole", F.coalesce(whole, F.lit(0)).cast("int")).withColumn("cell", F.coalesce(place, F.lit(0)))


def _fill(placed: DataFrame, plan: DataFrame, salt: int) -> DataFrame:
    """source, size, bound, rest: which documents get one more copy than their cut gives them, to fill the words left to their source's target.

    Sizes are taken from the largest that still fits to the smallest, each as often as it fits, and one more of the
    smallest where that comes nearer. That is a fold over one row a source, of its distinct sizes with documents that
    can be taken once more. Of a size's documents those of places below bound are taken, and rest of those at it.
    """
    free = placed.where((F.col("copies") < int(CAP)) & (F.col("size") > 0)).select("source", "size", _place(F.col("doc_id"), F.col("size"), salt + 1, CELLS).alias("place"))
    hist = free.groupBy("source", "size", "place").agg(F.count(F.lit(1)).alias("n"))
    hist = materialise(hist, "mix-free")
    kinds = hist.groupBy("source", "size").agg(F.sum("n").alias("n"))
    lists = kinds.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("size", "n")), asc=False).alias("sizes"))
    pick = "array<struct<size:bigint,m:bigint>>"
    zero = F.struct(F.col("gap").alias("left"), F.lit(None).cast("bigint").alias("small"), F.array().cast(pick).alias("picks"))

    def step(acc: Column, x: Column) -> Column:
        m = F.least(x["n"], F.floor(F.greatest(acc["left"], F.lit(0.0)) / x["size"]))
        one = F.array(F.struct(x["size"].alias("size"), m.alias("m"))).cast(pick)
        return F.struct((acc["left"] - m * x["size"]).alias("left"), F.when(m < x["n"], x["size"]).otherwise(acc["small"]).alias("small"), F.when(m > 0, F.concat(acc["picks"], one)).otherwise(acc["picks"]).alias("picks"))

    folded = _with_plan(lists, plan, "gap").withColumn("f", F.aggregate("sizes", zero, step))
    nearer = F.col("f.small").isNotNull() & (F.col("f.small") - F.col("f.left") < F.col("f.left"))
    last = F.array(F.struct(F.col("f.small").alias("size"), F.lit(1).cast("bigint").alias("m"))).cast(pick)
    picks = F.when(nearer, F.concat("f.picks", last)).otherwise(F.col("f.picks"))
    wanted = folded.select("source", F.explode(picks).alias("p")).groupBy("source", F.col("p.size").alias("size")).agg(F.sum("p.m").alias("m"))
    h, w = hist.alias("h"), wanted.alias("w")
    met = h.join(w, F.col("h.source").eqNullSafe(F.col("w.source")) & (F.col("h.size") == F.col("w.size"))).select("h.*", "w.m")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source", "size").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = met.withColumn("before", before).where((F.col("before") <= F.col("m")) & (F.col("before") + F.col("n") > F.col("m")) | (F.col("before") + F.col("n") == F.col("m")))
    found = ends.groupBy("source", "size").agg(F.min(F.struct("place", (F.col("m") - F.col("before")).alias("rest"))).alias("e")).select("source", "size", F.col("e.place").alias("bound"), F.col("e.rest").alias("rest"))
    out = materialise(found, "mix-fill")
    discard(hist)
    return out


class Plan:
    """What rounds the rates to copies: a cut a source, and the documents that fill what the cut leaves."""

    def __init__(self, sizes: DataFrame, salt: int = 3):
        """sizes: rows (doc_id, source, size)."""
        self.salt = salt
        base = tilts(sizes, source_targets(sizes))
        placed = _rounding(sizes, base, salt)
        certain = placed.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("base"))
        cells = placed.groupBy("source", "cell").agg(F.sum("size").alias("words"))
        run = F.sum("words").over(Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
        cells = cells.select("source", "cell", run.alias("run")).unionByName(base.select("source", F.lit(-1).alias("cell"), F.lit(0).cast("bigint").alias("run")))
        c, b, p = cells.alias("c"), certain.alias("b"), base.alias("p")
        # The last cut that doesn't pass the target; rates of whole documents alone can't, but for rounding.
        gap = F.col("target") - F.coalesce(F.col("base"), F.lit(0)) - F.col("run")
        best = (
            c.join(b, F.col("c.source").eqNullSafe(F.col("b.source")), "left")
            .join(p, F.col("c.source").eqNullSafe(F.col("p.source")))
            .where((gap >= -1e-6) | (F.col("c.cell") < 0))
            .groupBy(F.col("c.source").alias("source"))
            .agg(F.min(F.struct(gap.alias("gap"), F.col("c.cell").alias("cell"))).alias("best"))
            .alias("k")
        )
        plan = p.join(best, F.col("p.source").eqNullSafe(F.col("k.source"))).select("p.*", F.col("best.cell").alias("cut"), F.col("best.gap").alias("gap"))
        self.cuts = materialise(plan, "mix-plan")
        self.fill = _fill(self._cut(sizes), self.cuts, salt)

    def _cut(self, rows: DataFrame) -> DataFrame:
        placed = _rounding(rows, self.cuts, self.salt)
        return placed.select(*rows.columns, "source_size", "target", (F.col("whole") + (F.col("cell") <= F.col("cut")).cast("int")).alias("copies"))

    def with_copies(self, rows: DataFrame) -> DataFrame:
        """rows (doc_id, source, size, ...) with source_size, target and copies. Joins to one row a source and to the sizes that fill; only the rows at the bounds of these are ranked."""
        names = [*rows.columns, "source_size", "target"]
        r, f = self._cut(rows).alias("r"), self.fill.alias("f")
        free = (F.col("r.copies") < int(CAP)) & (F.col("r.size") > 0)
        joined = r.join(f, F.col("r.source").eqNullSafe(F.col("f.source")) & (F.col("r.size") == F.col("f.size")) & free, "left")
        place = _place(F.col("r.doc_id"), F.col("r.size"), self.salt + 1, CELLS)
        joined = joined.select(*[F.col(f"r.{c}") for c in names], F.col("r.copies").alias("copies"), F.col("f.bound").alias("bound"), F.col("f.rest").alias("rest"), place.alias("place"))
        at = F.col("bound").isNotNull() & (F.col("place") == F.col("bound"))
        turn = F.row_number().over(Window.partitionBy("source", "size", "place").orderBy("copies", "doc_id"))
        ranked = joined.where(at).withColumn("turn", turn).select(*names, (F.col("copies") + (F.col("turn") <= F.col("rest")).cast("int")).alias("copies"))
        more = F.coalesce((F.col("place") < F.col("bound")).cast("int"), F.lit(0))
        return joined.where(~at).select(*names, (F.col("copies") + more).alias("copies")).unionByName(ranked)


def mix(docs: DataFrame, salt: int = 3) -> DataFrame:
    """docs with each row repeated as often as the mix takes it (0, 1 or 2 times).

    A source's words come as near to its target as its free documents let them: what is left is less than the
    smallest document that could be taken once more. A null text has no words; a null source is a source of its own,
    last in order; a source without words has target 0; documents without words have no say in the balance and
    go with their source's cut; rows of one doc_id and size share a draw; repeated rows count each; very long texts
    count as any other, once or twice at most; an empty table stays empty; columns of any name pass through.
    """
    own = {c: f"__own{i}" for i, c in enumerate(docs.columns)}
    kept = docs.select(*[F.col(c).alias(n) for c, n in own.items()], F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"))
    sizes = materialise(kept.select("doc_id", "source", "size"), "mix-sizes")
    taken = Plan(sizes, salt).with_copies(kept)
    discard(sizes)
    return taken.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select(*[F.col(n).alias(c) for c, n in own.items()])


def mix_digest(docs: DataFrame) -> DataFrame:
    """Contract of the mixing query: doc_id, size, source_size, target, taken for every document; edge cases as in mix()."""
    sizes = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    out = Plan(sizes).with_copies(sizes)
    return out.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("copies") * F.col("size")).cast("bigint").alias("taken"))
