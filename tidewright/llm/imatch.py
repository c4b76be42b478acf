"""I-Match document fingerprints over randomised lexicon subsets, with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, partitions, text_or_empty

#: Terms that stand in this share of all documents are kept: inverse document frequencies from ln 10 to ln 333.
LEAST_SHARE, MOST_SHARE = 0.003, 0.1
#: Layers of random subsets of the lexicon: how many subsets, and the share of the lexicon that each holds is 1 in so
#: many. Of each layer a term falls in one subset or in none, by a hash of its own for the layer. Thick subsets tell
#: short texts apart, thin ones still know a long text after an edit.
LAYERS = ((128, 128), (32, 512), (32, 2048))
#: A layer has a say in the likeness of two documents if so many of its subsets have a term of either.
LEAST_SUBSETS = 8
_NO_TERM = "\x01"


def terms(text: Column) -> Column:
    """Distinct terms: lower case, split at white space and ASCII punctuation."""
    return F.array_distinct(F.split(F.lower(text), r"[\s\p{Punct}]+"))


def lexicon(docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """term, slot (a row for each subset that has the term) for the terms within the band, counted over all documents.

    Its size has a bound that doesn't grow with the corpus: the terms of a document number m on average, so at most
    m / least terms can reach a share of least.
    """
    n = docs.count()
    low, high = max(1.0, least * n), max(2.0, most * n)
    counted = docs.select(F.explode(terms(text_or_empty())).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    kept = counted.where(F.col("df").between(F.lit(low), F.lit(high)) & (F.col("term") != "") & (F.col("term") != _NO_TERM))
    starts = [sum(n for n, _ in LAYERS[:i]) for i in range(len(LAYERS))]
    places = [F.pmod(F.xxhash64("term", F.lit(17 + i)), F.lit(share)).cast("int") for i, (_, share) in enumerate(LAYERS)]
    slots = F.array_compact(F.array(*[F.when(p < n, p + first) for p, (n, _), first in zip(places, LAYERS, starts, strict=True)]))
    return materialise(kept.select("term", F.explode(slots).alias("slot")), "lexicon")


def _bucketed(docs: DataFrame) -> tuple[DataFrame, list[tuple[int, int | None]]]:
    """docs with bucket, its place among quantiles of doc_id (null: 0), and each bucket's largest doc_id, in descending order.

    The driver sees quantile bounds and one row for each bucket, four for each shuffle partition.
    """
    count = 4 * partitions(docs.sparkSession)
    probes = F.array(*[F.lit(i / count) for i in range(1, count)])
    row = docs.agg(F.percentile_approx("doc_id", probes, 10 * count)).first()
    bounds = sorted(set(row[0] or []))
    width = max(1, math.isqrt(len(bounds)))
    parts = [bounds[i : i + width] for i in range(0, len(bounds), width)] or [[]]
    arrays = F.array(*[F.array(*[F.lit(b) for b in p]).cast("array<bigint>") for p in parts])
    tops = F.array(*[F.lit(p[-1]) for p in parts if p]).cast("array<bigint>")
    coarse = F.least(F.size(F.filter(tops, lambda b: b < F.col("doc_id"))), F.lit(len(parts) - 1))
    fine = F.size(F.filter(F.element_at(arrays, F.col("__coarse") + 1), lambda b: b < F.col("doc_id")))
    out = docs.withColumn("__coarse", F.coalesce(coarse, F.lit(0)))
    out = out.withColumn("bucket", F.when(F.col("doc_id").isNull(), 0).otherwise(1 + F.col("__coarse") * width + fine)).drop("__coarse")
    tops_found = [(r[0], r[1]) for r in out.groupBy("bucket").agg(F.max("doc_id")).collect()]
    return out, sorted(tops_found, key=lambda x: -x[0])


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, bucket, ghost, rn, next_text in descending order of doc_id (nulls last, equal ids by a hash of the text); after the last comes the first.

    Texts are shuffled once, by bucket. Each bucket also holds a copy of the row that follows it (ghost), so that what
    comes next never needs another task's rows.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    rows, tops = _bucketed(docs)
    rows = rows.withColumn("tie", F.xxhash64("text"))
    before = {tops[i][0]: tops[i - 1][0] for i in range(len(tops))}
    firsts = rows.where(F.col("doc_id").isin([t for _, t in tops if t is not None]) | (F.col("doc_id").isNull() if tops and tops[-1][1] is None else F.lit(False)))
    first = firsts.groupBy("bucket").agg(F.min_by(F.struct("doc_id", "text", "tie"), F.struct("tie", "text")).alias("r"))
    first = first.select("r.doc_id", "r.text", "bucket", "r.tie")
    if before:
        turned = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
        first = first.withColumn("bucket", F.element_at(turned, F.col("bucket")))
    both = rows.withColumn("ghost", F.lit(0)).unionByName(first.withColumn("ghost", F.lit(1)))
    order = Window.partitionBy("bucket").orderBy("ghost", F.desc_nulls_last("doc_id"), "tie", "text")
    return both.select("doc_id", "text", "bucket", "ghost", F.row_number().over(order).alias("rn"), F.lead("text").over(order).alias("next_text"))


def edited(text: Column, following: Column) -> Column:
    """text with its last third (floor of code points / 3) replaced by as many of the first code points of the following text, or all."""
    cut = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - cut), F.substring(following, F.lit(1), cut))


def likeness(a: Column, b: Column, a_text: Column, b_text: Column) -> Column:
    """Share of the subsets with a term of either document whose hashes agree, in the layer where that is most; without any term, whether the texts are equal.

    Layers of fewer than LEAST_SUBSETS such subsets have no say, unless all are.
    """
    slots = F.array_union(F.transform(a, lambda x: F.shiftright(x, 16)), F.transform(b, lambda x: F.shiftright(x, 16)))
    same = F.transform(F.array_intersect(a, b), lambda x: F.shiftright(x, 16))

    def inside(codes: Column, first: int, end: int) -> Column:
        return F.size(F.filter(codes, lambda x: (x >= first) & (x < end)))

    shares, first = [], 0
    for n, _ in LAYERS:
        known = inside(slots, first, first + n)
        shares.append(F.when(known >= LEAST_SUBSETS, inside(same, first, first + n) / known))
        first += n
    best = F.coalesce(F.greatest(*shares), F.size(same) / F.size(slots))
    return F.when(F.size(slots) > 0, best).otherwise((a_text == b_text).cast("double")).cast("double")


def fingerprint_text(codes: Column, text_md5: Column) -> Column:
    """Six hex digits for each subset with a term: two of the subset, four of its hash. Documents without a term of the lexicon are known by their exact text."""
    return F.when(F.size(codes) > 0, F.array_join(F.transform(codes, lambda x: F.lpad(F.lower(F.hex(x)), 6, "0")), "")).otherwise(F.concat(F.lit("text:"), text_md5))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs (doc_id, text).

    Each subset's hash is taken over the document's sorted distinct terms of it. Tokens are joined to the broadcast
    lexicon and gathered within the bucket's own partition, without a further shuffle. A null text is empty; a lone
    document follows itself; repeated rows get a result each; an empty table gives an empty result; other columns are
    not read.
    """
    words = lexicon(docs.select("text"))
    rows = with_next(docs)
    rows = rows.withColumn("edited", F.when(F.col("ghost") == 0, edited(F.col("text"), F.coalesce("next_text", F.lit("")))))
    info = F.struct(
        "doc_id",
        "ghost",
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        F.md5(F.col("text")).alias("text_md5"),
        F.md5(F.col("edited")).alias("edited_md5"),
    )
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("t")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("t")))
    sided = rows.select("bucket", "rn", info.alias("info"), sides.alias("sides")).select("bucket", "rn", "info", F.explode("sides").alias("s")).where("s.t is not null")
    tokens = sided.select("bucket", "rn", "info", F.col("s.side").alias("side"), F.explode(F.concat(F.array(F.lit(_NO_TERM)), terms(F.col("s.t")))).alias("term"))
    marked = words.unionByName(words.sparkSession.createDataFrame([(_NO_TERM, -1)], "term string, slot int"))
    found = tokens.join(F.broadcast(marked), "term").select("bucket", "rn", "side", "slot", "term", F.when((F.col("slot") == -1) & (F.col("side") == 0), F.col("info")).alias("info"))
    subset = found.groupBy("bucket", "rn", "side", "slot").agg(F.array_sort(F.collect_set("term")).alias("terms"), F.first("info", ignorenulls=True).alias("info"))
    code = F.shiftleft(F.col("slot").cast("bigint"), 16) + F.pmod(F.xxhash64(F.array_join("terms", " ")), F.lit(1 << 16))
    coded = subset.select("bucket", "rn", "side", F.when(F.col("slot") >= 0, code).alias("code"), "info")
    own, other = (F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("code")))).alias(n) for s, n in ((0, "own"), (1, "other")))
    whole = coded.groupBy("bucket", "rn").agg(own, other, F.first("info", ignorenulls=True).alias("info"))
    order = Window.partitionBy("bucket").orderBy("rn")
    following = F.lead(F.struct("own", F.col("info.text_md5").alias("md5"))).over(order)
    whole = whole.withColumn("next", following).where("info.ghost = 0")
    return whole.select(
        "info.doc_id",
        "info.n_chars",
        "info.edited_sha256",
        fingerprint_text(F.col("own"), F.col("info.text_md5")).alias("fingerprint"),
        fingerprint_text(F.col("other"), F.col("info.edited_md5")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other"), F.col("info.text_md5"), F.col("info.edited_md5")).alias("near_edited"),
        likeness(F.col("own"), F.col("next.own"), F.col("info.text_md5"), F.col("next.md5")).alias("near_next"),
    )
