"""Exact line deduplication over levelled sorted runs of line hashes, with DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, ascii_strip, discard, drop_path, fresh_path, materialise, partitions, text_or_empty


def line_key(line: Column) -> Column:
    """A line's key: white space stripped at both ends, A-Z lower-cased."""
    return ascii_lower(ascii_strip(line))


def line_hash(line: Column) -> Column:
    """128-bit hash of the key; null where the key is empty."""
    key = line_key(line)
    return F.when(F.length(key) > 0, F.unhex(F.md5(key)))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


@dataclass(frozen=True)
class Run:
    """A table bucketed and sorted by hash, in two parts: fresh hashes, and counts of known ones. Joins by hash read a part's buckets in order, without a shuffle of it."""

    name: str
    path: str


class LineRuns:
    """Runs of (hash, docs, first) in levels: docs counts documents; first is null for a hash that no earlier run had, else the documents of the run that had it first.

    add() merge-anti-joins a batch with the fresh hashes of all runs: what is left is the batch's own and becomes the
    fresh part of its run; what the runs know already becomes the part of updates, each beside the count that it met.
    So every hash is fresh in one run only, and a hash of one batch is never read by a sum again: what is frequent comes
    from the updates, and from the few fresh hashes that one batch alone made so. When a level holds fanout runs they
    are merged into one of the next level. Hashes that reach `settle` documents leave for the settled run; later batches
    state them no more. Every run is written once, in the shared folder, and is listed only after its job has ended: a
    lost executor or a failed batch leaves the earlier state as it was. close() deletes all runs.
    """

    def __init__(self, spark: SparkSession, settle: int | None = None, fanout: int = 4):
        self.spark, self.settle, self.fanout = spark, settle, fanout
        self.buckets = partitions(spark)
        self.levels: list[list[Run]] = [[]]
        self.settled: Run | None = None

    def _write(self, df: DataFrame, label: str) -> Run:
        run = Run(f"tidewright_{label}_{uuid4().hex}", fresh_path(self.spark, label))
        dealt = df.select("hash", "docs", "first", F.col("first").isNull().alias("fresh")).repartition(self.buckets, "hash")
        dealt.write.partitionBy("fresh").bucketBy(self.buckets, "hash").sortBy("hash").option("path", run.path).saveAsTable(run.name)
        return run

    def _drop(self, run: Run) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run.name}")
        drop_path(self.spark, run.path)

    def fresh(self, run: Run) -> DataFrame:
        return self.spark.table(run.name).where("fresh").select("hash", "docs")

    def updates(self, run: Run) -> DataFrame:
        return self.spark.table(run.name).where("not fresh").select("hash", "docs", "first")

    def runs(self) -> list[Run]:
        return [r for level in self.levels for r in level]

    def close(self) -> None:
        for run in [*self.runs(), *([self.settled] if self.settled else [])]:
            self._drop(run)
        self.levels, self.settled = [[]], None

    def met(self, batch: DataFrame) -> DataFrame:
        """batch (hash, docs; a hash once) less what is settled, with first: the count of the run that knows the hash, null where the anti-join with every run leaves it. One shuffle, of the batch."""
        batch = batch.select("hash", "docs")
        if self.settled:
            batch = batch.join(self.fresh(self.settled).select("hash").hint("merge"), "hash", "left_anti")
        known = F.lit(None).cast("bigint")
        for i, run in enumerate(self.runs()):
            batch = batch.join(self.fresh(run).withColumnRenamed("docs", f"first{i}").hint("merge"), "hash", "left")
            known = F.coalesce(known, F.col(f"first{i}"))
        return batch.select("hash", "docs", known.alias("first"))

    def add(self, batch: DataFrame) -> Run:
        """Adds a batch as a run of level 0 and returns it; levels that are full then are merged."""
        run = self._write(self.met(batch), "run0")
        self.levels[0].append(run)
        return run

    def compact(self) -> None:
        """Merges each full level's runs into one of the next level, lowest level first."""
        level = 0
        while level < len(self.levels):
            old = self.levels[level]
            if len(old) >= self.fanout:
                # Fresh hashes stand in one run each; only updates can meet.
                fresh = reduce(DataFrame.unionByName, map(self.fresh, old)).withColumn("first", F.lit(None).cast("bigint"))
                if level + 1 == len(self.levels):
                    self.levels.append([])
                run = self._write(fresh.unionByName(self._summed(old)), f"run{level + 1}")
                self.levels[level], self.levels[level + 1] = [], [*self.levels[level + 1], run]
                for r in old:
                    self._drop(r)
                if self.settle is not None:
                    self._settle(run)
            level += 1

    def _summed(self, runs: list[Run]) -> DataFrame:
        rows = reduce(DataFrame.unionByName, map(self.updates, runs))
        return rows.groupBy("hash").agg(F.sum("docs").alias("docs"), F.max("first").alias("first"))

    def _full(self, runs: list[Run], least: int) -> DataFrame:
        """hash, docs of what these runs show to have enough documents: by updates and the count that they met, or within the run that it is fresh in."""
        told = self._summed(runs).select("hash", (F.col("docs") + F.col("first")).alias("docs")).where(F.col("docs") >= least)
        alone = [self.fresh(r).where(F.col("docs") >= least) for r in runs]
        return reduce(DataFrame.unionByName, alone, told)

    def _settle(self, run: Run) -> None:
        """Moves what one run alone shows to have enough documents; runs keep what they hold until they are merged."""
        full = self._full([run], self.settle)
        if self.settled:
            full = full.unionByName(self.fresh(self.settled))
        full = full.groupBy("hash").agg(F.max("docs").alias("docs"))
        old, self.settled = self.settled, self._write(full.withColumn("first", F.lit(None).cast("bigint")), "settled")
        if old:
            self._drop(old)

    def frequent(self, least: int) -> DataFrame:
        """Hashes of at least so many documents; exact where least is the settle bound, or none was given."""
        if not self.runs():
            return self.spark.createDataFrame([], "hash binary")
        found = self._full(self.runs(), least).select("hash")
        return (found.unionByName(self.fresh(self.settled).select("hash")) if self.settled else found).distinct()


def line_rows(docs: DataFrame) -> DataFrame:
    """doc_id, hash: a row for each document (rows that repeat a doc_id are one) and distinct non-empty line key."""
    hashes = F.array_distinct(F.transform(lines_of(text_or_empty()), line_hash))
    return docs.select("doc_id", F.explode(hashes).alias("hash")).where("hash is not null").distinct()


def unseen_lines(runs: LineRuns, docs: DataFrame) -> DataFrame:
    """Streaming form: (doc_id, hash) of the lines that no earlier batch had; the batch then joins the runs."""
    rows = materialise(line_rows(docs), "lines")
    own = runs.add(rows.groupBy("hash").agg(F.count(F.lit(1)).alias("docs")))
    fresh = materialise(rows.join(runs.fresh(own).select("hash"), "hash", "left_semi").select("doc_id", "hash"), "fresh-lines")
    runs.compact()
    discard(rows)
    return fresh


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, batches: int = 4, fanout: int = 2) -> DataFrame:
    """docs with the lines left in kept_text, and n_lines, n_dropped.

    Every line whose key stands in at least min_docs documents goes from every document, the first included; lines
    with an empty key stay, and a null text is one empty line. Rows that repeat a doc_id are one document where
    documents are counted, and a null doc_id counts as none; each row gets its own result. Texts, however long, are
    shuffled once, for the last join; an empty table gives an empty result. Columns of the three names are replaced,
    all others come back as they were, whatever their names.

    Documents come to the runs in batches, as they would day by day: each batch is read and counted by itself, is
    merge-anti-joined with the runs and adds its own; what the runs know becomes updates of their counts, as ten
    documents can come from several batches.
    """
    kept = [c for c in docs.columns if c not in ("kept_text", "n_lines", "n_dropped")]
    own = {c: f"__own{i}" for i, c in enumerate(kept)}
    batch = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(batches)), F.lit(0)).cast("int")
    rows = materialise(line_rows(docs).withColumn("batch", batch), "lines", by="batch")
    runs = LineRuns(docs.sparkSession, settle=min_docs, fanout=fanout)
    for b in range(batches):
        own_rows = rows.where((F.col("batch") == b) & F.col("doc_id").isNotNull())
        runs.add(own_rows.groupBy("hash").agg(F.count(F.lit(1)).alias("docs")))
        runs.compact()
    hot = materialise(runs.frequent(min_docs), "frequent-lines")
    runs.close()
    per_doc = rows.drop("batch").join(hot, "hash").groupBy("doc_id").agg(F.collect_set("hash").alias("__hot"))
    per_doc = materialise(per_doc.withColumnRenamed("doc_id", "__doc"), "lines-to-drop")
    for t in (rows, hot):
        discard(t)
    renamed = docs.select(F.col("doc_id").alias("__id"), text_or_empty().alias("__text"), *[F.col(c).alias(n) for c, n in own.items()])
    # What has lines to drop grows with the corpus, so this is a merge join at every size.
    joined = renamed.join(per_doc.hint("merge"), F.col("__id").eqNullSafe(F.col("__doc")), "left")
    lines = lines_of(F.col("__text"))
    stays = lambda line: F.coalesce(~F.array_contains(F.col("__hot"), line_hash(line)), F.lit(True))
    out = joined.withColumn("__lines", lines).withColumn("__kept", F.when(F.col("__hot").isNull(), lines).otherwise(F.filter(lines, stays)))
    return out.select(
        *[F.col(n).alias(c) for c, n in own.items()],
        F.size("__lines").cast("bigint").alias("n_lines"),
        (F.size("__lines") - F.size("__kept")).cast("bigint").alias("n_dropped"),
        F.array_join("__kept", "\n").alias("kept_text"),
    )


def line_digest(docs: DataFrame) -> DataFrame:
    """Contract of the line query: doc_id, n_lines, n_dropped, kept_sha256; edge cases as in drop_frequent_lines()."""
    out = drop_frequent_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
