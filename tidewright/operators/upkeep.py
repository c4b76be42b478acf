"""A kept table of vectors: which rows lack one, their embedding, and the replacement of what changed, in one call."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import json_values as jv
from ..functions import text as tx
from ..sources import files
from ..sources.ledger import shared_folder
from .channels import dense_vectors, weights_vectors

SCHEMA = "corpus string, key string, model_sha string, text_sha string, v array<double>"
BUCKETS = 64


@dataclass(frozen=True)
class Embedder:
    """model_sha names the vectors; embed gives key, v for rows (key, text)."""

    model_sha: str
    embed: Callable[[DataFrame], DataFrame]


def embedder(spark: SparkSession, name: str, models: dict[str, dict]) -> Embedder:
    """The embedder of a name: `hashing`, or a model that hashes with its own dim, or one of pinned weights (path, sha256). One behind an address is refused: workers call no network here."""
    model = {"hashing": {"dim": 256}} if name == "hashing" else models.get(name)
    if model is None:
        raise ValueError(f"no model {name}; there are {', '.join(sorted(models)) or 'none'}")
    if "hashing" in model:
        dim = model["hashing"]["dim"]
        sha = spark.range(1).select(tx.model_identity(dim)).first()[0]
        return Embedder(sha, lambda rows: dense_vectors(rows, "key", dim))
    if "path" not in model:
        raise ValueError(f"model {name} has neither hashing nor a path")
    w = files.weights(model["path"], model["sha256"])
    vocab = spark.createDataFrame([(t, [float(x) for x in v]) for t, v in w.get("vocab", {}).items()], "token string, vec array<double>")
    buckets = [(i, [float(x) for x in v]) for i, v in enumerate(w.get("buckets", []))]
    others = spark.createDataFrame(buckets, "bucket bigint, vec array<double>") if buckets else None
    return Embedder(w["model_sha"], lambda rows: weights_vectors(rows, "key", vocab, others, dim=w["dim"]))


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


class VectorStore:
    """Vectors of corpora in a folder, dealt to BUCKETS by key; one vector a corpus, key and model."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        self._there = lambda: place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def all(self) -> DataFrame:
        """Every vector, with its bucket."""
        schema = f"{SCHEMA}, bucket int"
        return self.spark.read.schema(schema).parquet(self.path) if self._there() else self.spark.createDataFrame([], schema)

    def vectors(self, corpus: str, model_sha: str) -> DataFrame:
        return self.all().where((F.col("corpus") == corpus) & (F.col("model_sha") == model_sha))

    def maintain(self, corpus: str, rows: DataFrame, by: Embedder) -> int:
        """Embeds the rows (key, text) of a corpus that have no vector of their present text under this model; returns how many.

        Rows are met with what is kept by key, model and text hash, so a second call embeds nothing. Only the buckets
        of embedded keys are written anew, each as a whole: kept vectors of other keys, corpora and models stay, a
        changed text's vector is replaced. A null text is an empty one; of rows with one key the first by text counts.
        """
        rows = rows.where("key is not null").groupBy(F.col("key").cast("string").alias("key")).agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
        now = rows.withColumn("text_sha", F.sha2("text", 256))
        have = self.vectors(corpus, by.model_sha).select("key", "text_sha")
        stale = self._aside(now.join(have, ["key", "text_sha"], "left_anti"), "stale")
        n = stale.count()
        if not n:
            return 0
        keys = stale.select(F.lit(corpus).alias("corpus"), "key", F.lit(by.model_sha).alias("model_sha"), "text_sha", _bucket(F.col("key")).alias("bucket"))
        # The embedder is in the plan once: what else is asked of fresh rows is known from their keys.
        vectors = by.embed(stale.select("key", "text")).select("key", F.col("v").cast("array<double>").alias("v"))
        fresh = vectors.join(keys, "key").select("corpus", "key", "model_sha", "text_sha", "v", "bucket")
        others = self.all().join(keys.select("bucket").distinct(), "bucket", "left_semi").join(keys.select("corpus", "key", "model_sha"), ["corpus", "key", "model_sha"], "left_anti")
        # Aside first: what is read here is overwritten below.
        merged = self._aside(others.select(*fresh.columns).unionByName(fresh), "merged")
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        return n

    def _aside(self, df: DataFrame, label: str) -> DataFrame:
        path = shared_folder(self.spark, f"vectors-{label}")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def remote_identity(base_url: str, model: str) -> str:
    """Identity of a model behind an address, under which its recorded vectors are kept."""
    import hashlib

    return hashlib.sha256(jv.dumped({"base_url": base_url, "model": model}).encode()).hexdigest()
