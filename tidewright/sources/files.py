"""Small files as sources: notes, secrets, pack settings, model weights, rules over a tree."""

from __future__ import annotations

import hashlib
import json
import os
import stat

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def notes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """name (file name), content of whole files; a missing file is an error."""
    rows = spark.read.text(paths, wholetext=True)
    return rows.select(_plain(F.col("_metadata.file_name")).alias("name"), F.col("value").alias("content"))


def _plain(path: Column) -> Column:
    """A path as it is: Spark tells it with percent signs for blanks and others."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def tree(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, line_no, line of all text files below a folder whose names match; the lines that rules are held against."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True)
    lines = files.select(_plain(F.col("_metadata.file_path")).alias("path"), F.posexplode(F.split("value", "\n")).alias("i", "line"))
    return lines.select("path", (F.col("i") + 1).cast("bigint").alias("line_no"), "line")


def matched(lines: DataFrame, rules: dict[str, str], longest: int = 400) -> DataFrame:
    """rule, path, line_no, text of the lines (path, line_no, line; as tree() tells them) that a rule's pattern is found in, text cut to `longest` characters."""
    hits = F.filter(F.array(*[F.when(F.col("line").rlike(p), F.lit(n)) for n, p in rules.items()]), lambda r: r.isNotNull())
    return lines.select(F.explode(hits).alias("rule"), "path", "line_no", F.substring("line", 1, longest).alias("text"))


def secrets(path: str) -> dict[str, str]:
    """NAME=value lines of a file that its owner alone may read and write."""
    if stat.S_IMODE(os.stat(path).st_mode) != 0o600:
        raise PermissionError(f"{path} must have mode 0600")
    with open(path, encoding="utf-8") as f:
        lines = [x.strip() for x in f]
    return {k.strip(): v.strip() for k, _, v in (x.partition("=") for x in lines if x and not x.startswith("#"))}


def weights(path: str, sha256: str | None = None) -> dict:
    """A model's weights (dim, vocab, buckets, centroids) from JSON; with sha256 the file must be that one, and every vector has dim numbers."""
    with open(path, "rb") as f:
        raw = f.read()
    found = hashlib.sha256(raw).hexdigest()
    if sha256 is not None and found != sha256:
        raise ValueError(f"{path} isn't the model that was pinned")
    model = json.loads(raw)
    for group in (model.get("vocab", {}).values(), model.get("buckets", []), model.get("centroids", {}).values()):
        if any(len(v) != model["dim"] for v in group):
            raise ValueError(f"{path}: a vector hasn't {model['dim']} numbers")
    return model | {"model_sha": found}
