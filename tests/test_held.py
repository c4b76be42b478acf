"""Rows that a task holds for a query while it ranks a pool."""

import random

from tidewright.operators.ranking import _Held


def test_a_task_holds_a_few_times_k_rows():
    """Thousands of rows beat what was known before, as they come: what is held stays near k, and the k best are among it."""
    r, k = random.Random(3), 5
    held, best, most = _Held(k), [], 0
    for n in range(20_000):
        score = n + r.random() if n % 2 else float(n // 100)
        best = sorted([*best, score])[-k:]
        held.add((f"{n:06d}", score, 1, (1,), (0.0,), score, score), best[0] if len(best) == k else float("-inf"))
        most = max(most, len(held.rows))
    assert most <= 4 * k + 64
    assert {row[6] for row in held.thinned(best[0])} >= set(best)
    alike = _Held(k)
    for n in range(5_000):
        alike.add((f"{9_999 - n:06d}", 1.0, 1, (1,), (0.0,), 1.0, 1.0), 1.0)
    assert len(alike.rows) <= 4 * k + 64 and [row[0] for row in alike.thinned(1.0)] == [f"{5_000 + n:06d}" for n in range(k)]


def test_pairs_are_counted_in_pieces_of_texts(spark, small_dir, monkeypatch):
    from tidewright.plans import retrieval

    want = sorted(map(tuple, retrieval.bigram_counts(spark, small_dir).collect()))
    monkeypatch.setattr(retrieval, "PIECE", 30_000)
    chars = spark.read.parquet(f"{small_dir}/documents.parquet").selectExpr("sum(length(text))").first()[0]
    got = retrieval.bigram_counts(spark, small_dir)
    assert f"Repartition {-(-chars // 30_000)}, true" in got._jdf.queryExecution().analyzed().toString()
    assert sorted(map(tuple, got.collect())) == want


def test_best_ranks_are_those_of_all_pairs(spark, small_dir, monkeypatch):
    from pyspark.sql import functions as F

    from tidewright.operators import ranking
    from tidewright.plans import step_queries as sq

    pairs = sq.full_pairs(spark, small_dir).groupBy("key").agg(F.round(F.min("lexical_rank"), 1), F.round(F.min("semantic_rank"), 1))
    want = sorted(map(tuple, pairs.collect()))
    assert sorted(map(tuple, sq.channel_best_ranks(spark, small_dir).collect())) == want
    # Coarse bins change what is asked for, not what is told.
    monkeypatch.setattr(ranking, "ROWS", 7)
    assert sorted(map(tuple, sq.channel_best_ranks(spark, small_dir).collect())) == want
