"""One thin query for each operator of this subpackage, over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .imatch import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op2_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hilbert import shard_digest

    return shard_digest(table(spark, sf_dir, "documents"))


def op3_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_digest

    return mix_digest(table(spark, sf_dir, "documents"))


def op4_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_runs import line_digest

    return line_digest(table(spark, sf_dir, "documents"))


def op5_fm_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import substring_digest

    return substring_digest(table(spark, sf_dir, "documents"))


def op6_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_digest

    return quality_digest(spark, sf_dir)


def op7_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import warc_digest

    return warc_digest(spark, table(spark, sf_dir, "pages"))


def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leak_digest

    return leak_digest(spark, sf_dir)


def op9_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import near_duplicate_digest

    return near_duplicate_digest(table(spark, sf_dir, "documents"))


def op10_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_digest

    return toxicity_digest(spark, sf_dir)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import manifest

    return manifest(table(spark, sf_dir, "documents"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import clusters

    return clusters(table(spark, sf_dir, "embeddings"))


def op13_simhash_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, n, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents)
),
hot AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT l.*, h.key IS NOT NULL AS dropped FROM lines l LEFT JOIN hot h ON l.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


#: The unsigned CRC-32 of a decimal, over a table of 256 remainders that is made here.
OP11_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY k) AS made
  FROM (SELECT unnest(range(256)) AS k)
),
d AS (
  SELECT doc_id, source, lang, n_chars, text,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                         lambda c, b: xor(c // 256, made[xor(c, b) % 256 + 1])), 4294967295) % 2 = 0 AS hit
  FROM documents, crc
),
l AS (
  SELECT doc_id, source, hit,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
         || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS lead, text, replace(text, chr(10), '') AS cut
  FROM d
),
r AS (
  SELECT doc_id, source, sha256(lead || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN hit THEN sha256(lead || coalesce(strlen(cut) || ':' || cut, '-')) END AS tampered,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n
  FROM l
),
tree AS (
  SELECT source, 0 AS lvl, i, n, leaf AS x FROM r
  UNION ALL
  SELECT source, lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(x, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY source, lvl, i // 3, n
),
sub AS (SELECT source, x AS subroot, lvl AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS m FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS lvl, place AS i, m AS n, subroot AS x FROM sub
  UNION ALL
  SELECT lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(x, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY lvl, i // 3, n
),
beside AS (
  SELECT r.doc_id, t.lvl AS step, t.i, t.i < r.i // CAST(3 ** t.lvl AS BIGINT) AS before, t.x
  FROM r JOIN tree t ON t.source IS NOT DISTINCT FROM r.source AND t.n > 1 AND t.i // 3 = r.i // CAST(3 ** (t.lvl + 1) AS BIGINT) AND t.i <> r.i // CAST(3 ** t.lvl AS BIGINT)
  UNION ALL
  SELECT r.doc_id, sub.height + t.lvl, t.i, t.i < sub.place // CAST(3 ** t.lvl AS BIGINT), t.x
  FROM r JOIN sub ON sub.source IS NOT DISTINCT FROM r.source
  JOIN top t ON t.n > 1 AND t.i // 3 = sub.place // CAST(3 ** (t.lvl + 1) AS BIGINT) AND t.i <> sub.place // CAST(3 ** t.lvl AS BIGINT)
),
proof AS (SELECT doc_id, sha256(string_agg(x, '' ORDER BY step, i)) AS h FROM beside GROUP BY doc_id),
sides AS (SELECT doc_id, step, string_agg(x, '' ORDER BY i) FILTER (WHERE before) AS a, string_agg(x, '' ORDER BY i) FILTER (WHERE NOT before) AS b FROM beside GROUP BY doc_id, step),
steps AS (SELECT r.doc_id, sub.height + (SELECT max(lvl) FROM top) AS last FROM r JOIN sub ON sub.source IS NOT DISTINCT FROM r.source),
fold AS (
  SELECT doc_id, 0 AS step, coalesce(tampered, leaf) AS x FROM r
  UNION ALL
  SELECT fold.doc_id, fold.step + 1, sha256(coalesce(a, '') || x || coalesce(b, ''))
  FROM fold JOIN steps ON steps.doc_id = fold.doc_id AND fold.step < steps.last LEFT JOIN sides ON sides.doc_id = fold.doc_id AND sides.step = fold.step
)
SELECT r.doc_id, leaf, subroot, root, coalesce(h, sha256('')) AS proof_sha256, fold.x AS folded_root, fold.x = root AS verified
FROM r JOIN sub ON sub.source IS NOT DISTINCT FROM r.source JOIN (SELECT x AS root FROM top WHERE n = 1) ON true LEFT JOIN proof ON proof.doc_id = r.doc_id
JOIN steps ON steps.doc_id = r.doc_id JOIN fold ON fold.doc_id = r.doc_id AND fold.step = steps.last
"""


def _op12_sql(rounds: int = 3, k: int = 16) -> str:
    """The rounds one after another; a centroid without vectors keeps its place."""
    near = "list_sum(list_transform(range(1, 65), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i])))"
    parts = [
        """q AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v FROM q ORDER BY c LIMIT {k})",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS (SELECT vec_id, any_value(q.v) AS v, min({{'d': {near}, 'c': c.c}}) AS best FROM q, c{r} c GROUP BY vec_id)")
        if r < rounds:
            parts.append(f"""s{r} AS (SELECT best.c AS c, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL),
c{r + 1} AS (SELECT c{r}.c, coalesce(m.v, c{r}.v) AS v FROM c{r} LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{r} GROUP BY c) m ON m.c = c{r}.c)""")
    return f"""WITH {', '.join(parts)}
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
 CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(f.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} f ON f.c = best.c"""


def oracle_sql() -> dict[str, str]:
    return {"op4_line_runs": OP4_SQL, "op11_merkle_manifest": OP11_SQL, "op12_centroid_clusters": _op12_sql()}
