"""Queries of the selection engine over documents and benchmark texts, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx
from ..operators import neighbours as nb
from ..operators import ranking as rk
from ..operators import selection as sel

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("key"), "text", "lang", "source", "n_chars")


def asked(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "benchmark").select(F.col("item_id").alias("q"), "text")


IDENTS = r"""list_filter(regexp_extract_all(replace(lower(regexp_replace(coalesce({0}, ''), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '_', ' '), '[a-z0-9_]+'), lambda x: length(x) >= 2)"""


@query(f"SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')) AS n_tokens, len({IDENTS.format('text')}) AS n_identifiers FROM documents")
def tok_documents(spark, d):
    return t(spark, d, "documents").select("doc_id", F.size(tx.tokens(F.col("text"))).cast("bigint").alias("n_tokens"), F.size(tx.identifiers(F.col("text"))).cast("bigint").alias("n_identifiers"))


#: Characters of text whose pairs one task counts.
PIECE = 16_000_000


@query(f"""
WITH w AS (SELECT {IDENTS.format('text')} AS w FROM documents),
b AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])) AS bigram FROM w WHERE len(w) >= 2)
SELECT bigram, count(*) AS n FROM b GROUP BY bigram ORDER BY n DESC, bigram LIMIT 100""")
def bigram_counts(spark, d):
    """The hundred most frequent pairs. Most pairs of a text are new, so a task's counts are as large as its texts: these are dealt into pieces of PIECE characters."""
    docs = t(spark, d, "documents").select("text")
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    docs = docs.repartition(max(spark.sparkContext.defaultParallelism, -(-chars // PIECE)))
    pairs = docs.select(F.explode(tx.bigrams(tx.identifiers(F.col("text")))).alias("bigram"))
    return pairs.groupBy("bigram").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "bigram").limit(100)


FEATURES = f"""
w AS (SELECT doc_id, {IDENTS.format('text')} AS w FROM {{0}}),
f AS (SELECT doc_id, unnest(w) AS f FROM w UNION ALL
      SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])) FROM w WHERE len(w) >= 2),
h AS (SELECT doc_id, sha256(f) AS h FROM f),
v AS (SELECT doc_id, (('0x' || substr(h, 17, 2))::INT) AS slot, sum(CASE WHEN ('0x0' || substr(h, 3, 1))::INT >= 8 THEN 1 ELSE -1 END)::BIGINT AS weight FROM h GROUP BY ALL)
"""


@query("WITH " + FEATURES.format("documents") + " SELECT * FROM v")
def hash_embed_sparse(spark, d):
    return sel.hash_vectors(t(spark, d, "documents").select("doc_id", "text"), "doc_id")


LEX = f"""
d AS (SELECT CAST(doc_id AS VARCHAR) AS key, text, lang, source, n_chars FROM documents {{where}}),
q AS (SELECT item_id AS q, text FROM benchmark),
dt AS (SELECT DISTINCT key, unnest({IDENTS.format('text')}) AS tok FROM d),
qt AS (SELECT DISTINCT q, unnest({IDENTS.format('text')}) AS tok FROM q),
hit AS (SELECT q, key, count(*) AS hits FROM dt JOIN qt USING (tok) GROUP BY ALL),
lex AS (SELECT q.q, d.key, coalesce(hits, 0) AS s FROM q CROSS JOIN d LEFT JOIN hit ON hit.q = q.q AND hit.key = d.key),
lr AS (SELECT *, rank() OVER (PARTITION BY q ORDER BY s DESC) + (count(*) OVER (PARTITION BY q, s) - 1) / 2.0 AS r,
       min(s) OVER (PARTITION BY q) < max(s) OVER (PARTITION BY q) AS votes FROM lex)"""
PRIOR = """
pr AS (SELECT key, rank() OVER (ORDER BY n_chars DESC) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS r FROM d)"""


def _top(static: str, extra: str = "", where: str = "", k: int = 5) -> str:
    return (
        "WITH "
        + LEX.format(where=where)
        + extra
        + f""", fused AS (SELECT lr.q, lr.key, round(CASE WHEN lr.votes THEN 1.0 / (60 + lr.r) ELSE 0 END{static}, 6) AS score FROM lr {{join}}),
        placed AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, key) AS place FROM fused)
        SELECT q, key, score, place FROM placed WHERE place <= {k}"""
    )


def _flat(pool: DataFrame) -> DataFrame:
    return pool.select("key", F.lit(0.0).alias("votes"))


@query(_top("").format(join=""))
def lexical_top5(spark, d):
    docs = corpus(spark, d)
    return rk.lexical_top(docs, asked(spark, d), _flat(docs))


@query(_top(" + 0.3 / (60 + pr.r)", "," + PRIOR).format(join="JOIN pr USING (key)"))
def rrf_fused_top5(spark, d):
    """Best documents for each benchmark text: lexical and prior channels, fused by reciprocal ranks."""
    docs = corpus(spark, d)
    return rk.lexical_top(docs, asked(spark, d), sel.static_votes(docs, {"n_chars": 0.3}))


@query(_top(" + 0.3 / (60 + pr.r)", "," + PRIOR, "WHERE lang = 'en'").format(join="JOIN pr USING (key)"))
def filter_scope(spark, d):
    docs = corpus(spark, d).where(F.col("lang") == "en")
    return rk.lexical_top(docs, asked(spark, d), sel.static_votes(docs, {"n_chars": 0.3}))


@query(
    _top(" + 1.0 / (60 + bo.r)", """, bo AS (SELECT key, rank() OVER (ORDER BY s DESC) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r
    FROM (SELECT key, (source = 'src1')::INT AS s FROM d))""").format(join="JOIN bo USING (key)")
)
def boost_source(spark, d):
    docs = corpus(spark, d)
    boosted = docs.withColumn("boost", (F.col("source") == "src1").cast("int"))
    return rk.lexical_top(docs, asked(spark, d), sel.static_votes(boosted, {"boost": 1.0}))


@query(_top("", ", flat AS (SELECT key, 1 AS s FROM d)").format(join=""))
def abstain_channels(spark, d):
    """A prior without any difference doesn't vote."""
    docs = corpus(spark, d).withColumn("same", F.lit(1))
    return rk.lexical_top(docs, asked(spark, d), sel.static_votes(docs, {"same": 0.3}))


@query(
    _top(" + 0.3 / (60 + ut.r)", """, u AS (SELECT d.key, coalesce((l.d + 1.0) / (l.d + l.f + 2.0), 0.5) AS s FROM d LEFT JOIN
    (SELECT CAST(doc_id AS VARCHAR) AS key, sum((quality = 1)::INT) AS d, sum((quality = 0)::INT) AS f FROM labels GROUP BY 1) l USING (key)),
    ut AS (SELECT key, rank() OVER (ORDER BY s DESC) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM u)""").format(join="JOIN ut USING (key)")
)
def utility_rank(spark, d):
    docs = corpus(spark, d)
    uses = t(spark, d, "labels").select(F.col("doc_id").cast("string").alias("key"), F.when(F.col("quality") == 1, "done").otherwise("failed").alias("state"))
    known = docs.join(sel.utility(uses), "key", "left").withColumn("utility", F.coalesce("utility", F.lit(0.5)))
    return rk.lexical_top(docs, asked(spark, d), sel.static_votes(known, {"utility": 0.3}))


MULTI = f"""
WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS key, text FROM documents),
qq AS (SELECT item_id AS q, 1 AS part, {IDENTS.format('text')} AS w FROM benchmark),
q AS (SELECT q, 1 AS part, w[1:len(w) // 2] AS w FROM qq UNION ALL SELECT q, 2, w[len(w) // 2 + 1:] FROM qq),
dt AS (SELECT DISTINCT key, unnest({IDENTS.format('text')}) AS tok FROM d),
qt AS (SELECT DISTINCT q, part, unnest(w) AS tok FROM q),
hit AS (SELECT q, part, key, count(*) AS hits FROM dt JOIN qt USING (tok) GROUP BY ALL),
lex AS (SELECT q.q, q.part, d.key, coalesce(hits, 0) AS s FROM q CROSS JOIN d LEFT JOIN hit ON hit.q = q.q AND hit.part = q.part AND hit.key = d.key),
lr AS (SELECT *, rank() OVER (PARTITION BY q, part ORDER BY s DESC) + (count(*) OVER (PARTITION BY q, part, s) - 1) / 2.0 AS r,
       min(s) OVER (PARTITION BY q, part) < max(s) OVER (PARTITION BY q, part) AS votes FROM lex),
fused AS (SELECT q, key, round(sum(CASE WHEN votes THEN 0.5 / (60 + r) ELSE 0 END), 6) AS score FROM lr GROUP BY q, key),
placed AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, key) AS place FROM fused)
SELECT q, key, score, place FROM placed WHERE place <= 5"""


@query(MULTI)
def multi_query_rrf(spark, d):
    """Two queries an item, each with half the channel's weight."""
    docs, words = corpus(spark, d).select("key", "text"), tx.identifiers(F.col("text"))
    half = F.floor(F.size(words) / 2).cast("int")
    parts = F.array(F.array_join(F.slice(words, F.lit(1), half), " "), F.array_join(F.slice(words, half + 1, F.size(words) - half), " "))
    split = asked(spark, d).select("q", F.explode(parts).alias("text"))
    return rk.fused(docs.withColumn("votes", F.lit(0.0)).withColumn("copies", F.lit(1).cast("bigint")), split, 5, {"lexical": 1.0}).select("q", "key", "score", "place")


@query("""
WITH x AS (SELECT CAST(doc_id AS VARCHAR) AS key, text, n_chars, row_number() OVER (PARTITION BY text ORDER BY n_chars DESC, CAST(doc_id AS VARCHAR)) AS twin FROM documents)
SELECT key, n_chars FROM x WHERE twin = 1""")
def dedup_exact(spark, d):
    best = F.min(F.struct((-F.col("n_chars")).alias("neg"), "key"))
    rows = corpus(spark, d).groupBy(F.sha2("text", 256).alias("sha")).agg(best.alias("best"))
    return rows.select("best.key", (-F.col("best.neg")).alias("n_chars"))


@query("SELECT CAST(doc_id AS VARCHAR) AS key, substr(text, 1, 100) AS display, length(text) > 100 AS truncated FROM documents")
def display_truncate(spark, d):
    shown, cut = sel.display(F.col("text"), 100)
    return corpus(spark, d).select("key", shown.alias("display"), cut.alias("truncated"))


@query("""SELECT lang, sum(strlen(text))::BIGINT AS pool_bytes, count(*) AS considered, sum(strlen(text)) <= 500000 AS included_all FROM documents GROUP BY lang""")
def include_all_gate(spark, d):
    size = F.sum(F.octet_length("text")).cast("bigint")
    return corpus(spark, d).groupBy("lang").agg(size.alias("pool_bytes"), F.count(F.lit(1)).alias("considered"), (size <= 500000).alias("included_all"))


BUDGET_SQL = (
    "WITH RECURSIVE "
    + LEX.format(where="")
    + """, placed AS (SELECT q, key, round(CASE WHEN votes THEN 1.0 / (60 + r) ELSE 0 END, 6) AS score FROM lr),
 ten AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, key) AS place FROM placed) WHERE place <= 10),
 b AS (SELECT ten.q, ten.key, ten.place, strlen(substr(d.text, 1, 2000))::BIGINT AS bytes FROM ten JOIN d USING (key)),
 fold AS (SELECT q, key, place, bytes, TRUE AS packed, bytes AS used FROM b WHERE place = 1
  UNION ALL SELECT b.q, b.key, b.place, b.bytes, f.used + b.bytes <= 6000, f.used + CASE WHEN f.used + b.bytes <= 6000 THEN b.bytes ELSE 0 END
  FROM fold f JOIN b ON b.q = f.q AND b.place = f.place + 1)
SELECT q, key, place, bytes, packed FROM fold"""
)


@query(BUDGET_SQL)
def budget_pack(spark, d):
    docs = corpus(spark, d)
    best = rk.lexical_top(docs, asked(spark, d), _flat(docs), k=10)
    shown = best.join(docs.select("key", sel.display(F.col("text"), 2000)[0].alias("display")), "key")
    return sel.pack_bytes(shown, 6000)


FUNNEL = (
    "WITH "
    + LEX.format(where="")
    + """, placed AS (SELECT q, key, round(CASE WHEN votes THEN 1.0 / (60 + r) ELSE 0 END, 6) AS score FROM lr),
 pl AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, key) AS place FROM placed),
 tw AS (SELECT pl.*, row_number() OVER (PARTITION BY q, d.text ORDER BY place) AS twin FROM pl JOIN d USING (key)),
 nth AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY place) AS n FROM tw WHERE twin = 1),
 pool AS (SELECT q, count(*) AS n, max(place) AS last FROM nth WHERE n <= 50 GROUP BY q)
SELECT tw.q, (SELECT count(*) FROM d) AS considered, count(*) AS gathered, count(*) FILTER (WHERE twin > 1 AND (pool.n < 50 OR place < pool.last)) AS deduped,
 any_value(pool.n) AS pool, least(any_value(pool.n), 5) AS chosen FROM tw JOIN pool USING (q) GROUP BY tw.q"""
)


@query(FUNNEL)
def funnel_counts(spark, d):
    """Every document is gathered; the pool is the first fifty different texts of the whole ranking."""
    docs = corpus(spark, d)
    cap, n = sel.pool_cap(5), F.lit(docs.count()).cast("bigint")
    pool = rk.lexical_top(docs, asked(spark, d), _flat(docs), k=cap, distinct=True)
    counts = sel.copies_passed(docs, pool, cap)
    return counts.select("q", n.alias("gathered"), "deduped", "pool", F.least("pool", F.lit(5)).cast("bigint").alias("chosen"), n.alias("considered"))


RECALL = _top("").format(join="").replace("SELECT q, key, score, place FROM placed WHERE place <= 5", """, best AS (SELECT q, key FROM placed WHERE place <= 5),
 golden AS (SELECT b.item_id AS q, CAST(d.doc_id AS VARCHAR) AS key FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
 found AS (SELECT g.q, max((best.key IS NOT NULL)::INT) AS hit FROM golden g LEFT JOIN best ON best.q = g.q AND best.key = g.key GROUP BY g.q)
 SELECT count(*) AS golden_queries, sum(hit)::BIGINT AS found_at_5 FROM found""")


@query(RECALL)
def recall_eval(spark, d):
    """Benchmark texts that stand verbatim in documents: for how many is one of these among the best five."""
    docs, items = corpus(spark, d), asked(spark, d)
    best = rk.lexical_top(docs, items, _flat(docs)).select("q", "key", F.lit(1).alias("hit"))
    golden = sel.verbatim(docs, items)
    per = golden.join(best, ["q", "key"], "left").groupBy("q").agg(F.max(F.coalesce("hit", F.lit(0))).alias("hit"))
    return per.agg(F.count(F.lit(1)).alias("golden_queries"), F.sum("hit").cast("bigint").alias("found_at_5"))


KNN = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
p AS (SELECT a.vec_id AS q, b.vec_id AS key, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a, e b WHERE a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, key) AS place FROM p)
SELECT q, key, score, place FROM r WHERE place <= 5"""


@query(KNN)
def knn_top5(spark, d):
    """Every row whose vec_id 50 divides, against all rows, through balls that can hold one of its best."""
    rows = t(spark, d, "embeddings").select(F.lit("all").alias("grp"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return nb.nearest(rows, rows.where("id % 50 = 0"), 5)[0]


CENTROID = """
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) GROUP BY ALL) GROUP BY label),
s AS (SELECT e.vec_id, CAST(c.label AS VARCHAR) AS label, round(list_cosine_similarity(e.v, c.c), 6) AS cos FROM e, c),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cos DESC, label) AS n FROM s)
SELECT vec_id, max(label) FILTER (WHERE n = 1) AS predicted, max(cos) FILTER (WHERE n = 1) AS score,
 round(max(cos) FILTER (WHERE n = 1) - coalesce(max(cos) FILTER (WHERE n = 2), 0), 6) AS margin FROM r GROUP BY vec_id"""


@query(CENTROID)
def nearest_centroid(spark, d):
    rows = t(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    means = rows.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    centroids = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    scored = rows.crossJoin(F.broadcast(centroids.withColumnRenamed("label", "l"))).select("vec_id", F.struct((-F.round(vx.cosine(F.col("v"), F.col("c")), 6)).alias("neg"), F.col("l").cast("string").alias("label")).alias("s"))
    best = scored.groupBy("vec_id").agg(F.slice(F.array_sort(F.collect_list("s")), 1, 2).alias("two"))
    one, two = F.col("two")[0], F.try_element_at(F.col("two"), F.lit(2))
    return best.select("vec_id", one["label"].alias("predicted"), (-one["neg"]).alias("score"), F.round(-one["neg"] - F.coalesce(-two["neg"], F.lit(0.0)), 6).alias("margin"))


def _mmr_sql(steps: int = 5) -> str:
    """The steps one after another: each takes the best by relevance less half its largest likeness to what is picked."""
    out = (
        "WITH "
        + LEX.format(where="")
        + """, sc AS (SELECT lr.q, lr.key, round(CASE WHEN lr.votes THEN 1.0 / (60 + lr.r) ELSE 0 END, 6) AS score, d.text FROM lr JOIN d USING (key)),
 tw AS (SELECT *, row_number() OVER (PARTITION BY q, text ORDER BY score DESC, key) AS twin FROM sc),
 po AS (SELECT q, key, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, key) AS n FROM tw WHERE twin = 1) WHERE n <= 50),
 rl AS (SELECT *, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS rel FROM po WINDOW w AS (PARTITION BY q)),
 """
        + FEATURES.format("(SELECT * FROM documents WHERE CAST(doc_id AS VARCHAR) IN (SELECT key FROM po))").strip()
        + """, ve AS (SELECT CAST(doc_id AS VARCHAR) AS key, slot, weight, sqrt(sum(weight * weight) OVER (PARTITION BY doc_id)) AS n FROM v),
 si AS (SELECT a.key AS a, b.key AS b, round(sum((a.weight / a.n) * (b.weight / b.n)), 9) AS x FROM ve a JOIN ve b USING (slot) WHERE a.n > 0 AND b.n > 0 GROUP BY ALL),
 r1 AS (SELECT *, 0.0::DOUBLE AS red FROM rl), p1 AS (SELECT q, key FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, key) AS n FROM r1) WHERE n = 1)"""
    )
    for k in range(2, steps + 1):
        out += f""", r{k} AS (SELECT r.q, r.key, r.score, r.rel, {'greatest(r.red, coalesce(si.x, 0))' if k > 2 else 'coalesce(si.x, 0)'} AS red FROM r{k - 1} r JOIN p{k - 1} p USING (q) LEFT JOIN si ON si.a = p.key AND si.b = r.key WHERE r.key <> p.key),
 p{k} AS (SELECT q, key FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(rel - 0.5 * red, 9) DESC, score DESC, key) AS n FROM r{k}) WHERE n = 1)"""
    return out + " " + " UNION ALL ".join(f"SELECT q, key, {k} AS step FROM p{k}" for k in range(1, steps + 1))


@query(_mmr_sql())
def mmr_select(spark, d):
    """Five diverse documents for each benchmark text, from the first fifty different texts of its whole ranking."""
    docs = corpus(spark, d)
    pool = rk.lexical_top(docs, asked(spark, d), _flat(docs), k=sel.pool_cap(5), distinct=True)
    vectors = sel.hash_vectors(docs.join(pool.select("key").distinct(), "key")).groupBy("key").agg(F.collect_list("slot").alias("slots"), F.collect_list(F.col("weight").cast("double")).alias("weights"))
    # A text without identifiers has no slots and stays in the pool.
    filled = [F.coalesce(c, F.array().cast(f"array<{t}>")).alias(c) for c, t in (("slots", "int"), ("weights", "double"))]
    return sel.mmr(pool.join(vectors, "key", "left").select("q", "key", "score", *filled))


GREP = [("license", "(?i)licensed under"), ("phone", r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}"), ("shout", "[A-Z]{4,}!!")]
GREP_SQL = "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents) " + " UNION ALL ".join(
    f"SELECT '{n}' AS rule, doc_id, line_no::BIGINT AS line_no, substr(line, 1, 400) AS hit FROM l WHERE regexp_matches(line, '{p}')" for n, p in GREP
)


@query(GREP_SQL)
def grep_hits(spark, d):
    lines = t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    rules = F.filter(F.array(*[F.when(F.col("line").rlike(p), F.lit(n)) for n, p in GREP]), lambda r: r.isNotNull())
    return lines.select(F.explode(rules).alias("rule"), "doc_id", (F.col("i") + 1).cast("bigint").alias("line_no"), F.substring("line", 1, 400).alias("hit"))


@query(r"""
WITH x AS (SELECT conv_id, turn, role || chr(10) || '```json' || chr(10) || '{"turn": ' || turn || '}' || chr(10) || '```' || chr(10) || CASE WHEN turn % 2 = 0 THEN '```json' || chr(10) || '{"turn": ' || (turn + 1) || '}' || chr(10) || '```' ELSE '' END AS t FROM conversations)
SELECT conv_id, turn, coalesce(list_extract(regexp_extract_all(t, '(?s)```json\s*\n(.*?)\n\s*```', 1), -1), t) AS verdict FROM x""")
def fence_extract(spark, d):
    fence = lambda n: F.concat(F.lit("```json\n{\"turn\": "), n.cast("string"), F.lit("}\n```"))
    turn = F.col("turn")
    body = F.concat(F.col("role"), F.lit("\n"), fence(turn), F.lit("\n"), F.when(turn % 2 == 0, fence(turn + 1)).otherwise(F.lit("")))
    return t(spark, d, "conversations").select("conv_id", "turn", tx.last_fenced(body).alias("verdict"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS key FROM documents d WHERE NOT (doc_id % 3 = 0)""")
def incremental_vectors(spark, d):
    """Rows whose vector isn't kept under the present text and model: here a third are."""
    docs = corpus(spark, d).select("key", "text")
    kept = docs.where(F.col("key").cast("bigint") % 3 == 0).select("key", tx.model_identity().alias("model_sha"), F.sha2(F.col("text"), 256).alias("text_sha"))
    return sel.missing_vectors(docs, kept).select("key")
