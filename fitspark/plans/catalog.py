"""Queries over the driver's tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fitspark.functions import arrays, dates, text
from fitspark.operators import lexical, matching, metrics, ranking

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------ vectors


@query("""
    WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)
    SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q.q), 6) AS similarity
    FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], q.q) DESC, vec_id LIMIT 10""")
def vector_topk(spark, d):
    e = table(spark, d, "embeddings")
    return ranking.nearest(e, _vector(e, 0), k=10, vector="embedding", key="vec_id").select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("""
    WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 1),
    s AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], q.q) AS s FROM embeddings, q WHERE label IN (1, 3))
    SELECT vec_id, label, round(s, 6) AS similarity FROM s ORDER BY s DESC, vec_id LIMIT 5""")
def vector_topk_filtered(spark, d):
    e = table(spark, d, "embeddings")
    near = ranking.nearest(e.where(F.col("label").isin(1, 3)), _vector(e, 1), k=5, vector="embedding", key="vec_id")
    return near.select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


@query("""
    WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 2),
    s AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], q.q) AS s FROM embeddings, q),
    r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS rank FROM s)
    SELECT label, rank, vec_id, round(s, 6) AS similarity FROM r WHERE rank <= 3""")
def vector_topk_per_label(spark, d):
    e = table(spark, d, "embeddings")
    scored = e.withColumn("similarity", arrays.cosine(F.col("embedding"), _vector(e, 2)))
    return ranking.top_per_group(scored, ["label"], [F.desc("similarity"), F.col("vec_id")], 3).select("label", F.col("rank").cast("long").alias("rank"), "vec_id", F.round("similarity", 6).alias("similarity"))


def _vector(e: DataFrame, vec_id: int) -> Column:
    """One stored vector as a literal: a point lookup."""
    return F.array(*(F.lit(float(x)) for x in e.where(F.col("vec_id") == vec_id).select("embedding").first()[0]))


@query("""
    SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)), 6) AS squared,
           round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS first
    FROM embeddings""")
def vector_l2_normalize(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.round(F.pow(arrays.norm(F.col("embedding")), 2), 6).alias("squared"), F.round(F.get(arrays.unit(F.col("embedding")), F.lit(0)), 6).alias("first"))


@query("""
    WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
    c AS (SELECT label, i, avg(v) AS m FROM x GROUP BY label, i)
    SELECT label, round(sqrt(sum(m * m)), 6) AS centroid_norm, count(*) AS dims FROM c GROUP BY label""")
def centroid_norms(spark, d):
    x = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    c = x.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return c.groupBy("label").agg(F.round(F.sqrt(F.sum(F.col("m") * F.col("m"))), 6).alias("centroid_norm"), F.count(F.lit(1)).alias("dims"))


# ------------------------------------------------------------------ tokens and patterns

STOP_SQL = ", ".join(f"'{w}'" for w in text.STOPWORDS)
TOKENS_SQL = f"list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 1 AND x NOT IN ({STOP_SQL})))"


@query(f"SELECT doc_id, len({TOKENS_SQL}) AS n_tokens, md5(array_to_string(list_sort({TOKENS_SQL}), ' ')) AS digest FROM documents")
def token_sets(spark, d):
    t = table(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join(F.array_sort("t"), " ")).alias("digest"))


@query(f"""
    WITH q AS (SELECT item_id, {TOKENS_SQL} AS q FROM benchmark), t AS (SELECT doc_id, {TOKENS_SQL} AS t FROM documents),
    s AS (SELECT item_id, doc_id, CASE WHEN len(q) = 0 OR len(t) = 0 THEN 0 ELSE len(list_intersect(q, t)) / len(q) END AS s FROM q, t)
    SELECT doc_id, round(avg(s), 6) AS lexical_fit FROM s GROUP BY doc_id""")
def lexical_fit(spark, d):
    """The mean share of every item's tokens that a document has: a token counts for what it adds to that mean."""
    items = table(spark, d, "benchmark").select("item_id", text.tokens(F.col("text")).alias("q"))
    n = items.count()
    weights = items.select(F.explode("q").alias("w"), (1 / F.size("q")).alias("share")).groupBy("w").agg((F.sum("share") / n).alias("share"))
    docs = table(spark, d, "documents").select("doc_id", F.explode_outer(text.tokens(F.col("text"))).alias("w"))
    return docs.join(broadcast_if_small(weights), "w", "left").groupBy("doc_id").agg(F.round(F.coalesce(F.sum("share"), F.lit(0.0)), 6).alias("lexical_fit"))


#: A side of more rows than this is not broadcast.
BROADCAST_ROWS = 200_000


def broadcast_if_small(rows: DataFrame) -> DataFrame:
    """A hint to broadcast light rows, if they are few; beyond that the join shuffles both sides."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


@query(f"""
    WITH q AS (SELECT DISTINCT item_id, unnest({TOKENS_SQL}) AS w FROM benchmark),
    t AS (SELECT DISTINCT doc_id, unnest({TOKENS_SQL}) AS w FROM documents),
    n AS (SELECT item_id, count(*) AS n FROM q GROUP BY item_id)
    SELECT q.item_id, max(hits) AS most_hits, count(*) AS documents_hit
    FROM (SELECT q.item_id, t.doc_id, count(*) AS hits FROM q JOIN t USING (w) GROUP BY ALL) q JOIN n USING (item_id)
    WHERE hits * 2 >= n GROUP BY q.item_id""")
def lexical_overlap(spark, d):
    """The inverted form: an equi-join on each item's rarest tokens, verified on whole sets."""
    tokenized = lambda name, key: table(spark, d, name).select(key, text.tokens(F.col("text")).alias("tokens"))
    pairs = lexical.overlapping(tokenized("benchmark", "item_id"), tokenized("documents", "doc_id"), item="item_id", doc="doc_id")
    return pairs.groupBy("item_id").agg(F.max("hits").cast("long").alias("most_hits"), F.count(F.lit(1)).alias("documents_hit"))


@query(r"""
    SELECT doc_id, regexp_matches(text, '(?i)\btoken\b|password') AS names_secret, len(regexp_extract_all(text, '(?i)tion')) AS n_tion,
           (length(text) - length(replace(text, 'the', ''))) // 3 AS n_the
    FROM documents""")
def regex_flags(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", (text.flag(t, r"\btoken\b|password") == 1.0).alias("names_secret"), text.count_matches(t, "tion").cast("long").alias("n_tion"), text.count_literal(t, "the").cast("long").alias("n_the"))


@query("""
    WITH n AS (SELECT doc_id, (length(lower(text)) - length(replace(lower(text), 'and', ''))) // 3 + (length(lower(text)) - length(replace(lower(text), 'tion', ''))) // 4 AS i,
                      (length(lower(text)) - length(replace(lower(text), 'sch', ''))) // 3 AS o FROM documents)
    SELECT doc_id, round((i + 1) / (i + o + 2), 6) AS ratio, o >= 3 AND o > i AS mostly_outside FROM n""")
def domain_ratio(spark, d):
    low = F.lower("text")
    n_in, n_out = text.count_terms(low, ("and", "tion")), text.count_terms(low, ("sch",))
    return table(spark, d, "documents").select("doc_id", F.round(text.domain_ratio(F.col("text"), ("and", "tion"), ("sch",)), 6).alias("ratio"), ((n_out >= 3) & (n_out > n_in)).alias("mostly_outside"))


CHUNK_SQL = "CASE WHEN regexp_matches(text, '(?i)tion') THEN 1.0 ELSE 0.0 END * CASE WHEN role = 'assistant' THEN 1.0 ELSE 0.7 END * pow(0.5, turn / 30.0)"


@query(f"""
    SELECT conv_id, round(max({CHUNK_SQL}), 6) AS evidence, round(max(CASE WHEN role = 'assistant' AND length(text) > 100 THEN pow(0.5, turn / 30.0) ELSE 0 END), 6) AS depth
    FROM conversations GROUP BY conv_id""")
def evidence_max(spark, d):
    age = dates.half_life(F.col("turn"), 30.0)
    owner = F.col("role") == "assistant"
    hit = text.flag(F.col("text"), "tion") * F.when(owner, 1.0).otherwise(0.7) * age
    depth = F.when(owner & (F.length("text") > 100), age).otherwise(0.0)
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.round(F.max(hit), 6).alias("evidence"), F.round(F.max(depth), 6).alias("depth"))


# ------------------------------------------------------------------ dates, ladders, numbers


@query("""
    WITH t(limit_, mult) AS (VALUES (10, 1.0), (20, 0.93), (30, 0.9), (45, 0.85))
    SELECT p_partkey, CAST(coalesce((SELECT arg_min(mult, limit_) FROM t WHERE p_size <= limit_), 0.85) AS DOUBLE) AS mult FROM part""")
def notice_ladder(spark, d):
    return table(spark, d, "part").select("p_partkey", dates.first_rung(F.col("p_size"), [(10, 1.0), (20, 0.93), (30, 0.9), (45, 0.85)]).alias("mult"))


@query("""
    WITH t(gt, mult) AS (VALUES (36, 0.35), (18, 0.7), (1, 0.9)),
    o AS (SELECT o_orderkey, 12 * (1998 - year(o_orderdate)) + (1 - month(o_orderdate)) + (1 - day(o_orderdate)) / 30.0 AS age FROM orders)
    SELECT o_orderkey, round(age, 6) AS age, CAST(coalesce((SELECT arg_max(mult, gt) FROM t WHERE age > gt), 1.0) AS DOUBLE) AS mult FROM o""")
def recency_ladder(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", dates.months(F.col("o_orderdate"), F.to_date(F.lit("1998-01-01"))).alias("age"))
    return o.select("o_orderkey", F.round("age", 6).alias("age"), dates.last_rung(F.col("age"), [(36, 0.35), (18, 0.7), (1, 0.9)]).alias("mult"))


@query("""
    WITH t(gt, mult) AS (VALUES (0, 1.0), (5, 0.9), (15, 0.7), (40, 0.35))
    SELECT p_partkey, CAST(mult AS DOUBLE) AS mult FROM (
      SELECT p_partkey, mult, row_number() OVER (PARTITION BY p_partkey ORDER BY gt DESC) AS r FROM part JOIN t ON p_size > gt) WHERE r = 1""")
def asof_join_table(spark, d):
    """The as-of lookup with the ladder as a table."""
    ladder = spark.createDataFrame([(0, 1.0), (5, 0.9), (15, 0.7), (40, 0.35)], "gt int, mult double")
    return matching.as_of(table(spark, d, "part"), ladder, on="p_size", at="gt", take=["mult"], strict=True).where("mult is not null").select("p_partkey", "mult")


@query("SELECT c_custkey, round(exp(-pow(c_acctbal / 1000 - 4, 2) / (2 * 3.0 * 3.0)), 6) AS band FROM customer")
def gaussian_band(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(dates.gaussian(F.col("c_acctbal") / 1000, 4.0, 3.0), 6).alias("band"))


@query("""
    WITH m AS (SELECT user_id, event_type, max(value) AS v FROM events WHERE event_type <> 'view' GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v DESC) AS r FROM m),
    t AS (SELECT user_id, avg(v) FILTER (WHERE r <= 3) AS mean, count(*) AS n FROM r GROUP BY user_id)
    SELECT user_id, round(least(1, greatest(0, (mean - 40) / 50)) * n / (n + 0.5), 6) AS strength FROM t""")
def topk_mean_shrunk(spark, d):
    m = table(spark, d, "events").where("event_type <> 'view'").groupBy("user_id", "event_type").agg(F.max("value").alias("v"))
    u = m.groupBy("user_id").agg(F.collect_list("v").alias("v"))  # as many values as there are event types
    return u.select("user_id", F.round(arrays.shrunk_top_mean(F.col("v"), 3, 40.0, 50.0, 0.5), 6).alias("strength"))


@query("SELECT event_id, CAST(round_even(value, 0) AS INTEGER) AS even, CAST(least(50, greatest(0, round_even(value, 0))) AS INTEGER) AS clamped FROM events")
def bround_clamp(spark, d):
    return table(spark, d, "events").select("event_id", F.bround("value", 0).cast("int").alias("even"), dates.clamp_int(F.col("value"), 0, 50, 0).alias("clamped"))


@query("""
    SELECT p_partkey, CASE WHEN s = '' THEN 'signal' ELSE s END AS slug FROM (
      SELECT p_partkey, rtrim(substr(CASE WHEN regexp_matches(t, '^[a-z]') OR t = '' THEN t ELSE 'sig_' || t END, 1, 32), '_') AS s
      FROM (SELECT p_partkey, trim(regexp_replace(lower(p_brand || ' ' || p_name), '[^a-z0-9]+', '_', 'g'), '_') AS t FROM part))""")
def slugify(spark, d):
    return table(spark, d, "part").select("p_partkey", text.slug(F.concat_ws(" ", "p_brand", "p_name")).alias("slug"))


# ------------------------------------------------------------------ metrics

STUDY_SQL = """study AS (SELECT user_id % 50 AS jd, CASE event_type WHEN 'purchase' THEN 'strong' WHEN 'click' THEN 'borderline' ELSE 'weak' END AS tier,
    CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS method, event_id % 4 AS repeat, value AS score, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 100 END AS tokens,
    value / 1000 AS elapsed_s, CASE WHEN event_id % 11 = 0 THEN 'failed' END AS error FROM events)"""
MEANS_SQL = f"WITH {STUDY_SQL}, m AS (SELECT method, jd, tier, avg(score) AS score FROM study GROUP BY ALL)"
PAIRS_SQL = f"{MEANS_SQL}, p AS (SELECT a.method, a.jd, a.score - b.score AS gap FROM m a JOIN m b ON a.method = b.method AND a.jd = b.jd AND CASE a.tier WHEN 'strong' THEN 3 WHEN 'borderline' THEN 2 ELSE 1 END > CASE b.tier WHEN 'strong' THEN 3 WHEN 'borderline' THEN 2 ELSE 1 END)"


def study(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    tier = F.when(F.col("event_type") == "purchase", "strong").when(F.col("event_type") == "click", "borderline").otherwise("weak")
    return table(spark, d, "events").select((F.col("user_id") % 50).alias("jd"), tier.alias("tier"), (k % 3).alias("method"), (F.col("event_id") % 4).alias("repeat"), F.col("value").alias("score"), F.when(F.col("event_id") % 7 != 0, F.col("event_id") % 100).alias("tokens"), (F.col("value") / 1000).alias("elapsed_s"), F.when(F.col("event_id") % 11 == 0, "failed").alias("error"))


@query(f"{MEANS_SQL} SELECT method, jd, tier, round(score, 6) AS score FROM m")
def tier_means(spark, d):
    return metrics.tier_means(study(spark, d)).withColumn("score", F.round("score", 6))


@query(f"{PAIRS_SQL}, j AS (SELECT method, jd, avg(CASE WHEN gap > 0 THEN 1.0 ELSE 0.0 END) AS a FROM p GROUP BY ALL) SELECT method, round(avg(a), 6) AS pairwise_accuracy FROM j GROUP BY method")
def pairwise_accuracy(spark, d):
    return metrics.pairwise_accuracy(metrics.tier_means(study(spark, d))).withColumn("pairwise_accuracy", F.round("pairwise_accuracy", 6))


@query(f"{PAIRS_SQL}, j AS (SELECT method, jd, coalesce(sum(sign(gap)) / nullif(sum(abs(sign(gap))), 0), 0) AS k FROM p GROUP BY ALL) SELECT method, round(avg(k), 6) AS kendall FROM j GROUP BY method")
def kendall(spark, d):
    return metrics.kendall(metrics.tier_means(study(spark, d))).withColumn("kendall", F.round("kendall", 6))


@query(f"WITH {STUDY_SQL}, g AS (SELECT method, jd, tier, stddev_pop(score) AS s, count(*) AS n FROM study GROUP BY ALL) SELECT method, round(avg(s), 6) AS stability FROM g WHERE n >= 2 GROUP BY method")
def stability(spark, d):
    return metrics.stability(study(spark, d)).withColumn("stability", F.round("stability", 6))


@query(f"WITH {STUDY_SQL} SELECT method, CAST(sum(tokens) AS BIGINT) AS tokens, round_even(sum(elapsed_s), 3) AS elapsed_s, count(*) AS n_calls, count(*) FILTER (WHERE error <> '') AS n_errors FROM study GROUP BY method")
def cost_rollup(spark, d):
    return metrics.cost(study(spark, d))


@query(f"""{PAIRS_SQL}, j AS (SELECT method, jd, avg(CASE WHEN gap > 0 THEN 1.0 ELSE 0.0 END) AS a, coalesce(sum(sign(gap)) / nullif(sum(abs(sign(gap))), 0), 0) AS k FROM p GROUP BY ALL),
    r AS (SELECT method, avg(a) AS a, avg(k) AS k FROM j GROUP BY method), g AS (SELECT method, jd, tier, stddev_pop(score) AS s, count(*) AS n FROM study GROUP BY ALL),
    s AS (SELECT method, avg(s) AS s FROM g WHERE n >= 2 GROUP BY method),
    c AS (SELECT method, CAST(sum(tokens) AS BIGINT) AS tokens, round_even(sum(elapsed_s), 3) AS elapsed_s, count(*) AS n_calls, count(*) FILTER (WHERE error <> '') AS n_errors FROM study GROUP BY method)
    SELECT method, round(a, 6) AS pairwise_accuracy, round(k, 6) AS kendall, round(s, 6) AS stability, tokens, elapsed_s, n_calls, n_errors FROM c LEFT JOIN r USING (method) LEFT JOIN s USING (method)""")
def method_dashboard(spark, d):
    out = metrics.dashboard(study(spark, d))
    return out.select("method", *(F.round(c, 6).alias(c) for c in ("pairwise_accuracy", "kendall", "stability")), "tokens", "elapsed_s", "n_calls", "n_errors")


@query("SELECT CAST(count(*) AS BIGINT) AS entries, count(*) FILTER (WHERE event_id % 11 <> 0) AS ok, count(*) FILTER (WHERE event_id % 11 = 0) AS failed, round_even(sum(value), 3) AS elapsed_s, (SELECT event_type FROM events ORDER BY value DESC, event_id LIMIT 1) AS slowest FROM events")
def telemetry_rollup(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("leaf"), (F.col("event_id") % 11 != 0).alias("ok"), F.col("value").alias("elapsed_s"))
    return metrics.telemetry(e)


@query("""
    SELECT event_id, sum(1) OVER w AS n_so_far, round(sum(value) OVER w, 4) AS value_so_far, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS errors_so_far
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def running_totals(spark, d):
    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", F.count(F.lit(1)).over(w).alias("n_so_far"), F.round(F.sum("value").over(w), 4).alias("value_so_far"), F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).over(w).alias("errors_so_far"))


@query("SELECT count(DISTINCT user_id) AS users, count(DISTINCT (user_id, event_type)) AS pairs FROM events")
def distinct_counts(spark, d):
    return table(spark, d, "events").agg(F.count_distinct("user_id").alias("users"), F.count_distinct(F.struct("user_id", "event_type")).alias("pairs"))


# ------------------------------------------------------------------ rankings, joins, sets


@query("""
    WITH t AS (SELECT c_custkey, c_name, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS total, list(DISTINCT o_orderstatus ORDER BY o_orderstatus) AS flags FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL)
    SELECT row_number() OVER (ORDER BY total DESC, c_custkey) AS rank, c_custkey, CAST(round(total, 1) AS DOUBLE) AS overall, array_to_string(flags, ', ') AS flags FROM t ORDER BY total DESC, c_custkey LIMIT 20""")
def leaderboard(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    totals = o.groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("overall"), F.array_sort(F.collect_set("o_orderstatus")).alias("flags"))
    rows = totals.join(c, totals.o_custkey == c.c_custkey).select("c_custkey", "overall", "flags")
    board = ranking.leaderboard(rows, score="overall", key="c_custkey", lists={"flags": "flags"}, limit=20)
    return board.select(F.col("rank").cast("long").alias("rank"), "c_custkey", F.round("overall", 1).cast("double").alias("overall"), "flags")


@query("SELECT r_regionkey, n_nationkey, CAST(i AS BIGINT) AS repeat FROM region, nation, range(3) t(i) WHERE r_regionkey = n_regionkey")
def study_plan(spark, d):
    pairs = table(spark, d, "region").join(table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).select("r_regionkey", "n_nationkey")
    return metrics.study_plan(pairs, repeats=3)


@query("""
    WITH b AS (SELECT s_suppkey, unnest(['name', 'nation', 'balance']) AS path, unnest([s_name, CAST(s_nationkey AS VARCHAR), CAST(CAST(s_acctbal AS INTEGER) AS VARCHAR)]) AS v FROM supplier),
    a AS (SELECT s_suppkey, unnest(['name', 'nation', 'balance', 'note']) AS path, unnest([CASE WHEN s_suppkey % 3 = 0 THEN upper(s_name) || '!' ELSE s_name END, CAST(s_nationkey + s_suppkey % 2 AS VARCHAR), CAST(CAST(s_acctbal AS INTEGER) AS VARCHAR), CASE WHEN s_suppkey % 5 = 0 THEN 'new' END]) AS v FROM supplier)
    SELECT coalesce(a.s_suppkey, b.s_suppkey) AS s_suppkey, coalesce(a.path, b.path) AS path, b.v AS before, a.v AS after
    FROM b FULL JOIN a ON a.s_suppkey = b.s_suppkey AND a.path = b.path WHERE a.v IS DISTINCT FROM b.v""")
def record_diff(spark, d):
    s = table(spark, d, "supplier")
    cell = lambda path, v: F.struct(F.lit(path).alias("path"), v.cast("string").alias("value"))
    balance = cell("balance", F.bround("s_acctbal").cast("int"))
    before = s.select("s_suppkey", F.inline(F.array(cell("name", F.col("s_name")), cell("nation", F.col("s_nationkey")), balance)))
    name = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.upper("s_name"), F.lit("!"))).otherwise(F.col("s_name"))
    after = s.select("s_suppkey", F.inline(F.array(cell("name", name), cell("nation", F.col("s_nationkey") + F.col("s_suppkey") % 2), balance, cell("note", F.when(F.col("s_suppkey") % 5 == 0, "new")))))
    return matching.diff(before, after, keys=["s_suppkey"])


@query(f"""
    WITH t AS (SELECT doc_id, {TOKENS_SQL} AS t FROM documents)
    SELECT a.doc_id, round(len(list_intersect(a.t, b.t)) / greatest(1, len(list_distinct(list_concat(a.t, b.t)))), 6) AS jaccard
    FROM t a JOIN t b ON b.doc_id = a.doc_id + 1""")
def jaccard_pairs(spark, d):
    t = table(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    nxt = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("t").alias("u"))
    return t.join(nxt, "doc_id").select("doc_id", F.round(arrays.overlap(F.col("t"), F.col("u")), 6).alias("jaccard"))


@query("SELECT user_id, event_id, event_type, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def upsert_latest(spark, d):
    e = table(spark, d, "events")
    return matching.latest(e, keys=["user_id"], order=[F.desc("event_id")]).select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))


@query("SELECT event_id, event_type FROM events WHERE user_id = 7 ORDER BY ts, event_id")
def workspace_listing(spark, d):
    return table(spark, d, "events").where("user_id = 7").orderBy("ts", "event_id").select("event_id", "event_type")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def point_lookup(spark, d):
    return table(spark, d, "customer").where("c_custkey = 42").select("c_custkey", "c_name").limit(1)


# ------------------------------------------------------------------ documents and pages


@query(r"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
    k AS (SELECT *, lower(trim(regexp_replace(line, '\s+', ' ', 'g'))) AS key FROM l),
    f AS (SELECT doc_id, arg_min(line, pos) AS line, min(pos) AS pos FROM k WHERE key <> '' GROUP BY doc_id, key)
    SELECT doc_id, count(*) AS n_lines, md5(string_agg(trim(line), chr(10) ORDER BY pos)) AS digest FROM f GROUP BY doc_id""")
def ordered_dedup_lines(spark, d):
    lines = F.filter(F.split("text", "\n"), lambda x: text.tidy_key(x) != "")
    kept = table(spark, d, "documents").select("doc_id", arrays.distinct_by(lines, text.tidy_key).alias("kept")).where(F.size("kept") > 0)
    return kept.select("doc_id", F.size("kept").cast("long").alias("n_lines"), F.md5(F.array_join(F.transform("kept", lambda x: F.trim(x)), "\n")).alias("digest"))


@query(r"SELECT doc_id, length(regexp_replace(text, '\s+', '', 'g')) < 20 AS nearly_empty, trim(coalesce(substr(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1], 1, 80), '')) AS first_line FROM documents")
def nearly_empty(spark, d):
    return table(spark, d, "documents").select("doc_id", text.nearly_empty(F.col("text"), F.lit(1)).alias("nearly_empty"), F.trim(text.first_line(F.col("text"))).alias("first_line"))


# The references that the pages of the tables have; an ampersand comes last, so that nothing is decoded twice.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&middot;", "·"))


def _decoded(sql: str) -> str:
    for name, char in ENTITIES:
        sql = f"replace({sql}, '{name}', " + ("chr(39)" if char == "'" else f"'{char}'") + ")"
    return f"regexp_replace({sql}, '&amp;?', '&', 'g')"


HTML_SQL = f"CASE WHEN html LIKE '%&lt;%' THEN {_decoded('html')} ELSE html END"
for _pattern, _instead in ((r"(?i)<\s*br\s*/?>", "chr(10)"), (r"(?i)<\s*li[^>]*>", "chr(10) || '- '"), (r"(?i)</\s*(?:p|div|section|ul|ol|h[1-6])\s*>", "chr(10)"), (r"(?i)<\s*h[1-6][^>]*>", "chr(10) || chr(10)"), ("<[^>]+>", "''")):
    HTML_SQL = f"regexp_replace({HTML_SQL}, '{_pattern}', {_instead}, 'g')"
HTML_SQL = _decoded(HTML_SQL)
HTML_SQL = rf"regexp_replace(regexp_replace(regexp_replace({HTML_SQL}, '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@query(f"WITH p AS (SELECT page_id, CASE WHEN page_id % 4 = 1 THEN replace(replace(html, '&', '&amp;'), '<', '&lt;') ELSE html END AS html FROM pages) SELECT page_id, length({HTML_SQL}) AS n_chars, md5({HTML_SQL}) AS digest FROM p")
def html_to_text(spark, d):
    """Every page; every fourth one is escaped first, as some feeds have them."""
    escaped = F.replace(F.replace("html", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    t = table(spark, d, "pages").select("page_id", text.html_text(F.when(F.col("page_id") % 4 == 1, escaped).otherwise(F.col("html"))).alias("t"))
    return t.select("page_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"))


@query(r"SELECT page_id, regexp_extract(url, '^https?://([^/:]+)', 1) AS host, CASE WHEN regexp_matches(url, '^https://') THEN 'secure' WHEN regexp_matches(url, '^http://') THEN 'plain' ELSE 'other' END AS route FROM pages")
def url_routing(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/:]+)", 1).alias("host"), F.when(F.col("url").rlike("^https://"), "secure").when(F.col("url").rlike("^http://"), "plain").otherwise("other").alias("route"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, least(100, greatest(0, CAST(json_extract_string(props, '$.k') AS DOUBLE))) AS score FROM events")
def json_members(spark, d):
    score = F.concat(F.lit('{"fit": '), F.get_json_object("props", "$.k"), F.lit("}"))
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"), text.score_of(score).alias("score"))


@query("""
    SELECT c_custkey, (list_filter([CASE WHEN c_acctbal < 0 THEN 'c_acctbal: below 0' END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'c_mktsegment: not allowed' END,
           CASE WHEN c_nationkey > 20 THEN 'c_nationkey: above 20' END], lambda x: x IS NOT NULL))[1] AS violation FROM customer""")
def schema_violations_first(spark, d):
    rules = [("c_acctbal", "below 0", F.col("c_acctbal") < 0), ("c_mktsegment", "not allowed", ~F.col("c_mktsegment").isin("BUILDING", "MACHINERY")), ("c_nationkey", "above 20", F.col("c_nationkey") > 20)]
    return table(spark, d, "customer").select("c_custkey", matching.first_violation(rules).alias("violation"))


@query("""
    SELECT doc_id, lang, source FROM documents WHERE source IN ('src1', 'src2')
    UNION SELECT doc_id, lang, source FROM documents WHERE lang = 'de' EXCEPT SELECT doc_id, lang, source FROM documents WHERE n_chars < 500""")
def relational_sets(spark, d):
    docs = table(spark, d, "documents")
    some = docs.where(F.col("source").isin("src1", "src2")).select("doc_id", "lang", "source").union(docs.where("lang = 'de'").select("doc_id", "lang", "source")).distinct()
    return some.exceptAll(docs.where("n_chars < 500").select("doc_id", "lang", "source")).distinct()
