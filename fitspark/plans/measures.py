"""Queries on pairs, intervals, spans and sketches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fitspark.cluster import shared_dir
from fitspark.functions.tables import register_tables
from fitspark.operators import cells, sketches
from fitspark.operators.concordance import concordance
from fitspark.operators.intervals import overlap_join
from fitspark.plans.catalog import query, table
from fitspark.sources import documents, files
from fitspark.streaming import runs


@query("""
    WITH c AS (SELECT c_custkey, CASE WHEN c_nationkey < 9 THEN 0 ELSE c_nationkey END AS g, c_custkey % 97 AS a, round(c_acctbal / 50) AS b FROM customer),
    p AS (SELECT x.g, sum(CASE WHEN (x.a < y.a AND x.b < y.b) THEN 1 ELSE 0 END) AS c, sum(CASE WHEN (x.a < y.a AND x.b > y.b) THEN 1 ELSE 0 END) AS d FROM c x JOIN c y ON x.g = y.g GROUP BY x.g)
    SELECT p.g, n, CAST(c AS BIGINT) AS concordant, CAST(d AS BIGINT) AS discordant, round((c - d) / nullif(c + d, 0), 9)::DOUBLE AS gamma FROM p JOIN (SELECT g, count(*) AS n FROM c GROUP BY g) USING (g)""")
def concordant_pairs(spark, d):
    """Pairs of customers by two columns with ties, in groups of which one holds a third of all."""
    c = table(spark, d, "customer").select(F.when(F.col("c_nationkey") < 9, 0).otherwise(F.col("c_nationkey")).alias("g"), (F.col("c_custkey") % 97).alias("a"), F.round(F.col("c_acctbal") / 50).alias("b"))
    got = concordance(c, by=["g"], a="a", b="b")
    return got.select("g", "n", F.col("concordant").cast("long").alias("concordant"), F.col("discordant").cast("long").alias("discordant"), F.round("gamma", 9).alias("gamma"))


@query("""
    WITH p AS (SELECT o_orderkey AS k, o_custkey AS c, epoch(o_orderdate) AS s, epoch(o_orderdate) + 86400 * (1 + o_orderkey % 90 + CASE WHEN o_orderkey % 50 = 0 THEN 2000 ELSE 0 END) AS e FROM orders)
    SELECT a.c AS candidate, a.k AS first_position, b.k AS second_position, CAST(floor((least(a.e, b.e) - greatest(a.s, b.s)) / 86400) AS BIGINT) AS days FROM p a JOIN p b ON a.c = b.c AND a.k < b.k AND a.s < b.e AND b.s < a.e""")
def overlapping_positions(spark, d):
    """Positions of a candidate (orders of a customer) that overlap in time; some go on for years."""
    key, start = F.col("o_orderkey"), F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6
    p = table(spark, d, "orders").select(key.alias("k"), F.col("o_custkey").alias("c"), start.alias("s"), (start + 86400 * (1 + key % 90 + F.when(key % 50 == 0, 2000).otherwise(0))).alias("e"))
    span = (F.col("s"), F.col("e"))
    pairs = overlap_join(p, p, on=["c"], left_span=span, right_span=span, width=30 * 86400.0).where("left.k < right.k")
    days = F.floor((F.least("left.e", "right.e") - F.greatest("left.s", "right.s")) / 86400)
    return pairs.select(F.col("left.c").alias("candidate"), F.col("left.k").alias("first_position"), F.col("right.k").alias("second_position"), days.alias("days"))


@query("""
    WITH e AS (SELECT *, epoch_us(ts) AS us, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS span FROM events)
    SELECT user_id, min(CASE WHEN event_type = 'purchase' THEN event_id END) AS header, min(us) AS "first", max(us) AS "last", count(*) AS n_rows FROM e GROUP BY user_id, span""")
def header_spans(spark, d):
    """Spans that a purchase begins among a user's events, by a table function that takes its columns from the table."""
    register_tables(spark)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    events = table(spark, d, "events").select("user_id", at.alias("at"), F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("header"))
    return spark.sql("SELECT user_id, header, first, last, n_rows FROM fit_spans(TABLE({events}), split_by => 'user_id', order_by => 'at', header => 'header')", events=events)


@query("""
    WITH a AS (SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type),
    b AS (SELECT event_type, count(DISTINCT user_id) AS also_bought FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase') GROUP BY event_type)
    SELECT event_type, n, true AS users_close, true AS bought_close, true AS same_as_direct, true AS median_close FROM a JOIN b USING (event_type)""")
def stored_sketches(spark, d):
    """Sketches of users and values by day and type, stored, read again and merged: against direct ones and exact figures."""
    events = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    path = f"{shared_dir(spark)}/fitspark/sketches-{uuid.uuid4().hex}"
    sketches.store(sketches.partial(events, by=["day", "event_type"], sets={"users": "user_id"}, quantiles={"amounts": "value"}), path, day="day")
    days = sketches.stored(spark, path)
    whole = sketches.merged(days, by=["event_type"], sets=["users"], quantiles=["amounts"])
    direct = sketches.partial(events, by=["event_type"], sets={"d_users": "user_id"}).drop("n")
    buyers = events.where("event_type = 'purchase'").select("user_id").distinct()
    exact = events.groupBy("event_type").agg(F.countDistinct("user_id").alias("x_users"), F.percentile("value", 0.48).alias("x_low"), F.percentile("value", 0.52).alias("x_high"))
    also = events.join(buyers, "user_id").groupBy("event_type").agg(F.countDistinct("user_id").alias("x_bought"))
    bought = sketches.merged(days.where("event_type = 'purchase'"), by=[], sets=["users"]).select(F.col("users").alias("bought"))
    close = lambda got, want: F.abs(got - want) <= 0.05 * want
    rows = whole.join(direct, "event_type").join(exact, "event_type").join(also, "event_type").join(F.broadcast(bought))  # one row
    return rows.select(
        "event_type", "n", close(sketches.distinct("users"), F.col("x_users")).alias("users_close"), close(sketches.distinct(sketches.both("users", "bought")), F.col("x_bought")).alias("bought_close"),
        (sketches.distinct("users") == sketches.distinct("d_users")).alias("same_as_direct"), sketches.quantile("amounts", 0.5).between(F.col("x_low"), F.col("x_high")).alias("median_close"),
    )


@query("""
    WITH e AS (SELECT CAST(user_id AS VARCHAR) AS run_id, event_id, epoch_us(ts) // 1000 AS ms, CAST(floor(value) AS BIGINT) AS tokens, event_type = 'error' AS failed, event_type = 'purchase' AS ends FROM events),
    b AS (SELECT *, CASE WHEN coalesce(ms - lag(ms) OVER w >= 43200000 OR lag(ends) OVER w, true) THEN 1 ELSE 0 END AS begins FROM e WINDOW w AS (PARTITION BY run_id ORDER BY ms, event_id)),
    p AS (SELECT *, sum(begins) OVER (PARTITION BY run_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS part FROM b)
    SELECT run_id, min(ms) AS started, max(ms) AS "last", CASE WHEN bool_or(ends) THEN 'done' ELSE 'stalled' END AS status, count(*) AS n_calls, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(CASE WHEN failed THEN 1 ELSE 0 END) AS BIGINT) AS n_errors
    FROM p GROUP BY run_id, part""")
def closed_runs(spark, d):
    """Runs that ended or stalled: the batch twin of a stream with state and timers."""
    e = table(spark, d, "events")
    entries = e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), "ts", F.floor("value").alias("tokens"), F.when(F.col("event_type") == "error", "failed").alias("error"), (F.col("event_type") == "purchase").alias("ends"))
    return runs.closed_runs(entries.unionByName(entries.where("seq % 7 = 0")), gap_seconds=43_200)


@query("""
    WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 3)
    SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], q.q), 6) AS similarity FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], q.q) DESC, vec_id LIMIT 25""")
def pruned_topk(spark, d):
    """Exact top-k from vectors stored by cells, of which those that cannot hold a result are not read."""
    vectors = table(spark, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    path = f"{shared_dir(spark)}/fitspark/cells-{uuid.uuid4().hex}"
    cells.build(vectors, path, vector="embedding", key="vec_id")
    asked = vectors.where("vec_id = 3").select("embedding").first()[0]
    found, _, _ = cells.search(spark, path, asked, k=25, vector="embedding", key="vec_id")
    return found.select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


@query("""SELECT 'supplier ' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '.docx' ELSE '.txt' END AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'docx' ELSE 'text' END AS kind, s_name || ' <&> é' || chr(10) || round(s_acctbal, 2) AS text FROM supplier""")
def written_files(spark, d):
    """A text or DOCX file for each supplier, read back."""
    even = F.col("s_suppkey") % 2 == 0
    body = F.concat("s_name", F.lit(" <&> é\n"), F.round("s_acctbal", 2).cast("string"))
    rows = table(spark, d, "supplier").select(F.concat(F.lit("supplier "), F.col("s_suppkey").cast("string")).alias("name"), F.when(even, "docx").otherwise("txt").alias("kind"), body.alias("text"))
    path = f"{shared_dir(spark)}/fitspark/files-{uuid.uuid4().hex}"
    files.write_files(rows, path)
    back = documents.read_documents(spark, path)
    return back.select(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("%20"), F.lit(" ")).alias("name"), "kind", "text")
