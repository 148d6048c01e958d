"""Queries that run the smaller operators, the store and the sinks on the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitspark.backends import MockJudge, entries, write_entries
from fitspark.cluster import shared_dir
from fitspark.embedding import DigestEmbedding, embed_texts
from fitspark.functions import dates, text
from fitspark.operators import coerce, ranking
from fitspark.plans import candidates as pool
from fitspark.plans.catalog import query, table
from fitspark.plans.session import RUBRIC, from_rows, judge, to_rows
from fitspark.plans.store import Store
from fitspark.sources import sections, study


def _place(spark, label: str) -> str:
    return f"{shared_dir(spark)}/fitspark/{label}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ store and sinks


def _resumes(spark, d: str) -> Store:
    """A store of one résumé for each customer, of which every third is saved again, then cleaned and every ninth saved once more."""
    store = Store(spark, _place(spark, "store"))
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(k.cast("string").alias("resume_id"), F.concat(F.lit("w"), (k % 50).cast("string")).alias("workspace_id"), F.col("c_name").alias("name"), F.format_string("%06d", k % 7).alias("created_at"))
    store.save("resumes", rows)
    store.save("resumes", rows.where("resume_id % 3 = 0").withColumn("name", F.lit("second")))
    store.clean("resumes")
    store.save("resumes", rows.where("resume_id % 9 = 0").withColumn("name", F.lit("third")))
    return store


RESUMES_SQL = "SELECT CAST(c_custkey AS VARCHAR) AS resume_id, 'w' || c_custkey % 50 AS workspace_id, CASE WHEN c_custkey % 9 = 0 THEN 'third' WHEN c_custkey % 3 = 0 THEN 'second' ELSE c_name END AS name, printf('%06d', c_custkey % 7) AS created_at FROM customer"


@query(RESUMES_SQL)
def store_upsert(spark, d):
    return _resumes(spark, d).read("resumes").select("resume_id", "workspace_id", "name", "created_at")


@query(f"SELECT resume_id, name, row_number() OVER (ORDER BY created_at, resume_id) AS place FROM ({RESUMES_SQL}) WHERE workspace_id = 'w7'")
def store_listing(spark, d):
    """One workspace's résumés by creation, then key."""
    listed = _resumes(spark, d).list("resumes", "w7").select("resume_id", "name").collect()  # one workspace
    return spark.createDataFrame([(r["resume_id"], r["name"], i + 1) for i, r in enumerate(listed)], "resume_id string, name string, place long")


@query("""
    WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 3)
    SELECT CAST(vec_id AS VARCHAR) AS embedding_id, round(list_cosine_similarity(embedding::DOUBLE[], q.q), 6) AS similarity FROM embeddings, q
    WHERE vec_id % 2 = 0 AND vec_id % 3 <> 1 ORDER BY list_cosine_similarity(embedding::DOUBLE[], q.q) DESC, CAST(vec_id AS VARCHAR) LIMIT 12""")
def store_search(spark, d):
    """The vectors nearest to one, of one model and owner type."""
    e = table(spark, d, "embeddings")
    store = Store(spark, _place(spark, "store"))
    vector = F.transform("embedding", lambda x: x.cast("double"))
    model, owner = F.when(F.col("vec_id") % 2 == 0, "even/1").otherwise("odd/1"), F.when(F.col("vec_id") % 3 == 1, "job").otherwise("resume")
    store.save("embeddings", e.select(F.col("vec_id").cast("string").alias("embedding_id"), F.lit("w").alias("workspace_id"), owner.alias("owner_type"), model.alias("embedding_model"), F.size("embedding").alias("dim"), vector.alias("vector")))
    asked = [float(x) for x in e.where("vec_id = 3").select("embedding").first()[0]]
    return store.search(asked, model="even/1", workspace_id="w", owner_type="resume", top_k=12).select("embedding_id", F.round("similarity", 6).alias("similarity"))


@query("""
    SELECT 'job' || user_id AS jd_slug, event_type AS tier, 'm' || event_id % 3 AS method, CAST(event_id AS INTEGER) AS repeat, round(value, 4) AS score, CASE WHEN event_id % 7 <> 0 THEN CAST(event_id % 100 AS INTEGER) END AS tokens,
           round(value, 4) AS elapsed_s, CASE WHEN event_id % 11 = 0 THEN 'a, "quoted" error' END AS error FROM events""")
def study_csv(spark, d):
    """Scores written as CSV and read again."""
    i = F.col("event_id")
    rows = table(spark, d, "events").select(F.concat(F.lit("job"), F.col("user_id").cast("string")).alias("jd_slug"), F.col("event_type").alias("tier"), F.concat(F.lit("m"), (i % 3).cast("string")).alias("method"), i.cast("int").alias("repeat"), F.col("value").alias("score"), F.when(i % 7 != 0, (i % 100).cast("int")).alias("tokens"), F.col("value").alias("elapsed_s"), F.when(i % 11 == 0, 'a, "quoted" error').alias("error"))
    path = _place(spark, "scores")
    study.write_scores(rows, path)
    return study.read_scores(spark, path)


@query("""
    SELECT 'leaf' || doc_id % 5 AS leaf, md5(CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || '…' ELSE text END) AS preview, doc_id % 3 <> 0 AS ok, round_even(n_chars / 1000.0, 3) AS elapsed_s, CASE WHEN doc_id % 4 <> 0 THEN n_chars END AS tokens,
           CASE WHEN doc_id % 3 = 0 THEN 'failed' END AS error FROM documents""")
def telemetry_entries(spark, d):
    """Telemetry with previews of prompts, appended as lines of JSON and read again."""
    i = F.col("doc_id")
    calls = table(spark, d, "documents").select(F.concat(F.lit("leaf"), (i % 5).cast("string")).alias("leaf"), F.col("text").alias("prompt"), (i % 3 != 0).alias("ok"), (F.col("n_chars") / 1000).alias("elapsed_s"), F.when(i % 4 != 0, F.col("n_chars")).alias("tokens"), F.when(i % 3 == 0, "failed").alias("error"))
    path = _place(spark, "telemetry")
    write_entries(entries(calls), path)
    got = spark.read.schema("leaf string, prompt string, ok boolean, elapsed_s double, tokens long, error string").json(path)
    return got.select("leaf", F.md5("prompt").alias("preview"), "ok", "elapsed_s", "tokens", "error")


# ------------------------------------------------------------------ rows, dates, sections


@query("SELECT CAST(l_orderkey AS VARCHAR) AS candidate_id, CAST(count(*) - count(*) // 3 AS INTEGER) AS n_left FROM lineitem GROUP BY l_orderkey")
def editor_round_trip(spark, d):
    """Positions as rows, of which every third is blanked, and as arrays again."""
    rows = to_rows(pool.candidates(spark, d), "career_history")
    blank = F.col("pos") % 3 == 2
    edited = rows.withColumns({c: F.when(blank, F.lit(" ")).otherwise(F.col(c)) for c in ("company", "title")})
    return from_rows(edited, "career_history", named=("company", "title")).select("candidate_id", F.size("career_history").alias("n_left"))


@query("""
    WITH l AS (SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS months, sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity ROWS UNBOUNDED PRECEDING) AS back,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) - 1 AS place FROM lineitem)
    SELECT l_orderkey, place, CAST(months AS INTEGER) AS months, strftime(DATE '2026-06-06' - INTERVAL 1 MONTH * back, '%Y-%m-%d') AS start_date, CASE WHEN place > 0 THEN strftime(DATE '2026-06-06' - INTERVAL 1 MONTH * (back - months), '%Y-%m-%d') END AS end_date FROM l""")
def dated_positions(spark, d):
    """Positions dated backwards, each ending where the one before begins."""
    line = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("months")))).alias("all"))
    entry = lambda x, i: F.struct(F.lit("t").alias("title"), F.lit("c").alias("company"), x["months"].alias("months"), (i == 0).alias("is_current"), F.lit("").alias("description"))
    placed = line.select("l_orderkey", F.posexplode(study.dated_entries(F.transform("all", entry), F.to_date(F.lit("2026-06-06")))).alias("place", "e"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return placed.select("l_orderkey", F.col("place").cast("long").alias("place"), F.col("e.months").alias("months"), day(F.col("e.start_date")).alias("start_date"), day(F.col("e.end_date")).alias("end_date"))


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN NULL WHEN 3 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def lenient_dates(spark, d):
    """Dates in texts: padded or not, with a time behind them, or none at all."""
    k, day = F.col("o_orderkey") % 5, F.col("o_orderdate")
    told = F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "yyyy-M-d")).when(k == 2, F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss")).when(k == 3, F.lit("2020-13-45"))
    return table(spark, d, "orders").select("o_orderkey", F.date_format(dates.parse_date(told), "yyyy-MM-dd").alias("day"))


@query("""
    WITH t AS (SELECT s_suppkey, 'Some title' || chr(10) || '- before' || chr(10) || CASE s_suppkey % 3 WHEN 0 THEN 'What you will do:' WHEN 1 THEN 'Requirements' ELSE 'Where you work' END || chr(10) || '- ' || repeat(s_name || ' ', 12) AS text, '- ' || rtrim(repeat(s_name || ' ', 12)) AS body FROM supplier)
    SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 2 THEN rtrim(text) ELSE 'Some title' || chr(10) || chr(10) || body END AS shown FROM t""")
def snippets(spark, d):
    """The head of a text and two of its sections, or the whole if that is short."""
    header = F.when(F.col("s_suppkey") % 3 == 0, "What you will do:").when(F.col("s_suppkey") % 3 == 1, "Requirements").otherwise("Where you work")
    rows = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("Some title\n- before\n"), header, F.lit("\n- "), F.repeat(F.concat("s_name", F.lit(" ")), F.lit(12))).alias("text"))
    return sections.with_sections(rows).select("s_suppkey", sections.snippet("text", "responsibilities", "qualifications", head=10).alias("shown"))


@query("SELECT s_suppkey, s_name || chr(10) || 'Second  line' || chr(10) || 'new ' || s_suppkey AS merged FROM supplier")
def merged_readings(spark, d):
    """Lines of three readings of a page, each once."""
    name = F.col("s_name")
    passes = F.array(F.concat(name, F.lit("\nSecond  line\n \n")), F.concat(F.lit("second line \n"), F.upper(name)), F.concat(F.lit("new "), F.col("s_suppkey").cast("string"), F.lit("\nSECOND LINE")))
    return table(spark, d, "supplier").select("s_suppkey", sections.merge_lines(passes).alias("merged"))


@query("SELECT c_custkey, c_mktsegment <> 'BUILDING' AS ranked, CASE WHEN c_mktsegment <> 'BUILDING' THEN round(c_acctbal, 2) END AS score FROM customer")
def ranked_and_failed(spark, d):
    """Outcomes split into those that are ok and the others."""
    rows = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", F.when(F.col("c_custkey") % 2 == 0, "invalid")).otherwise("ok").alias("status"), F.round("c_acctbal", 2).alias("score"))
    ok, failed = ranking.split_status(rows)
    return ok.select("c_custkey", F.lit(True).alias("ranked"), "score").union(failed.select("c_custkey", F.lit(False), F.lit(None).cast("double")))


# ------------------------------------------------------------------ blocks of role profiles, patterns, models


@query(r"""
    SELECT p_partkey, replace(p_brand, '#', '#') || '\(' || p_size || '\)|' || p_name || '\.' AS pattern, true AS found FROM part""")
def term_patterns(spark, d):
    """A pattern of literal terms with signs in them; blank terms are left out."""
    terms = F.array(F.concat("p_brand", F.lit("("), F.col("p_size").cast("string"), F.lit(")")), F.lit(""), F.concat("p_name", F.lit(".")))
    rows = table(spark, d, "part").select("p_partkey", text.any_of(terms).alias("pattern"), F.concat(F.lit("see "), "p_name", F.lit(". here")).alias("t"))
    return rows.select("p_partkey", "pattern", F.regexp("t", "pattern").alias("found"))


@query("""
    WITH n AS (SELECT n_nationkey AS k, n_name, trim(regexp_replace(lower(n_name), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM nation)
    SELECT k AS n_nationkey, slug || ', ' || slug || '_2, own, signal_9' AS ids, '0.0, 0.1, 0.7, 0.1' AS weights, CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END || ', false, false, true' AS flags,
           CASE WHEN k % 3 = 0 THEN n_name ELSE 'First line' END AS title, CASE WHEN k % 5 = 0 THEN 1.0 ELSE 2.5 END::DOUBLE AS sigma,
           'No summary. — a strong fit demonstrates ' || n_name || ', ' || n_name || ', L, signal 9, with relevant hands-on experience around general.' AS query, 'own' AS heaviest, k % 2 = 0 AS enforced FROM n""")
def role_blocks(spark, d):
    """Loose answers about a role into its blocks: identifiers, weights, flags, defaults, the query and what is wanted most."""
    k, name = F.col("n_nationkey"), F.col("n_name")
    part = lambda *c: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in c))
    signals = part('[{"label": "', name, '", "dense_weight": -1}, {"label": "', name, '", "query": "q"}, {"id": "own", "label": "L", "dense_weight": 0.7}, "none", {"label": "signal 9", "dense_weight": "heavy"}]')
    flags = part('{"cv_primary": {"enabled": ', F.when(k % 2 == 0, "true").otherwise("false"), '}, "job_hopper": false, "other": true}')
    role = part('{"title": "', F.when(k % 3 == 0, name).otherwise(""), '", "ideal_experience": {"sigma_years": ', F.when(k % 5 == 0, "0.2").otherwise('"?"'), "}}")
    v = F.parse_json(part('{"signals": ', signals, ', "red_flags": ', flags, ', "role": ', role, "}"))
    rows = table(spark, d, "nation").select("n_nationkey", v.alias("v"))
    made = rows.select("n_nationkey", coerce.signal_list(F.col("v")).alias("s"), coerce.red_flags(F.col("v")).alias("f"), coerce.role_block(F.col("v"), F.lit("\nFirst line\nmore")).alias("r"))
    joined = lambda c, f: F.array_join(F.transform(c, f), ", ")
    out_terms = F.array(F.when(k % 2 == 0, "sales").otherwise("care"))
    meta = coerce.meta_of(F.col("s"), F.array(F.lit("No Sales people")), out_terms)
    return made.select(
        "n_nationkey", joined("s", lambda s: s["id"]).alias("ids"), joined("s", lambda s: s["dense_weight"].cast("string")).alias("weights"),
        F.concat_ws(", ", *(F.col(f"f.{x}.enabled").cast("string") for x in ("cv_primary", "job_hopper", "only_consulting", "stale_ic_role"))).alias("flags"),
        F.col("r.title").alias("title"), F.col("r.ideal_experience.sigma_years").alias("sigma"), coerce.cross_query(F.col("r"), F.col("s")).alias("query"),
        F.get(meta["wanted"]["must"], F.lit(0))["id"].alias("heaviest"), F.get(meta["exclusions"], F.lit(0))["enforced"].alias("enforced"),
    )


@query("""
    WITH h AS (SELECT p_partkey, list_transform(range(32), lambda i: list_sum(list_transform(range(8), lambda j: (instr('0123456789abcdef', substr(sha256(i || ':' || p_name || p_partkey), j + 1, 1)) - 1) * pow(16, 7 - j))) / 2147483648 - 1) AS v FROM part)
    SELECT p_partkey, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first, CAST(len(v) AS INTEGER) AS dim FROM h""")
def digest_vectors(spark, d):
    """Vectors that depend on nothing but a text's digest."""
    rows = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.col("p_partkey").cast("string")).alias("text"))
    return embed_texts(rows, DigestEmbedding()).select("p_partkey", F.round(F.get("vector", F.lit(0)), 6).alias("first"), F.size("vector").alias("dim"))


JUDGED_SQL = f"'{RUBRIC}' || chr(10) || chr(10) || 'JOB' || chr(10) || p_type || chr(10) || chr(10) || 'CANDIDATE' || chr(10) || CASE p_partkey % 3 WHEN 0 THEN 'Designed, redesigned and led ' WHEN 1 THEN 'Helped with ' ELSE 'Filing clerk for ' END || p_name"


@query(f"""
    WITH p AS (SELECT p_partkey, {JUDGED_SQL} AS prompt FROM part),
    s AS (SELECT p_partkey, prompt, sha256(prompt) AS h, 50 + 8 * list_sum(list_transform(['led', 'designed', 'architected', 'from scratch', 'years of experience'], lambda w: (length(prompt) - length(replace(lower(prompt), w, ''))) // length(w)))
                 - 10 * list_sum(list_transform(['clerk', 'filing', 'scheduling', 'helped with'], lambda w: (length(prompt) - length(replace(lower(prompt), w, ''))) // length(w))) AS base FROM p),
    j AS (SELECT *, list_sum(list_transform(range(64), lambda i: (instr('0123456789abcdef', substr(h, i + 1, 1)) - 1) * [1, 2, 4][(63 - i) % 3 + 1])) % 7 - 3 AS jitter FROM s)
    SELECT 'job' || p_partkey AS jd_slug, CAST(greatest(0, least(100, greatest(5, least(95, base)) + jitter)) AS DOUBLE) AS score, CAST(length(prompt) // 4 + 40 AS INTEGER) AS tokens, CAST(NULL AS VARCHAR) AS error FROM j""")
def judged_pairs(spark, d):
    """The offline judge's scores: words for and against, and a jitter that depends on the prompt alone."""
    did = F.when(F.col("p_partkey") % 3 == 0, "Designed, redesigned and led ").when(F.col("p_partkey") % 3 == 1, "Helped with ").otherwise("Filing clerk for ")
    pairs: DataFrame = table(spark, d, "part").select(F.concat(F.lit("job"), F.col("p_partkey").cast("string")).alias("jd_slug"), F.lit("t").alias("tier"), F.lit(0).alias("repeat"), F.col("p_type").alias("jd_text"), F.concat(did, "p_name").alias("resume_text"))
    return judge(pairs, MockJudge(), RUBRIC, "rubric").select("jd_slug", "score", "tokens", "error")
