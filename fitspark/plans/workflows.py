"""Queries that run sources, compilation, coercion and stream twins on the driver's tables."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitspark.backends import MockBackend, MockJudge, RateLimitError, TransientBackendError, ask
from fitspark.cluster import shared_dir, spread
from fitspark.config import role_of
from fitspark.embedding import HashEmbedding, TermEmbedding
from fitspark.functions import arrays, jsonx, text
from fitspark.functions.register import register
from fitspark.operators import coerce, matching, metrics, quantiles
from fitspark.operators import ranking as rank
from fitspark.operators.score import score_candidates
from fitspark.plans import candidates as pool
from fitspark.plans.catalog import query, table
from fitspark.plans.compile import compile_candidates
from fitspark.plans.session import fit_candidates, parse_resumes, run_study
from fitspark.sources import documents, sections, study
from fitspark.streaming import events


def write_table(df: DataFrame, label: str) -> DataFrame:
    """A table in the folder that all machines share."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fitspark/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


STAMP = "yyyy-MM-dd HH:mm:ss"


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 3) AS value FROM events GROUP BY ALL")
def event_windows(spark, d):
    w = events.windowed(table(spark, d, "events"), width="1 day")
    return w.select(F.date_format("window_start", STAMP).alias("window_start"), "event_type", "n", F.round("value", 3).alias("value"))


@query("""
    WITH g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR AS new FROM events),
    s AS (SELECT *, sum(CASE WHEN new IS NULL OR new THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
    SELECT user_id, strftime(date_trunc('second', min(ts)), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM s GROUP BY user_id, s""")
def event_sessions(spark, d):
    s = events.sessions(table(spark, d, "events"), gap="6 hours")
    return s.select("user_id", F.date_format("session_start", STAMP).alias("session_start"), "n")


@query("""SELECT p_partkey, CAST(CASE WHEN p_size % 3 = 0 THEN least(180, p_size * 5) WHEN p_size % 3 = 1 THEN least(180, p_size * 30) ELSE NULL END AS INTEGER) AS days,
          CASE WHEN p_size % 2 = 0 THEN p_size / 2.0 END::DOUBLE AS years FROM part""")
def stated_numbers(spark, d):
    size = F.col("p_size").cast("string")
    told = F.when(F.col("p_size") % 3 == 0, F.concat((F.col("p_size") * 5).cast("string"), F.lit(" days notice"))).when(F.col("p_size") % 3 == 1, F.concat(size, F.lit(" Months  notice"))).otherwise("notice unknown")
    years = F.when(F.col("p_size") % 2 == 0, F.concat((F.col("p_size") / 2).cast("string"), F.lit(" years of hands-on experience"))).otherwise("no years")
    return table(spark, d, "part").select("p_partkey", text.notice_days(told).alias("days"), text.years_claimed(years).alias("years"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN CAST(c_nationkey AS VARCHAR) WHEN 1 THEN CAST(c_nationkey AS VARCHAR) WHEN 2 THEN '}' ELSE NULL END AS member FROM customer""")
def tolerant_json(spark, d):
    n = F.col("c_nationkey").cast("string")
    k = F.col("c_custkey") % 4
    answer = F.when(k == 0, F.concat(F.lit('{"a": '), n, F.lit("}"))).when(k == 1, F.concat(F.lit('Well:\n```json\n{"a": '), n, F.lit("}\n```"))).when(k == 2, F.lit('take {"a": "}"} then')).otherwise("nothing")
    return table(spark, d, "customer").select("c_custkey", jsonx.member(jsonx.tolerant_json(answer), "a").alias("member"))


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'responsibilities' WHEN 1 THEN 'qualifications' ELSE 'location' END AS section, '- ' || s_name AS body FROM supplier""")
def section_split(spark, d):
    header = F.when(F.col("s_suppkey") % 3 == 0, "What you will do:").when(F.col("s_suppkey") % 3 == 1, "Requirements").otherwise("Where you work")
    rows = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("Some title\n- before\n"), header, F.lit("\n- "), F.col("s_name"), F.lit("\n\nNothing known\n- after")).alias("text"))
    return sections.with_sections(rows).select("s_suppkey", F.explode("sections").alias("section", "body"))


@query("""SELECT o_orderkey, least(50, greatest(0, o_totalprice / 10000)) AS years, CAST(least(180, greatest(0, o_custkey % 400)) AS INTEGER) AS notice, CASE o_orderstatus WHEN 'F' THEN 'remote' ELSE 'flexible' END AS mode, o_orderstatus <> 'P' AS moves,
           CAST(greatest(0, o_custkey % 50 - 10) AS DOUBLE) AS pay_from, CAST(greatest(0, o_custkey % 50 - 10, o_custkey % 30) AS DOUBLE) AS pay_to, CASE WHEN o_custkey % 2 = 0 THEN 40 ELSE -1 END::DOUBLE AS github, '2025-06-06' AS signup, o_custkey % 3 = 0 AS mailed, 'India' AS country FROM orders""")
def coerced_blocks(spark, d):
    o = table(spark, d, "orders")
    raw = F.struct(
        F.struct((F.col("o_totalprice") / 10000).alias("years_of_experience")).alias("profile"),
        F.struct((F.col("o_custkey") % 400).alias("notice_period_days"), F.when(F.col("o_orderstatus") == "F", "remote").otherwise("Remote").alias("preferred_work_mode"), (F.col("o_orderstatus") != "P").alias("willing_to_relocate"), F.struct((F.col("o_custkey") % 50 - 10).alias("min"), (F.col("o_custkey") % 30).alias("max")).alias("expected_salary_range"), (F.col("o_custkey") % 3 == 0).alias("verified_email"), F.lit(9).alias("connection_count")).alias("signals"),
    )
    source = F.when(F.col("o_custkey") % 2 == 0, "see GitHub.com/me").otherwise("5 days notice")
    v = o.select("o_orderkey", F.parse_json(F.to_json(raw)).alias("v"), source.alias("source"))
    ref = F.to_date(F.lit("2026-06-06"))
    made = v.select("o_orderkey", coerce.profile(F.col("v")).alias("p"), coerce.signals(F.col("v"), F.col("source"), ref).alias("s"))
    return made.select("o_orderkey", F.col("p.years_of_experience").alias("years"), F.col("s.notice_period_days").alias("notice"), F.col("s.preferred_work_mode").alias("mode"), F.col("s.willing_to_relocate").alias("moves"), F.col("s.expected_salary_range.min").alias("pay_from"), F.col("s.expected_salary_range.max").alias("pay_to"), F.col("s.github_activity_score").alias("github"), F.col("s.signup_date").alias("signup"), F.col("s.verified_email").alias("mailed"), F.col("p.country").alias("country"))


@query("SELECT n_nationkey, n_name AS must, CAST(n_nationkey % 5 AS INTEGER) AS nice FROM nation")
def heaviest_signals(spark, d):
    w = lambda k: F.struct(F.lit(k).alias("weight"), F.lit(k).alias("pos"), F.col("n_name").alias("name"))
    n = table(spark, d, "nation").withColumn("all", F.concat(F.array(*(w(k) for k in range(4))), F.array_repeat(w(0), (F.col("n_nationkey") % 5).cast("int"))))
    split = n.select("n_nationkey", rank.heaviest(F.col("all"), 4).alias("h"))
    return split.select("n_nationkey", F.get("h.must", F.lit(0))["name"].alias("must"), F.size("h.nice").alias("nice"))


@query(r"""
    WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://boards.greenhouse.io/acme/jobs/' || page_id WHEN 1 THEN 'https://x.myworkdayjobs.com/en/job/' || page_id ELSE url END AS url, CASE WHEN page_id % 3 = 0 THEN 'page ' || page_id END AS told FROM pages)
    SELECT page_id, CASE WHEN regexp_matches(url, 'greenhouse[.]io/[^?#]') THEN 'greenhouse' WHEN regexp_matches(url, 'myworkdayjobs[.]com/[^?#]') THEN 'workday' ELSE 'page' END AS board,
           CASE WHEN told IS NULL THEN 'html' ELSE 'json-ld' END AS method, told FROM p""")
def job_pages(spark, d):
    """Every page; some have a board's address, and every third one posting data in JSON-LD before its HTML."""
    i = F.col("page_id")
    url = F.when(i % 5 == 0, F.concat(F.lit("https://boards.greenhouse.io/acme/jobs/"), i.cast("string"))).when(i % 5 == 1, F.concat(F.lit("https://x.myworkdayjobs.com/en/job/"), i.cast("string"))).otherwise(F.col("url"))
    data = F.concat(F.lit('<script type="application/ld+json">{"@type": "JobPosting", "description": "<p>page '), i.cast("string"), F.lit('</p>"}</script>'))
    pages = table(spark, d, "pages").select("page_id", url.alias("url"), F.when(i % 3 == 0, F.concat(data, F.col("html"))).otherwise(F.col("html")).alias("html"))
    got = documents.posting_texts(documents.routed(pages))
    return got.select("page_id", "board", "method", F.when(F.col("method") == "json-ld", F.col("text")).alias("told"))


@query("""
    WITH f AS (SELECT doc_id, doc_id // 3 AS jd, ['strong', 'borderline', 'weak'][doc_id % 3 + 1] AS tier FROM documents)
    SELECT 'job' || jd AS jd_slug, tier, '/data/job' || jd || '_' || tier || CASE WHEN doc_id % 2 = 0 THEN '/single_column' ELSE '' END || '/resume.txt' AS resume_path
    FROM f WHERE jd % 7 <> 0 AND jd % 11 <> 0 AND (doc_id % 2 = 0 OR doc_id % 5 <> 0)""")
def dataset_discovery(spark, d):
    """A listing of files with one résumé for each document, in a folder of its own, in a layout's folder below it, in both or in none."""
    docs = table(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 3).alias("jd"))
    tier = F.element_at(F.array(*(F.lit(t) for t in ("strong", "borderline", "weak"))), (F.col("doc_id") % 3 + 1).cast("int"))
    folder = F.concat(F.lit("job"), F.col("jd").cast("string"), F.lit("_"), tier)
    base = docs.withColumn("name", folder)
    flat = base.where("doc_id % 5 != 0").select(F.concat(F.lit("/data/"), "name", F.lit("/resume.txt")).alias("path"), F.col("name").alias("folder"), F.lit("data").alias("parent"))
    laid = base.where("doc_id % 2 = 0").select(F.concat(F.lit("/data/"), "name", F.lit("/single_column/resume.txt")).alias("path"), F.lit("single_column").alias("folder"), F.col("name").alias("parent"))
    jobs = docs.select("jd", F.concat(F.lit("job"), F.col("jd").cast("string")).alias("folder")).distinct()
    return study.pair_files(flat.union(laid), jobs.where("jd % 7 != 0"), jobs.where("jd % 11 != 0"))


@query("SELECT n_nationkey, n_nationkey % 2 = 0 AS same_flags, CAST(n_nationkey % 3 AS BIGINT) AS signal_count_delta FROM nation")
def profile_parity(spark, d):
    """Two versions of a role profile for each nation, summarised and compared as columns."""
    base = pool.ROLE.raw
    k = F.col("n_nationkey")
    signals = F.lit(json.dumps(base["signals"])[1:-1])
    extra = F.array_join(F.transform(F.sequence(F.lit(1), (k % 3).cast("int")), lambda i: F.concat(F.lit(', {"id": "x'), i.cast("string"), F.lit('", "dense_weight": 0.1}'))), "")
    profile = lambda more, flags: F.parse_json(F.concat(F.lit('{"signals": ['), signals, more, F.lit('], "red_flags": '), flags, F.lit("}")))
    flags = F.lit(json.dumps(base["red_flags"]))
    second = profile(F.when(k % 3 > 0, extra).otherwise(""), F.when(k % 2 == 0, flags).otherwise("{}"))
    both = table(spark, d, "nation").select("n_nationkey", matching.parity_of(matching.structural_of(profile(F.lit(""), flags)), matching.structural_of(second)).alias("p"))
    return both.select("n_nationkey", "p.same_flags", "p.signal_count_delta")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'role.title' ELSE '' END AS path, CASE WHEN c_custkey % 2 = 0 THEN 'role' ELSE '' END AS top FROM customer")
def named_fields(spark, d):
    message = F.when(F.col("c_custkey") % 2 == 0, "field 'role.title': empty").otherwise("something else")
    f = table(spark, d, "customer").select("c_custkey", matching.field_of(message).alias("f"))
    return f.select("c_custkey", F.coalesce("f.path", F.lit("")).alias("path"), F.coalesce("f.top", F.lit("")).alias("top"))


class StatedBackend(MockBackend):
    """Answers about texts that name a field and a number, with what coercion has to mend."""

    def generate(self, prompt: str, system: str | None = None, temperature: float = 0.2, max_tokens: int = 2048) -> str:
        found = re.search(r"works in (\w+), number (\d+)", prompt)
        if not found:
            return "nothing known"
        name, k = found[1], int(found[2])
        part = next((p for p in ("career_history", "education", "skills") if f'{{"{p}":' in prompt), "")
        old = {"title": name, "company": "F", "start_date": f"{2000 + k % 10}-{1 + k % 12}-5", "end_date": f"{2001 + k % 10}-{1 + k % 12:02d}-05"}
        answers = {
            "career_history": [old, {"title": "Lead", "start_date": "2021-02-01", "end_date": "Present", "company_size": "huge"}] * (1 + k % 7),
            "education": [{"institution": "U", "start_year": 1900 + k % 200, "end_year": f"{1899 + k % 200}"}] * (k % 8),
            "skills": [{"name": name, "proficiency": "expert" if k % 2 == 0 else "EXPERT", "endorsements": k % 4 + 0.5}, {"name": name.lower()}, {"name": ""}, {"name": "Go", "duration_months": k}],
        }
        return f"Here:\n```json\n{json.dumps({part: answers[part]} if part else {})}\n```"


@query("""
    SELECT CAST(c_custkey AS VARCHAR) AS resume_id, CAST(least(10, 2 * (1 + c_custkey % 7)) AS INTEGER) AS n_jobs, c_mktsegment AS title, strftime(make_date((2000 + c_custkey % 10)::INTEGER, (1 + c_custkey % 12)::INTEGER, 5), '%Y-%m-%d') AS start_date, 12 AS months,
           true AS goes_on, 64 AS months_so_far, 'Lead at Unknown Company.' AS description, CAST(least(5, c_custkey % 8) AS INTEGER) AS n_degrees,
           CASE WHEN c_custkey % 8 > 0 THEN CAST(least(2030, greatest(1970, 1900 + c_custkey % 200)) AS INTEGER) END AS start_year,
           CASE WHEN c_custkey % 8 > 0 THEN CAST(greatest(least(2030, greatest(1970, 1900 + c_custkey % 200)), least(2035, greatest(1970, 1899 + c_custkey % 200))) AS INTEGER) END AS end_year,
           c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN ':expert:' ELSE ':intermediate:' END || CAST(round_even(c_custkey % 4 + 0.5, 0) AS INTEGER) || ', Go:intermediate:0' AS skills, CAST(c_custkey AS INTEGER) AS skill_months, CAST(c_custkey % 5 * 15 AS INTEGER) AS notice, 0 AS n_violations, 'profile, signals' AS defaulted, CAST(5 AS INTEGER) AS n_calls
    FROM customer""")
def compiled_candidates(spark, d):
    """Texts compiled by a model whose answers need coercion: every row satisfies every rule."""
    k = F.col("c_custkey").cast("string")
    customers = spread(table(spark, d, "customer").select("c_custkey", "c_mktsegment"))
    texts = customers.select(k.alias("resume_id"), F.concat(F.lit("Someone works in "), F.col("c_mktsegment"), F.lit(", number "), k, F.lit(". "), (F.col("c_custkey") % 5 * 15).cast("string"), F.lit(" days notice.")).alias("text"))
    got = compile_candidates(texts, StatedBackend(), write_table)
    job, lead, degree = F.get("career_history", F.lit(0)), F.get("career_history", F.lit(1)), F.get("education", F.lit(0))
    said = F.array_join(F.transform("skills", lambda x: F.concat_ws(":", x["name"], x["proficiency"], x["endorsements"].cast("string"))), ", ")
    return got.select(
        "resume_id", F.size("career_history").alias("n_jobs"), job["title"].alias("title"), job["start_date"].alias("start_date"), job["duration_months"].alias("months"),
        (lead["is_current"] & lead["end_date"].isNull() & (lead["company_size"] == "201-500")).alias("goes_on"), lead["duration_months"].alias("months_so_far"), lead["description"].alias("description"),
        F.size("education").alias("n_degrees"), degree["start_year"].alias("start_year"), degree["end_year"].alias("end_year"), said.alias("skills"), F.get("skills", F.lit(1))["duration_months"].alias("skill_months"),
        F.col("signals.notice_period_days").alias("notice"), F.size("violations").alias("n_violations"), F.array_join("defaulted", ", ").alias("defaulted"), F.size("calls").alias("n_calls"),
    )


class MendingBackend(StatedBackend):
    """Leaves out the skills of every third text until it is told what was wrong, and of every ninth even then."""

    def generate(self, prompt: str, system: str | None = None, temperature: float = 0.2, max_tokens: int = 2048) -> str:
        number = re.search(r"number (\d+)", prompt)
        k = int(number[1]) if number else 1
        if '{"skills":' in prompt and (k % 9 == 0 or k % 3 == 0 and "broke these rules: skills none" not in prompt):
            return '{"skills": "none"}'
        return super().generate(prompt, system, temperature, max_tokens)


def _numbered(spark, d: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    customers = spread(table(spark, d, "customer").select("c_custkey", "c_mktsegment"))
    return customers.select(k.alias("resume_id"), F.concat(F.lit("Someone works in "), F.col("c_mktsegment"), F.lit(", number "), k, F.lit(".")).alias("text"))


@query("""
    SELECT CAST(c_custkey AS VARCHAR) AS resume_id, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE c_mktsegment || ', Go' END AS skills, CAST(5 + CASE WHEN c_custkey % 9 = 0 THEN 3 WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n_calls,
           CASE WHEN c_custkey % 9 = 0 THEN 1 ELSE 0 END AS n_violations, CASE WHEN c_custkey % 9 = 0 THEN 'profile, signals, skills' ELSE 'profile, signals' END AS defaulted FROM customer""")
def mended_candidates(spark, d):
    """The control loop: parts that break a rule are asked for again with what was wrong, twice, and then given up."""
    none = F.array(F.struct(F.lit("skills").alias("path"), F.lit("none").alias("message")))
    rules = F.when(F.size("skills") == 0, none).otherwise(F.slice(none, 1, 0))
    got = compile_candidates(_numbered(spark, d), MendingBackend(), write_table, rules=rules)
    return got.select("resume_id", F.array_join(F.transform("skills", lambda x: x["name"]), ", ").alias("skills"), F.size("calls").alias("n_calls"), F.size("violations").alias("n_violations"), F.array_join(F.array_sort("defaulted"), ", ").alias("defaulted"))


class FailingBackend(StatedBackend):
    """Answers three of five texts; asks to wait for one, and fails for another. Of a third it gives all but the positions."""

    def generate(self, prompt: str, system: str | None = None, temperature: float = 0.2, max_tokens: int = 2048) -> str:
        number = re.search(r"number (\d+)", prompt)
        k = int(number[1]) % 5 if number else 0
        if k == 1:
            raise RateLimitError("429: wait")
        if k == 2:
            raise TransientBackendError("gave up")
        if k == 3 and '{"career_history":' in prompt:
            raise ValueError("cannot say")
        return super().generate(prompt, system, temperature, max_tokens)


@query("""
    SELECT CAST(c_custkey AS VARCHAR) AS resume_id, CASE c_custkey % 5 WHEN 1 THEN 'rate_limited' WHEN 2 THEN 'transient' WHEN 4 THEN 'invalid' ELSE 'ok' END AS status,
           CASE c_custkey % 5 WHEN 1 THEN 5 WHEN 2 THEN 5 WHEN 3 THEN 1 ELSE 0 END AS n_failed, CASE WHEN c_custkey % 5 = 4 THEN 'career_history' END AS broken, c_custkey % 5 IN (0, 3) AS scored FROM customer""")
def typed_outcomes(spark, d):
    """Sessions with each outcome: ok, invalid, and two ways in which the model failed. Only what is ok has a score."""
    parsed = parse_resumes(_numbered(spark, d), FailingBackend(), write_table)
    # A record that was edited into one without positions is invalid.
    edited = spread(parsed).withColumn("career_history", F.when(F.col("resume_id").cast("long") % 5 == 4, F.slice("career_history", 1, 0)).otherwise(F.col("career_history")))
    answered, failed = edited.where("status = 'ok'"), edited.where("status <> 'ok'")
    calls = F.size(F.filter("calls", lambda c: ~c["ok"])).alias("n_failed")
    fitted = fit_candidates(answered.drop("status", "violations").withColumn("n_failed", calls), pool.ROLE, TermEmbedding(("service", "sales", "led")), ref_date=pool.REF)
    done = fitted.select("resume_id", "status", "n_failed", F.get("violations", F.lit(0))["path"].alias("broken"), F.col("overall").isNotNull().alias("scored"))
    return done.unionByName(failed.select("resume_id", "status", calls, F.lit(None).cast("string").alias("broken"), F.lit(False).alias("scored")))


#: A general role for made-up résumés: who led and designed is preferred to who helped, and that to who filed.
STUDY_ROLE = role_of(
    {
        "role": {"title": "Any", "summary": "Work of one's own.", "ideal_experience": {"peak_years": 6.0, "sigma_years": 3.0}},
        "signals": [
            {"id": "leading", "label": "leading", "query": "designed and led work", "evidence_regex": "designed|led work", "dense_weight": 0.6},
            {"id": "helping", "label": "helping", "query": "helped with projects", "evidence_regex": "helped|designed", "dense_weight": 0.4},
        ],
        "domain": {"in_domain_terms": ["project"], "out_of_domain_terms": ["files"], "in_domain_regex": "work|helped", "out_of_domain_regex": "files and calendars"},
        "relevant_skill_regex": "brand",
    }
)


def made_resumes(spark, d: str) -> DataFrame:
    parts = spread(table(spark, d, "part").select("p_partkey", "p_type", "p_brand", "p_name"))
    jobs = parts.select(F.concat(F.lit("job"), F.col("p_partkey").cast("string")).alias("jd_slug"), F.col("p_type").alias("title"), F.array("p_brand", "p_name").alias("skills"), F.col("p_type").alias("jd_text"))
    return study.make_resumes(jobs)


@query("""
    WITH t(tier, title, notice, n_skills) AS (VALUES ('strong', '', 15, 2), ('borderline', 'Junior ', 60, 2), ('weak', 'Office Clerk', 120, 2))
    SELECT 'job' || p_partkey AS jd_slug, tier, CASE WHEN tier = 'weak' THEN title ELSE title || p_type END AS title, CAST(notice AS INTEGER) AS notice, CAST(n_skills AS INTEGER) AS n_skills, 1 AS n_jobs, true AS is_current,
           CASE tier WHEN 'strong' THEN 'Designed and led work with ' || p_brand || ', ' || p_name || '.' WHEN 'borderline' THEN 'Helped with ' || p_brand || ', ' || p_name || '.' ELSE 'Kept files and calendars.' END AS description, 'BSc' AS degree
    FROM part, t""")
def resume_fields(spark, d):
    """What made-up résumés state, read back from their text."""
    made = made_resumes(spark, d)
    c = study.candidates_of_resumes(made, ref=F.to_date(F.lit("2026-06-06")), key=F.concat_ws("|", "jd_slug", "tier"))
    job = F.get("career_history", F.lit(0))
    return c.select("jd_slug", "tier", job["title"].alias("title"), F.col("signals.notice_period_days").alias("notice"), F.size("skills").alias("n_skills"), F.size("career_history").alias("n_jobs"), job["is_current"].alias("is_current"), job["description"].alias("description"), F.get("education", F.lit(0))["degree"].alias("degree"))


@query()
def study_scores(spark, d):
    """Two judges and the formula on made-up résumés: the formula scores what the résumés state."""
    made = made_resumes(spark, d)
    stated = study.candidates_of_resumes(made.select("jd_slug", "tier", "text"), ref=F.to_date(F.lit("2026-06-06")), key=F.concat_ws("|", "jd_slug", "tier"))
    engine = score_candidates(stated, STUDY_ROLE, HashEmbedding()).select("jd_slug", "tier", F.col("overall").alias("score"))
    return run_study(made.withColumnRenamed("text", "resume_text"), engine, MockJudge(), repeats=2).select("jd_slug", "tier", "method", "repeat", "score", "tokens", "error")


@query("""
    SELECT page_id, CASE page_id % 4 WHEN 0 THEN '# Job ' || page_id || chr(10) || '_Location: Town_' || chr(10) || chr(10) || 'Work & play'
      WHEN 1 THEN '# Job ' || page_id || chr(10) || '_Location: Town_' || chr(10) || chr(10) || 'Build' || chr(10) || chr(10) || '- fast'
      WHEN 2 THEN '# Job ' || page_id || chr(10) || '_Location: _' || chr(10) || chr(10) || chr(10) || '## Description' || chr(10) || 'Ship' || chr(10) || chr(10) || '## Preferred Qualifications' || chr(10) || 'Care'
      ELSE '# Job ' || page_id || chr(10) || chr(10) || chr(10) || '## Responsibilities' || chr(10) || 'Lead' || chr(10) || chr(10) || '## Description' || chr(10) || 'Do' END AS text,
      CASE page_id % 4 WHEN 0 THEN 'https://boards-api.greenhouse.io/v1/boards/acme/jobs/' || page_id || '?content=true' WHEN 1 THEN 'https://acme.wd1.myworkdayjobs.com/wday/cxs/acme/site/job/x/' || page_id
      WHEN 2 THEN 'https://www.amazon.jobs/en/jobs/' || page_id || '.json' ELSE 'https://careers.google.com/api/v3/jobs/' || page_id || '/' END AS api
    FROM pages""")
def board_postings(spark, d):
    """Answers of four boards, one for each page, as text; and where the boards give them."""
    i = F.col("page_id").cast("string")
    k = F.col("page_id") % 4
    q = lambda t: F.concat(F.lit('{"title": "Job '), i, F.lit(f'", {t}}}'))
    body = F.when(k == 0, q('"location": {"name": "Town"}, "content": "<p>Work &amp; play</p>"')).when(k == 1, F.concat(F.lit('{"jobPostingInfo": '), q('"location": "Town", "jobDescription": "<p>Build</p><ul><li>fast</li></ul>"'), F.lit("}"))).when(k == 2, q('"description": "<b>Ship</b>", "basic_qualifications": "", "preferred_qualifications": "Care"')).otherwise(F.concat(F.lit('{"job": '), q('"description": "Do", "responsibilities": "<p>Lead</p>"'), F.lit("}")))
    url = F.when(k == 0, F.concat(F.lit("https://boards.greenhouse.io/acme/jobs/"), i)).when(k == 1, F.concat(F.lit("https://acme.wd1.myworkdayjobs.com/en/site/job/x/"), i)).when(k == 2, F.concat(F.lit("https://www.amazon.jobs/en/jobs/"), i)).otherwise(F.concat(F.lit("https://www.google.com/about/careers/applications/jobs/results/"), i))
    pages = documents.routed(table(spark, d, "pages").select("page_id", url.alias("url"), body.alias("body")))
    return pages.select("page_id", documents.board_posting(F.col("board"), F.col("body")).alias("text"), documents.board_url(F.col("board"), F.col("url")).alias("api"))


@query("""
    WITH e AS (SELECT *, 'w' || user_id % 40 AS workspace_id FROM events)
    SELECT workspace_id, count(*) FILTER (WHERE event_type = 'purchase') AS n_fit_runs, count(*) FILTER (WHERE event_type = 'click') AS n_resumes, count(*) FILTER (WHERE event_type = 'view') AS n_profiles,
           count(*) FILTER (WHERE event_type = 'error') AS n_corrections, round(avg(value) FILTER (WHERE event_type = 'purchase'), 6) AS mean_overall
    FROM e WHERE event_type IN ('purchase', 'click', 'view', 'error') GROUP BY workspace_id""")
def session_metrics(spark, d):
    e = table(spark, d, "events").select("event_type", F.concat(F.lit("w"), (F.col("user_id") % 40).cast("string")).alias("workspace_id"), F.col("value").alias("overall"))
    of = lambda kind: e.where(F.col("event_type") == kind)
    return metrics.session(of("purchase"), of("click"), of("view"), of("error")).withColumn("mean_overall", F.round("mean_overall", 6))


@query("""
    SELECT o_orderstatus AS status, o_orderpriority AS priority, CAST(grouping_id(o_orderstatus, o_orderpriority) AS BIGINT) AS level, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DECIMAL(28, 2)) AS total,
           true AS distinct_is_close, round(quantile_cont(o_totalprice, 0.5), 4) AS median
    FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def order_cube(spark, d):
    """All groupings of two columns; the approximate number of customers is within a tenth of the exact one."""
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), "o_custkey", "o_totalprice")
    by = ["status", "priority"]
    # One aggregation would key the sketches and values by customer, too, and end in a task for all rows.
    sums = o.cube(*by).agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"), F.approx_count_distinct("o_custkey", 0.02).alias("near"))
    customers = o.where("o_custkey is not null").select(*by, "o_custkey").distinct().select("o_custkey", F.inline(quantiles.groupings(by)))
    exact = customers.distinct().groupBy("level", *by).agg(F.count(F.lit(1)).alias("exact"))
    median = quantiles.cube_quantile(o, by=by, value="o_totalprice", p=0.5)
    out = sums
    for more in (exact, median):
        out = out.alias("o").join(more.alias("m"), (F.col("o.level") == F.col("m.level")) & F.col("o.status").eqNullSafe(F.col("m.status")) & F.col("o.priority").eqNullSafe(F.col("m.priority")), "left").select("o.*", *(f"m.{c}" for c in more.columns if c not in ("level", *by)))
    count = F.coalesce("exact", F.lit(0))
    return out.select(*by, "level", "n", "total", (F.abs(F.col("near") - count) <= 0.1 * count + 2).alias("distinct_is_close"), F.round("quantile", 4).alias("median"))


@query("""
    SELECT l_returnflag AS flag, l_linestatus AS status, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS level, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DECIMAL(28, 2)) AS quantity
    FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""")
def line_rollup(spark, d):
    g = table(spark, d, "lineitem").rollup(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))
    return g.agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("quantity"))


@query("""
    WITH u AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS v FROM embeddings), q AS (SELECT v AS q FROM u WHERE vec_id = 0)
    SELECT vec_id, round(list_dot_product(v, q), 6) AS similarity FROM u, q""")
def distance_similarity(spark, d):
    """Similarities from distances of unit vectors."""
    e = table(spark, d, "embeddings")
    asked = arrays.unit(F.array(*(F.lit(float(x)) for x in e.where("vec_id = 0").select("embedding").first()[0])))
    return e.select("vec_id", F.round(arrays.similarity_of_distance(arrays.squared_distance(arrays.unit(F.col("embedding")), asked)), 6).alias("similarity"))


@query(r"""
    WITH g AS (SELECT a.user_id, sum(CASE WHEN sign(b.value - a.value) * sign(b.event_id - a.event_id) > 0 THEN 1 ELSE 0 END) AS c, sum(CASE WHEN sign(b.value - a.value) * sign(b.event_id - a.event_id) < 0 THEN 1 ELSE 0 END) AS d
               FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id GROUP BY a.user_id)
    SELECT u.user_id, round(coalesce((c - d) / nullif(c + d, 0), 0), 6)::DOUBLE AS gamma, round(least(50, greatest(10, u.top)), 6) AS clipped, u.kinds
    FROM (SELECT user_id, max(value) AS top, lower(string_agg(DISTINCT event_type, ' ' ORDER BY event_type)) AS kinds FROM events GROUP BY user_id) u LEFT JOIN g USING (user_id)""")
def sql_functions(spark, d):
    """The registered scalar, table and aggregate functions, called from SQL."""
    register(spark)
    table(spark, d, "events").createOrReplaceTempView("fit_events")
    spark.sql("SELECT user_id, fit_gamma(event_id, value) AS gamma FROM fit_events GROUP BY user_id").createOrReplaceTempView("fit_gammas")
    return spark.sql(r"""
        WITH u AS (SELECT user_id, max(value) AS top, array_join(array_sort(collect_set(event_type)), '
  
') AS kinds FROM fit_events GROUP BY user_id),
        lines AS (SELECT u.user_id, array_join(transform(array_sort(collect_list(struct(l.pos, l.line))), x -> x.line), '  ') AS kinds FROM u, LATERAL fit_lines(u.kinds) AS l GROUP BY u.user_id)
        SELECT u.user_id, round(g.gamma, 6) AS gamma, round(fit_clip(u.top, 10D, 50D), 6) AS clipped, fit_tidy(lines.kinds) AS kinds
        FROM u JOIN fit_gammas g ON g.user_id = u.user_id JOIN lines ON lines.user_id = u.user_id""")


@query("""SELECT item_id, '{"fit": ' || length(text) % 5 || '}' AS answer, true AS ok, CAST(NULL AS VARCHAR) AS error, CAST(length('fit ' || length(text) % 5 || ' ' || text) // 4 + 40 AS BIGINT) AS tokens, 1 AS tries FROM benchmark""")
def model_answers(spark, d):
    """Calls of the offline model with its telemetry."""
    rest = (F.length("text") % 5).cast("string")
    prompts = table(spark, d, "benchmark").select("item_id", F.concat_ws(" ", F.lit("fit"), rest, F.col("text")).alias("prompt"))
    return ask(prompts, MockBackend({f"fit {k} ": f'{{"fit": {k}}}' for k in range(5)})).select("item_id", "answer", "ok", "error", "tokens", "tries")
