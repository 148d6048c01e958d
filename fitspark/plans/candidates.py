"""Candidate operators on the driver's tables: an order is a candidate, its lines are the positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitspark.config import Role, role_of
from fitspark.embedding import HashEmbedding, TermEmbedding
from fitspark.operators.components import COMPONENTS, compute_components
from fitspark.operators.intrinsic import INTRINSIC_COLUMNS, extract_intrinsic
from fitspark.operators.score import score_candidates
from fitspark.operators.validate import candidate_violations
from fitspark.plans.catalog import query, table
from fitspark.schemas import CANDIDATE

ROLE: Role = role_of(
    {
        "role": {"title": "Service Engineer", "summary": "Builds services.", "ideal_experience": {"peak_years": 8.0, "sigma_years": 4.0}},
        "locations": {"preferred": ["nation 1"], "acceptable": ["nation 2"], "relocation_acceptable": True},
        "signals": [
            {"id": "services", "label": "services", "query": "building service api", "evidence_regex": "service|api", "dense_weight": 0.5},
            {"id": "selling", "label": "selling", "query": "sales marketing", "evidence_regex": r"\bsales\b", "dense_weight": 0.3},
            {"id": "care", "label": "care", "query": "care about quality", "evidence_regex": None, "dense_weight": 0.2},
        ],
        "dense_extras": {"yoe_fit_weight": 0.1, "domain_ratio_weight": 0.1},
        "domain": {"in_domain_terms": ["service"], "out_of_domain_terms": ["sales"], "in_domain_regex": "service", "out_of_domain_regex": "sales"},
        "relevant_skill_regex": "sql",
        "red_flags": {"cv_primary": {"enabled": True}, "job_hopper": {"enabled": True}, "only_consulting": {"enabled": True}, "stale_ic_role": {"enabled": True}},
    }
)
REF = "1999-01-01"


def candidates(spark, d: str) -> DataFrame:
    """Candidates with positions, skills, education, certificates and signals, among them nulls, zeros and contradictions."""
    line, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    text_of = lambda *when: F.concat(*(F.when(c, t).otherwise("") for c, t in when))
    chosen = lambda of, k: F.element_at(F.array(*(F.lit(x) for x in of)), (k % len(of) + 1).cast("int"))
    even = lambda e: e["l_suppkey"] % 2 == 0

    def position(e: Column) -> dict[str, Column]:
        work = F.concat(F.when(e["l_returnflag"] == "A", "led the service api for search").otherwise("kept a service"), text_of((e["l_linestatus"] == "F", " at 100 qps"), (e["l_partkey"] % 6 == 0, " as internal tool")))
        return {
            "company": F.when(e["l_suppkey"] % 3 == 0, "Infosys").otherwise("Maker"),
            "title": F.when(even(e), "Software Engineer").otherwise("Account Manager"),
            "end_date": F.date_format(e["l_shipdate"], "yyyy-MM-dd"),
            "duration_months": e["l_quantity"],
            "is_current": F.lit(False),
            "company_size": F.lit("51-200"),
            "description": F.when(even(e), work).otherwise("sales calls"),
        }

    def skill(e: Column) -> dict[str, Column]:
        return {
            "name": chosen(("PyTorch", "SQL", "Machine Learning", "Excel", "Search Ranking"), e["l_partkey"]),
            "proficiency": chosen(("beginner", "intermediate", "advanced", "expert"), e["l_suppkey"]),
            "duration_months": F.when(e["l_linenumber"] != 3, e["l_partkey"] % 90),
            "duration_given": e["l_linenumber"] != 2,
        }

    def degree(e: Column) -> dict[str, Column]:
        return {"start_year": 2000 + e["l_suppkey"] % 3, "end_year": F.when(e["l_partkey"] % 7 == 0, 0).otherwise(2004 + e["l_partkey"] % 2)}

    def course(e: Column) -> dict[str, Column]:
        third = e["l_partkey"] % 3
        return {"name": F.when(third == 0, "LangChain Basics").when(third == 1, "Llama Course").otherwise("Cloud"), "year": F.when(e["l_suppkey"] % 11 != 0, 2019 + e["l_suppkey"] % 6)}

    def members(block, have):
        """The struct of a block's type with these members; others are null."""
        return F.struct(*(have.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in block.fields))

    def listed(name, of, most=None):
        item = lambda e: F.struct(e["l_linenumber"].alias("no"), members(CANDIDATE[name].dataType.elementType, of(e)).alias("x"))
        some = F.col("_lines") if most is None else F.filter("_lines", lambda e: e["l_linenumber"] <= most)
        return F.transform(F.sort_array(F.transform(some, item)), lambda e: e["x"]).alias(name)

    # The few columns of a line are shuffled and collected once; the wide blocks are made of them where they are used.
    raw = ("l_linenumber", "l_suppkey", "l_partkey", "l_returnflag", "l_linestatus", "l_shipdate", "l_quantity")
    dealt = line.select("l_orderkey", "l_discount", *raw).repartition("l_orderkey")
    gathered = dealt.groupBy("l_orderkey").agg(F.collect_list(F.struct(*raw)).alias("_lines"), F.min(F.col("l_partkey") % 150).alias("notice"), F.max("l_discount").alias("rate"))
    lists = [listed("career_history", position), listed("skills", skill), listed("education", degree, 3), listed("certifications", course, 2)]
    jobs = gathered.select("l_orderkey", *lists, "notice", "rate")
    rows = jobs.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    cust, order, yoe = F.col("o_custkey"), F.col("o_orderkey"), F.round(F.col("o_totalprice") / 10000)
    headline = F.when(cust % 3 == 0, F.concat(F.lit("a person with "), (yoe + cust % 7).cast("int").cast("string"), F.lit(" years of experience"))).otherwise("a person")
    profile = {"location": F.concat(F.lit("Nation "), (cust % 5).cast("string")), "country": F.when(cust % 4 == 0, "India"), "years_of_experience": yoe, "headline": headline, "current_title": F.when(cust % 5 != 0, "Engineer")}
    scores = F.create_map(F.lit("SQL basics"), (cust % 100).cast("double"), F.lit("Advanced sql"), (cust % 61 + 30).cast("double"), F.lit("Cooking"), F.lit(90.0))
    signals = {
        "signup_date": F.date_format(F.date_add("o_orderdate", ((cust % 5 - 3) * 100).cast("int")), "yyyy-MM-dd"),
        "last_active_date": F.when(cust % 23 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")),
        "preferred_work_mode": F.when(order % 3 == 0, "remote").otherwise("hybrid"),
        "profile_completeness_score": F.when(cust % 10 != 0, cust % 101),
        "recruiter_response_rate": F.when(cust % 13 != 0, F.col("rate") * 10),
        "avg_response_time_hours": (cust % 48) / 2,
        "github_activity_score": F.when(cust % 4 != 1, cust % 100),
        "interview_completion_rate": F.when(cust % 9 != 0, (cust % 11) / 10),
        "offer_acceptance_rate": (cust % 4) / 4,
        "profile_views_received_30d": F.when(cust % 6 != 0, cust % 50),
        "connection_count": order % 500,
        "notice_period_days": F.col("notice"),
        "open_to_work_flag": F.col("o_orderstatus") == "F",
        "willing_to_relocate": F.col("o_orderstatus") == "O",
        "verified_email": cust % 2 == 0,
        "linkedin_connected": F.when(order % 4 != 0, order % 2 == 1),
        "skill_assessment_scores": F.when(cust % 17 != 0, scores),
        "expected_salary_range": F.when(cust % 19 != 0, F.struct((cust % 30).cast("double").alias("min"), yoe.alias("max"))),
    }
    made = {"candidate_id": order.cast("string"), "profile": members(CANDIDATE["profile"].dataType, profile), "signals": members(CANDIDATE["signals"].dataType, signals)}
    made |= {k: F.col(k) for k in ("career_history", "skills", "education", "certifications")}
    return rows.select(*(made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in CANDIDATE.fields))


MONTHS_SQL = "12 * (1999 - year({0})) + (1 - month({0})) + (1 - day({0})) / 30.0"
#: w: lines with what their position counts for; j: sums over the lines of an order; c: all facts of a candidate.
FACTS_SQL = f"""l AS (SELECT *, l_suppkey % 2 = 0 AS even, l_returnflag = 'A' AS own, l_linestatus = 'F' AS scale, l_partkey % 6 = 0 AS internal, greatest(0, {MONTHS_SQL.format('l_shipdate')}) AS since,
      CASE WHEN l_linenumber <> 3 THEN l_partkey % 90 ELSE 0 END AS months, ['PyTorch', 'SQL', 'Machine Learning', 'Excel', 'Search Ranking'][l_partkey % 5 + 1] AS skill, ['beginner', 'intermediate', 'advanced', 'expert'][l_suppkey % 4 + 1] AS level,
      CASE WHEN l_linenumber <= 3 AND l_partkey % 7 <> 0 THEN (2000 + l_suppkey % 3) * 10000 + 2004 + l_partkey % 2 END AS degree FROM lineitem),
    w AS (SELECT *, pow(0.5, since / 30.0) AS recent, CASE WHEN even THEN CASE WHEN internal THEN 0.4 ELSE 1 END * CASE WHEN own THEN 1 ELSE 0.7 END * CASE WHEN scale THEN 1 ELSE 0.85 END ELSE 0.7 * 0.85 END * pow(0.5, since / 30.0) AS mods,
      pow(0.5, since / 18.0) * sqrt(greatest(1, CAST(l_quantity AS INTEGER))) AS weight FROM l),
    j AS (SELECT l_orderkey, CAST(count(*) AS INTEGER) AS n_jobs, CAST(sum(CAST(l_quantity AS INTEGER)) AS DOUBLE) AS career_months, max(CAST(l_quantity AS INTEGER)) AS max_role, min(l_partkey % 150) AS notice, max(l_discount) AS rate,
      bool_and(l_suppkey % 3 = 0) AS consulting, min(CASE WHEN even THEN since END) AS ic, max(CASE WHEN even THEN mods ELSE 0 END) AS services, max(CASE WHEN even THEN 0 ELSE mods END) AS selling,
      max(CASE WHEN even AND own AND scale AND NOT internal THEN recent ELSE 0 END) AS depth, count(*) FILTER (WHERE NOT even) AS outside, count(*) FILTER (WHERE even) AS inside, bool_or(even AND own) AS searches,
      '[' || string_agg('{{"n":"' || skill || '","p":"' || level || '","d":' || months || '}}', ',' ORDER BY l_linenumber, skill, level, months) || ']' AS skills_json, count(*) FILTER (WHERE level = 'expert') AS n_expert,
      count(*) FILTER (WHERE level = 'expert' AND l_linenumber <> 2 AND months = 0) AS n_unused, list(months) AS skill_months, count(*) FILTER (WHERE l_partkey % 5 IN (0, 2, 4)) AS claimed, count(*) FILTER (WHERE l_partkey % 5 = 4) AS ranked,
      bool_or(l_linenumber <= 2 AND l_suppkey % 11 <> 0 AND (l_partkey % 3 = 0 AND 2019 + l_suppkey % 6 < 2022 OR l_partkey % 3 = 1 AND 2019 + l_suppkey % 6 < 2023)) AS anach,
      count(DISTINCT degree) < count(degree) AS concurrent, coalesce(min(degree % 10000), 0) AS edu_end,
      sum(weight * CASE WHEN NOT even THEN 0.5 WHEN own THEN 2 / sqrt(6) ELSE 1 END) / sum(weight) AS dense1, sum(weight * CASE WHEN NOT even THEN 1 WHEN own THEN 1 / sqrt(6) ELSE 0.5 END) / sum(weight) AS dense2,
      sum(weight * CASE WHEN even AND own THEN 1 / sqrt(3) ELSE 1 / sqrt(2) END) / sum(weight) AS dense3
      FROM w GROUP BY l_orderkey),
    c AS (SELECT *, round(o_totalprice / 10000) AS yoe, career_months / n_jobs AS tenure, 'nation ' || (o_custkey % 5) || ' ' || CASE WHEN o_custkey % 4 = 0 THEN 'india' ELSE '' END AS place, CAST(o_orderkey AS VARCHAR) AS candidate_id,
      CASE WHEN o_custkey % 23 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS active, strftime(o_orderdate + INTERVAL 100 DAY * (o_custkey % 5 - 3), '%Y-%m-%d') AS signup, CASE WHEN o_custkey % 13 <> 0 THEN rate * 10 ELSE -1 END::DOUBLE AS response,
      CASE WHEN o_custkey % 9 <> 0 THEN (o_custkey % 11) / 10.0 ELSE 0.5 END::DOUBLE AS interview, CASE WHEN o_custkey % 10 <> 0 THEN o_custkey % 101 ELSE 50 END::DOUBLE AS complete, o_orderkey % 3 = 0 AS remote, o_orderstatus = 'O' AS moves,
      CASE WHEN o_custkey % 19 <> 0 THEN o_custkey % 30 ELSE 0 END::DOUBLE AS pay_min, CASE WHEN o_custkey % 19 <> 0 THEN round(o_totalprice / 10000) ELSE 0 END::DOUBLE AS pay_max, ((o_custkey % 100) + (o_custkey % 61 + 30)) / 2.0 AS tested
      FROM j JOIN orders ON o_orderkey = l_orderkey)"""


@query(f"""
    WITH {FACTS_SQL} SELECT candidate_id, CASE WHEN o_custkey % 5 <> 0 THEN 'Engineer' ELSE '' END AS current_title, yoe, place AS location, n_jobs, career_months, round(tenure, 6) AS avg_tenure_months, CAST(max_role AS DOUBLE) AS max_role_months,
      skills_json, CAST(n_expert AS INTEGER) AS n_expert, CAST(n_unused AS INTEGER) AS n_expert_zero_dur, pay_min AS salary_min, pay_max AS salary_max, CAST(anach AS INTEGER) AS anach, CAST(concurrent AS INTEGER) AS concurrent_deg,
      CAST(edu_end AS INTEGER) AS min_edu_end_year, CASE WHEN o_custkey % 17 <> 0 THEN '{{"SQL basics":' || CAST(o_custkey % 100 AS DOUBLE) || ',"Advanced sql":' || CAST(o_custkey % 61 + 30 AS DOUBLE) || ',"Cooking":90.0}}' ELSE '{{}}' END AS assessments_json,
      active AS last_active_date, signup AS signup_date, round(response, 6) AS recruiter_response_rate, CAST(o_orderstatus = 'F' AS INTEGER) AS open_to_work_flag, round(interview, 6) AS interview_completion_rate, complete AS profile_completeness_score,
      CAST(notice AS INTEGER) AS notice_period_days, CASE WHEN o_custkey % 4 <> 1 THEN o_custkey % 100 ELSE -1 END::DOUBLE AS github_activity_score, CAST(moves AS INTEGER) AS willing_to_relocate, CAST(remote AS INTEGER) AS remote_pref,
      CASE WHEN o_custkey % 6 <> 0 THEN o_custkey % 50 ELSE -1 END::DOUBLE AS profile_views_received_30d, -1.0::DOUBLE AS applications_submitted_30d, (o_custkey % 48) / 2.0::DOUBLE AS avg_response_time_hours, CAST(o_orderkey % 500 AS DOUBLE) AS connection_count,
      -1.0::DOUBLE AS endorsements_received, -1.0::DOUBLE AS search_appearance_30d, -1.0::DOUBLE AS saved_by_recruiters_30d, (o_custkey % 4) / 4.0::DOUBLE AS offer_acceptance_rate,
      CAST(o_custkey % 2 = 0 AS INTEGER) AS verified_email, 0 AS verified_phone, CAST(o_orderkey % 4 <> 0 AND o_orderkey % 2 = 1 AS INTEGER) AS linkedin_connected
    FROM c""")
def candidate_facts(spark, d):
    """All 37 facts."""
    f = extract_intrinsic(candidates(spark, d))
    rounded = ("avg_tenure_months", "recruiter_response_rate", "interview_completion_rate")
    return f.select("candidate_id", *((F.round(k, 6) if k in rounded else F.col(k)).alias(k) for k in INTRINSIC_COLUMNS))


#: p: the parts of a score beside each candidate's facts.
PARTS_SQL = f"""{FACTS_SQL}, i AS (SELECT *, exp(-pow(yoe - 8, 2) / 32) AS yoe_fit, n_jobs >= 4 AND tenure < 19 AS hopper, outside >= 3 AND outside > inside AS outsider, (inside + 1) / (inside + outside + 2) AS ratio, (services + selling) / 2 AS coverage,
      CASE WHEN o_custkey % 17 <> 0 THEN least(1, greatest(0, (tested - 40) / 50)) * 2 / 2.5 ELSE 0 END AS strength, CASE WHEN searches THEN ranked ELSE 0 END / (claimed + 1.0) AS corroborated, len(list_filter(skill_months, lambda m: m > career_months * 1.25 + 6)) AS longer,
      CASE WHEN notice <= 90 THEN 1.0 WHEN notice <= 119 THEN 0.93 WHEN notice <= 120 THEN 0.9 ELSE 0.85 END AS late, CASE WHEN active = '' THEN 12 ELSE greatest(0, {MONTHS_SQL.format('o_orderdate')}) END AS idle, response BETWEEN 0 AND 0.1999999999 AS rare,
      CASE WHEN o_custkey % 5 = 1 THEN 1.0 WHEN o_custkey % 5 = 2 THEN 0.9 WHEN o_custkey % 4 = 0 THEN CASE WHEN moves THEN 0.75 ELSE 0.33 END WHEN moves THEN 0.5 ELSE 0.12 END AS near FROM c),
    p AS (SELECT *, CASE WHEN career_months / 12 > yoe + 3.5 THEN 0.05 ELSE 1 END * CASE WHEN max_role / 12 > yoe + 1.5 THEN 0.05 ELSE 1 END * CASE WHEN yoe * 12 > career_months * 1.6 + 18 THEN 0.05 ELSE 1 END
        * CASE WHEN o_custkey % 3 = 0 AND o_custkey % 7 > 3 THEN 0.05 ELSE 1 END * CASE WHEN n_unused >= 1 THEN 0.05 ELSE 1 END * CASE WHEN n_expert >= 8 THEN 0.05 ELSE 1 END * CASE WHEN longer >= 2 THEN 1 - least(0.15, 0.04 * longer) ELSE 1 END
        * CASE WHEN pay_min > pay_max THEN 0.97 ELSE 1 END * CASE WHEN anach THEN 0.3 ELSE 1 END * CASE WHEN active <> '' AND active < signup THEN 0.97 ELSE 1 END * CASE WHEN concurrent THEN 0.93 ELSE 1 END AS honest,
      (0.5 + 0.6 * (0.35 * exp(-idle / 6) + 0.25 * greatest(0, response) + 0.15 * CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END + 0.15 * interview + 0.1 * complete / 100)) * CASE WHEN idle > 6 AND rare THEN 0.5 WHEN rare THEN 0.8 ELSE 1 END AS available,
      CASE WHEN remote AND NOT moves AND o_custkey % 5 NOT IN (1, 2) THEN least(near, 0.25) ELSE near END * CASE WHEN remote THEN 0.9 ELSE 1 END AS loc FROM i)"""


@query(f"""
    WITH {PARTS_SQL} SELECT candidate_id, round(yoe_fit, 6) AS yoe_fit, CAST(hopper AS DOUBLE) AS hopper, CAST(consulting AS DOUBLE) AS only_consulting, round(coalesce(ic, 999), 6) AS months_since_ic_role, CAST(outsider AS DOUBLE) AS cv_primary,
      round(ratio, 6) AS domain_nlp_ratio, round(corroborated, 6) AS ai_skill_corroboration, CAST(claimed AS INTEGER) AS ai_skills_claimed, round(coverage, 6) AS evid_coverage, round(depth, 6) AS depth_bonus, round(strength, 6) AS assess_strength,
      round(honest, 6)::DOUBLE AS integrity, round(available, 6) AS availability_mult, late::DOUBLE AS notice_pen, round(loc, 6)::DOUBLE AS loc2_v4 FROM p""")
def candidate_components(spark, d):
    """All fifteen components."""
    c = compute_components(candidates(spark, d), ROLE, ref_date=REF)
    whole = ("hopper", "only_consulting", "cv_primary", "ai_skills_claimed", "notice_pen")
    return c.select("candidate_id", *((F.col(k) if k in whole else F.round(k, 6)).alias(k) for k in COMPONENTS))


#: s: the score from its parts; the vectors of TermEmbedding make the similarities simple fractions.
SCORE_SQL = f"""{PARTS_SQL}, f AS (SELECT *, CASE WHEN inside > 0 THEN 1 ELSE 0 END / 3.0 + CASE WHEN searches THEN 1 ELSE 0 END / 3.0 AS lexical1, CASE WHEN outside > 0 THEN 0.5 ELSE 0 END AS lexical2,
      CASE WHEN coalesce(ic, 999) > 36 THEN 0.35 WHEN coalesce(ic, 999) > 18 THEN 0.7 WHEN coalesce(ic, 999) > 1 THEN 0.9 ELSE 1 END AS stale, (0.55 + 0.45 * loc) * CASE WHEN loc <= 0.12 THEN 0.6 ELSE 1 END AS place_gate FROM p),
    s AS (SELECT *, least(100, greatest(0, 100 * least(1, greatest(0, (0.38 * (0.1 * yoe_fit + 0.1 * ratio + 0.5 * dense1 + 0.3 * dense2 + 0.2 * dense3) + 0.09 * (lexical1 + lexical2) / 3 + 0.08 * depth) / (0.38 * 1.2 + 0.09 + 0.08)))
        * (0.15 + 0.85 * coverage) * CASE WHEN claimed = 0 THEN 1 ELSE 0.5 + 0.5 * corroborated END * (1 + 0.25 * strength * least(1, coverage / 0.25)) * stale * (0.6 + 0.4 * yoe_fit) * CASE WHEN outsider THEN 0.6 ELSE 1 END
        * CASE WHEN hopper THEN 0.55 ELSE 1 END * CASE WHEN consulting THEN 0.7 ELSE 1 END * place_gate * honest * available * late)) AS overall,
      list_filter([CASE WHEN outsider THEN 'cv_primary' END, CASE WHEN hopper THEN 'job_hopper' END, CASE WHEN consulting THEN 'only_consulting' END, CASE WHEN stale < 1 THEN 'stale_ic_role' END], lambda x: x IS NOT NULL) AS fired FROM f)"""


@query(f"""
    WITH {SCORE_SQL} SELECT candidate_id, round(overall, 6) AS overall, array_to_string(fired, ', ') AS red_flags,
      CAST((dense1 < 0.35 AND services < 0.35)::INTEGER + (dense2 < 0.35 AND selling < 0.35)::INTEGER + (dense3 < 0.35)::INTEGER + (honest < 0.999)::INTEGER + (available < 0.999)::INTEGER + (late < 0.999)::INTEGER + (place_gate < 0.999)::INTEGER + len(fired) AS INTEGER) AS n_gaps,
      round(dense1, 6) AS dense_services, round(dense2, 6) AS dense_selling, round(dense3, 6) AS dense_care, round(services, 6) AS evidence_services, round(selling, 6) AS evidence_selling, round(lexical1, 6) AS lexical_services, round(lexical2, 6)::DOUBLE AS lexical_selling,
      round(place_gate, 6)::DOUBLE AS location_gate FROM s""")
def candidate_fit(spark, d):
    """The whole score with all that explains it, on vectors that SQL can give."""
    got = score_candidates(candidates(spark, d), ROLE, TermEmbedding(("service", "sales", "led")), ref_date=REF)
    of = lambda k, name: F.round(F.get("fit.per_signal", F.lit(k))[name], 6)
    return got.select(
        "candidate_id", F.round("overall", 6).alias("overall"), F.array_join("fit.red_flags", ", ").alias("red_flags"), F.size("fit.gaps").alias("n_gaps"),
        of(0, "dense").alias("dense_services"), of(1, "dense").alias("dense_selling"), of(2, "dense").alias("dense_care"), of(0, "evidence").alias("evidence_services"), of(1, "evidence").alias("evidence_selling"),
        of(0, "lexical").alias("lexical_services"), of(1, "lexical").alias("lexical_selling"), F.round(F.get("fit.gates", F.lit(3))["value"], 6).alias("location_gate"),
    )


@query(f"WITH {FACTS_SQL} SELECT CAST(o_orderkey AS VARCHAR) AS candidate_id, CASE WHEN n_jobs NOT BETWEEN 1 AND 10 THEN 1 ELSE 0 END AS jobs_broken, CASE WHEN yoe NOT BETWEEN 0 AND 50 THEN 1 ELSE 0 END AS years_broken FROM c")
def candidate_validation(spark, d):
    v = candidates(spark, d).select("candidate_id", F.transform(candidate_violations(check_id=False), lambda x: x["path"]).alias("paths"))
    broken = lambda p: F.array_contains("paths", p).cast("int")
    return v.select("candidate_id", broken("career_history").alias("jobs_broken"), broken("profile.years_of_experience").alias("years_broken"))


@query()
def hashed_fit(spark, d):
    """The score on hashed tokens, whose vectors have no counterpart in SQL."""
    return score_candidates(candidates(spark, d), ROLE, HashEmbedding(), ref_date=REF).select("candidate_id", F.round("overall", 6).alias("overall"), F.array_join("fit.red_flags", ", ").alias("red_flags"), F.size("fit.gaps").alias("n_gaps"))
