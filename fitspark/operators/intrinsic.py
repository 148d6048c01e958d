"""Facts of a candidate that depend on no role: one projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitspark.config import METHOD
from fitspark.functions import arrays
from fitspark.schemas import CANDIDATE, CANDIDATE_JSON

#: Counts that are passed on, -1 where missing.
COUNTS = ("profile_views_received_30d", "applications_submitted_30d", "avg_response_time_hours", "connection_count", "endorsements_received", "search_appearance_30d", "saved_by_recruiters_30d", "offer_acceptance_rate")
FLAGS = ("verified_email", "verified_phone", "linkedin_connected")


def candidates_of(rows: DataFrame, column: str = "candidate_json") -> DataFrame:
    """Candidates in JSON text as columns; other columns stay before them.

    The block of signals may be named by any word before _signals, and the salary
    range may have a unit after its name. Text that is no object gives nulls.
    """
    text = F.regexp_replace(F.regexp_replace(F.col(column), r'"[a-z0-9]+_signals"\s*:', '"signals":'), r'"expected_salary_range_[a-z_]+"\s*:', '"expected_salary_range":')
    skill = lambda m: F.struct(
        m["name"].alias("name"), m["proficiency"].alias("proficiency"), m["endorsements"].try_cast("int").alias("endorsements"), m["duration_months"].try_cast("double").try_cast("int").alias("duration_months"), F.map_contains_key(m, "duration_months").alias("duration_given")
    )
    read = rows.withColumn("_c", F.from_json(text, CANDIDATE_JSON))
    fields = [F.transform("_c.skills", skill).alias("skills") if f == "skills" else F.col(f"_c.{f}") for f in CANDIDATE.fieldNames()]
    return read.select(*(c for c in rows.columns if c not in (column, *CANDIDATE.fieldNames())), *fields)


def falsy(c: Column, default) -> Column:
    """The value, or the default where it is null, empty or zero."""
    return F.coalesce(F.nullif(c, F.lit("" if isinstance(default, str) else 0)), F.lit(default))


def jobs() -> Column:
    return F.coalesce(F.col("career_history"), F.expr("array()").cast(CANDIDATE["career_history"].dataType))


def skills() -> Column:
    return F.coalesce(F.col("skills"), F.expr("array()").cast(CANDIDATE["skills"].dataType))


def facts() -> dict[str, Column]:
    """The 37 facts, in order."""
    durations = F.transform(jobs(), lambda j: F.coalesce(j["duration_months"], F.lit(0)).cast("double"))
    months = arrays.total(durations)
    expert = F.filter(skills(), lambda s: F.coalesce(s["proficiency"] == "expert", F.lit(False)))
    unused = F.filter(expert, lambda s: s["duration_given"] & (F.coalesce(s["duration_months"], F.lit(0)) == 0))
    certs = F.coalesce(F.col("certifications"), F.expr("array()").cast(CANDIDATE["certifications"].dataType))

    def too_early(c: Column) -> Column:
        out = F.lit(False)
        for name, year in METHOD["first_years"].items():
            out = out | (c["name"].contains(name) & (c["year"] < year))
        return out

    # Lambdas compute an expression again wherever it stands, so names are lowered in a step of their own.
    named = F.transform(certs, lambda c: F.struct(F.lower(F.coalesce(c["name"], F.lit(""))).alias("name"), falsy(c["year"], 9999).alias("year")))
    early = F.exists(named, too_early)
    spans = F.filter(F.transform(F.coalesce(F.col("education"), F.expr("array()").cast(CANDIDATE["education"].dataType)), lambda e: F.struct(e["start_year"].alias("a"), e["end_year"].alias("b"))), lambda e: (falsy(e["a"], 0) != 0) & (falsy(e["b"], 0) != 0))
    s = F.col("signals")
    given = lambda name, default: F.coalesce(s[name].cast("double"), F.lit(float(default)))
    true = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return {
        "current_title": F.coalesce(F.col("profile.current_title"), F.lit("")),
        "yoe": F.coalesce(F.col("profile.years_of_experience"), F.lit(0.0)),
        "location": F.lower(F.concat(F.coalesce(F.col("profile.location"), F.lit("")), F.lit(" "), F.coalesce(F.col("profile.country"), F.lit("")))),
        "n_jobs": F.size(jobs()),
        "career_months": months,
        "avg_tenure_months": F.coalesce(F.try_divide(months, F.size(jobs()).cast("double")), F.lit(0.0)),
        "max_role_months": F.coalesce(F.array_max(durations), F.lit(0.0)),
        "skills_json": F.to_json(F.transform(skills(), lambda k: F.struct(F.coalesce(k["name"], F.lit("")).alias("n"), F.coalesce(k["proficiency"], F.lit("")).alias("p"), F.coalesce(k["duration_months"], F.lit(0)).alias("d")))),
        "n_expert": F.size(expert),
        "n_expert_zero_dur": F.size(unused),
        "salary_min": F.coalesce(s["expected_salary_range"]["min"], F.lit(0.0)),
        "salary_max": F.coalesce(s["expected_salary_range"]["max"], F.lit(0.0)),
        "anach": early.cast("int"),
        "concurrent_deg": (F.size(F.array_distinct(spans)) < F.size(spans)).cast("int"),
        "min_edu_end_year": F.coalesce(F.array_min(F.transform(spans, lambda e: e["b"])), F.lit(0)),
        "assessments_json": F.coalesce(F.to_json(s["skill_assessment_scores"]), F.lit("{}")),
        "last_active_date": F.coalesce(s["last_active_date"], F.lit("")),
        "signup_date": F.coalesce(s["signup_date"], F.lit("")),
        "recruiter_response_rate": given("recruiter_response_rate", -1),
        "open_to_work_flag": true(s["open_to_work_flag"]),
        "interview_completion_rate": given("interview_completion_rate", 0.5),
        "profile_completeness_score": given("profile_completeness_score", 50),
        "notice_period_days": F.coalesce(s["notice_period_days"], F.lit(0)),
        "github_activity_score": given("github_activity_score", -1),
        "willing_to_relocate": true(s["willing_to_relocate"]),
        "remote_pref": true(s["preferred_work_mode"] == "remote"),
        **{k: given(k, -1) for k in COUNTS},
        **{k: true(s[k]) for k in FLAGS},
    }


INTRINSIC_COLUMNS = tuple(
    "current_title yoe location n_jobs career_months avg_tenure_months max_role_months skills_json n_expert n_expert_zero_dur salary_min salary_max anach concurrent_deg min_edu_end_year assessments_json "
    "last_active_date signup_date recruiter_response_rate open_to_work_flag interview_completion_rate profile_completeness_score notice_period_days github_activity_score willing_to_relocate remote_pref".split()
) + COUNTS + FLAGS


def extract_intrinsic(candidates: DataFrame) -> DataFrame:
    """candidate_id and the 37 facts; the layer that is worth keeping, as all roles use it."""
    return candidates.select("candidate_id", *(c.alias(k) for k, c in facts().items()))
