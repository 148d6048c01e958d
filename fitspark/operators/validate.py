"""Rules of a candidate record as columns."""

from __future__ import annotations

import json

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from fitspark.config import Verdict, named_field
from fitspark.operators.intrinsic import candidates_of
from fitspark.operators.matching import violations
from fitspark.schemas import COMPANY_SIZES, PROFICIENCIES, WORK_MODES


def _between(path: str, low: float, high: float) -> tuple[str, str, Column]:
    c = F.col(path)
    return path, f"must be between {low:g} and {high:g}", c.isNull() | ~c.between(low, high)


def _given(path: str) -> tuple[str, str, Column]:
    return path, "missing", F.col(path).isNull()


def _among(path: str, allowed: tuple[str, ...]) -> tuple[str, str, Column]:
    return path, "not allowed", F.col(path).isNull() | ~F.col(path).isin(*allowed)


def candidate_rules(*, check_id: bool = True) -> list[tuple[str, str, Column]]:
    """(path, message, violated); dates are not checked, as elsewhere one that is none counts as missing."""
    jobs, edu, skills = F.col("career_history"), F.col("education"), F.col("skills")
    bad = lambda a, f: F.coalesce(F.exists(a, f), F.lit(False))
    rules = [
        ("candidate_id", "must be CAND_ and seven digits", F.col("candidate_id").isNull() | ~F.col("candidate_id").rlike("^CAND_[0-9]{7}$")) if check_id else _given("candidate_id"),
        _given("profile"),
        *(_given(f"profile.{k}") for k in ("anonymized_name", "headline", "summary", "location", "country", "current_title", "current_company", "current_industry")),
        _between("profile.years_of_experience", 0, 50),
        _among("profile.current_company_size", COMPANY_SIZES),
        ("career_history", "must have 1 to 10 entries", jobs.isNull() | ~F.size(jobs).between(1, 10)),
        ("career_history.company_size", "not allowed", bad(jobs, lambda j: j["company_size"].isNull() | ~j["company_size"].isin(*COMPANY_SIZES))),
        ("career_history.duration_months", "must be 0 or more", bad(jobs, lambda j: j["duration_months"].isNull() | (j["duration_months"] < 0))),
        ("career_history.title", "missing", bad(jobs, lambda j: j["title"].isNull())),
        ("education", "must have at most 5 entries", F.coalesce(F.size(edu) > 5, F.lit(False))),
        ("education.start_year", "must be between 1970 and 2030", bad(edu, lambda e: e["start_year"].isNull() | ~e["start_year"].between(1970, 2030))),
        ("education.end_year", "must be between 1970 and 2035", bad(edu, lambda e: e["end_year"].isNull() | ~e["end_year"].between(1970, 2035))),
        ("skills.proficiency", "not allowed", bad(skills, lambda s: s["proficiency"].isNull() | ~s["proficiency"].isin(*PROFICIENCIES))),
        _given("signals"),
        _between("signals.profile_completeness_score", 0, 100),
        _between("signals.recruiter_response_rate", 0, 1),
        _between("signals.interview_completion_rate", 0, 1),
        _between("signals.offer_acceptance_rate", -1, 1),
        _between("signals.github_activity_score", -1, 100),
        _between("signals.notice_period_days", 0, 180),
        _among("signals.preferred_work_mode", WORK_MODES),
    ]
    return rules


def candidate_violations(*, check_id: bool = True) -> Column:
    return violations(candidate_rules(check_id=check_id))


class CandidateValidator:
    """Candidates in JSON, one at a time, by the rules that tables of them are checked with."""

    def __init__(self, spark: SparkSession, *, check_id: bool = True) -> None:
        self.spark, self.check_id = spark, check_id

    def validate(self, d: dict) -> Verdict:
        rows = candidates_of(self.spark.createDataFrame([(json.dumps(d),)], "candidate_json string"))
        first = rows.select(F.get(candidate_violations(check_id=self.check_id), F.lit(0)).alias("v")).first()["v"]
        if first is None:
            return Verdict(True)
        error = f"field '{first['path']}': {first['message']}"
        return Verdict(False, error, *named_field(error))
