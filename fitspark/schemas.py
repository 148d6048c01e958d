"""Schemas of candidates, studies and stored tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
COMPANY_SIZES = ("1-10", "11-50", "51-200", "201-500", "501-1000", "1001-5000", "5001-10000", "10001+")
WORK_MODES = ("remote", "hybrid", "onsite", "flexible")
PROFICIENCIES = ("beginner", "intermediate", "advanced", "expert")
EDUCATION_TIERS = ("tier_1", "tier_2", "tier_3", "tier_4", "unknown")


SCALARS = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def _type(spec) -> T.DataType:
    """A name is a scalar, a dict a struct, a list of one an array, a tuple of two a map."""
    if isinstance(spec, dict):
        return T.StructType([T.StructField(k, _type(v)) for k, v in spec.items()])
    if isinstance(spec, list):
        return T.ArrayType(_type(spec[0]))
    if isinstance(spec, tuple):
        return T.MapType(_type(spec[0]), _type(spec[1]))
    return SCALARS[spec]


def _fields(**by_type: str) -> dict[str, str]:
    """Field names, blank-separated, by their type."""
    return {name: kind for kind, names in by_type.items() for name in names.split()}


PROFILE = _fields(string="anonymized_name headline summary location country current_title current_company current_company_size current_industry", double="years_of_experience")
CAREER = [_fields(string="company title start_date end_date industry company_size description", int="duration_months", boolean="is_current")]
EDUCATION = [_fields(string="institution degree field_of_study grade tier", int="start_year end_year")]
SIGNALS = _fields(
    string="signup_date last_active_date preferred_work_mode",
    double="profile_completeness_score recruiter_response_rate avg_response_time_hours github_activity_score interview_completion_rate offer_acceptance_rate",
    int="profile_views_received_30d applications_submitted_30d connection_count endorsements_received notice_period_days search_appearance_30d saved_by_recruiters_30d",
    boolean="open_to_work_flag willing_to_relocate verified_email verified_phone linkedin_connected",
) | {"skill_assessment_scores": ("string", "double"), "expected_salary_range": _fields(double="min max")}
#: duration_given tells a missing duration from one that is null.
SKILLS = [_fields(string="name proficiency", int="endorsements duration_months", boolean="duration_given")]
REST = {"certifications": [_fields(string="name issuer", int="year")], "languages": [_fields(string="language proficiency")], "signals": SIGNALS}

CANDIDATE = _type({"candidate_id": "string", "profile": PROFILE, "career_history": CAREER, "education": EDUCATION, "skills": SKILLS} | REST)
#: As it is read: a skill's members stay a map, in which a null member differs from a missing one.
CANDIDATE_JSON = _type({"candidate_id": "string", "profile": PROFILE, "career_history": CAREER, "education": EDUCATION, "skills": [("string", "string")]} | REST)

SCORES = _type({"jd_slug": "string", "tier": "string", "method": "string", "repeat": "int", "score": "double", "tokens": "int", "elapsed_s": "double", "error": "string"})
ENTRIES = _type({"seq": "long", "leaf": "string", "model": "string", "prompt": "string", "ok": "boolean", "elapsed_s": "double", "tokens": "long", "error": "string"})

#: The stored tables in dependency order: columns, the first being the key.
TABLES = {
    name: _type({c: "double" if c == "overall" else "int" if c == "dim" else ["double"] if c == "vector" else "string" for c in columns.split()})
    for name, columns in {
        "workspaces": "workspace_id name created_at updated_at",
        "profiles": "profile_id workspace_id name profile_yaml meta_yaml source_json created_at updated_at",
        "resumes": "resume_id workspace_id name raw_text candidate_json created_at updated_at",
        "candidate_records": "record_id workspace_id resume_id candidate_json created_at",
        "fit_runs": "run_id workspace_id profile_id record_id result_json overall created_at",
        "corrections": "correction_id workspace_id resume_id field_path before_json after_json note created_at",
        "embeddings": "embedding_id workspace_id owner_type owner_id embedding_model dim vector text metadata_json created_at",
    }.items()
}


def as_type(c: Column, have: T.DataType, want: T.DataType) -> Column:
    """A nested value with the members of another type by name, in its order; members that it lacks are null."""
    if have == want:
        return c
    if isinstance(have, T.StructType) and isinstance(want, T.StructType):
        members = {f.name: f.dataType for f in have.fields}
        made = F.struct(*((as_type(c[f.name], members[f.name], f.dataType) if f.name in members else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields))
        return F.when(c.isNotNull(), made)
    if isinstance(have, T.ArrayType) and isinstance(want, T.ArrayType):
        return F.transform(c, lambda x: as_type(x, have.elementType, want.elementType))
    return c.cast(want)
