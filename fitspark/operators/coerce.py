"""Loose JSON into blocks of the right shape, with defaults; expressions over VARIANT columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fitspark.functions import arrays, dates, text
from fitspark.functions.jsonx import member
from fitspark.operators.ranking import heaviest
from fitspark.schemas import COMPANY_SIZES, EDUCATION_TIERS, PROFICIENCIES, WORK_MODES

# What stands in for parts of a candidate or a role profile that are missing.
DEFAULT_COMPANY, DEFAULT_SIZE, DEFAULT_INDUSTRY = "Unknown Company", "201-500", "Technology"
DEFAULT_JOB = {"title": "Unknown Title"}
DEFAULT_DEGREE = {"institution": "Unknown Institution", "degree": "Bachelor's", "field_of_study": "General Studies"}
DEFAULT_PROFILE = {"anonymized_name": "XYZ Candidate", "headline": "Professional", "location": "Unknown", "country": "India", "current_title": "Professional"}
DAYS_BEFORE = 365
DEFAULT_ROLE = {"min_years": 2, "max_years": 10, "peak_years": 5.0, "sigma_years": 2.5, "notice_days": 60}
DEFAULT_EXTRAS = {"yoe_fit_weight": 0.08, "domain_ratio_weight": 0.10}
DEFAULT_DOMAIN = {"in_domain_terms": ["engineering", "technology"], "out_of_domain_terms": ["unrelated field"], "in_domain_regex": r"engineer|technolog|software|data|product", "out_of_domain_regex": r"unrelated field"}
DEFAULT_SKILLS = r"python|java|sql|cloud|aws|azure|gcp|communication|leadership|analysis"
DEFAULT_FLAGS = {"cv_primary": False, "job_hopper": True, "only_consulting": False, "stale_ic_role": True}


def words(v: Column, path: str, default: str = "") -> Column:
    return F.coalesce(F.nullif(F.trim(member(v, path)), F.lit("")), F.lit(default))


def one_of(c: Column, allowed: tuple[str, ...], default: str) -> Column:
    return F.when(c.isin(*allowed), c).otherwise(F.lit(default))


def kind_of(v: Column, path: str) -> Column:
    """The name of a member's JSON type, empty if it is missing."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{path}", "variant")), F.lit(""))


def number(v: Column, path: str) -> Column:
    """A member that is a number, not a text that looks like one; else null."""
    return F.when(kind_of(v, path).rlike("^(?:BIGINT|DOUBLE|DECIMAL)"), member(v, path, "double"))


def truth(v: Column, path: str) -> Column:
    """A member that is true or false; else null."""
    return F.when(kind_of(v, path) == "BOOLEAN", member(v, path, "boolean"))


def items(v: Column, path: str) -> Column:
    """The objects of an array member as array<variant>; empty if it is none."""
    every = F.coalesce(F.try_variant_get(v, f"$.{path}", "array<variant>"), F.expr("cast(array() as array<variant>)"))
    return F.filter(every, lambda e: F.schema_of_variant(e).startswith("OBJECT"))


def career(v: Column, ref: Column, path: str = "career_history", most: int = 10) -> Column:
    """Up to `most` positions, one at least. One that is current, or whose end is no date, goes on; lengths follow from the dates."""

    def stated(e: Column) -> Column:
        """What an entry states, each member read once; lambdas compute an expression again wherever it stands."""
        return F.struct(
            dates.parse_date(words(e, "start_date")).alias("start"), dates.parse_date(words(e, "end_date")).alias("end"), truth(e, "is_current").alias("current"), number(e, "duration_months").alias("given"),
            words(e, "title", DEFAULT_JOB["title"]).alias("title"), words(e, "company", DEFAULT_COMPANY).alias("company"), words(e, "industry", DEFAULT_INDUSTRY).alias("industry"), member(e, "company_size").alias("size"), F.nullif(words(e, "description"), F.lit("")).alias("description"),
        )

    def entry(s: Column) -> Column:
        current = F.coalesce(s["current"], F.lit(False)) | s["end"].isNull()
        start = F.coalesce(s["start"], F.date_sub(ref, DAYS_BEFORE))
        length = F.greatest(F.lit(0.0), dates.months(start, F.when(current, ref).otherwise(s["end"])))
        return F.struct(
            s["company"].alias("company"),
            s["title"].alias("title"),
            F.date_format(start, "yyyy-MM-dd").alias("start_date"),
            F.when(~current, F.date_format(s["end"], "yyyy-MM-dd")).alias("end_date"),
            F.bround(F.when(s["given"] >= 0, s["given"]).otherwise(length)).cast("int").alias("duration_months"),
            current.alias("is_current"),
            s["industry"].alias("industry"),
            one_of(s["size"], COMPANY_SIZES, DEFAULT_SIZE).alias("company_size"),
            F.coalesce(s["description"], F.concat(s["title"], F.lit(" at "), s["company"], F.lit("."))).alias("description"),
        )

    def listed(every: Column) -> Column:
        some = F.when(F.size(every) > 0, every).otherwise(F.array(F.parse_json(F.lit("{}"))))
        return F.transform(F.transform(some, stated), entry)

    return arrays.bound(F.slice(items(v, path), 1, most), listed)


def education(v: Column, path: str = "education", most: int = 5) -> Column:
    def entry(e: Column) -> Column:
        at = lambda k: words(e, k, DEFAULT_DEGREE[k]).alias(k)
        start = dates.clamp_int(member(e, "start_year", "double"), 1970, 2030, 2015)
        end = dates.clamp_int(member(e, "end_year", "double"), 1970, 2035, 2019)
        return F.struct(at("institution"), at("degree"), at("field_of_study"), start.alias("start_year"), F.greatest(start, end).alias("end_year"), F.nullif(words(e, "grade"), F.lit("")).alias("grade"), one_of(member(e, "tier"), EDUCATION_TIERS, "unknown").alias("tier"))

    return F.transform(F.slice(items(v, path), 1, most), entry)


def skills(v: Column, path: str = "skills") -> Column:
    """Skills with a name, each name once without regard to case; the first stays."""

    def entry(e: Column) -> Column:
        given = number(e, "duration_months")
        return F.struct(
            words(e, "name").alias("name"),
            one_of(member(e, "proficiency"), PROFICIENCIES, "intermediate").alias("proficiency"),
            dates.clamp_int(member(e, "endorsements", "double"), 0, 10_000, 0).alias("endorsements"),
            F.when(given >= 0, F.bround(given).cast("int")).alias("duration_months"),
            F.coalesce(given >= 0, F.lit(False)).alias("duration_given"),
        )

    named = F.filter(F.transform(items(v, path), entry), lambda s: s["name"] != "")
    return arrays.distinct_by(named, lambda s: F.lower(s["name"]))


def profile(v: Column, path: str = "profile") -> Column:
    at = lambda k: words(v, f"{path}.{k}", DEFAULT_PROFILE.get(k, "")).alias(k)
    years = dates.clip(dates.number_or(member(v, f"{path}.years_of_experience", "double"), 0.0), 0, 50)
    company, industry = words(v, f"{path}.current_company", DEFAULT_COMPANY), words(v, f"{path}.current_industry", DEFAULT_INDUSTRY)
    size = one_of(member(v, f"{path}.current_company_size"), COMPANY_SIZES, DEFAULT_SIZE)
    return F.struct(at("anonymized_name"), at("headline"), at("summary"), at("location"), at("country"), years.alias("years_of_experience"), at("current_title"), company.alias("current_company"), size.alias("current_company_size"), industry.alias("current_industry"))


def with_projects(p: Column, projects: Column) -> Column:
    """A profile whose summary takes in the projects after a blank line: they are no positions."""
    told = F.array_join(F.filter(F.transform(projects, lambda x: F.trim(x)), lambda x: x != ""), "; ")
    return F.when(told != "", p.withField("summary", F.concat_ws("\n\n", F.nullif(p["summary"], F.lit("")), F.concat(F.lit("Projects: "), told)))).otherwise(p)


def signals(v: Column, source: Column, ref: Column, path: str = "signals") -> Column:
    """The 23 signals of a candidate that nothing but a text is known of: neutral values, but for what the block or the text states."""
    fixed = lambda k, value: F.lit(value).alias(k)
    stated = lambda k: F.coalesce(truth(v, f"{path}.{k}"), F.lit(False)).alias(k)
    day = lambda d: F.date_format(d, "yyyy-MM-dd")
    low = F.greatest(F.lit(0.0), dates.number_or(member(v, f"{path}.expected_salary_range.min", "double"), 0.0))
    high = F.greatest(low, dates.number_or(member(v, f"{path}.expected_salary_range.max", "double"), 0.0))
    github = F.when(source.rlike(r"(?i)github\.com/[A-Za-z0-9_-]+"), 40.0).otherwise(-1.0)
    notice = F.coalesce(dates.clamp_int(F.coalesce(number(v, f"{path}.notice_period_days"), text.notice_days(source).cast("double")), 0, 180, 60))
    return F.struct(
        fixed("profile_completeness_score", 50.0),
        day(F.date_sub(ref, DAYS_BEFORE)).alias("signup_date"),
        day(ref).alias("last_active_date"),
        fixed("open_to_work_flag", True),
        fixed("profile_views_received_30d", 0),
        fixed("applications_submitted_30d", 0),
        fixed("recruiter_response_rate", 0.5),
        fixed("avg_response_time_hours", 0.0),
        F.expr("cast(map() as map<string,double>)").alias("skill_assessment_scores"),
        fixed("connection_count", 0),
        fixed("endorsements_received", 0),
        notice.alias("notice_period_days"),
        F.struct(low.alias("min"), high.alias("max")).alias("expected_salary_range"),
        one_of(member(v, f"{path}.preferred_work_mode"), WORK_MODES, "flexible").alias("preferred_work_mode"),
        F.coalesce(truth(v, f"{path}.willing_to_relocate"), F.lit(True)).alias("willing_to_relocate"),
        github.alias("github_activity_score"),
        fixed("search_appearance_30d", 0),
        fixed("saved_by_recruiters_30d", 0),
        fixed("interview_completion_rate", 0.5),
        fixed("offer_acceptance_rate", -1.0),
        stated("verified_email"),
        stated("verified_phone"),
        stated("linkedin_connected"),
    )


def role_block(v: Column, source: Column, path: str = "role") -> Column:
    """The role; without a title the first line of the job text is its title."""
    at = lambda k, default="": words(v, f"{path}.{k}", default).alias(k)
    n = lambda k: dates.number_or(member(v, f"{path}.ideal_experience.{k}", "double"), DEFAULT_ROLE[k])
    ideal = F.struct(n("min_years").alias("min_years"), n("max_years").alias("max_years"), n("peak_years").alias("peak_years"), F.greatest(F.lit(1.0), n("sigma_years")).alias("sigma_years"))
    title = F.coalesce(F.nullif(words(v, f"{path}.title"), F.lit("")), F.nullif(text.first_line(source), F.lit("")), F.lit("Role"))
    return F.struct(title.alias("title"), at("company"), at("domain", "general"), at("summary", "No summary."), ideal.alias("ideal_experience"), dates.clamp_int(F.floor(member(v, f"{path}.notice_preference_days", "double")), 0, 365, DEFAULT_ROLE["notice_days"]).alias("notice_preference_days"))


def string_list(v: Column, path: str) -> Column:
    return text.lower_list(F.coalesce(F.try_variant_get(v, f"$.{path}", "array<string>"), F.expr("cast(array() as array<string>)")))


def locations(v: Column, path: str = "locations") -> Column:
    yes = lambda k, default: F.coalesce(member(v, f"{path}.{k}", "boolean"), F.lit(default)).alias(k)
    return F.struct(string_list(v, f"{path}.preferred").alias("preferred"), string_list(v, f"{path}.acceptable").alias("acceptable"), yes("relocation_acceptable", True), yes("remote_acceptable", False))


def signal_list(v: Column, path: str = "signals") -> Column:
    """Signals with a label and a query, each under an identifier of its own; weights are 0 or more, 0.1 if missing.

    Patterns are kept as they are: check_patterns() on the driver nulls the bad ones.
    """
    raw = F.filter(items(v, path), lambda s: F.coalesce(words(s, "label"), words(s, "query"), words(s, "id")) != "")
    label = lambda s: F.coalesce(F.nullif(words(s, "label"), F.lit("")), F.nullif(words(s, "id"), F.lit("")), words(s, "query"))
    ids = text.unique_slugs(F.transform(raw, lambda s: F.coalesce(F.nullif(words(s, "id"), F.lit("")), label(s))))

    def entry(s: Column, i: Column) -> Column:
        return F.struct(F.get(ids, i).alias("id"), label(s).alias("label"), F.coalesce(F.nullif(words(s, "query"), F.lit("")), label(s)).alias("query"), F.nullif(words(s, "evidence_regex"), F.lit("")).alias("evidence_regex"), F.greatest(F.lit(0.0), dates.number_or(member(s, "dense_weight", "double"), 0.1)).alias("dense_weight"))

    return F.transform(raw, entry)


def domain(v: Column, path: str = "domain") -> Column:
    lst = lambda k: F.when(F.size(string_list(v, f"{path}.{k}")) > 0, string_list(v, f"{path}.{k}")).otherwise(F.array(*(F.lit(x) for x in DEFAULT_DOMAIN[k])))
    rx = lambda k, terms: F.coalesce(F.nullif(words(v, f"{path}.{k}"), F.lit("")), F.nullif(text.any_of(string_list(v, f"{path}.{terms}")), F.lit("")), F.lit(DEFAULT_DOMAIN[k]))
    return F.struct(lst("in_domain_terms").alias("in_domain_terms"), lst("out_of_domain_terms").alias("out_of_domain_terms"), rx("in_domain_regex", "in_domain_terms").alias("in_domain_regex"), rx("out_of_domain_regex", "out_of_domain_terms").alias("out_of_domain_regex"))


def red_flags(v: Column, path: str = "red_flags") -> Column:
    """Exactly the four flags: {enabled: ...}, a plain boolean, or the default."""
    return F.struct(*(F.struct(F.coalesce(member(v, f"{path}.{k}.enabled", "boolean"), member(v, f"{path}.{k}", "boolean"), F.lit(d)).alias("enabled")).alias(k) for k, d in DEFAULT_FLAGS.items()))


def cross_query(role: Column, signals_: Column) -> Column:
    """One sentence on the role from the first five labels."""
    base = F.coalesce(F.nullif(role["summary"], F.lit("")), F.nullif(role["title"], F.lit("")), F.lit("the ideal candidate"))
    return F.concat(base, F.lit(" — a strong fit demonstrates "), F.array_join(F.transform(F.slice(signals_, 1, 5), lambda s: s["label"]), ", "), F.lit(", with relevant hands-on experience around "), role["domain"], F.lit("."))


def meta_of(signals_: Column, exclusions: Column, out_terms: Column) -> Column:
    """Must-haves (the four heaviest signals), nice-to-haves (the rest), and exclusions with whether a term enforces them."""
    numbered = F.transform(signals_, lambda s, i: F.struct(s["id"].alias("id"), s["label"].alias("label"), s["dense_weight"].alias("weight"), i.alias("pos")))
    told = F.transform(exclusions, lambda x: F.struct(x.alias("text"), F.exists(out_terms, lambda t: F.contains(F.lower(x), t)).alias("enforced")))
    return F.struct(heaviest(numbered, 4).alias("wanted"), told.alias("exclusions"))
