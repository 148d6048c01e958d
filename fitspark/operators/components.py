"""Components of a candidate's fit to a role, as expressions over candidate and facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitspark.config import Role
from fitspark.functions import arrays, dates, text
from fitspark.operators.intrinsic import facts, jobs, skills

COMPONENTS = ("yoe_fit", "hopper", "only_consulting", "months_since_ic_role", "cv_primary", "domain_nlp_ratio", "ai_skill_corroboration", "ai_skills_claimed", "evid_coverage", "depth_bonus", "assess_strength", "integrity", "availability_mult", "notice_pen", "loc2_v4")


def _has_any(c: Column, terms) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | c.contains(t)
    return out


def _product(*factors: Column) -> Column:
    out = F.lit(1.0)
    for f in factors:
        out = out * f
    return out


def with_chunks(candidates: DataFrame, role: Role, *, ref_date: str | None = None) -> DataFrame:
    """Add facts and `chunks`, an array of one struct for each job.

    A chunk has its text, weight for pooling, flags of context, evidence of each
    signal and what else is known of the job. Computed once; all that follows
    folds over it.
    """
    m, ref = role.method, F.to_date(F.lit(ref_date or role.method["ref_date"]))
    blank = lambda c: F.coalesce(c, F.lit(""))

    def stated(j: Column) -> Column:
        """What a job states, once: lambdas compute an expression again wherever it stands."""
        return F.struct(
            F.trim(F.concat(blank(j["title"]), F.lit(" "), blank(j["company"]), F.lit(" "), blank(j["description"]))).alias("text"),
            dates.months_since(j["end_date"], j["is_current"], ref).alias("since"),
            F.greatest(F.lit(1.0), F.coalesce(j["duration_months"], F.lit(0)).cast("double")).alias("months"),
            F.lower(blank(j["company"])).alias("company"),
            F.lower(blank(j["title"])).alias("title"),
        )

    def chunk(j: Column) -> Column:
        found = {k: text.flag(j["text"], m["context"][k]) == 1.0 for k in ("internal", "owner", "scale")}
        return F.struct(
            j["text"].alias("text"),
            j["since"].alias("since"),
            (dates.half_life(j["since"], m["pool_half_life"]) * F.sqrt(j["months"])).alias("weight"),
            _has_any(j["company"], m["consulting"]).alias("consulting"),
            (_has_any(j["title"], m["ic_tokens"]) & ~_has_any(j["title"], m["mgmt_tokens"])).alias("hands_on"),
            *(c.alias(k) for k, c in found.items()),
            dates.half_life(j["since"], m["evidence_half_life"]).alias("recent"),
            F.array(*(text.flag(j["text"], s.evidence_regex) for s in role.signals)).alias("hits"),
        )

    def judged(c: Column) -> Column:
        d = m["context_damps"]
        mods = F.when(c["internal"], d["internal"]).otherwise(1.0) * F.when(c["owner"], 1.0).otherwise(d["no_owner"]) * F.when(c["scale"], 1.0).otherwise(d["no_scale"]) * c["recent"]
        depth = F.when(~c["internal"] & c["owner"] & c["scale"], c["recent"]).otherwise(0.0)
        return F.struct(*(c[k].alias(k) for k in ("text", "since", "weight", "consulting", "hands_on")), mods.alias("mods"), depth.alias("depth"), c["hits"].alias("hits"))

    with_facts = candidates.select("*", *(c.alias(k) for k, c in facts().items()))
    head = F.trim(F.concat(blank(F.col("profile.headline")), F.lit(" "), blank(F.col("profile.summary"))))
    out = with_facts.withColumn("head", head).withColumn("names", F.transform(skills(), lambda s: F.lower(F.coalesce(s["name"], F.lit("")))))
    # Three steps, so that each text is built once and searched once for each pattern.
    out = out.withColumn("chunks", F.transform(F.transform(F.transform(jobs(), stated), chunk), judged))
    joined = F.array_join(F.transform("chunks", lambda c: c["text"]), " ")
    return out.withColumn("career_text", joined).withColumn("all_text", F.concat_ws(" ", "head", "career_text", F.array_join("names", " ")))


def _integrity(role: Role) -> Column:
    i = role.method["integrity"]
    months, yoe = F.col("career_months"), F.col("yoe")
    claimed = text.years_claimed(F.col("head"))
    hard = [
        (months > 0) & (months / 12 > yoe + i["career_slack_years"]),
        F.col("max_role_months") / 12 > yoe + i["role_slack_years"],
        (months > 0) & (yoe * 12 > months * i["yoe_ratio"] + i["yoe_slack_months"]),
        F.coalesce(F.abs(yoe - claimed) > i["summary_tolerance"], F.lit(False)),
        F.col("n_expert_zero_dur") >= 1,
        F.col("n_expert") >= i["too_many_expert"],
    ]
    longer = F.size(F.filter(skills(), lambda s: F.coalesce(s["duration_months"], F.lit(0)) > F.col("career_months") * i["skill_ratio"] + i["skill_slack_months"]))
    soft = [
        F.when((months > 0) & (longer >= i["skill_least"]), 1 - F.least(F.lit(i["skill_most_penalty"]), i["skill_penalty"] * longer)).otherwise(1.0),
        F.when(F.col("salary_min") > F.col("salary_max"), i["salary_inverted"]).otherwise(1.0),
        F.when(F.col("anach") == 1, i["anachronism"]).otherwise(1.0),
        F.when((F.col("last_active_date") != "") & (F.col("signup_date") != "") & (F.col("last_active_date") < F.col("signup_date")), i["active_before_signup"]).otherwise(1.0),
        F.when(F.col("concurrent_deg") == 1, i["concurrent_degrees"]).otherwise(1.0),
    ]
    return _product(*(F.when(h, i["hard"]).otherwise(1.0) for h in hard), *soft)


def idle_months(role: Role, ref_date: str | None) -> Column:
    day = dates.parse_date(F.nullif(F.col("last_active_date"), F.lit("")))
    idle = F.greatest(F.lit(0.0), dates.months(day, F.to_date(F.lit(ref_date or role.method["ref_date"]))))
    return F.when(day.isNotNull(), idle).otherwise(role.method["availability"]["default_months"])


def response(role: Role) -> tuple[Column, Column]:
    """Whether a candidate is dormant, and whether one responds rarely."""
    a, rate = role.method["availability"], F.col("recruiter_response_rate")
    low = F.when(rate < 0, 1.0).otherwise(rate) < a["low_response"]
    return (F.col("idle") > a["dormant_months"]) & low, low


def _availability(role: Role) -> Column:
    a = role.method["availability"]
    raw = (
        a["recency"] * F.exp(-F.col("idle") / a["decay_months"])
        + a["response"] * F.greatest(F.lit(0.0), F.col("recruiter_response_rate"))
        + a["open_to_work"] * F.col("open_to_work_flag")
        + a["interview"] * F.col("interview_completion_rate")
        + a["completeness"] * F.col("profile_completeness_score") / 100
    )
    dormant, low = response(role)
    return (a["base"] + a["span"] * raw) * F.when(dormant, a["dormant_damp"]).when(low, a["low_response_damp"]).otherwise(1.0)


def _location(role: Role) -> Column:
    s, place = role.method["location"], F.col("location")
    preferred, acceptable = _has_any(place, role.preferred), _has_any(place, role.acceptable)
    home = _has_any(place, role.method["home_markers"])
    moving = (F.col("willing_to_relocate") == 1) & F.lit(role.relocation)
    base = F.when(preferred, s["preferred"]).when(acceptable, s["acceptable"]).when(home & moving, s["home_relocating"]).when(home, s["home"]).when(moving, s["abroad_relocating"]).otherwise(s["abroad"])
    remote = F.col("remote_pref") == 1
    capped = F.when(remote & (F.col("willing_to_relocate") == 0) & ~preferred & ~acceptable, F.least(base, F.lit(s["remote_cap"]))).otherwise(base)
    return capped * F.when(remote, s["remote_damp"]).otherwise(1.0)


def with_components(candidates: DataFrame, role: Role, *, ref_date: str | None = None) -> DataFrame:
    """Add the facts, chunks, evidence of each signal and the fifteen components."""
    out = with_chunks(candidates, role, ref_date=ref_date).withColumn("idle", idle_months(role, ref_date))
    regexes = [k for k, s in enumerate(role.signals) if s.evidence_regex is not None]

    def best(k: int) -> Column:
        return F.coalesce(F.array_max(F.transform("chunks", lambda c: F.get(c["hits"], F.lit(k)) * c["mods"])), F.lit(0.0))

    evidence = [best(k) for k in range(len(role.signals))]
    out = out.withColumn("evidence", F.array(*evidence))
    n_in, n_out = text.count_matches(F.col("career_text"), role.in_regex), text.count_matches(F.col("career_text"), role.out_regex)
    prose = F.lower(F.concat_ws(" ", "head", "career_text"))
    claimed = F.filter("names", lambda n: _has_any(n, role.method["ai_terms"]))
    supported = F.filter(claimed, lambda n: F.exists(F.filter(F.split(n, "[^a-z]+"), lambda w: F.length(w) >= 4), lambda w: F.contains(prose, F.substring(w, 1, 5))))
    scores = F.map_values(F.map_filter(F.coalesce(F.col("signals.skill_assessment_scores"), F.expr("cast(map() as map<string,double>)")), lambda k, v: (text.flag(k, role.skill_regex) == 1.0) & v.isNotNull()))
    a = role.method["assessment"]
    hands_on = F.filter("chunks", lambda c: c["hands_on"])
    coverage = F.lit(0.0)
    for k in regexes:
        coverage = coverage + F.get("evidence", F.lit(k))
    number = lambda c: c.cast("double")
    parts = {
        "yoe_fit": dates.gaussian(F.col("yoe"), role.peak_years, role.sigma_years),
        "hopper": number((F.col("n_jobs") >= role.method["hopper"]["jobs"]) & (F.col("avg_tenure_months") < role.method["hopper"]["tenure"])),
        "only_consulting": number((F.col("n_jobs") > 0) & F.forall("chunks", lambda c: c["consulting"])),
        "months_since_ic_role": F.coalesce(F.array_min(F.transform(hands_on, lambda c: c["since"])), F.lit(999.0)),
        "cv_primary": number((n_out >= 3) & (n_out > n_in)),
        "domain_nlp_ratio": text.domain_ratio(F.col("all_text"), role.in_terms, role.out_terms),
        "ai_skill_corroboration": F.size(supported) / (F.size(claimed) + 1.0),
        "ai_skills_claimed": F.size(claimed),
        "evid_coverage": coverage / max(1, len(regexes)),
        "depth_bonus": F.coalesce(F.array_max(F.transform("chunks", lambda c: c["depth"])), F.lit(0.0)),
        "assess_strength": arrays.shrunk_top_mean(scores, a["top"], a["floor"], a["span"], a["shrink"]),
        "integrity": _integrity(role),
        "availability_mult": _availability(role),
        "notice_pen": dates.first_rung(F.col("notice_period_days"), role.method["notice_rungs"]),
        "loc2_v4": _location(role),
    }
    return out.select("*", *(parts[k].alias(k) for k in COMPONENTS))


def compute_components(candidates: DataFrame, role: Role, *, ref_date: str | None = None) -> DataFrame:
    return with_components(candidates, role, ref_date=ref_date).select("candidate_id", *COMPONENTS)
