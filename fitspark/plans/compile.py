"""Texts into candidates and role profiles: ask for parts, coerce them, check, repair, and fall back on defaults."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitspark.backends import MockBackend, TextBackend, ask
from fitspark.config import METHOD, Role, role_of
from fitspark.dialect import safe_pattern
from fitspark.functions.jsonx import tolerant_json
from fitspark.operators import coerce
from fitspark.operators.validate import candidate_violations
from fitspark.sources.sections import snippet, with_sections


@dataclass(frozen=True)
class Part:
    """A block of an artifact: what to ask, the sections to show, and how to make it of the answer."""

    name: str
    question: str
    sections: tuple[str, ...]
    build: Callable[[Column, Column, Column], Column]
    head: int = 0
    kind: str = "OBJECT"


def _ref(ref_date: str | None) -> Column:
    return F.to_date(F.lit(ref_date or METHOD["ref_date"]))


CANDIDATE_PARTS = (
    Part("profile", "From the resume give {\"profile\": {anonymized_name, headline, summary, location, country, years_of_experience, current_title, current_company, current_company_size, current_industry}, \"projects\": [text]}.", (), lambda v, t, r: coerce.with_projects(coerce.profile(v), coerce.string_list(v, "projects")), 6000),
    Part("career_history", "From the resume give {\"career_history\": [{company, title, start_date, end_date, is_current, duration_months, industry, company_size, description}]}, positions only, no projects.", (), lambda v, t, r: coerce.career(v, r), 6000, "ARRAY"),
    Part("education", "From the resume give {\"education\": [{institution, degree, field_of_study, start_year, end_year, grade, tier}]}.", (), lambda v, t, r: coerce.education(v), 6000, "ARRAY"),
    Part("skills", "From the resume give {\"skills\": [{name, proficiency, endorsements, duration_months}]}.", (), lambda v, t, r: coerce.skills(v), 6000, "ARRAY"),
    Part("signals", "From the resume give {\"signals\": {notice_period_days, preferred_work_mode, willing_to_relocate, expected_salary_range}}, only what it states.", (), lambda v, t, r: coerce.signals(v, t, r), 6000),
)

ROLE_PARTS = (
    Part("role", "From the job text give {\"role\": {title, company, domain, summary, ideal_experience: {min_years, max_years, peak_years, sigma_years}, notice_preference_days}}.", ("about", "responsibilities"), lambda v, t, r: coerce.role_block(v, t), 400),
    Part("locations", "From the job text give {\"locations\": {preferred, acceptable, relocation_acceptable, remote_acceptable}}.", ("location",), lambda v, t, r: coerce.locations(v), 400),
    Part("signals", "From the job text give {\"signals\": [{id, label, query, evidence_regex, dense_weight}]}, what a candidate must show.", ("responsibilities", "qualifications"), lambda v, t, r: coerce.signal_list(v), kind="ARRAY"),
    Part("domain", "From the job text give {\"domain\": {in_domain_terms, out_of_domain_terms, in_domain_regex, out_of_domain_regex}}.", ("qualifications",), lambda v, t, r: coerce.domain(v)),
    Part("relevant_skill_regex", "From the job text give {\"relevant_skill_regex\": pattern} that matches the skills asked for.", ("qualifications",), lambda v, t, r: F.struct(coerce.words(v, "relevant_skill_regex", coerce.DEFAULT_SKILLS).alias("pattern")), kind="STRING"),
    Part("red_flags", "From the job text give {\"red_flags\": {cv_primary, job_hopper, only_consulting, stale_ic_role}}, each true or false.", ("qualifications",), lambda v, t, r: coerce.red_flags(v)),
)


def prompts_of(texts: DataFrame, parts: tuple[Part, ...], *, key: str, column: str = "text", asked: str | None = None, hint: str | None = None) -> DataFrame:
    """(key, leaf, prompt), one row for each text and part; only the parts that the column `asked` names, with the column `hint` after the question."""
    rows = with_sections(texts, column)
    told = F.concat(F.lit("\n"), F.col(hint)) if hint else F.lit("")
    each = F.array(*(F.struct(F.lit(p.name).alias("leaf"), F.concat(F.lit(p.question), told, F.lit("\n\n"), snippet(column, *p.sections, head=p.head)).alias("prompt")) for p in parts))
    return rows.select(key, F.inline(F.filter(each, lambda e: F.array_contains(asked, e["leaf"])) if asked else each))


def compile_parts(texts: DataFrame, parts: tuple[Part, ...], backend: TextBackend, write: Callable[[DataFrame, str], DataFrame], *, key: str, column: str = "text", ref_date: str | None = None, system: str | None = None, asked: str | None = None, hint: str | None = None) -> DataFrame:
    """Ask for all parts of all texts and build the blocks.

    Returns the key, a column for each part, `defaulted` (parts that no
    answer held) and `calls` (telemetry). Answers are written by `write` before they are
    used, since a lost task would ask again.
    """
    answers = write(ask(prompts_of(texts, parts, key=key, column=column, asked=asked, hint=hint), backend, system=system), "answers")
    by = answers.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("leaf", F.coalesce("answer", F.lit(""))))).alias("_answers"), F.collect_list(F.struct("leaf", "ok", "error", "tokens", "elapsed_s")).alias("calls"))
    rows = texts.select(key, F.col(column).alias("_text")).join(by, key, "left")
    parsed = rows.select("*", *(tolerant_json(F.element_at("_answers", F.lit(p.name))).alias(f"_v_{p.name}") for p in parts))
    empty = F.parse_json(F.lit("{}"))
    of_kind = lambda p: F.coalesce(F.schema_of_variant(F.try_variant_get(f"_v_{p.name}", f"$.{p.name}", "variant")), F.lit("")).startswith(p.kind)
    missing = F.array_compact(F.array(*(F.when(~of_kind(p), F.lit(p.name)) for p in parts)))
    built = [p.build(F.coalesce(F.col(f"_v_{p.name}"), empty), F.coalesce(F.col("_text"), F.lit("")), _ref(ref_date)).alias(p.name) for p in parts]
    return parsed.select(key, *built, missing.alias("defaulted"), "calls")


def compile_candidates(texts: DataFrame, backend: TextBackend, write: Callable[[DataFrame, str], DataFrame], *, key: str = "resume_id", column: str = "text", ref_date: str | None = None, max_repairs: int = 2, rules: Column | None = None) -> DataFrame:
    """Résumé texts into candidates that satisfy every rule, or `rules`, a column of violations.

    Of a row that breaks a rule, the parts that the broken rules name are asked for
    again, with what was wrong, `max_repairs` times at most; the others stay. A part that
    then still breaks a rule is replaced by its defaults. Blocks are coerced into
    range, so a rule is broken only by what coercion does not cover. `calls` has the
    calls of all rounds.
    """
    ident = F.concat(F.lit("CAND_"), F.lpad((F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(10_000_000))).cast("string"), 7, "0"))
    names = [p.name for p in CANDIDATE_PARTS]

    def judged(rows: DataFrame) -> DataFrame:
        return write(rows.withColumn("candidate_id", ident).withColumn("violations", candidate_violations() if rules is None else rules), "attempt")

    # A broken rule names a part, or a member of one; any other is a matter of all parts.
    tops = F.transform("violations", lambda v: F.regexp_extract(v["path"], "^[a-z_]+", 0))
    failing = F.when(F.exists(tops, lambda t: ~t.isin(*names)), F.array(*(F.lit(n) for n in names))).otherwise(F.array_distinct(tops))
    wrong = F.concat(F.lit("The last answer broke these rules: "), F.array_join(F.transform("violations", lambda v: F.concat_ws(" ", v["path"], v["message"])), "; "), F.lit("."))
    got = judged(compile_parts(texts, CANDIDATE_PARTS, backend, write, key=key, column=column, ref_date=ref_date))
    out = got.where(F.size("violations") == 0)
    for i in range(max_repairs + 1):
        bad = got.where(F.size("violations") > 0)
        if bad.isEmpty():
            return out
        last = i == max_repairs
        again = bad.withColumn("_asked", failing).withColumn("_hint", wrong)
        rows = texts.select(key, column).join(again.select(key, "_asked", "_hint"), key)
        new = compile_parts(rows, CANDIDATE_PARTS, MockBackend() if last else backend, write, key=key, column=column, ref_date=ref_date, asked="_asked", hint="_hint")
        mended = again.alias("o").join(new.alias("n"), key)
        asked = lambda name: F.array_contains("o._asked", name)
        parts = [F.when(asked(n), F.col(f"n.{n}")).otherwise(F.col(f"o.{n}")).alias(n) for n in names]
        defaulted = F.array_union(F.array_except("o.defaulted", "o._asked"), F.array_intersect("n.defaulted", "o._asked"))
        got = judged(mended.select(key, *parts, defaulted.alias("defaulted"), F.concat("o.calls", "n.calls").alias("calls")))
        out = out.unionByName(got if last else got.where(F.size("violations") == 0))
    return out


#: Labels for which a call of their own gives details.
MAX_DETAIL = 7
DETAIL = Part("detail", "From the job text give, for the one requirement named last, {\"query\": a sentence to search for, \"evidence_regex\": pattern of words that prove it, \"dense_weight\": 0 to 1}.", ("responsibilities", "qualifications"), lambda v, t, r: v)


def with_details(roles: DataFrame, texts: DataFrame, backend: TextBackend, write: Callable[[DataFrame, str], DataFrame], *, key: str, column: str = "text", most: int = MAX_DETAIL) -> DataFrame:
    """Ask about each of the first `most` signals by itself; what an answer lacks stays as it is. `calls` gets the calls."""
    named = roles.select(key, F.posexplode("signals").alias("pos", "signal")).where(F.col("pos") < most)
    shown = with_sections(texts.select(key, column), column).select(key, snippet(column, *DETAIL.sections).alias("shown"))
    prompts = named.join(shown, key).select(key, "pos", F.concat(F.lit("detail:"), F.col("signal.label")).alias("leaf"), F.concat(F.lit(DETAIL.question + "\n\n"), F.col("shown"), F.lit("\n\nRequirement: "), F.col("signal.label")).alias("prompt"))
    answers = write(ask(prompts, backend), "details")
    v = tolerant_json(F.coalesce("answer", F.lit("")))
    text_of = lambda k: F.nullif(F.try_variant_get(v, f"$.{k}", "string"), F.lit(""))
    told = F.struct(text_of("query").alias("query"), text_of("evidence_regex").alias("evidence_regex"), F.greatest(F.lit(0.0), F.try_variant_get(v, "$.dense_weight", "double")).alias("dense_weight"))
    weight = F.try_variant_get(v, "$.dense_weight", "double").isNotNull()
    by = answers.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("pos", told.withField("dense_weight", F.when(weight, told["dense_weight"])).alias("told")))).alias("_told"),
        F.collect_list(F.struct("leaf", "ok", "error", "tokens", "elapsed_s")).alias("_calls"),
    )

    def detailed(s: Column, i: Column) -> Column:
        d = F.element_at("_told", i)
        return F.struct(s["id"].alias("id"), s["label"].alias("label"), F.coalesce(d["query"], s["query"]).alias("query"), F.coalesce(d["evidence_regex"], s["evidence_regex"]).alias("evidence_regex"), F.coalesce(d["dense_weight"], s["dense_weight"]).alias("dense_weight"))

    rows = roles.join(by, key, "left")
    signals = F.when(F.col("_told").isNull(), F.col("signals")).otherwise(F.transform("signals", detailed))
    return rows.withColumn("signals", signals).withColumn("calls", F.concat("calls", F.coalesce("_calls", F.expr("array()").cast(roles.schema["calls"].dataType)))).drop("_told", "_calls")


def compile_roles(texts: DataFrame, backend: TextBackend, write: Callable[[DataFrame, str], DataFrame], *, key: str = "jd_slug", column: str = "text", max_signal_detail: int = MAX_DETAIL) -> DataFrame:
    """Job texts into the blocks of role profiles: one row each, `profile_json` among the columns.

    The first `max_signal_detail` signals get a call each for their details.
    """
    got = compile_parts(texts, ROLE_PARTS, backend, write, key=key, column=column)
    if max_signal_detail:
        got = with_details(got, texts, backend, write, key=key, column=column, most=max_signal_detail)
    fallback = F.array(F.struct(F.lit("core_fit").alias("id"), F.lit("core role fit").alias("label"), F.col("role.summary").alias("query"), F.lit(None).cast("string").alias("evidence_regex"), F.lit(0.2).alias("dense_weight")))
    signals = F.when(F.size("signals") > 0, F.col("signals")).otherwise(fallback)
    got = got.withColumn("signals", signals).withColumn("cross_encoder_query", coerce.cross_query(F.col("role"), F.col("signals")))
    extras = F.struct(*(F.lit(v).alias(k) for k, v in coerce.DEFAULT_EXTRAS.items()))
    whole = F.struct(F.lit(1).alias("schema_version"), "role", "locations", "signals", extras.alias("dense_extras"), "domain", F.col("relevant_skill_regex.pattern").alias("relevant_skill_regex"), "red_flags", "cross_encoder_query")
    return got.withColumn("profile_json", F.to_json(whole, {"ignoreNullFields": "false"}))


def checked_role(profile: dict) -> tuple[Role, list[str]]:
    """A role from compiled blocks on the driver: patterns that do not compile are dropped or replaced, and named."""
    mended = []
    for s in profile.get("signals", []):
        if s.get("evidence_regex") is not None and safe_pattern(s["evidence_regex"]) is None:
            s["evidence_regex"] = None
            mended.append(f"signals.{s['id']}")
    for where, k, default in ((profile["domain"], "in_domain_regex", coerce.DEFAULT_DOMAIN["in_domain_regex"]), (profile["domain"], "out_of_domain_regex", coerce.DEFAULT_DOMAIN["out_of_domain_regex"]), (profile, "relevant_skill_regex", coerce.DEFAULT_SKILLS)):
        if safe_pattern(where.get(k)) is None:
            where[k] = default
            mended.append(k)
    return role_of(profile), mended

