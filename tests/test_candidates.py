import copy
import json
import random

import pytest
from fixtures import CANDIDATES, EXPECTED, ROLE, candidate, job, signals
from pyspark.sql import functions as F

from fitspark.config import ProfileError, load_role, parity, role_of, structural, to_yaml
from fitspark.embedding import DigestEmbedding, HashEmbedding
from fitspark.operators.components import COMPONENTS, compute_components
from fitspark.operators.intrinsic import INTRINSIC_COLUMNS, candidates_of, extract_intrinsic
from fitspark.operators.score import score_candidates

ROLE_OBJECT = role_of(ROLE)


def frame(spark, records):
    return candidates_of(spark.createDataFrame([(json.dumps(r),) for r in records], "candidate_json string"))


def components(spark, *records, role=ROLE_OBJECT):
    return {r["candidate_id"]: r for r in compute_components(frame(spark, records), role).collect()}


@pytest.fixture(scope="module")
def golden(spark):
    return components(spark, *CANDIDATES)


@pytest.mark.parametrize("cid", sorted(EXPECTED))
def test_golden_components(golden, cid):
    assert {k: golden[cid][k] for k in COMPONENTS} == pytest.approx(EXPECTED[cid], abs=1e-6)


def test_facts(spark):
    rows = extract_intrinsic(frame(spark, CANDIDATES))
    assert tuple(rows.columns) == ("candidate_id", *INTRINSIC_COLUMNS) and len(INTRINSIC_COLUMNS) == 37
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


BASE = dict(yoe=5, place="Nowhere", country="Atlantis", jobs=[job("Engineer", "Firm", "2021-06-06", None, 60, "service", True)], sig=signals())


def made(cid="X", sig=None, **changed):
    args = BASE | changed
    return candidate(cid, args.pop("yoe"), args.pop("place"), args.pop("country"), args.pop("jobs"), signals(**(sig or {})), **{k: v for k, v in args.items() if k != "sig"})


@pytest.mark.parametrize(
    "component, want, changed",
    [
        ("integrity", 1.0, {}),
        ("integrity", 0.97, {"sig": {"expected_salary_range": {"min": 30, "max": 20}}}),
        ("integrity", 0.30, {"certifications": [{"name": "LangChain Pro", "issuer": "x", "year": 2020}]}),
        ("integrity", 1.0, {"certifications": [{"name": "LangChain Pro", "issuer": "x", "year": 0}]}),
        ("integrity", 0.97, {"sig": {"signup_date": "2026-06-02"}}),
        ("integrity", 0.93, {"education": [{"start_year": 2010, "end_year": 2014}, {"start_year": 2010, "end_year": 2014}]}),
        ("integrity", 0.92, {"skills": [{"name": "a", "duration_months": 90}, {"name": "b", "duration_months": 90}]}),
        ("integrity", 1.0, {"skills": [{"name": "a", "duration_months": 90}]}),
        ("integrity", 0.05, {"skills": [{"name": "a", "proficiency": "expert", "duration_months": 0}]}),
        ("integrity", 0.05, {"skills": [{"name": "a", "proficiency": "expert", "duration_months": None}]}),
        ("integrity", 1.0, {"skills": [{"name": "a", "proficiency": "expert"}]}),
        ("integrity", 0.05, {"skills": [{"name": str(i), "proficiency": "expert", "duration_months": 5} for i in range(8)]}),
        ("integrity", 0.05, {"summary": "9 years of experience"}),
        ("integrity", 0.05**2, {"yoe": 0.5}),
        ("loc2_v4", 0.50, {}),
        ("loc2_v4", 0.12, {"sig": {"willing_to_relocate": False}}),
        ("loc2_v4", 0.75, {"country": "India"}),
        ("loc2_v4", 0.33, {"country": "India", "sig": {"willing_to_relocate": False}}),
        ("loc2_v4", 0.25 * 0.9, {"country": "India", "sig": {"willing_to_relocate": False, "preferred_work_mode": "remote"}}),
        ("notice_pen", 0.93, {"sig": {"notice_period_days": 119}}),
        ("notice_pen", 0.90, {"sig": {"notice_period_days": 120}}),
        ("depth_bonus", 1.0, {"jobs": [job("Engineer", "Firm", "2021-06-06", None, 60, "led a service for 3 million people", True)]}),
        ("ai_skills_claimed", 2, {"skills": [{"name": "PyTorch"}, {"name": "vector search"}]}),
        ("ai_skill_corroboration", 1 / 3, {"skills": [{"name": "PyTorch"}, {"name": "vector search"}], "headline": "pytorch user"}),
        ("evid_coverage", 0.0, {"jobs": []}),
        ("months_since_ic_role", 999.0, {"jobs": []}),
        ("months_since_ic_role", 0.0, {"jobs": [job("Engineer", "Firm", "2021-01-01", "2030-01-01", 60, "x")]}),
        ("only_consulting", 0.0, {"jobs": []}),
    ],
)
def test_single_rules(spark, component, want, changed):
    assert components(spark, made(**changed))["X"][component] == pytest.approx(want, abs=1e-9)


def test_low_response_without_dormancy(spark):
    calm, rare, dormant = (components(spark, made(sig=s))["X"]["availability_mult"] for s in ({"recruiter_response_rate": 0.2}, {"recruiter_response_rate": 0.19}, {"recruiter_response_rate": 0.19, "last_active_date": "2025-06-06"}))
    assert dormant < rare < calm
    missing = components(spark, made(sig={"recruiter_response_rate": None}))["X"]["availability_mult"]
    assert missing == pytest.approx(components(spark, made(sig={"recruiter_response_rate": 0.0}))["X"]["availability_mult"] / 0.8)


def test_unknown_activity_counts_as_twelve_months(spark):
    unknown, year = (components(spark, made(sig={"last_active_date": d}))["X"]["availability_mult"] for d in ("2025-02-31", "2025-06-06"))
    assert unknown == pytest.approx(year)


def test_strong_above_borderline_above_weak(spark):
    got = {r["candidate_id"]: r for r in score_candidates(frame(spark, CANDIDATES), ROLE_OBJECT, HashEmbedding()).collect()}
    assert got["STRONG"]["overall"] > got["BORDERLINE"]["overall"] > got["WEAK"]["overall"] >= 0
    weak = got["WEAK"]["fit"]
    assert weak["red_flags"] == ["job_hopper", "only_consulting", "stale_ic_role"]
    assert [g["name"] for g in weak["gates"]] == ["integrity", "availability", "notice", "location"]
    assert any("notice period of 150 days" in g for g in weak["gaps"]) and any("contradict" in g for g in weak["gaps"])
    assert len(weak["per_signal"]) == 6 and weak["role_title"] == "Service Engineer"


def test_scores_do_not_depend_on_the_pool(spark):
    alone = {r["candidate_id"]: r["overall"] for c in CANDIDATES for r in score_candidates(frame(spark, [c]), ROLE_OBJECT, HashEmbedding()).collect()}
    crowd = [*CANDIDATES, *(made(f"N{i}") for i in range(20))]
    random.Random(1).shuffle(crowd)
    pooled = {r["candidate_id"]: r["overall"] for r in score_candidates(frame(spark, crowd), ROLE_OBJECT, HashEmbedding()).collect()}
    assert {k: pooled[k] for k in alone} == alone


def test_scoring_does_not_shuffle(spark):
    rows = score_candidates(frame(spark, CANDIDATES), ROLE_OBJECT, HashEmbedding())
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_empty_and_broken_records(spark):
    got = frame(spark, [{"candidate_id": "E"}]).union(candidates_of(spark.createDataFrame([("not json",), (None,)], "candidate_json string")))
    rows = score_candidates(got, ROLE_OBJECT, HashEmbedding()).collect()
    assert len(rows) == 3 and all(0 <= r["overall"] <= 100 for r in rows)


def test_prefixed_keys_are_read(spark):
    record = json.dumps(CANDIDATES[0]).replace('"signals":', '"some_signals":').replace('"expected_salary_range":', '"expected_salary_range_lpa":')
    got = candidates_of(spark.createDataFrame([(record,)], "candidate_json string")).select("signals.notice_period_days", "signals.expected_salary_range.max").first()
    assert tuple(got) == (15, 20.0)


@pytest.mark.parametrize(
    "path, value, named",
    [("role.title", "", "role.title"), ("role.ideal_experience.sigma_years", 0, "sigma_years"), ("signals", [], "signals"), ("extra", 1, "extra"), ("relevant_skill_regex", "(", "relevant_skill_regex"), ("red_flags", {"other": {"enabled": True}}, "red_flags.other"), ("locations.preferred", [1], "locations.preferred[0]"), ("locations.relocation_acceptable", "yes", "relocation_acceptable")],
)
def test_profile_errors_name_the_field(path, value, named):
    d = copy.deepcopy(ROLE)
    at = d
    *way, last = path.split(".")
    for k in way:
        at = at[k]
    at[last] = value
    with pytest.raises(ProfileError, match=named.replace("[", r"\[")):
        role_of(d)


def test_repeated_signal_ids_are_rejected():
    d = copy.deepcopy(ROLE)
    d["signals"].append(d["signals"][0])
    with pytest.raises(ProfileError, match="used twice"):
        role_of(d)


def test_yaml_round_trip_and_parity():
    again = load_role(to_yaml(ROLE))
    assert structural(again) == structural(ROLE_OBJECT)
    assert parity(structural(again), structural(ROLE_OBJECT)) == {"same_flags": True, "signal_count_delta": 0, "out_domain_overlap": 1.0}


def test_embeddings():
    h = HashEmbedding()
    a, b, c = h.embed(["payments ledger", "ledger for payments", "graphic design"])
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    assert dot(a, a) == pytest.approx(1) and dot(a, b) == pytest.approx(1) and abs(dot(a, c)) < 0.6
    assert h.embed([""]) == [[0.0] * 64]
    assert dot(*DigestEmbedding().embed(["a", "a"])) == pytest.approx(1)


def test_first_embeddings_are_in_the_reported_order(spark):
    rows = score_candidates(frame(spark, CANDIDATES[:1]), ROLE_OBJECT, HashEmbedding()).select(F.col("fit.per_signal.id").alias("ids")).first()
    assert rows["ids"] == [s["id"] for s in ROLE["signals"]]


def test_constants_can_be_changed_for_a_role(spark):
    mild = role_of(ROLE, {"integrity": {"hard": 0.5}, "notice_rungs": [[10, 1.0], [1000, 0.5]]})
    got = {r["candidate_id"]: r for r in compute_components(frame(spark, CANDIDATES), mild).collect()}
    assert got["WEAK"]["integrity"] == 0.5 and got["STRONG"]["notice_pen"] == 0.5
    for changes, named in (({"integrity": {"soft": 1}}, "integrity.soft"), ({"integrity": 1}, "integrity"), ({"pool_half_life": "x"}, "pool_half_life"), ({"context": {"owner": "("}}, "context.owner")):
        with pytest.raises(ProfileError, match=named):
            role_of(ROLE, changes)


def test_lines_are_collected_once_and_searched_once(spark):
    from fitspark.plans import candidates as plans

    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        plan = plans.candidate_components(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("collect_list(") == 1 and plan.count("internal (?:knowledge base") == 1
