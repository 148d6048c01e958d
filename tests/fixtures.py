"""Candidates and a role, written for the tests, with the components that they must have."""

from __future__ import annotations


def job(title, company, start, end, months, text, current=False):
    return {"company": company, "title": title, "start_date": start, "end_date": end, "duration_months": months, "is_current": current, "industry": "Software", "company_size": "51-200", "description": text}


def signals(**changed):
    base = {
        "profile_completeness_score": 90, "signup_date": "2022-01-01", "last_active_date": "2026-06-01", "open_to_work_flag": True, "profile_views_received_30d": 1, "applications_submitted_30d": 1,
        "recruiter_response_rate": 0.9, "avg_response_time_hours": 1, "skill_assessment_scores": {}, "connection_count": 1, "endorsements_received": 1, "notice_period_days": 15,
        "expected_salary_range": {"min": 10, "max": 20}, "preferred_work_mode": "hybrid", "willing_to_relocate": True, "github_activity_score": 10, "search_appearance_30d": 1, "saved_by_recruiters_30d": 1,
        "interview_completion_rate": 0.95, "offer_acceptance_rate": 0.5, "verified_email": True, "verified_phone": True, "linkedin_connected": True,
    }
    return base | changed


def candidate(cid, yoe, place, country, jobs, sig, headline="", summary="", skills=(), **more):
    return {"candidate_id": cid, "profile": {"anonymized_name": cid, "headline": headline, "summary": summary, "location": place, "country": country, "years_of_experience": yoe}, "career_history": list(jobs), "skills": list(skills), "signals": sig} | more


ROLE = {
    "schema_version": 1,
    "role": {"title": "Service Engineer", "company": "Example", "domain": "services", "summary": "Builds services.", "ideal_experience": {"min_years": 2, "max_years": 8, "peak_years": 4.0, "sigma_years": 3.0}, "notice_preference_days": 60},
    "locations": {"preferred": ["remote city"], "acceptable": ["bengaluru", "dublin"], "relocation_acceptable": True, "remote_acceptable": True},
    "signals": [
        {"id": "services", "label": "builds services", "query": "building and running large services", "evidence_regex": "service|api", "dense_weight": 0.3},
        {"id": "incidents", "label": "solves incidents", "query": "solving production incidents on call", "evidence_regex": "incident|on[- ]call", "dense_weight": 0.22},
        {"id": "payments", "label": "payments", "query": "ledgers payments money", "evidence_regex": "payment|ledger", "dense_weight": 0.14},
        {"id": "cloud", "label": "cloud", "query": "cloud containers kubernetes", "evidence_regex": r"docker|kubernetes|\baws\b", "dense_weight": 0.12},
        {"id": "mentoring", "label": "mentoring", "query": "mentoring engineers", "evidence_regex": "mentor|collaborat", "dense_weight": 0.1},
        {"id": "coding", "label": "coding", "query": "strong programming in any language", "evidence_regex": None, "dense_weight": 0.08},
    ],
    "dense_extras": {"yoe_fit_weight": 0.1, "domain_ratio_weight": 0.08},
    "cross_encoder_query": "",
    "domain": {"in_domain_terms": ["service", "backend"], "out_of_domain_terms": ["sales", "marketing"], "in_domain_regex": "service|backend", "out_of_domain_regex": r"\bsales\b|marketing"},
    "relevant_skill_regex": "design|sql",
    "red_flags": {"cv_primary": {"enabled": False}, "job_hopper": {"enabled": True}, "only_consulting": {"enabled": True}, "stale_ic_role": {"enabled": True}},
}

CANDIDATES = [
    # In domain: 11 literal terms and none outside give 12/13; all five patterns hit the current job, without figures of scale: 0.85.
    candidate(
        "STRONG", 5, "Bengaluru", "India",
        [
            job("Engineer", "Paywell", "2023-01-01", None, 30, "Designed backend service after backend service. Led on-call for payment incidents; mentored. Docker.", True),
            job("Engineer", "Shopwell", "2020-06-01", "2022-12-01", 30, "Backend service work, backend service tests."),
        ],
        signals(skill_assessment_scores={"service design": 85, "sql": 80}), "Engineer", "backend service, service",
    ),
    # One pattern of five hits, in an internal project that nobody owned: 0.4 * 0.7 * 0.85 / 5.
    candidate(
        "BORDERLINE", 2, "Dublin", "Ireland",
        [job("Developer", "Midway", "2024-12-01", None, 18, "An internal tool for a service.", True), job("Developer", "Midway", "2023-06-01", "2024-11-01", 17, "More of it: backend and backend.")],
        signals(profile_completeness_score=60, last_active_date="2026-04-01", recruiter_response_rate=0.4, interview_completion_rate=0.5, notice_period_days=45, willing_to_relocate=False), "Developer", "backend, backend",
    ),
    # Five short stints at consulting firms, all in sales and marketing: 16 literal terms outside and none inside give 1/18.
    candidate(
        "WEAK", 6, "Remote City", "Unknown",
        [job("Consultant", firm, "2020-01-01", f"20{20 + i}-06-01", months, text) for i, (firm, months, text) in enumerate([("TCS", 5, "sales and marketing, sales"), ("Infosys", 6, "sales and marketing, sales"), ("Wipro", 6, "sales, marketing, sales"), ("HCL Tech", 6, "sales, marketing, sales"), ("Accenture", 5, "sales, marketing, sales")])],
        signals(profile_completeness_score=20, last_active_date="2025-01-01", open_to_work_flag=False, recruiter_response_rate=0.05, interview_completion_rate=0.1, notice_period_days=150, preferred_work_mode="remote", willing_to_relocate=False), "sales", "",
    ),
]

_NAMES = "yoe_fit hopper only_consulting months_since_ic_role cv_primary domain_nlp_ratio ai_skill_corroboration ai_skills_claimed evid_coverage depth_bonus assess_strength integrity availability_mult notice_pen loc2_v4".split()
EXPECTED = {
    "STRONG": dict(zip(_NAMES, [0.9459594689067654, 0, 0, 0, 0, 0.9230769230769231, 0, 0, 0.85, 0, 0.68, 1, 1.068746940194433, 1, 0.9])),
    "BORDERLINE": dict(zip(_NAMES, [0.8007374029168081, 0, 0, 0, 0, 0.8571428571428571, 0, 0, 0.0476, 0, 0, 1, 0.8773493277382036, 1, 0.9])),
    "WEAK": dict(zip(_NAMES, [0.8007374029168081, 1, 1, 999, 1, 0.05555555555555555, 0, 0, 0, 0, 0, 0.05, 0.2702565421829995, 0.85, 0.9])),
}
