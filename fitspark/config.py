"""Role profiles and the method's constants, checked when they are loaded."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any, Protocol

import yaml

from fitspark.dialect import PatternError, java_pattern

# The constants that make scores comparable, in one place.
METHOD: dict[str, Any] = {
    "ref_date": "2026-06-06",
    "pool_half_life": 18.0,
    "evidence_half_life": 30.0,
    "additive": {"dense": 0.38, "lexical": 0.09, "depth": 0.08},
    "evidence_gate": {"floor": 0.15, "span": 0.85},
    "claim": {"base": 0.5, "span": 0.5},
    "assessment_bonus": {"weight": 0.25, "full_coverage": 0.25},
    "recency_rungs": [(36, 0.35), (18, 0.70), (1.0, 0.90)],
    "experience": {"base": 0.60, "span": 0.40},
    "damps": {"cv_primary": 0.60, "hopper": 0.55, "only_consulting": 0.30, "loc_base": 0.55, "loc_span": 0.45, "loc_floor": 0.12, "loc_floor_damp": 0.60},
    "hopper": {"jobs": 4, "tenure": 19},
    "integrity": {
        "hard": 0.05,
        "career_slack_years": 3.5,
        "role_slack_years": 1.5,
        "yoe_ratio": 1.6,
        "yoe_slack_months": 18,
        "summary_tolerance": 3.0,
        "too_many_expert": 8,
        "skill_ratio": 1.25,
        "skill_slack_months": 6,
        "skill_least": 2,
        "skill_most_penalty": 0.15,
        "skill_penalty": 0.04,
        "salary_inverted": 0.97,
        "anachronism": 0.30,
        "active_before_signup": 0.97,
        "concurrent_degrees": 0.93,
    },
    "first_years": {"langchain": 2022, "llama": 2023},
    "availability": {"recency": 0.35, "response": 0.25, "open_to_work": 0.15, "interview": 0.15, "completeness": 0.10, "base": 0.5, "span": 0.6, "decay_months": 6.0, "default_months": 12.0, "dormant_months": 6, "low_response": 0.2, "dormant_damp": 0.5, "low_response_damp": 0.8},
    "notice_rungs": [(90, 1.0), (119, 0.93), (120, 0.90), (99999, 0.85)],
    "assessment": {"floor": 40.0, "span": 50.0, "shrink": 0.5, "top": 3},
    "context": {
        "internal": r"internal (?:knowledge base|dashboard|tool|search|stakeholders)|internal[- ]facing",
        "owner": r"\bled\b|\bowned?\b|designed|architected|from scratch|built (?:the|an?|our)\b|drove\b|spearhead",
        "scale": r"\d+\s?m\+|\bqps\b|queries per (?:month|second|day)|\bp9[59]\b|million|\d+k\+? (?:users|queries|docs)",
    },
    "context_damps": {"internal": 0.4, "no_owner": 0.7, "no_scale": 0.85},
    "consulting": ["tcs", "tata consultancy", "infosys", "wipro", "accenture", "cognizant", "capgemini", "tech mahindra", "hcl", "mindtree", "ltimindtree", "deloitte"],
    "ic_tokens": ["engineer", "developer", "scientist", "programmer", "sde"],
    "mgmt_tokens": ["manager", "lead", "architect", "director", "vp", "head", "principal", "consultant"],
    "ai_terms": ["nlp", "llm", "fine-tun", "embed", "machine learning", "deep learning", "recommend", "retriev", "pytorch", "mlops", "tensorflow", "transformer", "ranking", "search", "faiss", "vector", "feature engineering", "ml"],
    "home_markers": ["india", "pradesh", "maharashtra", "karnataka", "telangana", "tamil", "bengal", "kerala", "gujarat", "rajasthan", "punjab", "delhi", "haryana", "bihar", "odisha", "assam"],
    "location": {"preferred": 1.0, "acceptable": 0.9, "home_relocating": 0.75, "home": 0.33, "abroad_relocating": 0.50, "abroad": 0.12, "remote_cap": 0.25, "remote_damp": 0.9},
    "low_signal": 0.35,
}

FLAGS = ("cv_primary", "job_hopper", "only_consulting", "stale_ic_role")


class ProfileError(ValueError):
    """A role profile breaks a rule; the message names the first such field."""


@dataclass(frozen=True)
class Signal:
    id: str
    label: str
    query: str
    evidence_regex: str | None
    dense_weight: float


@dataclass(frozen=True)
class Role:
    """A role profile; lists of places and terms are in lower case."""

    title: str
    company: str
    domain: str
    summary: str
    peak_years: float
    sigma_years: float
    notice_days: int
    preferred: tuple[str, ...]
    acceptable: tuple[str, ...]
    relocation: bool
    signals: tuple[Signal, ...]
    yoe_weight: float
    domain_weight: float
    in_terms: tuple[str, ...]
    out_terms: tuple[str, ...]
    in_regex: str
    out_regex: str
    skill_regex: str
    flags: frozenset[str]
    query: str = ""
    raw: dict = field(default_factory=dict, compare=False, repr=False)
    method: dict = field(default_factory=lambda: METHOD, compare=False, repr=False)


def _fail(path: str, what: str) -> ProfileError:
    return ProfileError(f"field '{path}': {what}")


def _get(d: Any, path: str, kind: type | tuple[type, ...], default: Any = ...) -> Any:
    at = d
    for part in path.split("."):
        if not isinstance(at, dict) or part not in at:
            if default is not ...:
                return default
            raise _fail(path, "missing")
        at = at[part]
    if isinstance(at, bool) and bool not in (kind if isinstance(kind, tuple) else (kind,)) or not isinstance(at, kind):
        raise _fail(path, f"expected {getattr(kind, '__name__', 'a number')}")
    return at


NUMBER = (int, float)
KNOWN = {"schema_version", "role", "locations", "signals", "dense_extras", "cross_encoder_query", "domain", "relevant_skill_regex", "red_flags", "lexicons"}


def _strings(d: dict, path: str) -> tuple[str, ...]:
    got = _get(d, path, list, [])
    for i, x in enumerate(got):
        if not isinstance(x, str):
            raise _fail(f"{path}[{i}]", "expected str")
    return tuple(x.lower() for x in got)


def _pattern(p: Any, path: str) -> str:
    try:
        java_pattern(p)
    except (PatternError, TypeError) as e:
        raise _fail(path, str(e)) from e
    return p


def method_of(changes: dict | None) -> dict:
    """The method's constants with some changed; names and kinds of values must be those of METHOD."""

    def merged(base: dict, new: dict, path: str) -> dict:
        out = dict(base)
        for k, v in new.items():
            at = f"{path}{k}"
            if k not in base:
                raise _fail(at, "unknown key")
            if isinstance(base[k], dict) and k != "first_years":
                if not isinstance(v, dict):
                    raise _fail(at, "expected a mapping")
                out[k] = merged(base[k], v, f"{at}.")
            elif isinstance(base[k], NUMBER) and (isinstance(v, bool) or not isinstance(v, NUMBER)):
                raise _fail(at, "expected a number")
            elif isinstance(base[k], (str, list)) and not isinstance(v, type(base[k])):
                raise _fail(at, f"expected {type(base[k]).__name__}")
            else:
                out[k] = [tuple(x) for x in v] if k.endswith("_rungs") else _pattern(v, at) if path == "context." else v
        return out

    return merged(METHOD, changes or {}, "")


def role_of(d: dict, method: dict | None = None) -> Role:
    """Check a role profile and turn it into a Role. Unknown keys and repeated signal ids are errors, too.

    `method` has changes to the method's constants for this role.
    """
    if not isinstance(d, dict):
        raise _fail("profile", "expected a mapping")
    for key in d:
        if key not in KNOWN:
            raise _fail(key, "unknown key")
    for path in ("role.title", "role.summary"):
        if not _get(d, path, str).strip():
            raise _fail(path, "empty")
    sigma = float(_get(d, "role.ideal_experience.sigma_years", NUMBER))
    if sigma <= 0:
        raise _fail("role.ideal_experience.sigma_years", "must be above 0")
    signals, seen = [], set()
    for i, s in enumerate(_get(d, "signals", list)):
        at = f"signals[{i}]"
        if not isinstance(s, dict):
            raise _fail(at, "expected a mapping")
        for k in ("id", "label", "query"):
            if not isinstance(s.get(k), str) or not s[k].strip():
                raise _fail(f"{at}.{k}", "missing or empty")
        if not re.fullmatch(r"[a-z][a-z0-9_]*", s["id"]):
            raise _fail(f"{at}.id", "must be a lower-case identifier")
        if s["id"] in seen:
            raise _fail(f"{at}.id", "used twice")
        seen.add(s["id"])
        weight = s.get("dense_weight")
        if isinstance(weight, bool) or not isinstance(weight, NUMBER) or weight < 0:
            raise _fail(f"{at}.dense_weight", "must be a number of 0 or more")
        regex = s.get("evidence_regex")
        signals.append(Signal(s["id"], s["label"], " ".join(s["query"].split()), None if regex is None else _pattern(regex, f"{at}.evidence_regex") or None, float(weight)))
    if not signals:
        raise _fail("signals", "must not be empty")
    flags = _get(d, "red_flags", dict, {})
    for k, v in flags.items():
        if k not in FLAGS or not isinstance(v, dict) or not isinstance(v.get("enabled"), bool):
            raise _fail(f"red_flags.{k}", "expected one of the known flags with enabled true or false")
    return Role(
        title=d["role"]["title"],
        company=_get(d, "role.company", str, ""),
        domain=_get(d, "role.domain", str, ""),
        summary=d["role"]["summary"],
        peak_years=float(_get(d, "role.ideal_experience.peak_years", NUMBER)),
        sigma_years=sigma,
        notice_days=int(_get(d, "role.notice_preference_days", NUMBER, 60)),
        preferred=_strings(d, "locations.preferred"),
        acceptable=_strings(d, "locations.acceptable"),
        relocation=_get(d, "locations.relocation_acceptable", bool, True),
        signals=tuple(signals),
        yoe_weight=float(_get(d, "dense_extras.yoe_fit_weight", NUMBER, 0.0)),
        domain_weight=float(_get(d, "dense_extras.domain_ratio_weight", NUMBER, 0.0)),
        in_terms=_strings(d, "domain.in_domain_terms"),
        out_terms=_strings(d, "domain.out_of_domain_terms"),
        in_regex=_pattern(_get(d, "domain.in_domain_regex", str), "domain.in_domain_regex"),
        out_regex=_pattern(_get(d, "domain.out_of_domain_regex", str), "domain.out_of_domain_regex"),
        skill_regex=_pattern(_get(d, "relevant_skill_regex", str), "relevant_skill_regex"),
        flags=frozenset(k for k, v in flags.items() if v["enabled"]),
        query=_get(d, "cross_encoder_query", str, ""),
        raw=d,
        method=method_of(method),
    )


@dataclass(frozen=True)
class Verdict:
    """What a validator says: the whole message, the field that it names, and the block of that field."""

    ok: bool
    error: str | None = None
    field: str | None = None
    top: str | None = None


class Validator(Protocol):
    """What compilation checks an artifact with; it changes nothing."""

    def validate(self, d: dict) -> Verdict: ...


def named_field(error: str | None) -> tuple[str | None, str | None]:
    """The field that a message names in quotes, and its first part; none without one."""
    found = re.search("field '([^']+)'", error or "")
    return (found[1], re.split(r"[.\[]", found[1], maxsplit=1)[0]) if found else (None, None)


class ProfileValidator:
    """Role profiles, by the rules that loading them applies."""

    def __init__(self, method: dict | None = None) -> None:
        self.method = method

    def validate(self, d: dict) -> Verdict:
        try:
            role_of(d, self.method)
        except ProfileError as e:
            return Verdict(False, str(e), *named_field(str(e)))
        return Verdict(True)


def load_role(text: str, method_text: str | None = None) -> Role:
    """A role profile in YAML, and changes to the method's constants in YAML."""
    try:
        return role_of(yaml.safe_load(text), yaml.safe_load(method_text) if method_text else None)
    except yaml.YAMLError as e:
        raise ProfileError(f"field 'profile': not YAML: {e}") from e


def to_yaml(d: dict) -> str:
    return yaml.safe_dump(d, sort_keys=False, allow_unicode=True, width=100)


def structural(role: Role) -> dict:
    """What two profiles of a role are compared by."""
    return {
        "n_signals": len(role.signals),
        "signal_ids": sorted(s.id for s in role.signals),
        "notice_days": role.notice_days,
        "peak_years": role.peak_years,
        "flags": sorted(role.flags),
        "out_terms": sorted(role.out_terms),
    }


def parity(a: dict, b: dict) -> dict:
    """Two structural summaries side by side."""
    x, y = set(a["out_terms"]), set(b["out_terms"])
    return {"same_flags": a["flags"] == b["flags"], "signal_count_delta": b["n_signals"] - a["n_signals"], "out_domain_overlap": len(x & y) / max(1, len(x | y))}
