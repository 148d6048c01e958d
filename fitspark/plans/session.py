"""From résumé text to stored fit runs, and studies of scoring methods."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitspark.backends import TextBackend, ask
from fitspark.config import Role
from fitspark.embedding import EmbeddingBackend
from fitspark.functions import text
from fitspark.operators import matching, metrics
from fitspark.operators.score import score_candidates
from fitspark.operators.validate import candidate_violations
from fitspark.plans.compile import compile_candidates
from fitspark.plans.store import Store, as_json, now_iso, with_ids
from fitspark.schemas import CANDIDATE, as_type

Write = Callable[[DataFrame, str], DataFrame]


def parse_resumes(texts: DataFrame, backend: TextBackend, write: Write, *, ref_date: str | None = None) -> DataFrame:
    """(resume_id, candidate columns, defaulted, calls, status): rate_limited or transient if all calls of a text failed so."""
    got = compile_candidates(texts, backend, write, ref_date=ref_date)
    failed = F.forall("calls", lambda c: ~c["ok"])
    limited = F.exists("calls", lambda c: F.coalesce(c["error"], F.lit("")).startswith("RateLimit"))
    broken = F.exists("calls", lambda c: F.coalesce(c["error"], F.lit("")).startswith("Transient"))
    return got.withColumn("status", F.when(failed & limited, "rate_limited").when(failed & broken, "transient").otherwise("ok"))


def fit_candidates(candidates: DataFrame, role: Role, backend: EmbeddingBackend, *, ref_date: str | None = None, check_id: bool = False) -> DataFrame:
    """Score candidates that satisfy the rules; others have status invalid and their violations.

    Returns the candidates' other columns, candidate_id, status, violations, overall and fit.
    """
    others = [c for c in candidates.columns if c not in CANDIDATE.fieldNames()]
    # Compiled blocks have the same members in another order.
    candidates = candidates.select(*others, *((as_type(F.col(f.name), candidates.schema[f.name].dataType, f.dataType) if f.name in candidates.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in CANDIDATE.fields))
    judged = candidates.withColumn("violations", candidate_violations(check_id=check_id))
    good = score_candidates(judged.where(F.size("violations") == 0), role, backend, ref_date=ref_date)
    good = good.select(*others, "candidate_id", F.lit("ok").alias("status"), "violations", "overall", "fit")
    bad = judged.where(F.size("violations") > 0).select(*others, "candidate_id", F.lit("invalid").alias("status"), "violations", F.lit(None).cast("double").alias("overall"), F.lit(None).cast(good.schema["fit"].dataType).alias("fit"))
    return good.unionByName(bad)


def run_fit(candidates: DataFrame, role: Role, backend: EmbeddingBackend, store: Store, write: Write, *, workspace_id: str, profile_id: str, profile_yaml: str, ref_date: str | None = None) -> DataFrame:
    """Score candidates (resume_id, raw_text, ...) and store résumé, record, profile and run of those that are ok.

    Nothing of an invalid candidate is stored. The result is written before ids are
    used, so that all tables agree on them.
    """
    packed = candidates.withColumn("candidate_json", as_json(F.struct(*(F.col(f) for f in CANDIDATE.fieldNames()))))
    outcome = fit_candidates(packed, role, backend, ref_date=ref_date)
    done = write(with_ids(with_ids(outcome, "record_id", "rec"), "run_id", "run"), "outcomes")
    ok = done.where("status = 'ok'").withColumn("workspace_id", F.lit(workspace_id)).withColumn("created_at", F.lit(now_iso())).withColumn("updated_at", F.col("created_at"))
    store.save("profiles", [{"profile_id": profile_id, "workspace_id": workspace_id, "name": role.title, "profile_yaml": profile_yaml, "created_at": now_iso(), "updated_at": now_iso()}])
    store.save("resumes", ok.select("resume_id", "workspace_id", F.col("candidate_id").alias("name"), "raw_text", "candidate_json", "created_at", "updated_at"))
    store.save("candidate_records", ok.select("record_id", "workspace_id", "resume_id", "candidate_json", "created_at"))
    store.save("fit_runs", ok.select("run_id", "workspace_id", F.lit(profile_id).alias("profile_id"), "record_id", as_json(F.col("fit")).alias("result_json"), "overall", "created_at"))
    return done


def corrections(before: DataFrame, after: DataFrame, *, workspace_id: str, note: str = "") -> DataFrame:
    """Differences of two versions of candidates (resume_id, candidate columns), as rows to store."""
    flat = lambda rows: rows.select("resume_id", F.inline(matching.flat(F.struct(*(F.col(f) for f in CANDIDATE.fieldNames())), CANDIDATE)))
    changed = matching.diff(flat(before), flat(after), keys=["resume_id"])
    return with_ids(changed, "correction_id", "cor").select("correction_id", F.lit(workspace_id).alias("workspace_id"), "resume_id", F.col("path").alias("field_path"), F.col("before").alias("before_json"), F.col("after").alias("after_json"), F.lit(note).alias("note"), F.lit(now_iso()).alias("created_at"))


# ------------------------------------------------------------------ entries as editable rows


def to_rows(candidates: DataFrame, column: str, *, key: str = "candidate_id") -> DataFrame:
    """An array of entries as rows (key, pos, members)."""
    return candidates.select(key, F.posexplode(column).alias("pos", "entry")).select(key, "pos", "entry.*")


def from_rows(rows: DataFrame, column: str, *, named: tuple[str, ...], key: str = "candidate_id") -> DataFrame:
    """Edited rows as arrays again, in order; rows in which all of `named` are blank are dropped.

    The key must tell candidates apart: a résumé's own, where their ids are made from it.
    """
    members = [c for c in rows.columns if c not in (key, "pos")]
    blank = F.lit(True)
    for c in named:
        blank = blank & (F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "")
    kept = rows.where(~blank).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", F.struct(*members).alias("entry")))).alias("all"))
    return kept.select(key, F.transform("all", lambda x: x["entry"]).alias(column))


# ------------------------------------------------------------------ studies

RUBRIC = "Score the candidate against the job by its requirements, each for itself, and answer {\"fit_0_100\": n}."
NAIVE = "How well does the candidate fit the job, from 0 to 100? Answer {\"fit_0_100\": n}."


def judge(pairs: DataFrame, backend: TextBackend, question: str, method: str) -> DataFrame:
    """Scores by a model of pairs (jd_slug, tier, repeat, jd_text, resume_text); a failed call scores 0 and says why."""
    prompt = F.concat(F.lit(question + "\n\nJOB\n"), F.col("jd_text"), F.lit("\n\nCANDIDATE\n"), F.col("resume_text"))
    answered = ask(pairs.withColumn("prompt", prompt), backend, reformat=False)
    score = F.when(F.col("ok"), text.score_of(F.col("answer"))).otherwise(0.0)
    return answered.select("jd_slug", "tier", F.lit(method).alias("method"), "repeat", score.alias("score"), F.col("tokens").cast("int").alias("tokens"), "elapsed_s", "error")


def run_study(pairs: DataFrame, engine: DataFrame, backend: TextBackend, *, repeats: int = 3) -> DataFrame:
    """All methods on all pairs: `engine` has the scores (jd_slug, tier, score) of the formula, which repeats do not change."""
    plan = metrics.study_plan(pairs, repeats=repeats).withColumn("repeat", F.col("repeat").cast("int"))
    ours = plan.join(engine, ["jd_slug", "tier"], "left").select("jd_slug", "tier", F.lit("engine").alias("method"), "repeat", F.coalesce("score", F.lit(0.0)).alias("score"), F.lit(None).cast("int").alias("tokens"), F.lit(0.0).alias("elapsed_s"), F.when(F.col("score").isNull(), "not scored").alias("error"))
    return ours.unionByName(judge(plan, backend, RUBRIC, "rubric")).unionByName(judge(plan, backend, NAIVE, "naive"))


def report(study: DataFrame) -> str:
    """The study in Markdown: a line for each method, then means by job and tier."""
    rows = study.withColumnRenamed("jd_slug", "jd")
    show = lambda x, n=3: "n/a" if x is None else f"{x:.{n}f}" if isinstance(x, float) else f"{x:,}"
    out = ["# Comparison", "", "| method | pairwise accuracy | Kendall | stability | tokens | seconds | calls | errors |", "|-|-|-|-|-|-|-|-|"]
    for r in metrics.dashboard(rows).collect():  # one row for each method
        out.append(f"| {r['method']} | " + " | ".join(show(r[k]) for k in ("pairwise_accuracy", "kendall", "stability", "tokens", "elapsed_s", "n_calls", "n_errors")) + " |")
    wide = metrics.tier_means(rows).groupBy("method", "jd").pivot("tier", list(metrics.TIERS)).agg(F.first("score")).orderBy("method", "jd")
    line = F.format_string("| %s | %s |", F.col("jd"), F.concat_ws(" | ", *(F.when(F.col(t).isNull(), "n/a").otherwise(F.format_string("%.3f", F.col(t))) for t in metrics.TIERS)))
    for r in wide.groupBy("method").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("lines")).orderBy("method").collect():
        out += ["", f"## {r['method']}", "", "| job | " + " | ".join(metrics.TIERS) + " |", "|-|-|-|-|", r["lines"]]
    return "\n".join(out) + "\n"
