"""The fit of candidates to a role: an overall score, what it is made of, and what would raise it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitspark.config import Role
from fitspark.embedding import EmbeddingBackend, similarities
from fitspark.functions import arrays, dates, text
from fitspark.operators.components import response, with_components
from fitspark.schemas import CANDIDATE


def with_similarity(rows: DataFrame, role: Role, backend: EmbeddingBackend) -> DataFrame:
    """Add `dense`, the pooled similarity of a candidate's jobs to each signal, weighted by recency and length.

    The arrays of candidates' texts go to Python, where each text of a batch is embedded
    and compared once, and a number for each signal comes back; all other columns stay in
    the JVM, in the same rows, so nothing is shuffled.
    """
    asked = backend.embed([s.query for s in role.signals])
    carried = rows.withColumn("_texts", F.transform("chunks", lambda c: c["text"]))
    got = similarities(carried, backend, asked, texts="_texts", into="_similar")
    weights = F.transform("chunks", lambda c: c["weight"])
    total = arrays.total(weights)

    def pooled(k: int) -> Column:
        return F.coalesce(F.try_divide(arrays.dot(F.transform("_similar", lambda x: F.get(x, F.lit(k))), weights), total), F.lit(0.0))

    return got.withColumn("dense", F.array(*(pooled(k) for k in range(len(asked))))).drop("_texts", "_similar")


def score_candidates(candidates: DataFrame, role: Role, backend: EmbeddingBackend, *, ref_date: str | None = None) -> DataFrame:
    """candidate_id, overall (0 to 100) and fit, the full result as a struct.

    fit has overall, candidate_id, role_title, per_signal, gates, red_flags and gaps.
    Map-only: nothing is shuffled, and no candidate's score depends on another's.
    """
    m = role.method
    keep = [c for c in candidates.columns if c not in CANDIDATE.fieldNames()]
    rows = with_similarity(with_components(candidates, role, ref_date=ref_date), role, backend)
    document = text.tokens(F.col("all_text"))
    rows = rows.withColumn("_tokens", document)
    spark = candidates.sparkSession
    asked = spark.createDataFrame([(i, s.query) for i, s in enumerate(role.signals)], "i int, q string").select("i", text.tokens(F.col("q")).alias("t")).orderBy("i").collect()
    empty = F.expr("cast(array() as array<string>)")
    lexical = [text.lexical(F.array(*(F.lit(w) for w in r["t"])) if r["t"] else empty, F.col("_tokens")) for r in asked]
    rows = rows.withColumn("lexical", F.array(*lexical))

    dense_fit = role.yoe_weight * F.col("yoe_fit") + role.domain_weight * F.col("domain_nlp_ratio")
    for k, s in enumerate(role.signals):
        dense_fit = dense_fit + s.dense_weight * F.get("dense", F.lit(k))
    most = sum(s.dense_weight for s in role.signals) + role.yoe_weight + role.domain_weight
    add = m["additive"]
    raw = add["dense"] * dense_fit + add["lexical"] * arrays.total(F.col("lexical")) / len(role.signals) + add["depth"] * F.col("depth_bonus")
    additive = dates.clip(raw / (add["dense"] * most + add["lexical"] + add["depth"]), 0, 1)

    d, coverage = m["damps"], F.col("evid_coverage")
    on = lambda flag, fires: F.lit(flag in role.flags) & fires
    stale = dates.last_rung(F.col("months_since_ic_role"), m["recency_rungs"]) if "stale_ic_role" in role.flags else F.lit(1.0)
    flags = {
        "cv_primary": on("cv_primary", F.col("cv_primary") > 0),
        "job_hopper": on("job_hopper", F.col("hopper") > 0),
        "only_consulting": on("only_consulting", F.col("only_consulting") > 0),
        "stale_ic_role": on("stale_ic_role", stale < 1.0),
    }
    place = (d["loc_base"] + d["loc_span"] * F.col("loc2_v4")) * F.when(F.col("loc2_v4") <= d["loc_floor"], d["loc_floor_damp"]).otherwise(1.0)
    bonus = m["assessment_bonus"]
    factors = [
        m["evidence_gate"]["floor"] + m["evidence_gate"]["span"] * coverage,
        F.when(F.col("ai_skills_claimed") == 0, 1.0).otherwise(m["claim"]["base"] + m["claim"]["span"] * F.col("ai_skill_corroboration")),
        1 + bonus["weight"] * F.col("assess_strength") * F.least(F.lit(1.0), coverage / bonus["full_coverage"]),
        stale,
        m["experience"]["base"] + m["experience"]["span"] * F.col("yoe_fit"),
        F.when(flags["cv_primary"], d["cv_primary"]).otherwise(1.0),
        F.when(flags["job_hopper"], d["hopper"]).otherwise(1.0),
        F.when(flags["only_consulting"], 1 - d["only_consulting"]).otherwise(1.0),
        place,
        F.col("integrity"),
        F.col("availability_mult"),
        F.col("notice_pen"),
    ]
    overall = 100 * additive
    for f in factors:
        overall = overall * f
    rows = rows.withColumn("overall", dates.clip(overall, 0, 100)).withColumn("_place", place)

    per_signal = F.array(*(F.struct(F.lit(s.id).alias("id"), F.lit(s.label).alias("label"), F.get("dense", F.lit(k)).alias("dense"), F.get("evidence", F.lit(k)).alias("evidence"), F.get("lexical", F.lit(k)).alias("lexical"), F.lit(s.dense_weight).alias("weight")) for k, s in enumerate(role.signals)))
    gate = lambda name, c: F.struct(F.lit(name).alias("name"), c.alias("value"), (c < 0.999).alias("damped"))
    gates = F.array(gate("integrity", F.col("integrity")), gate("availability", F.col("availability_mult")), gate("notice", F.col("notice_pen")), gate("location", F.col("_place")))
    fired = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in flags.items())))
    rows = rows.withColumn("_signals", per_signal).withColumn("_gates", gates).withColumn("_fired", fired)
    fit = F.struct("overall", "candidate_id", F.lit(role.title).alias("role_title"), F.col("_signals").alias("per_signal"), F.col("_gates").alias("gates"), F.col("_fired").alias("red_flags"), gaps(role).alias("gaps"))
    return rows.select(*keep, "candidate_id", "overall", fit.alias("fit"))


def gaps(role: Role) -> Column:
    """Advice: weak signals in order, then gates that damp, then flags that fired."""
    low = role.method["low_signal"]
    weak = F.transform(
        F.filter("_signals", lambda s: (s["dense"] < low) & (s["evidence"] < low)),
        lambda s: F.format_string("Little shows \"%s\": describe work that demonstrates it, with figures (similarity %.2f, evidence %.2f).", s["label"], s["dense"], s["evidence"]),
    )
    dormant, rare = response(role)
    damped = {g: F.get("_gates", F.lit(k))["damped"] for k, g in enumerate(("integrity", "availability", "notice", "location"))}
    why = F.when(dormant, "long inactive and rarely answering recruiters").when(rare, "rarely answering recruiters").otherwise("little activity on the platform")
    fired = lambda flag: F.array_contains("_fired", flag)
    said = [
        F.when(damped["integrity"], "Entries contradict each other (tenure, years of experience, salary or certificates): check them."),
        F.when(damped["availability"], F.format_string("Availability lowers the score (%s): answer recruiters and keep the profile active.", why)),
        F.when(damped["notice"], F.format_string(f"A notice period of %d days is longer than the {role.notice_days} days that this role prefers.", F.col("notice_period_days"))),
        F.when(damped["location"], "The location lowers the score: the role's places, relocation and remote terms do not match."),
        F.when(fired("cv_primary"), "The career reads as outside this role's domain: describe work in the domain's terms where that is true."),
        F.when(fired("job_hopper"), "Many short positions: a longer recent one would help."),
        F.when(fired("only_consulting"), "All positions are at consulting firms: point out work on products of your own."),
        F.when(fired("stale_ic_role"), F.format_string("About %.0f months have passed since the last hands-on position.", F.col("months_since_ic_role"))),
    ]
    return F.concat(weak, F.array_compact(F.array(*said)))
