"""Metrics of a study: (jd, tier, method, repeat, score, tokens, elapsed_s, error)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tiers from best to worst.
TIERS = ("strong", "borderline", "weak")


def tier_means(study: DataFrame) -> DataFrame:
    """Mean score of each method, jd and tier. A failed call counts with its score of 0."""
    return study.groupBy("method", "jd", "tier").agg(F.avg("score").alias("score"))


def _pairs(means: DataFrame) -> DataFrame:
    """For each method and jd its pairs of a better and a worse tier, from one row with all its tiers: no self-join."""
    wide = means.groupBy("method", "jd").agg(*(F.max(F.when(F.col("tier") == t, F.col("score"))).alias(t) for t in TIERS))
    pairs = [F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for i, a in enumerate(TIERS) for b in TIERS[i + 1 :]]
    return wide.select("method", "jd", F.inline(F.array(*pairs))).where("a is not null and b is not null")


def pairwise_accuracy(means: DataFrame) -> DataFrame:
    """Share of tier pairs in strict order, ties being wrong, averaged over jds; jds of one tier do not count."""
    per_jd = _pairs(means).groupBy("method", "jd").agg(F.avg((F.col("a") > F.col("b")).cast("double")).alias("x"))
    return per_jd.groupBy("method").agg(F.avg("x").alias("pairwise_accuracy"))


def kendall(means: DataFrame) -> DataFrame:
    """Goodman and Kruskal's gamma: tied pairs drop out, 0 if all are tied; averaged over jds."""
    gap = F.signum(F.col("a") - F.col("b"))
    per_jd = _pairs(means).groupBy("method", "jd").agg(F.coalesce(F.try_divide(F.sum(gap), F.sum(F.abs(gap))), F.lit(0.0)).alias("x"))
    return per_jd.groupBy("method").agg(F.avg("x").alias("kendall"))


def stability(study: DataFrame) -> DataFrame:
    """Population deviation over repeats, averaged over groups of two or more; null without one."""
    groups = study.groupBy("method", "jd", "tier").agg(F.stddev_pop("score").alias("s"), F.count("score").alias("n"))
    return groups.where("n >= 2").groupBy("method").agg(F.avg("s").alias("stability"))


def cost(study: DataFrame) -> DataFrame:
    """Tokens (null if none were reported), seconds, calls and errors of each method."""
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    return study.groupBy("method").agg(F.sum("tokens").alias("tokens"), F.bround(F.sum("elapsed_s"), 3).alias("elapsed_s"), F.count(F.lit(1)).alias("n_calls"), F.count_if(failed).alias("n_errors"))


def dashboard(study: DataFrame) -> DataFrame:
    """All metrics in one row for each method."""
    means = tier_means(study)
    out = cost(study)
    for part in (pairwise_accuracy(means), kendall(means), stability(study)):
        out = out.join(part, "method", "left")
    return out.select("method", "pairwise_accuracy", "kendall", "stability", "tokens", "elapsed_s", "n_calls", "n_errors").orderBy("method")


def telemetry(entries: DataFrame) -> DataFrame:
    """Totals of (seq, leaf, ok, elapsed_s): the slowest leaf is the first of the slowest."""
    slowest = F.max_by("leaf", F.struct("elapsed_s", (-F.col("seq")).alias("seq")))
    return entries.agg(F.count(F.lit(1)).alias("entries"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"), F.bround(F.sum("elapsed_s"), 3).alias("elapsed_s"), slowest.alias("slowest"))


def study_plan(pairs: DataFrame, *, repeats: int, methods: list[str] | None = None) -> DataFrame:
    """Each pair with each repeat, and with each method if given, as generated rows."""
    out = pairs.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)).cast("array<bigint>")))
    return out.withColumn("method", F.explode(F.array(*(F.lit(m) for m in methods)))) if methods else out


def session(fit_runs: DataFrame, resumes: DataFrame, profiles: DataFrame, corrections: DataFrame) -> DataFrame:
    """One row for each workspace: its runs, résumés, profiles and corrections, and the mean score of its runs.

    Each table is counted by itself before they meet, so rows are not multiplied.
    The mean is null without runs; other counts are then 0.
    """
    count = lambda rows, name: rows.groupBy("workspace_id").agg(F.count(F.lit(1)).alias(name))
    out = fit_runs.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("n_fit_runs"), F.avg("overall").alias("mean_overall"))
    names = ["n_fit_runs"]
    for rows, name in ((resumes, "n_resumes"), (profiles, "n_profiles"), (corrections, "n_corrections")):
        out = out.join(count(rows, name), "workspace_id", "full")
        names.append(name)
    return out.select("workspace_id", *(F.coalesce(n, F.lit(0)).alias(n) for n in names), "mean_overall")
