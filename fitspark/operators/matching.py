"""As-of lookups, differences, latest versions and violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T


#: Ranges of time that rows are dealt to, so that a key with very many rows is no single task.
AS_OF_BINS = 64


def as_of(rows: DataFrame, ladder: DataFrame, *, on: str, at: str, take: list[str], by: list[str] | None = None, strict: bool = False, bins: int = AS_OF_BINS) -> DataFrame:
    """Add the columns `take` of the last ladder row at or before (strictly before, if asked) each row's `on`, null without one.

    With keys `by`, among the ladder rows of equal keys. Rows and ladder are dealt to
    ranges of time, whose edges are quantiles of both, besides the keys. In each range both
    stand in one order, in which a window carries the ladder's last row forward; the last
    row of earlier ranges comes first, from a window over at most one row for each range and
    side. There is no inequality join, and neither a key nor a ladder has to be small.
    Null times have and are no match. Times that have no quantiles, such as text, are one range.
    """
    by = by or []
    low, high = (0, 1) if strict else (1, 0)
    side = F.struct(*(F.col(c) for c in take))
    left = rows.select(*by, F.col(on).alias("_at"), F.lit(low).alias("_side"), F.struct(*rows.columns).alias("_row"), F.lit(None).cast(ladder.select(side.alias("t")).schema["t"].dataType).alias("_take"))
    right = ladder.where(F.col(at).isNotNull()).select(*by, F.col(at).alias("_at"), F.lit(high).alias("_side"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), side.alias("_take"))
    both = left.unionByName(right)
    kind = both.schema["_at"].dataType
    ranged = bins > 1 and isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))
    edges = (both.agg(F.percentile_approx("_at", [i / bins for i in range(1, bins)], 10 * bins)).first()[0] or []) if ranged else []
    # Equal times are in one range.
    bin_of = sum((F.coalesce(F.col("_at") > F.lit(e).cast(kind), F.lit(False)).cast("int") for e in dict.fromkeys(edges)), F.lit(0))
    both = both.withColumn("_bin", bin_of)
    keys = [*by, "_bin"]
    lasts = both.where("_row is null").groupBy(*keys).agg(F.max_by("_take", "_at").alias("_take"))
    asked = both.where("_row is not null").select(*keys).distinct()
    # Of a range, the row that asks stands before the one that it may hand on itself.
    marks = asked.select(*keys, F.lit(0).alias("_side"), F.lit(None).cast(both.schema["_take"].dataType).alias("_take")).unionByName(lasts.select(*keys, F.lit(1).alias("_side"), "_take"))
    before = marks.withColumn("_take", F.last("_take", ignorenulls=True).over(W.partitionBy(*by).orderBy("_bin", "_side").rowsBetween(W.unboundedPreceding, 0))).where("_side = 0 and _take is not null")
    first = before.select(*keys, F.lit(None).cast(kind).alias("_at"), F.lit(-1).alias("_side"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), "_take")
    w = W.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, 0)  # null times come first
    carried = both.unionByName(first).withColumn("_last", F.when(F.col("_at").isNotNull(), F.last("_take", ignorenulls=True).over(w)))
    return carried.where("_row is not null").select("_row.*", *(F.col(f"_last.{c}").alias(c) for c in take))


def diff(before: DataFrame, after: DataFrame, *, keys: list[str], path: str = "path", value: str = "value") -> DataFrame:
    """Paths whose values differ between two flattened versions; a missing path is the same as null."""
    on = [*keys, path]
    both = before.select(*on, F.col(value).alias("before")).join(after.select(*on, F.col(value).alias("after")), on, "full")
    return both.where(~F.col("before").eqNullSafe(F.col("after"))).select(*on, "before", "after")


def flat(record: Column, schema, prefix: str = "") -> Column:
    """A struct as array<struct<path, value>> of its leaves; arrays and maps are leaves, in JSON."""
    out = []
    for f in schema.fields:
        c, at = record[f.name], f"{prefix}{f.name}"
        if isinstance(f.dataType, T.StructType):
            out.append(flat(c, f.dataType, f"{at}."))
        else:
            v = F.to_json(c) if isinstance(f.dataType, (T.ArrayType, T.MapType)) else c.cast("string")
            out.append(F.array(F.struct(F.lit(at).alias("path"), v.alias("value"))))
    return F.concat(*out)


def latest(rows: DataFrame, *, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order: whole-row upsert over a log."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(target: DataFrame, updates: DataFrame, *, keys: list[str]) -> DataFrame:
    """`target` with the rows of `updates` in place of those with the same key; updates must have each key once."""
    return target.join(updates, keys, "left_anti").unionByName(updates)


def violations(rules: list[tuple[str, str, Column]]) -> Column:
    """array<struct<path, message>> of the rules (path, message, violated) that a row breaks, by path."""
    each = [F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(path).alias("path"), F.lit(message).alias("message"))) for path, message, bad in rules]
    return F.sort_array(F.array_compact(F.array(*each)))


def first_violation(rules: list[tuple[str, str, Column]]) -> Column:
    """'path: message' of the first rule broken, or null."""
    return F.get(F.transform(violations(rules), lambda v: F.concat_ws(": ", v["path"], v["message"])), F.lit(0))


def field_of(message: Column) -> Column:
    """The field that an error message names, and the block it is in: struct<path, top>."""
    path = F.nullif(F.regexp_extract(message, r"field '([^']+)'", 1), F.lit(""))
    return F.struct(path.alias("path"), F.nullif(F.regexp_extract(path, r"^([^.\[]+)", 1), F.lit("")).alias("top"))


def structural_of(profile: Column) -> Column:
    """What two role profiles (VARIANT) are compared by, as `config.structural()` has it, without reading them on the driver."""
    get = lambda path, kind: F.try_variant_get(profile, f"$.{path}", kind)
    none = lambda c: F.coalesce(c, F.expr("cast(array() as array<string>)"))
    signals = get("signals", "array<variant>")
    flags = F.map_filter(get("red_flags", "map<string,variant>"), lambda k, v: F.coalesce(F.try_variant_get(v, "$.enabled", "boolean"), F.lit(False)))
    return F.struct(
        F.coalesce(F.size(signals), F.lit(0)).cast("long").alias("n_signals"),
        none(F.array_sort(F.transform(signals, lambda s: F.try_variant_get(s, "$.id", "string")))).alias("signal_ids"),
        F.coalesce(get("role.notice_preference_days", "int"), F.lit(60)).alias("notice_days"),
        get("role.ideal_experience.peak_years", "double").alias("peak_years"),
        none(F.array_sort(F.map_keys(flags))).alias("flags"),
        none(F.array_sort(get("domain.out_of_domain_terms", "array<string>"))).alias("out_terms"),
    )


def parity_of(a: Column, b: Column) -> Column:
    """Two structural summaries side by side, as `config.parity()` has them."""
    shared = F.size(F.array_intersect(a["out_terms"], b["out_terms"])) / F.greatest(F.lit(1), F.size(F.array_union(a["out_terms"], b["out_terms"])))
    return F.struct((a["flags"] == b["flags"]).alias("same_flags"), (b["n_signals"] - a["n_signals"]).alias("signal_count_delta"), shared.alias("out_domain_overlap"))
