"""Functions for users who write SQL: scalar, table and aggregate ones."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fitspark.cluster import ship
from fitspark.operators.concordance import gamma

#: Bodies are SQL over the arguments, so that the optimizer sees through them.
FUNCTIONS = {
    "fit_clip": ("x DOUBLE, low DOUBLE, high DOUBLE", "DOUBLE", "least(high, greatest(low, x))"),
    "fit_months": ("a DATE, b DATE", "DOUBLE", "(year(b) - year(a)) * 12.0D + (month(b) - month(a)) + (day(b) - day(a)) / 30.0D"),
    "fit_half_life": ("age DOUBLE, half DOUBLE", "DOUBLE", "pow(0.5D, age / half)"),
    "fit_tidy": ("t STRING", "STRING", "lower(trim(regexp_replace(t, '\\\\s+', ' ')))"),
    "fit_overlap": ("a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE", "size(array_intersect(a, b)) / greatest(1, size(array_union(a, b)))"),
    "fit_cosine": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "coalesce(try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v), sqrt(aggregate(a, 0D, (s, v) -> s + v * v)) * sqrt(aggregate(b, 0D, (s, v) -> s + v * v))), 0D)"),
}


#: Table functions in SQL: arguments, columns, query.
TABLE_FUNCTIONS = {
    "fit_lines": ("t STRING", "pos INT, line STRING", "SELECT pos, line FROM (SELECT posexplode(split(t, '\\n')) AS (pos, line)) WHERE trim(line) <> ''"),
}


def register(spark: SparkSession) -> list[str]:
    """Create scalar, table and aggregate functions in the session; returns their names. Table functions in Python are in `tables`."""
    for name, (arguments, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    for name, (arguments, columns, body) in TABLE_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE ({columns}) RETURN {body}")
    ship(spark)
    spark.udf.register("fit_gamma", F.pandas_udf(gamma, "double"))
    return [*FUNCTIONS, *TABLE_FUNCTIONS, "fit_gamma"]
