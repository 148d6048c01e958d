"""Queries on documents in JSON and HTML: schemas, corrections, leaves, character references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fitspark.cluster import spread
from fitspark.functions import text
from fitspark.operators import variant
from fitspark.operators.schema import first_schema_violation
from fitspark.plans.catalog import query, table

#: Every kind of rule that a schema of candidates has, and some more.
ORDER_SCHEMA = {
    "$schema": "http://json-schema.org/draft-07/schema#",
    "type": "object",
    "required": ["id", "person", "jobs", "status"],
    "properties": {
        "id": {"type": "string", "pattern": "^ORD_[0-9]+$"},
        "person": {"type": "object", "required": ["years"], "properties": {"years": {"type": "number", "minimum": 0, "maximum": 50}, "note": {"type": ["string", "null"], "maxLength": 5}}},
        "status": {"enum": ["F", "O", "P"]},
        "jobs": {"type": "array", "minItems": 1, "maxItems": 3, "items": {"type": "object", "required": ["title"], "properties": {"title": {"type": "string", "minLength": 1}, "months": {"type": "integer", "minimum": 0}, "open": {"type": "boolean"}}}},
        "scores": {"type": "object", "additionalProperties": {"type": "number", "maximum": 100}},
        "tags": {"type": "array", "uniqueItems": True, "items": {"$ref": "#/definitions/tag"}},
    },
    "additionalProperties": False,
    "definitions": {"tag": {"anyOf": [{"type": "string"}, {"const": 0}]}},
}
#: What is wrong with a document, and the violation that comes first.
DEFECTS = (
    (None, None, None),
    ("id", "id", "type"),
    ("id", "id", "pattern"),
    (None, None, "required"),
    ("person.years", "person", "minimum"),
    ("person.years", "person", "maximum"),
    ("person.note", "person", "maxLength"),
    ("status", "status", "enum"),
    ("jobs", "jobs", "minItems"),
    ("jobs", "jobs", "maxItems"),
    ("jobs.1", "jobs", "required"),
    ("jobs.1.months", "jobs", "type"),
    ("jobs.0.title", "jobs", "minLength"),
    ("scores.b", "scores", "maximum"),
    ("tags", "tags", "uniqueItems"),
    ("tags.2", "tags", "anyOf"),
    (None, None, "additionalProperties"),
    (None, None, "json"),
    ("person", "person", "type"),
    ("jobs.1.open", "jobs", "type"),
)
N = len(DEFECTS)


def _sql_list(i: int) -> str:
    return "[" + ", ".join("NULL" if d[i] is None else f"'{d[i]}'" for d in DEFECTS) + "]"


@query(f"""
    WITH k AS (SELECT o_orderkey, CAST((o_orderkey + o_custkey) % {N} AS INTEGER) + 1 AS k FROM orders)
    SELECT o_orderkey, {_sql_list(0)}[k] AS path, {_sql_list(1)}[k] AS top, {_sql_list(2)}[k] AS keyword FROM k""")
def schema_violations(spark, d):
    """A document for each order, most of them with a defect, against a schema that is compiled to one expression."""
    k = (F.col("o_orderkey") + F.col("o_custkey")) % N
    wrong = lambda good, **bad: _choose(k, good, bad)
    key = F.col("o_orderkey").cast("string")
    doc = F.concat(
        F.lit('{"id": '), wrong(F.concat(F.lit('"ORD_'), key, F.lit('"')), d1=key, d2=F.concat(F.lit('"X_'), key, F.lit('"'))),
        F.lit(', "person": '), wrong('{"years": 4.0, "note": null}', d4='{"years": -1}', d5='{"years": 50.5}', d6='{"years": 50, "note": "too long"}', d18="[]"),
        F.lit(', "status": "'), wrong(F.col("o_orderstatus"), d7="f"),
        F.lit('", "jobs": ['), wrong('{"title": "a", "months": 3.0}, {"title": "b", "open": false}', d8="", d9=", ".join(['{"title": "a"}'] * 4), d10='{"title": "a"}, {"months": 3}', d11='{"title": "a"}, {"title": "b", "months": 2.5}', d12='{"title": ""}', d19='{"title": "a"}, {"title": "b", "open": "no"}'),
        F.lit('], "scores": {"a": 100'), wrong("", d13=', "b": 100.5'),
        F.lit('}, "tags": ["x", 0'), wrong("", d14=', "x"', d15=", 1"),
        F.lit("]"), wrong("", d16=', "more": 1'), wrong("}", d17=""),
    )
    doc = F.when(k == 3, F.regexp_replace(doc, '"status": "[A-Z]", ', "")).otherwise(doc)
    return table(spark, d, "orders").select("o_orderkey", first_schema_violation(ORDER_SCHEMA, F.try_parse_json(doc)).alias("v")).select("o_orderkey", "v.path", "v.top", "v.keyword")


def _choose(k: Column, good, bad: dict) -> Column:
    """`good`, but the text under dN where k is N."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    out = as_column(good)
    for name, x in bad.items():
        out = F.when(k == int(name[1:]), as_column(x)).otherwise(out)
    return out


DEEP = [f"l{i}" for i in range(9)]


def _versions(spark, d):
    """Two versions of a document of eleven levels for each order: a deep value, a list, members that come and go, a type that changes."""
    o = spread(table(spark, d, "orders").select("o_orderkey", "o_custkey"), task_rows=20_000)
    n, custkey = F.col("o_orderkey"), F.col("o_custkey").cast("string")

    def version(value: Column, items: Column, rest: Column) -> Column:
        deep = F.concat(*(F.lit(f'{{"{k}": ') for k in DEEP), F.lit('{"v": '), value, F.lit(', "same": [1, {"x": 2}]}'), F.lit("}" * len(DEEP)))
        return F.concat(F.lit('{"deep": '), deep, F.lit(', "items": ['), items, F.lit("]"), rest, F.lit("}"))

    before = version(custkey, F.lit('1, {"a": [1, 2]}'), F.when(n % 4 == 0, ', "gone": {"a": 1}, "n": null').otherwise(', "n": 2.50'))
    after = version(F.when(n % 2 == 0, F.concat(F.lit('"'), custkey, F.lit('"'))).otherwise(F.concat(custkey, F.lit(".0"))), F.when(n % 3 == 0, '1, {"a": [1, 3]}').otherwise('1.0, {"a": [1, 2]}'), F.when(n % 4 == 1, ', "n": {"new": true}').when(n % 4 == 0, "").otherwise(', "n": 2.5'))
    return o.select("o_orderkey", before.alias("before"), after.alias("after"))


@query(f"""
    SELECT o_orderkey, 'deep.{".".join(DEEP)}.v' AS path, CAST(o_custkey AS VARCHAR) AS before, '"' || o_custkey || '"' AS after FROM orders WHERE o_orderkey % 2 = 0
    UNION ALL SELECT o_orderkey, 'items', '[1,{{"a":[1,2]}}]', '[1,{{"a":[1,3]}}]' FROM orders WHERE o_orderkey % 3 = 0
    UNION ALL SELECT o_orderkey, 'gone', '{{"a":1}}', NULL FROM orders WHERE o_orderkey % 4 = 0
    UNION ALL SELECT o_orderkey, 'n', '2.5', '{{"new":true}}' FROM orders WHERE o_orderkey % 4 = 1""")
def json_corrections(spark, d):
    """What a second version changed, without a schema, by a fold over pairs of objects."""
    return variant.json_corrections(_versions(spark, d), keys=["o_orderkey"])


@query(f"""
    WITH c AS (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS v, o_orderkey % 4 = 0 AS fourth FROM orders), deep AS (SELECT 'deep.{".".join(DEEP)}' AS p)
    SELECT o_orderkey, p || '.v' AS path, 'BIGINT' AS kind, v AS value FROM c, deep
    UNION ALL SELECT o_orderkey, p || '.same[0]', 'BIGINT', '1' FROM c, deep
    UNION ALL SELECT o_orderkey, p || '.same[1].x', 'BIGINT', '2' FROM c, deep
    UNION ALL SELECT o_orderkey, unnest(['items[0]', 'items[1].a[0]', 'items[1].a[1]']), 'BIGINT', unnest(['1', '1', '2']) FROM c
    UNION ALL SELECT o_orderkey, 'gone.a', 'BIGINT', '1' FROM c WHERE fourth
    UNION ALL SELECT o_orderkey, 'n', CASE WHEN fourth THEN 'VOID' ELSE 'DECIMAL' END, CASE WHEN fourth THEN 'null' ELSE '2.5' END FROM c""")
def json_leaves(spark, d):
    """Every leaf of documents of any shape, with its path."""
    return variant.json_leaves(_versions(spark, d), keys=["o_orderkey"], doc="before")


@query("""
    SELECT p_partkey, 'x' || chr(CAST(8000 + p_partkey % 4000 AS INTEGER)) || 'é—’&lt;' || chr(CAST(65 + p_size AS INTEGER)) || '¬it; & &nosuch; €' || CASE WHEN p_partkey % 3 = 0 THEN '∉&#;' ELSE '�' END AS told FROM part""")
def character_references(spark, d):
    """References by decimal and hexadecimal number, by name, without a semicolon, unknown and out of range."""
    size = F.col("p_size") + 65
    raw = F.concat(F.lit("x&#"), (F.col("p_partkey") % 4000 + 8000).cast("string"), F.lit(";&eacute;&mdash;&#8217;&amp;lt;&#x"), F.lower(F.hex(size)), F.lit(";&notit; & &nosuch; &#128;"), F.when(F.col("p_partkey") % 3 == 0, "&notin;&#;").otherwise("&#x110000;"))
    return table(spark, d, "part").select("p_partkey", text.unescape(raw).alias("told"))
