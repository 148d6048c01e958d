import html
import json
import random
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from fitspark.functions.text import html_text, unescape
from fitspark.operators.schema import JsonSchemaValidator, SchemaError, schema_violations
from fitspark.operators.variant import json_corrections, json_leaves

SCHEMA = {
    "type": "object",
    "required": ["id", "person"],
    "properties": {
        "id": {"type": "string", "pattern": "^C_[0-9]{3}$"},
        "person": {"type": "object", "required": ["years"], "properties": {"years": {"type": "number", "minimum": 0, "maximum": 50}}},
        "jobs": {"type": "array", "minItems": 1, "maxItems": 11, "items": {"type": "object", "properties": {"months": {"type": "integer", "minimum": 0}, "end": {"type": ["string", "null"]}}}},
    },
}
GOOD = {"id": "C_123", "person": {"years": 4}, "jobs": [{"months": 3, "end": None}]}


def found(spark, schema, docs, **options):
    rows = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(docs)], "i int, doc string").select("i", schema_violations(schema, F.try_parse_json("doc"), **options).alias("v")).collect()
    return [[(v.path, v.keyword) for v in r.v] for r in sorted(rows, key=lambda r: r.i)]


def test_validator_tells_field_and_block(spark):
    v = JsonSchemaValidator(spark, SCHEMA)
    assert v.validate(GOOD).ok
    bad = v.validate(GOOD | {"jobs": [{"months": "three"}]})
    assert (bad.ok, bad.field, bad.top) == (False, "jobs.0.months", "jobs")
    assert v.validate([]).field == "<root>"


def test_violations_stand_by_path_and_indexes_count_as_numbers(spark):
    many = [{"months": 1}] * 11
    many[2] = many[10] = {"months": -1}
    docs = [GOOD | {"jobs": many, "id": 5}, {"person": {"years": 60}}, {}, GOOD | {"jobs": []}]
    assert found(spark, SCHEMA, docs) == [[("id", "type"), ("jobs.2.months", "minimum"), ("jobs.10.months", "minimum")], [(None, "required"), ("person.years", "maximum")], [(None, "required"), (None, "required")], [("jobs", "minItems")]]


@pytest.mark.parametrize(
    ("schema", "good", "bad", "keyword"),
    [
        ({"type": "integer"}, [1, 2.0, -3], [1.5, "1", True, None], "type"),
        ({"type": "number"}, [1, 2.5], [True, "1"], "type"),
        ({"enum": ["a", 1, None, {"x": [1.0]}]}, ["a", 1.0, None, {"x": [1]}], ["b", 2, True, {"x": []}], "enum"),
        ({"const": {"b": 1, "a": 2}}, [{"a": 2, "b": 1}], [{"a": 2}], "const"),
        ({"exclusiveMinimum": 0}, [1, "x"], [0], "exclusiveMinimum"),
        ({"exclusiveMaximum": 0}, [-1], [0, 0.5], "exclusiveMaximum"),
        ({"multipleOf": 0.5}, [1, 1.5, "x"], [1.2], "multipleOf"),
        ({"minLength": 2}, ["ab", "éü", 1], ["a", "é"], "minLength"),
        ({"maxLength": 2}, ["ab", "éü", "\U0001f600é"], ["abc"], "maxLength"),
        ({"pattern": "b+"}, ["abc", 5], ["xyz", ""], "pattern"),
        ({"maxItems": 1}, [[], [1], "abc"], [[1, 2]], "maxItems"),
        ({"uniqueItems": True}, [[1, 2], ["1", 1]], [[1, 1.0], [{"a": 1, "b": 2}, {"b": 2, "a": 1}]], "uniqueItems"),
        ({"minProperties": 1}, [{"a": 1}, []], [{}], "minProperties"),
        ({"maxProperties": 1}, [{}, {"a": 1}], [{"a": 1, "b": 2}], "maxProperties"),
        ({"propertyNames": {"maxLength": 2}}, [{"ab": 1}], [{"abc": 1}], "propertyNames"),
        ({"properties": {"a": True}, "patternProperties": {"^x": True}, "additionalProperties": False}, [{"a": 1, "x1": 2}], [{"b": 1}], "additionalProperties"),
        ({"contains": {"type": "string"}}, [[1, "a"], "x"], [[], [1]], "contains"),
        ({"anyOf": [{"type": "string"}, {"minimum": 5}]}, ["a", 5], [4], "anyOf"),
        ({"oneOf": [{"type": "number"}, {"minimum": 5}]}, [4, "a"], [6], "oneOf"),
        ({"not": {"type": "string"}}, [1, None], ["a"], "not"),
        ({"allOf": [{"type": "number"}, {"maximum": 3}]}, [3], [4], "maximum"),
        ({"if": {"type": "string"}, "then": {"minLength": 2}, "else": {"type": "number"}}, ["ab", 1], ["a"], "minLength"),
        ({"$ref": "#/definitions/a~1b", "type": "string", "definitions": {"a/b": {"type": "number"}}}, [1], ["x"], "type"),
        (False, [], [1, None], "false"),
    ],
)
def test_each_keyword(spark, schema, good, bad, keyword):
    got = found(spark, schema, [*good, *bad])
    assert got[: len(good)] == [[]] * len(good)
    assert [[k for _, k in v] for v in got[len(good) :]] == [[keyword]] * len(bad)


def test_items_by_position_formats_and_names(spark):
    assert found(spark, {"items": [{"type": "string"}, {"type": "number"}], "additionalItems": {"type": "null"}}, [["a", 1, None], [1, 1, 1], ["a"]]) == [[], [("0", "type"), ("2", "type")], []]
    assert found(spark, {"format": "date"}, ["2024-02-30", "2024-02-28", "x", 5], formats=True) == [[(None, "format")], [], [(None, "format")], []]
    assert found(spark, {"format": "date"}, ["x"]) == [[]]
    assert found(spark, {"properties": {"a b": {"type": "null"}, "it's": {"type": "null"}}}, [{"a b": 1, "it's": 1}]) == [[("a b", "type"), ("it's", "type")]]
    assert found(spark, {"patternProperties": {"^n": {"type": "number"}}, "additionalProperties": {"type": "string"}}, [{"n1": "x", "o": 1, "n2": 3}]) == [[("n1", "type"), ("o", "type")]]


@pytest.mark.parametrize("schema", [{"colour": 1}, {"type": "text"}, {"$ref": "http://x"}, {"$ref": "#/none"}, {"$ref": "#"}, {"properties": {"a": 5}}])
def test_schemas_that_are_wrong(spark, schema):
    with pytest.raises(SchemaError):
        schema_violations(schema, F.parse_json(F.lit("{}")))


def test_no_json(spark):
    rows = spark.createDataFrame([("{oops",), (None,)], "doc string").select(schema_violations({}, F.try_parse_json("doc")).alias("v")).collect()
    assert [[(v.path, v.keyword) for v in r.v] for r in rows] == [[(None, "json")]] * 2


def corrections(before, after, prefix=""):
    out = []
    for k in sorted(before.keys() | after.keys()):
        path, b, a = f"{prefix}.{k}" if prefix else k, before.get(k), after.get(k)
        if isinstance(b, dict) and isinstance(a, dict):
            out += corrections(b, a, path)
        elif b != a:
            out.append((path, b, a))
    return out


def random_value(r, depth):
    kind = r.randrange(6 if depth else 4)
    if kind < 4:
        return [None, r.randrange(3), r.choice(["", "1", "é"]), r.choice([True, False, 2.5])][kind]
    return {r.choice("abc"): random_value(r, depth - 1) for _ in range(3)} if kind == 4 else [random_value(r, depth - 1) for _ in range(2)]


def test_corrections_equal_a_plain_recursion(spark):
    r = random.Random(5)
    pairs = [({k: random_value(r, 5) for k in "ab"}, {k: random_value(r, 5) for k in "bc"}) for _ in range(150)]
    deep = lambda n, leaf: leaf if n == 0 else {"x": deep(n - 1, leaf), "y": [1]}
    pairs.append((deep(40, 1), deep(40, 2)))
    df = spark.createDataFrame([(i, json.dumps(b), json.dumps(a)) for i, (b, a) in enumerate(pairs)], "id int, before string, after string")
    read = lambda x: None if x is None else json.loads(x)
    got = sorted((x.id, x.path, json.dumps(read(x.before), sort_keys=True), json.dumps(read(x.after), sort_keys=True)) for x in json_corrections(df, keys=["id"]).collect())
    # True equals 1 in Python; in JSON it does not.
    want = sorted((i, p, json.dumps(b, sort_keys=True), json.dumps(a, sort_keys=True)) for i, (x, y) in enumerate(pairs) for p, b, a in corrections(json.loads(json.dumps(x).replace("true", '"T"').replace("false", '"F"')), json.loads(json.dumps(y).replace("true", '"T"').replace("false", '"F"'))))
    assert got == [(i, p, b.replace('"T"', "true").replace('"F"', "false"), a.replace('"T"', "true").replace('"F"', "false")) for i, p, b, a in want]


def test_corrections_and_leaves_of_odd_documents(spark):
    df = spark.createDataFrame([(1, None, '{"a": 1}'), (1, None, '{"a": 1}'), (2, "{}", "{}"), (3, "[1]", "[1, 2]"), (4, "oops", "null"), (None, '{"k": 1.0}', '{"k": 2}')], "id int, before string, after string")
    assert sorted(map(tuple, json_corrections(df, keys=["id"]).collect()), key=repr) == sorted([(1, "", None, '{"a":1}')] * 2 + [(3, "", "[1]", "[1,2]"), (None, "k", "1", "2")], key=repr)
    assert sorted(map(tuple, json_leaves(df, keys=["id"], doc="after", arrays=True).collect()), key=repr) == sorted([(1, "a", "BIGINT", "1")] * 2 + [(2, "", "OBJECT", "{}"), (3, "[0]", "BIGINT", "1"), (3, "[1]", "BIGINT", "2"), (4, "", "VOID", "null"), (None, "k", "BIGINT", "2")], key=repr)
    assert json_leaves(df.where("id = 3"), keys=["id"], doc="after", arrays=False).first()["value"] == "[1,2]"
    assert json_corrections(df.limit(0), keys=["id"]).count() == 0


def test_references_equal_the_full_decoder(spark):
    r = random.Random(3)
    texts = [x for n in html5 for x in (f"&{n}", f"&{n}x", f"a&{n};b")] + [x for n in range(0x180) for x in (f"&#{n};", f"&#x{n:x}z")]
    texts += [f"&#{n}" for n in (0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDD0, 0xFDEF, 0xFFFE, 0x10000, 0x1FFFE, 0x10FFFF, 0x110000, 10**9, 10**30, 2**32 + 65)]
    texts += ["", "&", "&&", "&;", "&#", "&#;", "&#x;", "&#xg", "a & b", "&amp;lt;", "&notit;", "&am", "&\namp;", "&#00000000000065;", "&" + "a" * 40 + ";", "x" * 1000 + "&eacute;", "&amp" * 500]
    texts += ["".join(r.choices([*"&#;xX019afmpltgt \n<>é", "&amp;", "&lt", "&#x", "&not"], k=r.randrange(25))) for _ in range(2000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", unescape(F.col("t")).alias("u")).collect()
    assert [(x.t, x.u) for x in rows if x.u != html.unescape(x.t)] == []
    assert spark.range(1).select(unescape(F.lit(None).cast("string")).alias("u")).first()["u"] is None
    assert spark.range(1).select(html_text(F.lit("<p>It&#8217;s &eacute;t&eacute; &mdash; &#x1F600;</p>")).alias("u")).first()["u"] == "It’s été — \U0001f600"


def test_corrections_do_not_shuffle(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": 1}}', '{"a": {"b": 2, "c": {}}}')], "id int, before string, after string")
    out = json_corrections(df, keys=["id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "UnionLoop" not in plan
    assert sorted(map(tuple, out.collect())) == [(1, "a.b", "1", "2"), (1, "a.c", None, "{}")]


def leaves(v, path=""):
    if isinstance(v, dict) and v:
        return [x for k in v for x in leaves(v[k], f"{path}.{k}" if path else k)]
    if isinstance(v, list) and v:
        return [x for i, e in enumerate(v) for x in leaves(e, f"{path}[{i}]")]
    return [(path, v)]


def test_leaves_equal_a_plain_recursion_without_a_shuffle(spark):
    r = random.Random(8)
    docs = [{k: random_value(r, 5) for k in "ab"} for _ in range(150)]
    deep = [1]
    for _ in range(250):
        deep = {"x": deep, "y": None}
    docs += [deep, [{"a": i} for i in range(2000)], {"{[{[": "{{{", "n": [None, {"m": None}]}]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(docs)], "id int, doc string")
    out = json_leaves(df, keys=["id"])
    got = sorted((x.id, x.path, x.value) for x in out.collect())
    assert got == sorted((i, p, json.dumps(v, separators=(",", ":"), ensure_ascii=False)) for i, x in enumerate(docs) for p, v in leaves(x))
    both = json_corrections(df.select("id", F.lit("{}").alias("before"), F.col("doc").alias("after")), keys=["id"])
    for plan in (x._jdf.queryExecution().executedPlan().toString() for x in (out, both)):
        assert "Exchange" not in plan and "UnionLoop" not in plan
    assert both.where("id = 150").count() == 1


def test_documents_are_read_once_and_after_they_are_dealt_to_tasks(spark):
    df = spark.createDataFrame([(1, '{"a": [1, {}]}'), (2, None), (3, "oops"), (4, "null")], "id int, doc string")
    out = json_leaves(df.repartition(2), keys=["id"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1 and plan.index("parseJson") < plan.index("Repartition")
    assert sorted(map(tuple, out.collect())) == [(1, "a[0]", "BIGINT", "1"), (1, "a[1]", "OBJECT", "{}"), (4, "", "VOID", "null")]
