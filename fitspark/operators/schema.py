"""JSON Schema documents compiled to one expression over VARIANT values.

A schema becomes a column that lists every violation of a document, in the order
of their paths. All of it is built-in functions: no document goes to Python.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from fitspark.config import Verdict
from fitspark.dialect import java_pattern

#: A violation; `place` has the steps of its path, indexes marked, and sorts as paths do.
ERROR = "array<struct<place:array<string>,position:int,keyword:string,message:string>>"
#: Keywords that say nothing about validity. `format` is a note, too, unless formats are asked for.
NOTES = {"$schema", "$id", "$comment", "title", "description", "default", "examples", "definitions", "$defs", "readOnly", "writeOnly", "format", "then", "else", "additionalItems"}
#: An index in a place: it sorts as a number.
INDEX, DIGITS = "\x00", 10
SIMPLE = {"type", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "pattern", "format", "required", "minItems", "maxItems", "uniqueItems", "minProperties", "maxProperties"}
NESTED = {"properties", "patternProperties", "additionalProperties", "propertyNames", "items", "contains", "allOf", "anyOf", "oneOf", "not", "if", "$ref"}

Place = tuple[Column, ...]


class SchemaError(ValueError):
    """The schema itself is wrong, or uses what is not known here."""


def none() -> Column:
    return F.expr(f"cast(array() as {ERROR})")


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def member_path(name: str) -> str:
    if "'" in name and '"' in name:
        raise SchemaError(f"a member's name has both kinds of quotes: {name}")
    return f"$['{name}']" if "'" not in name else f'$["{name}"]'


def json_key(value: Any) -> str:
    """Equal JSON values have equal keys: members in order, and whole numbers without a fraction."""

    def plain(v):
        if isinstance(v, dict):
            return {k: plain(x) for k, x in sorted(v.items())}
        if isinstance(v, list):
            return [plain(x) for x in v]
        return int(v) if isinstance(v, float) and v.is_integer() else v

    return json.dumps(plain(value), ensure_ascii=False, separators=(",", ":"))


class _Compiler:
    def __init__(self, root: Any, formats: bool) -> None:
        self.root, self.formats = root, formats

    def node(self, schema: Any, value: Column, place: Place, refs: tuple[str, ...] = ()) -> Column:
        """All violations of a value, which may be null if it is not there."""
        if schema is True or schema == {}:
            return F.lit(None).cast(ERROR)
        if schema is False:
            return self.errors([(F.lit(True), "false", 0, F.lit("nothing is allowed here"))], place)
        if not isinstance(schema, dict):
            raise SchemaError(f"a schema must be an object or a boolean: {schema!r}")
        if unknown := schema.keys() - NOTES - SIMPLE - NESTED:
            raise SchemaError(f"unknown keywords: {', '.join(sorted(unknown))}")
        if "$ref" in schema:  # what stands beside a reference is ignored
            schema = {"$ref": schema["$ref"]}

        def checked(x: Column) -> Column:
            v, kind = x["v"], x["kind"]
            simple, nested = [], []
            for i, (key, want) in enumerate(schema.items()):
                if key in SIMPLE:
                    simple += [(bad, key, i * 1000 + j, message) for j, (bad, message) in enumerate(self.simple(key, want, v, kind))]
                elif key in NESTED:
                    nested += self.nested(key, want, schema, v, kind, place, refs, i * 1000)
            parts = [self.errors(simple, place)] * bool(simple) + [F.coalesce(n, none()) for n in nested]
            return F.concat(*parts) if parts else none()

        kind = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
        return F.when(value.isNotNull(), bound(F.struct(value.alias("v"), kind.alias("kind")), checked))

    def errors(self, checks, place: Place) -> Column:
        where = F.array(*place) if place else F.expr("cast(array() as array<string>)")
        each = [F.when(F.coalesce(bad, F.lit(False)), F.struct(where.alias("place"), F.lit(i).alias("position"), F.lit(key).alias("keyword"), message.alias("message"))) for bad, key, i, message in checks]
        return F.array_compact(F.array(*each)).cast(ERROR)

    def simple(self, key: str, want: Any, v: Column, kind: Column) -> list[tuple[Column, Column]]:
        """(violated, message) of a keyword that looks at the value alone."""
        text, shown = F.try_variant_get(v, "$", "string"), F.to_json(v)
        number, is_number, is_text = F.try_variant_get(v, "$", "double"), kind.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), kind == "STRING"
        items, members = F.size(F.try_variant_get(v, "$", "array<variant>")), F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
        is_array, is_object = kind == "ARRAY", kind == "OBJECT"
        says = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
        told = json.dumps(want, ensure_ascii=False)
        if key == "type":
            fits = {"string": is_text, "number": is_number, "integer": is_number & (number % 1 == 0), "boolean": kind == "BOOLEAN", "null": kind == "VOID", "array": is_array, "object": is_object}
            kinds = [want] if isinstance(want, str) else want
            if wrong := set(kinds) - fits.keys():
                raise SchemaError(f"unknown types: {', '.join(sorted(map(str, wrong)))}")
            ok = fits[kinds[0]]
            for k in kinds[1:]:
                ok = ok | fits[k]
            return [(~ok, says(shown, " is not of type ", ", ".join(kinds)))]
        if key in ("enum", "const"):
            allowed = want if key == "enum" else [want]
            same = F.when(is_number & (number % 1 == 0) & (F.abs(number) < 2**53), number.cast("long").cast("string")).otherwise(shown)
            return [(~same.isin([json_key(x) for x in allowed]), says(shown, " is not one of " if key == "enum" else " is not ", told))]
        compare = {
            "minimum": (number < want, "is less than"), "maximum": (number > want, "is greater than"), "exclusiveMinimum": (number <= want, "is not above"), "exclusiveMaximum": (number >= want, "is not below"),
        } if key in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum") else {}
        if compare:
            return [(is_number & compare[key][0], says(shown, f" {compare[key][1]} ", told))]
        if key == "multipleOf":
            times = number / want
            return [(is_number & (F.abs(times - F.rint(times)) > 1e-9), says(shown, " is no multiple of ", told))]
        if key in ("minLength", "maxLength"):
            n = F.char_length(text)
            return [(is_text & ((n < want) if key == "minLength" else (n > want)), says(shown, " is too ", "short" if key == "minLength" else "long"))]
        if key == "pattern":
            return [(is_text & ~text.rlike(java_pattern(want)), says(shown, " does not match ", want))]
        if key == "format":
            if not self.formats or want != "date":
                return []
            return [(is_text & (~text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") | F.try_to_date(text, "yyyy-MM-dd").isNull()), says(shown, " is no date"))]
        if key == "required":
            return [(is_object & ~F.array_contains(members, k), says(f"'{k}' is required")) for k in want]
        if key in ("minItems", "maxItems"):
            return [(is_array & ((items < want) if key == "minItems" else (items > want)), says(items.cast("string"), " items are too ", "few" if key == "minItems" else "many"))]
        if key == "uniqueItems":
            keys = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.to_json(x))
            return [(is_array & (F.size(F.array_distinct(keys)) < F.size(keys)), says("items are repeated"))] if want else []
        n = F.size(members)
        return [(is_object & ((n < want) if key == "minProperties" else (n > want)), says(n.cast("string"), " members are too ", "few" if key == "minProperties" else "many"))]

    def nested(self, key: str, want: Any, schema: dict, v: Column, kind: Column, place: Place, refs: tuple[str, ...], position: int) -> list[Column]:
        """Violations of a keyword that applies schemas to the value or to what is in it."""
        here = lambda s: self.node(s, v, place, refs)
        valid = lambda s: F.coalesce(F.size(here(s)), F.lit(0)) == 0
        one = lambda bad, message: [self.errors([(bad, key, position, F.lit(message))], place)]
        if key == "properties":
            return [F.when(kind == "OBJECT", self.node(s, F.try_variant_get(v, member_path(k), "variant"), (*place, F.lit(k)), refs)) for k, s in want.items()]
        if key in ("patternProperties", "additionalProperties"):
            patterns = schema.get("patternProperties", {})
            if key == "patternProperties":
                parts = [(s, lambda k, p=p: k.rlike(java_pattern(p))) for p, s in patterns.items()]
            else:
                known = list(schema.get("properties", {}))
                other = lambda k: F.lit(True) if not known else ~k.isin(known)
                for p in patterns:
                    other = lambda k, f=other, p=p: f(k) & ~k.rlike(java_pattern(p))
                if want is False:
                    extra = F.filter(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), lambda k: other(k))
                    return [self.errors([((kind == "OBJECT") & (F.size(extra) > 0), key, position, F.concat(F.lit("unexpected members: "), F.array_join(extra, ", ")))], place)]
                parts = [(want, other)]

            def members(s: Any, applies) -> Column:
                fitting = F.filter(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: applies(e["key"]))
                return F.when(kind == "OBJECT", F.flatten(F.transform(fitting, lambda e: F.coalesce(self.node(s, e["value"], (*place, e["key"]), refs), none()))))

            return [members(s, f) for s, f in parts]
        if key == "propertyNames":
            return self.names(want, v, kind, place, key, position)
        if key in ("items", "contains"):
            values = F.try_variant_get(v, "$", "array<variant>")
            step = lambda i: F.concat(F.lit(INDEX), F.lpad(i.cast("string"), DIGITS, "0"))
            each = lambda s, x, i: F.coalesce(self.node(s, x, (*place, step(i)), refs), none())
            if key == "contains":
                fits = F.exists(F.transform(values, lambda x, i: F.size(each(want, x, i)) == 0), lambda ok: ok)
                return one((kind == "ARRAY") & ~fits, "no item fits")
            if isinstance(want, list):  # a schema for each of the first items, and one for the rest
                first = [F.when(kind == "ARRAY", self.node(s, F.get(values, F.lit(i)), (*place, step(F.lit(i))), refs)) for i, s in enumerate(want)]
                rest = schema.get("additionalItems", True)
                tail = F.flatten(F.transform(values, lambda x, i: F.when(i >= len(want), each(rest, x, i)).otherwise(none())))
                return first + [F.when(kind == "ARRAY", tail)] * (rest is not True)
            return [F.when(kind == "ARRAY", F.flatten(F.transform(values, lambda x, i: each(want, x, i))))]
        if key == "allOf":
            return [here(s) for s in want]
        if key in ("anyOf", "oneOf"):
            fitting = sum((valid(s).cast("int") for s in want[1:]), valid(want[0]).cast("int"))
            return one(fitting == 0 if key == "anyOf" else fitting != 1, f"not {'any' if key == 'anyOf' else 'exactly one'} of the schemas fits")
        if key == "not":
            return one(valid(want), "fits what it must not")
        if key == "if":
            ways = [F.when(valid(want) if k == "then" else ~valid(want), here(schema[k])) for k in ("then", "else") if k in schema]
            return ways
        if want in refs:
            raise SchemaError(f"a schema that contains itself has no expression: {want}")
        return [self.node(self.lookup(want), v, place, (*refs, want))]

    def names(self, want: Any, v: Column, kind: Column, place: Place, key: str, position: int) -> list[Column]:
        """Violations of the members' names."""
        names = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
        as_json = lambda k: F.get(F.try_variant_get(F.parse_json(F.to_json(F.array(k))), "$", "array<variant>"), F.lit(0))
        wrong = F.filter(names, lambda k: F.coalesce(F.size(self.node(want, as_json(k), place)), F.lit(0)) > 0)
        return [self.errors([((kind == "OBJECT") & (F.size(wrong) > 0), key, position, F.concat(F.lit("names that are not allowed: "), F.array_join(wrong, ", ")))], place)]

    def lookup(self, ref: str) -> Any:
        if not ref.startswith("#"):
            raise SchemaError(f"only references within the schema are followed: {ref}")
        at = self.root
        for step in ref[1:].split("/")[1:]:
            step = step.replace("~1", "/").replace("~0", "~")
            try:
                at = at[int(step)] if isinstance(at, list) else at[step]
            except (KeyError, IndexError, ValueError) as e:
                raise SchemaError(f"nothing stands at {ref}") from e
        return at


def schema_violations(schema: dict | bool | str, doc: Column, *, formats: bool = False) -> Column:
    """All violations of a document (VARIANT) of a JSON Schema (draft 7), in the order of their paths, as
    array<struct<path, top, keyword, message>>; an empty one for a valid document.

    `schema` is a dict, or the text of a schema file. path has the steps to the
    value, dotted, indexes as numbers; top is the first of them; both are null for
    the document itself. A missing value is checked by `required` alone. A null document,
    which is what text that is no JSON becomes, has one violation with keyword json.
    Violations of one value stand in the order of the schema's keywords. References
    within the schema are followed; a schema that contains itself, an unknown
    keyword or type raises SchemaError.
    """
    if isinstance(schema, str):
        schema = json.loads(schema)
    found = F.sort_array(F.coalesce(_Compiler(schema, formats).node(schema, doc, ()), none()))

    def shown(e: Column) -> Column:
        steps = F.transform(e["place"], lambda s: F.when(s.startswith(INDEX), F.substring(s, 2, DIGITS).cast("long").cast("string")).otherwise(s))
        return F.struct(F.nullif(F.array_join(steps, "."), F.lit("")).alias("path"), F.get(steps, F.lit(0)).alias("top"), e["keyword"].alias("keyword"), e["message"].alias("message"))

    nothing = F.lit(None).cast("string")
    no_json = F.array(F.struct(nothing.alias("path"), nothing.alias("top"), F.lit("json").alias("keyword"), F.lit("no JSON").alias("message")))
    return F.when(doc.isNull(), no_json).otherwise(F.transform(found, shown))


def first_schema_violation(schema: dict | bool | str, doc: Column, *, formats: bool = False) -> Column:
    """The first violation by path, struct<path, top, keyword, message>; null for a valid document."""
    return F.get(schema_violations(schema, doc, formats=formats), F.lit(0))


class JsonSchemaValidator:
    """Documents, one at a time, by the column that tables of them are checked with."""

    def __init__(self, spark: SparkSession, schema: dict | bool | str, *, formats: bool = False) -> None:
        self.spark, self.check = spark, first_schema_violation(schema, F.try_parse_json("doc"), formats=formats)

    def validate(self, d: dict) -> Verdict:
        first = self.spark.createDataFrame([(json.dumps(d),)], "doc string").select(self.check.alias("v")).first()["v"]
        return Verdict(True) if first is None else Verdict(False, first["message"], first["path"] or "<root>", first["top"])
