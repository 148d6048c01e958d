"""Documents of any shape: leaves with their paths, and corrections between two versions, by folds over the levels of a document's VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OBJECT, LIST = "map<string,variant>", "array<variant>"


def _document(rows: DataFrame, c: str) -> Column:
    return F.try_parse_json(F.col(c)) if rows.schema[c].dataType.simpleString() == "string" else F.col(c)


def kind_of(v: Column) -> Column:
    """The name of a value's type. It walks through all of the value: for leaves."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _under(path: Column, name: Column) -> Column:
    return F.when(path == "", name).otherwise(F.concat(path, F.lit("."), name))


def _levels(rows: DataFrame, c: str) -> Column:
    """A bound of the levels of a document: it has no more than brackets that open."""
    json = F.col(c) if rows.schema[c].dataType.simpleString() == "string" else F.to_json(F.col(c))
    without = F.replace(F.replace(json, F.lit("{"), F.lit("")), F.lit("["), F.lit(""))
    return F.coalesce(F.length(json) - F.length(without), F.lit(0))


def _opened(start: Column, levels: Column, row: str, is_open, children) -> Column:
    """The nodes (`row` each) that are left when all that is_open(node) are replaced by children(them), level by level.

    Those that are left are set aside at their own level, so that none is copied at
    those below, and steps beyond the last level cost nothing.
    """

    def step(s: Column, _: Column) -> Column:
        left = F.concat(s["left"], F.array(F.filter(s["nodes"], lambda x: ~is_open(x))))
        return F.when(F.size(s["nodes"]) > 0, F.struct(children(F.filter(s["nodes"], is_open)).alias("nodes"), left.alias("left"))).otherwise(s)

    state = F.struct(start.alias("nodes"), F.expr(f"cast(array() as array<array<{row}>>)").alias("left"))
    return F.aggregate(F.sequence(F.lit(0), levels), state, step, lambda s: F.flatten(s["left"]))


def json_leaves(docs: DataFrame, *, keys: list[str], doc: str = "doc", arrays: bool = True) -> DataFrame:
    """(keys, path, kind, value) of every leaf of the documents in column `doc` (VARIANT, or text in JSON).

    A fold opens a document's objects and, if `arrays`, lists level by level, as deep as
    they go, so that no row is joined, shuffled or kept between levels. path is dotted,
    items as [i]; kind is the leaf's type; value is JSON. Empty objects and lists are
    leaves. Null documents and text that is no JSON have none. Repeated rows give
    repeated leaves.
    """

    row = f"struct<path:string,v:variant,members:{OBJECT},items:{LIST}>"

    def read(nodes: Column) -> Column:
        # Members or items are null if it is no object or list.
        items = lambda v: F.try_variant_get(v, "$", LIST) if arrays else F.lit(None).cast(LIST)
        return F.transform(nodes, lambda x: F.struct(x["path"].alias("path"), x["v"].alias("v"), F.try_variant_get(x["v"], "$", OBJECT).alias("members"), items(x["v"]).alias("items")))

    def is_open(x: Column) -> Column:
        some = lambda c: F.coalesce(F.size(x[c]) > 0, F.lit(False))
        return some("members") | some("items")

    def within(x: Column) -> Column:
        members = F.transform(F.map_entries(x["members"]), lambda e: F.struct(_under(x["path"], e["key"]).alias("path"), e["value"].alias("v")))
        items = F.transform(x["items"], lambda v, i: F.struct(F.concat(x["path"], F.lit("["), i.cast("string"), F.lit("]")).alias("path"), v.alias("v")))
        return F.coalesce(members, items)

    rows = docs.select(*keys, _document(docs, doc).alias("_v"), _levels(docs, doc).alias("_levels"))
    # Documents that are null have no node; a filter of rows would go before what deals them to tasks, and read each document there, too.
    root = F.filter(F.array(F.struct(F.lit("").alias("path"), F.col("_v").alias("v"))), lambda x: x["v"].isNotNull())
    left = _opened(read(root), F.col("_levels"), row, is_open, lambda nodes: read(F.flatten(F.transform(nodes, within))))
    leaves = rows.select(*keys, F.inline(F.transform(left, lambda x: F.struct(x["path"].alias("path"), x["v"].alias("v")))))
    return leaves.select(*keys, "path", kind_of(F.col("v")).alias("kind"), F.to_json("v").alias("value"))


def json_corrections(pairs: DataFrame, *, keys: list[str], before: str = "before", after: str = "after") -> DataFrame:
    """(keys, path, before, after) of what differs between two versions of documents of any shape, as JSON.

    Objects are compared member by member, at any depth; lists and all else as whole
    values. A missing member equals a null one. path is dotted, empty for the
    document itself. Numbers that are equal are the same however they are written; objects are the
    same whatever the order of their members. Null, and text that is no JSON, counts as null.

    A fold over the levels opens the pairs of objects and drops what is equal, so each
    value is compared once, and no row is joined, shuffled or kept between levels.
    """

    def shown(v: Column) -> Column:
        return F.nullif(F.to_json(v), F.lit("null"))

    row = f"struct<path:string,b:variant,a:variant,bm:{OBJECT},am:{OBJECT}>"

    def is_open(x: Column) -> Column:
        return x["bm"].isNotNull() & x["am"].isNotNull()

    def differing(pairs: Column) -> Column:
        """The (path, b, a) that are two objects, which are open, or differ."""
        read = F.transform(pairs, lambda x: F.struct(*(x[c].alias(c) for c in ("path", "b", "a")), F.try_variant_get(x["b"], "$", OBJECT).alias("bm"), F.try_variant_get(x["a"], "$", OBJECT).alias("am")))
        return F.filter(read, lambda x: is_open(x) | ~shown(x["b"]).eqNullSafe(shown(x["a"])) & ~F.coalesce(_number(x["b"]) == _number(x["a"]), F.lit(False)))

    def within(x: Column) -> Column:
        names = F.array_union(F.map_keys(x["bm"]), F.map_keys(x["am"]))
        return F.transform(names, lambda n: F.struct(_under(x["path"], n).alias("path"), F.element_at(x["bm"], n).alias("b"), F.element_at(x["am"], n).alias("a")))

    rows = pairs.select(*keys, _document(pairs, before).alias("_b"), _document(pairs, after).alias("_a"), F.least(_levels(pairs, before), _levels(pairs, after)).alias("_levels"))
    start = differing(F.array(F.struct(F.lit("").alias("path"), F.col("_b").alias("b"), F.col("_a").alias("a"))))
    left = _opened(start, F.col("_levels"), row, is_open, lambda nodes: differing(F.flatten(F.transform(nodes, within))))
    told = F.transform(left, lambda x: F.struct(x["path"].alias("path"), shown(x["b"]).alias("before"), shown(x["a"]).alias("after")))
    return rows.select(*keys, F.inline(told)).select(*keys, "path", "before", "after")


def _number(v: Column) -> Column:
    """The value of a number, null for all else: a text is no number."""
    return F.when(kind_of(v).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), F.try_variant_get(v, "$", "double"))
