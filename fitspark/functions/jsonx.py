"""JSON in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def balanced(c: Column, opening: str, closing: str) -> Column:
    """The first balanced {...} or [...] in a text, aware of strings and escapes; null without one.

    A fold over the characters from the first opening one on: a struct of depth, whether
    inside a string, whether after a backslash, and the length at which depth fell to 0.
    """
    start = F.instr(c, opening)
    tail = F.substring(c, start, F.length(c))
    zero = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(s: Column, ch: Column) -> Column:
        plain = ~s["quoted"] & ~s["escaped"]
        depth = s["depth"] + F.when(plain & (ch == opening), 1).when(plain & (ch == closing), -1).otherwise(0)
        n = s["n"] + 1
        done = (s["end"] == 0) & (depth == 0)
        new = F.struct(
            depth.alias("depth"),
            F.when((ch == '"') & ~s["escaped"], ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"),
            (s["quoted"] & (ch == "\\") & ~s["escaped"]).alias("escaped"),
            n.alias("n"),
            F.when(done, n).otherwise(s["end"]).alias("end"),
        )
        return F.when(s["end"] > 0, s).otherwise(new)

    end = F.aggregate(F.split(tail, ""), zero, step, lambda s: s["end"])
    return F.when((start > 0) & (end > 0), F.substring(tail, F.lit(1), end))


def tolerant_json(c: Column) -> Column:
    """The JSON value in an answer, as VARIANT: the whole text, else a fenced block, else the first balanced object, else array; null if none parses."""
    # A text that begins otherwise is no JSON: an attempt to parse it would cost an exception.
    parse = lambda x: F.when(x.rlike(r'^\s*[\[{"0-9tfn-]'), F.try_parse_json(x))
    fenced = F.nullif(F.regexp_extract(c, r"(?s)```(?:json|JSON)?\s*(.*?)```", 1), F.lit(""))
    return F.coalesce(parse(F.trim(c)), parse(F.trim(fenced)), parse(balanced(c, "{", "}")), parse(balanced(c, "[", "]")))


def member(v: Column, path: str, kind: str = "string") -> Column:
    """A member of a VARIANT in a type; null if it is missing or cannot be cast."""
    return F.try_variant_get(v, f"$.{path}", kind)
