"""Places of pattern matches in texts, as JVM-side expressions.

Built-in functions give the text of matches but not their places. A match is
therefore wrapped in a mark that no pattern contains, and the marked text is
split: matches and what stands between them alternate, and running sums of their
lengths in code points are the places.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK, INSTEAD = "\x01", "\x02"

SPAN = "struct<start:int,stop:int,match:string,before:string,after:string>"


#: Matches are folded in blocks of so many: a fold copies what it has for each match, so a block is small, and blocks are few.
BLOCK = 256


def matches(text: Column, pattern: str, only_if: Column | None = None) -> Column:
    """Leftmost non-overlapping matches in order, as array<struct<start, stop, match, before, after>>.

    `pattern` is a Java regular expression that matches neither U+0001 nor U+0002
    nor the empty string. before and after are up to 24 code points around it.
    `only_if` is a cheap condition that holds for every text with a match. The work
    is in proportion to the text, however many matches it has.
    """
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    # A mark that the text has itself becomes another control character; no pattern sees the difference.
    marked = F.regexp_replace(F.translate(text, MARK, INSTEAD), pattern, f"{MARK}$0{MARK}")

    def bound(value: Column, f) -> Column:
        """f(value) with the value computed once: an expression that is named twice would be computed twice."""
        return F.element_at(F.transform(F.array(value), f), 1)

    def folded(p: Column, lengths: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.get(lengths, i - 1)
            stop = start + F.get(lengths, i)
            span = F.struct(start.alias("start"), stop.alias("stop"), F.get(p, i).alias("match"), F.right(F.get(p, i - 1), F.lit(24)).alias("before"), F.left(F.get(p, i + 1), F.lit(24)).alias("after"))
            return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        def block(acc: Column, first: Column) -> Column:
            here = F.sequence(first, F.least(first + 2 * (BLOCK - 1), F.size(p) - 2), F.lit(2))
            return F.aggregate(here, F.struct(acc["at"].alias("at"), none.alias("out")), add, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

        firsts = F.sequence(F.lit(1), F.size(p) - 2, F.lit(2 * BLOCK))
        zero = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<array<{SPAN}>>)").alias("out"))
        return F.aggregate(firsts, zero, block, lambda acc: F.flatten(acc["out"]))

    found = bound(F.split(marked, MARK, -1), lambda p: bound(F.transform(p, F.char_length), lambda n: F.when(F.size(p) > 1, folded(p, n)).otherwise(none)))
    some = text.rlike(pattern)
    return F.when(some if only_if is None else only_if & some, found).otherwise(none)


def labelled(spans: Column, kind: str, order: int) -> Column:
    """array<struct<start, order, stop, kind>>, which sorts by start, then kind as listed."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["stop"].alias("stop"), F.lit(kind).alias("kind")))


def written_out(spans: Column) -> Column:
    """kind:start:stop of the spans by start, comma-joined."""
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def normal_below(z: Column) -> Column:
    """The standard normal distribution function, by a logistic form that is right within 2e-4."""
    return 1 / (1 + F.exp(-(z * 1.5976 + z * z * z * 0.070566)))
