"""Sections of job texts, and lines merged from several readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitspark.functions import arrays, text

# Sections and the words in a header that name them, in order of precedence.
SECTIONS = {
    "responsibilities": ("responsibilit", "what you'll do", "what you will do", "role", "the job", "key job", "day in the life", "about the role"),
    "qualifications": ("qualification", "requirement", "what you'll bring", "what you will bring", "who you are", "skills", "we're looking for", "we are looking for", "basic qualification", "minimum qualification", "preferred qualification", "you have", "you'll need"),
    "location": ("location", "where you", "remote", "hybrid", "onsite", "office"),
    "about": ("about the team", "about us", "who we are", "company"),
    "comp": ("compensation", "salary", "benefits", "pay range"),
}
HEADER = r"^\s{0,4}[A-Z].{0,60}?\s*:?\s*$"
SHORT, LONG = 120, 6000


def section_of(header: Column) -> Column:
    """The section that a header names, or null."""
    low = F.lower(header)
    out = F.lit(None).cast("string")
    for name, words in reversed(SECTIONS.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, name).otherwise(out)
    return out


def with_sections(rows: DataFrame, column: str = "text") -> DataFrame:
    """Add `sections`, a map of section to text.

    A header is a short line that begins with a capital. What follows belongs to its
    section until the next header; headers that name none end a section, too. A fold
    over the lines of each text carries the section on, so nothing is exploded.
    """
    lines = F.split(F.trim(F.coalesce(F.col(column), F.lit(""))), "\n")
    row = "struct<section:string,line:string>"

    def step(now: Column, line: Column) -> tuple[Column, Column]:
        header = line.rlike(HEADER)
        new = F.when(header, section_of(line)).otherwise(now)
        return new, F.when(~header & now.isNotNull(), F.array(F.struct(now.alias("section"), line.alias("line")))).otherwise(F.expr(f"cast(array() as array<{row}>)"))

    placed = arrays.gathered(lines, F.lit(None).cast("string"), row, step)

    def body(name: str) -> Column:
        return F.trim(F.regexp_replace(F.array_join(F.transform(F.filter("_placed", lambda p: p["section"] == name), lambda p: p["line"]), "\n"), r"^\s+|\s+$", ""))

    out = rows.withColumn("_placed", placed)
    found = F.map_from_arrays(F.array(*(F.lit(n) for n in SECTIONS)), F.array(*(body(n) for n in SECTIONS)))
    return out.withColumn("sections", F.map_filter(found, lambda k, v: v != "")).drop("_placed")


def snippet(column: str, *names: str, head: int = 0) -> Column:
    """The head of a text and some of its sections, blank lines between; the whole text if that is short; cut."""
    whole = F.trim(F.coalesce(F.col(column), F.lit("")))
    parts = [F.substring(whole, 1, head)] if head else []
    parts += [F.coalesce(F.element_at("sections", F.lit(n)), F.lit("")) for n in names]
    joined = F.trim(F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "\n\n"))
    return F.substring(F.when(F.length(joined) < SHORT, whole).otherwise(joined), 1, LONG)


def merge_lines(passes: Column) -> Column:
    """Lines of several readings of a page, each once, in the order of the first that has it."""
    lines = F.filter(F.flatten(F.transform(passes, lambda p: F.split(F.coalesce(p, F.lit("")), "\n"))), lambda x: text.tidy_key(x) != "")
    return F.array_join(arrays.distinct_by(F.transform(lines, lambda x: F.trim(x)), text.tidy_key), "\n")
