"""Character references of HTML, decoded in one pass by expressions."""

from __future__ import annotations

import html
import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A reference behind its ampersand: a number, or a name of up to 32 characters with or without a semicolon.
REFERENCE = r"^&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: Names that hold without a semicolon, even at the beginning of a longer one.
BARE = {n: c for n, c in html5.items() if not n.endswith(";")}
#: Numbers below this may stand for other characters, or for none.
ODD = 0xA0


def bound(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def constant(value, kind: str) -> Column:
    """A constant of a nested type, which the optimizer folds into one literal: a map of thousands of literals is slow to plan."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _names() -> Column:
    """All names by their first two characters: a map is searched from its beginning, so two short ones beat a long one."""
    groups: dict[str, dict[str, str]] = {}
    for n, c in html5.items():
        groups.setdefault(n[:2], {})[n] = c
    return constant(groups, "map<string,map<string,string>>")


def character(number: Column) -> Column:
    """The character of a code point, from its four bytes."""
    return F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")


def _numbered(ref: Column) -> Column:
    """What a reference by number stands for."""
    hexadecimal = F.lower(F.substring(ref, 2, 1)) == "x"
    digits = F.regexp_replace(F.when(hexadecimal, F.regexp_extract(ref, "^#[xX]([0-9a-fA-F]+)", 1)).otherwise(F.regexp_extract(ref, "^#([0-9]+)", 1)), "^0+(?=.)", "")
    # More digits than any code point has stay above all of them.
    number = F.when(F.length(digits) > 9, F.lit(2**31)).when(hexadecimal, F.conv(digits, 16, 10).cast("long")).otherwise(digits.cast("long"))
    odd = constant([html.unescape(f"&#{n};") for n in range(ODD)], "array<string>")

    def of(n: Column) -> Column:
        none = n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
        return F.when(n < ODD, F.get(odd, n.cast("int"))).when((n > 0x10FFFF) | n.between(0xD800, 0xDFFF), F.lit("�")).when(none, F.lit("")).otherwise(character(n))

    return bound(number, of)


def _named(ref: Column) -> Column:
    """What a reference by name stands for; else the longest name that it begins with, and the rest; else itself."""
    exact = F.element_at(F.element_at(_names(), F.left(ref, F.lit(2))), ref)
    longest = max(map(len, BARE))
    bare = constant(BARE, "map<string,string>")
    begins = [F.when(F.length(ref) > n, F.concat(F.element_at(bare, F.left(ref, F.lit(n))), F.substr(ref, F.lit(n + 1)))) for n in range(longest, 1, -1)]
    return F.coalesce(exact, *begins, F.concat(F.lit("&"), ref))


def unescape(c: Column) -> Column:
    """The text with all character references decoded, once: by decimal and hexadecimal numbers, and by all names of HTML 5.

    The text is split before each ampersand, so it is scanned once, and what a
    reference stands for is not decoded again. Unknown references stay. Text without
    an ampersand is not split.
    """

    def piece(p: Column) -> Column:
        def decoded(ref: Column) -> Column:
            found = F.when(ref.startswith("#"), _numbered(ref)).otherwise(_named(ref))
            return F.when(ref == "", p).otherwise(F.concat(found, F.substr(p, F.length(ref) + 2)))

        return F.when(p.startswith("&"), bound(F.regexp_extract(p, REFERENCE, 1), decoded)).otherwise(p)

    return F.when(c.contains("&"), F.array_join(F.transform(F.split(c, "(?=&)", -1), piece), "")).otherwise(c)
