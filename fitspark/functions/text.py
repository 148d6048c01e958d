"""Text, tokens and patterns. Patterns are in Python's form unless a function says otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from fitspark.dialect import java_pattern
from fitspark.functions import arrays
from fitspark.functions.entities import unescape

# Fixed values.
STOPWORDS = ("a", "an", "the", "and", "or", "of", "to", "in", "on", "for", "with", "is", "are", "that", "this", "at", "by", "as", "be", "it", "from")
# What tags of a page become.
TAGS = (
    (r"(?i)<\s*br\s*/?>", "\n"),
    (r"(?i)<\s*li[^>]*>", "\n- "),
    (r"(?i)</\s*(?:p|div|section|ul|ol|h[1-6])\s*>", "\n"),
    (r"(?i)<\s*h[1-6][^>]*>", "\n\n"),
    (r"<[^>]+>", ""),
)
# Statements of notice, in days and months, and that there is none.
NOTICE_DAYS = r"(\d{1,3})\s*days?\s*(?:notice|left|remaining)"
NOTICE_MONTHS = r"(\d{1,2})\s*months?\s*notice"
NOTICE_NONE = r"immediate(?:ly)?\s+(?:joiner|available)"
YEARS = r"(\d+(?:\.\d+)?)\s*years of (?:hands[- ]on )?experience"


def tokens(c: Column) -> Column:
    """Distinct ASCII words of two or more letters or digits, in lower case, without stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS)))


def lexical(query: Column, document: Column) -> Column:
    """The share of the query's tokens that the document has; 0 without tokens."""
    return F.when((F.size(query) > 0) & (F.size(document) > 0), F.size(F.array_intersect(query, document)) / F.size(query)).otherwise(F.lit(0.0))


def flag(c: Column, pattern: str | None) -> Column:
    """1.0 if the pattern is found anywhere, without case; 0.0 without a pattern."""
    return F.lit(0.0) if not pattern else F.coalesce(c.rlike(java_pattern(pattern)).cast("double"), F.lit(0.0))


def count_matches(c: Column, pattern: str | None) -> Column:
    """The number of matches that do not overlap."""
    return F.lit(0) if not pattern else F.coalesce(F.regexp_count(c, F.lit(java_pattern(pattern))), F.lit(0))


def count_literal(c: Column, term: str) -> Column:
    """The number of occurrences that do not overlap; an empty term counts as none."""
    if not term:
        return F.lit(0)
    return ((F.length(c) - F.length(F.replace(c, F.lit(term), F.lit("")))) / len(term)).cast("int")


def count_terms(c: Column, terms) -> Column:
    out = F.lit(0)
    for t in terms:
        out = out + count_literal(c, t.lower())
    return out


def domain_ratio(c: Column, inside, outside) -> Column:
    """(in + 1) / (in + out + 2) over literal counts in the lower-case text."""
    low = F.lower(c)
    n_in, n_out = count_terms(low, inside), count_terms(low, outside)
    return (n_in + 1) / (n_in + n_out + 2)


def years_claimed(c: Column) -> Column:
    """The years of experience that a text states, or null."""
    return F.nullif(F.regexp_extract(c, java_pattern(YEARS), 1), F.lit("")).try_cast("double")


def notice_days(c: Column) -> Column:
    """Days of notice that a text states, 0 to 180, or null."""

    def stated(low: Column) -> Column:
        take = lambda rx: F.regexp_extract(low, rx, 1).try_cast("int")
        return F.coalesce(take(NOTICE_DAYS), take(NOTICE_MONTHS) * 30, F.when(low.rlike(NOTICE_NONE), 0))

    # Numbers have no sign; least() would skip a null.
    return arrays.bound(arrays.bound(F.lower(c), stated), lambda n: F.when(n > 180, 180).otherwise(n))


def score_of(c: Column) -> Column:
    """A score of 0 to 100 in an answer: a JSON member fit_0_100, fit or score, else the first number; 0 without one."""
    v = F.try_parse_json(c)
    members = [F.try_variant_get(v, f"$.{k}", "double") for k in ("fit_0_100", "fit", "score")]
    number = F.nullif(F.regexp_extract(c, r"\b(\d{1,3}(?:\.\d+)?)\b", 1), F.lit("")).try_cast("double")
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.coalesce(*members, number, F.lit(0.0))))


def slug(c: Column) -> Column:
    """An identifier: runs of other characters become _, a letter comes first, 32 characters at most."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    s = F.when((s != "") & ~s.rlike("^[a-z]"), F.concat(F.lit("sig_"), s)).otherwise(s)
    s = F.regexp_replace(F.substring(s, 1, 32), "_+$", "")
    return F.when(s == "", F.lit("signal")).otherwise(s)


def unique_slugs(labels: Column) -> Column:
    """Identifiers of an array of labels; one that was taken before gets _2, _3 and so on."""

    def add(taken: Column, label: Column) -> Column:
        s = slug(label)
        options = F.transform(F.sequence(F.lit(1), F.size(taken) + 1), lambda i: F.when(i == 1, s).otherwise(F.concat(s, F.lit("_"), i.cast("string"))))
        return F.concat(taken, F.array(F.get(F.filter(options, lambda o: ~F.array_contains(taken, o)), F.lit(0))))

    return F.aggregate(labels, F.expr("cast(array() as array<string>)"), add)


def quoted(c: Column) -> Column:
    """The text with every character that a pattern treats specially escaped."""
    return F.regexp_replace(c, r"([\\.^$|?*+()\[\]{}])", r"\\$1")


def any_of(terms: Column) -> Column:
    """A pattern that matches any of the terms literally."""
    return F.array_join(F.transform(F.filter(terms, lambda t: t != ""), quoted), "|")


def tidy_key(c: Column) -> Column:
    """White space collapsed, trimmed, in lower case: the key under which lines are the same."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def nearly_empty(c: Column, pages: Column, least: int = 20) -> Column:
    """Fewer than `least` characters that are no white space, for each page."""
    return F.length(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")) / F.greatest(F.lit(1), pages) < least


def first_line(c: Column, width: int = 80) -> Column:
    """The first line that is not blank, trimmed and cut; empty without one."""
    line = F.get(F.filter(F.split(c, "\n"), lambda x: F.trim(x) != ""), F.lit(0))
    return F.coalesce(F.substring(F.trim(line), 1, width), F.lit(""))


def lower_list(a: Column) -> Column:
    return F.filter(F.transform(a, lambda x: F.lower(F.trim(x))), lambda x: x != "")


def html_text(c: Column) -> Column:
    """The text of HTML: breaks and block ends become new lines, items get '- ', headings a blank line before; tags go.

    Bodies of script and style stay, as tags alone are removed. HTML that is itself
    escaped is unescaped first.
    """
    t = F.coalesce(c, F.lit(""))
    t = F.when(t.contains("&lt;"), unescape(t)).otherwise(t)
    for pattern, instead in TAGS:
        t = F.regexp_replace(t, pattern, instead)
    t = unescape(t)
    t = F.regexp_replace(t, r"[ \t]+\n", "\n")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def posting_description(c: Column) -> Column:
    """The description in the first JSON-LD block of a page that has one, or null."""
    blocks = F.regexp_extract_all(c, F.lit(r'(?is)<script[^>]+type="application/ld\+json"[^>]*>(.*?)</script>'), F.lit(1))
    found = F.transform(blocks, lambda b: F.try_variant_get(F.try_parse_json(F.trim(b)), "$.description", "string"))
    return F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))


def plain(pattern: str) -> str:
    """Escape a literal for a Java pattern."""
    return re.escape(pattern)
