"""Secrets in texts: fixed patterns, and a battery of randomness tests. JVM-side expressions throughout."""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitspark.llm.common import text_of, written
from fitspark.llm.spans import labelled, matches, normal_below, written_out

ASSIGN = r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+"
ASSIGN_VALUE = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
#: Runs of 24 and more; shorter runs would be dropped, and none starts inside a run.
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

#: A string to test: 20 or more characters of the usual encodings, with a digit or an upper-case letter after a lower-case one.
LEAST = 20
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9]|[A-Za-z+/_-]*?[a-z][A-Z])[A-Za-z0-9+/_-]{20,}+"

#: Inferred encodings, the first that fits: name, pattern, alphabet.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("decimal", r"^[0-9]+$", DIGITS),
    ("hex", r"^[0-9a-f]+$", DIGITS + "abcdef"),
    ("hex_upper", r"^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", r"^[A-Z2-7]+$", UPPER + "234567"),
    ("base36", r"^[0-9a-z]+$", DIGITS + LOWER),
    ("base62", r"^[0-9A-Za-z]+$", UPPER + LOWER + DIGITS),
    ("base64url", r"^[0-9A-Za-z_-]+$", UPPER + LOWER + DIGITS + "-_"),
    ("base64", r".", UPPER + LOWER + DIGITS + "+/-_"),
)
#: The chance that two characters of an ordinary name are equal; at least twice that of a uniform alphabet.
CONCENTRATION = 0.06
#: An ordinary name changes between upper case, lower case, digits and signs at most this share as often as a uniform string.
CLASS_CHANGES = 0.4
#: The share of false discoveries that is aimed at, in each stratum of encoding and length.
FALSE_SHARE = 0.05
#: p-values are counted in bins of a quarter of a power of ten, PBINS of them.
PBINS = 80


def base_spans(text: Column) -> Column:
    assign = F.filter(matches(text, ASSIGN), lambda s: F.char_length(F.regexp_extract(s["match"], ASSIGN_VALUE, 1)) >= 6)
    access = F.filter(matches(text, ACCESS), lambda s: F.char_length(s["match"]) >= 20)
    return F.concat(labelled(assign, "assign", 0), labelled(access, "access", 1), labelled(matches(text, HEX), "hex", 2))


def _classes(alphabet: str) -> str:
    """The class of each character of an alphabet; the halves of one that has one class only."""
    of = "".join("D" if c in DIGITS else "L" if c in LOWER else "U" if c in UPPER else "S" for c in alphabet)
    return of if len(set(of)) > 1 else "A" * (len(of) // 2) + "B" * (len(of) - len(of) // 2)


def _fisher(*ps: Column) -> Column:
    """Fisher's combination of two or three p-values."""
    log = sum((F.log(F.greatest(p, F.lit(1e-30))) for p in ps[1:]), F.log(F.greatest(ps[0], F.lit(1e-30))))
    return F.exp(log) * (1 - log + (log * log / 2 if len(ps) == 3 else F.lit(0.0)))


def _battery(value: Column, alphabet: str) -> Column:
    """One p-value of three tests: the chance that an ordinary name of this length looks as random.

    Chi-squared test of the characters' counts, runs test of their classes, and
    lag-1 serial correlation. Against a uniform string, each gives the chance of
    what is seen, and Fisher's rule joins them. Against an ordinary name the first
    two do so: names use few characters and change class rarely. The quotient of
    both is small only for strings that no name resembles and that all three
    tests find uniform. It is never below the second, so it bounds false discoveries.
    """
    k = len(alphabet)
    n = F.char_length(value).cast("double")
    chars = F.split(value, "")
    squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc + F.pow((F.char_length(value) - F.char_length(F.replace(value, c, F.lit("")))).cast("double"), F.lit(2.0)))
    chi = squares * k / n - n
    df = k - 1
    middle, variance = (k - 1) / 2, (k * k - 1) / 12
    classes = _classes(alphabet)
    rate = 1 - sum((classes.count(c) / k) ** 2 for c in set(classes))
    places = F.transform(chars, lambda c: F.struct((F.instr(F.lit(alphabet), c) - 1 - middle).alias("v"), F.translate(c, alphabet, classes).alias("c")))

    def over(v: Column) -> Column:
        zero = F.struct(F.lit(0.0).alias("changes"), F.lit(0.0).alias("products"))
        pair = lambda acc, i: F.struct(
            (acc["changes"] + F.when(F.get(v, i)["c"] != F.get(v, i + 1)["c"], 1.0).otherwise(0.0)).alias("changes"), (acc["products"] + F.get(v, i)["v"] * F.get(v, i + 1)["v"]).alias("products")
        )
        return F.aggregate(F.sequence(F.lit(0), F.size(v) - 2), zero, pair)

    def judged(x: Column) -> Column:
        chi, chi_z, changes, products = (x[c] for c in ("chi", "chi_z", "changes", "products"))
        runs_z = (changes - (n - 1) * rate) / F.sqrt((n - 1) * rate * (1 - rate))
        serial_z = products / (F.sqrt(n - 1) * variance)
        two_sided = lambda z: 2 * normal_below(-F.abs(z))
        uniform = _fisher(normal_below(-chi_z), two_sided(runs_z), two_sided(serial_z))
        excess = k * max(CONCENTRATION, 2 / k) - 1
        name_z = (chi - (df + n * excess)) / F.sqrt(2 * df + 4 * n * excess)
        low = rate * CLASS_CHANGES
        name_runs_z = (changes - (n - 1) * low) / F.sqrt((n - 1) * low * (1 - low))
        name = _fisher(normal_below(name_z), normal_below(-name_runs_z))
        return F.least(F.lit(1.0), name / F.greatest(uniform, F.lit(1e-30)))

    both = F.element_at(F.transform(F.array(places), over), 1)
    # Each statistic is computed once and then named.
    facts = F.array(F.struct(chi.alias("chi"), both.alias("both")))
    named = F.transform(facts, lambda x: F.struct(x["chi"].alias("chi"), ((F.pow(F.greatest(x["chi"], F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))).alias("chi_z"), x["both"]["changes"].alias("changes"), x["both"]["products"].alias("products")))
    return F.element_at(F.transform(named, judged), 1)


def candidates(text: Column) -> Column:
    """array<struct<start, stop, encoding, length_bin, p>> of the strings tested."""

    def tested(s: Column) -> Column:
        code, p = F.lit(None).cast("int"), F.lit(1.0)
        for i, (_, pattern, alphabet) in reversed(list(enumerate(ENCODINGS))):
            fits = s["match"].rlike(pattern)
            code, p = F.when(fits, F.lit(i)).otherwise(code), F.when(fits, _battery(s["match"], alphabet)).otherwise(p)
        return F.struct(s["start"].alias("start"), s["stop"].alias("stop"), code.alias("encoding"), F.floor(F.log2(F.char_length(s["match"]).cast("double")) * 2).cast("int").alias("length_bin"), p.alias("p"))

    return F.transform(matches(text, CANDIDATE), tested)


def _bin(p: Column) -> Column:
    return F.least(F.lit(PBINS - 1), F.floor(-F.log10(F.greatest(p, F.lit(1e-30))) * 4)).cast("int")


def discovery_limits(bins: dict[tuple[int, int], dict[int, int]], share: float) -> dict[tuple[int, int], int]:
    """For each stratum the least bin that is discovered, by Benjamini and Hochberg's rule on binned p-values."""
    out = {}
    for stratum, counts in bins.items():
        total, seen = sum(counts.values()), 0
        for b in range(PBINS - 1, -1, -1):
            seen += counts.get(b, 0)
            if seen and 10 ** (-b / 4) * total / seen <= share:
                out[stratum] = b
    return out


def secret_spans(docs: DataFrame, *, false_share: float = FALSE_SHARE) -> DataFrame:
    """Find secrets in the texts of `docs` (doc_id, text, ...).

    Returns one row per row: doc_id, base and added, both arrays of
    struct<start, order, stop, kind> with code points, stop exclusive. base has the
    matches of the fixed patterns. added has strings that overlap none of these and
    pass the randomness battery: discovery is controlled in strata of encoding and
    length, so that a length at which ordinary text often looks random needs
    smaller p-values. Null and empty texts have no spans; repeated rows and rows
    with null doc_id stay; other columns are ignored; no rows: no rows.

    Texts are read once; the spans are written without the texts. The counts of
    p-values by stratum, bounded whatever the input, go to the driver.
    """
    found = written(docs.select("doc_id", base_spans(text_of()).alias("base"), candidates(text_of()).alias("tested")), "secrets", light=True)
    tested = found.select(F.explode("tested").alias("t")).groupBy("t.encoding", "t.length_bin", _bin(F.col("t.p")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins: dict[tuple[int, int], dict[int, int]] = defaultdict(dict)
    for r in tested.collect():
        bins[r["encoding"], r["length_bin"]][r["bin"]] = r["n"]
    limits = discovery_limits(bins, false_share)

    def taken(t: Column) -> Column:
        limit = F.lit(PBINS)
        for (encoding, length), b in limits.items():
            limit = F.when((t["encoding"] == encoding) & (t["length_bin"] == length), F.lit(b)).otherwise(limit)
        return _bin(t["p"]) >= limit

    apart = F.filter("tested", lambda t: taken(t) & ~F.exists("base", lambda s: (s["start"] < t["stop"]) & (t["start"] < s["stop"])))
    return found.select("doc_id", "base", labelled(apart, "random", 3).alias("added"))


def digest(spans: DataFrame) -> DataFrame:
    """Counts by kind and the spans in writing."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select("doc_id", *(count(k) for k in KINDS[:3]), F.sha2(written_out(F.col("base")), 256).alias("base_sha256"), written_out(F.concat("base", "added")).alias("spans"))
