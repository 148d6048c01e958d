"""Personal data in texts: fixed patterns, and candidates that labelers vote on. JVM-side expressions throughout."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitspark.llm.common import text_of, written
from fitspark.llm.spans import labelled, matches, written_out
from fitspark.llm.weak import estimate, logistic

# A match can begin within a run of its first class only where the last match ended; elsewhere it begins with the
# run. Saying so, and never giving back what was matched, keeps the search linear in long runs.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
#: Shorter runs would be dropped, and no longer one starts inside a run.
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

#: Gazetteers by what they list; any larger lists may be given instead.
GAZETTEER = {
    "given": tuple(
        "Adam Alex Alice Amy Ana Andrea Andrew Angela Anna Anne Antonio Ben Brian Camille Carl Carlos Carmen Carol Charles Chloe Christian Christine Claire Clara Daniel David Diego Eduardo Elena Elisabeth "
        "Elizabeth Emily Emma Eric Eva Felix Fernando Francisco Frank Gabriel George Greta Hans Helen Henry Hugo Ian Isabel Jack Jakob James Jan Jane Javier Jean Jennifer Jessica John Jonas Jorge Jose Joseph "
        "Juan Julia Julie Karl Kate Katrin Kevin Klaus Laura Lea Leon Linda Lisa Louis Lucas Lucia Luis Manuel Marc Maria Marie Mark Markus Martin Mary Max Michael Michel Miguel Monika Nicolas Nina Olivia Oscar "
        "Pablo Patrick Paul Pedro Peter Petra Philip Pierre Rachel Rafael Richard Robert Rosa Sabine Samuel Sandra Sara Sarah Sebastian Sofia Sophie Stefan Stephen Steven Susan Theo Thomas Tim Tom Ursula Victor Walter William".split()
    ),
    "places": tuple("Airport Avenue Bay Beach Bridge Castle Cathedral Church City College County Football Forest Garden Hill Hospital Hotel Island Lake Library Museum Park Prize River School Square Station Street Tower University Valley".split()),
    "countries": tuple("AD AE AT BE BG BR CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IL IS IT LI LT LU LV MC MT NL NO PL PT RO RS SE SI SK SM TR".split()),
    "domains": tuple("com org net edu gov info mail gmail yahoo outlook hotmail web gmx de fr es uk example".split()),
}
TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora"
STREETS = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Square"


def loose_patterns(gazetteer: dict[str, tuple[str, ...]]) -> dict[str, str]:
    """Further kinds: looser patterns, whose matches need the labelers' support."""
    word = r"[A-ZÀ-Ü][a-zß-ÿ]{2,20}"
    return {
        "national_phone": r"(?<![0-9+])(?:\([0-9]{2,5}\)\x20?|0[0-9]{2,4}[\x20/-])[0-9]{3,4}[\x20-]?[0-9]{3,5}(?![0-9])",
        "tax_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        "birth_date": r"(?<![0-9./-])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![0-9./-])",
        "titled_name": rf"(?<![A-Za-z])(?:{TITLES})\.?\x20{word}(?:\x20{word})?(?![a-z])",
        "spelled_email": r"(?i)(?<![A-Za-z0-9])[a-z0-9._-]{2,40}\x20?[\[(]\x20?at\x20?[\])]\x20?[a-z0-9-]{2,40}(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?[a-z0-9-]{2,20}){1,3}",
        "full_name": rf"(?<![A-Za-zÀ-ÿ.])(?=[A-Z])(?<!(?:{TITLES})\.?\x20)(?:{'|'.join(gazetteer['given']) or '(?!)'})\x20(?:[A-Z]\.\x20)?{word}(?![a-z])",
        "street": rf"(?<![0-9A-Za-z])[0-9]{{1,5}}\x20(?:{word}\x20){{1,3}}(?:{STREETS})(?![A-Za-z])",
    }


#: Conditions that hold for every text with a match, where they are cheaper than the pattern.
ONLY_IF = {"spelled_email": r"[\[(]\x20?(?i:at)\x20?[\])]", "street": rf"\x20(?:{STREETS})(?![A-Za-z])"}
#: Words that stand before data of a kind, in four languages.
CUES = {
    "national_phone": r"(?i)(?:phone|tel|call|mobile|fax|telefon|anruf|tél|appel|llam|móvil)",
    "tax_id": r"(?i)(?:ssn|social|tax|steuer|sécurité|seguro)",
    "account": r"(?i)(?:iban|account|konto|compte|cuenta|bank)",
    "birth_date": r"(?i)(?:born|birth|dob|geboren|geburt|née?\x20|naissance|nacid|nacimiento)",
    "titled_name": r"(?i)(?:dear|name|contact|sincerely|from|liebe|geehrte|cher|chère|estimad)",
    "spelled_email": r"(?i)(?:mail|contact|write|reach|schreib|écri|escrib)",
    "full_name": r"(?i)(?:name|dear|contact|sincerely|regards|from|by|mr|signed|patient|customer|employee|kunde|client|cliente)",
    "street": r"(?i)(?:address|lives?|at|ship|deliver|residence|adresse|wohnt|dirección)",
}
#: Words before a number that make it something else.
OTHER = r"(?i)(?:version|build|isbn|issn|page|figure|fig|table|section|line|item|order|invoice|price|total|doi|serial|part|ref|released?|updated?|on|§|#|\$|€)[\x20:.]*$"
LABELERS = ("pattern", "gazetteer", "cue", "other", "edges", "variety")
KINDS_LOOSE = tuple(loose_patterns(GAZETTEER))
#: What the span classifier sees besides the votes: the word before the span, its length and its shape, each as a class.
OWN = {"context": 5, "length": 4, "shape": 4}
#: A candidate becomes a span from this probability on.
THRESHOLD = 0.5


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits pass Luhn's check."""
    each = F.transform(F.reverse(F.split(digits, "")), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.get(F.array(*(F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int"))))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> Column:
    has = lambda what, spans: F.when(text.contains(what), spans).otherwise(F.expr("cast(array() as array<struct<start:int,order:int,stop:int,kind:string>>)"))
    part = lambda p: F.ltrim(p, F.lit("0"))
    ip = F.filter(matches(text, IP), lambda s: F.forall(F.split(s["match"], r"\."), lambda p: (F.char_length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255)))
    card = F.filter(matches(text, CARD), lambda s: F.when(F.char_length(digits_of(s["match"])).between(14, 19), luhn(digits_of(s["match"]))).otherwise(F.lit(False)))
    phone = F.filter(matches(text, PHONE), lambda s: F.char_length(digits_of(s["match"])).between(10, 15))
    return F.concat(has("@", labelled(matches(text, EMAIL), "email", 0)), has(".", labelled(ip, "ip", 1)), labelled(card, "card", 2), has("+", labelled(phone, "phone", 3)))


def candidates(text: Column, gazetteer: dict[str, tuple[str, ...]]) -> Column:
    """array<struct<start, stop, kind, votes: array<int>, own: array<int>>> of the loose patterns' matches; a vote is 1, 0 or -1."""
    listed = {k: F.array(*(F.lit(n) for n in v)) if v else F.expr("cast(array() as array<string>)") for k, v in gazetteer.items()}
    any_cue = "|".join(CUES.values())

    def judge(k: int, kind: str):
        numeric = kind in ("national_phone", "tax_id", "account", "birth_date")

        def judged(s: Column) -> Column:
            match, before = s["match"], s["before"]
            digits = digits_of(match)
            words = F.split(match, r"[^A-Za-zÀ-ÿ]+")
            numbers = F.transform(F.filter(F.split(match, "[^0-9]+"), lambda x: x != ""), lambda x: x.cast("int"))
            day = F.exists(numbers, lambda x: x.between(13, 31)) | F.forall(numbers, lambda x: (x <= 12) | (x > 31))
            place = F.arrays_overlap(words, listed["places"]) if kind == "full_name" else F.lit(False)
            valid = {
                "national_phone": F.when(F.char_length(digits).between(9, 12), 1).otherwise(0),
                "tax_id": F.when(F.substring(digits, 1, 3).isin("000", "666") | (F.substring(digits, 4, 2) == "00") | (F.substring(digits, 6, 4) == "0000"), 0).otherwise(1),
                "account": F.when(F.char_length(F.replace(match, F.lit(" "), F.lit(""))).between(15, 34), 1).otherwise(0),
                "birth_date": F.when(day & F.exists(numbers, lambda x: x.between(1900, 2020)) & F.exists(numbers, lambda x: x.between(1, 12)), -1).otherwise(0),
                "titled_name": F.lit(1),
                "spelled_email": F.lit(1),
                "full_name": F.lit(-1),
                "street": F.lit(-1),
            }[kind]
            named = {
                "titled_name": F.when(F.arrays_overlap(words, listed["given"]), 1).otherwise(-1),
                "full_name": F.when(place, 0).otherwise(1),
                "account": F.when(F.array_contains(listed["countries"], F.left(match, F.lit(2))), 1).otherwise(0),
                "spelled_email": F.when(F.arrays_overlap(F.transform(words, F.lower), listed["domains"]), 1).otherwise(-1),
                "street": F.when(F.arrays_overlap(words, listed["given"]), 1).otherwise(-1),
            }.get(kind, F.lit(-1))
            cue = F.when(before.rlike(CUES[kind]), 1).otherwise(-1)
            other = F.when(before.rlike(OTHER) | place, 0).otherwise(-1)
            # A number that goes on beyond a space is part of a longer one.
            longer = before.rlike(r"[0-9]\x20$") | s["after"].rlike(r"^\x20[0-9]") if numeric else F.lit(False)
            edges = F.when(before.rlike(r"[A-Za-z0-9_]$") | s["after"].rlike(r"^[A-Za-z0-9_@]") | longer, 0).otherwise(1)
            variety = F.when(F.size(F.array_distinct(F.split(digits, ""))) >= 4, 1).otherwise(0) if numeric else F.lit(-1)
            context = F.when(before.rlike(OTHER), 0).when(before.rlike(CUES[kind]), 1).when(before.rlike(any_cue), 2).when(before.rlike(r"(?:^|[\n.!?:;,(])[\x20]*$"), 3).otherwise(4)
            length = F.least(F.lit(3), F.shiftright(F.char_length(match), 3))
            shape = F.when(match.rlike(r"[0-9]") & match.rlike(r"[A-Za-z]"), 0).when(match.rlike(r"[./-]"), 1).when(match.rlike(r"\x20"), 2).otherwise(3)
            votes = F.array(*(v.cast("int") for v in (valid, named, cue, other, edges, variety)))
            return F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.lit(k).alias("kind"), votes.alias("votes"), F.array(*(c.cast("int") for c in (context, length, shape))).alias("own"))

        return judged

    patterns = loose_patterns(gazetteer)
    return F.concat(*(F.transform(matches(text, patterns[kind], text.rlike(ONLY_IF[kind]) if kind in ONLY_IF else None), judge(k, kind)) for k, kind in enumerate(KINDS_LOOSE)))


def features(votes: np.ndarray, kinds: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The classifier's inputs: a constant, votes for and against of each labeler, the kind, and the classes of context, length and shape."""
    classes = [own[:, j, None] == np.arange(n) for j, n in enumerate(OWN.values())]
    return np.column_stack([np.ones(len(votes)), votes == 1, votes == 0, kinds[:, None] == np.arange(len(KINDS_LOOSE)), *classes]).astype(float)


def train(votes: np.ndarray, kinds: np.ndarray, own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Estimate the labelers' reliabilities, then fit the span classifier on the posteriors of what was seen."""
    posterior = estimate(votes, counts, prior=0.5, abstain_tells=True).posterior(votes) if len(votes) else np.zeros(0)
    return logistic(features(votes, kinds, own), posterior, counts) if len(votes) else np.zeros(1 + 2 * len(LABELERS) + len(KINDS_LOOSE) + sum(OWN.values()))


def probability(weights: np.ndarray, c: Column) -> Column:
    """The classifier as an expression of a candidate."""
    k = len(LABELERS)
    z, at = F.lit(float(weights[0])), 1 + 2 * k

    def one_of(z: Column, value: Column, n: int, at: int) -> Column:
        for j in range(n):
            z = z + F.when(value == j, float(weights[at + j])).otherwise(0.0)
        return z

    for j in range(k):
        vote = F.get(c["votes"], F.lit(j))
        z = z + F.when(vote == 1, float(weights[1 + j])).when(vote == 0, float(weights[1 + k + j])).otherwise(0.0)
    z, at = one_of(z, c["kind"], len(KINDS_LOOSE), at), at + len(KINDS_LOOSE)
    for j, n in enumerate(OWN.values()):
        z, at = one_of(z, F.get(c["own"], F.lit(j)), n, at), at + n
    return 1 / (1 + F.exp(-z))


def pii_spans(docs: DataFrame, *, gazetteer: dict[str, tuple[str, ...]] = GAZETTEER, threshold: float = THRESHOLD) -> DataFrame:
    """Find personal data in the texts of `docs` (doc_id, text, ...).

    Returns one row per row: doc_id, base and added, both arrays of
    struct<start, order, stop, kind> with code points, stop exclusive. base has the
    matches of the fixed patterns, which are always kept. added has candidates of
    the looser patterns that overlap no base span and reach the threshold. Labelers
    (the pattern's own checks, gazetteers, words before the span that speak
    for or against it, its edges, and the variety of its digits) vote on
    candidates; their reliabilities come from expectation-maximisation. A
    logistic classifier is trained on the posteriors; besides the votes it sees
    the kind, what stands before the span, its length and its shape. Null and empty texts have no
    spans; repeated rows and rows with null doc_id stay; other columns are ignored;
    no rows: no rows.

    Texts are read once; the spans are written without them. Patterns of votes and
    classes, bounded by 3**6 * 80 for each kind whatever the input, go to the driver.
    Gazetteers go into the expressions, so they should hold thousands of terms at most.
    """
    found = written(docs.select("doc_id", base_spans(text_of()).alias("base"), candidates(text_of(), gazetteer).alias("asked")), "personal", light=True)
    patterns = found.select(F.explode("asked").alias("c")).groupBy("c.kind", "c.votes", "c.own").agg(F.count(F.lit(1)).alias("n")).orderBy("kind", "votes", "own").collect()
    votes = np.array([r["votes"] for r in patterns], np.int64).reshape(-1, len(LABELERS))
    own = np.array([r["own"] for r in patterns], np.int64).reshape(-1, len(OWN))
    weights = train(votes, np.array([r["kind"] for r in patterns], np.int64), own, np.array([r["n"] for r in patterns], float))
    overlaps = lambda c: F.exists("base", lambda s: (s["start"] < c["stop"]) & (c["start"] < s["stop"]))
    added = F.filter("asked", lambda c: (probability(weights, c) >= threshold) & ~overlaps(c))
    kinds = F.array(*(F.lit(k) for k in KINDS_LOOSE))
    named = F.transform(added, lambda c: F.struct(c["start"].alias("start"), (c["kind"] + len(KINDS)).alias("order"), c["stop"].alias("stop"), F.get(kinds, c["kind"]).alias("kind")))
    return found.select("doc_id", "base", named.alias("added"))


def digest(spans: DataFrame) -> DataFrame:
    """Counts by kind and the spans in writing."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select("doc_id", *(count(k) for k in KINDS), F.sha2(written_out(F.col("base")), 256).alias("base_sha256"), written_out(F.concat("base", "added")).alias("spans"))
