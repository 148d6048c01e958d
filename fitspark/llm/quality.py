"""Quality rules that vote, and the posterior probability of quality. JVM-side expressions throughout."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitspark.llm.common import WORD, WS_CLASS, strip_ws, text_of, written
from fitspark.llm.weak import Reliability, estimate

SYMBOLS = "#*$%&|<>"
#: Function words of the four languages; ordinary prose has some.
FUNCTION_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "with", "this"),
    "de": ("der", "die", "das", "und", "von", "mit", "nicht", "ein", "den", "ist"),
    "fr": ("le", "la", "les", "de", "et", "des", "un", "une", "que", "pour"),
    "es": ("el", "la", "los", "de", "que", "y", "en", "un", "por", "con"),
}
#: A document stays from this posterior on.
THRESHOLD = 0.5


def statistics(text: Column) -> dict[str, Column]:
    """Counts over the whole text, each an expression of the text."""
    words = F.filter(F.split(text, f"{WS_CLASS}+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return {
        "n_words": F.regexp_count(text, F.lit(WORD)).cast("long"),
        "word_chars": F.char_length(strip_ws(text)).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": F.element_at(F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x))), 1).cast("long"),
        "n_repeat_words": _repeat_words(words).cast("long"),
        "n_upper": (F.char_length(text) - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long"),
        "n_function_words": F.size(F.array_intersect(F.transform(words, F.lower), F.array(*(F.lit(w) for w in sorted({w for ws in FUNCTION_WORDS.values() for w in ws}))))).cast("long"),
    }


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that are found twice or more, the first included.

    The windows are first counted as distinct hashes; only if some hash recurs are
    they sorted with their places, so that equal windows stand side by side. Both
    take O(n log n) at most.
    """

    def of(w: Column) -> Column:
        window = lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        places = F.sequence(F.lit(0), F.size(w) - 3)
        hashes = F.transform(places, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

        def covered(h: Column) -> Column:
            ordered = F.sort_array(F.transform(places, lambda i: F.struct(F.get(h, i).alias("h"), window(i).alias("w"), i.alias("i"))))
            def hit(s: Column) -> Column:
                same = lambda a, b: (F.get(s, a)["h"] == F.get(s, b)["h"]) & (F.get(s, a)["w"] == F.get(s, b)["w"])
                twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: F.coalesce(same(j, j + 1), F.lit(False)) | F.coalesce(F.when(j > 0, same(j, F.greatest(j - 1, F.lit(0)))), F.lit(False)))
                return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda j: F.sequence(F.get(s, j)["i"], F.get(s, j)["i"] + 2)))))
            return F.element_at(F.transform(F.array(ordered), hit), 1)

        def counted(h: Column) -> Column:
            return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))

        return F.when(F.size(w) < 4, F.lit(0)).otherwise(F.element_at(F.transform(F.array(hashes), counted), 1))

    return F.element_at(F.transform(F.array(words), of), 1)


def votes() -> dict[str, Column]:
    """Each rule votes 1 (good), 0 (bad) or abstains (-1), from the statistics."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    good_bad = lambda good, bad: F.when(bad, 0).when(good, 1).otherwise(-1).cast("int")
    mean = F.col("word_chars") / n
    symbols = F.col("n_symbols") / n
    share = F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))
    lines = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    repeat = F.col("n_repeat_words") / n
    upper = F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1))
    known = F.col("n_function_words")
    return {
        "length": good_bad(F.col("n_words") >= 100, F.col("n_words") < 50),
        "word_length": good_bad(mean.between(4, 9), ~mean.between(3, 12)),
        "symbols": good_bad(symbols < 0.02, symbols > 0.1),
        "symbol_share": good_bad(share < 0.01, share > 0.05),
        "lines": good_bad((lines == 0) & (F.col("n_lines") > 1), lines > 0.3),
        "repetition": good_bad(repeat < 0.1, repeat > 0.3),
        "upper_case": good_bad(upper < 0.1, upper > 0.3),
        "function_words": good_bad(known >= 3, (known == 0) & (F.col("n_words") >= 20)),
    }


def quality_scores(docs: DataFrame, *, threshold: float = THRESHOLD) -> tuple[DataFrame, Reliability]:
    """Score the texts of `docs` (doc_id, text, ...).

    Returns one row per row: doc_id, the statistics, the votes (vote_...), quality
    (the posterior probability) and good (it reaches the threshold); and the
    labelers' reliabilities. Null and empty texts have no words: the length rule
    votes bad on them, as on any short text. Repeated rows count as often as they
    come; rows with null doc_id are treated alike; other columns are ignored; no
    rows: no rows.

    Texts are read once; statistics and votes are written. Patterns of votes, at
    most 3**8 rows, go to the driver, where their probabilities are estimated.
    """
    rules = votes()
    counted = docs.select("doc_id", text_of().alias("text")).select("doc_id", *(c.alias(k) for k, c in statistics(F.col("text")).items()))
    voted = written(counted.select("*", *(c.alias(f"vote_{k}") for k, c in rules.items())), "votes", light=True)
    names = [f"vote_{k}" for k in rules]
    patterns = voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).orderBy(*names).collect()
    found = np.array([[r[k] for k in names] for r in patterns], np.int64).reshape(-1, len(names))
    model = estimate(found, np.array([r["n"] for r in patterns]), prior=0.7)
    p = model.posterior_column([F.col(k) for k in names])
    return voted.withColumn("quality", p).withColumn("good", F.col("quality") >= threshold), model
