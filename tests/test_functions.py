import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fitspark.dialect import PatternError, alternation, java_pattern, safe_pattern
from fitspark.functions import arrays, dates, jsonx, text


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


def all_of(spark, column, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in rows.select("i", column(F.col("v"))).orderBy("i").collect()]


def test_tokens(spark):
    assert all_of(spark, text.tokens, ["The API of the api, a C++ x2!", "", None]) == [["api", "x2"], [], []]


def test_flags_ignore_case_beyond_ascii(spark):
    assert all_of(spark, lambda c: text.flag(c, "école"), ["ÉCOLE", "ecole", None]) == [1.0, 0.0, 0.0]
    assert one(spark, lambda c: text.flag(c, None), "x") == 0.0


def test_counts_do_not_overlap(spark):
    assert one(spark, lambda c: text.count_matches(c, "aa"), "aaaaa") == 2
    assert one(spark, lambda c: text.count_literal(c, "aa"), "aaaaa") == 2
    assert one(spark, lambda c: text.count_literal(c, ""), "aaa") == 0


def test_domain_ratio(spark):
    assert one(spark, lambda c: text.domain_ratio(c, ["api"], ["sales"]), "API api sales") == 3 / 5


def test_years_and_notice(spark):
    assert all_of(spark, text.years_claimed, ["6 years of hands-on experience", "2.5 years of experience", "years"]) == [6.0, 2.5, None]
    assert all_of(spark, text.notice_days, ["30 days notice", "2 months notice", "Immediate joiner", "400 days left", "none"]) == [30, 60, 0, 180, None]


def test_scores(spark):
    assert all_of(spark, text.score_of, ['{"fit_0_100": 71}', '{"score": 12.5}', "I say 88 of 100", "nothing", '{"fit": 300}']) == [71.0, 12.5, 88.0, 0.0, 100.0]


def test_slugs(spark):
    assert all_of(spark, text.slug, ["Große APIs!", "3 D", "", "a" * 40]) == ["gro_e_apis", "sig_3_d", "signal", "a" * 32]
    assert one(spark, text.unique_slugs, ["A b", "a-b", "A B", "c"], "array<string>") == ["a_b", "a_b_2", "a_b_3", "c"]


def test_html(spark):
    page = "<h1>Job</h1><p>Do &amp; dare<br/>more</p><ul><li>one</li><li>two</li></ul>"
    assert one(spark, text.html_text, page) == "Job\nDo & dare\nmore\n\n- one\n- two"
    assert one(spark, text.html_text, "&lt;p&gt;hidden&lt;/p&gt;") == "hidden"


def test_posting(spark):
    page = '<script type="application/ld+json">{"description": "<p>x</p>"}</script>'
    assert all_of(spark, text.posting_description, [page, "<p>none</p>", '<script type="application/ld+json">bad</script>']) == ["<p>x</p>", None, None]


def test_nearly_empty(spark):
    for n, pages, want in ((19, 1, True), (21, 1, False), (400, 5, False), (0, 0, True)):
        assert one(spark, lambda c, pages=pages: text.nearly_empty(c, F.lit(pages)), "x " * n) is want


def test_quoting(spark):
    terms = ["c++", "a.b", "(x)"]
    pattern = one(spark, text.any_of, terms, "array<string>")
    for t in terms:
        assert re.fullmatch(pattern, t)
    assert re.fullmatch(alternation(terms), "a.b") and not re.fullmatch(alternation(terms), "aXb")


def test_dialect():
    assert java_pattern("(?P<n>a)") == "(?iU)(?<n>a)"
    for bad in (r"(?P<a>x)(?P=a)", r"\p{L}", "(", r"a\Z"):
        with pytest.raises(PatternError):
            java_pattern(bad)
    assert safe_pattern("(") is None and safe_pattern(None) is None and safe_pattern(" ") is None and safe_pattern("a|b") == "a|b"


@pytest.mark.parametrize("pattern", [r"\bled\b|\bowned?\b", r"\d+k\+? (?:users|docs)", r"fine[- ]tun", r"internal[- ]facing", r"built (?:the|an?|our)\b"])
def test_patterns_mean_the_same(spark, pattern):
    corpus = ["LED by", "fled", "owned", "own", "10k+ users", "5K docs", "Fine-Tuning", "internal facing", "built our api", "built a", "", "naïve LED"]
    got = all_of(spark, lambda c: text.flag(c, pattern), corpus)
    assert got == [float(bool(re.search(pattern, t, re.I))) for t in corpus]


def test_dates(spark):
    assert [str(x) if x else None for x in all_of(spark, dates.parse_date, ["2024-1-5", "2024-06", "2024-02-31", "2024-03-01T10:00", None])] == ["2024-01-05", None, None, "2024-03-01", None]
    ref = F.to_date(F.lit("2026-06-06"))
    assert one(spark, lambda c: dates.months(dates.parse_date(c), ref), "2022-12-01") == pytest.approx(42 + 5 / 30)
    since = lambda c: dates.months_since(c, F.lit(False), ref)
    assert all_of(spark, since, ["2030-01-01", "", None, "2026-05-06"]) == [0.0, 0.0, 0.0, 1.0]


def test_ladders(spark):
    rungs = [(90, 1.0), (119, 0.93), (120, 0.90), (99999, 0.85)]
    assert all_of(spark, lambda c: dates.first_rung(c, rungs), [0, 90, 91, 120, 121, 100000], "int") == [1.0, 1.0, 0.93, 0.90, 0.85, 0.85]
    assert all_of(spark, lambda c: dates.last_rung(c, [(36, 0.35), (18, 0.7), (1, 0.9)]), [0.0, 1.0, 1.5, 18.0, 40.0, 999.0], "double") == [1.0, 1.0, 0.9, 0.9, 0.35, 0.35]


def test_guarded_numbers(spark):
    assert all_of(spark, lambda c: dates.clamp_int(c, 0, 10, 7), ["2.5", "3.5", "x", None, "99", "NaN"]) == [2, 4, 7, 7, 10, 7]
    assert all_of(spark, lambda c: dates.number_or(c, 1.5), ["2", "x", None, "NaN", "Infinity"]) == [2.0, 1.5, 1.5, 1.5, 1.5]


def test_vectors(spark):
    pair = lambda f: lambda c: f(c, F.array(F.lit(1.0), F.lit(0.0)))
    assert all_of(spark, pair(arrays.cosine), [[2.0, 0.0], [0.0, 3.0], [0.0, 0.0], [], [1.0]], "array<double>") == [1.0, 0.0, 0.0, 0.0, 0.0]
    assert all_of(spark, arrays.unit, [[3.0, 4.0], [0.0, 0.0]], "array<double>") == [[0.6, 0.8], [0.0, 0.0]]


def test_sets(spark):
    assert one(spark, lambda c: arrays.overlap(c, F.array()), [], "array<string>") == 0.0
    assert one(spark, lambda c: arrays.distinct_by(c, F.lower), ["A", "b", "a", "B", "c"], "array<string>") == ["A", "b", "c"]
    assert all_of(spark, lambda c: arrays.shrunk_top_mean(c, 3, 40.0, 50.0, 0.5), [[85.0, 80.0], [], [10.0]], "array<double>") == [pytest.approx(0.68), 0.0, 0.0]


@pytest.mark.parametrize(
    "answer, path, want",
    [('{"a": 1}', "a", "1"), ('Sure:\n```json\n{"a": "x"}\n```', "a", "x"), ('so {"a": {"b": "}"}} ok', "a.b", "}"), ('say "{" then {"a": "\\"{"}', "a", None), ("none", "a", None)],
)
def test_tolerant_json(spark, answer, path, want):
    assert one(spark, lambda c: jsonx.member(jsonx.tolerant_json(c), path), answer) == want


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("aA b\n", max_size=12), max_size=6))
def test_merged_lines_are_those_of_a_loop(spark, passes):
    from fitspark.sources.sections import merge_lines

    seen, want = set(), []
    for p in passes:
        for line in p.split("\n"):
            key = " ".join(line.split()).lower()
            if key and key not in seen:
                seen.add(key)
                want.append(line.strip(" "))
    assert one(spark, merge_lines, passes, "array<string>") == "\n".join(want)
