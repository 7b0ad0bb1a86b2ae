from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docketry.functions import dates, legal, text


def value(spark, column, x, kind="string"):
    return spark.createDataFrame([(x,)], f"c {kind}").select(column.alias("v")).first()["v"]


A = "array<string>"
CASES = [
    (lambda: text.clean_appnos("c"), "12345/06;67890/07 and 11/08", "string", "12345/06;67890/07;11/08"),
    (lambda: text.clean_appnos("c"), "no. 5/02", "string", "5/02"),
    (lambda: text.parse_list("c"), "A; B;;C ", "string", ["A", "B", "C"]),
    (lambda: text.parse_list("c"), "nan", "string", []),
    (lambda: text.parse_list("c"), None, "string", []),
    (lambda: text.parse_list("c"), "[]", "string", []),
    (lambda: text.appellant("c"), "CASE OF X AND OTHERS v. FREEDONIA", "string", "X AND OTHERS"),
    (lambda: text.appellant("c"), "AFFAIRE DUPONT c. SYLVANIE", "string", "DUPONT"),
    (lambda: text.appellant("c"), "Z (v. FREEDONIA)", "string", "Z"),
    (lambda: text.appellant("c"), "Plain Name", "string", "Plain Name"),
    (lambda: text.appellant("c"), None, "string", None),
    (lambda: text.slug("c"), "Court (First Section)", "string", "court_first_section"),
    (lambda: text.slug("c"), "É", "string", "unknown"),
    (lambda: text.slug("c"), " 6-1 ", "string", "6_1"),
    (lambda: text.section_label("c"), "THE LAW", "string", "law"),
    (lambda: text.section_label("c"), "Legal Framework!", "string", "legal_framework"),
    (lambda: text.normalize_text("c"), " NaN\t", "string", None),
    (lambda: text.normalize_list("c"), "['a', \"b\"]", "string", ["a", "b"]),
    (lambda: text.normalize_list("c"), "a; b|c", "string", ["a", "b", "c"]),
    (lambda: text.normalize_list("c"), None, "string", []),
    (lambda: text.humanize("c"), "https://x/y#hasJudgmentDate", "string", "has Judgment Date"),
    (lambda: text.truncate("c", 3), "abcdef", "string", "abc... [3 more chars]"),
    (lambda: text.turtle_escape("c"), 'a"b\\c\nd\r', "string", 'a\\"b\\\\c d'),
    (lambda: text.safe_filename("c"), "a b/c.txt", "string", "a_b_c.txt"),
    (lambda: text.is_valid("c"), "N/A", "string", False),
    (lambda: text.is_valid("c"), "None", "string", True),
    (lambda: text.paragraphs("c"), "a\n\n \n\nb", "string", ["a", "b"]),
    (lambda: dates.optional_date("c").cast("string"), "2005-01-02T00:00:00.000", "string", "2005-01-02"),
    (lambda: dates.optional_date("c").cast("string"), "02/01/2005", "string", None),
    (lambda: dates.optional_date("c").cast("string"), "2005-13-02", "string", None),
    (lambda: dates.year_range("c"), "2019-", "string", (2019, None)),
    (lambda: dates.year_range("c"), "1998", "string", (1998, None)),
    (lambda: dates.year_range("c", True), "1998", "string", (1998, 1998)),
    (lambda: dates.year_range("c"), "-2008", "string", (None, 2008)),
    (lambda: dates.year_range("c"), "x", "string", (None, None)),
    (lambda: dates.case_year(F.lit(None).cast("string"), "c"), "ECLI:CE:ECHR:2001:0101JUD", "string", 2001),
    (lambda: legal.expand_articles("c"), ["6+6-3-c", "p1-1", "6"], A, ["6", "6-3-c", "P1-1"]),
    (lambda: legal.article_references("c"), ["Violation of Art. 6-1"], A, ["6-1"]),
    (lambda: legal.article_references("c"), ["6+6-1"], A, ["6", "6-1"]),
    (lambda: legal.article_references("c"), ["Inadmissible"], A, []),
    (lambda: legal.article_references("c"), ["Award under Article 41 of 5000 euro"], A, ["41", "5000"]),
    (lambda: legal.limb("c"), ["Criminal charge", "Civil proceedings"], A, "Mixed"),
    (lambda: legal.limb("c"), ["Constitutional proceedings", "Civil proceedings"], A, "Constitutional"),
    (lambda: legal.limb("c"), ["Death penalty"], A, "Criminal"),
    (lambda: legal.limb("c"), [], A, "Unspecified"),
    (lambda: legal.limb("c"), None, A, "Unspecified"),
    (lambda: legal.chamber_type("c", F.lit(None).cast("string")), "Court (Second Section Committee)", "string", "Committee"),
    (lambda: legal.chamber_type(F.lit(None).cast("string"), "c", by_level=False), "DECGRANDCHAMBER", "string", "Chamber"),
    (lambda: legal.chamber_type(F.lit(None).cast("string"), "c"), "DECGRANDCHAMBER", "string", "GrandChamber"),
    (lambda: legal.chamber_type("c", F.lit(None).cast("string")), "Court (Grand Chamber)", "string", "GrandChamber"),
    (lambda: legal.chamber_type("c", "c"), None, "string", None),
    (lambda: legal.separate_opinion("c"), None, "string", "SeparateOpinion_Absent"),
    (lambda: legal.separate_opinion("c"), "FALSE", "string", "SeparateOpinion_Absent"),
    (lambda: legal.separate_opinion("c"), "maybe", "string", "SeparateOpinion_Present"),
    (lambda: legal.document_kind("c"), "HEJUD", "string", "judgments"),
    (lambda: legal.document_kind("c"), "JUDDEC", "string", "judgments"),
    (lambda: legal.document_kind("c"), "HFDEC", "string", "decisions"),
    (lambda: legal.document_kind("c"), None, "string", "other"),
    (lambda: legal.country_names("c"), ["FRA", "XXX"], A, ["France", "XXX"]),
    (lambda: legal.iso3("c"), "Turkey", "string", "TUR"),
    (lambda: legal.canonical_country("c"), "Czech Republic", "string", "Czechia"),
    (lambda: legal.respondent_code("c"), ["x", "fra"], A, "FRA"),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_function(spark, i):
    column, x, kind, want = CASES[i]
    got = value(spark, column(), x, kind)
    assert (tuple(got) if isinstance(want, tuple) else got) == want


def test_periods(spark):
    years = [1950, 1964, 1965, 1999, 2019, 2020, 2030, None]
    got = [r[0] for r in spark.createDataFrame([(y,) for y in years], "y int").select(dates.period("y")).collect()]
    assert got == ["1959-1964", "1959-1964", "1965-1969", "1995-1999", "2015-2019", "2020-2025", "2020-2025", None]


def test_law_system(spark):
    systems = legal.mapping({"France": "Civil", "United Kingdom": "Common", "Cyprus": "Mixed"})
    rows = [(["France"],), (["France", "United Kingdom"],), (["Nowhere", "France"],), ([],), (["Cyprus"],)]
    got = [r[0] for r in spark.createDataFrame(rows, "c array<string>").select(legal.law_system("c", systems)).collect()]
    assert got == ["Civil", "Mixed", "Civil", None, "Mixed"]


def test_list_difference_keeps_repetitions(spark):
    df = spark.createDataFrame([(["1/02", "9/99", "9/99"], ["1/02"])], "a array<string>, b array<string>")
    assert df.select(text.list_difference("a", "b")).first()[0] == ["9/99", "9/99"]
