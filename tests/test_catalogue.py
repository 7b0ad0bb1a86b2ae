from __future__ import annotations

import re
from statistics import mean, median

import pytest
from sql import FOLDER, compare

from docketry.plans import cases, catalogue, scalars  # noqa: F401


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, name):
    compare(spark, catalogue.QUERIES[name], catalogue.ORACLES[name])


@pytest.mark.parametrize("name", ["html_blocks", "html_sections", "fuzzy_best_match", "vocabulary_edges"])
def test_query_without_sql_runs(spark, name):
    assert catalogue.QUERIES[name](spark, FOLDER).count() > 0


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalogue.QUERIES) <= set(e.queries())


def test_every_order_cites_every_other_with_a_common_part(spark, tmp_path):
    rows = [(o, p) for o in (1, 2, 3, 10, 20, 30) for p in (o % 2, 7, None)] + [(1, 7), (40, 99), (None, 7)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    want = sorted({(a, b) for a, p in rows for b, q in rows if None not in (a, b, p) and p == q and a != b})
    assert (1, 2) in want and (10, 20) in want
    assert sorted(map(tuple, catalogue.QUERIES["citation_self_join"](spark, str(tmp_path)).collect())) == want


TEXTS = [(1, "1. first\n2.second and a long line\n\n3.  third"), (2, None), (3, ""), (4, "\n" * 6 + "12.\tseventh line, long enough"), (5, "no number here at all\nx\n١. other digits"), (None, "4. a\n5. b")]


def texts(spark, folder):
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_every_line_of_a_text_can_be_a_numbered_paragraph(spark, tmp_path):
    want = [(i, k, re.sub(r"^(\d+\.)\s*(.*)", r"**\1** \2", x)) for i, t in TEXTS if t is not None for k, x in enumerate(t.split("\n"))] + [(2, None, None)]
    got = catalogue.QUERIES["numbered_paragraphs"](spark, texts(spark, tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and (4, 6, "**12.** seventh line, long enough") in want


def test_sections_of_the_whole_text_count(spark, tmp_path):
    lines = [(t or "").split("\n") for _, t in TEXTS]
    want = []
    for k in range(max(map(len, lines))):
        long = [len(x[k]) for x in lines if len(x) > k and len(x[k]) > 15]
        want.append((f"s{k}", len(long), round(100 * len(long) / len(TEXTS), 1), round(mean(long or [0]), 6), float(median(long or [0]))))
    got = catalogue.QUERIES["doc_section_presence"](spark, texts(spark, tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and want[6][1] == 1


def plain_appellant(i, t):
    if t is None:
        return None
    name = re.sub(r"^(CASE OF|AFFAIRE)\s+", "", "CASE OF " + t.split(".")[0] + ("" if i is None else (" v. STATE", " c. ETAT", "")[i % 3]), flags=re.I)
    for pattern in (r"(.+?)(?:\s*\(v\.\s*| v\.)", r"(.+?)\s+c\."):
        if m := re.search(pattern, name, re.I):
            return m[1].strip()
    return name.strip() or None


def test_every_document_has_an_appellant_row(spark, tmp_path):
    rows = [(0, "Heading\nSmith and others. More"), (1, "a\tb. c"), (2, "x\ny (v. z. w"), (3, None), (4, "\n\nDoe"), (5, "plain. text"), (None, "no id\nhere. x"), (6, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for folder in (str(tmp_path), FOLDER):
        docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
        got = catalogue.QUERIES["appellant_style_cascade"](spark, folder).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(((i, plain_appellant(i, t)) for i, t in docs), key=repr)
