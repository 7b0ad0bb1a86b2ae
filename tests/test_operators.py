from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.operators import graph, html, matching, sampling, sections, stats, tables, vocabulary
from docketry.sources import readers, sinks
from docketry.sources.replay import ReplaySource, windows

PAGE = "<p><b>PROCEDURE</b></p><p>1. The case originated.</p><p><b>THE FACTS</b></p><p>2. X was born.</p>"


def test_sections_in_both_modes(spark):
    docs = html.extract(spark.createDataFrame([(1, PAGE), (2, None)], "id int, html string")).withColumn("full_text", html.markdown("blocks"))
    judgment = {r["id"]: r for r in sections.with_sections(docs).collect()}
    assert judgment[1]["procedure"] == "# PROCEDURE\n\n\n**1.** The case originated."
    assert judgment[1]["facts"] == "# THE FACTS\n\n\n**2.** X was born."
    assert all(judgment[2][s] == "" for s in sections.SECTIONS)
    decision = sections.with_sections(docs, decision=True).filter("id = 1").first()
    assert decision["procedure"] == "" and decision["facts"] == "# PROCEDURE\n\n\n**1.** The case originated.\n\n\n\n# THE FACTS\n\n\n**2.** X was born."


def test_section_headers(spark):
    lines = ["The facts of the case are plain", "The law of the land", "## QUESTIONS TO THE PARTIES", "swallowed", "EN DROIT", "x", "DECIDES TO STRIKE it out", "y", "DROIT ET LA PRATIQUE INTERNES", "APPENDIX", "z"]
    r = sections.with_sections(spark.createDataFrame([("\n".join(lines),)], "full_text string")).first()
    assert r["facts"].startswith("The facts of") and "The law of the land" in r["facts"]
    assert "swallowed" not in "".join(r[s] for s in sections.SECTIONS)
    assert r["law"] == "EN DROIT\n\nx" and r["appendix"] == "APPENDIX\n\nz"
    assert r["reasons"].startswith("DECIDES TO STRIKE it out\n\ny")


def test_blocks_follow_the_tree():
    root = html.parse("<div>a<div>in</div></div><div><h4>lost</h4></div><p>x <b>bold<p>nested</p><style>no</style><table><tr><td>t</td></tr></table>")
    assert html.blocks(root) == [("div", "in", False), ("p", "x bold nested", True), ("p", "nested", False)]


def test_tables_drop_empty_rows_and_count_dropped_tables():
    page = "<table><tr><td></td></tr></table><table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td></td></tr><tr><td></td><td></td></tr></table><table><tr><td colspan=2>w</td></tr></table>"
    assert html.tables(html.parse(page)) == [("table_2", [{"A": "1"}]), ("table_3", [{"0": "w", "1": "w"}])]


def test_relaxed_union(spark):
    a = spark.createDataFrame([(1, 2.5)], "k long, x double")
    b = spark.createDataFrame([("abc", 7)], "k string, y int")
    assert [tuple(r) for r in tables.relaxed_union(a, b).orderBy("k").collect()] == [("1", 2.5, None), ("abc", None, 7)]


def test_first_per_key_prefers_language_and_keeps_null_keys(spark):
    df = spark.createDataFrame([("e", "FRE", 1), ("e", "ENG", 2), (None, "ENG", 3), (None, "ENG", 4)], "ecli string, lang string, at int")
    got = tables.preferred_language(df, "ecli", "lang", "at", {"ENG": 0, "FRE": 1})
    assert sorted(r["at"] for r in got.collect()) == [2, 3, 4]


def test_drop_strict_raises(spark):
    with pytest.raises(ValueError):
        tables.drop_strict(spark.range(1), "nothing")


def test_citations(spark):
    owns = spark.createDataFrame([("A", "1/01"), ("B", "2/02")], "item string, value string")
    cites = spark.createDataFrame([("A", "1/01"), ("B", "1/01")], "item string, value string")
    assert [tuple(r) for r in tables.citations(owns, cites).collect()] == [("B", "A")]


@pytest.mark.parametrize("n", [40, 50, 51, 120, 239, 288, 428, 1000])
def test_spread_equals_linspace(spark, n):
    df = spark.range(n).withColumn("level", F.lit("x"))
    got = sorted(r["id"] for r in sampling.time_spread_sample(df, "level", "id", k=50).collect())
    assert got == (sorted(set(np.linspace(0, n - 1, 50).astype(int).tolist())) if n > 50 else list(range(n)))


def test_lower_rank_quantiles(spark):
    r = stats.lower_rank_quantiles(spark.createDataFrame([(1,), (2,), (3,)], "v int"), "v").first()
    assert tuple(r) == (1, 1, 2, 2, 3)


def test_histogram_puts_the_maximum_in_the_last_bin(spark):
    got = {r["bin"]: r["n"] for r in stats.histogram(spark.range(0, 101), "id", 25).collect()}
    assert sum(got.values()) == 101 and max(got) == 25 and got[25] == 5


def test_best_matches(spark):
    ref = spark.createDataFrame([(1, "Anna Bell"), (2, "bcde"), (3, "Zed")], "judge_id long, name string")
    names = spark.createDataFrame([("ANNA bell",), ("abcd",), (None,)], "name string")
    got = {r["name"]: (r["ref_id"], r["score"]) for r in matching.best_matches(names, ref).collect()}
    assert got == {"ANNA bell": (1, 1.0), "abcd": (2, 0.75)}
    by_blocks = {r["name"]: r["ref_id"] for r in matching._by_join(names.filter("name = 'abcd'"), ref.select(F.col("judge_id").alias("ref_id"), F.col("name").alias("ref_name")), block=1).collect()}
    assert by_blocks == {"abcd": 2}


def test_matched_lists_keep_places(spark):
    df = spark.createDataFrame([(1, ["a", "b"])], "id int, names array<string>")
    matches = spark.createDataFrame([("a", 7, 0.9), ("b", 8, 0.2)], "name string, ref_id long, score double")
    assert matching.matched_lists(df, "id", "names", matches, 0.7).first()["ids"] == [7, None]
    with pytest.raises(ValueError):
        matching.matched_lists(df, "id", "names", matches, 1.5)


def test_case_graph(spark):
    cases = spark.createDataFrame(
        [(1, "001-1", ["6-1"], ["8"], ["1/01"], ["1/01"], ["FRA"], ["A. Judge", "B. Judge"], ["5", None]), (2, "001-2", ["6"], None, ["2/02"], ["1/01"], ["Turkey"], ["a. judge"], None)],
        "ordinal long, itemid string, violation array<string>, nonviolation array<string>, case_appno array<string>, cited_appno array<string>, respondent array<string>, judges array<string>, judges_id array<string>",
    )
    register = spark.createDataFrame([(5, "Anna Judge", "France", "2008-2019", "President", "2010-")], "judge_id long, name string, country string, tenure string, role string, role_length string")
    triples = graph.build(cases, register).cache()
    rows = {(r["s"].removeprefix(graph.DATA), r["p"].rpartition("#")[2], r["o"].removeprefix(graph.DATA)) for r in triples.collect()}
    assert len(rows) == triples.count()
    assert ("case_001_2", "citesCase", "case_001_1") in rows and ("case_001_1", "citesCase", "case_001_1") not in rows
    assert ("case_001_1", "hasJudge", "judge_5") in rows and ("judge_5", "label", "Anna Judge") in rows and ("judge_5", "hasPresidencyBeginYear", "2010") in rows
    assert ("case_001_2", "hasRespondentState", "country_t_rkiye") in rows
    assert ("convention_article_8", "label", "Article 8") in rows and ("finding_001_1_nonviolation_0", "findingRefersToArticle", "convention_article_8") in rows
    names = [r["name"] for r in graph.number_findings(graph.findings(graph.case_records(cases))).orderBy("name").collect()]
    assert names == ["finding_000000", "finding_000001", "finding_000002"]
    assert graph.undeclared(triples, vocabulary.terms(spark)).count() == 0
    assert graph.disjoint_violations(triples, graph.SCHEMA + "Violation", graph.SCHEMA + "NonViolation").count() == 0
    assert vocabulary.out_of_domain(triples, vocabulary.triples(spark)).count() == 0


def test_vocabulary_counts():
    individuals = sum(map(len, vocabulary.INDIVIDUALS.values()))
    assert (len(vocabulary.CLASSES), len(vocabulary.OBJECT_PROPERTIES), individuals) == (28, 26, 23)


def test_tolerant_json(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"itemid":"1","full_text":"x\\Ny"}\n\n{"itemid":"2","full_text":"ok\\n"}\n{broken\n')
    got = readers.tolerant_json_lines(spark, str(tmp_path / "x.jsonl"), readers.T.StructType([readers.T.StructField("itemid", readers.T.StringType()), readers.T.StructField("full_text", readers.T.StringType())]))
    assert sorted(tuple(r) for r in got.collect()) == [("1", "x\\Ny"), ("2", "ok\n")]
    assert sorted(r[0] for r in readers.item_ids(spark, str(tmp_path / "x.jsonl")).collect()) == ["1", "2"]


def test_ntriples_round_trip(spark, tmp_path):
    rows = [("http://a", "http://p", 'x "q" \\n \n tab\t', "literal", None, "en"), ("http://a", "http://p", "http://b", "iri", None, None), ("_:n1", "http://p", "5", "literal", "http://int", None)]
    df = spark.createDataFrame(rows, "s string, p string, o string, o_kind string, o_datatype string, o_lang string")
    sinks.ntriples(df, str(tmp_path / "t"))
    assert sorted(map(tuple, readers.ntriples(spark, str(tmp_path / "t")).drop("g").collect()), key=str) == sorted(rows, key=str)


def test_ntriples_of_another_form_raise(spark, tmp_path):
    long = 'y\\"' * 100_000
    (tmp_path / "t.nt").write_text(f'# head\n\n<http://a> <http://p> "{long}" .\n')
    assert readers.ntriples(spark, str(tmp_path / "t.nt")).first()["o"] == 'y"' * 100_000
    (tmp_path / "t.ttl").write_text("@prefix x: <http://x> .\n<http://a> <http://p> <http://b> .\n")
    with pytest.raises(Exception, match="no triple: @prefix"):
        readers.ntriples(spark, str(tmp_path / "t.ttl")).collect()
    assert readers.ntriples(spark, str(tmp_path / "t.ttl"), strict=False).count() == 1


def test_html_folder_judges_and_dictionary(spark, tmp_path):
    (tmp_path / "a.html").write_bytes(b"<p>caf\xc3\xa9 \xff!</p>")
    (tmp_path / "b.html").write_text(PAGE)
    got = html.extract(readers.html_folder(spark, str(tmp_path), limit=1)).select("itemid", html.markdown("blocks").alias("m")).collect()
    assert [tuple(r) for r in got] == [("a", "café !")]
    assert readers.file_sizes(spark, str(tmp_path), "*.html").first()["files"] == 2
    (tmp_path / "j.csv").write_text('"Judge Name","Country","Tenure","Role","Role Length"\n"A","FRANCE ","2019-","",""\n"B","SPAIN","","President","2001-2002"\n')
    assert [tuple(r) for r in readers.judges(spark, str(tmp_path / "j.csv")).orderBy("judge_id").collect()] == [("A", "FRANCE", "2019-", None, None, 1), ("B", "SPAIN", None, "President", "2001-2002", 2)]
    (tmp_path / "d.json").write_text('{"293": "Label"}')
    dim = readers.json_dictionary(spark, str(tmp_path / "d.json"))
    df = spark.createDataFrame([("293",), ("x",), (None,)], "c string")
    assert sorted((r["c"] or "", r["label"]) for r in tables.with_lookup(df, F.col("c"), dim, "label").collect()) == [("", None), ("293", "Label"), ("x", None)]
    assert [r[0] for r in tables.unmatched(df, F.col("c"), dim).collect()] == ["x"]
    assert readers.json_records(spark, str(tmp_path / "none.json"), readers.RAW_SCHEMA).count() == 0


def test_replay_reads_pages_until_an_empty_one(spark, tmp_path):
    import json

    assert windows(1955, 1958) == [("1955-01-01", "1956-12-31"), ("1957-01-01", "1958-12-31")]
    for name, n in (("1955-01-01_1956-12-31_0", 2), ("1955-01-01_1956-12-31_2", 1), ("1957-01-01_1958-12-31_0", 1)):
        (tmp_path / f"{name}.json").write_text(json.dumps([{"itemid": f"{name}-{i}", "ecli": "e"} for i in range(n)]))
    spark.dataSource.register(ReplaySource)
    read = spark.read.format("register_replay").option("path", str(tmp_path)).option("start_year", 1955).option("end_year", 1958).option("length", 2).load()
    assert read.count() == 4


def test_sections_from_json(spark):
    rows = [('{"The Law": "a"}',), ('[{"label": "Facts", "text": "x"}, {"title": "FACTS", "content": "y"}]',), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "j string").select(sections.sections_from_json(F.col("j"))).collect()]
    assert [[tuple(x) for x in g] if g is not None else None for g in got] == [[("law", "a")], [("facts", "x\n\ny")], None]


def test_resumable_ingest(spark, tmp_path):
    from docketry.streaming.ingest import ingest_new, record_stream

    source = tmp_path / "in"
    source.mkdir()
    schema = readers.T.StructType([readers.T.StructField("itemid", readers.T.StringType())])

    def run():
        q = ingest_new(record_stream(spark, str(source), schema), str(tmp_path / "out"), str(tmp_path / "cp"), key="itemid")
        q.awaitTermination(120)
        return sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    (source / "1.json").write_text('{"itemid": "a"}\n{"itemid": "a"}\n')
    assert run() == ["a"]
    (source / "2.json").write_text('{"itemid": "a"}\n{"itemid": "b"}\n')
    assert run() == ["a", "b"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, None, ["x"]), (1, "é", None)], "k int, v string, l array<string>")
    sinks.json_lines(df, str(tmp_path / "j"), "k")
    assert "".join(p.read_text() for p in sorted((tmp_path / "j").glob("part-*"))).splitlines()[0] == '{"k":1,"v":"é","l":null}'
    assert '"v": "é"' in sinks.json_array(df)
    with pytest.raises(ValueError):
        sinks.json_array(df, limit=1)
    sinks.csv(df.drop("l"), str(tmp_path / "c"))
    assert readers.quoted_csv(spark, str(tmp_path / "c")).count() == 2
    sinks.lines(df, str(tmp_path / "t"), F.concat_ws(" ", "k", "v"), "k")
    assert "".join(p.read_text() for p in (tmp_path / "t").glob("part-*")) == "1 é\n2\n"
    quads = spark.createDataFrame([("g1", "a"), ("g2", "b")], "g string, s string")
    sinks.replace_graphs(quads, str(tmp_path / "q"))
    sinks.replace_graphs(spark.createDataFrame([("g2", "c")], "g string, s string"), str(tmp_path / "q"))
    assert sorted((r["g"], r["s"]) for r in spark.read.parquet(str(tmp_path / "q")).collect()) == [("g1", "a"), ("g2", "c")]
