from __future__ import annotations

from pyspark.sql import functions as F

from docketry.operators import graph
from docketry.plans import pipelines
from docketry.sources import readers

PAGE = "<p><b>PROCEDURE</b></p><p>1. The case originated.</p><p><b>THE FACTS</b></p><p>2. X was born.</p>"


def raw(spark):
    base = dict.fromkeys(readers.RAW_FIELDS)
    rows = [
        base | {"itemid": "1", "ecli": "ECLI:X:2001:1", "languageisocode": "FRE", "doctype": "HFJUD", "appno": "1/01;2/01", "docname": "AFFAIRE A c. B", "judgementdate": "02/03/2001 00:00:00", "respondent": "FRA"},
        base | {"itemid": "2", "ecli": "ECLI:X:2001:1", "languageisocode": "ENG", "doctype": "HEJUD", "appno": "1/01 and 2/01", "extractedappno": "1/01;3/01", "sclappnos": "9/99;9/99", "docname": "CASE OF A v. B", "typedescription": "14", "originatingbody": " 8", "importance": "2", "judgementdate": "02/03/2001 00:00:00", "respondent": "FRA;GBR", "judges": "anna bell; Nobody Else", "kpthesaurus": "293;x", "doctypebranch": "GRANDCHAMBER"},
        base | {"itemid": "3", "ecli": "ECLI:X:2002:2", "languageisocode": "RUS", "doctype": "HEDEC", "appno": "", "judgementdate": "02/03/2002 00:00:00"},
    ]
    return spark.createDataFrame([tuple(r[f] for f in readers.RAW_FIELDS) for r in rows], readers.RAW_SCHEMA)


def dims(spark):
    judges = spark.createDataFrame([(1, "Anna Bell"), (2, "Zed")], "judge_id long, name string")
    keywords = spark.createDataFrame([("293", "(Art. 6) Criminal charge")], "code string, label string")
    systems = spark.createDataFrame([("France", "Civil"), ("United Kingdom", "Common")], "code string, label string")
    return judges, keywords, systems


def stored(df, path):
    """Stages hand over files, as in production: a plan over all stages at once would repeat the early ones many times."""
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def test_register_rows(spark):
    r = raw(spark)
    assert {k: sorted(x["itemid"] for x in v.collect()) for k, v in pipelines.split_by_kind(r).items()} == {"judgments": ["1", "2"], "decisions": ["3"], "other": []}
    assert sorted(tuple(x) for x in pipelines.appno_map(r).select("itemid", "individual_appno").collect()) == [("1", "1/01"), ("1", "2/01"), ("2", "1/01"), ("2", "2/01")]
    assert sorted(x["itemid"] for x in pipelines.one_per_ecli(pipelines.in_languages(r)).collect()) == ["2"]
    assert tuple(pipelines.language_counts(r).first()) == (1, 1)
    stems = spark.createDataFrame([("2",)], "stem string")
    assert [x["itemid"] for x in pipelines.with_texts(r, stems).collect()] == ["2"]


def test_cases(spark):
    judges, keywords, systems = dims(spark)
    c = pipelines.process_cases(raw(spark), judges, keywords, systems).filter("itemid = '2'").first()
    assert c["case_appno"] == ["1/01", "2/01"] and c["secondary_appno"] == ["3/01"] and c["cited_appno"] == ["9/99", "9/99"]
    assert (c["appellant"], c["judgment_type"], c["originatingbody"], c["importance"], c["court_level"]) == ("A", "Judgment (Merits)", "Court (Grand Chamber)", 2, "GRANDCHAMBER")
    assert c["country_name"] == ["France", "United Kingdom"] and c["law_system"] == "Mixed" and c["judges_id"][0] == 1 and c["judges_id"][1] is None
    assert c["kpthesaurus_labels"] == ["(Art. 6) Criminal charge", "[Unmapped: x]"] and c["limb"] == "Criminal"
    assert [x[0] for x in pipelines.unmapped_keywords(raw(spark), keywords).collect()] == ["x"]


def test_corpus_sample_and_report(spark, tmp_path):
    judges, keywords, systems = dims(spark)
    pages = spark.createDataFrame([("1", PAGE), ("2", PAGE), ("3", "")], "itemid string, html string")
    corpus = pipelines.build_corpus(pages)
    assert corpus.count() == 3 and pipelines.build_corpus(pages, decision=True).count() == 2
    assert tuple(pipelines.corpus_counts(pages, pipelines.build_corpus(pages, skip_empty=True)).select("total", "success", "errors", "skipped").first()) == (3, 2, 0, 1)
    stats = {r["segment"]: r["n"] for r in pipelines.section_statistics(corpus).collect()}
    assert stats["facts"] == 2 and stats["law"] == 0
    cases = stored(pipelines.process_cases(raw(spark), judges, keywords, systems), tmp_path / "cases")
    corpus = stored(corpus.drop("tables"), tmp_path / "corpus")
    levels = {r["level"]: r["n"] for r in pipelines.level_statistics(corpus, cases, {"GRANDCHAMBER": "Grand Chamber"}).collect()}
    assert levels == {"Grand Chamber": 1, None: 2}
    sample = stored(pipelines.build_sample(cases, cases.limit(0), corpus, corpus.limit(0)), tmp_path / "sample")
    row = sample.first()
    assert sample.count() == 1 and row["year"] == 2001 and row["facts"].startswith("# THE FACTS") and row["law"] is None
    assert pipelines.english_with_text(sample).count() == 1
    shares = pipelines.period_country_shares(sample.withColumn("respondent", F.lit("FRA")))
    assert {(r["period"], r["n"], r["share"]) for r in shares.filter("country = 'FRA'").collect()} == {("2000-2004", 1, 100.0)} and shares.count() == 47
    lines = pipelines.graph_report(stored(graph.build(sample), tmp_path / "graph"), "sample")
    assert "# sample" in lines and "subjects: " in " ".join(lines) and lines[-1].startswith("greatest: ")


def test_qname(spark):
    df = spark.createDataFrame([("http://a/b#c",), ("http://a/x",), ("z",)], "t string")
    got = [r[0] for r in df.select(pipelines.qname(F.col("t"), {"http://a/": "a", "http://a/b#": "b"})).collect()]
    assert got == ["b:c", "a:x", "z"]


def test_json_with_comments(spark, tmp_path):
    (tmp_path / "c.json").write_text('{ // note\n "a": "x//y" /* end */ }')
    assert pipelines.json_with_comments(spark, str(tmp_path / "c.json"), "a string").first()["a"] == "x//y"
