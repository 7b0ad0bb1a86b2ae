"""Queries of the case graph over a stand-in for the register: documents dressed up as court cases, and the SQL that writes out their triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators import graph
from docketry.plans.catalogue import query, table
from docketry.plans.scalars import pick, picked

_TYPES = [("Judgment (Merits)", "Judgment"), ("Decision", "Decision"), ("Judgment (Revision)", "Judgment"), (None, "Judgment"), ("Decision (Final)", "Decision")]
_BODIES = [("Court (First Section)", "Chamber"), ("Court (Grand Chamber)", "GrandChamber"), ("Committee of Ministers", "Committee"), ("Commission", "Commission"), (None, None), ("Court (Second Section Committee)", "Committee"), ("Registry", None)]
_LEVELS = [("CHAMBER", "Chamber"), ("GRANDCHAMBER", "GrandChamber"), (None, None), ("unknown", None)]
_LIMBS = [("Civil", "Civil"), ("Criminal", "Criminal"), ("Mixed", "Mixed"), ("none", None)]
_OPINIONS = [("TRUE", "Present"), ("FALSE", "Absent"), (None, "Absent")]
_ARTICLES = [("6;6-1", ["6", "6-1"]), ("p1-1+6", ["P1-1", "6"]), ("8|13+6", ["8", "13", "6"]), (None, []), ("6-3-c;6-3-c", ["6-3-c"])]
_CONCLUSIONS = [("Violation of Art. 6-1", ["6-1"]), ("Inadmissible", []), ("Article 41 of 500", ["41", "500"])]
_VIOLATIONS = [("6-1", ["6-1"]), ("6+13", ["6", "13"]), (None, []), ("p1-1", ["P1-1"])]
_OTHERS = [("8", ["8"]), ("10+8+10", ["10", "8"]), (None, [])]
_STATES = [("FRA", "France"), ("GBR", "United Kingdom"), ("TUR", "Türkiye"), ("XYZ", "XYZ"), ("Russia", "Russian Federation"), ("mda", "Moldova, Republic of"), (None, None)]


def _cases(spark: SparkSession, d: str) -> DataFrame:
    """One case for each document, with every field that the graph reads."""
    k = F.col("doc_id")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    one = lambda rows: pick(k, [r[0] for r in rows])
    date = F.when(k % 3 == 0, text(1990 + k % 30, "-03-04")).when(k % 3 == 1, text(1990 + k % 30, "-11-30T00:00:00")).otherwise("bad")
    judge = F.when(k % 5 == 0, F.lit("x")).otherwise((k % 41).cast("string"))
    return table(spark, d, "documents").select(
        k.alias("ordinal"), text("001-", k).alias("itemid"), text("CASE OF PARTY ", k, " v. STATE").alias("case_name"), text("ECLI:X:", k).alias("ecli"), F.upper("lang").alias("languageisocode"), date.alias("judgementdate"), one(_TYPES).alias("judgment_type"), one(_BODIES).alias("originatingbody"), one(_LEVELS).alias("court_level"),
        one(_LIMBS).alias("limb"), (k % 5).cast("string").alias("importance"), one(_OPINIONS).alias("separateopinion"), text(" Party ", k % 1000, " ").alias("appellant"), F.array(text(k, "/09"), text(k + 1, "/09"), text(k, "/09")).alias("case_appno"), F.array(text(k + 7, "/09")).alias("cited_appno"), F.array(text(3 * k, "/10")).alias("secondary_appno"),
        one(_ARTICLES).alias("article"), F.array(one(_CONCLUSIONS)).alias("conclusion"), F.array(one(_VIOLATIONS)).alias("violation"), F.array(one(_OTHERS)).alias("nonviolation"), F.array(one(_STATES)).alias("respondent"), F.array(text("Judge ", k % 37), F.lit(" ")).alias("judges"), F.array(judge).alias("judges_id"),
        text(100 + k % 11, ";", 200 + k % 3).alias("kpthesaurus"), F.array(text("Topic ", k % 11), text("Theme ", k % 3)).alias("kpthesaurus_labels"),
    )


def _slug(x: str) -> str:
    return f"coalesce(nullif(lower(regexp_replace(regexp_replace(trim({x}), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')), ''), 'unknown')"


def _iri(kind: str, x: str) -> str:
    return f"'{graph.DATA}{kind}_' || {_slug(x)}"


def _term(x: str) -> str:
    return f"'{graph.SCHEMA}' || {x}"


def _node(s: str, p: str, o: str, rel: str) -> str:
    return f"SELECT {s} AS s, '{graph.SCHEMA + p if ':' not in p else p}' AS p, {o} AS o, 'iri' AS o_kind, NULL AS o_datatype, NULL AS o_lang FROM {rel} WHERE {o} IS NOT NULL"


def _literal(s: str, p: str, o: str, rel: str, datatype: str | None = "string", lang: str | None = None) -> str:
    kind, tongue = f"'{graph.XSD}{datatype}'" if datatype else "NULL", f"'{lang}'" if lang else "NULL"
    return f"SELECT {s}, '{graph.SCHEMA + p if ':' not in p else p}', {o}, 'literal', {kind}, {tongue} FROM {rel} WHERE {o} IS NOT NULL"


def _lists(rows: list) -> str:
    return "[" + ", ".join("[" + ", ".join(f"'{x}'" for x in items) + "]::VARCHAR[]" for _, items in rows) + f"][(k % {len(rows)} + 1)::INTEGER]"


def _words(rows: list) -> str:
    return picked("k", [r[1] for r in rows])


_CASE = _iri("case", "itemid")
_YEAR = "CASE WHEN k % 3 < 2 THEN (1990 + k % 30)::VARCHAR END"
_FINDING = _iri("finding", "itemid || '_' || lower(cls) || '_' || pos")


def _entity(kind: str, cls: str, rel: str, lang: str | None = None) -> list[str]:
    """rel: (x, label), the first mention of each."""
    s = _iri(kind, "x")
    return [_node(s, graph.TYPE, _term(f"'{cls}'"), rel), _literal(s, graph.LABEL, "label", rel, None, lang)]


_SQL = f"""WITH c AS (SELECT doc_id AS k, '001-' || doc_id AS itemid, lang FROM documents WHERE doc_id IS NOT NULL),
app AS (SELECT DISTINCT x FROM (SELECT k || '/09' AS x FROM c UNION ALL SELECT (k + 1) || '/09' FROM c UNION ALL SELECT (k + 7) || '/09' FROM c UNION ALL SELECT (3 * k) || '/10' FROM c)),
article AS (SELECT k, itemid, unnest({_lists(_ARTICLES)}) AS x FROM c),
concluded AS (SELECT itemid, unnest({_lists(_CONCLUSIONS)}) AS x FROM c),
state AS (SELECT itemid, {_words(_STATES)} AS x FROM c),
violated AS (SELECT itemid, 'Violation' AS cls, unnest(l) AS x, unnest(range(len(l))) AS pos FROM (SELECT itemid, {_lists(_VIOLATIONS)} AS l FROM c)),
kept AS (SELECT itemid, 'NonViolation' AS cls, unnest(l) AS x, unnest(range(len(l))) AS pos FROM (SELECT itemid, {_lists(_OTHERS)} AS l FROM c)),
finding AS (FROM violated UNION ALL FROM kept),
judge AS (SELECT k, itemid, CASE WHEN k % 5 = 0 THEN 'Judge ' || k % 37 ELSE (k % 41)::VARCHAR END AS x, 'Judge ' || k % 37 AS label, CASE WHEN k % 5 > 0 THEN (k % 41)::VARCHAR END AS id FROM c),
first_judge AS (SELECT x, arg_min(label, k) AS label, arg_min(id, k) AS id FROM judge GROUP BY x),
body AS (SELECT DISTINCT x, x AS label FROM (SELECT {picked("k", [r[0] for r in _BODIES])} AS x FROM c) WHERE x IS NOT NULL),
kind AS (SELECT DISTINCT x, x AS label FROM (SELECT {picked("k", [r[0] for r in _TYPES])} AS x FROM c) WHERE x IS NOT NULL),
keyword AS (SELECT itemid, 'Topic ' || k % 11 AS x, (100 + k % 11)::VARCHAR AS code FROM c UNION ALL SELECT itemid, 'Theme ' || k % 3, (200 + k % 3)::VARCHAR FROM c),
named_article AS (SELECT DISTINCT x, 'Article ' || x AS label FROM (SELECT x FROM article UNION ALL SELECT x FROM finding)),
named_app AS (SELECT x, x AS label FROM app), named_state AS (SELECT DISTINCT x, x AS label FROM state WHERE x IS NOT NULL), named_keyword AS (SELECT DISTINCT x, x AS label, code FROM keyword),
t AS (""" + " UNION ".join([
    _node(_CASE, graph.TYPE, _term("'CaseDocument'"), "c"),
    _node(_CASE, graph.TYPE, _term(_words(_TYPES)), "c"),
    _literal(_CASE, "hasItemId", "itemid", "c"),
    _literal(_CASE, "hasCaseName", "'CASE OF PARTY ' || k || ' v. STATE'", "c"),
    _literal(_CASE, graph.LABEL, "'CASE OF PARTY ' || k || ' v. STATE'", "c", None),
    _literal(_CASE, "hasEcli", "'ECLI:X:' || k", "c"),
    _literal(_CASE, "hasLanguageCode", "upper(lang)", "c"),
    _literal(_CASE, "hasJudgmentDate", "CASE k % 3 WHEN 0 THEN (1990 + k % 30) || '-03-04' WHEN 1 THEN (1990 + k % 30) || '-11-30' END", "c", "date"),
    _literal(_CASE, "hasYear", _YEAR, "c", "gYear"),
    _literal(_CASE, "hasApplicantName", "'Party ' || k % 1000", "c"),
    _node(_CASE, "hasArticle6Limb", _term("'Limb_' || " + _words(_LIMBS)), "c"),
    _node(_CASE, "hasImportanceLevel", _term("'Importance_' || CASE WHEN k % 5 > 0 THEN k % 5 END"), "c"),
    _node(_CASE, "hasSeparateOpinion", _term("'SeparateOpinion_' || " + _words(_OPINIONS)), "c"),
    _node(_CASE, "hasChamberType", _term(f"coalesce({_words(_LEVELS)}, {_words(_BODIES)}, CASE WHEN {picked('k', [r[0] for r in _LEVELS])} ILIKE '%chamber%' THEN 'Chamber' END)"), "c"),
    _node(_CASE, "hasCourtFormation", f"CASE WHEN {picked('k', [r[0] for r in _BODIES])} IS NOT NULL THEN {_iri('court_formation', picked('k', [r[0] for r in _BODIES]))} END", "c"),
    _node(_CASE, "hasJudgmentType", f"CASE WHEN {picked('k', [r[0] for r in _TYPES])} IS NOT NULL THEN {_iri('judgment_type', picked('k', [r[0] for r in _TYPES]))} END", "c"),
    _node(_CASE, "hasApplication", _iri("application", "k || '/09'"), "c"),
    _node(_CASE, "hasApplication", _iri("application", "(k + 1) || '/09'"), "c"),
    _node(_CASE, "citesApplication", _iri("application", "(k + 7) || '/09'"), "c"),
    _node(_CASE, "referencesSecondaryApplication", _iri("application", "(3 * k) || '/10'"), "c"),
    _node(_CASE, "concernsArticle", _iri("convention_article", "x"), "article"),
    _literal(_CASE, "hasConclusionReference", "x", "concluded"),
    _node(_CASE, "hasKeyword", _iri("keyword", "x"), "keyword"),
    _node(_CASE, "hasRespondentState", f"CASE WHEN x IS NOT NULL THEN {_iri('country', 'x')} END", "state"),
    _node(_CASE, "hasJudge", _iri("judge", "x"), "judge"),
    _node(_CASE, "hasFinding", _FINDING, "finding"),
    _node(_FINDING, graph.TYPE, _term("cls"), "finding"),
    _literal(_FINDING, graph.LABEL, "cls || ' ' || x", "finding", None),
    _node(_FINDING, "findingRefersToArticle", _iri("convention_article", "x"), "finding"),
    _node(_iri("case", "a.itemid"), "citesCase", _iri("case", "b.itemid"), "c a JOIN c b ON b.k = a.k + 7 OR b.k = a.k + 6"),
    *_entity("court_formation", "CourtFormation", "body"), *_entity("judgment_type", "JudgmentType", "kind"), *_entity("application", "Application", "named_app"), *_entity("convention_article", "ConventionArticle", "named_article"),
    *_entity("keyword", "Keyword", "named_keyword"), *_entity("country", "Country", "named_state", "en"), *_entity("judge", "Judge", "first_judge"),
    _literal(_iri("application", "x"), "hasApplicationNumber", "x", "app"),
    _literal(_iri("keyword", "x"), "hasKeywordCode", "code", "named_keyword"),
    _literal(_iri("judge", "x"), "hasJudgeId", "id", "first_judge", "integer"),
]) + ")"


@query(f"{_SQL} SELECT s, p, o, o_kind, o_datatype, o_lang FROM t")
def case_graph_triples(spark, d):
    return graph.build(_cases(spark, d))


@query(f"""{_SQL}, o AS (SELECT DISTINCT o, o_kind, coalesce(o_datatype, '') AS a, coalesce(o_lang, '') AS b FROM t)
SELECT count(*) AS triples, count(DISTINCT s) AS subjects, count(DISTINCT p) AS predicates, (SELECT count(*) FROM o) AS objects, count(DISTINCT s) AS iri_subjects, 0::BIGINT AS blank_subjects, (SELECT count(*) FROM o WHERE o_kind = 'literal') AS literal_objects FROM t""")
def case_graph_profile(spark, d):
    return graph.statistics(graph.build(_cases(spark, d)))


@query(f"{_SQL} SELECT o AS class, count(DISTINCT s) AS n FROM t WHERE p = '{graph.TYPE}' GROUP BY o")
def case_graph_classes(spark, d):
    return graph.class_counts(graph.build(_cases(spark, d)))


@query(f"{_SQL.split(chr(10) + 't AS (')[0].rstrip().rstrip(',')} SELECT {_CASE} AS case_iri, cls, pos::INTEGER AS pos, x, {_FINDING} AS finding FROM finding")
def case_findings(spark, d):
    return graph.findings(graph.case_records(_cases(spark, d))).select("case_iri", "cls", "pos", "x", "finding")


@query("""SELECT 'finding_' || lpad((row_number() OVER (ORDER BY k, rank, pos) - 1)::VARCHAR, 6, '0') AS name, k AS ordinal, x FROM (""" + f"""SELECT k, 0 AS rank, unnest(range(len(l))) AS pos, unnest(l) AS x FROM (SELECT doc_id AS k, {_lists(_VIOLATIONS).replace('(k %', '(doc_id %')} AS l FROM documents) UNION ALL SELECT k, 1, unnest(range(len(l))), unnest(l) FROM (SELECT doc_id AS k, {_lists(_OTHERS).replace('(k %', '(doc_id %')} AS l FROM documents)""" + ")")
def case_finding_numbers(spark, d):
    return graph.number_findings(graph.findings(graph.case_records(_cases(spark, d)))).select("name", "ordinal", "x")
