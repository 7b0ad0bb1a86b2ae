"""Queries of the column functions, by family, over whole columns of the driver's tables that are dressed up as the functions' inputs; and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.functions import dates, legal, text
from docketry.operators import graph, html, sections, stats, tables  # noqa: F401
from docketry.plans.catalogue import _TRIPLES, _triples, query, table


def pick(key: Column, values: list) -> Column:
    """One of the values by the key's remainder; None is null."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (key % len(values) + 1).cast("int"))


def picked(key: str, values: list) -> str:
    """The same in SQL."""
    return "[" + ", ".join("NULL" if v is None else "'" + str(v).replace("'", "''") + "'" for v in values) + f"][({key} % {len(values)} + 1)::INTEGER]"


_V = r"""CASE p_partkey % 6 WHEN 0 THEN '  ' || p_name || ' ' WHEN 1 THEN 'NaN' WHEN 2 THEN '' WHEN 3 THEN 'The  ' || p_type WHEN 4 THEN p_name || chr(9) || '"x' || chr(92) || 'y"' || chr(10) || chr(13) || p_type ELSE 'n/a' END"""
_S = r"regexp_replace(v, '^\s+|\s+$', '', 'g')"


@query(rf"""WITH x AS (SELECT p_partkey, p_type, {_V} AS v FROM part), y AS (SELECT *, {_S} AS s FROM x)
SELECT p_partkey, CASE WHEN lower(s) NOT IN ('', 'nan', 'none', 'null') THEN s END AS normalized, coalesce(nullif(lower(regexp_replace(regexp_replace(s, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')), ''), 'unknown') AS slug,
regexp_replace(regexp_replace(regexp_replace(lower(s), '^the\s+', ''), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS label, regexp_replace(lower(s), '\s+', ' ', 'g') AS name, coalesce(s, '') AS filled, regexp_replace(v, '[^A-Za-z0-9_.-]+', '_', 'g') AS filename,
CASE WHEN length(v) > 10 THEN left(v, 10) || '... [' || (length(v) - 10) || ' more chars]' ELSE v END AS truncated, replace(replace(replace(replace(v, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), ' '), chr(13), '') AS escaped,
s NOT IN ('', 'null', 'none', 'nan', '[]') AND lower(s) NOT IN ('n/a', 'na') AS valid, 'has Part ' || replace(p_type, ' ', 'X') AS term FROM y""")
def text_scalars(spark, d):
    k = F.col("p_partkey") % 6
    v = F.when(k == 0, F.concat(F.lit("  "), "p_name", F.lit(" "))).when(k == 1, "NaN").when(k == 2, "").when(k == 3, F.concat(F.lit("The  "), "p_type")).when(k == 4, F.concat("p_name", F.lit('\t"x\\y"\n\r'), "p_type")).otherwise("n/a")
    parts = table(spark, d, "part").select("p_partkey", "p_type", v.alias("v"))
    made = {"normalized": text.normalize_text, "slug": text.slug, "label": text.section_label, "name": text.normalize_name, "filled": text.blank_to_empty, "filename": text.safe_filename, "escaped": text.turtle_escape, "valid": text.is_valid}
    iri = F.concat(F.lit("https://example.org/schema#hasPart_"), F.replace("p_type", F.lit(" "), F.lit("X")))
    return parts.select("p_partkey", *[f("v").alias(c) for c, f in made.items()], text.truncate("v", 10).alias("truncated"), text.humanize(iri).alias("term"))


@query("""WITH x AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)
SELECT p_partkey, CASE p_partkey % 4 WHEN 2 THEN '' ELSE array_to_string(w, '|') END AS items, array_to_string(list_filter(w, lambda a, i: list_position(w, a) = i), '|') AS firsts, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE len(w) END AS n_ensured, p_partkey % 3 = 0 AS missing, CASE p_partkey % 4 WHEN 0 THEN w[1] || '~' || array_to_string(w, ' ') ELSE array_to_string(w, ' ') END AS paragraphs FROM x""")
def list_scalars(spark, d):
    k, words = F.col("p_partkey"), F.split("p_name", " ")
    kind = k % 4
    written = F.when(kind == 0, F.replace("p_name", F.lit(" "), F.lit("; "))).when(kind == 1, F.concat(F.lit("['"), F.replace("p_name", F.lit(" "), F.lit("', '")), F.lit("']"))).when(kind == 2, "None").otherwise(F.concat(F.replace("p_name", F.lit(" "), F.lit("|")), F.lit(";;nan")))
    some = F.when(k % 3 != 0, words)
    parted = F.when(kind == 0, F.concat(F.lit("\\n\\n ".replace("\\n", "\n")), words[0], F.lit("\n\n\n\n"), "p_name")).otherwise(F.concat("p_name", F.lit("\n\n  ")))
    return table(spark, d, "part").select("p_partkey", F.array_join(text.normalize_list(written), "|").alias("items"), F.array_join(text.ordered_unique(words, words), "|").alias("firsts"), F.size(text.ensure_list(some)).cast("long").alias("n_ensured"), text.is_missing(some).alias("missing"), F.array_join(text.paragraphs(parted), "~").alias("paragraphs"))


_ARTICLES = [("p1-1+6-3-c", "P1-1|6-3-c"), ("6+6+ 13", "6|13"), ("8", "8"), ("P7-2++14", "P7-2|14")]
_REFERENCES = [("Violation of Art. 6-1", "6-1"), ("6+P1-1", "6|P1-1"), ("Inadmissible", ""), ("Articles 6", ""), ("Award under Article 41 of 5000 euro", "41|5000"), (None, "")]
_CHAMBERS = [("Court (Grand Chamber)", None, "GrandChamber"), ("Commission", "", "Commission"), ("Court (Second Section Committee)", None, "Committee"), ("Court (Third Section)", None, "Chamber"), ("x", "DECGRANDCHAMBER", "GrandChamber"), ("Court (First Section)", "Admissibility-Com", "Committee"), ("x", "y", None)]
_OPINIONS = [(None, "Absent"), ("FALSE", "Absent"), (" no ", "Absent"), ("1", "Present"), ("maybe", "Present"), ("NaN", "Absent")]
_COUNTRIES = [("Turkey", "TUR", "Türkiye"), ("russia", "RUS", "Russian Federation"), ("FRA", "FRA", "France"), ("gbr", "GBR", "United Kingdom"), ("Nowhere", None, "Nowhere"), (" Czechia ", "CZE", "Czechia"), (None, None, None)]
_TERMS = [("Civil", "Limb_Civil"), ("MIXED ", "Limb_Mixed"), ("other", None), (None, None)]
_KINDS = [("Judgment (Merits)", "x", "Judgment"), ("Decision (Final)", "x", "Decision"), (None, "decisions", "Decision"), (None, None, "Judgment")]


@query(f"""SELECT o_orderkey, {picked("o_orderkey", [a for _, a in _ARTICLES])} AS codes, {picked("o_orderkey", [a for _, a in _REFERENCES])} AS refs, {picked("o_orderkey", [a[2] for a in _CHAMBERS])} AS chamber, 'SeparateOpinion_' || {picked("o_orderkey", [a for _, a in _OPINIONS])} AS opinion,
{picked("o_orderkey", [a[1] for a in _COUNTRIES])} AS iso3, {picked("o_orderkey", [a[2] for a in _COUNTRIES])} AS country, {picked("o_orderkey", [a for _, a in _TERMS])} AS term, {picked("o_orderkey", [a[2] for a in _KINDS])} AS class FROM orders""")
def legal_scalars(spark, d):
    k = F.col("o_orderkey")
    one = lambda rows, i=0: pick(k, [r[i] for r in rows])
    return table(spark, d, "orders").select(
        "o_orderkey", F.array_join(legal.expand_articles(F.array(one(_ARTICLES))), "|").alias("codes"), F.array_join(legal.article_references(F.array(one(_REFERENCES))), "|").alias("refs"), legal.chamber_type(one(_CHAMBERS), one(_CHAMBERS, 1)).alias("chamber"), legal.separate_opinion(one(_OPINIONS)).alias("opinion"),
        legal.iso3(one(_COUNTRIES)).alias("iso3"), legal.canonical_country(one(_COUNTRIES)).alias("country"), legal.term(one(_TERMS), legal.LIMB_TERMS).alias("term"), legal.case_class(one(_KINDS), one(_KINDS, 1)).alias("class"),
    )


@query("""WITH x AS (SELECT s_suppkey, n_name, n_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT s_suppkey, n_name AS first, CASE WHEN n_nationkey % 2 = 0 THEN 'FRA' END AS respondent, CASE n_nationkey % 3 WHEN 0 THEN 'Civil' WHEN 1 THEN 'Mixed' END AS system FROM x""")
def country_list_scalars(spark, d):
    k = F.col("n_nationkey")
    joined = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == k)
    systems = legal.mapping({"France": "Civil", "Malta": "Mixed", "Ireland": "Common"})
    named = F.when(k % 3 == 0, F.array(F.lit("France"), F.lit("Nowhere"))).when(k % 3 == 1, F.array(F.lit("France"), F.lit("Ireland"))).otherwise(F.array(F.lit("Nowhere")))
    codes = F.when(k % 2 == 0, F.array(F.lit("x"), F.lit(" fra "), F.lit("GBR"))).otherwise(F.array(F.lit("none of"), F.lit("12")))
    return joined.select("s_suppkey", legal.first_country(F.array(F.lit(None), F.lit(" "), F.concat(F.lit(" "), "n_name"))).alias("first"), legal.respondent_code(codes).alias("respondent"), legal.law_system(named, systems).alias("system"))


@query("""WITH x AS (SELECT o_orderkey, o_orderdate AS t, year(o_orderdate) AS y, o_orderkey % 4 AS k FROM orders)
SELECT o_orderkey, strftime(t, '%Y-%m-%d %H:%M:%S') AS stamp, CASE WHEN k < 2 THEN strftime(t, '%Y-%m-%d') END AS day, CASE WHEN k <> 3 THEN y END::INTEGER AS begins, CASE k WHEN 0 THEN y + 5 WHEN 3 THEN y END::INTEGER AS ends, CASE k WHEN 0 THEN y + 5 WHEN 2 THEN y WHEN 3 THEN y END::INTEGER AS single_ends FROM x""")
def date_scalars(spark, d):
    k, t, y = F.col("o_orderkey") % 4, F.col("o_orderdate"), F.year("o_orderdate")
    iso = F.date_format(t, "yyyy-MM-dd")
    written = F.when(k == 0, iso).when(k == 1, F.concat(iso, F.lit("T00:00:00.000"))).when(k == 2, F.date_format(t, "dd/MM/yyyy")).otherwise("none")
    text_of = lambda c: c.cast("string")
    tenure = F.when(k == 0, F.concat_ws("-", text_of(y), text_of(y + 5))).when(k == 1, F.concat(text_of(y), F.lit("-"))).when(k == 2, text_of(y)).otherwise(F.concat(F.lit("-"), text_of(y)))
    spans = dates.year_range(tenure), dates.year_range(tenure, True)
    return table(spark, d, "orders").select("o_orderkey", F.date_format(dates.day_first(F.date_format(t, "dd/MM/yyyy HH:mm:ss")), "yyyy-MM-dd HH:mm:ss").alias("stamp"), dates.optional_date(written).cast("string").alias("day"), spans[0]["start"].alias("begins"), spans[0]["end"].alias("ends"), spans[1]["end"].alias("single_ends"))


@query("""SELECT 'Parts' AS corpus, p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size + 0.5 WHEN 1 THEN p_size END::DOUBLE AS lenient, CASE WHEN p_partkey % 2 = 0 THEN p_size END::BIGINT AS whole, p_size::VARCHAR AS written FROM part""")
def coerced_columns(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    lenient = F.when(k % 3 == 0, F.concat(F.lit(" "), size, F.lit(".5"))).when(k % 3 == 1, size).otherwise("about 5")
    made = table(spark, d, "part").select("p_partkey", tables.lenient_number(lenient).alias("lenient"), tables.nullable_int(F.when(k % 2 == 0, size)).alias("whole"), tables.as_text("p_size").alias("written"))
    return tables.labelled(made, corpus="Parts")


@query("""SELECT event_id, 'a // no /* comment */ "' AS note, json_extract_string(props, '$.k') AS k FROM events""")
def json_comment_strip(spark, d):
    note = F.lit('"note": "a // no /* comment */ \\"", // one\n/* two "lines"\n*/ ')
    written = F.concat(F.lit("/* first */ {"), note, F.substring("props", 2, 1_000_000), F.lit(" // last"))
    plain = F.from_json(text.strip_json_comments(written), "note string, k string")
    return table(spark, d, "events").select("event_id", plain["note"].alias("note"), plain["k"].alias("k"))


@query(f"WITH {_TRIPLES} SELECT s, p, o FROM t ORDER BY o, s, p LIMIT 100")
def first_triples_in_order(spark, d):
    return graph.in_order(_triples(spark, d)).select("s", "p", "o").limit(100)


@query(f"WITH {_TRIPLES} SELECT s, p, o FROM t WHERE p <> '{graph.LABEL}' AND s <> '{graph.DATA}region_1' AND o <> '{graph.DATA}region_1'")
def triples_without_header(spark, d):
    return graph.without_node(_triples(spark, d), graph.DATA + "region_1").select("s", "p", "o")


_PLANTED = [
    ("# PROCEDURE", "procedure"), ("THE FACTS", "facts"), ("I. THE CIRCUMSTANCES OF THE CASE", "facts"), ("RELEVANT DOMESTIC LAW AND PRACTICE", "legal_framework"), ("EN DROIT", "law"), ("PAR CES MOTIFS, LA COUR", "reasons"), ("QUESTIONS TO THE PARTIES", "skip"), ("## APPENDIX", "appendix"), ("FOR THESE REASONS, THE COURT", "reasons"), ("THE LAW", "law"), ("APPENDIX to it", None),
]
#: Of which line of a document a header is planted, and which one.
_EVERY = 4
_WHITE = r"[\t-\r\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STATE = "[" + ", ".join("NULL" if s is None else f"'{s}'" for _, s in _PLANTED) + "]"


@query(rf"""WITH l AS (SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
h AS (SELECT doc_id, pos, CASE WHEN (doc_id + pos) % {_EVERY} = 0 THEN {picked("(doc_id + pos // 4)", [a for a, _ in _PLANTED])} ELSE regexp_replace(line, '^{_WHITE}+|{_WHITE}+$', '', 'g') END AS line, CASE WHEN (doc_id + pos) % {_EVERY} = 0 THEN {_STATE}[((doc_id + pos // 4) % {len(_PLANTED)} + 1)::INTEGER] END AS state FROM l),
s AS (SELECT doc_id, pos, coalesce(last_value(state IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 'introduction') AS state, CASE WHEN state IS NULL THEN line || chr(10) ELSE chr(10) || chr(10) || line || chr(10) || chr(10) END AS line FROM h),
t AS (SELECT doc_id, state, regexp_replace(string_agg(line, '' ORDER BY pos), '^{_WHITE}+|{_WHITE}+$', '', 'g') AS text FROM s GROUP BY doc_id, state)
SELECT doc_id, {", ".join(f"coalesce(max(text) FILTER (state = '{x}'), '') AS {x}" for x in sections.SECTIONS)} FROM t GROUP BY doc_id""")
def document_sections(spark, d):
    # a header stands in the place of every fourth line; one of the forms is no header
    k = F.col("doc_id")
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.when((k + i) % _EVERY == 0, pick(k + F.floor(i / 4), [a for a, _ in _PLANTED])).otherwise(x))
    return sections.with_sections(table(spark, d, "documents").select("doc_id", F.array_join(lines, "\n").alias("full_text"))).select("doc_id", *sections.SECTIONS)
