"""The end-to-end stages: register rows to cases, HTML to corpus, cases and corpus to a sample, cases to a graph and its report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.functions import dates, legal, text
from docketry.operators import graph, html, matching, sampling, sections, stats, tables

LANGUAGES = {"ENG": 0, "FRE": 1}

# ---- register rows


def split_by_kind(raw: DataFrame) -> dict[str, DataFrame]:
    """judgments, decisions and other, by document type."""
    marked = raw.withColumn("_kind", legal.document_kind("doctype"))
    return {k: marked.filter(F.col("_kind") == k).drop("_kind") for k in ("judgments", "decisions", "other")}


def appno_map(raw: DataFrame) -> DataFrame:
    """(individual_appno, ecli, itemid): one row for each application number of a case."""
    numbers = F.split(text.clean_appnos("appno"), ";")
    return raw.select(F.explode(numbers).alias("individual_appno"), "ecli", "itemid").filter("individual_appno <> ''")


def in_languages(raw: DataFrame) -> DataFrame:
    """English and French rows."""
    return raw.filter(F.col("languageisocode").isin(*LANGUAGES))


def language_counts(raw: DataFrame) -> DataFrame:
    return raw.agg(*[F.count_if(F.col("languageisocode") == k).alias(k.lower()) for k in LANGUAGES])


def one_per_ecli(raw: DataFrame, folder: str | None = None) -> DataFrame:
    """One row an ECLI, English before French; with the path of its text in `folder` if given."""
    kept = tables.preferred_language(raw, "ecli", "languageisocode", "itemid", LANGUAGES)
    return kept.withColumn("case_text_path", F.concat(F.lit(f"{folder}/"), "itemid", F.lit(".html"))) if folder else kept


def with_texts(raw: DataFrame, stems: DataFrame) -> DataFrame:
    """Rows whose text file is among the stems (see sources.readers.existing_stems)."""
    return raw.join(stems.select(F.col("stem").alias("itemid")).distinct(), "itemid", "left_semi")


# ---- cases


def process_cases(raw: DataFrame, judges: DataFrame, keywords: DataFrame, systems: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Cases from register rows: lists parsed, codes named, judges matched, limb and law system classified.

    judges: judge_id, name. keywords and systems: code, label. The keyword and law-system dictionaries have some hundred
    rows; the keyword list goes through a join, the law systems of at most a few countries a case through one too.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold is between 0 and 1")
    c = tables.case_columns(raw)
    for name in ("case_appno", "secondary_appno", "cited_appno"):
        c = c.withColumn(name, text.parse_list(text.clean_appnos(name)))
    c = c.withColumn("secondary_appno", text.list_difference("secondary_appno", "case_appno")).withColumn("cited_appno", text.list_difference("cited_appno", "case_appno"))
    c = c.withColumn("importance", F.col("importance").cast("bigint")).withColumn("judgementdate", dates.day_first("judgementdate"))
    c = c.withColumn("originatingbody", F.try_element_at(legal.mapping(legal.BODY_CODES), text.strip("originatingbody"))).withColumn("judgment_type", F.try_element_at(legal.mapping(legal.TYPE_CODES), text.strip("judgment_type")))
    c = c.withColumn("appellant", text.appellant("case_name")).withColumn("country_name", legal.country_names(text.parse_list("respondent")))
    c = c.withColumn("judges", text.parse_list("judges"))
    for name in ("article", "violation", "nonviolation", "conclusion"):
        c = c.withColumn(name, text.parse_list(name))
    found = matching.best_matches(c.select(F.explode("judges").alias("name")), judges)
    c = matching.matched_lists(c, "itemid", "judges", found, threshold).withColumnsRenamed({"ids": "judges_id", "scores": "judge_similarity_pct"})
    c = tables.map_list_by_table(c.withColumn("_codes", text.parse_list("kpthesaurus")), "itemid", "_codes", keywords, "kpthesaurus_labels").drop("_codes")
    c = c.withColumn("limb", legal.limb("kpthesaurus_labels"))
    of = c.select("itemid", F.explode("country_name").alias("_country")).join(systems.select(F.col("code").alias("_country"), F.col("label").alias("_system")), "_country")
    collapsed = of.groupBy("itemid").agg(legal.collapse(F.collect_set("_system")).alias("law_system"))
    return c.join(collapsed, "itemid", "left")


def unmatched_report(cases: DataFrame, matches: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Names without a match, with their frequency and nearest name."""
    counts = stats.item_counts(cases, F.col("judges")).withColumnRenamed("item", "name")
    return matching.unmatched_names(matches, counts, threshold)


def unmapped_keywords(raw: DataFrame, keywords: DataFrame) -> DataFrame:
    return tables.unmatched(raw.select(F.explode(text.parse_list("kpthesaurus")).alias("code")), F.col("code"), keywords)


# ---- corpus


def build_corpus(pages: DataFrame, decision: bool = False, skip_empty: bool | None = None) -> DataFrame:
    """(itemid, full_text, text_chunks, tables, error) from (itemid, html). Decisions always leave out documents without text; judgments do if asked."""
    read = html.extract(pages.select("itemid", "html")).withColumn("full_text", html.markdown("blocks"))
    if decision or skip_empty:
        read = read.filter(F.length(text.strip("full_text")) > 0)
    cut = sections.with_sections(read, "full_text", decision)
    return cut.select("itemid", "full_text", F.struct(*sections.SECTIONS).alias("text_chunks"), "tables", "error")


def corpus_counts(pages: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row: documents read, written, left out and failed."""
    total, written = pages.agg(F.count(F.lit(1)).alias("total")), corpus.agg(F.count_if(F.col("error").isNull()).alias("success"), F.count("error").alias("errors"))
    return total.crossJoin(written).withColumn("skipped", F.col("total") - F.col("success") - F.col("errors"))


def section_statistics(corpus: DataFrame) -> DataFrame:
    return stats.segment_stats(corpus.select("text_chunks.*"), list(sections.SECTIONS))


def level_statistics(corpus: DataFrame, cases: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Text lengths by court level; levels under their label, screening panels under one."""
    level = F.when(F.col("court_level").ilike("%screening%"), "Screening").otherwise(F.coalesce(F.try_element_at(legal.mapping(labels), F.col("court_level")), "court_level"))
    joined = corpus.select("itemid", "full_text").join(cases.select("itemid", "court_level"), "itemid", "left").withColumn("level", level)
    return stats.length_stats(joined, F.length(F.coalesce("full_text", F.lit(""))), "level", digits=0)


# ---- sample


def build_sample(judgments: DataFrame, decisions: DataFrame, corpus_judgments: DataFrame, corpus_decisions: DataFrame, k: int = 50) -> DataFrame:
    """A time-spread sample of each court level of the cases that have a text, with text and sections joined."""
    cases = tables.relaxed_union(
        tables.with_match(judgments, corpus_judgments, "itemid").withColumn("source", F.lit("judgments")),
        tables.with_match(decisions, corpus_decisions, "itemid").withColumn("source", F.lit("decisions")),
    )
    tables.require(cases, "itemid", "court_level", "judgementdate", "ecli")
    dated = cases.withColumn("year", dates.case_year(F.col("judgementdate").cast("string"), F.col("ecli"))).filter("court_level is not null and year is not null")
    # only key columns are ordered; the wide rows are joined to what was chosen
    chosen = sampling.time_spread_sample(dated.select("itemid", "source", "court_level", "year"), "court_level", "year", "itemid", k=k).select("itemid", "source")
    sample = dated.join(chosen, ["itemid", "source"], "left_semi")
    texts = corpus_judgments.withColumn("source", F.lit("judgments")).unionByName(corpus_decisions.withColumn("source", F.lit("decisions")))
    first = tables.first_per_key(texts.join(chosen, ["itemid", "source"], "left_semi"), ["itemid", "source"], F.desc(F.length("full_text")), F.col("full_text"))
    return sample.join(first.select("itemid", "source", "full_text", *[F.nullif(F.col(f"text_chunks.{s}"), F.lit("")).alias(s) for s in sections.SECTIONS]), ["itemid", "source"], "left")


def english_with_text(sample: DataFrame) -> DataFrame:
    return sample.filter((F.length("full_text") > 0) & (F.upper("languageisocode") == "ENG"))


def period_country_shares(cases: DataFrame, last_year: int = 2025) -> DataFrame:
    """Cases of each European country in each period, and their share of the period."""
    code = legal.iso3(legal.first_country("country_name"), legal.respondent_code(F.split("respondent", ";")))
    placed = cases.withColumn("country", code).filter((F.col("year") <= last_year) & F.col("country").isin(*legal.COUNTRIES)).withColumn("period", dates.period("year"))
    countries = cases.sparkSession.createDataFrame([(x,) for x in legal.COUNTRIES], "country string")
    return tables.grid_counts(placed, placed, countries, "period", "country")


# ---- graph


def graph_report(triples: DataFrame, name: str = "graph", top: int = 20) -> list[str]:
    """The graph's statistics as lines: totals, most frequent predicates and classes, triples a case. Everything but these few aggregates stays distributed."""
    total = graph.statistics(triples).first().asDict()
    lines = [f"# {name}", *[f"{k}: {v}" for k, v in total.items()]]
    for title, counts, key in (("predicates", graph.predicate_counts(triples), "p"), ("classes", graph.class_counts(triples), "class")):
        lines += [f"## {title}", *[f"{r[key]}: {r['n']}" for r in stats.top(counts, top, key).collect()]]
    cases = triples.filter((F.col("p") == graph.TYPE) & (F.col("o") == graph.SCHEMA + "CaseDocument")).select("s")
    degree = graph.out_degrees(triples.join(cases, "s", "left_semi"))
    spread = stats.lower_rank_quantiles(degree, "n").first()
    return [*lines, "## triples per case", *([f"{k}: {v}" for k, v in spread.asDict().items()] if spread else [])]


def qname(term: Column, prefixes: dict[str, str]) -> Column:
    """An IRI under the prefix of its namespace, the longest that fits."""
    out = F
    for namespace, prefix in sorted(prefixes.items(), key=lambda x: -len(x[0])):
        out = out.when(term.startswith(namespace), F.concat(F.lit(prefix + ":"), F.substring(term, len(namespace) + 1, 1_000_000)))
    return term if out is F else out.otherwise(term)


def running_share(counts: DataFrame, order: str, n: str = "n") -> DataFrame:
    """counts of a few ordered values with their running share of the total."""
    w = Window.orderBy(order)
    return counts.withColumn("running", F.sum(n).over(w) / F.sum(n).over(Window.partitionBy()))


def json_with_comments(spark: SparkSession, path: str, schema) -> DataFrame:
    """A JSON file with // and /* */ comments."""
    return spark.read.schema(schema).option("multiLine", True).option("allowComments", True).json(path)
