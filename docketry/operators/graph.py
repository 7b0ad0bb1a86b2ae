"""Triples: a table (s, p, o, o_kind, o_datatype, o_lang) with set semantics, minted from case records, and its profile."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import legal
from docketry.functions.dates import optional_date, year_range
from docketry.functions.text import normalize_list, normalize_text, ordered_unique, slug

DATA = "https://example.org/docketry/data#"
SCHEMA = "https://example.org/docketry/schema#"
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
COMMENT = "http://www.w3.org/2000/01/rdf-schema#comment"
SAME_AS = "http://www.w3.org/2002/07/owl#sameAs"
XSD = "http://www.w3.org/2001/XMLSchema#"
WIKIDATA = "http://www.wikidata.org/entity/"

COLUMNS = ["s", "p", "o", "o_kind", "o_datatype", "o_lang"]


def iri(kind: str, key: Column) -> Column:
    """The IRI of an entity; keys that slug alike share one."""
    return F.concat(F.lit(f"{DATA}{kind}_"), slug(key))


def term(name: str | Column) -> Column:
    return F.lit(SCHEMA + name) if isinstance(name, str) else F.concat(F.lit(SCHEMA), name)


def edge(p: str, o: Column, schema: bool = True) -> Column:
    """(p, o, ...) for an IRI; null if o is."""
    return F.when(o.isNotNull(), F.struct(F.lit(SCHEMA + p if schema else p).alias("p"), o.alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype"), F.lit(None).cast("string").alias("o_lang")))


def literal(p: str, o: Column, datatype: str | None = "string", lang: str | None = None, schema: bool = True) -> Column:
    o = o.cast("string")
    kind = F.lit(XSD + datatype if datatype else None).cast("string")
    return F.when(o.isNotNull(), F.struct(F.lit(SCHEMA + p if schema else p).alias("p"), o.alias("o"), F.lit("literal").alias("o_kind"), kind.alias("o_datatype"), F.lit(lang).cast("string").alias("o_lang")))


def melt(df: DataFrame, subject: Column, *statements: Column) -> DataFrame:
    """One triple for each statement of each row that isn't null: one pass, whatever their number."""
    rows = df.select(subject.alias("s"), F.explode(F.filter(F.array(*statements), lambda x: x.isNotNull())).alias("t"))
    return rows.select("s", "t.*")


def union(*parts: DataFrame) -> DataFrame:
    """The set of all parts' triples."""
    return reduce(DataFrame.unionByName, parts).dropDuplicates(COLUMNS)


def mention(kind: str, cls: str, key: Column, label: Column, lang: str | None = None, *more: Column) -> Column:
    """An entity that a record mentions: its IRI, class, label and further statements. Null if the key is."""
    extra = F.array(*more) if more else F.array(literal(LABEL, F.lit(None)))
    return F.when(key.isNotNull(), F.struct(iri(kind, key).alias("iri"), F.lit(cls).alias("cls"), label.alias("label"), F.lit(lang).cast("string").alias("lang"), extra.alias("more")))


def entities(mentions: DataFrame) -> DataFrame:
    """Type, label and further statements of each entity, from the first row (by ordinal, pos) that mentions it in column m. First mentions are found by aggregation, so one that a third of all records mention is met in parts."""
    first = mentions.filter("m is not null").groupBy("m.iri").agg(F.min_by("m", F.struct("ordinal", "pos")).alias("m"))
    label = F.when(F.col("m.label").isNotNull(), F.struct(F.lit(LABEL).alias("p"), F.col("m.label").alias("o"), F.lit("literal").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype"), F.col("m.lang").alias("o_lang")))
    rows = F.concat(F.array(edge(TYPE, term(F.col("m.cls")), schema=False), label), F.col("m.more"))
    return melt_lists(first, F.col("iri"), rows)


def melt_lists(df: DataFrame, subject: Column, *lists: Column) -> DataFrame:
    """As melt, for lists of statements."""
    every = F.concat(*lists) if len(lists) > 1 else lists[0]
    return df.select(subject.alias("s"), F.explode(F.filter(every, lambda x: x.isNotNull())).alias("t")).select("s", "t.*")


def case_records(cases: DataFrame) -> DataFrame:
    """Cases with an id, their text fields normalised, and their IRI; fields that are missing come as null."""
    fields = ("itemid", "case_name", "ecli", "languageisocode", "year", "case_text_path", "appellant", "kpthesaurus", "judgment_type", "source", "limb", "importance", "law_system", "separateopinion", "court_level", "originatingbody")
    lists = ("kpthesaurus_labels", "case_appno", "cited_appno", "secondary_appno", "article", "conclusion", "violation", "nonviolation", "country_name", "respondent", "judges", "judges_id")
    have = dict(cases.dtypes)

    def text(c: str) -> Column:
        return normalize_text(F.col(c).cast("string")) if c in have else F.lit(None).cast("string")

    def items(c: str) -> Column:
        if c not in have:
            return F.array().cast("array<string>")
        if have[c].startswith("array"):
            # places stay, so that lists that belong together stay aligned
            cleaned = F.transform(F.col(c).cast("array<string>"), normalize_text)
            return F.coalesce(cleaned if c in ("judges", "judges_id") else F.filter(cleaned, lambda x: x.isNotNull()), F.array().cast("array<string>"))
        return normalize_list(F.col(c).cast("string"))

    date = optional_date(F.col("judgementdate").cast("string").alias("d")) if "judgementdate" in have and have["judgementdate"] == "string" else F.to_date("judgementdate") if "judgementdate" in have else F.lit(None).cast("date")
    ordinal = F.col("ordinal") if "ordinal" in have else F.col("itemid")
    out = cases.select(ordinal.alias("ordinal"), *[text(c).alias(c) for c in fields], *[items(c).alias(c) for c in lists], date.alias("judgementdate"))
    return out.filter("itemid is not null").withColumn("case_iri", iri("case", F.col("itemid")))


def case_triples(r: DataFrame) -> DataFrame:
    """Everything that is said of the cases themselves, in one pass over them: literals, controlled terms, and edges from their lists."""
    c = F.col
    year = F.coalesce(F.when(c("year").rlike(r"^\d{4}$"), c("year")), F.year("judgementdate").cast("string"))
    scalars = F.array(
        edge(TYPE, term("CaseDocument"), schema=False),
        edge(TYPE, term(legal.case_class("judgment_type", "source")), schema=False),
        literal("hasItemId", c("itemid")),
        literal("hasCaseName", c("case_name")),
        literal(LABEL, c("case_name"), None, schema=False),
        literal("hasEcli", c("ecli")),
        literal("hasLanguageCode", c("languageisocode")),
        literal("hasJudgmentDate", c("judgementdate").cast("string"), "date"),
        literal("hasYear", year, "gYear"),
        literal("hasCaseTextPath", c("case_text_path")),
        literal("hasApplicantName", c("appellant")),
        edge("hasArticle6Limb", term(legal.term("limb", legal.LIMB_TERMS))),
        edge("hasImportanceLevel", term(legal.term("importance", legal.IMPORTANCE_TERMS))),
        edge("hasLawSystem", term(legal.term("law_system", legal.LAW_SYSTEM_TERMS))),
        edge("hasSeparateOpinion", term(legal.separate_opinion("separateopinion"))),
        edge("hasChamberType", term(legal.chamber_type("originatingbody", "court_level"))),
        edge("hasCourtFormation", F.when(c("originatingbody").isNotNull(), iri("court_formation", c("originatingbody")))),
        edge("hasJudgmentType", F.when(c("judgment_type").isNotNull(), iri("judgment_type", c("judgment_type")))),
    )

    def links(items: Column, p: str, kind: str) -> Column:
        return F.transform(items, lambda x: edge(p, iri(kind, x)))

    return melt_lists(
        r,
        c("case_iri"),
        scalars,
        links(F.array_distinct("case_appno"), "hasApplication", "application"),
        links(F.array_distinct("cited_appno"), "citesApplication", "application"),
        links(F.array_distinct("secondary_appno"), "referencesSecondaryApplication", "application"),
        links(articles(), "concernsArticle", "convention_article"),
        F.transform(legal.article_references("conclusion"), lambda x: literal("hasConclusionReference", x)),
        links(c("kpthesaurus_labels"), "hasKeyword", "keyword"),
        links(states(), "hasRespondentState", "country"),
    )


def articles() -> Column:
    return legal.expand_articles(F.array_distinct("article"))


def states() -> Column:
    """The respondent states' canonical names, of the lists of names and codes."""
    return F.array_distinct(F.transform(ordered_unique("country_name", "respondent"), legal.canonical_country))


def mentioned(r: DataFrame) -> DataFrame:
    """(ordinal, pos, m) of all entities that cases mention, but for judges and findings."""
    codes = F.coalesce(F.filter(F.transform(F.split(F.col("kpthesaurus"), ";"), normalize_text), lambda k: k.isNotNull()), F.array().cast("array<string>"))

    def each(items: Column, make) -> Column:
        return F.transform(items, make)

    applications = each(F.concat("case_appno", "cited_appno", "secondary_appno"), lambda x: mention("application", "Application", x, x, None, literal("hasApplicationNumber", x)))
    cited = F.concat(articles(), *[legal.expand_articles(F.array_distinct(f)) for f in ("violation", "nonviolation")])
    every = F.concat(
        F.array(*[mention(kind, cls, F.col(c), F.col(c)) for kind, cls, c in (("court_formation", "CourtFormation", "originatingbody"), ("judgment_type", "JudgmentType", "judgment_type"))]),
        applications,
        each(cited, lambda x: mention("convention_article", "ConventionArticle", x, F.concat(F.lit("Article "), x))),
        F.transform("kpthesaurus_labels", lambda x, i: mention("keyword", "Keyword", x, x, None, literal("hasKeywordCode", F.get(codes, i)))),
        each(states(), lambda x: mention("country", "Country", x, x, "en")),
    )
    return r.select("ordinal", F.posexplode(every).alias("pos", "m"))


def finding_triples(r: DataFrame) -> DataFrame:
    """Findings with their class, label and article, and the cases' edges to them."""
    found = findings(r)
    own = melt(found, F.col("finding"), edge(TYPE, term(F.col("cls")), schema=False), literal(LABEL, F.concat_ws(" ", "cls", "x"), None, schema=False), edge("findingRefersToArticle", iri("convention_article", F.col("x"))))
    return own.unionAll(melt(found, F.col("case_iri"), edge("hasFinding", F.col("finding"))))


def findings(r: DataFrame) -> DataFrame:
    """(ordinal, case_iri, cls, pos, x, finding): one finding for each article violated or not. Its IRI comes from case, class and place, so no count over all records is needed; number_findings gives running numbers."""
    both = F.concat(*[_tagged(f, n, cls) for f, n, cls in (("violation", 0, "Violation"), ("nonviolation", 1, "NonViolation"))])
    rows = r.select("ordinal", "case_iri", "itemid", F.explode(both).alias("f")).select("ordinal", "case_iri", "itemid", "f.*")
    key = F.concat_ws("_", "itemid", F.lower("cls"), F.col("pos").cast("string"))
    return rows.withColumn("finding", iri("finding", key)).drop("itemid")


def _tagged(field: str, rank: int, cls: str) -> Column:
    articles = legal.expand_articles(F.array_distinct(field))
    return F.transform(articles, lambda a, i: F.struct(F.lit(rank).alias("cls_rank"), F.lit(cls).alias("cls"), i.alias("pos"), a.alias("x")))


def number_findings(found: DataFrame) -> DataFrame:
    """finding_000000 and so on, by record, class and place. One order over all findings is one task's work: for exports of bounded size; findings() itself needs none."""
    number = F.row_number().over(Window.orderBy("ordinal", "cls_rank", "pos")) - 1
    return found.withColumn("name", F.format_string("finding_%06d", number))


def country_links(triples: DataFrame, ids: DataFrame) -> DataFrame:
    """Links of countries to an external register, by ids (name, external)."""
    named = triples.filter((F.col("p") == LABEL) & F.col("s").startswith(f"{DATA}country_")).select("s", F.col("o").alias("name"))
    return melt(named.join(ids.select("name", "external"), "name"), F.col("s"), edge(SAME_AS, F.concat(F.lit(WIKIDATA), "external"), schema=False))


def judge_parts(r: DataFrame, judges: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges to judges, and the judges and their countries as mentions. Judges go by place in the lists of names and ids, with what the register `judges` (judge_id, name, country, tenure, role, role_length) has on them: found by id, else by name."""
    places = F.sequence(F.lit(0), F.greatest(F.size("judges"), F.size("judges_id")) - 1)
    slots = F.transform(places, lambda i: F.struct(F.get("judges", i).alias("name"), F.get("judges_id", i).try_cast("long").alias("id")))
    some = r.filter((F.size("judges") > 0) | (F.size("judges_id") > 0))
    rows = some.select("ordinal", "case_iri", F.posexplode(slots).alias("pos", "j")).select("ordinal", "case_iri", "pos", "j.*")
    if judges is None:
        judges = r.sparkSession.createDataFrame([], "judge_id long, name string, country string, tenure string, role string, role_length string")
    known = judges.select("judge_id", F.struct("judge_id", "name", "country", "tenure", "role", "role_length").alias("authority"), slug(F.col("name")).alias("name_key"))
    by_id = known.select(F.col("judge_id").alias("id"), F.col("authority").alias("_a"))
    by_name = known.groupBy("name_key").agg(F.max_by("authority", "judge_id").alias("_b"))
    found = rows.join(by_id, "id", "left").withColumn("name_key", slug(F.col("name"))).join(by_name, "name_key", "left").withColumn("a", F.coalesce("_a", F.when(F.col("name").isNotNull(), F.col("_b"))))
    found = found.withColumn("judge_id", F.coalesce("a.judge_id", "id")).withColumn("label", F.coalesce(normalize_text(F.col("a.name")), "name")).withColumn("key", F.coalesce(F.col("judge_id").cast("string"), "label")).filter("key is not null")
    tenure, presidency = year_range(F.col("a.tenure")), year_range(F.col("a.role_length"))
    country = legal.canonical_country(normalize_text(F.col("a.country")))
    links = melt(found, F.col("case_iri"), edge("hasJudge", iri("judge", F.col("key"))))
    judge = mention(
        "judge", "Judge", F.col("key"), F.col("label"), None,
        literal("hasJudgeId", F.col("judge_id"), "integer"), literal("hasTenureBeginYear", tenure["start"], "gYear"), literal("hasTenureEndYear", tenure["end"], "gYear"),
        literal("isSectionPresident", F.when(normalize_text(F.col("a.role")) == "President", "true"), "boolean"), literal("hasPresidencyBeginYear", presidency["start"], "gYear"), literal("hasPresidencyEndYear", presidency["end"], "gYear"),
        edge("hasJudgeCountry", F.when(country.isNotNull(), iri("country", country))),
    )
    return links, found.select("ordinal", "pos", judge.alias("m")), found.select("ordinal", "pos", mention("country", "Country", country, country, "en").alias("m"))


def _rows(r: DataFrame, items: Column) -> DataFrame:
    return r.select("ordinal", "case_iri", F.posexplode(items).alias("pos", "x"))


def citation_triples(r: DataFrame) -> DataFrame:
    """citesCase edges: a case cites an application that another case has."""
    node = iri("application", F.col("x"))
    a = _rows(r, F.array_distinct("cited_appno")).select(F.col("case_iri").alias("citing"), node.alias("application")).distinct()
    b = _rows(r, F.array_distinct("case_appno")).select(F.col("case_iri").alias("cited"), node.alias("application")).distinct()
    pairs = a.join(b, "application").filter("citing <> cited").select("citing", "cited").distinct()
    return melt(pairs, F.col("citing"), edge("citesCase", F.col("cited")))


def build(cases: DataFrame, judges: DataFrame | None = None, country_ids: DataFrame | None = None) -> DataFrame:
    """All triples of the cases."""
    r = case_records(cases)
    links, judge, their_countries = judge_parts(r, judges)
    nodes = entities(mentioned(r).unionAll(judge).unionAll(their_countries))
    parts = [case_triples(r), links, nodes, finding_triples(r), citation_triples(r)]
    if country_ids is not None:
        parts.append(country_links(nodes, country_ids))
    return union(*parts)


def audit(triples: DataFrame) -> DataFrame:
    """For each subject and predicate the distinct values, sorted."""
    return triples.groupBy("s", "p").agg(F.array_sort(F.collect_set("o")).alias("values"))


# ---- rewriting and checking


def rename_subject(triples: DataFrame, old: str, new: str) -> DataFrame:
    """The triples with one IRI in place of another, as subject and object."""
    return triples.withColumn("s", F.when(F.col("s") == old, new).otherwise(F.col("s"))).withColumn("o", F.when((F.col("o") == old) & (F.col("o_kind") == "iri"), new).otherwise(F.col("o"))).dropDuplicates(COLUMNS)


def undeclared(triples: DataFrame, vocabulary: DataFrame, namespace: str = SCHEMA) -> DataFrame:
    """(term, role, n): predicates and classes of the namespace that the vocabulary (column term) doesn't declare."""
    predicates = triples.select(F.col("p").alias("term"), F.lit("predicate").alias("role"))
    classes = triples.filter(F.col("p") == TYPE).select(F.col("o").alias("term"), F.lit("class").alias("role"))
    used = predicates.union(classes).filter(F.col("term").startswith(namespace)).groupBy("term", "role").agg(F.count(F.lit(1)).alias("n"))
    return used.join(vocabulary.select("term"), "term", "left_anti")


def declared_only(triples: DataFrame, vocabulary: DataFrame, namespace: str = SCHEMA) -> DataFrame:
    """The triples without those whose predicate or class the vocabulary doesn't declare."""
    gone = undeclared(triples, vocabulary, namespace)
    bad_p = gone.filter("role = 'predicate'").select(F.col("term").alias("p"))
    bad_o = gone.filter("role = 'class'").select(F.lit(TYPE).alias("p"), F.col("term").alias("o"))
    return triples.join(bad_p, "p", "left_anti").join(bad_o, ["p", "o"], "left_anti").select(COLUMNS)


def disjoint_violations(triples: DataFrame, a: str, b: str) -> DataFrame:
    """Subjects that have both of two disjoint classes."""
    typed = triples.filter((F.col("p") == TYPE) & F.col("o").isin(a, b))
    return typed.groupBy("s").agg(F.countDistinct("o").alias("n")).filter("n > 1").select("s")


def nontrivial(triples: DataFrame, meta: tuple[str, ...] = ()) -> DataFrame:
    """Without labels, comments, objects of the modelling layer and long bracketed names."""
    bracketed = F.col("o").startswith("[") & F.col("o").endswith("]") & (F.length("o") > 20)
    return triples.filter(~F.col("p").isin(LABEL, COMMENT) & ~F.col("o").isin(*meta, "") & ~bracketed)


def without_node(triples: DataFrame, node: str) -> DataFrame:
    return triples.filter((F.col("s") != node) & (F.col("o") != node))


# ---- statistics


def statistics(triples: DataFrame) -> DataFrame:
    """One row: triples, distinct subjects, predicates and objects, kinds of subjects and objects. A triple gives three rows, which are counted by value before and after one shuffle."""

    def row(role: str, value: str, rest: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), F.col(value).alias("value"), rest.alias("rest"))

    kind = F.struct("o_kind", F.coalesce("o_datatype", F.lit("")).alias("datatype"), F.coalesce("o_lang", F.lit("")).alias("lang"))
    parts = F.array(row("s", "s", F.lit(None).cast("struct<o_kind:string,datatype:string,lang:string>")), row("p", "p", F.lit(None).cast("struct<o_kind:string,datatype:string,lang:string>")), row("o", "o", kind))
    met = triples.select(F.explode(parts).alias("x")).groupBy("x.role", "x.value", "x.rest").agg(F.count(F.lit(1)).alias("n"))
    role, blank = F.col("role"), F.col("value").startswith("_:")
    return met.agg(
        F.coalesce(F.sum(F.when(role == "s", F.col("n"))), F.lit(0)).cast("long").alias("triples"),
        F.count_if(role == "s").alias("subjects"),
        F.count_if(role == "p").alias("predicates"),
        F.count_if(role == "o").alias("objects"),
        F.count_if((role == "s") & ~blank).alias("iri_subjects"),
        F.count_if((role == "s") & blank).alias("blank_subjects"),
        F.count_if((role == "o") & (F.col("rest.o_kind") == "literal")).alias("literal_objects"),
    )


def class_counts(triples: DataFrame) -> DataFrame:
    return triples.filter(F.col("p") == TYPE).groupBy(F.col("o").alias("class")).agg(F.countDistinct("s").alias("n"))


def predicate_counts(triples: DataFrame) -> DataFrame:
    return triples.groupBy("p").agg(F.count(F.lit(1)).alias("n"))


def out_degrees(triples: DataFrame) -> DataFrame:
    return triples.groupBy("s").agg(F.count(F.lit(1)).alias("n"))


def edges(triples: DataFrame) -> DataFrame:
    """(src, dst, label) of the edges between nodes."""
    return triples.filter("o_kind = 'iri'").select(F.col("s").alias("src"), F.col("o").alias("dst"), F.col("p").alias("label"))


def edge_labels(e: DataFrame) -> DataFrame:
    """Each pair of nodes once, its labels sorted and joined by line feeds."""
    return e.groupBy("src", "dst").agg(F.array_join(F.array_sort(F.collect_set("label")), "\n").alias("labels"))


def domain_range_edges(vocabulary: DataFrame) -> DataFrame:
    """(src, dst, label) from vocabulary triples: each property from its domains to its ranges, and subclass edges."""
    rdfs = "http://www.w3.org/2000/01/rdf-schema#"
    pick = lambda p, a, b: vocabulary.filter(F.col("p") == rdfs + p).select(F.col("s").alias(a), F.col("o").alias(b))
    spans = pick("domain", "label", "src").join(pick("range", "label", "dst"), "label").select("src", "dst", "label")
    return spans.union(pick("subClassOf", "src", "dst").withColumn("label", F.lit("subClassOf")))


def top_nodes(e: DataFrame, n: int) -> DataFrame:
    """The n nodes of the highest degree (in and out), ties by name."""
    ends = e.select(F.col("src").alias("node")).unionAll(e.select(F.col("dst").alias("node")))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "node").limit(n)


def induced(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends among the nodes."""
    return e.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst", "label")


def neighbourhood(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges from the nodes, and edges to them from others."""
    src, dst = nodes.select(F.col("node").alias("src")), nodes.select(F.col("node").alias("dst"))
    return e.join(src, "src", "left_semi").select("src", "dst", "label").unionAll(e.join(dst, "dst", "left_semi").join(src, "src", "left_anti").select("src", "dst", "label"))


def graph_counts(quads: DataFrame) -> DataFrame:
    """Triples by named graph."""
    return quads.groupBy("g").agg(F.count(F.lit(1)).alias("n"))


def in_order(triples: DataFrame) -> DataFrame:
    """Triples by object, then subject, then predicate."""
    return triples.orderBy("o", "s", "p", "o_kind", "o_datatype", "o_lang")
