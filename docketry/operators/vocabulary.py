"""The vocabulary of the case graph as tables: classes, properties, individuals; and as triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators.graph import LABEL, SCHEMA, TYPE, WIKIDATA, XSD

RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
DCTERMS = "http://purl.org/dc/terms/"
FOAF = "http://xmlns.com/foaf/0.1/"

# Classes with their superclass, and the terms of public vocabularies they are aligned to.
CLASSES = {
    "Application": ("", "Q56759633"), "Article6Limb": ("", ""), "CaseDocument": ("", "Q2334719"), "Decision": ("CaseDocument", "Q327000"), "Judgment": ("CaseDocument", "Q3769186"), "Law": ("", "Q7748"), "LegalRepresentative": ("", "Q40348"), "DomesticLaw": ("Law", "Q1668641"), "InternationalLaw": ("Law", "Q4394526"), "ImportanceLevel": ("", ""), "ConventionArticle": ("", "Q712597"), "Country": ("", "Q3624078"), "CourtFormation": ("", ""), "ChamberType": ("", "Q357147"), "Judge": ("", "Q16533"), "Party": ("", "Q12648988"), "Gender": ("", "Q48277"), "JudgmentType": ("", ""), "LegalFinding": ("", ""), "Violation": ("LegalFinding", ""), "NonViolation": ("LegalFinding", ""), "LawSystem": ("", ""), "SeparateOpinionIndicator": ("", ""), "OperativeProvision": ("", ""), "LegalStatus": ("", ""), "VulnerabilityStatus": ("", ""), "EconomicStatus": ("", ""), "Keyword": ("", ""),
}
# Datatype properties (domain, type) and object properties (domain, range).
DATATYPE_PROPERTIES = {
    "hasApplicationNumber": ("Application", "string"), "hasTenureBeginYear": ("Judge", "gYear"), "hasTenureEndYear": ("Judge", "gYear"), "isSectionPresident": ("Judge", "boolean"), "hasPresidencyBeginYear": ("Judge", "gYear"), "hasPresidencyEndYear": ("Judge", "gYear"), "hasJudgeId": ("Judge", "integer"), "hasRepresentativeName": ("LegalRepresentative", "string"), "hasApplicantName": ("CaseDocument", "string"), "hasCaseName": ("CaseDocument", "string"), "hasCaseTextPath": ("CaseDocument", "string"), "hasEcli": ("CaseDocument", "string"), "hasItemId": ("CaseDocument", "string"), "hasJudgmentDate": ("CaseDocument", "date"), "hasKeywordCode": ("Keyword", "string"), "hasLanguageCode": ("CaseDocument", "string"), "hasYear": ("CaseDocument", "gYear"), "hasViolationGrounds": ("OperativeProvision", "string"), "hasConclusionText": ("CaseDocument", "string"), "hasConclusionReference": ("CaseDocument", "string"),
}
OBJECT_PROPERTIES = {
    "hasArticle6Limb": ("CaseDocument", "Article6Limb"), "hasImportanceLevel": ("CaseDocument", "ImportanceLevel"), "hasRespondentState": ("CaseDocument", "Country"), "concernsArticle": ("CaseDocument", "ConventionArticle"), "hasNationality": ("Party", "Country"), "hasCourtFormation": ("CaseDocument", "CourtFormation"), "hasChamberType": ("CaseDocument", "ChamberType"), "hasGender": ("Party", "Gender"), "hasLegalRepresentative": ("CaseDocument", "LegalRepresentative"), "hasFinding": ("CaseDocument", "LegalFinding"), "findingRefersToArticle": ("LegalFinding", "ConventionArticle"), "hasSeparateOpinion": ("CaseDocument", "SeparateOpinionIndicator"), "hasOperativeProvision": ("CaseDocument", "OperativeProvision"), "provisionRefersToArticle": ("OperativeProvision", "ConventionArticle"), "hasLawSystem": ("CaseDocument", "LawSystem"), "citesApplication": ("CaseDocument", "Application"), "citesCase": ("CaseDocument", "CaseDocument"), "hasApplication": ("CaseDocument", "Application"), "hasJudgmentType": ("CaseDocument", "JudgmentType"), "hasJudge": ("CaseDocument", "Judge"), "referencesSecondaryApplication": ("CaseDocument", "Application"), "hasLegalStatus": ("Party", "LegalStatus"), "hasVulnerability": ("Party", "VulnerabilityStatus"), "citesLaw": ("CaseDocument", "Law"), "hasJudgeCountry": ("Judge", "Country"), "hasKeyword": ("CaseDocument", "Keyword"),
}
# Individuals by class, and the standard properties that some properties specialise.
INDIVIDUALS = {
    "Article6Limb": {"Limb_Civil": "Civil", "Limb_Criminal": "Criminal", "Limb_Mixed": "Mixed", "Limb_Constitutional": "Constitutional", "Limb_Unspecified": "Unspecified"},
    "ImportanceLevel": {"Importance_1": "Key Case", "Importance_2": "Important Case", "Importance_3": "Case Report", "Importance_4": "Case of Little Interest"},
    "LawSystem": {"LawSystem_Civil": "Civic code jurisdiction", "LawSystem_Common": "Common Law jurisdiction", "LawSystem_Mixed": "Mixed jurisdiction"},
    "SeparateOpinionIndicator": {"SeparateOpinion_Present": "Separate Opinion", "SeparateOpinion_Absent": "No Separate Opinion"},
    "ChamberType": {"GrandChamber": "Grand Chamber", "Chamber": "Chamber", "Committee": "Committee", "Commission": "Commission"},
    "Gender": {"Gender_Female": "Female", "Gender_Male": "Male", "Gender_NonBinary": "Non-binary", "Gender_Unknown": "Unknown", "Gender_NotStated": "Not stated"},
}
ALIGNED = {
    "hasCaseName": DCTERMS + "title", "hasJudgmentDate": DCTERMS + "date", "hasLanguageCode": DCTERMS + "language", "hasKeyword": DCTERMS + "subject", "hasCaseTextPath": DCTERMS + "source", "hasEcli": DCTERMS + "isVersionOf", "citesCase": DCTERMS + "references", "citesLaw": DCTERMS + "references", "hasJudgmentType": DCTERMS + "type", "hasApplicantName": FOAF + "name", "hasLegalRepresentative": DCTERMS + "contributor", "hasRepresentativeName": FOAF + "name",
}
DISJOINT = (("Violation", "NonViolation"),)


def triples(spark: SparkSession) -> DataFrame:
    """The vocabulary as triples, in the columns of the case graph."""
    rows: list[tuple] = []

    def add(s: str, p: str, o: str, kind: str = "iri", lang: str | None = None) -> None:
        rows.append((s, p, o, kind, None, lang))

    for name, (parent, aligned) in CLASSES.items():
        add(SCHEMA + name, TYPE, OWL + "Class")
        if parent:
            add(SCHEMA + name, RDFS + "subClassOf", SCHEMA + parent)
        if aligned:
            add(SCHEMA + name, RDFS + "subClassOf", WIKIDATA + aligned)
    for properties, kind, base in ((DATATYPE_PROPERTIES, "DatatypeProperty", XSD), (OBJECT_PROPERTIES, "ObjectProperty", SCHEMA)):
        for name, (domain, range_) in properties.items():
            add(SCHEMA + name, TYPE, OWL + kind)
            add(SCHEMA + name, RDFS + "domain", SCHEMA + domain)
            add(SCHEMA + name, RDFS + "range", base + range_)
    for cls, names in INDIVIDUALS.items():
        for name, label in names.items():
            add(SCHEMA + name, TYPE, SCHEMA + cls)
            add(SCHEMA + name, LABEL, label, "literal", "en")
    for name, standard in ALIGNED.items():
        add(SCHEMA + name, RDFS + "subPropertyOf", standard)
    for a, b in DISJOINT:
        add(SCHEMA + a, OWL + "disjointWith", SCHEMA + b)
    return spark.createDataFrame(rows, "s string, p string, o string, o_kind string, o_datatype string, o_lang string")


def terms(spark: SparkSession) -> DataFrame:
    """The declared classes, properties and individuals (column term)."""
    names = [*CLASSES, *DATATYPE_PROPERTIES, *OBJECT_PROPERTIES, *(n for x in INDIVIDUALS.values() for n in x)]
    return spark.createDataFrame([(SCHEMA + n,) for n in names], "term string")


def set_ranges(vocabulary: DataFrame, properties: list[str], datatype: str) -> DataFrame:
    """The vocabulary with another range for some properties."""
    own = [SCHEMA + p for p in properties]
    kept = vocabulary.filter(~((F.col("p") == RDFS + "range") & F.col("s").isin(own)))
    changed = vocabulary.sparkSession.createDataFrame([(s, RDFS + "range", XSD + datatype, "iri", None, None) for s in own], vocabulary.schema)
    return kept.unionByName(changed)


def out_of_domain(data: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Triples whose subject has a type, but neither the property's domain nor a subclass of it. Superclasses are one step away at most here."""
    above = vocabulary.filter(F.col("p") == RDFS + "subClassOf").select(F.col("s").alias("cls"), F.col("o").alias("super"))
    typed = data.filter(F.col("p") == TYPE).select("s", F.col("o").alias("cls"))
    every = typed.union(typed.join(above, "cls").select("s", F.col("super").alias("cls"))).distinct()
    domains = vocabulary.filter(F.col("p") == RDFS + "domain").select(F.col("s").alias("p"), F.col("o").alias("domain"))
    checked = data.join(domains, "p")
    good = checked.join(every.withColumnRenamed("cls", "domain"), ["s", "domain"], "left_semi")
    return checked.join(typed.select("s").distinct(), "s", "left_semi").join(good.select("s", "p", "o").distinct(), ["s", "p", "o"], "left_anti").select(data.columns)

