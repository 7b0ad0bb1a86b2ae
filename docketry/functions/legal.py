"""Rules on court metadata: article codes, limbs, chambers, opinions, document types, countries."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.functions.text import col, normalize_text, ordered_unique, squeeze, strip

# Codes of originating bodies and of document types, as the register publishes them.
BODY_CODES = {
    "1": "Commission (First Chamber)",
    "2": "Commission (Second Chamber)",
    "3": "Commission (Plenary)",
    "4": "Court (First Section)",
    "5": "Court (Second Section)",
    "6": "Court (Third Section)",
    "7": "Court (Fourth Section)",
    "8": "Court (Grand Chamber)",
    "9": "Court (Chamber)",
    "15": "Court (Plenary)",
    "16": "Court (Screening Panel",
    "17": "Committee of Ministers",
    "21": "Commission",
    "23": "Court (Fifth Section)",
    "25": "Court (First Section Committee)",
    "26": "Court (Second Section Committee)",
    "27": "Court (Third Section Committee)",
    "28": "Court (Fourth Section Committee)",
    "29": "Court (Fifth Section Committee)",
}
TYPE_CODES = {
    "8": "Decision",
    "9": "Decision (Partial)",
    "10": "Decision (Final)",
    "11": "Judgment (Interpretation)",
    "12": "Judgment (Just Satisfaction)",
    "13": "Judgment (Lack of Jurisdiction)",
    "14": "Judgment (Merits)",
    "15": "Judgment (Merits and Just Satisfaction)",
    "16": "Judgment (Preliminary Objection)",
    "17": "Judgment (Questions of Procedure)",
    "18": "Judgment (Revision)",
    "19": "Judgment (Struck out of the List)",
    "20": "Decision (P9)",
    "21": "Revision",
    "22": "Restoration",
    "26": "Judgment (Article 46 § 4)",
}

# Words that tell the limbs of Article 6 apart.
CRIMINAL = ("criminal charge", "criminal proceedings", "penal", "extradition", "expulsion", "deportation", "criminal offence")
CONSTITUTIONAL = ("constitutional proceedings", "constitutional court")
CIVIL = ("civil rights and obligations", "civil proceedings", "administrative proceedings", "disciplinary proceedings", "enforcement proceedings", "labour dispute", "employment dispute", "social security")

# Vocabulary terms by lower-cased value.
LIMB_TERMS = {"civil": "Limb_Civil", "criminal": "Limb_Criminal", "mixed": "Limb_Mixed", "constitutional": "Limb_Constitutional", "unspecified": "Limb_Unspecified"}
IMPORTANCE_TERMS = {"1": "Importance_1", "2": "Importance_2", "3": "Importance_3", "4": "Importance_4"}
LAW_SYSTEM_TERMS = {"civil": "LawSystem_Civil", "common": "LawSystem_Common", "mixed": "LawSystem_Mixed"}
CHAMBER_LEVELS = {"grandchamber": "GrandChamber", "decgrandchamber": "GrandChamber", "deccommission": "Commission", "committee": "Committee", "admissibilitycom": "Committee", "chamber": "Chamber", "admissibility": "Chamber"}

# The member states by ISO 3166 alpha-3 code, and other names in use for some of them.
COUNTRIES = {
    "ALB": "Albania", "AND": "Andorra", "ARM": "Armenia", "AUT": "Austria", "AZE": "Azerbaijan", "BEL": "Belgium", "BIH": "Bosnia and Herzegovina", "BGR": "Bulgaria", "HRV": "Croatia", "CYP": "Cyprus", "CZE": "Czechia", "DNK": "Denmark", "EST": "Estonia", "FIN": "Finland", "FRA": "France", "GEO": "Georgia", "DEU": "Germany", "GRC": "Greece", "HUN": "Hungary", "ISL": "Iceland", "IRL": "Ireland", "ITA": "Italy", "LVA": "Latvia", "LIE": "Liechtenstein", "LTU": "Lithuania", "LUX": "Luxembourg", "MLT": "Malta", "MDA": "Moldova, Republic of", "MCO": "Monaco", "MNE": "Montenegro", "NLD": "Netherlands", "MKD": "North Macedonia", "NOR": "Norway", "POL": "Poland", "PRT": "Portugal", "ROU": "Romania", "RUS": "Russian Federation", "SMR": "San Marino", "SRB": "Serbia", "SVK": "Slovakia", "SVN": "Slovenia", "ESP": "Spain", "SWE": "Sweden", "CHE": "Switzerland", "TUR": "Türkiye", "UKR": "Ukraine", "GBR": "United Kingdom",
}
COUNTRY_ALIASES = {
    "turkey": "TUR", "republic of turkey": "TUR", "turkiye": "TUR", "turkiye republic": "TUR", "türkiye": "TUR", "türkiye cumhuriyeti": "TUR", "russia": "RUS", "russian federation": "RUS", "moldova": "MDA", "czech republic": "CZE", "north macedonia": "MKD", "bosnia and herzegovina": "BIH", "united kingdom": "GBR",
}

_CODE = r"P?\d+(?:-\d+)*(?:-[A-Za-z])?(?:\+P?\d+(?:-\d+)*(?:-[A-Za-z])?)*"


def mapping(values: dict[str, str]) -> Column:
    """A small fixed dictionary as a map literal, parsed from one SQL text (a call for each entry would take longer than the query)."""

    def quoted(x: str) -> str:
        return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"

    return F.expr("map(" + ", ".join(quoted(x) for x in chain.from_iterable(values.items())) + ")")


def any_of(c: Column, words: tuple[str, ...]) -> Column:
    found = c.contains(words[0])
    for w in words[1:]:
        found = found | c.contains(w)
    return found


def limb(labels: Column | str) -> Column:
    """Criminal, Civil, Constitutional, Mixed or Unspecified, by the words in a list of keyword labels."""
    text = strip(squeeze(F.lower(F.array_join(F.filter(col(labels), lambda x: strip(x) != ""), " "))))
    criminal, constitutional, civil = (any_of(text, w) for w in (CRIMINAL, CONSTITUTIONAL, CIVIL))
    return F.when(criminal & (civil | constitutional), "Mixed").when(criminal, "Criminal").when(constitutional, "Constitutional").when(civil, "Civil").otherwise("Unspecified")


def collapse(values: Column | str, many: str = "Mixed") -> Column:
    """A set's only value; `many` if it has more, null if none. Nulls in it don't count."""
    found = F.array_distinct(F.filter(col(values), lambda x: x.isNotNull()))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0))).when(F.size(found) > 1, many)


def law_system(countries: Column | str, systems: Column) -> Column:
    """The law system of all of a list's countries, by a map column of systems; countries it lacks don't count."""
    return collapse(F.transform(col(countries), lambda x: F.try_element_at(systems, x)))


def article_code(c: Column | str) -> Column:
    """A code with its protocol letter upper-case."""
    c = strip(c)
    return F.when(c.rlike(r"^p\d"), F.concat(F.lit("P"), F.substring(c, 2, 1_000_000))).otherwise(c)


def expand_articles(codes: Column | str) -> Column:
    """Single article codes of a list of codes joined by plus signs, distinct in order."""
    parts = F.flatten(F.transform(col(codes), lambda x: F.split(x, r"\+")))
    return ordered_unique(F.transform(F.filter(parts, lambda x: strip(x) != ""), article_code))


def article_references(texts: Column | str) -> Column:
    """Article codes in a list of texts: a text that is a code, or any code in one that speaks of articles."""

    def found(x: Column) -> Column:
        text = normalize_text(x)
        codes = F.when(text.rlike(f"^{_CODE}$"), F.array(text)).when(text.rlike(r"(?iu)\bart(?:icle)?\b"), F.regexp_extract_all(text, F.lit(_CODE), 0))
        return F.coalesce(codes, F.array().cast("array<string>"))

    return expand_articles(F.flatten(F.transform(col(texts), found)))


def document_kind(doctype: Column | str) -> Column:
    """judgments, decisions or other; a type that names both is a judgment, null is other."""
    c = col(doctype)
    return F.when(c.rlike("(?i)JUD"), "judgments").when(c.rlike("(?i)DEC"), "decisions").otherwise("other")


def case_class(judgment_type: Column | str, source: Column | str) -> Column:
    text = F.lower(F.concat_ws(" ", normalize_text(judgment_type), normalize_text(source)))
    return F.when(text.contains("decision"), "Decision").otherwise("Judgment")


def chamber_type(body: Column | str, level: Column | str, by_level: bool = True) -> Column:
    """The kind of chamber: by its level's code where that is known (by_level), else by the words of body and level."""
    text = F.lower(F.concat_ws(" ", normalize_text(body), normalize_text(level)))
    words = F.when(text.contains("grand chamber"), "GrandChamber").when(text.contains("commission"), "Commission").when(text.contains("committee"), "Committee").when(text.contains("section") | text.contains("chamber"), "Chamber")
    if not by_level:
        return words
    key = F.regexp_replace(F.lower(strip(level)), r"(?U)[^\p{Alnum}]+", "")
    return F.coalesce(F.try_element_at(mapping(CHAMBER_LEVELS), key), words)


def separate_opinion(c: Column | str) -> Column:
    text = F.lower(F.coalesce(normalize_text(c), F.lit("")))
    return F.when(text.isin("", "0", "false", "no", "none", "absent"), "SeparateOpinion_Absent").otherwise("SeparateOpinion_Present")


def term(c: Column | str, terms: dict[str, str]) -> Column:
    """The vocabulary term of a value, null for values without one."""
    return F.try_element_at(mapping(terms), F.lower(normalize_text(c)))


def country_names(codes: Column | str) -> Column:
    """Names for a list of alpha-3 codes; an unknown code stays."""
    names = mapping(COUNTRIES)
    return F.transform(col(codes), lambda x: F.coalesce(F.try_element_at(names, x), x))


def first_country(names: Column | str) -> Column:
    return F.get(F.filter(F.transform(col(names), strip), lambda x: x.isNotNull() & (x != "")), F.lit(0))


def respondent_code(codes: Column | str) -> Column:
    """The first item of a list that is three letters."""
    return F.get(F.filter(F.transform(col(codes), lambda x: F.upper(strip(x))), lambda x: x.rlike("^[A-Z]{3}$")), F.lit(0))


def iso3(name: Column | str, code: Column | str | None = None) -> Column:
    """The alpha-3 code by a country's name, another name of it or a code; else a three-letter respondent code as it is."""
    key = F.lower(strip(name))
    by_name = mapping({v.lower(): k for k, v in COUNTRIES.items()} | {k.lower(): k for k in COUNTRIES})
    found = F.coalesce(F.try_element_at(mapping(COUNTRY_ALIASES), key), F.try_element_at(by_name, key))
    if code is None:
        return found
    plain = F.upper(strip(code))
    return F.coalesce(found, F.when(F.length(plain) == 3, plain))


def canonical_country(name: Column | str) -> Column:
    """The country's name in COUNTRIES, by any of its names or codes; other names stay."""
    return F.coalesce(F.try_element_at(mapping(COUNTRIES), iso3(name)), strip(name))
