"""Named sections of a document, by its header lines.

A state begins as introduction; a header line sets it by the first rule that its words satisfy, or leaves it as it is.
The lines of a state belong to its section, headers between blank lines; lines after a list of questions belong to
none until the next header. All of it happens inside one row, by array functions: no shuffle, whatever a text's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.legal import any_of
from docketry.functions.text import strip

SECTIONS = ("introduction", "procedure", "facts", "legal_framework", "law", "reasons", "appendix")

# The header forms, in English and French, and the words that name a header's section, in order of precedence.
HEADER = (
    r"(?iuU)^(?:#+\s*)?(?:[A-Z0-9IVX]+\.\s*)?"
    r"(PROC[EÉ]DURE|"
    r"FACTS\s+AND\s+PROC[EÉ]DURE(?:\s+.*)?|"
    r"AS\s+TO\s+THE\s+FACTS(?:\s+.*)?|"
    r"(?:THE\s+)?FACTS(?:\s*\[\d+\])?(?:\s+.*)?|EN\s+FAIT(?:\s*\[\d+\])?(?:\s+.*)?|LES\s+FAITS(?:\s*\[\d+\])?(?:\s+.*)?|"
    r"(?:THE\s+)?PARTICULAR\s+CIRCUMSTANCES\s+OF\s+THE\s+CASES?(?:\s+.*)?|"
    r"THE\s+CIRCUMSTANCES\s+OF\s+THE\s+CASES?(?:\s+.*)?|CIRCONSTANCES\s+DE\s+L'AFFAIRE(?:\s+.*)?|"
    r"THE\s+LAW|EN\s+DROIT|"
    r"FOR\s+THESE\s+REAS\s*O\s*NS.*|PAR\s+CES\s+MOTIFS.*|F\s*O\s*R\s+T\s*H\s*E\s*S\s*E\s+R\s*E\s*A\s*S\s*O\s*N\s*S.*|"
    r"NOW\s+THEREFORE\s+THE\s+COMMISSION(?:\s+.*)?|"
    r"(?:D[ÉE]CIDES?|DECLARES?)\s+(?:TO\s+)?(?:STRIKE|ADJOURN|HOLD|REJECT).*|"
    r"(?:UPDATED\s+)?SUBJECT\s+MATTER\s+OF\s+THE\s+CASES?|OBJET\s+DE\s+L'AFFAIRE|"
    r"STATEMEN[TR]\s+OF\s+FACTS|EXPOS[EÉ]\s+DES\s+FAITS|"
    r"RELEVANT\s+(?:DOMESTIC|INTERNATIONAL|LEGAL)\s+(?:LAW|FRAMEWORK|MATERIAL).*|"
    r"(?:LE\s+)?DROIT\s+(?:ET\s+LA\s+PRATIQUE\s+)?(?:INTERNES?|INTERNATIONAL|PERTINENTS?).*|CADRE\s+JURIDIQUE.*|"
    r"QUESTIONS?\s+(?:TO\s+THE|AUX)\s+PARTIES.*|"
    r"APPENDIX|ANNEXE)\s*$"
)
RULES = (
    ("facts", ("FACTSANDPROC",)),
    ("procedure", ("PROC",)),
    ("facts", ("FACTS", "SUBJECTMATTER", "CIRCUMSTANCES", "STATEMEN", "FAIT", "OBJETDE", "CIRCONSTANCES", "EXPOS")),
    ("legal_framework", ("RELEVANT", "PERTINENT", "CADRE", "DROITINTERNE", "DROITINTERNATIONAL")),
    ("law", ("LAW", "ENDROIT")),
    ("reasons", ("REASONS", "MOTIFS", "NOWTHEREFORETHECOMMISSION", "DECIDES", "DECLARES")),
    ("appendix", ("APPENDIX", "ANNEXE")),
    ("skip", ("QUESTION",)),
)
_SAME = "same"


def header_state(line: Column, decision: bool = False) -> Column:
    """The state that a stripped line sets, `same` for a header that leaves it, null for other lines."""
    words = F.regexp_replace(F.upper(F.regexp_extract(line, HEADER, 1)), r"(?U)\s+", "")
    state = F
    for section, marks in RULES:
        state = state.when(any_of(words, marks), "facts" if decision and section == "procedure" else section)
    return F.when(line.rlike(HEADER), state.otherwise(_SAME))


def with_sections(df: DataFrame, text: str = "full_text", decision: bool = False) -> DataFrame:
    """df with a column for each section."""
    lines = df.withColumn("_lines", F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), strip))
    marked = lines.withColumn("_marks", F.transform("_lines", lambda x: header_state(x, decision)))
    # places of headers, from 1; the state after each, carried over headers that leave it
    heads = marked.withColumn("_heads", F.filter(F.sequence(F.lit(1), F.size("_lines")), lambda i: F.get("_marks", i - 1).isNotNull()))
    carried = F.aggregate(
        "_heads",
        F.array(F.lit("introduction")),
        lambda states, i: F.concat(states, F.array(F.when(F.get("_marks", i - 1) == _SAME, F.element_at(states, -1)).otherwise(F.get("_marks", i - 1)))),
    )
    states = heads.withColumn("_states", carried).withColumn("_starts", F.concat(F.array(F.lit(0)), "_heads"))

    def part(start: Column, k: Column) -> Column:
        after = F.coalesce(F.get("_starts", k + 1), F.size("_lines") + 1)
        head = F.when(start > 0, F.concat(F.lit("\n\n"), F.get("_lines", start - 1), F.lit("\n\n"))).otherwise("")
        body = F.transform(F.slice("_lines", start + 1, after - start - 1), lambda x: F.concat(x, F.lit("\n")))
        return F.struct(F.get("_states", k).alias("state"), F.concat(head, F.array_join(body, "")).alias("text"))

    parts = states.withColumn("_parts", F.transform("_starts", part))
    for s in SECTIONS:
        mine = F.filter("_parts", _in(s))
        parts = parts.withColumn(s, strip(F.array_join(F.transform(mine, lambda p: p["text"]), "")))
    return parts.drop("_lines", "_marks", "_heads", "_states", "_starts", "_parts")


def _in(section: str):
    return lambda p: p["state"] == section


def sections_from_json(raw: Column) -> Column:
    """Sections as label-text entries from JSON text that is an object of label to text, or a list of objects with label, section or title and text or content; entries of one label are joined by a blank line."""
    from docketry.functions.text import section_label

    pairs = F.map_entries(F.from_json(raw, "map<string,string>"))
    listed = F.transform(
        F.from_json(raw, "array<struct<label:string,section:string,title:string,text:string,content:string>>"),
        lambda x: F.struct(F.coalesce(F.nullif(x["label"], F.lit("")), F.nullif(x["section"], F.lit("")), F.nullif(x["title"], F.lit(""))).alias("key"), F.coalesce(F.nullif(x["text"], F.lit("")), x["content"]).alias("value")),
    )
    entries = F.when(strip(raw).startswith("["), listed).otherwise(F.transform(pairs, lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value"))))
    named = F.filter(F.transform(entries, lambda x: F.struct(section_label(x["key"]).alias("key"), x["value"].alias("value"))), lambda x: (x["key"] != "") & (strip(x["value"]) != ""))
    labels = F.array_distinct(F.transform(named, lambda x: x["key"]))
    return F.transform(labels, lambda k: F.struct(k.alias("label"), F.array_join(F.transform(F.filter(named, lambda x: x["key"] == k), lambda x: strip(x["value"])), "\n\n").alias("text")))
