"""Text and list columns. White space is Unicode's throughout, as (?U) gives it; plain trim() only takes spaces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK_WORDS = ("nan", "none", "null")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def squeeze(c: Column | str) -> Column:
    """Runs of white space as one space."""
    return F.regexp_replace(col(c), r"(?U)\s+", " ")


def null_if(c: Column, *values: str) -> Column:
    return F.when(~c.isin(*values), c)


def first_group(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the pattern's first match, null if there is none or it is empty."""
    return null_if(F.regexp_extract(c, pattern, group), "")


def clean_appnos(c: Column | str) -> Column:
    """Application numbers apart from what stands between them: digits and slashes, joined by semicolons."""
    kept = F.regexp_replace(col(c), r"[^0-9/;]+", ";")
    return F.regexp_replace(F.regexp_replace(kept, ";+", ";"), "^;|;$", "")


def parse_list(c: Column | str) -> Column:
    """A semicolon list: stripped items without blanks; null, nan, none and [] give an empty list."""
    c = col(c)
    items = F.filter(F.transform(F.split(c, ";+"), strip), lambda x: x != "")
    return F.when(c.isNull() | F.lower(strip(c)).isin("", "[]", *BLANK_WORDS), F.array().cast("array<string>")).otherwise(items)


def strip_list(c: Column | str) -> Column:
    """A list's items stripped, without blanks; null is empty."""
    items = F.filter(F.transform(col(c), strip), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(items, F.array().cast("array<string>"))


def normalize_text(c: Column | str) -> Column:
    """Stripped text; null for blank and for nan, none, null in any case."""
    return null_if_blank(strip(c))


def null_if_blank(c: Column) -> Column:
    return F.when(~F.lower(c).isin("", *BLANK_WORDS), c)


def normalize_list(c: Column | str) -> Column:
    """A list from text: the quoted items of a bracketed literal, else the parts between semicolons or bars."""
    text = normalize_text(c)
    literal = F.transform(F.regexp_extract_all(text, F.lit(r"'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\""), 0), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))
    parts = F.when(text.rlike(r"(?s)^\[.*\]$"), literal).otherwise(F.split(text, "[;|]+"))
    items = F.filter(F.transform(parts, normalize_text), lambda x: x.isNotNull())
    return F.coalesce(items, F.array().cast("array<string>"))


def ensure_list(c: Column | str) -> Column:
    """Null as the empty list."""
    return F.coalesce(col(c), F.array().cast("array<string>"))


def list_difference(a: Column | str, b: Column | str) -> Column:
    """The items of a that aren't in b, in order and with repetitions."""
    b = col(b)
    return F.filter(col(a), lambda x: ~F.array_contains(b, x))


def ordered_unique(*lists: Column | str) -> Column:
    """Distinct items of the lists in order of first occurrence."""
    return F.array_distinct(F.concat(*[col(x) for x in lists]))


def appellant(c: Column | str) -> Column:
    """The applicant's name out of a case name in English or French."""
    name = F.regexp_replace(col(c), r"(?iU)^(CASE OF|AFFAIRE)\s+", "")
    # anchored at line begins: what matches further on in a line matches from its begin too
    english = F.regexp_extract(name, r"(?imU)^([^\n]+?)(?:\s*\(v\.\s*| v\.)", 1)
    french = F.regexp_extract(name, r"(?imU)^([^\n]+?)\s+c\.", 1)
    found = F.when(english != "", english).when(french != "", french).otherwise(name)
    return F.when(name != "", strip(found))


def slug(c: Column | str) -> Column:
    """Runs of other than ASCII letters and digits as underscores, lower-cased; unknown if nothing is left."""
    made = F.lower(F.regexp_replace(F.regexp_replace(strip(c), "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))
    return F.when(F.coalesce(made, F.lit("")) == "", "unknown").otherwise(made)


def section_label(c: Column | str) -> Column:
    """A section's label as a column name, without a leading article."""
    text = F.regexp_replace(F.lower(strip(c)), r"(?U)^the\s+", "")
    return F.regexp_replace(F.regexp_replace(text, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def normalize_name(c: Column | str) -> Column:
    return squeeze(F.lower(strip(c)))


def blank_to_empty(c: Column | str) -> Column:
    return F.coalesce(strip(c), F.lit(""))


def safe_filename(c: Column | str) -> Column:
    return F.regexp_replace(col(c), "[^A-Za-z0-9_.-]+", "_")


def truncate(c: Column | str, limit: int) -> Column:
    """The first characters, and how many were cut off."""
    c = col(c)
    cut = F.concat(F.left(c, F.lit(limit)), F.lit("... ["), (F.length(c) - limit).cast("string"), F.lit(" more chars]"))
    return F.when(F.length(c) > limit, cut).otherwise(c)


def turtle_escape(c: Column | str) -> Column:
    """A literal's text for Turtle: backslash and quote escaped, line feeds as spaces, carriage returns dropped."""
    c = F.replace(F.replace(col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.replace(F.replace(c, F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(""))


def humanize(c: Column | str) -> Column:
    """An IRI's local name with spaces between its words."""
    local = F.substring_index(F.substring_index(col(c), "#", -1), "/", -1)
    return F.regexp_replace(F.regexp_replace(local, "([a-z0-9])([A-Z])", "$1 $2"), "_", " ")


def is_valid(c: Column | str) -> Column:
    """Whether a value says something: not null, none of the blank words (these in lower case only), not n/a."""
    text = strip(col(c).cast("string"))
    return col(c).isNotNull() & ~text.isin("", "null", "none", "nan", "[]") & ~F.lower(text).isin("n/a", "na")


def is_missing(c: Column | str, numeric: bool = False) -> Column:
    c = col(c)
    return c.isNull() | F.isnan(c) if numeric else c.isNull()


def paragraphs(c: Column | str) -> Column:
    """The text's parts between blank lines, stripped, without empty ones."""
    return F.filter(F.transform(F.split(col(c), "\n\n"), strip), lambda x: x != "")


def strip_json_comments(c: Column | str) -> Column:
    """JSON text without // and /* */ comments; what stands inside a string stays."""
    return F.regexp_replace(col(c), r'("[^"\\]*+(?:\\.[^"\\]*+)*+")|//[^\n]*+|/\*(?s:.*?)\*/', "$1")
