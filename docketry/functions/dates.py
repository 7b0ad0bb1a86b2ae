"""Dates, years and periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.functions.text import col, first_group, normalize_text


def day_first(c: Column | str) -> Column:
    """A timestamp from day-first text; text of another form raises."""
    return F.to_timestamp(col(c), "dd/MM/yyyy HH:mm:ss")


def optional_date(c: Column | str) -> Column:
    """An ISO date before any T; null for all else."""
    text = F.substring_index(normalize_text(c), "T", 1)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))).cast("date")


def case_year(date: Column | str, ecli: Column | str) -> Column:
    """The year that a date's text begins with, else the year within the ECLI."""
    return F.coalesce(F.substring(col(date), 1, 4).try_cast("int"), first_group(col(ecli), r":(\d{4}):").try_cast("int"))


def year_range(c: Column | str, single_ends: bool = False) -> Column:
    """start and end of a tenure such as 2008-2019, 2019- or -2008; single_ends: a lone year ends where it starts."""
    text = F.coalesce(normalize_text(c), F.lit(""))
    whole = r"^(\d{4})?(?:(-)(\d{4})?)?$"
    start = first_group(text, whole, 1).cast("int")
    end = first_group(text, whole, 3).cast("int")
    if single_ends:
        end = F.when(F.regexp_extract(text, whole, 2) == "", start).otherwise(end)
    return F.struct(start.alias("start"), end.alias("end"))


def period(year: Column | str) -> Column:
    """Five years from 1965 on; all before in one, 2020 and later in one."""
    y = col(year)
    start = F.lit(1965) + F.floor((y - 1965) / 5).cast("int") * 5
    return F.when(y <= 1964, "1959-1964").when(y >= 2020, "2020-2025").when(y.isNotNull(), F.concat_ws("-", start.cast("string"), (start + 4).cast("string")))
