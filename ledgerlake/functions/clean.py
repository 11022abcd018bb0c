"""Cleaning of cells that are text: numbers, dates, labels. Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = ("NA", "N/A", "-", "--", "")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: Separators are spaces by then. What a text must look like for a format to fit: one that fails costs an exception a cell.
DATE_FORMATS = {"d MMM yyyy": r"^\S+ \S{3} \S{4,}$", "d MMMM yyyy": r"^\S+ \S{4,} \S{4,}$", "d MMM yy": r"^\S+ \S{3} \S{2}$", "d MMMM yy": r"^\S+ \S{4,} \S{2}$", "yyyy MM dd": r"^\S{4,} \S{2} \S{2}$", "d MM yyyy": r"^\S+ \S{2} \S{4,}$"}


def na_to_null(c: Column) -> Column:
    return F.when(F.upper(F.trim(c)).isin(*MISSING), None).otherwise(F.trim(c))


def to_double(c: Column) -> Column:
    """'1,234.50 Cr' to 1234.5, '12.5%' to 12.5; missing marks and what is no finite number to null."""
    plain = F.regexp_replace(F.regexp_replace(na_to_null(c), r"(?i)\s*cr\.?$", ""), "[%,]", "")
    x = F.trim(plain).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def to_int(c: Column) -> Column:
    """Cut toward zero."""
    return F.when(F.abs(to_double(c)) < 2**31, to_double(c)).cast("int")


def to_date(c: Column) -> Column:
    """The first of DATE_FORMATS that fits; null if none does. Years of two digits are those from 1969 to 2068."""
    plain = F.trim(F.regexp_replace(c, r"[-/\s]+", " "))

    def read(pattern: str) -> Column:
        day = F.when(plain.rlike(DATE_FORMATS[pattern]), F.try_to_date(plain, pattern))
        return day if "yyyy" in pattern else F.when(F.year(day) > 2068, F.add_months(day, -1200)).otherwise(day)

    return F.coalesce(*map(read, DATE_FORMATS))


def as_of(c: Column) -> Column:
    """The date after 'As on' in a text, in any spelling of day, month name and year that to_date takes. The text is searched once, not for each of the formats."""
    found = F.regexp_extract(c, r"(?i)as\s+on\s*[:-]?\s*(\d{1,2}[-/\s]+[A-Za-z]{3,9}[-/\s]+(?:\d{4}|\d{2}))\b", 1)
    return F.get(F.transform(F.array(found), lambda t: F.when(t != "", to_date(t))), F.lit(0))


def after_marker(c: Column, marker: str, most: int = 200) -> Column:
    """Up to `most` characters from the marker on (any case); null without it."""
    at = F.instr(F.lower(c), F.lit(marker.lower()))
    return F.when(at > 0, F.substr(c, at, F.lit(most)))


def age(c: Column) -> Column:
    """'2 Years 9 Months' to '2Y 9M'; anything else as it is."""
    y, m = F.regexp_extract(c, r"(?i)(\d+)\s*year", 1), F.regexp_extract(c, r"(?i)(\d+)\s*month", 1)
    short = F.concat_ws(" ", F.when(y != "", F.concat(y, F.lit("Y"))), F.when(m != "", F.concat(m, F.lit("M"))))
    return F.when(short != "", short).otherwise(c)


def month_key(c: Column) -> Column:
    """'March 2024' to '2024-03'; null for other texts."""
    name, year = F.lower(F.regexp_extract(c, r"^\s*([A-Za-z]{3,9})[\s-]*(\d{4})\s*$", 1)), F.regexp_extract(c, r"^\s*([A-Za-z]{3,9})[\s-]*(\d{4})\s*$", 2)
    at = F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(name, 1, 3))
    return F.when((year != "") & (at > 0), F.concat_ws("-", year, F.lpad(at.cast("string"), 2, "0")))


def period_label(c: Column) -> Column:
    """FYTD, 'FY nn', YTD, 'CY nn' from their spellings; null for others."""
    flat = F.upper(F.regexp_replace(F.trim(c), r"[\s'-]+", ""))
    return (
        F.when(flat == "FYTD", F.lit("FYTD"))
        .when(flat.rlike(r"^FY\d{2,4}$"), F.concat(F.lit("FY "), F.right(flat, F.lit(2))))
        .when(flat.isin("YTD", "CYTD"), F.lit("YTD"))
        .when(flat.rlike(r"^CY\d{2,4}$"), F.concat(F.lit("CY "), F.right(flat, F.lit(2))))
    )


def labels_and_values(tokens: Column) -> tuple[Column, Column]:
    """Tokens that are labels (years, numbers of up to three digits), and those that are values."""
    label = lambda t: t.rlike(r"^(?:(?:19|20)\d{2}|\d{1,3})$")
    return F.filter(tokens, label), F.filter(tokens, lambda t: ~label(t) & t.rlike(r"^-?\d+(?:\.\d+)?%?$"))


def percent_change(now: Column, before: Column) -> Column:
    """Rounded to two places; null where there is nothing before or it is zero."""
    return F.round(F.try_divide(now - before, before) * 100, 2)
