"""Dates, months and editions as they are typed in a register, parsed inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The first three letters of the months' names, in order.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_YMD = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:[T\s].*)?$"
_DMY = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})(?:\s.*)?$"
_TEXT = r"^(\d{1,2})(?:st|nd|rd|th)?[\s-]+([A-Za-z]{3,9})\.?,?[\s-]+(\d{4})(?:\s.*)?$"


def strip(c: Column) -> Column:
    """Without white space at either end, no-break spaces included; null stays null."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank(c: Column) -> Column:
    """True for null and for text of nothing but white space."""
    return F.coalesce(strip(c), F.lit("")) == ""


def month_number(name: Column) -> Column:
    """1 to 12 by the first three letters of a month's name, null if there is no such month."""
    names = F.array(*[F.lit(m) for m in MONTHS])
    return F.nullif(F.array_position(names, F.lower(F.substring(name, 1, 3))), F.lit(0).cast("long"))


def parse_day(c: Column) -> Column:
    """A typed date as DATE.

    All-number dates are year-month-day or day/month/year, whatever separates them; the
    month may also be a word.  A time of day is ignored.  Anything else, an impossible day
    included, is null.
    """
    s = strip(c)

    def part(pattern: str, i: int) -> Column:
        return F.regexp_extract(s, pattern, i)

    text = (
        F.when(s.rlike(_YMD), F.concat_ws("-", part(_YMD, 1), part(_YMD, 2), part(_YMD, 3)))
        .when(s.rlike(_DMY), F.concat_ws("-", part(_DMY, 3), part(_DMY, 2), part(_DMY, 1)))
        .when(
            s.rlike(_TEXT) & month_number(part(_TEXT, 2)).isNotNull(),
            F.concat_ws("-", part(_TEXT, 3), month_number(part(_TEXT, 2)).cast("string"), part(_TEXT, 1)),
        )
    )
    return F.try_to_date(text, "y-M-d")


def edition_no(edition: Column) -> Column:
    """Months since year 0 of an edition label such as ``july2023``; orders editions."""
    s = F.lower(strip(edition))
    month = month_number(F.regexp_extract(s, r"^([a-z]+)\s*\d{4}$", 1))
    year = F.try_to_number(F.regexp_extract(s, r"^[a-z]+\s*(\d{4})$", 1), F.lit("9999")).cast("int")
    return (year * 12 + month.cast("int") - 1).cast("int")


def parse_month(c: Column) -> Column:
    """A release month as ``yyyy-MM``: from ``2021-08``, ``Aug-21``, ``August 2021``, ``08/2021``
    or a whole date; two-digit years are of this century; anything else is ``''``."""
    s = F.coalesce(strip(c), F.lit(""))
    word = r"^([A-Za-z]{3,9})[\s\-/]+(\d{4}|\d{2})$"
    number = month_number(F.regexp_extract(s, word, 1))
    year = F.regexp_extract(s, word, 2)
    year = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    ym, my = r"^(\d{4})[-/](\d{1,2})$", r"^(\d{1,2})[-/](\d{4})$"
    months = F.lpad(
        F.when(s.rlike(ym), F.regexp_extract(s, ym, 2))
        .when(s.rlike(my), F.regexp_extract(s, my, 1))
        .otherwise(number.cast("string")),
        2,
        "0",
    )
    years = F.when(s.rlike(ym), F.regexp_extract(s, ym, 1)).when(s.rlike(my), F.regexp_extract(s, my, 2)).otherwise(year)
    found = F.concat_ws("-", years, months)
    day = parse_day(s)
    return (
        F.when((s.rlike(ym) | s.rlike(my) | (s.rlike(word) & number.isNotNull())) & months.between("01", "12"), found)
        .when(day.isNotNull(), F.date_format(day, "yyyy-MM"))
        .otherwise(F.lit(""))
    )
