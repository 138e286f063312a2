"""Text functions as Column expressions; those Spark lacks are Arrow UDFs over batches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ends of a word of ASCII: Java's own \\b also minds other letters, which other engines do not.
START, END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def clean(c: Column) -> Column:
    """Prose: null is '', line ends are \\n, outer white space goes, three or more line breaks are two."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n?", "\n")
    s = F.regexp_replace(s, r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(s, "\n{3,}", "\n\n")


def clean_line(c: Column) -> Column:
    """A name on one line: every run of white space is one space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def name_key(c: Column) -> Column:
    """Names are the same whatever their letter case and spacing."""
    return F.lower(clean_line(c))


def words(c: Column) -> Column:
    """Distinct search words: apostrophes dropped, lower case, letters and digits of ASCII."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "['’]", "")), F.lit("[a-z0-9]+"), F.lit(0)))


def paragraphs(c: Column) -> Column:
    """Lines without outer white space, empty ones dropped."""
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.filter(lines, lambda x: x != "")


def iso(day: Column) -> Column:
    """A DATE as text, '' if there is none: blank sorts below every date."""
    return F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit(""))


def nice_step(most: Column) -> Column:
    """The smallest of 1, 2 and 5 times a power of ten that divides ``most`` in four steps or fewer."""
    most = most.cast("double")
    tens = F.pow(F.lit(10.0), F.floor(F.log10(F.greatest(most, F.lit(1.0)))))
    options = F.array(*[tens * f for f in (0.1, 0.2, 0.5, 1.0, 2.0, 5.0, 10.0)])
    fits = F.filter(options, lambda s: (s >= 1) & (most / s <= 4))
    return F.when(most <= 0, F.lit(1)).otherwise(F.round(F.element_at(fits, 1))).cast("long")
