"""Checks of texts that were written about records: what needs (re)writing, what should be read by
a person first, what a rewording changed; all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words a text may have; characters of a source field; characters a token is taken to have.
MOST_WORDS, FIELD_CHARS, CHARS_PER_TOKEN = 90, 4_000, 4
#: Words that a statement about releases turns on: what denies one, and what is denied, so many
#: words apart at most in one sentence.
DENIALS = ("no", "not", "never", "none", "yet")
RELEASES = ("released", "shared", "received", "provided", "disseminated", "supplied", "sent")
NEAR_WORDS = 6


def cut_on_word(c: Column, most: int = FIELD_CHARS) -> Column:
    """A text, or as many of its first ``most`` characters as end with a word, marked as cut."""
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.regexp_replace(F.substring(c, 1, most), r"(?s)^(.*) .*$", "$1"), F.lit(" [cut]")))


def text_hash(*fields: Column) -> Column:
    """A digest of fields in their order; null counts as blank."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(f, F.lit("")) for f in fields])), 256)


def needing(records: DataFrame, written: DataFrame, key: str = "base") -> DataFrame:
    """Records without a text, or whose text was written from other words: ``hash`` differs."""
    w = written.select(F.col(key).alias("__k"), F.col("hash").alias("__h"))
    j = records.join(w, F.upper(F.col(key)) == F.upper(F.col("__k")), "left")
    return j.filter(~F.col("hash").eqNullSafe(F.col("__h"))).drop("__k", "__h")


def estimate(texts: DataFrame, text: str, written_tokens: int = 150) -> DataFrame:
    """One row: texts, tokens to be read and to be written, roughly."""
    return texts.agg(F.count(F.lit(1)).alias("texts"), F.coalesce(F.sum(F.length(text)) / CHARS_PER_TOKEN, F.lit(0.0)).alias("tokens_in"), (F.count(F.lit(1)) * written_tokens).alias("tokens_out"))


def _tokens(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")


def _bare(word: Column) -> Column:
    """A word without what is not a letter or digit at its ends, and without a possessive."""
    return F.regexp_replace(F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""), "['’]s$", "")


def names_in(c: Column, openers: bool = False) -> Column:
    """Words with a capital, the parts of hyphened ones apart; those that open a sentence only if asked for."""
    words = _tokens(c)
    opens = lambda i: (i == 0) | F.coalesce(F.get(words, i - 1).rlike("[.!?:][\"'’”)]*$"), F.lit(False))
    kept = words if openers else F.filter(words, lambda w, i: ~opens(i))
    parts = F.flatten(F.transform(kept, lambda w: F.split(_bare(w), "-")))
    return F.array_distinct(F.filter(parts, lambda p: p.rlike(r"^\p{Lu}")))


def numbers_in(c: Column) -> Column:
    words = F.transform(_tokens(c), lambda w: F.regexp_extract(w, r"\d[\d.,]*\d|\d", 0))
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def denies_release(c: Column) -> Column:
    """Whether a sentence says that something was not released."""
    words = F.transform(_tokens(F.lower(c)), lambda w: F.struct(_bare(w).alias("w"), w.rlike("[.!?]$").alias("ends")))

    def follows(i: Column) -> Column:
        after = F.slice(words, i + 2, NEAR_WORDS)
        ended = F.array_position(F.transform(after, lambda x: x["ends"]), True)
        seen = F.when(ended > 0, F.slice(after, 1, ended.cast("int"))).otherwise(after)
        return F.exists(seen, lambda x: x["w"].isin(*RELEASES))

    numbered = F.transform(words, lambda x, i: F.struct(x["w"].alias("w"), (x["ends"] | ~x["w"].isin(*DENIALS)).alias("no"), i.alias("i")))
    return F.exists(numbered, lambda x: ~x["no"] & follows(x["i"]))


CHECK = "array<struct<check:string,detail:string>>"


def _checks(*found: tuple[str, Column, Column]) -> Column:
    every = F.array(*[F.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(name).alias("check"), detail.alias("detail"))) for name, holds, detail in found])
    return F.filter(every, lambda x: x.isNotNull())


def _list(items: Column) -> Column:
    return F.array_join(F.sort_array(items), ", ")


def flags(summary: Column, source: Column) -> Column:
    """What somebody should look at before a text is shown, ``check`` and ``detail``; an empty array
    if nothing: ``empty``, ``length`` (words), ``release`` and ``unknown`` (names the source lacks)."""
    blank = F.trim(F.coalesce(summary, F.lit(""))) == ""
    low, n = F.lower(F.coalesce(source, F.lit(""))), F.size(_tokens(summary))
    unknown = F.filter(names_in(summary), lambda w: ~F.contains(low, F.lower(w)))
    return _checks(
        ("empty", blank, F.lit("")),
        ("length", ~blank & (n > MOST_WORDS), n.cast("string")),
        ("release", denies_release(summary), F.lit("")),
        ("unknown", F.size(unknown) > 0, _list(unknown)),
    )


def drift(before: Column, after: Column) -> Column:
    """Names and numbers that a rewording brought in (``added``) or left out (``lost``)."""

    def only(one: Column, other: Column) -> Column:
        return F.array_union(F.array_except(names_in(one), names_in(other, True)), F.array_except(numbers_in(one), numbers_in(other)))

    added, lost = only(after, before), only(before, after)
    return _checks(("added", F.size(added) > 0, _list(added)), ("lost", F.size(lost) > 0, _list(lost)))


#: What may stand for what in a body's name, words as patterns.
INTERCHANGEABLE = (("&", " and "), (r"\band\b", " & "), (r"\bhospitals\b", "Hospital"), (r"\bhospital\b", "Hospitals"), (r"\bNHS trust$", "NHS Foundation Trust"), (r"\s*\([^)]*\)\s*$", ""))


def spelling_variants(name: Column) -> Column:
    """Other ways a register of codes may write a name: every choice of interchangeable words,
    each used or not; the name itself is left out, however spaced."""
    tidy = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))

    def written(pattern: str, other: str):
        return lambda x: tidy(F.regexp_replace(x, f"(?i){pattern}", other))

    forms = F.array(name)
    for pattern, other in reversed(INTERCHANGEABLE):
        forms = F.array_union(forms, F.transform(forms, written(pattern, other)))
    return F.sort_array(F.filter(forms, lambda x: (x != "") & (F.lower(tidy(x)) != F.lower(tidy(name)))))
