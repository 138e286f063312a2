"""Several values packed in one field: one value per row, position kept.

Method: minimum description length.  A dialect is the set of delimiters that divide a field,
and whether double quotes shield what they enclose (brackets always do).  Every field is parsed
by each dialect that its own characters allow; the code length of a value comes from counts over
all fields (frequent values and frequent shapes are cheap, one-off text costs its characters);
each field keeps the parse that takes the fewest bits.

A text that holds a delimiter has no code of its own where it is only a frequent company of
values: where each of its parts also stands outside it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.functions.dates import blank
from quillspan.session import cut

#: The delimiters a field may use.  A slash or a plus divides only between spaces,
#: a comma not between digits, so no value is divided at a hyphen, an "and" or a bare slash.
DELIMITERS = {
    ";": r"[;；]",
    ",": r"(?<!\d)[,，、]|[,，、](?!\d)",
    "|": r"[|¦]",
    "/": r"\s+/\s+|//+",
    "n": r"\r\n|\r|\n",
    "t": r"\t",
    "*": r"[•‣●▪]",
    "+": r"(?<=\s)\+(?=\s)",
}
_FIND = re.compile("|".join(f"(?P<d{i}>{p})" for i, p in enumerate(DELIMITERS.values())))
_CODES = list(DELIMITERS)
_OPEN, _SHUT = "([", ")]"
_DIGIT = re.compile(r"\d")

#: Bits: a character of text that no table knows, a digit, a delimiter kind in a dialect,
#: the start of a value that no table knows.
CHAR_BITS, DIGIT_BITS, KIND_BITS, ESCAPE_BITS = 4.7, math.log2(10), 1.0, 6.0

#: Delimiters of these kinds are no part of any value, so every dialect of a field that holds them
#: divides at them; the others are tried with and without.
STRONG = frozenset(";|nt*")
#: Bits for quotes that shield nothing.
BARE_QUOTE_BITS = 20.0

#: A text with delimiters is a company of values if each part stands this often, and in this share
#: of its fields, outside it.
APART_FIELDS, APART_SHARE = 2, 0.02

#: Up to this many characters, and a sixteenth as many rows, the table of code lengths is sent to
#: all executors.
BROADCAST_CHARS = 16_000_000


def shielded(cell: str, quotes: bool = True) -> list[tuple[int, int]]:
    """Spans in brackets and, with ``quotes``, in double quotes, outermost first.  A quote or
    bracket that is never closed shields nothing."""
    spans, i, n = [], 0, len(cell)
    while i < n:
        c = cell[i]
        j = i
        if quotes and c == '"':
            j = i + 1
            while True:
                j = cell.find('"', j)
                if j < 0 or cell[j + 1 : j + 2] != '"':
                    break
                j += 2
        elif c in _OPEN:
            depth, j, quoted = 0, i, False
            while j < n:
                d = cell[j]
                quoted ^= quotes and d == '"'
                depth += (d in _OPEN) - (d in _SHUT) if not quoted else 0
                if depth == 0:
                    break
                j += 1
            j = j if j < n else -1
        if j > i:
            spans.append((i, j + 1))
            i = j
        i += 1
    return spans


def cuts(cell: str, quotes: bool = True) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each delimiter outside the shields."""
    spans, out, k = shielded(cell, quotes), [], 0
    for m in _FIND.finditer(cell):
        while k < len(spans) and spans[k][1] <= m.start():
            k += 1
        if k < len(spans) and spans[k][0] <= m.start():
            continue
        out.append((m.start(), m.end(), _CODES[m.lastindex - 1]))
    return out


def parse(cell: str, found: list[tuple[int, int, str]], kinds: frozenset[str] | set[str]) -> list[str]:
    """The values of ``cell`` divided at ``kinds``: trimmed, unquoted, empty ones dropped."""
    parts, at = [], 0
    for a, b, kind in found:
        if kind in kinds:
            parts.append(cell[at:a])
            at = b
    parts.append(cell[at:])
    return [v for v in map(unquote, parts) if v]


def unquote(value: str) -> str:
    """Trimmed; if the whole is one quoted text, without the quotes, doubled ones made single."""
    v = value.strip()
    if len(v) >= 2 and v[0] == v[-1] == '"' and '"' not in v[1:-1].replace('""', ""):
        v = v[1:-1].replace('""', '"').strip()
    return v


def stray_quotes(cell: str) -> bool:
    """Whether a quoted text that holds a delimiter begins or ends inside a value, so that its
    quotes may be signs of another kind, such as inches."""
    if '"' not in cell:
        return False
    whole = cuts(cell)
    starts, ends = {0, *(b for _, b, _ in whole)}, {len(cell), *(a for a, _, _ in whole)}
    for a, b in shielded(cell):
        if cell[a] == '"' and _FIND.search(cell, a, b):
            before, after = len(cell[:a].rstrip(" ")), b + len(cell[b:]) - len(cell[b:].lstrip(" "))
            if not (starts & set(range(before, a + 1)) and ends & set(range(b, after + 1))):
                return True
    return False


Dialect = tuple[bool, frozenset[str]]


def parses(cell: str) -> list[tuple[Dialect, list[str], float]]:
    """(dialect, values, bits of the dialect) of every dialect that the field's characters allow."""
    out = []
    for quotes in (True, False) if stray_quotes(cell) else (True,):
        found = cuts(cell, quotes)
        always = STRONG & {k for _, _, k in found}
        weak = sorted({k for _, _, k in found} - always)
        for n in range(len(weak) + 1):
            for d in map(always.union, combinations(weak, n)):
                out.append(((quotes, d), parse(cell, found, d), KIND_BITS * len(d) + (0.0 if quotes else BARE_QUOTE_BITS)))
    return out


def shape_of(value: str) -> str:
    return re.sub(r"\d", "9", value)


def bits_of(values: list[str], dialect_bits: float, code: dict[str, float]) -> float:
    """The code length of one parse: its dialect, and each value by its shape or letter by letter."""
    bits = dialect_bits
    for v in values:
        known = code.get(shape_of(v))
        bits += ESCAPE_BITS + CHAR_BITS * len(v) if known is None else known + DIGIT_BITS * len(_DIGIT.findall(v))
    return bits


def label(dialect: Dialect) -> str:
    return ("" if dialect[0] else '"') + "".join(sorted(dialect[1]))


def cheapest(cell: str, code: dict[str, float]) -> list[str]:
    return min((round(bits_of(v, bits, code), 6), -len(v), label(d), v) for d, v, bits in parses(cell))[-1]


def _count_shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        tally: Counter[str] = Counter()
        for cell, n in pdf["cell"].value_counts().items():
            for x in {shape_of(v) for _, values, _ in parses(cell) for v in values}:
                tally[x] += int(n)
        if tally:
            yield pd.DataFrame({"shape": list(tally), "n": list(tally.values())})


@F.pandas_udf(T.ArrayType(T.StringType()))
def _parts(shapes: pd.Series) -> pd.Series:
    """What a text falls into at every delimiter, or nothing if it holds none."""

    def of(x: str) -> list[str]:
        found = cuts(x)
        return sorted(set(parse(x, found, set(_CODES)))) if found else []

    return shapes.map(of)


def code_lengths(cells: DataFrame) -> DataFrame:
    """``shape, bits`` of every shape that occurs in two fields or more, over all fields: its
    rarity, and the letters of its entry in the code book, shared among its uses.  Companies of
    values are left out."""
    total = cells.count()
    counts = cut(cells.mapInPandas(_count_shapes, "shape string, n long").groupBy("shape").agg(F.sum("n").alias("n")).filter("n > 1"))
    several = counts.withColumn("part", F.explode(_parts("shape"))).join(counts.select(F.col("shape").alias("part"), F.col("n").alias("m")), "part", "left")
    apart = (F.coalesce("m", F.col("n")) - F.col("n") >= F.greatest(F.lit(APART_FIELDS), F.col("m") * APART_SHARE)).cast("int")
    company = several.groupBy("shape").agg(F.min(apart).alias("apart")).filter("apart = 1").select("shape")
    rarity = F.log2(F.lit(float(total + 1)) / F.col("n")) + CHAR_BITS * F.length("shape") / F.col("n")
    return counts.join(company, "shape", "left_anti").select("shape", rarity.alias("bits"))


def _parses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(cell, label(d), bits, v) for cell in pdf["cell"] for d, v, bits in parses(cell)]
        if rows:
            yield pd.DataFrame(rows, columns=["cell", "dialect", "dialect_bits", "parts"])


def _priced_by_join(cells: DataFrame, code: DataFrame) -> DataFrame:
    """``cell, parts`` by a join with the code lengths, for a code too large to be sent around."""
    distinct = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).select("cell")
    every = distinct.mapInPandas(_parses, "cell string, dialect string, dialect_bits double, parts array<string>")
    shape = F.regexp_replace("value", r"(?U)\d", "9")
    digits = F.length("value") - F.length(F.regexp_replace("value", r"(?U)\d", ""))
    each = every.select("cell", "dialect", "dialect_bits", F.explode_outer("parts").alias("value")).withColumn("shape", shape).join(code, "shape", "left")
    price = F.coalesce(F.col("bits") + DIGIT_BITS * digits, ESCAPE_BITS + CHAR_BITS * F.length("value"), F.lit(0.0))
    sums = each.groupBy("cell", "dialect").agg((F.first("dialect_bits") + F.sum(price)).alias("bits"))
    ranked = every.join(sums, ["cell", "dialect"]).withColumn("bits", F.round("bits", 6))
    return ranked.groupBy("cell").agg(F.min_by("parts", F.struct("bits", (-F.size("parts")).alias("more"), "dialect")).alias("parts"))


def split_packed(rows: DataFrame, field: str, keep: list[str], broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """One row per value of ``field``: ``keep..., value_no, value``.

    Null and blank fields give no rows.  ``value_no`` counts the values of a field from 1 in
    their order; empty values are not counted, repeated values are.  What stands in double quotes
    or in round or square brackets is not divided.  Repeated rows are each split.  Equal code
    lengths go to the dialect that divides more, then to the one first in the alphabet.  Columns
    not named are ignored.  Text of any length is parsed whole.

    Two passes over the fields and one small shuffle of shape counts.  Code lengths of up to
    ``broadcast_chars`` characters are sent to the executors and every row is split in place;
    beyond that the parses are priced by a join, with the same result.
    """
    spark = rows.sparkSession
    given = rows.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)], F.col(field).alias("cell")).filter(~blank(F.col("cell")))
    code = cut(code_lengths(given.select("cell")))
    size = code.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.length("shape")), F.lit(0)).alias("chars")).first()
    if size.chars > broadcast_chars or size.rows > broadcast_chars // 16:
        done = given.join(_priced_by_join(given.select("cell"), code), "cell")
    else:
        sent = spark.sparkContext.broadcast({r.shape: r.bits for r in code.collect()})  # bounded by broadcast_chars

        @F.pandas_udf("array<string>")
        def parts_of(cells: pd.Series) -> pd.Series:
            memo = {c: cheapest(c, sent.value) for c in cells.unique()}
            return cells.map(memo)

        done = given.withColumn("parts", parts_of("cell"))
    out = done.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], F.posexplode("parts").alias("__no", "value"))
    return out.withColumn("value_no", F.col("__no").cast("long") + 1).select(*keep, "value_no", "value")
