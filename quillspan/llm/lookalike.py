"""Visually identical text with different characters, brought to one form.

Method: the UTF-8 bytes of a whole Arrow batch become one numpy array of code points; a lookup
table gives every code point its replacement length and a gather with expansion offsets writes
the replacements (full-width to plain, look-alike letters to Latin, ligatures and accented
letters to their parts, invisible characters to nothing); marks are put in order and composed
with their letters by searches in a table of pairs.  No call is made per row.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache, reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillspan.session import cut

#: Letters of other scripts that print like a Latin letter.
LOOK_ALIKES = {
    "АВЕЅІЈКМНОРСТУХһԁԛԝ": "ABESIJKMHOPCTYXhdqw",
    "аеіјорсухѕ": "aeijopcyxs",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ": "ABEZHIKMNOPTYX",
    "ονϲ": "ovc",
    "ՕՍՏօոսցհ": "OUSonugh",
    "ɡɑⅼⅰ": "gali",
}
#: Hyphens and a unit's sign that print like another character.
LOOK_ALIKE_MARKS = {"\u2010": "-", "\u2011": "-", "\u00b5": "\u03bc"}

SPACE, NEWLINE = 32, 10
#: Bytes of text that are folded at a time.
SLICE_BYTES = 1 << 20
_TOP = sys.maxunicode + 1


def _plain(cp: int) -> str | None:
    """What a code point prints as: its parts, without width; None if it prints as itself."""
    c = chr(cp)
    kind = unicodedata.category(c)
    if kind == "Zs" or c == "\t":
        return " "
    if c in "\r" or (kind == "Cf" and cp not in (0x600, 0x601, 0x602, 0x603, 0x6DD)) or cp in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF:
        return ""
    if c in "\u2028\u2029\x0b\x0c\x85":
        return "\n"
    parts = unicodedata.decomposition(c).split()
    if parts and parts[0] in ("<wide>", "<narrow>") or (parts and parts[0] == "<compat>" and 0xFB00 <= cp <= 0xFB06):
        return "".join(chr(int(p, 16)) for p in parts[1:])
    return None


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(length of the replacement, its place, replacements, combining class, pairs, composed)."""
    alike = {ord(a): b for many, plain in LOOK_ALIKES.items() for a, b in zip(many, plain, strict=True)}
    alike |= {ord(a): b for a, b in LOOK_ALIKE_MARKS.items()}
    length, place = np.ones(_TOP, np.int64), np.zeros(_TOP, np.int64)
    pool: list[int] = [0]  # place 0: not replaced
    classes = np.zeros(_TOP, np.uint8)
    pairs, composed = [], []
    for cp in range(_TOP):
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF or cp > 0x2FA1F and not 0xE0000 <= cp <= 0xE01EF:
            continue
        c = chr(cp)
        classes[cp] = unicodedata.combining(c)
        said = _plain(cp)
        text = unicodedata.normalize("NFD", c if said is None else said)
        text = "".join(alike.get(ord(x), x) for x in text)
        text = unicodedata.normalize("NFD", text)
        if text != c:
            length[cp], place[cp] = len(text), len(pool)
            pool.extend(map(ord, text))
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", c) == c:
            pairs.append(int(parts[0], 16) << 21 | int(parts[1], 16))
            composed.append(cp)
    order = np.argsort(pairs)
    return length, place, np.array(pool, np.uint32), classes, np.array(pairs)[order], np.array(composed, np.uint32)[order]


def to_points(data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and where each row starts among them."""
    raw = np.frombuffer(data, np.uint8)
    leads = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32), leads[starts]


def _rows_after(keep: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Row starts after dropping the elements not kept."""
    return np.concatenate(([0], np.cumsum(keep)))[starts]


def canonical_points(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The one form of a batch.  ``starts`` has one entry more than there are rows."""
    length, place, pool, classes, pairs, composed = tables()
    # replace and expand
    n = length[points]
    ends = np.cumsum(n)
    within = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n, n)
    at = np.repeat(place[points], n)
    out = np.where(at > 0, pool[np.minimum(at + within, len(pool) - 1)], np.repeat(points, n))
    starts = np.concatenate(([0], ends))[starts]
    # neighbouring marks by combining class, row by row order unchanged
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    while len(out) > 1:
        k = classes[out]
        swap = (k[:-1] > k[1:]) & (k[1:] > 0) & (row[:-1] == row[1:])
        if not swap.any():
            break
        at = np.flatnonzero(swap)
        at = at[np.concatenate(([True], np.diff(at) > 1))]
        out[at], out[at + 1] = out[at + 1].copy(), out[at].copy()
    # compose the first mark of a letter that no mark of its own class or above stands before,
    # again until nothing is left to compose
    while len(out) > 1 and len(pairs):
        k = classes[out]
        base = np.maximum.accumulate(np.where(k == 0, np.arange(len(out)), 0))
        base[1:] = np.where(k[1:] > 0, base[1:], np.arange(len(out) - 1))  # a letter may follow a letter it composes with
        maybe = np.flatnonzero((k[1:] == 0) | (k[:-1] == 0) | (k[:-1] < k[1:])) + 1
        maybe = maybe[(out[maybe] >= 0x300) & (row[base[maybe]] == row[maybe]) & (k[base[maybe]] == 0)]
        want = out[base[maybe]].astype(np.int64) << 21 | out[maybe].astype(np.int64)
        found = np.minimum(np.searchsorted(pairs, want), len(pairs) - 1)
        ok = pairs[found] == want
        at, made = maybe[ok], composed[found[ok]]
        if not len(at):
            break
        first = np.concatenate(([True], base[at][1:] != base[at][:-1]))
        at, made = at[first], made[first]
        apart = np.concatenate(([True], base[at][1:] > at[:-1]))  # a letter just taken is not composed with in this round
        at, made = at[apart], made[apart]
        out[base[at]] = made
        keep = np.ones(len(out), bool)
        keep[at] = False
        starts = _rows_after(keep, starts)
        out, row = out[keep], row[keep]
    # the width of a space does not count, nor do spaces that end a line
    space = out == SPACE
    first = np.zeros(len(out), bool)
    first[starts[:-1][starts[:-1] < len(out)]] = True
    after = np.ones(len(out), bool)
    after[1:] = (out[:-1] == SPACE) | (out[:-1] == NEWLINE)
    keep = ~(space & (after | first))
    starts = _rows_after(keep, starts)
    out, row = out[keep], row[keep]
    last = np.zeros(len(out), bool)
    tail = starts[1:][(starts[1:] > starts[:-1])] - 1
    last[tail] = True
    before = np.zeros(len(out), bool)
    before[:-1] = out[1:] == NEWLINE
    keep = ~((out == SPACE) & (before | last))
    return out[keep], _rows_after(keep, starts)


def canonical_batch(texts: pa.Array) -> pa.Array:
    """An Arrow string array in one form; nulls stay null.

    Rows are taken in slices of about SLICE_BYTES (one row at least), which bounds the memory of
    the index arrays whatever the batch holds.
    """
    a = pa.compute.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = a.buffers()[2]
    view = memoryview(data) if data is not None else memoryview(b"")
    made, at = [], 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        made.append(_canonical_slice(view[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]))
        at = to
    whole = pa.concat_arrays(made) if made else pa.array([], pa.large_string())
    return pa.compute.if_else(texts.is_valid(), whole, pa.scalar(None, pa.large_string()))


def _canonical_slice(data: memoryview, offsets: np.ndarray) -> pa.Array:
    points, starts = canonical_points(*to_points(bytes(data), offsets))
    raw = points.astype(np.uint32).tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    ends = np.concatenate(([0], np.cumsum(width)))[starts]
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(raw))


@F.pandas_udf(StringType())
def _canonical(texts: pd.Series) -> pd.Series:
    return canonical_batch(pa.array(texts, pa.large_string(), from_pandas=True)).to_pandas()


def canonical(text: Column) -> Column:
    """A text in one form: two texts that look the same become the same string.

    Null stays null and empty stays empty.  Letters, capitals, accents, digits, punctuation,
    words and line breaks are kept; widths, invisible characters, the way an accent is written
    and the script that a look-alike letter is taken from are not.
    """
    return _canonical(text)


def look_alikes(rows: DataFrame, key: str, text: str, within: list[str]) -> DataFrame:
    """One row per row: ``key, within..., look, letters``: digests of the text's one form and of
    the text itself.  Rows with the same ``look`` read the same; those with different
    ``letters`` are written differently.  Null texts have null digests."""
    return rows.select(key, *within, F.sha2(canonical(F.col(text)), 256).alias("look"), F.sha2(F.col(text), 256).alias("letters"))


def pairs_alike(rows: DataFrame, key: str, text: str, within: list[str]) -> DataFrame:
    """``<key>_a, <key>_b`` (a < b) of rows that read the same but are not the same string.

    Rows are compared ``within`` equal columns; null equals null.

    Digests alone are shuffled.  Spellings are paired first, one row each however many rows share
    one, and each pair of spellings is then given its rows: exact copies meet only rows that are
    written differently, and every pair that is made is a result.
    """
    marked = cut(look_alikes(rows, key, text, within).filter("look is not null"))
    by = [*within, "look"]
    spellings = cut(marked.groupBy(*by, "letters").agg(F.count(F.lit(1)).alias("__n")).select(*by, "letters"))
    same = lambda x, y: reduce(and_, [F.col(f"{x}.{c}").eqNullSafe(F.col(f"{y}.{c}")) for c in by])
    a, b = spellings.alias("a"), spellings.alias("b")
    pairs = a.join(b, same("a", "b") & (F.col("a.letters") < F.col("b.letters"))).select(*[F.col(f"a.{c}").alias(c) for c in by], F.col("a.letters").alias("first"), F.col("b.letters").alias("second"))
    p, m, n = pairs.alias("p"), marked.alias("m"), marked.alias("n")
    half = p.join(m, same("p", "m") & (F.col("p.first") == F.col("m.letters"))).select("p.*", F.col(f"m.{key}").alias("__a")).alias("h")
    whole = half.join(n, same("h", "n") & (F.col("h.second") == F.col("n.letters"))).select("__a", F.col(f"n.{key}").alias("__b"))
    return whole.select(F.least("__a", "__b").alias(f"{key}_a"), F.greatest("__a", "__b").alias(f"{key}_b"))
