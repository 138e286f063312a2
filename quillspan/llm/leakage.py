"""Evaluation texts leaking into a corpus.

Method: items and documents become streams of template words: numbers, units and names are
replaced with typed placeholders; case, spacing, punctuation and markup are dropped.  Windows of
five template words are hashed, five in a row and five of six with an inner one left out, so that
a changed, missing or added word costs no window of its neighbours.  The documents are read once:
a bit table of the items' windows, of bounded size, keeps the windows that no item has from
leaving the scan, and the rest meet the items' windows in one equi-join on the hash.  The joined
windows of a document and an item say which words agree; these are chained into runs, and the
fillings of the placeholders are compared: one replaced by one and the same throughout still
agrees (a re-parameterised copy), one filled at random is a changed word.

Names are those that a text itself writes with a capital inside a sentence.  Windows that hold
one are hashed with the name and with its placeholder, so it does not matter whether both texts
show it (a document may be in capitals throughout).
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.session import cut, partitions

#: Words in a window, and the inner word of six that is left out (0: five words in a row).
WINDOW, GAPS = 5, (0, 2, 3)
#: The least share of an item's words that a run must hold.
LEAST_SHARE = 1 / 3
#: Changed or missing words in a row that do not break a run, and the least share of a run's
#: words that must agree.
MOST_GAP, LEAST_DENSITY = 4, 0.7
#: A window with more placeholders than this says little: it is hashed by its own words.
MOST_SLOTS = 2
#: Bits of the bit table for each item window, and its greatest size (2 to the power: 16 MB).
BITS_EACH, MOST_BITS = 256, 27
#: Item windows, and pairs of document and item, up to this many (80 bytes each) are sent to the
#: executors; more are joined by a shuffle.
BROADCAST_WINDOWS = 500_000
#: Characters of text that are hashed at a time, and words whose codes a worker remembers.
SLICE_CHARS, MOST_CODES = 1_000_000, 500_000

#: Numbers written as words, and units.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty "
    "thirty forty fifty sixty seventy eighty ninety hundred thousand million billion first second third fourth fifth sixth seventh eighth ninth tenth "
    "once twice half dozen".split()
)
UNITS = frozenset(
    "second seconds minute minutes hour hours day days week weeks month months year years mm cm m km metre metres kilometre kilometres mile miles g kg mg "
    "gram grams kilogram kilograms tonne tonnes l ml litre litres percent pound pounds pence dollar dollars euro euros degree degrees".split()
) - {"second"}

_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
_WORD = re.compile(r"[^\W_]+|[.!?]")
_INVISIBLE = re.compile("[­͏​-‍⁠﻿]")
_MARKS = re.compile("[̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯]")

#: The low bits of a word's code: what kind it is, and whether it is written with a capital.
_NUMBER, _UNIT, _KIND, _CAPITAL = 1, 2, 3, 4
#: The code of a sentence's end among the words.
_END = 0


def tokens(text: str) -> list[str]:
    """Words without accents, markup and invisible characters, and the ends of sentences."""
    text = html.unescape(text) if "&" in text else text
    text = _TAG.sub(" ", text) if "<" in text else text
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", _INVISIBLE.sub("", text)))
    return _WORD.findall(text.replace("'", "").replace("’", ""))


class Codes(dict):
    """Word -> 64-bit code, worked out once per word and worker."""

    def __missing__(self, token: str) -> int:
        import xxhash

        word = token.casefold()
        if token in ".!?":
            code = _END
        else:
            kind = _NUMBER if token[0].isdigit() or word in NUMBER_WORDS else _UNIT if word in UNITS else 0
            capital = _CAPITAL if not kind and len(token) > 1 and token[0].isupper() and token[1:].islower() else 0
            code = (xxhash.xxh64_intdigest(word) | 15) ^ 15 | 8 | kind | capital
        if len(self) >= MOST_CODES:
            self.clear()
        self[token] = code
        return code


def mixed(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def places_of(n: int, gap: int) -> list[int]:
    """Where the words of a window stand, counted from its first."""
    return [i + (1 if gap and i >= gap else 0) for i in range(n)]


class Slice:
    """The words of some texts, one after another, as codes.

    ``own`` are words as they are, ``plain`` has numbers and units as placeholders, ``full`` names
    too.  ``at`` is a word's place in its text, ``text`` the number of its text.
    """

    def __init__(self, texts: list[str], codes: Codes):
        found = [tokens(t) for t in texts]
        raw = np.fromiter((codes[t] for ts in found for t in ts), np.uint64)
        text = np.repeat(np.arange(len(found)), [len(t) for t in found])
        starts = np.ones(len(raw), bool)
        starts[1:] = (raw[:-1] == _END) | (text[1:] != text[:-1])
        keep = raw != _END
        raw, text, starts = raw[keep], text[keep], starts[keep]
        self.text = text
        self.count = np.bincount(text, minlength=len(found))
        self.at = np.arange(len(text)) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        capital = (raw & np.uint64(_CAPITAL)) != 0
        # a text in which every other word has a capital shows no names by them
        many = np.bincount(text, weights=capital, minlength=len(found)) * 2 > self.count
        self.name = capital & ~starts & ~many[text]
        kind = raw & np.uint64(_KIND)
        self.own = raw & ~np.uint64(_CAPITAL)
        self.slot = kind != 0
        self.plain = np.where(self.slot, kind, self.own)
        self.full = np.where(self.name, np.uint64(3), self.plain)

    def windows(self, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(word left out, or 0; first word of each window; hash) of all windows of ``n`` words.  A
        window is hashed by words and placeholders, and once more if it holds a name."""
        in_row: dict[bool, np.ndarray] = {}
        for gap in GAPS if n == WINDOW else (0,):
            places = places_of(n, gap)
            width = places[-1] + 1
            if len(self.own) < width:
                continue
            end = len(self.own) - width + 1
            first = np.flatnonzero(self.text[:end] == self.text[width - 1 :])
            slots = sum((self.slot[first + p].astype(np.int8) for p in places), np.zeros(len(first), np.int8))
            named = sum((self.name[first + p].astype(np.int8) for p in places), np.zeros(len(first), np.int8))
            for with_names in (False, True):
                if with_names:
                    some = np.flatnonzero((named > 0) & (slots + named <= MOST_SLOTS))
                    first, slots = first[some], (slots + named)[some]
                h = self._hashed(first, places, self.full if with_names else self.plain, slots)
                if gap:  # of one and the same word over and over, a window with a gap says nothing new
                    new = np.flatnonzero(h != in_row[with_names][first])
                    yield gap, first[new], h[new]
                else:
                    in_row[with_names] = np.zeros(len(self.own), np.uint64)
                    in_row[with_names][first] = h
                    yield gap, first, h

    def _hashed(self, first: np.ndarray, places: list[int], template: np.ndarray, slots: np.ndarray) -> np.ndarray:
        literal = slots > MOST_SLOTS if len(places) == WINDOW else np.zeros(len(first), bool)
        h = np.full(len(first), len(places), np.uint64)
        for p in places:
            at = first + p
            h = mixed(h ^ (np.where(literal, self.own[at], template[at]) * np.uint64(0x9E3779B97F4A7C15)))
        return h


_SLOTS = [f"w{i}" for i in range(WINDOW)]
_ITEM_SCHEMA = "h long, item_id long, words int, p int, item_gap int, cover long, " + ", ".join(f"i{i} long" for i in range(WINDOW))
_HIT_SCHEMA = "h long, row long, doc_id long, n int, q int, doc_gap int, stretch int, " + ", ".join(f"{c} long" for c in _SLOTS)


def _slices(batch: pa.RecordBatch, text: int) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) in slices of about SLICE_CHARS; a longer text is a slice of its own."""
    given = batch.column(text).to_pylist()
    at, size = 0, 0
    for i, t in enumerate(given):
        if i > at and size + len(t) > SLICE_CHARS:
            yield at, given[at:i]
            at, size = i, 0
        size += len(t)
    if at < len(given):
        yield at, given[at:]


def window_of(words: int | np.ndarray) -> np.ndarray:
    """Words in the windows of an item: five, or all of a shorter one."""
    return np.minimum(WINDOW, words)


def item_windows(items: DataFrame, key: str, text: str) -> DataFrame:
    """One row per window of each item: its hash, place and words.  Items without a word have none."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            for at, texts in _slices(batch, 1):
                s = Slice(texts, codes)
                ids = np.asarray(batch.column(0).to_numpy(zero_copy_only=False))[at : at + len(texts)]
                for n in sorted({int(x) for x in window_of(s.count) if x}):
                    for gap, first, h in s.windows(n):
                        mine = window_of(s.count[s.text[first]]) == n
                        first, h = first[mine], h[mine]
                        if len(first):
                            words, at_word = s.count[s.text[first]], s.at[first]
                            yield _rows(s, n, gap, first, [h.view(np.int64), ids[s.text[first]], words, at_word, np.full(len(first), gap), covered(at_word, at_word + places_of(n, gap)[-1], words)], _ITEM_NAMES)

    given = items.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).filter("k is not null and t is not null")
    return given.mapInArrow(made, _ITEM_SCHEMA)


def covered(first: np.ndarray, last: np.ndarray, words: np.ndarray) -> np.ndarray:
    """64 bits, each for a 64th of an item, set where its words ``first`` to ``last`` stand."""
    a, b = (first * 64 // words).astype(np.uint64), (((last + 1) * 64 - 1) // words).astype(np.uint64)
    low = (np.uint64(1) << a) - np.uint64(1)
    high = np.where(b == 63, ~np.uint64(0), (np.uint64(1) << ((b + np.uint64(1)) & np.uint64(63))) - np.uint64(1))
    return (high & ~low).view(np.int64)


def may_hold_a_run(cover: Column, words: Column) -> Column:
    """Whether the covered parts of an item may hold the least run: enough of them, and a third of
    the item in a row once gaps of MOST_GAP words are closed (items under 64 words: not asked)."""

    def closed(bits: int) -> Column:
        return reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(cover, i) for i in range(bits + 1)])

    third = F.when(words < 128, closed(MOST_GAP)).when(words < 256, closed(MOST_GAP // 2)).otherwise(closed(1))
    for step in (1, 2, 4, 8, 5):  # bits that end 21 set ones in a row
        third = third.bitwiseAND(F.shiftleft(third, step))
    return (F.bit_count(cover) >= int(64 * LEAST_SHARE * LEAST_DENSITY)) & ((words < 64) | (third != 0))


_ITEM_NAMES = ["h", "item_id", "words", "p", "item_gap", "cover", *(f"i{i}" for i in range(WINDOW))]
_HIT_NAMES = ["h", "row", "doc_id", "n", "q", "doc_gap", "stretch", *_SLOTS]


def _rows(s: Slice, n: int, gap: int, first: np.ndarray, columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """Windows as rows: the given columns, then their words (0 beyond the window's end)."""
    wide = {"h", "item_id", "cover", "row", "doc_id"}
    arrays = [pa.array(c, pa.int64() if name in wide else pa.int32()) for c, name in zip(columns, names, strict=False)]
    for i in range(WINDOW):
        own = words_at(s, first + places_of(n, gap)[i]) if i < n else np.zeros(len(first), np.int64)
        arrays.append(pa.array(own, pa.int64()))
    return pa.RecordBatch.from_arrays(arrays, names=names)


def words_at(s: Slice, at: np.ndarray) -> np.ndarray:
    """The codes of words; the low bits tell what may be replaced: a number, a unit or a name."""
    return (s.own[at] | np.where(s.name[at], np.uint64(3), np.uint64(0))).view(np.int64)


def bit_table(windows: DataFrame, count: int) -> tuple[np.ndarray, int]:
    """(bytes, bits to shift a hash by): a bit for every window hash.  Built in the cluster; of
    bounded size whatever the number of windows."""
    power = min(MOST_BITS, max(16, int(count * BITS_EACH).bit_length()))
    slot = F.shiftrightunsigned("h", 64 - power) + 1
    rows = windows.select(F.call_function("bitmap_bucket_number", slot).alias("b"), F.call_function("bitmap_bit_position", slot).alias("i"))
    parts = rows.groupBy("b").agg(F.call_function("bitmap_construct_agg", F.col("i")).alias("bits")).collect()  # at most 2^27 bits
    table = np.zeros(max(1 << (power - 3), 4096), np.uint8)
    for r in parts:
        at = (r.b - 1) * 4096
        table[at : at + 4096] = np.frombuffer(bytes(r.bits), np.uint8)[: len(table) - at]
    return table, 64 - power


def stretches(s: Slice, found: list[tuple[int, int, np.ndarray, np.ndarray]], need: float) -> np.ndarray:
    """For each word the place of the first of its stretch, -1 outside.  A stretch may hold a run:
    its words of found windows, ``need`` or more, have at most MOST_GAP others in a row between them."""
    shown = np.zeros(len(s.own), bool)
    for n, gap, first, _ in found:
        for p in places_of(n, gap):
            shown[first + p] = True
    at = np.flatnonzero(shown)
    out = np.full(len(s.own), -1)
    if len(at):
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > MOST_GAP + 1) | (s.text[at[1:]] != s.text[at[:-1]])
        of = np.cumsum(new) - 1
        out[at] = np.where(np.bincount(of)[of] >= need, s.at[at[new]][of], -1)
    return out


def document_hits(documents: DataFrame, doc: str, text: str, table: tuple[np.ndarray, int], lengths: list[int], least_words: int) -> DataFrame:
    """The windows of documents that an item may have, one row each: one pass, no shuffle.

    Windows that stand too far from others to make up the least run of the shortest item, of
    ``least_words`` words, stay behind as well."""
    sent = documents.sparkSession.sparkContext.broadcast(table)
    need = LEAST_SHARE * LEAST_DENSITY * least_words - 1e-9

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, shift = sent.value
        codes, shift = Codes(), np.uint64(shift)
        for batch in batches:
            rows, ids = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in (0, 1))
            for at, texts in _slices(batch, 2):
                s = Slice(texts, codes)
                kept = []
                for n in lengths:
                    for gap, first, h in s.windows(n):
                        slot = h >> shift
                        hit = np.flatnonzero((bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1)
                        kept.append((n, gap, first[hit], h[hit]))
                stretch = stretches(s, kept, need)
                for n, gap, first, h in kept:
                    hit = np.flatnonzero(stretch[first] >= 0)
                    if len(hit):
                        first, h = first[hit], h[hit]
                        of = at + s.text[first]
                        yield _rows(s, n, gap, first, [h.view(np.int64), rows[of], ids[of], s.count[s.text[first]], s.at[first], np.full(len(first), gap), stretch[first]], _HIT_NAMES)

    given = documents.select(F.monotonically_increasing_id().alias("r"), F.col(doc).cast("long").alias("d"), F.col(text).alias("t")).filter("t is not null")
    return given.mapInArrow(found, _HIT_SCHEMA)


Cells = dict[tuple[int, int], tuple[int, int]]


def agreeing(q: np.ndarray, doc_gap: np.ndarray, p: np.ndarray, item_gap: np.ndarray, own: np.ndarray, theirs: np.ndarray) -> Cells:
    """(document word, item word) -> (document's own, item's own) of the words that windows pair.
    ``own`` and ``theirs`` hold the words of one window after the other."""
    i = np.arange(WINDOW)
    at = [(first[:, None] + i + ((gap[:, None] > 0) & (i >= gap[:, None]))).ravel() for first, gap in ((q, doc_gap), (p, item_gap))]
    real = theirs != 0
    return dict(zip(zip(at[0][real].tolist(), at[1][real].tolist(), strict=True), zip(own[real].tolist(), theirs[real].tolist(), strict=True), strict=True))


def best_run(cells: Cells, words: int) -> tuple[float, float, int, int, bool] | None:
    """(share of the item, density, slots, changed slots, consistent) of the best run, or None.

    Agreeing words with at most MOST_GAP words between them in either text are chained, each word
    taking the longest chain before it; of every chain the longest stretch that is dense enough
    counts.  No chain is given up.
    """
    order = sorted(cells)
    length: dict[tuple[int, int], int] = {}
    before: dict[tuple[int, int], tuple[int, int] | None] = {}
    inner = set()
    longest = 0
    for q, p in order:
        via = (q - 1, p - 1)
        best = length.get(via, 0)
        if not best or best < longest:  # no chain is longer than the longest
            best, via = 0, None
            for dq in range(1, MOST_GAP + 2):
                for dp in range(1, MOST_GAP + 2):
                    n = length.get((q - dq, p - dp), 0)
                    if n > best:
                        best, via = n, (q - dq, p - dp)
        length[q, p], before[q, p] = best + 1, via
        longest = max(longest, best + 1)
        inner.add(via)
    need = LEAST_SHARE * words - 1e-9
    found = None
    for last in order:
        if last in inner or length[last] < LEAST_DENSITY * need:
            continue
        chain = []
        at: tuple[int, int] | None = last
        while at is not None:
            chain.append(at)
            at = before[at]
        chain.reverse()
        same = _agree(chain, cells)
        run = _densest(chain, same, need)
        if run:
            i, j = run
            part = chain[i : j + 1]
            span = part[-1][1] - part[0][1] + 1
            slots, changed, consistent = _slots(part, cells)
            result = (min(1.0, span / words), float(same[i : j + 1].sum()) / span, slots, changed, consistent)
            if found is None or result[:2] > found[:2]:
                found = result
    return found


def _agree(chain: list[tuple[int, int]], cells: Cells) -> np.ndarray:
    """1 for each word of a chain that agrees.  A placeholder's filling agrees if the item's is
    replaced by one and the same throughout the chain."""
    filled: dict[int, set[int]] = {}
    for c in chain:
        a, b = cells[c]
        filled.setdefault(b >> 3, set()).add(a >> 3)
    return np.array([int(cells[c][0] >> 3 == cells[c][1] >> 3 or len(filled[cells[c][1] >> 3]) == 1) for c in chain])


def _densest(chain: list[tuple[int, int]], same: np.ndarray, need: float) -> tuple[int, int] | None:
    """The longest stretch of a chain that spans ``need`` words of the item and is dense enough."""
    q, p = (np.array([c[k] for c in chain]) for k in (0, 1))
    total = np.concatenate([[0], np.cumsum(same)])
    best, at = 0, None
    for i in range(len(chain)):
        span = p[i:] - p[i] + 1
        if span[-1] <= best:
            break
        wide = np.maximum(span, q[i:] - q[i] + 1)
        fits = np.flatnonzero((span >= need) & (total[i + 1 :] - total[i] >= LEAST_DENSITY * wide))
        if len(fits) and span[fits[-1]] > best:
            best, at = int(span[fits[-1]]), (i, i + int(fits[-1]))
    return at


def _slots(chain: list[tuple[int, int]], cells: Cells) -> tuple[int, int, bool]:
    """(placeholders in a run, those filled otherwise, whether each filling is replaced by one and
    the same throughout)."""
    filled: dict[int, set[int]] = {}
    n = changed = 0
    for c in chain:
        a, b = cells[c]
        if b & _KIND:
            n += 1
            changed += a >> 3 != b >> 3
            filled.setdefault(b >> 3, set()).add(a >> 3)
    return n, changed, all(len(v) == 1 for v in filled.values())


_RESULT = "doc_id long, item_id long, share double, density double, slots int, changed_slots int, consistent boolean"
_RESULT_NAMES = ["doc_id", "item_id", "share", "density", "slots", "changed_slots", "consistent"]
def runs_of(grouped: DataFrame) -> DataFrame:
    """``row`` and the result's columns for the groups of ``hits`` that hold a run."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row, doc, item, words, *hits in pdf.itertuples(index=False, name=None):
                found = best_run(agreeing(*hits), words)
                if found:
                    rows.append((row, doc, item, *found))
            if rows:
                yield pd.DataFrame(rows, columns=["row", *_RESULT_NAMES])

    hits = [F.col(f"hits.{c}").alias(c) for c in ("q", "doc_gap", "p", "item_gap")] + [F.flatten(f"hits.{c}").alias(c) for c in ("a", "b")]
    return grouped.select("row", "doc_id", "item_id", "words", *hits).mapInPandas(run, f"row long, {_RESULT}")


def find_leaks(documents: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", key: str = "item_id", item_text: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Documents that hold an item, whole or a run of at least a third of its words.

    One row per document and item: the run's share of the item, the share of the run's words
    that agree, its placeholders, how many are filled otherwise, and whether consistently.  Null
    and empty texts hold nothing and are held by nothing.  Repeated documents each get their
    rows; an item that occurs several times in a document gets one row, for its best run.  Items
    with one id are told apart by their number of words only.  Items of fewer than fifteen words
    are found by five words in a row, shorter ones than that as a whole.  Texts are read whole.

    The documents are read once and not shuffled; joined windows are, grouped by document and
    item.  A document of more than four times the item's words is looked at in stretches of that
    size, which overlap by half, so a group's size depends on the item alone.
    """
    spark = documents.sparkSession
    made = cut(item_windows(items, key, item_text))
    known = made.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.least("words", F.lit(WINDOW))).alias("lengths"), F.min("words").alias("least")).first()
    if not known.n:
        return spark.createDataFrame([], _RESULT)
    hits = cut(document_hits(documents, doc, text, bit_table(made, known.n), sorted(known.lengths), known.least))
    joined = hits.join(F.broadcast(made) if known.n <= broadcast_windows else made, "h")
    half = F.floor(F.col("q") / (2 * F.col("words"))).cast("int")
    parts = F.when(F.col("n") <= 4 * F.col("words"), F.array(F.lit(0))).otherwise(F.array(half, half - 1))
    pair = ["row", "doc_id", "item_id", "words", "stretch", "part"]
    joined = joined.withColumn("part", F.explode(parts))
    shown = joined.groupBy(*pair).agg(F.bit_or("cover").alias("cover"))
    likely = cut(shown.filter(may_hold_a_run(F.col("cover"), F.col("words"))).drop("cover"))
    few = likely.count() <= broadcast_windows
    hit = F.struct("q", "doc_gap", "p", "item_gap", F.array(*_SLOTS).alias("a"), F.array(*(f"i{i}" for i in range(WINDOW))).alias("b"))
    # chaining is slow for its few bytes, so its tasks are not merged by their size
    kept = joined.join(F.broadcast(likely) if few else likely, pair, "left_semi").repartition(partitions(spark), "row", "item_id")
    grouped = kept.groupBy(*pair).agg(F.collect_list(hit).alias("hits"))
    run = F.struct(*_RESULT_NAMES[2:])
    best = runs_of(grouped).groupBy("row", "doc_id", "item_id").agg(F.max(run).alias("run"))
    return best.select("doc_id", "item_id", "run.*")
