"""Mapping freely typed values to the closest entry of a reference list.

Method: an Aho-Corasick automaton over the canonical names and the aliases derived from them
finds the mentions embedded in a value; the longest non-overlapping mentions win and together
name the entry.  Before matching, words are brought to the list's own words where they are a
slip of the keyboard or a shortening of one.  Values in which no mention is found go to a
token-set similarity against the whole list; below its threshold a value is reported as
unmatched.

The list is bounded (checked), so its automaton is sent to every executor and the mapping is
one pass over the rows without a shuffle.  A batch works on its distinct values only.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A reference list may hold this many entries; the automaton must fit every executor.
MOST_ENTRIES = 200_000

#: Token-set similarity from which a value without a mention is taken for an entry.
LEAST_SIMILARITY = 0.65
#: Values whose match a worker remembers.
MOST_KEPT = 100_000

#: Words that say nothing about which data set is meant.
NOISE = frozenset(
    "the a an of for and at in data dataset datasets set ds extract standard bespoke annual monthly refresh renewal new version v file table from".split()
)

_WORD = re.compile(r"[^\W_]+")
_BRACKETS = re.compile(r"^(.*?)\s*[(\[]([^()\[\]]+)[)\]]\s*$")


def words(text: str) -> list[str]:
    """Lower-case words after compatibility folding; every other character separates."""
    return _WORD.findall(unicodedata.normalize("NFKC", text).casefold())


def slips(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours, or ``most + 1`` if it is greater than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def shortens(short: str, word: str) -> bool:
    """``short`` abbreviates ``word``: a prefix of three letters or more, or the word's first
    letter and others in their order, up to its last or all of them consonants."""
    if len(short) >= len(word) or len(short) < 2:
        return False
    if word.startswith(short):
        return len(short) >= 3
    if len(short) < 3 or short[0] != word[0] or (short[-1] != word[-1] and set(short) & set("aeiou")):
        return False
    rest = iter(word)
    return all(c in rest for c in short)


class NearWords:
    """The words of a list by length, with how often they hold each letter, so that the words within
    a few slips of another are sought among those whose letters are as near."""

    def __init__(self, words: list[str]):
        by: dict[int, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            by[len(w)].append(i)
        self.words = words
        self.by_length = {n: (np.array(at), np.stack([self.letters(words[i]) for i in at])) for n, at in by.items()}

    @staticmethod
    def letters(word: str) -> np.ndarray:
        return np.bincount([ord(c) % 32 for c in word], minlength=32).astype(np.int16)

    def within(self, word: str, most: int) -> list[str]:
        """The words of which ``most`` slips may make ``word``, in the list's order; no such word is missed."""
        own, found = self.letters(word), []
        for n in range(max(1, len(word) - most), len(word) + most + 1):
            if n in self.by_length:
                at, letters = self.by_length[n]
                apart = np.abs(letters - own).sum(axis=1)  # one slip changes two letters' counts at most
                found += at[apart <= 2 * most].tolist()
        return [self.words[i] for i in sorted(found)]


class ReferenceList:
    """Entries, the aliases derived from them, and the automaton over both."""

    def __init__(self, entries: list[tuple[int, str]]):
        import ahocorasick

        self.entries = sorted(entries)
        self.parts: dict[int, tuple[tuple[str, ...], tuple[str, ...]]] = {}
        for key, name in self.entries:
            m = _BRACKETS.match(name)
            self.parts[key] = (tuple(words(m[1] if m else name)), tuple(words(m[2])) if m else ())
        by_name = {long: key for key, (long, _) in self.parts.items()}
        aliases: dict[tuple[str, ...], set[int]] = defaultdict(set)
        self.extra: dict[int, tuple[str, ...]] = {}
        self.base: dict[int, int] = {}
        for key, (long, short) in self.parts.items():
            stem = next((long[:n] for n in range(len(long) - 1, 0, -1) if long[:n] in by_name), None)
            forms = {long, short, long + short, short + long}
            if stem:  # a variant of another entry: its own words may stand before or after either name
                self.base[key] = by_name[stem]
                self.extra[key] = extra = long[len(stem) :]
                code = self.parts[by_name[stem]][1]
                tail = short[len(code) :] if short[: len(code)] == code else ()
                for head in filter(None, (stem, code, stem + code, code + stem)):
                    for end in filter(None, (extra, tail)):
                        forms |= {head + end, end + head}
                for head in filter(None, (code, short)):
                    forms |= {head + long, long + head}
            for form in forms - {()}:
                aliases[form].add(key)
        self.aliases = {form: min(keys) for form, keys in aliases.items() if len(keys) == 1}
        count = Counter(w for long, _ in self.parts.values() for w in set(long))
        self.vocabulary = sorted(count, key=lambda w: (-count[w], w))
        self.codes = {w for _, short in self.parts.values() for w in short}
        self.known = frozenset(self.vocabulary)
        self.near = NearWords([w for w in self.vocabulary if len(w) >= 4])
        self.holding: dict[str, list[int]] = defaultdict(list)
        for key, (long, _) in self.parts.items():
            for w in set(long) - NOISE:
                self.holding[w].append(key)
        self.by_first: dict[str, list[str]] = defaultdict(list)
        for w in self.vocabulary:
            self.by_first[w[0]].append(w)
        self.machine = ahocorasick.Automaton()
        for form, key in self.aliases.items():
            self.machine.add_word(f" {' '.join(form)} ", (len(form), key))
        self.machine.make_automaton()
        self.tails: dict[tuple[str, ...], set[int]] = defaultdict(set)
        for key, extra in self.extra.items():
            self.tails[extra].add(key)
        self.fixed: dict[str, str] = {}
        self.soft: dict[str, dict[str, float]] = {}
        self.seen: dict[str, tuple[int, str, float]] = {}

    def settle(self, word: str) -> str:
        """The list's own word that ``word`` stands for, or ``word`` itself."""
        if word not in self.fixed:
            if len(self.fixed) >= MOST_KEPT:
                self.fixed.clear()
            self.fixed[word] = self._settle(word)
        return self.fixed[word]

    def _settle(self, word: str) -> str:
        if word in self.codes or word in NOISE or any(c.isdigit() for c in word) or len(word) < 3:
            return word
        if word in self.known:
            return word
        near = []
        for w in self.near.within(word, 3) if len(word) >= 4 else ():
            allowed = 1 if len(w) < 6 else 2 if len(w) < 9 else 3
            d = slips(word, w, allowed)
            if d <= allowed:
                near.append((d, w[0] != word[0], w))
        short = [w for w in self.by_first[word[0]] if shortens(word, w)]
        if near and (min(near)[0] == 1 or not short):
            return min(near)[2]
        prefix = [w for w in short if w.startswith(word)]
        return min(prefix or short, key=len) if short else word

    def mentions(self, tokens: list[str]) -> list[tuple[int, int, int]]:
        """Longest non-overlapping mentions: (first token, tokens, entry), longest first."""
        if not self.aliases:
            return []
        text = f" {' '.join(tokens)} "
        starts = {}
        at = 0
        for i, t in enumerate(tokens):
            starts[at] = i
            at += len(t) + 1
        found = []
        for end, (n, key) in self.machine.iter(text):
            form_at = text.rfind(" ", 0, end)
            for _ in range(n - 1):
                form_at = text.rfind(" ", 0, form_at)
            found.append((-n, starts[form_at], key))
        taken: set[int] = set()
        kept = []
        for n, first, key in sorted(found):
            span = range(first, first - n)
            if taken.isdisjoint(span):
                taken.update(span)
                kept.append((first, -n, key))
        return kept

    def match(self, value: str) -> tuple[int, str, float]:
        """(entry or 0, how: ``mention``, ``similar`` or ``none``, similarity)."""
        if value not in self.seen:
            if len(self.seen) >= MOST_KEPT:
                self.seen.clear()
            self.seen[value] = self._match(value)
        return self.seen[value]

    def _match(self, value: str) -> tuple[int, str, float]:
        tokens = [self.settle(w) for w in words(value)]
        kept = self.mentions(tokens)
        if kept:
            key = self._combined(tokens, kept)
            return key, "mention", 1.0
        return self._similar(words(value))

    def _combined(self, tokens: list[str], kept: list[tuple[int, int, int]]) -> int:
        """One entry for several mentions: of an entry and its variants the variant is meant; words
        of a variant left over beside its base name that variant."""
        keys = {key for _, _, key in kept}
        general = {self.base.get(k, k) for k in keys}
        if len(general) == 1:
            best = max(keys, key=lambda k: (k in self.extra, -k))
            if best in self.extra:
                return best
            covered = {i for first, n, _ in kept for i in range(first, first + n)}
            left = [t for i, t in enumerate(tokens) if i not in covered]
            told = set(left) - NOISE
            options = [(len(told & set(extra)) / len(extra), len(extra), -k) for extra, ks in self.tails.items() if told & set(extra) for k in ks if self.base[k] == best]
            return -max(options)[2] if options and max(options)[0] >= 0.5 else best
        return min(kept, key=lambda m: (-m[1], m[0]))[2]

    def _near(self, word: str) -> dict[str, float]:
        """The list's words near ``word``, each with how near: 1 is the word itself."""
        if word not in self.soft:
            if len(self.soft) >= MOST_KEPT:
                self.soft.clear()
            near = {word: 1.0} if word in self.known else {}
            if len(word) >= 4 and not near:
                for w in self.near.within(word, max(2, len(word) // 3)):
                    allowed = 1 if min(len(w), len(word)) < 5 else max(2, min(len(w), len(word)) // 3)
                    d = slips(word, w, allowed)
                    if d <= allowed:
                        near[w] = 1 - d / max(len(w), len(word))
                for w in self.by_first[word[0]]:
                    if shortens(word, w):
                        near[w] = max(near.get(w, 0), 0.7)
            self.soft[word] = near
        return self.soft[word]

    def _similar(self, given: list[str]) -> tuple[int, str, float]:
        """Token sets compared: a word counts by how near it is to the entry's own.  Only entries that
        hold a word near one of the value's are looked at; all others have nothing in common."""
        told = [t for t in dict.fromkeys(given) if t not in NOISE and t not in self.codes and not any(c.isdigit() for c in t)]
        best = (0.0, 0)
        nearest: dict[str, float] = {}
        for t in told:
            for w, how in self._near(t).items():
                nearest[w] = max(nearest.get(w, 0.0), how)
        for key in sorted({k for w in nearest for k in self.holding.get(w, ())}):
            own = set(self.parts[key][0]) - NOISE
            same = [nearest.get(w, 0.0) for w in own]
            score = 2 * sum(same) / (len(own) + len(told))
            if (score, -key) > (best[0], -best[1]):
                best = (score, key)
        return (best[1], "similar", best[0]) if best[0] >= LEAST_SIMILARITY else (0, "none", best[0])


def load_list(entries: DataFrame, key: str, name: str) -> ReferenceList:
    """A reference list of at most MOST_ENTRIES entries; more is an error, never a sample."""
    rows = entries.select(F.col(key).cast("long").alias("k"), F.col(name).alias("v")).filter("k is not null and v is not null").limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"the reference list has more than {MOST_ENTRIES} entries")
    return ReferenceList([(r.k, r.v) for r in rows])


def map_to_list(rows: DataFrame, value: str, entries: DataFrame, key: str = "dataset_id", name: str = "dataset_name") -> DataFrame:
    """``rows`` with ``entry_id`` (0: the list has none), ``match_kind`` and ``similarity``.

    A value that is an entry character by character is ``exact``.  Null and blank values are
    ``blank`` with entry 0.  Repeated rows are each mapped; ties between entries go to the
    smaller id; an empty list maps everything to 0.  Values are read whole.
    """
    listed = load_list(entries, key, name)
    exact = {v: k for k, v in reversed(listed.entries)}
    sent = rows.sparkSession.sparkContext.broadcast((listed.entries, exact))
    cache: list[ReferenceList] = []

    @F.pandas_udf("entry_id long, match_kind string, similarity double")
    def mapped(values: pd.Series) -> pd.DataFrame:
        if not cache:
            cache.append(ReferenceList(sent.value[0]))
        memo = {}
        for v in values.unique():
            if v is None or not v.strip():
                memo[v] = (0, "blank", 0.0)
            elif v in sent.value[1]:
                memo[v] = (sent.value[1][v], "exact", 1.0)
            else:
                memo[v] = cache[0].match(v)
        return pd.DataFrame([memo[v] for v in values], columns=["entry_id", "match_kind", "similarity"])

    return rows.withColumn("__m", mapped(F.col(value))).select("*", "__m.*").drop("__m")
