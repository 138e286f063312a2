"""Abusive, hateful or sexual content, scored per document.

Method: a weighted lexicon of words and phrases is matched by an Aho-Corasick automaton in text
folded so that look-alike letters, digits and signs in place of letters, stretched and spaced-out
words and masked letters read as the word meant.  Classes of terms near each other make up the
lexicon's patterns.  Phrases of the exception list take out what they cover, quoted speech is not
the document's own, and length is set off by scoring stretches: a sentence counts as its worst
forty words, a document as its worst sentence, so nothing is diluted by the text around it.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.abuse_lexicon import DEFAULT, Lexicon
from quillspan.llm.lookalike import canonical_batch

#: A document scores at or above this if it is a case.
THRESHOLD = 1.0
#: Words of the stretches that are scored.
STRETCH = 40
#: Sentences and tokens whose reading a worker remembers.
MOST_KEPT = 100_000

#: Characters written in place of letters.
IN_PLACE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "$": "s", "@": "a", "!": "i", "€": "e", "£": "l", "|": "l"})
#: Classes of single words that are written in disguise.
DISGUISED = ("insult", "swear", "explicit", "mild", "mild noun", "sensual", "beast", "violent", "purge", "expel")

_SENTENCE = re.compile(r"(?<=[.!?;])\s+|\n+")
_QUOTED = re.compile(r"(?<![^\s(\[,:;–—-])[\"“«][^\"“”«»\n]+[\"”»](?![^\W_])")
_SPACED = re.compile(r"(?<![^\W_])(?:(?:[^\W\d_][ .\-_*]){3,}[^\W\d_]{2}|(?:[^\W\d_][ .\-_*]){2,}[^\W\d_])(?![^\W_])")
_TOKEN = re.compile(r"[^\s,;:()\"“”«»?]+")
_MASKED = re.compile(r"^([a-z]+)([*#_]{2,})([a-z]+)$|^([a-z])([*#_]{2,})$")
_STRETCHED = re.compile(r"(.)\1+")


def squeezed(word: str) -> str:
    """Without doubled letters, so a stretched word reads as the word."""
    return _STRETCHED.sub(r"\1", word)


class Scorer:
    """A lexicon's automaton and patterns, and what a worker has read with them."""

    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        terms: dict[str, set[tuple[str, str]]] = defaultdict(set)
        for kind, listed in (*lexicon.classes.items(), ("", lexicon.exceptions)):
            for p in filter(None, listed.split("|")):
                terms[" ".join(squeezed(w) for w in p.split())].add((kind, p))
        self.machine = ahocorasick.Automaton()
        for key, of in terms.items():
            self.machine.add_word(f" {key} ", (len(key.split()), sorted(of)))
        self.machine.make_automaton()
        self.patterns = [(name, lexicon.weights.get(name, w), kinds, gap) for name, w, kinds, gap in lexicon.patterns]
        #: Classes that say something where no other is near: without one of them nothing is looked at.
        self.telling = {kinds[0] for _, _, kinds, _ in lexicon.patterns if len(kinds) == 1} | {"mild", "mild noun", "taint", "lethal", "violent", "fate", "purge", "expel", "beast", "out", "violently"}
        self.alarm = ahocorasick.Automaton()
        for key, of in terms.items():
            if any(kind in self.telling for kind, _ in of):
                self.alarm.add_word(f" {key} ", True)
        self.alarm.make_automaton()
        self.masked: dict[tuple[int, str, str], list[str]] = defaultdict(list)
        self.plain: set[str] = set()
        for kind in DISGUISED:
            for w in (w for p in lexicon.classes.get(kind, "").split("|") for w in p.split()):
                if len(w) >= 4 or kind.startswith("mild"):
                    self.plain.add(squeezed(w))
                if len(w) >= 4 and kind != "beast" and w not in self.masked[len(w), w[0], w[-1]]:
                    self.masked[len(w), w[0], w[-1]].append(w)
        self.read_as = lru_cache(MOST_KEPT)(self._read_as)
        self.score = lru_cache(MOST_KEPT)(self._score)

    def _read_as(self, token: str) -> tuple[str, ...]:
        """The words that a token reads as, squeezed."""
        t = token.strip(".!-–—'’…")
        return (squeezed(t),) if t.isalpha() else tuple(map(squeezed, self._unmasked(t)))

    def _unmasked(self, t: str) -> list[str]:
        m = _MASKED.match(t)
        if m:  # letters masked by signs
            if m[1]:
                found = [w for w in self.masked.get((len(t), t[0], t[-1]), ()) if w.startswith(m[1]) and w.endswith(m[3])]
            else:
                found = [w for (n, first, _), ws in self.masked.items() if n == len(t) and first == t[0] for w in ws]
            return found[:1] or [t.replace("*", "")]
        if any(c.isalpha() for c in t) and any(c in "013457$@!€£|8" for c in t):
            swapped = re.sub(r"[^a-z]", "", t.translate(IN_PLACE))
            if squeezed(swapped) in self.plain:
                return [swapped]
        return re.findall(r"[^\W_]+", t.replace("'", "").replace("’", ""))

    def folded(self, sentence: str) -> list[str]:
        """The words of a sentence as they are meant, lower-case and squeezed."""
        s = _SPACED.sub(lambda m: re.sub(r"[ .\-_*]", "", m[0]), sentence.casefold())
        return [w for t in _TOKEN.findall(s) for w in self.read_as(t)]

    def _score(self, sentence: str) -> tuple[float, tuple[str, ...], tuple[str, ...]]:
        """(score, terms matched, patterns matched) of the worst stretch of one sentence."""
        words = self.folded(sentence)
        text = f" {' '.join(words)} "
        if next(self.alarm.iter(text), None) is None:
            return 0.0, (), ()
        found = list(self.machine.iter(text))
        hits, spans = [], []
        for end, (n, of) in found:
            last = text.count(" ", 0, end)  # words before the term's end
            for kind, term in of:
                (hits if kind else spans).append((last - n, last, kind, term))
        hits = sorted({h for h in hits if not any(a <= h[0] and h[1] <= b for a, b, *_ in spans)})
        if not any(h[2] in self.telling for h in hits):
            return 0.0, (), ()
        if len(words) <= STRETCH:
            return self._stretch(hits)
        return max((self._stretch([h for h in hits if a <= h[0] and h[1] <= a + STRETCH]) for a in {h[0] for h in hits}), default=(0.0, (), ()))

    def _stretch(self, hits: list[tuple[int, int, str, str]]) -> tuple[float, tuple[str, ...], tuple[str, ...]]:
        by: dict[str, list[tuple[int, int, str]]] = defaultdict(list)
        for a, b, kind, term in hits:
            by[kind].append((a, b, term))
        score, terms, names = 0.0, set(), []
        for name, weight, kinds, gap in self.patterns:
            if not all(k in by for k in kinds):
                continue
            chains = [(h,) for h in by[kinds[0]]]
            for k in kinds[1:]:
                chains = [(*c, h) for c in chains for h in by[k] if 0 <= h[0] - c[-1][1] <= gap]
                chains = list({(c[0], c[-1]): c for c in chains}.values())
            if chains:
                several = len({c[0][2] for c in chains}) if len(kinds) == 1 else 1
                score += weight * several
                names.append(name)
                terms.update(h[2] for c in chains for h in c)
        return round(score, 6), tuple(sorted(terms)), tuple(names)

    def document(self, text: str) -> tuple[float, int, list[str], list[str]]:
        """(score of the worst sentence, sentences that are cases, terms and patterns matched in them)."""
        worst, n, terms, names = 0.0, 0, set(), set()
        text = html.unescape(text) if "&" in text else text
        own = _QUOTED.sub(" ", text)
        if not re.search(r"[^\W_]", own):  # a quoted whole is what the document says
            own = text
        for s in _SENTENCE.split(own):
            if s:
                score, what, which = self.score(s)
                worst = max(worst, score)
                if score >= THRESHOLD:
                    n += 1
                    terms.update(what)
                    names.update(which)
        return worst, n, sorted(terms), sorted(names)


def score_documents(documents: DataFrame, text: str = "text", lexicon: Lexicon = DEFAULT) -> DataFrame:
    """``documents`` with ``abuse_score`` (0 for null and empty texts), ``abusive_sentences``,
    ``abuse_terms``, ``abuse_patterns`` and ``abusive`` (score at or above THRESHOLD).

    One pass over the rows, no shuffle.  Whole texts are read; repeated rows score alike.
    """

    made: list[Scorer] = []

    @F.pandas_udf("abuse_score double, abusive_sentences int, abuse_terms array<string>, abuse_patterns array<string>")
    def scored(texts: pd.Series) -> pd.DataFrame:
        if not made:
            made.append(Scorer(lexicon))
        given = [t or "" for t in texts]
        other = [i for i, t in enumerate(given) if not t.isascii()]  # ASCII is its own one form
        for i, t in zip(other, canonical_batch(pa.array([given[i] for i in other], pa.large_string())).to_pylist() if other else [], strict=True):
            given[i] = t
        rows = [made[0].document(t) if t else (0.0, 0, [], []) for t in given]
        return pd.DataFrame(rows, columns=["abuse_score", "abusive_sentences", "abuse_terms", "abuse_patterns"])

    return documents.withColumn("__a", scored(F.col(text))).select("*", "__a.*").drop("__a").withColumn("abusive", F.col("abuse_score") >= THRESHOLD)


def source_rates(scored: DataFrame, source: str = "source") -> DataFrame:
    """``source, documents, abusive_documents, abusive_share`` per source; null is a source."""
    return scored.groupBy(F.col(source).alias("source")).agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if("abusive").alias("abusive_documents"),
        F.round(F.avg(F.col("abusive").cast("double")), 6).alias("abusive_share"),
    )
