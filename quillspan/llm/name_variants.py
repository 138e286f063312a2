"""Variant spellings of names typed by people, linked to the body or person meant.

Method: every name is rewritten to its canonical forms by rules - slips of single words undone
against the words of all names, abbreviations and nicknames written out, initials formed, legal
forms and titles dropped, word order removed.  Forms are exploded and joined by equality; a form
links two names as strongly as it is rare, that is, as few different full names share it.  No
pair of names is ever compared with another outside a form they share.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.llm.canonical_map import slips
from quillspan.session import cut

#: Words written short in names of bodies.
SHORT_FORMS = {
    "inst": "institute", "univ": "university", "uni": "university", "met": "metropolitan", "metro": "metropolitan",
    "hosp": "hospital", "hosps": "hospital", "hospitals": "hospital", "cncl": "council", "cnty": "county",
    "clin": "clinical", "ctu": "clinical trials unit", "icb": "integrated care board", "integ": "integrated",
    "bd": "board", "comm": "community", "ft": "foundation trust", "tr": "trust", "biosci": "biosciences",
    "res": "research", "dept": "department", "dep": "department", "saint": "st", "analytic": "analytics",
    "ltd": "limited", "co": "company", "corp": "corporation", "assoc": "association", "soc": "society",
    "natl": "national", "intl": "international", "ctr": "centre", "center": "centre", "svc": "service",
}
#: Words that do not tell one body from another, legal forms among them.
UNTELLING = frozenset("the of for and in at on a an limited plc llp llc inc gmbh company trust foundation nhs charity".split())
#: Words that only bodies have in their names.
BODY_WORDS = frozenset(
    "university institute hospital infirmary hospice unit trust council board analytics biosciences limited plc department centre college school "
    "foundation charity company group society association agency ministry nhs research clinic surgery laboratory laboratories pharma health care "
    "corporation service services partnership authority network consortium office bureau academy library museum press union federation".split()
)
#: Forms of address.
TITLES = frozenset("dr prof professor mr mrs ms miss sir dame lord lady rev doctor".split())
#: Familiar forms of given names.
NICKNAMES = {
    "alec": "alexander", "alex": "alexander", "al": "alan", "andy": "andrew", "beth": "elizabeth", "liz": "elizabeth", "lizzie": "elizabeth",
    "bill": "william", "will": "william", "bob": "robert", "rob": "robert", "bobby": "robert", "chris": "christine christopher", "dan": "daniel",
    "dave": "david", "deb": "deborah", "debbie": "deborah", "dick": "richard", "rich": "richard", "ed": "edward", "ned": "edward", "ted": "edward",
    "fred": "frederick", "geoff": "geoffrey", "harry": "henry harold", "jack": "john", "jim": "james", "jimmy": "james", "joe": "joseph",
    "kate": "katherine", "kathy": "katherine", "katie": "katherine", "larry": "laurence", "maggie": "margaret", "meg": "margaret", "peggy": "margaret",
    "matt": "matthew", "mick": "michael", "mike": "michael", "nick": "nicholas", "pat": "patricia patrick", "patty": "patricia", "pete": "peter",
    "phil": "philip", "becky": "rebecca", "becca": "rebecca", "ron": "ronald", "sam": "samuel samantha", "sandy": "alexander sandra", "steve": "steven",
    "sue": "susan", "trish": "patricia", "tricia": "patricia", "patsy": "patricia", "charlie": "charles", "frank": "francis",
    "cathy": "catherine katherine", "libby": "elizabeth", "betty": "elizabeth", "chrissie": "christine", "tina": "christine", "jenny": "jennifer",
    "jen": "jennifer", "jess": "jessica", "ken": "kenneth", "greg": "gregory", "jeff": "jeffrey", "ben": "benjamin", "doug": "douglas", "ray": "raymond",
    "mandy": "amanda", "angie": "angela", "terry": "terence theresa", "jerry": "gerald jeremy", "maddie": "madeleine", "susie": "susan", "tim": "timothy", "tom": "thomas", "tony": "anthony", "val": "valerie", "vicky": "victoria", "vic": "victor",
}
_KNOWN = frozenset(SHORT_FORMS) | {w for v in SHORT_FORMS.values() for w in v.split()} | UNTELLING | BODY_WORDS | TITLES | frozenset(NICKNAMES)

#: A word is taken for a slip of another that this many times as many names hold; two slips
#: ask for more, as words of names that differ in two letters are often both meant.
RARER, MUCH_RARER = 3, 15
#: Words shorter than the first are never changed; from the second on, two slips are undone.
LEAST_WORD, TWO_SLIPS = 4, 8
#: Whole forms shorter than this are never taken for one another.
LEAST_FORM = 14

_TOKEN = re.compile(r"[^\W_]+|[(),]")


def tokens(name: str) -> list[str]:
    """Words in lower case without accents; a comma, and a bracket before a short bracketed word
    (``(ctu``), are kept as they tell something about the order."""
    text = unicodedata.normalize("NFKD", name).casefold()
    text = "".join(c for c in text if not unicodedata.combining(c))
    text = re.sub(r"['’‘`´]", "", text)
    text = re.sub(r"\b(?:\w\.){2,}(?:\w\b)?", lambda m: m[0].replace(".", "") + " ", text)
    text = re.sub(r"(?<=\w)[-‐‑](?=\w)", "", text)
    out: list[str] = []
    found = _TOKEN.findall(text.replace("[", "(").replace("]", ")").replace("&", " and "))
    i = 0
    while i < len(found):
        t = found[i]
        if t == "(" and i + 2 < len(found) and found[i + 2] == ")" and len(found[i + 1]) <= 6:
            out.append("(" + found[i + 1])
            i += 3
            continue
        if t not in "()":
            out.append(t)
        i += 1
    while out and out[-1] == ",":
        out.pop()
    return out


def written_out(words: list[str]) -> list[str]:
    out: list[str] = []
    for i, w in enumerate(words):
        after = words[i + 1] if i + 1 < len(words) else ""
        if w == "u" and after == "of":
            out.append("university")
        elif w == "r" and "infirmary" in words:
            out.append("royal")
        else:
            out.extend(SHORT_FORMS.get(w, w).split())
    return out


def _spelt(code: str, words: list[str]) -> bool:
    """A bracketed code made of the words' first letters, but for one or two of words left out."""
    left = Counter(code) - Counter(w[0] for w in words if w != ",")
    return sum(left.values()) <= (1 if len(code) <= 4 else 2)


def rewritings(words: list[str]) -> list[str]:
    """The canonical forms of a name given as tokens, fullest first.

    ``b:`` forms name a body, ``p:`` forms a person in full, ``i:`` forms a person by an initial.
    A name without any word has none.
    """
    codes = [w[1:] for w in words if w[0] == "("]
    plain = written_out([w for w in words if w[0] != "("])
    for code in codes:
        if code not in UNTELLING and not _spelt(code, plain):
            plain += written_out([code])
    letters = [w for w in plain if w != ","]
    if not letters:
        return []
    if any(w in BODY_WORDS for w in letters) or len([w for w in letters if w not in TITLES]) > 3:
        if "department" in letters and "university" in letters:  # a department stands for its university
            parts = " ".join(plain).split(" , ")
            whole = [p for p in parts if "university" in p.split()]
            if len(parts) > 1 and whole:
                letters = whole[0].split()
            else:
                i = letters.index("department")
                letters = [w for j, w in enumerate(letters) if not i <= j <= i + 2]
        core = sorted({w for w in letters if w not in UNTELLING}) or sorted(set(letters))
        return ["b:" + " ".join(core)]
    named = [w for w in plain if w not in TITLES]
    if "," in named:  # family name first
        i = named.index(",")
        named = [w for w in named[i + 1 :] + named[:i] if w != ","]
    full = [w for w in named if len(w) > 1]
    first = [w for w in named if len(w) == 1]
    if not full:
        return ["b:" + " ".join(sorted(named))] if named else ["b:" + " ".join(sorted(letters))]
    if len(full) == 1:
        return [f"i:{first[0]} {full[0]}"] if first else [f"p:{full[0]}"]
    ways = list(product(*[NICKNAMES.get(w, w).split() for w in full]))
    out = ["p:" + " ".join(sorted(way)) for way in ways]
    for way in ways:
        out += [f"i:{a[0]} {b}" for a in way for b in way if a is not b]
    return list(dict.fromkeys(out))


def shortened(word: str) -> list[str]:
    """The word and what is left of it after one letter or, in a long word, two are struck out."""
    if len(word) < LEAST_WORD or not word.isalpha():
        return []
    one = {word[:i] + word[i + 1 :] for i in range(len(word))}
    two = {w[:i] + w[i + 1 :] for w in one for i in range(len(w))} if len(word) >= TWO_SLIPS else set()
    return [word, *sorted(one | two)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _tokens(names: pd.Series) -> pd.Series:
    return names.map(lambda n: tokens(n) if n is not None else [])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _shortened(words: pd.Series) -> pd.Series:
    return words.map(shortened)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _struck(forms: pd.Series) -> pd.Series:
    """A form, and what is left of it after one letter of a word is struck out."""
    return forms.map(lambda f: sorted({f} | {f[:i] + f[i + 1 :] for i in range(2, len(f)) if f[i] != " "}) if len(f) >= LEAST_FORM else [])


@F.pandas_udf(T.IntegerType())
def _slips(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([slips(x, y, 2 if min(len(x), len(y)) >= TWO_SLIPS else 1) for x, y in zip(a, b, strict=True)], dtype="int32")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _rewritings(words: pd.Series) -> pd.Series:
    return words.map(lambda w: rewritings([x for x in w if x]))


def slip_table(words: DataFrame) -> DataFrame:
    """``word, meant``: words that are slips of one found in RARER times as many names.

    ``words`` has one row per name and word.  Words meet by what is left of them after letters
    are struck out, so only near words meet.  Of several meant words the nearest wins, then the
    one in most names, then the first in the alphabet.
    """
    spark = words.sparkSession
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("word").rlike("^[a-z]+$") & (F.length("word") >= LEAST_WORD))
    left = counts.withColumn("rest", F.explode(_shortened("word")))
    rare = left.filter(~F.col("word").isin(*sorted(_KNOWN))).select(F.col("word").alias("word"), F.col("n").alias("n"), "rest")
    often = left.filter(f"n >= {RARER}").select(F.col("word").alias("meant"), F.col("n").alias("m"), "rest")
    listed = spark.createDataFrame([(w,) for w in sorted(BODY_WORDS) if len(w) >= 6], "meant string").select("meant", F.lit(1 << 40).alias("m"), F.explode(_shortened("meant")).alias("rest"))
    near = rare.join(often.unionByName(listed), "rest").filter(f"word <> meant and m >= {RARER} * n").groupBy("word", "meant").agg(F.max("m").alias("m"), F.max("n").alias("n")).withColumn("d", _slips("word", "meant"))
    long = (F.length("word") >= TWO_SLIPS) & (F.length("meant") >= TWO_SLIPS)
    likely = near.filter((F.col("d") == 1) | (F.col("d") == 2) & long & (F.col("m") >= MUCH_RARER * F.col("n")))
    best = likely.groupBy("word").agg(F.min_by("meant", F.struct("d", (-F.col("m")).alias("m"), "meant")).alias("meant"))
    onward = best.select(F.col("word").alias("meant"), F.col("meant").alias("further"))  # a common slip has slips of its own
    return best.join(onward, "meant", "left").select("word", F.coalesce("further", "meant").alias("meant"))


def link_names(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``<key>, entity, rarity``: one row per row of ``rows``; rows with the same ``entity`` name
    the same body or person.

    ``rarity`` is the number of names that share the linking form, the rarer the stronger: for a name
    in full the names that are rewritten to it, for one known by an initial the bodies or persons
    it may stand for; the latter is linked only if that is 1, else it stands with the names written
    alike.
    Names that are null or have no letter or digit stand alone.  Repeated rows share their
    entity.  Every name is compared through all its forms; nothing is capped.
    """
    given = rows.select(F.col(key).alias("id"), F.col(name).alias("name"))
    words = given.select("id", F.posexplode(_tokens("name")).alias("pos", "word"))
    meant = cut(slip_table(words.select("id", "word").distinct()))
    settled = words.join(meant, "word", "left").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("meant", "word").alias("word")))).alias("w"))
    forms = settled.select("id", _rewritings("w.word").alias("forms"))
    each = cut(forms.select("id", F.posexplode("forms").alias("no", "form")))
    full = each.filter("form not like 'i:%'")
    # names that may be read in several ways take the reading most names share
    support = cut(full.groupBy("form").agg(F.count(F.lit(1)).alias("n")))
    read = full.join(support, "form").groupBy("id").agg(F.max_by(F.struct("form", "n"), F.struct("n", (-F.col("no")).alias("no"))).alias("e")).select("id", "e.form", "e.n")
    # a form that one name alone has, and that is one slip away from a form of several, or of one
    lone = read.filter("n = 1").select("form", F.explode(_struck("form")).alias("rest"))
    shared = support.select(F.col("form").alias("meant"), "n", F.explode(_struck("form")).alias("rest"))
    slip = lone.join(shared, "rest").filter("n > 1 or meant < form").select("form", "meant", "n").distinct().filter(_slips("form", "meant") == 1).groupBy("form").agg(F.min_by("meant", F.struct((-F.col("n")).alias("n"), "meant")).alias("meant"))
    slip = slip.join(support.select(F.col("form").alias("meant"), F.col("n").alias("meant_n")), "meant")
    entity = cut(read.join(slip, "form", "left").select("id", F.coalesce("meant", "form").alias("entity"), F.coalesce("meant_n", "n").alias("rarity")))
    # what an initial may stand for
    initials = each.filter("form like 'i:%'")
    owners = initials.join(entity.drop("rarity"), "id").groupBy("form").agg(F.countDistinct("entity").alias("rarity"), F.min("entity").alias("owner"))
    alone = initials.join(entity, "id", "left_anti").join(owners, "form", "left")
    short = alone.select("id", F.when(F.col("rarity") == 1, F.col("owner")).otherwise(F.col("form")).alias("entity"), F.coalesce("rarity", F.lit(0)).alias("rarity"))
    named = entity.unionByName(short)
    return given.join(named, "id", "left").select(F.col("id").alias(key), F.coalesce("entity", F.concat(F.lit("?:"), F.col("id").cast("string"))).alias("entity"), F.coalesce("rarity", F.lit(0)).alias("rarity"))


def pairs_of(classes: DataFrame, key: str, by: str) -> DataFrame:
    """``<key>_a, <key>_b`` (a < b): all pairs of a class, where a result must state them."""
    a, b = classes.select(F.col(key).alias(f"{key}_a"), by), classes.select(F.col(key).alias(f"{key}_b"), by)
    return a.join(b, by).filter(F.col(f"{key}_a") < F.col(f"{key}_b")).select(f"{key}_a", f"{key}_b")
