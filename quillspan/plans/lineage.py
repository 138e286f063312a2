"""Succession of organisations: names to bodies, dated edges, and how two names are related.

Inputs are small reference tables as DataFrames:
``codes(name, code, as_ccg)``, ``bodies(code, name, icb, roles array<struct<id, start>>,
successors array<struct<code, date>>, predecessors array<struct<code, date>>)``,
``aliases(variant, canonical)`` and ``successions(was, now, date)``.  None is assumed to be small
enough to broadcast; Spark decides by size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.text import name_key
from quillspan.session import cut

#: The roles of a body that matter, and the hops a succession may take.
CCG, SUB_ICB_LOCATION, MOST_HOPS = "RO98", "RO319", 6
#: Legal forms that do not tell two names apart.
FORMS = r"(?:LIMITED|LTD|PLC|LLP|LLC|INC|INCORPORATED|CORP|CORPORATION)"


def bare(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def merge_reason(a: Column, b: Column) -> Column:
    """What alone tells two spellings of one name apart: ``letters`` (case, spacing, punctuation),
    ``bracket`` (one ends with one) or ``form`` (the legal form); null if something else does, so
    that somebody should look.  Names without letters and digits are nobody's."""
    unbracketed = lambda c: bare(F.regexp_replace(c, r"[(\[][^()\[\]]*[)\]]\s*$", ""))
    formless = lambda c: F.trim(F.regexp_replace(bare(c), rf"(?i)\b{FORMS}$", ""))
    levels = F.array(
        F.struct(F.lit("letters").alias("why"), (bare(a) == bare(b)).alias("holds")),
        F.struct(F.lit("bracket").alias("why"), ((unbracketed(a) == bare(b)) | (unbracketed(b) == bare(a))).alias("holds")),
        F.struct(F.lit("form").alias("why"), ((formless(a) == formless(b)) & (formless(a) != "")).alias("holds")),
    )
    return F.when((bare(a) != "") & (bare(b) != ""), F.get(F.filter(levels, lambda x: x["holds"]), 0)["why"])


def alias_groups(pairs: DataFrame) -> DataFrame:
    """``name, canonical`` of names tied by ``pairs(first, second)``: groups that share a name are
    one, the longest spelling stands for it (then the first in the alphabet).

    Each round gives a name the least label among its neighbours', and then the label of that
    label; rounds grow with the logarithm of the longest chain.
    """
    both = cut(pairs.select(F.col("first").alias("a"), F.col("second").alias("b")).union(pairs.select("second", "first")).filter("a <> b").distinct())
    label = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l")))
    while True:
        near = both.join(label.select(F.col("a").alias("b"), F.col("l").alias("nl")), "b").groupBy("a").agg(F.min("nl").alias("nl"))
        new = label.join(near, "a").select("a", "l", F.least("l", "nl").alias("m"))
        jump = new.join(label.select(F.col("a").alias("m"), F.col("l").alias("ll")), "m", "left")
        step = cut(jump.select("a", "l", F.least("m", F.coalesce("ll", "m")).alias("m")))
        done = step.filter("l <> m").isEmpty()
        label = step.select("a", F.col("m").alias("l"))
        if done:
            break
    best = label.groupBy("l").agg(F.min_by("a", F.struct(-F.length("a"), F.col("a"))).alias("canonical"))
    return label.join(best, "l").select(F.col("a").alias("name"), "canonical")


def resolved(names: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    """``names`` with ``key``: the key of what a reviewer says the name is, else its own."""
    rules = aliases.select(name_key(F.col("variant")).alias("__v"), name_key(F.col("canonical")).alias("__c"))
    own = names.withColumn("__own", name_key(F.col(name)))
    return own.join(rules, F.col("__own") == F.col("__v"), "left").withColumn("key", F.coalesce("__c", "__own")).drop("__v", "__c")


def nodes(names: DataFrame, name: str, codes: DataFrame, aliases: DataFrame, successions: DataFrame) -> DataFrame:
    """``names`` with ``node``: ``name:<key>`` where a reviewed succession speaks of it, else the
    body's ``ccg:<code>`` or ``org:<code>``; null if nothing is known."""
    r = resolved(names, name, aliases)
    said = resolved(successions, "was", aliases).select(F.col("key").alias("__s")).distinct()
    c = codes.select(name_key(F.col("name")).alias("__k"), F.concat(F.when(F.col("as_ccg"), "ccg:").otherwise("org:"), "code").alias("__n")).dropDuplicates(["__k"])
    # the canonical name of a group takes the code that any of its variants has
    lent = resolved(codes.select("name", "code", "as_ccg"), "name", aliases).filter("key <> __own").groupBy("key").agg(F.min(F.concat(F.when(F.col("as_ccg"), "ccg:").otherwise("org:"), F.col("code"))).alias("__l"))
    j = r.join(said, F.col("key") == F.col("__s"), "left").join(c, F.col("key") == F.col("__k"), "left").drop("__k").withColumnRenamed("__n", "__n1")
    j = j.join(lent.withColumnRenamed("key", "__lk"), F.col("key") == F.col("__lk"), "left").join(c, F.col("__own") == F.col("__k"), "left")
    node = F.when(F.col("__s").isNotNull(), F.concat(F.lit("name:"), F.col("key"))).otherwise(F.coalesce("__n1", "__l", "__n"))
    return j.withColumn("node", node).select(*names.columns, "key", "node")




def identities(bodies: DataFrame) -> DataFrame:
    """``node, identity`` of nodes that belong to another: a sub-location belongs to its board."""
    has = F.size(F.filter(F.coalesce("roles", F.array().cast("array<struct<id: string, start: string>>")), lambda r: r["id"] == SUB_ICB_LOCATION)) > 0
    return bodies.filter(has & (F.coalesce("icb", F.lit("")) != "")).select(F.concat(F.lit("org:"), "code").alias("node"), F.concat(F.lit("org:"), "icb").alias("identity"))


def _identified(df: DataFrame, node: str, ids: DataFrame) -> DataFrame:
    i = ids.select(F.col("node").alias("__i"), F.col("identity").alias("__to"))
    return df.join(i, F.col(node) == F.col("__i"), "left").withColumn(f"{node}_identity", F.coalesce("__to", node)).drop("__i", "__to")


def edges(bodies: DataFrame, codes: DataFrame, aliases: DataFrame, successions: DataFrame) -> DataFrame:
    """``node, later, date``: what a node passed to.  A succession recorded by one side counts for
    both; a commissioning group passed to its board on the day its record became a location."""
    kind = "struct<id: string, start: string>"
    roles = F.coalesce("roles", F.array().cast(f"array<{kind}>"))
    first = lambda role: F.try_element_at(F.filter(roles, lambda r: r["id"] == role), F.lit(1))
    b = bodies.select("code", "icb", first(SUB_ICB_LOCATION)["start"].alias("sub"), first(CCG).isNotNull().alias("ccg"), "successors", "predecessors")
    links = b.select(F.col("code").alias("a"), F.explode("successors").alias("x")).select("a", F.col("x.code").alias("b"), "x.date").unionByName(b.select(F.col("code").alias("b"), F.explode("predecessors").alias("x")).select(F.col("x.code").alias("a"), "b", "x.date"))
    t = b.select(F.col("code").alias("b"), "sub", "ccg")
    was_group = F.coalesce("ccg", F.lit(False)) & (F.col("sub").isNull() | ((F.coalesce("date", F.lit("")) != "") & (F.col("date") < F.col("sub"))))
    to = links.distinct().join(t, "b", "left").select("a", F.concat(F.when(was_group, "ccg:").otherwise("org:"), "b").alias("later"), "date")
    plain = to.select(F.explode(F.array(F.concat(F.lit("org:"), "a"), F.concat(F.lit("ccg:"), "a"))).alias("node"), "later", "date")
    became = b.filter("sub is not null").select(F.concat(F.lit("ccg:"), "code").alias("node"), F.when(F.coalesce("icb", F.lit("")) != "", F.concat(F.lit("org:"), "icb")).otherwise(F.concat(F.lit("org:"), "code")).alias("later"), F.col("sub").alias("date"))
    s = nodes(resolved(successions, "was", aliases).select(F.concat(F.lit("name:"), "key").alias("from_node"), "now", "date"), "now", codes, aliases, successions).filter("node is not null")
    said = _identified(s, "node", identities(bodies)).select(F.col("from_node").alias("node"), F.col("node_identity").alias("later"), "date")
    return plain.unionByName(became).unionByName(said).distinct()


def relations(pairs: DataFrame, bodies: DataFrame, codes: DataFrame, aliases: DataFrame, successions: DataFrame) -> DataFrame:
    """``old, new, relation, date`` for the pairs that are related: ``same``, or ``succeeded`` with
    the date of the last hop on a shortest way of at most MOST_HOPS hops (the earliest date if
    there are several)."""
    ids = identities(bodies)
    e = cut(_identified(edges(bodies, codes, aliases, successions), "later", ids))
    p = nodes(pairs.select("old", "new").distinct(), "old", codes, aliases, successions).select("old", "new", F.col("node").alias("a"))
    p = nodes(p, "new", codes, aliases, successions).select("old", "new", "a", F.col("node").alias("b")).filter("a is not null and b is not null")
    p = cut(_identified(_identified(p, "a", ids), "b", ids).select("old", "new", "a", "a_identity", F.col("b_identity").alias("target")))
    found = [p.filter("a_identity = target").select("old", "new", F.lit("same").alias("relation"), F.lit("").alias("date"), F.lit(0).alias("hops"))]
    frontier = p.filter("a_identity <> target").select("old", "new", "target", F.col("a").alias("node"))
    for hop in range(1, MOST_HOPS + 1):
        reached = frontier.join(e, "node").select("old", "new", "target", "later", "later_identity", "date")
        found.append(reached.filter("later_identity = target").select("old", "new", F.lit("succeeded").alias("relation"), F.coalesce("date", F.lit("")).alias("date"), F.lit(hop).alias("hops")))
        frontier = reached.filter("later_identity <> target").select("old", "new", "target", F.col("later").alias("node")).distinct()
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy("old", "new").agg(F.min_by(F.struct("relation", "date"), F.struct("hops", "date")).alias("r")).select("old", "new", "r.*")


def first_page(names: DataFrame, name: str, steps: DataFrame, pages: DataFrame) -> DataFrame:
    """``<name>, page``: the nearest successor (``steps``: was, now) that has a page, itself first."""
    front = names.select(F.col(name).alias("start"), F.col(name).alias("at")).distinct()
    found = []
    for hop in range(MOST_HOPS + 1):
        hit = front.join(pages.select(F.col(name).alias("at"), "page"), "at").select("start", "page", F.lit(hop).alias("hop"))
        found.append(hit)
        front = front.join(hit.select("start").distinct(), "start", "left_anti").join(steps.select(F.col("was").alias("at"), "now"), "at").select("start", F.col("now").alias("at")).distinct()
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy(F.col("start").alias(name)).agg(F.min_by("page", F.struct("hop", "page")).alias("page"))
