"""Name resolution and graphs: alias chains, renames seen in behaviour, similar names, successions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions.text import name_key
from quillspan.plans.base import HELD, Book, dataset_rows, held, line_sql
from quillspan.sources.register import table

BOOK = Book()

#: Steps along a chain of names after which it counts as a loop.
MOST_STEPS = 32


def renames(spark: SparkSession, folder: str) -> DataFrame:
    """``was, now, no``: one organisation name given for another on the same reference between
    two editions, by normalised name; the newest word on a name wins."""
    h = held(spark, folder, "organisation").select("no", "key", name_key(F.col("organisation")).alias("name")).filter("name <> ''")
    w = Window.partitionBy("key").orderBy("no")
    c = h.withColumn("was", F.lag("name").over(w)).filter("was is not null and was <> name")
    return c.groupBy("was").agg(F.max_by(F.struct(F.col("name").alias("now"), "no"), F.struct("no", "name")).alias("r")).select("was", "r.*")


_RENAMES = HELD + f""", nm as (select no, key, lower({line_sql("organisation")}) as name from held where {line_sql("organisation")} <> ''),
chg as (select name as now, lag(name) over (partition by key order by no) as was, no from nm),
ren as (select was, max_by(now, (no, now)) as now, max(no) as no from chg where was is not null and was <> now group by was) """


@BOOK.add(_RENAMES.replace("with ", "with recursive ", 1) + f""", walk(was, now, steps, path) as (
  select was, now, 1, [was, now] from ren
  union all
  select w.was, r.now, w.steps + 1, list_append(w.path, r.now) from walk w join ren r on r.was = w.now where w.steps < {MOST_STEPS} and not list_contains(w.path, r.now)
)
select was as name, max_by(now, steps) as canonical, max(steps) as steps from walk group by was""")
def e1_alias_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Chains of names followed to their end; a chain that returns to itself ends before it does.

    One step a round, at most MOST_STEPS; each name keeps a row for every step of its chain.
    """
    edges = renames(spark, folder).select("was", "now")
    edges.createOrReplaceTempView("__ren")
    walk = spark.sql(
        f"""with recursive walk(was, now, steps, path) max recursion level {MOST_STEPS + 1} as (
          select was, now, 1, array(was, now) from __ren
          union all
          select w.was, r.now, w.steps + 1, array_append(w.path, r.now) from walk w join __ren r on r.was = w.now where w.steps < {MOST_STEPS} and not array_contains(w.path, r.now)
        ) select * from walk"""
    )
    return walk.groupBy(F.col("was").alias("name")).agg(F.max_by("now", "steps").alias("canonical"), F.max("steps").alias("steps"))


@BOOK.add(_RENAMES.replace("with ", "with recursive ", 1) + """, reach(src, dst, hops) as (
  select was, now, 1 from ren union select r.src, n.now, r.hops + 1 from reach r join ren n on n.was = r.dst where r.hops < 6
)
select src, dst, min(hops) as hops from reach where src <> dst group by all""")
def g2_succession_closure(spark: SparkSession, folder: str) -> DataFrame:
    """Every name that a name was succeeded by, within six steps."""
    renames(spark, folder).select("was", "now").createOrReplaceTempView("__succ")
    reach = spark.sql(
        """with recursive reach(src, dst, hops) max recursion level 8 as (
          select was, now, 1 from __succ union all select r.src, n.now, r.hops + 1 from reach r join __succ n on n.was = r.dst where r.hops < 6
        ) select src, dst, min(hops) as hops from reach where src <> dst group by src, dst"""
    )
    return reach


_OWN = HELD + f", ow as (select no, key, lower({line_sql('organisation')}) as name from held where {line_sql('organisation')} <> ''), ends as (select min(no) as a, max(no) as b from held), shared as (select key from ow where no = (select a from ends) intersect select key from ow where no = (select b from ends)), "


@BOOK.add(_OWN + """bef as (select key, name from ow where no = (select a from ends) and key in (select key from shared)), aft as (select key, name from ow where no = (select b from ends) and key in (select key from shared)),
van as (select name, count(*) as n from bef where name not in (select name from aft) group by name), app as (select name, count(*) as n from aft where name not in (select name from bef) group by name),
p as (select b.name as was, a.name as now, count(*) as shw from bef b join aft a using (key) where b.name <> a.name group by all)
select p.was, p.now, p.shw as versions, round(p.shw / (v.n + q.n - p.shw), 6) as jaccard from p join van v on v.name = p.was join app q on q.name = p.now where p.shw / (v.n + q.n - p.shw) >= 0.5""")
def e4_rename_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Names that vanish beside names that appear on the same references: Jaccard of their owners.

    Pairs come from an equi-join on the reference, so only names that share one are compared.
    """
    from quillspan.sources.register import editions_of

    nos = [no for no, _ in editions_of(table(spark, folder, "agreement_snapshots"))]
    o = held(spark, folder, "organisation").select("no", "key", name_key(F.col("organisation")).alias("name")).filter("name <> ''")
    bef, aft = o.filter(F.col("no") == nos[0]).select("key", F.col("name").alias("was")), o.filter(F.col("no") == nos[-1]).select("key", F.col("name").alias("now"))
    j = bef.join(aft, "key")
    was, now = j.groupBy("was").agg(F.count(F.lit(1)).alias("nw")), j.groupBy("now").agg(F.count(F.lit(1)).alias("nn"))
    van = was.join(now, was.was == now.now, "left_anti")
    app = now.join(was, was.was == now.now, "left_anti")
    p = j.filter("was <> now").groupBy("was", "now").agg(F.count(F.lit(1)).alias("versions")).join(van, "was").join(app, "now")
    score = F.col("versions") / (F.col("nw") + F.col("nn") - F.col("versions"))
    return p.withColumn("score", score).filter("score >= 0.5").select("was", "now", "versions", F.round("score", 6).alias("jaccard"))


#: Tokens that do not count between names.
STOP = ("THE", "LIMITED", "LTD", "LLC", "LLP", "PLC", "AND", "CO", "OF")
LEAST_SCORE = 0.55
_STOP_SQL = "[" + ", ".join(f"'{t}'" for t in STOP) + "]"


@BOOK.add(HELD + f""", nm as (select distinct upper(organisation) as name from agr where organisation <> ''),
tk as (select name, unnest(list_filter(list_distinct(regexp_extract_all(regexp_replace(name, '[^A-Z0-9 ]', '', 'g'), '[A-Z0-9]+')), lambda t: not list_contains({_STOP_SQL}, t))) as t from nm),
df as (select t, 1 / ln(2 + count(*)) as idf from tk group by t), w as (select tk.name, tk.t, df.idf from tk join df using (t)), tot as (select name, sum(idf) as total from w group by name),
pr as (select a.name as name_a, b.name as name_b, sum(a.idf) as shw from w a join w b on a.t = b.t and a.name < b.name group by all)
select name_a, name_b, round(shw / (x.total + y.total - shw), 6) as score from pr join tot x on x.name = name_a join tot y on y.name = name_b where shw / (x.total + y.total - shw) >= {LEAST_SCORE}""")
def e5_weighted_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Organisation names whose rare words agree.

    The score is the shared weight over the weight of all words of both.  Names meet in the
    words of their rarest part alone: words are put in the order of their rarity and a name is
    entered under its first ones only, as many as its score needs (prefix filtering), so common
    words such as UNIVERSITY bring no pairs and no pair at the threshold is lost.
    """
    from quillspan.plans.base import agreements

    n = agreements(spark, folder).filter("organisation <> ''").select(F.upper("organisation").alias("name")).distinct()
    toks = F.array_except(F.array_distinct(F.regexp_extract_all(F.regexp_replace("name", "[^A-Z0-9 ]", ""), F.lit("[A-Z0-9]+"), F.lit(0))), F.array(*map(F.lit, STOP)))
    t = n.select("name", F.explode(toks).alias("t"))
    df = t.groupBy("t").agg((1 / F.log(2.0 + F.count(F.lit(1)))).alias("idf"))
    w = t.join(df, "t").groupBy("name").agg(F.sort_array(F.collect_list(F.struct((-F.col("idf")).alias("o"), "t", "idf"))).alias("ws"), F.sum("idf").alias("total"))
    # weight that may stay unseen without the score falling below the threshold
    before = F.transform("ws", lambda x, i: F.struct(x["t"].alias("t"), x["idf"].alias("idf"), F.aggregate(F.slice("ws", F.lit(1), i), F.lit(0.0), lambda s, y: s + y["idf"]).alias("seen")))
    kept = F.filter(before, lambda x: x["seen"] <= (1 - LEAST_SCORE) * F.col("total") + 1e-9)
    entered = w.select("name", "ws", "total", F.explode(F.transform(kept, lambda x: x["t"])).alias("t"))
    a, b = entered.alias("a"), entered.alias("b")
    cand = a.join(b, (F.col("a.t") == F.col("b.t")) & (F.col("a.name") < F.col("b.name"))).select(
        F.col("a.name").alias("name_a"), F.col("b.name").alias("name_b"), F.col("a.ws").alias("wa"), F.col("b.ws").alias("wb"), F.col("a.total").alias("ta"), F.col("b.total").alias("tb")
    )
    both = F.aggregate(F.filter("wa", lambda x: F.exists("wb", lambda y: y["t"] == x["t"])), F.lit(0.0), lambda s, x: s + x["idf"])
    scored = cand.withColumn("both", both).withColumn("score", F.col("both") / (F.col("ta") + F.col("tb") - F.col("both")))
    return scored.filter(F.col("score") >= LEAST_SCORE).groupBy("name_a", "name_b").agg(F.round(F.max("score"), 6).alias("score"))


@BOOK.add(HELD + ", c as (select distinct name, regexp_extract(name, '\\(([A-Z][A-Z ]+)\\)$', 1) as code from dat) select code, count(*) as names, array_to_string(list_sort(list(name)), ' | ') as listed from c where code <> '' group by code having count(*) > 1")
def e6_same_code(spark: SparkSession, folder: str) -> DataFrame:
    """Data set names that end in the same code."""
    c = dataset_rows(spark, folder).select("name", F.regexp_extract("name", r"\(([A-Z][A-Z ]+)\)$", 1).alias("code")).filter("code <> ''").distinct()
    return c.groupBy("code").agg(F.count(F.lit(1)).alias("names"), F.array_join(F.sort_array(F.collect_list("name")), " | ").alias("listed")).filter("names > 1")


@BOOK.add(_RENAMES + "select was, now, no from ren")
def e7_rename_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return renames(spark, folder)


@BOOK.add(HELD + """, l as (select dataset_id, dataset_name, lower(dataset_name) as k1, trim(regexp_replace(lower(dataset_name), '\\([^)]*\\)', '', 'g')) as k2 from dataset_list),
u as (select distinct name, lower(name) as k1, trim(regexp_replace(regexp_replace(lower(name), '\\([^)]*\\)', '', 'g'), ' +', ' ', 'g')) as k2 from dat)
select u.name, coalesce(a.dataset_id, b.dataset_id, c.dataset_id, 0) as dataset_id, case when a.dataset_id is not null then 1 when b.dataset_id is not null then 2 when c.dataset_id is not null then 3 else 0 end as step
from u left join l a on a.dataset_name = u.name left join l b on b.k1 = u.k1 left join (select k2, min(dataset_id) as dataset_id from l group by k2 having count(*) = 1) c on c.k2 = u.k2""")
def j19_prioritized_match(spark: SparkSession, folder: str) -> DataFrame:
    """Names matched to the list in steps: the same text, the same but for case, the same without
    brackets if only one entry is."""
    bare = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"\([^)]*\)", ""), " +", " "))
    l = table(spark, folder, "dataset_list").select("dataset_id", "dataset_name")  # noqa: E741
    u = dataset_rows(spark, folder).select("name").distinct()
    s1 = l.select(F.col("dataset_name").alias("name"), F.col("dataset_id").alias("a"))
    s2 = l.groupBy(F.lower("dataset_name").alias("k1")).agg(F.min("dataset_id").alias("b"))
    s3 = l.groupBy(bare(F.col("dataset_name")).alias("k2")).agg(F.min("dataset_id").alias("c"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    j = u.join(s1, "name", "left").withColumn("k1", F.lower("name")).join(s2, "k1", "left").withColumn("k2", bare(F.col("name"))).join(s3, "k2", "left")
    step = F.when(F.col("a").isNotNull(), 1).when(F.col("b").isNotNull(), 2).when(F.col("c").isNotNull(), 3).otherwise(0)
    return j.select("name", F.coalesce("a", "b", "c", F.lit(0)).alias("dataset_id"), step.alias("step"))
