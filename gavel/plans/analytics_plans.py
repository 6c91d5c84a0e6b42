"""Tag facts and the analytics over them: lift, shares, trends, comparisons, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gavel.operators import aggregates as agg
from gavel.operators import graph
from gavel.operators import relational as rel
from gavel.plans.registry import query
from gavel.sources.staging import stage
from gavel.sources.tables import load


def brands(spark: SparkSession, folder: str) -> DataFrame:
    """The fact table of these analytics: distinct (order, brand), with the order's customer and day."""
    l, p = load(spark, folder, "lineitem", "l_orderkey", "l_partkey"), load(spark, folder, "part", "p_partkey", "p_brand")
    return l.join(p, l.l_partkey == p.p_partkey).select(F.col("l_orderkey").alias("unit"), F.col("p_brand").alias("tag")).distinct()


def sales(spark: SparkSession, folder: str) -> DataFrame:
    """The same facts with member (customer), party (segment), place (nation) and day."""
    o = load(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice").withColumnRenamed("o_orderkey", "unit")
    c = load(spark, folder, "customer", "c_custkey", "c_mktsegment", "c_nationkey")
    return brands(spark, folder).join(o, "unit").join(c, F.col("o_custkey") == c.c_custkey).select(
        "unit", "tag", F.col("o_custkey").alias("member"), F.col("c_mktsegment").alias("party"), F.col("c_nationkey").alias("place"),
        F.to_date("o_orderdate").alias("day"), F.year("o_orderdate").alias("y"), F.col("o_totalprice").alias("size"))


B = "b AS (SELECT DISTINCT l_orderkey AS unit, p_brand AS tag FROM lineitem JOIN part ON l_partkey = p_partkey)"
S = B + """, s AS (SELECT b.unit, b.tag, o_custkey AS member, c_mktsegment AS party, c_nationkey AS place, CAST(o_orderdate AS DATE) AS day, CAST(extract(year FROM o_orderdate) AS INTEGER) AS y, o_totalprice AS size
  FROM b JOIN orders ON o_orderkey = b.unit JOIN customer ON c_custkey = o_custkey)"""


@query("TAG01 JOI08 PAG06 JOI07", f"""
WITH {B}, n AS (SELECT tag, count(*) AS n FROM b GROUP BY 1), t AS (SELECT count(DISTINCT unit) AS t FROM b),
p AS (SELECT x.tag AS a, y.tag AS b, count(*) AS shared FROM b x JOIN b y ON x.unit = y.unit AND x.tag <> y.tag GROUP BY 1, 2 HAVING count(*) >= 8),
l AS (SELECT p.a, p.b, p.shared, round(CAST(na.n AS DOUBLE) * nb.n / t, 6) AS expected, round(shared / (CAST(na.n AS DOUBLE) * nb.n / t), 6) AS lift FROM p JOIN n na ON na.tag = p.a JOIN n nb ON nb.tag = p.b, t)
SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY a ORDER BY lift DESC, shared DESC, b) <= 10""")
def tag_related_lift(spark: SparkSession, folder: str) -> DataFrame:
    """Related tags: pairs shared more often than chance, the ten with the highest lift for each."""
    b = stage(brands(spark, folder), "facts")  # read four times
    n = b.groupBy("tag").agg(F.count("*").alias("n"))
    total = b.select("unit").distinct().agg(F.count("*").alias("t"))
    pairs = agg.co_occurrence(b, "unit", "tag").where("shared >= 8").join(F.broadcast(total))
    a_, b_ = n.select(F.col("tag").alias("a"), F.col("n").alias("n_a")), n.select(F.col("tag").alias("b"), F.col("n").alias("n_b"))
    expected = F.col("n_a").cast("double") * F.col("n_b") / F.col("t")
    lifted = pairs.join(a_, "a").join(b_, "b").select("a", "b", "shared", F.round(expected, 6).alias("expected"), F.round(F.col("shared") / expected, 6).alias("lift"))
    return rel.top_per_group(lifted, ["a"], [F.desc("lift"), F.desc("shared"), F.col("b")], 10)


@query("TAG01 AGG08", """
SELECT unit, tag, source FROM (SELECT l_orderkey AS unit, p_brand AS tag, l_returnflag AS source, row_number() OVER (PARTITION BY l_orderkey, p_brand ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_returnflag) AS n
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'F') WHERE n = 1""")
def speech_tags_precedence(spark: SparkSession, folder: str) -> DataFrame:
    """One row per (unit, tag) of the kept items, from the source that comes first (min_by combines before the shuffle)."""
    l = load(spark, folder, "lineitem", "l_orderkey", "l_partkey", "l_returnflag", "l_linestatus").where("l_linestatus = 'F'")
    p = load(spark, folder, "part", "p_partkey", "p_brand")
    rows, precedence = l.join(p, l.l_partkey == p.p_partkey), F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    return rows.groupBy(F.col("l_orderkey").alias("unit"), F.col("p_brand").alias("tag")).agg(F.min_by("l_returnflag", F.struct(precedence, "l_returnflag")).alias("source"))


@query("TAG02 SET01 TAG01", """
WITH f AS (SELECT l_orderkey AS unit, 'brand' AS source FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#7'
  UNION ALL SELECT l_orderkey, 'type' FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type = 'PROMO')
SELECT unit, min(source) AS source FROM f GROUP BY unit""")
def tag_speeches_union_roads(spark: SparkSession, folder: str) -> DataFrame:
    """Units of a tag by two roads, a union of two equi joins instead of one with OR, each unit once."""
    l, p = load(spark, folder, "lineitem", "l_orderkey", "l_partkey"), load(spark, folder, "part", "p_partkey", "p_brand", "p_type")
    road = lambda where, name: l.join(p.where(where), l.l_partkey == p.p_partkey).select(F.col("l_orderkey").alias("unit"), F.lit(name).alias("source"))
    return road("p_brand = 'Brand#7'", "brand").unionByName(road("p_type = 'PROMO'", "type")).groupBy("unit").agg(F.min("source").alias("source"))


@query("TAG03", f"WITH {B} SELECT unit, string_agg(tag, ', ' ORDER BY tag) AS tags, count(*) AS n FROM b GROUP BY unit")
def tags_of_speeches(spark: SparkSession, folder: str) -> DataFrame:
    """All tags of each unit in order, as one text."""
    return brands(spark, folder).groupBy("unit").agg(F.array_join(F.sort_array(F.collect_list("tag")), ", ").alias("tags"), F.count("*").alias("n"))


#: All that a tag's chain of merges passes (a set, so a cycle ends it), and its end, or on a cycle the smallest tag of it.
ENDS = """c(id, pos) AS (SELECT id, id FROM tags UNION SELECT c.id, t.merged_into FROM c JOIN tags t ON t.id = c.pos WHERE t.merged_into IS NOT NULL),
cycle AS (SELECT DISTINCT t.id FROM tags t JOIN c ON c.id = t.merged_into AND c.pos = t.id),
e AS (SELECT c.id, max(CASE WHEN t.merged_into IS NULL THEN c.pos END) AS target, count(*) AS seen, bool_or(t.id IS NULL) AS gone, coalesce(max(CASE WHEN t.merged_into IS NULL THEN c.pos END), min(cycle.id)) AS "to"
  FROM c LEFT JOIN tags t ON t.id = c.pos LEFT JOIN cycle ON cycle.id = c.pos GROUP BY c.id)"""


def slug(name: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


@query("TAG04", f"""
WITH RECURSIVE {ENDS} SELECT e.id, e.target, CASE WHEN e.target IS NOT NULL THEN CAST(e.seen - 1 AS INTEGER) END AS steps, trim(regexp_replace(lower(g.tag), '[^a-z0-9]+', '-', 'g'), '-') AS slug
FROM e LEFT JOIN tags g ON g.id = e.target WHERE NOT gone""")
def merge_chain_resolve(spark: SparkSession, folder: str) -> DataFrame:
    """Every tag with the end of its merge chain, at any length, and its slug there.

    Tags on a cycle of merges, or that lead into one, have no kept tag: their target, steps and slug are null.
    Tags that end at an id that isn't there are left out.
    """
    t = load(spark, folder, "tags", "id", "merged_into", "tag")
    ends = graph.chain_ends(t).select(F.col("node").alias("id"), F.col("end").alias("target"), F.col("steps").cast("int").alias("steps"))
    names = t.select(F.col("id").alias("target"), slug(F.col("tag")).alias("slug"), F.lit(True).alias("there"))
    return ends.join(names, "target", "left").where("there or target is null").select("id", "target", "steps", "slug")


@query("TAG06", f"""
WITH RECURSIVE {ENDS}, a AS (SELECT e.to AS id, id AS src, generate_subscripts(list_prepend(tag, aliases), 1) AS k, unnest(list_prepend(tag, aliases)) AS alias FROM tags JOIN e USING (id)),
f AS (SELECT *, row_number() OVER (PARTITION BY id, lower(trim(alias)) ORDER BY (src <> id), src, k) AS n, (src <> id) AS other FROM a)
SELECT id, list(alias ORDER BY other, src, k) AS aliases FROM f WHERE n = 1 GROUP BY id""")
def merged_aliases(spark: SparkSession, folder: str) -> DataFrame:
    """The names and aliases of merged tags, each spelling once by its normal form, in first-seen order.

    They go to the end of the merge chain, or on a cycle to its smallest tag.
    """
    t = load(spark, folder, "tags", "id", "merged_into", "tag", "aliases")
    t = t.join(graph.chain_ends(t).select(F.col("node").alias("id"), F.col("group").alias("to")), "id")
    names = F.concat(F.array("tag"), F.coalesce("aliases", F.array().cast("array<string>")))
    a = t.select("to", F.col("id").alias("src"), F.posexplode(names).alias("k", "alias")).withColumn("other", F.col("src") != F.col("to"))
    first = a.groupBy("to", F.lower(F.trim("alias")).alias("norm")).agg(F.min(F.struct("other", "src", "k", "alias")).alias("f"))
    return first.groupBy(F.col("to").alias("id")).agg(F.transform(F.sort_array(F.collect_list("f")), lambda x: x["alias"]).alias("aliases"))


@query("TAG07", """
SELECT s.id AS subject_id, count(DISTINCT e.id) AS names, CAST(sum(e.n_speeches) AS BIGINT) AS speeches FROM (SELECT id, unnest(string_split(subject_key, ' ')) AS k FROM subjects) s JOIN entity_names e ON e.id = TRY_CAST(s.k AS BIGINT) GROUP BY 1""")
def cluster_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Subjects with sums over the names in their keys."""
    s = load(spark, folder, "subjects", "id", "subject_key").select(F.col("id").alias("subject_id"), F.explode(F.split("subject_key", " ")).alias("k"))
    e = load(spark, folder, "entity_names", "id", "n_speeches")
    return s.join(e, F.expr("try_cast(k as bigint)") == e.id).groupBy("subject_id").agg(F.count_distinct("id").alias("names"), F.sum("n_speeches").alias("speeches"))


@query("TAG09 SRC06 SRC07 SRC08 SRC16 DEC07", """
WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE CAST(o_orderdate AS DATE) < DATE '2000-06-01'), n AS (SELECT o_orderkey AS k, CASE WHEN o_totalprice > 400000 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1996-01-01')
SELECT k, CASE WHEN o.v IS NULL THEN 'insert' WHEN n.v IS NULL THEN 'delete' WHEN o.v = n.v THEN 'same' ELSE 'update' END AS change FROM o FULL JOIN n USING (k)""")
def load_plan(spark: SparkSession, folder: str) -> DataFrame:
    """What a new version of a table inserts, updates, deletes and leaves (two derived versions of the orders)."""
    o, n = _versions(spark, folder)
    return rel.diff(o, n, ["k"], ["v"])


def _versions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    t = load(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("price"))
    return t.where("day < date'2000-06-01'").select("k", "v"), t.where("day >= date'1996-01-01'").select("k", F.when(F.col("price") > 400000, "X").otherwise(F.col("v")).alias("v"))


@query("SRC06 SRC16", """
SELECT o_orderkey AS k, CASE WHEN CAST(o_orderdate AS DATE) >= DATE '1996-01-01' AND o_totalprice > 400000 THEN 'X' ELSE o_orderstatus END AS v FROM orders""")
def upsert_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The old version with the new one's rows in place of those with equal keys."""
    o, n = _versions(spark, folder)
    return rel.upsert(o, n, ["k"])


@query("SRC07 SRC08", "SELECT o_orderkey AS k, CASE WHEN CAST(o_orderdate AS DATE) >= DATE '2000-06-01' AND o_totalprice > 400000 THEN 'X' ELSE o_orderstatus END AS v FROM orders")
def insert_if_absent(spark: SparkSession, folder: str) -> DataFrame:
    """The old version with only those rows of the new one whose keys it lacks."""
    o, n = _versions(spark, folder)
    return rel.insert_absent(o, n, ["k"])


@query("PAG02 PAG01", """
WITH o AS (SELECT CAST(extract(year FROM o_orderdate) AS INTEGER) AS y, o_orderstatus AS s, o_orderpriority AS p FROM orders)
SELECT 'year' AS facet, CAST(y AS VARCHAR) AS value, count(*) AS n FROM o WHERE s = 'F' AND p = '1-URGENT' GROUP BY 2
UNION ALL SELECT 'status', s, count(*) FROM o WHERE y = 1997 AND p = '1-URGENT' GROUP BY 2 UNION ALL SELECT 'priority', p, count(*) FROM o WHERE y = 1997 AND s = 'F' GROUP BY 2""")
def facets_minus_own_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Facets, each under all filters but its own, from one scan: every row goes to the facets whose filters it passes."""
    o = load(spark, folder, "orders", "o_orderdate", "o_orderstatus", "o_orderpriority").select(F.year("o_orderdate").cast("string").alias("year"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    conditions = {"year": F.col("year") == "1997", "status": F.col("status") == "F", "priority": F.col("priority") == "1-URGENT"}
    facets = [F.when(rel.conjunction(conditions, [f]), F.struct(F.lit(f).alias("facet"), F.col(f).alias("value"))) for f in conditions]
    return o.select(F.explode(F.array_compact(F.array(*facets))).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


@query("PAG04 AGG05", """
SELECT o_custkey, count(*) AS n, CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS last_priority,
  count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, list_sort(list(DISTINCT o_orderstatus)) AS states FROM orders GROUP BY 1""")
def members_group_by_speeches(spark: SparkSession, folder: str) -> DataFrame:
    """A list grouped by member: counts under conditions, first and last day, the last row's value, distinct values."""
    o = load(spark, folder, "orders")
    return o.groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.to_date(F.min("o_orderdate")).alias("first_day"), F.to_date(F.max("o_orderdate")).alias("last_day"), F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("last_priority"),
        F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.sort_array(F.collect_set("o_orderstatus")).alias("states"))


@query("PAG05 JOI15", f"""
WITH {S}, q AS (SELECT DISTINCT y FROM s) SELECT q.y, count(DISTINCT s.unit) AS n, count(DISTINCT s.member) AS members,
  round(100.0 * count(DISTINCT s.unit) / (SELECT count(DISTINCT unit) FROM s a WHERE a.y = q.y), 6) AS per_100 FROM q LEFT JOIN s ON s.y = q.y AND s.tag = 'Brand#3' GROUP BY q.y""")
def tag_years(spark: SparkSession, folder: str) -> DataFrame:
    """One tag per year: units, members, and the rate per 100 units of the year, years without any with 0."""
    s = sales(spark, folder)
    mine = F.col("tag") == "Brand#3"
    units = s.groupBy("y", "unit").agg(F.max("member").alias("member"), F.max(mine).alias("has"))
    return units.groupBy("y").agg(F.count_if("has").alias("n"), F.count_distinct(F.when(F.col("has"), F.col("member"))).alias("members"), F.round(F.count_if("has") * 100.0 / F.count("*"), 6).alias("per_100"))


@query("PAG07", f"""
WITH {S}, m AS (SELECT member, tag, count(*) AS n, sum(count(*)) OVER (PARTITION BY member) AS t FROM s GROUP BY 1, 2), a AS (SELECT tag, count(*) AS n, sum(count(*)) OVER () AS t FROM s GROUP BY 1)
SELECT m.member, m.tag, m.n, round((m.n / CAST(m.t AS DOUBLE)) / (a.n / CAST(a.t AS DOUBLE)), 6) AS lift FROM m JOIN a USING (tag) WHERE m.n >= 3
QUALIFY row_number() OVER (PARTITION BY m.member ORDER BY lift DESC, m.n DESC, m.tag) <= 3""")
def member_typical_lift(spark: SparkSession, folder: str) -> DataFrame:
    """What is typical of a member: the three tags with the highest lift of those on three units or more."""
    s = stage(sales(spark, folder).select("member", "tag"), "facts")
    m = agg.shares(s.groupBy("member", "tag").agg(F.count("*").alias("n")), ["member"], ["member"], name="own").select("member", "tag", "n", F.sum("n").over(Window.partitionBy("member")).alias("t"))
    a = s.groupBy("tag").agg(F.count("*").alias("n_all"))
    total = a.agg(F.sum("n_all").alias("t_all"))
    lift = F.round((F.col("n") / F.col("t").cast("double")) / (F.col("n_all") / F.col("t_all").cast("double")), 6)
    out = m.where("n >= 3").join(a, "tag").join(F.broadcast(total)).select("member", "tag", "n", lift.alias("lift"))
    return rel.top_per_group(out, ["member"], [F.desc("lift"), F.desc("n"), F.col("tag")], 3)


@query("PAG07 AGG17", f"""
WITH {S}, m AS (SELECT party, tag, count(*) AS n FROM s GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY party ORDER BY n DESC, tag) AS k, sum(n) OVER (PARTITION BY party) AS t FROM m)
SELECT party, CASE WHEN k <= 5 THEN tag ELSE 'other' END AS tag, CAST(sum(n) AS BIGINT) AS n, round(sum(n) / CAST(max(t) AS DOUBLE), 6) AS share FROM r GROUP BY 1, 2""")
def member_shares_other(spark: SparkSession, folder: str) -> DataFrame:
    """The five largest tags of each group with their shares, and the rest as `other`."""
    m = sales(spark, folder).groupBy("party", "tag").agg(F.count("*").alias("n"))
    w = Window.partitionBy("party")
    r = m.withColumn("k", F.row_number().over(w.orderBy(F.desc("n"), "tag"))).withColumn("t", F.sum("n").over(w))
    return r.groupBy("party", F.when(F.col("k") <= 5, F.col("tag")).otherwise("other").alias("tag")).agg(F.sum("n").alias("n"), agg.ratio(F.sum("n"), F.max("t")).alias("share"))


@query("PAG08", f"""
WITH {S}, p AS (SELECT party, tag, count(*) AS n, count(DISTINCT member) AS members FROM s GROUP BY 1, 2), u AS (SELECT party, count(DISTINCT unit) AS units FROM s GROUP BY 1), r AS (SELECT tag, count(*) / CAST((SELECT count(DISTINCT unit) FROM s) AS DOUBLE) AS base FROM s GROUP BY 1)
SELECT party, tag, n, members, round(n - units * base, 6) AS extra FROM p JOIN u USING (party) JOIN r USING (tag) WHERE members >= 5""")
def party_extra_speeches(spark: SparkSession, folder: str) -> DataFrame:
    """Units of a group on a tag beyond what its size and the tag's base rate let expect."""
    s = stage(sales(spark, folder).select("party", "tag", "member", "unit"), "facts")
    p = s.groupBy("party", "tag").agg(F.count("*").alias("n"), F.count_distinct("member").alias("members"))
    units = s.select("party", "unit").distinct()
    u, all_ = units.groupBy("party").agg(F.count("*").alias("units")), s.select("unit").distinct().agg(F.count("*").alias("all_units"))
    b = s.groupBy("tag").agg(F.count("*").alias("n_tag")).join(F.broadcast(all_)).select("tag", (F.col("n_tag") / F.col("all_units").cast("double")).alias("base"))
    return p.where("members >= 5").join(u, "party").join(b, "tag").select("party", "tag", "n", "members", F.round(F.col("n") - F.col("units") * F.col("base"), 6).alias("extra"))


@query("PAG09", f"""
WITH {S}, p AS (SELECT party, count(DISTINCT unit) AS units FROM s GROUP BY 1), h AS (SELECT c_mktsegment AS party, count(*) AS seats FROM customer GROUP BY 1)
SELECT party, units, seats, round((units / CAST(sum(units) OVER () AS DOUBLE)) / (seats / CAST(sum(seats) OVER () AS DOUBLE)), 6) AS weight FROM p JOIN h USING (party)""")
def party_weight_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """A group's share of units against its share of seats."""
    p = sales(spark, folder).select("party", "unit").distinct().groupBy("party").agg(F.count("*").alias("units"))
    h = load(spark, folder, "customer", "c_mktsegment").groupBy(F.col("c_mktsegment").alias("party")).agg(F.count("*").alias("seats"))
    both, every = p.join(h, "party"), Window.partitionBy()
    return both.select("party", "units", "seats", F.round((F.col("units") / F.sum("units").over(every).cast("double")) / (F.col("seats") / F.sum("seats").over(every).cast("double")), 6).alias("weight"))


@query("PAG09 PAG10", f"""
WITH {S}, g AS (SELECT party, place, count(*) AS n FROM s GROUP BY 1, 2) SELECT party, place, n,
  round(n * CAST(sum(n) OVER () AS DOUBLE) / (sum(n) OVER (PARTITION BY party) * CAST(sum(n) OVER (PARTITION BY place) AS DOUBLE)), 6) AS lift FROM g""")
def party_area_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Lift of every cell of a grid of two dimensions."""
    g = sales(spark, folder).groupBy("party", "place").agg(F.count("*").alias("n"))
    total = lambda *k: F.sum("n").over(Window.partitionBy(*k)).cast("double")
    return g.select("party", "place", "n", F.round(F.col("n") * total() / (total("party") * total("place")), 6).alias("lift"))


@query("PAG10", f"""
WITH {S}, a AS (SELECT tag, count(*) AS n FROM s WHERE place = 3 GROUP BY 1), t AS (SELECT tag, count(*) AS n_all FROM s GROUP BY 1)
SELECT tag, n, n_all, round((n / CAST((SELECT count(*) FROM s WHERE place = 3) AS DOUBLE)) / (n_all / CAST((SELECT count(*) FROM s) AS DOUBLE)), 6) AS lift FROM a JOIN t USING (tag) WHERE tag NOT IN ('Brand#1')""")
def place_associated(spark: SparkSession, folder: str) -> DataFrame:
    """Tags associated with one place by lift, some excluded."""
    s = sales(spark, folder)
    here = F.col("place") == 3
    n = s.groupBy("tag").agg(F.count_if(here).alias("n"), F.count("*").alias("n_all"))
    total = n.agg(F.sum("n").alias("t"), F.sum("n_all").alias("t_all"))
    return n.where("n > 0 and tag not in ('Brand#1')").join(F.broadcast(total)).select("tag", "n", "n_all", F.round((F.col("n") / F.col("t").cast("double")) / (F.col("n_all") / F.col("t_all").cast("double")), 6).alias("lift"))


@query("PAG11 PAG12", """
SELECT DISTINCT ON (constituency_key) constituency_key, constituency, state_id, person_id FROM (SELECT upper(trim(regexp_replace(constituency, '\\s*\\(.*\\)\\s*$', ''))) AS constituency_key, * FROM speakers WHERE constituency IS NOT NULL) ORDER BY constituency_key, effective_from DESC, id""")
def places_index(spark: SparkSession, folder: str) -> DataFrame:
    """Seats by normalised name, each with its latest holder."""
    s = load(spark, folder, "speakers", "id", "person_id", "constituency", "state_id", "effective_from").where("constituency is not null")
    s = s.withColumn("constituency_key", F.upper(F.trim(F.regexp_replace("constituency", "\\s*\\(.*\\)\\s*$", ""))))
    return rel.top_per_group(s, ["constituency_key"], [F.desc("effective_from"), F.col("id")]).select("constituency_key", "constituency", "state_id", "person_id")


@query("PAG12 TXT15", """
WITH s AS (SELECT DISTINCT upper(trim(constituency)) AS seat FROM speakers WHERE constituency IS NOT NULL)
SELECT seat, CASE WHEN seat = 'TAZOBARI' THEN 0 WHEN starts_with(seat, 'TAZ') THEN 1 ELSE 2 END AS place FROM s WHERE contains(seat, 'TAZ') ORDER BY place, seat LIMIT 20""")
def seat_search(spark: SparkSession, folder: str) -> DataFrame:
    """Seats that match a text exactly, at the start, or inside, in that order."""
    s = load(spark, folder, "speakers", "constituency").where("constituency is not null").select(F.upper(F.trim("constituency")).alias("seat")).distinct()
    place = F.when(F.col("seat") == "TAZOBARI", 0).when(F.col("seat").startswith("TAZ"), 1).otherwise(2)
    return s.where(F.contains("seat", F.lit("TAZ"))).select("seat", place.alias("place")).orderBy("place", "seat").limit(20)


@query("PAG13 SET02", f"""
WITH {S}, x AS (SELECT tag, count(*) AS n FROM s WHERE party = 'BUILDING' GROUP BY 1), y AS (SELECT tag, count(*) AS n FROM s WHERE party = 'MACHINERY' GROUP BY 1),
j AS (SELECT tag, coalesce(x.n, 0) / CAST((SELECT sum(n) FROM x) AS DOUBLE) AS a, coalesce(y.n, 0) / CAST((SELECT sum(n) FROM y) AS DOUBLE) AS b FROM x FULL JOIN y USING (tag))
SELECT tag, round(a, 6) AS a, round(b, 6) AS b, CASE WHEN a = 0 THEN 'only_b' WHEN b = 0 THEN 'only_a' WHEN greatest(a, b) < 2 * least(a, b) THEN 'shared' WHEN a > b THEN 'more_a' ELSE 'more_b' END AS side FROM j""")
def compare_two_sides(spark: SparkSession, folder: str) -> DataFrame:
    """Two groups side by side: shares of each tag, and whether it is shared, one's only, or mostly one's."""
    n = sales(spark, folder).groupBy("tag").agg(F.count_if(F.col("party") == "BUILDING").alias("x"), F.count_if(F.col("party") == "MACHINERY").alias("y")).where("x + y > 0")
    total = n.agg(F.sum("x").alias("tx"), F.sum("y").alias("ty"))
    j = n.join(F.broadcast(total)).select("tag", (F.col("x") / F.col("tx").cast("double")).alias("a"), (F.col("y") / F.col("ty").cast("double")).alias("b"))
    side = F.when(F.col("a") == 0, "only_b").when(F.col("b") == 0, "only_a").when(F.greatest("a", "b") < 2 * F.least("a", "b"), "shared").when(F.col("a") > F.col("b"), "more_a").otherwise("more_b")
    return j.select("tag", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), side.alias("side"))


@query("PAG14", f"""
WITH {S}, q AS (SELECT y, quarter(day) AS q, count(DISTINCT unit) AS units, count(DISTINCT CASE WHEN tag = 'Brand#5' THEN unit END) AS n FROM s GROUP BY 1, 2),
r AS (SELECT *, 1000.0 * n / units AS rate, units < 300 AS thin FROM q)
SELECT y, CAST(q AS INTEGER) AS q, n, units, round(rate, 6) AS rate, thin, NOT thin AND rate = max(rate) FILTER (WHERE NOT thin) OVER () AS peak FROM r""")
def trend_rate_thin_peak(spark: SparkSession, folder: str) -> DataFrame:
    """A tag's rate per 1,000 units by quarter, quarters with few units marked, and the peak among the others."""
    s = sales(spark, folder)
    u = s.groupBy("unit", "y", F.quarter("day").alias("q")).agg(F.max(F.col("tag") == "Brand#5").alias("has"))
    r = u.groupBy("y", "q").agg(F.count_if("has").alias("n"), F.count("*").alias("units")).withColumn("_rate", F.col("n") * 1000.0 / F.col("units")).withColumn("thin", F.col("units") < 300)
    top = F.max(F.when(~F.col("thin"), F.col("_rate"))).over(Window.partitionBy())
    return r.select("y", "q", "n", "units", F.round("_rate", 6).alias("rate"), "thin", F.coalesce(~F.col("thin") & (F.col("_rate") == top), F.lit(False)).alias("peak"))


@query("PAG15 AGG17", f"""
WITH {S}, g AS (SELECT a.y, t.tag, count(s.unit) AS n FROM (SELECT DISTINCT y FROM s) a CROSS JOIN (SELECT DISTINCT tag FROM s) t LEFT JOIN s ON s.y = a.y AND s.tag = t.tag GROUP BY 1, 2),
h AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY y) AS DOUBLE) AS share FROM g), m AS (SELECT *, median(share) OVER (PARTITION BY tag) AS mid FROM h)
SELECT y, tag, n, round(share, 6) AS share, round(mid, 6) AS mid FROM m WHERE share >= 1.02 * mid AND n >= 20 QUALIFY row_number() OVER (PARTITION BY y ORDER BY share - mid DESC, tag) <= 3""")
def yearly_standouts(spark: SparkSession, folder: str) -> DataFrame:
    """Tags whose share of a year is well above the median of their shares over all years, absent years counting 0."""
    n = sales(spark, folder).groupBy("y", "tag").agg(F.count("*").alias("n"))
    total = n.groupBy("y").agg(F.sum("n").alias("_t"))
    g = n.join(total, "y").withColumn("share", F.col("n") / F.col("_t").cast("double"))
    # A tag has one share a year, so its list is as short as the calendar; absent years are added to it as zeros.
    every = total.agg(F.count("*").cast("int").alias("years"))
    of_tag = g.groupBy("tag").agg(F.collect_list("share").alias("s")).join(F.broadcast(every))
    filled = F.array_sort(F.concat("s", F.array_repeat(F.lit(0.0), F.col("years") - F.size("s"))))
    half = (F.col("years") / 2).cast("int")
    mid = of_tag.select("tag", "years", filled.alias("s")).select("tag", F.when(F.col("years") % 2 == 1, F.get("s", half)).otherwise((F.get("s", half - 1) + F.get("s", half)) / 2).alias("mid"))
    m = g.join(mid, "tag").where((F.col("share") >= 1.02 * F.col("mid")) & (F.col("n") >= 20))
    top = rel.top_per_group(m.withColumn("_d", F.col("share") - F.col("mid")), ["y"], [F.desc("_d"), F.col("tag")], 3)
    return top.select("y", "tag", "n", F.round("share", 6).alias("share"), F.round("mid", 6).alias("mid"))


@query("PAG16 WIN08 AGG17 PAG30", f"""
WITH {S}, n AS (SELECT tag, y * 12 + month(day) AS m, count(*) AS n FROM s GROUP BY 1, 2), g AS (SELECT t.tag, a.m, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT tag FROM n) t CROSS JOIN (SELECT unnest(range(min(m), max(m) + 1)) AS m FROM n) a LEFT JOIN n USING (tag, m)),
w AS (SELECT tag, m, sum(n) OVER (PARTITION BY tag ORDER BY m ROWS 11 PRECEDING) AS n FROM g), h AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY m) AS DOUBLE) AS share FROM w), k AS (SELECT *, share - median(share) OVER (PARTITION BY tag) AS above FROM h)
SELECT CAST(m AS INTEGER) AS m, tag, CAST(n AS BIGINT) AS n, round(above, 6) AS above FROM k QUALIFY row_number() OVER (PARTITION BY m ORDER BY round(above, 9) DESC, tag) <= 3""")
def race_sliding_12m(spark: SparkSession, folder: str) -> DataFrame:
    """Frames of a race: per month the tags whose share of the last twelve months is furthest above their median."""
    n = sales(spark, folder).groupBy("tag", (F.col("y") * 12 + F.month("day")).alias("m")).agg(F.count("*").alias("n"))
    months = n.agg(F.sequence(F.min("m"), F.max("m")).alias("all"))  # one row
    tags = n.select("tag").distinct().join(F.broadcast(months)).select("tag", F.explode("all").alias("m"))
    grid = tags.join(n, ["tag", "m"], "left").select("tag", "m", F.coalesce("n", F.lit(0)).alias("n"))
    w = grid.select("tag", "m", F.sum("n").over(Window.partitionBy("tag").orderBy("m").rangeBetween(-11, 0)).alias("n"))
    h = w.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("m")).cast("double"))
    k = h.join(h.groupBy("tag").agg(F.percentile("share", 0.5).alias("mid")), "tag").withColumn("_a", F.col("share") - F.col("mid"))
    return rel.top_per_group(k, ["m"], [F.round("_a", 9).desc(), F.col("tag")], 3).select("m", "tag", "n", F.round("_a", 6).alias("above"))


@query("PAG19", """
WITH d AS (SELECT DISTINCT loksabha, debate_date AS day FROM debates WHERE debate_date IS NOT NULL), y AS (SELECT DISTINCT year(day) AS y FROM d)
SELECT CAST(y AS INTEGER) AS y, day FROM (SELECT y.y, d.day, row_number() OVER (PARTITION BY y.y ORDER BY abs(d.day - make_date(y.y, 7, 1)), d.day) AS k FROM y JOIN (SELECT DISTINCT day FROM d) d ON abs(d.day - make_date(y.y, 7, 1)) <= 45) WHERE k = 1""")
def nearest_sitting_day(spark: SparkSession, folder: str) -> DataFrame:
    """The sitting day nearest to 1 July of each year, at most 45 days away, the earlier of two."""
    d = load(spark, folder, "debates", "debate_date").where("debate_date is not null").select(F.col("debate_date").alias("day")).distinct()
    d = d.withColumn("y", F.year("day")).withColumn("_off", F.abs(F.datediff("day", F.make_date(F.year("day"), F.lit(7), F.lit(1))))).where("_off <= 45")
    return d.groupBy("y").agg(F.min_by("day", F.struct("_off", "day")).alias("day"))


@query("PAG20", """
SELECT d.id AS debate_id, count(t.id) AS turns, count(DISTINCT t.person_id) AS people, CAST(coalesce(sum(t.word_count) FILTER (WHERE t.role_kind IS NULL), 0) AS BIGINT) AS member_words,
  count(*) FILTER (WHERE t.role_kind = 'presiding') AS chair, CAST(len(d.member_names) AS INTEGER) AS listed, (SELECT count(*) FROM debates e WHERE e.debate_date = d.debate_date AND e.id <> d.id) AS same_day
FROM debates d LEFT JOIN turns t ON t.debate_id = d.id GROUP BY d.id, d.member_names, d.debate_date""")
def debate_overview(spark: SparkSession, folder: str) -> DataFrame:
    """Each debate's people, words and chair turns, and how many other debates its day has."""
    d = load(spark, folder, "debates", "id", "member_names", "debate_date").withColumnRenamed("id", "debate_id")
    t = load(spark, folder, "turns", "debate_id", "id", "person_id", "word_count", "role_kind")
    by = t.groupBy("debate_id").agg(F.count("id").alias("turns"), F.count_distinct("person_id").alias("people"), F.sum(F.when(F.col("role_kind").isNull(), F.col("word_count"))).alias("member_words"), F.count_if(F.col("role_kind") == "presiding").alias("chair"))
    days = d.where("debate_date is not null").groupBy("debate_date").agg((F.count("*") - 1).alias("same_day"))
    return d.join(by, "debate_id", "left").join(days, "debate_date", "left").select(
        "debate_id", *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("turns", "people", "member_words", "chair")), F.when(F.col("member_names").isNotNull(), F.size("member_names")).alias("listed"), F.coalesce("same_day", F.lit(0).cast("bigint")).alias("same_day"))


@query("PAG22", """
WITH e AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS k FROM events WHERE event_type IN ('purchase', 'error', 'view') AND value > 60 GROUP BY 1),
s AS (SELECT user_id, CASE WHEN list_contains(k, 'purchase') AND list_contains(k, 'error') THEN 'mixed' WHEN list_contains(k, 'purchase') THEN 'for' WHEN list_contains(k, 'error') THEN 'against' ELSE 'unclear' END AS stance FROM e)
SELECT stance, count(*) AS members FROM s GROUP BY 1""")
def bill_member_stance(spark: SparkSession, folder: str) -> DataFrame:
    """Members' stances rolled up from their acts: for and against make mixed, a clear one wins over none."""
    e = load(spark, folder, "events", "user_id", "event_type", "value")
    has = lambda v: F.max(F.col("event_type") == v)
    s = e.where(F.col("event_type").isin("purchase", "error", "view") & (F.col("value") > 60)).groupBy("user_id").agg(has("purchase").alias("f"), has("error").alias("a"))
    stance = F.when(F.col("f") & F.col("a"), "mixed").when(F.col("f"), "for").when(F.col("a"), "against").otherwise("unclear")
    return s.groupBy(stance.alias("stance")).agg(F.count("*").alias("members"))


@query("PAG23 WIN02 SRT07", f"""
WITH {S}, n AS (SELECT party, tag, count(*) AS n FROM s GROUP BY 1, 2) SELECT party, string_agg(tag, ', ' ORDER BY n DESC, tag) AS top FROM (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY party ORDER BY n DESC, tag) <= 5) GROUP BY 1""")
def bill_top_tags(spark: SparkSession, folder: str) -> DataFrame:
    """The five most frequent tags of each group as one text."""
    n = sales(spark, folder).groupBy("party", "tag").agg(F.count("*").alias("n"))
    top = rel.top_per_group(n, ["party"], [F.desc("n"), F.col("tag")], 5)
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "tag")))
    return top.groupBy("party").agg(F.array_join(F.transform(ordered, lambda x: x["tag"]), ", ").alias("top"))


@query("PAG24 PAG29", """
SELECT count(*) AS turns, count(person_id) AS named, count(*) FILTER (WHERE person_id IS NULL AND role_kind IS NULL) AS unnamed, CAST(sum(word_count) AS BIGINT) AS words, round(sum(word_count) FILTER (WHERE person_id IS NOT NULL) / CAST(sum(word_count) AS DOUBLE), 6) AS named_share,
  (SELECT count(*) FROM speech_search) AS speeches, (SELECT count(*) > 0 FROM tags WHERE status = 'reviewed') AS has_reviewed FROM turns""")
def method_figures(spark: SparkSession, folder: str) -> DataFrame:
    """Coverage figures of the corpus in one row."""
    t = load(spark, folder, "turns", "person_id", "role_kind", "word_count").agg(
        F.count("*").alias("turns"), F.count("person_id").alias("named"), F.count_if(F.col("person_id").isNull() & F.col("role_kind").isNull()).alias("unnamed"), F.sum("word_count").alias("words"),
        agg.ratio(F.sum(F.when(F.col("person_id").isNotNull(), F.col("word_count"))), F.sum("word_count")).alias("named_share"))
    s = load(spark, folder, "speech_search", "speech_id").agg(F.count("*").alias("speeches"))
    r = load(spark, folder, "tags", "status").agg(F.coalesce(F.max(F.col("status") == "reviewed"), F.lit(False)).alias("has_reviewed"))
    return t.join(s).join(r)


DQ = {"debates": ("id",), "turns": ("id",), "speech_search": ("speech_id",), "tags": ("id",), "subjects": ("id",), "entity_names": ("norm_name", "type"), "documents": ("doc_id",), "tag_embeddings": ("tag_id", "model", "task_type")}


@query("SEQ02", " UNION ALL ".join(f"SELECT 'unique {t}' AS rule, count(*) AS broken FROM (SELECT 1 FROM {t} GROUP BY {', '.join(k)} HAVING count(*) > 1)" for t, k in DQ.items()) + """
 UNION ALL SELECT 'turn of a debate', count(*) FROM turns t WHERE NOT EXISTS (SELECT 1 FROM debates d WHERE d.id = t.debate_id)
 UNION ALL SELECT 'merged tag is there', count(*) FROM tags t WHERE merged_into IS NOT NULL AND NOT EXISTS (SELECT 1 FROM tags u WHERE u.id = t.merged_into)
 UNION ALL SELECT 'merged means a target', count(*) FROM tags WHERE (status = 'merged') <> (merged_into IS NOT NULL)
 UNION ALL SELECT 'known status', count(*) FROM tags WHERE status NOT IN ('reviewed', 'unverified', 'rejected', 'merged')""")
def dq_constraints(spark: SparkSession, folder: str) -> DataFrame:
    """How often each key, reference and value rule is broken."""
    one = lambda name, df: df.agg(F.count("*").alias("broken")).select(F.lit(name).alias("rule"), "broken")
    parts = [one(f"unique {t}", load(spark, folder, t, *k).groupBy(*k).agg(F.count("*").alias("n")).where("n > 1")) for t, k in DQ.items()]
    tags = load(spark, folder, "tags", "id", "status", "merged_into")
    turns, debates = load(spark, folder, "turns", "debate_id"), load(spark, folder, "debates", "id").withColumnRenamed("id", "debate_id")
    parts += [
        one("turn of a debate", turns.join(debates, "debate_id", "left_anti")),
        one("merged tag is there", tags.where("merged_into is not null").join(tags.select(F.col("id").alias("merged_into")), "merged_into", "left_anti")),
        one("merged means a target", tags.where((F.col("status") == "merged") != F.col("merged_into").isNotNull())),
        one("known status", tags.where(rel.not_in_known(F.col("status"), ["reviewed", "unverified", "rejected", "merged"]))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
