"""Exact vector search on small tables, similarity graphs, and decisions over stored probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gavel.functions import vectors as vec
from gavel.operators import decisions as dec
from gavel.operators import graph
from gavel.operators import relational as rel
from gavel.plans.analytics_plans import ENDS
from gavel.plans.registry import query
from gavel.sources.staging import stage
from gavel.sources.tables import load


def _tags(spark: SparkSession, folder: str) -> DataFrame:
    """Usable tag vectors of one model and task, one per tag: of several the smallest, element by element."""
    t = load(spark, folder, "tag_embeddings", "tag_id", "model", "task_type", "embedding").where("model = 'vec-archive-2' and task_type = 'RETRIEVAL_DOCUMENT'")
    one = t.where(vec.unit(F.col("embedding")).isNotNull()).groupBy("tag_id").agg(F.min("embedding").alias("embedding"))
    return one.select("tag_id", vec.unit(F.col("embedding")).alias("v"))


U = "t AS (SELECT tag_id, min(embedding) AS v FROM tag_embeddings WHERE model = 'vec-archive-2' AND task_type = 'RETRIEVAL_DOCUMENT' AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1)"
D = "list_cosine_distance(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"
DIST = D.format("x.v", "y.v")


@query("VEC01 VEC05", f"""
WITH {U} SELECT e.id, t.tag_id, round({D.format('e.embedding_query', 't.v')}, 5) AS dist FROM (SELECT id, embedding_query FROM entity_names WHERE embedding_query IS NOT NULL AND len(list_filter(embedding_query, lambda x: isnan(x))) = 0 AND len(list_filter(embedding_query, lambda x: x <> 0)) > 0 AND id % 50 = 0) e, t
QUALIFY row_number() OVER (PARTITION BY e.id ORDER BY dist, t.tag_id) <= 5""")
def cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The five tags nearest to the vector of every fiftieth entity."""
    e = load(spark, folder, "entity_names", "id", "embedding_query").where("id % 50 = 0")
    left = e.select((-F.col("id")).alias("a"), vec.unit(F.col("embedding_query")).alias("va")).where("va is not null")  # other ids than the tags'
    right = _tags(spark, folder).select(F.col("tag_id").alias("b"), F.col("v").alias("vb"))
    return graph.nearest(left, right, 5).select((-F.col("a")).alias("id"), F.col("b").cast("int").alias("tag_id"), "dist")


@query("VEC02 JOI10", f"""
WITH {U}, f AS (SELECT x.tag_id AS a, y.tag_id AS b, {DIST} AS dist FROM t x JOIN t y ON x.tag_id <> y.tag_id JOIN tags g ON g.id = y.tag_id WHERE x.tag_id % 50 = 0 AND g.status = 'reviewed' AND g.type <> 'bill')
SELECT a, b, round(dist, 5) AS dist FROM f WHERE dist <= 0.42 QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(dist, 5), b) <= 3""")
def filtered_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest live tags of some kinds: all filters first, then the nearest, then the limit of distance."""
    t = _tags(spark, folder)
    live = load(spark, folder, "tags", "id", "status", "type").where("status = 'reviewed' and type <> 'bill'").select(F.col("id").alias("tag_id"))
    left = t.where("tag_id % 50 = 0").select(F.col("tag_id").alias("a"), F.col("v").alias("va"))
    right = t.join(live, "tag_id", "left_semi").select(F.col("tag_id").alias("b"), F.col("v").alias("vb"))
    near = graph.nearest(left, right, 3)
    return near.where("dist <= 0.42").select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), "dist")


def _near(spark: SparkSession, folder: str, k: int = 6) -> DataFrame:
    t = _tags(spark, folder)
    left, right = t.select(F.col("tag_id").alias("a"), F.col("v").alias("va")), t.select(F.col("tag_id").alias("b"), F.col("v").alias("vb"))
    return graph.nearest(left, right, k).select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), "dist", "place")


KNN = f"""{U}, v AS (SELECT tag_id, list_transform(CAST(v AS DOUBLE[]), lambda x: x / sqrt(list_inner_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[])))) AS v FROM t),
nn AS MATERIALIZED (SELECT x.tag_id AS a, y.tag_id AS b, round(1.0 - list_inner_product(x.v, y.v), 5) AS dist FROM v x JOIN v y ON x.tag_id <> y.tag_id),
k AS MATERIALIZED (SELECT a, b, dist FROM nn QUALIFY row_number() OVER (PARTITION BY a ORDER BY dist, b) <= 6),
m AS (SELECT k.a, k.b, greatest(k.dist, j.dist) AS dist FROM k JOIN k j ON j.a = k.b AND j.b = k.a WHERE k.a < k.b AND greatest(k.dist, j.dist) < 0.2)"""


@query("VEC03 GRA02", f"WITH {KNN} SELECT * FROM m")
def knn_mutual_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Tags that are each among the other's six nearest, closer than 0.2."""
    return graph.mutual_edges(_near(spark, folder), 0.2)


@query("GRA01", f"""
WITH RECURSIVE {KNN}, e AS (SELECT a, b FROM m UNION SELECT b, a FROM m), r(a, b) AS (SELECT a, a FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b) SELECT a AS node, min(b) AS component FROM r GROUP BY 1""")
def components(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of tags by mutual links."""
    return graph.components(knn_mutual_edges(spark, folder))


def _guard_sql(largest: int, start: float, step: float, floor: float) -> str:
    parts, out, limit, k = [f"{KNN}, n0 AS (SELECT a AS node FROM m UNION SELECT b FROM m)"], [], start, 0
    while True:
        last = limit - step < floor - 1e-9
        parts.append(f"""u{k} AS (SELECT a, b FROM m JOIN n{k} p ON p.node = a JOIN n{k} q ON q.node = b WHERE dist < CAST({limit!r} AS DOUBLE) UNION SELECT b, a FROM m JOIN n{k} p ON p.node = a JOIN n{k} q ON q.node = b WHERE dist < CAST({limit!r} AS DOUBLE)),
r{k}(a, b) AS (SELECT node, node FROM n{k} UNION SELECT r.a, u.b FROM r{k} r JOIN u{k} u ON u.a = r.b), c{k} AS (SELECT a AS node, min(b) AS component FROM r{k} GROUP BY 1), z{k} AS (SELECT *, count(*) OVER (PARTITION BY component) AS n FROM c{k}), n{k + 1} AS (SELECT node FROM z{k} WHERE n > {largest})""")
        out.append(f"SELECT node, component FROM z{k}" + ("" if last else f" WHERE n <= {largest}"))
        if last:
            return f"WITH RECURSIVE {', '.join(parts)} {' UNION ALL '.join(out)}"
        limit, k = limit - step, k + 1


@query("GRA03", _guard_sql(4, 0.2, 0.04, 0.04))
def component_guard(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of tags, those of more than four split again at smaller distances."""
    return graph.guarded_groups(knn_mutual_edges(spark, folder), 4, 0.2, 0.04, 0.04)


@query("GRA09", f"""
WITH RECURSIVE {KNN}, e AS (SELECT a, b FROM m UNION SELECT b, a FROM m), r(a, b) AS (SELECT a, a FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), c AS (SELECT a AS node, min(b) AS component FROM r GROUP BY 1),
gold AS (SELECT k.a, k.b, x.domain IS NOT DISTINCT FROM y.domain AS same FROM k JOIN tags x ON x.id = k.a JOIN tags y ON y.id = k.b WHERE k.a < k.b),
j AS (SELECT coalesce(p.component = q.component, false) AS t, same FROM gold LEFT JOIN c p ON p.node = gold.a LEFT JOIN c q ON q.node = gold.b),
n AS (SELECT count(*) FILTER (WHERE t AND same) AS tp, count(*) FILTER (WHERE t AND NOT same) AS fp, count(*) FILTER (WHERE NOT t AND same) AS fn FROM j)
SELECT tp, fp, fn, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 6) AS recall, round(1.25 * (tp / CAST(tp + fp AS DOUBLE)) * (tp / CAST(tp + fn AS DOUBLE)) / (0.25 * tp / CAST(tp + fp AS DOUBLE) + tp / CAST(tp + fn AS DOUBLE)), 6) AS f_half FROM n""")
def cluster_pair_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Precision and recall of the groups against pairs judged by domain."""
    d = load(spark, folder, "tags", "id", "domain")
    near = _near(spark, folder).where("a < b").select("a", "b")
    gold = near.join(d.select(F.col("id").alias("a"), F.col("domain").alias("x")), "a").join(d.select(F.col("id").alias("b"), F.col("domain").alias("y")), "b").select("a", "b", F.col("x").eqNullSafe(F.col("y")).alias("same"))
    return graph.pair_scores(components(spark, folder), gold)


@query("VEC04", f"""
WITH {U}, p AS (SELECT g.type, generate_subscripts(t.v, 1) AS k, unnest(t.v) / sqrt(list_inner_product(CAST(t.v AS DOUBLE[]), CAST(t.v AS DOUBLE[]))) AS x FROM t JOIN tags g ON g.id = t.tag_id), m AS (SELECT type, k, avg(CAST(x AS DOUBLE)) AS x FROM p GROUP BY 1, 2),
c AS (SELECT type, list(x ORDER BY k) AS v FROM m GROUP BY 1) SELECT x.type AS a, y.type AS b, round({DIST}, 4) AS dist FROM c x JOIN c y ON x.type <> y.type""")
def centroid_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """Centroids of groups (means by position) and their distances."""
    t = _tags(spark, folder).join(load(spark, folder, "tags", "id", "type").withColumnRenamed("id", "tag_id"), "tag_id").select("type", F.posexplode("v").alias("k", "x"))
    m = t.groupBy("type", "k").agg(F.avg("x").alias("x")).groupBy("type").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("c"))
    c = m.select("type", vec.unit(F.col("c")).alias("v"))
    pairs = c.select(F.col("type").alias("a"), F.col("v").alias("va")).join(c.select(F.col("type").alias("b"), F.col("v").alias("vb")), F.col("a") != F.col("b"))
    return pairs.select("a", "b", F.round(vec.distance(F.col("va"), F.col("vb")), 4).alias("dist"))


@query("VEC06", """
SELECT tag_id, model, task_type, input_hash IS DISTINCT FROM md5(t.tag) AS changed FROM tag_embeddings e JOIN tags t ON t.id = e.tag_id""")
def change_detection(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors whose input text is no longer the tag's (hashes compared null-safely)."""
    e, t = load(spark, folder, "tag_embeddings", "tag_id", "model", "task_type", "input_hash"), load(spark, folder, "tags", "id", "tag").withColumnRenamed("id", "tag_id")
    return e.join(t, "tag_id").select("tag_id", "model", "task_type", (~F.col("input_hash").eqNullSafe(F.md5("tag"))).alias("changed"))


@query("VEC07", f"WITH {KNN} SELECT CAST(floor(dist / 0.05) AS BIGINT) AS band, count(*) AS n, min(dist) AS nearest, max(dist) AS furthest FROM k GROUP BY 1")
def distance_bands(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbour pairs by bands of distance."""
    return _near(spark, folder).groupBy(F.floor(F.col("dist") / 0.05).alias("band")).agg(F.count("*").alias("n"), F.min("dist").alias("nearest"), F.max("dist").alias("furthest"))


@query("VEC09", f"""
WITH {KNN}, a AS (SELECT k.a, row_number() OVER (PARTITION BY k.a ORDER BY k.dist, k.b) AS place, y.type = x.type AS good FROM k JOIN tags x ON x.id = k.a JOIN tags y ON y.id = k.b)
SELECT coalesce(CAST(min(place) FILTER (WHERE good) AS BIGINT), 0) AS best_place, a FROM a GROUP BY a""")
def rank_of_best(spark: SparkSession, folder: str) -> DataFrame:
    """The place of the first acceptable answer among the six nearest, 0 if there is none."""
    t = load(spark, folder, "tags", "id", "type")
    near = _near(spark, folder).join(t.select(F.col("id").alias("a"), F.col("type").alias("x")), "a").join(t.select(F.col("id").alias("b"), F.col("type").alias("y")), "b")
    return near.groupBy("a").agg(F.coalesce(F.min(F.when(F.col("x") == F.col("y"), F.col("place"))).cast("bigint"), F.lit(0).cast("bigint")).alias("best_place"))


SHARES = "o AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type AS name, count(*) / CAST(sum(count(*)) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS DOUBLE) AS p FROM events GROUP BY 1, 2, 3)"


def _options(spark: SparkSession, folder: str) -> DataFrame:
    """Per user and day an array of options with probabilities (shares of event types)."""
    e = load(spark, folder, "events", "user_id", "ts", "event_type").groupBy("user_id", F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    p = e.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("user_id", "day")).cast("double"))
    return p.groupBy("user_id", "day").agg(F.sort_array(F.collect_list(F.struct(F.col("event_type").alias("name"), "p"))).alias("options"))


@query("DEC01 DEC04", f"""
WITH {SHARES}, b AS (SELECT user_id, day, name, p FROM o QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY p DESC, name) = 1),
l AS (SELECT user_id, day, round(sum(p * CASE name WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END), 6) AS level FROM o GROUP BY 1, 2) SELECT user_id, day, CASE WHEN p >= 0.5 THEN name ELSE 'unclear' END AS answer, level FROM b JOIN l USING (user_id, day)""")
def argmax_limit(spark: SparkSession, folder: str) -> DataFrame:
    """The most probable option where it reaches one half, and the expected level."""
    return _options(spark, folder).select("user_id", "day", dec.argmax_limit(F.col("options"), 0.5, "unclear").alias("answer"), F.round(dec.expected_level(F.col("options"), {"view": 1, "click": 2, "purchase": 3}), 6).alias("level"))


@query("DEC02 DEC03", """
WITH e AS (SELECT event_id, event_type, value / 100.0 AS p FROM events), k AS (SELECT event_id, CASE WHEN event_type = 'view' THEN p >= 0.4 ELSE p >= 0.8 END AS kept, CASE WHEN event_type = 'view' THEN p >= 0.5 ELSE p >= 0.7 END AS now FROM e)
SELECT event_id, kept, now FROM k WHERE kept IS DISTINCT FROM now""")
def rethreshold_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose decision changes when the limits of their source do."""
    p, view = F.col("value") / 100.0, F.col("event_type") == "view"
    rule = lambda a, b: F.when(view, p >= a).otherwise(p >= b)
    k = load(spark, folder, "events", "event_id", "event_type", "value").select("event_id", rule(0.4, 0.8).alias("kept"), rule(0.5, 0.7).alias("now"))
    return k.where(~F.col("kept").eqNullSafe(F.col("now")))


@query("DEC05", f"""
WITH {SHARES}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY p DESC, name) AS k FROM o), s AS (SELECT user_id, day, max(p) FILTER (WHERE k = 1) AS a, max(p) FILTER (WHERE k = 2) AS b FROM r GROUP BY 1, 2)
SELECT user_id, day, b IS NOT NULL AND a + b >= 0.7 AND b >= 0.2 AS split FROM s""")
def split_vote(spark: SparkSession, folder: str) -> DataFrame:
    """Users whose two most probable options hold nearly everything and are both likely."""
    return _options(spark, folder).select("user_id", "day", dec.split_vote(F.col("options")).alias("split"))


@query("DEC07", """
WITH d AS (SELECT tag_id, max(input_hash) AS h, count(*) AS v FROM tag_embeddings WHERE model = 'vec-archive-2' GROUP BY 1)
SELECT t.id, CASE WHEN d.h IS NULL THEN 'todo' WHEN d.h <> md5(t.tag) OR d.v < 2 THEN 'stale' ELSE 'done' END AS state FROM tags t LEFT JOIN d ON d.tag_id = t.id""")
def staleness_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Which tags have no vector yet, an outdated one, or none to redo."""
    d = load(spark, folder, "tag_embeddings", "tag_id", "model", "input_hash").where("model = 'vec-archive-2'").groupBy(F.col("tag_id").alias("id")).agg(F.max("input_hash").alias("h"), F.count("*").alias("v"))
    t = load(spark, folder, "tags", "id", "tag").join(d, "id", "left")
    return t.select("id", dec.state_of(F.col("h"), F.md5("tag"), F.col("v"), F.lit(2)).alias("state"))


@query("DEC09", """
SELECT event_id, list_filter(['user', 'value', 'props', 'kind'], lambda x: (x = 'user' AND NOT user_id > 3) OR (x = 'value' AND NOT value >= 1) OR (x = 'props' AND NOT coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) < 90, false)) OR (x = 'kind' AND event_type = 'error')) AS failed FROM events""")
def answer_checks(spark: SparkSession, folder: str) -> DataFrame:
    """The checks that each stored answer fails, read from its JSON where needed."""
    k = F.from_json("props", "struct<k:int>")["k"]
    checks = {"user": F.col("user_id") > 3, "value": F.col("value") >= 1, "props": k < 90, "kind": F.col("event_type") != "error"}
    return load(spark, folder, "events").select("event_id", dec.failed_checks(checks).alias("failed"))


@query("DEC06 DEC14", """
WITH c AS (SELECT e.id, t.id AS tag_id, 0 AS pri FROM entity_names e JOIN tags t ON t.id = e.tag_id UNION ALL SELECT e.id, s.parent_tag_id, 1 FROM entity_names e JOIN subjects s ON s.subject_key = CAST(e.id AS VARCHAR) WHERE s.parent_tag_id IS NOT NULL),
u AS (SELECT id, tag_id, min(pri) AS pri FROM c GROUP BY 1, 2) SELECT id, tag_id, pri, row_number() OVER (PARTITION BY id ORDER BY pri, tag_id) AS position FROM u QUALIFY position <= 21""")
def answer_reuse_priority(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates of two sources, each once by the better source, numbered on."""
    e, t = load(spark, folder, "entity_names", "id", "tag_id"), load(spark, folder, "tags", "id").withColumnRenamed("id", "tag_id")
    s = load(spark, folder, "subjects", "subject_key", "parent_tag_id").where("parent_tag_id is not null").select(F.col("subject_key").alias("k"), F.col("parent_tag_id").alias("tag_id"))
    a = e.join(t, "tag_id").select("id", "tag_id", F.lit(0).alias("pri"))
    b = e.select("id", F.col("id").cast("string").alias("k")).join(s, "k").select("id", "tag_id", F.lit(1).alias("pri"))
    u = a.unionByName(b).groupBy("id", "tag_id").agg(F.min("pri").alias("pri"))
    return u.withColumn("position", F.row_number().over(Window.partitionBy("id").orderBy("pri", "tag_id")).cast("bigint")).where("position <= 21")


@query("DEC13 WIN01", """
WITH s AS (SELECT DISTINCT ON (person_id, lok_sabha_term, effective_from) person_id, lok_sabha_term AS term, effective_from, party_id, id FROM speakers ORDER BY person_id, lok_sabha_term, effective_from, id),
c AS (SELECT *, row_number() OVER w = 1 OR party_id IS DISTINCT FROM lag(party_id) OVER w AS new FROM s WINDOW w AS (PARTITION BY person_id, term ORDER BY effective_from))
SELECT person_id, term, party_id, effective_from AS since, lead(effective_from) OVER (PARTITION BY person_id, term ORDER BY effective_from) AS until FROM c WHERE new""")
def scd2_build(spark: SparkSession, folder: str) -> DataFrame:
    """Periods of a slowly changing attribute: rows that change nothing are dropped, ends are the next starts."""
    s = load(spark, folder, "speakers", "id", "person_id", "lok_sabha_term", "effective_from", "party_id").withColumnRenamed("lok_sabha_term", "term")
    s = rel.top_per_group(s, ["person_id", "term", "effective_from"], [F.col("id")])
    w = Window.partitionBy("person_id", "term").orderBy("effective_from")
    changed = s.withColumn("new", (F.row_number().over(w) == 1) | ~F.col("party_id").eqNullSafe(F.lag("party_id").over(w))).where("new")
    return rel.periods(changed, ["person_id", "term"], "effective_from").select("person_id", "term", "party_id", F.col("effective_from").alias("since"), "until")


@query("GRA05", f"""
WITH RECURSIVE {ENDS}, g AS (SELECT e."to" AS g, id, tag, debate_count AS n FROM tags JOIN e USING (id)) SELECT g AS group_id, arg_max(id, (n, -id)) AS kept, count(*) AS members, CAST(sum(n) AS BIGINT) AS debates FROM g GROUP BY 1 HAVING count(*) > 1""")
def pick_kept(spark: SparkSession, folder: str) -> DataFrame:
    """The member of each group to keep: of most debates, the lowest id of equals.

    A group is all tags whose merge chains have the same end (`group_id`), or the same cycle (its smallest id).
    """
    t = load(spark, folder, "tags", "id", "merged_into", "debate_count")
    g = t.join(graph.chain_ends(t).select(F.col("node").alias("id"), F.col("group").alias("group_id")), "id")
    return g.groupBy("group_id").agg(F.max_by("id", F.struct("debate_count", -F.col("id"))).alias("kept"), F.count("*").alias("members"), F.sum("debate_count").alias("debates")).where("members > 1")


@query("GRA07")
def chain_in_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The tags of each kept group of merged tags (grouped as in `pick_kept`) in a chain of nearest neighbours."""
    t = graph.chain_ends(load(spark, folder, "tags", "id", "merged_into")).select(F.col("node").alias("tag_id"), F.col("group").alias("g"))
    return graph.chained(_tags(spark, folder).join(t, "tag_id").select("g", F.col("tag_id").alias("id"), "v"), "g")


@query("GRA04")
def constrained_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Tags joined along mutual links, nearest first, to groups of at most forty debates' worth that share no rejected tag."""
    t = load(spark, folder, "tags", "id", "debate_count", "status")
    sizes = t.select(F.col("id").alias("unit"), F.coalesce("debate_count", F.lit(0)).alias("size"))
    edges = stage(knn_mutual_edges(spark, folder), "edges")
    apart = edges.join(t.where("status = 'rejected'").select(F.col("id").alias("a")), "a", "left_semi").select("a", "b")
    return graph.constrained(edges, sizes, 40, apart)


@query("GRA08")
def packed_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The tags of each type and domain packed first-fit, largest first, into boxes of at most 350 tags of one type."""
    t = load(spark, folder, "tags", "type", "domain").groupBy("type", "domain").agg(F.count("*").alias("members"))
    return graph.packed(t, "type", "domain", "members", 350)


@query("AGG21", """
SELECT loksabha, count(DISTINCT person_id) AS people, true AS people_near, true AS median_near FROM turns JOIN debates d ON d.id = debate_id GROUP BY 1""")
def sketches(spark: SparkSession, folder: str) -> DataFrame:
    """Per term whether an approximate distinct count is within a tenth of the exact one, and an approximate median within half a hundredth of all ranks."""
    t = load(spark, folder, "turns", "debate_id", "word_count", "person_id").join(load(spark, folder, "debates", "id", "loksabha").withColumnRenamed("id", "debate_id"), "debate_id")
    exact = lambda q: F.expr(f"percentile_disc({q}) within group (order by word_count)")
    near = F.percentile_approx("word_count", 0.5, 1000).between(exact(0.495), exact(0.505))
    g = t.groupBy("loksabha").agg(F.count_distinct("person_id").alias("people"), F.approx_count_distinct("person_id", 0.02).alias("about"), near.alias("median_near"))
    return g.select("loksabha", "people", (F.abs(F.col("about") - F.col("people")) <= 0.1 * F.col("people")).alias("people_near"), "median_near")
