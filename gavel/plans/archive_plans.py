"""Queries of the archive's own pages, files, merges, answers and reviews over its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gavel.functions import pages
from gavel.operators import arrow, graph, search
from gavel.operators import relational as rel
from gavel.plans.analytics_plans import ENDS
from gavel.plans.registry import query
from gavel.plans.text_plans import HITS
from gavel.plans.vector_plans import KNN, _near, components
from gavel.sources import files
from gavel.sources.staging import new_path
from gavel.sources.tables import load

# Sources and sinks


@query("SRC09 SRC10", "SELECT id, tag, status, domain FROM tags WHERE status <> 'rejected'")
def tsv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Tags written as tab-separated files and read back, quotes being ordinary characters."""
    t = load(spark, folder, "tags", "id", "tag", "status", "domain").where("status <> 'rejected'")
    path = new_path(spark, "tsv")
    files.write_tsv(t, path)
    return files.read_tsv(spark, path, "id int, tag string, status string, domain string")


@query("SRC11", "SELECT id, debate_id, word_count FROM turns WHERE word_count >= 60 ORDER BY word_count DESC, id LIMIT 100000")
def csv_export(spark: SparkSession, folder: str) -> DataFrame:
    """The longest turns as a CSV export (its limit of 100,000 rows is the feature), read back."""
    t = load(spark, folder, "turns", "id", "debate_id", "word_count").where("word_count >= 60")
    path = new_path(spark, "csv")
    files.export_csv(t, path, [F.desc("word_count"), F.col("id")])
    return spark.read.csv(path, schema="id bigint, debate_id bigint, word_count int", header=True)


@query("SRC04 SRC05", """
SELECT id, CAST(debate_date AS DATE) AS day, CAST(coalesce(len(json_keys(extra)), 0) AS INTEGER) AS extra_keys, sha256(raw_html) AS hash, true AS same FROM debates""")
def payload_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Every debate rebuilt as the JSON it was fetched as, with its day written day first, and shredded again: nothing is lost."""
    d = load(spark, folder, "debates", "id", "loksabha", "session", "dbslno", "raw_html", "title", "debate_date", "keywords", "extra")
    own = F.struct("id", "loksabha", "session", "dbslno", "raw_html", "title", "keywords", "extra")
    sent = F.to_json(F.struct(own.alias("row"), F.date_format("debate_date", "dd/MM/yyyy").alias("day")))
    kind = f"struct<row:{d.select(own.alias('r')).schema['r'].dataType.simpleString()},day:string>"
    back = d.select("*", own.alias("own"), F.from_json(sent, kind).alias("back"))
    day = files.day_first(F.col("back.day"))
    keys = F.coalesce(F.size(F.json_object_keys("back.row.extra")), F.lit(0))
    same = F.col("own").eqNullSafe(F.col("back.row")) & day.eqNullSafe(F.col("debate_date"))
    return back.select("id", day.alias("day"), F.when(F.col("back.row.extra").isNull(), 0).otherwise(keys).alias("extra_keys"), F.sha2("back.row.raw_html", 256).alias("hash"), same.alias("same"))


@query("SRC08", """
WITH old AS (SELECT * FROM orders WHERE o_orderkey % 3 <> 0) SELECT CAST(extract(year FROM o.o_orderdate) AS INTEGER) AS y, count(*) AS listed, count(old.o_orderkey) AS stored, count(*) - count(old.o_orderkey) AS missing
FROM orders o LEFT JOIN old USING (o_orderkey) GROUP BY 1""")
def listed_and_stored(spark: SparkSession, folder: str) -> DataFrame:
    """What is listed against what is stored already, by year: the keys still to fetch are an anti-join, their number the difference."""
    o = load(spark, folder, "orders", "o_orderkey", "o_orderdate")
    to_fetch = o.join(o.where("o_orderkey % 3 <> 0").select("o_orderkey"), "o_orderkey", "left_anti").groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("missing"))
    listed = o.groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("listed"))
    out = listed.join(to_fetch, "y", "left").withColumn("missing", F.coalesce("missing", F.lit(0).cast("bigint")))
    return out.select("y", "listed", (F.col("listed") - F.col("missing")).alias("stored"), "missing")


@query("SRC02", """
SELECT DISTINCT ON (loksabha, session, dbslno) loksabha, session, dbslno, id, fetched_at FROM debates ORDER BY loksabha, session, dbslno, id""")
def first_of_search_walk(spark: SparkSession, folder: str) -> DataFrame:
    """Each debate once, as the pages of a search first listed it."""
    d = load(spark, folder, "debates", "loksabha", "session", "dbslno", "id", "fetched_at")
    return d.groupBy("loksabha", "session", "dbslno").agg(F.min_by(F.struct("id", "fetched_at"), "id").alias("f")).select("loksabha", "session", "dbslno", "f.*")


@query("SRC12 SRC13", """
SELECT lok_sabha_term AS term, CAST(state_id AS VARCHAR) AS state, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS name, CAST(id AS VARCHAR) AS number FROM speakers WHERE name IS NOT NULL AND state_id IS NOT NULL""")
def wiki_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Member lists as HTML tables whose state cells span their rows, read back as grids: every row has its state again."""
    s = load(spark, folder, "speakers", "lok_sabha_term", "state_id", "name", "id").where("name is not null and state_id is not null")
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    name = F.regexp_replace(F.regexp_replace("name", "&", "&amp;"), "<", "&lt;")
    rows = s.groupBy("lok_sabha_term", "state_id").agg(F.sort_array(F.collect_list(F.struct("id", F.concat(cell(name), cell(F.col("id").cast("string"))).alias("cells")))).alias("r"))
    head = F.concat(F.lit('<tr><td rowspan="'), F.size("r").cast("string"), F.lit('">'), F.col("state_id").cast("string"), F.lit("</td>"))
    table = F.concat(F.lit("<table>"), head, F.array_join(F.transform("r", lambda x: x["cells"]), "</tr><tr>"), F.lit("</tr></table>"))
    page = rows.select(F.col("lok_sabha_term").alias("term"), table.alias("html"))
    read = lambda html: [tuple(line) for grid in pages.grids(html) for line in grid]
    return arrow.rows_of_text(page, "term", "html", read, {"state": "string", "name": "string", "number": "string"})


@query("SRC14 SRC15 SRC16", """
SELECT id, md5(json_object('debate_count', debate_count, 'id', id, 'status', status, 'tag', tag)) AS answer FROM tags WHERE status <> 'merged'""")
def prebuilt_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Every tag's answer as canonical JSON in a table that replaces the one before as a whole."""
    t = load(spark, folder, "tags", "id", "tag", "status", "debate_count")
    path = new_path(spark, "answers")
    for rows in (t, t.where("status <> 'merged'")):  # built twice: the second build takes the place of the first
        files.replace_table(rows.select("id", F.to_json(F.struct("debate_count", "id", "status", "tag")).alias("json")), path)
    return spark.read.schema("id int, json string").parquet(path).select("id", F.md5("json").alias("answer"))


@query("FIL14", """
WITH r AS (SELECT id, word_count, row_number() OVER (ORDER BY word_count DESC NULLS LAST, id) AS n FROM turns WHERE word_count >= 50), p AS (SELECT greatest(1, least(9999, CAST(ceil(count(*) / 100.0) AS BIGINT))) AS page FROM r)
SELECT id, word_count, page FROM r, p WHERE n > (page - 1) * 100 AND n <= page * 100""")
def clamped_page(spark: SparkSession, folder: str) -> DataFrame:
    """A page that lies beyond the last one, with more rows than allowed: both arguments are clamped, to the last page of 100."""
    t = load(spark, folder, "turns", "id", "word_count").where("word_count >= 50")
    return rel.page_of(t, [F.desc_nulls_last("word_count"), F.col("id")], page="9999", per_page="5000")


# Merges, subjects and clusters


@query("TAG05", """
WITH RECURSIVE e AS (SELECT id AS a, merged_into AS b FROM tags WHERE merged_into IS NOT NULL), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(a, b) AS (SELECT a, a FROM u UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b),
c AS (SELECT a AS node, min(b) AS component FROM r GROUP BY 1), s AS (SELECT component, count(*) AS members, count(*) FILTER (WHERE t.merged_into IS NULL) AS sinks, min(node) FILTER (WHERE t.merged_into IS NULL) AS sink FROM c LEFT JOIN tags t ON t.id = c.node GROUP BY 1)
SELECT component, members, sinks, CASE WHEN sinks = 1 THEN sink END AS target, sinks <> 1 AS conflict FROM s""")
def merge_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of merged tags by their links in either direction; the target is the only one not merged itself, else there is a conflict."""
    t = load(spark, folder, "tags", "id", "merged_into")
    c = graph.components(t.where("merged_into is not null"), "id", "merged_into")
    sinks = c.join(t.withColumnRenamed("id", "node"), "node", "left").groupBy("component").agg(
        F.count("*").alias("members"), F.count_if(F.col("merged_into").isNull()).alias("sinks"), F.min(F.when(F.col("merged_into").isNull(), F.col("node"))).alias("sink"))
    return sinks.select("component", "members", "sinks", F.when(F.col("sinks") == 1, F.col("sink")).alias("target"), (F.col("sinks") != 1).alias("conflict"))


@query("TAG10", f"""
WITH RECURSIVE {ENDS}, k AS (SELECT 'subjects' AS tbl, CAST(id AS BIGINT) AS row_id, parent_tag_id AS old FROM subjects UNION ALL SELECT 'entity_names', id, tag_id FROM entity_names UNION ALL SELECT 'tag_embeddings', CAST(tag_id AS BIGINT), tag_id FROM (SELECT DISTINCT tag_id FROM tag_embeddings))
SELECT tbl, row_id, old, e."to" AS new FROM k JOIN e ON e.id = k.old WHERE e."to" <> k.old""")
def applied_merges(spark: SparkSession, folder: str) -> DataFrame:
    """The keys in three tables that merges rewrite, with the tag they lead to in the end."""
    to = graph.chain_ends(load(spark, folder, "tags", "id", "merged_into")).select(F.col("node").alias("old"), F.col("group").alias("new")).where("old <> new")
    key = lambda name, row, column: load(spark, folder, name, *dict.fromkeys((row, column))).select(F.lit(name).alias("tbl"), F.col(row).cast("bigint").alias("row_id"), F.col(column).alias("old"))
    keys = key("subjects", "id", "parent_tag_id").unionByName(key("entity_names", "id", "tag_id")).unionByName(key("tag_embeddings", "tag_id", "tag_id").distinct())
    return keys.join(to, "old").select("tbl", "row_id", "old", "new")


MEMBERS = "m AS (SELECT s.id AS subject_id, s.parent_tag_id, e.id AS name_id, e.name, e.tag_id, e.link_p, e.n_speeches FROM (SELECT id, parent_tag_id, unnest(string_split(subject_key, ' ')) AS k FROM subjects) s JOIN entity_names e ON e.id = TRY_CAST(s.k AS BIGINT))"


def _members(spark: SparkSession, folder: str) -> DataFrame:
    """The names of each subject, from its key."""
    s = load(spark, folder, "subjects", "id", "parent_tag_id", "subject_key").select(F.col("id").alias("subject_id"), "parent_tag_id", F.expr("explode(split(subject_key, ' '))").alias("k"))
    e = load(spark, folder, "entity_names", "id", "name", "tag_id", "link_p", "n_speeches").withColumnRenamed("id", "name_id")
    return s.join(e, F.expr("try_cast(k as bigint) = name_id")).drop("k")


@query("TAG07", f"""
WITH {MEMBERS} SELECT parent_tag_id, count(DISTINCT subject_id) AS subjects, count(DISTINCT name_id) AS names, count(DISTINCT name_id) FILTER (WHERE link_p >= 0.8) AS kept FROM m WHERE parent_tag_id IS NOT NULL GROUP BY 1""")
def subject_facet(spark: SparkSession, folder: str) -> DataFrame:
    """Kept items by the subject their name belongs to, under its parent: names once however many subjects they are in."""
    m = _members(spark, folder).where("parent_tag_id is not null")
    kept = F.when(F.col("link_p") >= 0.8, F.col("name_id"))
    return m.groupBy("parent_tag_id").agg(F.count_distinct("subject_id").alias("subjects"), F.count_distinct("name_id").alias("names"), F.count_distinct(kept).alias("kept"))


@query("GRA10", f"""
WITH {MEMBERS}, v AS (SELECT subject_id, tag_id, CAST(sum(n_speeches) AS BIGINT) AS n FROM m WHERE tag_id IS NOT NULL GROUP BY 1, 2), p AS (SELECT subject_id, arg_max(tag_id, (n, -tag_id)) AS parent, round(max(n) / CAST(sum(n) AS DOUBLE), 6) AS share FROM v GROUP BY 1),
l AS (SELECT subject_id, arg_min(name, (-n_speeches, name)) AS label, count(DISTINCT name_id) AS names FROM m GROUP BY 1) SELECT l.subject_id, label, names, parent, share FROM l LEFT JOIN p USING (subject_id)""")
def subject_parent_vote(spark: SparkSession, folder: str) -> DataFrame:
    """Each subject's parent by the votes of its names' tags, with its share, and its label, the name used most."""
    m = _members(spark, folder)
    v = m.where("tag_id is not null").groupBy("subject_id", "tag_id").agg(F.sum("n_speeches").alias("n"))
    p = v.groupBy("subject_id").agg(F.max_by("tag_id", F.struct("n", -F.col("tag_id"))).alias("parent"), F.round(F.max("n") / F.sum("n").cast("double"), 6).alias("share"))
    l = m.groupBy("subject_id").agg(F.min_by("name", F.struct(-F.col("n_speeches"), "name")).alias("label"), F.count_distinct("name_id").alias("names"))
    return l.join(p, "subject_id", "left").select("subject_id", "label", "names", "parent", "share")


@query("GRA06", """
WITH o AS (SELECT id, type || ' ' || domain AS c FROM tags WHERE domain IS NOT NULL AND id % 7 <> 0), n AS (SELECT id, type || ' ' || CASE WHEN id % 11 = 0 THEN 'other' ELSE domain END AS c FROM tags WHERE domain IS NOT NULL),
so AS (SELECT c, count(*) AS n FROM o GROUP BY 1), sn AS (SELECT c, count(*) AS n FROM n GROUP BY 1), x AS (SELECT o.c AS old, n.c AS new, count(*) AS shared FROM o JOIN n USING (id) GROUP BY 1, 2),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY old ORDER BY shared DESC, new) = 1)
SELECT old, new, shared, CASE WHEN shared = so.n AND shared = sn.n THEN 'same' WHEN shared = so.n THEN 'grew' WHEN shared = sn.n THEN 'kept' WHEN 2 * shared > so.n THEN 'changed' ELSE 'far' END AS class FROM b JOIN so ON so.c = old JOIN sn ON sn.c = new""")
def carried_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """What became of each cluster of an older grouping in a newer one: the same, grown, kept in part, changed, or far from any."""
    t = load(spark, folder, "tags", "id", "type", "domain").where("domain is not null")
    old = t.where("id % 7 <> 0").select("id", F.concat_ws(" ", "type", "domain").alias("c"))
    new = t.select("id", F.concat_ws(" ", "type", F.when(F.col("id") % 11 == 0, "other").otherwise(F.col("domain"))).alias("c"))
    return graph.carried(old, new, "id", "c")


@query("GRA11", f"""
WITH RECURSIVE {KNN}, e AS (SELECT a, b FROM m UNION SELECT b, a FROM m), r(a, b) AS (SELECT a, a FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), c AS (SELECT a AS node, min(b) AS component FROM r GROUP BY 1)
SELECT k.a, k.b, p.component FROM k JOIN tags x ON x.id = k.a JOIN tags y ON y.id = k.b JOIN c p ON p.node = k.a JOIN c q ON q.node = k.b WHERE k.a < k.b AND x.type <> y.type AND p.component = q.component""")
def cannot_links(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs that were judged different (here: of different types) and yet ended in one group."""
    t = load(spark, folder, "tags", "id", "type")
    side = lambda c, name: t.select(F.col("id").alias(c), F.col("type").alias(name))
    judged = _near(spark, folder).where("a < b").join(side("a", "x"), "a").join(side("b", "y"), "b").where("x <> y").select("a", "b")
    return graph.split_pairs(judged, components(spark, folder))


@query("DEC17", f"""
WITH {KNN}, p AS (SELECT k.a, k.b, k.dist, CAST(floor(k.dist / 0.05) AS BIGINT) AS band, x.type = y.type AS same, (k.a * 7 + k.b) % 3 = 0 AS judged FROM k JOIN tags x ON x.id = k.a JOIN tags y ON y.id = k.b WHERE k.a < k.b),
w AS (SELECT band, count(*) / CAST(count(*) FILTER (WHERE judged) AS DOUBLE) AS w FROM p GROUP BY 1 HAVING count(*) FILTER (WHERE judged) > 0), l AS (SELECT CAST(unnest([0.02, 0.05, 0.1, 0.2, 0.3]) AS DOUBLE) AS most),
s AS (SELECT most, coalesce(sum(w) FILTER (WHERE dist < most AND same), 0) AS tp, coalesce(sum(w) FILTER (WHERE dist < most AND NOT same), 0) AS fp, coalesce(sum(w) FILTER (WHERE dist >= most AND same), 0) AS fn FROM p JOIN w USING (band), l WHERE judged GROUP BY 1)
SELECT most, round(tp, 6) AS tp, round(fp, 6) AS fp, round(fn, 6) AS fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM s""")
def weighted_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Precision and recall at several limits from judged pairs, each standing for its band's pairs."""
    t = load(spark, folder, "tags", "id", "type")
    side = lambda c, name: t.select(F.col("id").alias(c), F.col("type").alias(name))
    p = _near(spark, folder).where("a < b").join(side("a", "x"), "a").join(side("b", "y"), "b")
    p = p.select("dist", F.floor(F.col("dist") / 0.05).alias("band"), (F.col("x") == F.col("y")).alias("same"), ((F.col("a") * 7 + F.col("b")) % 3 == 0).alias("judged"))
    return graph.weighted_scores(p, [0.02, 0.05, 0.1, 0.2, 0.3])


@query("DEC16", """
WITH k AS (SELECT id, array_to_string(list_sort(string_split(subject_key, ' ')), ' ') AS key, parent_tag_id, created_at FROM subjects WHERE subject_key IS NOT NULL)
SELECT key, CASE WHEN count(DISTINCT parent_tag_id) > 1 THEN 'different' WHEN count(parent_tag_id) > 0 THEN 'same' ELSE 'open' END AS answer, count(*) AS rows, arg_max(id, (parent_tag_id IS NOT NULL, created_at, id)) AS used FROM k GROUP BY 1""")
def stored_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Answers found again by the sorted ids they were given for: different beats same, an answered row beats an open one, then the newest."""
    k = load(spark, folder, "subjects", "id", "subject_key", "parent_tag_id", "created_at").where("subject_key is not null").withColumn("key", F.array_join(F.sort_array(F.split("subject_key", " ")), " "))
    parents = F.count_distinct("parent_tag_id")
    answer = F.when(parents > 1, "different").when(parents > 0, "same").otherwise("open")
    return k.groupBy("key").agg(answer.alias("answer"), F.count("*").alias("rows"), F.max_by("id", F.struct(F.col("parent_tag_id").isNotNull(), "created_at", "id")).alias("used"))


# Decisions and reviews


@query("DEC08", """
WITH n AS (SELECT lower(trim(name)) AS key, name, n_speeches FROM entity_names WHERE link_status <> 'none')
SELECT key, count(*) AS items, CAST(sum(n_speeches) AS BIGINT) AS speeches, arg_min(name, (-n_speeches, name)) AS spelling FROM n GROUP BY 1""")
def registered_names(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct names of kept items with their counts and the spelling used most."""
    n = load(spark, folder, "entity_names", "name", "n_speeches", "link_status").where("link_status <> 'none'")
    return n.groupBy(F.lower(F.trim("name")).alias("key")).agg(F.count("*").alias("items"), F.sum("n_speeches").alias("speeches"), F.min_by("name", F.struct(-F.col("n_speeches"), "name")).alias("spelling"))


@query("DEC10", """
SELECT t.id, CASE WHEN e.h IS NULL THEN 'ask' WHEN e.h = md5(t.tag) THEN 'recheck' ELSE 'ask again' END AS todo FROM tags t LEFT JOIN (SELECT tag_id, min(input_hash) AS h FROM tag_embeddings GROUP BY 1) e ON e.tag_id = t.id
WHERE EXISTS (SELECT 1 FROM subjects s WHERE s.parent_tag_id = t.id) OR EXISTS (SELECT 1 FROM entity_names n WHERE n.tag_id = t.id)""")
def recheck_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Used tags whose stored answer only needs checking again because its input is unchanged; tags that nothing uses are dropped."""
    t, e = load(spark, folder, "tags", "id", "tag"), load(spark, folder, "tag_embeddings", "tag_id", "input_hash").groupBy(F.col("tag_id").alias("id")).agg(F.min("input_hash").alias("h"))
    used = load(spark, folder, "subjects", "parent_tag_id").select(F.col("parent_tag_id").alias("id")).union(load(spark, folder, "entity_names", "tag_id"))
    todo = F.when(F.col("h").isNull(), "ask").when(F.col("h") == F.md5("tag"), "recheck").otherwise("ask again")
    return t.join(used, "id", "left_semi").join(e, "id", "left").select("id", todo.alias("todo"))


@query("DEC11", """
SELECT debate_id, id, k AS place FROM (SELECT debate_id, id, row_number() OVER (PARTITION BY debate_id ORDER BY md5(id || ' seed 7'), id) AS k FROM turns WHERE person_id IS NOT NULL) WHERE k <= 2""")
def seeded_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Two turns of each debate, drawn by a seeded hash (a sampling operator), spread over all debates."""
    t = load(spark, folder, "turns", "debate_id", "id", "person_id").where("person_id is not null").select("debate_id", "id", F.md5(F.concat("id", F.lit(" seed 7"))).alias("h"))
    w = Window.partitionBy("debate_id").orderBy("h", "id")
    return t.withColumn("place", F.row_number().over(w).cast("bigint")).where("place <= 2").select("debate_id", "id", "place")


@query("DEC12", """
WITH r AS (SELECT coalesce(link_p >= 0.8, false) AS x, link_status = 'linked' AS y FROM entity_names), n AS (SELECT count(*) FILTER (WHERE x AND y) AS agreed, count(*) FILTER (WHERE x AND NOT y) AS only_x, count(*) FILTER (WHERE NOT x AND y) AS only_y, count(*) FILTER (WHERE NOT x AND NOT y) AS neither, CAST(count(*) AS DOUBLE) AS n FROM r)
SELECT agreed, only_x, only_y, neither, round((agreed + neither) / n, 6) AS agreement, round(((agreed + neither) / n - ((agreed + only_x) * (agreed + only_y) + (neither + only_x) * (neither + only_y)) / (n * n)) / (1 - ((agreed + only_x) * (agreed + only_y) + (neither + only_x) * (neither + only_y)) / (n * n)), 6) AS kappa, round(agreed / nullif(CAST(agreed + only_y AS DOUBLE), 0), 6) AS recall FROM n""")
def review_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Two judgements of the same items: the confusion of both, their agreement beyond chance, and recall of the second by the first."""
    e = load(spark, folder, "entity_names", "link_p", "link_status").select(F.coalesce(F.col("link_p") >= 0.8, F.lit(False)).alias("x"), (F.col("link_status") == "linked").alias("y"))
    n = e.agg(F.count_if(F.col("x") & F.col("y")).alias("agreed"), F.count_if(F.col("x") & ~F.col("y")).alias("only_x"), F.count_if(~F.col("x") & F.col("y")).alias("only_y"), F.count_if(~F.col("x") & ~F.col("y")).alias("neither"), F.count("*").cast("double").alias("n"))
    seen = (F.col("agreed") + F.col("neither")) / F.col("n")
    chance = ((F.col("agreed") + F.col("only_x")) * (F.col("agreed") + F.col("only_y")) + (F.col("neither") + F.col("only_x")) * (F.col("neither") + F.col("only_y"))) / (F.col("n") * F.col("n"))
    return n.select("agreed", "only_x", "only_y", "neither", F.round(seen, 6).alias("agreement"), F.round(F.try_divide(seen - chance, 1 - chance), 6).alias("kappa"), F.round(F.try_divide(F.col("agreed"), (F.col("agreed") + F.col("only_y")).cast("double")), 6).alias("recall"))


@query("DEC18", f"""
WITH {HITS}, c AS (SELECT d.doc_id, coalesce(h.n, 0) AS n FROM documents d LEFT JOIN (SELECT id, count(*) AS n FROM tf GROUP BY 1) h ON h.id = d.doc_id), r AS (SELECT n, row_number() OVER (ORDER BY n, doc_id) - 1 AS k, count(*) OVER () AS t FROM c)
SELECT p, max(n) AS value FROM r, (SELECT CAST(unnest([0.1, 0.5, 0.9, 0.99]) AS DOUBLE) AS p) q WHERE k = CAST(floor(p * t) AS BIGINT) GROUP BY 1""")
def gate_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    """How many names of the dictionary documents have, at ranks of the whole table (the row at floor(p n), from counts of values)."""
    names = load(spark, folder, "debates", "keywords").select(F.explode("keywords").alias("name")).distinct()
    d = load(spark, folder, "documents", "doc_id", "text")
    hits = search.dictionary_hits(d, "doc_id", F.col("text"), names, "name", most=None).groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("n"))
    by = d.select("doc_id").join(hits, "doc_id", "left").groupBy(F.coalesce("n", F.lit(0)).alias("value")).agg(F.count("*").alias("n"))  # as many rows as different numbers
    upto = by.select("value", F.sum("n").over(Window.orderBy("value")).alias("upto"), "n", F.sum("n").over(Window.partitionBy()).alias("t"))
    at = upto.select("value", "upto", "n", "t", F.explode(F.array(*map(F.lit, (0.1, 0.5, 0.9, 0.99)))).alias("p")).withColumn("k", F.floor(F.col("p") * F.col("t")))
    return at.where("k >= upto - n and k < upto").select("p", F.col("value").cast("bigint").alias("value"))
