"""Search, similarity, dictionary and identity queries over texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gavel.functions import text as tx
from gavel.operators import aggregates as agg
from gavel.operators import relational as rel
from gavel.operators import search
from gavel.plans.registry import query
from gavel.sources.tables import load

#: DuckDB's form of `tokens`: lower-case runs of letters, marks and digits.
TOKENS = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{M}}\\p{{N}}]+')"
T = lambda c: TOKENS.format(c)


def hits_sql(names: str, docs: str) -> str:
    """CTEs down to `tf` (id, name, tf) for dictionary matching: `names` selects `name`, `docs` selects `id` and `text`."""
    return f"""nn AS (SELECT DISTINCT array_to_string({T('name')}, ' ') AS name, len({T('name')}) AS k FROM ({names}) WHERE len({T('name')}) > 0),
dd AS (SELECT id, {T('text')} AS t FROM ({docs})), rr AS (SELECT id, i AS pos, k, array_to_string(t[i:i+k-1], ' ') AS name FROM (SELECT id, t, unnest(range(1, len(t) + 1)) AS i FROM dd), (SELECT DISTINCT k FROM nn) WHERE i + k - 1 <= len(t)),
ff AS (SELECT rr.* FROM rr JOIN nn USING (name)), gg AS (SELECT *, max(pos + k) OVER (PARTITION BY id ORDER BY pos, k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ff),
tf AS (SELECT id, name, count(*) AS tf FROM gg WHERE reach IS NULL OR pos + k > reach GROUP BY 1, 2)"""


KEYWORDS = "SELECT unnest(keywords) AS name FROM debates"
HITS = hits_sql(KEYWORDS, "SELECT doc_id AS id, text FROM documents")


@query("TXT01 TXT04 FIL08", f"SELECT doc_id, len({T('text')}) AS n_tokens FROM documents WHERE list_has_all({T('text')}, ['granary', 'audit', 'workers'])")
def fts_all_words(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with all of some words."""
    d = load(spark, folder, "documents", "doc_id", "text").withColumn("t", tx.tokens(F.col("text")))
    return d.where(tx.has_all(F.col("t"), ["granary", "audit", "workers"])).select("doc_id", F.size("t").cast("bigint").alias("n_tokens"))


@query("TXT02", f"SELECT id, debate_id FROM turns WHERE contains(' ' || array_to_string({T('text')}, ' ') || ' ', ' the state government returned ')")
def fts_phrase(spark: SparkSession, folder: str) -> DataFrame:
    """Turns with a phrase: its words one after another, inside one turn."""
    t = load(spark, folder, "turns", "id", "debate_id", "text")
    return t.where(tx.has_phrase(tx.tokens(F.col("text")), ["the", "state", "government", "returned"])).select("id", "debate_id")


BM = f"""d AS (SELECT doc_id AS id, {T('text')} AS t, len({T('text')}) AS length FROM documents), g AS (SELECT count(*) AS n, avg(length) AS mean FROM d),
h AS (SELECT id, length, w AS word, len(list_filter(t, lambda x: x = w)) AS tf FROM d, (SELECT unnest(['ferry', 'arrears', 'wages']) AS w) WHERE len(list_filter(t, lambda x: x = w)) > 0), f AS (SELECT word, count(*) AS df FROM h GROUP BY 1),
s AS (SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM h JOIN f USING (word), g GROUP BY 1)"""
WORDS = ["ferry", "arrears", "wages"]


@query("TXT03", f"WITH {BM} SELECT id, score FROM s")
def bm25_rank(spark: SparkSession, folder: str) -> DataFrame:
    """Documents ranked for a query of words by BM25."""
    return search.bm25(load(spark, folder, "documents", "doc_id", "text"), "doc_id", tx.tokens(F.col("text")), WORDS)


@query("SRT05", f"""
WITH {BM}, a AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 50), b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_date DESC NULLS LAST, doc_id) AS rank FROM documents WHERE contains(lower(title), 'ferry') QUALIFY rank <= 50),
u AS (SELECT id, rank, 'words' AS l FROM a UNION ALL SELECT id, rank, 'title' FROM b)
SELECT id, round(sum(1.0 / (60 + rank)), 9) AS score, CASE WHEN count(*) = 2 THEN 'both' ELSE min(l) END AS kind FROM u GROUP BY 1""")
def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """Two ranked lists fused by reciprocal ranks, and which of them a document is from (a top-50 report each)."""
    d = load(spark, folder, "documents", "doc_id", "text", "title", "doc_date")
    a = search.ranked(search.bm25(d, "doc_id", tx.tokens(F.col("text")), WORDS), "score", 50)
    b = d.where(F.contains(F.lower("title"), F.lit("ferry"))).select(F.col("doc_id").alias("id"), "doc_date").orderBy(F.desc_nulls_last("doc_date"), "id").limit(50)
    b = b.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("doc_date"), "id")))
    kinds = a.select("id", F.lit("words").alias("l")).unionByName(b.select("id", F.lit("title").alias("l"))).groupBy("id").agg(F.when(F.count("*") == 2, "both").otherwise(F.min("l")).alias("kind"))
    return search.fuse([a, b]).join(kinds, "id").select("id", "score", "kind")


STEM = "CASE WHEN length({0}) > 4 AND {0} LIKE '%ies' THEN left({0}, length({0}) - 3) || 'y' WHEN length({0}) > 4 AND {0} LIKE '%s' THEN left({0}, length({0}) - 1) ELSE {0} END"
STOP = ["the", "of", "in", "and", "for", "on", "a", "to"]


@query("TXT10 TXT14", f"""
SELECT id, tag FROM tags WHERE list_has_all(list_transform(list_filter({T('tag')}, lambda x: x NOT IN ('the','of','in','and','for','on','a','to')), lambda x: {STEM.format('x')}), ['bridge', 'repair'])""")
def stem_subset_search(spark: SparkSession, folder: str) -> DataFrame:
    """Tags whose stems contain all stems of a query."""
    t = load(spark, folder, "tags", "id", "tag")
    return t.where(F.size(F.array_except(F.array(F.lit("bridge"), F.lit("repair")), tx.stems(F.col("tag"), STOP))) == 0)


@query("TXT11", f"""
WITH m AS (SELECT s.id, s.parent_tag_id AS parent, s.n_speeches AS n FROM subjects s WHERE list_contains({T('s.label')}, 'canal')),
i AS (SELECT parent, count(*) AS children, CAST(sum(n) AS BIGINT) AS speeches FROM m WHERE parent IS NOT NULL GROUP BY 1 HAVING count(*) >= 2)
SELECT t.id, t.tag, CASE WHEN lower(t.tag) = 'canal' THEN 0 WHEN list_contains({T('t.tag')}, 'canal') THEN 1 ELSE 2 END AS place, coalesce(i.children, 0) AS children, coalesce(i.speeches, 0) AS speeches
FROM tags t LEFT JOIN i ON i.parent = t.id WHERE t.status NOT IN ('rejected', 'merged') AND (list_contains({T('t.tag')}, 'canal') OR i.parent IS NOT NULL)""")
def two_level_search(spark: SparkSession, folder: str) -> DataFrame:
    """Live tags that match a word, or that two or more matching subjects have as parent, exact matches first."""
    word = lambda c: F.array_contains(tx.tokens(F.col(c)), "canal")
    s = load(spark, folder, "subjects", "id", "label", "parent_tag_id", "n_speeches").where(word("label"))
    i = s.where("parent_tag_id is not null").groupBy(F.col("parent_tag_id").alias("id")).agg(F.count("*").alias("children"), F.sum("n_speeches").alias("speeches")).where("children >= 2")
    t = load(spark, folder, "tags", "id", "tag", "status").where(~F.col("status").isin("rejected", "merged")).join(i, "id", "left")
    place = F.when(F.lower("tag") == "canal", 0).when(word("tag"), 1).otherwise(2)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return t.where(word("tag") | F.col("children").isNotNull()).select("id", "tag", place.alias("place"), zero("children"), zero("speeches"))


GRAMS = "list_distinct(flatten(list_transform({0}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
G = lambda c: GRAMS.format(T(c))


@query("TXT47 JOI07", f"""
WITH p AS (SELECT id, type, domain, tag, {G('tag')} AS g FROM tags WHERE domain IS NOT NULL)
SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.g, b.g)) / CAST(len(list_distinct(list_concat(a.g, b.g))) AS DOUBLE), 6) AS similarity FROM p a JOIN p b ON a.domain = b.domain AND a.type = b.type AND a.id < b.id
WHERE len(list_intersect(a.g, b.g)) / CAST(len(list_distinct(list_concat(a.g, b.g))) AS DOUBLE) >= 0.4""")
def trigram_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of tags of one kind and domain with similar names; names without any word are similar by NaN, as in SQL."""
    t = load(spark, folder, "tags", "id", "type", "domain", "tag")
    return search.similar_names(t, ["type", "domain"], "id", F.col("tag"), 0.4).withColumn("similarity", F.round("similarity", 6))


@query("TXT46", """
SELECT e.id, min(t.id) AS tag_id, count(t.id) AS n FROM (SELECT id, lower(regexp_replace(regexp_replace(regexp_replace(name, '^[\\p{P}\\p{S}\\s]+', ''), '[\\p{P}\\p{S}\\s]+$', ''), '\\s+', ' ', 'g')) AS k FROM entity_names) e
LEFT JOIN (SELECT id, lower(regexp_replace(regexp_replace(regexp_replace(tag, '^[\\p{P}\\p{S}\\s]+', ''), '[\\p{P}\\p{S}\\s]+$', ''), '\\s+', ' ', 'g')) AS k FROM tags WHERE status <> 'rejected') t USING (k) GROUP BY 1 HAVING count(t.id) <= 1""")
def exact_tag_map(spark: SparkSession, folder: str) -> DataFrame:
    """Entity names with the one tag that is named alike, after stripping what stands around them; names of several drop out."""
    e = load(spark, folder, "entity_names", "id", "name").select("id", tx.bare_name(F.col("name")).alias("k"))
    t = load(spark, folder, "tags", "id", "tag", "status").where("status <> 'rejected'").select(F.col("id").alias("tag_id"), tx.bare_name(F.col("tag")).alias("k"))
    return e.join(t, "k", "left").groupBy("id").agg(F.min("tag_id").alias("tag_id"), F.count("tag_id").alias("n")).where("n <= 1")


@query("TXT20", """
SELECT id, regexp_replace(regexp_replace(lower(title), '^the\\s+', ''), '[^\\p{L}\\p{N}]', '', 'g') || '-' || CAST(year(debate_date) AS VARCHAR) || '-ls' || CAST(loksabha AS VARCHAR) AS k FROM debates""")
def title_keys(spark: SparkSession, folder: str) -> DataFrame:
    """A key of name, year and term for each debate, null where one of them is."""
    d = load(spark, folder, "debates", "id", "title", "debate_date", "loksabha")
    return d.select("id", tx.key_of(F.col("title"), F.year("debate_date"), F.col("loksabha")).alias("k"))


@query("TXT17", f"WITH {hits_sql(KEYWORDS, 'SELECT id, title AS text FROM debates WHERE title IS NOT NULL')} SELECT id, count(*) AS n FROM tf GROUP BY 1")
def quote_substring_check(spark: SparkSession, folder: str) -> DataFrame:
    """How many keywords of any debate each title contains word for word."""
    d = load(spark, folder, "debates", "id", "title").where("title is not null")
    q = load(spark, folder, "debates", "keywords").select(F.explode("keywords").alias("k")).distinct()
    return search.dictionary_hits(d, "id", F.col("title"), q, "k", most=None).groupBy("id").agg(F.count("*").alias("n"))


@query("TXT18", """
SELECT id, regexp_extract(text, 'in ((?:19|20)\\d\\d)-\\d\\d', 1) AS year FROM turns WHERE regexp_matches(text, 'Abhiyan.{0,40}in (?:19|20)\\d\\d-\\d\\d')""")
def year_near_name(spark: SparkSession, folder: str) -> DataFrame:
    """Turns with a year shortly after a name."""
    t = load(spark, folder, "turns", "id", "text").where(F.col("text").rlike("Abhiyan.{0,40}in (?:19|20)\\d\\d-\\d\\d"))
    return t.select("id", F.regexp_extract("text", "in ((?:19|20)\\d\\d)-\\d\\d", 1).alias("year"))


@query("TXT21 TXT22", """
SELECT id, regexp_replace(trim(regexp_replace(regexp_replace(title, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), '\\s*\\(Laid\\)$', '') AS tidy,
CASE WHEN debate_type IS NULL THEN NULL ELSE upper(left(trim(debate_type), 1)) || lower(substr(trim(debate_type), 2)) END AS kind FROM debates""")
def tidy_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Titles without tags and repeated blanks, types in sentence case."""
    t = F.trim(F.regexp_replace(F.regexp_replace("title", "<[^>]+>", " "), "\\s+", " "))
    k = F.trim("debate_type")
    return load(spark, folder, "debates", "id", "title", "debate_type").select(
        "id", F.regexp_replace(t, "\\s*\\(Laid\\)$", "").alias("tidy"), F.concat(F.upper(F.left(k, F.lit(1))), F.lower(F.substring(k, F.lit(2), F.length(k)))).alias("kind"))


@query("TXT44 AGG09", """
WITH g AS (SELECT lower(regexp_replace(norm_name, '[^\\p{L}\\p{M}\\p{N}]', '', 'g')) AS k, norm_name, type, n_speeches FROM entity_names), s AS (SELECT k, type, CAST(sum(n_speeches) AS BIGINT) AS n, count(DISTINCT norm_name) AS spellings FROM g GROUP BY 1, 2)
SELECT k, arg_max(type, (n, type)) AS type, CAST(sum(n) AS BIGINT) AS speeches, CAST(max(spellings) AS BIGINT) AS spellings FROM s GROUP BY k HAVING sum(n) >= 3 AND max(n) >= 0.8 * sum(n)""")
def dictionary_build(spark: SparkSession, folder: str) -> DataFrame:
    """A dictionary of names by spelling key: used in three speeches or more, and of one type in 80 % of them."""
    e = load(spark, folder, "entity_names", "norm_name", "type", "n_speeches")
    g = e.withColumn("k", F.lower(F.regexp_replace("norm_name", "[^\\p{L}\\p{M}\\p{N}]", "")))
    s = g.groupBy("k", "type").agg(F.sum("n_speeches").alias("n"), F.count_distinct("norm_name").alias("spellings"))
    out = s.groupBy("k").agg(F.max_by("type", F.struct("n", "type")).alias("type"), F.sum("n").alias("speeches"), F.max("spellings").alias("spellings"), F.max("n").alias("_most"))
    return out.where((F.col("speeches") >= 3) & (F.col("_most") >= 0.8 * F.col("speeches"))).drop("_most")


@query("TXT45", f"""
WITH {HITS}, df AS (SELECT name, count(*) AS df FROM tf GROUP BY 1), s AS (SELECT id, name, tf, round(tf * ln((SELECT count(*) FROM documents) / CAST(df AS DOUBLE)), 6) AS score FROM tf JOIN df USING (name))
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, name) <= 8""")
def dictionary_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """The eight best keywords in each document, scored by tf * ln(N / df), longest match first."""
    names = load(spark, folder, "debates", "keywords").select(F.explode("keywords").alias("name")).distinct()
    return search.dictionary_hits(load(spark, folder, "documents", "doc_id", "text"), "doc_id", F.col("text"), names, "name")


@query("TXT33", """
WITH r AS (SELECT DISTINCT person_id, lower(trim(name)) AS name FROM speakers WHERE name IS NOT NULL), one AS (SELECT k, min(person_id) AS p FROM (SELECT DISTINCT name AS k, person_id FROM r) GROUP BY 1 HAVING count(*) = 1),
sorted AS (SELECT k, min(person_id) AS p FROM (SELECT DISTINCT array_to_string(list_sort(string_split_regex(name, '[ _,.]+')), ' ') AS k, person_id FROM r) GROUP BY 1 HAVING count(*) = 1),
sur AS (SELECT k, min(person_id) AS p FROM (SELECT DISTINCT split_part(name, ' ', -1) AS k, person_id FROM r) GROUP BY 1 HAVING count(*) = 1),
l AS (SELECT DISTINCT speaker_label AS label, trim(regexp_replace(regexp_replace(lower(speaker_label), '\\([^)]*\\)|\\b(shri|shrimati|dr|prof|adv|hon)\\b\\.?|[:\\[\\]_]|contd\\.*', ' ', 'g'), '[\\s\\p{Z}]+', ' ', 'g')) AS n FROM turns WHERE person_id IS NOT NULL AND speaker_label IS NOT NULL)
SELECT label, coalesce(one.p, sorted.p, sur.p) AS person_id, CASE WHEN one.p IS NOT NULL THEN 'exact' WHEN sorted.p IS NOT NULL THEN 'sorted' WHEN sur.p IS NOT NULL THEN 'surname' ELSE 'none' END AS tier
FROM l LEFT JOIN one ON one.k = l.n LEFT JOIN sorted ON sorted.k = array_to_string(list_sort(string_split_regex(l.n, '[ _,.]+')), ' ') LEFT JOIN sur ON sur.k = split_part(l.n, ' ', -1)""")
def tiered_resolver(spark: SparkSession, folder: str) -> DataFrame:
    """Labels resolved to persons in tiers (exact, words in any order, surname); keys of several persons never resolve."""
    r = load(spark, folder, "speakers", "person_id", "name").where("name is not null").select("person_id", F.lower(F.trim("name")).alias("name")).distinct()
    in_order = lambda c: F.array_join(F.sort_array(F.split(c, "[ _,.]+")), " ")
    last = lambda c: F.element_at(F.split(c, " "), -1)
    unique = lambda key, name: r.select(key(F.col("name")).alias(f"k_{name}"), "person_id").distinct().groupBy(f"k_{name}").agg(F.min("person_id").alias(name), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    pattern = "\\([^)]*\\)|\\b(shri|shrimati|dr|prof|adv|hon)\\b\\.?|[:\\[\\]_]|contd\\.*"
    l = load(spark, folder, "turns", "person_id", "speaker_label").where("person_id is not null and speaker_label is not null").select(F.col("speaker_label").alias("label")).distinct()
    l = l.withColumn("n", F.trim(F.regexp_replace(F.regexp_replace(F.lower("label"), pattern, " "), "[\\s\\p{Z}]+", " ")))
    keyed = l.select("label", F.col("n").alias("k_exact"), in_order(F.col("n")).alias("k_sorted"), last(F.col("n")).alias("k_surname"))
    for name, key in {"exact": lambda c: c, "sorted": in_order, "surname": last}.items():
        keyed = keyed.join(unique(key, name), f"k_{name}", "left")
    tier = F.when(F.col("exact").isNotNull(), "exact").when(F.col("sorted").isNotNull(), "sorted").when(F.col("surname").isNotNull(), "surname").otherwise("none")
    return keyed.select("label", F.coalesce("exact", "sorted", "surname").alias("person_id"), tier.alias("tier"))


@query("TXT34", """
SELECT id, CASE WHEN speaker_label IS NULL OR NOT regexp_matches(speaker_label, '\\p{L}') THEN 'none' WHEN regexp_matches(speaker_label, '(?i)(^|[^\\p{L}])members?([^\\p{L}]|$)|सदस्य') THEN 'crowd' WHEN regexp_matches(regexp_replace(speaker_label, '\\s[–-]\\s*speaker\\s*$', ''), '(?i)(^|[^\\p{L}])(chairman|chairperson|chair|speaker)([^\\p{L}]|$)|सभापति|अध्यक्ष') THEN 'chair'
  WHEN regexp_matches(speaker_label, '(?i)(^|[^\\p{L}])minister of ') THEN 'office' ELSE 'name' END AS kind FROM turns""")
def label_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """What a label is: none, of a group, of the chair, an office or a name (groups before the chair)."""
    l = F.col("speaker_label")
    kind = (
        F.when(l.isNull() | ~l.rlike("\\p{L}"), "none").when(l.rlike("(?i)(^|[^\\p{L}])members?([^\\p{L}]|$)|सदस्य"), "crowd")
        .when(F.regexp_replace(l, "\\s[–-]\\s*speaker\\s*$", "").rlike("(?i)(^|[^\\p{L}])(chairman|chairperson|chair|speaker)([^\\p{L}]|$)|सभापति|अध्यक्ष"), "chair")
        .when(l.rlike("(?i)(^|[^\\p{L}])minister of "), "office").otherwise("name")
    )
    return load(spark, folder, "turns", "id", "speaker_label").select("id", kind.alias("kind"))


@query("TXT37 AGG20", """
WITH v AS (SELECT mp_code, person_id, count(*) AS n FROM turns WHERE mp_code IS NOT NULL AND person_id IS NOT NULL GROUP BY 1, 2), t AS (SELECT mp_code, CAST(sum(n) AS BIGINT) AS votes, CAST(max(n) AS BIGINT) AS most, count(*) AS people, arg_max(person_id, (n, -person_id)) AS person_id FROM v GROUP BY 1)
SELECT mp_code, person_id, votes, people FROM t WHERE most >= 2 AND most > votes - most""")
def code_alias_vote(spark: SparkSession, folder: str) -> DataFrame:
    """The person that a code's turns name, where most of at least two votes agree."""
    v = load(spark, folder, "turns", "mp_code", "person_id").where("mp_code is not null and person_id is not null").groupBy("mp_code", "person_id").agg(F.count("*").alias("n"))
    t = v.groupBy("mp_code").agg(F.sum("n").alias("votes"), F.max("n").alias("most"), F.count("*").alias("people"), F.max_by("person_id", F.struct("n", -F.col("person_id"))).alias("person_id"))
    return t.where("most >= 2 and most > votes - most").select("mp_code", "person_id", "votes", "people")


@query("TXT42 AGG05", """
SELECT speaker_label, count(*) AS turns, CAST(sum(word_count) AS BIGINT) AS words, min(d.debate_date) AS first_day, max(d.debate_date) AS last_day, md5(left(arg_max(text, (word_count, t.id)), 400)) AS excerpt
FROM turns t LEFT JOIN debates d ON d.id = t.debate_id WHERE person_id IS NULL AND role_kind IS NULL AND regexp_matches(speaker_label, '\\p{L}') GROUP BY 1""")
def unnamed_label_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Labels without a person: words, days, and the start of the longest turn (as a digest)."""
    t = load(spark, folder, "turns", "id", "debate_id", "speaker_label", "text", "word_count", "person_id", "role_kind").where("person_id is null and role_kind is null").where(F.col("speaker_label").rlike("\\p{L}"))
    t = t.withColumn("text", F.substring("text", 1, 400)).join(load(spark, folder, "debates", "id", "debate_date").withColumnRenamed("id", "debate_id"), "debate_id", "left")
    return t.groupBy("speaker_label").agg(
        F.count("*").alias("turns"), F.sum("word_count").alias("words"), F.min("debate_date").alias("first_day"), F.max("debate_date").alias("last_day"), F.md5(F.max_by("text", F.struct("word_count", "id"))).alias("excerpt"))


@query("TXT43", """
WITH a AS (SELECT DISTINCT person_id, lok_sabha_term AS term, split_part(lower(trim(name)), ' ', -1) AS sur, split_part(lower(trim(name)), ' ', 1) AS first FROM speakers WHERE name IS NOT NULL),
b AS (SELECT DISTINCT d.loksabha AS term, lower(regexp_replace(trim(n), '^(Shri|Shrimati|Dr\\.|Prof\\.|Adv\\.) ', '')) AS name FROM (SELECT loksabha, unnest(member_names) AS n FROM debates) d),
c AS (SELECT term, name, split_part(name, ' ', -1) AS sur, split_part(name, ' ', 1) AS first FROM b),
s AS (SELECT c.term, c.name, a.person_id, CAST(levenshtein(c.first, a.first) AS INTEGER) AS d FROM c JOIN a ON a.term = c.term AND a.sur = c.sur)
SELECT term, name, person_id, d FROM (SELECT *, row_number() OVER (PARTITION BY term, name ORDER BY d, person_id) AS k, count(*) OVER (PARTITION BY term, name, d) AS ties FROM s) WHERE k = 1 AND ties = 1 AND d <= 2""")
def name_matching(spark: SparkSession, folder: str) -> DataFrame:
    """Listed names matched with the term's members: same surname, nearest given name, no ties."""
    words = lambda c: F.split(c, " ")
    name = lambda c: F.lower(F.trim(c))
    a = load(spark, folder, "speakers", "person_id", "lok_sabha_term", "name").where("name is not null")
    a = a.select("person_id", F.col("lok_sabha_term").alias("term"), F.element_at(words(name("name")), -1).alias("sur"), F.element_at(words(name("name")), 1).alias("given")).distinct()
    b = load(spark, folder, "debates", "loksabha", "member_names").select(F.col("loksabha").alias("term"), F.explode("member_names").alias("n"))
    b = b.select("term", F.lower(F.regexp_replace(F.trim("n"), "^(Shri|Shrimati|Dr\\.|Prof\\.|Adv\\.) ", "")).alias("name")).distinct()
    c = b.select("term", "name", F.element_at(words(F.col("name")), -1).alias("sur"), F.element_at(words(F.col("name")), 1).alias("first"))
    s = c.join(a, ["term", "sur"]).withColumn("d", F.levenshtein("first", "given"))
    w = Window.partitionBy("term", "name")
    s = s.withColumn("k", F.row_number().over(w.orderBy("d", "person_id"))).withColumn("ties", F.count("*").over(Window.partitionBy("term", "name", "d")))
    return s.where("k = 1 and ties = 1 and d <= 2").select("term", "name", "person_id", "d")


@query("TXT54", """
WITH n AS (SELECT type, lower(trim(split_part(name, ',', 1))) AS bare, count(*) AS n FROM entity_names GROUP BY 1, 2), k AS (SELECT bare, count(DISTINCT type) AS types FROM n GROUP BY 1)
SELECT n.bare, n.type, CASE WHEN types > 1 THEN n.bare || ' (' || n.type || ')' ELSE n.bare END AS name, n.n FROM n JOIN k USING (bare)""")
def shared_name_qualify(spark: SparkSession, folder: str) -> DataFrame:
    """Names claimed by several types get the type as a qualifier."""
    n = load(spark, folder, "entity_names", "type", "name").groupBy("type", F.lower(F.trim(F.split_part("name", F.lit(","), F.lit(1)))).alias("bare")).agg(F.count("*").alias("n"))
    k = n.groupBy("bare").agg(F.count_distinct("type").alias("types"))
    qualified = F.when(F.col("types") > 1, F.concat("bare", F.lit(" ("), "type", F.lit(")"))).otherwise(F.col("bare"))
    return n.join(k, "bare").select("bare", "type", qualified.alias("name"), "n")


@query("TXT57", """
SELECT speaker_label, count(*) AS n, count(*) FILTER (WHERE regexp_matches(text, '(?:^|\\n)[A-Z][A-Z. ]{8,60}:')) AS swallowed, round(count(*) FILTER (WHERE name_source = 'unresolved') / CAST(count(*) AS DOUBLE), 6) AS unresolved FROM turns GROUP BY 1 HAVING count(*) >= 5""")
def parser_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Per label: turns that hold another label in capitals, and the share that no person was found for."""
    t = load(spark, folder, "turns", "speaker_label", "text", "name_source")
    return t.groupBy("speaker_label").agg(
        F.count("*").alias("n"), F.count_if(F.col("text").rlike("(?:^|\\n)[A-Z][A-Z. ]{8,60}:")).alias("swallowed"), agg.ratio(F.count_if(F.col("name_source") == "unresolved"), F.count("*")).alias("unresolved")).where("n >= 5")


@query("TXT35", """
WITH a AS (SELECT debate_id, speaker_label AS l, min(person_id) AS p FROM turns WHERE name_source = 'anchor' AND person_id IS NOT NULL AND speaker_label IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT person_id) = 1)
SELECT t.id, a.p AS person_id FROM turns t JOIN a ON a.debate_id = t.debate_id AND a.l = t.speaker_label WHERE t.name_source <> 'anchor'""")
def anchor_reuse(spark: SparkSession, folder: str) -> DataFrame:
    """Turns without an anchor whose label has exactly one anchored person in their debate."""
    t = load(spark, folder, "turns", "id", "debate_id", "speaker_label", "name_source", "person_id")
    a = t.where("name_source = 'anchor' and person_id is not null and speaker_label is not null").groupBy("debate_id", "speaker_label").agg(F.min("person_id").alias("p"), F.count_distinct("person_id").alias("n")).where("n = 1")
    return t.where("name_source <> 'anchor'").join(a, ["debate_id", "speaker_label"]).select("id", F.col("p").alias("person_id"))
