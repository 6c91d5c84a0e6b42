"""What the archive's pages show: searches with marks, member, speech, debate, tag and bill pages, places, and reviews of new tags."""

from __future__ import annotations

import html
import unicodedata

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gavel.functions import spans
from gavel.functions import text as tx
from gavel.functions import vectors as vec
from gavel.operators import arrow, graph, search
from gavel.operators import relational as rel
from gavel.operators import sequences as seq
from gavel.plans.analytics_plans import S, sales
from gavel.plans.registry import query
from gavel.plans.relational_plans import SPEECHES, once_each, speeches
from gavel.plans.text_plans import T
from gavel.plans.vector_plans import D, U, _tags
from gavel.sources.staging import stage
from gavel.sources.tables import load

# Searches


@query("TXT08", """
WITH s AS (SELECT id, list_filter(regexp_extract_all(text, '[^.?!।\\n]+[.?!।]?'), lambda x: regexp_matches(x, '(?i)(^|[^\\p{L}\\p{N}_])(canal|ferry)([^\\p{L}\\p{N}_]|$)')) AS hits FROM turns WHERE text IS NOT NULL)
SELECT id, md5(trim(hits[1])) AS excerpt FROM s WHERE len(hits) > 0""")
def search_excerpts(spark: SparkSession, folder: str) -> DataFrame:
    """The first sentence of each turn that holds a query word (as a digest)."""
    pick = lambda t: (found := spans.excerpt(t, ["canal", "ferry"], most=1 << 30)) and found[0]
    t = load(spark, folder, "turns", "id", "text").where(F.lower("text").rlike("canal|ferry"))
    return arrow.each_text(t, "id", "text", pick, "excerpt").where("excerpt is not null").select("id", F.md5("excerpt").alias("excerpt"))


@query("TXT09", """
SELECT id, CAST(len(regexp_extract_all(text, '(?i)state\\s+government')) AS INTEGER) AS n, CAST(length(regexp_extract(text, '(?is)^(.*?)state\\s+government', 1)) AS INTEGER) AS first_at FROM turns WHERE regexp_matches(text, '(?i)state\\s+government')""")
def mention_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """Where a name is mentioned in each turn, case aside and over any white space: how often, and the first place."""
    t = load(spark, folder, "turns", "id", "text").where(F.col("text").rlike("(?i)state\\s+government"))
    places = arrow.rows_of_text(t, "id", "text", lambda x: spans.mentions(x, "state government"), {"start": "int", "end": "int"})
    return places.groupBy("id").agg(F.count("*").cast("int").alias("n"), F.min("start").alias("first_at"))


@query("TXT19", """
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\b(?:first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|twentieth|hundredth)\\b')) AS w FROM documents),
v(w, n) AS (VALUES ('first', 1), ('second', 2), ('third', 3), ('fourth', 4), ('fifth', 5), ('sixth', 6), ('seventh', 7), ('eighth', 8), ('ninth', 9), ('tenth', 10), ('twentieth', 20), ('hundredth', 100))
SELECT doc_id, n AS number, count(*) AS times FROM d JOIN v USING (w) GROUP BY 1, 2""")
def ordinal_words(spark: SparkSession, folder: str) -> DataFrame:
    """The ordinals that documents write in words, as numbers (each different word is read once)."""
    words = "\\b(?:first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|twentieth|hundredth)\\b"
    d = load(spark, folder, "documents", "doc_id", "text").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(words), 0)).alias("w"))
    n = d.groupBy("doc_id", "w").agg(F.count("*").alias("times"))
    read = arrow.each_text(n.select("w", F.col("w").alias("t")).distinct(), "w", "t", lambda t: str(spans.ordinal(t)), "number")
    return n.join(read, "w").groupBy("doc_id", F.col("number").cast("int").alias("number")).agg(F.sum("times").alias("times"))


@query("TXT18", """
WITH n AS (SELECT DISTINCT regexp_extract(text, '([A-Z][a-z]+ [A-Z][a-z]+ (?:Abhiyan|Yojana|Mission))', 1) AS name FROM turns WHERE regexp_matches(text, '[A-Z][a-z]+ [A-Z][a-z]+ (?:Abhiyan|Yojana|Mission)'))
SELECT t.id, n.name, regexp_extract(substr(t.text, strpos(t.text, n.name)), '^' || n.name || '[^0-9]{0,12}((?:19|20)[0-9][0-9])', 1) AS year FROM turns t JOIN n ON regexp_extract(t.text, '([A-Z][a-z]+ [A-Z][a-z]+ (?:Abhiyan|Yojana|Mission))', 1) = n.name""")
def year_after_name(spark: SparkSession, folder: str) -> DataFrame:
    """The first scheme that each turn names, and the year at most 12 characters after it; no year gives an empty text."""
    name = F.regexp_extract("text", "([A-Z][a-z]+ [A-Z][a-z]+ (?:Abhiyan|Yojana|Mission))", 1)
    t = load(spark, folder, "turns", "id", "text").withColumn("name", name).where("name <> ''")
    after = F.substring(F.col("text"), F.expr("locate(name, text)"), F.length("text"))
    return t.select("id", "name", F.regexp_extract(after, "^[A-Z][a-z]+ [A-Z][a-z]+ (?:Abhiyan|Yojana|Mission)[^0-9]{0,12}((?:19|20)[0-9][0-9])", 1).alias("year"))


@query("TXT16", """
SELECT id, lower(trim(regexp_replace(translate(regexp_replace(nfc_normalize(norm_name), '[\\x{200B}-\\x{200D}\\x{2060}\\x{FEFF}\\x{AD}]', '', 'g'), '‘’‚‛“”„‟–—−‐‑', '''''''''""""-----'), '[\\s\\x{A0}\\x{2000}-\\x{200A}\\x{202F}\\x{3000}]+', ' ', 'g'))) AS plain FROM entity_names""")
def plain_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names in plain form: composed, without invisible characters, straight quotes and dashes, single blanks, lower case."""
    e = load(spark, folder, "entity_names", "id", "norm_name")
    return arrow.each_text(e, "id", "norm_name", lambda t: None if t is None else unicodedata.normalize("NFC", t), "t").select("id", tx.plain(F.col("t")).alias("plain"))


@query("TXT21", """
SELECT id, CASE WHEN t = upper(t) AND t <> lower(t) THEN upper(left(t, 1)) || lower(substr(t, 2)) ELSE t END AS title FROM (SELECT id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(title, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS t FROM debates)""")
def unescaped_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Titles without tags, references resolved, blanks collapsed, those all in capitals in sentence case."""
    d = load(spark, folder, "debates", "id", "title").select("id", F.regexp_replace("title", "<[^>]+>", " ").alias("t"))
    t = F.trim(F.regexp_replace("u", "\\s+", " "))
    capitals = (t == F.upper(t)) & (t != F.lower(t))
    sentence = F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.expr("substring(trim(regexp_replace(u, '\\\\s+', ' ')), 2)")))
    return arrow.each_text(d, "id", "t", lambda x: None if x is None else html.unescape(x), "u").select("id", F.when(capitals, sentence).otherwise(t).alias("title"))


@query("TXT24", """
WITH s AS (SELECT doc_id, generate_subscripts(l, 1) AS k, trim(unnest(l)) AS s FROM (SELECT doc_id, regexp_extract_all(text, '[^.?!।\\n]+[.?!।]') AS l FROM documents))
SELECT doc_id, CAST(k AS BIGINT) AS k, CASE WHEN regexp_matches(s, '^[\\x{900}-\\x{97F}][^0-9०-९()\\[\\]{}]*।$') THEN 'hi' ELSE 'en' END AS lang FROM s
WHERE len(regexp_extract_all(s, '\\S+')) BETWEEN 12 AND 40 AND NOT regexp_matches(s, '(?i)rs\\.|hon|sir') AND ((regexp_matches(s, '^[A-Z][^0-9()\\[\\]{}]*\\.$') AND length(regexp_replace(s, '[^A-Za-z]', '', 'g')) >= 0.95 * length(regexp_replace(s, '[^\\p{L}]', '', 'g')))
  OR (regexp_matches(s, '^[\\x{900}-\\x{97F}][^0-9०-९()\\[\\]{}]*।$') AND length(regexp_replace(s, '[^\\x{900}-\\x{963}]', '', 'g')) >= 0.95 * length(regexp_replace(s, '[^\\p{L}\\p{M}]', '', 'g'))))""")
def quotable_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences that may be quoted, English or Hindi: 12 to 40 words, a full stop or danda, nearly all letters of one script, no digits, brackets or listed words."""
    d = load(spark, folder, "documents", "doc_id", "text").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[^.?!।\\n]+[.?!।]"), 0)).alias("k", "s")).withColumn("s", F.trim("s"))
    share = lambda own, of: F.length(F.regexp_replace("s", own, "")) >= 0.95 * F.length(F.regexp_replace("s", of, ""))
    hindi = F.col("s").rlike("^[\\x{900}-\\x{97F}][^0-9०-९()\\[\\]{}]*।$")
    english = F.col("s").rlike("^[A-Z][^0-9()\\[\\]{}]*\\.$") & share("[^A-Za-z]", "[^\\p{L}]")
    fits = F.size(F.regexp_extract_all("s", F.lit("\\S+"), 0)).between(12, 40) & ~F.col("s").rlike("(?i)rs\\.|hon|sir")
    return d.where(fits & (english | (hindi & share("[^\\x{900}-\\x{963}]", "[^\\p{L}\\p{M}]")))).select("doc_id", (F.col("k") + 1).cast("bigint").alias("k"), F.when(hindi, "hi").otherwise("en").alias("lang"))


@query("VEC08", """
SELECT id, concat_ws(' | ', tag, nullif(array_to_string(list_sort(list_distinct(list_filter(list_transform(coalesce(aliases, []), lambda x: trim(x)), lambda x: lower(x) <> lower(tag) AND x <> ''))), ', '), ''), type, nullif(nullif(domain, '-'), ''), description) AS input FROM tags""")
def embedding_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The text that a tag's vector is made of: name, its other spellings once each, type, domain, description; what is missing is left out."""
    t = load(spark, folder, "tags", "id", "tag", "aliases", "type", "domain", "description")
    others = F.filter(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: (F.lower(x) != F.lower("tag")) & (x != ""))
    named = F.array_join(F.sort_array(F.array_distinct(others)), ", ")
    known = F.when(~F.col("domain").isin("-", ""), F.col("domain"))
    return t.select("id", F.concat_ws(" | ", "tag", F.when(named != "", named), "type", known, "description").alias("input"))


@query("VEC10", f"""
WITH {U}, g AS (SELECT id FROM tags ORDER BY debate_count DESC, id LIMIT 20), f AS (SELECT x.tag_id AS a, y.tag_id AS b, round({D.format('x.v', 'y.v')}, 5) AS dist FROM t x JOIN t y ON x.tag_id <> y.tag_id WHERE x.tag_id % 50 = 0 AND y.tag_id NOT IN (SELECT id FROM g))
SELECT a, b, dist FROM f QUALIFY row_number() OVER (PARTITION BY a ORDER BY dist, b) <= 4""")
def nearest_but_general(spark: SparkSession, folder: str) -> DataFrame:
    """The four tags nearest to every fiftieth, after the twenty most general ones (a stated list) are taken out."""
    t = _tags(spark, folder)
    general = load(spark, folder, "tags", "id", "debate_count").orderBy(F.desc("debate_count"), "id").limit(20).select(F.col("id").alias("tag_id"))
    near = graph.nearest(t.where("tag_id % 50 = 0").select(F.col("tag_id").alias("a"), F.col("v").alias("va")), t.join(general, "tag_id", "left_anti").select(F.col("tag_id").alias("b"), F.col("v").alias("vb")), 4)
    return near.select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), "dist")


HYBRID = f"""{U}, e AS (SELECT id, name, embedding_query AS v FROM entity_names WHERE id % 50 = 0),
w AS (SELECT e.id, g.id AS tag_id FROM e JOIN tags g ON list_has_all({T('g.tag')}, {T("list_extract(string_split(e.name, ' '), 1) || ' ' || list_extract(string_split(e.name, ' '), 2)")}) WHERE g.status = 'reviewed'),
n AS (SELECT e.id, t.tag_id, round({D.format('e.v', 't.v')}, 5) AS dist FROM e, t WHERE e.v IS NOT NULL AND len(list_filter(e.v, lambda x: isnan(x))) = 0 AND len(list_filter(e.v, lambda x: x <> 0)) > 0 QUALIFY row_number() OVER (PARTITION BY e.id ORDER BY dist, t.tag_id) <= 10),
m AS (SELECT n.* FROM n JOIN tags g ON g.id = n.tag_id WHERE dist <= 0.36 AND g.status = 'reviewed')"""


def _hybrid(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Of every fiftieth name: the live tags with its first two words, and those near to it in meaning."""
    e = load(spark, folder, "entity_names", "id", "name", "embedding_query").where("id % 50 = 0")
    live = load(spark, folder, "tags", "id", "tag", "status").where("status = 'reviewed'").select(F.col("id").alias("tag_id"), tx.tokens(F.col("tag")).alias("g"))
    asked = e.select("id", tx.tokens(F.array_join(F.slice(F.split("name", " "), 1, 2), " ")).alias("q"))
    by_word = live.select("tag_id", "g", F.explode(F.array_distinct("g")).alias("w"))
    words = asked.where(F.size("q") > 0).select("id", "q", F.col("q")[0].alias("w")).join(by_word, "w").where(F.size(F.array_except("q", "g")) == 0).select("id", "tag_id").distinct()
    left = e.select((-F.col("id")).alias("a"), vec.unit(F.col("embedding_query")).alias("va")).where("va is not null")
    near = graph.nearest(left, _tags(spark, folder).select(F.col("tag_id").alias("b"), F.col("v").alias("vb")), 10).where("dist <= 0.36")
    meaning = near.select((-F.col("a")).alias("id"), F.col("b").cast("int").alias("tag_id"), "dist").join(live.select("tag_id"), "tag_id", "left_semi")
    return words, meaning.select("id", "tag_id", "dist")


@query("TXT07 TXT06 PAG25", f"""
WITH {HYBRID} SELECT id, tag_id, CASE WHEN w.tag_id IS NULL THEN 'meaning' WHEN m.tag_id IS NULL THEN 'words' ELSE 'both' END AS kind FROM w FULL JOIN m USING (id, tag_id)""")
def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    """Live tags found for a name by words or by stored meaning, and by which of them."""
    words, meaning = _hybrid(spark, folder)
    return rel.set_difference(words, meaning, ["id", "tag_id"]).select("id", "tag_id", F.when(F.col("side") == "left", "words").when(F.col("side") == "right", "meaning").otherwise("both").alias("kind"))


@query("TXT13", f"""
WITH {HYBRID} SELECT m.id, m.tag_id, m.dist FROM m LEFT JOIN w ON w.id = m.id AND w.tag_id = m.tag_id JOIN tags g ON g.id = m.tag_id WHERE w.tag_id IS NULL AND g.debate_count > 0 QUALIFY row_number() OVER (PARTITION BY m.id ORDER BY dist, m.tag_id) <= 5""")
def suggested_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Up to five live tags with debates that are near in meaning and not among those found by words."""
    words, meaning = _hybrid(spark, folder)
    used = load(spark, folder, "tags", "id", "debate_count").where("debate_count > 0").select(F.col("id").alias("tag_id"))
    return rel.top_per_group(meaning.join(words, ["id", "tag_id"], "left_anti").join(used, "tag_id", "left_semi"), ["id"], [F.col("dist"), F.col("tag_id")], 5).select("id", "tag_id", "dist")


@query("TXT12", f"""
WITH RECURSIVE seats AS (SELECT array_to_string({T("trim(regexp_replace(constituency, '[(].*$', ''))")}, ' ') AS name, count(DISTINCT state_id) AS c FROM speakers WHERE constituency IS NOT NULL GROUP BY 1), kw AS (SELECT DISTINCT array_to_string({T('k')}, ' ') AS name FROM (SELECT unnest(keywords) AS k FROM debates)),
n AS (SELECT name, 'place' AS kind, len(string_split(name, ' ')) AS k FROM seats WHERE c = 1 AND name <> '' UNION ALL SELECT name, 'tag', len(string_split(name, ' ')) FROM kw WHERE name <> '' AND name NOT IN (SELECT name FROM seats)),
d AS (SELECT id, {T('title')} AS t FROM debates), c AS (SELECT id, t, unnest(range(1, len(t) + 1)) AS pos FROM d), l AS (SELECT id, pos, max(n.k) AS k FROM c, (SELECT DISTINCT k FROM n) s JOIN n ON n.k = s.k WHERE n.name = array_to_string(t[pos:pos + n.k - 1], ' ') GROUP BY 1, 2),
r(id, pos) AS (SELECT id, CAST(1 AS BIGINT) FROM d WHERE len(t) > 0 UNION ALL SELECT r.id, r.pos + coalesce(l.k, 1) FROM r JOIN d ON d.id = r.id LEFT JOIN l ON l.id = r.id AND l.pos = r.pos WHERE r.pos + coalesce(l.k, 1) <= len(d.t))
SELECT r.id, CAST(r.pos AS INTEGER) AS "at", n.name, n.kind FROM r JOIN l ON l.id = r.id AND l.pos = r.pos JOIN d ON d.id = r.id JOIN n ON n.name = array_to_string(d.t[r.pos:r.pos + l.k - 1], ' ')""")
def named_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The places and tags that titles name, longest runs of words first; a place beats a tag, and one of several states is dropped."""
    s = load(spark, folder, "speakers", "constituency", "state_id").where("constituency is not null").select(F.array_join(tx.tokens(F.regexp_replace("constituency", "[(].*$", "")), " ").alias("name"), "state_id")
    seats = s.groupBy("name").agg(F.count_distinct("state_id").alias("c")).where("name <> ''")
    tags = load(spark, folder, "debates", "keywords").select(F.explode("keywords").alias("k")).select(F.array_join(tx.tokens(F.col("k")), " ").alias("name")).distinct().join(seats, "name", "left_anti")
    names = seats.where("c = 1").select("name", F.lit("place").alias("kind")).unionByName(tags.select("name", F.lit("tag").alias("kind")))
    return search.named_runs(load(spark, folder, "debates", "id", "title"), "id", F.col("title"), names)


# Sequences


@query("SEQ03", """
WITH t AS (SELECT DISTINCT ON (debate_id, seq) debate_id, seq, coalesce(word_count, 0) AS w FROM turns ORDER BY debate_id, seq, id),
c AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY debate_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, row_number() OVER (PARTITION BY debate_id ORDER BY seq) AS n, row_number() OVER (PARTITION BY debate_id ORDER BY seq DESC) AS back FROM t)
SELECT debate_id, seq, CASE WHEN (n <= 5 OR b < 200) AND (b < 400 OR n = 1) THEN 'head' ELSE 'tail' END AS part FROM c WHERE ((n <= 5 OR b < 200) AND (b < 400 OR n = 1)) OR back <= 2""")
def head_and_tail(spark: SparkSession, folder: str) -> DataFrame:
    """The head of each debate and its last two turns, each turn once."""
    t = once_each(spark, folder, "word_count").select("debate_id", "seq", F.coalesce("word_count", F.lit(0)).alias("word_count"))
    head = seq.head_of(t, "debate_id", "seq", "word_count", 5, 200, 400).select("debate_id", "seq", F.lit("head").alias("part"))
    ends = t.groupBy("debate_id").agg(F.max("seq").alias("last"))
    before = t.join(ends, "debate_id").where("seq < last").groupBy("debate_id").agg(F.max("seq").alias("last"))
    tail = ends.unionByName(before).select("debate_id", F.col("last").alias("seq"), F.lit("tail").alias("part"))
    return head.unionByName(tail).groupBy("debate_id", "seq").agg(F.min("part").alias("part"))


@query("SEQ05 SEQ06", """
WITH t AS (SELECT DISTINCT ON (debate_id, seq) debate_id, seq, id, text, mp_code, person_id FROM turns ORDER BY debate_id, seq, id),
r AS (SELECT id, debate_id, md5(text) AS expected FROM turns WHERE id % 5 = 0 AND contains(text, chr(10))), g AS (SELECT r.debate_id, bool_and(t.id IS NOT NULL AND md5(t.text) = CASE WHEN r.id % 35 = 0 THEN 'x' ELSE expected END) AS ok FROM r LEFT JOIN t ON t.id = r.id GROUP BY 1),
p AS (SELECT t.debate_id, t.seq, generate_subscripts(CASE WHEN r.id IS NOT NULL THEN string_split(t.text, chr(10)) ELSE [t.text] END, 1) AS part, unnest(CASE WHEN r.id IS NOT NULL THEN string_split(t.text, chr(10)) ELSE [t.text] END) AS text FROM t JOIN g ON g.debate_id = t.debate_id AND g.ok LEFT JOIN r ON r.id = t.id)
SELECT debate_id, row_number() OVER (PARTITION BY debate_id ORDER BY seq, part) - 1 AS new_seq, seq AS old_seq, md5(text) AS hash FROM p""")
def guarded_rewrite(spark: SparkSession, folder: str) -> DataFrame:
    """Listed turns split at line ends and their debates numbered again, all or nothing: a debate with one listed turn whose text isn't the expected one stays."""
    t = once_each(spark, folder, "text")
    listed = load(spark, folder, "turns", "id", "debate_id", "text").where((F.col("id") % 5 == 0) & F.contains("text", F.lit("\n"))).select("id", "debate_id", F.md5("text").alias("expected"))
    listed = listed.withColumn("expected", F.when(F.col("id") % 35 == 0, "x").otherwise(F.col("expected")))  # some of the list are out of date
    checked = listed.join(t.select("id", F.md5("text").alias("now")), "id", "left").groupBy("debate_id").agg(F.min(F.coalesce(F.col("now") == F.col("expected"), F.lit(False))).alias("ok")).where("ok").select("debate_id")
    rows = t.join(checked, "debate_id", "left_semi").join(listed.select("id", F.lit(True).alias("cut")), "id", "left")
    parts = F.when(F.col("cut"), F.split("text", "\n")).otherwise(F.array("text"))
    placed = seq.running_sum(rows.select("debate_id", "seq", F.size(parts).alias("n")), "debate_id", "seq", "n", "upto").select("debate_id", "seq", (F.col("upto") - F.col("n")).alias("first"))
    each = rows.select("debate_id", "seq", F.posexplode(parts).alias("part", "text")).select("debate_id", "seq", "part", F.md5("text").alias("hash"))
    return each.join(placed, ["debate_id", "seq"]).select("debate_id", (F.col("first") + F.col("part")).alias("new_seq"), F.col("seq").alias("old_seq"), "hash")


@query("SEQ06", """
WITH v AS (SELECT d.loksabha AS term, t.speaker_label, min(person_id) AS p FROM turns t JOIN debates d ON d.id = t.debate_id WHERE name_source IN ('anchor', 'name-exact') AND person_id IS NOT NULL AND speaker_label IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT person_id) = 1)
SELECT t.id, t.person_id AS was, v.p AS now FROM turns t JOIN debates d ON d.id = t.debate_id JOIN v ON v.term = d.loksabha AND v.speaker_label = t.speaker_label WHERE t.role_kind IS NULL AND t.person_id IS DISTINCT FROM v.p""")
def reassigned_turns(spark: SparkSession, folder: str) -> DataFrame:
    """A list of owners (the only surely known person of a label in a term) applied to the turns: those that change, with both owners."""
    t = load(spark, folder, "turns", "id", "debate_id", "speaker_label", "name_source", "person_id", "role_kind").where("speaker_label is not null")
    t = t.join(load(spark, folder, "debates", "id", "loksabha").select(F.col("id").alias("debate_id"), F.col("loksabha").alias("term")), "debate_id")
    sure = t.where("name_source in ('anchor', 'name-exact') and person_id is not null")
    v = sure.groupBy("term", "speaker_label").agg(F.min("person_id").alias("now"), F.count_distinct("person_id").alias("n")).where("n = 1").drop("n")
    return t.where("role_kind is null").join(v, ["term", "speaker_label"]).where(~F.col("person_id").eqNullSafe(F.col("now"))).select("id", F.col("person_id").alias("was"), "now")


# Pages


@query("PAG03", f"""
WITH {S}, f AS (SELECT * FROM s WHERE y = 1997) SELECT 'tag' AS facet, tag AS value, count(DISTINCT unit) AS n FROM f WHERE place < 5 GROUP BY 2 UNION ALL SELECT 'place', CAST(place AS VARCHAR), count(DISTINCT unit) FROM f WHERE tag IN ('Brand#3', 'Brand#5') GROUP BY 2
UNION ALL SELECT 'party', party, count(DISTINCT unit) FROM f WHERE tag IN ('Brand#3', 'Brand#5') AND place < 5 GROUP BY 2
UNION ALL SELECT 'tag_all', tag, count(*) FROM f WHERE place < 5 AND unit IN (SELECT unit FROM f WHERE tag IN ('Brand#3', 'Brand#5') GROUP BY unit HAVING count(*) = 2) GROUP BY 2""")
def named_facets(spark: SparkSession, folder: str) -> DataFrame:
    """Facets of tag, place and party, each under all filters but its own, and of the tags that go with two given ones."""
    f = stage(sales(spark, folder).where("y = 1997"), "facts")
    tagged, placed = F.col("tag").isin("Brand#3", "Brand#5"), F.col("place") < 5
    facets = {"tag": (placed, F.col("tag")), "place": (tagged, F.col("place").cast("string")), "party": (tagged & placed, F.col("party"))}
    each = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(name).alias("facet"), v.alias("value"))) for name, (c, v) in facets.items())))
    counts = f.select("unit", F.explode(each).alias("f")).distinct().groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))
    both = rel.having_all(f, "unit", "tag", ["Brand#3", "Brand#5"])
    more = f.where(placed).join(both, "unit", "left_semi").groupBy(F.col("tag").alias("value")).agg(F.count("*").alias("n")).select(F.lit("tag_all").alias("facet"), "value", "n")
    return counts.unionByName(more)


@query("PAG05", f"""
WITH {S}, p AS (SELECT party, count(DISTINCT unit) AS units, count(DISTINCT CASE WHEN tag = 'Brand#3' THEN unit END) AS n FROM s GROUP BY 1), m AS (SELECT party, count(*) AS members FROM (SELECT party, member FROM s WHERE tag = 'Brand#3' GROUP BY 1, 2 HAVING count(*) >= 3) GROUP BY 1),
k AS (SELECT party, arg_max(y, (n, -y)) AS peak FROM (SELECT party, y, count(*) AS n FROM s WHERE tag = 'Brand#3' GROUP BY 1, 2) GROUP BY 1)
SELECT party, units, n, round(100.0 * n / units, 6) AS per_100, coalesce(members, 0) AS members, peak FROM p LEFT JOIN m USING (party) LEFT JOIN k USING (party)""")
def tag_parties(spark: SparkSession, folder: str) -> DataFrame:
    """One tag by party: units and rate per hundred, members with three or more, and the year of its peak."""
    s = stage(sales(spark, folder).select("party", "unit", "member", "y", (F.col("tag") == "Brand#3").alias("mine")), "facts")
    p = s.groupBy("party", "unit").agg(F.max("mine").alias("has")).groupBy("party").agg(F.count("*").alias("units"), F.count_if("has").alias("n"))
    mine = s.where("mine")
    m = mine.groupBy("party", "member").agg(F.count("*").alias("c")).where("c >= 3").groupBy("party").agg(F.count("*").alias("members"))
    k = mine.groupBy("party", "y").agg(F.count("*").alias("c")).groupBy("party").agg(F.max_by("y", F.struct("c", -F.col("y"))).alias("peak"))
    out = p.join(m, "party", "left").join(k, "party", "left")
    return out.select("party", "units", "n", F.round(F.col("n") * 100.0 / F.col("units"), 6).alias("per_100"), F.coalesce("members", F.lit(0).cast("bigint")).alias("members"), "peak")


@query("PAG07", f"""
WITH {SPEECHES}, t AS (SELECT DISTINCT ON (debate_id, seq) * FROM turns ORDER BY debate_id, seq, id),
i AS (SELECT s.person_id AS speaker, t.person_id AS interrupter, count(*) AS n FROM speeches s JOIN t ON t.debate_id = s.debate_id AND t.seq BETWEEN s.seq_start AND s.seq_end WHERE t.person_id IS NOT NULL AND s.person_id IS NOT NULL AND t.person_id <> s.person_id GROUP BY 1, 2),
o AS (SELECT speaker AS p, CAST(sum(n) AS BIGINT) AS n FROM i GROUP BY 1), b AS (SELECT interrupter AS p, CAST(sum(n) AS BIGINT) AS n FROM i GROUP BY 1), w AS (SELECT person_id AS p, count(*) AS speeches, CAST(sum(word_count) AS BIGINT) AS words, round(median(word_count), 6) AS mid FROM speeches WHERE person_id IS NOT NULL GROUP BY 1)
SELECT w.p AS person_id, speeches, words, mid, coalesce(o.n, 0) AS interrupted, coalesce(b.n, 0) AS interrupts FROM w LEFT JOIN o USING (p) LEFT JOIN b USING (p)""")
def member_speech_figures(spark: SparkSession, folder: str) -> DataFrame:
    """Each member's speeches, words, median length, and how often others interrupt and are interrupted."""
    s = stage(speeches(spark, folder).where("person_id is not null"), "speeches")
    t = once_each(spark, folder, "person_id").where("person_id is not null").select("debate_id", "seq", F.col("person_id").alias("by"))
    i = rel.within_spans(t, s.select("debate_id", "seq_start", "seq_end", "person_id"), "debate_id", "seq", "seq_start", "seq_end").where("by <> person_id").groupBy("person_id", "by").agg(F.count("*").alias("n"))
    of, by = i.groupBy("person_id").agg(F.sum("n").alias("interrupted")), i.groupBy(F.col("by").alias("person_id")).agg(F.sum("n").alias("interrupts"))
    w = s.groupBy("person_id").agg(F.count("*").alias("speeches"), F.sum("word_count").alias("words"), F.round(F.percentile("word_count", 0.5), 6).alias("mid"))
    out = w.join(of, "person_id", "left").join(by, "person_id", "left")
    return out.select("person_id", "speeches", "words", "mid", *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("interrupted", "interrupts")))


@query("PAG20 PAG26", """
WITH l AS (SELECT DISTINCT id AS debate_id, CAST(m.mpCode AS INTEGER) - 4000 AS p FROM (SELECT id, unnest(from_json(mp_list_raw, '[{"mpCode":"INTEGER"}]')) AS m FROM debates)),
t AS (SELECT debate_id, person_id AS p, count(*) AS turns, CAST(sum(word_count) AS BIGINT) AS words, min(seq) AS first_at FROM turns WHERE person_id IS NOT NULL GROUP BY 1, 2)
SELECT debate_id, p AS person_id, coalesce(turns, 0) AS turns, coalesce(words, 0) AS words, first_at, l.p IS NOT NULL AS listed, t.p IS NULL AS silent FROM t FULL JOIN l USING (debate_id, p)""")
def debate_people(spark: SparkSession, folder: str) -> DataFrame:
    """Everyone in a debate: turns, words and first place of those who speak, and the listed members who stay silent."""
    t = load(spark, folder, "turns", "debate_id", "person_id", "word_count", "seq").where("person_id is not null").groupBy("debate_id", "person_id").agg(F.count("*").alias("turns"), F.sum("word_count").alias("words"), F.min("seq").alias("first_at"))
    listed = F.from_json("mp_list_raw", "array<struct<mpCode:int>>")
    l = load(spark, folder, "debates", "id", "mp_list_raw").select(F.col("id").alias("debate_id"), F.explode(listed).alias("m")).select("debate_id", (F.col("m.mpCode") - 4000).alias("person_id"), F.lit(True).alias("listed")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return t.join(l, ["debate_id", "person_id"], "full").select("debate_id", "person_id", zero("turns"), zero("words"), "first_at", F.coalesce("listed", F.lit(False)).alias("listed"), F.col("turns").isNull().alias("silent"))


@query("PAG21", f"""
WITH {SPEECHES} SELECT debate_id, seq_start, person_id, lag(seq_start) OVER d AS previous, lead(seq_start) OVER d AS next, count(*) OVER (PARTITION BY person_id) AS of_member, row_number() OVER (PARTITION BY person_id ORDER BY debate_id, seq_start) AS nth FROM speeches
WHERE person_id IS NOT NULL WINDOW d AS (PARTITION BY debate_id ORDER BY seq_start)""")
def speech_page(spark: SparkSession, folder: str) -> DataFrame:
    """Each member's speech with its neighbours in the debate, how many the member has, and which of them it is."""
    s = stage(speeches(spark, folder).where("person_id is not null").select("debate_id", "seq_start", "person_id", F.lit(1).cast("bigint").alias("one"), (-F.col("seq_start")).alias("down")), "speeches")
    s = seq.with_previous(s.withColumn("at", F.col("seq_start")), "debate_id", "seq_start", ["at"]).withColumnRenamed("prev_at", "previous")
    s = seq.with_previous(s, "debate_id", "down", ["at"]).withColumnRenamed("prev_at", "next")
    # A member's speeches are counted debate by debate, then inside each.
    by = s.groupBy("person_id", "debate_id").agg(F.count("*").alias("n"))
    before = by.withColumn("earlier", F.coalesce(F.sum("n").over(Window.partitionBy("person_id").orderBy("debate_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = by.groupBy("person_id").agg(F.sum("n").alias("of_member"))
    inside = Window.partitionBy("person_id", "debate_id").orderBy("seq_start")
    out = s.withColumn("k", F.row_number().over(inside)).join(before.drop("n"), ["person_id", "debate_id"]).join(total, "person_id")
    return out.select("debate_id", "seq_start", "person_id", "previous", "next", "of_member", (F.col("earlier") + F.col("k")).alias("nth"))


@query("TAG08", """
SELECT l_orderkey AS unit, p_brand AS tag, list_sort(list(DISTINCT l_returnflag)) AS reasons, count(*) AS items, count(*) FILTER (WHERE l_quantity >= 40) AS marks FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
def tag_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Why a unit has a tag: the distinct reasons of its items, their number, and how many are marked."""
    l, p = load(spark, folder, "lineitem", "l_orderkey", "l_partkey", "l_returnflag", "l_quantity"), load(spark, folder, "part", "p_partkey", "p_brand")
    return l.join(p, l.l_partkey == p.p_partkey).groupBy(F.col("l_orderkey").alias("unit"), F.col("p_brand").alias("tag")).agg(
        F.sort_array(F.collect_set("l_returnflag")).alias("reasons"), F.count("*").alias("items"), F.count_if(F.col("l_quantity") >= 40).alias("marks"))


@query("PAG22", """
WITH e AS (SELECT user_id % 9 AS party, user_id, bool_or(event_type = 'purchase') AS f, bool_or(event_type = 'error') AS a FROM events WHERE value > 60 AND event_type IN ('purchase', 'error', 'view') GROUP BY 1, 2),
s AS (SELECT party, CASE WHEN f AND a THEN 'mixed' WHEN f THEN 'for' WHEN a THEN 'against' ELSE 'unclear' END AS stance, user_id FROM e), r AS (SELECT party, row_number() OVER (ORDER BY count(*) DESC, party) AS k FROM s GROUP BY 1)
SELECT CASE WHEN k <= 7 THEN CAST(party AS VARCHAR) ELSE 'Others' END AS party, stance, count(*) AS members, min(user_id) AS sample FROM s JOIN r USING (party) GROUP BY 1, 2""")
def stance_by_party(spark: SparkSession, folder: str) -> DataFrame:
    """Members' stances by party, the seven largest and the others, with a sample of each."""
    e = load(spark, folder, "events", "user_id", "event_type", "value").where(F.col("event_type").isin("purchase", "error", "view") & (F.col("value") > 60))
    has = lambda v: F.max(F.col("event_type") == v)
    s = e.groupBy((F.col("user_id") % 9).alias("p"), "user_id").agg(has("purchase").alias("f"), has("error").alias("a"))
    stance = F.when(F.col("f") & F.col("a"), "mixed").when(F.col("f"), "for").when(F.col("a"), "against").otherwise("unclear")
    n = s.groupBy("p", stance.alias("stance")).agg(F.count("*").alias("n"), F.min("user_id").alias("sample"))
    r = n.groupBy("p").agg(F.sum("n").alias("all")).withColumn("k", F.row_number().over(Window.orderBy(F.desc("all"), "p")))
    return n.join(r, "p").groupBy(F.when(F.col("k") <= 7, F.col("p").cast("string")).otherwise("Others").alias("party"), "stance").agg(F.sum("n").alias("members"), F.min("sample").alias("sample"))


@query("PAG14", f"""
WITH {S}, m AS (SELECT strftime(day, '%Y-%m') AS month, count(DISTINCT unit) AS units, count(DISTINCT CASE WHEN tag = 'Brand#5' THEN unit END) AS n FROM s GROUP BY 1), r AS (SELECT *, 1000.0 * n / units AS rate FROM m)
SELECT month, n, units, round(rate, 6) AS rate, round(rate / avg(rate) OVER (), 6) AS strength, row_number() OVER (ORDER BY rate DESC, month) = 1 AS peak FROM r""")
def trend_months(spark: SparkSession, folder: str) -> DataFrame:
    """A tag's rate by month against the mean of all months, and the month of its peak."""
    s = sales(spark, folder)
    u = s.groupBy("unit", F.date_format("day", "yyyy-MM").alias("month")).agg(F.max(F.col("tag") == "Brand#5").alias("has"))
    r = u.groupBy("month").agg(F.count_if("has").alias("n"), F.count("*").alias("units")).withColumn("_r", F.col("n") * 1000.0 / F.col("units"))
    total = r.agg(F.avg("_r").alias("mean"), F.max_by("month", F.struct("_r", -F.to_date(F.concat("month", F.lit("-01"))).cast("timestamp").cast("bigint"))).alias("top"))
    return r.join(F.broadcast(total)).select("month", "n", "units", F.round("_r", 6).alias("rate"), F.round(F.col("_r") / F.col("mean"), 6).alias("strength"), (F.col("month") == F.col("top")).alias("peak"))


@query("PAG18", """
WITH h AS (SELECT id, 'tag' AS kind FROM tags WHERE id % 37 = 0 UNION ALL SELECT DISTINCT id, 'debate' FROM debates WHERE id % 29 = 0 UNION ALL SELECT 10000000, 'tag')
SELECT h.kind, h.id, CASE WHEN h.kind = 'tag' AND t.id IS NULL THEN 'unknown tag' WHEN h.kind = 'tag' AND t.status <> 'reviewed' THEN 'not live' WHEN h.kind = 'debate' AND d.title IS NULL THEN 'no title' WHEN h.kind = 'debate' AND d.n = 0 THEN 'no turns' END AS left_out
FROM h LEFT JOIN tags t ON h.kind = 'tag' AND t.id = h.id LEFT JOIN (SELECT d.id, any_value(d.title) AS title, count(t.id) AS n FROM debates d LEFT JOIN turns t ON t.debate_id = d.id GROUP BY 1) d ON h.kind = 'debate' AND d.id = h.id""")
def featured_references(spark: SparkSession, folder: str) -> DataFrame:
    """Hand-picked references (here by number, and one that doesn't exist) with the reason why one is left out, null for those that stay."""
    tags, d = load(spark, folder, "tags", "id", "status"), load(spark, folder, "debates", "id", "title")
    picked = lambda df, n, kind: df.where(F.col("id") % n == 0).select(F.col("id").cast("bigint").alias("id"), F.lit(kind).alias("kind"))
    t = picked(tags, 37, "tag").unionByName(spark.range(1).select(F.lit(10_000_000).cast("bigint").alias("id"), F.lit("tag").alias("kind"))).join(tags, "id", "left")
    n = load(spark, folder, "turns", "debate_id").groupBy(F.col("debate_id").alias("id")).agg(F.count("*").alias("n"))
    of_tag = t.select("kind", "id", F.when(F.col("status").isNull(), "unknown tag").when(F.col("status") != "reviewed", "not live").alias("left_out"))
    e = picked(d, 29, "debate").join(d, "id", "left").join(n, "id", "left")
    return of_tag.unionByName(e.select("kind", "id", F.when(F.col("title").isNull(), "no title").when(F.col("n").isNull(), "no turns").alias("left_out")))


@query("PAG24", """
WITH k AS (SELECT name_source, id, word_count FROM turns WHERE word_count IS NOT NULL) SELECT name_source, count(*) AS turns, CAST(sum(word_count) AS BIGINT) AS words, arg_max(id, (word_count, -id)) AS example FROM k GROUP BY 1""")
def worked_examples(spark: SparkSession, folder: str) -> DataFrame:
    """How turns got their names, with the longest turn of each way as an example."""
    t = load(spark, folder, "turns", "name_source", "id", "word_count").where("word_count is not null")
    return t.groupBy("name_source").agg(F.count("*").alias("turns"), F.sum("word_count").alias("words"), F.max_by("id", F.struct("word_count", -F.col("id"))).alias("example"))


# Sessions, seats and lists


@query("TXT48", """
WITH d AS (SELECT loksabha, session, min(debate_date) AS first_day FROM debates WHERE debate_date IS NOT NULL GROUP BY 1, 2), n AS (SELECT *, CASE WHEN month(first_day) <= 4 THEN 'Budget' WHEN month(first_day) <= 9 THEN 'Monsoon' ELSE 'Winter' END || ' session, ' || year(first_day) AS name FROM d)
SELECT loksabha, session, CASE WHEN row_number() OVER (PARTITION BY name ORDER BY first_day, loksabha, session) = 1 THEN name ELSE 'Special session, ' || monthname(first_day) || ' ' || year(first_day) END AS name FROM n""")
def session_names(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions named by season and year; a later one of the same name is a special session of its month."""
    d = load(spark, folder, "debates", "loksabha", "session", "debate_date").where("debate_date is not null").groupBy("loksabha", "session").agg(F.min("debate_date").alias("f"))
    season = F.when(F.month("f") <= 4, "Budget").when(F.month("f") <= 9, "Monsoon").otherwise("Winter")
    n = d.withColumn("n", F.concat(season, F.lit(" session, "), F.year("f").cast("string")))
    first = F.row_number().over(Window.partitionBy("n").orderBy("f", "loksabha", "session")) == 1
    return n.select("loksabha", "session", F.when(first, F.col("n")).otherwise(F.concat(F.lit("Special session, "), F.date_format("f", "MMMM yyyy"))).alias("name"))


@query("TXT49", """
WITH p AS (SELECT id, lower(regexp_extract(description, '^([^:,]*)', 1)) AS label, trim(regexp_extract(description, ',\\s*([^:,]*)', 1)) AS area FROM tags WHERE type = 'place'), u AS (SELECT list_last(string_split(label, ' ')) AS k, min(id) AS tag_id FROM p GROUP BY 1 HAVING count(*) = 1),
s AS (SELECT DISTINCT lower(trim(regexp_replace(constituency, '\\s*\\(.*\\)\\s*$', ''))) AS seat FROM speakers WHERE constituency IS NOT NULL)
SELECT s.seat, u.tag_id, p.label, p.area FROM s LEFT JOIN u ON u.k = s.seat LEFT JOIN p ON p.id = u.tag_id""")
def seat_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Each seat with the only place tag whose label, read from its description, ends in its name; none where several do."""
    p = load(spark, folder, "tags", "id", "type", "description").where("type = 'place'").select(
        "id", F.lower(F.regexp_extract("description", "^([^:,]*)", 1)).alias("label"), F.trim(F.regexp_extract("description", ",\\s*([^:,]*)", 1)).alias("area"))
    u = p.groupBy(F.element_at(F.split("label", " "), -1).alias("seat")).agg(F.min(F.struct("id", "label", "area")).alias("t"), F.count("*").alias("n")).where("n = 1").select("seat", "t")
    s = load(spark, folder, "speakers", "constituency").where("constituency is not null").select(F.lower(F.trim(F.regexp_replace("constituency", "\\s*\\(.*\\)\\s*$", ""))).alias("seat")).distinct()
    return s.join(u, "seat", "left").select("seat", F.col("t.id").alias("tag_id"), "t.label", "t.area")


@query("TXT50", """
WITH l AS (SELECT d.id AS debate_id, string_split(trim(regexp_replace(lower(n), '^(shri|shrimati|dr|prof|adv)\\.? ', '')), ' ') AS w FROM (SELECT id, unnest(member_names) AS n FROM debates) d),
s AS (SELECT DISTINCT t.debate_id, t.person_id, string_split(lower(trim(s.name)), ' ') AS w FROM turns t JOIN speakers s ON s.person_id = t.person_id WHERE t.person_id IS NOT NULL AND s.name IS NOT NULL)
SELECT s.debate_id, s.person_id, bool_or(l.w IS NOT NULL AND (list_has_all(s.w, l.w) OR list_has_all(l.w, s.w))) AS listed FROM s LEFT JOIN l ON l.debate_id = s.debate_id AND list_last(l.w) = list_last(s.w) GROUP BY 1, 2""")
def listed_speakers(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each member who speaks is on the debate's list of names: the words of one name are all in the other."""
    words = lambda c: F.split(F.trim(F.regexp_replace(F.lower(c), "^(shri|shrimati|dr|prof|adv)\\.? ", "")), " ")
    l = load(spark, folder, "debates", "id", "member_names").select(F.col("id").alias("debate_id"), F.explode("member_names").alias("n")).select("debate_id", words("n").alias("lw")).withColumn("k", F.element_at("lw", -1))
    names = load(spark, folder, "speakers", "person_id", "name").where("name is not null").select("person_id", F.split(F.lower(F.trim("name")), " ").alias("w")).distinct()
    s = load(spark, folder, "turns", "debate_id", "person_id").where("person_id is not null").distinct().join(names, "person_id").withColumn("k", F.element_at("w", -1))
    fits = (F.size(F.array_except("lw", "w")) == 0) | (F.size(F.array_except("w", "lw")) == 0)
    return s.join(l, ["debate_id", "k"], "left").groupBy("debate_id", "person_id").agg(F.max(F.coalesce(F.col("lw").isNotNull() & fits, F.lit(False))).alias("listed"))


@query("TXT51", """
WITH l AS (SELECT DISTINCT id AS debate_id, CAST(m.mpCode AS INTEGER) - 4000 AS p, m.mpName AS name FROM (SELECT id, unnest(from_json(mp_list_raw, '[{"mpCode":"INTEGER","mpName":"VARCHAR"}]')) AS m FROM debates)), x AS (SELECT debate_id, p, min(name) AS name FROM l WHERE NOT EXISTS (SELECT 1 FROM turns t WHERE t.debate_id = l.debate_id AND t.person_id = l.p) GROUP BY 1, 2),
k AS (SELECT debate_id, count(*) FILTER (WHERE person_id IS NULL AND role_kind IS NULL) AS open, count(*) FILTER (WHERE role_kind IS NOT NULL) AS roles, count(*) AS n FROM turns GROUP BY 1), c AS (SELECT debate_id, list_last(string_split(name, ' ')) AS sur, count(DISTINCT p) AS same FROM l GROUP BY 1, 2)
SELECT x.debate_id, x.p AS person_id, CASE WHEN c.same > 1 THEN 'collision' WHEN k.roles = k.n THEN 'role only' WHEN k.open > 0 THEN 'printed, unexplained' ELSE 'not printed' END AS reason FROM x LEFT JOIN k USING (debate_id) LEFT JOIN c ON c.debate_id = x.debate_id AND c.sur = list_last(string_split(x.name, ' '))""")
def missing_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Why a listed member has no turn, by the first that fits: a surname that several listed members have, a debate of roles only, turns that nobody was found for, else not printed."""
    listed = F.from_json("mp_list_raw", "array<struct<mpCode:int,mpName:string>>")
    l = load(spark, folder, "debates", "id", "mp_list_raw").select(F.col("id").alias("debate_id"), F.explode(listed).alias("m")).select("debate_id", (F.col("m.mpCode") - 4000).alias("person_id"), F.col("m.mpName").alias("name"))
    l = l.groupBy("debate_id", "person_id").agg(F.min("name").alias("name"), F.collect_set(F.element_at(F.split("name", " "), -1)).alias("surs"))
    t = load(spark, folder, "turns", "debate_id", "person_id", "role_kind")
    k = t.groupBy("debate_id").agg(F.count_if(F.col("person_id").isNull() & F.col("role_kind").isNull()).alias("open"), F.count_if(F.col("role_kind").isNotNull()).alias("roles"), F.count("*").alias("n"))
    c = l.select("debate_id", "person_id", F.explode("surs").alias("sur")).groupBy("debate_id", "sur").agg(F.count("*").alias("same"))
    x = l.join(t.select("debate_id", "person_id").distinct(), ["debate_id", "person_id"], "left_anti").withColumn("sur", F.element_at(F.split("name", " "), -1))
    reason = F.when(F.col("same") > 1, "collision").when(F.col("roles") == F.col("n"), "role only").when(F.col("open") > 0, "printed, unexplained").otherwise("not printed")
    return x.join(k, "debate_id", "left").join(c, ["debate_id", "sur"], "left").select("debate_id", "person_id", reason.alias("reason"))


@query("TXT52", """
WITH a AS (SELECT DISTINCT state_id, upper(trim(regexp_replace(constituency, '\\s*\\(.*\\)\\s*$', ''))) AS place FROM speakers WHERE constituency IS NOT NULL AND state_id IS NOT NULL AND lok_sabha_term <= 15), b AS (SELECT DISTINCT state_id, upper(trim(regexp_replace(constituency, '\\s*\\(.*\\)\\s*$', ''))) AS place FROM speakers WHERE constituency IS NOT NULL AND state_id IS NOT NULL AND lok_sabha_term > 15)
SELECT coalesce(a.state_id, b.state_id) AS state_id, coalesce(a.place, b.place) AS place, CASE WHEN b.place IS NULL THEN 'old seat' WHEN a.place IS NULL THEN 'new seat' ELSE 'both' END AS kind FROM a FULL JOIN b ON a.state_id = b.state_id AND a.place = b.place""")
def place_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Places of two lists (the seats of older and newer terms) by state and name: in both, or only in one."""
    s = load(spark, folder, "speakers", "state_id", "constituency", "lok_sabha_term").where("constituency is not null and state_id is not null").select(
        "state_id", F.upper(F.trim(F.regexp_replace("constituency", "\\s*\\(.*\\)\\s*$", ""))).alias("place"), (F.col("lok_sabha_term") <= 15).alias("old"))
    g = s.groupBy("state_id", "place").agg(F.max("old").alias("old"), F.max(~F.col("old")).alias("new"))
    return g.select("state_id", "place", F.when(F.col("old") & F.col("new"), "both").when(F.col("old"), "old seat").otherwise("new seat").alias("kind"))


@query("TXT53", """
WITH a AS (SELECT lower(trim(x)) AS norm, id, k FROM (SELECT id, unnest(list_prepend(tag, coalesce(aliases, []))) AS x, generate_subscripts(list_prepend(tag, coalesce(aliases, [])), 1) AS k FROM tags WHERE status <> 'rejected')), f AS (SELECT norm, arg_min(id, (k > 1, id)) AS tag_id FROM a GROUP BY 1)
SELECT e.type, count(*) AS names, count(f.tag_id) AS covered, count(*) - count(f.tag_id) AS uncovered FROM entity_names e LEFT JOIN f ON f.norm = lower(trim(e.name)) GROUP BY 1""")
def vocabulary_cover(spark: SparkSession, folder: str) -> DataFrame:
    """How many names of each type the vocabulary covers; a spelling belongs to the first tag that has it, as its name before as an alias."""
    t = load(spark, folder, "tags", "id", "tag", "aliases", "status").where("status <> 'rejected'")
    a = t.select("id", F.posexplode(F.concat(F.array("tag"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("k", "x"))
    f = a.groupBy(F.lower(F.trim("x")).alias("norm")).agg(F.min_by("id", F.struct(F.col("k") > 0, "id")).alias("tag_id"))
    e = load(spark, folder, "entity_names", "type", "name").withColumn("norm", F.lower(F.trim("name"))).join(f, "norm", "left")
    return e.groupBy("type").agg(F.count("*").alias("names"), F.count("tag_id").alias("covered"), F.count_if(F.col("tag_id").isNull()).alias("uncovered"))


@query("TXT55", """
WITH n AS (SELECT id, lower(trim(tag)) AS k, regexp_replace(lower(tag), '[^a-z]|[aeiou]', '', 'g') AS near, list_extract(string_split(lower(tag), ' '), 1) AS w FROM tags WHERE status <> 'rejected'), e AS (SELECT id, lower(trim(name)) AS k, regexp_replace(lower(name), '[^a-z]|[aeiou]', '', 'g') AS near FROM entity_names),
u AS (SELECT e.id, n.id AS tag_id, 1 AS pri, 'exact' AS why FROM e JOIN n USING (k) UNION ALL SELECT e.id, n.id, 2, 'near spelling' FROM e JOIN n USING (near) WHERE near <> '' UNION ALL SELECT e.id, m.tag_id, 3, 'linked' FROM e JOIN entity_names m ON m.id = e.id WHERE m.tag_id IS NOT NULL)
SELECT id, tag_id, why FROM u QUALIFY row_number() OVER (PARTITION BY id, tag_id ORDER BY pri) = 1""")
def review_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of a name and a tag to review, each once by its first reason: the same name, a near spelling (same consonants), a stored link."""
    consonants = lambda c: F.regexp_replace(F.lower(c), "[^a-z]|[aeiou]", "")
    n = load(spark, folder, "tags", "id", "tag", "status").where("status <> 'rejected'").select(F.col("id").alias("tag_id"), F.lower(F.trim("tag")).alias("k"), consonants("tag").alias("near"))
    e = load(spark, folder, "entity_names", "id", "name", "tag_id").select("id", F.col("tag_id").alias("linked"), F.lower(F.trim("name")).alias("k"), consonants("name").alias("near"))
    of = lambda rows, pri, why: rows.select("id", "tag_id", F.lit(pri).alias("pri"), F.lit(why).alias("why"))
    u = of(e.join(n, "k"), 1, "exact").unionByName(of(e.join(n, "near").where("near <> ''"), 2, "near spelling")).unionByName(of(e.where("linked is not null").withColumn("tag_id", F.col("linked")), 3, "linked"))
    return u.groupBy("id", "tag_id").agg(F.min_by("why", "pri").alias("why"))


@query("TXT56", """
WITH n AS (SELECT lower(trim(name)) AS k, count(*) AS rows, count(DISTINCT type) AS types, count(DISTINCT tag_id) AS tags, min(type) AS type FROM entity_names GROUP BY 1)
SELECT n.k, n.rows, CASE WHEN t.k IS NOT NULL THEN 'clash with a tag' WHEN types > 1 THEN 'several types' WHEN tags > 1 THEN 'several tags' ELSE 'new' END AS state FROM n LEFT JOIN (SELECT DISTINCT lower(trim(tag)) AS k FROM tags) t USING (k)""")
def new_tag_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Names as new tags: those that clash with a tag there is, whose rows disagree on type or tag, and those without conflict."""
    n = load(spark, folder, "entity_names", "name", "type", "tag_id").groupBy(F.lower(F.trim("name")).alias("k")).agg(F.count("*").alias("rows"), F.count_distinct("type").alias("types"), F.count_distinct("tag_id").alias("tags"))
    t = load(spark, folder, "tags", "tag").select(F.lower(F.trim("tag")).alias("k"), F.lit(True).alias("there")).distinct()
    state = F.when(F.col("there"), "clash with a tag").when(F.col("types") > 1, "several types").when(F.col("tags") > 1, "several tags").otherwise("new")
    return n.join(t, "k", "left").select("k", "rows", state.alias("state"))


@query("DEC02", """
WITH p AS (SELECT event_id, event_type, coalesce(CASE WHEN event_type = 'view' THEN value / 100.0 END, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100.0, value / 100.0) AS p, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS refers FROM events)
SELECT event_id, CASE event_type WHEN 'view' THEN p >= 0.4 WHEN 'purchase' THEN p >= 0.8 AND coalesce(refers >= 60, false) ELSE p >= 0.8 END AS kept FROM p""")
def kept_by_source(spark: SparkSession, folder: str) -> DataFrame:
    """Which items are kept by the limit of their source; one source needs a second answer too; the probability is the first that is there."""
    e = load(spark, folder, "events", "event_id", "event_type", "value", "props").withColumn("k", F.expr("try_cast(get_json_object(props, '$.k') as double)"))
    p = F.coalesce(F.when(F.col("event_type") == "view", F.col("value") / 100.0), F.col("k") / 100.0, F.col("value") / 100.0)
    kept = F.when(F.col("event_type") == "view", p >= 0.4).when(F.col("event_type") == "purchase", (p >= 0.8) & F.coalesce(F.col("k") >= 60, F.lit(False))).otherwise(p >= 0.8)
    return e.select("event_id", kept.alias("kept"))


@query("DEC13", """
WITH f AS (SELECT person_id, lok_sabha_term AS term, min(effective_from) AS first_day FROM speakers GROUP BY 1, 2), e AS (SELECT s.*, f.first_day FROM speakers s JOIN f ON f.person_id = s.person_id AND f.term = s.lok_sabha_term)
SELECT person_id, lok_sabha_term AS term, effective_from, arg_min(id, (source <> 'manual', source = 'event', id)) AS id, arg_min(coalesce(party_id, -1), (source <> 'manual', source = 'event', id)) AS party_id, effective_from = min(first_day) AS opens, count(*) AS rows FROM e GROUP BY 1, 2, 3""")
def loaded_versions(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of members' histories as they are loaded: one a day, entries by hand before lists and lists before events; the first of a term opens it."""
    s = load(spark, folder, "speakers", "id", "person_id", "lok_sabha_term", "effective_from", "source", "party_id").withColumnRenamed("lok_sabha_term", "term")
    order = F.struct(F.col("source") != "manual", F.col("source") == "event", F.col("id"))
    one = s.groupBy("person_id", "term", "effective_from").agg(F.min_by(F.struct("id", F.coalesce("party_id", F.lit(-1)).alias("party_id")), order).alias("b"), F.count("*").alias("rows"))
    first = s.groupBy("person_id", "term").agg(F.min("effective_from").alias("first_day"))
    return one.join(first, ["person_id", "term"]).select("person_id", "term", "effective_from", "b.id", "b.party_id", (F.col("effective_from") == F.col("first_day")).alias("opens"), "rows")


@query("TXT04", """
WITH t AS (SELECT DISTINCT ON (debate_id, seq) * FROM turns ORDER BY debate_id, seq, id), s AS (SELECT debate_id, person_id, left(string_agg(text, ' ' ORDER BY seq), 400000) AS body FROM t WHERE person_id IS NOT NULL AND role_kind IS NULL GROUP BY 1, 2)
SELECT s.debate_id, s.person_id, md5(body) AS body, CAST(length(body) AS INTEGER) AS chars, lower(d.title) AS head FROM s LEFT JOIN debates d ON d.id = s.debate_id""")
def search_index_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the search index: a member's own turns of a debate joined in order, cut at 400,000 characters as the index has them, and the title as head."""
    t = once_each(spark, folder, "person_id", "role_kind", "text").where("person_id is not null and role_kind is null and text is not null")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ")
    s = t.groupBy("debate_id", "person_id").agg(F.left(joined, F.lit(400_000)).alias("b"))
    d = load(spark, folder, "debates", "id", "title").withColumnRenamed("id", "debate_id")
    return s.join(d, "debate_id", "left").select("debate_id", "person_id", F.md5("b").alias("body"), F.length("b").alias("chars"), F.lower("title").alias("head"))
