"""Pages split into turns, sentences and quotes, transliteration, and the streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gavel.functions import glyphs, pages
from gavel.operators import arrow
from gavel.operators import relational as rel
from gavel.plans.registry import query
from gavel.sources.tables import load
from gavel.streaming import sessions


@query("TXT27 TXT28 PAG27 FIL13", """
WITH p AS (SELECT id, generate_subscripts(string_split(raw_html, '<p>'), 1) AS k, unnest(string_split(raw_html, '<p>')) AS part FROM debates)
SELECT id, k, regexp_extract(part, '<A name="(\\d+)\\*\\d+">', 1) AS code, trim(regexp_extract(part, '<b>([^<]*?)\\s*:?</b>', 1)) AS label, NOT contains(raw.raw_html, '*') AS old FROM p JOIN (SELECT id AS i, raw_html FROM debates) raw ON raw.i = p.id WHERE contains(part, '<b>')""")
def html_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The labelled paragraphs of each page with their anchors' codes, inside the JVM, and whether the page is of the older form."""
    d = load(spark, folder, "debates", "id", "raw_html").select("id", (~F.contains("raw_html", F.lit("*"))).alias("old"), F.posexplode(F.split("raw_html", "<p>")).alias("k", "part")).where(F.contains("part", F.lit("<b>")))
    return d.select("id", (F.col("k") + 1).cast("bigint").alias("k"), F.regexp_extract("part", '<A name="(\\d+)\\*\\d+">', 1).alias("code"), F.trim(F.regexp_extract("part", "<b>([^<]*?)\\s*:?</b>", 1)).alias("label"), "old")


@query("TXT26 TXT27 TXT28")
def html_clean_split(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as its turns with references resolved: number, code, label and text."""
    d = load(spark, folder, "debates", "id", "raw_html")
    return arrow.rows_of_text(d, "id", "raw_html", pages.turns, {"seq": "int", "mp_code": "string", "label": "string", "text": "string"})


@query("TXT30")
def translit_fold(spark: SparkSession, folder: str) -> DataFrame:
    """A spelling key of every label, across scripts."""
    t = load(spark, folder, "turns", "id", "speaker_label")
    labels = t.where("speaker_label is not null").select("speaker_label", F.col("speaker_label").alias("t")).distinct()
    return t.join(arrow.each_text(labels, "speaker_label", "t", pages.folded, "folded"), "speaker_label", "left").select("id", "folded")


SENTENCE = "[^.?!।\\n]+[.?!।]"


@query("TXT23 TXT25", """
WITH s AS (SELECT doc_id, generate_subscripts(l, 1) AS k, trim(unnest(l)) AS s, title FROM (SELECT doc_id, title, regexp_extract_all(text, '[^.?!।\\n]+[.?!।]') AS l FROM documents)),
g AS (SELECT doc_id, k, s, len(regexp_extract_all(s, '\\S+')) AS w, CASE WHEN contains(lower(s), split_part(lower(coalesce(title, '~')), ' ', 1)) THEN 1 ELSE 0 END AS hit FROM s WHERE regexp_matches(s, '^[A-Z][^0-9()\\[\\]{}]*\\.$'))
SELECT doc_id, CAST(k AS BIGINT) AS k, s AS quote, w AS words FROM g WHERE w BETWEEN 8 AND 40 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY hit DESC, CASE WHEN w BETWEEN 15 AND 28 THEN 0 ELSE 1 END, abs(w - 24), k) = 1""")
def sentence_quote_pick(spark: SparkSession, folder: str) -> DataFrame:
    """The best sentence of each document to quote: eligible by form, near 24 words, with a word of the title."""
    d = load(spark, folder, "documents", "doc_id", "text", "title").select("doc_id", "title", F.posexplode(F.regexp_extract_all("text", F.lit(SENTENCE), 0)).alias("k", "s")).withColumn("s", F.trim("s"))
    d = d.where(F.col("s").rlike("^[A-Z][^0-9()\\[\\]{}]*\\.$")).withColumn("words", F.size(F.regexp_extract_all("s", F.lit("\\S+"), 0)).cast("bigint")).where("words between 8 and 40")
    hit = F.contains(F.lower("s"), F.split_part(F.lower(F.coalesce("title", F.lit("~"))), F.lit(" "), F.lit(1))).cast("int")
    best = rel.top_per_group(d.withColumn("_h", hit), ["doc_id"], [F.desc("_h"), F.when(F.col("words").between(15, 28), 0).otherwise(1), F.abs(F.col("words") - 24), F.col("k")])
    return best.select("doc_id", (F.col("k") + 1).cast("bigint").alias("k"), F.col("s").alias("quote"), "words")


@query("WIN09", """
WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n, round(sum(value), 2) AS value FROM b GROUP BY user_id, k""")
def user_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of each user's events, by the batch form of the streaming operator."""
    e = load(spark, folder, "events", "user_id", "ts", "value")
    s = e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))
    return s.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n", "value")


@query("WIN09", """
WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n, round(sum(value), 2) AS value FROM b GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOUR <= date_trunc('millisecond', (SELECT max(ts) FROM events)) - INTERVAL 1 DAY""")
def stream_user_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """The same blocks from the events as a stream, those that the watermark has closed."""
    s = sessions.run_to_table(sessions.user_sessions(sessions.read_events(spark, folder)), "sessions")
    return s.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query("AGG01", """
SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING date_trunc('hour', min(ts)) + INTERVAL 1 HOUR <= date_trunc('millisecond', (SELECT max(ts) FROM events)) - INTERVAL 2 HOUR""")
def stream_windowed_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly counts by kind from the events as a stream, for windows that the watermark has closed."""
    return sessions.run_to_table(sessions.windowed_counts(sessions.read_events(spark, folder)), "windows").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SRC08", "SELECT DISTINCT ON (event_id) event_id, ts, user_id, event_type, value, props FROM events ORDER BY event_id")
def stream_first_seen(spark: SparkSession, folder: str) -> DataFrame:
    """Each event once from a stream that may repeat them."""
    return sessions.run_to_table(sessions.first_seen(sessions.read_events(spark, folder), ["event_id"]), "first").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("SRC17", """
SELECT '/tag/' || trim(regexp_replace(lower(tag), '[^a-z0-9]+', '-', 'g'), '-') AS path, min(id) AS id FROM tags WHERE status = 'reviewed' GROUP BY 1""")
def sitemap_paths(spark: SparkSession, folder: str) -> DataFrame:
    """The path of every live tag once, the smallest id of those that share one."""
    t = load(spark, folder, "tags", "id", "tag", "status").where("status = 'reviewed'")
    slug = F.regexp_replace(F.regexp_replace(F.lower("tag"), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return t.groupBy(F.concat(F.lit("/tag/"), slug).alias("path")).agg(F.min("id").alias("id"))


@query("SRC02", """
SELECT loksabha, session, dbslno, min(id) AS first_id, count(*) AS fetched, max(fetched_at) AS last_fetch, sha256(arg_max(raw_html, (fetched_at, id))) = arg_max(raw_html_sha256, (fetched_at, id)) AS hash_fits FROM debates GROUP BY 1, 2, 3""")
def refetched_debates(spark: SparkSession, folder: str) -> DataFrame:
    """Debates by natural key: how often fetched, and whether the latest page has the stored hash."""
    d = load(spark, folder, "debates", "id", "loksabha", "session", "dbslno", "fetched_at", "raw_html", "raw_html_sha256")
    d = d.withColumn("fits", F.sha2("raw_html", 256) == F.col("raw_html_sha256"))
    return d.groupBy("loksabha", "session", "dbslno").agg(F.min("id").alias("first_id"), F.count("*").alias("fetched"), F.max("fetched_at").alias("last_fetch"), F.max_by("fits", F.struct("fetched_at", "id")).alias("hash_fits"))


@query("TXT29", "SELECT id, md5(text) AS decoded FROM turns")
def glyph_decode(spark: SparkSession, folder: str) -> DataFrame:
    """Turns typed in the old Hindi font, read back; the others unchanged (as a digest). The SQL holds for tables without such turns."""
    out = arrow.each_text(load(spark, folder, "turns", "id", "text"), "id", "text", glyphs.read_glyphs, "decoded")
    return out.select("id", F.md5("decoded").alias("decoded"))
