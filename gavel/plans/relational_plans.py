"""Filters, joins, aggregates, windows, sorts and sets over the archive's and the trade tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gavel.operators import aggregates as agg
from gavel.operators import relational as rel
from gavel.operators import sequences as seq
from gavel.plans.registry import query
from gavel.sources.staging import stage
from gavel.sources.tables import load

KINDS = {"question": ["QUESTION", "STARRED QUESTION"], "bill": ["BILL"], "urgent": ["ZERO HOUR", "SPECIAL MENTION"]}
KIND_SQL = """CASE upper(regexp_replace(trim(debate_type), '\\s+', ' ', 'g'))
  WHEN 'QUESTION' THEN 'question' WHEN 'STARRED QUESTION' THEN 'question' WHEN 'BILL' THEN 'bill'
  WHEN 'ZERO HOUR' THEN 'urgent' WHEN 'SPECIAL MENTION' THEN 'urgent' ELSE 'other' END"""


@query("SRC01 FIL01 FIL05 FIL08 SRT01 SRT02 FIL14", """
SELECT o.o_orderkey, o.o_custkey, CAST(o.o_orderdate AS DATE) AS day, o.o_totalprice FROM orders o
WHERE o.o_orderdate >= DATE '1996-01-01' AND o.o_orderdate < DATE '1998-01-01' AND o.o_totalprice BETWEEN 50000 AND 400000
  AND o.o_orderpriority IN ('1-URGENT', '2-HIGH')
  AND EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_mktsegment = 'BUILDING')
ORDER BY o.o_totalprice DESC NULLS LAST, o.o_orderkey LIMIT 25 OFFSET 25""")
def speeches_filter_page(spark: SparkSession, folder: str) -> DataFrame:
    """The second page of a list under a map of named filters, one of them a semi join, with a unique order."""
    orders = load(spark, folder, "orders")
    conditions = {
        "from": F.col("o_orderdate") >= F.lit("1996-01-01").cast("date"), "to": F.col("o_orderdate") < F.lit("1998-01-01").cast("date"),
        "size": F.col("o_totalprice").between(50000, 400000), "kind": F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"),
    }
    building = load(spark, folder, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    page = orders.where(rel.conjunction(conditions)).join(building, "o_custkey", "left_semi")
    page = page.orderBy(F.col("o_totalprice").desc_nulls_last(), "o_orderkey").offset(25).limit(25)
    return page.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"), "o_totalprice")


@query("FIL02 FIL07 FIL09 FIL15", """
WITH t AS (SELECT id, domain, status, merged_into FROM tags)
SELECT 'known and not in' AS rule, count(*) AS n FROM t WHERE domain IS NOT NULL AND domain NOT IN ('labour', '-')
UNION ALL SELECT 'null or not in', count(*) FROM t WHERE domain IS NULL OR domain NOT IN ('labour', '-')
UNION ALL SELECT 'distinct from', count(*) FROM t WHERE domain IS DISTINCT FROM 'labour'
UNION ALL SELECT 'anti join', count(*) FROM t WHERE NOT EXISTS (SELECT 1 FROM subjects s WHERE s.parent_tag_id = t.id)
UNION ALL SELECT 'live', count(*) FROM t WHERE status NOT IN ('rejected', 'merged')""")
def negation_null_semantics(spark: SparkSession, folder: str) -> DataFrame:
    """The negative filters and what each does with nulls."""
    t = load(spark, folder, "tags", "id", "domain", "status")
    used = load(spark, folder, "subjects", "parent_tag_id").where("parent_tag_id is not null").select(F.col("parent_tag_id").alias("id"))
    rules = {
        "known and not in": t.where(rel.not_in_known(F.col("domain"), ["labour", "-"])),
        "null or not in": t.where(rel.not_in_or_null(F.col("domain"), ["labour", "-"])),
        "distinct from": t.where(~F.col("domain").eqNullSafe("labour")),
        "anti join": t.join(used, "id", "left_anti"),
        "live": t.where(~F.col("status").isin("rejected", "merged")),
    }
    out = None
    for name, rows in rules.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("FIL06", """
SELECT id, title FROM (SELECT id, title, lower(coalesce(title, '')) AS t FROM debates)
WHERE contains(t, 'need for') AND NOT contains(t, 'canal') OR contains(t, '50%_') ORDER BY id""")
def title_like_escape(spark: SparkSession, folder: str) -> DataFrame:
    """Titles that contain one text and not another; wild cards stand for themselves, null titles pass the negative."""
    d = load(spark, folder, "debates", "id", "title")
    t = F.col("title")
    return d.where(rel.contains_literal(t, "need for") & ~rel.contains_literal(t, "canal") | rel.contains_literal(t, "50%_"))


@query("FIL03 FIL11", """
SELECT id, loksabha, session FROM debates
WHERE (loksabha, session) IN ((14, 7), (15, 9), (16, 3)) AND (loksabha, session, dbslno) <= (15, 9, 100)""")
def pair_and_struct_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs as a filter, and rows compared as tuples."""
    d = load(spark, folder, "debates", "id", "loksabha", "session", "dbslno")
    low = F.struct("loksabha", "session", "dbslno") <= F.struct(F.lit(15).alias("loksabha"), F.lit(9).alias("session"), F.lit(100).alias("dbslno"))
    return d.where(rel.pair_in(F.col("loksabha"), F.col("session"), [(14, 7), (15, 9), (16, 3)]) & low).select("id", "loksabha", "session")


@query("FIL12", """
WITH f AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3'))
SELECT l_orderkey, count(*) = 3 AS has_all FROM f GROUP BY l_orderkey""")
def multi_tag_all_any(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with any of three brands, and whether they have all."""
    facts = load(spark, folder, "lineitem", "l_orderkey", "l_partkey").join(
        load(spark, folder, "part", "p_partkey", "p_brand").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey")
    wanted = ["Brand#1", "Brand#2", "Brand#3"]
    every = rel.having_all(facts, "l_orderkey", "p_brand", wanted).withColumn("has_all", F.lit(True))
    some = rel.having_any(facts, "l_orderkey", "p_brand", wanted)
    return some.join(every, "l_orderkey", "left").select("l_orderkey", F.coalesce("has_all", F.lit(False)).alias("has_all"))


@query("FIL04", f"SELECT {KIND_SQL} AS kind, count(*) AS n FROM debates GROUP BY 1")
def kind_other_bucket(spark: SparkSession, folder: str) -> DataFrame:
    """Debates by kind over the normalised type, everything unlisted and null as `other`."""
    return load(spark, folder, "debates", "debate_type").groupBy(rel.bucket_of(F.col("debate_type"), KINDS).alias("kind")).agg(F.count("*").alias("n"))


@query("FIL10 FIL13 AGG02", """
SELECT debate_id, count(*) AS turns, count(*) FILTER (WHERE role_kind IS NULL) AS by_members,
  count(*) FILTER (WHERE speaker_label IS NOT NULL AND NOT regexp_matches(speaker_label, '(?i)chair|speaker')) AS not_chair,
  count(*) FILTER (WHERE EXISTS (SELECT 1 FROM speech_search s WHERE s.speech_id = turns.speech_id)) AS searchable
FROM turns GROUP BY debate_id""")
def filtered_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts under conditions, one of them the existence of a row elsewhere (a flag from a left join)."""
    t = load(spark, folder, "turns", "debate_id", "role_kind", "speaker_label", "speech_id")
    s = load(spark, folder, "speech_search", "speech_id").distinct().withColumn("_there", F.lit(True))
    return t.join(s, "speech_id", "left").groupBy("debate_id").agg(
        F.count("*").alias("turns"), F.count_if(F.col("role_kind").isNull()).alias("by_members"),
        F.count_if(F.col("speaker_label").isNotNull() & ~F.col("speaker_label").rlike("(?i)chair|speaker")).alias("not_chair"),
        F.count_if(F.coalesce("_there", F.lit(False))).alias("searchable"))


@query("JOI01 JOI02 JOI15 JOI13", """
SELECT r.r_name, n.n_name, count(c.c_custkey) AS customers, round(coalesce(sum(c.c_acctbal), 0), 2) AS balance
FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey AND c.c_acctbal > 9900
GROUP BY r.r_name, n.n_name""")
def session_zero_groups(spark: SparkSession, folder: str) -> DataFrame:
    """A star of dimensions with counts of a filtered fact, groups without any kept with 0."""
    r, n = load(spark, folder, "region"), load(spark, folder, "nation")
    c = load(spark, folder, "customer").where("c_acctbal > 9900")
    star = r.join(n, r.r_regionkey == n.n_regionkey).join(c, c.c_nationkey == n.n_nationkey, "left")
    return star.groupBy("r_name", "n_name").agg(F.count("c_custkey").alias("customers"), F.round(F.coalesce(F.sum("c_acctbal"), F.lit(0.0)), 2).alias("balance"))


SEATS = "(SELECT DISTINCT ON (person_id, lok_sabha_term, effective_from) id, person_id, lok_sabha_term AS term, effective_from, party_id FROM speakers ORDER BY person_id, lok_sabha_term, effective_from, id)"


def _seats(spark: SparkSession, folder: str) -> DataFrame:
    s = load(spark, folder, "speakers", "id", "person_id", "lok_sabha_term", "effective_from", "party_id").withColumnRenamed("lok_sabha_term", "term")
    return rel.top_per_group(s, ["person_id", "term", "effective_from"], [F.col("id")])


def _spoken(spark: SparkSession, folder: str) -> DataFrame:
    d = load(spark, folder, "debates", "id", "loksabha", "debate_date").select(F.col("id").alias("debate_id"), F.col("loksabha").alias("term"), "debate_date")
    t = load(spark, folder, "turns", "id", "debate_id", "person_id").where("person_id is not null").withColumnRenamed("id", "turn_id")
    return t.join(d, "debate_id")


@query("JOI03", f"""
SELECT turn_id, CASE WHEN fits THEN party_id END AS party_id FROM (
  SELECT t.id AS turn_id, s.party_id, (d.debate_date IS NULL OR s.effective_from <= d.debate_date) AS fits,
    row_number() OVER (PARTITION BY t.id ORDER BY CASE WHEN d.debate_date IS NULL OR s.effective_from <= d.debate_date THEN s.effective_from END DESC NULLS LAST, s.id) AS n
  FROM turns t JOIN debates d ON d.id = t.debate_id LEFT JOIN {SEATS} s ON s.person_id = t.person_id AND s.term = d.loksabha
  WHERE t.person_id IS NOT NULL) WHERE n = 1""")
def asof_latest_or_last(spark: SparkSession, folder: str) -> DataFrame:
    """Each turn with its member's party as of the day, or the last one of the term where the debate has no day."""
    return rel.latest_or_last(_spoken(spark, folder), _seats(spark, folder), ["person_id", "term"], "debate_date", "effective_from", "turn_id", "id", ["party_id"]).select("turn_id", "party_id")


@query("JOI04 WIN01", f"""
WITH p AS (SELECT *, lead(effective_from) OVER (PARTITION BY person_id, term ORDER BY effective_from) AS until FROM {SEATS})
SELECT t.id AS turn_id, p.party_id, p.until FROM turns t JOIN debates d ON d.id = t.debate_id
JOIN p ON p.person_id = t.person_id AND p.term = d.loksabha AND p.effective_from <= d.debate_date AND (p.until IS NULL OR d.debate_date < p.until)""")
def interval_join_periods(spark: SparkSession, folder: str) -> DataFrame:
    """Each turn with the half-open period its day lies in; turns without a day or period drop out."""
    spans = rel.periods(_seats(spark, folder), ["person_id", "term"], "effective_from")
    return rel.interval_join(_spoken(spark, folder), spans, ["person_id", "term"], "debate_date", "effective_from", "until").select("turn_id", "party_id", "until")


@query("JOI05 AGG08 AGG05", """
SELECT DISTINCT ON (person_id) person_id, lok_sabha_term AS term, effective_from, id FROM speakers ORDER BY person_id, effective_from DESC, id""")
def latest_row(spark: SparkSession, folder: str) -> DataFrame:
    """The latest row of each member (one per group by an order that ends in a unique column)."""
    s = load(spark, folder, "speakers", "person_id", "lok_sabha_term", "effective_from", "id")
    return rel.top_per_group(s, ["person_id"], [F.desc("effective_from"), F.col("id")]).withColumnRenamed("lok_sabha_term", "term")


SPEECHES = """speeches AS (
  WITH t AS (SELECT DISTINCT ON (debate_id, seq) * FROM turns ORDER BY debate_id, seq, id),
  a AS (SELECT debate_id, seq, person_id, role_kind, coalesce(word_count, 0) AS words,
    (role_kind IS NULL AND person_id IS NULL AND coalesce(word_count, 0) > 25) AS alone FROM t),
  b AS (SELECT *, count(*) FILTER (WHERE alone) OVER (PARTITION BY debate_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS section FROM a),
  c AS (SELECT *, CASE WHEN role_kind IS NULL THEN person_id END AS p FROM b WHERE NOT alone),
  d AS (SELECT *, count(p) OVER (PARTITION BY debate_id, section ORDER BY seq ROWS UNBOUNDED PRECEDING) = 1 AND p IS NOT NULL AS first FROM c),
  e AS (SELECT *, last_value(CASE WHEN first OR words > 25 THEN p END IGNORE NULLS) OVER (PARTITION BY debate_id, section ORDER BY seq ROWS UNBOUNDED PRECEDING) AS owner FROM d),
  f AS (SELECT *, CASE WHEN owner IS NOT NULL AND owner IS DISTINCT FROM lag(owner) OVER (PARTITION BY debate_id, section ORDER BY seq) THEN 1 ELSE 0 END AS change FROM e),
  g AS (SELECT *, sum(change) OVER (PARTITION BY debate_id, section ORDER BY seq ROWS UNBOUNDED PRECEDING) AS speech, coalesce(p = owner, false) AS own FROM f),
  h AS (SELECT *, max(CASE WHEN own THEN seq END) OVER (PARTITION BY debate_id, section, speech) AS last_seq FROM g WHERE owner IS NOT NULL)
  SELECT debate_id, max(owner) AS person_id, min(CASE WHEN own THEN seq END) AS seq_start, max(last_seq) AS seq_end, count(*) FILTER (WHERE own) AS turn_count,
    count(*) FILTER (WHERE NOT own AND seq < last_seq) AS interruption_count, CAST(sum(CASE WHEN own THEN words END) AS BIGINT) AS word_count
  FROM h GROUP BY debate_id, section, speech
  UNION ALL SELECT debate_id, NULL, seq, seq, 1, 0, CAST(words AS BIGINT) FROM a WHERE alone)"""


def once_each(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Turns with each (debate, seq) once, the smallest id of those imported twice."""
    t = load(spark, folder, "turns", "id", "debate_id", "seq", *columns)
    return rel.top_per_group(t, ["debate_id", "seq"], [F.col("id")])


def speeches(spark: SparkSession, folder: str) -> DataFrame:
    return seq.stitch(once_each(spark, folder, "person_id", "role_kind", "word_count"))


@query("SEQ01 WIN11", f"WITH {SPEECHES} SELECT * FROM speeches")
def stitch_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Turns stitched into speeches across short interruptions."""
    return speeches(spark, folder)


@query("SEQ02", f"""
WITH {SPEECHES}, t AS (SELECT DISTINCT ON (debate_id, seq) * FROM turns ORDER BY debate_id, seq, id),
o AS (SELECT s.debate_id, s.seq_start, count(*) AS owned, CAST(sum(t.word_count) AS BIGINT) AS words FROM speeches s JOIN t ON t.debate_id = s.debate_id
  AND t.seq BETWEEN s.seq_start AND s.seq_end AND t.role_kind IS NULL AND t.person_id IS NOT DISTINCT FROM s.person_id GROUP BY 1, 2)
SELECT count(*) AS speeches, count(*) FILTER (WHERE o.owned <> s.turn_count) AS wrong_turns, count(*) FILTER (WHERE o.words <> s.word_count) AS wrong_words,
  count(*) FILTER (WHERE s.seq_start > s.seq_end) AS empty_spans FROM speeches s LEFT JOIN o USING (debate_id, seq_start)""")
def stitch_integrity(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the speeches' turn and word sums are those of the turns their owners have inside their spans."""
    s = speeches(spark, folder)
    t = once_each(spark, folder, "person_id", "role_kind", "word_count").where("role_kind is null")
    inside = rel.within_spans(t.select("debate_id", "seq", F.col("person_id").alias("p"), "word_count"), s.select("debate_id", "person_id", "seq_start", "seq_end"), "debate_id", "seq", "seq_start", "seq_end")
    owned = inside.where(F.col("p").eqNullSafe(F.col("person_id"))).groupBy("debate_id", "seq_start").agg(F.count("*").alias("owned"), F.sum("word_count").alias("words"))
    return s.join(owned, ["debate_id", "seq_start"], "left").agg(
        F.count("*").alias("speeches"), F.count_if(F.col("owned") != F.col("turn_count")).alias("wrong_turns"),
        F.count_if(F.col("words") != F.col("word_count")).alias("wrong_words"), F.count_if(F.col("seq_start") > F.col("seq_end")).alias("empty_spans"))


@query("JOI06 SEQ04", f"""
WITH {SPEECHES}, t AS (SELECT DISTINCT ON (debate_id, seq) * FROM turns ORDER BY debate_id, seq, id)
SELECT s.debate_id, s.seq_start, s.person_id AS speaker, t.person_id AS interrupter, count(*) AS n FROM speeches s JOIN t ON t.debate_id = s.debate_id AND t.seq BETWEEN s.seq_start AND s.seq_end
WHERE t.person_id IS NOT NULL AND s.person_id IS NOT NULL AND t.person_id <> s.person_id GROUP BY ALL""")
def interruption_range_join(spark: SparkSession, folder: str) -> DataFrame:
    """Turns inside another member's speech (a range join by buckets of positions)."""
    t = once_each(spark, folder, "person_id").where("person_id is not null").select("debate_id", "seq", F.col("person_id").alias("interrupter"))
    s = speeches(spark, folder).where("person_id is not null").select("debate_id", "seq_start", "seq_end", F.col("person_id").alias("speaker"))
    inside = rel.within_spans(t, s, "debate_id", "seq", "seq_start", "seq_end").where("speaker <> interrupter")
    return inside.groupBy("debate_id", "seq_start", "speaker", "interrupter").agg(F.count("*").alias("n"))


@query("SEQ04", f"""
WITH {SPEECHES}, t AS (SELECT DISTINCT ON (debate_id, seq) * FROM turns ORDER BY debate_id, seq, id)
SELECT t.debate_id, t.seq, CASE WHEN t.role_kind = 'presiding' THEN 'chair' WHEN s.seq_start IS NULL THEN 'between'
  WHEN t.role_kind IS NULL AND t.person_id IS NOT DISTINCT FROM s.person_id THEN 'speech' ELSE 'interruption' END AS part
FROM t LEFT JOIN speeches s ON s.debate_id = t.debate_id AND t.seq BETWEEN s.seq_start AND s.seq_end""")
def debate_turn_parts(spark: SparkSession, folder: str) -> DataFrame:
    """What each turn is in its debate: the chair's, a speech's, an interruption, or between speeches."""
    t = once_each(spark, folder, "person_id", "role_kind")
    inside = rel.within_spans(t.select("debate_id", "seq"), speeches(spark, folder).select("debate_id", "seq_start", "seq_end", F.col("person_id").alias("_owner")), "debate_id", "seq", "seq_start", "seq_end")
    all_ = t.join(inside, ["debate_id", "seq"], "left")
    part = F.when(F.col("role_kind") == "presiding", "chair").when(F.col("seq_start").isNull(), "between").when(F.col("role_kind").isNull() & F.col("person_id").eqNullSafe(F.col("_owner")), "speech").otherwise("interruption")
    return all_.select("debate_id", "seq", part.alias("part"))


@query("SEQ03", """
WITH t AS (SELECT DISTINCT ON (debate_id, seq) debate_id, seq, coalesce(word_count, 0) AS w FROM turns ORDER BY debate_id, seq, id),
c AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY debate_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, row_number() OVER (PARTITION BY debate_id ORDER BY seq) AS n FROM t)
SELECT debate_id, seq, CAST(b AS BIGINT) AS words_before FROM c WHERE (n <= 5 OR b < 200) AND (b < 400 OR n = 1)""")
def select_head_turns(spark: SparkSession, folder: str) -> DataFrame:
    """The head of each debate by turns and words (here 5 turns or 200 words, cut at 400)."""
    t = once_each(spark, folder, "word_count").withColumn("word_count", F.coalesce("word_count", F.lit(0)))
    return seq.head_of(t, "debate_id", "seq", "word_count", 5, 200, 400).select("debate_id", "seq", "words_before")


@query("SEQ05", """
WITH t AS (SELECT DISTINCT ON (debate_id, seq) debate_id, seq, text FROM turns ORDER BY debate_id, seq, id),
p AS (SELECT debate_id, seq, generate_subscripts(string_split(text, chr(10)), 1) AS part, unnest(string_split(text, chr(10))) AS text FROM t)
SELECT debate_id, row_number() OVER (PARTITION BY debate_id ORDER BY seq, part) - 1 AS new_seq, seq AS old_seq, md5(text) AS text_hash FROM p""")
def rewrite_sequence(spark: SparkSession, folder: str) -> DataFrame:
    """Turns split at line ends and their debates numbered again."""
    t = once_each(spark, folder, "text")
    parts = t.select("debate_id", "seq", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n")).where("n > 0")
    placed = seq.running_sum(parts, "debate_id", "seq", "n", "upto").select("debate_id", "seq", (F.col("upto") - F.col("n")).alias("first"))
    each = t.select("debate_id", "seq", F.posexplode(F.split("text", "\n")).alias("part", "text")).select("debate_id", "seq", "part", F.md5("text").alias("text_hash"))
    return each.join(placed, ["debate_id", "seq"]).select("debate_id", (F.col("first") + F.col("part")).alias("new_seq"), F.col("seq").alias("old_seq"), "text_hash")


@query("JOI16", """
WITH s AS (SELECT c_custkey AS a, s_suppkey AS b, -abs(round(c_acctbal, 0) - round(s_acctbal, 0)) AS score FROM customer JOIN supplier ON c_nationkey = s_nationkey),
m AS (SELECT *, max(score) OVER (PARTITION BY a) AS ma, max(score) OVER (PARTITION BY b) AS mb FROM s),
n AS (SELECT *, count(*) FILTER (WHERE score = ma) OVER (PARTITION BY a) AS na, count(*) FILTER (WHERE score = mb) OVER (PARTITION BY b) AS nb FROM m)
SELECT a, b, score FROM n WHERE score = ma AND score = mb AND na = 1 AND nb = 1""")
def mutual_best_match(spark: SparkSession, folder: str) -> DataFrame:
    """Customers and suppliers of a nation that are each other's only nearest by balance."""
    c = load(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("k"), F.round("c_acctbal", 0).alias("at"))
    s = load(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("k"), F.round("s_acctbal", 0).alias("at"))
    return rel.only_nearest(c, s, "k", "at").select("a", "b", (-F.col("gap")).alias("score"))


@query("JOI09 PAG17", """
WITH o AS (SELECT extract(year FROM o_orderdate) AS y, extract(quarter FROM o_orderdate) AS q, o_orderpriority AS p FROM orders),
last AS (SELECT max(y * 10 + q) AS k FROM o),
tot AS (SELECT count(*) AS n_year, count(*) FILTER (WHERE y * 10 + q = k) AS n_session FROM o, last WHERE y = k // 10)
SELECT p, count(*) AS in_year, count(*) FILTER (WHERE y * 10 + q = k) AS in_session,
  round((count(*) FILTER (WHERE y * 10 + q = k) / CAST(max(n_session) AS DOUBLE)) / (count(*) / CAST(max(n_year) AS DOUBLE)), 6) AS lift
FROM o, last, tot WHERE y = k // 10 GROUP BY p""")
def home_session_lift(spark: SparkSession, folder: str) -> DataFrame:
    """What is typical of the newest session: its share there against its share in the session's year."""
    o = load(spark, folder, "orders", "o_orderdate", "o_orderpriority").select(F.year("o_orderdate").alias("y"), (F.year("o_orderdate") * 10 + F.quarter("o_orderdate")).alias("k"), F.col("o_orderpriority").alias("p"))
    last = o.agg(F.max("k").alias("last"))
    of_year = o.join(F.broadcast(last), o.y == F.floor(last["last"] / 10))
    n = of_year.groupBy("p").agg(F.count("*").alias("in_year"), F.count_if(F.col("k") == F.col("last")).alias("in_session"))
    total = of_year.agg(F.count("*").alias("n_year"), F.count_if(F.col("k") == F.col("last")).alias("n_session"))
    lift = F.round((F.col("in_session") / F.col("n_session").cast("double")) / (F.col("in_year") / F.col("n_year").cast("double")), 6)
    return n.join(F.broadcast(total)).select("p", "in_year", "in_session", lift.alias("lift"))


@query("JOI11", """
SELECT coalesce(merged_into, id) AS tag_id, count(*) AS names, CAST(sum(debate_count) AS BIGINT) AS debates FROM tags GROUP BY 1""")
def resolve_through_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Tags rolled up to what they were merged into, one step."""
    t = load(spark, folder, "tags", "id", "merged_into", "debate_count")
    return t.groupBy(F.coalesce("merged_into", "id").alias("tag_id")).agg(F.count("*").alias("names"), F.sum("debate_count").alias("debates"))


@query("JOI12 AGG15", """
WITH z AS (SELECT speech_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM speech_search)
SELECT word, count(*) AS n, count(DISTINCT speech_id) AS speeches, CAST(min(pos) AS INTEGER) AS first_pos FROM z GROUP BY word HAVING count(*) >= 5""")
def unnest_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Arrays unnested with positions, counted per value."""
    s = load(spark, folder, "speech_search", "speech_id", "words").select("speech_id", F.posexplode("words").alias("pos", "word"))
    return s.groupBy("word").agg(F.count("*").alias("n"), F.count_distinct("speech_id").alias("speeches"), (F.min("pos") + 1).alias("first_pos")).where("n >= 5")


@query("AGG15", """
SELECT loksabha, count(*) AS debates, count(*) FILTER (WHERE len(keywords) > 0) AS with_keywords, round(count(*) FILTER (WHERE len(keywords) > 0) / CAST(count(*) AS DOUBLE), 6) AS coverage,
  round(avg(len(keywords)) FILTER (WHERE len(keywords) > 0), 6) AS mean_keywords FROM debates GROUP BY loksabha""")
def array_unnest_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """How many debates have keywords, and how many they have, per term."""
    d = load(spark, folder, "debates", "loksabha", "keywords").withColumn("k", F.coalesce(F.size("keywords"), F.lit(0)))
    has = F.col("k") > 0
    return d.groupBy("loksabha").agg(F.count("*").alias("debates"), F.count_if(has).alias("with_keywords"), agg.ratio(F.count_if(has), F.count("*")).alias("coverage"), F.round(F.avg(F.when(has, F.col("k"))), 6).alias("mean_keywords"))


@query("JOI14 WIN07 WIN12", f"""
WITH {SPEECHES} SELECT debate_id, seq_start, person_id, row_number() OVER (PARTITION BY debate_id ORDER BY seq_start) AS position, count(*) OVER (PARTITION BY debate_id) AS in_debate,
  rank() OVER (PARTITION BY debate_id ORDER BY word_count DESC) AS by_length FROM speeches""")
def position_in_debate(spark: SparkSession, folder: str) -> DataFrame:
    """Each speech's place in its debate, the debate's size, and its rank by length (running counts instead of subqueries)."""
    s = stage(speeches(spark, folder).select("debate_id", "seq_start", "person_id", "word_count", F.lit(1).cast("bigint").alias("one")), "speeches")
    lengths = s.groupBy("debate_id", "word_count").agg(F.count("*").alias("n")).withColumn("down", -F.col("word_count"))
    lengths = seq.running_sum(lengths, "debate_id", "down", "n", "upto").select("debate_id", "word_count", (F.col("upto") - F.col("n") + 1).alias("by_length"))
    total = s.groupBy("debate_id").agg(F.count("*").alias("in_debate"))
    placed = seq.running_sum(s, "debate_id", "seq_start", "one", "position")
    return placed.join(total, "debate_id").join(lengths, ["debate_id", "word_count"]).select("debate_id", "seq_start", "person_id", "position", "in_debate", "by_length")


@query("AGG01 AGG03 AGG12 PAG28", """
SELECT loksabha AS term, count(*) AS n, CAST(sum(word_count) AS BIGINT) AS words, min(word_count) AS least, max(word_count) AS most, round(avg(word_count), 6) AS mean, round(stddev(word_count), 6) AS sd,
  count(DISTINCT person_id) AS people, round(quantile_cont(word_count, 0.25), 6) AS p25, round(quantile_cont(word_count, 0.5), 6) AS p50, round(quantile_cont(word_count, 0.9), 6) AS p90, round(quantile_cont(word_count, 0.99), 6) AS p99
FROM turns JOIN debates d ON d.id = debate_id GROUP BY 1""")
def size_distribution(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of turns per term: counts, moments and exact percentiles."""
    t = load(spark, folder, "turns", "debate_id", "word_count", "person_id").join(load(spark, folder, "debates", "id", "loksabha").withColumnRenamed("id", "debate_id"), "debate_id")
    p = lambda q: F.round(F.percentile("word_count", q), 6)
    return t.groupBy(F.col("loksabha").alias("term")).agg(
        F.count("*").alias("n"), F.sum("word_count").alias("words"), F.min("word_count").alias("least"), F.max("word_count").alias("most"), F.round(F.avg("word_count"), 6).alias("mean"), F.round(F.stddev("word_count"), 6).alias("sd"),
        F.count_distinct("person_id").alias("people"), p(0.25).alias("p25"), p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.99).alias("p99"))


@query("AGG12 PAG28", """
SELECT CASE WHEN word_count < 10 THEN '0-9' WHEN word_count < 50 THEN '10-49' WHEN word_count < 100 THEN '50-99' ELSE '100+' END AS size,
  CASE WHEN word_count < 10 THEN 1 WHEN word_count < 50 THEN 2 WHEN word_count < 100 THEN 3 ELSE 4 END AS place, count(*) AS n FROM turns GROUP BY ALL""")
def size_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """A histogram by named size classes and their order."""
    w = F.col("word_count")
    size = F.when(w < 10, "0-9").when(w < 50, "10-49").when(w < 100, "50-99").otherwise("100+")
    place = F.when(w < 10, 1).when(w < 50, 2).when(w < 100, 3).otherwise(4)
    return load(spark, folder, "turns", "word_count").groupBy(size.alias("size"), place.alias("place")).agg(F.count("*").alias("n"))


@query("AGG13 WIN04 PAG28", """
WITH n AS (SELECT word_count AS w, ntile(100) OVER (ORDER BY word_count DESC, id) AS t FROM turns)
SELECT round(sum(w) FILTER (WHERE t <= 1) / CAST(sum(w) AS DOUBLE), 6) AS top1, round(sum(w) FILTER (WHERE t <= 5) / CAST(sum(w) AS DOUBLE), 6) AS top5,
  round(sum(w) FILTER (WHERE t <= 10) / CAST(sum(w) AS DOUBLE), 6) AS top10, round(sum(w) FILTER (WHERE t > 50) / CAST(sum(w) AS DOUBLE), 6) AS bottom50 FROM n""")
def lorenz_skew(spark: SparkSession, folder: str) -> DataFrame:
    """The share of words in the longest 1, 5, 10 % and shortest 50 % of turns.

    Which hundredth a turn is in follows from how many are longer. Counts per length, a short table, are accumulated;
    no window sees all turns. Turns of one length that straddle a border are split by number, as any order would.
    """
    t = load(spark, folder, "turns", "word_count")
    by = t.groupBy("word_count").agg(F.count("*").alias("n"))
    longer = F.coalesce(F.sum("n").over(Window.orderBy(F.desc_nulls_first("word_count")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by = by.withColumn("before", longer).join(F.broadcast(by.agg(F.sum("n").alias("rows"), F.sum(F.col("word_count") * F.col("n")).alias("all"))))
    # The first (rows mod 100) of the hundred tiles have one row more than the others.
    edge = lambda k: F.floor(F.col("rows") / 100) * k + F.least(F.lit(k), F.col("rows") % 100)
    inside = lambda k: F.sum(F.col("word_count") * F.least(F.col("n"), F.greatest(edge(k) - F.col("before"), F.lit(0))))
    share = lambda k: agg.ratio(inside(k), F.max("all"))
    return by.agg(share(1).alias("top1"), share(5).alias("top5"), share(10).alias("top10"), agg.ratio(F.max("all") - inside(50), F.max("all")).alias("bottom50"))


@query("AGG14 PAG28", """
WITH g AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS v FROM orders GROUP BY 1 ORDER BY v DESC, o_custkey LIMIT 50),
r AS (SELECT o.o_custkey, o.o_totalprice, row_number() OVER (PARTITION BY o.o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders o JOIN g USING (o_custkey))
SELECT o_custkey, round(sum(o_totalprice) FILTER (WHERE k <= 3) / sum(o_totalprice), 6) AS top3_share FROM r GROUP BY 1""")
def top_share_concentration(spark: SparkSession, folder: str) -> DataFrame:
    """How much of the largest groups their three largest members hold."""
    o = load(spark, folder, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    largest = o.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("v")).orderBy(F.desc("v"), "o_custkey").limit(50).select("o_custkey")
    rows = o.join(largest, "o_custkey", "left_semi").withColumn("k", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")))
    return rows.groupBy("o_custkey").agg(F.round(F.sum(F.when(F.col("k") <= 3, F.col("o_totalprice"))) / F.sum("o_totalprice"), 6).alias("top3_share"))


@query("AGG04 AGG20", """
WITH c AS (SELECT person_id, trim(name) AS name, count(*) AS n FROM speakers WHERE name IS NOT NULL GROUP BY 1, 2)
SELECT DISTINCT ON (person_id) person_id, name, n FROM c ORDER BY person_id, n DESC, name""")
def mode_dominant_spelling(spark: SparkSession, folder: str) -> DataFrame:
    """The most frequent spelling of each member's name, of equals the first."""
    s = load(spark, folder, "speakers", "person_id", "name").select("person_id", F.trim("name").alias("name"))
    return agg.dominant(s, ["person_id"], "name")


@query("AGG06 AGG07", """
SELECT person_id, list_sort(list(DISTINCT party_id) FILTER (WHERE party_id IS NOT NULL)) AS parties, string_agg(DISTINCT source, ', ' ORDER BY source) AS sources FROM speakers GROUP BY 1
HAVING count(party_id) > 0""")
def distinct_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct values as a sorted array and as a joined text."""
    s = load(spark, folder, "speakers", "person_id", "party_id", "source")
    return s.groupBy("person_id").agg(F.sort_array(F.collect_set("party_id")).alias("parties"), F.array_join(F.sort_array(F.collect_set("source")), ", ").alias("sources")).where(F.size("parties") > 0)


@query("AGG19 WIN10", """
WITH s AS (SELECT DISTINCT ON (person_id, lok_sabha_term, effective_from) person_id, effective_from, id, CAST(party_id AS VARCHAR) AS p FROM speakers WHERE party_id IS NOT NULL ORDER BY person_id, lok_sabha_term, effective_from, id),
c AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND p IS DISTINCT FROM lag(p) OVER w THEN 1 ELSE 0 END AS c FROM s WINDOW w AS (PARTITION BY person_id ORDER BY effective_from, id)),
r AS (SELECT *, sum(c) OVER (PARTITION BY person_id ORDER BY effective_from, id ROWS UNBOUNDED PRECEDING) AS run FROM c),
g AS (SELECT person_id, run, any_value(p) AS p, min(effective_from) AS f FROM r GROUP BY 1, 2)
SELECT person_id, string_agg(p, ' > ' ORDER BY run) AS path, count(*) AS stations FROM g GROUP BY 1""")
def party_path(spark: SparkSession, folder: str) -> DataFrame:
    """Consecutive equal parties collapsed to runs, and the runs as a path."""
    s = load(spark, folder, "speakers", "person_id", "lok_sabha_term", "effective_from", "id", "party_id").where("party_id is not null")
    s = rel.top_per_group(s, ["person_id", "lok_sabha_term", "effective_from"], [F.col("id")]).withColumn("p", F.col("party_id").cast("string"))
    r = seq.runs(s, ["person_id"], ["effective_from", "id"], "p")
    packed = F.array_sort(F.collect_list(F.struct("run", "p")))
    return r.groupBy("person_id").agg(F.array_join(F.transform(packed, lambda x: x["p"]), " > ").alias("path"), F.count("*").alias("stations"))


@query("AGG16 AGG17", """
WITH q AS (SELECT DISTINCT extract(year FROM o_orderdate) AS y FROM orders), c AS (SELECT extract(year FROM o_orderdate) AS y, o_custkey, count(*) AS n FROM orders GROUP BY 1, 2),
g AS (SELECT q.y, k.c_custkey, coalesce(c.n, 0) AS n FROM q CROSS JOIN customer k LEFT JOIN c ON c.y = q.y AND c.o_custkey = k.c_custkey)
SELECT CAST(y AS INTEGER) AS y, round(median(n), 6) AS median FROM g GROUP BY 1""")
def median_with_zeros(spark: SparkSession, folder: str) -> DataFrame:
    """The median number of orders per customer and year, customers without any counting 0, with no grid of zeros."""
    c = load(spark, folder, "orders", "o_orderdate", "o_custkey").groupBy(F.year("o_orderdate").alias("y"), "o_custkey").agg(F.count("*").alias("n"))
    population = c.select("y").distinct().join(F.broadcast(load(spark, folder, "customer", "c_custkey").agg(F.count("*").alias("size"))))
    return agg.median_with_zeros(c, ["y"], "n", population, "size")


@query("AGG10 AGG11 AGG22", """
SELECT CASE WHEN grouping(y) = 1 THEN 'all years' ELSE CAST(y AS VARCHAR) END AS year, CASE WHEN grouping(s) = 1 THEN 'all segments' ELSE s END AS segment, count(*) AS orders, count(DISTINCT k) AS customers
FROM (SELECT extract(year FROM o_orderdate) AS y, c_mktsegment AS s, c_custkey AS k FROM orders JOIN customer ON c_custkey = o_custkey) GROUP BY GROUPING SETS ((y, s), (y), (s), ())""")
def multi_grain_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts at four grains over one scan; distinct customers by a first step that removes repeats.

    The grains' distinct counts come from rows that are already distinct per (year, segment, customer), which is
    smaller than what expanding every row for several distinct counts would shuffle.
    """
    o = load(spark, folder, "orders", "o_orderdate", "o_custkey").withColumn("y", F.year("o_orderdate").cast("string"))
    c = load(spark, folder, "customer", "c_custkey", "c_mktsegment").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("s"))
    base = o.join(c, "o_custkey").groupBy("y", "s", "o_custkey").agg(F.count("*").alias("n"))
    sets = base.groupingSets([["y", "s"], ["y"], ["s"], []], "y", "s").agg(F.sum("n").alias("orders"), F.count_distinct("o_custkey").alias("customers"), F.grouping("y").alias("gy"), F.grouping("s").alias("gs"))
    return sets.select(F.when(F.col("gy") == 1, "all years").otherwise(F.col("y")).alias("year"), F.when(F.col("gs") == 1, "all segments").otherwise(F.col("s")).alias("segment"), "orders", "customers")


@query("AGG09 SRT03 WIN02", """
WITH c AS (SELECT c_nationkey AS nation, c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT nation, segment, n FROM (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY n DESC, segment) AS k FROM c) WHERE k <= 2""")
def top_k_per_group(spark: SparkSession, folder: str) -> DataFrame:
    """The two largest segments of each nation among those of three customers or more."""
    c = load(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n")).where("n >= 3")
    return rel.top_per_group(c, ["nation"], [F.desc("n"), F.col("segment")], 2)


@query("AGG18", """
SELECT debate_id, coalesce('code ' || mp_code, 'label ' || nullif(trim(speaker_label), ''), 'unattributed') AS who, count(*) AS interventions, CAST(sum(word_count) AS BIGINT) AS words, CAST(sum(char_count) AS BIGINT) AS chars FROM turns GROUP BY ALL""")
def speaker_distribution(spark: SparkSession, folder: str) -> DataFrame:
    """Interventions, words and characters of each speaker of a debate, keyed by code, else label."""
    t = load(spark, folder, "turns", "debate_id", "mp_code", "speaker_label", "word_count", "char_count")
    label = F.trim("speaker_label")
    who = F.coalesce(F.concat(F.lit("code "), F.col("mp_code")), F.concat(F.lit("label "), F.when(label != "", label)), F.lit("unattributed"))
    return t.groupBy("debate_id", who.alias("who")).agg(F.count("*").alias("interventions"), F.sum("word_count").alias("words"), F.sum("char_count").alias("chars"))


@query("WIN05 AGG08", """
SELECT c_custkey, c_nationkey, count(*) OVER (PARTITION BY c_nationkey) AS in_nation FROM (SELECT DISTINCT ON (c_nationkey, c_mktsegment) * FROM customer ORDER BY c_nationkey, c_mktsegment, c_acctbal DESC, c_custkey)""")
def group_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per pair of keys, with the size of its group beside it."""
    one = rel.top_per_group(load(spark, folder, "customer"), ["c_nationkey", "c_mktsegment"], [F.desc("c_acctbal"), F.col("c_custkey")])
    return one.select("c_custkey", "c_nationkey", F.count("*").over(Window.partitionBy("c_nationkey")).alias("in_nation"))


@query("WIN06 TXT05", """
WITH t AS (SELECT doc_id, source, md5(text) AS h FROM documents WHERE n_chars >= 20)
SELECT doc_id, min(doc_id) OVER (PARTITION BY source, h) AS first_id FROM t QUALIFY first_id < doc_id""")
def duplicate_pointer(spark: SparkSession, folder: str) -> DataFrame:
    """Letter-for-letter repeats inside a source, with the first; groups are aggregated, so a large one stays small."""
    t = load(spark, folder, "documents", "doc_id", "source", "text", "n_chars").where("n_chars >= 20").select("doc_id", "source", F.md5("text").alias("h"))
    first = t.groupBy("source", "h").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return t.join(first, (t.h == first.h) & t.source.eqNullSafe(first.source)).where("first_id < doc_id").select("doc_id", "first_id")


@query("WIN09 TXT48", """
WITH d AS (SELECT loksabha, debate_date AS day, count(*) AS n FROM debates WHERE debate_date IS NOT NULL GROUP BY 1, 2),
b AS (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY loksabha ORDER BY day) > 35 THEN 1 ELSE 0 END AS new FROM d),
k AS (SELECT *, sum(new) OVER (PARTITION BY loksabha ORDER BY day ROWS UNBOUNDED PRECEDING) AS block FROM b)
SELECT loksabha, CAST(block AS INTEGER) AS block, min(day) AS first_day, max(day) AS last_day, count(*) AS days, CAST(sum(n) AS BIGINT) AS debates,
  CASE WHEN month(min(day)) <= 4 THEN 'Budget' WHEN month(min(day)) <= 9 THEN 'Monsoon' ELSE 'Winter' END || ' session, ' || year(min(day)) AS name FROM k GROUP BY 1, 2""")
def sitting_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of sitting days at most 35 days apart, and their names by season."""
    d = load(spark, folder, "debates", "loksabha", "debate_date").where("debate_date is not null").groupBy("loksabha", F.col("debate_date").alias("day")).agg(F.count("*").alias("n"))
    b = seq.islands(d, ["loksabha"], "day", 35).groupBy("loksabha", "block").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days"), F.sum("n").alias("debates"))
    season = F.when(F.month("first_day") <= 4, "Budget").when(F.month("first_day") <= 9, "Monsoon").otherwise("Winter")
    return b.withColumn("name", F.concat(season, F.lit(" session, "), F.year("first_day").cast("string")))


@query("WIN03 SRT04", """
SELECT id, tag_id, place FROM (SELECT e.id, t.tag_id, row_number() OVER (PARTITION BY e.id ORDER BY abs(e.n_speeches - t.dc), t.tag_id) AS place
  FROM (SELECT id, n_speeches FROM entity_names WHERE id % 50 = 0) e, (SELECT id AS tag_id, debate_count AS dc FROM tags WHERE status = 'reviewed') t) WHERE place <= 3""")
def nearest_by_expression(spark: SparkSession, folder: str) -> DataFrame:
    """The three reviewed tags nearest by size to every fiftieth entity (a stated set of queries against all rows)."""
    e = load(spark, folder, "entity_names", "id", "n_speeches").where("id % 50 = 0")
    t = load(spark, folder, "tags", "id", "debate_count", "status").where("status = 'reviewed'").select(F.col("id").alias("tag_id"), F.col("debate_count").alias("dc"))
    near = e.join(t).withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.abs(F.col("n_speeches") - F.col("dc")), "tag_id")).cast("bigint"))
    return near.where("place <= 3").select("id", "tag_id", "place")


@query("SRT06", """
SELECT a.debate_id, a.seq AS at, b.seq AS neighbour FROM (SELECT DISTINCT debate_id, seq, role_kind FROM turns) a JOIN (SELECT DISTINCT debate_id, seq FROM turns) b USING (debate_id)
WHERE a.role_kind = 'crowd' AND b.seq <> a.seq QUALIFY row_number() OVER (PARTITION BY a.debate_id, a.seq, b.seq > a.seq ORDER BY abs(b.seq - a.seq)) <= 2""")
def neighbours_per_side(spark: SparkSession, folder: str) -> DataFrame:
    """The two turns before and after each turn of the crowd: turns are numbered, and the numbers beside it looked up."""
    t = load(spark, folder, "turns", "debate_id", "seq", "role_kind").groupBy("debate_id", "seq").agg(F.max(F.col("role_kind") == "crowd").alias("crowd"), F.lit(1).alias("one"))
    t = seq.running_sum(t, "debate_id", "seq", "one", "number")
    beside = t.where("crowd").select("debate_id", F.col("seq").alias("at"), F.explode(F.array(*(F.col("number") + k for k in (-2, -1, 1, 2)))).alias("number"))
    return beside.join(t.select("debate_id", "number", F.col("seq").alias("neighbour")), ["debate_id", "number"]).select("debate_id", "at", "neighbour")


@query("SET01 SET02 TXT51", """
WITH t AS (SELECT DISTINCT debate_id, person_id AS p FROM turns WHERE person_id IS NOT NULL),
l AS (SELECT DISTINCT id AS debate_id, CAST(m.mpCode AS INTEGER) - 4000 AS p FROM (SELECT id, unnest(from_json(mp_list_raw, '[{"mpCode":"INTEGER"}]')) AS m FROM debates))
SELECT debate_id, p, CASE WHEN t.p IS NULL THEN 'right' WHEN l.p IS NULL THEN 'left' ELSE 'both' END AS side FROM t FULL JOIN l USING (debate_id, p)""")
def mp_diff_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Members who speak against members who are listed: both, only speaking, only listed."""
    t = load(spark, folder, "turns", "debate_id", "person_id").where("person_id is not null").select("debate_id", F.col("person_id").alias("p"))
    listed = F.from_json("mp_list_raw", "array<struct<mpCode:int>>")
    l = load(spark, folder, "debates", "id", "mp_list_raw").select(F.col("id").alias("debate_id"), F.explode(listed).alias("m")).select("debate_id", (F.col("m.mpCode") - 4000).alias("p"))
    return rel.set_difference(t, l, ["debate_id", "p"])


@query("WIN08", """
WITH m AS (SELECT c_mktsegment AS s, extract(year FROM o_orderdate) * 12 + extract(month FROM o_orderdate) AS m, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)
SELECT s, CAST(m AS INTEGER) AS m, n, CAST(sum(n) OVER (PARTITION BY s ORDER BY m RANGE BETWEEN 11 PRECEDING AND CURRENT ROW) AS BIGINT) AS window_sum FROM m""")
def sliding_twelve_months(spark: SparkSession, folder: str) -> DataFrame:
    """Sums over the twelve calendar months up to each, absent months counting 0."""
    o = load(spark, folder, "orders", "o_orderdate", "o_custkey").join(load(spark, folder, "customer", "c_custkey", "c_mktsegment").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    m = o.groupBy(F.col("c_mktsegment").alias("s"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("m")).agg(F.count("*").alias("n"))
    return seq.sliding_months(m, ["s"], "m", "n")
