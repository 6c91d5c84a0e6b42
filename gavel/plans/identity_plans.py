"""Who a label names: reading, agreement, option lists, tiers, passes, fallbacks and deciders."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gavel.functions import spans
from gavel.plans.registry import query
from gavel.sources.staging import stage
from gavel.sources.tables import load

#: Titles before names (fixed values), as a pattern that both engines read.
TITLE = "\\b(shri|shrimati|smt|sushri|dr|prof|adv|hon|mr|mrs|ms|kumari)\\b\\.?"
BARE_SQL = f"trim(regexp_replace(regexp_replace(regexp_replace(lower({{0}}), '\\([^()]*\\)|\\[[^\\[\\]]*\\]', ' ', 'g'), '{TITLE}|contd\\.*|[:_\\[\\]().,-]', ' ', 'g'), '[\\s\\p{{{{Z}}}}]+', ' ', 'g'))".replace("{{{{", "{{").replace("}}}}", "}}")
B_ = lambda c: BARE_SQL.format(c)


def bare(c: Column) -> Column:
    """A label's or name's words in lower case: no brackets with what is in them, titles, marks of continuation or punctuation."""
    t = F.regexp_replace(F.lower(c), "\\([^()]*\\)|\\[[^\\[\\]]*\\]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, f"{TITLE}|contd\\.*|[:_\\[\\]().,-]", " "), "[\\s\\p{Z}]+", " "))


#: Spelling key: long vowels and their doublets are one letter, w is v, no h after a consonant.
FOLD = [("aa", "a"), ("ee", "i"), ("oo", "u"), ("w", "v"), ("ph", "f"), ("bh", "b"), ("dh", "d"), ("gh", "g"), ("kh", "k"), ("th", "t"), ("sh", "s"), (" ", "")]
F_ = lambda c: "".join("replace(" for _ in FOLD) + c + "".join(f", '{a}', '{b}')" for a, b in FOLD)


def fold(c: Column) -> Column:
    for a, b in FOLD:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


LABELS = "l AS (SELECT DISTINCT d.loksabha AS term, t.speaker_label AS label FROM turns t JOIN debates d ON d.id = t.debate_id WHERE t.role_kind IS NULL AND regexp_matches(t.speaker_label, '\\p{L}'))"
ROSTER = "r AS (SELECT DISTINCT person_id, lok_sabha_term AS term, name, upper(trim(regexp_replace(constituency, '\\s*\\(.*\\)\\s*$', ''))) AS seat FROM speakers WHERE name IS NOT NULL)"


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct labels of each term that aren't of a role."""
    t = load(spark, folder, "turns", "debate_id", "speaker_label", "role_kind").where(F.col("role_kind").isNull() & F.col("speaker_label").rlike("\\p{L}"))
    d = load(spark, folder, "debates", "id", "loksabha").select(F.col("id").alias("debate_id"), F.col("loksabha").alias("term"))
    return t.join(d, "debate_id").select("term", F.col("speaker_label").alias("label")).distinct()


def _roster(spark: SparkSession, folder: str) -> DataFrame:
    """Members of each term by name and seat."""
    s = load(spark, folder, "speakers", "person_id", "lok_sabha_term", "name", "constituency").where("name is not null")
    return s.select("person_id", F.col("lok_sabha_term").alias("term"), "name", F.upper(F.trim(F.regexp_replace("constituency", "\\s*\\(.*\\)\\s*$", ""))).alias("seat")).distinct()


@query("TXT31", f"""
SELECT person_id, {B_('name')} AS bare, {F_(B_('name'))} AS folded, array_to_string(list_transform(string_split({B_('name')}, ' '), lambda w: left(w, 1)), '') AS initials FROM speakers WHERE name IS NOT NULL GROUP BY ALL""")
def normal_names(spark: SparkSession, folder: str) -> DataFrame:
    """Members' names without titles, their spelling keys and initials."""
    s = load(spark, folder, "speakers", "person_id", "name").where("name is not null")
    return s.select("person_id", bare(F.col("name")).alias("bare"), fold(bare(F.col("name"))).alias("folded"), F.array_join(F.transform(F.split(bare(F.col("name")), " "), lambda w: F.substring(w, 1, 1)), "").alias("initials")).distinct()


@query("TXT38", f"""
WITH k AS (SELECT DISTINCT speaker_label AS label, regexp_extract(regexp_replace(speaker_label, '\\(([^()]*)\\(([^()]*)\\)([^()]*)\\)', '(\\1 \\2 \\3)'), '\\(([^()]*)\\)', 1) AS inside, {B_('speaker_label')} AS b FROM turns WHERE speaker_label IS NOT NULL)
SELECT label, CASE WHEN NOT regexp_matches(label, '\\p{{L}}') THEN 'not_a_name' WHEN regexp_matches(label, '(?i)minister|secretary|chair|speaker|सभापति|अध्यक्ष') THEN 'office' WHEN regexp_matches(label, '(?i)members?\\b|सदस्य') THEN 'not_a_name' WHEN b = '' THEN 'title_only' ELSE 'name' END AS kind, trim(inside) AS inside FROM k""")
def label_reading(spark: SparkSession, folder: str) -> DataFrame:
    """What each label reads as: a name, an office, a title only, or no name; and what its brackets hold, nested ones with their own."""
    l = load(spark, folder, "turns", "speaker_label").where("speaker_label is not null").select(F.col("speaker_label").alias("label")).distinct()
    inside = F.regexp_extract(F.regexp_replace("label", "\\(([^()]*)\\(([^()]*)\\)([^()]*)\\)", "($1 $2 $3)"), "\\(([^()]*)\\)", 1)
    kind = (
        F.when(~F.col("label").rlike("\\p{L}"), "not_a_name").when(F.col("label").rlike("(?i)minister|secretary|chair|speaker|सभापति|अध्यक्ष"), "office")
        .when(F.col("label").rlike("(?i)members?\\b|सदस्य"), "not_a_name").when(bare(F.col("label")) == "", "title_only").otherwise("name"))
    return l.select("label", kind.alias("kind"), F.trim(inside).alias("inside"))


@query("TXT32", f"""
WITH {LABELS}, {ROSTER}, p AS (SELECT DISTINCT term, label, person_id, string_split({B_('label')}, ' ') AS x, string_split({B_('name')}, ' ') AS y FROM l JOIN r USING (term) WHERE list_last(string_split({B_('label')}, ' ')) = list_last(string_split({B_('name')}, ' ')) AND {B_('label')} <> ''),
f AS (SELECT *, len(list_filter(x, lambda w: len(list_filter(y, lambda v: 1 - levenshtein(w, v) / CAST(greatest(length(w), length(v)) AS DOUBLE) >= 0.8 OR (length(w) = 1 AND left(v, 1) = w))) > 0)) AS found FROM p)
SELECT term, label, person_id, max(CASE WHEN found = len(x) AND len(x) > 1 THEN 1 WHEN found >= 0.6 * len(x) THEN 0 ELSE -1 END) AS agrees FROM f GROUP BY 1, 2, 3""")
def name_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a label and a member of the same surname agree: 1 (every word is found, near or as an initial), 0 (most are), -1 (they don't)."""
    words = lambda c: F.split(bare(F.col(c)), " ")
    last = lambda c: F.element_at(words(c), -1)
    l = _labels(spark, folder).where(bare(F.col("label")) != "").select("term", "label", words("label").alias("x"), last("label").alias("_s"))
    r = _roster(spark, folder).select("term", "person_id", words("name").alias("y"), last("name").alias("_s")).distinct()
    near = lambda w, v: (1 - F.levenshtein(w, v) / F.greatest(F.length(w), F.length(v)).cast("double") >= 0.8) | ((F.length(w) == 1) & (F.substring(v, 1, 1) == w))
    p = l.join(r, ["term", "_s"]).withColumn("found", F.size(F.filter("x", lambda w: F.exists("y", lambda v: near(w, v)))))
    agrees = F.when((F.col("found") == F.size("x")) & (F.size("x") > 1), 1).when(F.col("found") >= 0.6 * F.size("x"), 0).otherwise(-1)
    return p.groupBy("term", "label", "person_id").agg(F.max(agrees).alias("agrees"))


TIERS = ["exact", "joined", "sorted", "folded", "subset", "surname"]
KEYS = {
    "exact": "{0}", "joined": "replace({0}, ' ', '')", "sorted": "array_to_string(list_sort(string_split({0}, ' ')), ' ')", "folded": F_("{0}"), "surname": "list_last(string_split({0}, ' '))",
}


def _tier_sql() -> str:
    unique = ", ".join(f"u_{n} AS (SELECT {k.format('b')} AS k, min(person_id) AS p FROM q GROUP BY 1 HAVING count(DISTINCT person_id) = 1)" for n, k in KEYS.items())
    joins = " ".join(f"LEFT JOIN u_{n} ON u_{n}.k = {k.format('n.b')}" for n, k in KEYS.items())
    order = [(f"u_{t}.p" if t in KEYS else "s.p", t) for t in TIERS]
    return f"""WITH q AS (SELECT DISTINCT person_id, {B_('name')} AS b FROM speakers WHERE name IS NOT NULL), n AS (SELECT DISTINCT speaker_label AS label, {B_('speaker_label')} AS b FROM turns WHERE role_kind IS NULL AND regexp_matches(speaker_label, '\\p{{L}}')),
{unique}, w AS (SELECT DISTINCT person_id, b, unnest(string_split(b, ' ')) AS w FROM q), lw AS (SELECT DISTINCT label, unnest(list_distinct(string_split(b, ' '))) AS w, len(list_distinct(string_split(b, ' '))) AS k FROM n WHERE b <> ''),
h AS (SELECT label, person_id FROM (SELECT label, person_id, b, max(k) AS k, count(DISTINCT w) AS c FROM lw JOIN w USING (w) GROUP BY 1, 2, 3) WHERE c = k GROUP BY 1, 2), s AS (SELECT label, min(person_id) AS p FROM h GROUP BY 1 HAVING count(*) = 1)
SELECT n.label, coalesce({', '.join(c for c, _ in order)}) AS person_id, CASE {' '.join(f"WHEN {c} IS NOT NULL THEN '{t}'" for c, t in order)} ELSE 'none' END AS tier FROM n {joins} LEFT JOIN s ON s.label = n.label"""


@query("TXT33", _tier_sql())
def six_tiers(spark: SparkSession, folder: str) -> DataFrame:
    """Labels resolved in six tiers: as it is, joined, words in any order, spelling key, all its words in one person's name, surname.

    A key that several persons share never resolves.
    """
    q = load(spark, folder, "speakers", "person_id", "name").where("name is not null").select("person_id", bare(F.col("name")).alias("b")).distinct()
    n = load(spark, folder, "turns", "speaker_label", "role_kind").where(F.col("role_kind").isNull() & F.col("speaker_label").rlike("\\p{L}")).select(F.col("speaker_label").alias("label")).distinct().withColumn("b", bare(F.col("label")))
    words = lambda c: F.split(c, " ")
    keys = {"exact": lambda c: c, "joined": lambda c: F.replace(c, F.lit(" "), F.lit("")), "sorted": lambda c: F.array_join(F.sort_array(words(c)), " "), "folded": fold, "surname": lambda c: F.element_at(words(c), -1)}
    out = n
    for name, key in keys.items():
        one = q.select(key(F.col("b")).alias(f"k_{name}"), "person_id").distinct().groupBy(f"k_{name}").agg(F.min("person_id").alias(name), F.count("*").alias("_n")).where("_n = 1").drop("_n")
        out = out.withColumn(f"k_{name}", key(F.col("b"))).join(one, f"k_{name}", "left").drop(f"k_{name}")
    of = q.select("person_id", "b", F.explode(F.array_distinct(words(F.col("b")))).alias("w"))
    asked = n.where("b <> ''").select("label", F.array_distinct(words(F.col("b"))).alias("ws")).select("label", F.size("ws").alias("k"), F.explode("ws").alias("w"))
    held = asked.join(of, "w").groupBy("label", "person_id", "b").agg(F.max("k").alias("k"), F.count("*").alias("c")).where("c = k").select("label", "person_id").distinct()
    subset = held.groupBy("label").agg(F.min("person_id").alias("subset"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    out = out.join(subset, "label", "left")
    tier = F.lit("none")
    for name in reversed(TIERS):
        tier = F.when(F.col(name).isNotNull(), name).otherwise(tier)
    return out.select("label", F.coalesce(*TIERS).alias("person_id"), tier.alias("tier"))


@query("TXT36", """
WITH v AS (SELECT mp_code, person_id, count(*) AS n FROM turns WHERE mp_code IS NOT NULL AND name_source = 'anchor' AND person_id IS NOT NULL GROUP BY 1, 2), code AS (SELECT mp_code, arg_max(person_id, (n, -person_id)) AS p FROM v GROUP BY 1 HAVING 2 * max(n) > sum(n)),
a AS (SELECT debate_id, speaker_label, min(person_id) AS p FROM turns WHERE name_source = 'anchor' AND person_id IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT person_id) = 1),
tl AS (SELECT d.loksabha AS term, t.speaker_label, min(person_id) AS p FROM turns t JOIN debates d ON d.id = t.debate_id WHERE person_id IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT person_id) = 1)
SELECT t.id, CASE WHEN t.role_kind IS NULL THEN coalesce(code.p, a.p, tl.p) END AS person_id, CASE WHEN t.role_kind IS NOT NULL THEN 'role' WHEN code.p IS NOT NULL THEN 'code' WHEN a.p IS NOT NULL THEN 'debate label' WHEN tl.p IS NOT NULL THEN 'term label' ELSE 'none' END AS source
FROM turns t LEFT JOIN debates d ON d.id = t.debate_id LEFT JOIN code ON code.mp_code = t.mp_code LEFT JOIN a ON a.debate_id = t.debate_id AND a.speaker_label = t.speaker_label LEFT JOIN tl ON tl.term = d.loksabha AND tl.speaker_label = t.speaker_label""")
def attribution_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Every turn's person by the first that knows: its code, its label in the debate, its label in the term; never for roles."""
    t = load(spark, folder, "turns", "id", "debate_id", "speaker_label", "mp_code", "person_id", "role_kind", "name_source")
    t = stage(t.join(load(spark, folder, "debates", "id", "loksabha").select(F.col("id").alias("debate_id"), F.col("loksabha").alias("term")), "debate_id", "left"), "turns")
    anchored = t.where("name_source = 'anchor' and person_id is not null")
    v = anchored.where("mp_code is not null").groupBy("mp_code", "person_id").agg(F.count("*").alias("n"))
    code = v.groupBy("mp_code").agg(F.max_by("person_id", F.struct("n", -F.col("person_id"))).alias("by_code"), F.max("n").alias("m"), F.sum("n").alias("s")).where("2 * m > s").select("mp_code", "by_code")
    only = lambda rows, keys, name: rows.groupBy(*keys).agg(F.min("person_id").alias(name), F.count_distinct("person_id").alias("_n")).where("_n = 1").drop("_n")
    out = t.join(code, "mp_code", "left").join(only(anchored, ["debate_id", "speaker_label"], "by_debate"), ["debate_id", "speaker_label"], "left")
    out = out.join(only(t.where("person_id is not null"), ["term", "speaker_label"], "by_term"), ["term", "speaker_label"], "left")
    role = F.col("role_kind").isNotNull()
    source = F.when(role, "role").when(F.col("by_code").isNotNull(), "code").when(F.col("by_debate").isNotNull(), "debate label").when(F.col("by_term").isNotNull(), "term label").otherwise("none")
    return out.select("id", F.when(~role, F.coalesce("by_code", "by_debate", "by_term")).alias("person_id"), source.alias("source"))


def _similar(pairs: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """`pairs` with the Jaro-Winkler similarity of two of its columns, computed once for each two different values."""
    texts = pairs.select(a, b).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([round(spans.jaro_winkler(p, q), 6) for p, q in zip(x, y, strict=True)])], [a, b, name])

    return pairs.join(texts.mapInArrow(run, f"`{a}` string, `{b}` string, `{name}` double"), [a, b])


@query("TXT40 TXT39", f"""
WITH {LABELS}, {ROSTER}, k AS (SELECT term, label, {B_('label')} AS b, upper(trim(regexp_extract(label, '\\(([^()]*)\\)', 1))) AS inside FROM l WHERE {B_('label')} <> ''),
n AS (SELECT DISTINCT term, person_id, {B_('name')} AS m, seat FROM r),
c AS (SELECT term, label, person_id, max(CASE WHEN inside <> '' AND inside = seat THEN 1 ELSE 0 END) AS seat_fits, max(round(jaro_winkler_similarity(regexp_replace(b, '[^a-z ]', '', 'g'), regexp_replace(m, '[^a-z ]', '', 'g')), 6)) AS similarity FROM k JOIN n USING (term) WHERE (inside <> '' AND inside = seat) OR left(list_last(string_split(b, ' ')), 2) = left(list_last(string_split(m, ' ')), 2) GROUP BY 1, 2, 3),
o AS (SELECT *, row_number() OVER (PARTITION BY term, label ORDER BY seat_fits DESC, similarity DESC, person_id) AS place, sum(seat_fits) OVER (PARTITION BY term, label) AS seats FROM c)
SELECT term, label, person_id, similarity, place, seats = 1 AND seat_fits = 1 AS rule FROM o WHERE place <= 10""")
def option_lists(spark: SparkSession, folder: str) -> DataFrame:
    """A closed list of ten members for each label of a term: those of the seat in its brackets first, then the most similar names.

    Candidates share the seat or the start of the surname; names are compared by their plain Latin letters. `rule`: the only member of the seat, who needs no further judging.
    """
    first = lambda c: F.substring(F.element_at(F.split(F.col(c), " "), -1), 1, 2)
    k = _labels(spark, folder).select("term", "label", bare(F.col("label")).alias("b"), F.upper(F.trim(F.regexp_extract("label", "\\(([^()]*)\\)", 1))).alias("inside")).where("b <> ''")
    n = _roster(spark, folder).select("term", "person_id", bare(F.col("name")).alias("m"), "seat").distinct()
    by_name = k.withColumn("_f", first("b")).join(n.withColumn("_f", first("m")), ["term", "_f"]).drop("_f")
    by_seat = k.where("inside <> ''").join(n, (k.term == n.term) & (k.inside == n.seat)).select(*(k[c] for c in k.columns), "person_id", "m", "seat")
    latin = lambda c: F.regexp_replace(c, "[^a-z ]", "").alias(c)
    c = _similar(by_name.unionByName(by_seat).select("term", "label", latin("b"), "inside", "person_id", latin("m"), "seat"), "b", "m", "_s")
    fits = F.coalesce(((F.col("inside") != "") & (F.col("inside") == F.col("seat"))).cast("int"), F.lit(0))
    c = c.groupBy("term", "label", "person_id").agg(F.max(fits).alias("seat_fits"), F.max("_s").alias("similarity"))
    w = Window.partitionBy("term", "label")
    o = c.withColumn("place", F.row_number().over(w.orderBy(F.desc("seat_fits"), F.desc("similarity"), "person_id")).cast("bigint")).withColumn("seats", F.sum("seat_fits").over(w))
    return o.where("place <= 10").select("term", "label", "person_id", "similarity", "place", ((F.col("seats") == 1) & (F.col("seat_fits") == 1)).alias("rule"))


@query("TXT41", """
WITH c AS (SELECT id, tag_id AS answer, 1 AS pri, 'person' AS decider FROM entity_names WHERE link_status = 'linked' AND link_p >= 0.95 UNION ALL SELECT e.id, min(t.id), 2, 'rule' FROM entity_names e JOIN tags t ON lower(t.tag) = lower(e.name) WHERE t.status <> 'rejected' GROUP BY e.id HAVING count(*) = 1
  UNION ALL SELECT id, tag_id, 3, 'model' FROM entity_names WHERE link_p >= 0.8 UNION ALL SELECT id, NULL, 4, 'none' FROM entity_names WHERE link_status = 'none' UNION ALL SELECT id, tag_id, 5, 'fallback' FROM entity_names)
SELECT id, answer, decider FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY pri) = 1""")
def decider_precedence(spark: SparkSession, folder: str) -> DataFrame:
    """Each name's answer by the decider that comes first: a person, a rule (the only tag of that name), a sure model, none, the fallback."""
    e, t = load(spark, folder, "entity_names", "id", "name", "tag_id", "link_p", "link_status"), load(spark, folder, "tags", "id", "tag", "status").where("status <> 'rejected'")
    of = lambda rows, pri, name, answer: rows.select("id", answer.alias("answer"), F.lit(pri).alias("pri"), F.lit(name).alias("decider"))
    rule = e.select("id", F.lower("name").alias("k")).join(t.select(F.col("id").alias("t"), F.lower("tag").alias("k")), "k").groupBy("id").agg(F.min("t").alias("t"), F.count("*").alias("n")).where("n = 1")
    c = of(e.where("link_status = 'linked' and link_p >= 0.95"), 1, "person", F.col("tag_id")).unionByName(of(rule, 2, "rule", F.col("t"))).unionByName(of(e.where("link_p >= 0.8"), 3, "model", F.col("tag_id")))
    c = c.unionByName(of(e.where("link_status = 'none'"), 4, "none", F.lit(None).cast("int"))).unionByName(of(e, 5, "fallback", F.col("tag_id")))
    return c.groupBy("id").agg(F.min_by(F.struct("answer", "decider"), "pri").alias("b")).select("id", "b.*")


@query("TXT58 TXT43", f"""
WITH {LABELS}, {ROSTER}, k AS (SELECT term, label, {B_('label')} AS b, upper(trim(regexp_extract(label, '\\(([^()]*)\\)', 1))) AS inside FROM l WHERE {B_('label')} <> ''), n AS (SELECT DISTINCT term, person_id, {B_('name')} AS m, seat FROM r),
p1 AS (SELECT term, label, min(person_id) AS p FROM k JOIN n USING (term) WHERE b = m GROUP BY 1, 2 HAVING count(DISTINCT person_id) = 1),
p2 AS (SELECT k.term, k.label, min(person_id) AS p FROM k JOIN n ON n.term = k.term AND n.seat = k.inside WHERE inside <> '' AND NOT EXISTS (SELECT 1 FROM p1 WHERE p1.term = k.term AND p1.label = k.label) GROUP BY 1, 2 HAVING count(DISTINCT person_id) = 1),
p3 AS (SELECT k.term, k.label, min(person_id) AS p FROM k JOIN n ON n.term = k.term AND list_last(string_split(n.m, ' ')) = list_last(string_split(k.b, ' ')) AND left(n.m, 1) = left(k.b, 1)
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT term, label FROM p1 UNION ALL SELECT term, label FROM p2) d WHERE d.term = k.term AND d.label = k.label) GROUP BY 1, 2 HAVING count(DISTINCT person_id) = 1),
u AS (SELECT *, 'name' AS how FROM p1 UNION ALL SELECT *, 'seat' FROM p2 UNION ALL SELECT *, 'surname and initial' FROM p3),
o AS (SELECT person_id, lok_sabha_term AS term FROM speakers GROUP BY 1, 2 HAVING bool_and(source = 'not-a-member'))
SELECT u.term, u.label, CASE WHEN o.person_id IS NULL THEN p END AS person_id, CASE WHEN o.person_id IS NULL THEN how ELSE 'struck by hand' END AS how FROM u LEFT JOIN o ON o.person_id = u.p AND o.term = u.term""")
def passes_of_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Labels matched with members in passes, each over what the ones before left: full name, seat, surname with initial; entries by hand overrule."""
    last = lambda c: F.element_at(F.split(F.col(c), " "), -1)
    k = stage(_labels(spark, folder).select("term", "label", bare(F.col("label")).alias("b"), F.upper(F.trim(F.regexp_extract("label", "\\(([^()]*)\\)", 1))).alias("inside")).where("b <> ''"), "labels")
    n = stage(_roster(spark, folder).select("term", "person_id", bare(F.col("name")).alias("m"), "seat").distinct(), "roster")
    keyed = {
        "name": (k.withColumn("_k", F.col("b")), n.withColumn("_k", F.col("m"))), "seat": (k.where("inside <> ''").withColumn("_k", F.col("inside")), n.withColumn("_k", F.col("seat"))),
        "surname and initial": (k.withColumn("_k", F.concat(last("b"), F.lit(" "), F.substring("b", 1, 1))), n.withColumn("_k", F.concat(last("m"), F.lit(" "), F.substring("m", 1, 1)))),
    }
    done = None
    for how, (left, right) in keyed.items():
        rest = left if done is None else left.join(done, ["term", "label"], "left_anti")
        found = rest.join(right, ["term", "_k"]).groupBy("term", "label").agg(F.min("person_id").alias("p"), F.count_distinct("person_id").alias("_n")).where("_n = 1").select("term", "label", "p", F.lit(how).alias("how"))
        done = stage(found if done is None else done.unionByName(found), "matches")
    struck = load(spark, folder, "speakers", "person_id", "lok_sabha_term", "source").groupBy(F.col("person_id").alias("p"), F.col("lok_sabha_term").alias("term")).agg(F.min(F.col("source") == "not-a-member").alias("struck")).where("struck")
    out = done.join(struck, ["p", "term"], "left")
    return out.select("term", "label", F.when(F.col("struck").isNull(), F.col("p")).alias("person_id"), F.when(F.col("struck").isNull(), F.col("how")).otherwise("struck by hand").alias("how"))
