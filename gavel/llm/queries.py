"""The training-data queries over the archive's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.llm import duplicates, garbled, groups, lookalikes, neighbours, packing, residue, speakers, tokens
from gavel.operators.relational import spread_lookup
from gavel.sources.staging import stage
from gavel.sources.tables import load

CAPACITY = 2_048
MODEL, TASK, DIMS = "vec-archive-2", "RETRIEVAL_DOCUMENT", 96


def _vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    tags = (
        load(spark, folder, "tag_embeddings", "tag_id", "model", "task_type", "embedding")
        .where((F.col("model") == MODEL) & (F.col("task_type") == TASK))
        .select(F.col("tag_id").cast("bigint").alias("id"), F.col("embedding").alias("vector"))
    )
    entities = load(spark, folder, "entity_names", "id", "embedding_query")
    queries = tags.select(F.lit("tag").alias("kind"), "id", F.col("id").alias("own"), "vector").unionByName(
        entities.select(F.lit("entity").alias("kind"), "id", F.lit(None).cast("bigint").alias("own"), F.col("embedding_query").alias("vector"))
    )
    return tags, queries


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """For every tag vector and entity query vector, the up to five most similar tags of cosine 0.8 or more."""
    tags, queries = _vectors(spark, folder)
    return neighbours.most_similar(tags, queries, DIMS).select(
        F.col("kind").alias("query_kind"), F.col("id").alias("query_id"), F.col("found").cast("int").alias("tag_id")
    ).distinct()


P1_FOUND = """
WITH t AS (SELECT DISTINCT tag_id, CAST(embedding AS DOUBLE[]) AS v FROM tag_embeddings WHERE model = 'vec-archive-2' AND task_type = 'RETRIEVAL_DOCUMENT' AND len(embedding) = 96
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT id, CAST(embedding_query AS DOUBLE[]) AS v FROM entity_names WHERE len(embedding_query) = 96
    AND len(list_filter(embedding_query, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding_query, lambda x: x <> 0)) > 0),
q AS (SELECT DISTINCT 'tag' AS query_kind, CAST(tag_id AS BIGINT) AS query_id, tag_id AS own, v FROM t UNION ALL SELECT 'entity', id, NULL, v FROM e),
c AS (SELECT query_kind, query_id, t.tag_id, max(list_cosine_similarity(q.v, t.v)) AS c FROM q JOIN t ON q.own IS DISTINCT FROM t.tag_id WHERE list_cosine_similarity(q.v, t.v) >= 0.8 GROUP BY ALL)
SELECT query_kind, query_id, tag_id FROM c QUALIFY row_number() OVER (PARTITION BY query_kind, query_id ORDER BY c DESC, tag_id) <= 5
"""


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    """The pages and turns that may be garbled: `field`, `record_id`, `text`."""
    pages = load(spark, folder, "debates", "id", "raw_html").select(F.lit("debates.raw_html").alias("field"), F.col("id").alias("record_id"), F.col("raw_html").alias("text"))
    turns = load(spark, folder, "turns", "id", "text").select(F.lit("turns.text").alias("field"), F.col("id").alias("record_id"), "text")
    return pages.unionByName(turns)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pages and turns that are garbled by a wrong decoding, wholly or in part."""
    return garbled.find_garbled(_texts(spark, folder), ["field", "record_id"], "text").select("field", "record_id").distinct()


def p3_restored(spark: SparkSession, folder: str) -> DataFrame:
    """The garbled pages and turns with their original text, where it can be restored, and the wrong decodings undone."""
    return garbled.find_garbled(_texts(spark, folder), ["field", "record_id"], "text")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of 25 or more words that repeat an earlier one but for formatting, with the earliest."""
    same = duplicates.same_texts(load(spark, folder, "turns", "id", "text"), "id", "text")
    return same.where("id <> first_id").select("first_id", F.col("id").alias("turn_id")).distinct()


P4_FOUND = """
WITH t AS (SELECT id, text, string_split_regex(regexp_replace(text, '^[\\s\\x{b}\\x{1c}-\\x{1f}\\x{85}\\p{Z}]+|[\\s\\x{b}\\x{1c}-\\x{1f}\\x{85}\\p{Z}]+$', '', 'g'), '[\\s\\x{b}\\x{1c}-\\x{1f}\\x{85}\\p{Z}]+') AS w FROM turns WHERE text IS NOT NULL),
n AS (SELECT id, text, regexp_replace(lower(text), '[^\\p{L}\\p{M}\\p{Nd}]+', '', 'g') AS flat, list_filter(string_split_regex(text, '[;|\\r\\n]+'), lambda p: regexp_matches(p, '[\\p{L}\\p{M}\\p{Nd}]')) AS parts FROM t WHERE len(w) >= 25),
f AS (SELECT id, flat, CASE WHEN len(parts) >= 2 AND regexp_matches(text, '^[^:;|\\r\\n]{1,120}:') AND len(list_filter(parts, lambda p: NOT regexp_matches(p, '^\\s*[^:]{0,59}\\p{L}[^:]{0,59}:(?s:.*)[\\p{L}\\p{Nd}]'))) = 0
    THEN array_to_string(list_sort(list_distinct(list_transform(parts, lambda p: regexp_replace(lower(p), '[^\\p{L}\\p{M}\\p{Nd}]+', '', 'g')))), chr(10)) END AS fields FROM n),
l AS (SELECT flat, min(fields) AS fields FROM f WHERE fields IS NOT NULL GROUP BY 1),
g AS (SELECT f.id, coalesce('F' || l.fields, 'T' || f.flat) AS k FROM f LEFT JOIN l USING (flat))
SELECT DISTINCT first_id, id AS turn_id FROM (SELECT id, min(id) OVER (PARTITION BY k) AS first_id FROM g) WHERE first_id <> id
"""


def p4_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    """One record of each group of turns that are the same but for formatting, with its number of copies."""
    same = duplicates.same_texts(load(spark, folder, "turns", "id", "text"), "id", "text")
    return same.where("id = first_id").select("first_id", "copies").distinct()


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Tags and subjects that merges, parents and equal keys link, with the smallest tag of their group."""
    tags = load(spark, folder, "tags", "id", "merged_into")
    subjects = load(spark, folder, "subjects", "id", "parent_tag_id", "subject_key")
    tag, subject = (lambda c: F.concat(F.lit("tag "), F.col(c))), (lambda c: F.concat(F.lit("subject "), F.col(c)))
    links = (
        tags.where("merged_into is not null").select(tag("id").alias("a"), tag("merged_into").alias("b"))
        .unionByName(subjects.where("parent_tag_id is not null").select(subject("id").alias("a"), tag("parent_tag_id").alias("b")))
        .unionByName(subjects.where("subject_key is not null").select(subject("id").alias("a"), F.concat(F.lit("key "), F.col("subject_key")).alias("b")))
    )
    records = tags.select(F.lit("tag").alias("kind"), F.col("id").alias("record_id"), tag("id").alias("node")).unionByName(
        subjects.select(F.lit("subject").alias("kind"), F.col("id").alias("record_id"), subject("id").alias("node"))
    ).distinct()
    members = stage(records.join(groups.components(links, "a", "b"), "node").drop("node"), "members")
    of_group = members.groupBy("component").agg(
        F.min(F.when(F.col("kind") == "tag", F.col("record_id"))).alias("group_tag_id"), F.count("*").alias("n")
    ).where("n > 1 and group_tag_id is not null")
    # Told without moving the members of heavy groups; records are distinct, and so are their rows.
    return spread_lookup(members, of_group, "component", "n").select("kind", "record_id", "group_tag_id")


def _turns(spark: SparkSession, folder: str, build: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    turns = load(spark, folder, "turns", "id", "debate_id", "seq", "speaker_label", "text", "person_id", "role_kind")
    rosters = load(spark, folder, "debates", "id", "mp_list_raw").withColumnRenamed("id", "debate_id")
    return build(turns, rosters)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The first and last row of each clean turn of each debate."""
    return _turns(spark, folder, speakers.clean_turns).select("debate_id", "seq_start", "seq_end")


def p5_turns(spark: SparkSession, folder: str) -> DataFrame:
    """The clean turns with their speakers, numbers of rows and cleaned texts."""
    return _turns(spark, folder, speakers.turn_texts)


P6_FOUND = """
WITH RECURSIVE nodes AS (
  SELECT DISTINCT 'tag' AS kind, id AS record_id, 'tag ' || id AS node FROM tags
  UNION SELECT DISTINCT 'subject', id, 'subject ' || id FROM subjects),
links AS (
  SELECT 'tag ' || id AS a, 'tag ' || merged_into AS b FROM tags WHERE merged_into IS NOT NULL
  UNION SELECT 'subject ' || id, 'tag ' || parent_tag_id FROM subjects WHERE parent_tag_id IS NOT NULL
  UNION SELECT 'subject ' || id, 'key ' || subject_key FROM subjects WHERE subject_key IS NOT NULL),
undirected AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, a FROM undirected UNION SELECT r.a, l.b FROM reach r JOIN undirected l ON l.a = r.b),
label AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a),
members AS (SELECT n.kind, n.record_id, l.component FROM nodes n JOIN label l USING (node)),
of_group AS (
  SELECT component, min(CASE WHEN kind = 'tag' THEN record_id END) AS group_tag_id FROM members
  GROUP BY component HAVING count(*) > 1 AND min(CASE WHEN kind = 'tag' THEN record_id END) IS NOT NULL)
SELECT DISTINCT kind, record_id, group_tag_id FROM members JOIN of_group USING (component)
"""


def _looks(spark: SparkSession, folder: str) -> DataFrame:
    turns = load(spark, folder, "turns", "id", "text", "speaker_label")
    names = load(spark, folder, "entity_names", "id", "norm_name")
    two = turns.select("id", F.inline(F.array(*(F.struct(F.lit(f"turns.{c}").alias("field"), F.col(c).alias("text")) for c in ("text", "speaker_label")))))
    three = names.select("id", F.lit("entity_names.norm_name").alias("field"), F.col("norm_name").alias("text"))
    return two.unionByName(three).select("field", F.col("id").alias("record_id"), "text")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Turns, labels and names that are written with look-alike characters; turns that are garbled aside."""
    changed = lookalikes.normalised(_looks(spark, folder), ["field", "record_id"], "text").select("field", "record_id")
    # The cases of problem 3, by the same run over the same texts.
    broken = p3_found(spark, folder).where("field = 'turns.text'")
    return changed.join(broken, ["field", "record_id"], "left_anti").distinct()


def p7_normal(spark: SparkSession, folder: str) -> DataFrame:
    """Every turn text, label and name in its one consistent form."""
    return lookalikes.normalised(_looks(spark, folder), ["field", "record_id"], "text", changed_only=False)


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The token ids of every document by byte_bpe_50k."""
    return tokens.encode_corpus(load(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")


def p8_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's text again, from its token ids; null texts come back as empty ones."""
    return tokens.decode_corpus(p8_ids(spark, folder), "doc_id")


def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    """In which container of 2,048 tokens each document, or piece of a longer one, lies."""
    sizes = tokens.count_tokens(load(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")
    return packing.pack(sizes, "doc_id", "n_tokens", CAPACITY)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with template residue or filler text, or that are a message of the site."""
    return residue.residue(load(spark, folder, "documents", "doc_id", "text"), "doc_id", "text").select("doc_id").distinct()


def p10_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """The same documents with what was found in each."""
    return residue.residue(load(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p3_found": p3_found,
        "p3_restored": p3_restored,
        "p4_found": p4_found,
        "p4_collapsed": p4_collapsed,
        "p5_found": p5_found,
        "p5_turns": p5_turns,
        "p6_found": p6_found,
        "p7_found": p7_found,
        "p7_normal": p7_normal,
        "p8_ids": p8_ids,
        "p8_decoded": p8_decoded,
        "p9_containers": p9_containers,
        "p10_found": p10_found,
        "p10_reasons": p10_reasons,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1_FOUND,
        "p4_found": P4_FOUND,
        "p6_found": P6_FOUND,
        "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    }
