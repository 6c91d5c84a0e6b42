"""Attributes as known at event time, over the archive's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.operators.asof import as_known
from gavel.plans.registry import query
from gavel.sources.tables import load

P2_FOUND = """
SELECT DISTINCT debate_id, person_id, party_id FROM (
  SELECT e.debate_id, e.person_id, s.party_id,
         row_number() OVER (PARTITION BY e.debate_id, e.person_id ORDER BY s.effective_from DESC, s.party_id NULLS LAST) AS n
  FROM (SELECT DISTINCT debate_id, person_id FROM turns WHERE person_id IS NOT NULL) e
  JOIN debates d ON d.id = e.debate_id AND d.debate_date IS NOT NULL
  JOIN speakers s ON s.person_id = e.person_id AND s.lok_sabha_term = d.loksabha AND s.effective_from <= d.debate_date
) WHERE n = 1 AND party_id IS NOT NULL
"""


@query("JOI03", P2_FOUND)
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The party that each member who speaks in a debate had on its day."""
    debates = load(spark, folder, "debates", "id", "loksabha", "debate_date").where(F.col("debate_date").isNotNull())
    spoke = load(spark, folder, "turns", "debate_id", "person_id").where(F.col("person_id").isNotNull()).distinct()
    events = spoke.join(debates.withColumnRenamed("id", "debate_id"), "debate_id").withColumnRenamed("loksabha", "term")
    parties = load(spark, folder, "speakers", "id", "person_id", "lok_sabha_term", "effective_from", "party_id")
    known = as_known(
        events,
        parties.withColumnRenamed("lok_sabha_term", "term"),
        ["person_id", "term"],
        "debate_date",
        "effective_from",
        ["party_id"],
        tie=[F.col("party_id").asc_nulls_last()],
    )
    return known.where(F.col("party_id").isNotNull()).select("debate_id", "person_id", "party_id").distinct()
