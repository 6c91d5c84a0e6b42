"""Problem 7 leaves aside what problem 3 finds, by margins from all clean rows."""

from gavel.llm import garbled, queries
from pyspark.sql import functions as F
from test_whole_margins import TEXTS, brute


def test_p7_margins_of_all_rows(spark, tmp_path, monkeypatch):
    table = lambda name, schema, data: spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    bad, look = "café et naïveté".encode().decode("cp1252"), "\u0421anal"
    table("turns", "id bigint, text string, speaker_label string", [*((k, t, "Shri A") for k, t in enumerate(TEXTS)), (9_000, bad + " \u0421anal", None), (9_001, look, None)])
    table("debates", "id bigint, raw_html string", [(1, "<p>Île</p>")])
    table("entity_names", "id bigint, norm_name string", [(1, "canal")])
    seen = []
    margins = garbled._margins
    monkeypatch.setattr(garbled, "_margins", lambda clean, *more: seen.append({r[0]: r[1] for r in clean.groupBy("text").agg(F.sum("count")).collect()}) or margins(clean, *more))
    found = {(r["field"], r["record_id"]) for r in queries.p7_found(spark, str(tmp_path)).collect()}
    want = brute([*TEXTS, "<p>Île</p>", look])
    assert seen == [dict(want)]
    assert ("turns.text", 9_001) in found and ("turns.text", 9_000) not in found
