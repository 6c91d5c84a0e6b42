"""Pairs of similar names: every pair is compared, in blocks of bounded size, and only rows travel, not pairs."""

import compare
import pytest
from gavel.operators import search
from gavel.plans import catalog

WORDS = ["canal", "district", "scheme", "union", "bridge", "repair", "water", "granary"]


def exchanged(plan) -> int:
    """Rows that a plan, once run, wrote for other tasks."""
    node = plan.nodeName()
    if node == "AdaptiveSparkPlan":
        return exchanged(plan.executedPlan())
    if node.endswith("QueryStage"):
        return exchanged(plan.plan())
    metric = plan.metrics().get("shuffleRecordsWritten")
    inner = plan.children()
    return (metric.get().value() if metric.isDefined() else 0) + sum(exchanged(inner.apply(k)) for k in range(inner.size()))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """600 names of shared words in one domain, ids that repeat, names without a word, null kinds and domains."""
    folder = tmp_path_factory.mktemp("names")
    rows = [(k, "bill", "water", f"{WORDS[k % 8]} {WORDS[k // 8 % 8]} district of {WORDS[k * 7 % 5]} {k % 10}") for k in range(600)]
    rows += [(3, "bill", "water", "Canal repair, district"), (3, "bill", "water", "canal repair district"), (700, "bill", "water", "***"), (701, "bill", "water", None), (702, "bill", None, "canal"), (703, None, "water", "canal")]
    spark.createDataFrame(rows, "id int, type string, domain string, tag string").write.parquet(f"{folder}/tags.parquet")
    return str(folder)


def test_as_sql(spark, folder):
    _, got, types = compare.rows_of_spark(catalog.queries()["trigram_candidates"](spark, folder))
    _, want, _ = compare.rows_of_sql(compare.connect(folder), catalog.oracle_sql()["trigram_candidates"])
    assert got == want and len(got) > 1000
    assert types == {"a": "int", "b": "int", "similarity": "double"}


def test_only_rows_travel(spark, folder):
    df = catalog.queries()["trigram_candidates"](spark, folder)
    df.collect()
    assert 0 < exchanged(df._jdf.queryExecution().executedPlan()) < 5 * 606


def test_blocks(spark, folder, monkeypatch):
    names = spark.read.parquet(f"{folder}/tags.parquet")
    build = lambda: sorted(map(repr, search.similar_names(names, ["type", "domain"], "id", names["tag"], 0.4).toArrow().to_pylist()))
    whole = build()
    monkeypatch.setattr(search, "NAMES", 50)
    monkeypatch.setattr(search, "GRAMS", 7)
    assert build() == whole
