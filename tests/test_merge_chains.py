"""Merge chains are followed to their ends, whatever their length, and cycles have a defined result."""

from pathlib import Path

import pytest
from gavel.operators import graph
from gavel.plans import catalog
from gavel.sources.tables import load

FOLDER = "/root/testdata/sf0.001"


def walk(into):
    """By node: end and steps (null on cycles) and group, one pointer at a time."""
    out = {}
    for n in into:
        seen, at = [], n
        while into.get(at) is not None and at not in seen:
            seen.append(at)
            at = into[at]
        out[n] = (None, None, min(seen[seen.index(at) :])) if at in seen else (at, len(seen), at)
    return out


def test_chains_of_any_length_and_cycles(rows):
    into = {0: None, 9: None, 500: 777, 600: 600, 601: 600} | {n: n - 1 for n in range(1, 9)} | {n: n - 1 for n in range(10, 120)}
    into |= {200: 201, 201: 202, 202: 200, 203: 201} | {n: n - 1 for n in range(204, 240)}
    out = {r["node"]: (r["end"], r["steps"], r["group"]) for r in graph.chain_ends(rows("id int, merged_into int", *into.items())).collect()}
    assert out == walk(into) and out[119] == (9, 110, 9) and out[239] == (None, None, 200)
    assert graph.chain_ends(rows("id int, merged_into int")).count() == 0


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
def test_every_tag_reaches_its_kept_tag(spark):
    want = walk({r["id"]: r["merged_into"] for r in load(spark, FOLDER, "tags", "id", "merged_into").collect()})
    got = {r["id"]: (r["target"], r["steps"]) for r in catalog.queries()["merge_chain_resolve"](spark, FOLDER).collect()}
    assert got == {n: w[:2] for n, w in want.items()} and max(s for _, s in got.values() if s is not None) > 16


@pytest.fixture
def tags(spark, rows, tmp_path):
    """A folder of tags: 1 <- 2 <- 3 with one tag, 4, of its own, and a cycle 5 -> 6 -> 5 that 7 leads into."""
    t = [(1, None, "Onion", ["onions"], 1), (2, 1, "Onion price", None, 5), (3, 2, "onions ", ["Bulb"], 9), (4, None, "Rail", None, 2), (5, 6, "A", None, 1), (6, 5, "B", None, 1), (7, 6, "C", None, 1)]
    rows("id int, merged_into int, tag string, aliases array<string>, debate_count int", *t).write.parquet(f"{tmp_path}/tags.parquet")
    v = [(n, "vec-archive-2", "RETRIEVAL_DOCUMENT", [1.0, float(n)]) for n in range(1, 8)]
    rows("tag_id int, model string, task_type string, embedding array<float>", *v).write.parquet(f"{tmp_path}/tag_embeddings.parquet")
    return str(tmp_path)


def test_groups_of_merged_tags_hold_the_whole_chain(spark, tags):
    run = lambda name: catalog.queries()[name](spark, tags).collect()
    assert {(r["group_id"], r["kept"], r["members"], r["debates"]) for r in run("pick_kept")} == {(1, 3, 3, 15), (5, 5, 3, 3)}
    assert {r["id"]: r["aliases"] for r in run("merged_aliases")} == {1: ["Onion", "onions", "Onion price", "Bulb"], 4: ["Rail"], 5: ["A", "B", "C"]}
    assert {(r["g"], r["id"]) for r in run("chain_in_groups")} == {(1, 1), (1, 2), (1, 3), (4, 4), (5, 5), (5, 6), (5, 7)}


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
def test_kept_tags_of_the_test_tables(spark):
    t = {r["id"]: r for r in load(spark, FOLDER, "tags", "id", "merged_into", "debate_count").collect()}
    groups = {}
    for n, (_, _, g) in walk({n: r["merged_into"] for n, r in t.items()}).items():
        groups.setdefault(g, []).append(n)
    want = {(g, max(m, key=lambda n: (t[n]["debate_count"], -n)), len(m), sum(t[n]["debate_count"] for n in m)) for g, m in groups.items() if len(m) > 1}
    assert {(r["group_id"], r["kept"], r["members"], r["debates"]) for r in catalog.queries()["pick_kept"](spark, FOLDER).collect()} == want
