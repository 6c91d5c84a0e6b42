"""Groups are packed first-fit within their type, and no inventory row is claimed without an operator."""

from gavel.operators import graph
from gavel.plans import catalog


def test_packed_groups(spark, rows, tmp_path):
    sizes = rows("type string, domain string, members bigint", ("a", "x", 5), ("a", "y", 6), ("a", "z", 4), ("a", "w", 12), ("a", None, 4), ("b", "x", 1), (None, "x", 3))
    got = {(r["type"], r["domain"]): r["box"] for r in graph.packed(sizes, "type", "domain", "members", 10).collect()}
    assert got == {("a", "w"): 0, ("a", "y"): 1, ("a", "x"): 2, ("a", None): 1, ("a", "z"): 2, ("b", "x"): 0, (None, "x"): 0}
    tags = [("a", d) for d, n in (("x", 300), ("y", 60), ("z", 50)) for _ in range(n)]
    rows("type string, domain string", *tags).write.parquet(f"{tmp_path}/tags.parquet")
    assert {(r["domain"], r["members"], r["box"]) for r in catalog.queries()["packed_groups"](spark, str(tmp_path)).collect()} == {("x", 300, 0), ("y", 60, 1), ("z", 50, 0)}


def test_rows_without_an_operator_are_not_claimed():
    covered = catalog.coverage()
    assert covered["GRA08"] == ["packed_groups"] and not {"SRC03", "DEC15"} & covered.keys()
