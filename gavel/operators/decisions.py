"""What follows from stored probabilities, hashes and versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax_limit(options: Column, limit: float, otherwise: str) -> Column:
    """The name of the most probable option (array of struct<name, p>), the first of equals by name, or `otherwise` below `limit`."""
    best = F.element_at(F.array_sort(options, lambda a, b: F.when(a["p"] > b["p"], -1).when(a["p"] < b["p"], 1).when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0)), 1)
    return F.when((F.size(options) > 0) & (best["p"] >= limit), best["name"]).otherwise(otherwise)


def expected_level(options: Column, levels: dict[str, int]) -> Column:
    """The mean level under the probabilities; options without a level count 0."""
    value = lambda o: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in levels.items() for x in kv)), o["name"]), F.lit(0))
    return F.aggregate(options, F.lit(0.0), lambda s, o: s + o["p"] * value(o))


def split_vote(options: Column, total: float = 0.7, second: float = 0.2) -> Column:
    """The two most probable options hold `total` or more, and the second of them `second` or more."""
    p = F.reverse(F.array_sort(F.transform(options, lambda o: o["p"])))
    return F.when(F.size(p) >= 2, (p[0] + p[1] >= total) & (p[1] >= second)).otherwise(False)


def state_of(done_hash: Column, now_hash: Column, done_version: Column, now_version: Column) -> Column:
    """todo (never done), stale (input or version changed), else done."""
    return F.when(done_hash.isNull(), "todo").when(~done_hash.eqNullSafe(now_hash) | (done_version < now_version), "stale").otherwise("done")


def failed_checks(checks: dict[str, Column]) -> Column:
    """The names of the checks that don't hold (null counts as not holding), in order."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items())))
