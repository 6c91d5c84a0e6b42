"""Relational building blocks: filters with explicit null rules, joins, one row per group, set differences.

All take and return DataFrames, and none collects rows. Null rules are part of each operator's contract.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavel.operators.sequences import filled
from gavel.sources.staging import stage


def conjunction(conditions: Mapping[str, Column], skip: Sequence[str] = ()) -> Column:
    """All named conditions but the skipped ones, joined by AND; true if none is left. A facet skips its own names."""
    return reduce(lambda a, b: a & b, (c for name, c in conditions.items() if name not in skip), F.lit(True))


def not_in_known(column: Column, values: Sequence) -> Column:
    """Value known and not among `values`: rows with a null don't pass."""
    return column.isNotNull() & ~column.isin(list(values))


def not_in_or_null(column: Column, values: Sequence) -> Column:
    """Value not among `values`, or null: rows with a null pass."""
    return column.isNull() | ~column.isin(list(values))


def contains_literal(column: Column, part: str) -> Column:
    """The text contains `part`, case aside; `%`, `_` and `\\` in it stand for themselves. Null texts give false."""
    return F.coalesce(F.contains(F.lower(column), F.lit(part.lower())), F.lit(False))


def pair_in(a: Column, b: Column, pairs: Sequence[tuple]) -> Column:
    """(a, b) is one of `pairs`; false if either is null."""
    return F.coalesce(reduce(lambda x, y: x | y, ((a == p) & (b == q) for p, q in pairs), F.lit(False)), F.lit(False))


def bucket_of(column: Column, groups: Mapping[str, Sequence[str]], other: str = "other") -> Column:
    """The group a normalised text (trimmed, single blanks, upper case) belongs to, or `other`, also for null."""
    text = F.upper(F.regexp_replace(F.trim(column), "\\s+", " "))
    out = F.lit(None).cast("string")
    for name, members in groups.items():
        out = F.when(text.isin(list(members)), F.lit(name)).otherwise(out)
    return F.coalesce(out, F.lit(other))


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """The first `k` rows of each group by `order`, which should end in a unique column. A null key is a group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def page_of(df: DataFrame, order: Sequence[Column], page: str | None, per_page: str | None, most: int = 100) -> DataFrame:
    """One page of `df` with its number `page`. The arguments are texts as they come: what is no number counts as 1 and `most`.

    Rows a page are clamped to 1..`most`, the page to 1..the last one. Only a page's rows are sorted out, by offset and limit.
    """
    number = lambda t, other: int(t) if t and t.strip().lstrip("+-").isdigit() else other
    size = min(max(number(per_page, most), 1), most)
    last = max(1, -(-df.count() // size))
    at = min(max(number(page, 1), 1), last)
    return df.orderBy(*order).offset((at - 1) * size).limit(size).withColumn("page", F.lit(at).cast("bigint"))


def latest_or_last(events: DataFrame, versions: DataFrame, keys: Sequence[str], at: str, since: str, event_id: str, tie: str, keep: Sequence[str]) -> DataFrame:
    """Each event with the version in force at its time, or the entity's last version where the time is null.

    Unlike a half-open interval join, which drops events without a time. Ties go to the smaller `tie`. Events without
    any version keep nulls in `keep`.
    """
    found = (
        events.join(versions.select(*keys, since, tie, *keep), list(keys), "left")
        .withColumn("_fits", F.col(at).isNull() | (F.col(since) <= F.col(at)))
        .withColumn("_since", F.when(F.col("_fits"), F.col(since)))
    )
    best = top_per_group(found, [event_id], [F.col("_since").desc_nulls_last(), F.col(tie)])
    return best.select(*events.columns, *(F.when(F.col("_fits"), F.col(c)).alias(c) for c in keep))


def periods(versions: DataFrame, keys: Sequence[str], since: str, until: str = "until") -> DataFrame:
    """Versions with the start of the next one as their end (null for the last): half-open periods."""
    return versions.withColumn(until, F.lead(since).over(Window.partitionBy(*keys).orderBy(since)))


def interval_join(events: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, since: str, until: str) -> DataFrame:
    """Events with the period that contains their time: since <= at < until, an open end counting as never.

    Events with a null time or without a period drop out.
    """
    joined = events.join(spans, list(keys))
    return joined.where((F.col(since) <= F.col(at)) & (F.col(until).isNull() | (F.col(at) < F.col(until))))


def within_spans(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, width: int = 64) -> DataFrame:
    """Points with every span of the same key that contains them (both ends count).

    Spans are listed under each range of `width` positions that they touch, points under theirs, and the two are
    equi-joined on key and range, so one key with a third of all rows is spread over its ranges.
    """
    p = points.withColumn("_range", F.floor(F.col(at) / width))
    s = spans.withColumn("_range", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return p.join(s, [key, "_range"]).where(F.col(at).between(F.col(start), F.col(end))).drop("_range")


#: A key counts as heavy from this share of all rows on, so there are at most as many heavy keys as its inverse.
HEAVY = 1_000


def spread_lookup(rows: DataFrame, facts: DataFrame, key: str, size: str) -> DataFrame:
    """`rows` with the columns of their key's row in `facts` (one row a key), those without one dropping out.

    `size` says how many of the rows have the key. Keys with a thousandth of all rows or more, of which there can be no
    more than a thousand, are broadcast and their rows stay where they are; only the others travel. So a key with a
    third of all rows is no single task's work. Null keys find nothing.
    """
    columns = [c for c in facts.columns if c != key]
    total = facts.agg(F.sum(size).alias("_total"))
    heavy = facts.join(F.broadcast(total)).where(F.col(size) * HEAVY >= F.col("_total")).select(key, F.struct(*columns).alias("_heavy"))
    rest = facts.select(F.col(key).alias("_key"), F.struct(*columns).alias("_light"))
    found = rows.join(F.broadcast(heavy), key, "left").withColumn("_key", F.when(F.col("_heavy").isNull(), F.col(key)))
    light = found.where("_heavy is null and _key is not null").join(rest, "_key").select(*rows.columns, *(F.col("_light")[c].alias(c) for c in columns))
    return found.where("_heavy is not null").select(*rows.columns, *(F.col("_heavy")[c].alias(c) for c in columns)).unionByName(light)


def zero_filled(groups: DataFrame, counts: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """All groups with their counts, 0 where a group has none."""
    joined = groups.join(counts, list(keys), "left")
    return joined.select(*groups.columns, *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in columns))


def only_nearest(a: DataFrame, b: DataFrame, key: str, at: str, width: int = 64) -> DataFrame:
    """Pairs of `a` and `b` (`key`, `at`, `id` each) in which each is the other's only nearest by the number `at`: `a`, `b`, `gap`.

    A row with two nearest ones matches nothing. No pair is tried: of every place the nearest places of the other side
    below and above are carried along the order, in ranges of `width`. Rows with a null key or place take no part.
    """
    count = lambda df, side: df.where(F.col(at).isNotNull()).groupBy(key, at).agg(F.count("*").alias(f"_n_{side}"), F.min("id").alias(f"_{side}"))
    places = count(a, "a").join(count(b, "b"), [key, at], "full").where(F.col(key).isNotNull())
    places = stage(places.withColumn("_down", -F.col(at)), "places")
    for side in ("a", "b"):
        here = F.when(F.col(f"_n_{side}").isNotNull(), F.struct(F.col(at).alias("at"), F.col(f"_n_{side}").alias("n"), F.col(f"_{side}").alias("id")))
        places = places.withColumn("_here", here)
        for order, name in ((at, "below"), ("_down", "above")):
            places = filled(places, key, order, "_here", f"_{side}_{name}", width)
        places = stage(places.drop("_here"), "places")

    def best(side: str, other: str) -> DataFrame:
        low, high = F.col(f"_{other}_below"), F.col(f"_{other}_above")
        down, up = F.col(at) - low["at"], high["at"] - F.col(at)
        one = F.when(high.isNull() | (down < up), low).when(low.isNull() | (up < down), high).when(low["at"] == high["at"], low)
        near = places.where(F.col(f"_n_{side}").isNotNull()).select(key, at, one.alias("_best")).where("_best.n = 1")
        rows = {"a": a, "b": b}[side].select(key, at, F.col("id").alias(side)).join(near, [key, at])
        return rows.select(side, F.col("_best.id").alias(other), F.abs(F.col(at) - F.col("_best.at")).alias("gap"))

    return best("a", "b").join(best("b", "a").drop("gap"), ["a", "b"])


def having_all(facts: DataFrame, key: str, value: str, wanted: Sequence) -> DataFrame:
    """The keys that have every wanted value."""
    found = facts.where(F.col(value).isin(list(wanted))).select(key, value).distinct()
    return found.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") == len(set(wanted))).select(key)


def having_any(facts: DataFrame, key: str, value: str, wanted: Sequence) -> DataFrame:
    """The keys that have one of the wanted values or more."""
    return facts.where(F.col(value).isin(list(wanted))).select(key).distinct()


def set_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of either side once, with `side`: both, left or right. Nulls in keys are equal to each other."""
    l, r = left.select(*keys).distinct().withColumn("_l", F.lit(1)), right.select(*keys).distinct().withColumn("_r", F.lit(1))
    both = l.unionByName(r, allowMissingColumns=True).groupBy(*keys).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    side = F.when(F.col("_l").isNull(), "right").when(F.col("_r").isNull(), "left").otherwise("both")
    return both.select(*keys, side.alias("side"))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`old` with rows of equal key replaced by those of `new`, and the others of `new` added. Keys must be unique in each."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new.select(*old.columns))


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`old` with those rows of `new` added whose key it doesn't have."""
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti").select(*old.columns))


def diff(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Every key with `change`: insert, delete, update or same (null-safe comparison of `values`)."""
    o, n = old.select(*keys, F.struct(*values).alias("_o")), new.select(*keys, F.struct(*values).alias("_n"))
    both = o.join(n, list(keys), "full")
    change = F.when(F.col("_o").isNull(), "insert").when(F.col("_n").isNull(), "delete").when(F.col("_o").eqNullSafe(F.col("_n")), "same").otherwise("update")
    return both.select(*keys, change.alias("change"))
