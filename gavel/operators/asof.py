"""Attributes as they were known at the time of an event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucket(time: Column, kind: str, width_days: int) -> Column:
    """The number of the time range that `time` lies in; ranges are `width_days` long."""
    if kind == "date":
        return F.floor(F.datediff(time, F.lit("1970-01-01").cast("date")) / width_days)
    return F.floor(F.unix_micros(time.cast("timestamp")) / (width_days * 86_400_000_000))


def as_known(
    events: DataFrame,
    attributes: DataFrame,
    keys: list[str],
    event_time: str,
    valid_from: str,
    columns: list[str],
    tie: list[Column] | None = None,
    prefix: str = "",
    width_days: int = 30,
) -> DataFrame:
    """`events` with the `columns` of the attribute row that was in force: the latest `valid_from` on or before the event.

    Every event gets a version number, the count of the entity's changes up to its time; attribute rows are numbered in
    the order of their change; then both are equi-joined on entity and number. Only (entity, time) pairs take part in
    the numbering, once each, so it moves few bytes. It runs inside time ranges of `width_days`, with the counts of
    earlier ranges added, so that an entity with a third of all rows is spread over as many tasks as it has ranges.

    keys: columns of both tables. Of attribute rows with equal keys and time one stays, the first by `tie` (by default
    the columns themselves in order, nulls last). Events with a null key or time, or before the first change, keep
    nulls; attribute rows with a null key or time are never in force. Every event row stays, repeated ones too. The
    added columns are named `prefix` + name; other columns of `attributes` don't take part, whatever their names.
    """
    kind = events.schema[event_time].dataType.simpleString()
    tie = tie or [F.col(c).asc_nulls_last() for c in columns]
    known = lambda df, time: df.where(F.col(time).isNotNull() & F.expr(" and ".join(f"`{k}` is not null" for k in keys)))
    own = [f"_k{n}" for n in range(len(keys))]
    renamed = [F.col(k).alias(o) for k, o in zip(keys, own, strict=True)]
    bucket = _bucket(F.col("_t"), kind, width_days).alias("_b")

    rank = Window.partitionBy(*own, "_t").orderBy(*tie)
    wide = (
        known(attributes, valid_from)
        .select(*renamed, F.col(valid_from).cast(kind).alias("_t"), *dict.fromkeys(columns))
        .withColumn("_n", F.row_number().over(rank)).where("_n = 1").drop("_n")
    )
    changes = wide.select(*own, "_t").withColumn("_c", F.lit(1))
    asked = known(events, event_time).select(*renamed, F.col(event_time).alias("_t")).distinct().withColumn("_c", F.lit(0))
    narrow = changes.unionByName(asked).groupBy(*own, "_t").agg(F.max("_c").alias("_c")).withColumn("_b", bucket)

    earlier = Window.partitionBy(*own).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        narrow.groupBy(*own, "_b").agg(F.sum("_c").alias("_s"))
        .withColumn("_before", F.coalesce(F.sum("_s").over(earlier), F.lit(0))).drop("_s")
    )
    within = Window.partitionBy(*own, "_b").orderBy("_t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = (
        narrow.withColumn("_within", F.sum("_c").over(within))
        .join(before, [*own, "_b"])
        .select(*own, "_t", (F.col("_before") + F.col("_within")).alias("_version"))
    )
    versions = wide.join(numbered, [*own, "_t"]).drop("_t")
    named = [F.col(c).alias(f"_v{n}") for n, c in enumerate(columns)]
    at_time = numbered.join(versions.select(*own, "_version", *named), [*own, "_version"]).drop("_version")
    taken = {c: f"_v{n}" for n, c in enumerate(columns)}
    same = [F.col(f"_e.{k}") == F.col(f"_a.{o}") for k, o in zip(keys, own, strict=True)]
    condition = F.col(f"_e.{event_time}") == F.col("_a._t")
    for c in same:
        condition = condition & c
    joined = events.alias("_e").join(at_time.alias("_a"), condition, "left")
    return joined.select("_e.*", *(F.col(f"_a.{v}").alias(prefix + c) for c, v in taken.items()))
