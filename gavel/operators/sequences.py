"""Operators on ordered rows: islands, runs, sliding calendar windows, stitching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gavel.sources.staging import stage


def islands(df: DataFrame, keys: Sequence[str], at: str, gap: int, name: str = "block") -> DataFrame:
    """`df` with the number of each row's block: days more than `gap` days apart start a new one. Null days drop out."""
    w = Window.partitionBy(*keys).orderBy(at)
    new = F.coalesce((F.datediff(F.col(at), F.lag(at).over(w)) > gap).cast("int"), F.lit(0))
    out = df.where(F.col(at).isNotNull()).withColumn("_new", new)
    return out.withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Consecutive equal values as one row: `keys`, `run` (from 0), `value`, `first`, `last` (of the first order column), `n`."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = (~F.col(value).eqNullSafe(F.lag(value).over(w))) & (F.row_number().over(w) > 1)
    numbered = df.withColumn("_c", changed.cast("int")).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return numbered.groupBy(*keys, "run").agg(F.first(value).alias(value), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("n"))


def sliding_months(monthly: DataFrame, keys: Sequence[str], month: str, value: str, months: int = 12, name: str = "window_sum") -> DataFrame:
    """`monthly` with the sum of `value` over the `months` months up to each row's; absent months count 0.

    `month` is a month number (year * 12 + month), so the window is a range of numbers and no grid is needed for sums.
    """
    w = Window.partitionBy(*keys).orderBy(month).rangeBetween(-(months - 1), 0)
    return monthly.withColumn(name, F.sum(value).over(w))


#: Positions in one block of a group (see below).
BLOCK = 2_048


def _in_blocks(rows: DataFrame, order: str, width: int) -> DataFrame:
    return rows.withColumn("_block", F.floor(F.col(order) / width))


def _by_block(group: str, order: str):
    return Window.partitionBy(group, "_block").orderBy(order)


def running_sum(rows: DataFrame, group: str, order: str, value: str, name: str, width: int = BLOCK) -> DataFrame:
    """`rows` with `name`, the sum of `value` over the rows of the group up to each (itself included).

    Like `filled` and `with_previous`: `order` is a number that is unique in its group. Rows are ordered inside blocks
    of `width` positions, and what a block needs of earlier ones is one row a block, so no task holds a whole group.
    """
    rows = _in_blocks(rows, order, width)
    sums = rows.groupBy(group, "_block").agg(F.sum(value).alias("_s"))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(group, "_block", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_earlier"))
    here = F.sum(value).over(_by_block(group, order).rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn(name, here).join(sums, [group, "_block"])
    return out.withColumn(name, F.coalesce(F.col(name), F.lit(0)) + F.col("_earlier")).drop("_earlier", "_block")


def filled(rows: DataFrame, group: str, order: str, value: str, name: str, width: int = BLOCK) -> DataFrame:
    """`rows` with `name`, the last value of the group that is not null, up to each row (itself included)."""
    rows = _in_blocks(rows, order, width)
    last = rows.groupBy(group, "_block").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_l"))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select(group, "_block", F.last("_l", True).over(before).alias("_earlier"))
    here = F.last(value, True).over(_by_block(group, order).rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("_local", here).join(last, [group, "_block"])
    return out.withColumn(name, F.coalesce("_local", "_earlier")).drop("_local", "_earlier", "_block")


def with_previous(rows: DataFrame, group: str, order: str, values: Sequence[str], width: int = BLOCK) -> DataFrame:
    """`rows` with `prev_` + each value of the row before in the group (null at its start)."""
    rows, packed = _in_blocks(rows, order, width), F.struct(*values)
    last = rows.groupBy(group, "_block").agg(F.max_by(packed, order).alias("_l"))
    last = last.select(group, "_block", F.lag("_l").over(Window.partitionBy(group).orderBy("_block")).alias("_earlier"))
    out = rows.withColumn("_p", F.lag(packed).over(_by_block(group, order))).join(last, [group, "_block"])
    before = F.coalesce("_p", "_earlier")
    return out.select("*", *(before[v].alias(f"prev_{v}") for v in values)).drop("_p", "_earlier", "_block")


def stitch(turns: DataFrame, group: str = "debate_id", order: str = "seq", bridge_words: int = 25, width: int = BLOCK) -> DataFrame:
    """Turns into speeches, one row each: `group`, `person_id`, `seq_start`, `seq_end`, `turn_count`, `interruption_count`, `word_count`.

    Columns used: `person_id`, `role_kind`, `word_count`; (group, order) must be unique. A speech is its owner's turns,
    across bridges: turns with a role, and turns of at most `bridge_words` words by others. A longer turn of another
    identified person starts that person's speech; a longer turn of an unnamed person is a speech of its own and ends
    the one before. Turns with a role never own a speech, and short turns of unnamed persons don't either. Bridges count
    as interruptions only between the first and last owned turn.

    What is open changes in two ways only: unnamed long turns cut the group into sections; inside a section the owner at
    a turn is the person of the last long turn by an identified person, or else of the section's first identified turn.
    Both are carried over blocks of positions, so a group may hold a third of all rows.
    """
    rows = turns.select(
        group, order, F.coalesce("word_count", F.lit(0)).alias("_words"), "person_id", F.when(F.col("role_kind").isNull(), F.col("person_id")).alias("_person"),
        (F.col("role_kind").isNull() & F.col("person_id").isNull() & (F.coalesce("word_count", F.lit(0)) > bridge_words)).cast("int").alias("_alone"))
    # Each step reads its rows twice (blocks and rows), so what it reads is written first.
    rows = stage(running_sum(stage(rows, "stitch"), group, order, "_alone", "_section", width), "stitch")
    unnamed = rows.where("_alone = 1").select(
        group, "person_id", F.col(order).alias("seq_start"), F.col(order).alias("seq_end"),
        F.lit(1).cast("bigint").alias("turn_count"), F.lit(0).cast("bigint").alias("interruption_count"), F.col("_words").cast("bigint").alias("word_count"))
    rows = rows.where("_alone = 0")
    first = rows.where("_person is not null").groupBy(group, "_section").agg(F.min(order).alias("_first"))
    rows = rows.join(first, [group, "_section"])
    takes = F.col("_person").isNotNull() & ((F.col(order) == F.col("_first")) | (F.col("_words") > bridge_words))
    rows = filled(stage(rows, "stitch").withColumn("_mark", F.when(takes, F.struct("_section", "_person"))), group, order, "_mark", "_at", width)
    rows = rows.where(F.col("_at._section") == F.col("_section")).select(group, order, "_section", "_words", F.col("_at._person").alias("_owner"), F.coalesce(F.col("_person") == F.col("_at._person"), F.lit(False)).alias("_own"))
    rows = stage(with_previous(stage(rows, "stitch"), group, order, ["_section", "_owner"], width), "stitch")
    new = F.col("prev__section").isNull() | (F.col("prev__section") != F.col("_section")) | (F.col("prev__owner") != F.col("_owner"))
    rows = stage(running_sum(rows.withColumn("_new", new.cast("int")), group, order, "_new", "_speech", width), "stitch")
    own = rows.where("_own").groupBy(group, "_speech").agg(
        F.max("_owner").alias("person_id"), F.min(order).alias("seq_start"), F.max(order).alias("seq_end"), F.count("*").alias("turn_count"), F.sum("_words").cast("bigint").alias("word_count"))
    inside = rows.where("not _own").join(own.select(group, "_speech", "seq_end"), [group, "_speech"]).where(F.col(order) < F.col("seq_end")).groupBy(group, "_speech").agg(F.count("*").alias("interruption_count"))
    named = own.join(inside, [group, "_speech"], "left").withColumn("interruption_count", F.coalesce("interruption_count", F.lit(0).cast("bigint")))
    return named.select(*unnamed.columns).unionByName(unnamed)


def head_of(turns: DataFrame, group: str, order: str, words: str, least_turns: int, least_words: int, most_words: int) -> DataFrame:
    """The head of each group: its first `least_turns` rows, extended until `least_words` words are reached, cut at `most_words`.

    Adds `words_before`, the words of earlier rows. Rows beyond the limit of words go, but never the first row.
    """
    out = running_sum(turns.withColumn("_one", F.lit(1)), group, order, "_one", "_n")
    out = running_sum(out, group, order, words, "_upto")
    out = out.withColumn("words_before", F.col("_upto") - F.coalesce(words, F.lit(0))).drop("_upto", "_one")
    keep = ((F.col("_n") <= least_turns) | (F.col("words_before") < least_words)) & ((F.col("words_before") < most_words) | (F.col("_n") == 1))
    return out.where(keep).drop("_n")
