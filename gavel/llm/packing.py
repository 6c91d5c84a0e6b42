"""Filling containers of a fixed capacity with items of varying size.

Best-fit decreasing: items in falling order of size, each into the open container with the least room that still
suffices, found in logarithmic time by a segment tree over the possible amounts of room. Items of one size are alike,
so the decision needs only how many there are of each size, a table no longer than the capacity, and treats containers
that are filled alike as one pattern. The items themselves are never gathered: each gets its rank within its size from
narrow counts, and its container from the pattern that holds this rank.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gavel.sources.staging import stage


class Room:
    """A segment tree over the amounts of room 0..capacity: which of them some open container has.

    Node k of the tree is true if any amount of room in its range occurs; `tightest(size)` finds the least amount that
    is at least `size`.
    """

    def __init__(self, capacity: int):
        self.size = 1 << (capacity).bit_length()
        self.any = bytearray(2 * self.size)

    def add(self, room: int) -> None:
        node = room + self.size
        while node and not self.any[node]:
            self.any[node] = 1
            node >>= 1

    def remove(self, room: int) -> None:
        node = room + self.size
        self.any[node] = 0
        while node > 1 and not self.any[node ^ 1]:
            node >>= 1
            self.any[node] = 0

    def tightest(self, size: int) -> int:
        """The least amount of room that is at least `size`, or -1."""
        node = size + self.size
        if self.any[node]:
            return size
        while node > 1:
            if not node & 1 and self.any[node + 1]:
                node += 1
                break
            node >>= 1
        else:
            return -1
        while node < self.size:
            node = 2 * node + (not self.any[2 * node])
        return node - self.size


@dataclass
class Pattern:
    """`many` containers that hold the same: how many items of which size, as pairs."""

    many: int
    held: tuple[tuple[int, int], ...]


def patterns(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over `counts` items of each size: the containers, alike ones together.

    Container by container this is what placing the items one by one gives. Of containers with the same room the one
    that was filled last is taken on; once an item is in, the room left is the tightest for the next of its size, so a
    container takes as many of them as fit before the next one is touched.
    """
    room, tree, done = {}, Room(capacity), []  # room: amount of room -> patterns with it

    def put(left: int, pattern: Pattern) -> None:
        if left == 0:
            done.append(pattern)
            return
        if left not in room:
            room[left] = []
            tree.add(left)
        room[left].append(pattern)

    def fill(left: int, held: tuple[tuple[int, int], ...], many: int, size: int, items: int) -> int:
        """Puts up to `items` items into `many` containers with room `left`; how many went in."""
        each = left // size
        whole = min(many, items // each)
        rest = items - whole * each if whole < many and items - whole * each < each else 0
        if whole:
            put(left - each * size, Pattern(whole, (*held, (size, each))))
        if rest:
            put(left - rest * size, Pattern(1, (*held, (size, rest))))
        untouched = many - whole - bool(rest)
        if untouched and held:
            put(left, Pattern(untouched, held))
        return whole * each + rest

    for size in sorted(counts, reverse=True):
        items = counts[size]
        while items:
            left = tree.tightest(size)
            if left < 0:
                each = capacity // size
                items -= fill(capacity, (), -(-items // each), size, items)
                continue
            pattern = room[left].pop()
            if not room[left]:
                del room[left]
                tree.remove(left)
            items -= fill(left, pattern.held, pattern.many, size, items)
    return done + [p for ps in room.values() for p in ps]


def _slots(found: list[Pattern], capacity: int) -> tuple[np.ndarray, ...]:
    """For each size in turn its slots: rank of the first item, number of the first container, items a container.

    The first array says where each size's slots begin. Ranks run over the containers of a pattern one after another.
    """
    first, at = [], 0
    by_size: dict[int, list[tuple[int, int, int]]] = {}
    for p in found:
        first.append(at)
        at += p.many
    for start, p in zip(first, found, strict=True):
        for size, each in p.held:
            by_size.setdefault(size, []).append((p.many * each, start, each))
    begins, ranks, containers, many = [0], [], [], []
    for size in range(1, capacity):
        rank = 0
        for items, start, each in by_size.get(size, ()):
            ranks.append(rank)
            containers.append(start)
            many.append(each)
            rank += items
        begins.append(len(ranks))
    return np.array(begins), np.array(ranks, np.int64), np.array(containers, np.int64), np.array(many, np.int64)


def _numbered(capacity: int, fields: list[str]):
    """Adds the number of the task, and each row's number among the rows of its size there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, task = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            sizes = batch.column(3).to_numpy(zero_copy_only=False)
            order = np.argsort(sizes, kind="stable")
            ordered = sizes[order]
            starts = np.flatnonzero(np.diff(ordered, prepend=-1)) if len(ordered) else np.zeros(0, np.int64)
            within = np.arange(len(ordered)) - np.repeat(starts, np.diff(np.append(starts, len(ordered))))
            local = np.empty(len(sizes), np.int64)
            local[order] = within + seen[ordered]
            seen += np.bincount(sizes, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(sizes), task, np.int32)), pa.array(local)], fields)

    return run


def pack(df: DataFrame, id_col: str, size_col: str, capacity: int) -> DataFrame:
    """Every item, or piece of an item, with its container: `id_col`, `piece`, `start`, `size`, `bin`.

    An item larger than `capacity` is cut into full containers (pieces 0, 1, ..., each at offset `start` of the item)
    and a rest; no other item is cut. Items of size null or 0 need no container: one row with `bin` null. Equal ids are
    separate items. `bin` is a string that is the same for exactly the rows of one container. Negative sizes count as 0.
    """
    kind = df.schema[id_col].dataType.simpleString()
    items = df.select(F.col(id_col), F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(0)).cast("bigint").alias("whole"))
    pieces = items.select(id_col, "whole", F.explode(F.expr(f"sequence(0, cast(greatest(whole - 1, 0) div {capacity} as int))")).alias("piece"))
    pieces = pieces.select(
        id_col, "piece", (F.col("piece").cast("bigint") * capacity).alias("start"), F.least(F.col("whole") - F.col("piece").cast("bigint") * capacity, F.lit(capacity)).alias("size")
    )
    fields = [id_col, "piece", "start", "size", "_task", "_local"]
    shape = f"`{id_col}` {kind}, piece int, start bigint, size bigint, _task int, _local bigint"
    rows = stage(pieces.mapInArrow(_numbered(capacity, fields), shape), "pieces")
    counts = rows.groupBy("size", "_task").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("size").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    totals = counts.where(f"size > 0 and size < {capacity}").groupBy("size").agg(F.sum("n").alias("n")).collect()  # at most one row a size
    held = df.sparkSession.sparkContext.broadcast(_slots(patterns({r["size"]: r["n"] for r in totals}, capacity), capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins, ranks, containers, many = held.value
        for batch in batches:
            sizes, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4))
            bins = np.full(len(sizes), None, object)
            for size in np.unique(sizes).tolist():
                here = np.flatnonzero(sizes == size)
                if size == capacity:
                    bins[here] = [f"w{r}" for r in rank[here]]
                elif size:
                    part = slice(begins[size - 1], begins[size])
                    at = np.searchsorted(ranks[part], rank[here], side="right") - 1
                    numbers = containers[part][at] + (rank[here] - ranks[part][at]) // many[part][at]
                    bins[here] = [f"c{n}" for n in numbers]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(bins, pa.string())], [id_col, "piece", "start", "size", "bin"])

    ranked = rows.join(offsets.drop("n"), ["size", "_task"]).select(id_col, "piece", "start", "size", (F.col("_local") + F.col("_before")).alias("_rank"))
    return ranked.mapInArrow(place, f"`{id_col}` {kind}, piece int, start bigint, size bigint, bin string")
