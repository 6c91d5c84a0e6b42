"""Pairwise links into groups: connected components by union-find in bounded partitions.

Each round deals the links evenly to partitions of a bounded number, by the hash of the whole link, so the links of a
record that has a third of all of them are spread like any others. A partition runs union-find over its links and
keeps a spanning forest: one link from each record to the representative of its local group. A record whose
representatives agree is settled. Where they differ, the record goes to one of them, and only the links between
representatives remain for the next round. Representatives are chosen by a hash that changes with the round, which
shrinks even a single long chain by a constant share each time; once the rest fits one partition, it is the last. The
rounds are then read backwards, from representatives of representatives to records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.operators.relational import spread_lookup
from gavel.sources.staging import stage

#: Links in a partition.
PARTITION_LINKS = 500_000


def spanning_forest(a: np.ndarray, b: np.ndarray, n: int, order: np.ndarray) -> np.ndarray:
    """The representative of each of `n` numbered records under the links a-b: the one of lowest `order` in its group."""
    parent = list(range(n))
    rank = order.tolist()
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            if rank[x] > rank[y]:
                x, y = y, x
            parent[y] = x
    roots = np.array(parent, dtype=np.int64)
    while True:
        up = roots[roots]
        if np.array_equal(up, roots):
            return roots
        roots = up


def _local(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        links = pa.Table.from_batches(held)
        both = np.concatenate([links["a"].to_numpy(), links["b"].to_numpy()])
        numbers, names = pd.factorize(both)
        order = np.argsort(np.argsort(pd.util.hash_array(names, hash_key=f"gavel-round-{level:04d}"[:16]), kind="stable"))
        n = len(links)
        roots = spanning_forest(numbers[:n], numbers[n:], len(names), order)
        names = pa.array(names, pa.string())
        for at in range(0, len(roots), 50_000):
            some = pa.array(roots[at : at + 50_000])
            yield pa.RecordBatch.from_arrays([names.take(some), names.slice(at, 50_000)], ["root", "node"])

    return run


def components(links: DataFrame, a: str, b: str, partition_links: int = PARTITION_LINKS) -> DataFrame:
    """`node` and `component` (strings) for every record that occurs in a link; equal components are connected.

    A link with a null end only makes its other end occur; a record linked with itself occurs. Repeated links are
    harmless. The component's name is one of its records.
    """
    pairs = links.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))
    pairs = pairs.select(F.coalesce("a", "b").alias("a"), F.coalesce("b", "a").alias("b")).where("a is not null")
    # Within the partitions as they come: most repeated and redundant links never travel.
    first = pairs.mapInArrow(_chunked(partition_links), "root string, node string").select(
        F.col("root").alias("a"), F.col("node").alias("b")
    )
    edges, level, settled = stage(first, "forest"), 1, []
    while True:
        parts = max(1, -(-edges.count() // partition_links))
        if parts == 1:
            final = edges.repartition(1)
        else:
            final = edges.repartition(parts, F.xxhash64("a", "b", F.lit(level)))
        forest = final.mapInArrow(_local(level), "root string, node string")
        if parts == 1:
            labels = stage(forest.select("node", F.col("root").alias("component")), "labels")
            break
        forest = stage(forest.distinct(), "forest")
        best = forest.groupBy("node").agg(
            F.min(F.struct(F.xxhash64("root", F.lit(level)).alias("h"), F.col("root"))).alias("best"), F.count("*").alias("n")
        ).select("node", F.col("best.root").alias("parent"), "n")
        best = stage(best, "parents")
        settled.append(best.select("node", "parent"))
        torn = forest.join(best.where("n > 1").select("node", "parent"), "node").where("root <> parent")
        edges = stage(torn.select(F.col("parent").alias("a"), F.col("root").alias("b")).distinct(), "forest")
        level += 1
    for parents in reversed(settled):
        # A parent may have a third of all records, so what is known of it goes to them, not they to it.
        below = parents.join(labels.select("node"), "node", "left_anti")
        sizes = below.groupBy("parent").agg(F.count("*").alias("_n"))
        known = sizes.join(labels.withColumnRenamed("node", "parent"), "parent", "left").withColumn("component", F.coalesce("component", "parent"))
        labels = stage(labels.unionByName(spread_lookup(below, known, "parent", "_n").select("node", "component")), "labels")
    return labels


def _chunked(most: int):
    """Union-find over the rows of a task, at most `most` links at a time."""
    local = _local(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= most:
                yield from local(iter(held))
                held, n = [], 0
        yield from local(iter(held))

    return run
