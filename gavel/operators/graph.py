"""Graphs of links: components by pointer shortening, mutual neighbours, groups with a guard against chains."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gavel.sources.staging import stage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`node` and `component`, the smallest node it is linked with, directly or not.

    Alternates two steps until nothing changes: every node's larger neighbours are linked to its smallest one, then its
    smaller ones are. Links to a hub never meet in one row: both steps are a minimum per node and an equi-join.
    """
    links = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    current = stage(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    while True:
        # Large star: neighbours larger than a node go to the smallest of its neighbours and itself.
        both = current.select(F.col("hi").alias("n"), F.col("lo").alias("v")).union(current.select(F.col("lo"), F.col("hi")))
        least = both.groupBy("n").agg(F.least(F.min("v"), F.col("n")).alias("m"))
        large = both.join(least, "n").where("v > n").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.explode(F.array(F.struct(F.col("hi").alias("x"), F.col("m").alias("m")), F.struct(F.col("lo").alias("x"), F.col("m").alias("m")))).alias("e"))
        after = stage(small.select(F.col("e.x").alias("hi"), F.col("e.m").alias("lo")).where("hi <> lo").distinct(), "edges")
        if after.exceptAll(current).isEmpty() and current.exceptAll(after).isEmpty():
            break
        current = after
    return nodes.join(current.select(F.col("hi").alias("node"), F.col("lo").alias("c")), "node", "left").select("node", F.coalesce("c", "node").alias("component"))


def chain_ends(pointers: DataFrame, node: str = "id", into: str = "merged_into") -> DataFrame:
    """`node`, `end`, `steps`, `group`: every node's end of the chain of pointers, and the name of what it is joined with.

    A chain ends at a node without a pointer, or at an id that is no node. Nodes on a cycle, or that lead into one, have
    no end: `end` and `steps` are null. `group` is the end, or the smallest node of the cycle, so two nodes share it
    where pointers connect them. Pointers are doubled until none is open but those into cycles: as long as others are,
    every doubling closes some (the chain lengths have no gaps), so one that closes none shows the cycles.
    """
    rows = pointers.select(F.col(node).alias("node"), F.col(into).alias("to"))
    ends = rows.where("to is null").select("node", F.col("node").alias("end"), F.lit(0).cast("bigint").alias("steps"), F.col("node").alias("group"))
    hop = stage(rows.where("to is not null").select("node", "to", F.lit(1).cast("bigint").alias("steps"), F.least("node", "to").alias("low"), F.lit(False).alias("done")), "chains")
    left, reach = hop.count(), 1
    while left:
        on = hop.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("steps").alias("_s"), F.col("low").alias("_low"), F.col("done").alias("_done"))
        further = hop.where("not done").join(on, "to", "left").select(
            "node", F.coalesce("_to", "to").alias("to"), (F.col("steps") + F.coalesce("_s", F.lit(0))).alias("steps"), F.least("low", "_low").alias("low"), F.coalesce("_done", F.lit(True)).alias("done"))
        hop, before, reach = stage(hop.where("done").unionByName(further), "chains"), left, 2 * reach
        left = hop.where("not done").count()
        if left == before and reach >= left:  # every pointer is on its cycle and has seen all of it
            break
    closed = hop.where("done").select("node", F.col("to").alias("end"), "steps", F.col("to").alias("group"))
    open_, none = hop.where("not done"), F.lit(None)
    cycles = open_.select("node", "to").join(open_.select(F.col("node").alias("to"), F.col("low").alias("group")), "to").select("node", none.cast(rows.schema["to"].dataType).alias("end"), none.cast("bigint").alias("steps"), "group")
    return ends.unionByName(closed).unionByName(cycles)


def mutual_edges(near: DataFrame, most: float) -> DataFrame:
    """Links of nodes that are each among the other's neighbours (`a`, `b`, `dist`), closer than `most`: a < b, the larger distance."""
    near = stage(near.select("a", "b", "dist"), "near")  # read from both ends
    back = near.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("dist").alias("_d"))
    both = near.join(back, ["a", "b"]).where("a < b").select("a", "b", F.greatest("dist", "_d").alias("dist"))
    return both.where(F.col("dist") < most)


def guarded_groups(edges: DataFrame, largest: int, start: float, step: float = 0.02, floor: float = 0.04) -> DataFrame:
    """Components of links closer than `start`; those larger than `largest` are split again at smaller distances.

    `node`, `component`, one row for every node of a link: one without a link that is close enough is a group of its own,
    at `start` as in a group that is split. Stops at `floor`: what is still too large then stays. The number of rounds
    doesn't depend on the data.
    """
    limit, done, rest = start, None, edges
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).where("node is not null").distinct()
    while True:
        linked = components(rest.where(F.col("dist") < limit))
        found = stage(nodes.join(linked, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "groups")
        sizes = found.groupBy("component").agg(F.count("*").alias("n"))
        last = limit - step < floor - 1e-9
        fine = sizes if last else sizes.where(F.col("n") <= largest)
        kept = found.join(fine.select("component"), "component", "left_semi").select("node", "component")
        done = kept if done is None else done.unionByName(kept)
        if last:
            return done
        big = found.join(sizes.where(F.col("n") > largest).select("component"), "component", "left_semi").select("node")
        nodes = big
        rest = rest.join(big.select(F.col("node").alias("a")), "a", "left_semi").join(big.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b", "dist")
        limit -= step


def pair_scores(groups: DataFrame, gold: DataFrame) -> DataFrame:
    """Precision, recall and F0.5 of groups (`node`, `component`) against judged pairs (`a`, `b`, `same`)."""
    g = lambda side: groups.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"))
    joined = gold.join(g("a"), "a", "left").join(g("b"), "b", "left")
    together = F.coalesce(F.col("c_a") == F.col("c_b"), F.lit(False))
    counts = joined.agg(F.count_if(together & F.col("same")).alias("tp"), F.count_if(together & ~F.col("same")).alias("fp"), F.count_if(~together & F.col("same")).alias("fn"))
    p, r = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    return counts.select("tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.try_divide(1.25 * p * r, 0.25 * p + r), 6).alias("f_half"))


def carried(old: DataFrame, new: DataFrame, item: str, cluster: str) -> DataFrame:
    """Every old cluster with the new one that has most of its items (of equals the first): `old`, `new`, `shared`, `class`.

    same: both have the same items; grew: the new one has them all and more; kept: it has only of them; changed: it has
    more than half of them, and others; far: no new cluster has. Old clusters without any item in the new grouping drop out.
    """
    o, n = old.select(item, F.col(cluster).alias("old")), new.select(item, F.col(cluster).alias("new"))
    shared = o.join(n, item).groupBy("old", "new").agg(F.count("*").alias("shared"))
    best = shared.groupBy("old").agg(F.min_by(F.struct("new", "shared"), F.struct(-F.col("shared"), "new")).alias("b")).select("old", "b.*")
    size = lambda df, c: df.groupBy(c).agg(F.count("*").alias(f"_n_{c}"))
    both = best.join(size(o, "old"), "old").join(size(n, "new"), "new")
    all_old, all_new = F.col("shared") == F.col("_n_old"), F.col("shared") == F.col("_n_new")
    kind = F.when(all_old & all_new, "same").when(all_old, "grew").when(all_new, "kept").when(2 * F.col("shared") > F.col("_n_old"), "changed").otherwise("far")
    return both.select("old", "new", "shared", kind.alias("class"))


def split_pairs(judged: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs (`a`, `b`) judged different that are in one group (`node`, `component`): `a`, `b`, `component`."""
    side = lambda c: groups.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    return judged.join(side("a"), "a").join(side("b"), "b").where("_a = _b").select("a", "b", F.col("_a").alias("component"))


def weighted_scores(pairs: DataFrame, limits: list[float]) -> DataFrame:
    """Precision and recall at each limit of `dist` from pairs with `band`, `same` and `judged`: `most`, `tp`, `fp`, `fn`, `precision`, `recall`.

    Only judged pairs count, each for as many as its band has for each judged one; bands without judged pairs don't count.
    """
    n = pairs.groupBy("band").agg(F.try_divide(F.count("*").cast("double"), F.count_if("judged")).alias("w"))
    rows = pairs.where("judged").join(n, "band").select("w", "dist", "same", F.explode(F.array(*map(F.lit, limits))).alias("most"))
    near, total = F.col("dist") < F.col("most"), lambda c: F.coalesce(F.sum(F.when(c, F.col("w"))), F.lit(0.0))
    sums = rows.groupBy("most").agg(total(near & F.col("same")).alias("tp"), total(near & ~F.col("same")).alias("fp"), total(~near & F.col("same")).alias("fn"))
    r = lambda a, b: F.round(F.try_divide(F.col(a), F.col(a) + F.col(b)), 6)
    return sums.select("most", *(F.round(c, 6).alias(c) for c in ("tp", "fp", "fn")), r("tp", "fp").alias("precision"), r("tp", "fn").alias("recall"))


#: Rows of one block of an exact comparison.
BLOCK_ROWS = 4_096
#: Pairs of vectors that an exact comparison may have: a million by a million.
MOST_PAIRS = 10**12


def _blocks_nearest(k: int, digits: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        shape = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("dist", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return shape.empty_table()
        a, b = left["a"].to_numpy(), right["b"].to_numpy()
        x, y = (t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1).astype(np.float64) for t, c in ((left, "va"), (right, "vb")))
        by = np.argsort(b, kind="stable")  # so that a stable sort by distance breaks ties by id
        b, y = b[by], y[by]
        out = []
        for at in range(0, len(a), 512):
            d = np.round(1.0 - x[at : at + 512] @ y.T, digits)
            d[a[at : at + 512, None] == b[None, :]] = np.inf
            if d.shape[1] > 4 * k:
                # Everything up to the k-th smallest distance, ties included, then sorted exactly.
                edge = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
                most = int((d <= edge).sum(axis=1).max())
                some = np.sort(np.argpartition(d, most - 1, axis=1)[:, :most], axis=1)
                order = np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, 1), axis=1, kind="stable")[:, :k], 1)
            else:
                order = np.argsort(d, axis=1, kind="stable")[:, :k]
            near = np.take_along_axis(d, order, 1)
            keep = np.isfinite(near)
            out.append((np.repeat(a[at : at + 512], keep.sum(1)), b[order][keep], near[keep]))
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], schema=shape)

    return run


def nearest(left: DataFrame, right: DataFrame, k: int, digits: int = 5) -> DataFrame:
    """The `k` rows of `right` (`b`, `vb`) nearest to each of `left` (`a`, `va`) by cosine distance of unit vectors: `a`, `b`, `dist`, `place`.

    Exact: blocks of both sides are multiplied as matrices, and only the `k` best of each block travel. The work grows
    with the product of the sides, so more than `MOST_PAIRS` are refused: an index is the way then. Distances are rounded
    to `digits`; ties go to the smaller `b`; equal ids never pair.
    """
    left, right = stage(left, "nearest"), stage(right, "nearest")
    n, m = left.count(), right.count()
    if n * m > MOST_PAIRS:
        raise ValueError(f"{n} x {m} vectors are too many to compare each with each; use an index of vectors")
    p, q = max(1, -(-n // BLOCK_ROWS)), max(1, -(-m // BLOCK_ROWS))
    blocks = lambda c, own, other, parts, others: (F.pmod(F.xxhash64(c), F.lit(parts)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))
    l = left.select(F.col("a").cast("bigint").alias("a"), "va", *blocks("a", "lb", "rb", p, q))
    r = right.select(F.col("b").cast("bigint").alias("b"), "vb", *blocks("b", "rb", "lb", q, p))
    best = l.groupBy("lb", "rb").cogroup(r.groupBy("lb", "rb")).applyInArrow(_blocks_nearest(k, digits), "a bigint, b bigint, dist double")
    w = Window.partitionBy("a").orderBy("dist", "b")
    return best.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def chain_order(ids: list[int], vectors: list[list[float]]) -> list[int]:
    """Ids in a chain of nearest neighbours, from the one least like the mean; ties go to the lower id."""
    order = np.argsort(ids, kind="stable")
    names, x = np.asarray(ids)[order], np.asarray(vectors, np.float64)[order]
    if len(names) < 3:
        return names.tolist()
    left, at = np.ones(len(names), bool), int(np.argmin(x @ x.mean(axis=0)))
    out = []
    while True:
        out.append(int(names[at]))
        left[at] = False
        if not left.any():
            return out
        at = int(np.argmax(np.where(left, x @ x[at], -np.inf)))


def chained(points: DataFrame, group: str) -> DataFrame:
    """`group`, `id`, `place`: the points (`id`, `v`) of each group in a chain. For groups of a page's size."""

    def run(part: pa.Table) -> pa.Table:
        ids = chain_order(part["id"].to_pylist(), part["v"].to_pylist())
        key = part[group][0]
        return pa.table({group: pa.array([key.as_py()] * len(ids), part.schema.field(group).type), "id": pa.array(ids, pa.int64()), "place": pa.array(range(len(ids)), pa.int32())})

    kind = points.schema[group].dataType.simpleString()
    return points.select(group, F.col("id").cast("bigint").alias("id"), "v").groupBy(group).applyInArrow(run, f"{group} {kind}, id bigint, place int")


def join_nearest_first(pairs: list[tuple[int, int, float]], sizes: dict[int, int], largest: int, apart: set[frozenset[int]] = frozenset()) -> dict[int, int]:
    """Units joined nearest pair first, unless the group would grow beyond `largest` or hold a pair that must stay apart.

    The order of the pairs decides, so this runs inside one component at a time (see `constrained`).
    """
    group, members = {u: u for u in sizes}, {u: {u} for u in sizes}
    for a, b, _ in sorted(pairs, key=lambda p: (p[2], p[0], p[1])):
        x, y = group[a], group[b]
        if x == y or sum(sizes[u] for u in members[x] | members[y]) > largest or any(frozenset((u, v)) in apart for u in members[x] for v in members[y]):
            continue
        for u in members[y]:
            group[u] = x
        members[x] |= members.pop(y)
    return {u: min(members[g]) for u, g in group.items()}


def constrained(edges: DataFrame, sizes: DataFrame, largest: int, apart: DataFrame | None = None) -> DataFrame:
    """`unit`, `component`: units joined along links (`a`, `b`, `dist`) under a limit of size, one component per call.

    sizes: `unit`, `size`. apart: `a`, `b`, pairs that never share a group.
    """
    whole = components(edges).withColumnRenamed("node", "unit").withColumnRenamed("component", "_c")
    units = sizes.join(whole, "unit", "left").withColumn("_c", F.coalesce("_c", "unit"))
    at = whole.select(F.col("unit").alias("a"), "_c")
    linked = edges.join(at, "a").select("_c", "a", "b", F.col("dist").cast("double").alias("dist"))
    if apart is not None:
        linked = linked.unionByName(apart.join(at, "a").select("_c", "a", "b", F.lit(None).cast("double").alias("dist")))

    def run(u: pa.Table, e: pa.Table) -> pa.Table:
        size = dict(zip(u["unit"].to_pylist(), u["size"].to_pylist(), strict=True))
        rows = [r for r in e.to_pylist() if r["a"] in size and r["b"] in size]
        out = join_nearest_first([(r["a"], r["b"], r["dist"]) for r in rows if r["dist"] is not None], size, largest, {frozenset((r["a"], r["b"])) for r in rows if r["dist"] is None})
        return pa.table({"unit": pa.array(list(out), pa.int64()), "component": pa.array(list(out.values()), pa.int64())})

    units = units.select("_c", F.col("unit").cast("bigint").alias("unit"), F.col("size").cast("bigint").alias("size"))
    linked = linked.select("_c", F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"), "dist")
    return units.groupBy("_c").cogroup(linked.groupBy("_c")).applyInArrow(run, "unit bigint, component bigint")


def first_fit(sizes: list[int], capacity: int) -> list[int]:
    """The box of each item in the given order: the first with room, else a new one (also for items larger than a box)."""
    room, out = [], []
    for s in sizes:
        k = next((k for k, r in enumerate(room) if r >= s), len(room))
        if k == len(room):
            room.append(capacity)
        room[k] -= s
        out.append(k)
    return out


def packed(groups: DataFrame, apart: str, name: str, size: str, capacity: int) -> DataFrame:
    """`groups` with `box`: within each value of `apart`, groups go largest first (equal ones by `name`, null first) to the first box with room.

    For as many groups in one value as fit a task.
    """

    def run(part: pa.Table) -> pa.Table:
        rows = sorted(part.to_pylist(), key=lambda r: (-r[size], r[name] is not None, r[name] or ""))
        out = pa.Table.from_pylist(rows, part.schema)
        return out.append_column("box", pa.array(first_fit([r[size] for r in rows], capacity), pa.int32()))

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in groups.schema)
    return groups.groupBy(apart).applyInArrow(run, f"{shape}, box int")
