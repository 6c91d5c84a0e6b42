"""Splitting large groups again loses no member."""

import random

from gavel.operators import graph


def brute(nodes, edges, largest, limit, step, floor):
    """The groups (sets) of the rule, split one at a time."""
    group = {n: {n} for n in nodes}
    for a, b, d in edges:
        if d < limit and group[a] is not group[b]:
            group[a] |= group[b]
            for n in group[b]:
                group[n] = group[a]
    out = []
    for g in {id(g): g for g in group.values()}.values():
        if len(g) <= largest or limit - step < floor - 1e-9:
            out.append(frozenset(g))
        else:
            out += brute(g, [e for e in edges if e[0] in g and e[1] in g], largest, limit - step, step, floor)
    return out


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["component"], []).append(r["node"])
    assert all(len(set(m)) == len(m) for m in out.values())
    return {frozenset(m) for m in out.values()}


def test_members_without_close_links_are_groups_of_their_own(rows):
    e = [(1, 2, 0.01), (2, 3, 0.01), (3, 4, 0.15), (4, 5, 0.15), (10, 11, 0.15), (20, 21, 0.5)]
    assert groups(graph.guarded_groups(rows("a int, b int, dist double", *e), 4, 0.2, 0.1, 0.1)) == {frozenset(g) for g in ([1, 2, 3], [4], [5], [10, 11], [20], [21])}


def test_guard_against_brute_force(rows):
    random.seed(5)
    pairs = {tuple(sorted(random.sample(range(60), 2))) for _ in range(70)}
    e = [(a, b, round(random.random() * 0.25, 3)) for a, b in sorted(pairs)]
    got = groups(graph.guarded_groups(rows("a int, b int, dist double", *e), 4, 0.2, 0.04, 0.04))
    assert got == set(brute({n for p in pairs for n in p}, e, 4, 0.2, 0.04, 0.04))
