"""Linking, radius joins, the search for groups and neighbour joining, each against the plainest way to do it."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from phylospark.operators import distance, joining, linking


def evolved(r, n, loci, most=4):
    """Profiles of a random tree: each takes another's and adds to some intervals."""
    out = [[2] * loci]
    for _ in range(n - 1):
        p = list(r.choice(out))
        for _ in range(r.randint(0, 2)):
            a, k = r.randrange(loci), r.choice([-1, 1, -2])
            for i in range(a, min(loci, a + r.randint(1, 3))):
                p[i] = max(0, min(most, p[i] + k))
        out.append(p)
    return out


def biopsies(r, sizes, loci, runs=3):
    rows = []
    for run in range(runs):
        own, number = evolved(r, sum(sizes), loci), iter(r.sample(range(1000), sum(sizes)))
        names = [[(next(number), p) for p in own[sum(sizes[:k]) : sum(sizes[: k + 1])]] for k in range(len(sizes))]
        names[-1][0] = names[0][-1]  # one cell is sampled twice
        rows += [(f"r{run}", level, k, c, p) for level, cells in enumerate(names) for k, (c, p) in enumerate(cells)]
    return rows


BIOPSY = "run_id string, level int, ord int, cell_id long, genome array<int>"


def one_after_another(rows, d, radius):
    """Cells of a run in turn, copies made as they are needed: {node: (parent, weight, cell)} and the nodes of the earliest biopsy."""
    layers = [[(c, p) for level, _, c, p in rows if level == k] for k in range(1 + max(x[0] for x in rows))]
    fresh, named, nodes = max(c for own in layers for c, _ in own) + 1, set(), []
    for own in reversed(layers):
        mine = []
        for c, p in own:
            node, fresh = (fresh, fresh + 1) if c in named else (c, fresh)
            named.add(c)
            mine.append((node, c, p))
        nodes.insert(0, mine)
    found = {}
    for k in range(len(nodes) - 1, 0, -1):
        for node, c, p in nodes[k]:
            able = [(x != c, 0 if x == c else d(x, c), at) for at, (_, x, q) in enumerate(nodes[k - 1]) if d(x, c) <= radius and (x == c or not any(a == 0 < b for a, b in zip(q, p, strict=True)))]
            if able:
                up, x, _ = nodes[k - 1][min(able)[2]]
                found[node] = up, float(d(x, c)), c
            else:
                nodes[k - 1].append((fresh, c, p))
                found[node] = fresh, 0.0, c
                fresh += 1
    return found, [(n, c) for n, c, _ in nodes[0]], fresh


def symmetric(rows):
    """Distances by identifier, from the earlier to the later cell; the first profile of an identifier counts."""
    place, profile = {}, {}
    for k, (_, _, c, p) in enumerate(sorted(rows)):
        place.setdefault(c, k)
        profile.setdefault(c, p)

    def d(a, b):
        a, b = sorted((a, b), key=place.get)
        return 0 if a == b else distance.distance(profile[a], profile[b])

    return d


@pytest.mark.parametrize(("sizes", "loci", "radius"), [((4, 5, 6), 6, 2), ((3, 12, 12, 9), 5, 1), ((6,), 4, 3)])
def test_trees_equal_cells_taken_in_turn(spark, sizes, loci, radius):
    r = random.Random(sum(sizes))
    rows = biopsies(r, sizes, loci)
    cells = spark.createDataFrame(rows, BIOPSY).repartition(3)
    once = cells.groupBy("run_id", "cell_id").agg(F.min_by(F.struct("level", "ord", "genome"), F.struct("level", "ord")).alias("c")).select("run_id", "cell_id", "c.*")
    once = once.withColumn("ord", F.row_number().over(Window.partitionBy("run_id").orderBy("level", "ord")) - 1)
    trees = [{(x["run_id"], x["node_id"]): (x["parent_id"], x["weight"], x["cell_id"]) for x in t.collect()} for t in (linking.reconstruct(cells, distance.matrix(once), radius), linking.reconstruct_within(cells, radius))]
    assert trees[0] == trees[1]
    for run in {x[0] for x in rows}:
        own = [x[1:] for x in rows if x[0] == run]
        d = symmetric(own)
        wanted, first, fresh = one_after_another(own, d, radius)
        joined = joining.neighbour_joining(np.array([[d(a, b) for _, b in first] for _, a in first], float), [n for n, _ in first], fresh + 1)
        cell = dict(first)
        wanted |= {child: (up, w, cell.get(child)) for up, child, w in joined.edges}
        got = {node: x for (name, node), x in trees[0].items() if name == run and node != -1}
        assert got == wanted


def test_a_run_of_two_thousand_cells(spark):
    """Every node has one parent, every cell of a later biopsy is linked, and no parent lost what its child has."""
    r = random.Random(9)
    own = evolved(r, 2000, 60)
    rows = [("r", int(k >= 40) + int(k >= 900), k, k, p) for k, p in enumerate(own)]
    tree = linking.reconstruct_within(spark.createDataFrame(rows, BIOPSY).repartition(4), 2).collect()
    up = {x["node_id"]: x["parent_id"] for x in tree}
    assert len(up) == len(tree) and {x["cell_id"] for x in tree} - {None} == set(range(2000)) and [n for n, p in up.items() if p is None] == [-1]
    cell = {x["node_id"]: x["cell_id"] for x in tree}
    for x in tree:
        a, b = cell.get(x["parent_id"]), x["cell_id"]
        assert a is None or b is None or a == b or (x["weight"] == distance.distance(*(own[k] for k in sorted((a, b)))) <= 2 and not any(p == 0 < q for p, q in zip(own[a], own[b], strict=True)))


@pytest.mark.parametrize(("loci", "radius", "most"), [(12, 2, 4), (40, 2, 6), (40, 0, 6), (8, 2.5, 2)])
def test_pairs_within_a_radius_equal_all_pairs(spark, loci, radius, most):
    r = random.Random(loci)
    rows = [(f"r{run}", k, p) for run in range(2) for k, p in enumerate([*evolved(r, 40, loci, most), [0] * loci, [2] * loci, [r.randint(0, most) for _ in range(loci)]])]
    own = spark.createDataFrame(rows, "run_id string, key int, genome array<int>").repartition(3)
    wanted = {(a[0], a[1], b[1], float(d)) for a in rows for b in rows if a[0] == b[0] and (d := distance.distance(a[2], b[2])) <= radius}
    got = [(x["run_id"], x["x"], x["y"], x["dist"]) for x in distance.near(own, own, radius, keep_lost=False).collect()]
    assert len(got) == len(set(got)) and set(got) == wanted
    genome = {(x[0], x[1]): x[2] for x in rows}
    kept = {x for x in wanted if not any(a == 0 < b for a, b in zip(genome[x[0], x[1]], genome[x[0], x[2]], strict=True))}
    assert {(x["run_id"], x["x"], x["y"], x["dist"]) for x in distance.near(own, own, radius).collect()} == kept


def test_near_of_nothing(spark):
    empty = spark.createDataFrame([], "run_id string, key int, genome array<int>")
    assert distance.near(empty, empty, 3).collect() == []
    with pytest.raises(ValueError):
        distance.near(empty, empty, -1)


def test_many_groups_without_recursion():
    groups = [x for k in range(1, 1501) for x in (3, 5, -8)]
    assert distance.zero_groups(tuple(sorted(groups))) == (1500, 1500)
    assert distance.zero_groups(tuple(sorted([1000] * 1001 + [-1001] * 1000))) == (1, 1)
    r = random.Random(5)
    low, high = distance.bounds([r.randint(1, 90) for _ in range(10_000)], [r.randint(0, 90) for _ in range(10_000)], 20_000)
    assert 0 < low <= high <= 10_001


def test_forty_loci_with_ninety_copies():
    """Such pairs end with one distance, and it lies between what two other counts allow."""
    r = random.Random(12)
    for _ in range(12):
        u, v = [r.randint(1, 90) for _ in range(40)], [r.randint(0, 90) for _ in range(40)]
        least, most = distance.bounds(u, v)
        n = len(distance.breakpoints(u, v))
        assert least == most and -(-n // 2) <= least <= n - 1


def plain_joining(dist, ids, next_id):
    live, edges, d = list(ids), [], np.array(dist, float)
    while len(live) > 2:
        n, total = len(live), d.sum(1)
        pairs = [((n - 2) * d[a, b] - total[a] - total[b], a, b) for a in range(n) for b in range(a + 1, n)]
        _, a, b = min(pairs)
        delta = (total[a] - total[b]) / (n - 2)
        edges += [(next_id, live[a], (d[a, b] + delta) / 2), (next_id, live[b], (d[a, b] - delta) / 2)]
        rest = [k for k in range(n) if k not in (a, b)]
        to = (d[a, rest] + d[b, rest] - d[a, b]) / 2
        d = np.vstack([np.column_stack([d[np.ix_(rest, rest)], to]), np.append(to, 0)])
        live, next_id = [live[k] for k in rest] + [next_id], next_id + 1
    return [*edges, (-1, live[0], d[0, 1] / 2), (-1, live[1], d[0, 1] / 2)]


@pytest.mark.parametrize("spare", [1, 2, 512])
def test_joining_equals_the_plain_way(monkeypatch, spare):
    monkeypatch.setattr(joining, "SPARE", spare)
    r = np.random.default_rng(spare)
    for n in (2, 3, 4, 7, 20, 40):
        for most in (1, 2, 9, 1000):
            d = np.triu(r.integers(0, most + 1, (n, n)).astype(float), 1)
            got = joining.neighbour_joining(d + d.T, list(range(n)), 100)
            assert [e[:2] for e in got.edges] == [e[:2] for e in plain_joining(d + d.T, list(range(n)), 100)]
            assert [e[2] for e in got.edges] == pytest.approx([e[2] for e in plain_joining(d + d.T, list(range(n)), 100)])
