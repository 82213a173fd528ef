"""Which clusters are equal, squares of clusters, and nodes with several parents, each against the plainest way."""

import random
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from phylospark.operators import clusters, linking, similarity

NODES = "tree_id string, node_id long, parent_id long, label string"


def grown(r, n, labels, tree="t"):
    return [(tree, i, r.randrange(i) if i else None, r.choice(labels)) for i in range(n)]


def plain(rows):
    """{node: Counter of labels by paths} of one tree or graph."""
    label, kids = {}, {}
    for _, node, up, name in rows:
        label[node] = name
        if up is not None:
            kids.setdefault(up, set()).add(node)

    def of(node):
        return sum((of(k) for k in kids.get(node, ())), Counter([label[node]] if label[node] is not None else []))

    return {node: of(node) for node in label}


def named(counter):
    return tuple(sorted(counter.items()))


def classes(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[0], []).append(row)
    every = {(t, node): named(c) for t, own in trees.items() for node, c in plain(own).items()}
    return {at: (min(a for a, c in every.items() if c == own), sum(c == own for c in every.values())) for at, own in every.items()}


@pytest.mark.parametrize("guess", ["hashes", "size alone", "nothing"])
def test_elements_decide_which_clusters_are_equal(spark, monkeypatch, guess):
    none = F.lit(0).cast("decimal(30,0)")
    if guess != "hashes":  # then every group but the right ones has to be parted
        size = F.coalesce(F.sum("cnt"), F.lit(0)) if guess == "size alone" else F.lit(7).cast("long")
        monkeypatch.setattr(clusters, "identity", lambda: [F.min(none).alias("h1"), F.min(none).alias("h2"), F.max(size).alias("size") if guess == "nothing" else size.alias("size")])
    r = random.Random(3)
    rows = grown(r, 25, ["a", "b", None], "t") + grown(r, 12, ["a", "b"], "u")
    got = clusters.numbered(spark.createDataFrame(rows, NODES))
    found = {(x["tree_id"], x["anc"]): ((x["first_tree"], x["first_node"]), x["n"]) for x in got.collect()}
    assert found == classes(rows)


def test_no_nodes(spark):
    assert clusters.numbered(spark.createDataFrame([], NODES)).count() == 0


def exact_similarity(left, right):
    a, b = list(plain(left).values()), list(plain(right).values())

    def far(x, y):
        most = sum((x | y).values())
        return 1 - Fraction(sum((x & y).values()), most) if most else Fraction(0)

    names = [{named(x) for x in side} for side in (a, b)]
    u = len(names[0] | names[1])
    first = sum(far(x, y) for x in a for y in b if named(y) not in names[0])
    second = sum(far(y, x) for y in b for x in a if named(x) not in names[1])
    return float(1 - first / (len(a) * u) - second / (len(b) * u))


def chain(n, tree, label=lambda i: "x"):
    return [(tree, i, i - 1 if i else None, label(i)) for i in range(n)]


def test_squares_of_clusters_give_what_pairs_give(spark, monkeypatch):
    r = random.Random(5)
    trees = {
        "chain": chain(40, "chain"),
        "longer": chain(55, "longer"),
        "mixed": chain(45, "mixed", lambda i: "xy"[i % 3 == 0]),
        "bushy": grown(r, 50, ["x", "y", "z", None], "bushy"),
        "small": grown(r, 4, ["x", "q"], "small"),
        "apart": grown(r, 6, ["other"], "apart"),
    }
    wanted = [(f"{a}|{b}", a, b) for a in trees for b in trees]
    nodes = spark.createDataFrame([row for own in trees.values() for row in own], NODES)
    pairs = spark.createDataFrame(wanted, "pair_id string, left_tree string, right_tree string")
    squares = []
    by_blocks = similarity.by_blocks
    monkeypatch.setattr(similarity, "PAIRS", 300)
    monkeypatch.setattr(similarity, "BLOCK", 16)
    monkeypatch.setattr(similarity, "by_blocks", lambda left, right: squares.extend(x[0] for x in left.select("pair_id").distinct().collect()) or by_blocks(left, right))
    got = {x["pair_id"]: x["similarity"] for x in similarity.similarity(nodes, pairs).collect()}
    assert {"chain|longer", "chain|mixed", "mixed|bushy"} <= set(squares)
    assert not {p for p in squares if "small" in p or "apart" in p}
    for name, a, b in wanted:
        assert got[name] == pytest.approx(exact_similarity(trees[a], trees[b]), abs=1e-9), name


def test_clusters_with_many_labels_stay_pairs(spark, monkeypatch):
    monkeypatch.setattr(similarity, "PAIRS", 100)
    monkeypatch.setattr(similarity, "MEAN_LABELS", 3)
    monkeypatch.setattr(similarity, "by_blocks", None)  # would fail
    a, b = chain(30, "a", str), chain(35, "b", lambda i: str(i % 33))
    pairs = spark.createDataFrame([("p", "a", "b")], "pair_id string, left_tree string, right_tree string")
    got = similarity.similarity(spark.createDataFrame(a + b, NODES), pairs).first()["similarity"]
    assert got == pytest.approx(exact_similarity(a, b), abs=1e-9)


def test_labels_below_several_parents_count_by_paths(spark):
    r, rows = random.Random(11), []
    for g in range(8):
        for node in range(12):
            ups = r.sample(range(node), min(node, r.randint(1, 3)))
            label = r.choice(["a", "b", "c", None])
            rows += [(f"g{g}", node, up, label) for up in ups or [None]]
    rows += rows[5:9]  # repeated rows change nothing
    got = clusters.elements(spark.createDataFrame(rows, NODES)).collect()
    found = {}
    for x in got:
        found.setdefault((x["tree_id"], x["anc"]), {})[x["label"]] = x["cnt"]
    expected = {(g, node): dict(c) for g in {x[0] for x in rows} for node, c in plain([x for x in rows if x[0] == g]).items() if c}
    assert found == expected


def joined_in_turn(cells, d, fresh):
    """Neighbour joining of a list with repeated cells, a matrix at a time: the set of (parent, child)."""
    items, m, edges = list(cells), {(i, j): float(d(a, b)) for i, a in enumerate(cells) for j, b in enumerate(cells)}, set()
    live, top = list(range(len(cells))), len(cells)
    while len(live) > 2:
        total = {i: sum(m[i, j] for j in live) for i in live}
        _, a, b = min(((len(live) - 2) * m[i, j] - total[i] - total[j], x, y) for x, i in enumerate(live) for y, j in enumerate(live) if x < y)
        a, b = live[a], live[b]
        items.append(fresh)
        edges |= {(fresh, items[a]), (fresh, items[b])}
        fresh, live = fresh + 1, [k for k in live if k not in (a, b)]
        for k in live:
            m[k, top] = m[top, k] = (m[a, k] + m[b, k] - m[a, b]) / 2
        m[top, top] = 0.0
        live, top = [*live, top], top + 1
    return edges | {(-1, items[i]) for i in live}


def test_a_cell_sampled_twice_is_one_node_under_its_parents(spark):
    r = random.Random(2)
    runs = {"r1": [[1, 2, 3], [3, 4, 5], [5, 6, 7, 1]], "r2": [[1, 2], [2, 3]], "r3": [[4], [4]], "r4": [[9]]}
    far = {(a, b): 0 if a == b else r.randint(1, 9) for a in range(1, 10) for b in range(a, 10)}
    d = lambda a, b: far[min(a, b), max(a, b)]
    rows, distances = [], []
    for run, levels in runs.items():
        cells = sorted({c for own in levels for c in own})
        rows += [(run, level, at, c, [2]) for level, own in enumerate(levels) for at, c in enumerate(own)]
        distances += [(run, i, j, a, float(d(a, b))) for i, a in enumerate(cells) for j, b in enumerate(cells)]
    biopsy = spark.createDataFrame(rows, "run_id string, level int, ord int, cell_id long, genome array<int>")
    matrix = spark.createDataFrame(distances, "run_id string, i int, j int, id_i long, dist double")
    got = linking.reconstruct(biopsy, matrix, 4, pooled=True, shared=True).collect()
    for run, levels in runs.items():
        pooled = [c for own in levels for c in own]
        expected = joined_in_turn(pooled, d, max(pooled) + 2) if len(pooled) > 1 else set()
        found = [(x["parent_id"], x["node_id"]) for x in got if x["run_id"] == run and x["parent_id"] is not None]
        assert len(found) == len(set(found)) and set(found) == expected, run
        assert sum(x["run_id"] == run and x["parent_id"] is None for x in got) == (len(pooled) > 1)
        assert all(x["cell_id"] == x["node_id"] for x in got if x["run_id"] == run and x["cell_id"] is not None)
