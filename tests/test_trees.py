from fractions import Fraction

import pytest

from phylospark.operators import clusters, similarity
from phylospark.sources import newick


def plain_clusters(text, allowed=None):
    nodes, root = newick.parse(text)
    kids = {}
    for n, up, _ in nodes:
        kids.setdefault(up, []).append(n)
    label = {n: x for n, _, x in nodes}

    def of(n):
        own = {} if label[n] is None or (allowed is not None and label[n] not in allowed) else {label[n]: 1}
        for k in kids.get(n, []):
            for x, c in of(k)[0].items():
                own[x] = own.get(x, 0) + c
        return own, n

    return [tuple(sorted(of(n)[0].items())) for n, *_ in nodes] if root is not None else []


def plain_similarity(left, right, allowed=None):
    def far(a, b):
        a, b = dict(a), dict(b)
        least, most = sum(min(a.get(k, 0), b.get(k, 0)) for k in a | b), sum(max(a.get(k, 0), b.get(k, 0)) for k in a | b)
        return 1 - Fraction(least, most) if most else 0

    a, b = plain_clusters(left, allowed), plain_clusters(right, allowed)
    u = len(set(a) | set(b))
    first = sum(far(x, y) for x in a for y in b if y not in set(a))
    second = sum(far(y, x) for y in b for x in a if x not in set(b))
    return float(1 - Fraction(first) / (len(a) * u) - Fraction(second) / (len(b) * u))


# Known pairs of trees and their similarity.
GOLDEN = [
    ("((a,b)f,(c,d)e)g;", "((a,b)f,c);", 6917 / 11760),
    ("(a,b)c;", "(a,d)c;", 14 / 45),
    ("((((a,b)d,e)f,h)i,c)g;", "((a,b),c);", 127291 / 311850),
    ("((a,b)f,(c,d)e)g;", "((a,b)f,(c,d)e)g;", 1.0),
]


def scored(spark, pairs, of):
    rows = [(f"{side}{i}", t) for i, (a, b, *_) in enumerate(pairs) for side, t in (("l", a), ("r", b))]
    nodes = newick.nodes(spark.createDataFrame(rows, "tree_id string, newick string"))
    wanted = spark.createDataFrame([(str(i), f"l{i}", f"r{i}") for i in range(len(pairs))], "pair_id string, left_tree string, right_tree string")
    return {int(r["pair_id"]): r["similarity"] for r in of(nodes, wanted).collect()}


def test_similarity_of_hand_worked_trees(spark):
    got = scored(spark, GOLDEN, similarity.similarity)
    for i, (left, right, value) in enumerate(GOLDEN):
        assert got[i] == pytest.approx(value, abs=1e-12)
        assert plain_similarity(left, right) == pytest.approx(value, abs=1e-12)


def test_similarity_equals_the_plain_formula_and_is_symmetric(spark):
    trees = ["((a,b)c,(d)d)c;", "((a,b),(d)d);", "((a,b)e,(d)f)g;", "(e,f)g;", "((a,a),(a,b)a);", "(,a);", "a;", "((x y,b:0.1),q)"]
    pairs = [(a, b) for a in trees for b in trees]
    got = scored(spark, pairs, similarity.similarity)
    for i, (a, b) in enumerate(pairs):
        assert got[i] == pytest.approx(plain_similarity(a, b), abs=1e-9), (a, b)
        assert got[i] == pytest.approx(got[pairs.index((b, a))], abs=1e-9)


def test_restricted_similarities(spark):
    pair = [("((a,b)f,(c,d)e)g;", "((a,b)h,c);")]
    shared = {"a", "b", "c", "d"}  # leaves of either; no inner label is in both
    assert scored(spark, pair, similarity.shared_label_similarity)[0] == pytest.approx(plain_similarity(*pair[0], shared), abs=1e-9)
    labels = spark.createDataFrame([("a",), ("c",)], "label string")
    same = scored(spark, [(pair[0][0], pair[0][0])], lambda n, p: similarity.given_label_similarity(n, p, labels))
    assert same[0] == pytest.approx(1.0)
    none = spark.createDataFrame([("zzz",)], "label string")
    assert scored(spark, pair, lambda n, p: similarity.given_label_similarity(n, p, none))[0] == 0.0


def test_newick_rules():
    assert newick.parse("((a,b)c,d)e;") == ([(0, 2, "a"), (1, 2, "b"), (2, 4, "c"), (3, 4, "d"), (4, None, "e")], 4)
    assert newick.parse("(,a);") == ([(0, 1, "a"), (1, None, None)], 1)
    assert newick.parse("a:0.1;")[0] == [(0, None, "a:0.1")]
    assert newick.parse("") == newick.parse(None) == ([], None)
    with pytest.raises(ValueError):
        newick.parse("a)")


def test_closure_of_a_long_chain(spark):
    rows = [("t", i, i - 1 if i else None, str(i)) for i in range(300)]
    nodes = spark.createDataFrame(rows, "tree_id string, node_id long, parent_id long, label string")
    assert clusters.closure(nodes).count() == 300 * 301 // 2
