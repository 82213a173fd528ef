import itertools
import os
import random

import numpy as np
import pytest

from phylospark.operators import distance, joining, layout, linking
from phylospark.plans import reconstruction_queries, registry

SF = "/root/testdata/sf0.001"


def plain_distance(u, v):
    """By trying all partitions of the breakpoints into groups that sum to zero."""
    kept = [(b - a) for a, b in zip(u, v, strict=True) if a]
    steps = [x for x in np.diff(kept, prepend=0, append=0).tolist() if x]

    def groups(left):
        if not left:
            return 0
        best = -99
        for k in range(len(left)):
            for rest in itertools.combinations(left[1:], k):
                if left[0] + sum(rest) == 0:
                    other = list(left[1:])
                    for x in rest:
                        other.remove(x)
                    best = max(best, 1 + groups(other))
        return best

    return len(steps) - groups(steps)


def test_distance_equals_all_partitions():
    r = random.Random(2)
    for _ in range(150):
        u, v = ([r.randint(0, 4) for _ in range(6)] for _ in range(2))
        assert distance.distance(u, v) == plain_distance(u, v), (u, v)


def test_distance_of_many_breakpoints_is_bounded():
    r = random.Random(3)
    for _ in range(20):
        u, v = [r.randint(1, 9) for _ in range(40)], [r.randint(0, 90) for _ in range(40)]
        steps = np.count_nonzero(np.diff(np.subtract(v, u), prepend=0, append=0))
        assert -(-steps // 2) <= distance.distance(u, v) <= steps - 1


def test_joining_of_three():
    d = np.array([[0, 2, 4], [2, 0, 4], [4, 4, 0]], float)
    got = joining.neighbour_joining(d, [1, 2, 3], 10)
    assert got.edges == [(10, 1, 1.0), (10, 2, 1.0), (-1, 3, 1.5), (-1, 10, 1.5)]


def test_joining_recovers_an_additive_tree():
    r = np.random.default_rng(4)
    n = 9
    parent = [None, 0] + [int(r.integers(0, k)) for k in range(2, 2 * n)]
    length = r.uniform(0.5, 2, 2 * n)
    leaves = [k for k in range(2 * n) if k not in parent]

    def path(k):
        return {k} | (path(parent[k]) if parent[k] is not None else set())

    d = np.array([[sum(length[x] for x in path(a) ^ path(b)) for b in leaves] for a in leaves])
    got = joining.neighbour_joining(d, leaves, 100)
    up = {c: (p, w) for p, c, w in got.edges}

    def root_path(k):
        return {k: up[k][1]} | root_path(up[k][0]) if k in up else {}

    for i, a in enumerate(leaves):
        for j, b in enumerate(leaves):
            x, y = root_path(a), root_path(b)
            assert sum(v for k, v in (x | y).items() if (k in x) != (k in y)) == pytest.approx(d[i, j])


def test_joining_always_ends():
    assert len(joining.neighbour_joining(np.zeros((5, 5)), list(range(5)), 9).created) == 4
    with pytest.raises(ValueError):
        joining.neighbour_joining(np.zeros((1, 1)), [1], 9)


def run(spark, cells, d, radius=4):
    rows = [("r", level, k, c, g) for level, own in enumerate(cells) for k, (c, g) in enumerate(own)]
    ids = [c for own in cells for c, _ in own]
    far = [("r", i, j, ids[i], float(d(ids[i], ids[j]))) for i in range(len(ids)) for j in range(len(ids))]
    out = linking.reconstruct(spark.createDataFrame(rows, "run_id string, level int, ord int, cell_id long, genome array<int>"), spark.createDataFrame(far, "run_id string, i int, j int, id_i long, dist double"), radius)
    return {r["node_id"]: (r["parent_id"], r["weight"]) for r in out.collect()}


def test_a_cell_without_ancestor_is_copied_and_adopted(spark):
    cells = [[(1, [2, 2]), (2, [2, 2])], [(3, [2, 2]), (4, [2, 2]), (5, [2, 2])]]
    near = lambda a, b: 0 if a == b else 1 if {a, b} in ({3, 4}, {1, 5}) else 9
    got = run(spark, cells, near)
    assert got[3] == (6, 0.0) and got[4] == (6, 1.0) and got[5] == (1, 1.0)
    assert {k for k, (up, _) in got.items() if up is None} == {-1}


def test_lost_loci_and_the_same_cell(spark):
    cells = [[(1, [0, 2]), (2, [2, 2]), (7, [0, 0])], [(3, [1, 2]), (7, [1, 1])]]
    got = run(spark, cells, lambda a, b: abs(a - b))
    assert got[3] == (2, 1.0)  # 1 lost a locus that 3 has
    assert got[7] == (8, 0.0)  # the earlier copy of 7 got a new node; the loss doesn't matter for the same cell


def test_palette_repeats(spark):
    rows = spark.range(40)
    got = [r["c"] for r in rows.select(layout.biopsy_colour(rows["id"]).alias("c"), "id").orderBy("id").collect()]
    assert got[0] == got[19] == got[38] == layout.PALETTE[0] and got[20] == layout.PALETTE[1]


def test_trees_hold_every_customer(spark, tmp_path):
    rows = [(k, k % 2 if k < 60 else 0) for k in range(75)]  # 45 and 30 of two nations
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    pooled = registry.QUERIES["nj_full"](spark, str(tmp_path)).where("cell_id IS NOT NULL").groupBy("run_id").count().collect()
    assert {r["run_id"]: r["count"] for r in pooled} == {"0-0": 11, "0-1": 11, "0-2": 20, "1-0": 11, "1-1": 17}  # one cell a run occurs twice
    layered = registry.QUERIES["layered_full"](spark, str(tmp_path)).where("cell_id IS NOT NULL")
    assert layered.groupBy("run_id").count().agg({"count": "sum"}).first()[0] >= 75
    assert registry.QUERIES["layered_layout"](spark, str(tmp_path)).select("run_id").distinct().count() == 5


@pytest.mark.parametrize("name", ["layered_full", "layered_layout"])
def test_no_table_that_grows_with_the_runs_is_broadcast(spark, tmp_path, monkeypatch, name):
    """Files of staged tables are small whatever they hold, so Spark would send them through the driver."""
    spark.createDataFrame([(k, k % 3) for k in range(120)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    plans, planned = [], lambda df: df._jdf.queryExecution().toString()
    stage = linking.stage
    for module in (linking, reconstruction_queries):
        monkeypatch.setattr(module, "stage", lambda df, label: plans.append((label, planned(df))) or stage(df, label))
    plans.append((name, planned(registry.QUERIES[name](spark, str(tmp_path)))))
    assert len(plans) > 10 and any("Join" in plan for _, plan in plans)
    assert [label for label, plan in plans if "Broadcast" in plan] == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are elsewhere")
def test_queries_equal_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")

    def rows(frame):
        frame = frame[sorted(frame.columns)]
        plain = lambda v: None if v is None or v != v else float(v) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)
        return sorted(map(repr, (tuple(map(plain, r)) for r in frame.itertuples(index=False))))

    for name, sql in registry.ORACLES.items():
        got, wanted = registry.QUERIES[name](spark, SF).toPandas(), con.execute(sql).df()
        assert sorted(got.columns) == sorted(wanted.columns), name
        assert rows(got) == rows(wanted), name
    for name in registry.QUERIES.keys() - registry.ORACLES.keys():
        assert registry.QUERIES[name](spark, SF).count() > 0, name
