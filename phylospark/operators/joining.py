"""Neighbour joining. One step as a DataFrame plan, and the whole run as a kernel over one matrix.

A run joins one pair after another, so it is sequential within a matrix and parallel over matrices; a matrix is that of the earliest biopsy of a
run (5,000 cells are 200 MB in its task).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROOT, SPARE = -1, 512


def step(distances: DataFrame) -> DataFrame:
    """(run_id, i, j, q, dist, limb_i, limb_j): the first pair of least Q of each run, in row order, and its limbs.

    distances: (run_id, i, j, dist), all ordered pairs of at least three items."""
    totals = distances.groupBy("run_id", "i").agg(F.sum("dist").alias("total"))
    sizes = totals.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    rows = distances.where("i < j").join(totals.withColumnRenamed("total", "ti"), ["run_id", "i"])
    rows = rows.join(totals.select("run_id", F.col("i").alias("j"), F.col("total").alias("tj")), ["run_id", "j"]).join(sizes, "run_id")
    rows = rows.withColumn("q", (F.col("n") - 2) * F.col("dist") - F.col("ti") - F.col("tj"))
    best = rows.groupBy("run_id").agg(F.min_by(F.struct("i", "j", "q", "dist", "ti", "tj", "n"), F.struct("q", "i", "j")).alias("b")).select("run_id", "b.*")
    delta = (F.col("ti") - F.col("tj")) / (F.col("n") - 2)
    return best.select("run_id", "i", "j", "q", "dist", ((F.col("dist") + delta) / 2).alias("limb_i"), ((F.col("dist") - delta) / 2).alias("limb_j"))


@dataclass
class Joined:
    """Edges (parent, child, weight), and new nodes in the order in which they arose, the root last."""

    edges: list[tuple[int, int, float]]
    created: list[int]


def neighbour_joining(dist: np.ndarray, ids: list[int], next_id: int) -> Joined:
    """Tree of the items under ROOT; new nodes are numbered from next_id. The diagonal is never a candidate, so it always ends;
    limbs may be negative. Of equal pairs the first by age of its items is joined. It needs two items.

    Rows that can't hold the best pair aren't looked at: a row's least distance and the largest total bound its Q from below, rows are taken by that
    bound, and the search ends where the bound passes the best Q. Joining can only raise a row's least distance, but for the distance to the
    new item, so bounds stay good until their row is looked at again. Items keep their age's order; a new one takes the next place, and
    places of joined ones are closed up every SPARE joins."""
    if len(ids) < 2:
        raise ValueError("neighbour joining needs at least two cells in the earliest biopsy")
    out, node, left = Joined([], []), np.array(ids, np.int64), np.array(dist, float)
    np.fill_diagonal(left, np.inf)
    while len(node) > 2:
        n = len(node)
        wide = n + min(SPARE, n - 2)
        d, node = np.full((wide, wide), np.inf), np.append(node, np.zeros(wide - n, np.int64))
        d[:n, :n] = left
        total, least = np.full(wide, -np.inf), d.min(1)  # of a free or joined place, so that no Q there is the least
        total[:n] = np.where(np.isinf(left), 0, left).sum(1)
        for new in range(n, wide):
            i, j = first_pair(d, total, least, new, 2 * n - new - 2)
            delta = (total[i] - total[j]) / (2 * n - new - 2)
            out.edges += [(next_id, int(node[i]), float((d[i, j] + delta) / 2)), (next_id, int(node[j]), float((d[i, j] - delta) / 2))]
            to_new = (d[i, :new] + d[j, :new] - d[i, j]) / 2
            to_new[[i, j]] = np.inf
            here = np.isfinite(to_new)
            total[:new][here] += to_new[here] - d[i, :new][here] - d[j, :new][here]
            least[:new] = np.minimum(least[:new], to_new)
            d[new, :new] = d[:new, new] = to_new
            for k in (i, j):
                d[k], d[:, k], total[k], least[k] = np.inf, np.inf, -np.inf, np.inf
            total[new], least[new], node[new] = to_new[here].sum(), to_new.min(), next_id
            out.created.append(next_id)
            next_id += 1
        alive = np.flatnonzero(total > -np.inf)
        left, node = d[np.ix_(alive, alive)], node[alive]
    half = float(left[0, 1] / 2)
    out.edges += [(ROOT, int(node[0]), half), (ROOT, int(node[1]), half)]
    out.created.append(ROOT)
    return out


def first_pair(d: np.ndarray, total: np.ndarray, least: np.ndarray, end: int, factor: int) -> tuple[int, int]:
    """The first pair of least Q among the first places; the least distance of each row that is looked at is set anew."""
    bound = factor * least[:end] - total[:end] - total.max()
    order = np.argsort(bound)
    best, pair, start, size = np.inf, (0, 0), 0, 16
    while start < end and bound[order[start]] <= best and bound[order[start]] < np.inf:
        rows = order[start : start + size]
        q = d[rows, :end]
        least[rows] = q.min(1)
        q *= factor
        q -= total[rows, None]
        q -= total[:end]
        at = q.argmin(1)
        value = q[np.arange(len(rows)), at]
        if value.min() <= best:
            found = min((min(a, b), max(a, b)) for a, b in zip(rows[value == value.min()].tolist(), at[value == value.min()].tolist(), strict=True))
            pair = min(pair, found) if value.min() == best and np.isfinite(best) else found
            best = value.min()
        start, size = start + size, min(2 * size, 256)
    return pair
