"""Hierarchical density clustering of small groups, by the published algorithm."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spanning_tree(x: np.ndarray) -> list[tuple[float, int, int]]:
    """Edges ``(weight, a, b)`` of the minimum spanning tree under mutual reachability with one neighbour, sorted.

    No distance of a row is less than that to its nearest neighbour, so with one neighbour the mutual reachability of two rows is their
    distance. Prim's algorithm: a product in single precision tells which rows may be nearer to the new one than to the tree, with a bound on its error;
    only their distances are taken, in double precision. Memory grows with the rows.
    """
    n = len(x)
    scale = float(np.abs(x).max(initial=0.0)) or 1.0
    near = (x / scale).astype(np.float32)
    sq = np.einsum("ij,ij->i", near, near, dtype=np.float64)
    slack = (x.shape[1] + 8) * 2.5e-7
    best, link, edges = np.full(n, np.inf), np.zeros(n, int), []
    inside, rest, held, own = np.zeros(n, bool), np.arange(n), near, sq  # rows outside the tree, and some that have joined it since
    low = np.full(n, np.inf)  # (best / scale) ** 2 of ``rest``, less than any square of those inside
    at = 0
    for _ in range(n - 1):
        inside[at] = True
        low[np.searchsorted(rest, at)] = -np.inf
        if len(rest) > 64 and 4 * (n - len(edges) - 1) < 3 * len(rest):
            out = ~inside[rest]
            rest, held, own, low = rest[out], held[out], own[out], low[out]
        square = own + sq[at]
        square *= 1 - slack
        square -= 2 * (held @ near[at])
        may = np.flatnonzero(~(square - 1e-35 > low))
        may = may[~inside[rest[may]]]
        c = rest[may]
        d = np.sqrt(((x[at] - x[c]) ** 2).sum(-1))
        closer = d < best[c]
        c, may = c[closer], may[closer]
        best[c], link[c] = d[closer], at
        low[may] = (d[closer] / scale) ** 2 * (1 + 1e-9)
        key = np.where(low == -np.inf, np.inf, best[rest])
        at = int(rest[key.argmin()])
        edges.append((float(best[at]), int(link[at]), at))
    return sorted(edges)


def density_clusters(x: np.ndarray, least: int, edges: list[tuple[float, int, int]] | None = None) -> np.ndarray:
    """Labels from 0, noise -1: mutual reachability (one neighbour), spanning tree (``edges`` where it is at hand), condensed tree, excess of mass."""
    n = len(x)
    if n < max(2, least):
        return np.full(n, -1)
    if edges is None:
        edges = spanning_tree(x)
    kids: dict[int, tuple[int, int, float]] = {}
    size, top = dict.fromkeys(range(n), 1), list(range(n))

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for k, (w, a, b) in enumerate(edges):
        ra, rb, new = root(a), root(b), n + k
        kids[new], size[new] = (ra, rb, w), size[ra] + size[rb]
        top.append(new)
        top[ra] = top[rb] = new

    def leaves(v: int) -> list[int]:
        stack, out = [v], []
        while stack:
            v = stack.pop()
            if v < n:
                out.append(v)
            else:
                stack += kids[v][:2]
        return out

    # condensed tree: a cluster lives while at most one side of a split is large enough
    born: list[float] = [0.0]
    gone: list[dict[int, float]] = [{}]
    below: list[list[int]] = [[]]
    todo = [(2 * n - 2, 0)]
    while todo:
        v, c = todo.pop()
        while v >= n:
            a, b, w = kids[v]
            lam = 1 / w if w > 0 else 1e12
            big = [k for k in (a, b) if size[k] >= least]
            if len(big) == 2:
                for p in leaves(v):
                    gone[c][p] = lam
                for k in big:
                    born.append(lam)
                    gone.append({})
                    below.append([])
                    below[c].append(len(born) - 1)
                    todo.append((k, len(born) - 1))
                break
            for k in (a, b):
                if k not in big:
                    for p in leaves(k):
                        gone[c][p] = lam
            if not big:
                break
            v = big[0]
    mass = [sum(lam - born[c] for lam in gone[c].values()) for c in range(len(born))]
    chosen: set[int] = set()
    best_mass = list(mass)
    for c in reversed(range(len(born))):
        under = sum(best_mass[k] for k in below[c])
        if below[c] and (under >= mass[c] or c == 0):
            best_mass[c] = under
        elif c:
            drop = list(below[c])
            while drop:
                k = drop.pop()
                chosen.discard(k)
                drop += below[k]
            chosen.add(c)
    out = np.full(n, -1)
    for label, c in enumerate(sorted(chosen)):
        for p in gone[c]:
            out[p] = label
    return out


def cluster_groups(vectors: DataFrame, id_col: str, vec: str, group: str, sizes: Sequence[int] = (5, 10, 20), most: int | None = None) -> DataFrame:
    """``(group, min_size, id, cluster_id)`` for groups of any size, or an error beyond ``most`` rows where that is given.

    A group is one task, and its spanning tree serves all sizes: its memory grows with the group's rows, its time with their square.
    """
    if most is not None and vectors.groupBy(group).count().where(F.col("count") > most).limit(1).count():
        raise ValueError(f"a group has more than {most} rows; sample contexts first")

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("id")
        x = np.stack(pdf["v"].to_numpy()).astype(float)
        edges = spanning_tree(x)
        return pd.concat([pd.DataFrame({"grp": pdf["grp"], "min_size": s, "id": pdf["id"], "cluster_id": density_clusters(x, s, edges)}) for s in sizes])

    rows = vectors.select(F.col(group).cast("string").alias("grp"), F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    return rows.groupBy("grp").applyInPandas(run, "grp string, min_size int, id long, cluster_id int")
