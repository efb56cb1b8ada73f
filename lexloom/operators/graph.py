"""Term co-occurrence graphs: edges, degrees, ego graphs, communities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as tx
from lexloom.session import stored

from .frequency import top


#: MB of sums that a task of ``cooccurrence`` holds, rows of a batch that it takes and of one that it hands on.
MATRIX_MB, BATCH_ROWS, EDGE_ROWS = 64, 1_024, 200_000


def vocabulary(rows: DataFrame, tk: Column, size: int, by_documents: bool = False) -> DataFrame:
    """The ``size`` most frequent terms, by tokens or by documents."""
    grams = F.array_distinct(tk) if by_documents else tk
    counts = rows.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return top(counts, size).select(F.col("gram").alias("term"), F.col("n").alias("freq"))


def _gram_matrices(terms: list[str], n_keys: int):
    """Batches of ``keys..., tokens`` to ``keys..., i, j, n``: per key the product of the 0/1 matrix of documents and terms with itself.

    A task holds ``MATRIX_MB`` of sums (at least one matrix), beside them a block of documents, its product and ``EDGE_ROWS`` rows on their way out.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        listed = pa.array(terms, pa.string())
        size, block = len(terms), 1024
        most = max(1, int(MATRIX_MB * 1e6 / (4 * size * size or 1)))
        held: dict[tuple, np.ndarray] = {}
        kinds: list = []

        def out():
            for key, total in held.items():
                step = max(1, EDGE_ROWS // (size or 1))
                for first in range(0, size, step):
                    rows = total[first : first + step]
                    i, j = np.nonzero(np.triu(rows, first + 1))
                    if len(i):
                        yield pa.RecordBatch.from_arrays([*(pa.array([k] * len(i), t) for k, t in zip(key, kinds)), pa.array((i + first).astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(rows[i, j].astype(np.int64))], [*(f"k{x}" for x in range(n_keys)), "i", "j", "n"])
            held.clear()

        for batch in batches:
            kinds = [batch.column(x).type for x in range(n_keys)]
            tokens = batch.column(n_keys)
            at = pc.index_in(tokens.flatten(), value_set=listed)
            row = pc.list_parent_indices(tokens).to_numpy(zero_copy_only=False)
            known = pc.is_valid(at).to_numpy(zero_copy_only=False)
            col = pc.fill_null(at, 0).to_numpy(zero_copy_only=False)[known]
            row = row[known]
            keys = list(zip(*(batch.column(x).to_pylist() for x in range(n_keys)))) if n_keys else [()] * batch.num_rows
            groups: dict[tuple, list[int]] = {}
            for r, key in enumerate(keys):
                groups.setdefault(key, []).append(r)
            place = np.zeros(batch.num_rows, dtype=np.int64)
            for key, own in groups.items():
                if key not in held and len(held) >= most:
                    yield from out()
                if key not in held:
                    held[key] = np.zeros((size, size), np.int32)
                total = held[key]
                for a in range(0, len(own), block):
                    part = own[a : a + block]
                    place[:] = -1
                    place[part] = np.arange(len(part))
                    use = place[row] >= 0
                    x = np.zeros((len(part), size), dtype=np.float32)
                    x[place[row[use]], col[use]] = 1
                    total += (x.T @ x).astype(np.int32)  # at most 1024, exact
        yield from out()

    return run


def cooccurrence(rows: DataFrame, tk: Column, vocab: DataFrame, min_edge: int, keys: Sequence[str] = ()) -> DataFrame:
    """Edges ``src < dst`` with the number of documents that hold both terms.

    The vocabulary has a bounded size and goes to every task. A task multiplies the matrix of documents and terms with itself block by
    block, so what is shuffled are its sums, at most one row a task and edge. The edges, bounded by the vocabulary, are written to the shared
    folder: whoever reads them more than once doesn't count the corpus again.
    """
    terms = sorted(r["term"] for r in vocab.select("term").collect())
    kinds = [f"k{x} {rows.schema[k].dataType.simpleString()}" for x, k in enumerate(keys)]
    conf = rows.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    # a document brings each term of the bounded vocabulary once at most, whatever its length
    known = F.array_distinct(F.filter(tk, lambda t: t.isin(terms))) if terms else F.array().cast("array<string>")
    held = rows.select(*keys, known.alias("_tk")).where(F.size("_tk") > 1)
    cells = held.mapInArrow(_gram_matrices(terms, len(keys)), ", ".join([*kinds, "i int, j int, n long"]))
    names = [f"k{x}" for x in range(len(keys))]
    edges = cells.groupBy(*names, "i", "j").agg(F.sum("n").alias("weight")).where(F.col("weight") >= min_edge)
    listed = rows.sparkSession.createDataFrame(list(enumerate(terms)), "i int, term string")  # the bounded vocabulary
    src, dst = (F.broadcast(listed.select(F.col("i").alias(at), F.col("term").alias(name))) for at, name in (("i", "src"), ("j", "dst")))
    named = edges.join(src, "i").join(dst, "j").select(*(F.col(n).alias(k) for n, k in zip(names, keys)), "src", "dst", "weight")
    return stored(named, "edges")


def central_terms(members: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most central terms inside each community: degree over the community's other terms, counting edges inside it. ``members``: ``term, community``."""
    inside = endpoints(edges).join(members, "term").join(members.select(F.col("term").alias("other"), F.col("community").alias("_c")), "other").where("community = _c")
    size = members.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    degree = members.join(inside.groupBy("community", "term").agg(F.count(F.lit(1)).alias("degree")), ["community", "term"], "left").join(size, "community")
    central = degree.select("community", F.col("term").alias("gram"), F.coalesce(F.try_divide(F.col("degree").cast("double"), F.col("size") - 1), F.lit(0.0)).alias("n"))
    return top(central, k, ["community"]).select("community", F.col("gram").alias("term"), F.col("n").alias("centrality"), "rank")


def mentions(rows: DataFrame, id_col: str, tk: Column, tops: DataFrame, valence: Column | None = None) -> DataFrame:
    """``(row, community)`` of the rows that hold at least one of a community's top terms, with ``valence`` where a scorer's column is given.

    ``tops`` (``community, term``) is bounded by communities times top terms.
    """
    each = rows.select(F.col(id_col).alias("row"), (valence if valence is not None else F.lit(None).cast("double")).alias("valence"), F.explode(F.array_distinct(tk)).alias("term"))
    return each.join(tops.select("community", "term"), "term").select("row", "community", "valence").distinct()


def endpoints(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Both directions of every edge."""
    return edges.select(*keys, F.col("src").alias("term"), F.col("dst").alias("other"), "weight").unionByName(edges.select(*keys, F.col("dst").alias("term"), F.col("src").alias("other"), "weight"))


def degrees(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return endpoints(edges, keys).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))


def graph_stats(vocab: DataFrame, edges: DataFrame, keep_isolates: bool = False) -> DataFrame:
    nodes = vocab.select("term") if keep_isolates else degrees(edges).select("term")
    n, e = nodes.agg(F.count(F.lit(1)).alias("nodes")), edges.agg(F.count(F.lit(1)).alias("edges"))
    return n.crossJoin(e).select("nodes", "edges", F.try_divide(F.lit(2.0) * F.col("edges"), F.col("nodes") * (F.col("nodes") - 1)).alias("density"), F.try_divide(F.lit(2.0) * F.col("edges"), F.col("nodes")).alias("average_degree"))


def size_summary(members: DataFrame, group: str) -> DataFrame:
    """Number, median, largest, smallest and five largest sizes of the groups of ``members``."""
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    five = sizes.orderBy(F.desc("n")).limit(5).agg(F.array_join(F.sort_array(F.collect_list("n"), False), ",").alias("top5"))
    whole = sizes.agg(F.count(F.lit(1)).alias("communities"), F.percentile("n", F.lit(0.5)).alias("median_size"), F.max("n").alias("largest"), F.min("n").alias("smallest"))
    return whole.crossJoin(F.broadcast(five))  # one row each


def ego(edges: DataFrame, seeds: Sequence[str]) -> DataFrame:
    """Induced edges among each seed and its neighbours."""
    both = endpoints(edges)
    near = both.where(F.col("term").isin(*seeds)).select(F.col("term").alias("seed"), F.col("other").alias("term"))
    near = near.unionByName(near.select("seed", F.col("seed").alias("term"))).distinct()
    return edges.join(near.withColumnRenamed("term", "src"), "src").join(near.withColumnRenamed("term", "dst"), ["seed", "dst"]).select("seed", "src", "dst", "weight")


class _Rows:
    """A weighted graph as sorted rows of neighbours in flat arrays; weights are whole numbers, so their sums are exact in any order."""

    def __init__(self, a, b, w, n: int) -> None:
        import numpy as np

        loop = a == b
        key, at = np.unique(np.concatenate([a, b[~loop]]) * n + np.concatenate([b, a[~loop]]), return_inverse=True)
        self.n, self.w = n, np.bincount(at, np.concatenate([w, w[~loop]]), len(key))
        self.i, self.j = key // n, key % n
        self.start = np.searchsorted(self.i, np.arange(n + 1))

    def strength(self):
        """Sums of the rows, loops twice."""
        import numpy as np

        return np.bincount(self.i, self.w * (1 + (self.i == self.j)), self.n)

    def row(self, i: int):
        """The neighbours of a node but itself, and their weights."""
        at = slice(self.start[i], self.start[i + 1])
        j, w = self.j[at], self.w[at]
        return (j, w) if not (own := j == i).any() else (j[~own], w[~own])

    def merged(self, com, n: int) -> _Rows:
        """The graph of the communities: each edge once, those inside a community as its loop."""
        once = self.i <= self.j
        return _Rows(com[self.i[once]], com[self.j[once]], self.w[once], n)


def louvain(edges: DataFrame, resolutions: Sequence[float] = (0.5, 1.0, 2.0), max_edges: int = 2_000_000) -> DataFrame:
    """``(resolution, term, community)`` for a graph of bounded size; one group per resolution, nodes visited in order of name.

    The graph's size is that of its vocabulary; ``max_edges`` is checked and more is an error.
    """
    if edges.limit(max_edges + 1).count() > max_edges:
        raise ValueError(f"more than {max_edges} edges; bound the vocabulary first")

    def run(pdf):
        import numpy as np
        import pandas as pd

        gamma = float(pdf["resolution"].iloc[0])
        names = np.array(sorted(set(pdf["src"]) | set(pdf["dst"])), dtype=object)
        src, dst = (pd.Categorical(pdf[c], categories=names).codes.astype(np.int64) for c in ("src", "dst"))
        adj = _Rows(src, dst, pdf["weight"].to_numpy(np.float64), len(names))
        del src, dst, pdf
        member = np.arange(len(names))
        while True:
            n = adj.n
            strength = adj.strength()
            whole = float(strength.sum()) or 1.0
            com, tot, moved = np.arange(n), strength.copy(), False
            improving = True
            while improving:
                improving = False
                for i in range(n):
                    own = com[i]
                    tot[own] -= strength[i]
                    j, w = adj.row(i)
                    at = com[j]
                    to = np.bincount(at, w, n)
                    near = np.zeros(n, bool)
                    near[at] = near[own] = True
                    c = np.flatnonzero(near)
                    gain = to[c] - gamma * strength[i] * tot[c] / whole
                    k = int(gain.argmax())  # ties: the smallest community
                    best = own if gain[k] <= gain[np.searchsorted(c, own)] + 1e-12 else c[k]
                    tot[best] += strength[i]
                    if best != own:
                        com[i], improving, moved = best, True, True
            _, first, back = np.unique(com, return_index=True, return_inverse=True)
            label = np.empty(len(first), np.int64)
            label[np.argsort(first)] = np.arange(len(first))  # in order of their first node
            com = label[back]
            member = com[member]
            if not moved:
                break
            adj = adj.merged(com, len(first))
        return pd.DataFrame({"resolution": gamma, "term": names, "community": member})

    each = edges.select(F.explode(F.array(*[F.lit(float(r)) for r in resolutions])).alias("resolution"), "src", "dst", "weight")
    return each.groupBy("resolution").applyInPandas(run, "resolution double, term string, community long")
