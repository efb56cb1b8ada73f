"""Corpus building: merges with provenance, first-row dedup, samples, audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.session import stored


def keep_first(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by ``order``; combined before the shuffle, so the commonest key doesn't gather."""
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_r"))
    return first.select("_r.*")


def merge_with_provenance(frames: Sequence[tuple[str, DataFrame]], key: str, keep: Sequence[str]) -> DataFrame:
    """The first row of each key in the order of the frames, and all frames that have it, sorted and joined by ``|``."""
    out = None
    for i, (name, f) in enumerate(frames):
        f = f.select(key, *keep).withColumn("_p", F.lit(name)).withColumn("_o", F.lit(i))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    row = F.min_by(F.struct(*keep), "_o")
    return out.groupBy(key).agg(row.alias("_r"), F.array_join(F.sort_array(F.collect_set("_p")), "|").alias("retrieval_provenance")).select(key, *[F.col(f"_r.{c}").alias(c) for c in keep], "retrieval_provenance")


def seeded(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")))


def sample(rows: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    return rows.orderBy(seeded(id_col, seed), id_col).limit(n)


#: Rows of a small side that are broadcast, behind a count; beyond it the same join is a merge join.
BROADCAST_ROWS = 200_000


def small_side(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows.hint("merge")


def stratified_sample(rows: DataFrame, id_col: str, stratum: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in proportion to the strata, at least one each; remainders go to the largest strata first.

    A stratum's rows are cut to its share by a seeded order: first in each task's range of it, then over all.
    """
    sizes = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("_s"))
    total = sizes.agg(F.sum("_s").alias("_t"))
    base = sizes.crossJoin(F.broadcast(total)).withColumn("_a", F.greatest(F.floor(F.lit(n) * F.col("_s") / F.col("_t")), F.lit(1)))
    left = base.agg((F.lit(n) - F.sum("_a")).alias("_left"))
    order = Window.orderBy(F.desc("_s"), F.asc(stratum))  # one row per stratum
    ranked = base.crossJoin(F.broadcast(left)).withColumn("_r", F.row_number().over(order))
    alloc = ranked.select(stratum, (F.col("_a") + (F.col("_r") <= F.col("_left")).cast("long") - ((F.col("_r") <= -F.col("_left")) & (F.col("_a") > 1)).cast("long")).alias("_alloc"))
    marked = rows.join(small_side(alloc), stratum).withColumn("_o", seeded(id_col, seed)).withColumn("_salt", F.pmod(F.xxhash64(id_col), F.lit(64)))
    for keys in ([stratum, "_salt"], [stratum]):
        w = Window.partitionBy(*keys).orderBy("_o", id_col)
        marked = marked.withColumn("_rn", F.row_number().over(w)).where("_rn <= _alloc").drop("_rn")
    return marked.drop("_alloc", "_o", "_salt")


def net_new(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    return rows.join(existing.select(key), key, "left_anti")


def index_quartiles(rows: DataFrame, value: str) -> DataFrame:
    """The values at places n/4, n/2 and 3n/4 of the sorted column: exact order statistics by counts of values.

    Distinct values are dealt into ranges; running counts stay inside a range, and only the ranges' sums meet in one task.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    counts = stored(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "values")
    parts = counts.groupBy("part").agg(F.sum("c").alias("pc"))
    line = Window.orderBy("part")  # a row for each range
    before = parts.select("part", (F.sum("pc").over(line) - F.col("pc")).alias("before"), F.sum("pc").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))
    at = counts.withColumn("run", F.sum("c").over(Window.partitionBy("part").orderBy("v"))).join(F.broadcast(before), "part").withColumn("upto", F.col("before") + F.col("run"))
    return at.agg(*[F.min(F.when(F.col("upto") > F.expr(f"(n * {q}) div 4"), F.col("v"))).alias(f"q{q}") for q in (1, 2, 3)])


#: Blocks of vectors before blocks grow, and vectors that a block has at most (64 values of 4 bytes: 17 MB).
BLOCKS, BLOCK_MOST = 24, 65_536


def _close_pairs(threshold: float):
    def run(table):
        import numpy as np
        import pyarrow as pa

        b, side, ids = (table.column(x).to_numpy() for x in ("b", "side", "id"))
        dim = len(table.column("v")[0])
        v = table.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim).astype(np.float64)
        norm = np.sqrt((v * v).sum(axis=1))
        v = np.divide(v, norm[:, None], out=np.full_like(v, np.nan), where=norm[:, None] > 0)  # of a null vector no cosine
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = not len(right)
        right = left if same else right
        found_i, found_j, found_c = [], [], []
        for a in range(0, len(left), 1024):
            own = left[a : a + 1024]
            for b in range(0, len(right), 8192):  # products of bounded size, whatever the blocks'
                other = right[b : b + 8192]
                cosine = v[own] @ v[other].T
                x, y = np.nonzero(cosine > threshold)
                i, j, c = ids[own[x]], ids[other[y]], cosine[x, y]
                use = i < j if same else i != j
                found_i.append(np.minimum(i, j)[use])
                found_j.append(np.maximum(i, j)[use])
                found_c.append(c[use])
        return pa.table({"i": np.concatenate(found_i), "j": np.concatenate(found_j), "cosine": np.concatenate(found_c)})

    return run


def near_duplicates(vectors: DataFrame, id_col: str, vec: str, threshold: float, block_rows: int = 2048) -> DataFrame:
    """Pairs ``i < j`` of vectors with a cosine above ``threshold``: exact, by products of blocks of vectors.

    Ids are whole numbers, one vector each; null ids and vectors take no part. Every block meets itself and the later ones, so a vector is copied once a block, and a task holds
    two blocks. Blocks have about ``block_rows`` vectors until there are ``BLOCKS`` of them, then they grow to ``BLOCK_MOST`` vectors before their number does: so
    what is shuffled grows with the rows up to ``BLOCKS * BLOCK_MOST`` of them. The work grows with the square of the rows.
    """
    unit = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec).alias("v")).where("id is not null and v is not null")
    rows = unit.count()
    blocks = max(1, min(-(-rows // block_rows), BLOCKS), -(-rows // BLOCK_MOST))
    unit = unit.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    left = unit.select("id", "v", "b", F.explode(F.sequence(F.col("b"), F.lit(blocks - 1).cast("long"))).alias("c"), F.lit(0).alias("side"))
    right = unit.where("b > 0").select("id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b") - 1)).alias("a"), F.col("b").alias("c"), F.lit(1).alias("side"))
    both = left.unionByName(right.withColumnRenamed("a", "b"))
    return both.groupBy("b", "c").applyInArrow(_close_pairs(threshold), "i long, j long, cosine double")


def drop_near_duplicates(vectors: DataFrame, id_col: str, vec: str, threshold: float) -> DataFrame:
    """``vectors`` without those that are close to one with a smaller id, whether that one stays or not."""
    later = near_duplicates(vectors, id_col, vec, threshold).select(F.col("j").alias("_j")).distinct()
    return vectors.join(later, F.col(id_col).cast("long") == F.col("_j"), "left_anti")


def adjusted_rand(labels: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labellings; 1 where the largest and the expected index are the same."""
    pairs = lambda c: F.sum(c * (c - 1) / 2)
    cell = labels.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    ij = cell.agg(pairs(F.col("n")).alias("ij"), F.sum("n").alias("n"))
    ra = cell.groupBy(a).agg(F.sum("n").alias("m")).agg(pairs(F.col("m")).alias("pa"))
    rb = cell.groupBy(b).agg(F.sum("n").alias("m")).agg(pairs(F.col("m")).alias("pb"))
    expected = F.col("pa") * F.col("pb") / (F.col("n") * (F.col("n") - 1) / 2)
    most = (F.col("pa") + F.col("pb")) / 2
    return ij.crossJoin(ra).crossJoin(rb).select(F.when(most == expected, 1.0).otherwise((F.col("ij") - expected) / (most - expected)).alias("ari"))


def exemplars(vectors: DataFrame, id_col: str, vec: str, cluster: str, k: int) -> DataFrame:
    """The ``k`` nearest rows to each cluster's mean by cosine."""
    flat = vectors.select(cluster, F.posexplode(F.col(vec)).alias("p", "x")).groupBy(cluster, "p").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = flat.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda s: s["m"]).alias("c"))
    j = vectors.select(F.col(id_col).alias("id"), cluster, F.col(vec).cast("array<double>").alias("v")).join(centre, cluster)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))
    dot = F.aggregate(F.zip_with("v", "c", lambda p, q: p * q), F.lit(0.0), lambda a, p: a + p)
    sim = j.select("id", cluster, F.try_divide(dot, norm("v") * norm("c")).alias("similarity"))
    w = Window.partitionBy(cluster).orderBy(F.desc(F.round("similarity", 9)), "id")
    return sim.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def rand_matrix(labels: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(a, b, ari)`` for every ordered pair of labellings, 1 on the diagonal."""
    out = labels.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], "a string, b string, ari double")
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            one = adjusted_rand(labels, a, b).select(F.explode(F.array(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")), F.struct(F.lit(b).alias("a"), F.lit(a).alias("b")))).alias("p"), "ari")
            out = out.unionByName(one.select("p.a", "p.b", "ari"))
    return out


def label_shift(rows: DataFrame, label_1: str, confidence_1: str, label_2: str, confidence_2: str, order: Sequence[str] = ("low", "medium", "high")) -> DataFrame:
    """How many rows changed their label between two labellings, and whose confidence went up, down or stayed; unknown confidences count as the lowest."""
    level = lambda c: F.greatest(F.array_position(F.array(*[F.lit(x) for x in order]), F.coalesce(c, F.lit(""))), F.lit(1))
    delta = level(F.col(confidence_2)) - level(F.col(confidence_1))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col(label_1).eqNullSafe(F.col(label_2))).alias("label_changed"), F.count_if(delta > 0).alias("conf_up"), F.count_if(delta < 0).alias("conf_down"), F.count_if(delta == 0).alias("conf_same"))


def group_profile(rows: DataFrame, group: str, value: str) -> DataFrame:
    """``(group, n, counts, most, share)``: the counts of a column's values as JSON in order of value, the commonest (ties by value) and its share."""
    c = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("c"))
    counts = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "c")))))  # one entry for each value
    return c.groupBy(group).agg(F.sum("c").alias("n"), counts.alias("counts"), F.min_by(value, F.struct((-F.col("c")).alias("m"), value)).alias("most"), (F.max("c") / F.sum("c").cast("double")).alias("share"))


def readable(rows: DataFrame, time_col: str, needed: Sequence[str] = ()) -> DataFrame:
    """Rows whose time can be read, as a time without a zone; rows with a null in ``needed`` go too."""
    return rows.withColumn(time_col, F.try_to_timestamp(F.col(time_col)).cast("timestamp_ntz")).na.drop(subset=[time_col, *needed])


def naive_utc(seconds: Column) -> Column:
    """Seconds since 1970 as a time without a zone, in UTC whatever the session's zone."""
    return F.timestamp_add("SECOND", seconds, F.lit("1970-01-01").cast("timestamp_ntz"))


def row_index(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with a gapless ``row_index`` from 0 in the order of a column, numbered range by range; ties in no order."""
    dealt = stored(rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "indexed")
    parts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = parts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each range
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return dealt.withColumn("_rn", place).join(F.broadcast(before), "_part").select((F.col("_before") + F.col("_rn") - 1).alias("row_index"), *rows.columns)


def two_pools(rows: DataFrame, id_col: str, pool: str, first: str, second: str, budget: int, seed: int = 42) -> DataFrame:
    """``budget`` rows over two pools in proportion to their sizes, each by a seeded order; the first's share is rounded, the second gets the rest."""
    sizes = {r[pool]: r["c"] for r in rows.where(F.col(pool).isin(first, second)).groupBy(pool).agg(F.count(F.lit(1)).alias("c")).collect()}  # two rows
    whole = sum(sizes.values())
    take = int(budget * sizes.get(first, 0) / whole + 0.5) if whole else 0
    own = [sample(rows.where(F.col(pool) == p), id_col, n, seed) for p, n in ((first, take), (second, budget - take))]
    return own[0].unionByName(own[1])
