"""Sharding by proportional stratified interleaving.

Rows of each source are shuffled by a seeded hash and ranked; the fractional rank
``(2 * rank - 1) / (2 * rows of the source)`` spreads every source evenly over [0, 1). All rows are put in
the order of that fraction and the order is cut in equal runs, so every shard has the mixture of the whole.

Ranks are never taken over a whole source in one task. The hash of id, checksum and size falls into ranges, as many as the rows ask
for (``BUCKET_ROWS``); a small table of counts by (source, range) gives the rows before each range, and only the rows of one range are ranked
together. The order by fraction is numbered in the same way. Only ids, sizes and checksums are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import named, table, text_or_empty

#: Rows of a range, about; there are at least 2 ** 10 ranges and at most 2 ** 20.
BUCKET_ROWS = 50_000
SEED = 20240229


def interleave(
    docs: DataFrame, n_shards: int = 16, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """One row per row of ``docs``: its shard, its slot in the shard and the figures of its text.

    A null text has size 1 and the checksum of the empty text; a null source is a source of its own; a null id
    is hashed like any other value; repeated rows are all placed. An empty table gives an empty result.
    Ties of the hash are ordered by id, checksum and size, so the result depends on the rows alone. Very long texts are read for their size and
    checksum only.
    """
    text = text_or_empty(text_col)
    bits = min(20, max(10, (docs.count() // BUCKET_ROWS).bit_length()))
    buckets = 1 << bits
    keyed = docs.select(
        named(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("s"), named(source_col).cast("string")), F.lit("n")).alias("_source"),
    ).withColumn("_order", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size"))
    keyed = keyed.withColumn("_bucket", (F.shiftright("_order", 64 - bits) + buckets // 2).cast("int"))
    per_bucket = keyed.groupBy("_source", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("_source")
    before = per_bucket.select(
        "_source",
        "_bucket",
        (F.sum("_n").over(whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"),
        F.sum("_n").over(whole).alias("_total"),
    )
    within = Window.partitionBy("_source", "_bucket").orderBy("_order", "doc_id", "text_crc32", "size")
    ranked = (
        keyed.withColumn("_rn", F.row_number().over(within))
        .join(before, ["_source", "_bucket"])
        .withColumn("_odd", 2 * (F.col("_before") + F.col("_rn")) - 1)  # the fraction is _odd / (2 * _total)
        .withColumn("_fraction", F.col("_odd") / (2 * F.col("_total")))
        .withColumn("_cell", F.expr(f"cast((_odd * {buckets}) div (2 * _total) as int)"))
    )
    cells = ranked.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    line = Window.orderBy("_cell")
    starts = cells.select(
        "_cell",
        (F.sum("_n").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_start"),
        F.sum("_n").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_rows"),
    )
    in_cell = Window.partitionBy("_cell").orderBy("_fraction", "_source", "_order", "doc_id", "text_crc32", "size")
    placed = ranked.withColumn("_rn", F.row_number().over(in_cell)).join(F.broadcast(starts), "_cell")
    position = F.col("_start") + F.col("_rn") - 1
    return (
        placed.withColumn("_position", position)
        .withColumn("shard", F.expr(f"cast((_position * {n_shards}) div _rows as int)"))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            "shard",
            F.expr(f"_position - (shard * _rows + {n_shards - 1}) div {n_shards}").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave(table(spark, sf_dir, "documents"))
