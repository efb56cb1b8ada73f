"""Frequency tables, concordances and comparisons of corpora."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import text as tx
from lexloom.session import stored


def gram_counts(rows: DataFrame, grams: Column, keys: Sequence[str] = (), name: str = "gram") -> DataFrame:
    """Counts of the grams of each row, per key; counted before the shuffle."""
    return rows.select(*keys, F.explode(grams).alias(name)).groupBy(*keys, name).agg(F.count(F.lit(1)).alias("n"))


def top(counts: DataFrame, k: int, keys: Sequence[str] = (), name: str = "gram") -> DataFrame:
    """The ``k`` most frequent of each key with their rank; ties by the term."""
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), F.asc(name))
    if keys:
        return counts.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
    few = counts.orderBy(F.desc("n"), F.asc(name)).limit(k)  # at most k rows reach the window
    return few.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), F.asc(name))).cast("long"))


def combination_weight(a: Column, g: Column, skip: int) -> Column:
    """How often a pair at distance ``g`` whose first token is at 0-based ``a`` is counted by combinations over sliding windows."""
    length = 2 + 2 * skip
    return F.least(a + 1, F.lit(length) - g)


def combination_skipgrams(rows: DataFrame, tk: Column, skip: int, keys: Sequence[str] = ()) -> DataFrame:
    """Skip-grams with the multiplicity of enumerating every window's combinations, by its closed form."""
    reach = 2 + 2 * skip - 1
    held = rows.select(*keys, tk.alias("_tk"))
    pairs = F.expr(
        f"flatten(transform(sequence(1, {reach}), g -> if(size(_tk) > g, transform(sequence(1, size(_tk) - g), i -> "
        f"named_struct('gram', concat(_tk[i - 1], ' ', _tk[i - 1 + g]), 'w', cast(least(i, {2 + 2 * skip} - g) as bigint))), array())))"
    )
    return held.select(*keys, F.explode(pairs).alias("p")).groupBy(*keys, F.col("p.gram").alias("gram")).agg(F.sum("p.w").alias("n"))


def _offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the tokens before each row of its partition, and the partition."""
    at, part = 0, TaskContext.get().partitionId()
    for batch in batches:
        n = pc.fill_null(pc.list_value_length(batch.column(1)), 0).cast(pa.int64()).to_numpy(zero_copy_only=False)
        off = at + np.cumsum(n) - n
        at += int(n.sum())
        columns = [batch.column(0), batch.column(1), pa.array(off), pa.array(n), pa.array(np.full(len(n), part, dtype=np.int32))]
        yield pa.RecordBatch.from_arrays(columns, ["doc", "tk", "off", "n", "part"])


def token_table(rows: DataFrame, id_col: str, tk: Column) -> DataFrame:
    """``(doc, tk, start, n)``: the tokens of each document and their place in the stream of all documents by id, written to the shared folder.

    Documents are sorted into ranges of ids; places are summed along each range, and only the sums of the ranges (one row each) meet in one
    task. Ids may be of any type that sorts; a null text has no tokens.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number keeps small inputs in that many ranges
    dealt = rows.repartitionByRange(ranges, id_col).sortWithinPartitions(id_col)
    dealt = dealt.select(F.col(id_col).alias("doc"), F.coalesce(tk, F.array().cast("array<string>")).alias("tk"))  # tokenized after the ranges are sampled
    held = stored(dealt.mapInArrow(_offsets, f"doc {kind}, tk array<string>, off long, n long, part int"), "tokens")
    parts = held.groupBy("part").agg(F.sum("n").alias("pn"))
    before = parts.select("part", (F.sum("pn").over(Window.orderBy("part")) - F.col("pn")).alias("before"))  # a row for each range
    return held.join(F.broadcast(before), "part").select("doc", "tk", (F.col("before") + F.col("off")).alias("start"), "n")


def edge_stream(held: DataFrame, w: int) -> DataFrame:
    """``(gpos, token, left)``: the first and last ``w`` tokens of each document, where alone a window can leave it; ``left`` counts from the token to the end."""
    after = F.greatest(F.col("n") - w, F.lit(w)).cast("int")  # 0-based place of the last tokens that aren't among the first
    head = F.transform(F.slice("tk", F.lit(1), F.lit(w)), lambda t, i: F.struct(i.cast("long").alias("i"), t.alias("token")))
    tail = F.transform(F.slice("tk", after + 1, F.lit(w)), lambda t, i: F.struct((i + after).cast("long").alias("i"), t.alias("token")))
    each = held.select("start", "n", F.explode(F.concat(head, tail)).alias("e"))
    return each.select((F.col("start") + F.col("e.i")).alias("gpos"), F.col("e.token").alias("token"), (F.col("n") - F.col("e.i")).alias("left"))


def stream_ngrams(held: DataFrame, n: int) -> DataFrame:
    """N-grams of the concatenated corpus, from a ``token_table``: those inside a document are slices, only tokens near its ends are joined."""
    inside = held.select(F.explode(tx.ngrams(F.col("tk"), n)).alias("gram"))
    edge = edge_stream(held, n - 1)
    out = edge.where(F.col("left") < n).select("gpos", F.col("token").alias("gram"))
    for k in range(1, n):
        out = out.join(edge.select((F.col("gpos") - k).alias("gpos"), F.col("token").alias("_t")), "gpos").select("gpos", F.concat_ws(" ", "gram", "_t").alias("gram"))
    return inside.unionByName(out.select("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def kwic(rows: DataFrame, keys: Sequence[str], tk: Column, phrase: Sequence[str], w: int) -> DataFrame:
    """Keyword in context: one row per occurrence with ``w`` tokens on either side."""
    at = rows.select(*keys, F.explode_outer(tx.around_phrase(tk, phrase, w)).alias("h")).where("h is not null")
    return at.select(
        *keys,
        (F.col("h.at") - 1).cast("long").alias("pos"),
        F.array_join("h.left", " ").alias("left_context"),
        F.lit(" ".join(phrase)).alias("keyword"),
        F.array_join("h.right", " ").alias("right_context"),
    )
