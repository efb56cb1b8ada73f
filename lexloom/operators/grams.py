"""The most frequent n- and skip-grams of a corpus, exactly, without shuffling its grams.

Most grams of a corpus are rare and almost all that a plain count shuffles. Here a first pass sums grams into buckets by hash; as a gram is
never more frequent than its bucket, a second pass needs to count only those in full buckets, by their text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.session import stored

from .frequency import top

#: Buckets are 2 ** BITS for each table and task, in pieces of CHUNK; a slice of a batch has about SLICE tokens.
BITS, CHUNK, SLICE = 21, 1 << 14, 500_000
#: Buckets of a table that the second pass counts at first; what it finds says whether that was enough.
KEEP = 20_000
#: Rows of an Arrow batch.
BATCH_ROWS = 1_024
#: Weights that a task sums into 32 bits before it hands them on.
FLUSH = 1 << 31


@dataclass(frozen=True)
class Shape:
    """A gram of the tokens at ``offsets`` from its first one; with ``cap``, counted ``min(place of the first from 1, cap)`` times."""

    offsets: tuple[int, ...]
    cap: int | None = None


def ngram(n: int) -> tuple[Shape, ...]:
    return (Shape(tuple(range(n))),)


def gaps(*each: int) -> tuple[Shape, ...]:
    return tuple(Shape((0, g)) for g in each)


def combinations(skip: int) -> tuple[Shape, ...]:
    """Pairs with the multiplicity of enumerating every window's combinations, see ``frequency.combination_weight``."""
    length = 2 + 2 * skip
    return tuple(Shape((0, g), length - g) for g in range(1, length))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows of about ``SLICE`` tokens, but at least one row."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE, "right")))
        yield batch.slice(a, b - a)
        a = b


def _streams(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array | None]]:
    """For each mask of a slice ``mask, hashes[, tokens]``: the mask, its rows' hashes, for each token its place in its row, and the tokens."""
    masks = batch.column(0).to_numpy(zero_copy_only=False)
    for mask in np.unique(masks):
        own = batch if (masks == mask).all() else pa.RecordBatch.from_arrays([c.take(pa.array(np.flatnonzero(masks == mask))) for c in batch.columns], names=batch.schema.names)
        size = pc.fill_null(pc.list_value_length(own.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        yield int(mask), own.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64), place, own.column(2).flatten() if own.num_columns > 2 else None


def _buckets(hashes: np.ndarray, place: np.ndarray, shape: Shape, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """First tokens of the grams of a shape, their buckets and weights; a gram's bucket depends on its tokens alone."""
    reach = shape.offsets[-1]
    at = np.flatnonzero(place[reach:] >= reach) if reach else np.arange(len(place))
    h = np.zeros(len(at), np.uint64)
    for o in shape.offsets:
        h = (h ^ hashes[at + o]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    weight = None if shape.cap is None else np.minimum(place[at] + 1, shape.cap)
    return at, (h >> np.uint64(64 - bits)).astype(np.int64), weight


def _summed(kinds: Sequence[tuple[Shape, ...]], bits: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        total = 0

        def out():
            for (mask, s), counts in held.items():
                n = len(counts) // chunk
                data = pa.array([counts[i * chunk : (i + 1) * chunk].tobytes() for i in range(n)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([s] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([mask] * n, pa.int32()), data], ["s", "chunk", "mask", "data"])
            held.clear()

        for batch in batches:
            for part in _slices(batch):
                for mask, hashes, place, _ in _streams(part):
                    for s, shapes in enumerate(kinds):
                        counts = held.setdefault((mask, s), np.zeros(1 << bits, np.uint32))
                        for shape in shapes:
                            _, bucket, weight = _buckets(hashes, place, shape, bits)
                            counts += np.bincount(bucket, weight, 1 << bits).astype(np.uint32)
                            total += len(bucket) * (shape.cap or 1)
                    if total > FLUSH:
                        yield from out()
                        total = 0
        yield from out()

    return run


def _added(variants: int, chunk: int):
    """All tasks' counts of a chunk to one row for each variant."""

    def run(table: pa.Table) -> pa.Table:
        sums = np.zeros((variants, chunk), np.int64)
        for mask, data in zip(table.column("mask").to_pylist(), table.column("data"), strict=True):
            counts = np.frombuffer(data.as_buffer(), np.uint32)
            for v in range(variants):
                if mask >> v & 1:
                    sums[v] += counts
        s, c = table.column("s")[0].as_py(), table.column("chunk")[0].as_py()
        return pa.table({"variant": pa.array(range(variants), pa.int32()), "s": pa.array([s] * variants, pa.int32()), "chunk": pa.array([c] * variants, pa.int32()), "data": pa.array([x.tobytes() for x in sums], pa.binary())})

    return run


def _places(part: int):
    """The value of a chunk's bucket of rank ``part``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [int(np.partition(x, len(x) - part)[len(x) - part]) for x in (np.frombuffer(d.as_buffer(), np.int64) for d in b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.int64())], ["variant", "s", "n"])

    return run


def _full(least: dict[tuple[int, int], int]):
    """One bit for each bucket: whether its sum reaches the least of its table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = [np.packbits(np.frombuffer(d.as_buffer(), np.int64) >= least[v, s]).tobytes() for v, s, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(bits, pa.binary())], ["variant", "s", "chunk", "bits"])

    return run


def _counted(kinds: Sequence[tuple[Shape, ...]], bits: int, glue: str, full):
    """Batches of ``mask, hashes, tokens`` to ``variant, s, gram, n``, counted in each slice, of the grams in full buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = {k: np.unpackbits(np.frombuffer(v, np.uint8)).view(bool) for k, v in full.value.items()}
        variants = 1 + max((v for v, _ in marks), default=-1)
        for batch in batches:
            for part in _slices(batch):
                for mask, hashes, place, tokens in _streams(part):
                    coded = tokens.dictionary_encode()
                    code, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
                    for s, shapes in enumerate(kinds):
                        tables = [v for v in range(variants) if mask >> v & 1 and (v, s) in marks]
                        if not tables:
                            continue
                        any_of = reduce(np.logical_or, (marks[v, s] for v in tables))
                        for shape in shapes:
                            at, bucket, weight = _buckets(hashes, place, shape, bits)
                            use = np.flatnonzero(any_of[bucket])
                            if not len(use):
                                continue
                            key = np.zeros(len(use), np.int64)
                            for k, o in enumerate(shape.offsets):
                                if k > 1:  # keys of two codes fit into 64 bits, those of more may not
                                    key = np.unique(key, return_inverse=True)[1]
                                key = key * len(words) + code[at[use] + o]
                            _, first, back = np.unique(key, return_index=True, return_inverse=True)
                            n = np.bincount(back, None if weight is None else weight[use]).astype(np.int64)
                            start = at[use[first]]
                            grams = pc.binary_join_element_wise(*(words.take(pa.array(code[start + o])) for o in shape.offsets), glue)
                            for v in tables:
                                own = pa.array(marks[v, s][bucket[use[first]]])
                                text = grams.filter(own)
                                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(text), v, np.int32)), pa.array(np.full(len(text), s, np.int32)), text, pa.array(n).filter(own)], ["variant", "s", "gram", "n"])

    return run


def _tables(each: Iterable[tuple[int, int]]) -> Column:
    """Whether a row is of one of the tables ``(variant, s)``."""
    return F.concat_ws("|", "variant", "s").isin(*(f"{v}|{s}" for v, s in each))


def top_grams(rows: DataFrame, mask: str, tk: str, variants: int, kinds: Sequence[tuple[Shape, ...]], k: int, glue: str = " ", bits: int = BITS, keep: int = KEEP) -> DataFrame:
    """``(variant, s, gram, n, rank)``: the ``k`` most frequent grams of each variant of a corpus and each kind of gram, ties by the gram.

    ``tk`` is a column of tokens, ``mask`` has the bit of each variant that a row's tokens count for, so tokens that variants share are
    worked on once. Exact: a first pass sums grams into buckets, a second counts by their text all grams of the buckets that reach a
    sum ``t``. Grams elsewhere are rarer than ``t``; if the ``k``-th found is too, the second pass is made again with its count as ``t``, which no gram of the
    first ``k`` can miss. Only buckets and grams of full ones are shuffled; the result is written to the shared folder.
    """
    spark = rows.sparkSession
    conf = spark.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    kinds, chunk = tuple(kinds), min(CHUNK, 1 << bits)
    held = rows.select(F.col(mask).cast("int").alias("mask"), F.col(tk).alias("tk")).where(F.size("tk") > 0)
    hashed = held.select("mask", F.transform("tk", lambda t: F.xxhash64(t)).alias("h"), "tk")
    each = hashed.select("mask", "h").mapInArrow(_summed(kinds, bits, chunk), "s int, chunk int, mask int, data binary")
    sums = stored(each.groupBy("s", "chunk").applyInArrow(_added(variants, chunk), "variant int, s int, chunk int, data binary"), "buckets")
    part = min(chunk, max(1, -(-max(keep, 40 * k) * chunk >> bits)))
    places = sums.select("variant", "s", "data").mapInArrow(_places(part), "variant int, s int, n long").groupBy("variant", "s").agg(F.percentile("n", F.lit(0.5)).cast("long").alias("n"))
    least = {(r["variant"], r["s"]): max(1, r["n"]) for r in places.collect()}  # a row for each table
    found = []
    while least:
        marks: dict[tuple[int, int], bytes] = {}
        marked = sums.where(_tables(least)).mapInArrow(_full(least), "variant int, s int, chunk int, bits binary")
        for r in sorted(marked.collect(), key=lambda r: (r["variant"], r["s"], r["chunk"])):
            marks[r["variant"], r["s"]] = marks.get((r["variant"], r["s"]), b"") + bytes(r["bits"])  # a bit for each bucket
        full = spark.sparkContext.broadcast(marks)
        counts = hashed.mapInArrow(_counted(kinds, bits, glue, full), "variant int, s int, gram string, n long").groupBy("variant", "s", "gram").agg(F.sum("n").alias("n"))
        first = stored(top(counts, k, ["variant", "s"]), "grams")
        got = {(r["variant"], r["s"]): (r["c"], r["m"]) for r in first.groupBy("variant", "s").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("m")).collect()}
        again = {}
        for t, low in least.items():
            c, m = got.get(t, (0, 0))
            if low > 1 and (c < k or m < low):
                again[t] = m if c == k else 1
        found.append(first.where(_tables(x for x in least if x not in again)))
        least = again
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "variant int, s int, gram string, n long, rank long")


def top_of(rows: DataFrame, tk, kind: tuple[Shape, ...], k: int, glue: str = " ") -> DataFrame:
    """``(gram, n, rank)`` of one kind of gram over all rows."""
    return top_grams(rows.select(F.lit(1).alias("mask"), tk.alias("tk")), "mask", "tk", 1, (kind,), k, glue).select("gram", "n", "rank")
