"""N-gram Jaccard join with signature trees.

Sets of word shingles link where ``100 * shared >= 80 * all``. Texts with the same set are one node. Nodes that might link meet in
units (groups of bounded size), and in each unit a signature tree finds what links; nothing in this is left to chance.

*Signature tree.* A leaf holds a set's size and a bitmap of its shingles, an inner node the OR of its children's bitmaps and their range of
sizes. A dual traversal goes down pairs of tree nodes. Two sets below a pair share at most as many shingles as the sizes and the bits common
to both bitmaps allow; a pair goes where that can't reach the limit, or where all sets below both are connected already.

*Routing.* Shingles have one order for the whole corpus: by hash, but those that more than ``HOT`` sets have among their first ones come last.
Of ``n`` shingles in that order two sets that link have one in common among the first ``n - ceil(0.8 n) + 1`` of each, so nodes
with such a shingle in common are a bucket; buckets with the same nodes are one. The hot shingles are chosen from exact counts and
at most ``HOT_TOKENS`` of them are sent to the tasks; the order changes the size of buckets, never the result.

*Two levels.* On the first a unit holds only sizes and bitmaps, and its tree joins nodes that the bound doesn't separate. What is
joined, over all buckets, is a family; it holds every link. On the second level a family is a unit of whole shingle sets, compared exactly at the
leaves, so a text is fetched once or twice and only where something close to it exists. A unit returns links that connect what links in it, not
every link, so large groups of near copies cost about one link a node.

A bucket or family beyond ``UNIT_NODES`` nodes or ``UNIT_SHINGLES`` shingles is dealt into blocks that each hold its smallest node
too, which connects near copies over blocks; then those of its nodes that still aren't connected with its largest part meet
all its blocks in turn.

Shingles are 64-bit hashes of whole word sequences; a node is told from others by a 128-bit digest of its set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.operators.components import connected_components
from lexloom.session import Scratch, stored

from .tables import arrow_map, named, sized, table, text_or_empty, worker_cache

SHINGLE = 5
NUM, DEN = 80, 100
UNIT_NODES, UNIT_SHINGLES = 192, 1_500_000
#: Sets that may have a shingle among their first ones before it goes to the end of the order, and the most shingles that do.
HOT, HOT_TOKENS = 16, 1_000_000
MIN_BITS, MAX_BITS = 64, 1 << 16

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_PLACE = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64) + np.uint64(1 << 32)) | np.uint64(1)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of five words in a row; of fewer words, one hash of all; of none, nothing."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=n)
    width = min(n, SHINGLE)
    with np.errstate(over="ignore"):
        s = np.full(n - width + 1, width, dtype=np.uint64)
        for j in range(width):
            s = mix(s + h[j : n - width + 1 + j] * _PLACE[j])
    s.sort()
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


def digest_of(s: np.ndarray) -> tuple[int, int]:
    """128 bits of the set as two signed numbers."""
    import xxhash

    raw = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(raw[:8], "big", signed=True), int.from_bytes(raw[8:], "big", signed=True)


def first_of(n: int, num: int = NUM, den: int = DEN) -> int:
    """How many of ``n`` ordered shingles hold one of any set that links: ``n - ceil(n * num / den) + 1``."""
    return n - -(-n * num // den) + 1


def bitmap(s: np.ndarray) -> bytes:
    """A bit per shingle by its low bits, in at least twice as many bits as shingles up to ``MAX_BITS``."""
    width = MIN_BITS
    while width < 2 * len(s) and width < MAX_BITS:
        width *= 2
    flags = np.zeros(width, dtype=bool)
    flags[s & np.uint64(width - 1)] = True
    return np.packbits(flags, bitorder="little").tobytes()


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, n, hi, lo``, the first shingles by hash (a tenth of all more than needed) and the bitmap."""
    worker_cache("jaccard")
    for batch in batches:
        n, hi, lo, pre, bits = [], [], [], [], []
        for text in batch.column(1).to_pylist():
            s = shingles(text)
            n.append(len(s))
            high, low = digest_of(s) if len(s) else (None, None)
            hi.append(high)
            lo.append(low)
            pre.append(s[: first_of(len(s)) + len(s) // 10 + 1].view(np.int64) if len(s) else None)
            bits.append(bitmap(s) if len(s) else None)
        long = pa.int64()
        columns = [batch.column(0), pa.array(n, long), pa.array(hi, long), pa.array(lo, long), pa.array(pre, pa.list_(long)), pa.array(bits, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "hi", "lo", "pre", "bits"])


class Order:
    """The order of shingles: by hash, the hot ones last."""

    def __init__(self, hot: np.ndarray) -> None:
        self.hot = np.sort(hot.view(np.uint64))

    def is_hot(self, s: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.zeros(len(s), dtype=bool)
        return self.hot[np.minimum(np.searchsorted(self.hot, s), len(self.hot) - 1)] == s

    def first(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first shingles of the whole set ``s``, and which of them are hot."""
        h = self.is_hot(s)
        n = first_of(len(s))
        own = np.concatenate((s[~h], s[h]))[:n]
        return own, np.arange(n) >= len(s) - h.sum()


def _routed(shared, full: bool):
    """Rows ``token, node, n`` for nodes whose first shingles are all among the stored ones; or (``full``) the other nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("jaccard")
        order = Order(shared.value)
        for batch in batches:
            pre = batch.column(2)
            ends = pre.offsets.to_numpy()
            flat = pre.values.to_numpy()[ends[0] : ends[-1]].view(np.uint64)
            ends = ends - ends[0]
            sizes = np.diff(ends)
            row = np.repeat(np.arange(len(sizes)), sizes)
            cold = ~order.is_hot(flat)
            before = np.concatenate(([0], np.cumsum(cold)))
            n = batch.column(1).to_numpy()
            need = n - -(-n * NUM // DEN) + 1
            lacking = before[ends[1:]] - before[ends[:-1]] < need
            nodes = batch.column(0).to_numpy()
            if full:
                yield pa.RecordBatch.from_arrays([pa.array(nodes[lacking], pa.int64())], ["node"])
            else:
                use = cold & ~lacking[row] & (before[:-1] - before[ends[:-1]][row] < need[row])
                yield pa.RecordBatch.from_arrays([pa.array(flat[use].view(np.int64)), pa.array(nodes[row[use]]), pa.array(n[row[use]])], ["token", "node", "n"])

    return run


def _routed_texts(shared):
    """Rows ``hi, lo, tokens, hot`` of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("jaccard")
        order = Order(shared.value)
        for batch in batches:
            hi, lo, tokens, hot = [], [], [], []
            for text in batch.column(0).to_pylist():
                s = shingles(text)
                if len(s):
                    high, low = digest_of(s)
                    own, which = order.first(s)
                    hi.append(high)
                    lo.append(low)
                    tokens.append(own.view(np.int64))
                    hot.append(which)
            long = pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(hi, long), pa.array(lo, long), pa.array(tokens, pa.list_(long)), pa.array(hot, pa.list_(pa.bool_()))], ["hi", "lo", "tokens", "hot"])

    return run


class Tree:
    """A node of a signature tree; all leaves below have bitmaps of the same width. Made from ``(place, size, bits)`` sorted by size."""

    __slots__ = ("bits", "folded", "kids", "least", "most", "one", "place", "slack", "width")

    def __init__(self, leaves: list[tuple[int, int, int]], width: int) -> None:
        self.place = leaves[0][0]
        self.width = width
        self.one = len(leaves) == 1
        self.folded: int | None = None
        if self.one:
            _, size, self.bits = leaves[0]
            self.least = self.most = size
            self.slack = size - self.bits.bit_count()  # shingles that share a bit with another of the set
            self.kids: tuple = ()
        else:
            half = len(leaves) // 2
            a, b = self.kids = (Tree(leaves[:half], width), Tree(leaves[half:], width))
            self.bits = a.bits | b.bits
            self.least, self.most = min(a.least, b.least), max(a.most, b.most)
            self.slack = max(a.slack, b.slack)

    def half(self) -> int:
        """The bitmap at half its width."""
        if self.folded is None:
            w = self.width // 2
            self.folded = (self.bits >> w) | (self.bits & ((1 << w) - 1))
        return self.folded


class Joiner:
    """Dual traversal with union-find over ``(size, bitmap)``; with ``sets`` leaves are compared exactly, without them the bound decides."""

    def __init__(self, signs: list[tuple[int, bytes]], groups: list[int | None], sets: list[np.ndarray] | None = None, num: int = NUM, den: int = DEN) -> None:
        self.signs, self.sets, self.num, self.den = signs, sets, num, den
        self.parent = list(range(len(signs)))
        self.links: list[tuple[int, int]] = []
        self.compared = 0
        first: dict[int, int] = {}
        for i, g in enumerate(groups):  # what is connected already
            if g is not None:
                self.parent[self.find(i)] = self.find(first.setdefault(g, i))

    def trees(self, places: list[int]) -> dict[int, Tree]:
        """A tree for each width of bitmap."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for i in places:
            size, raw = self.signs[i]
            by.setdefault(8 * len(raw), []).append((i, size, int.from_bytes(raw, "little")))
        return {w: Tree(sorted(leaves, key=lambda x: (x[1], x[2])), w) for w, leaves in sorted(by.items())}

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def uniform(self, t: Tree) -> bool:
        """Whether all sets below are connected with one another."""
        if not t.one:
            a, b = t.kids
            t.one = self.uniform(a) and self.uniform(b) and self.find(a.place) == self.find(b.place)
        return t.one

    def hopeless(self, a: Tree, b: Tree) -> bool:
        num, den = self.num, self.den
        if den * a.most < num * b.least or den * b.most < num * a.least:
            return True
        if a.width == b.width:
            common = (a.bits & b.bits).bit_count()
            shared = min(a.most, b.most, a.slack + common, b.slack + common)
        else:  # the wider bitmap is folded; the slack of the other holds
            low, high = (a, b) if a.width < b.width else (b, a)
            shared = min(a.most, b.most, low.slack + (low.bits & high.half()).bit_count())
        return (den + num) * shared < num * (a.least + b.least)

    def within(self, t: Tree) -> None:
        if t.kids and not self.uniform(t):
            a, b = t.kids
            self.within(a)
            self.within(b)
            self.across(a, b)

    def across(self, a: Tree, b: Tree) -> None:
        if (self.uniform(a) and self.uniform(b) and self.find(a.place) == self.find(b.place)) or self.hopeless(a, b):
            return
        if not a.kids and not b.kids:
            self.compared += 1
            if self.sets is not None:
                x, y = self.sets[a.place], self.sets[b.place]
                both = len(x) + len(y)
                shared = both - len(np.union1d(x, y))
                if self.den * shared < self.num * (both - shared):
                    return
            self.links.append((a.place, b.place))
            self.parent[self.find(a.place)] = self.find(b.place)
        elif not b.kids or (a.kids and a.most - a.least + a.bits.bit_count() >= b.most - b.least + b.bits.bit_count()):
            for kid in a.kids:
                self.across(kid, b)
        else:
            for kid in b.kids:
                self.across(a, kid)

    def meet(self, left: dict[int, Tree], right: dict[int, Tree]) -> None:
        """Trees whose widths differ more than twofold hold sets too different in size; the widest and narrowest have any beyond."""
        for w, t in left.items():
            for x in (w // 2, w, 2 * w):
                if x in right:
                    self.across(t, right[x])

    def join(self, sides: list[int]) -> list[tuple[int, int]]:
        """Side 0 meets itself and side 1. The links as stars: every joined place with one place of its group."""
        zero, one = (self.trees([i for i, s in enumerate(sides) if s == side]) for side in (0, 1))
        for w, t in zero.items():
            self.within(t)
            if 2 * w in zero:
                self.across(t, zero[2 * w])
        self.meet(zero, one)
        touched = {self.find(a) for a, _ in self.links}
        return [(i, r) for i in range(len(self.parent)) if (r := self.find(i)) != i and r in touched]


def _unit_links(exact: bool):
    """Rows ``unit, side, node, grp`` and ``n, bits`` or (``exact``) ``hi, lo, text``, sorted by unit; one unit at a time is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("jaccard")
        unit = None
        nodes: dict[int, int] = {}
        signs: list[tuple[int, bytes]] = []
        sets: list[np.ndarray] = []
        sides: list[int] = []
        groups: list[int | None] = []
        found: list[tuple[int, int]] = []

        def close() -> None:
            if len(nodes) > 1:
                names = list(nodes)
                found.extend((names[a], names[b]) for a, b in Joiner(signs, groups, sets if exact else None).join(sides))
            for held in (nodes, signs, sets, sides, groups):
                held.clear()

        for batch in batches:
            columns = [c.to_pylist() if c.type != pa.string() else c for c in batch.columns]
            for i, (u, side, node, group) in enumerate(zip(*columns[:4], strict=True)):
                if u != unit:
                    close()
                    unit = u
                if node in nodes:  # a repeated row, or the smallest node of a bucket in its own block
                    continue
                if exact:
                    s = shingles(columns[6][i].as_py())
                    if not len(s) or digest_of(s) != (columns[4][i], columns[5][i]):  # another text under the same id
                        continue
                    sets.append(s)
                    signs.append((len(s), bitmap(s)))
                else:
                    signs.append((columns[4][i], columns[5][i]))
                nodes[node] = len(nodes)
                sides.append(side)
                groups.append(group)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])
                found.clear()
        close()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

    return run


def _in_units(rows: DataFrame, exact: bool) -> DataFrame:
    return arrow_map(rows.repartition("unit").sortWithinPartitions("unit", "node"), _unit_links(exact), "a long, b long")


def _bucket_links(scratch: Scratch, members: DataFrame, run: Callable[[DataFrame], DataFrame], unit_nodes: int, unit_shingles: int) -> DataFrame:
    """Links inside buckets. ``members``: ``key, node, cnt, weight, hub`` (the bucket's nodes, shingles and smallest node); see the module for large ones."""
    none = F.lit(None).cast("long")
    columns = ("unit", "side", "node", "grp")
    blocks = F.expr(f"if(cnt > {unit_nodes} or weight > {unit_shingles}, greatest(ceil(cnt / {unit_nodes - 1}), ceil(weight / {unit_shingles})), 1)")
    members = members.withColumn("blocks", blocks)
    block = F.expr("pmod(xxhash64(node, 17), blocks)")
    zero = F.lit(0).alias("side")
    rows = members.select(F.xxhash64("key", block).alias("unit"), zero, "node", none.alias("grp"))
    beyond = members.where("blocks > 1")
    split = beyond.limit(1).count() > 0
    if split:
        hubs = beyond.where("node = hub").select("key", "node", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("s"))
        rows = rows.unionByName(hubs.select(F.xxhash64("key", "s").alias("unit"), zero, "node", none.alias("grp"))).distinct()
    first = scratch.keep(run(rows), "links")
    if not split:
        return first
    parts = connected_components(first)
    held = scratch.keep(beyond.join(parts.withColumnRenamed("component", "grp"), "node", "left").withColumn("grp", F.coalesce("grp", "node")), "parts")
    counts = held.groupBy("key", "grp").agg(F.count(F.lit(1)).alias("m"))
    main = counts.groupBy("key").agg(F.max_by("grp", F.struct("m", "grp")).alias("main"), F.sum("m").alias("all"), F.max("m").alias("most")).where("all > most")
    held = held.join(main, "key").withColumn("sets", F.expr(f"ceil((all - most) / {unit_nodes})"))
    minor = held.where("grp <> main").withColumn("t", F.expr("pmod(xxhash64(node, 19), sets)"))
    left = minor.select("node", "grp", "key", "t", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("s")).select(F.xxhash64("key", "t", "s").alias("unit"), zero, "node", "grp")
    right = held.select("node", "grp", "key", block.alias("s"), F.explode(F.expr("sequence(0L, sets - 1)")).alias("t")).select(
        F.xxhash64("key", "t", "s").alias("unit"), F.lit(1).alias("side"), "node", "grp"
    )
    # a minor node that is also in the block stands on side 0
    both = left.unionByName(right).groupBy("unit", "node").agg(F.min("side").alias("side"), F.first("grp").alias("grp"))
    return first.unionByName(scratch.keep(run(both.select(*columns)), "links"))


def _hot_tokens(scratch: Scratch, nodes: DataFrame, hot: int, hot_tokens: int) -> np.ndarray:
    """Shingles that more than ``hot`` nodes have among their first; where there are too many, those over the next power of two that leaves few enough."""
    counts = nodes.select(F.explode("pre").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt") > hot)
    counts = scratch.keep(counts.withColumn("size", F.floor(F.log2("cnt")).cast("int")), "counts")
    sizes = sorted(((r["size"], r["n"]) for r in counts.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)  # at most 63 rows
    least, held = 64, 0
    for size, n in sizes:
        if held + n > hot_tokens:
            break
        least, held = size, held + n
    found = counts.where(F.col("size") >= least).select("token").toArrow().column(0).to_numpy()
    scratch.drop(counts)
    return found


def _with_partner(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of buckets without the nodes that no other node of their bucket is close to in size; none of those could link there."""
    line = Window.partitionBy(*keys).orderBy("n")
    near = (F.lead("n").over(line) * NUM <= F.col("n") * DEN) | (F.col("n") * NUM <= F.lag("n").over(line) * DEN)
    return rows.withColumn("_near", near).where("_near").drop("_near")


def _buckets(scratch: Scratch, nodes: DataFrame, reps: DataFrame, source: DataFrame, hot: int, hot_tokens: int) -> DataFrame:
    """``key, node, cnt, weight, hub`` of buckets with more than one node."""
    shared = scratch.spark.sparkContext.broadcast(_hot_tokens(scratch, nodes, hot, hot_tokens))
    stems = nodes.select("node", "n", "pre")
    rich = scratch.keep(arrow_map(stems, _routed(shared, True), "node long").join(reps, "node"), "rich")
    texts = source.join(sized(rich.select(F.col("rep").alias("_id")).distinct()), "_id", "left_semi").select("text")
    routed = arrow_map(texts, _routed_texts(shared), "hi long, lo long, tokens array<long>, hot array<boolean>").dropDuplicates(["hi", "lo"])
    again = routed.join(sized(rich.select("hi", "lo", "node", "n")), ["hi", "lo"]).select("node", "n", F.explode(F.arrays_zip("tokens", "hot")).alias("t"))
    again = scratch.keep(again.select(F.col("t.tokens").alias("token"), "node", "n", F.col("t.hot").alias("hot")), "rich-tokens")
    scratch.drop(rich)
    # hot shingles may be those of any number of near copies: counted with a map-side combine and joined
    warm = again.where("hot").select("token", "node", "n")
    counts = warm.groupBy("token").agg(F.count(F.lit(1)).alias("cnt"), F.bit_xor(F.xxhash64("node")).alias("x"), F.min("node").alias("hub"), F.max("node").alias("top")).where("cnt > 1")
    warm = warm.join(counts, "token")
    # others have at most as many rows as the count of what isn't hot allows, so their rows are shuffled once and put together there
    cold = arrow_map(stems, _routed(shared, False), "token long, node long, n long").unionByName(again.where("not hot").select("token", "node", "n"))
    over = Window.partitionBy("token")
    cold = _with_partner(cold.repartition("token"), "token").select(
        "token", "node", "n", *(c.over(over) for c in (F.count(F.lit(1)), F.bit_xor(F.xxhash64("node")), F.min("node"), F.max("node")))
    ).toDF("token", "node", "n", "cnt", "x", "hub", "top")
    rows = cold.where("cnt > 1").unionByName(warm.select(*cold.columns)).select(F.xxhash64("cnt", "x", "hub", "top").alias("key"), "node", "cnt", F.lit(0).cast("long").alias("weight"), "hub")
    made = scratch.keep(rows.dropDuplicates(["key", "node"]), "buckets")
    scratch.drop(again)
    return made


def components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    unit_nodes: int = UNIT_NODES,
    unit_shingles: int = UNIT_SHINGLES,
    hot: int = HOT,
    hot_tokens: int = HOT_TOKENS,
) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for each row of ``docs``; the component is the smallest id that links lead to.

    Null and empty texts and texts without words have an empty set, link with nothing and are their own component. Rows
    with a null id have a null component and play no part in links. Repeated rows and equal texts are one node; the same
    id with different texts is a node for each. An empty table gives an empty result. Only id and text are read. Very long texts are
    read whole: a task holds the shingles of one text, and on the second level those of one unit. The
    result is written to the shared folder; all intermediate tables are deleted.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    try:
        return stored(_components(scratch, docs.select(named(id_col).alias("_id"), text_or_empty(text_col).alias("text")), unit_nodes, unit_shingles, hot, hot_tokens), "jaccard-result")
    finally:
        scratch.close()


def _components(scratch: Scratch, source: DataFrame, unit_nodes: int, unit_shingles: int, hot: int, hot_tokens: int) -> DataFrame:
    ids = source.schema["_id"].dataType.simpleString()
    signed = arrow_map(source, _signed, f"doc_id {ids}, n long, hi long, lo long, pre array<long>, bits binary")
    signed = scratch.keep(signed.withColumn("row", F.monotonically_increasing_id()), "sets")
    known = signed.where("hi is not null and doc_id is not null")
    # a node is known by the smallest row of its set; the other rows of it are few, or many of few sets
    reps = scratch.keep(known.groupBy("hi", "lo").agg(F.min("row").alias("node"), F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.count(F.lit(1)).alias("rows")), "nodes")
    copies = known.select("row", "hi", "lo").join(sized(reps.where("rows > 1").select("hi", "lo", "node")), ["hi", "lo"]).where("row <> node").select("row")
    nodes = known.join(sized(scratch.keep(copies, "copies")), "row", "left_anti").select(F.col("row").alias("node"), "n", "pre", "bits")
    buckets = _buckets(scratch, nodes, reps, source, hot, hot_tokens)
    scratch.sweep()
    signs = nodes.select("node", "n", "bits")
    close = _bucket_links(scratch, buckets, lambda rows: _in_units(rows.hint("merge").join(signs, "node").select("unit", "side", "node", "grp", "n", "bits"), False), unit_nodes, unit_shingles)
    families = scratch.keep(connected_components(close).join(reps, "node"), "families")
    scratch.drop(buckets, close)
    sizes = families.groupBy("component").agg(F.count(F.lit(1)).alias("cnt"), F.sum("n").alias("weight"))
    members = scratch.keep(families.join(sizes, "component").select(F.col("component").alias("key"), "node", "cnt", "weight", F.col("component").alias("hub")), "members")

    def compare(rows: DataFrame) -> DataFrame:
        rows = rows.join(families.select("node", "rep", "hi", "lo"), "node")
        texts = source.join(sized(families.select(F.col("rep").alias("_id")).distinct()), "_id", "left_semi")
        return _in_units(texts.join(rows.withColumnRenamed("rep", "_id"), "_id").select("unit", "side", "node", "grp", "hi", "lo", "text"), True)

    joined = connected_components(_bucket_links(scratch, members, compare, unit_nodes, unit_shingles))
    # the smallest id of each component, from the smallest of each node
    linked = reps.select("hi", "lo", "node", "rep").join(joined, "node", "left").withColumn("root", F.coalesce("component", "node"))
    least = linked.where("component is not null").groupBy("root").agg(F.min("rep").alias("component_id"))
    target = linked.join(least, "root", "left").select("hi", "lo", F.coalesce("component_id", "rep").alias("component_id"))
    with_node = signed.where("hi is not null").select("doc_id", "n", "hi", "lo").join(target, ["hi", "lo"], "left").select("doc_id", "n", "component_id")
    without = signed.where("hi is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return with_node.unionByName(without).select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest id.

    Rows with a null id and rows without words stay. Of repeated rows (same id and text) that link with something or with
    one another one stays. Other columns, whatever their names, pass through.
    """
    found = components(docs)
    columns = [named(c) for c in docs.columns]
    ids = found.where("doc_id is not null and n_shingles > 0").groupBy("doc_id").agg(F.max((F.col("doc_id") == F.col("component_id")).cast("int")).alias("own"), F.count(F.lit(1)).alias("rows"))
    kept = docs.join(sized(ids.where("own = 0").select("doc_id")), "doc_id", "left_anti").select(*columns)
    again = ids.where("own = 1 and rows > 1").select("doc_id")
    if not again.limit(1).count():
        return kept
    again = sized(again)
    once = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*columns)
    return kept.join(again, "doc_id", "left_anti").select(*columns).unionByName(once)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
with recursive words as (
  select row_number() over () as rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as w from documents),
grams as (select distinct rid, list_slice(w, i, i + least(len(w), 5) - 1) as g from (select rid, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from words where len(w) > 0)),
sizes as (select rid, count(*) as n, min(hash(g)) as m, sum(hash(g)::hugeint % 1000000007) as h from grams group by rid),
classes as (select rid, n, min(rid) over (partition by n, m, h) as c from sizes),
reps as (select c as rid, any_value(n) as n from classes group by c),
few as (select g, rid from grams semi join reps using (rid)),
shared as (select a.rid as a, b.rid as b, count(*) as k from few a join few b on a.g = b.g and a.rid < b.rid group by all),
links as (select a, b from shared join reps x on x.rid = a join reps y on y.rid = b where 100 * k >= 80 * (x.n + y.n - k)),
edges as (select a, b from links union select b, a from links union select rid, rid from reps),
reach(a, b) as (select a, b from edges union select r.a, e.b from reach r join edges e on r.b = e.a),
roots as (select a as c, min(b) as root from reach group by a),
named as (select words.rid, words.doc_id, n, root from words left join classes using (rid) left join roots using (c))
select doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, case when n is null then doc_id else min(doc_id) over (partition by root, n is null) end as component_id from named
"""
