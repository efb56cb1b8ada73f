"""Benchmark decontamination with a generalised suffix automaton of the benchmark's words.

The automaton holds every run of words of every benchmark item. A text's words stream through it; the state keeps
the longest run that ends at the present word and occurs in an item. Where that length reaches ``window`` words, the last
``window`` words are a window of some item and are hit; the items that have it are those of the state's end positions. An item
shorter than a window is one window itself and is met when its own state lies on the suffix path of the present state.

Most words never get that far. A stretch of words all of whose neighbouring pairs might occur in some item (a hashed bitmap
of the pairs, without false negatives) is the only place where a window can lie, so only such stretches are streamed; the
skipped ones can't hold a window.

The benchmark is cut into blocks of at most ``block_words`` words; each block's automaton is the only thing sent to the
executors, so its size is bounded whatever the benchmark's is. Every block is a pass over all documents and their results
are merged by document.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.session import stored

from .tables import arrow_map, named, sized, table, text_or_empty, worker_cache

WINDOW = 10
BLOCK_WORDS = 400_000
MAX_COVERAGE = 0.5
PAIR_BITS = 22
_MIX = 0x9E3779B97F4A7C15

#: Bytes that aren't part of a word become spaces, A-Z become a-z; bytes of other characters stay.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
_WORD = re.compile(rb"[^ ]+")


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Automaton:
    """Generalised suffix automaton of word sequences with the items that own each window.

    While it grows, states have their moves in dicts; then these are laid down as one sorted array of ``state * words + word`` with the targets
    beside it, and everything else as arrays by state, so that what is sent to the tasks has a few bytes a state.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        owner: list[set[str | None]] = [set()]
        short: dict[int, list[tuple[int, str | None]]] = {}
        self.pairs = np.zeros(1 << PAIR_BITS, dtype=bool)
        self.shortest = window
        for name, words in items:
            if not words:
                continue
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
            last = 0
            for w in ids:
                last = self._extend(last, w, owner)
                owner[last].add(name)
            if len(ids) < window:
                short.setdefault(last, []).append((len(ids), name))
                self.shortest = min(self.shortest, len(ids))
            if len(ids) > 1:
                arr = np.array(ids, dtype=np.uint64)
                self.pairs[self._slot(arr[:-1], arr[1:])] = True
        order = sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True)
        for s in order:  # end positions flow to the suffix link, but no further than the state with the window itself
            if self.len[self.link[s]] >= window:
                owner[self.link[s]] |= owner[s]
        self.window_state, self.marked = array("i", [0]) * len(self.len), array("i", [0]) * len(self.len)
        for s in reversed(order):
            up = self.link[s]
            if self.len[s] >= window:
                self.window_state[s] = s if self.len[up] < window else self.window_state[up]
            self.marked[s] = s if s in short else self.marked[up]
        self.items = {s: tuple(owner[s]) for s in set(self.window_state) if s}
        self.short = short
        self._lay_down()

    def _lay_down(self) -> None:
        self.width = len(self.vocab)
        sizes = np.fromiter(map(len, self.next), dtype=np.int64, count=len(self.next))
        n = int(sizes.sum())
        states = np.repeat(np.arange(len(sizes)), sizes)
        keys = states * self.width + np.fromiter(chain.from_iterable(self.next), dtype=np.int64, count=n)
        order = np.argsort(keys)
        targets = np.fromiter(chain.from_iterable(m.values() for m in self.next), dtype=np.int32, count=n)
        self.keys, self.targets = array("q", keys[order].tobytes()), array("i", targets[order].tobytes())
        self.link, self.len = array("i", self.link), array("i", self.len)
        del self.next

    def move(self, state: int, word: int) -> int:
        """The state after ``word``, or -1."""
        key = state * self.width + word
        i = bisect_left(self.keys, key)
        return self.targets[i] if i < len(self.keys) and self.keys[i] == key else -1

    def _new(self, length: int, link: int, moves: dict[int, int], owner: list[set[str]]) -> int:
        self.len.append(length)
        self.link.append(link)
        self.next.append(moves)
        owner.append(set())
        return len(self.len) - 1

    def _extend(self, last: int, w: int, owner: list[set[str]]) -> int:
        nxt, link, length = self.next, self.link, self.len
        if w in nxt[last]:
            q = nxt[last][w]
            if length[q] == length[last] + 1:
                return q
            return self._split(last, q, w, owner)
        cur = self._new(length[last] + 1, 0, {}, owner)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, q, w, owner)
        return cur

    def _split(self, p: int, q: int, w: int, owner: list[set[str]]) -> int:
        nxt, link = self.next, self.link
        clone = self._new(self.len[p] + 1, link[q], dict(nxt[q]), owner)
        link[q] = clone
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        return clone

    @staticmethod
    def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (((a << np.uint64(32)) ^ b) * np.uint64(_MIX)) >> np.uint64(64 - PAIR_BITS)

    def stretches(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Half-open runs of positions outside of which no window can lie."""
        known = ids >= 0
        if self.shortest == 1:
            linked = known
            least = 1
        else:
            u = ids.astype(np.uint64)
            linked = known[:-1] & known[1:] & self.pairs[self._slot(u[:-1], u[1:])]
            least = self.shortest - 1
        edges = np.flatnonzero(np.diff(np.concatenate(([0], linked.view(np.int8), [0]))))
        begins, ends = edges[::2], edges[1::2]
        far = ends - begins >= least
        extra = 0 if self.shortest == 1 else 1
        for a, b in zip(begins[far].tolist(), ends[far].tolist(), strict=True):
            yield a, b + extra

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Merged half-open runs of hit words, and the items with a window in ``words``."""
        hits: list[tuple[int, int]] = []
        found: set[str | None] = set()
        if not self.vocab or len(words) < self.shortest:
            return hits, found
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        for a, b in self.stretches(ids):
            self._stream(ids[a:b].tolist(), a, hits, found)
        return merged(hits), found

    def _stream(self, ids: list[int], at: int, hits: list[tuple[int, int]], found: set[str | None]) -> None:
        link, length, window, move = self.link, self.len, self.window, self.move
        state = size = 0
        for i, w in enumerate(ids, at + 1):
            to = -1 if w < 0 else move(state, w)
            while state and to < 0:
                state = link[state]
                size = length[state]
                to = -1 if w < 0 else move(state, w)
            if to >= 0:
                state = to
                size += 1
            if size >= window:
                hits.append((i - window, i))
                found.update(self.items[self.window_state[state]])
            s = self.marked[state]
            while s:
                for n, name in self.short[s]:
                    if n <= size:
                        hits.append((i - n, i))
                        found.add(name)
                s = self.marked[link[s]]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Items in blocks of at most ``block_words`` words (or one item); the driver holds one block at a time."""
    held: list[tuple[str | None, list[bytes]]] = []
    n = 0
    rows = benchmark.select(named(id_col).cast("string").alias("i"), named(text_col).alias("t")).where("t is not null")
    for row in rows.toLocalIterator():
        words = words_of(row["t"])
        if held and n + len(words) > block_words:
            yield held
            held, n = [], 0
        held.append((row["i"], words))
        n += len(words)
    if held:
        yield held


_RESULT = "n_words long, spans array<struct<a:int,b:int>>, items array<string>"


def _scanner(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("decontamination")
        automaton: Automaton = shared.value
        span = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        for batch in batches:
            n, spans, items = [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                hits, found = automaton.scan(words)
                n.append(len(words))
                spans.append([{"a": a, "b": b} for a, b in hits])
                items.append(sorted(found, key=lambda x: (x is None, x)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))],
                ["doc_id", "n_words", "spans", "items"],
            )

    return run


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, spans`` (half-open runs of hit words, merged) and ``items``.

    Null texts have no words. Items with a null text or without words have no window; without any, nothing is hit. An item with a null id
    hits like others and is one null in ``items``. Very long texts are scanned whole, word by word; repeated rows each have a result. With one
    block the operator is a map without any shuffle. With more, rows are joined by a row key made of the id and the text's
    digest, so repeated rows stay apart from others with the same id.
    """
    spark = docs.sparkSession
    ids = dict((f.name, f.dataType.simpleString()) for f in docs.schema)[id_col]
    rows = docs.select(named(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    passes: list[DataFrame] = []
    keyed = rows.select(F.struct("doc_id", F.sha2("text", 256).alias("d")).alias("doc_id"), "text")
    blocks = blocks_of(benchmark, item_col, item_text_col, block_words)
    first = next(blocks, [])
    second = next(blocks, None)
    if second is None:
        scan = _scanner(spark.sparkContext.broadcast(Automaton(first, window)))
        return arrow_map(rows, scan, f"doc_id {ids}, {_RESULT}")
    for block in (first, second, *blocks):
        scan = _scanner(spark.sparkContext.broadcast(Automaton(block, window)))
        passes.append(arrow_map(keyed, scan, f"doc_id struct<doc_id:{ids},d:string>, {_RESULT}"))
    some = passes[0]
    for more in passes[1:]:
        some = some.unionByName(more)
    hit = some.where("size(items) > 0")
    per_key = hit.groupBy("doc_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("_s"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("_i")
    )  # at most one distinct entry for each block
    union = F.aggregate(
        "_s",
        F.expr("cast(array() as array<struct<a:int,b:int>>)"),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["b"] >= s["a"]),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["a"].alias("a"), F.greatest(F.try_element_at(acc, F.lit(-1))["b"], s["b"]).alias("b"))))
        ).otherwise(F.concat(acc, F.array(s))),
    )
    left = passes[0].select("doc_id", "n_words").alias("l")
    joined = left.join(per_key.select(F.col("doc_id").alias("k"), union.alias("spans"), F.col("_i").alias("items")), F.col("l.doc_id").eqNullSafe(F.col("k")), "left")
    return joined.select(
        F.col("l.doc_id")["doc_id"].alias("doc_id"),
        "n_words",
        F.coalesce("spans", F.expr("cast(array() as array<struct<a:int,b:int>>)")).alias("spans"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
    )


def cut_runs(raw: bytes, folded: bytes, hits: list[tuple[int, int]]) -> bytes:
    """``raw`` without the runs of words; from the first to the last word of a run everything goes, what lies between included."""
    places = [m.span() for m in _WORD.finditer(folded)]
    out, at = [], 0
    for a, b in hits:
        out.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, raw[at:]])


def cut_spans(text: str, automaton: Automaton) -> tuple[str, float]:
    """The text without its hit words, and the share of its words that went.

    What a cut brings together is looked at again, until nothing is hit.
    """
    raw = text.encode("utf-8", "surrogatepass")
    words = gone = 0
    while True:
        folded = raw.translate(_FOLD)
        split = folded.split()
        hits, _ = automaton.scan(split)
        if not hits:
            break
        words = words or len(split)
        raw = cut_runs(raw, folded, hits)
        gone += sum(b - a for a, b in hits)
    return (raw.decode("utf-8", "surrogatepass"), gone / words) if gone else (text, 0.0)


def _cleaner(shared, names: list[str], max_coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("decontamination")
        automaton: Automaton = shared.value
        at = names.index("text")
        for batch in batches:
            keep, texts = [], []
            for text in batch.column(at).to_pylist():
                new, share = (text, 0.0) if text is None else cut_spans(text, automaton)
                keep.append(share <= max_coverage)
                texts.append(new)
            columns = [pa.array(texts, batch.schema.field(i).type) if i == at else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array(keep, pa.bool_()))

    return run


def _spotter(shared):
    """Maps ``k, text`` to ``k, spans`` of the rows with a hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("decontamination")
        automaton: Automaton = shared.value
        span = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        for batch in batches:
            keys, spans = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if hits := automaton.scan(words_of(text))[0]:
                    keys.append(key)
                    spans.append([{"a": a, "b": b} for a, b in hits])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(spans, span)], ["k", "spans"])

    return run


def _cutter(max_coverage: float):
    """Cuts the spans of all blocks from ``text`` at once; ``gone`` and ``words`` (of the uncut text) decide what stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            held = {n: batch.column(names.index(n)).to_pylist() for n in ("text", "gone", "words", "spans")}
            texts, gone, words, keep = [], [], [], []
            for text, g, w, spans in zip(*held.values(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                folded = raw.translate(_FOLD)
                hits = merged([(s["a"], s["b"]) for s in spans])
                texts.append(cut_runs(raw, folded, hits).decode("utf-8", "surrogatepass"))
                gone.append(g + sum(b - a for a, b in hits))
                words.append(w or len(folded.split()))
                keep.append(gone[-1] / words[-1] <= max_coverage)
            new = {"text": pa.array(texts, batch.schema.field("text").type), "gone": pa.array(gone, pa.int64()), "words": pa.array(words, pa.int64())}
            out = [n for n in names if n != "spans"]
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(names.index(n))) for n in out], names=out).filter(pa.array(keep, pa.bool_()))

    return run


def remove_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` (with a column ``text``) without benchmark spans.

    Spans of ``window`` words or more (or whole shorter items) go from the texts; a document with more than ``max_coverage``
    of its words hit goes altogether. Other columns pass through, rows with a null text too.

    The result doesn't depend on ``block_words``. One block is a narrow map. With more, the spans of all blocks on the same
    text are merged and cut at once, and the rows that were cut are looked at again with all blocks until nothing is hit;
    each round's rows are stored, and found by a key given when they were stored first.
    """
    spark = docs.sparkSession
    blocks = blocks_of(benchmark, "item_id", "text", block_words)
    first = next(blocks, None)
    if first is None:
        return docs
    second = next(blocks, None)
    if second is None:
        return arrow_map(docs, _cleaner(spark.sparkContext.broadcast(Automaton(first, window)), docs.columns, max_coverage), docs.schema)
    shared = [spark.sparkContext.broadcast(Automaton(block, window)) for block in chain((first, second), blocks)]
    zero = F.lit(0).cast("long")
    others = [c for c in docs.columns if c != "text"]
    rest = F.struct(*map(named, others)) if others else F.lit(True)
    left = stored(docs.select(F.monotonically_increasing_id().alias("k"), rest.alias("rest"), "text", zero.alias("gone"), zero.alias("words")), "leaks")
    clean: list[DataFrame] = []
    while True:
        texts = left.where("text is not null").select("k", "text")
        spots = reduce(DataFrame.unionByName, [arrow_map(texts, _spotter(s), "k long, spans array<struct<a:int,b:int>>") for s in shared])
        hit = stored(spots.groupBy("k").agg(F.flatten(F.collect_list("spans")).alias("spans")), "leaks-hit")
        clean.append(left.join(sized(hit.select("k")), "k", "left_anti"))
        if hit.isEmpty():
            break
        both = left.join(hit, "k")
        left = stored(arrow_map(both, _cutter(max_coverage), left.schema), "leaks")
    return reduce(DataFrame.unionByName, clean).select(*(F.col("text") if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["b"] - s["a"]).cast("long"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


OP4_SQL = r"""
with item_words as (
  select cast(item_id as varchar) as item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where text is not null),
windows as (
  select distinct item_id, least(len(w), 10) as n, list_slice(w, i, i + least(len(w), 10) - 1) as gram
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from item_words where len(w) > 0)),
doc_words as (
  select row_number() over () as rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w
  from documents),
sizes as (select distinct n from windows),
grams as (
  select rid, n, i, list_slice(w, i, i + n - 1) as gram
  from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as i from doc_words, sizes where len(w) >= n)),
met as (select rid, i, g.n, item_id from grams g join windows x on g.n = x.n and g.gram = x.gram),
hit as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + n)) as p from met) group by rid),
items as (select rid, count(*) as n_items, string_agg(item_id, ',' order by item_id) as names from (select distinct rid, item_id from met) group by rid)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc_words left join hit using (rid) left join items using (rid)
"""
