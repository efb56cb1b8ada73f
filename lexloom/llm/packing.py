"""Packing by Karmarkar-Karp multiway differencing.

Each document's ids are cut: what fills whole sequences becomes such, the rest is cut into pieces of at most
``PIECE`` ids. A block of pieces is then split into ``k`` windows of nearly equal sums: every piece starts as a partition of its own
with one loaded window, and the two partitions of the largest imbalance are merged, the fullest windows of one with the
emptiest of the other, until one is left. If its fullest window exceeds the capacity, ``k`` rises and the block is split again.

A block holds about ``BLOCK_WINDOWS`` windows of one input partition, so memory and work are bounded, nothing is shuffled and a
task that is run again gives the same sequences. ``sequence_id`` is the input partition's number and a count within it.
"""

from __future__ import annotations

import heapq
import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import arrow_map, table, text_or_empty, worker_cache

SEQUENCE = 2048
PIECE = 512
BLOCK_WINDOWS = 128
END_ID = 1
#: Words in each of the two generations of an encoder's cache.
CACHE_WORDS = 300_000
#: These count as white space for Python's split but not for the tokenizer's pattern.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")


#: The tokenizer's own pattern of pre-tokens, a fixed value.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> dict[int, str]:
    """Byte-level letters: bytes that print in Latin-1 stand for themselves, the others for letters from U+0100 on, in turn."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {x: chr(0x100 + i) for i, x in enumerate(b for b in range(256) if b not in plain)}


class WordEncoder:
    """Ids of a text by a tokenizer that drops white space and never joins across it.

    Normalisation, pre-tokenization and special strings all stop at white space, so the ids of a text are those of its
    words in turn; words are kept in a cache of two generations, each bounded. A new word of letters below U+0250 goes straight to the
    tokenizer's merge model; one with signs or digits among them is first cut by the tokenizer's pattern. Others take the whole tokenizer.
    """

    def __init__(self, name: str, cache_words: int = CACHE_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(public_tokenizers.path(name))
        self.model = self.tok.model
        self.limit = cache_words
        self.fresh: dict[str, bytes] = {}
        self.aged: dict[str, bytes] = {}
        self.pieces = regex.compile(_PIECES).findall
        self.letters = byte_letters()

    def encode(self, text: str) -> np.ndarray:
        """Ids as little-endian unsigned 32-bit numbers.

        Words are looked up in lower case, as the tokenizer would make them. Texts in which that could differ (special strings,
        a final sigma, unusual white space, other normal forms) are encoded whole.
        """
        if "<|" in text or "Σ" in text or any(c in text for c in _ODD) or not unicodedata.is_normalized("NFC", text):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4")
        words = text.lower().split()
        found = list(map(self.fresh.get, words))
        if None in found:
            for i, known in enumerate(found):
                if known is None:
                    found[i] = self._word(words[i])
        ids = np.frombuffer(b"".join(found), dtype="<u4")
        if len(self.fresh) > self.limit:
            self.aged, self.fresh = self.fresh, {}
        return ids

    def _word(self, word: str) -> bytes:
        """Ids of a word (or of a pre-token, which is its own only one), now in the cache."""
        known = self.fresh.get(word)
        if known is None:
            known = self.aged.get(word)
            if known is None:
                if max(word) >= "ɐ":
                    ids = self.tok.encode(word, add_special_tokens=False).ids
                    known = np.array(ids, dtype="<u4").tobytes()
                elif word.isalpha() or len(parts := self.pieces(word)) == 1:
                    plain = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)
                    known = array("I", [t.id for t in self.model.tokenize(plain)]).tobytes()
                else:
                    known = b"".join(map(self._word, parts))
            self.fresh[word] = known
        return known


def differencing(sizes: list[int], k: int) -> tuple[list[int], list[list[int]]]:
    """The sums and members of ``k`` windows, by largest differencing.

    A partition keeps its windows' loads in falling order, the smallest taken off; the taken part plays no role in differences.
    Members are kept as binary trees of pieces: node ``i`` below ``len(sizes)`` is a piece, others join two nodes.
    """
    n = len(sizes)
    empty = -1
    kids: list[tuple[int, int]] = []
    heap = []
    for i, s in enumerate(sizes):
        loads, nodes = np.zeros(k, dtype=np.int64), np.full(k, empty, dtype=np.int64)
        loads[0], nodes[0] = s, i
        heap.append((-s, i, loads, nodes, 1))
    heapq.heapify(heap)
    serial = n
    while len(heap) > 1:
        _, _, la, na, ua = heapq.heappop(heap)
        _, _, lb, nb, ub = heapq.heappop(heap)
        if ua + ub <= k:  # the loaded windows of both fit side by side
            loads, nodes = la.copy(), na.copy()
            loads[k - ub :], nodes[k - ub :] = lb[:ub][::-1], nb[:ub][::-1]
            used = ua + ub
        else:
            loads = la + lb[::-1]
            nodes, other = na.copy(), nb[::-1]
            both = np.flatnonzero((na >= 0) & (other >= 0))
            nodes[na < 0] = other[na < 0]
            nodes[both] = np.arange(n + len(kids), n + len(kids) + len(both))
            kids.extend(zip(na[both].tolist(), other[both].tolist(), strict=True))
            used = k
        order = np.argsort(-loads, kind="stable")
        loads, nodes = loads[order], nodes[order]
        loads = loads - loads[-1]
        heapq.heappush(heap, (-int(loads[0]), serial, loads, nodes, used))
        serial += 1
    members: list[list[int]] = []
    for root in heap[0][3].tolist() if heap else []:
        stack, own = [root], []
        while stack:
            x = stack.pop()
            if x >= n:
                stack.extend(kids[x - n])
            elif x >= 0:
                own.append(x)
        members.append(sorted(own))
    return [sum(sizes[i] for i in m) for m in members], members


def windows(sizes: list[int], capacity: int = SEQUENCE) -> list[list[int]]:
    """Members of near-equal windows of at most ``capacity``; the count rises while it is exceeded."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        loads, members = differencing(sizes, k)
        if max(loads, default=0) <= capacity:
            return [m for m in members if m]
        k = max(k + 1, -(-k * (max(loads) + sum(loads) // k) // (2 * capacity)))


_COLUMNS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _packer(tokenizer: str, capacity: int, piece: int, block_windows: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_cache(("packing", tokenizer), lambda: WordEncoder(tokenizer))
        end = np.array([end_id], dtype="<u4")
        sequence = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        pool: list[tuple] = []  # (doc, start, length, crc, tokens)
        pooled = 0
        kind = None

        def place(full: bool) -> None:
            nonlocal sequence, pool, pooled
            if pool and (full or pooled >= block_windows * capacity):
                for members in windows([p[2] for p in pool], capacity):
                    offset = 0
                    for i in members:
                        rows.append((*pool[i], sequence, offset))
                        offset += pool[i][2]
                    sequence += 1
                pool, pooled = [], 0

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

        for batch in batches:
            kind = batch.column(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.concatenate((encoder.encode(text), end))
                raw, n = memoryview(ids).cast("B"), len(ids)
                whole = n // capacity * capacity
                for start in range(0, whole, capacity):
                    rows.append((doc, start, capacity, zlib.crc32(raw[4 * start : 4 * (start + capacity)]), n, sequence, 0))
                    sequence += 1
                parts = -(-(n - whole) // piece)
                for j in range(parts):  # near-equal pieces of the rest
                    a, b = whole + (n - whole) * j // parts, whole + (n - whole) * (j + 1) // parts
                    pool.append((doc, a, b - a, zlib.crc32(raw[4 * a : 4 * b]), n))
                    pooled += b - a
                place(False)
                if len(rows) >= 20_000:
                    yield out()
        place(True)
        if rows:
            yield out()

    return run


def pack(
    docs: DataFrame,
    tokenizer: str = "word_bpe_49k.json",
    capacity: int = SEQUENCE,
    piece: int = PIECE,
    block_windows: int = BLOCK_WINDOWS,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece of each row of ``docs``: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A null or empty text is the end id alone; repeated rows and null ids are packed like others; an empty table gives no
    piece. Other columns aren't read. No sequence holds more than ``capacity`` ids, and offsets have no gap.
    """
    ids = dict((f.name, f.dataType.simpleString()) for f in docs.schema)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return arrow_map(rows, _packer(tokenizer, capacity, piece, block_windows, end_id), f"doc_id {ids}, {_COLUMNS}")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
