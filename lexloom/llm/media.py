"""Media columns by content-defined chunking.

A text's payload (its UTF-8 bytes, padded with spaces to a positive multiple of ``FRAME``) is cut where a rolling gear hash of the last
64 bytes has ``MASK_BITS`` zero bits, so an edit moves only the cuts near it.

1. Every row's ordered list of chunk digests is written. Spark joins over the lists find, for each digest that several texts have, the one
   text that owns it, and the texts that stand in several rows.
2. The store is written: a row for each distinct text with its recipe and the chunks it owns. A chunk is stored once,
   whichever task meets it. Texts that own all they hold, and stand in one row, are stored where they are read; only the others are shuffled.
3. The store is read back: chunks that live in another row are joined by digest, the payload is put together in list order, every chunk is
   checked against its digest, and features are computed from these bytes.

Stored form of a text: the recipe (``CDC1``, the number of chunks, and for each chunk its length, 32-bit little-endian, and SHA-256) followed by
its chunks in order. ``media_bytes`` and ``media_sha256`` are taken from the stored recipe and chunks as they were read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.session import Scratch, stored

from .tables import arrow_map, named, sized, table, text_or_empty, worker_cache

FRAME = 192
MIN_CHUNK, MAX_CHUNK, MASK_BITS = 1024, 16_384, 11
HEAVY_SHARE = 4_096
#: Bytes of payload after which an Arrow batch is handed on.
BATCH_BYTES = 4_000_000

_GEAR = np.array([int.from_bytes(hashlib.sha256(b"gear %d" % i).digest()[:8], "little") for i in range(256)], dtype=np.uint64)


def payload_of(text: str) -> tuple[bytes, int]:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + b" " * (max(FRAME, -(-len(raw) // FRAME) * FRAME) - len(raw)), len(raw)


def gear_hashes(data: bytes) -> np.ndarray:
    """At each byte the gear hash of up to 64 bytes that end there, by doubling the width six times."""
    h = _GEAR[np.frombuffer(data, dtype=np.uint8)]
    width = 1
    while width < 64 and width < len(h):
        h[width:] = h[width:] + (h[:-width] << np.uint64(width))
        width *= 2
    return h


def cut(data: bytes, least: int = MIN_CHUNK, most: int = MAX_CHUNK, bits: int = MASK_BITS, segment: int = 1 << 22) -> list[bytes]:
    """Chunks of ``data``; hashed in segments that overlap by 63 bytes, so memory doesn't follow the length."""
    if len(data) <= least:
        return [data]
    mask = np.uint64(((1 << bits) - 1) << (64 - bits))
    places: list[int] = []
    for a in range(0, len(data), segment):
        low = max(0, a - 63)
        h = gear_hashes(data[low : a + segment])
        places.extend((np.flatnonzero((h & mask) == 0) + low + 1).tolist() if not a else [x + low + 1 for x in np.flatnonzero((h & mask) == 0).tolist() if x + low >= a])
    out, start = [], 0
    for p in [*places, len(data)]:
        while p - start > most:
            out.append(data[start : start + most])
            start += most
        if p - start >= least or (p == len(data) and p > start):
            out.append(data[start:p])
            start = p
    return out


def recipe_of(chunks: list[bytes]) -> bytes:
    return b"".join([b"CDC1", struct.pack("<I", len(chunks)), *(struct.pack("<I", len(c)) + hashlib.sha256(c).digest() for c in chunks)])


def chunks_in(recipe: bytes) -> list[tuple[int, bytes]]:
    """Length and digest of each chunk of a recipe."""
    if recipe[:4] != b"CDC1" or len(recipe) != 8 + 36 * struct.unpack_from("<I", recipe, 4)[0]:
        raise ValueError("not a whole recipe")
    return [(struct.unpack_from("<I", recipe, at)[0], recipe[at + 4 : at + 36]) for at in range(8, len(recipe), 36)]


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, key, text`` to ``doc_id, key, digests``."""
    worker_cache("media")
    for batch in batches:
        lists = [[hashlib.sha256(c).digest() for c in cut(payload_of(t)[0])] for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.list_(pa.binary()))], ["doc_id", "key", "digests"])


def _stored_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, key, text, skip`` to ``doc_id, key, n_bytes, recipe, chunks``; a chunk is null where another row, or an earlier place of this, holds it."""
    worker_cache("media")
    names = ["doc_id", "key", "n_bytes", "recipe", "chunks"]
    for batch in batches:
        done, held = 0, 0
        sizes: list[int] = []
        recipes: list[bytes] = []
        lists: list[list[bytes | None]] = []

        def out(upto: int) -> pa.RecordBatch:
            nonlocal done, held, sizes, recipes, lists
            ids = [batch.column(i).slice(done, upto - done) for i in (0, 1)]
            made = pa.RecordBatch.from_arrays([*ids, pa.array(sizes, pa.int64()), pa.array(recipes, pa.binary()), pa.array(lists, pa.list_(pa.binary()))], names)
            done, held, sizes, recipes, lists = upto, 0, [], [], []
            return made

        for i in range(batch.num_rows):
            data, n = payload_of(batch.column(2)[i].as_py())
            parts = cut(data)
            away = set(batch.column(3)[i].as_py() or ())
            own: list[bytes | None] = []
            for c in parts:
                d = hashlib.sha256(c).digest()
                own.append(None if d in away else c)
                away.add(d)
            sizes.append(n)
            recipes.append(recipe_of(parts))
            lists.append(own)
            held += len(data)
            if held > BATCH_BYTES:
                yield out(i + 1)
        if done < batch.num_rows:
            yield out(batch.num_rows)


def _owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, recipe, chunks`` of the store to ``owner, digest, data`` of the chunks held there."""
    worker_cache("media")
    for batch in batches:
        for key, recipe, chunks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held = [(d, c) for (_, d), c in zip(chunks_in(recipe), chunks, strict=True) if c is not None]
            if held:
                digests, data = zip(*held, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(held), pa.binary()), pa.array(digests, pa.binary()), pa.array(data, pa.binary())], ["owner", "digest", "data"])


def features(data: bytes) -> str:
    """Level, spread, mean step, crossings of the mean and entropy of the 8-bit samples."""
    x = np.frombuffer(data, dtype=np.uint8).astype(np.float64)
    mean = x.mean()
    share = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256) / len(x)
    share = share[share > 0]
    above = x > mean
    return f"n={len(x)};mean={mean:.4f};std={x.std():.4f};step={np.abs(np.diff(x)).mean():.4f};cross={int((above[1:] != above[:-1]).sum())};entropy={float(-(share * np.log2(share)).sum()):.4f}"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the store with the chunks that live elsewhere; each payload is rebuilt, checked and measured."""
    worker_cache("media")
    names = ["doc_id", "key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks"]
    for batch in batches:
        cols: list[list] = [[] for _ in names[3:]]
        for i in range(batch.num_rows):
            recipe, own, extra = (batch.column(j)[i].as_py() for j in (3, 4, 5))
            data = {c["digest"]: c["data"] for c in extra or ()}
            media = hashlib.sha256(recipe)
            size = len(recipe)
            parts = []
            for (n, d), part in zip(chunks_in(recipe), own, strict=True):
                if part is None:
                    part = data.get(d)
                else:
                    data[d] = part
                if part is None or len(part) != n or hashlib.sha256(part).digest() != d:
                    raise ValueError(f"chunk {d.hex()} of text {batch.column(1)[i].as_py().hex()} is missing or damaged")
                media.update(part)
                size += n
                parts.append(part)
            payload = b"".join(parts)
            for col, v in zip(cols, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), size, media.hexdigest(), features(payload), len(parts)), strict=True):
                col.append(v)
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)


class Media:
    """A store in the shared folder: ``texts`` (``doc_id, key, n_bytes, recipe, chunks``), ``moved`` (``key, digest, owner`` of chunks that live in
    another text's row) and ``copies`` (``doc_id, key`` of the rows whose text stands in several; those have a null ``doc_id`` in ``texts``)."""

    def __init__(self, texts: DataFrame, moved: DataFrame, copies: DataFrame) -> None:
        self.texts, self.moved, self.copies = texts, moved, copies


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Media:
    """Writes the payloads of ``docs`` to a new store; every distinct text has one row and every distinct chunk is stored once.

    Null texts are empty payloads of ``FRAME`` spaces. Repeated rows, equal texts and null ids are kept as rows of ``copies`` or ``texts``. An
    empty table gives an empty store. Very long texts are hashed in segments; a task holds one payload.
    """
    scratch = Scratch(docs.sparkSession, "media")
    try:
        rows = docs.select(named(id_col).alias("doc_id"), F.unhex(F.sha2(text_or_empty(text_col), 256)).alias("key"), text_or_empty(text_col).alias("text"))
        ids = rows.schema["doc_id"].dataType.simpleString()
        lists = scratch.keep(arrow_map(rows, _listed, f"doc_id {ids}, key binary, digests array<binary>"), "lists")
        several = scratch.keep(lists.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "several")
        digests = lists.select("key", F.explode(F.array_distinct("digests")).alias("digest"))
        owners = scratch.keep(digests.groupBy("digest").agg(F.min("key").alias("owner"), F.max("key").alias("last")).where("owner <> last").select("digest", "owner"), "owners")
        moved = stored(digests.join(sized(owners), "digest").where("key <> owner").distinct(), "media-moved")
        copies = stored(lists.join(sized(several), "key", "left_semi").select("doc_id", "key"), "media-copies")
        skips = moved.groupBy("key").agg(F.collect_list("digest").alias("skip"))
        apart = sized(scratch.keep(several.unionByName(moved.select("key")).distinct(), "apart"))
        plain = rows.join(apart, "key", "left_anti").select("doc_id", "key", "text", F.lit(None).cast("array<binary>").alias("skip"))
        once = rows.join(apart, "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"))
        once = once.join(sized(several).withColumn("_many", F.lit(True)), "key", "left").join(skips.hint("merge"), "key", "left")
        once = once.select(F.when(F.col("_many").isNull(), F.col("doc_id")).alias("doc_id"), "key", "text", "skip")
        schema = f"doc_id {ids}, key binary, n_bytes long, recipe binary, chunks array<binary>"
        return Media(stored(arrow_map(plain.unionByName(once), _stored_rows, schema), "media"), moved, copies)
    finally:
        scratch.close()


def read_media(store: Media) -> DataFrame:
    """A row for each row that was stored, rebuilt from the store. See the module for the law; a damaged or missing chunk is an error."""
    texts, moved = store.texts, store.moved
    ids = texts.schema["doc_id"].dataType.simpleString()
    # the chunks wanted elsewhere, read from their owner's row
    owners = texts.select("key", "recipe", "chunks").join(sized(moved.select(F.col("owner").alias("key")).distinct()), "key", "left_semi")
    live = arrow_map(owners, _owned, "owner binary, digest binary, data binary")
    brought = moved.hint("merge").join(live, ["digest", "owner"]).groupBy("key").agg(F.collect_list(F.struct("digest", "data")).alias("extra"))
    lacking = sized(moved.select("key").distinct())
    columns = ("doc_id", "key", "n_bytes", "recipe", "chunks", "extra")
    whole = texts.join(lacking, "key", "left_anti").withColumn("extra", F.lit(None).cast("array<struct<digest:binary,data:binary>>"))
    both = whole.select(*columns).unionByName(texts.join(lacking, "key", "left_semi").join(brought.hint("merge"), "key").select(*columns))
    schema = f"doc_id {ids}, key binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks int"
    measured = arrow_map(both, _read, schema)
    several = store.copies.groupBy("key").agg(F.count(F.lit(1)).alias("_rows"))
    kept = stored(measured.join(sized(several.select("key")), "key", "left_semi").drop("doc_id"), "media-copied")
    single = measured.join(sized(several.select("key")), "key", "left_anti")
    # texts with more than a 1 / HEAVY_SHARE of all copies are at most HEAVY_SHARE; their rows aren't dealt by text
    heavy = F.broadcast(several.where(F.col("_rows") * HEAVY_SHARE > store.copies.count()).select("key"))
    near = store.copies.join(F.broadcast(kept.join(heavy, "key", "left_semi")), "key")
    far = store.copies.join(heavy, "key", "left_anti").hint("merge").join(kept, "key")
    return single.drop("key").unionByName(near.drop("key")).unionByName(far.drop("key"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts are empty payloads of ``FRAME`` spaces; repeated rows and null ids are stored and read like others."""
    return read_media(store_media(table(spark, sf_dir, "documents")))
