"""Token counts by overlap resynchronisation.

A text of ordinary length is encoded whole. A huge text is encoded in overlapping chunks with offsets. In the
overlap the two encodings are spliced at a token start that both have and that is *proven* stable: the character
before it is no white space and the one at it is. The pre-tokenizer's pattern ends every pre-token at such a place,
whatever precedes or follows, and matches on from there without looking back; no special token holds white space.
So the tokens before the place are those of the whole text in the left chunk, and those from it on in the right one.
Where an overlap has no such place it is doubled, and in the end the chunk itself grows, up to the whole text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import arrow_map, table, text_or_empty, worker_cache

CHUNK_CHARS = 65_536
OVERLAP_CHARS = 1_024
BATCH_CHARS = 500_000
LIMIT = 1024

#: White space of the pre-tokenizers' patterns (Unicode White_Space), fixed values.
WHITE = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def load_tokenizer(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def stable(text: str, at: int) -> bool:
    """Whether a pre-token is proven to end before ``at`` in any context."""
    return 0 < at < len(text) and text[at] in WHITE and text[at - 1] not in WHITE


def splice(text: str, left_starts: list[int], right_starts: list[int], low: int, high: int) -> int | None:
    """The last proven boundary in ``(low, high)`` at which both encodings have a token start."""
    for at in sorted({x for x in left_starts if low < x < high} & {x for x in right_starts if low < x < high}, reverse=True):
        if stable(text, at):
            return at
    return None


def count_spliced(encode_starts, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Tokens of ``text``; ``encode_starts(piece)`` gives the start of each token of a piece."""
    size = len(text)
    total = valid = 0
    end = min(size, chunk)
    starts = encode_starts(text[:end])  # starts in the text of the current chunk's tokens
    while end < size:
        width = overlap
        while True:
            low = max(valid, end - width)
            high = min(size, low + chunk + width)
            right = [low + x for x in encode_starts(text[low:high])]
            at = splice(text, starts, right, low, end)
            if at is not None:
                total += sum(valid <= x < at for x in starts)
                starts, valid, end = right, at, high
                break
            if low > valid:
                width *= 2
                continue
            end = min(size, valid + 2 * (end - valid))  # no proven boundary in the whole chunk: it grows
            starts = [valid + x for x in encode_starts(text[valid:end])]
            break
    return total + sum(x >= valid for x in starts)


def _count(tokenizer: str, chunk: int, overlap: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = worker_cache(("tokens", tokenizer), lambda: load_tokenizer(tokenizer))

        def starts(piece: str) -> list[int]:
            return [a for a, _ in tok.encode(piece, add_special_tokens=False).offsets]

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            counts: list[int] = [0] * len(texts)
            held: list[int] = []
            chars = 0

            def flush() -> None:
                nonlocal held, chars
                for i, e in zip(held, tok.encode_batch_fast([texts[i] for i in held], add_special_tokens=False), strict=True):
                    counts[i] = len(e)
                held, chars = [], 0

            for i, text in enumerate(texts):
                if len(text) > chunk:
                    counts[i] = count_spliced(starts, text, chunk, overlap)
                elif text:
                    held.append(i)
                    chars += len(text)
                    if chars > BATCH_CHARS:
                        flush()
            flush()
            n = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids, batch.column(2), n, pa.array([c > limit for c in counts], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    return run


def count_tokens(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    limit: int = LIMIT,
    chunk: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for each row of ``docs``, repeated rows and null ids included.

    A null or empty text has no bytes and no tokens. A narrow map: nothing is shuffled, other columns aren't read, and a
    task holds the encodings of about ``BATCH_CHARS`` characters or of two chunks at a time, however long a text is.
    """
    ids = dict((f.name, f.dataType.simpleString()) for f in docs.schema)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    return arrow_map(rows, _count(tokenizer, chunk, overlap, limit), f"doc_id {ids}, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
