"""Toxicity by noisy-channel deobfuscation and a linear score of the restored text.

1. A character trigram model is counted over all documents (a fixed alphabet, so its table is bounded).
2. Every word with a letter in it that also holds a look-alike (a digit or sign), a separator or a run of one character, and letters
   spaced out, become lattices: each position may stand for itself, for the letter a leetspeak symbol looks like, for one or two of a run,
   and separators may vanish. Viterbi decoding finds the likeliest reading under the channel's costs and the character model. Numbers,
   which hold no letter, stay.
3. The restored text is scored by a logistic model on hashed words and word beginnings. It learns from labelled documents outside
   the held-out fold only; beginnings that go with a label are picked by their log-odds first.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import arrow_map, named, picked, table, text_or_empty, worker_cache

FOLDS = 5
#: Labelled documents the classifier is fitted on, about; a seeded hash of the id picks them where there are more.
TRAIN_ROWS = 12_000
DIM = 1 << 19
PICKED = 4_096
CACHE_WORDS = 250_000
SEGMENT = 1 << 20

LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßáéíóúñçèêàâîôûëïœùæåø"
N_SYMBOLS = len(LETTERS) + 2  # 0: no letter, last: another letter
#: Look-alikes, fixed values.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
KEEP, SWAP, SQUEEZE, DROP = math.log(0.5), math.log(0.25), math.log(0.4), math.log(0.4)
#: What a sign or digit costs that stays inside a word.
STAYS = 6.0

_SYMBOL = {c: i + 1 for i, c in enumerate(LETTERS)}
#: A letter beside a look-alike, a separator or "!" between a letter and more of the word, or a run of three.
_DISGUISED = re.compile(r"[^\W\d_][0-9@$|+]|[0-9@$!|+][^\W\d_]|[^\W\d_][._*\-!]+[\w@$]|([^\W\d_])\1\1")
_SIGNS = "@$|+"
_SEPARATORS = " ._*-"
_BEFORE, _AFTER = "\"'([", ".,;:?!\"')]"
_LETTER = re.compile(r"[^\W\d_]")
_NOT_WORD = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A or 0x30 <= b <= 0x39 else 0x20 for b in range(256))


def _code_table() -> np.ndarray:
    codes = np.zeros(0x251, dtype=np.int64)
    for cp in range(0x251):
        c = chr(cp).lower() if cp < 0x250 else "x"
        codes[cp] = _SYMBOL.get(c, N_SYMBOLS - 1 if cp == 0x250 or c.isalpha() else 0)
    return codes


def trigram_codes(text: str) -> np.ndarray:
    cps = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4"), 0x250)
    s = np.concatenate(([0, 0], _code_table_cached()[cps], [0]))
    return (s[:-2] * N_SYMBOLS + s[1:-1]) * N_SYMBOLS + s[2:]


_codes: list[np.ndarray] = []


def _code_table_cached() -> np.ndarray:
    if not _codes:
        _codes.append(_code_table())
    return _codes[0]


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_cache("trigrams")
    total = np.zeros(N_SYMBOLS**3, dtype=np.int64)
    for batch in batches:
        held: list[np.ndarray] = []
        size = 0
        for text in batch.column(0).to_pylist():
            for a in range(0, len(text), SEGMENT):
                held.append(trigram_codes(text[a : a + SEGMENT]))
                size += len(held[-1])
                if size > SEGMENT:
                    total += np.bincount(np.concatenate(held), minlength=len(total))
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["code", "n"])


def character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log probabilities ``[a, b, c]`` of a symbol after two others, from all documents; at most ``N_SYMBOLS ** 3`` rows reach the driver."""
    counts = arrow_map(docs.select(text_or_empty(text_col).alias("text")), _count_trigrams, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    three = np.zeros(N_SYMBOLS**3)
    for row in counts.collect():
        three[row["code"]] = row["n"]
    three = three.reshape((N_SYMBOLS,) * 3)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + N_SYMBOLS)
    p2 = (two + 4 * p1) / (two.sum(axis=1, keepdims=True) + 4)
    p3 = (three + 4 * p2[None]) / (three.sum(axis=2, keepdims=True) + 4)
    return np.log(p3).astype(np.float32)


class Restorer:
    """Viterbi decoding of disguised places; readings of single words are kept in a bounded cache."""

    def __init__(self, model: np.ndarray) -> None:
        self.model = model
        self.cache: dict[str, str] = {}

    @staticmethod
    def lattice(word: str) -> list[list[tuple[str, float]]]:
        """What each position may stand for, with its cost; a run of three or more is one position, a separator a space or nothing."""
        steps: list[list[tuple[str, float]]] = []
        i = 0
        while i < len(word):
            c = word[i]
            j = i
            while j < len(word) and word[j] == c:
                j += 1
            if c in _SEPARATORS:
                steps.append([(" ", KEEP), ("", DROP)])
            elif j - i >= 3:
                options = [(c, SQUEEZE), (c * 2, SQUEEZE)]
                options += [(x * k, SQUEEZE + SWAP) for x in LEET.get(c, "") for k in (1, 2)]
                steps.append([*options, ("", DROP + SQUEEZE)] if not c.isalnum() else options)
            else:
                steps += [[(c, KEEP), *((x, SWAP) for x in LEET.get(c, ""))]] * (j - i)
            i = j
        return steps

    def cost(self, a: int, b: int, out: str) -> tuple[float, int, int]:
        """The character model's score of ``out`` after symbols ``a, b``, and the last two symbols then."""
        s = 0.0
        for c in out:
            z = _SYMBOL.get(c, N_SYMBOLS - 1 if c.isalpha() else 0)
            if z == 0 and c != " ":
                s -= STAYS
            s += float(self.model[a, b, z])
            a, b = b, z
        return s, a, b

    def decode(self, word: str) -> str:
        """The likeliest reading of a word or of spaced letters; of equal ones the first."""
        if (known := self.cache.get(word)) is not None:
            return known
        beam: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for options in [*self.lattice(word), [(" ", 0.0)]]:
            nxt: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, path) in beam.items():
                for out, cost in options:
                    s, x, y = self.cost(a, b, out)
                    s += score + cost
                    if (x, y) not in nxt or s > nxt[(x, y)][0]:
                        nxt[(x, y)] = (s, (out, path))
            beam = nxt
        _, path = max(beam.values(), key=lambda v: v[0])
        parts: list[str] = []
        while path:
            parts.append(path[0])
            path = path[1]
        read = "".join(reversed(parts))[:-1]
        if len(word) <= 64:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            self.cache[word] = read
        return read

    def word(self, word: str) -> str:
        """The reading of a word without white space, in lower case."""
        if not _DISGUISED.search(word):
            return word
        a, b = 0, len(word)
        while a < b and not word[a].isalnum() and word[a] not in _SIGNS + "!":
            a += 1
        while b > a and not word[b - 1].isalnum() and word[b - 1] not in _SIGNS:
            b -= 1
        return f"{word[:a]}{self.decode(word[a:b])}{word[b:]}"

    def restore(self, text: str) -> str:
        """``text`` in lower case with its disguised places read out and its words one space apart."""
        words = spaced_together(text.lower().split())
        return " ".join(self.decode(w) if " " in w else self.word(w) for w in words)


def spaced_together(words: list[str]) -> list[str]:
    """Three or more words of one sign each, with a letter among them, become one with spaces inside; the last may end a sentence."""
    single = [i for i, w in enumerate(words) if len(w) == 1 or (len(w) == 2 and w[1] in _AFTER)]
    out: list[str] = []
    done = i = 0
    while i < len(single):
        j = i + 1
        while j < len(single) and single[j] == single[j - 1] + 1 and len(words[single[j - 1]]) == 1:
            j += 1
        if j - i >= 3:
            first, last = single[i], single[i] + j - i
            run = " ".join([*words[first : last - 1], words[last - 1][0]])
            if _LETTER.search(run):
                out += [*words[done:first], run]
                done = last
        i = j
    return out + words[done:] if out else words


def words_of(text: str) -> set[bytes]:
    return set(text.encode("utf-8", "surrogatepass").translate(_NOT_WORD).split())


def distinct_words(text: str) -> set[str]:
    """The distinct words of a text in lower case, without signs of sentences at their ends; spaced letters are one."""
    return {w.rstrip(_AFTER).lstrip(_BEFORE) for w in set(spaced_together(text.lower().split()))}


def features_of(word: bytes) -> tuple[int, ...]:
    """Places of a word and of its two beginnings."""
    at = [zlib.crc32(b"w" + word), zlib.crc32(b"4" + word[:4]), zlib.crc32(b"5" + word[:5])]
    return tuple(x % DIM for x in at)


class Reader:
    """Places of the features of words as they stand in texts, after their decoding; kept in a bounded cache."""

    def __init__(self, model: np.ndarray, among: dict[int, float] | None = None) -> None:
        self.restorer, self.among = Restorer(model), among
        self.cache: dict[str, tuple[int, ...]] = {}

    def places(self, text: str) -> set[int]:
        """Places of a text's features; only those in ``among`` where that is given."""
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        at: set[int] = set()
        for w in distinct_words(text):
            f = cache.get(w)
            if f is None:
                read = self.restorer.decode(w) if " " in w else self.restorer.word(w)
                f = {x for part in words_of(read) for x in features_of(part)}
                f = cache[w] = tuple(f if self.among is None else f & self.among.keys())
            if f:
                at.update(f)
        return at


def _featured(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            lists = [sorted(reader.places(text)) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int32()))], ["label", "at"])

    return run


def fit(labels: np.ndarray, lists: list[np.ndarray]) -> tuple[dict[int, float], float]:
    """Weights of the picked places and the intercept of a ridge logistic model. One class only: that class's constant."""
    n1 = float(labels.sum())
    n0 = len(labels) - n1
    if not n1 or not n0:
        return {}, 0.0 if not len(labels) else (4.0 if n1 else -4.0)
    flat = np.concatenate(lists) if lists else np.zeros(0, dtype=np.int32)
    row = np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists])
    d1 = np.bincount(flat[labels[row] == 1], minlength=DIM).astype(float)
    d0 = np.bincount(flat[labels[row] == 0], minlength=DIM).astype(float)
    odds = np.log((d1 + 0.5) / (n1 - d1 + 0.5)) - np.log((d0 + 0.5) / (n0 - d0 + 0.5))
    z = np.abs(odds) / np.sqrt(1 / (d1 + 0.5) + 1 / (d0 + 0.5))
    z[(d1 + d0) < 3] = 0
    picked = np.sort(np.argsort(-z, kind="stable")[:PICKED])
    picked = picked[z[picked] > 3.0]
    slot = np.full(DIM, -1, dtype=np.int32)
    slot[picked] = np.arange(len(picked))
    use = slot[flat] >= 0
    r, c = row[use], slot[flat[use]]
    w, b = np.zeros(len(picked)), math.log(n1 / n0)
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, 301):
        p = 1 / (1 + np.exp(-(b + np.bincount(r, weights=w[c], minlength=len(labels)))))
        g = (p - labels) / len(labels)
        gw, gb = np.bincount(c, weights=g[r], minlength=len(w)) + 1e-5 * w, g.sum()
        mw, vw, mb, vb = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        fix1, fix2 = 1 - 0.9**step, 1 - 0.99**step
        w -= 0.05 * (mw / fix1) / (np.sqrt(vw / fix2) + 1e-8)
        b -= 0.05 * (mb / fix1) / (math.sqrt(vb / fix2) + 1e-8)
    return dict(zip(picked.tolist(), w.tolist(), strict=True)), float(b)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS):
    """``(character model, weights, intercept)``. Only labelled ids outside the held-out fold are used; null labels and ids aren't."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(character_model(docs, text_col))
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("double").alias("label"))
    n = known.count()
    sample = known.where(picked(rows, n, "_id", F.lit(7)))
    chosen = docs.select(named(id_col).alias("_id"), text_or_empty(text_col).alias("text")).join(F.broadcast(sample), "_id").select("label", "text")
    got = arrow_map(chosen, _featured(model), "label double, at array<int>").toArrow()
    at = got.column("at").combine_chunks()
    ends = at.offsets.to_numpy()
    flat = at.values.to_numpy()
    lists = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    weights, b = fit(got.column("label").to_numpy(), lists)
    return model, weights, b


class Scorer:
    def __init__(self, model: np.ndarray, weights: dict[int, float], b: float) -> None:
        self.reader, self.weights, self.b = Reader(model, weights), weights, b

    def score(self, text: str) -> float:
        s = self.b + sum(self.weights[x] for x in sorted(self.reader.places(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, s))))


def _scored(model, weights: dict[int, float], b: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_cache(("toxicity", model.value.tobytes()[:4096], b), lambda: Scorer(model.value, weights, b))
        for batch in batches:
            scores = [scorer.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs``.

    Null and empty texts get the score of no words; rows with null ids and repeated rows are scored like others. Without usable labels
    every score is one half or the only class's. The score is made from the text alone.
    """
    model, weights, b = train(docs, labels, id_col, text_col, label_col)
    ids = dict((f.name, f.dataType.simpleString()) for f in docs.schema)[id_col]
    rows = docs.select(named(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"), held_out(id_col).alias("held_out"))
    return arrow_map(rows, _scored(model, weights, b), f"doc_id {ids}, held_out boolean, score double, predicted int")


def _kept(model, weights: dict[int, float], b: float, at: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_cache(("toxicity", model.value.tobytes()[:4096], b), lambda: Scorer(model.value, weights, b))
        for batch in batches:
            yield batch.filter(pa.array([t is None or scorer.score(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return run


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose text scores ``threshold`` or more; null texts stay."""
    model, weights, b = train(docs, labels)
    return arrow_map(docs, _kept(model, weights, b, docs.columns.index("text"), threshold), docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
