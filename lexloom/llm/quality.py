"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or not at all on every document. Expectation-maximisation over the counts of vote
patterns (at most three to the power of the labellers, whatever the corpus' size) estimates each labeller's accuracy and the posterior of
every pattern. The posteriors are the labels from which a linear scorer on hashed words and word shapes learns; the scorer then judges all
documents by their text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import arrow_map, named, picked, table, text_or_empty

LABELLERS = ("length", "word_length", "letters", "variety", "repeated_lines", "symbols", "capitals", "breaks", "echoes", "marks", "density")
#: Documents the scorer is fitted on, about; a seeded hash of id and text length picks them where there are more.
TRAIN_ROWS = 12_000
DIM = 1 << 16
CACHE_WORDS = 250_000
ROUNDS = 100

_LETTER = bytes(1 if 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 else 0 for b in range(256))
_SIGN = re.compile(r"[#$%&*<>{}\[\]|\\~^=_@]")
_MARKS = re.compile(r"[#$%&*<>{}\[\]|\\~^=_@]+")
_SHAPES = ((re.compile(r"[^\W\d_]+"), "a"), (re.compile(r"\d+"), "0"), (re.compile(r"(\W)\1+"), r"\1"))


def _vote(x: float, bad_below: float, good_from: float) -> str:
    return "b" if x < bad_below else "g" if x >= good_from else "-"


def votes(text: str) -> str:
    """One sign per labeller: ``g`` good, ``b`` bad, ``-`` none. A text without words is voted bad by length and not at all by others."""
    words = text.split()
    n = len(words)
    if not n:
        return "b" + "-" * (len(LABELLERS) - 1)
    raw = text.encode("utf-8", "surrogatepass")
    letters = sum(raw.translate(_LETTER)) / max(1, len(raw) - raw.count(b" ") - raw.count(b"\n"))
    mean = sum(map(len, words)) / n
    lines = [x for x in text.split("\n") if x.strip()]
    repeated = 1 - len(set(lines)) / len(lines) if lines else 0.0
    variety = len(set(words)) / n
    signs = len(_SIGN.findall(text)) / n
    capitals = sum(w[0].isupper() and w[-1].isupper() and len(w) > 1 for w in words) / n
    marks = len(_MARKS.findall(text)) / n
    density = len(zlib.compress(raw, 1)) / len(raw)  # repeated passages of any length make it small
    echoes = sum(map(eq, words, words[1:])) / n
    short = n < 20
    return "".join(
        (
            _vote(n, 3, 40),
            "-" if short else "b" if mean < 2.5 or mean > 12 else "g" if 3.5 <= mean <= 9 else "-",
            _vote(letters, 0.75, 0.93),
            "-" if n < 50 else _vote(variety, 0.25, 0.4),
            "-" if len(lines) < 3 else "b" if repeated > 0.3 else "g" if repeated == 0 else "-",
            "b" if signs > 0.15 else "g" if signs < 0.03 else "-",
            "b" if capitals > 0.2 else "g" if capitals < 0.05 else "-",
            "-" if n < 50 else "b" if len(lines) > n / 3 else "g" if len(lines) < n / 6 else "-",
            "-" if short else "b" if echoes > 0.05 else "g" if echoes < 0.01 else "-",
            "b" if marks > 0.1 else "g" if marks < 0.02 else "-",
            "-" if n < 50 else "b" if density < 0.25 else "g" if density >= 0.35 else "-",
        )
    )


def estimate(patterns: dict[str, int], rounds: int = ROUNDS) -> tuple[float, np.ndarray, dict[str, float]]:
    """``(share of good, table [class, labeller, vote], posterior of good per pattern)`` by expectation-maximisation.

    Votes are taken as independent given the class; where a labeller doesn't vote it has no say. It starts from the share of good among each pattern's votes; smoothing
    keeps every probability inside (0, 1). Class 1 is the one the majority of votes calls good.
    """
    if not patterns:
        return 0.5, np.zeros((2, len(LABELLERS), 3)), {}
    names = sorted(patterns)
    weight = np.array([patterns[p] for p in names], dtype=float)
    votes_at = np.array([["-gb".index(v) for v in p] for p in names])
    good, bad = (votes_at == 1).sum(axis=1), (votes_at == 2).sum(axis=1)
    post = (good + 1) / (good + 2 * bad + 2)
    k = votes_at.shape[1]
    share, cond = 0.5, np.zeros((2, k, 3))
    for _ in range(rounds):
        for c, p in ((1, post), (0, 1 - post)):
            for j in range(k):
                n = np.bincount(votes_at[:, j], weights=weight * p, minlength=3) + 0.5
                cond[c, j] = n / n[1:].sum()
                cond[c, j, 0] = 1.0  # not voting says nothing about the class
        share = float((weight * post).sum() + 1) / float(weight.sum() + 2)
        logit = math.log(share / (1 - share)) + sum(np.log(cond[1, j, votes_at[:, j]] / cond[0, j, votes_at[:, j]]) for j in range(k))
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return share, cond, dict(zip(names, post.tolist(), strict=True))


class Features:
    """Hashed places of words and of their shapes, with their share of the words; and one place per vote."""

    def __init__(self) -> None:
        self.cache: dict[str, tuple[int, int]] = {}

    def of(self, text: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        count: Counter[int] = Counter()
        words = text.split()
        for w, n in Counter(words).items():
            f = cache.get(w)
            if f is None:
                shape = w
                for pat, to in _SHAPES:
                    shape = pat.sub(to, shape)
                f = cache[w] = (zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % DIM, zlib.crc32(b"s" + shape.encode("utf-8", "surrogatepass")) % DIM)
            count[f[0]] += n
            count[f[1]] += n
        at = [*count, *(zlib.crc32(b"v%d%s" % (j, v.encode())) % DIM for j, v in enumerate(pattern) if v != "-")]
        x = [c / len(words) for c in count.values()] + [0.25] * (len(at) - len(count))
        return np.array(at, dtype=np.int32), np.array(x, dtype=np.float32)


def _voting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()
    for batch in batches:
        counts.update(votes(t) for t in batch.column(0).to_pylist())
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["pattern", "n"])


def _featured(posterior: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            ats, xs, ys = [], [], []
            for text in batch.column(0).to_pylist():
                p = votes(text)
                at, x = features.of(text, p)
                ats.append(at)
                xs.append(x)
                ys.append(posterior[p])
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.float64()), pa.array(ats, pa.list_(pa.int32())), pa.array(xs, pa.list_(pa.float32()))], ["y", "at", "x"])

    return run


def fit(y: np.ndarray, row: np.ndarray, at: np.ndarray, x: np.ndarray, steps: int = 200) -> tuple[np.ndarray, float]:
    """Logistic weights on soft labels by full-batch Adam with a small ridge."""
    w, b = np.zeros(DIM), 0.0
    mw, vw, mb, vb = np.zeros(DIM), np.zeros(DIM), 0.0, 0.0
    for step in range(1, steps + 1 if len(y) else 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(row, weights=w[at] * x, minlength=len(y)), -30, 30)))
        g = (p - y) / len(y)
        gw, gb = np.bincount(at, weights=g[row] * x, minlength=DIM) + 1e-7 * w, g.sum()
        mw, vw, mb, vb = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        w -= 0.1 * (mw / (1 - 0.9**step)) / (np.sqrt(vw / (1 - 0.99**step)) + 1e-8)
        b -= 0.1 * (mb / (1 - 0.9**step)) / (math.sqrt(vb / (1 - 0.99**step)) + 1e-8)
    return w, float(b)


def _judged(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, b, posterior, threshold = shared.value
        features = Features()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            patterns = [votes(t) for t in texts]
            scores = []
            for t, p in zip(texts, patterns, strict=True):
                at, x = features.of(t, p)
                s = b + float(weights[at] @ x) if len(at) else b
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, s)))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(patterns, pa.string()), pa.array([posterior[p] for p in patterns], pa.float64()), pa.array(scores, pa.float64()), pa.array([s >= threshold for s in scores], pa.bool_())],
                ["doc_id", "votes", "posterior", "score", "keep"],
            )

    return run


def judge_quality(docs: DataFrame, threshold: float = 0.5, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, votes, posterior, score, keep)`` for each row of ``docs``.

    Null and empty texts are texts without words. Repeated rows and null ids are judged like others. All documents are counted for the
    labellers' accuracies; only the scorer is fitted on a bounded sample. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(named(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    counted = arrow_map(rows.select("text"), _voting, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    patterns = {r["pattern"]: r["n"] for r in counted}
    _, _, posterior = estimate(patterns)
    n = sum(patterns.values())
    sample = rows.where(picked(train_rows, n, "doc_id", F.length("text"), F.lit(11)))
    got = arrow_map(sample.select("text"), _featured(posterior), "y double, at array<int>, x array<float>").toArrow()
    if n and not got.num_rows:
        raise RuntimeError(f"no row of {n} was picked to fit the scorer")
    at, x = got.column("at").combine_chunks(), got.column("x").combine_chunks()
    ends = at.offsets.to_numpy()
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    weights, b = fit(got.column("y").to_numpy(), row, at.values.to_numpy(), x.values.to_numpy())
    shared = spark.sparkContext.broadcast((weights.astype(np.float32), b, posterior, threshold))
    ids = dict((f.name, f.dataType.simpleString()) for f in docs.schema)[id_col]
    return arrow_map(rows, _judged(shared), f"doc_id {ids}, votes string, posterior double, score double, keep boolean")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"))
