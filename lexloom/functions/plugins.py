"""Plug-ins for what needs a model: embedder, tagger, lemmatizer, sentiment scorer, zero-shot and span classifiers.

A plug-in is any object with the method named here; it is pickled to the tasks and called with a batch of texts at a time. None comes with this
package, as no models do; tests use small ones made of rules.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Tagger(Protocol):
    def tag(self, texts: list[str]) -> list[list[tuple[str, str]]]:
        """Per text its tokens and their parts of speech."""


class Lemmatizer(Protocol):
    def lemmas(self, texts: list[str]) -> list[list[str]]: ...


class SentimentScorer(Protocol):
    def score(self, texts: list[str]) -> list[float]: ...


class ZeroShotClassifier(Protocol):
    def rank(self, texts: list[str], labels: Sequence[str]) -> list[list[tuple[str, float]]]:
        """Per text labels and their scores."""


def _mapped(rows: DataFrame, text_col: str, name: str, kind: str, arrow: pa.DataType, call) -> DataFrame:
    """``rows`` with a column ``name`` of ``call(texts)``; null texts are empty ones."""
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array(call([t or "" for t in batch.column(at).to_pylist()]), arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, name])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, _parse_datatype_string(kind))]))


def embedded(rows: DataFrame, text_col: str, plugin: Embedder, name: str = "embedding") -> DataFrame:
    return _mapped(rows, text_col, name, "array<float>", pa.list_(pa.float32()), plugin.embed)


def lemmatized(rows: DataFrame, text_col: str, plugin: Lemmatizer, name: str = "lemmas") -> DataFrame:
    return _mapped(rows, text_col, name, "array<string>", pa.list_(pa.string()), plugin.lemmas)


def valence(rows: DataFrame, text_col: str, plugin: SentimentScorer, name: str = "valence") -> DataFrame:
    return _mapped(rows, text_col, name, "double", pa.float64(), lambda texts: [float(x) for x in plugin.score(texts)])


def tagged(rows: DataFrame, text_col: str, plugin: Tagger, name: str = "tags") -> DataFrame:
    def call(texts: list[str]) -> list[list[dict[str, Any]]]:
        return [[{"token": t, "pos": p} for t, p in tags] for tags in plugin.tag(texts)]

    return _mapped(rows, text_col, name, "array<struct<token:string,pos:string>>", pa.list_(pa.struct([("token", pa.string()), ("pos", pa.string())])), call)


def seed_pos(tags: Column, seed: str) -> Column:
    """The part of speech of the first token that is the seed, without regard to case."""
    return F.try_element_at(F.transform(F.filter(tags, lambda t: F.lower(t["token"]) == seed.lower()), lambda t: t["pos"]), F.lit(1))


def zero_shot(rows: DataFrame, text_col: str, plugin: ZeroShotClassifier, labels: Sequence[str], least: float = 0.6, default: str = "ambiguous", name: str = "label") -> DataFrame:
    """The best label where its score is above ``least``, else ``default``; ties by the order of ``labels``."""

    def call(texts: list[str]) -> list[str]:
        out = []
        for ranked in plugin.rank(texts, labels):
            best, score = max(ranked, key=lambda x: (x[1], -labels.index(x[0])))
            out.append(best if score > least else default)
        return out

    return _mapped(rows, text_col, name, "string", pa.string(), call)


def imperative_sentences(text: Column, starters: Sequence[str], reporting: Sequence[str] = ("you should", "you need to", "you must", "please")) -> Column:
    """Sentences that begin with a starter verb or hold a directive, without a parser: the fallback where no tagger is at hand."""
    found = F.transform(F.split(F.coalesce(text, F.lit("")), r"[.!?\n]+"), lambda s: F.trim(F.lower(s)))
    return F.filter(found, lambda s: s.rlike("^(" + "|".join(starters) + ")\\b") | s.rlike("\\b(" + "|".join(reporting) + ")\\b"))
