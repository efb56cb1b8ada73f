"""Spans: rule-based speaker segmentation with sentence bounds, overlap resolution and gaps, and quote extraction.

Offsets are code points. Matching all offsets of a pattern has no SQL function, so a document at a time is segmented in an Arrow
map; everything after it (metrics, tables, merges) is DataFrame work.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANK = {"high": 3, "medium": 2, "low": 1}
#: (pattern, label, confidence, note); applied in this order.
RULES = (
    (r"(?m)^>.*$", "model_quoted", "high", "block quote"),
    (r"(?m)^(?:assistant|bot|ai)\s*:.*$", "model_quoted", "high", "speaker label"),
    (r"(?i)\b(?:it|the bot|the model|the assistant) (?:said|told|replied|answered)\b[^.!?\n]*", "model_paraphrased", "medium", "reported speech"),
    (r"“[^”\n]{3,}”|\"[^\"\n]{3,}\"", "model_quoted", "low", "inline quote"),
    (r"(?i)\b(?:i|we) (?:said|asked|told|think|feel|am|was)\b[^.!?\n]*", "user", "medium", "first person"),
)
NEGATED = re.compile(r"(?i)\b(?:never|didn't|did not|doesn't|does not)\b")
FLOOR = ("ambiguous", "low", "gap")
_END = re.compile(r"[.!?\n]")


def sentence_ends(text: str) -> list[int]:
    return [m.end() for m in _END.finditer(text)]


def sentence_bounds(text: str, start: int, end: int, ends: Sequence[int] | None = None) -> tuple[int, int]:
    """The sentence or sentences that hold ``[start, end)``; ``ends`` are the text's, found once for all its spans."""
    ends = sentence_ends(text) if ends is None else ends
    i = bisect_right(ends, start)
    a = ends[i - 1] if i else 0
    j = bisect_left(ends, max(end - 1, start) + 1)
    b = ends[j] if j < len(ends) else len(text)
    while a < start and text[a].isspace():
        a += 1
    return a, b


def find_spans(text: str, rules: Sequence[tuple[str, str, str, str]] = RULES) -> list[tuple[int, int, str, str, str]]:
    """All matches, widened to sentences unless they fill lines; negated reports are left out."""
    out = []
    ends = sentence_ends(text)
    for pattern, label, confidence, note in rules:
        for m in re.finditer(pattern, text):
            if m.start() == m.end():
                continue
            a, b = m.span()
            if label in ("model_paraphrased", "user"):
                a, b = sentence_bounds(text, a, b, ends)
            if label == "model_paraphrased" and NEGATED.search(text, a, m.start()):
                continue
            out.append((a, b, label, confidence, note))
    return out


def resolve(spans: Sequence[tuple[int, int, str, str, str]], size: int) -> list[tuple[int, int, str, str, str]]:
    """A sorted, disjoint, gapless cover of ``[0, size)``: more confident spans win, then the label, the start and the length.

    What is taken is kept in order, so a span looks only at those it overlaps.
    """
    starts: list[int] = []
    taken: list[tuple[int, int, str, str, str]] = []
    for a, b, *rest in sorted(spans, key=lambda s: (-RANK[s[3]], s[2], s[0], s[0] - s[1])):
        at, b = max(0, a), min(size, b)
        i = bisect_right(starts, at)
        if i and taken[i - 1][1] > at:
            at = taken[i - 1][1]
        while at < b:
            until = min(b, starts[i]) if i < len(starts) else b
            if until > at:
                starts.insert(i, at)
                taken.insert(i, (at, until, *rest))
                i += 1
            if i >= len(starts) or starts[i] >= b:
                break
            at = taken[i][1]
            i += 1
    out, at = [], 0
    for s in taken:
        if s[0] > at:
            out.append((at, s[0], *FLOOR))
        out.append(s)
        at = s[1]
    if at < size:
        out.append((at, size, *FLOOR))
    return out


def merge_adjacent(spans: Sequence[tuple[int, int, str, str, str]]) -> list[tuple[int, int, str, str, str]]:
    out: list[tuple[int, int, str, str, str]] = []
    for s in spans:
        if out and out[-1][1] == s[0] and out[-1][2:4] == s[2:4]:
            out[-1] = (out[-1][0], s[1], *out[-1][2:])
        else:
            out.append(s)
    return out


def segment(rows: DataFrame, id_col: str, text_col: str, rules=RULES) -> DataFrame:
    """``row_id, span_index, span_start, span_end, label, confidence, source, span_text``; null and empty texts have no span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                spans = merge_adjacent(resolve(find_spans(text, rules), len(text))) if text else []
                out += [(i, k, a, b, label, conf, note, text[a:b].replace("\n", " | ")) for k, (a, b, label, conf, note) in enumerate(spans)]
            cols = list(zip(*out, strict=True)) if out else [()] * 8
            types = [batch.column(0).type, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["row_id", "span_index", "span_start", "span_end", "label", "confidence", "source", "span_text"])

    kind = dict(rows.dtypes)[id_col]
    return rows.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("text")).mapInArrow(run, f"row_id {kind}, span_index int, span_start int, span_end int, label string, confidence string, source string, span_text string")


def span_metrics(spans: DataFrame) -> DataFrame:
    """Counts and characters by label, confidence and source."""
    return spans.groupBy("label", "confidence", "source").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("span_end") - F.col("span_start")).cast("long")).alias("chars"))


def tiers(spans: DataFrame, label_prefix: str = "model", least: float = 0.2) -> DataFrame:
    """Tier 1 where confident model spans cover at least ``least`` of a text's characters."""
    size = F.col("span_end") - F.col("span_start")
    good = F.col("label").startswith(label_prefix) & F.col("confidence").isin("high", "medium")
    c = spans.groupBy("row_id").agg(F.sum(size).alias("chars"), F.sum(F.when(good, size).otherwise(0)).alias("model_chars"))
    return c.withColumn("tier", F.when(F.try_divide("model_chars", "chars") >= least, 1).otherwise(2))


_QUOTES = (
    ("blockquote", re.compile(r"(?m)^>\s?(.+)$")),
    ("speaker", re.compile(r"(?mi)^(?:\*\*)?\[?(?:assistant|bot|ai|chatbot)\]?(?:\*\*)?\s*[:\-–]\s*(.+)$")),
    ("attribution", re.compile(r"(?i)\b(?:said|replied|told me|responded)[:,]?\s+[\"“]([^\"”]+)[\"”]")),
    ("inline", re.compile(r"[\"“]([^\"”\n]{15,})[\"”]")),
)


def extract_quotes(text: str) -> tuple[str, str, list[str]]:
    """``(quoted, narration, methods)``: quotes in the order of methods, each content once; the rest is narration."""
    seen: set[str] = set()
    quoted, methods, cut = [], [], []
    for name, pattern in _QUOTES:
        for m in pattern.finditer(text):
            key = re.sub(r"\W+", " ", m.group(1)).strip().lower()
            if key and key not in seen:
                seen.add(key)
                quoted.append(m.group(1).strip())
                methods.append(name)
            cut.append(m.span())
    out, at = [], 0
    for a, b in sorted(cut):
        out.append(text[at : max(at, a)])
        at = max(at, b)
    return "\n".join(quoted), "".join([*out, text[at:]]).strip(), methods


def quotes(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [extract_quotes(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.list_(pa.string()))], ["row_id", "quoted", "narration", "sources"])

    kind = dict(rows.dtypes)[id_col]
    return rows.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("text")).mapInArrow(run, f"row_id {kind}, quoted string, narration string, sources array<string>")


def unescape(text: str) -> str:
    """All HTML entities, and backslash escapes."""
    return html.unescape(text.replace("\\", ""))


def parse_response(raw: str, labels: Sequence[str], default: tuple[str, str]) -> tuple[str, str]:
    """Label and confidence from a fallback classifier's answer; the default where none is found."""
    label = next((x for x in labels if re.search(rf"\b{re.escape(x)}\b", raw, re.I)), None)
    conf = next((c for c in RANK if re.search(rf"\b{c}\b", raw, re.I)), None)
    return (label, conf or "low") if label else default


def with_fallback(spans: DataFrame, classify: Callable[[list[str]], list[str]], labels: Sequence[str], budget: int, floor: Sequence[str] = ("ambiguous",)) -> DataFrame:
    """``spans`` with the labels of a fallback classifier for at most ``budget`` of those the rules left open, the longest first.

    ``classify`` is the plug-in: texts to raw answers, a batch at a time; what an answer doesn't say stays as it was. The budget is the operator's
    feature, a bound on calls; its rows are few and go through one task.
    """
    order = (F.desc(F.length("span_text")), "row_id", "span_index")
    picked = spans.where(F.col("label").isin(*floor)).orderBy(*order).limit(budget)
    kind = spans.schema["row_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, before, conf = (batch.column(i).to_pylist() for i in (2, 3, 4))
            said = [parse_response(raw, labels, (b, c)) for raw, b, c in zip(classify(texts), before, conf, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.string())], ["row_id", "span_index", "_label", "_confidence"])

    asked = picked.select("row_id", "span_index", "span_text", "label", "confidence").mapInArrow(run, f"row_id {kind}, span_index int, _label string, _confidence string")
    joined = spans.join(F.broadcast(asked), ["row_id", "span_index"], "left")  # at most ``budget`` rows
    source = F.when(F.col("_label").isNotNull() & (F.col("_label") != F.col("label")), F.lit("fallback")).otherwise(F.col("source"))
    return joined.withColumn("source", source).withColumn("label", F.coalesce("_label", "label")).withColumn("confidence", F.coalesce("_confidence", "confidence")).drop("_label", "_confidence").select(*spans.columns)


def validation_sample(spans: DataFrame, per_label: int, seed: int = 42) -> DataFrame:
    """``(row_id, stratum, spans)``: per label up to ``per_label`` texts whose first span has it, by a seeded order, with all their spans as JSON in order."""
    first = spans.where("span_index = 0").select("row_id", F.col("label").alias("stratum"))
    order = F.md5(F.concat(F.col("row_id").cast("string"), F.lit(f"|{seed}")))
    own = first.withColumn("_rn", F.row_number().over(Window.partitionBy("stratum").orderBy(order, "row_id"))).where(F.col("_rn") <= per_label).drop("_rn")
    nested = spans.join(F.broadcast(own.select("row_id")), "row_id", "left_semi").groupBy("row_id").agg(
        F.to_json(F.array_sort(F.collect_list(F.struct("span_index", "span_start", "span_end", "label", "confidence", "span_text")))).alias("spans")
    )
    return own.join(nested, "row_id")


def extractor_yield(found: DataFrame, methods: str = "sources") -> DataFrame:
    """``(method, n, share, rows)``: quotes by method, their share of all quotes and the texts that have one."""
    each = found.select("row_id", F.explode(methods).alias("method"))
    c = each.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("row_id").alias("rows"))
    return c.crossJoin(F.broadcast(c.agg(F.sum("n").alias("_all")))).select("method", "n", (F.col("n") / F.col("_all").cast("double")).alias("share"), "rows")
