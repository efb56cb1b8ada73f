"""Personal data by proposed spans, checksums and context, in SQL functions only.

Regular expressions propose spans. A span is confirmed by its validator: parts up to 255 for addresses, Luhn for cards,
the digit count for phone numbers, mod 97 for bank accounts (IBAN, the kind the method adds). The words near a span raise or lower its score;
the score doesn't decide whether a span stays.

The functions that find all matches don't give places. They follow from the lengths of the pieces between the matches:
a match starts after all pieces and matches before it. Sums are taken in blocks of ``BLOCK`` matches, so long lists stay cheap.
The patterns below match the same spans as the plain ones they come from, but can't backtrack: a run of characters is entered only
at its start (or where the previous match ended) and is never given back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table, text_or_empty

KINDS = ("email", "ip", "card", "phone", "iban")
BASE = KINDS[:4]
BLOCK = 256
NEAR = 48
PIECE = 4096

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
#: What a text must hold for a kind to be looked for at all.
GUARDS = {"email": "instr(_t, '@') > 0", "ip": "instr(_t, '.') > 0", "card": "true", "phone": "instr(_t, '+') > 0", "iban": "true"}
#: Words near a span that speak for and against it.
CONTEXT = {
    "email": ("mail|contact|write|address", "example|noreply"),
    "ip": ("ip|host|server|address|login|network", "version|release|section|chapter"),
    "card": ("card|visa|master|amex|credit|debit|payment|pay", "order|isbn|tracking|serial"),
    "phone": ("phone|tel|call|mobile|fax|contact|sms", "order|score|version"),
    "iban": ("iban|bank|account|transfer|konto", "serial|license|code"),
}
BASE_SCORE = {"email": 0.7, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8}


def _valid(kind: str) -> str:
    octet = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    digits = "regexp_replace(m, '[^0-9]', '')"
    return {
        "email": "true",
        "ip": rf"m rlike '^0*{octet}(?:[.]0*{octet}){{3}}$'",
        "card": f"length({digits}) between 12 and 19 and coalesce(luhn_check({digits}), false)",
        "phone": f"length({digits}) between 9 and 15",
        "iban": "length(replace(m, ' ', '')) between 15 and 34 and aggregate(filter(split(concat(substring(replace(m, ' ', ''), 5), left(replace(m, ' ', ''), 4)), ''), c -> c <> ''), 0, "
        "(a, c) -> (a * if(c between '0' and '9', 10, 100) + instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1) % 97) = 1",
    }[kind]


def _literal(pattern: str) -> str:
    return "r'" + pattern + "'"


def _spans(kind: str) -> str:
    """Valid spans of a kind from its matches ``_m_kind`` and the pieces between them ``_g_kind``."""
    m, g, s = f"_m_{kind}", f"_g_{kind}", f"_s_{kind}"
    before = f"aggregate(slice({s}, 1 + {BLOCK} * (i div {BLOCK}), i % {BLOCK}), 0L, (a, x) -> a + x)"
    start = f"element_at(_b_{kind}, cast(i div {BLOCK} as int) + 1) + {before} + length({g}[i])"
    plus, minus = CONTEXT[kind]
    near = f"lower(concat(right({g}[i], {NEAR}), ' ', left({g}[i + 1], {NEAR})))"
    score = f"least(1D, greatest(0D, {BASE_SCORE[kind]}D + if({near} rlike '(?:{plus})', 0.2D, 0D) - if({near} rlike '(?:{minus})', 0.3D, 0D)))"
    every = f"transform({m}, (m, i) -> if({_valid(kind)}, named_struct('start', {start}, 'rank', {KINDS.index(kind)}, 'kind', '{kind}', 'end', {start} + length(m), 'score', {score}), null))"
    return f"if(size({m}) = 0, {_EMPTY}, filter({every}, x -> x is not null))"


_SPAN = "struct<start:bigint,rank:int,kind:string,end:bigint,score:double>"
_EMPTY = f"cast(array() as array<{_SPAN}>)"


def with_spans(rows: DataFrame, text: Column) -> DataFrame:
    """``rows`` with ``_t`` (null: empty) and ``_spans``: all valid spans in code points, by start and then kind."""
    out = rows.withColumn("_t", text)
    out = out.withColumns({f"_m_{k}": F.expr(f"if({GUARDS[k]}, regexp_extract_all(_t, {_literal(PATTERNS[k])}, 0), cast(array() as array<string>))") for k in KINDS})
    out = out.withColumns({f"_g_{k}": F.expr(f"if(size(_m_{k}) = 0, cast(array() as array<string>), split(_t, {_literal(PATTERNS[k])}, -1))") for k in KINDS})
    out = out.withColumns({f"_s_{k}": F.expr(f"transform(_m_{k}, (m, i) -> cast(length(m) + length(_g_{k}[i]) as bigint))") for k in KINDS})
    sums = f"transform(sequence(0, greatest(size(_s_{{k}}) - 1, 0) div {BLOCK}), b -> aggregate(slice(_s_{{k}}, cast(1 + {BLOCK} * b as int), {BLOCK}), 0L, (a, x) -> a + x))"
    out = out.withColumns({f"_c_{k}": F.expr(sums.format(k=k)) for k in KINDS})
    out = out.withColumns({f"_b_{k}": F.expr(f"transform(_c_{k}, (x, j) -> aggregate(slice(_c_{k}, 1, j), 0L, (a, y) -> a + y))") for k in KINDS})
    out = out.withColumns({f"_v_{k}": F.expr(_spans(k)) for k in KINDS})
    out = out.withColumn("_spans", F.expr(f"array_sort(concat({', '.join(f'_v_{k}' for k in KINDS)}))"))
    return out.drop(*(f"_{p}_{k}" for p in "mgscbv" for k in KINDS))


def _joined(spans: str) -> str:
    return f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: counts of the base kinds, a digest of their spans, all spans, and their scores.

    Null and empty texts have no spans. Only the id and the text are read; rows with null ids and repeated rows are kept.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = with_spans(rows, text_or_empty("text")).drop("text", "_t")
    base = "filter(_spans, x -> x.rank < 4)"
    return found.select(
        "doc_id",
        *(F.expr(f"cast(size(filter(_spans, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE),
        F.expr(f"sha2({_joined(base)}, 256)").alias("base_sha256"),
        F.expr(_joined("_spans")).alias("spans"),
        F.expr("array_join(transform(_spans, x -> format_number(x.score, 2)), ',')").alias("scores"),
    )


def redact(docs: DataFrame, text_col: str = "text", least_score: float = 0.0) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one, named by the first.

    Null texts stay null, rows without a span stay as they are. The text is held in pieces of ``PIECE`` characters for this, so
    a place deep in a long text isn't looked for from its start for every span. Other columns travel in one struct, so none of
    their names can clash with those used here.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    found = with_spans(docs.select(row.alias("_row")), F.coalesce(F.col(f"_row.`{text_col}`"), F.lit("")))
    grow = (
        "aggregate(filter(_spans, x -> x.score >= {least}), cast(array() as array<struct<start:bigint,kind:string,end:bigint>>), (a, x) -> "
        "if(size(a) > 0 and element_at(a, -1).end > x.start, concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'kind', element_at(a, -1).kind, 'end', greatest(element_at(a, -1).end, x.end)))), "
        "concat(a, array(named_struct('start', x.start, 'kind', x.kind, 'end', x.end)))))"
    ).format(least=least_score)
    # runs of overlapping spans are short, but a text may have many: those without any overlap need no fold
    plain = "transform(_spans, x -> named_struct('start', x.start, 'kind', x.kind, 'end', x.end))"
    overlap = "exists(sequence(1, greatest(size(_spans) - 1, 1)), i -> i < size(_spans) and _spans[i].start < _spans[i - 1].end)"
    found = found.withColumn("_u", F.expr(f"if(size(_spans) > 0, if({overlap} or {least_score} > 0, {grow}, {plain}), null)"))
    found = found.withColumn("_p", F.expr(f"if(size(_u) > 0, transform(sequence(0, cast((length(_t) - 1) div {PIECE} as int)), i -> substring(_t, i * {PIECE} + 1, {PIECE})), null)"))

    def between(a: str, b: str) -> str:
        one = f"substring(_p[cast({a} div {PIECE} as int)], cast({a} % {PIECE} as int) + 1, cast({b} - {a} as int))"
        head = f"substring(_p[cast({a} div {PIECE} as int)], cast({a} % {PIECE} as int) + 1)"
        middle = f"array_join(slice(_p, cast({a} div {PIECE} as int) + 2, cast({b} div {PIECE} - {a} div {PIECE} - 1 as int)), '')"
        tail = f"left(coalesce(try_element_at(_p, cast({b} div {PIECE} as int) + 1), ''), cast({b} % {PIECE} as int))"
        return f"case when {b} <= {a} then '' when {a} div {PIECE} = {b} div {PIECE} then {one} else concat({head}, {middle}, {tail}) end"

    last = between("element_at(_u, -1).end", "cast(length(_t) as bigint)")
    pieces = f"array_join(transform(_u, (x, i) -> concat({between('if(i = 0, 0L, _u[i - 1].end)', 'x.start')}, '[', upper(x.kind), ']')), '')"
    new = F.expr(f"if(size(_u) > 0, concat({pieces}, {last}), _row.`{text_col}`)")
    return found.select(*[(new if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
