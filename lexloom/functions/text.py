"""Text columns: cleaning, the tokenizers, n-grams, concordances and counters. All are Catalyst expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

URL = r"(?i)(https?://\S+)|(www\.\S+)|(\[[^\]]*?\]\([^)]*?\))"

# A short stop list for English prose.
STOPS = (
    "the", "and", "for", "with", "that", "this", "from", "are", "was", "were", "has", "have", "had", "not", "but", "you", "your", "they", "them", "their",
    "his", "her", "she", "him", "its", "our", "out", "who", "whom", "what", "which", "when", "where", "will", "would", "can", "could", "into", "than", "then",
)

# What stands before a keyword in a directive, and a small lexicon of emotions in ten categories.
IMPERATIVE_BEFORE = ("you should", "go", "try", "you need to", "you need", "please", "just", "should", "must")
EMOTIONS = {
    "fear": ("afraid", "scared", "anxious", "worried", "panic", "dread", "nervous", "terror", "fright"),
    "anger": ("angry", "mad", "furious", "rage", "annoyed", "irritated", "frustrated", "pissed", "livid"),
    "anticipation": ("hope", "expect", "wait", "tomorrow", "soon", "future", "plan", "ahead", "coming"),
    "trust": ("trust", "believe", "honest", "loyal", "faith", "confident", "rely", "safe"),
    "surprise": ("surprise", "wow", "shock", "unexpected", "sudden", "amazed", "astonished", "gasp"),
    "sadness": ("sad", "depressed", "down", "blue", "lonely", "miserable", "heartbreaking", "cry", "tears", "grief"),
    "joy": ("happy", "joy", "great", "love", "wonderful", "delighted", "excited", "thrilled", "cheerful"),
    "disgust": ("disgust", "gross", "awful", "horrible", "nasty", "revolting", "sick"),
    "positive": ("good", "great", "amazing", "wonderful", "love", "happy", "awesome", "best", "perfect"),
    "negative": ("bad", "awful", "terrible", "hate", "worst", "horrible", "sad", "wrong", "broken", "tired", "exhausted"),
}


def words(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def let(value: Column, body) -> Column:
    """``body(value)`` with the value held by a lambda, so it is made once even where the optimizer puts its expression into inner lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip_urls(text: Column) -> Column:
    """URLs, bare www addresses and markdown links become a space."""
    return F.regexp_replace(text, URL, " ")


def unescape_basic(text: Column) -> Column:
    """The five basic entities and backslash escapes; numeric entities stay."""
    out = F.regexp_replace(text, r"\\", "")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return out


def slug(text: Column, length: int = 60) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit(length))


def tokens(text: Column, min_len: int = 3) -> Column:
    """Runs of letters, digits and underscores, in lower case, that are a-z only and long enough.

    Equal to word-bounded ``[a-z]{n,}`` with Unicode word boundaries, whatever the regex engine takes for a boundary.
    """
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda t: t.rlike(f"^[a-z]{{{min_len},}}$"))


def tokens_apostrophe(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[a-zA-Z']+"), F.lit(0))


def tokens_plain(text: Column) -> Column:
    """Folded quotes, all but a-z, 0-9, blanks, apostrophes and hyphens to blanks, split at blanks."""
    folded = F.translate(F.lower(text), "‘’“”", "''\"\"")
    return F.filter(F.split(F.regexp_replace(folded, "[^a-z0-9 '-]", " "), " +"), lambda t: t != "")


def tokens_space(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t\n\r]+"), lambda t: t != "")


def tokens_treebank(text: Column, words_only: bool = False) -> Column:
    """Contractions and punctuation split off, in lower case; tokens with a letter or digit, or only words that may hold hyphens.

    An approximation by rules: quotes and abbreviations aren't told apart.
    """
    out = F.regexp_replace(F.lower(text), r"([a-z])n't([^a-z]|$)", "$1 n't$2")
    out = F.regexp_replace(out, r"([a-z])('ll|'re|'ve|'s|'m|'d)([^a-z]|$)", "$1 $2$3")
    out = F.regexp_replace(out, r'([.,;:!?"()\[\]{}<>&@#$%*])', " $1 ")
    keep = "^[a-z][a-z-]*$" if words_only else "[a-z0-9]"
    return F.filter(F.split(out, r"[ \t\n\r]+"), lambda t: t.rlike(keep))


def tokens_social(text: Column) -> Column:
    """Hashtags, numbers, words and pictographs of the blocks from U+1F300 to U+1FAFF."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"#[a-z0-9_]+|[0-9]+|[a-z]+|[\x{1F300}-\x{1FAFF}]"), F.lit(0))


def anchor_token(seed: Column, function_words: Sequence[str] = ("a", "the", "to", "you")) -> Column:
    """The last token of a seed that isn't a function word."""
    return F.try_element_at(F.filter(F.split(seed, " "), lambda t: ~t.isin(*function_words)), F.lit(-1))


def has_code_block(text: Column) -> Column:
    """A fence, or two indented lines in a row."""
    return F.contains(text, F.lit("```")) | text.rlike(r"(?m)^    .*\n    ")


def hashed_terms(tk: Column) -> Column:
    """``(slot, value)`` in 256 slots by the first byte of a term's md5: a sparse embedding that needs no model."""
    return F.transform(tk, lambda t: F.conv(F.left(F.md5(t.cast("binary")), F.lit(2)), 16, 10).cast("int"))


def without(tk: Column, stops: Sequence[str] = STOPS) -> Column:
    """Keeps repeated tokens, unlike a set difference."""
    return F.filter(tk, lambda t: ~t.isin(*stops))


def lemmas(tk: Column, dictionary: Column) -> Column:
    """``dictionary`` is a map column; tokens it lacks stay."""
    return F.transform(tk, lambda t: F.coalesce(F.try_element_at(dictionary, t), t))


def ngrams(tk: Column, n: int) -> Column:
    starts = F.when(F.size(tk) >= n, F.sequence(F.lit(1), F.size(tk) - (n - 1))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(starts, lambda i: F.array_join(F.slice(tk, i, n), " "))


def skipgrams(tk: Column, gaps: Sequence[int], glue: str = " ") -> Column:
    """Pairs of tokens ``gap`` places apart for each gap."""

    def at(gap: int) -> Column:
        starts = F.when(F.size(tk) > gap, F.sequence(F.lit(1), F.size(tk) - gap)).otherwise(F.expr("cast(array() as array<int>)"))
        return F.transform(starts, lambda i: F.concat(F.element_at(tk, i), F.lit(glue), F.element_at(tk, i + gap)))

    return F.flatten(F.array(*[at(g) for g in gaps]))


def phrase_starts(tk: Column, phrase: Sequence[str]) -> Column:
    """1-based places where a phrase begins."""
    n = len(phrase)

    def starts(t: Column) -> Column:
        first = F.filter(F.transform(t, lambda w, i: F.when(w == phrase[0], i + 1)), lambda i: i.isNotNull())
        return F.filter(first, lambda i: F.slice(t, i, n) == words(phrase)) if n > 1 else first

    return let(tk, starts)


def around_phrase(tk: Column, phrase: Sequence[str], w: int) -> Column:
    """``(at, left, right)`` for each occurrence of a phrase: small slices, so what is exploded afterwards doesn't carry the whole text."""
    n = len(phrase)

    def found(t: Column) -> Column:
        return F.transform(phrase_starts(t, phrase), lambda i: F.struct(i.alias("at"), left_of(t, i, w).alias("left"), right_of(t, i, n, w).alias("right")))

    return let(tk, found)


def left_of(tk: Column, at: Column, w: int) -> Column:
    return F.slice(tk, F.greatest(at - w, F.lit(1)), F.least(F.lit(w), at - 1))


def right_of(tk: Column, at: Column, n: int, w: int) -> Column:
    return F.slice(tk, at + n, F.lit(w))


def lexicon_count(tk: Column, text: Column, unigrams: Sequence[str], phrases: Sequence[str] = ()) -> Column:
    """Tokens in the lexicon plus non-overlapping occurrences of its phrases."""
    listed = words(unigrams)
    hits = F.size(F.filter(tk, lambda t: F.array_contains(listed, t))).cast("long")
    for p in phrases:
        hits = hits + ((F.length(text) - F.length(F.replace(text, F.lit(p), F.lit("")))) / len(p)).cast("long")
    return hits


def matched_terms(text: Column, terms: Sequence[str]) -> Column:
    low = F.lower(text)
    return F.filter(words(sorted(terms)), lambda t: F.contains(low, t))


def code_ratio(text: Column) -> Column:
    """Characters in fences, indented lines and inline code over all characters; parts may count twice."""

    def chars(pattern: str) -> Column:
        return F.aggregate(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lit(0), lambda a, x: a + F.length(x))

    return F.try_divide(chars(r"(?s)```.*?```") + chars(r"(?m)^    .*$") + chars(r"`[^`\n]+`"), F.length(text))


def first_match(text: Column, rules: Sequence[tuple[str, str, str, str]]) -> Column:
    """The first rule ``(pattern, label, confidence, note)`` that a text meets, as a struct."""
    return F.coalesce(*[F.when(text.rlike(p), F.struct(F.lit(a).alias("label"), F.lit(c).alias("confidence"), F.lit(n).alias("note"))) for p, a, c, n in rules])


def seed_column(term: str) -> str:
    """A column name for a seed term."""
    return "r2_" + re.sub("[^a-z0-9]+", "_", term.lower())[:60].strip("_")


def valid_pattern(spark: SparkSession, term: str) -> bool:
    """Whether a term is a regular expression of the JVM's; asked on the driver, once a term."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(term)
    except IllegalArgumentException:  # what a pattern's syntax error becomes
        return False
    return True


def seed_match(text: Column, term: str, action: str, valid: bool = True) -> Column:
    """Whether a text holds a seed term, without regard to case: as a pattern for the action ``regex``, else (or where the pattern isn't valid) as it stands."""
    if action == "regex" and valid:
        return text.rlike(f"(?i){term}")
    return F.contains(F.lower(text), F.lit(term.lower()))


def imperative_context(left: Column) -> Column:
    """Whether the text to the left of a keyword ends in a directive, is empty or ends a sentence."""
    low = F.trim(F.lower(left))
    after = F.lit(False)
    for phrase in IMPERATIVE_BEFORE:
        after = after | F.endswith(low, F.lit(phrase))
    return after | (low == "") | low.rlike("[.!?]$")
