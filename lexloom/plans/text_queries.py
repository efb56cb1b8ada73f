"""Frequency, n-gram, concordance and lexicon queries over ``documents`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import text as tx
from lexloom.operators import frequency as fq
from lexloom.operators import grams as gm

from .registry import query, table

STOP_SQL = "[" + ", ".join(f"'{s}'" for s in tx.STOPS) + "]"
RAW_TK = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda t: regexp_full_match(t, '[a-z]{3,}'))"
TK = f"list_filter({RAW_TK}, lambda t: not list_contains({STOP_SQL}, t))"
PLAIN = r"list_filter(regexp_split_to_array(regexp_replace(translate(lower(text), '‘’“”', '''''""'), '[^a-z0-9 ''-]', ' ', 'g'), ' +'), lambda t: t <> '')"
SPACE = r"list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda t: t <> '')"
SENSES = {"motion": ("rest", "and the"), "place": ("that", "of the"), "license": ("license", "apache license")}
TARGETS = ("with",)


def docs(spark, d):
    return table(spark, d, "documents")


def tk(col="text"):
    return tx.without(tx.tokens(F.col(col)))


def _grams_sql(n: int) -> str:
    return f"select gram, n, row_number() over (order by n desc, gram) as rank from (select gram, count(*) as n from (select unnest(list_transform(range(1, len(tk) - {n - 2}), lambda i: array_to_string(tk[i:i + {n - 1}], ' '))) as gram from (select {TK} as tk from documents)) group by gram) qualify rank <= 200"


@query("freq_unigram", f"""
select gram, n, rank, n / total as pct from (select *, row_number() over (order by n desc, gram) as rank, sum(n) over () as total from
(select gram, count(*) as n from (select unnest({TK}) as gram from documents) group by gram)) where rank <= 500""")
def freq_unigram(spark, d):
    counts = fq.gram_counts(docs(spark, d), tk())
    total = counts.agg(F.sum("n").alias("total"))
    return fq.top(counts, 500).crossJoin(F.broadcast(total)).select("gram", "n", "rank", (F.col("n") / F.col("total")).alias("pct"))  # total is one row


@query("freq_bigram", _grams_sql(2))
def freq_bigram(spark, d):
    return gm.top_of(docs(spark, d), tk(), gm.ngram(2), 200)


@query("freq_trigram", _grams_sql(3))
def freq_trigram(spark, d):
    return gm.top_of(docs(spark, d), tk(), gm.ngram(3), 200)


@query("ngram_stream", f"""
with s as (select row_number() over (order by doc_id, i) as g, t from (select doc_id, unnest(tk) as t, generate_subscripts(tk, 1) as i from (select doc_id, {TK} as tk from documents)))
select gram, n, row_number() over (order by n desc, gram) as rank from (select gram, count(*) as n from (select concat_ws(' ', t, lead(t) over (order by g)) as gram, lead(t) over (order by g) as z from s) where z is not null group by gram) qualify rank <= 100""")
def ngram_stream(spark, d):
    return fq.top(fq.stream_ngrams(fq.token_table(docs(spark, d), "doc_id", tk()), 2), 100)


def _skip_sql(gaps, glue=" "):
    parts = " union all ".join(f"select unnest(list_transform(range(1, len(tk) - {g - 1}), lambda i: tk[i] || '{glue}' || tk[i + {g}])) as gram from t" for g in gaps)
    return f"with t as (select {TK} as tk from documents) select gram, n, row_number() over (order by n desc, gram) as rank from (select gram, count(*) as n from ({parts}) group by gram) qualify rank <= 200"


@query("skipgram_cumulative", _skip_sql((1, 2, 3)))
def skipgram_cumulative(spark, d):
    return gm.top_of(docs(spark, d), tk(), gm.gaps(1, 2, 3), 200)


@query("skipgram_true", _skip_sql((2, 3), " _ "))
def skipgram_true(spark, d):
    return gm.top_of(docs(spark, d), tk(), gm.gaps(2, 3), 200, " _ ")


@query("skipgram_combinations", f"""
with t as (select {TK} as tk from documents), p as (select tk, unnest(range(1, 4)) as g from t),
q as (select unnest(list_transform(range(1, len(tk) - g + 1), lambda i: {{'gram': tk[i] || ' ' || tk[i + g], 'w': least(i, 4 - g)}})) as x from p)
select gram, n, row_number() over (order by n desc, gram) as rank from (select x.gram as gram, cast(sum(x.w) as bigint) as n from q group by 1) qualify rank <= 200""")
def skipgram_combinations(spark, d):
    return gm.top_of(docs(spark, d), tk(), gm.combinations(1), 200)


@query("freq_by_source", f"""
select source, gram, n, rank from (select source, gram, n, row_number() over (partition by source order by n desc, gram) as rank from
(select source, gram, count(*) as n from (select source, unnest({TK}) as gram from documents) group by all)) where rank <= 50""")
def freq_by_source(spark, d):
    return fq.top(fq.gram_counts(docs(spark, d), tk(), ["source"]), 50, ["source"])


@query("freq_pre_post", f"""
select period, gram, n, rank from (select period, gram, n, row_number() over (partition by period order by n desc, gram) as rank from
(select period, gram, count(*) as n from (select case when doc_id % 30 < 15 then 'pre' else 'post' end as period, unnest({TK}) as gram from documents) group by all)) where rank <= 100""")
def freq_pre_post(spark, d):
    day = F.expr("date_add(date'2024-01-01', cast(doc_id % 30 as int))")
    rows = docs(spark, d).withColumn("period", F.when(day < F.lit("2024-01-16").cast("date"), "pre").otherwise("post"))
    return fq.top(fq.gram_counts(rows, tk(), ["period"]), 100, ["period"])


@query("stopword_candidates", f"""
with c as (select gram, count(*) as n from (select unnest({RAW_TK}) as gram from documents) group by gram)
select row_number() over (order by n desc, gram) as rank, gram, n, 100.0 * n / (select sum(n) from c) as pct_of_tokens,
case when list_contains({STOP_SQL}, gram) then 'standard' when list_contains(['license', 'apache', 'under'], gram) then 'domain' else 'content' end as category from c qualify rank <= 200""")
def stopword_candidates(spark, d):
    counts = fq.gram_counts(docs(spark, d), tx.tokens(F.col("text")))
    total = counts.agg(F.sum("n").alias("total"))
    kind = F.when(F.array_contains(tx.words(tx.STOPS), F.col("gram")), "standard").when(F.col("gram").isin("license", "apache", "under"), "domain").otherwise("content")
    return fq.top(counts, 200).crossJoin(F.broadcast(total)).select("rank", "gram", "n", (F.lit(100.0) * F.col("n") / F.col("total")).alias("pct_of_tokens"), kind.alias("category"))


def _kwic_sql(tokens, phrase, w):
    n = len(phrase)
    lit = "[" + ", ".join(f"'{p}'" for p in phrase) + "]"
    return f"""with t as (select doc_id, {tokens} as tk from documents), h as (select doc_id, tk, unnest(list_filter(range(1, len(tk) - {n - 2}), lambda i: tk[i:i + {n - 1}] = {lit})) as i from t)
select doc_id, i - 1 as pos, array_to_string(tk[greatest(i - {w}, 1):i - 1], ' ') as left_context, array_to_string(tk[i:i + {n - 1}], ' ') as keyword, array_to_string(tk[i + {n}:i + {n - 1 + w}], ' ') as right_context from h"""


@query("kwic_token", _kwic_sql(PLAIN, ("rest",), 5))
def kwic_token(spark, d):
    return fq.kwic(docs(spark, d), ["doc_id"], tx.tokens_plain(F.col("text")), ("rest",), 5)


@query("kwic_phrase", _kwic_sql(PLAIN, ("and", "the"), 10))
def kwic_phrase(spark, d):
    return fq.kwic(docs(spark, d), ["doc_id"], tx.tokens_plain(F.col("text")), ("and", "the"), 10)


@query("kwic_raw", f"""
with t as (select doc_id, {SPACE} as tk from documents), h as (select doc_id, tk, unnest(list_filter(range(1, len(tk) + 1), lambda i: lower(trim(tk[i], '.,;:!?"''()[]{{}}')) = 'rest')) as i from t)
select doc_id, i - 1 as pos, tk[i] as keyword, array_to_string(tk[greatest(i - 8, 1):i + 8], ' ') as full_context from h""")
def kwic_raw(spark, d):
    def found(t):
        bare = F.transform(t, lambda x, i: F.when(F.lower(F.btrim(x, F.lit(".,;:!?\"'()[]{}"))) == "rest", i + 1))
        near = lambda i: F.slice(t, F.greatest(i - 8, F.lit(1)), i + 9 - F.greatest(i - 8, F.lit(1)))
        return F.transform(F.filter(bare, lambda i: i.isNotNull()), lambda i: F.struct(i.alias("at"), F.element_at(t, i).alias("keyword"), near(i).alias("near")))

    at = docs(spark, d).select("doc_id", F.explode_outer(tx.let(tx.tokens_space(F.col("text")), found)).alias("h")).where("h is not null")
    return at.select("doc_id", (F.col("h.at") - 1).cast("long").alias("pos"), "h.keyword", F.array_join("h.near", " ").alias("full_context"))


@query("kwic_hit_counts", f"""
with t as (select unnest({PLAIN}) as w from documents) select seed_term, win as "window", count(*) as total_hits from t join (values ('rest'), ('the'), ('that')) s(seed_term) on t.w = seed_term, (values (5), (10), (20)) x(win) group by all""")
def kwic_hit_counts(spark, d):
    rows = docs(spark, d).select(F.explode(tx.tokens_plain(F.col("text"))).alias("seed_term")).where(F.col("seed_term").isin("rest", "the", "that"))
    return rows.groupBy("seed_term").agg(F.count(F.lit(1)).alias("total_hits")).select("seed_term", F.explode(F.array(F.lit(5), F.lit(10), F.lit(20))).alias("window"), "total_hits")


@query("phrase_doc_freq", f"""
with t as (select source, {PLAIN} as tk from documents) select source, count(*) as n, count(*) filter (len(list_filter(range(1, len(tk)), lambda i: tk[i:i + 1] = ['of', 'the'])) > 0) as with_phrase from t group by source""")
def phrase_doc_freq(spark, d):
    rows = docs(spark, d).select("source", tx.tokens_plain(F.col("text")).alias("tk"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size(tx.phrase_starts(F.col("tk"), ("of", "the"))) > 0).alias("with_phrase"))


def _lex_sql(uni, phrase):
    return f"len(list_filter({RAW_TK}, lambda t: t = '{uni}')) + (length(lower(text)) - length(replace(lower(text), '{phrase}', ''))) // {len(phrase)}"


@query("lexicon_counts", "select doc_id, " + ", ".join(f"{_lex_sql(u, p)} as n_{k}" for k, (u, p) in SENSES.items()) + " from documents")
def lexicon_counts(spark, d):
    low = F.lower("text")
    return docs(spark, d).select("doc_id", *(tx.lexicon_count(tx.tokens(F.col("text")), low, [u], [p]).alias(f"n_{k}") for k, (u, p) in SENSES.items()))


@query("density_features", r"""
with t as (select doc_id, regexp_extract_all(text, '[a-zA-Z'']+') as w from documents), c as (select doc_id, len(w) as n_tokens, len(list_filter(w, lambda x: list_contains(['i', 'me', 'my', 'on', 'he'], lower(x)))) as hits from t)
select doc_id, n_tokens, hits, 100.0 * hits / greatest(n_tokens, 1) as density from c""")
def density_features(spark, d):
    held = docs(spark, d).select("doc_id", tx.tokens_apostrophe(F.col("text")).alias("w"))
    hits = F.size(F.filter("w", lambda t: F.lower(t).isin("i", "me", "my", "on", "he")))
    return held.select("doc_id", F.size("w").cast("long").alias("n_tokens"), hits.cast("long").alias("hits"), (F.lit(100.0) * hits / F.greatest(F.size("w"), F.lit(1))).alias("density"))


TERMS = ("rest", "license", "apache license", "the", "erra")


@query("tag_terms", f"""
with t as (select doc_id, list_filter({sorted(TERMS)!r}, lambda x: contains(lower(text), x)) as m from documents) select doc_id, array_to_string(m, '|') as matched_terms, len(m) > 0 as any_match, list_contains(m, 'rest') as r2_rest from t""")
def tag_terms(spark, d):
    held = docs(spark, d).select("doc_id", tx.matched_terms(F.col("text"), TERMS).alias("m"))
    return held.select("doc_id", F.array_join("m", "|").alias("matched_terms"), (F.size("m") > 0).alias("any_match"), F.array_contains("m", "rest").alias("r2_rest"))


@query("term_match_counts", f"""
select term, count(*) as n from (select unnest(list_filter({sorted(TERMS)!r}, lambda x: contains(lower(text), x))) as term from documents) group by term""")
def term_match_counts(spark, d):
    return docs(spark, d).select(F.explode(tx.matched_terms(F.col("text"), TERMS)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("strip_urls", r"""select page_id, regexp_replace('see ' || url || ' and [a link](http://x.y) now', '(?i)(https?://\S+)|(www\.\S+)|(\[[^\]]*?\]\([^)]*?\))', ' ', 'g') as clean from pages""")
def strip_urls(spark, d):
    return table(spark, d, "pages").select("page_id", tx.strip_urls(F.concat(F.lit("see "), "url", F.lit(" and [a link](http://x.y) now"))).alias("clean"))


@query("unescape_html", r"""select page_id, length(replace(replace(replace(replace(replace(replace(html, '\', ''), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')) as n_chars from pages""")
def unescape_html(spark, d):
    return table(spark, d, "pages").select("page_id", F.length(tx.unescape_basic(F.col("html"))).cast("long").alias("n_chars"))


@query("slugs", r"""select page_id, left(trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_'), 60) as slug from pages""")
def slugs(spark, d):
    return table(spark, d, "pages").select("page_id", tx.slug(F.col("url")).alias("slug"))


@query("artefact_counters", r"""select source, cast(sum(len(regexp_extract_all(text, '[#$%&*]{3}'))) as bigint) as sign_runs, cast(sum(len(regexp_extract_all(lower(text), 'license'))) as bigint) as license, cast(sum(len(regexp_extract_all(text, '[0-9]+'))) as bigint) as numbers from documents group by source""")
def artefact_counters(spark, d):
    count = lambda c, p: F.sum(F.regexp_count(c, F.lit(p))).alias
    return docs(spark, d).groupBy("source").agg(count(F.col("text"), "[#$%&*]{3}")("sign_runs"), count(F.lower("text"), "license")("license"), count(F.col("text"), "[0-9]+")("numbers"))


@query("code_ratio", r"""select page_id, (list_sum(list_transform(regexp_extract_all(html, '(?s)```.*?```') || regexp_extract_all(html, '(?m)^    .*$') || regexp_extract_all(html, '`[^`\n]+`') || [''], lambda x: length(x)))) / nullif(length(html), 0) as ratio from pages""")
def code_ratio(spark, d):
    return table(spark, d, "pages").select("page_id", tx.code_ratio(F.col("html")).alias("ratio"))


@query("modal_directives", r"""select doc_id, len(regexp_extract_all(lower(text), '\b(the|that|is) [a-z]+')) as directives, len(regexp_extract_all(text, '\+[0-9]')) + len(regexp_extract_all(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}')) as temporal from documents""")
def modal_directives(spark, d):
    return docs(spark, d).select("doc_id", F.regexp_count(F.lower("text"), F.lit(r"\b(the|that|is) [a-z]+")).cast("long").alias("directives"), (F.regexp_count("text", F.lit(r"\+[0-9]")) + F.regexp_count("text", F.lit("[0-9]{4}-[0-9]{2}-[0-9]{2}"))).cast("long").alias("temporal"))


SPACE_LOW = SPACE.replace("(text,", "(lower(coalesce(text, '')),")
IMPERATIVE_SQL = "(" + " or ".join(f"ends_with(left_context, '{p}')" for p in tx.IMPERATIVE_BEFORE) + " or left_context = '' or regexp_matches(left_context, '[.!?]$'))"


@query("imperative_context", f"""with t as (select doc_id, {SPACE_LOW} as tk from documents), h as (select doc_id, tk, unnest(list_filter(range(1, len(tk) + 1), lambda i: tk[i] = 'rest' or tk[i] = 'the')) as i from t),
k as (select doc_id, i - 1 as pos, tk[i] as keyword, array_to_string(tk[greatest(i - 5, 1):i - 1], ' ') as left_context from h) select doc_id, pos, keyword, {IMPERATIVE_SQL} as imperative from k""")
def imperative_context(spark, d):
    """Occurrences of a keyword after a directive, or at the start of a text or sentence."""
    tokens = tx.tokens_space(F.lower(F.coalesce("text", F.lit(""))))
    found = [fq.kwic(docs(spark, d), ["doc_id"], tokens, (w,), 5) for w in ("rest", "the")]
    return found[0].unionByName(found[1]).select("doc_id", "pos", "keyword", tx.imperative_context(F.col("left_context")).alias("imperative"))


@query("covariates", "select doc_id, cast(doc_id % 24 as int) as hour, length(text) as body_length, cast(lang = 'en' as int) as is_post from documents")
def covariates(spark, d):
    ts = F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(doc_id % 24 as int))")
    return docs(spark, d).select("doc_id", F.hour(ts).alias("hour"), F.length("text").cast("long").alias("body_length"), (F.col("lang") == "en").cast("int").alias("is_post"))


@query("sentence_criteria", r"""select doc_id, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: contains(s, ' the ') and contains(s, ' and '))) as sentences from documents""")
def sentence_criteria(spark, d):
    return docs(spark, d).select("doc_id", F.size(F.filter(F.split("text", "[.!?]+"), lambda s: F.contains(s, F.lit(" the ")) & F.contains(s, F.lit(" and ")))).cast("long").alias("sentences"))


EMOTION_TK = "regexp_extract_all(lower(coalesce(text, '')), '[a-z'']+')"


@query("emotion_scores", f"with t as (select doc_id, {EMOTION_TK} as tk from documents) select doc_id, " + ", ".join(f"len(list_filter(tk, lambda t: list_contains({list(v)!r}, t))) as {k}" for k, v in tx.EMOTIONS.items()) + " from t")
def emotion_scores(spark, d):
    """Tokens of each of the ten categories; a token may count in several."""
    held = docs(spark, d).select("doc_id", tx.tokens_apostrophe(F.lower(F.coalesce("text", F.lit("")))).alias("tk"))
    return held.select("doc_id", *(tx.lexicon_count(F.col("tk"), F.lit(""), tuple(v)).alias(k) for k, v in tx.EMOTIONS.items()))



SAMPLED = 50
WINDOWS = (5, 10, 20)


@query("kwic_windows", f"""with t as (select doc_id, {PLAIN} as tk from documents), h as (select doc_id, tk, unnest(list_filter(range(1, len(tk) + 1), lambda i: tk[i] = 'rest')) as i from t),
s as (select * from h order by md5(concat(doc_id, '|', i - 1, '|42')), doc_id, i limit {SAMPLED})
select doc_id, i - 1 as pos, w as width, array_to_string(tk[greatest(i - w, 1):i - 1], ' ') as left_context, array_to_string(tk[i + 1:i + w], ' ') as right_context from s, (values (5), (10), (20)) as v(w)""")
def kwic_windows(spark, d):
    """One seeded sample of occurrences, shown in every width."""
    widest = max(WINDOWS)
    hits = docs(spark, d).select("doc_id", F.explode(tx.around_phrase(tx.tokens_plain(F.col("text")), ("rest",), widest)).alias("h")).select("doc_id", (F.col("h.at") - 1).cast("long").alias("pos"), "h.left", "h.right")
    order = F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("|"), F.col("pos").cast("string"), F.lit("|42")).cast("binary"))
    chosen = hits.orderBy(order, "doc_id", "pos").limit(SAMPLED)
    shown = chosen.select("doc_id", "pos", "left", "right", F.explode(F.array(*[F.lit(w) for w in WINDOWS])).alias("width"))
    left = F.slice("left", F.greatest(F.size("left") - F.col("width") + 1, F.lit(1)), F.col("width"))
    return shown.select("doc_id", "pos", "width", F.array_join(left, " ").alias("left_context"), F.array_join(F.slice("right", F.lit(1), F.col("width")), " ").alias("right_context"))
