"""Smaller operators of the inventory: variants, contingencies, selections, set comparisons, markers and tokenizers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexloom.functions import text as tx
from lexloom.operators import association as ac
from lexloom.operators import corpus as cp
from lexloom.operators import frequency as fq
from lexloom.operators import grams as gm
from lexloom.operators import graph as gr
from lexloom.operators.components import connected_components

from .assoc_queries import graph
from .registry import query, table
from .text_queries import PLAIN, RAW_TK, STOP_SQL, docs

#: A fixed value: addresses as the frequency variants drop them.
NO_URL = r"(https?://\S+)|(www\.\S+)"

# --- frequency variants -------------------------------------------------------------------------------------------------------------------

_CLEAN_TK = RAW_TK.replace("lower(text)", f"lower(regexp_replace(text, '{NO_URL}', ' ', 'g'))")
_VARIANTS_SQL = {"raw": RAW_TK, "no_urls": _CLEAN_TK, **{f"{k}_no_stops": f"list_filter({t}, lambda t: not list_contains({STOP_SQL}, t))" for k, t in (("raw", RAW_TK), ("no_urls", _CLEAN_TK))}}
VARIANT_SQL = f"""
with t as ({" union all ".join(f"select '{k}' as variant, {t} as tk from documents" for k, t in _VARIANTS_SQL.items())}),
g as ({" union all ".join(f"select variant, {n} as n_tokens, unnest(list_transform(range(1, len(tk) - {n - 2}), lambda i: array_to_string(tk[i:i + {n - 1}], ' '))) as gram from t" for n in (1, 2, 3))}),
c as (select variant, n_tokens, gram, count(*) as n from g group by all) select variant, n_tokens, gram, n, row_number() over (partition by variant, n_tokens order by n desc, gram) as rank from c qualify rank <= 500"""


@query("freq_variants", VARIANT_SQL)
def freq_variants(spark, d):
    """Unigrams, bigrams and trigrams of four preprocessing variants; a text without an address has the tokens of both kinds once."""
    linked = F.col("text").rlike(NO_URL)
    texts = docs(spark, d).where("text is not null").select(F.explode(F.when(linked, F.array(F.struct(F.lit(1).alias("mask"), "text"), F.struct(F.lit(2).alias("mask"), F.regexp_replace("text", NO_URL, " ").alias("text")))).otherwise(F.array(F.struct(F.lit(3).alias("mask"), "text")))).alias("v"))
    plain = texts.select(F.col("v.mask").alias("mask"), tx.tokens(F.col("v.text")).alias("tk"))
    # bits 0 and 1 are the variants with stop words, 2 and 3 those without
    both = plain.select(F.explode(F.array(F.struct("mask", "tk"), F.struct((F.col("mask") * 4).alias("mask"), tx.without(F.col("tk")).alias("tk")))).alias("v")).select("v.mask", "v.tk")
    names = F.array(*[F.lit(v) for v in ("raw", "no_urls", "raw_no_stops", "no_urls_no_stops")])
    found = gm.top_grams(both, "mask", "tk", 4, [gm.ngram(n) for n in (1, 2, 3)], 500)
    return found.select(F.get(names, F.col("variant")).alias("variant"), (F.col("s") + 1).alias("n_tokens"), "gram", "n", "rank")


# --- contingencies and summaries ----------------------------------------------------------------------------------------------------------


@query("contingency_pct", "select lang, source, length(text) > 500 as long, count(*) as n, 100.0 * count(*) / sum(count(*)) over () as pct from documents group by all")
def contingency_pct(spark, d):
    counts = docs(spark, d).groupBy("lang", "source", (F.length("text") > 500).alias("long")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("lang", "source", "long", "n", (F.lit(100.0) * F.col("n") / F.col("total")).alias("pct"))


RULE_SQL = "case when contains(text, '?') then 'question' when regexp_matches(text, '[0-9]') then 'number' else 'plain' end"


@query("type_label_pivot", f"select {RULE_SQL} as label, count(*) filter (role = 'user') as user, count(*) filter (role = 'assistant') as assistant from conversations group by 1")
def type_label_pivot(spark, d):
    label = F.when(F.contains("text", F.lit("?")), "question").when(F.col("text").rlike("[0-9]"), "number").otherwise("plain")
    return table(spark, d, "conversations").groupBy(label.alias("label")).pivot("role", ["user", "assistant"]).agg(F.count(F.lit(1))).na.fill(0)


@query("seed_distribution", f"""
with h as (select lang, unnest({PLAIN}) as seed from documents), c as (select seed, lang, count(*) as n from h where seed in ('rest', 'the', 'license') group by all)
select seed, cast(sum(n) as bigint) as hits, string_agg(lang || ':' || n, ',' order by lang) as by_lang from c group by seed""")
def seed_distribution(spark, d):
    c = docs(spark, d).select("lang", F.explode(tx.tokens_plain(F.col("text"))).alias("seed")).where(F.col("seed").isin("rest", "the", "license")).groupBy("seed", "lang").agg(F.count("*").alias("n"))
    shown = F.transform(F.array_sort(F.collect_list(F.struct("lang", "n"))), lambda x: F.concat(x["lang"], F.lit(":"), x["n"]))  # one entry for each language
    return c.groupBy("seed").agg(F.sum("n").alias("hits"), F.array_join(shown, ",").alias("by_lang"))


@query("report_header", """
with c as (select source, count(*) as n from documents group by source), a as (select count(*) as total, avg(length(text)) as mean_length from documents)
select total, (select source from c order by n desc, source limit 1) as top_source, mean_length, case when mean_length < 200 then 'short' when mean_length < 2000 then 'middle' else 'long' end as bucket from a""")
def report_header(spark, d):
    sums = docs(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("chars"), F.count("text").alias("texts"))
    out = sums.agg(F.sum("n").alias("total"), F.min_by("source", F.struct(-F.col("n"), "source")).alias("top_source"), F.try_divide(F.sum("chars"), F.sum("texts")).alias("mean_length"))
    return out.withColumn("bucket", F.when(F.col("mean_length") < 200, "short").when(F.col("mean_length") < 2000, "middle").otherwise("long"))


@query("community_sizes", "with c as (select source as c, count(*) as n from documents group by 1) select count(*) as communities, median(n) as median_size, max(n) as largest, min(n) as smallest, (select string_agg(n, ',' order by n desc) from (select n from c order by n desc limit 5)) as top5 from c")
def community_sizes(spark, d):
    return gr.size_summary(docs(spark, d).select("source"), "source")


@query("component_sizes")
def component_sizes(spark, d):
    """The same summary of the components of the graph's heavier edges; no SQL, its closure would have a row for each pair of nodes."""
    return gr.size_summary(connected_components(graph(spark, d)[1].where("weight >= 12"), "src", "dst"), "component")


@query("argmax_member", "select source, doc_id, length(text) as score from documents qualify row_number() over (partition by source order by length(text) desc nulls last, doc_id) = 1")
def argmax_member(spark, d):
    score = F.length("text").cast("long")
    best = docs(spark, d).groupBy("source").agg(F.min_by(F.struct("doc_id", score.alias("score")), F.struct(-F.coalesce(score, F.lit(-1)), "doc_id")).alias("b"))
    return best.select("source", "b.doc_id", "b.score")


@query("verdicts", """
with c as (select lang, case when length(text) < 200 then -1 else doc_id % 5 end as c from documents), s as (select lang, count(distinct c) filter (c >= 0) as clusters, avg(case when c < 0 then 1.0 else 0.0 end) as noise from c group by lang)
select lang, clusters, noise, case when clusters < 2 then 'collapsed' when noise > 0.5 then 'noisy' when noise > 0.2 then 'mixed' else 'stable' end as verdict from s""")
def verdicts(spark, d):
    c = docs(spark, d).select("lang", F.when(F.length("text") < 200, F.lit(-1)).otherwise(F.col("doc_id") % 5).alias("c"))
    s = c.groupBy("lang").agg(F.countDistinct(F.when(F.col("c") >= 0, F.col("c"))).alias("clusters"), F.avg(F.when(F.col("c") < 0, 1.0).otherwise(0.0)).alias("noise"))
    return s.withColumn("verdict", F.when(F.col("clusters") < 2, "collapsed").when(F.col("noise") > 0.5, "noisy").when(F.col("noise") > 0.2, "mixed").otherwise("stable"))


# --- selections and set algebra -----------------------------------------------------------------------------------------------------------


@query("universe_filter", r"""
with f as (select regexp_matches(lower(coalesce(text, '')), 'of the|and the') as p, regexp_matches(lower(coalesce(text, '')), '\b(rest|license)\b') as u from documents)
select count(*) filter (p or u) as universe, count(*) filter (p and not u) as phrase_only, count(*) filter (u and not p) as unigram_only, count(*) filter (p and u) as both from f""")
def universe_filter(spark, d):
    low = F.lower(F.coalesce("text", F.lit("")))
    f = docs(spark, d).select(low.rlike("of the|and the").alias("p"), low.rlike(r"\b(rest|license)\b").alias("u"))
    return f.agg(F.expr("count_if(p or u)").alias("universe"), F.expr("count_if(p and not u)").alias("phrase_only"), F.expr("count_if(u and not p)").alias("unigram_only"), F.expr("count_if(p and u)").alias("both"))


@query("case_selection", "select doc_id, lang, length(text) as n_chars, '' as code, '' as note from documents where lang = 'en' and length(text) between 200 and 2000 and contains(text, ' the ') and doc_id in (select doc_id from labels where quality = 1)")
def case_selection(spark, d):
    good = table(spark, d, "labels").where("quality = 1").select("doc_id")
    cases = docs(spark, d).where((F.col("lang") == "en") & F.length("text").between(200, 2000) & F.contains("text", F.lit(" the "))).join(good, "doc_id", "left_semi")
    return cases.select("doc_id", "lang", F.length("text").cast("long").alias("n_chars")).withColumns({"code": F.lit(""), "note": F.lit("")})


@query("two_pools", """
with a as (select doc_id, md5(doc_id || '|42') as o, lang, length(text) as n from documents), x as (select doc_id, 'en' as pool from a where lang = 'en' order by o, doc_id limit 20),
y as (select doc_id, 'long' as pool from a where n > 1000 and doc_id not in (select doc_id from x) order by o, doc_id limit 20) select * from x union all select * from y""")
def two_pools(spark, d):
    rows = docs(spark, d).select("doc_id", "lang", F.length("text").alias("n"))
    x = cp.sample(rows.where("lang = 'en'"), "doc_id", 20).select("doc_id", F.lit("en").alias("pool"))
    y = cp.sample(rows.where("n > 1000").join(F.broadcast(x), "doc_id", "left_anti"), "doc_id", 20)  # x has 20 rows
    return x.unionByName(y.select("doc_id", F.lit("long").alias("pool")))


@query("second_pass", """
select d.doc_id, coalesce(l.quality, -1) as prior, case when l.doc_id is null then 'low' else 'high' end as confidence, l.doc_id is null and length(text) > 400 as targeted from documents d left join (select distinct doc_id, quality from labels) l using (doc_id)""")
def second_pass(spark, d):
    prior = table(spark, d, "labels").select("doc_id", "quality", F.lit(True).alias("known")).distinct()
    j = docs(spark, d).select("doc_id", F.length("text").alias("n")).join(prior, "doc_id", "left")
    unknown = F.col("known").isNull()
    return j.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("prior"), F.when(unknown, "low").otherwise("high").alias("confidence"), (unknown & (F.col("n") > 400)).alias("targeted"))


@query("id_sets", """
with a as (select doc_id from documents where lang = 'en'), b as (select doc_id from labels where toxic = 1)
select (select count(*) from (select * from a union select * from b)) as n_union, (select count(*) from (select * from a intersect select * from b)) as n_both, (select count(*) from (select * from a except select * from b)) as n_first, (select count(*) from (select * from b except select * from a)) as n_second""")
def id_sets(spark, d):
    a, b = docs(spark, d).where("lang = 'en'").select("doc_id", F.lit(1).alias("s")), table(spark, d, "labels").where("toxic = 1").select("doc_id", F.lit(2).alias("s"))
    sides = a.unionByName(b).groupBy("doc_id").agg(F.bit_or("s").alias("s"))  # one shuffle for all four
    return sides.agg(F.count("*").alias("n_union"), F.count_if(F.col("s") == 3).alias("n_both"), F.count_if(F.col("s") == 1).alias("n_first"), F.count_if(F.col("s") == 2).alias("n_second"))


@query("term_sets", f"""
with c as (select lang, w, count(*) as n from (select lang, unnest({RAW_TK}) as w from documents where lang in ('en', 'de')) group by all), r as (select lang, w from c qualify row_number() over (partition by lang order by n desc, w) <= 100), s as (select w, count(*) as k, min(lang) as l from r group by w)
select count(*) as n_union, count(*) filter (k = 2) as n_shared, count(*) filter (k = 1 and l = 'en') as only_en, count(*) filter (k = 1 and l = 'de') as only_de, count(*) filter (k = 2) / count(*)::double as jaccard from s""")
def term_sets(spark, d):
    r = fq.top(fq.gram_counts(docs(spark, d).where(F.col("lang").isin("en", "de")), tx.tokens(F.col("text")), ["lang"]), 100, ["lang"])
    s = r.groupBy("gram").agg(F.count("*").alias("k"), F.min("lang").alias("l"))
    out = s.agg(F.count("*").alias("n_union"), F.count_if(F.col("k") == 2).alias("n_shared"), F.expr("count_if(k = 1 and l = 'en')").alias("only_en"), F.expr("count_if(k = 1 and l = 'de')").alias("only_de"))
    return out.withColumn("jaccard", F.try_divide(F.col("n_shared").cast("double"), F.col("n_union")))


@query("first_seen_terms", f"""
with t as (select conv_id, turn, unnest(tk) as w, generate_subscripts(tk, 1) as i from (select conv_id, turn, {RAW_TK} as tk from conversations)), f as (select conv_id, w, min(turn * 1000000 + i) as p from t group by all)
select conv_id, w as term, row_number() over (partition by conv_id order by p) as place from f""")
def first_seen_terms(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(tx.tokens(F.col("text"))).alias("i", "term"))
    first = rows.groupBy("conv_id", "term").agg(F.min(F.struct("turn", "i")).alias("p"))
    return first.select("conv_id", "term", F.row_number().over(Window.partitionBy("conv_id").orderBy("p")).cast("long").alias("place"))


# --- markers and tokenizers ---------------------------------------------------------------------------------------------------------------

MARKERS = ("and", "the", "license", "under", "that")


@query("marker_counts", f"""
with t as (select {PLAIN} as tk from documents), h as (select tk, unnest(list_filter(range(1, len(tk) + 1), lambda i: tk[i] = 'rest')) as i from t), c as (select unnest(tk[greatest(i - 10, 1):i - 1] || tk[i + 1:i + 10]) as marker from h)
select marker, count(*) as n from c where list_contains({list(MARKERS)!r}, marker) group by marker""")
def marker_counts(spark, d):
    near = F.transform(tx.around_phrase(tx.tokens_plain(F.col("text")), ("rest",), 10), lambda h: F.filter(F.concat(h["left"], h["right"]), lambda t: t.isin(*MARKERS)))
    return docs(spark, d).select(F.explode_outer(F.flatten(near)).alias("marker")).where("marker is not null").groupBy("marker").agg(F.count("*").alias("n"))


@query("anchor_tokens", f"""
with s(seed) as (values ('take a rest'), ('under the license'), ('go to you'), ('rest')), a as (select seed, list_filter(string_split(seed, ' '), lambda t: t not in ('a', 'the', 'to', 'you'))[-1] as anchor from s),
c as (select w, count(*) as n from (select unnest({RAW_TK}) as w from documents) group by w) select seed, anchor, coalesce(n, 0) as n from a left join c on w = anchor""")
def anchor_tokens(spark, d):
    seeds = spark.sql("select * from values ('take a rest'), ('under the license'), ('go to you'), ('rest') as s(seed)").withColumn("anchor", tx.anchor_token(F.col("seed")))
    counts = fq.gram_counts(docs(spark, d), tx.tokens(F.col("text")), name="anchor")
    return seeds.join(counts, "anchor", "left").select("seed", "anchor", F.coalesce("n", F.lit(0)).alias("n"))


TREEBANK = r"""regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '([a-z])n''t([^a-z]|$)', '\1 n''t\2', 'g'), '([a-z])(''ll|''re|''ve|''s|''m|''d)([^a-z]|$)', '\1 \2\3', 'g'), '([.,;:!?"()\[\]{}<>&@#$%*])', ' \1 ', 'g'), '[ \t\n\r]+')"""


@query("treebank_tokens", f"""
with t as (select conv_id, turn, {TREEBANK} as w from conversations)
select conv_id, turn, array_to_string(list_filter(w, lambda x: regexp_matches(x, '[a-z0-9]')), ' ') as tokens, len(list_filter(w, lambda x: regexp_full_match(x, '[a-z][a-z-]*'))) as n_words from t""")
def treebank_tokens(spark, d):
    rows = table(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    return rows.select("conv_id", "turn", F.array_join(tx.tokens_treebank(F.col("text")), " ").alias("tokens"), F.size(tx.tokens_treebank(F.col("text"), True)).cast("long").alias("n_words"))


@query("social_tokens", r"""select conv_id, turn, array_to_string(regexp_extract_all(lower(coalesce(text, '')), '#[a-z0-9_]+|[0-9]+|[a-z]+|[\x{1F300}-\x{1FAFF}]'), ' ') as tokens from conversations""")
def social_tokens(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(tx.tokens_social(F.coalesce("text", F.lit(""))), " ").alias("tokens"))


TIMES = r"[0-9]+ (?:second|minute|hour|day|week|month|year)s?|[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}:[0-9]{2}|today|tomorrow|yesterday"


@query("temporal_expressions", f"select doc_id, len(x) as n, array_to_string(x, '|') as found from (select doc_id, regexp_extract_all(lower(text), '{TIMES}') as x from documents) where len(x) > 0")
def temporal_expressions(spark, d):
    x = F.regexp_extract_all(F.lower("text"), F.lit(TIMES), F.lit(0))
    return docs(spark, d).select("doc_id", x.alias("x")).where(F.size("x") > 0).select("doc_id", F.size("x").cast("long").alias("n"), F.array_join("x", "|").alias("found"))


NUDGES = "under the license|take a (?:break|rest)|of the|get some rest"


@query("nudge_flags", f"select doc_id, len(x) > 0 as nudge, array_to_string(x, '|') as spans, contains(lower(text), 'user:') or contains(lower(text), 'assistant:') as speaker from (select doc_id, coalesce(text, '') as text, regexp_extract_all(lower(coalesce(text, '')), '{NUDGES}') as x from documents)")
def nudge_flags(spark, d):
    low = F.lower(F.coalesce("text", F.lit("")))
    held = docs(spark, d).select("doc_id", low.alias("low"), F.regexp_extract_all(low, F.lit(NUDGES), F.lit(0)).alias("x"))
    return held.select("doc_id", (F.size("x") > 0).alias("nudge"), F.array_join("x", "|").alias("spans"), (F.contains("low", F.lit("user:")) | F.contains("low", F.lit("assistant:"))).alias("speaker"))


@query("code_blocks", r"select page_id, contains(html, '```') or regexp_matches(html, '(?m)^    .*\n    ') as has_code from pages")
def code_blocks(spark, d):
    return table(spark, d, "pages").select("page_id", tx.has_code_block(F.col("html")).alias("has_code"))


@query("clean_variants", rf"select page_id, length(regexp_replace(t, '{NO_URL}', '', 'g')) as cut, length(regexp_replace(t, '{NO_URL}', ' ', 'g')) as spaced, md5(replace(t, chr(13) || chr(10), chr(10))) as unix_md5 from (select page_id, concat_ws(' ', url, html) as t from pages)")
def clean_variants(spark, d):
    held = table(spark, d, "pages").select("page_id", F.concat_ws(" ", "url", "html").alias("t"))
    cut = lambda to: F.length(F.regexp_replace("t", NO_URL, to)).cast("long")
    return held.select("page_id", cut("").alias("cut"), cut(" ").alias("spaced"), F.md5(F.replace("t", F.lit("\r\n"), F.lit("\n")).cast("binary")).alias("unix_md5"))


@query("hashed_embedding", f"""
with t as (select doc_id, unnest({RAW_TK}) as w from documents), c as (select doc_id, ('0x' || left(md5(w), 2))::int as slot, count(*) as n from t group by all)
select doc_id, slot, round(n / sqrt(sum(n * n) over (partition by doc_id)), 9) as value from c""")
def hashed_embedding(spark, d):
    c = docs(spark, d).select("doc_id", F.explode(tx.hashed_terms(tx.tokens(F.col("text")))).alias("slot")).groupBy("doc_id", "slot").agg(F.count("*").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("doc_id")))  # at most 256 rows a document
    return c.select("doc_id", "slot", F.round(F.col("n") / norm, 9).alias("value"))


# --- seed terms, shifts, profiles, dates ---------------------------------------------------------------------------------------------------

#: Term, confidence and retrieval action; the last pattern isn't valid and is looked for as it stands.
SEEDS = (
    ("take a rest", "high", "exact match"), ("licen[sc]e", "high", "regex"), ("under the", "medium", "co_occurrence"), ("and (the|an)\\b", "high", "regex"), ("the (", "high", "regex"),
)
_SEED_SQL = {"take a rest": "contains(t, 'take a rest')", "licen[sc]e": "regexp_matches(t, '(?i)licen[sc]e')", "under the": "contains(t, 'under the')", "and (the|an)\\b": r"regexp_matches(t, '(?i)and (the|an)\b')", "the (": "contains(t, 'the (')"}


@query("seed_matches", "select doc_id, " + ", ".join(f"{_SEED_SQL[t]} as {tx.seed_column(t)}" for t, _, _ in SEEDS) + ", array_to_string(list_filter([" + ", ".join(f"case when {_SEED_SQL[t]} then '{t}' end" for t, c, _ in SEEDS if c == "high") + "], lambda x: x is not null), '|') as high from (select doc_id, lower(coalesce(text, '')) as t from documents)")
def seed_matches(spark, d):
    """A flag for each seed term by its action, and the high-confidence terms that a document holds."""
    found = {t: tx.seed_match(F.coalesce("text", F.lit("")), t, action, tx.valid_pattern(spark, t)) for t, _, action in SEEDS}
    high = F.array_compact(F.array(*[F.when(found[t], F.lit(t)) for t, c, _ in SEEDS if c == "high"]))
    return docs(spark, d).select("doc_id", *(m.alias(tx.seed_column(t)) for t, m in found.items()), F.array_join(high, "|").alias("high"))


@query("confidence_shift", """
with v as (select case when contains(text, '?') then 'question' else 'plain' end as l1, case when length(text) > 400 then 2 when length(text) > 100 then 1 else 0 end as c1, case when contains(text, '?') and length(text) > 50 then 'question' else 'plain' end as l2, case when contains(text, '?') then 2 when contains(text, ' the ') then 1 else 0 end as c2 from (select coalesce(text, '') as text from conversations))
select count(*) as n, count(*) filter (l1 <> l2) as label_changed, count(*) filter (c2 > c1) as conf_up, count(*) filter (c2 < c1) as conf_down, count(*) filter (c2 = c1) as conf_same from v""")
def confidence_shift(spark, d):
    """Two labellings of the same rows: changed labels, and confidences (low, medium, high) that went up, down or stayed."""
    t = F.coalesce("text", F.lit(""))
    asked, n = F.contains(t, F.lit("?")), F.length(t)
    first = F.when(n > 400, "high").when(n > 100, "medium").otherwise("low")
    second = F.when(asked, "high").when(F.contains(t, F.lit(" the ")), "medium").otherwise("low")
    rows = table(spark, d, "conversations").select(F.when(asked, "question").otherwise("plain").alias("l1"), first.alias("c1"), F.when(asked & (n > 50), "question").otherwise("plain").alias("l2"), second.alias("c2"))
    return cp.label_shift(rows, "l1", "c1", "l2", "c2")


_GROUPINGS = {"label": "label", "mod3": "vec_id % 3", "mod4": "vec_id % 4", "mod5": "vec_id % 5"}
_ARI = "round((ij - pa * pb / (n * (n - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2)), 9)"
_ARI_SQL = "with " + ", ".join(
    f"k{i}_{j} as (with l as (select {_GROUPINGS[a]} as a, {_GROUPINGS[b]} as b from embeddings), c as (select a, b, count(*) as n from l group by all), k as (select (select sum(n * (n - 1) / 2) from c) as ij, (select sum(m * (m - 1) / 2) from (select sum(n) as m from c group by a)) as pa, (select sum(m * (m - 1) / 2) from (select sum(n) as m from c group by b)) as pb, (select count(*) from l) as n) select '{a}' as a, '{b}' as b, {_ARI} as ari from k)"
    for i, a in enumerate(_GROUPINGS) for j, b in enumerate(_GROUPINGS) if i < j
) + ", u as (" + " union all ".join(f"select * from k{i}_{j}" for i in range(4) for j in range(4) if i < j) + "), m as (select a, b, ari from u union all select b, a, ari from u union all select unnest(['label', 'mod3', 'mod4', 'mod5']), unnest(['label', 'mod3', 'mod4', 'mod5']), 1.0)"


def _ari_matrix(spark, d):
    rows = table(spark, d, "embeddings").select("label", *(F.expr(f"vec_id % {k}").alias(f"mod{k}") for k in (3, 4, 5)))
    return cp.rand_matrix(rows, list(_GROUPINGS)).withColumn("ari", F.round("ari", 9))


@query("ari_matrix", _ARI_SQL + " select * from m")
def ari_matrix(spark, d):
    return _ari_matrix(spark, d)


@query("ari_off_diagonal", _ARI_SQL + " select round(avg(ari), 9) as mean, min(ari) as least, max(ari) as most from m where a <> b")
def ari_off_diagonal(spark, d):
    return _ari_matrix(spark, d).where("a <> b").agg(F.round(F.avg("ari"), 9).alias("mean"), F.min("ari").alias("least"), F.max("ari").alias("most"))


@query("feature_means", "select toxic, count(*) as n, round(avg(n_chars), 6) as mean_chars, round(avg(len(string_split(coalesce(text, ''), ' '))), 6) as mean_words, round(avg(length(coalesce(text, '')) - length(replace(coalesce(text, ''), '?', ''))), 6) as mean_asked from documents join labels using (doc_id) group by toxic")
def feature_means(spark, d):
    t = F.coalesce("text", F.lit(""))
    rows = docs(spark, d).select("doc_id", "n_chars", F.size(F.split(t, " ")).alias("w"), (F.length(t) - F.length(F.replace(t, F.lit("?"), F.lit("")))).alias("q")).join(table(spark, d, "labels"), "doc_id")
    return rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(c), 6).alias(f"mean_{k}") for k, c in (("chars", "n_chars"), ("words", "w"), ("asked", "q"))))


@query("group_profile", """with c as (select source, lang, count(*) as n from documents group by all)
select source, cast(sum(n) as bigint) as n, '{' || string_agg('"' || lang || '":' || n, ',' order by lang) || '}' as langs, arg_min(lang, (-n, lang)) as most, round(max(n) / sum(n), 9) as share from c group by source""")
def group_profile(spark, d):
    """Per group its size, the counts of another column's values as JSON, the commonest value and its share."""
    return cp.group_profile(docs(spark, d).select("source", "lang"), "source", "lang").withColumnsRenamed({"counts": "langs"}).withColumn("share", F.round("share", 9))


@query("valid_times", "select event_id, ts as at from events where event_type <> 'error' and props is not null")
def valid_times(spark, d):
    """Rows with an unreadable time or a null body go; times here are made unreadable where an event is an error."""
    shown = F.when(F.col("event_type") == "error", "n/a").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    rows = table(spark, d, "events").select("event_id", "props", shown.alias("at"))
    return cp.readable(rows, "at", ["props"]).select("event_id", "at")


@query("epoch_times", "select event_id, epoch(ts)::bigint as seconds, make_timestamp(epoch(ts)::bigint * 1000000) as at from (select event_id, date_trunc('second', ts) as ts from events)")
def epoch_times(spark, d):
    """Seconds since 1970 as times without a zone, in UTC."""
    rows = table(spark, d, "events").select("event_id", F.unix_seconds(F.date_trunc("second", F.col("ts").cast("timestamp"))).alias("seconds"))
    return rows.withColumn("at", cp.naive_utc(F.col("seconds")))


@query("weekly_pmi", """with c as (select date_trunc('week', ts)::date as week, count(*) as n, count(*) filter (value > 50) as n_high, count(*) filter (event_type = 'error') as n_error, count(*) filter (value > 50 and event_type = 'error') as n_both from events group by 1 having count(*) >= 10)
select *, case when n_both = 0 then 0 else round(log2(n_both::double * n / (n_high::double * n_error)), 4) end as pmi from c""")
def weekly_pmi(spark, d):
    high, error = F.col("value") > 50, F.col("event_type") == "error"
    c = table(spark, d, "events").groupBy(F.date_trunc("week", "ts").cast("date").alias("week")).agg(F.count(F.lit(1)).alias("n"), F.count_if(high).alias("n_high"), F.count_if(error).alias("n_error"), F.count_if(high & error).alias("n_both")).where("n >= 10")
    return c.withColumn("pmi", F.coalesce(F.round(ac.pmi(F.col("n_both"), F.col("n_high"), F.col("n_error"), F.col("n")), 4), F.lit(0.0)))


@query("near_dup_removed", "with v as (select vec_id as id, embedding::double[] as v from embeddings) select vec_id from embeddings where vec_id not in (select b.id from v a join v b on a.id < b.id where list_cosine_similarity(a.v, b.v) > 0.5)")
def near_dup_removed(spark, d):
    return cp.drop_near_duplicates(table(spark, d, "embeddings"), "vec_id", "embedding", 0.5).select("vec_id")


@query("json_summary", "select source, '{\"n\":' || count(*) || ',\"longest\":' || max(n_chars) || '}' as summary from documents group by source")
def json_summary(spark, d):
    return docs(spark, d).groupBy("source").agg(F.to_json(F.struct(F.count(F.lit(1)).alias("n"), F.max("n_chars").alias("longest"))).alias("summary"))


#: Words and their base forms; a caller's dictionary takes its place.
LEMMAS = {"rests": "rest", "rested": "rest", "resting": "rest", "licenses": "license", "licensed": "license", "thes": "the"}


@query("lemma_counts", f"with t as (select unnest({RAW_TK}) as w from documents), l as (select coalesce(map {{{', '.join(f'{k!r}: {v!r}' for k, v in LEMMAS.items())}}}[w], w) as lemma from t), c as (select lemma, count(*) as n from l group by 1) select lemma, n, row_number() over (order by n desc, lemma) as rank from c qualify rank <= 100")
def lemma_counts(spark, d):
    held = tx.lemmas(tx.tokens(F.col("text")), F.create_map(*[F.lit(x) for kv in LEMMAS.items() for x in kv]))
    return fq.top(fq.gram_counts(docs(spark, d), held, name="lemma"), 100, name="lemma")


@query("post_features", f"""with t as (select doc_id, coalesce(text, '') as text from documents)
select doc_id, length(text) as n_chars, len({RAW_TK}) as n_tokens, len(list_distinct({RAW_TK})) as n_types, length(text) - length(replace(text, '?', '')) as n_asked, length(text) - length(replace(text, '!', '')) as n_exclaimed,
len(list_filter({RAW_TK}, lambda t: list_contains({STOP_SQL}, t))) as n_stops, contains(lower(text), 'license') as licensed, regexp_matches(text, 'https?://') as linked, len(regexp_extract_all(text, '[0-9]+')) as n_numbers, len(regexp_extract_all(text, '[.!?]+')) as n_ends from t""")
def post_features(spark, d):
    """A row of features for each document in one pass."""
    rows = docs(spark, d).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tk", tx.tokens(F.col("text")))
    gone = lambda c: (F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))).cast("long")
    count = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0))).cast("long")
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.size("tk").cast("long").alias("n_tokens"), F.size(F.array_distinct("tk")).cast("long").alias("n_types"), gone("?").alias("n_asked"), gone("!").alias("n_exclaimed"),
        F.size(F.filter("tk", lambda t: t.isin(*tx.STOPS))).cast("long").alias("n_stops"), F.contains(F.lower("text"), F.lit("license")).alias("licensed"), F.col("text").rlike("https?://").alias("linked"), count("[0-9]+").alias("n_numbers"), count("[.!?]+").alias("n_ends"),
    )
