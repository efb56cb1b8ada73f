"""Association and graph queries over ``documents`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import text as tx
from lexloom.operators import association as ac
from lexloom.operators import frequency as fq
from lexloom.operators import graph as gr
from lexloom.operators.components import connected_components

from .registry import query, table
from .text_queries import PLAIN, RAW_TK, STOP_SQL, TK, docs, tk

PMI = "log2(co_occurrences::double * total / (anchor_freq::double * collocate_freq))"


@query("colloc_flat", f"""
with s as (select row_number() over (order by doc_id, i) - 1 as g, t from (select doc_id, unnest(tk) as t, generate_subscripts(tk, 1) as i from (select doc_id, {RAW_TK} as tk from documents))),
f as (select t, count(*) as freq from s group by t), a as (select t as anchor, g as pl, unnest(range(g - 5, g + 6)) as g from s where t in ('rest', 'license')),
c as (select anchor, s.t as collocate, count(distinct pl) as co_occurrences from a join s using (g) where g <> pl and length(s.t) >= 3 and s.t <> anchor and not list_contains({STOP_SQL}, s.t) group by all having count(distinct pl) >= 3)
select anchor, collocate, co_occurrences, x.freq as anchor_freq, y.freq as collocate_freq, log2(co_occurrences::double * (select sum(freq)::bigint from f) / (x.freq::double * y.freq)) as pmi from c join f x on x.t = anchor join f y on y.t = collocate""")
def colloc_flat(spark, d):
    return ac.flat_collocation(docs(spark, d), "doc_id", tx.tokens(F.col("text")), ("rest", "license"), 5, 3, stops=tx.STOPS)


@query("colloc_bounded", f"""
with t as (select {PLAIN} as tk from documents), h as (select tk, unnest(list_filter(range(1, len(tk)), lambda i: tk[i:i + 1] = ['and', 'the'])) as i from t),
c as (select collocate, count(*) as co from (select unnest(tk[greatest(i - 5, 1):i - 1] || tk[i + 2:i + 6]) as collocate from h) where collocate not in ('and', 'the') group by 1 having count(*) >= 3),
f as (select w, count(*) as freq from (select unnest(tk) as w from t) group by w)
select collocate, co as co_occurrences, log2(co::double * (select sum(freq)::bigint from f) / ((select count(*) from h)::double * freq)) as pmi from c join f on w = collocate""")
def colloc_bounded(spark, d):
    return ac.bounded_collocation(docs(spark, d), tx.tokens_plain(F.col("text")), ("and", "the"), 5, 3)


LEX = {"lx_rest": ("rest", "rere"), "lx_with": ("with", "for"), "lx_license": ("license", "apache")}
FLAGS_SQL = "select source, doc_id, list_contains(tk, 'the') as tgt, " + ", ".join(f"list_has_any(tk, {list(v)!r}) as {k}" for k, v in LEX.items()) + f" from (select source, doc_id, {RAW_TK} as tk from documents)"
LONG_SQL = "select * from (" + " union all ".join(f"select '{k}' as lexicon, source, doc_id, {k} as l, tgt as t from f" for k in LEX) + ")"


def flags(spark, d):
    held = docs(spark, d).select("source", "doc_id", tx.tokens(F.col("text")).alias("tk"))
    return held.select("source", "doc_id", F.array_contains("tk", "the").alias("tgt"), *(F.arrays_overlap("tk", tx.words(v)).alias(k) for k, v in LEX.items()))


@query("assoc_pmi", f"""
with f as ({FLAGS_SQL}), x as ({LONG_SQL}), c as (select lexicon, count(*) as n, count(*) filter (l) as n_lexicon, count(*) filter (t) as n_target, count(*) filter (l and t) as n_both from x group by lexicon)
select *, n_both / nullif(n_lexicon, 0) as p_target, n_both / nullif(n_target, 0) as p_lexicon, case when n_both > 0 then log2(n_both::double * n / (n_lexicon::double * n_target)) end as pmi,
case when n_both > 0 then log2(n_both::double * n / (n_lexicon::double * n_target)) / -log2(n_both::double / n) end as npmi, case when n_both > 0 then 14.0 + log2(n_both::double * 2 / (n_lexicon + n_target)) end as log_dice,
n_both::double * n / nullif(n_lexicon::double * n_target, 0) as lift from c""")
def assoc_pmi(spark, d):
    return ac.flag_association(flags(spark, d), list(LEX), "tgt")


@query("assoc_directional", f"""
with f as ({FLAGS_SQL}) select 'lx_rest' as lexicon, count(*) filter (lx_rest and not lx_license) as n_narration, count(*) filter (lx_rest and not lx_license and tgt) as n_directional,
count(*) filter (lx_rest and not lx_license and tgt) / nullif(count(*) filter (lx_rest and not lx_license), 0) as p_directional from f""")
def assoc_directional(spark, d):
    narr = F.col("lx_rest") & ~F.col("lx_license")
    out = flags(spark, d).agg(F.count_if(narr).alias("n_narration"), F.count_if(narr & F.col("tgt")).alias("n_directional"))
    return out.select(F.lit("lx_rest").alias("lexicon"), "n_narration", "n_directional", F.try_divide("n_directional", "n_narration").alias("p_directional"))


@query("assoc_by_source", f"""
with f as ({FLAGS_SQL}) select source, count(*) as n, count(*) filter (lx_with and tgt) as n_both, case when count(*) filter (lx_with and tgt) > 0 then
log2(count(*) filter (lx_with and tgt)::double * count(*) / (count(*) filter (lx_with)::double * count(*) filter (tgt))) end as pmi from f group by source having count(*) >= 10""")
def assoc_by_source(spark, d):
    c = flags(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if("lx_with").alias("a"), F.count_if("tgt").alias("b"), F.count_if(F.col("lx_with") & F.col("tgt")).alias("n_both")).where("n >= 10")
    return c.select("source", "n", "n_both", ac.pmi(F.col("n_both"), F.col("a"), F.col("b"), F.col("n")).alias("pmi"))


@query("pmi_rank_order", f"""
with f as ({FLAGS_SQL}), x as ({LONG_SQL}), u as (select source, lexicon, l, t from x union all select 'all', lexicon, l, t from x),
c as (select source, lexicon, count(*) as n, count(*) filter (l) as a, count(*) filter (t) as b, count(*) filter (l and t) as k from u group by all),
p as (select source, lexicon, case when k > 0 then round(log2(k::double * n / (a::double * b)), 9) else 0 end as pmi from c), r as (select source, array_to_string(list(lexicon order by pmi desc, lexicon), '>') as ranking from p group by source)
select source, ranking, ranking = (select ranking from r where source = 'all') as same_as_all from r""")
def pmi_rank_order(spark, d):
    """Lexicons of each source by their PMI with the target, and whether the order is that of all sources together."""
    f = flags(spark, d)
    long = f.select("source", "tgt", F.explode(F.array(*[F.struct(F.lit(k).alias("lexicon"), F.col(k).alias("l")) for k in LEX])).alias("s")).select("source", "s.lexicon", "s.l", F.col("tgt").alias("t"))
    sums = (F.count(F.lit(1)).alias("n"), F.count_if("l").alias("a"), F.count_if("t").alias("b"), F.count_if(F.col("l") & F.col("t")).alias("k"))
    each = long.groupBy("source", "lexicon").agg(*sums)
    every = each.groupBy("lexicon").agg(*(F.sum(c).alias(c) for c in "nabk")).withColumn("source", F.lit("all"))
    p = each.unionByName(every).withColumn("pmi", F.coalesce(F.round(ac.pmi(F.col("k"), F.col("a"), F.col("b"), F.col("n")), 9), F.lit(0.0)))
    order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("pmi")).alias("m"), "lexicon"))), lambda x: x["lexicon"]), ">")
    r = p.groupBy("source").agg(order.alias("ranking"))
    whole = r.where("source = 'all'").select(F.col("ranking").alias("_all"))  # one row
    return r.crossJoin(F.broadcast(whole)).select("source", "ranking", (F.col("ranking") == F.col("_all")).alias("same_as_all"))


SENT = r"regexp_split_to_array(text, '[.!?\n]+')"


ALL_TK = r"regexp_extract_all(lower(s), '[\p{L}\p{N}_]+')"
ANCHORS = ("rest", "license", "under")


@query("sentence_pairs", f"""
with s as (select unnest({SENT}) as s from documents), t as (select {ALL_TK} as tk from s), h as (select tk, unnest(list_filter(range(1, len(tk) + 1), lambda i: list_contains({list(ANCHORS)!r}, tk[i]))) as i from t),
w as (select list_filter(tk[greatest(i - 10, 1):i - 1] || tk[i + 1:i + 10], lambda x: regexp_full_match(x, '[a-z]{{3,}}') and not list_contains({STOP_SQL}, x)) as c from h),
p as (select unnest(flatten(list_transform(range(1, len(c) + 1), lambda k: list_transform(c[k + 1:len(c)], lambda b: {{'a': least(c[k], b), 'b': greatest(c[k], b)}})))) as p from w)
select p.a as term_1, p.b as term_2, count(*) as n from p group by all having count(*) >= 3""")
def sentence_pairs(spark, d):
    """Term pairs within 10 words of an anchor, in sentences of any length."""
    sent = docs(spark, d).select(F.explode(F.split("text", r"[.!?\n]+")).alias("s"))
    every = F.regexp_extract_all(F.lower("s"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return ac.anchored_pairs(sent, every, ANCHORS, 10, lambda x: x.rlike("^[a-z]{3,}$") & ~x.isin(*tx.STOPS), 3)


#: Terms of the graphs over documents, and of those by type.
VOCABULARY, TYPED = 2000, 1500

EDGES_SQL = f"""t as (select doc_id, lang, list_sort(list_distinct({TK})) as tk from documents), v as (select w as term, count(*) as freq from (select unnest({TK}) as w from documents) group by w order by freq desc, term limit 2000),
e0 as (select doc_id, unnest(tk) as w from t), e1 as (select doc_id, w from e0 semi join v on w = term), edges as (select a.w as src, b.w as dst, count(*) as weight from e1 a join e1 b on a.doc_id = b.doc_id and a.w < b.w group by all having count(*) >= 5)"""


def graph(spark, d, size=VOCABULARY):
    vocab = gr.vocabulary(docs(spark, d), tk(), size)
    return vocab, gr.cooccurrence(docs(spark, d), tk(), vocab, 5)


@query("cooc_edges", f"with {EDGES_SQL} select * from edges")
def cooc_edges(spark, d, size=VOCABULARY):
    return graph(spark, d, size)[1]


@query("graph_stats", f"with {EDGES_SQL}, n as (select src as w from edges union select dst from edges) select (select count(*) from n) as nodes, count(*) as edges, 2.0::double * count(*) / ((select count(*) from n) * ((select count(*) from n) - 1)) as density, 2.0::double * count(*) / (select count(*) from n) as average_degree from edges")
def graph_stats(spark, d, size=VOCABULARY):
    return gr.graph_stats(*graph(spark, d, size))


ENDS = "ends as (select src as term, dst as other, weight from edges union all select dst, src, weight from edges)"


@query("degree_top", f"with {EDGES_SQL}, {ENDS} select term, count(*) as degree, cast(sum(weight) as bigint) as strength from ends group by term order by degree desc, term limit 40")
def degree_top(spark, d, size=VOCABULARY):
    return gr.degrees(graph(spark, d, size)[1]).orderBy(F.desc("degree"), "term").limit(40)


@query("degree_centrality", f"with {EDGES_SQL}, {ENDS} select term, count(*) / ((select count(distinct term) from ends) - 1)::double as centrality from ends group by term")
def degree_centrality(spark, d, size=VOCABULARY):
    deg = gr.degrees(graph(spark, d, size)[1])
    return deg.crossJoin(F.broadcast(deg.agg(F.count(F.lit(1)).alias("n")))).select("term", (F.col("degree") / (F.col("n") - 1).cast("double")).alias("centrality"))


@query("isolates", f"with {EDGES_SQL}, {ENDS} select term, freq from v anti join ends using (term)")
def isolates(spark, d, size=VOCABULARY):
    vocab, edges = graph(spark, d, size)
    return vocab.join(gr.degrees(edges), "term", "left_anti").select("term", "freq")


@query("ego", f"with {EDGES_SQL}, {ENDS}, near as (select term as seed, other as term from ends where term in ('rest', 'license') union select distinct term, term from ends where term in ('rest', 'license')) select x.seed, src, dst, weight from edges join near x on x.term = src join near y on y.seed = x.seed and y.term = dst")
def ego(spark, d, size=VOCABULARY):
    return gr.ego(graph(spark, d, size)[1], ("rest", "license"))


@query("subgraph_stats", f"with {EDGES_SQL}, {ENDS}, near as (select term as seed, other as term from ends where term in ('rest', 'license') union select distinct term, term from ends where term in ('rest', 'license')), s as (select x.seed, src, dst from edges join near x on x.term = src join near y on y.seed = x.seed and y.term = dst), n as (select seed, count(distinct term) as nodes from near group by seed) select seed, nodes, count(*) as edges, 2.0::double * count(*) / (nodes * (nodes - 1)) as density from s join n using (seed) group by seed, nodes")
def subgraph_stats(spark, d, size=VOCABULARY):
    e = gr.ego(graph(spark, d, size)[1], ("rest", "license"))
    n = e.select("seed", F.explode(F.array("src", "dst")).alias("t")).groupBy("seed").agg(F.countDistinct("t").alias("nodes"))
    return e.groupBy("seed").agg(F.count(F.lit(1)).alias("edges")).join(n, "seed").select("seed", "nodes", "edges", (F.lit(2.0) * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).alias("density"))


@query("adjacency", f"with {EDGES_SQL}, {ENDS}, top5 as (select term from ends group by term order by count(*) desc, term limit 200) select a.term, b.term as other, coalesce(weight, 0) as weight from top5 a cross join top5 b left join ends e on e.term = a.term and e.other = b.term")
def adjacency(spark, d, size=VOCABULARY, most=200):
    edges = graph(spark, d, size)[1]
    top_terms = F.broadcast(gr.degrees(edges).orderBy(F.desc("degree"), "term").limit(most).select("term"))
    grid = top_terms.crossJoin(top_terms.select(F.col("term").alias("other")))  # most x most rows
    return grid.join(gr.endpoints(edges), ["term", "other"], "left").select("term", "other", F.coalesce("weight", F.lit(0)).alias("weight"))


@query("components")
def components(spark, d, size=VOCABULARY):
    return connected_components(graph(spark, d, size)[1].where("weight >= 12"), "src", "dst")


@query("louvain")
def louvain(spark, d, size=VOCABULARY):
    return gr.louvain(graph(spark, d, size)[1])


@query("edge_list", f"with {EDGES_SQL} select src as \"Source\", dst as \"Target\", weight as \"Weight\" from edges where weight >= 8")
def edge_list(spark, d, size=VOCABULARY):
    return graph(spark, d, size)[1].where("weight >= 8").select(F.col("src").alias("Source"), F.col("dst").alias("Target"), F.col("weight").alias("Weight"))


CROSS = f"t as (select case when role = 'user' then 'post' else 'comment' end as type, conv_id, turn, list_distinct({TK}) as tk from conversations), v as (select w, count(*) as n from (select unnest(tk) as w from t) group by w order by n desc, w limit 1500), e1 as (select type, conv_id, turn, w from (select type, conv_id, turn, unnest(tk) as w from t) semi join v using (w)), edges as (select a.type, a.w as src, b.w as dst, count(*) as weight from e1 a join e1 b on a.type = b.type and a.conv_id = b.conv_id and a.turn = b.turn and a.w < b.w group by all having count(*) >= 3)"


def typed_edges(spark, d, size=TYPED):
    rows = table(spark, d, "conversations").withColumn("type", F.when(F.col("role") == "user", "post").otherwise("comment"))
    return gr.cooccurrence(rows, tk(), gr.vocabulary(rows, tk(), size, by_documents=True), 3, ["type"])


@query("crosstype_edges", f"with {CROSS} select * from edges")
def crosstype_edges(spark, d, size=TYPED):
    return typed_edges(spark, d, size)


@query("crosstype_jaccard", f"with {CROSS}, ends as (select type, src as term from edges union all select type, dst from edges), r as (select type, term, row_number() over (partition by type order by count(*) desc, term) as rn from ends group by type, term), k as (select type, term from r where rn <= 20) select count(*) filter (c = 2) as shared, count(*) filter (c = 2) / count(*)::double as jaccard from (select term, count(*) as c from k group by term)")
def crosstype_jaccard(spark, d, size=TYPED):
    deg = gr.degrees(typed_edges(spark, d, size), ["type"]).select("type", F.col("term").alias("gram"), F.col("degree").alias("n"))
    c = fq.top(deg, 20, ["type"]).groupBy("gram").agg(F.count(F.lit(1)).alias("c"))
    return c.agg(F.count_if(F.col("c") == 2).alias("shared"), F.count(F.lit(1)).alias("all")).select("shared", (F.col("shared") / F.col("all").cast("double")).alias("jaccard"))


LANG = f"c as (select lang, w, count(*) as n from (select lang, unnest({RAW_TK}) as w from documents) group by all), r as (select lang, w, n, row_number() over (partition by lang order by n desc, w) as rank from c qualify rank <= 500)"


@query("compare_two", f"with {LANG} select a.w as term, a.n as n_a, coalesce(b.n, 0) as n_b, a.rank as rank_a, b.rank as rank_b, b.n::double / a.n as growth, b.n is null as gone, (select sum(n) from c where lang = 'de')::double / (select sum(n) from c where lang = 'en') as expected, coalesce(b.n::double / a.n > (select sum(n) from c where lang = 'de')::double / (select sum(n) from c where lang = 'en'), false) as elevated from (select * from r where lang = 'en' and rank <= 100) a left join (select * from r where lang = 'de') b using (w)")
def compare_two(spark, d):
    c = fq.gram_counts(docs(spark, d), tx.tokens(F.col("text")), ["lang"])
    r = fq.top(c, 500, ["lang"])
    whole = c.agg(F.try_divide(F.sum(F.when(F.col("lang") == "de", F.col("n"))).cast("double"), F.sum(F.when(F.col("lang") == "en", F.col("n")))).alias("expected"))
    a, b = r.where("lang = 'en' and rank <= 100"), r.where("lang = 'de'")
    j = a.alias("a").join(b.alias("b"), F.col("a.gram") == F.col("b.gram"), "left").crossJoin(F.broadcast(whole))  # one row
    growth = F.col("b.n").cast("double") / F.col("a.n")
    return j.select("expected", F.coalesce(growth > F.col("expected"), F.lit(False)).alias("elevated"), F.col("a.gram").alias("term"), F.col("a.n").alias("n_a"), F.coalesce("b.n", F.lit(0)).alias("n_b"), F.col("a.rank").alias("rank_a"), F.col("b.rank").alias("rank_b"), (F.col("b.n").cast("double") / F.col("a.n")).alias("growth"), F.col("b.n").isNull().alias("gone"))


@query("compare_three", f"with {LANG}, s as (select lang, sum(n)::bigint as total from r group by lang), k as (select w, lang, 1000.0::double * n / total as x from r join s using (lang)) select w as term, coalesce(max(x) filter (lang = 'en'), 0) as en_per_1k, coalesce(max(x) filter (lang = 'de'), 0) as de_per_1k, coalesce(max(x) filter (lang = 'fr'), 0) as fr_per_1k, coalesce(max(x) filter (lang = 'en'), 0) / greatest(coalesce(max(x) filter (lang = 'de'), 0), 1e-9) as ratio_de from k group by w")
def compare_three(spark, d):
    r = fq.top(fq.gram_counts(docs(spark, d), tx.tokens(F.col("text")), ["lang"]), 500, ["lang"])
    k = r.join(F.broadcast(r.groupBy("lang").agg(F.sum("n").alias("total"))), "lang").withColumn("x", F.lit(1000.0) * F.col("n") / F.col("total"))
    at = {v: F.coalesce(F.max(F.when(F.col("lang") == v, F.col("x"))), F.lit(0.0)).alias(f"{v}_per_1k") for v in ("en", "de", "fr")}
    return k.groupBy(F.col("gram").alias("term")).agg(*at.values()).withColumn("ratio_de", F.col("en_per_1k") / F.greatest(F.col("de_per_1k"), F.lit(1e-9)))


@query("pair_npmi", f"with {EDGES_SQL}, n as (select count(*) as n from documents), f as (select w, count(*) as f from e1 group by w) select src as term_1, dst as term_2, weight as n, log2(weight::double * n.n / (x.f::double * y.f)) / -log2(weight::double / n.n) as npmi, 14.0 + log2(weight::double * 2 / (x.f + y.f)) as log_dice from edges join f x on x.w = src join f y on y.w = dst, n")
def pair_npmi(spark, d, size=VOCABULARY):
    rows = docs(spark, d)
    vocab, edges = graph(spark, d, size)
    f = rows.select(F.explode(F.array_distinct(tk())).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("f")).join(F.broadcast(vocab.select(F.col("term").alias("w"))), "w", "left_semi")
    j = edges.join(f.select(F.col("w").alias("src"), F.col("f").alias("fa")), "src").join(f.select(F.col("w").alias("dst"), F.col("f").alias("fb")), "dst").crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("docs"))))
    w, a, b, n = F.col("weight"), F.col("fa"), F.col("fb"), F.col("docs")
    return j.select(F.col("src").alias("term_1"), F.col("dst").alias("term_2"), w.alias("n"), ac.npmi(w, a, b, n).alias("npmi"), ac.log_dice(w, a, b).alias("log_dice"))


MEMBERS_SQL = f"with {EDGES_SQL}, m as (select distinct term, ascii(term) % 7 as community from (select src as term from edges union all select dst from edges)), z as (select community, count(*) as size from m group by 1), {ENDS}, i as (select x.term, x.community, count(*) as k from ends join m x using (term) join m y on y.term = ends.other and y.community = x.community group by 1, 2), k as (select m.community, m.term, coalesce(coalesce(k, 0)::double / nullif(size - 1, 0), 0) as centrality from m join z using (community) left join i using (term, community)), tops as (select *, row_number() over (partition by community order by centrality desc, term) as rank from k qualify rank <= 10)"


def community_tops(spark, d):
    """Communities here are terms by their first letter's code, so that SQL can say them; ``central_terms`` takes any."""
    edges = graph(spark, d)[1]
    members = gr.degrees(edges).select("term", F.pmod(F.ascii("term"), F.lit(7)).alias("community"))
    return gr.central_terms(members, edges)


@query("community_top", MEMBERS_SQL + " select community, term, centrality, rank from tops")
def community_top(spark, d):
    return community_tops(spark, d)


@query("community_mentions", MEMBERS_SQL + f", h as (select distinct doc_id, community from (select doc_id, unnest({TK}) as term from documents) join tops using (term)), l as (select doc_id, max(community) as last from h group by 1) select community, count(*) as mentions, min(doc_id) as first_row, count(*) filter (last = community) as assigned from h join l using (doc_id) group by 1")
def community_mentions(spark, d):
    """Documents that mention a community's top terms, the first of them, and how many stay with it when the last community wins."""
    hits = gr.mentions(docs(spark, d), "doc_id", tk(), community_tops(spark, d))
    last = hits.groupBy("row").agg(F.max("community").alias("last"))
    return hits.join(last, "row").groupBy("community").agg(F.count(F.lit(1)).alias("mentions"), F.min("row").alias("first_row"), F.count_if(F.col("last") == F.col("community")).alias("assigned"))


@query("tfidf_top", f"""with t as (select doc_id, lang, unnest({TK}) as w from documents), tf as (select lang, doc_id, w, count(*) as tf from t group by all),
v as (select lang, w from (select lang, w, sum(tf) as n from tf group by all) qualify row_number() over (partition by lang order by n desc, w) <= 50), k as (select tf.* from tf semi join v using (lang, w)),
n as (select lang, count(*) as docs from documents group by lang), i as (select lang, w, ln((1 + docs) / (1 + count(*))::double) + 1 as idf from k join n using (lang) group by lang, w, docs),
x as (select lang, doc_id, w, tf * idf as x from k join i using (lang, w)), m as (select lang, doc_id, sqrt(sum(x * x)) as norm from x group by all),
s as (select lang as segment, w as gram, sum(x / norm) as score from x join m using (lang, doc_id) group by all) select segment, gram, round(score, 6) as score from s qualify row_number() over (partition by segment order by score desc, gram) <= 10""")
def tfidf_top(spark, d):
    return ac.tfidf_top(docs(spark, d), "doc_id", "lang", tk(), 50, 10).select("segment", "gram", F.round("score", 6).alias("score"))
