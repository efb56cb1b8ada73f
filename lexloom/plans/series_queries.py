"""Time series, corpus building, cluster diagnostics and relational queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from lexloom.operators import corpus as co
from lexloom.operators import series as se

from .registry import query, table
from .text_queries import docs

DAILY = "select ts::date as day, count(*) as n, count(*) filter (event_type = 'error') as hits, avg(value) as mean_value from events group by 1"


def events(spark, d):
    return table(spark, d, "events")


def daily(spark, d):
    return se.daily(events(spark, d), "ts", "value", F.col("event_type") == "error")


@query("daily_agg", f"select *, hits / greatest(n, 1)::double as rate from ({DAILY})")
def daily_agg(spark, d):
    return daily(spark, d)


@query("monthly_counts", "select date_trunc('month', ts)::date as month, count(*) as n from events group by 1")
def monthly_counts(spark, d):
    return events(spark, d).groupBy(F.date_trunc("month", "ts").cast("date").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("weekly_assoc", "select date_trunc('week', ts)::date as week, event_type, count(*) as n, count(*) filter (value > 50) as n_high, count(*) filter (value > 50) / count(*)::double as rate from events group by 1, 2 having count(*) >= 10")
def weekly_assoc(spark, d):
    g = events(spark, d).groupBy(F.date_trunc("week", "ts").cast("date").alias("week"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("n_high")).where("n >= 10")
    return g.withColumn("rate", F.col("n_high") / F.col("n").cast("double"))


@query("rolling7", f"select day, n, case when count(n) over w >= 3 then avg(n) over w end as rolling from ({DAILY}) window w as (order by day rows between 3 preceding and 3 following)")
def rolling7(spark, d):
    return se.rolling_mean(daily(spark, d).select("day", "n"), "day", "n", 3, 3)


ITS = f"with s as (select day, n::double as y, date_diff('day', min(day) over (), day)::double as t, date_diff('day', min(day) over (), date '2024-01-16')::double as tc, day >= date '2024-01-16' as post from ({DAILY})), c as (select count(*) as n_days, max(tc) as tc, regr_intercept(y, t) filter (not post) as intercept, regr_slope(y, t) filter (not post) as pre_slope, regr_intercept(y, t) filter (post) as i2, regr_slope(y, t) filter (post) as s2 from s), k as (select n_days, tc, intercept, pre_slope, i2 + s2 * tc - (intercept + pre_slope * tc) as level_shift, s2 - pre_slope as slope_change from c)"


@query("its_ols", ITS + " select n_days, round(tc, 6) as tc, round(intercept, 6) as intercept, round(pre_slope, 6) as pre_slope, round(level_shift, 6) as level_shift, round(slope_change, 6) as slope_change from k")
def its_ols(spark, d):
    out = se.its(daily(spark, d).withColumn("y", F.col("n").cast("double")), "day", "y", "2024-01-16")
    return out.select("n_days", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


@query("its_fitted", ITS + " select day, y, round(intercept + pre_slope * t + level_shift * post::int + slope_change * greatest(t - k.tc, 0), 6) as fitted from s, k")
def its_fitted(spark, d):
    out = se.fitted(daily(spark, d).withColumn("y", F.col("n").cast("double")), "day", "y", "2024-01-16")
    return out.withColumn("fitted", F.round("fitted", 6))


@query("its_hac")
def its_hac(spark, d):
    return se.hac(spark, daily(spark, d), "day", "n", "2024-01-16")


@query("pivot_date_type", "select ts::date as day, count(*) filter (event_type = 'click') as click, count(*) filter (event_type = 'error') as error, count(*) filter (event_type = 'view') as view from events group by 1")
def pivot_date_type(spark, d):
    return events(spark, d).groupBy(F.to_date("ts").alias("day")).pivot("event_type", ["click", "error", "view"]).agg(F.count(F.lit(1))).na.fill(0)


@query("coverage", "select min(ts) as first_ts, max(ts) as last_ts, count(*) as n, count(*) filter (ts < timestamp '2024-01-16') as n_before from events")
def coverage(spark, d):
    return events(spark, d).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("ts") < F.lit("2024-01-16").cast("timestamp")).alias("n_before"))


@query("date_window", "select event_id, event_type from events where ts between timestamp '2024-01-05' and timestamp '2024-01-07'")
def date_window(spark, d):
    return events(spark, d).where(F.col("ts").between(F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-07").cast("timestamp"))).select("event_id", "event_type")


@query("resume_antijoin", "select event_id from events where event_id not in (select event_id from events where event_id % 3 = 0)")
def resume_antijoin(spark, d):
    e = events(spark, d).select("event_id")
    return co.net_new(e, e.where("event_id % 3 = 0"), "event_id")


@query("islands", "with c as (select conv_id, turn, case when role = 'user' then 'u' else 'a' end as lb from conversations), m as (select *, case when lb is distinct from lag(lb) over (partition by conv_id order by turn) or row_number() over (partition by conv_id order by turn) = 1 then 1 else 0 end as ch from c), i as (select *, sum(ch) over (partition by conv_id order by turn rows unbounded preceding)::bigint as island from m) select conv_id, island, lb, min(turn) as first, max(turn) as last, count(*) as n from i group by all")
def islands(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", "u").otherwise("a").alias("lb"))
    return se.islands(c, ["conv_id"], "turn", "lb")


@query("dedup_first", "select min(doc_id) as doc_id, text from documents group by text")
def dedup_first(spark, d):
    return co.keep_first(docs(spark, d).select("doc_id", "text"), ["text"], ["doc_id"])


@query("min_len_filter", "select doc_id from documents where length(text) > 300")
def min_len_filter(spark, d):
    return docs(spark, d).where(F.length("text") > 300).select("doc_id")


@query("ads_filter", r"select doc_id from documents where not regexp_matches(lower(text), 'ads?|sponsor|promot|video')")
def ads_filter(spark, d):
    return docs(spark, d).where(~F.lower("text").rlike("ads?|sponsor|promot|video")).select("doc_id")


@query("ads_filter_bounded", r"select doc_id from documents where not regexp_matches(lower(text), '(^|[^a-z])(ads?|sponsor|video)([^a-z]|$)')")
def ads_filter_bounded(spark, d):
    return docs(spark, d).where(~F.lower("text").rlike("(^|[^a-z])(ads?|sponsor|video)([^a-z]|$)")).select("doc_id")


@query("sample_simple", "select doc_id from documents order by md5(concat(doc_id, '|42')), doc_id limit 20")
def sample_simple(spark, d):
    return co.sample(docs(spark, d).select("doc_id"), "doc_id", 20)


@query("stratified_sample", """with s as (select lang, count(*) as s from documents group by lang), b as (select lang, s, greatest(floor(100 * s / (select sum(s) from s))::bigint, 1) as a from s), r as (select *, row_number() over (order by s desc, lang) as r, (100 - sum(a) over ())::bigint as l from b),
k as (select lang, a + (r <= l)::bigint - (r <= -l and a > 1)::bigint as alloc from r) select doc_id, lang from (select doc_id, documents.lang, alloc, row_number() over (partition by documents.lang order by md5(concat(doc_id, '|42')), doc_id) as rn from documents join k on k.lang = documents.lang) where rn <= alloc""")
def stratified_sample(spark, d):
    return co.stratified_sample(docs(spark, d).select("doc_id", "lang"), "doc_id", "lang", 100).select("doc_id", "lang")


@query("quartiles", "with o as (select n_chars as v, row_number() over (order by n_chars) - 1 as i, count(*) over () as n from documents) select max(v) filter (i = n // 4) as q1, max(v) filter (i = n * 2 // 4) as q2, max(v) filter (i = n * 3 // 4) as q3 from o")
def quartiles(spark, d):
    return co.index_quartiles(docs(spark, d), "n_chars")


@query("merge_provenance", "with u as (select doc_id, lang, 'pass_a' as p, 0 as o from documents where doc_id in (select doc_id from labels) union all select doc_id, lang, 'pass_b', 1 from documents where lang = 'en' union all select doc_id, lang, 'fresh', 2 from documents) select doc_id, arg_min(lang, o) as lang, string_agg(distinct p, '|' order by p) as retrieval_provenance from u group by doc_id")
def merge_provenance(spark, d):
    """Labelled, English and all documents: frames given by columns, that together hold every document."""
    r = docs(spark, d).select("doc_id", "lang")
    labelled = r.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    return co.merge_with_provenance([("pass_a", labelled), ("pass_b", r.where("lang = 'en'")), ("fresh", r)], "doc_id", ["lang"])


@query("provenance_group", "select case when source in ('src1', 'src2') then 'original' when contains(source, '1') then 'broad' else 'other' end as grp, count(*) as n, count(distinct lang) as langs from documents group by 1")
def provenance_group(spark, d):
    g = F.when(F.col("source").isin("src1", "src2"), "original").when(F.contains("source", F.lit("1")), "broad").otherwise("other")
    return docs(spark, d).groupBy(g.alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("lang").alias("langs"))


@query("saturation", "select count(*) as net_new, count(*) / (select count(*) from documents)::double as fraction from documents where doc_id not in (select doc_id from labels)")
def saturation(spark, d):
    all_ = docs(spark, d).select("doc_id")
    n = co.net_new(all_, table(spark, d, "labels"), "doc_id").agg(F.count(F.lit(1)).alias("net_new"))
    return n.crossJoin(all_.agg(F.count(F.lit(1)).alias("n"))).select("net_new", (F.col("net_new") / F.col("n").cast("double")).alias("fraction"))


@query("codes_left_join", "select d.doc_id, coalesce(quality, -1) as quality, coalesce(toxic, 0) as toxic from documents d left join labels using (doc_id)")
def codes_left_join(spark, d):
    return docs(spark, d).select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1).cast("int")).alias("quality"), F.coalesce("toxic", F.lit(0).cast("int")).alias("toxic"))


@query("full_outer", "select coalesce(a.source, b.source) as source, n_a, n_b from (select source, count(*) as n_a from documents where lang = 'en' group by source) a full join (select source, count(*) as n_b from documents where lang = 'de' group by source) b on a.source = b.source")
def full_outer(spark, d):
    side = lambda lang, n: docs(spark, d).where(F.col("lang") == lang).groupBy("source").agg(F.count(F.lit(1)).alias(n))
    return side("en", "n_a").join(side("de", "n_b"), "source", "full_outer")


@query("label_shift", "select a.quality as before, b.quality as after, count(*) as n from labels a join labels b on a.doc_id = b.doc_id + 1 group by all")
def label_shift(spark, d):
    lab = table(spark, d, "labels")
    return lab.select("doc_id", F.col("quality").alias("before")).join(lab.select((F.col("doc_id") + 1).alias("doc_id"), F.col("quality").alias("after")), "doc_id").groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))


@query("precision_audit", "select count(*) filter (quality = 1 and toxic = 0) as tp, count(*) filter (quality = 0) as fp, count(*) filter (quality = 1 and toxic = 1) as borderline, count(*) filter (quality = 1 and toxic = 0) / nullif(count(*) filter (quality = 1 and toxic = 0) + count(*) filter (quality = 0), 0)::double as strict, (count(*) filter (quality = 1 and toxic = 0) + 0.5::double * count(*) filter (quality = 1 and toxic = 1)) / count(*) as liberal from labels")
def precision_audit(spark, d):
    tp, fp, bo = (F.col("quality") == 1) & (F.col("toxic") == 0), F.col("quality") == 0, (F.col("quality") == 1) & (F.col("toxic") == 1)
    c = table(spark, d, "labels").agg(F.count_if(tp).alias("tp"), F.count_if(fp).alias("fp"), F.count_if(bo).alias("borderline"), F.count(F.lit(1)).alias("n"))
    return c.select("tp", "fp", "borderline", F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")).alias("strict"), ((F.col("tp") + F.lit(0.5) * F.col("borderline")) / F.col("n")).alias("liberal"))


@query("kappa", "with c as (select count(*)::double as n, avg((quality = 1 - toxic)::int) as po, avg(quality) as p1, avg(1 - toxic) as p2 from labels) select round((po - (p1 * p2 + (1 - p1) * (1 - p2))) / (1 - (p1 * p2 + (1 - p1) * (1 - p2))), 9) as kappa from c")
def kappa(spark, d):
    c = table(spark, d, "labels").agg(F.avg((F.col("quality") == 1 - F.col("toxic")).cast("int")).alias("po"), F.avg("quality").alias("a"), F.avg(1 - F.col("toxic")).alias("b"))
    pe = F.col("a") * F.col("b") + (1 - F.col("a")) * (1 - F.col("b"))
    return c.select(F.round(F.try_divide(F.col("po") - pe, 1 - pe), 9).alias("kappa"))


@query("recall_bound", "select count(*) filter (contains(lower(text), 'license')) as cued, count(*) filter (contains(lower(text), 'license') and doc_id in (select doc_id from labels)) as captured from documents")
def recall_bound(spark, d):
    lab = table(spark, d, "labels").select("doc_id", F.lit(True).alias("l"))
    j = docs(spark, d).where(F.contains(F.lower("text"), F.lit("license"))).select("doc_id").join(lab, "doc_id", "left")
    return j.agg(F.count(F.lit(1)).alias("cued"), F.count_if("l").alias("captured"))


@query("exemplars", """with p as (select vec_id, label, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings), m as (select label, i, avg(x::double) as m from p group by all),
s as (select vec_id as id, p.label, sum(x::double * m) / (sqrt(sum(x::double * x::double)) * sqrt(sum(m * m))) as similarity from p join m on p.label = m.label and p.i = m.i group by all)
select id, label, round(similarity, 6) as similarity, row_number() over (partition by label order by round(similarity, 9) desc, id) as rank from s qualify rank <= 10""")
def exemplars(spark, d):
    return co.exemplars(table(spark, d, "embeddings"), "vec_id", "embedding", "label", 10).withColumn("similarity", F.round("similarity", 6))


@query("near_dup_cosine", """with v as (select vec_id as id, embedding::double[] as v from embeddings), p as (select a.id as i, b.id as j, list_cosine_similarity(a.v, b.v) as cosine from v a join v b on a.id < b.id) select i, j, round(cosine, 6) as cosine from p where cosine > 0.5""")
def near_dup_cosine(spark, d):
    return co.near_duplicates(table(spark, d, "embeddings"), "vec_id", "embedding", 0.5).withColumn("cosine", F.round("cosine", 6))


@query("ari", """with l as (select label as a, vec_id % 4 as b from embeddings), c as (select a, b, count(*) as n from l group by all), k as (select (select sum(n * (n - 1) / 2) from c) as ij, (select sum(m * (m - 1) / 2) from (select sum(n) as m from c group by a)) as pa, (select sum(m * (m - 1) / 2) from (select sum(n) as m from c group by b)) as pb, (select count(*) from l) as n)
select round((ij - pa * pb / (n * (n - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2)), 9) as ari from k""")
def ari(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("label").alias("a"), (F.col("vec_id") % 4).alias("b"))
    return co.adjusted_rand(rows, "a", "b").select(F.round("ari", 9).alias("ari"))


@query("purity", "with c as (select label, vec_id % 3 as b, count(*) as n from embeddings group by all) select label, max(n) / sum(n)::double as purity, max(n) / sum(n)::double >= 0.5 as stable from c group by label")
def purity(spark, d):
    c = table(spark, d, "embeddings").groupBy("label", (F.col("vec_id") % 3).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("label").agg((F.max("n") / F.sum("n").cast("double")).alias("purity")).withColumn("stable", F.col("purity") >= 0.5)


@query("cluster_profile", "select label, count(*) as n, cast(mode(vec_id % 2 order by vec_id % 2) as bigint) as top_parity, count(distinct vec_id % 7) as kinds from embeddings group by label")
def cluster_profile(spark, d):
    e = table(spark, d, "embeddings")
    c = e.groupBy("label", (F.col("vec_id") % 2).alias("p")).agg(F.count(F.lit(1)).alias("m"))
    top = c.groupBy("label").agg(F.min_by("p", F.struct((-F.col("m")).alias("m"), "p")).alias("top_parity"))
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.col("vec_id") % 7).alias("kinds")).join(top, "label")


@query("confidence_distribution", "select role as type, case when contains(text, '?') then 'question' else 'statement' end as voice_label, count(*) as n, 100.0::double * count(*) / (select count(*) from conversations) as pct_of_total from conversations group by all")
def confidence_distribution(spark, d):
    c = table(spark, d, "conversations").groupBy(F.col("role").alias("type"), F.when(F.contains("text", F.lit("?")), "question").otherwise("statement").alias("voice_label")).agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n").alias("t"))
    return c.crossJoin(F.broadcast(total)).select("type", "voice_label", "n", (F.lit(100.0) * F.col("n") / F.col("t")).alias("pct_of_total"))


@query("semi_parent", "select conv_id, turn from conversations c where role <> 'user' and exists (select 1 from conversations p where p.role = 'system' and p.conv_id = c.conv_id)")
def semi_parent(spark, d):
    c = table(spark, d, "conversations")
    return c.where("role <> 'user'").join(c.where("role = 'system'").select("conv_id"), "conv_id", "left_semi").select("conv_id", "turn")


@query("composite_id", "select concat_ws('|', conv_id, turn) as row_id, length(concat_ws(' ', role, text)) as n from conversations")
def composite_id(spark, d):
    return table(spark, d, "conversations").select(F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("row_id"), F.length(F.concat_ws(" ", "role", "text")).cast("long").alias("n"))


@query("engagement", "select role, count(*) as n, count(*) filter (turn = 0) as top_level, count(*) filter (turn > 0) as nested, max(turn) as deepest from conversations group by role")
def engagement(spark, d):
    return table(spark, d, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("turn") == 0).alias("top_level"), F.count_if(F.col("turn") > 0).alias("nested"), F.max("turn").alias("deepest"))


@query("json_round_trip", "select event_id, json_extract_string(props, '$.k') as k from events")
def json_round_trip(spark, d):
    return events(spark, d).select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("best_group", "select source, avg(n_chars) as mean_chars from documents group by source having count(*) >= 20 order by mean_chars desc, source limit 1")
def best_group(spark, d):
    return docs(spark, d).groupBy("source").agg(F.avg("n_chars").alias("mean_chars"), F.count(F.lit(1)).alias("c")).where("c >= 20").orderBy(F.desc("mean_chars"), "source").limit(1).select("source", "mean_chars")


@query("kmeans")
def kmeans(spark, d):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector

    rows = table(spark, d, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("raw"))
    scaled = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(rows).transform(rows)
    return KMeans(k=8, seed=42).fit(scaled).transform(scaled).select("vec_id", F.col("prediction").alias("cluster_id"))


def _topics(spark, d):
    from pyspark import StorageLevel
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer

    from .text_queries import tk

    rows = docs(spark, d).select("doc_id", F.coalesce(tk(), F.array().cast("array<string>")).alias("tk"))
    cv = CountVectorizer(inputCol="tk", outputCol="features", vocabSize=1000).fit(rows)
    counted = cv.transform(rows)
    held = counted.persist(StorageLevel.DISK_ONLY)  # the fit reads its rows some twenty times; partitions, and so its samples, stay as they are
    try:
        return cv.vocabulary, counted, LDA(k=5, seed=42).fit(held)
    finally:
        held.unpersist()


@query("lda")
def lda(spark, d):
    vocabulary, _, model = _topics(spark, d)
    names = F.array(*[F.lit(w) for w in vocabulary])
    return model.describeTopics(10).select(F.col("topic"), F.transform("termIndices", lambda i: F.get(names, i)).alias("terms"))


@query("lda_topics")
def lda_topics(spark, d):
    """The dominant topic of each document."""
    from pyspark.ml.functions import vector_to_array

    _, counted, model = _topics(spark, d)
    share = vector_to_array("topicDistribution")
    return model.transform(counted).select("doc_id", (F.array_position(share, F.array_max(share)) - 1).alias("topic"), F.array_max(share).alias("share"))


FOREST = ("len", "words", "signs")


def _forest(spark, d):
    """100 trees on a seeded four fifths of the labelled documents, and the rest."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = docs(spark, d).withColumn("text", F.coalesce("text", F.lit(""))).select("doc_id", F.length("text").alias("len"), F.size(F.split("text", " ")).alias("words"), F.regexp_count("text", F.lit("[#$%&*]{2}")).alias("signs")).join(table(spark, d, "labels"), "doc_id")
    data = VectorAssembler(inputCols=list(FOREST), outputCol="features").transform(rows)
    held = F.pmod(F.xxhash64("doc_id", F.lit(42)), F.lit(5)) == 0
    return RandomForestClassifier(labelCol="quality", numTrees=100, seed=42).fit(data.where(~held)), data.where(held)


@query("random_forest")
def random_forest(spark, d):
    """Predictions for the rows that the trees haven't seen."""
    from pyspark.ml.functions import vector_to_array

    model, rest = _forest(spark, d)
    return model.transform(rest).select("doc_id", "quality", vector_to_array("probability")[1].alias("p_quality"), F.col("prediction").cast("int").alias("predicted"))


@query("forest_importances")
def forest_importances(spark, d):
    model, _ = _forest(spark, d)
    return spark.createDataFrame(list(zip(FOREST, model.featureImportances.toArray().tolist(), strict=True)), "feature string, importance double")


CUES = ("license", "under the", "rest", "http")


@query("cue_tallies", f"with t as (select doc_id, lower(coalesce(text, '')) as t, doc_id in (select doc_id from labels) as captured from documents), c as (select unnest(list_filter({list(CUES)!r}, lambda c: contains(t, c))) as cue, captured from t) select cue, count(*) as cued, count(*) filter (captured) as captured, count(*) filter (captured) / count(*)::double as recall from c group by cue")
def cue_tallies(spark, d):
    """Per cue the documents that hold it and the share of those that are labelled."""
    low = F.lower(F.coalesce("text", F.lit("")))
    held = docs(spark, d).select("doc_id", F.explode(F.filter(F.array(*[F.lit(c) for c in CUES]), lambda c: F.contains(low, c))).alias("cue"))
    marked = held.join(table(spark, d, "labels").select("doc_id", F.lit(True).alias("l")).distinct(), "doc_id", "left")
    return marked.groupBy("cue").agg(F.count(F.lit(1)).alias("cued"), F.count_if("l").alias("captured")).withColumn("recall", F.col("captured") / F.col("cued").cast("double"))


@query("coded_summary", "select lang, count(*) as n, count(quality) as coded, count(*) filter (quality = 1) as good, count(*) filter (quality = 1 and toxic = 0) as clean, count(*) filter (quality = 1 and toxic = 0) / nullif(count(*) filter (quality = 1), 0)::double as clean_share from documents left join labels using (doc_id) group by lang")
def coded_summary(spark, d):
    """Codes applied by key, and conditional counts of them."""
    j = docs(spark, d).select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    c = j.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("coded"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("clean"))
    return c.withColumn("clean_share", F.try_divide(F.col("clean").cast("double"), F.col("good")))


@query("proportional_pools", """with a as (select doc_id, case when n_chars > 1000 then 'long' else 'short' end as pool, md5(concat(doc_id, '|42')) as o from documents), s as (select pool, count(*) as c from a group by 1),
k as (select pool, case when pool = 'long' then round(60.0 * c / (select sum(c) from s))::bigint else 60 - (select coalesce(max(round(60.0 * c / (select sum(c) from s)))::bigint, 0) from s where pool = 'long') end as take from s),
r as (select doc_id, pool, row_number() over (partition by pool order by o, doc_id) as rn from a) select doc_id, r.pool from r join k using (pool) where rn <= take""")
def proportional_pools(spark, d):
    """A budget of 60 rows over two pools in proportion to their sizes; what rounding leaves goes to the second."""
    rows = docs(spark, d).select("doc_id", F.when(F.col("n_chars") > 1000, "long").otherwise("short").alias("pool"))
    return co.two_pools(rows, "doc_id", "pool", "long", "short", 60)


@query("kmeans_means")
def kmeans_means(spark, d):
    """Four clusters of the vectors with their sizes and the mean of each value."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = table(spark, d, "embeddings").select("vec_id", "embedding", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    found = KMeans(k=4, seed=42).fit(rows).transform(rows)
    each = found.select(F.col("prediction").alias("cluster_id"), F.posexplode("embedding").alias("place", "x"))
    return each.groupBy("cluster_id", "place").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.count(F.lit(1)).alias("n"))
