"""Row classifiers, spans, quotes and density clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import text as tx
from lexloom.operators import clustering, spans

from .registry import query, table

VOICE = (("(?i)[\"“][^\"”]{10,}[\"”]", "direct_quote", "high", "quoted"), ("(?i)\\b(it|he|she) (is|was)\\b", "paraphrase", "medium", "third person"), ("(?i)\\b(the|that)\\b", "weak", "low", "weak cue"))


@query("row_voice", "with c as (select conv_id, turn, case when regexp_matches(text, '(?i)[\"“][^\"”]{10,}[\"”]') then 0 when regexp_matches(text, '(?i)\\b(it|he|she) (is|was)\\b') then 1 when regexp_matches(text, '(?i)\\b(the|that)\\b') then 2 else 3 end as k from conversations) select conv_id, turn, ['direct_quote', 'paraphrase', 'weak', 'ambiguous'][k + 1] as voice_label, ['high', 'medium', 'low', 'low'][k + 1] as voice_confidence from c")
def row_voice(spark, d):
    c = table(spark, d, "conversations").withColumn("m", tx.first_match(F.col("text"), VOICE))
    return c.select("conv_id", "turn", F.coalesce("m.label", F.lit("ambiguous")).alias("voice_label"), F.coalesce("m.confidence", F.lit("low")).alias("voice_confidence"))


@query("structural_cues", "select conv_id, turn, array_to_string(list_filter([case when contains(text, '>') then 'block' end, case when contains(text, '\"') then 'quote' end, case when regexp_matches(text, '(?m)^[A-Za-z]+:') then 'speaker' end, case when contains(text, '?') then 'question' end, case when length(text) > 500 then 'long' end], lambda x: x is not null), '|') as cues from conversations")
def structural_cues(spark, d):
    t = F.col("text")
    cues = F.array_compact(F.array(F.when(F.contains(t, F.lit(">")), "block"), F.when(F.contains(t, F.lit('"')), "quote"), F.when(t.rlike("(?m)^[A-Za-z]+:"), "speaker"), F.when(F.contains(t, F.lit("?")), "question"), F.when(F.length(t) > 500, "long")))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(cues, "|").alias("cues"))


@query("transcript_structure", "select conv_id, turn, len(regexp_extract_all(text, '(?m)^[A-Z][a-z]+:')) >= 2 as v1, len(list_distinct(regexp_extract_all(text, '(?m)^[A-Z][a-z]+:'))) >= 2 as v2 from conversations")
def transcript_structure(spark, d):
    m = F.regexp_extract_all("text", F.lit("(?m)^[A-Z][a-z]+:"), F.lit(0))
    return table(spark, d, "conversations").select("conv_id", "turn", (F.size(m) >= 2).alias("v1"), (F.size(F.array_distinct(m)) >= 2).alias("v2"))


def _turns(spark, d):
    return table(spark, d, "conversations").select(F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("row_id"), "text")


@query("span_table")
def span_table(spark, d):
    return spans.segment(_turns(spark, d), "row_id", "text")


@query("span_metrics")
def span_metrics(spark, d):
    return spans.span_metrics(spans.segment(_turns(spark, d), "row_id", "text"))


@query("span_cover", "select concat_ws('|', conv_id, turn) as row_id, length(text) as chars from conversations where length(text) > 0")
def span_cover(spark, d):
    return spans.segment(_turns(spark, d), "row_id", "text").groupBy("row_id").agg(F.sum((F.col("span_end") - F.col("span_start")).cast("long")).alias("chars"))


@query("tier_assignment")
def tier_assignment(spark, d):
    return spans.tiers(spans.segment(_turns(spark, d), "row_id", "text"))


@query("quote_extraction")
def quote_extraction(spark, d):
    return spans.quotes(_turns(spark, d), "row_id", "text")


@query("density_clusters")
def density_clusters(spark, d):
    return clustering.cluster_groups(table(spark, d, "embeddings"), "vec_id", "embedding", "label", (5, 10))


@query("validation_sample")
def validation_sample(spark, d):
    return spans.validation_sample(spans.segment(_turns(spark, d), "row_id", "text"), 10)


@query("extractor_yield")
def extractor_yield(spark, d):
    return spans.extractor_yield(spans.quotes(_turns(spark, d), "row_id", "text"))
