"""Association measures: windowed collocation, document-level PMI and its relatives, TF-IDF."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as tx
from lexloom.session import stored

from .frequency import edge_stream, token_table


def safe_log2(x: Column) -> Column:
    return F.when(x > 0, F.log2(x))


def pmi(both: Column, a: Column, b: Column, n: Column) -> Column:
    """Null where a margin or the joint count is zero."""
    return safe_log2(F.try_divide(both.cast("double") * n, a.cast("double") * b))


def npmi(both: Column, a: Column, b: Column, n: Column) -> Column:
    return F.try_divide(pmi(both, a, b, n), -safe_log2(F.try_divide(both.cast("double"), n)))


def log_dice(both: Column, a: Column, b: Column) -> Column:
    return F.lit(14.0) + safe_log2(F.try_divide(both.cast("double") * 2, a + b))


def lift(both: Column, a: Column, b: Column, n: Column) -> Column:
    return F.try_divide(both.cast("double") * n, a.cast("double") * b)


def flat_collocation(rows: DataFrame, id_col: str, tk: Column, anchors: Sequence[str], w: int, floor: int, min_len: int = 3, stops: Sequence[str] = ()) -> DataFrame:
    """Collocates within ``w`` places of an anchor in the stream of all documents; each once per occurrence of the anchor.

    Texts are tokenized once. Windows are slices of their document; only places beyond its ends meet the tokens near
    the ends of others, by equal position.
    """
    held = token_table(rows, id_col, tk)
    counts = held.select(F.explode("tk").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("freq"))
    total = counts.agg(F.sum("freq").alias("total"))
    at = tx.let(F.col("tk"), lambda t: F.filter(F.transform(t, lambda x, i: F.when(x.isin(*anchors), F.struct(x.alias("anchor"), i.alias("i"), tx.left_of(t, i + 1, w).alias("left"), tx.right_of(t, i + 1, 1, w).alias("right")))), lambda h: h.isNotNull()))
    hits = held.where(F.arrays_overlap("tk", tx.words(anchors))).select("start", "n", F.explode(at).alias("h")).select("start", "n", F.col("h.anchor").alias("anchor"), (F.col("start") + F.col("h.i")).alias("at"), F.concat("h.left", "h.right").alias("near"))
    inside = hits.select("anchor", "at", F.explode("near").alias("collocate"))
    places = hits.where((F.col("at") - w < F.col("start")) | (F.col("at") + w >= F.col("start") + F.col("n"))).select("start", "n", "anchor", "at", F.explode(F.expr(f"sequence(at - {w}, at + {w})")).alias("gpos"))
    outside = places.where((F.col("gpos") < F.col("start")) | (F.col("gpos") >= F.col("start") + F.col("n"))).join(edge_stream(held, w).withColumnRenamed("token", "collocate"), "gpos").select("anchor", "at", "collocate")
    near = inside.unionByName(outside).where((F.length("collocate") >= min_len) & (F.col("collocate") != F.col("anchor")))
    if stops:
        near = near.where(~F.col("collocate").isin(*stops))
    co = near.distinct().groupBy("anchor", "collocate").agg(F.count(F.lit(1)).alias("co_occurrences")).where(F.col("co_occurrences") >= floor)
    few = F.broadcast(counts.where(F.col("token").isin(*anchors)).select(F.col("token").alias("anchor"), F.col("freq").alias("anchor_freq")))  # one row per anchor
    out = co.join(few, "anchor").join(counts.select(F.col("token").alias("collocate"), F.col("freq").alias("collocate_freq")), "collocate").crossJoin(F.broadcast(total))
    return out.select("anchor", "collocate", "co_occurrences", "anchor_freq", "collocate_freq", pmi(F.col("co_occurrences"), F.col("anchor_freq"), F.col("collocate_freq"), F.col("total")).alias("pmi"))


def bounded_collocation(rows: DataFrame, tk: Column, phrase: Sequence[str], w: int, floor: int) -> DataFrame:
    """Collocates of a phrase inside its document, every occurrence counted. Texts are tokenized once, and the tokens written to the shared folder."""
    rows = stored(rows.select(tk.alias("tk")), "tokens")
    hits = rows.select(tx.around_phrase(F.col("tk"), phrase, w).alias("hits"))
    anchors = hits.agg(F.sum(F.size("hits").cast("long")).alias("anchor_freq"))
    near = hits.select(F.explode_outer("hits").alias("h")).where("h is not null").select(F.explode(F.concat("h.left", "h.right")).alias("collocate"))
    co = near.where(~F.col("collocate").isin(*phrase)).groupBy("collocate").agg(F.count(F.lit(1)).alias("co_occurrences")).where(F.col("co_occurrences") >= floor)
    counts = rows.select(F.explode("tk").alias("collocate")).groupBy("collocate").agg(F.count(F.lit(1)).alias("freq"))
    total = counts.agg(F.sum("freq").alias("total"))
    out = co.join(counts, "collocate").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(anchors))  # one row each
    return out.select("collocate", "co_occurrences", pmi(F.col("co_occurrences"), F.col("anchor_freq"), F.col("freq"), F.col("total")).alias("pmi"))


def anchored_pairs(sentences: DataFrame, tk: Column, anchors: Sequence[str], w: int, keep: Callable[[Column], Column], floor: int) -> DataFrame:
    """Unordered pairs of the kept terms within ``w`` places of each anchor of a sentence of any length; repeated pairs count, the anchor itself doesn't.

    A window holds at most ``2 * w`` terms, so its pairs are bounded whatever the sentence's length.
    """
    at = tx.let(tk, lambda t: F.filter(F.transform(t, lambda x, i: F.when(x.isin(*anchors), F.filter(F.concat(tx.left_of(t, i + 1, w), tx.right_of(t, i + 1, 1, w)), keep))), lambda c: c.isNotNull()))
    windows = sentences.select(F.explode(at).alias("c"))
    pairs = F.flatten(F.transform("c", lambda a, i: F.transform(F.slice(F.col("c"), i + 2, F.size("c")), lambda b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))))
    each = windows.select(F.explode(pairs).alias("p"))
    return each.groupBy(F.col("p.a").alias("term_1"), F.col("p.b").alias("term_2")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= floor)


def flag_association(flags: DataFrame, lexicons: Sequence[str], target: str) -> DataFrame:
    """Counts and measures of each lexicon flag against a target flag, over the rows of ``flags``."""
    long = flags.select(F.col(target).alias("t"), F.explode(F.array(*[F.struct(F.lit(x).alias("lexicon"), F.col(x).alias("l")) for x in lexicons])).alias("s"))
    c = long.groupBy(F.col("s.lexicon").alias("lexicon")).agg(F.count(F.lit(1)).alias("n"), F.count_if("s.l").alias("n_lexicon"), F.count_if("t").alias("n_target"), F.count_if(F.col("s.l") & F.col("t")).alias("n_both"))
    a = (F.col("n_both"), F.col("n_lexicon"), F.col("n_target"), F.col("n"))
    return c.withColumns({"p_target": F.try_divide(a[0], a[1]), "p_lexicon": F.try_divide(a[0], a[2]), "pmi": pmi(*a), "npmi": npmi(*a), "log_dice": log_dice(*a[:3]), "lift": lift(*a)})


def tfidf_top(rows: DataFrame, id_col: str, segment: str, tk: Column, features: int, k: int) -> DataFrame:
    """Top terms per segment: the most frequent terms as features, smooth idf, unit vectors, summed over documents."""
    from .corpus import small_side
    from .frequency import top

    terms = rows.select(F.col(id_col).alias("doc"), F.col(segment).alias("segment"), F.explode(tk).alias("gram"))
    counts = terms.groupBy("segment", "gram").agg(F.count(F.lit(1)).alias("n"))
    vocab = stored(top(counts, features, ["segment"]).select("segment", "gram", F.col("rank").cast("int").alias("at")), "features")
    # only the features' tokens are dealt by document; a document is one row of places in the vocabulary and counts
    tf = terms.join(small_side(vocab), ["segment", "gram"]).groupBy("segment", "doc", "at").agg(F.count(F.lit(1)).alias("tf"))
    docs = stored(tf.groupBy("segment", "doc").agg(F.collect_list(F.struct("at", "tf")).alias("v")).select("segment", "v"), "tf")
    n = rows.groupBy(F.col(segment).alias("segment")).agg(F.count(F.lit(1)).alias("docs"))
    df = docs.select("segment", F.explode("v.at").alias("at")).groupBy("segment", "at").agg(F.count(F.lit(1)).alias("df")).join(n, "segment")
    idf = df.select("segment", "at", (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    held = idf.groupBy("segment").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "idf"))), lambda s: s["idf"]).alias("idf"))  # places are gapless from 1
    weighted = docs.join(small_side(held), "segment").select("segment", F.transform("v", lambda e: F.struct(e["at"].alias("at"), (e["tf"] * F.element_at("idf", e["at"])).alias("x"))).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e["x"] * e["x"]))
    unit = weighted.withColumn("norm", norm).select("segment", "norm", F.explode("v").alias("e"))
    score = unit.groupBy("segment", F.col("e.at").alias("at")).agg(F.sum(F.col("e.x") / F.col("norm")).alias("n")).join(small_side(vocab), ["segment", "at"]).select("segment", "gram", "n")
    return top(score, k, ["segment"]).withColumnRenamed("n", "score")
