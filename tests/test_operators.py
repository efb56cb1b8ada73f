"""Operators of the engine against plain Python on small fixtures, and invariants."""

import datetime
import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as tx
from lexloom.operators import association as ac
from lexloom.operators import clustering, corpus, graph, grams, series, spans
from lexloom.operators import frequency as fq
from lexloom.operators.components import connected_components
from lexloom.plans import catalog
from lexloom.sources import files, listings
from lexloom.streaming import incremental


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def one(df):
    return df.first()[0]


def test_tokenizers(spark):
    df = texts(spark, "It’s Über-cool: abc1 abc_d don't école x", "", None)
    got = [r[0] for r in df.select(tx.tokens(F.col("text"), 2)).collect()]
    assert got == [["it", "cool", "don"], [], None]
    assert one(df.select(tx.tokens_plain(F.col("text")))) == ["it's", "ber-cool", "abc1", "abc", "d", "don't", "cole", "x"]
    assert one(df.select(tx.strip_urls(F.lit("a http://x.y/z b www.q.com [l](u) c")))).split() == ["a", "b", "c"]
    assert one(df.select(tx.unescape_basic(F.lit("a &lt;b&gt; &amp;amp; \\_")))) == "a <b> &amp; _"


def test_combination_skipgrams_equal_enumeration(spark):
    for skip in (1, 2):
        for n in range(8):
            tk = [f"t{i}" for i in range(n)]
            want = {}
            for i in range(n):
                for a, b in itertools.combinations(range(i, min(i + 2 + 2 * skip, n)), 2):
                    want[f"t{a} t{b}"] = want.get(f"t{a} t{b}", 0) + 1
            df = spark.createDataFrame([(" ".join(tk),)], "text string").select(tx.tokens_space(F.col("text")).alias("tk"))
            got = {r["gram"]: r["n"] for r in fq.combination_skipgrams(df, F.col("tk"), skip).collect()}
            # windows that begin at each place count a pair again where they hold it
            again = {}
            for i in range(n):
                for a, b in itertools.combinations(range(i, min(i + 2 + 2 * skip, n)), 2):
                    again[f"t{a} t{b}"] = again.get(f"t{a} t{b}", 0) + 1
            assert got == again == want


def test_flat_and_bounded_collocation_differ_at_a_boundary(spark):
    df = texts(spark, "alpha rest", "beta gamma rest delta")
    flat = {(r["collocate"], r["co_occurrences"]) for r in ac.flat_collocation(df, "doc_id", tx.tokens(F.col("text")), ["rest"], 2, 1).collect()}
    assert flat == {("alpha", 1), ("beta", 2), ("gamma", 2), ("delta", 1)}
    bounded = {(r["collocate"], r["co_occurrences"]) for r in ac.bounded_collocation(df, tx.tokens(F.col("text")), ["rest"], 2, 1).collect()}
    assert bounded == {("alpha", 1), ("beta", 1), ("gamma", 1), ("delta", 1)}


def test_anchored_pairs_of_a_long_sentence(spark):
    rng = random.Random(3)
    tk = [rng.choice([f"w{chr(97 + i)}x" for i in range(20)] + ["rest", "rest", "the"]) for _ in range(400)]
    want = Counter()
    for i, t in enumerate(tk):
        if t == "rest":
            near = [x for x in tk[max(0, i - 10) : i] + tk[i + 1 : i + 11] if x != "the"]
            want.update(tuple(sorted(p)) for p in itertools.combinations(near, 2))
    df = texts(spark, " ".join(tk), "", None)
    got = {(r["term_1"], r["term_2"]): r["n"] for r in ac.anchored_pairs(df, tx.tokens_space(F.col("text")), ["rest"], 10, lambda x: x != "the", 2).collect()}
    assert got == {p: n for p, n in want.items() if n >= 2} and got


def test_token_table_and_streams(spark):
    rng = random.Random(8)
    docs = [" ".join(rng.choice(("aaa", "bbb", "ccc", "rest")) for _ in range(rng.choice((0, 1, 1, 2, 3, 9, 30)))) for _ in range(60)] + [None]
    df = spark.createDataFrame([(f"k{i:03}", t) for i, t in enumerate(docs)], "doc_id string, text string").repartition(7)
    held = fq.token_table(df, "doc_id", tx.tokens(F.col("text")))
    stream = [w for t in docs for w in (t or "").split()]
    assert [w for r in sorted(held.collect(), key=lambda r: (r["start"], r["n"])) for w in r["tk"]] == stream
    for r in held.collect():
        assert stream[r["start"] : r["start"] + r["n"]] == r["tk"]
    for n in (2, 3, 4):
        got = {r["gram"]: r["n"] for r in fq.stream_ngrams(held, n).collect()}
        assert got == Counter(" ".join(stream[i : i + n]) for i in range(len(stream) - n + 1))
    want = Counter()
    for i, t in enumerate(stream):
        if t == "rest":
            want.update({x for x in stream[max(0, i - 4) : i] + stream[i + 1 : i + 5] if x != "rest"})
    got = {r["collocate"]: r["co_occurrences"] for r in ac.flat_collocation(df, "doc_id", tx.tokens(F.col("text")), ["rest"], 4, 1).collect()}
    assert got == want


def test_seed_terms(spark):
    df = texts(spark, "Take a REST now", "Licence and the(x", "under THE roof the (", None)
    rows = {r["doc_id"]: r for r in df.select("doc_id", *(tx.seed_match(F.coalesce("text", F.lit("")), t, a, tx.valid_pattern(spark, t)).alias(tx.seed_column(t)) for t, a in (("take a rest", "exact match"), ("licen[sc]e", "regex"), ("Under the", "co_occurrence"), ("the (", "regex")))).collect()}
    assert [list(rows[i])[1:] for i in range(4)] == [[True, False, False, False], [False, True, False, False], [False, False, True, True], [False] * 4]
    assert tx.seed_column("Go to -- bed!") == "r2_go_to_bed"
    assert not tx.valid_pattern(spark, "a(") and tx.valid_pattern(spark, "a(b)?")


def test_communities(spark):
    edges = spark.createDataFrame([("a", "b", 3), ("a", "c", 2), ("b", "c", 1), ("c", "x", 9), ("x", "y", 4)], "src string, dst string, weight long")
    members = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 1), ("x", 2), ("y", 2)], "term string, community int")
    tops = graph.central_terms(members, edges, 3)
    assert sorted((r["community"], r["term"], round(r["centrality"], 6), r["rank"]) for r in tops.collect()) == [(1, "a", 0.666667, 1), (1, "b", 0.666667, 2), (1, "c", 0.666667, 3), (2, "x", 1.0, 1), (2, "y", 1.0, 2)]
    rows = spark.createDataFrame([(1, "a b x"), (2, "c c"), (3, "d"), (4, None)], "id long, text string")
    got = sorted(tuple(r) for r in graph.mentions(rows, "id", tx.tokens_space(F.col("text")), tops).collect())
    assert got == [(1, 1, None), (1, 2, None), (2, 1, None)]


def test_kwic_edges(spark):
    got = [tuple(r)[1:] for r in fq.kwic(texts(spark, "rest a rest b", "x"), ["doc_id"], tx.tokens_plain(F.col("text")), ["rest"], 2).orderBy("doc_id", "pos").collect()]
    assert got == [(0, "", "rest", "a rest"), (2, "rest a", "rest", "b")]


def test_association_formulas(spark):
    df = spark.createDataFrame([(True, True)] * 3 + [(True, False)] * 2 + [(False, True)] * 1 + [(False, False)] * 4, "l boolean, t boolean")
    r = ac.flag_association(df, ["l"], "t").first()
    assert math.isclose(r["pmi"], math.log2(3 * 10 / (5 * 4)))
    assert math.isclose(r["npmi"], r["pmi"] / -math.log2(0.3))
    assert math.isclose(r["log_dice"], 14 + math.log2(6 / 9))
    assert math.isclose(r["lift"], 1.5)


def test_graph(spark):
    df = texts(spark, *["aaa bbb ccc"] * 3, *["ddd eee"] * 2, "fff")
    vocab = graph.vocabulary(df, tx.tokens(F.col("text")), 10)
    edges = graph.cooccurrence(df, tx.tokens(F.col("text")), vocab, 2)
    assert {tuple(r) for r in edges.collect()} == {("aaa", "bbb", 3), ("aaa", "ccc", 3), ("bbb", "ccc", 3), ("ddd", "eee", 2)}
    s = graph.graph_stats(vocab, edges).first()
    assert (s["nodes"], s["edges"]) == (5, 4) and 0 <= s["density"] <= 1
    assert graph.graph_stats(vocab, edges, True).first()["nodes"] == 6
    parts = {r["term"]: r["community"] for r in graph.louvain(edges, [1.0]).collect()}
    assert len(parts) == 5 and parts["aaa"] == parts["bbb"] == parts["ccc"] != parts["ddd"] == parts["eee"]
    with pytest.raises(ValueError):
        graph.louvain(edges, [1.0], max_edges=2).collect()


def test_graph_queries_hold_terms_beyond_the_first_150(spark, tmp_path):
    names = ["qz" + chr(97 + i // 26) + chr(97 + i % 26) for i in range(200)]
    texts(spark, *[" ".join(names)] * 5).write.parquet(f"{tmp_path}/documents.parquet")
    edges = {tuple(r) for r in catalog.QUERIES["cooc_edges"](spark, str(tmp_path)).collect()}
    assert edges == {(a, b, 5) for a, b in itertools.combinations(sorted(names), 2)}
    assert {r["term"] for r in catalog.QUERIES["louvain"](spark, str(tmp_path)).collect()} == set(names)
    assert catalog.QUERIES["adjacency"](spark, str(tmp_path)).count() == 200 * 200


@pytest.mark.parametrize("few", [0, 300_000])
def test_components(spark, few):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 380)] + [(500, x) for x in range(501, 560)] + [(900, 900)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame([*edges, (None, 3)], "a long, b long"), few_edges=few).collect()}
    assert got == {x: find(x) for e in edges for x in e}
    assert connected_components(spark.createDataFrame([], "a long, b long"), few_edges=few).collect() == []


def test_interrupted_series(spark):
    d0 = datetime.date(2024, 1, 1)
    rng = random.Random(2)
    rows = [(d0 + datetime.timedelta(days=i), 5 + 0.3 * i + (4 + 0.5 * (i - 15) if i >= 15 else 0) + rng.random() * 0.01) for i in range(30) if i not in (3, 20)]
    df = spark.createDataFrame(rows, "day date, y double")
    r = series.its(df, "day", "y", "2024-01-16").first()
    assert abs(r["pre_slope"] - 0.3) < 0.01 and abs(r["level_shift"] - 4) < 0.05 and abs(r["slope_change"] - 0.5) < 0.01
    h = {x["parameter"]: x for x in series.hac(spark, df, "day", "y", "2024-01-16").collect()}
    assert math.isclose(h["level_shift"]["estimate"], r["level_shift"], rel_tol=1e-6) and h["level_shift"]["p_value"] < 1e-6
    assert series.hac(spark, df.limit(9), "day", "y", "2024-01-05").count() == 0
    assert series.its(df.limit(9), "day", "y", "2024-02-16").first()["level_shift"] is None
    assert abs(series.t_two_sided(2.0, 10) - 0.07338803) < 1e-6


def test_adjusted_rand(spark):
    def ari(a, b):
        return one(corpus.adjusted_rand(spark.createDataFrame(list(zip(a, b)), "a int, b int"), "a", "b"))

    assert ari([0, 0, 1, 1], [0, 0, 1, 1]) == 1.0
    assert ari([0, 0, 1, 1], [5, 5, 3, 3]) == 1.0
    assert ari([-1] * 4, [-1] * 4) == 1.0
    assert math.isclose(ari([0, 0, 1, 1], [0, 1, 0, 1]), -0.5)


def test_spans_cover_without_overlap():
    rng = random.Random(4)
    parts = ["> quoted line\n", "Assistant: hi there\n", "It said you should rest. ", "It never said that. ", 'He wrote "a longer thing here" ok. ', "I think so. ", "plain words ", "“curly”", "\n", ""]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 8)))
        got = spans.merge_adjacent(spans.resolve(spans.find_spans(text), len(text)))
        at = 0
        for a, b, *_ in got:
            assert a == at < b
            at = b
        assert at == len(text)
        assert all(x[2:4] != y[2:4] for x, y in zip(got, got[1:]))
    assert spans.find_spans("It never said that.") == []
    assert [s[2] for s in spans.find_spans("> a")] == ["model_quoted"]


def test_quotes(spark):
    q, n, m = spans.extract_quotes('> One thing\nBot: two things\nshe said: "three things here" and then\n"one  thing"')
    assert m == ["blockquote", "speaker", "attribution"] and q.split("\n") == ["One thing", "two things", "three things here"]
    assert "three" not in n and "and then" in n
    assert spans.quotes(texts(spark, None, ""), "doc_id", "text").collect()[0]["quoted"] == ""
    assert spans.segment(texts(spark, None, ""), "doc_id", "text").collect() == []
    assert spans.unescape("a &amp;&#8217; \\*") == "a &’ *"
    assert spans.parse_response("Label: USER (high)", ["user", "model"], ("x", "low")) == ("user", "high")
    assert spans.parse_response("??", ["user"], ("x", "low")) == ("x", "low")


def test_density_clusters_find_blobs_and_noise(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate((rng.normal(0, 0.05, (30, 3)), rng.normal(3, 0.05, (30, 3)), [[10, 10, 10], [-9, 4, 2]]))
    got = clustering.density_clusters(x, 5)
    assert len(set(got[:30])) == 1 and len(set(got[30:60])) == 1 and got[0] != got[30] and set(got[60:]) == {-1}
    assert set(clustering.density_clusters(x[:3], 5)) == {-1}
    rows = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "id long, v array<double>, g int")
    assert clustering.cluster_groups(rows, "id", "v", "g", (5,)).where("cluster_id = -1").count() == 2
    with pytest.raises(ValueError):
        clustering.cluster_groups(rows, "id", "v", "g", (5,), most=10)


def test_density_clusters_of_a_group_of_more_than_5000_rows(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate((rng.uniform(0, 1, (2600, 2)), rng.uniform(50, 51, (2600, 2)), [[500, 500]]))
    rows = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "id long, v array<double>, g int")
    got = {r["id"]: r["cluster_id"] for r in clustering.cluster_groups(rows, "id", "v", "g", (1000,)).collect()}
    assert len(got) == 5201 and got[5200] == -1
    assert len({got[i] for i in range(2600)}) == 1 and len({got[i] for i in range(2600, 5200)}) == 1 and got[0] != got[2600]


def test_merge_and_samples(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k long, body string")
    b = spark.createDataFrame([(2, "late"), (3, "z")], "k long, body string")
    got = {r["k"]: (r["body"], r["retrieval_provenance"]) for r in corpus.merge_with_provenance([("one", a), ("fresh", b)], "k", ["body"]).collect()}
    assert got == {1: ("x", "one"), 2: (None, "fresh|one"), 3: ("z", "fresh")}
    rows = spark.range(1000).select(F.col("id"), F.when(F.col("id") < 900, "a").when(F.col("id") < 998, "b").otherwise("c").alias("s"))
    got = corpus.stratified_sample(rows, "id", "s", 40)
    counts = {r["s"]: r["count"] for r in got.groupBy("s").count().collect()}
    assert sum(counts.values()) == 40 and counts["c"] == 1 and counts["a"] >= 35
    assert corpus.sample(rows, "id", 7).count() == 7


def test_provenance_holds_every_document(spark, tmp_path):
    spark.createDataFrame([(1, "en"), (2, "de"), (7, "fr"), (11, "en")], "doc_id long, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2,), (11,)], "doc_id long").write.parquet(f"{tmp_path}/labels.parquet")
    assert sorted(r["doc_id"] for r in catalog.QUERIES["merge_provenance"](spark, str(tmp_path)).collect()) == [1, 2, 7, 11]


def test_near_duplicate_vectors_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 4))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if u[i] @ u[j] > 0.8}
    assert {(r["i"], r["j"]) for r in corpus.near_duplicates(rows, "id", "v", 0.8, block_rows=11).collect()} == want
    assert {r["id"] for r in corpus.drop_near_duplicates(rows, "id", "v", 0.8).collect()} == set(range(40)) - {j for _, j in want}
    more = rows.unionByName(spark.createDataFrame([(90, None), (None, [1.0, 0.0, 0.0, 0.0]), (91, [0.0] * 4)], rows.schema))
    assert {(r["i"], r["j"]) for r in corpus.near_duplicates(more, "id", "v", 0.8).collect()} == want
    assert corpus.near_duplicates(rows.limit(0), "id", "v", 0.8).collect() == []


def test_files(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('﻿post_id,body\n1,"two\nlines ""q"""\n2,x\n', encoding="utf-8")
    df = files.read_csv(spark, str(p))
    assert df.columns == ["post_id", "body"] and df.count() == 2 and df.first()["body"] == 'two\nlines "q"'
    assert files.first_existing(spark, [str(tmp_path / "no.csv"), str(p)]) == str(p)
    with pytest.raises(FileNotFoundError):
        files.first_existing(spark, [str(tmp_path / "no.csv")])
    j = tmp_path / "log.jsonl"
    j.write_text('{"row_id": "a", "n": 1, "v": "old"}\nnot json\n{"row_id": "a", "n": 2, "v": "new"}\n{"row_id": "b", "n": 1, "v": "x"}\n')
    assert {r["row_id"]: r["v"] for r in files.read_jsonl_last(spark, str(j), "row_id string, n int, v string", "row_id", "n").collect()} == {"a": "new", "b": "x"}
    nodes = spark.createDataFrame([("a&b", 2), ("c", 1)], "term string, freq long")
    edges = spark.createDataFrame([("a&b", "c", 5)], "src string, dst string, weight long")
    files.write_gexf(nodes, edges, str(tmp_path / "g.gexf"))
    n, e = files.read_gexf(spark, str(tmp_path / "g.gexf"))
    assert sorted(map(tuple, n.collect())) == [("a&b", 2), ("c", 1)] and [tuple(r) for r in e.collect()] == [("a&b", "c", 5)]
    m = {r["term"]: (r["a&b"], r["c"]) for r in files.matrix(edges, ["a&b", "c"]).collect()}
    assert m == {"a&b": (0, 5), "c": (5, 0)}
    files.write_partitioned(edges, str(tmp_path / "parts"), ["dst"])
    files.write_top(nodes, str(tmp_path / "top"), [F.desc("freq")], 1)
    files.write_jsonl(nodes, str(tmp_path / "j"))
    files.write_jsonl(nodes, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4 and spark.read.parquet(str(tmp_path / "parts")).count() == 1


def test_listing_pages_and_retries(spark):
    store = [{"id": f"p{i}", "title": f"t{i}", "selftext": None, "created_utc": 1000 + i, "subreddit": "s"} for i in range(25)]
    failed = []

    def fetch(listing, before, page):
        if len(failed) < 2:
            failed.append(1)
            raise listings.Unavailable
        return sorted((r for r in store if before is None or r["created_utc"] < before), key=lambda r: -r["created_utc"])[:page]

    waits = []
    got = list(listings.pages(fetch, "new", 1003, 1020, page=4, sleep=waits.append))
    assert [r["id"] for r in got] == [f"p{i}" for i in range(20, 2, -1)] and len(waits) == 2
    with pytest.raises(listings.Unavailable):
        listings.with_retries(lambda: (_ for _ in ()).throw(listings.Unavailable()), tries=2, sleep=lambda s: None)

    def steady(listing, before, page):
        return [{"id": f"{i}", "title": "t", "selftext": "b", "created_utc": i, "subreddit": "s"} for i in range(9, 0, -1) if before is None or i < before][:page]

    df = listings.read_listings(spark, ["new", "hot"], steady, 2, 8)
    assert df.count() == 7 and {r["source"] for r in df.collect()} == {"hot"} and df.first()["body"] == "t b"


def test_incremental(spark, tmp_path):
    rows = spark.range(10).withColumnRenamed("id", "k")
    path = str(tmp_path / "sink")
    assert incremental.append_missing(rows.where("k < 4"), path, "k", lambda d: d) == 4
    assert incremental.append_missing(rows, path, "k", lambda d: d) == 6
    assert incremental.append_missing(rows, path, "k", lambda d: d) == 0
    assert spark.read.parquet(path).count() == 10
    src = str(tmp_path / "src")
    rows.write.parquet(src)
    for _ in range(2):
        incremental.run_available(spark, src, "k long", str(tmp_path / "out"), str(tmp_path / "cp"), lambda s: s.where("k > 5"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


@pytest.mark.parametrize("bits,keep", [(21, 20_000), (4, 1), (1, 1)])
def test_top_grams_equal_enumeration_whatever_the_buckets(spark, bits, keep):
    """Also where the buckets hold many grams, so that the first guess at full ones is too high; ties by the gram, variants by their bits."""
    rng = random.Random(3)
    rows = [(rng.choice([1, 2, 3]), [f"t{min(int(rng.expovariate(0.2)), 30)}" for _ in range(rng.randrange(12))]) for _ in range(300)] + [(1, None), (3, [])]
    kinds = [grams.ngram(1), grams.ngram(3), grams.gaps(1, 3), grams.combinations(1)]
    want = {(v, s): Counter() for v in (0, 1) for s in range(4)}
    for mask, tk in rows:
        for (v, s), c in want.items():
            if mask >> v & 1:
                for i in range(len(tk or [])):
                    for shape in kinds[s]:
                        if i + shape.offsets[-1] < len(tk):
                            c[" ".join(tk[i + o] for o in shape.offsets)] += min(i + 1, shape.cap or 1)
    got = grams.top_grams(spark.createDataFrame(rows, "mask int, tk array<string>"), "mask", "tk", 2, kinds, 25, bits=bits, keep=keep)
    assert sorted(map(tuple, got.collect())) == sorted((v, s, g, n, r) for (v, s), c in want.items() for r, (g, n) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:25], 1))


def test_frequency_queries_shuffle_no_rare_grams(spark, tmp_path):
    """A plan that explodes grams and groups them shuffles them all; here what is left to run reads the found ones."""
    spark.createDataFrame([(1, "one two three four five six")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("freq_variants", "freq_bigram", "freq_trigram", "skipgram_cumulative", "skipgram_true", "skipgram_combinations"):
        plan = catalog.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "Aggregate" not in plan, name
