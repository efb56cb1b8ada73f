"""What queries must not do again for every row, copy or reader as tables grow."""

import numpy as np
from pyspark.sql import functions as F

from lexloom.operators import association as ac
from lexloom.operators import clustering, corpus, graph
from lexloom.plans import catalog


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_spanning_tree_equals_plain_prim_with_ties_and_copies():
    rng = np.random.default_rng(5)
    for n, d in ((2, 3), (150, 1), (150, 2), (300, 64)):
        x = np.round(rng.normal(size=(n, d)) * 2)
        away = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        inside, best, link, want, at = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int), [], 0
        for _ in range(n - 1):
            inside[at] = True
            closer = (away[at] < best) & ~inside
            best[closer], link[closer] = away[at][closer], at
            at = int(np.where(inside, np.inf, best).argmin())
            want.append((float(best[at]), int(link[at]), at))
        assert clustering.spanning_tree(x) == sorted(want)


def test_tfidf_reads_documents_of_features_only(spark):
    rows = spark.createDataFrame([(1, "a", ["x", "x", "y"]), (2, "a", ["x", "rare"]), (3, "b", ["z"]), (3, "b", ["z", "x"]), (4, None, ["x"])], "id long, seg string, tk array<string>")
    got = ac.tfidf_top(rows, "id", "seg", F.col("tk"), 2, 2)
    assert any("lexloom-tf-" in f for f in got.inputFiles())
    idf = np.log(3 / 2) + 1  # of "rare", which one of two documents has, as "x" is in both
    found = {(r["segment"], r["gram"]): r["score"] for r in got.collect()}
    assert set(found) == {("a", "x"), ("a", "rare"), ("b", "x"), ("b", "z")}
    assert abs(found["a", "x"] - 1 - 1 / np.hypot(1, idf)) < 1e-9 and abs(found["a", "rare"] - idf / np.hypot(1, idf)) < 1e-9


def test_edges_are_counted_once_for_all_readers(spark):
    rows = spark.createDataFrame([(["x", "y", "y", "out"],), (["y", "x"],), (["x"],), (None,), ([],)], "tk array<string>")
    edges = graph.cooccurrence(rows, F.col("tk"), spark.createDataFrame([("x",), ("y",)], "term string"), 2)
    assert "MapInArrow" not in plan(edges)
    assert [tuple(r) for r in edges.collect()] == [("x", "y", 2)]


def test_only_terms_of_the_vocabulary_go_to_python(spark, monkeypatch):
    made = graph._gram_matrices

    def spied(terms, n_keys):
        run = made(terms, n_keys)

        def checked(batches):
            def each():
                for b in batches:
                    tokens = b.column(n_keys)
                    assert set(tokens.flatten().to_pylist()) <= set(terms) and b.num_rows <= 1024
                    yield b

            yield from run(each())

        return checked

    monkeypatch.setattr(graph, "_gram_matrices", spied)
    rows = spark.range(3000).select(F.array(F.lit("x"), F.lit("y"), F.concat(F.lit("other"), "id")).alias("tk"))
    edges = graph.cooccurrence(rows, F.col("tk"), spark.createDataFrame([("x",), ("y",)], "term string"), 2)
    assert [tuple(r) for r in edges.collect()] == [("x", "y", 3000)]


def test_topics_are_fitted_on_kept_rows(spark, monkeypatch):
    from pyspark.ml.clustering import LDA

    fit, seen = LDA.fit, []
    monkeypatch.setattr(LDA, "fit", lambda self, rows: (seen.append(rows.storageLevel.useDisk), fit(self, rows))[1])
    assert catalog.QUERIES["lda_topics"](spark, "/root/testdata/sf0.001").count()
    assert seen == [True] and not spark.sparkContext._jsc.getPersistentRDDs().size()


def test_near_duplicates_copy_vectors_a_bounded_number_of_times(spark, monkeypatch):
    monkeypatch.setattr(corpus, "BLOCKS", 3)
    v = np.random.default_rng(2).normal(size=(60, 4)).astype(np.float32)
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<float>")
    made = []
    close = corpus._close_pairs
    got = corpus.near_duplicates(rows, "id", "v", 0.5, block_rows=1)
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    i, j = np.nonzero(np.triu(unit @ unit.T, 1) > 0.5)
    assert sorted((r["i"], r["j"]) for r in got.collect()) == sorted(zip(i.tolist(), j.tolist()))
    assert "sequence(b" in plan(got) and ", 2" in plan(got)
