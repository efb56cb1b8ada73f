"""Plug-ins, sources, sinks and span extras on small fixtures."""

import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from lexloom.functions import plugins
from lexloom.functions import text as tx
from lexloom.operators import corpus, spans
from lexloom.sources import files, listings


def rules():
    class Rules:
        """Every plug-in by plain rules."""

        def embed(self, texts):
            return [[float(len(t)), float(t.count("a"))] for t in texts]

        def tag(self, texts):
            return [[(w, "VERB" if w.lower() in ("go", "rest") else "NOUN") for w in t.split()] for t in texts]

        def lemmas(self, texts):
            return [[w.rstrip("s") for w in t.split()] for t in texts]

        def score(self, texts):
            return [t.count("good") - t.count("bad") for t in texts]

        def rank(self, texts, labels):
            return [[(x, 0.9 if x in t else 0.1) for x in labels] for t in texts]

    return Rules()


def test_plugins(spark):
    rows = spark.createDataFrame([(1, "Go rest cats", 7), (2, "good good bad", 8), (3, None, 9)], "id long, text string, `m.x` int").withColumnRenamed("m.x", "mx")
    by = lambda df, c: {r["id"]: r[c] for r in df.collect()}
    assert by(plugins.embedded(rows, "text", rules()), "embedding") == {1: [12.0, 1.0], 2: [13.0, 1.0], 3: [0.0, 0.0]}
    assert by(plugins.lemmatized(rows, "text", rules()), "lemmas")[1] == ["Go", "rest", "cat"]
    assert by(plugins.valence(rows, "text", rules()), "valence") == {1: 0.0, 2: 1.0, 3: 0.0}
    tags = plugins.tagged(rows, "text", rules())
    assert tags.columns == ["id", "text", "mx", "tags"]
    assert by(tags.select("id", plugins.seed_pos(F.col("tags"), "REST").alias("pos")), "pos") == {1: "VERB", 2: None, 3: None}
    assert by(plugins.zero_shot(rows, "text", rules(), ["good", "rest"]), "label") == {1: "rest", 2: "good", 3: "ambiguous"}
    said = rows.select("id", plugins.imperative_sentences(F.lit("Go home. We went. You should rest! No"), ["go", "rest"]).alias("s")).first()["s"]
    assert said == ["go home", "you should rest"]
    assert plugins.valence(rows.limit(0), "text", rules()).collect() == []


def test_fallback_and_validation_sample(spark):
    rows = spark.createDataFrame([(f"r{i}", t) for i, t in enumerate(["We said hello. Then nothing of note happened here at all.", "plain text", "> quoted line", "", None, "x"])], "row_id string, text string")
    found = spans.segment(rows, "row_id", "text")
    open_ = [r for r in found.collect() if r["label"] == "ambiguous"]
    asked = spans.with_fallback(found, lambda texts: ["label: user high" if "plain" in t or "note" in t else "???" for t in texts], ["user", "model_quoted"], 2)
    got = {(r["row_id"], r["span_index"]): (r["label"], r["confidence"], r["source"]) for r in asked.collect()}
    longest = sorted(open_, key=lambda r: (-len(r["span_text"]), r["row_id"], r["span_index"]))
    assert len(open_) == 3 and len(got) == found.count() and asked.columns == found.columns
    for r in longest[:2]:
        assert got[r["row_id"], r["span_index"]] == ("user", "high", "fallback")
    assert got[longest[2]["row_id"], longest[2]["span_index"]] == ("ambiguous", "low", "gap")
    sample = {r["row_id"]: (r["stratum"], json.loads(r["spans"])) for r in spans.validation_sample(found, 1).collect()}
    assert len({s for s, _ in sample.values()}) == len(sample) == found.where("span_index = 0").select("label").distinct().count()
    for row, (stratum, nested) in sample.items():
        assert nested[0]["label"] == stratum and [x["span_index"] for x in nested] == list(range(len(nested)))
        assert nested[-1]["span_end"] == len(next(r["text"] for r in rows.collect() if r["row_id"] == row))
    made = spans.extractor_yield(spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, [])], "row_id long, sources array<string>"))
    assert sorted((r["method"], r["n"], round(r["share"], 4), r["rows"]) for r in made.collect()) == [("a", 2, 0.6667, 2), ("b", 1, 0.3333, 1)]


def test_resolution_and_bounds_equal_plain_ones():
    rng = random.Random(5)
    for _ in range(200):
        size = rng.randrange(1, 60)
        found = [(a := rng.randrange(-2, size), a + rng.randrange(1, 25), rng.choice(("user", "model")), rng.choice(("high", "medium", "low")), "n") for _ in range(rng.randrange(8))]
        cover = [spans.FLOOR] * size
        for a, b, *rest in sorted(found, key=lambda s: (-spans.RANK[s[3]], s[2], s[0], s[0] - s[1])):
            for i in range(max(0, a), min(size, b)):
                if cover[i] == spans.FLOOR:
                    cover[i] = tuple(rest)
        got = spans.resolve(found, size)
        assert [s[0] for s in got] == [0, *(s[1] for s in got[:-1])] and got[-1][1] == size
        assert [tuple(s[2:]) for s in got for _ in range(s[1] - s[0])] == cover
    text = "One two. Three  four!\nFive six"
    for a in range(len(text)):
        for b in range(a + 1, len(text) + 1):
            first = max((m.end() for m in re.finditer(r"[.!?\n]", text[:a])), default=0)
            while first < a and text[first].isspace():
                first += 1
            m = re.compile(r"[.!?\n]").search(text, max(b - 1, a))
            assert spans.sentence_bounds(text, a, b) == (first, m.end() if m else len(text))


def test_searches_and_comments(spark):
    found = {("rest", "new"): [{"id": "p1", "title": "T", "selftext": "S", "created_utc": 50, "subreddit": "s"}, {"id": "p2", "title": "old", "created_utc": 5}], ("rest", "top"): [{"id": "p1", "title": "T", "selftext": "S", "created_utc": 50, "subreddit": "s"}]}
    got = listings.read_searches(spark, ["rest"], ["new", "top"], lambda q, s: found[q, s], 10, 100).collect()
    assert [(r["post_id"], r["body"], r["type"], r["source"]) for r in got] == [("p1", "T S", "post", "rest:new")]
    posts = spark.createDataFrame([("p1",), ("p2",), ("p1",), (None,)], "post_id string")
    fetch = lambda i, most: [{"id": f"{i}c{k}", "link_id": i, "parent_id": i, "body": f"b{k}", "created_utc": k} for k in range(80)]
    got = listings.read_comments(posts, fetch, 10, 1000).collect()
    assert sorted(r["comment_id"] for r in got) == sorted(f"{p}c{k}" for p in ("p1", "p2") for k in range(10, 50))
    with pytest.raises(RuntimeError):
        list(listings.pages(lambda name, before, page: [{"id": str(before), "created_utc": before - 1}] * 1, "x", 0, 10**6, page=1, most_pages=3))


def test_files(spark, tmp_path):
    (tmp_path / "seeds.csv").write_text("term,provenance_case_id,pattern_type,confidence,retrieval_action\ngo to bed,P1,phrasal,high,exact match\nre?st,P2,x,low,regex\n")
    assert files.read_seed_terms(spark, f"{tmp_path}/seeds.csv") == [("go to bed", "high", "exact match"), ("re?st", "low", "regex")]
    for name in ("a_2020", "b_2021"):
        (tmp_path / f"{name}.csv").write_text("post_id,body,createdAt,subreddit,type,comment_id,parent_id,source\n" + f"{name},x,2020-01-01 00:00:00,s,post,,,l\n")
    got = files.read_strata(spark, f"{tmp_path}/*_20*.csv", files.CORPUS, r"_(\d+)\.csv").collect()
    assert sorted((r["post_id"], r["stratum"]) for r in got) == [("a_2020", "2020"), ("b_2021", "2021")]
    df = spark.createDataFrame([(i, [float(i)]) for i in (5, 3, 9, 1)], "id long, v array<double>").repartition(3)
    (tmp_path / "blocked").write_text("a file")
    assert files.write_csv(df.select("id"), f"{tmp_path}/blocked/x", f"{tmp_path}/csv").endswith("/csv") and spark.read.csv(f"{tmp_path}/csv", header=True).count() == 4
    files.write_embeddings(df, f"{tmp_path}/emb", "id", "v")
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/emb").orderBy("row_index").collect()] == [(0, 1, [1.0]), (1, 3, [3.0]), (2, 5, [5.0]), (3, 9, [9.0])]
    files.write_summary(df.agg(F.count("*").alias("n"), F.max("id").alias("m"), F.lit(None).cast("int").alias("z")), f"{tmp_path}/sum")
    files.write_lexicon(spark, {"b": ["y", "x", "y"], "a": ["z"]}, f"{tmp_path}/lex")
    read = lambda d: [json.loads(x) for f in sorted(os.listdir(tmp_path / d)) if f.startswith("part") for x in (tmp_path / d / f).read_text().splitlines()]
    assert read("sum") == [{"n": 4, "m": 9, "z": None}]
    assert read("lex") == [{"name": "a", "terms": ["z"]}, {"name": "b", "terms": ["x", "y"]}]
    files.write_report([("Sizes", df.select("id").orderBy("id"))], f"{tmp_path}/report")
    assert "## Sizes\n\n| id |\n|-|\n| 1 |" in "".join((tmp_path / "report" / f).read_text() for f in os.listdir(tmp_path / "report") if f.startswith("part"))


def test_times_and_shifts(spark):
    rows = spark.createDataFrame([(1, "2024-01-02 03:04:05", "x"), (2, "n/a", "x"), (3, None, "x"), (4, "2024-01-02", None)], "id long, at string, body string")
    assert [(r["id"], str(r["at"])) for r in corpus.readable(rows, "at", ["body"]).collect()] == [(1, "2024-01-02 03:04:05")]
    assert str(spark.range(1).select(corpus.naive_utc(F.lit(86_400)).alias("t")).first()["t"]) == "1970-01-02 00:00:00"
    v = spark.createDataFrame([("a", "low", "b", "high"), ("a", "high", "a", "medium"), (None, None, None, "low"), ("x", "medium", None, "medium")], "l1 string, c1 string, l2 string, c2 string")
    assert tuple(corpus.label_shift(v, "l1", "c1", "l2", "c2").first()) == (4, 2, 1, 1, 2)
    assert tx.anchor_token  # the functions module is whole
