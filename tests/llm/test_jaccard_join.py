import random

import numpy as np
import pytest

from lexloom.llm import jaccard_join as jj

SCHEMA = "doc_id long, text string, node string, key string, n string, rep string"


def brute(rows):
    """Components by comparing every pair of word sets."""
    sets = []
    for _, text in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), None if d is None else least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)) if d is not None), [len(s) for (d, _), s in zip(rows, sets) if d is None]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", "y", "z", "w") for d, t in rows], SCHEMA)


def copies(rng, n, edits):
    words = [f"w{rng.randrange(3000)}" for _ in range(n)]
    for _ in range(edits):
        words[rng.randrange(n)] = f"v{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed, families=6, size=25):
    rng = random.Random(seed)
    rows, d = [], 0
    passage = " ".join(f"p{i}" for i in range(60))
    for f in range(families):
        base = [f"f{f}w{rng.randrange(400)}" for _ in range(rng.choice((4, 12, 80, 200)))]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 3, 6))):
                w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
            rows.append((d, " ".join(w) + (" " + passage if rng.random() < 0.2 else "")))
            d += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limits", [(192, 1_500_000), (6, 1_500_000), (6, 300)])
def test_components_equal_brute_force(spark, limits):
    rows = corpus(limits[0] + limits[1])
    rows += [(9000, None), (9001, ""), (9002, " \t\n"), (9003, "One two"), (9004, "one TWO"), (9005, "one two three"), (9003, "One two"), (9006, "É é"), (9007, "é é")]
    rows += [(None, "one two"), (9008, "word " * 5000), (9009, "word " * 7000)]
    want, nulls = brute(rows)
    got = jj.components(frame(spark, rows), unit_nodes=limits[0], unit_shingles=limits[1]).collect()
    assert sorted(tuple(r) for r in got if r[0] is not None) == want
    assert [(r["n_shingles"], r["component_id"]) for r in got if r[0] is None] == [(n, None) for n in nulls]


def test_the_same_id_with_other_texts(spark):
    rows = [(1, "a b c d e f"), (1, "g h i j k l"), (2, "g h i j k l"), (3, "a b c d e f")]
    got = sorted(tuple(r) for r in jj.components(frame(spark, rows)).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 2, 1)]


def test_empty_table(spark):
    assert jj.components(frame(spark, [])).collect() == []
    assert jj.keep_one(frame(spark, [])).collect() == []


def test_keep_one(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "x y z"), (3, "x y z"), (4, None), (5, ""), (None, "a b c d e f"), (6, "u v")]
    got = jj.keep_one(frame(spark, rows))
    assert got.columns == frame(spark, rows).columns
    assert sorted((r["doc_id"] is None, r["doc_id"], r["text"]) for r in got.collect() if r["doc_id"] is not None) == [(False, 1, "a b c d e f"), (False, 3, "x y z"), (False, 4, None), (False, 5, ""), (False, 6, "u v")]
    assert got.where("doc_id is null").count() == 1


def random_sets(seed, families=12, size=8):
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(families):
        base = rng.integers(0, 1 << 62, rng.integers(3, 300)).astype(np.uint64)
        for _ in range(size):
            s = base.copy()
            for i in rng.integers(0, len(s), rng.integers(0, max(1, len(s) // 12) + 1)):
                s[i] = rng.integers(0, 1 << 62)
            sets.append(np.unique(s))
    return sets


def linked(a, b):
    both = len(np.intersect1d(a, b))
    return 100 * both >= 80 * (len(a) + len(b) - both)


@pytest.mark.parametrize("exact", [True, False])
def test_tree_prunes_and_loses_nothing(exact):
    sets = random_sets(5)
    joiner = jj.Joiner([(len(s), jj.bitmap(s)) for s in sets], [None] * len(sets), sets if exact else None)
    stars = joiner.join([0] * len(sets))
    for i in range(len(sets)):
        for j in range(i):
            if linked(sets[i], sets[j]):
                assert joiner.find(i) == joiner.find(j)
    assert joiner.compared < len(sets) * (len(sets) - 1) // 8
    if exact:
        assert all(linked(sets[a], sets[b]) for a, b in joiner.links)
    assert {a for a, _ in stars} | {b for _, b in stars} == {i for link in joiner.links for i in link}


@pytest.mark.parametrize("seed", range(4))
def test_sets_that_link_share_one_of_their_first_shingles_in_any_order(seed):
    rng = np.random.default_rng(seed)
    sets = random_sets(seed, 20)
    every = np.unique(np.concatenate(sets))
    order = jj.Order(rng.choice(every, len(every) // 3, replace=False).view(np.int64))
    first = [set(order.first(s)[0].tolist()) for s in sets]
    for i in range(len(sets)):
        for j in range(i):
            if linked(sets[i], sets[j]):
                assert first[i] & first[j]


def limit_pairs():
    """Pairs of texts that share exactly 80 % of their shingles, or one shingle less: words are dropped from one text's end."""
    rows, want = [], {}
    for k, n in enumerate((5, 10, 15, 40, 80, 200, 1000)):
        words = [f"l{k}x{i}" for i in range(n + 4)]  # n shingles
        for off, d in ((0, 4 * k), (1, 4 * k + 2)):
            tag = [f"{w}o{off}" for w in words]
            rows += [(d, " ".join(tag)), (d + 1, " ".join(tag[: len(tag) - n // 5 - off]))]
            want[d + 1] = d if off == 0 else d + 1
    return rows, want


@pytest.mark.parametrize("hot", [0, 16])
def test_pairs_exactly_at_the_limit(spark, hot):
    rows, want = limit_pairs()
    got = {r["doc_id"]: r["component_id"] for r in jj.components(frame(spark, rows), hot=hot).collect()}
    assert {d: got[d] for d in want} == want


@pytest.mark.parametrize("hot, hot_tokens, unit_nodes", [(0, 1_000_000, 192), (2, 40, 8), (16, 0, 5)])
def test_order_and_blocks_do_not_change_the_result(spark, hot, hot_tokens, unit_nodes):
    rows = corpus(hot + unit_nodes, families=5, size=30)
    line = " ".join(f"c{i}" for i in range(12))  # a line that many documents share
    rows += [(5000 + i, f"{line} only {i} of {i * 7} here {i * 13}") for i in range(60)]
    want, _ = brute(rows)
    got = jj.components(frame(spark, rows), unit_nodes=unit_nodes, hot=hot, hot_tokens=hot_tokens).collect()
    assert sorted(tuple(r) for r in got) == want


def test_nothing_is_left_in_the_shared_folder_but_results(spark):
    import os

    from lexloom.session import shared_dir

    before = set(os.listdir(shared_dir(spark)))
    jj.components(frame(spark, corpus(1))).count()
    made = set(os.listdir(shared_dir(spark))) - before
    assert {m.rsplit("-", 1)[0] for m in made if m.startswith("lexloom-")} <= {"lexloom-jaccard-result", "lexloom-components"}


def test_columns_with_dots(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 1, 2), (2, "a b c d e f", 3, 4)], "doc_id long, text string, `m.x` int, `a``b` int")
    assert [tuple(r) for r in jj.keep_one(df).collect()] == [(1, "a b c d e f", 1, 2)]
