import os
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from lexloom.llm import decontamination, jaccard_join, packing, toxicity

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, `m.x` string, row_id string, _row string, keep string, rep string, score string"


def words5(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_near(rows):
    """Of linked documents that with the smallest id stays; rows are (id, text) in any order."""
    sets = [words5(t) for _, t in rows]
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
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i) if d is not None and sets[i] else ("own", i)].append(i)
    return [rows[min(g, key=lambda i: (rows[i][0] is None, rows[i][0] or 0))] for g in groups.values()]


def plain_cut(text, windows):
    """Cuts the words inside a window until none is left, in passes; None where most words went."""
    pattern = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
    if text is None:
        return ""
    first = gone = 0
    while True:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        found = list(pattern.finditer(low))
        first = first or len(found)
        hit = [False] * len(found)
        for i in range(len(found)):
            for w in windows:
                if [m.group(0) for m in found[i : i + len(w)]] == w:
                    hit[i : i + len(w)] = [True] * len(w)
        if not any(hit):
            return None if first and gone / first > 0.5 else text
        runs, i = [], 0
        while i < len(hit):
            j = i
            while j < len(hit) and hit[j]:
                j += 1
            if j > i:
                runs.append((found[i].start(), found[j - 1].end()))
            i = max(j, i + 1)
        gone += sum(hit)
        for a, b in reversed(runs):
            text = text[:a] + text[b:]


def corpus():
    rng = random.Random(11)
    vocabulary = [f"{a}{b}{c}" for a in ("gar", "riv", "sto", "win", "lit") for b in ("de", "er", "ne") for c in ("n", "ly", "m", "ing")]
    clean = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    item = [f"quest{i}" for i in range(14)]
    rows, toxic = [], set()
    for i in range(150):
        w = clean(rng.randrange(25, 60))
        if i % 10 == 3:
            w[rng.randrange(len(w))] = "stupid"
            toxic.add(i)
        rows.append((i, " ".join(w)))
    base = clean(80)
    for i in range(200, 240):  # a group of near copies, ties and exact copies among them
        w = list(base)
        for _ in range(rng.choice((0, 0, 1))):
            w[rng.randrange(80)] = f"edit{i}"
        rows.append((i, " ".join(w)))
    rows += [(300, " ".join([*clean(20), *item, *clean(20)])), (301, " ".join([*item, *clean(5)])), (302, " ".join([*clean(6), *item[:9], *item, *clean(30)])), (303, " ".join(item[:9] + clean(30)))]
    rows += [(400, None), (401, ""), (402, " \n\t"), (403, "few words"), (403, "few words"), (None, " ".join(clean(30))), (404, " ".join(clean(30)) + " mail ann.b@example.org or 10.1.2.3 now"), (405, " ".join(clean(9000)))]
    return rows, toxic, " ".join(item)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows, toxic, item = corpus()
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(d, t, "en", "s", len(t or ""), "a", "b", "c", "d", "e", "f") for d, t in rows], COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("q1", item), ("q2", None), (None, "")], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, toxic, item


def test_stages_equal_a_plain_pipeline(spark, tables, tmp_path):
    folder, rows, toxic, item = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        got[name] = docs.collect()
    pairs = lambda found: Counter((r["doc_id"], r["text"]) for r in found)
    left = [(d, t) for d, t in rows if d not in toxic]
    assert pairs(got["toxicity"]) == Counter(left)
    left = plain_near(left)
    assert pairs(got["near_copies"]) == Counter(left)
    w = item.split()
    windows = [w[i : i + 10] for i in range(len(w) - 9)]
    left = [(d, t if t is None else plain_cut(t, windows)) for d, t in left if t is None or plain_cut(t, windows) is not None]
    assert pairs(got["decontamination"]) == Counter(left) and 301 not in dict(left) and 303 in dict(left)
    left = [(d, t and t.replace("ann.b@example.org", "[EMAIL]").replace("10.1.2.3", "[IP]")) for d, t in left]
    assert pairs(got["pii"]) == Counter(left)
    assert all(r["m.x"] == "a" and r["keep"] == "d" for r in got["pii"])
    tok = packing.WordEncoder("word_bpe_49k.json").tok
    want = sorted((-1 if d is None else d, [*tok.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in left)
    pieces = defaultdict(list)
    for r in got["packing"]:
        pieces[-1 if r["doc_id"] is None else r["doc_id"]].append(r)
    for d, ids in want:
        own = sorted(pieces.pop(d), key=lambda r: r["start"])
        assert [r["start"] for r in own] == [sum(x["length"] for x in own[:i]) for i in range(len(own))] and sum(r["length"] for r in own) == len(ids)
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[r["start"] : r["start"] + r["length"]]))
    assert not pieces
    used = defaultdict(list)
    for r in got["packing"]:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in used.values():
        own.sort()
        assert [a for a, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 2048
    end = [tuple(r) for r in corpus_pipeline.run(spark, folder).select("doc_id", "start", "length", "ids_crc32").collect()]
    assert Counter(end) == Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in got["packing"])


def test_an_empty_table_stays_empty(spark, tables):
    folder = tables[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    assert corpus_pipeline.run_stages(spark, docs, folder).collect() == []


def test_stages_on_the_given_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    outs = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        path = os.path.join(tmp_path, str(i))
        stage(spark, docs, SF).write.parquet(path)
        docs = outs[name] = spark.read.parquet(path)
    scored = toxicity.score_toxicity(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r[0] for r in outs["toxicity"].select("doc_id").collect()} == {r["doc_id"] for r in scored.collect() if not r["predicted"]}
    comp = jaccard_join.components(outs["toxicity"]).collect()
    assert {r[0] for r in outs["near_copies"].select("doc_id").collect()} == {r["doc_id"] for r in comp if r["doc_id"] == r["component_id"]}
    assert decontamination.find_leaks(outs["decontamination"], spark.read.parquet(f"{SF}/benchmark.parquet")).where("size(items) > 0").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "decontamination", "pii", "packing"]
