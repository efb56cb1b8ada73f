"""The operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import decontamination, media, packing, pii, quality, sharding, token_counts, toxicity, url_filter
from lexloom.llm.tables import picked

# columns that clash with names the operators use inside
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_id string, chunks string, _t string, score string, label string, _id string, shard string"


def frame(spark, rows, sources=None):
    return spark.createDataFrame([(d, t, "en", (sources or {}).get(d, "s"), len(t or ""), "a", "b", "c", "d", "e", "f", "g") for d, t in rows], SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(("the", "wording", "Über", "naïve", "日本", "x1", "don't", "and,", "end.\nNew", "12", "émile")) + rng.choice(("", "", "ly", "!")) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = [(i, prose(rng, rng.randrange(1, 60))) for i in range(40)]
    out += [(100, None), (101, ""), (102, " \n\t "), (103, out[0][1]), (103, out[0][1]), (None, "null id here"), (104, "long " * 9000), (105, "a" * 5000), (106, "x <|endoftext|> y<|endoftext|>")]
    out += [(107, prose(rng, 20000)), (108, "ΣΑΣ ΟΔΟΣ\x1cfoo\x1f bar e\u0301\u0301 İstanbul")]
    return out


def text_of(t):
    return t or ""


def test_token_counts(spark, rows):
    tok = token_counts.load_tokenizer("byte_bpe_50k.json")
    want = sorted((-1 if d is None else d, len(text_of(t).encode()), n := len(tok.encode(text_of(t), add_special_tokens=False)), n > 1024) for d, t in rows)
    for chunk, overlap in ((65_536, 1_024), (400, 20), (64, 4)):
        got = token_counts.count_tokens(frame(spark, rows), chunk=chunk, overlap=overlap).collect()
        assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == want


def test_splice_widens_until_a_proven_boundary():
    tok = token_counts.load_tokenizer("byte_bpe_50k.json")
    starts = lambda p: [a for a, _ in tok.encode(p, add_special_tokens=False).offsets]
    for text in ("x" * 3000 + " end", " " * 4000 + "a", "日本語" * 900 + " \n\n é", "word\u00a0\u00a0 two \n" * 300):
        assert token_counts.count_spliced(starts, text, 100, 3) == len(tok.encode(text, add_special_tokens=False))


def test_packing(spark, rows):
    tok = packing.WordEncoder("word_bpe_49k.json").tok
    ids = [(d, [*tok.encode(text_of(t), add_special_tokens=False).ids, 1]) for d, t in rows]
    got = packing.pack(frame(spark, rows).coalesce(1)).collect()
    by_seq = defaultdict(list)
    for r in got:
        by_seq[r["sequence_id"]].append(r)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert 0 < at <= 2048
    assert len(by_seq) <= -(-sum(len(x) for _, x in ids) // 2048) + 2
    want, have = Counter(), Counter()
    for d, x in ids:
        for r in [r for r in got if r["doc_id"] == d and r["doc_tokens"] == len(x)]:
            part = x[r["start"] : r["start"] + r["length"]]
            if zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)) == r["ids_crc32"]:
                have[(d, tuple(x))] += r["length"]
        want[(d, tuple(x))] += len(x)
    for k, n in want.items():
        copies = sum(1 for d, x in ids if (d, tuple(x)) == k)
        assert have[k] == n * copies


def test_word_ids_equal_whole_texts():
    encoder = packing.WordEncoder("word_bpe_49k.json", 500)
    whole = lambda t: encoder.tok.encode(t, add_special_tokens=False).ids
    texts = [x for c in map(chr, range(1, 0x2C0)) for x in (c, f"a{c}", f"{c}a", f"1{c}b", f"'{c}s", c + c)]
    texts += ["don't we'll 's it's ''s a's-b x²y ½", "naïve ÀÉ ǅ ß ﬀ İstanbul", "a.b,c!!!? --- $$$a&&&b 12345 1a2b3c", "日本語 mixed日本", "foo_bar __x__", ""]
    assert [t for t in texts if encoder.encode(t).tolist() != whole(t)] == []


def test_differencing_and_rising_window_count():
    rng = random.Random(3)
    for _ in range(60):
        sizes = [rng.randrange(1, 500) for _ in range(rng.randrange(1, 60))]
        members = packing.windows(sizes, 512)
        assert sorted(i for m in members for i in m) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in m) <= 512 for m in members)
    loads, _ = packing.differencing([8, 7, 6, 5, 4], 2)
    assert sorted(loads) == [14, 16]
    assert packing.windows([300, 300, 300], 512) == [[0], [1], [2]] or len(packing.windows([300, 300, 300], 512)) == 3


def pii_brute(text):
    spans = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        spans.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group(0).split(".")):
            spans.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group(0) if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(reversed(d))) % 10 == 0:
            spans.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m.group(0)) <= 15:
            spans.append((m.start(), 3, m.end(), "phone"))
    return sorted(spans)


def pii_rows():
    rng = random.Random(11)
    parts = ["a.b@c.d", "a@b.c%d@e.f-g.h", "x@y..z", "@a.b", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "010.000.0255.9", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+49.30 1234567",
             "+12", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "GB82WEST12345698765433", "日本", "😀", "é", " ", "\n", "call ", "7", "1 2 3", ".", "-", "4111111111111111@x.com"]
    out = [(i, "".join(rng.choice(parts) + rng.choice(("", " ")) for _ in range(rng.randrange(0, 30)))) for i in range(150)]
    out += [(900, None), (901, ""), (None, "a@b.c"), (902, "9" * 30000), (903, "a" * 60000 + "@b.c"), (904, " ".join("a@b.c +1 555 010 9999" for _ in range(700)))]
    return out + [out[3], (905, "1.2.3." * 3000), (906, "日" * 9000 + " a@b.c " + "😀" * 5000 + "4111111111111111")]


def test_pii_base_spans_and_redaction(spark):
    rows = pii_rows()
    got = pii.find_pii(frame(spark, rows)).collect()
    want = []
    for d, t in rows:
        s = pii_brute(text_of(t))
        n = Counter(x[3] for x in s)
        base = ",".join(f"{k}:{a}:{b}" for a, _, b, k in s)
        want.append((-1 if d is None else d, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(base.encode()).hexdigest()))
    assert sorted((-1 if r[0] is None else r[0], *r[1:6]) for r in got) == sorted(want)
    spans = {r["doc_id"]: r["spans"] for r in got}
    clean = {r["doc_id"]: r["text"] for r in pii.redact(frame(spark, rows)).collect()}
    for d, t in rows:
        if t is None:
            assert clean[d] is None
            continue
        runs = []
        for x in filter(None, spans[d].split(",")):
            k, a, b = x.split(":")
            if runs and int(a) < runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], int(b))
            else:
                runs.append([int(a), int(b), k])
        out, at = [], 0
        for a, b, k in runs:
            out += [t[at:a], f"[{k.upper()}]"]
            at = b
        assert clean[d] == "".join([*out, t[at:]])


def test_redaction_leaves_other_columns_alone(spark):
    docs = frame(spark, [(1, "write to a.b@c.example now"), (2, None), (None, "")]).selectExpr("*", "'p' as _spans", "'q' as _row", "'r' as `_m.x`", "cast(null as int) as _p")
    got = pii.redact(docs)
    assert got.columns == docs.columns
    kept = {r["doc_id"]: r for r in got.collect()}
    assert kept[1]["text"] == "write to [EMAIL] now" and kept[2]["text"] is None and kept[None]["text"] == ""
    for r in kept.values():
        assert (r["_t"], r["_spans"], r["_row"], r["_m.x"], r["_p"]) == ("c", "p", "q", "r", None)


def test_pii_iban_needs_its_checksum_and_context_moves_the_score(spark):
    got = {r["doc_id"]: r for r in pii.find_pii(frame(spark, [(1, "iban GB82WEST12345698765432"), (2, "GB82WEST12345698765433"), (3, "order 4111111111111111"), (4, "card 4111111111111111")])).collect()}
    assert got[1]["spans"] == "iban:5:27" and got[1]["scores"] == "1.00"
    assert got[2]["spans"] == ""
    assert float(got[3]["scores"]) < float(got[4]["scores"])
    assert pii.redact(frame(spark, [])).collect() == []


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def leaks_brute(rows, items, window):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for d, t in rows:
        w = words(t)
        hit, found = set(), set()
        for i, x in items:
            v = words(x)
            n = min(window, len(v))
            grams = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)} if v else set()
            for j in range(len(w) - n + 1):
                if n and tuple(w[j : j + n]) in grams:
                    hit |= set(range(j, j + n))
                    found.add(str(i))
        out.append((-1 if d is None else d, len(w), len(hit), sorted(found)))
    return sorted(out)


@pytest.mark.parametrize("block", [400_000, 15])
def test_decontamination(spark, block):
    rng = random.Random(5)
    vocab = ["a", "b", "C", "d1", "é", "日本"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice((1, 3, 6, 9, 14))))) for i in range(2, 14)]
    items += [(0, None), (1, ""), (20, "..."), (21, items[3][1])]
    items = [x for x in items if x[0] not in (5,)] + [(30, "zz zz zz")]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 40)))) for i in range(60)] + [(100, None), (101, ""), (None, items[2][1]), (102, "zz, ZZ. zz-zz"), (102, "zz, ZZ. zz-zz")]
    got = decontamination.find_leaks(frame(spark, rows), bench(spark, items), window=5, block_words=block).collect()
    have = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], sum(s["b"] - s["a"] for s in r["spans"]), list(r["items"])) for r in got)
    assert have == leaks_brute(rows, items, 5)


def test_decontamination_without_items_and_removal(spark):
    rows = [(1, "Keep this. One, two three four five six seven eight nine ten! And this and so on and on for long."), (4, "but one two three four five one two three four five six seven eight nine ten six seven eight nine ten " + "more words to keep here " * 6), (2, None), (3, "one two three four five six seven eight nine ten")]
    items = bench(spark, [(1, "one two three four five six seven eight nine ten")])
    assert {r["spans"] == [] for r in decontamination.find_leaks(frame(spark, rows), items.limit(0)).collect()} == {True}
    left = {r["doc_id"]: r["text"] for r in decontamination.remove_leaks(frame(spark, rows), items).collect()}
    assert left == {1: "Keep this. ! And this and so on and on for long.", 2: None, 4: "but  " + "more words to keep here " * 6}


@pytest.mark.parametrize("block", [400_000, 6])
def test_removal_does_not_depend_on_the_blocks(spark, block):
    w = [f"w{i}" for i in range(60)]
    items = [(1, " ".join(w[:6])), (2, " ".join(w[3:9])), (3, " ".join(w[20:26])), (4, " ".join(w[30:36]))]
    half = " ".join([*w[:9], *w[40:49]])
    rows = [
        (1, " ".join([*w[:9], *w[40:52]])),  # windows of two items overlap
        (2, " ".join([*w[20:26], *w[30:36], *w[40:48]])),  # 12 of 20 words, half by either item
        (3, " ".join([*w[20:23], *w[30:36], *w[23:26], *w[40:56]])),  # cutting item 4 brings item 3 together
        (4, None), (5, half), (5, half), (6, "Nothing, here."), (7, ""),
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, k string")
    got = decontamination.remove_leaks(df, bench(spark, items), window=5, block_words=block)
    assert got.columns == df.columns
    have = sorted((r["doc_id"], None if r["text"] is None else r["text"].strip(), r["k"]) for r in got.collect())
    want = [(1, " ".join(w[40:52]), "x"), (3, " ".join(w[40:56]), "x"), (4, None, "x"), (5, " ".join(w[40:49]), "x"), (5, " ".join(w[40:49]), "x"), (6, "Nothing, here.", "x"), (7, "", "x")]
    assert have == want


def plain_cut(data):
    """The rolling hash byte by byte."""
    gear = [int.from_bytes(hashlib.sha256(b"gear %d" % i).digest()[:8], "little") for i in range(256)]
    out, start, h = [], 0, 0
    if len(data) <= media.MIN_CHUNK:
        return [data]
    for i, byte in enumerate(data, 1):
        h = (2 * h + gear[byte]) % 2**64
        if i - start > media.MAX_CHUNK:
            out.append(data[start : start + media.MAX_CHUNK])
            start += media.MAX_CHUNK
        if h >> (64 - media.MASK_BITS) == 0 and i - start >= media.MIN_CHUNK or i == len(data) and i > start:
            out.append(data[start:i])
            start = i
    return out


def plain_feature(data):
    n = len(data)
    mean = sum(data) / n
    std = (sum((x - mean) ** 2 for x in data) / n) ** 0.5
    step = sum(abs(b - a) for a, b in zip(data, data[1:])) / (n - 1)
    cross = sum((a > mean) != (b > mean) for a, b in zip(data, data[1:]))
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(data).values())
    return f"n={n};mean={mean:.4f};std={std:.4f};step={step:.4f};cross={cross};entropy={entropy:.4f}"


def test_media_equals_brute_force(spark, rows):
    shared = "shared passage of some length, " * 400  # chunks that texts have in common
    more = [*rows, (200, shared + "one"), (201, "two " * 500 + shared), (202, shared + "one"), (203, shared * 3)]
    store = media.store_media(frame(spark, more).repartition(3))
    want = []
    for d, t in more:
        raw = text_of(t).encode()
        p = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        chunks = plain_cut(p)
        form = b"CDC1" + struct.pack("<I", len(chunks)) + b"".join(struct.pack("<I", len(c)) + hashlib.sha256(c).digest() for c in chunks) + p
        want.append((-1 if d is None else d, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(form), hashlib.sha256(form).hexdigest(), plain_feature(p), len(chunks)))
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in media.read_media(store).collect()) == sorted(want)
    held = [hashlib.sha256(c).digest() for r in store.texts.collect() for c in r["chunks"] if c is not None]
    assert len(held) == len(set(held)) == len({hashlib.sha256(c).digest() for _, t in more for c in media.cut(media.payload_of(text_of(t))[0])})
    assert media.read_media(media.store_media(frame(spark, []))).collect() == []


def test_damaged_media_is_an_error(spark):
    store = media.store_media(frame(spark, [(1, "some text")]))
    damaged = store.texts.withColumn("chunks", F.transform("chunks", lambda c: F.concat(F.substring(c, 1, 191), F.lit(b"!"))))
    with pytest.raises(Exception, match="missing or damaged"):
        media.read_media(media.Media(damaged, store.moved, store.copies)).collect()


def test_chunks_survive_edits_and_rebuild():
    rng = random.Random(2)
    data = bytes(rng.randrange(256) for _ in range(200_000))
    whole = media.cut(data)
    assert b"".join(whole) == data and all(len(c) <= media.MAX_CHUNK for c in whole) and media.cut(data, segment=5_000) == whole
    edited = media.cut(data[:90_000] + b"!" + data[90_000:])
    assert len(set(whole) & set(edited)) >= len(whole) - 4


def test_sharding(spark, rows):
    big = [(i, "x" * (i % 7)) for i in range(1000, 1700)] + rows
    src = {i: "hot" if i % 3 == 0 else f"s{i % 5}" for i in range(1000, 1700)} | {1001: None}
    got = sharding.interleave(frame(spark, big, src)).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, len(text_of(t).encode()) + 1, zlib.crc32(text_of(t).encode())) for d, t in big)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    sizes = [len(by[s]) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1
    for s, part in by.items():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    hot = {i for i in src if src[i] == "hot"}
    shares = [sum(r["doc_id"] in hot for r in by[s]) for s in range(16)]
    assert max(shares) - min(shares) <= 2
    assert sharding.interleave(frame(spark, [])).collect() == []
    again = {(r["doc_id"], r["size"], r["shard"], r["slot"]) for r in sharding.interleave(frame(spark, big, src).repartition(5)).collect()}
    assert again == {(r["doc_id"], r["size"], r["shard"], r["slot"]) for r in got}


def test_sharding_equals_a_plain_sort(spark, rows):
    big = [(i, "x" * (i % 7)) for i in range(2000, 2400)] + rows
    src = {i: "hot" if i % 3 == 0 else f"s{i % 5}" for i in range(2000, 2400)} | {2001: None}
    df = frame(spark, big, src)
    hashed = df.select("doc_id", "source", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"), (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"))
    hashed = [tuple(r) for r in hashed.withColumn("o", F.xxhash64(F.lit(sharding.SEED), "doc_id", "crc", "size")).collect()]
    groups = defaultdict(list)
    for d, source, crc, size, o in hashed:
        groups["n" if source is None else "s" + source].append((o, d is not None, d or 0, crc, size))
    line = []
    for source, own in groups.items():
        for rank, key in enumerate(sorted(own), 1):
            line.append(((2 * rank - 1) / (2 * len(own)), source, *key))
    line.sort()
    n = len(line)
    want = Counter()
    for at, (_, _, _, there, d, crc, size) in enumerate(line):
        shard = at * 16 // n
        want[(d if there else None, size, crc, shard, at - -(-shard * n // 16))] += 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.interleave(df).collect()) == want


def url_brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group(0)
    path = re.match(r"[^?#]*", rest[len(host) :]).group(0)
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, None, None))
    return host, path, best[1], best[2]


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "http://A.Example.COM/en/1?x=/y#z", "https://www.example.com/en/2", "https://sub.www.example.com/en/2", "http://x.net/es/", "http://net/fr/1", "http://xnet/fr/1", "http://b.org#frag",
            "http://b.org?q=1/2", "ftp://é.net/es/é", "http://example.com", "http://a.com:80/en/", "http://cheap-pills.org/x", "http://library.org/en/5", "http://a://b.net/es/", "http://x.net/es/\nnext", "http://www.example.com/de/"]
    rows = spark.createDataFrame([(i, u, "h", "r", "p") for i, u in enumerate(urls)] + [(None, "http://x.net/es/", "h", "r", "p")], "page_id long, url string, host string, rule string, path string")
    got = url_filter.judge(rows, url_filter.training_table(spark)).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        host, path, rule, verdict = url_brute(urls[r["page_id"]] if r["page_id"] is not None else "http://x.net/es/")
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["score"] >= 0.5 else "allow"))
    by = {r["page_id"]: r["verdict"] for r in got}
    assert by[15] == "block" and by[16] == "allow"
    assert url_filter.judge(rows.limit(0), url_filter.training_table(spark)).collect() == []
    assert url_filter.judge(rows, url_filter.training_table(spark).limit(0)).count() == len(urls) + 1


def plain_places(host, path):
    grams = {m + t[i : i + 4] for m, t in (("h", f"^{host}$"), ("p", f"^{path}$")) for i in range(max(1, len(t) - 3))}
    return grams


def test_url_verdicts_equal_a_plain_logistic_fit(spark):
    """Newton's method on the same table; places are taken from Spark's hash, everything else is plain."""
    table = [(r["url"], r["label"]) for r in url_filter.training_table(spark).collect()]
    judged = [f"http://{w}.{t}/{p}" for w in ("casinos", "newsroom", "my-poker", "gardening", "qwerty", "bookshop") for t in ("org", "co") for p in ("", "en/7")]
    parts = [(u, *url_brute(u)[:2]) for u in [*(u for u, _ in table), *judged]]
    every = sorted({g for _, h, p in parts for g in plain_places(h, p)})
    at = {r["g"]: r["x"] for r in spark.createDataFrame([(g,) for g in every], "g string").selectExpr("g", f"cast(pmod(xxhash64(g), {url_filter.DIM}) as int) as x").collect()}
    x = np.zeros((len(parts), url_filter.DIM + 1))
    x[:, -1] = 1
    for i, (_, h, p) in enumerate(parts):
        x[i, [at[g] for g in plain_places(h, p)]] = 1
    fit, y = x[: len(table)], np.array([label for _, label in table], dtype=float)
    ridge = np.full(url_filter.DIM + 1, 0.003)
    ridge[-1] = 0
    w = np.zeros(url_filter.DIM + 1)
    for _ in range(30):
        q = 1 / (1 + np.exp(-fit @ w))
        hessian = (fit * (q * (1 - q))[:, None]).T @ fit / len(y) + np.diag(ridge + 1e-9)
        w -= np.linalg.solve(hessian, fit.T @ (q - y) / len(y) + ridge * w)
    want = dict(zip(judged, 1 / (1 + np.exp(-x[len(table) :] @ w))))
    got = url_filter.judge(spark.createDataFrame(list(enumerate(judged)), "page_id long, url string"), url_filter.training_table(spark), rules=()).collect()
    for r in got:
        assert abs(r["score"] - want[judged[r["page_id"]]]) < 0.02
        if abs(r["score"] - 0.5) > 0.02:  # scores agree to this much
            assert (r["verdict"] == "block") == (want[judged[r["page_id"]]] >= 0.5)
    assert {r["verdict"] for r in got} == {"allow", "block"}


def character_model(texts):
    three = np.zeros(toxicity.N_SYMBOLS**3)
    for t in texts:
        three += np.bincount(toxicity.trigram_codes(t), minlength=len(three))
    three = three.reshape((toxicity.N_SYMBOLS,) * 3) + 0.01
    return np.log(three / three.sum(axis=2, keepdims=True)).astype(np.float32)


@pytest.mark.parametrize("word", ["a$$", "a55", "5h17", "st.up.id", "f u k", "th3r3", "coool", "s-t-u-p", "id!ot", "0b4c", "1l|7", "aaa$$$b", "x", "$$$", "7h1s+"])
def test_decoding_equals_enumeration(word):
    restorer = toxicity.Restorer(character_model(["this is stupid stuff there", "ass shit fuk idiot cool", "a b c"]))
    best, readings = None, []
    for combo in itertools.product(*restorer.lattice(word), [(" ", 0.0)]):
        score, a, b = 0.0, 0, 0
        for out, cost in combo:
            s, a, b = restorer.cost(a, b, out)
            score += s + cost
        readings.append((score, "".join(o for o, _ in combo)[:-1]))
    best = max(s for s, _ in readings)
    assert restorer.decode(word) in {r for s, r in readings if s > best - 1e-6}


def test_disguises_reach_the_decoder():
    restorer = toxicity.Restorer(character_model(["this is stupid stuff there", "ass shit fuk idiot cool stupid shit ass ass " * 50]))
    assert restorer.restore("You a$$, 5h17 St.Up.Id f u k! 1d10t (coooool) 2024 1 2 3") == "you ass, shit stupid fuk idiot (cool) 2024 1 2 3"
    assert toxicity.spaced_together("a b x y z word 1 2 3 word w u".split()) == ["a b x y z", "word", "1", "2", "3", "word", "w", "u"]
    assert toxicity.spaced_together([]) == []


def test_a_sample_is_never_empty(spark):
    """The predicate at sizes beyond any table: its share of 63-bit hashes stays what was asked for."""
    hashed = spark.range(200_000).select("id")
    for n, rows in ((10**3, 5_000), (400_000, 100_000), (200_000 * 50, 200_000)):
        share = hashed.where(picked(rows, n, "id", F.lit(1))).count() / 200_000
        assert abs(share - min(1, rows / n)) < 0.01
    assert hashed.where(picked(12_000, 10**11, "id")).count() < 10
    bound = (12_000 << 63) // 10**11
    assert 0.99 < bound / 2**63 / (12_000 / 10**11) < 1.01


def toxic_rows():
    rng = random.Random(9)
    clean = ["garden", "river", "stone", "window", "little", "morning", "paper", "yellow", "table", "quiet", "walking", "summer"]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(clean) for _ in range(rng.randrange(10, 40))]
        bad = i % 4 == 0
        if bad:
            w[rng.randrange(len(w))] = rng.choice(("stupid", "idiot", "moron"))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_rows()
    extra = [(1000, "garden river 1d10t stone"), (1001, "stone s t u p i d table"), (1002, "river stuuuupid quiet"), (1003, None), (1004, ""), (None, "garden stone"), (1005, "quiet $tup1d paper"), (1006, "paper 2024 table 3rd x2"), (0, rows[0][1])]
    lab = spark.createDataFrame([*labels, (5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(frame(spark, rows + extra), lab).collect()
    assert len(got) == len(rows) + len(extra)
    by = {r["doc_id"]: r for r in got}
    wrong = [i for i, _, t in labels if by[i]["held_out"] and by[i]["predicted"] != t]
    assert not wrong and any(by[i]["held_out"] for i, _, _ in labels)
    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in rows)
    assert [by[i]["predicted"] for i in (1000, 1001, 1002, 1003, 1004, 1005, 1006)] == [1, 1, 1, 0, 0, 1, 0]
    kept = toxicity.reject_toxic(frame(spark, rows + extra), lab)
    assert kept.columns == frame(spark, []).columns
    assert {r["doc_id"] for r in kept.collect()} >= {1003, 1004, 1006, None}
    none = toxicity.score_toxicity(frame(spark, rows[:3]), lab.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert toxicity.score_toxicity(frame(spark, []), lab).collect() == []


def test_quality(spark, rows):
    rng = random.Random(4)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    good = [(1000 + i, ". ".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(12))) for i in range(120)]
    junk = [(2000 + i, " ".join(rng.choice(words) + "$$$ ###" for _ in range(100))) for i in range(25)] + [(2100 + i, "Spam spam. " * 80) for i in range(20)]
    got = quality.judge_quality(frame(spark, good + junk + rows)).collect()
    assert len(got) == len(good) + len(junk) + len(rows)
    keep = {r["doc_id"]: r["keep"] for r in got}
    assert sum(keep[d] for d, _ in good) >= 115
    assert sum(keep[d] for d, _ in junk[:25]) <= 2
    assert all(0 <= r["score"] <= 1 and 0 <= r["posterior"] <= 1 for r in got)
    assert quality.judge_quality(frame(spark, [])).collect() == []


def plain_votes(text):
    """The labellers, said anew."""
    w = text.split()
    if not w:
        return "b" + "-" * 10
    three = lambda x, bad, good: "b" if x < bad else "g" if x >= good else "-"
    n, raw = len(w), text.encode("utf-8", "surrogatepass")
    lines = [x for x in text.split("\n") if x.strip()]
    letters = sum(1 for b in raw if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) / max(1, sum(b not in (10, 32) for b in raw))
    signs = "#$%&*<>{}[]|\\~^=_@"
    mean = sum(len(x) for x in w) / n
    repeated = 1 - len(set(lines)) / len(lines) if lines else 0
    runs = len([k for k, _ in itertools.groupby(text, key=lambda c: c in signs) if k])
    capitals = sum(len(x) > 1 and x[0].isupper() and x[-1].isupper() for x in w) / n
    echoes = sum(w[i] == w[i + 1] for i in range(n - 1)) / n
    return "".join([
        three(n, 3, 40), "-" if n < 20 else "b" if not 2.5 <= mean <= 12 else "g" if 3.5 <= mean <= 9 else "-", three(letters, 0.75, 0.93), "-" if n < 50 else three(len(set(w)) / n, 0.25, 0.4),
        "-" if len(lines) < 3 else "b" if repeated > 0.3 else "g" if repeated == 0 else "-", "b" if (x := sum(c in signs for c in text) / n) > 0.15 else "g" if x < 0.03 else "-",
        "b" if capitals > 0.2 else "g" if capitals < 0.05 else "-", "-" if n < 50 else "b" if len(lines) > n / 3 else "g" if len(lines) < n / 6 else "-", "-" if n < 20 else "b" if echoes > 0.05 else "g" if echoes < 0.01 else "-",
        "b" if runs / n > 0.1 else "g" if runs / n < 0.02 else "-", "-" if n < 50 else three(len(zlib.compress(raw, 1)) / len(raw), 0.25, 0.35),
    ])


def plain_posteriors(patterns):
    """Expectation-maximisation with plain loops from the same start."""
    post = {p: (p.count("g") + 1) / (p.count("g") + 2 * p.count("b") + 2) for p in patterns}
    k = len(next(iter(patterns)))
    for _ in range(quality.ROUNDS):
        cond = []
        for good in (False, True):
            table = []
            for j in range(k):
                n = {v: 0.5 + sum(c * (post[p] if good else 1 - post[p]) for p, c in patterns.items() if p[j] == v) for v in "gb"}
                table.append({v: n[v] / (n["g"] + n["b"]) for v in "gb"})
            cond.append(table)
        share = (sum(c * post[p] for p, c in patterns.items()) + 1) / (sum(patterns.values()) + 2)
        new = {}
        for p in patterns:
            logit = math.log(share / (1 - share)) + sum(math.log(cond[1][j][v] / cond[0][j][v]) for j, v in enumerate(p) if v != "-")
            new[p] = 1 / (1 + math.exp(-max(-30, min(30, logit))))
        moved = max(abs(new[p] - post[p]) for p in patterns)
        if moved < 1e-9:
            break
        post = new
    return post


def test_votes_posteriors_and_scores_equal_brute_force(spark, rows):
    rng = random.Random(6)
    texts = [*rows, *((3000 + i, prose(rng, rng.randrange(1, 200)) + rng.choice(("", " $$$ ###", "\nA\nA\nA", " word word word"))) for i in range(60))]
    got = quality.judge_quality(frame(spark, texts)).collect()
    key = lambda d, v: (-1 if d is None else d, v)
    assert Counter(key(r["doc_id"], r["votes"]) for r in got) == Counter(key(d, plain_votes(text_of(t))) for d, t in texts)
    want = plain_posteriors(Counter(plain_votes(text_of(t)) for _, t in texts))
    for r in got:
        assert abs(r["posterior"] - want[r["votes"]]) < 1e-6
    # scores by plain sums with the weights of a fit on the same soft labels, rows in another order
    features = quality.Features()
    made = [(features.of(text_of(t), plain_votes(text_of(t))), want[plain_votes(text_of(t))]) for _, t in texts]
    row = np.repeat(np.arange(len(made)), [len(at) for (at, _), _ in made])
    at, x = np.concatenate([a for (a, _), _ in made]), np.concatenate([v for (_, v), _ in made])
    w, b = quality.fit(np.array([y for _, y in made]), row, at, x)
    plain = {(-1 if d is None else d, round(1 / (1 + math.exp(-(b + sum(w[i] * v for i, v in zip(*f))))), 4)) for (d, _), (f, _) in zip(texts, made)}
    scored = {(-1 if r["doc_id"] is None else r["doc_id"], r["score"]) for r in got}
    assert all(any(d == e and abs(s - z) < 0.05 for e, z in plain) for d, s in scored)


def test_expectation_maximisation_recovers_accuracies():
    rng = random.Random(1)
    k = len(quality.LABELLERS)
    counts = Counter()
    for _ in range(20000):
        y = rng.random() < 0.8
        counts["".join("-" if rng.random() < 0.2 else ("g" if (y if rng.random() < 0.7 + 0.03 * j else not y) else "b") for j in range(k))] += 1
    share, cond, post = quality.estimate(dict(counts))
    assert abs(share - 0.8) < 0.03
    for j in range(k):
        assert abs(cond[1, j, 1] / (cond[1, j, 1] + cond[1, j, 2]) - (0.7 + 0.03 * j)) < 0.03
    assert post["g" * k] > 0.99
