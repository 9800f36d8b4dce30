"""Corpus operators against brute force, exact round trips and edge cases."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import chat, common, components, exact_dedup, golay, mixing, packing, quality, repair, sharding, simhash, token_store, tokens, toxicity, url_filter

DOCS = "doc_id long, text string, source string, lang string, size int, kept string, Shard string"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))


def table(spark, rows):
    """Rows (doc_id, text, source) with columns whose names clash with results."""
    return spark.createDataFrame([(i, t, s, "en", 7, "x", "y") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, marks."""
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one", "b"), (5, "one two", "b"), (None, "one two", "b"), (6, LONG, "b"), (6, LONG, "b"), (7, LONG + " x", None)]
    rows += [(i, f"the cat sat on the mat number {i % 5} and looked at it again", "c") for i in range(10, 40)]
    rows += [(50, "É é\nÉ é\nß # * | <a>", "c"), (51, "a b c a b c", "é"), (52, "Ünïcode   spaces\x0b here\x1cthere", "z")]
    return table(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# Tokens


VOCABULARIES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def same_ids(enc, texts):
    for t, want in zip(texts, enc.whole.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == want.ids, ascii(t)


@pytest.mark.parametrize("name", VOCABULARIES)
def test_encoder_equals_library(name):
    enc = tokens.Encoder(tokens.read_tokenizer(public_tokenizers.path(name)))
    r = random.Random(4)
    bits = ["a", "Bc", " ", "  ", "     ", "\n", "\r\n", "'s", "'S", "'", "é", "e\u0301", "1", "!", ".", "\t", "\x0b", "<|endoftext|>", "\x1c", "\x85", "\xa0", "\u2028", "𝔘", "ß", "İ", "Σ", "日本"]
    same_ids(enc, ["", " ", LONG[:5000], "it's we'LL\n\n x ", *("".join(r.choice(bits) for _ in range(r.randrange(16))) for _ in range(5000))])
    assert enc.encode(None) == b""


@pytest.mark.parametrize("name", VOCABULARIES)
def test_every_code_point(name):
    enc = tokens.Encoder(tokens.read_tokenizer(public_tokenizers.path(name)))
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x20000 or c % 64 == 0 or 0xE0000 <= c < 0xE0200)]
    for at in range(0, len(points), 10_000):
        same_ids(enc, [f"a{x}b {x}x 1{x} {x}\n{x}" for x in map(chr, points[at : at + 10_000])])


def test_encoder_forgets():
    enc = tokens.Encoder(tokens.read_tokenizer(public_tokenizers.path("byte_bpe_50k.json")), 2000)
    same_ids(enc, ["a b c d e f", "g h i, j", "a b", *(f"first{i} then{i} last{i}." for i in range(200)), "日本語" * 50, "x" * 500])
    for u in (enc.firsts, enc.units, enc.parts):
        assert len(u) + len(u.old) <= 2000 // tokens.ENTRY and all(len(k) <= tokens.LONG for k in [*u, *u.old])


# 1: URL filters

RULES = [url_filter.HostRule.parse(v, t) for v, t in (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))]


def test_urls(spark):
    urls = [
        (1, "http://A.Example.COM/en/12?x"), (2, "https://a.example.com/en/77"), (3, "x://b.example.net/de/81#q"), (4, "http://net/de/"), (5, "http://ornet/de/"), (6, None),
        (7, "no scheme"), (8, "http://org/es"), (9, "http://w.org/es/?y"), (10, "http://spam-farm.example.de/a"), (10, "http://spam-farm.example.de/a"), (11, "http://É.com/en/"), (12, ""),
    ]
    pages = spark.createDataFrame([(i, u, "v", "m") for i, u in urls], "page_id long, url string, Verdict string, path string")
    mined = [url_filter.TokenRule(("h:farm", "h:spam"), 0.9, 0.1), url_filter.TokenRule(("h:spam", "q:z"), 0.95, 0.1)]
    got = rows_of(url_filter.judge_urls(pages, mined, RULES).orderBy("page_id"))
    assert [(r["page_id"], r["rule"], r["verdict"]) for r in got] == [
        (1, "com/en/", "block"), (2, "example.com/en/7", "allow"), (3, "example.net/de/8", "block"), (4, "net/de/", "allow"), (5, None, "allow"), (6, None, "allow"), (7, None, "allow"),
        (8, None, "allow"), (9, "org/es/", "block"), (10, None, "block"), (10, None, "block"), (11, "com/en/", "block"), (12, None, "allow"),
    ]
    assert (got[0]["host"], got[0]["path"], got[6]["host"], got[11 - 1]["matched"]) == ("a.example.com", "/en/12", "", "h:farm h:spam")
    assert got[11]["host"] == "É.com"  # only A-Z is lowered
    assert url_filter.judge_urls(pages.limit(0), mined, RULES).count() == 0


def rules_by_force(rows, need, confidence, most, noise):
    """Every set of tokens that qualifies, by trying all; ``rows`` are (tokens, bad)."""
    base = sum(b for _, b in rows) / len(rows)
    tokens_, found = sorted({t for x, _ in rows for t in x}), {}
    same = {t: frozenset(k for k, (x, _) in enumerate(rows) if t in x) for t in tokens_}
    for n in range(1, most + 1):
        for c in itertools.combinations(tokens_, n):
            hit = [b for x, b in rows if set(c) <= x]
            if len({same[t] for t in c}) == n and sum(hit) >= need:
                found[c] = sum(hit), len(hit)
    tests = len({frozenset(same[t] for t in c) for c in found})
    ok = {c: h / n for c, (h, n) in found.items() if h >= confidence * n and sum(math.comb(n, k) * base**k * (1 - base) ** (n - k) for k in range(h, n + 1)) <= noise / tests}
    return {c for c, q in ok.items() if not any(set(d) < set(c) and ok[d] >= q for d in ok)}


@pytest.mark.parametrize("width", [12, 1])
def test_mined_rules(spark, width):
    r = random.Random(1)
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        host = "casino-win" if bad and i % 8 else r.choice(["blog", "www", "shop"])
        pair = "/red/blue" if bad and i % 3 else r.choice(["/red", "/blue", ""])
        rows.append((f"http://{host}.site{i % 7}.com/en{pair}/{i}?ref={i}", bad if i % 9 else None))
    rows += [(None, True), ("http://long.com/" + "x" * 100_000, True), ("", False)]
    df = spark.createDataFrame(rows, "url string, bad boolean")
    rules = url_filter.mine_rules(df, width=width)
    known = [(set(x), b) for x, b in ((t["t"], t["bad"]) for t in df.where("bad IS NOT NULL AND url IS NOT NULL").select(url_filter.url_tokens(F.col("url")).alias("t"), "bad").collect())]
    assert {x.tokens for x in rules} == rules_by_force(known, 5, 0.6, 3, 0.05)
    assert any(x.tokens == ("h:casino",) for x in rules) and any(x.tokens == ("p:blue", "p:red") for x in rules)
    for x in rules:
        hit = [b for t, b in known if set(x.tokens) <= t]
        assert abs(sum(hit) / len(hit) - x.confidence) < 1e-9 and abs(sum(hit) / len(known) - x.support) < 1e-9
    assert url_filter.mine_rules(df.limit(0)) == [] and url_filter.mine_rules(df.where("NOT bad")) == []


def test_shared_parameters(spark):
    """A template of 30 parameters, and one of 25 that come and go, are mined in seconds; chance gives no rule."""
    r = random.Random(2)
    rows = [("http://a.com/?" + "&".join(f"k{j}=1" for j in range(30)), i % 2 == 0 or i < 80) for i in range(100)]
    rows += [("http://b.com/?" + "&".join(f"m{j}=1" for j in range(25) if r.random() < 0.9), r.random() < 0.3) for i in range(150)]
    rows += [(f"http://c.com/{r.choice('abcdef')}/{r.choice('xyz')}", r.random() < 0.3) for i in range(300)]
    rules = url_filter.mine_rules(spark.createDataFrame(rows, "url string, bad boolean"))
    assert {x.tokens for x in rules} == {(f"q:k{j}",) for j in range(30)} | {("h:a",)}


# 2: toxicity


def test_ordinal_held_out(spark):
    r = random.Random(2)
    clean, bad = [f"c{i}" for i in range(80)], ["idiotic", "scummy", "trashpile"]
    rows = []
    for i in range(600):
        grade = r.choice([0, 0, 0, 1, 2])
        t = [r.choice(clean) for _ in range(40)] + [r.choice(bad) for _ in range(grade * 3)]
        r.shuffle(t)
        rows.append((i, " ".join(t), grade, "s", 1.0))
    rows += [(900, None, 0, "s", 1.0), (901, "", 0, "s", 1.0), (902, "x", None, "s", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int, Severity string, toxic double")
    m = toxicity.fit(df.where("doc_id < 400 OR doc_id >= 900").select("text", "grade"))
    got = rows_of(toxicity.score(df.drop("grade"), m).join(df.select("doc_id", F.col("grade").alias("g")), "doc_id").where("doc_id BETWEEN 400 AND 899"))
    assert np.mean([(x["grade"] > 0) == (x["g"] > 0) for x in got]) > 0.97
    by = {g: np.mean([x["severity"] for x in got if x["g"] == g]) for g in (0, 1, 2)}
    assert by[0] < by[1] < by[2] and (np.diff(m.thresholds) > 0).all()
    edge = rows_of(toxicity.score(df.where("doc_id >= 900"), m))
    assert len(edge) == 3 and not any(x["toxic"] for x in edge)
    none = toxicity.fit(df.limit(0).select("text", "grade"))
    assert toxicity.score(df.limit(0), none).count() == 0 and not any(x["toxic"] for x in rows_of(toxicity.score(df.limit(5), none)))


def test_few_insults_in_ordinary_text(spark):
    """Labelled toxic texts have many insults and chance words differ; texts with two insults are still found."""
    r = random.Random(4)
    words, bad = [f"c{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(600)], ["idiotic", "scummy", "trashpile", "moronic"]
    text = lambda n: " ".join(r.sample([r.choice(words) for _ in range(100)] + [r.choice(bad) for _ in range(n)], 100 + n))
    rows = [(i, text(6 if i % 9 == 0 else 0), int(i % 9 == 0)) for i in range(900)]
    m = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, grade int"))
    new = spark.createDataFrame([(i, text(2 if i % 2 else 0)) for i in range(400)], "doc_id long, text string")
    got = rows_of(toxicity.score(new, m))
    assert np.mean([x["toxic"] for x in got if x["doc_id"] % 2]) > 0.95 and np.mean([x["toxic"] for x in got if x["doc_id"] % 2 == 0]) < 0.05
    assert all(w.rstrip("*#2")[:5] in {b[:5] for b in bad} for w in m.vocabulary if m.weights[m.vocabulary[w]] > 1)
    assert m.recall > 0.9 and m.precision > 0.8 and not rows_of(toxicity.score(new.limit(1).withColumn("text", F.lit("")), m))[0]["toxic"]


# 3: token store


def test_repair_round_trip():
    r = np.random.default_rng(0)
    cases = [[], [5], [1, 1], [1] * 1000, [1, 2] * 500 + [3], list(range(100)) * 9, r.integers(0, 70_000, 5000).tolist(), [1 << 31] * 9]
    cases += [r.integers(0, r.integers(1, 6), r.integers(0, 400)).tolist() for _ in range(100)]
    for c in cases:
        x = np.array(c, np.uint32)
        g = repair.compress(x)
        assert (repair.expand(g) == x).all()
        n = np.array([len(x)], np.uint32)
        back, ids, null, count = repair.load(repair.dump(g, np.array([9]), np.array([0]), n))
        assert (repair.expand(back) == x).all() and ids.tolist() == [9] and count.tolist() == [len(x)] and not null.any()
        if len(x) > 3:
            a, b = sorted(r.integers(0, len(x), 2).tolist())
            assert (repair.slice_of(back, a, b) == x[a:b]).all()
    assert len(repair.compress(np.array([1, 2] * 500)).seq) < 40
    r = np.random.default_rng(3)
    text = np.concatenate([r.integers(0, 40, 6)[r.integers(0, 6, 30)] for _ in range(400)])
    for least in (2, 3, 4):  # no pair is left that could be replaced so often: overlapping ones of a run count once
        left = repair.compress(text, least=least).seq.tolist()
        last, counts = {}, Counter()
        for i, pair in enumerate(itertools.pairwise(left)):
            if last.get(pair) != i - 1:
                counts[pair] += 1
                last[pair] = i
        assert max(counts.values()) < least


def test_token_store(spark, odd, empty, tmp_path):
    spec = tokens.read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    enc = Tokenizer.from_str(spec)
    token_store.write_store(odd, f"file://{tmp_path}/a", spec, shard_tokens=500)
    store = spark.read.parquet(f"file://{tmp_path}/a")
    got = sorted((r["start"], r["id"], r["n_tokens"], r["ids_crc32"]) for r in rows_of(token_store.read_index(store)))
    flat, at = [], 0
    texts = defaultdict(list)
    for r in rows_of(odd):
        texts[r["doc_id"]].append(np.array(enc.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4"))
    order = sorted(texts, key=lambda i: (i is not None, i or 0))
    for (start, i, n, crc), want in zip(got, [(i, x) for i in order for x in texts[i]], strict=True):
        assert (start, i, n, crc) == (at, want[0], len(want[1]), zlib.crc32(want[1].tobytes()))
        at += n
        flat.append(want[1])
    flat = np.concatenate(flat)
    for a, b in ((0, 5), (400, 2000), (at - 3, at)):
        assert (token_store.read_range(store, a, b) == flat[a:b]).all()
    token_store.write_store(empty, f"file://{tmp_path}/b", spec)
    assert token_store.read_index(spark.read.schema(token_store.STORE).parquet(f"file://{tmp_path}/b")).count() == 0


# 4: mixing


def level(sizes, weights, share, cap):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    t, left, free = dict.fromkeys(names, 0.0), share * sum(sizes.values()), list(names)
    while left > 1e-9 and free:
        total = sum(w[s] for s in free)
        for s in free:
            t[s] += left * w[s] / total
        left = 0.0
        for s in list(free):
            if t[s] > cap * sizes[s]:
                left += t[s] - cap * sizes[s]
                t[s] = cap * sizes[s]
                free.remove(s)
    return t


def test_mix(spark, odd, empty):
    got = rows_of(mixing.mix(odd))
    assert len(got) == odd.count()
    sizes = Counter()
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) and 0 <= r["taken"] <= 2 * r["size"]
        sizes[r["source"]] += r["size"]
    want = level(sizes, (3, 1, 2), 1.5, 2)
    for s in sizes:
        own = [r for r in got if r["source"] == s]
        assert abs(own[0]["target"] - want[s]) < 1e-6 and own[0]["source_size"] == sizes[s]
        assert sum(r["taken"] for r in own) == int(want[s] + 0.5)
    again = rows_of(mixing.mix(odd.repartition(3)))
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    out = mixing.render(mixing.mix(odd), odd.columns)
    assert out.columns == odd.columns
    words, whole, texts = Counter(), Counter(), {r["text"] for r in got}
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    for r in rows_of(out):
        words[r["source"]] += len(split(r["text"]))
        whole[r["source"]] += r["text"] not in texts
        assert any(r["doc_id"] == x["doc_id"] and split(x["text"])[: len(split(r["text"]))] == split(r["text"]) for x in got)
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
    assert +words == +taken and max(whole.values()) <= 1  # one cut row a source
    assert mixing.render(mixing.mix(empty), empty.columns).count() == 0
    many = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 7).alias("source"), (F.col("id") % 90).alias("n"))
    t = {r["source"]: r for r in rows_of(mixing.mix(many, size_col="n", weights=(9, 1)).groupBy("source").agg(F.sum("taken").alias("k"), F.first("target").alias("t")))}
    assert all(abs(r["k"] - r["t"]) <= 1 for r in t.values())


# 5: chats


def cheapest(roles):
    """Least cost by trying everything."""
    seen = {}

    def f(k, s, ins):
        if (k, s, ins) not in seen:
            best = 10**6
            if k == len(roles):
                best = 0 if s == 3 else best
            else:
                for x in chat.LEGAL[s]:
                    best = min(best, f(k + 1, x, 0) + (0 if x == roles[k] else 2))
                if s:
                    best = min(best, f(k + 1, s, 0) + 1 + (0 if s == roles[k] else 2))
            if ins < 4:
                for x in chat.LEGAL[s]:
                    best = min(best, 3 + f(k, x, ins + 1))
            seen[k, s, ins] = best
        return seen[k, s, ins]

    return f(0, 0, 0)


def cost_of(roles, done, after):
    c, s = 3 * len(after), 0
    for (role, action, before), r in zip(done, roles, strict=True):
        for b in before:
            assert b in chat.LEGAL[s]
            s, c = b, c + 3
        if action == "merge":
            assert role == s
            c += 1 + (0 if s == r else 2)
        else:
            assert role in chat.LEGAL[s]
            s, c = role, c + (0 if role == r else 2)
    for b in after:
        assert b in chat.LEGAL[s]
        s = b
    assert s == 3
    return c


def test_repair_is_cheapest():
    r = random.Random(0)
    for _ in range(600):
        roles = [r.randrange(4) for _ in range(r.randrange(1, 8))]
        assert cost_of(roles, *chat.repair(roles, 0, None)) == cheapest(roles)


def test_chats(spark):
    turns = [(1, 0, "user", "hi", "m"), (1, 1, "assistant", "yo", "m"), (2, 0, "user", None, "m"), (2, 0, "user", None, "m"), (3, 5, None, "x", "m"), (None, None, "bot", "", "m"), (4, 2, "assistant", "b", "m"), (4, 1, "system", "a", "m")]
    turns += [(-(1 << 62), 0, "user", "edge", "m"), (9, 0, "user", LONG, "m"), (9, 1, "assistant", LONG[::-1], "m"), (9, 0, "user", LONG, "m")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, position string")
    got = rows_of(chat.format_chats(df).orderBy("conv_id", "position"))
    assert [(r["conv_id"], r["turn"], r["text"]) for r in got if r["action"] != "insert" and r["conv_id"] in (None, -(1 << 62))] == [(None, None, ""), (-(1 << 62), 0, "edge")]
    assert [r["text"] for r in got if r["conv_id"] == 9] == [LONG, LONG, LONG[::-1]] and all(r["text"] in r["rendered"] for r in got)
    one = [r for r in got if r["conv_id"] == 1]
    assert "".join(r["rendered"] for r in one) == "<|user|>\nhi<|end|>\n<|assistant|>\nyo<|end|>\n"
    assert [r["action"] for r in got if r["conv_id"] == 2] == ["keep", "relabel"]
    assert sum(r["turn"] is not None or r["action"] != "insert" for r in got) == len(turns)
    for c in {r["conv_id"] for r in got}:
        assert [r["position"] for r in got if r["conv_id"] == c] == list(range(sum(r["conv_id"] == c for r in got)))
    assert chat.format_chats(df.limit(0)).count() == 0


def test_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK_TURNS", 7)
    monkeypatch.setattr(chat, "FAN", 4)
    r = random.Random(3)
    roles = [r.choice(["user", "assistant", "system", None]) for _ in range(600)]
    df = spark.createDataFrame([(5, k, x, str(k)) for k, x in enumerate(roles)], "conv_id long, turn long, role string, text string")
    got = rows_of(chat.format_chats(df).orderBy("position"))
    codes, k, c = [chat._code(x) for x in roles], 0, 0
    assert [x["turn"] for x in got if x["action"] != "insert"] == list(range(600)) and [x["position"] for x in got] == list(range(len(got)))
    for x in got:
        if x["action"] == "insert":
            c += 3
            continue
        c += (0 if chat.ROLES[codes[k]] == x["role"] else 2) + (x["action"] == "merge")
        k += 1
    assert c == cost_of(codes, *chat.repair(codes, 0, None))


# 6: shards


def test_shards(spark, odd, empty):
    got = rows_of(sharding.shuffle_into_shards(odd, shards=4, bucket_bytes=1000, carry=["source", "lang"]))
    assert sorted(str((r["doc_id"], r["text"], r["source"])) for r in got) == sorted(str((r["doc_id"], r["text"], r["source"])) for r in rows_of(odd))
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert all(r["grown_shard"] in (r["shard"], 4) and r["size"] == len((r["text"] or "").encode()) + 1 for r in got)
    by_id = defaultdict(set)
    for r in got:
        by_id[r["doc_id"]].add(r["shard"])
    assert all(len(x) == 1 for x in by_id.values())
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"))
    a = rows_of(sharding.shuffle_into_shards(many, bucket_bytes=2000).orderBy("doc_id"))
    assert a == rows_of(sharding.shuffle_into_shards(many, bucket_bytes=2000).orderBy("doc_id"))
    n = Counter(r["shard"] for r in a)
    assert min(n.values()) > 400 and abs(np.corrcoef([r["doc_id"] for r in a], [r["slot"] for r in a])[0, 1]) < 0.1
    assert sharding.shuffle_into_shards(empty).count() == 0


def test_write_shards(spark, odd, tmp_path):
    sharding.write_shards(sharding.shuffle_into_shards(odd, shards=3), f"file://{tmp_path}/s")
    back = spark.read.parquet(f"file://{tmp_path}/s")
    assert back.count() == odd.count() and {r["shard"] for r in back.select("shard").distinct().collect()} <= {0, 1, 2}


# 7: quality rules


def measures(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(g)
    covered = {p for i, x in enumerate(g) if n[x] > 1 for p in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, odd, empty):
    led = quality.ledger(odd)
    assert set(odd.columns) <= set(led.columns)
    rows = rows_of(led)
    for r in rows:
        m = measures(r["text"])
        assert tuple(r[c] for c in quality.MEASURES) == m
        words, chars, symbols, lines, dup, rep = m
        bits = [words < 50, 100 * rep > 50 * words, 2 * symbols > 3 * words, 2 * dup > lines, chars < 2 * words, chars > 20 * words]
        assert r["failures"] == sum(1 << k for k, b in enumerate(bits) if b)
    kept = quality.keep_passing(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r["failures"] == 0 for r in rows)
    m = quality.mask("v1")
    for a in rows_of(quality.ablation(led, "v1")):
        bit = 1 << [x.name for x in quality.RULES].index(a["rule"])
        assert a["failed"] == sum(bool(r["failures"] & bit) for r in rows) and a["only_this"] == sum(r["failures"] & m == bit for r in rows)
    assert quality.ledger(empty).count() == 0 and rows_of(quality.ablation(quality.ledger(empty), "base"))[0]["n"] == 0


def test_repeated_windows(spark):
    r = random.Random(5)
    texts = [" ".join(r.choice("abc") for _ in range(r.randrange(30))) for _ in range(200)]
    got = {x["text"]: x["n_repeat_words"] for x in rows_of(quality.measure(spark.createDataFrame([(t,) for t in texts], "text string")))}
    assert all(got[t] == measures(t)[5] for t in texts)


# 8: exact duplicates


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("weak", [False, True])
def test_exact(spark, odd, keep, weak):
    how = {"digest": lambda c: F.lit("same")} if weak else {}
    got = rows_of(exact_dedup.mark_duplicates(odd, keep=keep, carry=["text", "source"], **how))
    groups = defaultdict(list)
    for r in rows_of(odd):
        groups[r["text"] or ""].append(r["doc_id"])
    assert len(got) == odd.count()
    for r in got:
        ids = groups[r["text"] or ""]
        known = [i for i in ids if i is not None]
        want = (max if keep == "largest" else min)(known) if known else None
        assert (r["keep_id"], r["group_size"]) == (want, len(ids)) and r["text_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
        assert not r["kept"] or r["doc_id"] == want
    assert sum(r["kept"] for r in got) == len(groups)
    kept = exact_dedup.drop_duplicates(odd, keep=keep, **how)
    assert kept.columns == odd.columns and kept.count() == len(groups)


def test_exact_empty_and_hot(spark, empty):
    assert exact_dedup.mark_duplicates(empty).count() == 0
    hot = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.mark_duplicates(hot)
    assert got.where("kept").count() == 6001 and got.where("group_size = 3000").count() == 3000


# 9: packing


def check_packing(df, spec, pieces, capacity):
    enc, by = Tokenizer.from_str(spec), defaultdict(list)
    for p in pieces:
        by[p["doc_id"]].append(p)
    seqs, want, have = defaultdict(list), Counter(), Counter()
    for r in rows_of(df):
        ids = np.array(enc.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4")
        want[r["doc_id"]] += len(ids)
        for p in by[r["doc_id"]]:
            if p["doc_tokens"] == len(ids):
                assert bytes(p["ids"]) == ids[p["start"] : p["start"] + p["length"]].tobytes()
    for p in pieces:
        assert p["length"] > 0
        have[p["doc_id"]] += p["length"]
        seqs[p["sequence_id"]].append(p)
    assert want == have
    for s in seqs.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == capacity or (at < capacity and at & (at - 1) == 0)  # no padding at all


def test_packing(spark, odd, empty):
    spec = tokens.read_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    for cap in (64, 2048):
        check_packing(odd, spec, rows_of(packing.pack(odd, spec, capacity=cap)), cap)
    same = table(spark, [(i, "a b c d e", "s") for i in range(300)])
    pieces = packing.pack(same, spec, capacity=16)
    check_packing(same, spec, rows_of(pieces), 16)
    assert packing.sequences(pieces).count() == pieces.select("sequence_id").distinct().count()
    assert packing.pack(empty, spec).count() == 0


def test_best_fill():
    r = random.Random(6)
    for _ in range(200):
        counts = {r.randrange(1, 30): r.randrange(1, 4) for _ in range(r.randrange(1, 6))}
        target, sums = r.randrange(0, 60), {0}
        for x, n in counts.items():
            sums = {s + x * k for s in sums for k in range(n + 1)}
        used = packing.best_fill(counts, target)
        assert all(n <= counts[x] for x, n in used.items()) and sum(x * n for x, n in used.items()) == max(s for s in sums if s <= target)
    plan = packing.plan_windows({k: k % 5 for k in range(1, 200)}, 256)
    total = Counter(plan.left)
    for p, times in plan.patterns:
        assert sum(x * n for x, n in p.items()) == 256
        for x, n in p.items():
            total[x] += n * times
    assert total == Counter({k: k % 5 for k in range(1, 200) if k % 5})


def test_later_rounds_look_at_open_places_only(monkeypatch):
    """Re-Pair's later rounds count few pairs, the grammar expands to the ids, and no pair is left that occurs LEAST times."""
    r, sizes, sort = np.random.default_rng(5), [], np.sort
    ids = np.minimum(r.zipf(1.3, 60_000), 3000).astype(np.uint32)
    monkeypatch.setattr(repair.np, "sort", lambda x: (sizes.append(len(x)), sort(x))[1])
    g = repair.compress(ids)
    assert len(sizes) > 3 and max(sizes[3:]) < len(g.seq) // 2
    assert (repair.expand(g) == ids).all()
    last, n = {}, Counter()
    for k, p in enumerate(zip(g.seq[:-1].tolist(), g.seq[1:].tolist(), strict=True)):
        if last.get(p) != k - 1:  # of overlapping ones every other
            n[p], last[p] = n[p] + 1, k
    assert max(n.values()) < repair.LEAST


# 10: SimHash


def test_golay():
    words = golay.codewords()
    assert min(bin(int(w)).count("1") for w in words[1:]) == 7 and (words >> 11 == np.arange(4096)).all()
    r = np.random.default_rng(1)
    fp = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    for k in range(300):  # any pair within three bits shares a key
        flips = r.choice(64, r.integers(0, 4), replace=False)
        other = fp[k] ^ np.uint64(sum(1 << int(b) for b in flips))
        rows, keys = golay.hard_keys(np.array([fp[k], other], np.uint64))
        assert set(keys[rows == 0].tolist()) & set(keys[rows == 1].tolist())


def reference_fingerprint(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    c = [sum(xxhash.xxh64_intdigest(x.encode(), 42) >> b & 1 for x in s) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * c[b] > len(s))


def groups_of(ids, linked):
    parent = {i: i for i in range(len(ids))}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(ids))]


def test_simhash(spark, odd, empty):
    got = rows_of(simhash.mark_similar(odd, carry=["text"]))
    fps = [reference_fingerprint(r["text"]) for r in got]
    assert [r["fingerprint"] for r in got] == [f"{f:016x}" for f in fps]
    g = groups_of(got, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    for k, r in enumerate(got):
        ids = [got[j]["doc_id"] for j in range(len(got)) if g[j] == g[k] and got[j]["doc_id"] is not None]
        assert r["component_id"] == min(ids, default=None)
    assert sum(r["kept"] for r in got) == len(set(g))
    assert simhash.mark_similar(empty).count() == 0


def test_links_of_a_large_group(spark):
    """A key with more rows than a task compares at once goes through blocks, and loses no link."""
    r = np.random.default_rng(2)
    fp = np.unique(np.array([np.bitwise_xor.reduce([0, *(1 << r.choice(12, r.integers(0, 5), replace=False))]) for _ in range(400)], np.int64))
    keys = spark.createDataFrame([(7, int(x), int(x)) for x in fp], "key long, node long, fp long")
    whole, cut = (components.components(simhash.link_candidates(keys, 1, limit)) for limit in (1 << 15, 16))
    assert {(x["node"], x["root"]) for x in rows_of(whole)} == {(x["node"], x["root"]) for x in rows_of(cut)}
    g = groups_of(fp, lambda a, b: (int(fp[a]) ^ int(fp[b])).bit_count() <= 1)
    assert len({x["root"] for x in rows_of(whole)}) == sum(n > 1 for n in Counter(g).values())


def test_links_of_nodes_with_several_fingerprints(spark):
    """Rows of one node are never linked to themselves, and reach what any of them is near to, in one task or in blocks."""
    fps = {1: (0, 255, 1 << 20), 2: (254, 1 << 40), 3: (3 << 40, 1 << 50), 4: (7 << 55,)}
    rows = [(key, node, fp) for key in (5, 6) for node, x in fps.items() for fp in x]
    keys = spark.createDataFrame(rows, "key long, node long, fp long")
    for limit in (1 << 15, 4):
        links = rows_of(simhash.link_candidates(keys, 1, limit))
        assert all(x["a"] != x["b"] for x in links)
        assert {(x["node"], x["root"]) for x in rows_of(components.components(spark.createDataFrame(links, "a long, b long")))} == {(1, 1), (2, 1), (3, 1)}


def test_copies_are_linked_once(spark, monkeypatch):
    """What the first keys have joined is not linked again under each key of the second, and neither's links stay on disk."""
    r = random.Random(4)
    base = [f"w{r.randrange(5000)}" for _ in range(300)]
    texts = [" ".join(f"x{k}" if r.random() < 0.02 else w for w in base) for k in range(40)]
    found, linked = [], simhash._linked

    def counted(*args):
        links, path = linked(*args)
        found.append(links.count())
        return links, path

    monkeypatch.setattr(simhash, "_linked", counted)
    before = set(common.written_so_far(spark))
    got = simhash.drop_similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [x["doc_id"] for x in rows_of(got)] == [0] and len(found) == 2 and found[0] > 0 and found[1] < 39
    assert not any(p.endswith("-scan") for p in set(common.written_so_far(spark)) - before)


def test_components(spark):
    r = random.Random(8)
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    got = {x["node"]: x["root"] for x in rows_of(components.components(spark.createDataFrame(edges, "a long, b long")))}
    nodes = sorted({x for e in edges for x in e})
    link = {frozenset(e) for e in edges}
    g = groups_of(nodes, lambda a, b: frozenset((nodes[a], nodes[b])) in link)
    want = {n: nodes[k] for n, k in zip(nodes, g, strict=True) if sum(x == k for x in g) > 1}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def near(a, b, n=5, similarity=0.8):
    """Common shingles cover the share of both texts' words, or of their sets of shingles, by the definition."""
    x, y = (simhash.shingles(t, n) for t in (a, b))
    both = set(x) & set(y)
    if not x or not y:
        return not x and not y

    def cover(s):
        places = {p + k for p, g in enumerate(s) if g in both for k in range(n)}
        return len(places) / (len(s) + n - 1)

    return min(cover(x), cover(y)) >= similarity - 1e-12 or len(both) >= similarity * len(set(x) | set(y)) - 1e-12


def test_near_duplicates(spark, odd, empty):
    r = random.Random(9)
    vocab = [f"v{i}" for i in range(3000)]
    rows, base = [], None
    for i in range(120):
        if i % 4 == 0:
            base = [r.choice(vocab) for _ in range(300)]
            t = list(base)
        else:
            t = list(base)
            for _ in range([0, 2, 25, 70][i % 4]):
                t[r.randrange(len(t))] = r.choice(vocab)
        rows.append((i, " ".join(t), "s"))
    df = table(spark, rows)
    g = groups_of(rows, lambda a, b: near(rows[a][1], rows[b][1]))
    assert 40 < len(set(g)) < 70
    kept = simhash.drop_similar(df)
    assert kept.columns == df.columns and {x["doc_id"] for x in rows_of(kept)} == set(g)
    assert simhash.drop_similar(empty).count() == 0
    left = rows_of(simhash.drop_similar(odd))
    assert sum(x["text"] is None or not x["text"].strip() for x in left) == 1 and sum((x["text"] or "").startswith("w0 w1") for x in left) == 1


def test_pairs_close_to_the_bound(spark):
    """Pairs that stand alone and cover exactly 0.8 of each other lose a document, pairs just below keep both."""
    r, rows, gone = random.Random(12), [], set()
    for i in range(500):
        t = [f"v{r.randrange(10**6)}" for _ in range(400)]
        cut = 81 if i % 10 == 0 else 80
        rows += [(2 * i, " ".join(t), "s"), (2 * i + 1, " ".join(t[:-cut] + [f"x{r.randrange(10**6)}" for _ in range(cut)]), "s")]
        gone |= {2 * i + 1} if cut == 80 else set()
    kept = {x["doc_id"] for x in rows_of(simhash.drop_similar(table(spark, rows)))}
    assert kept == set(range(1000)) - gone


def test_golay_keys_bring_near_duplicates_together(spark):
    """Without the exact way, the Golay keys alone find the copies with one word in twenty changed, and nothing else."""
    r, rows = random.Random(14), []
    for i in range(200):
        t = [f"v{r.randrange(10**6)}" for _ in range(300)]
        rows.append((2 * i, " ".join(t), "s"))
        for p in r.sample(range(300), 15):
            t[p] = f"x{r.randrange(10**6)}"
        rows.append((2 * i + 1, " ".join(t), "s"))
    kept = {x["doc_id"] for x in rows_of(simhash.drop_similar(table(spark, rows), exact=False))}
    assert set(range(0, 400, 2)) <= kept and len(kept) <= 210
    sums = np.stack([simhash.bit_sums(t, 2)[: simhash.SOFT_BITS] for _, t, _ in rows])
    at, keys = golay.soft_keys(golay.soft_words(sums))
    own = [set(keys[at == k].tolist()) for k in range(len(rows))]
    assert all(len(x) == 90 for x in own) and sum(bool(own[k] & own[k + 1]) for k in range(0, 400, 2)) >= 190
    assert golay.soft_keys(golay.soft_words(sums[:0]))[1].size == 0


def test_near_pairs_of_a_block():
    r = random.Random(3)
    for _ in range(200):
        base = [r.choice("abcdefgh") for _ in range(r.randrange(0, 30))]
        texts = []
        for _ in range(r.randrange(1, 9)):
            t = list(base)
            for _ in range(r.randrange(0, 4)):
                if t:
                    t[r.randrange(len(t))] = r.choice("xyz")
            texts.append(" ".join(t[: r.randrange(len(t) // 2, len(t) + 1)]))
        n = r.choice([2, 3, 5])
        g = groups_of(texts, lambda a, b, t=texts, n=n: near(t[a], t[b], n))
        links = {frozenset(x) for x in simhash.near_duplicates(texts, n, 0.8)}
        assert groups_of(texts, lambda a, b, links=links: frozenset((a, b)) in links) == g and len(links) == len(texts) - len(set(g))


def test_large_cluster(spark, monkeypatch):
    """A candidate cluster of many blocks, with a chain and stragglers that only other blocks' documents reach."""
    monkeypatch.setattr(simhash, "CLUSTER_BLOCK", 6)
    monkeypatch.setattr(simhash, "HUBS", 2)
    r = random.Random(31)
    base, rows = [f"v{i}" for i in range(150)], []
    for i in range(90):
        t = list(base)
        for _ in range(r.choice([1, 8, 8, 8, 30])):
            t[r.randrange(150)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    texts = spark.createDataFrame(rows, "_gl_row long, _gl_text string")
    clusters = spark.createDataFrame([(i, i // 80) for i in range(90)], "node long, root long")
    got = {frozenset((x["a"], x["b"])) for x in rows_of(simhash.verified_links(texts, clusters, 5, 0.8))}
    g = groups_of(rows, lambda a, b: a // 80 == b // 80 and near(rows[a][1], rows[b][1]))
    assert all(near(rows[a][1], rows[b][1]) for a, b in map(sorted, got)) and 3 < len(set(g)) < 60
    assert groups_of(rows, lambda a, b: frozenset((a, b)) in got) == g


def test_near_copies_of_the_test_table(spark):
    """Of the pairs of near copies (a third of their shingles in common or more) nine in ten lose a document."""
    path = Path("/root/testdata/sf0.1/documents.parquet")
    if not path.exists():
        pytest.skip("no test table")
    docs = exact_dedup.drop_duplicates(spark.read.parquet(str(path)))
    rows = [(x["doc_id"], simhash.shingles(x["text"], 5)) for x in docs.select("doc_id", "text").collect()]
    lists, met = defaultdict(list), Counter()
    for k, (_, s) in enumerate(rows):
        for x in set(s):
            lists[x].append(k)
    for x in lists.values():
        if 1 < len(x) <= 100:
            met.update(itertools.combinations(x, 2))
    pairs = {p for p, n in met.items() if n >= 0.35 * (len(set(rows[p[0]][1])) + len(set(rows[p[1]][1])) - n)}
    g, up = {}, lambda x: x if g.setdefault(x, x) == x else up(g[x])
    for a, b in pairs:
        a, b = up(a), up(b)
        g[max(a, b)] = min(a, b)
    want = len(rows) - len({up(k) for k in range(len(rows))})
    kept = {x["doc_id"] for x in rows_of(simhash.drop_similar(docs).select("doc_id"))}
    linked = {rows[k][0] for p in met for k in p}
    assert len(rows) - len(kept) >= 0.9 * want > 100 and {i for i, _ in rows} - kept <= linked


# The rest


def test_attach_hot_key(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    classes = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = common.attach(rows, classes, "k", "n", 5000)
    assert got.count() == 5000 and got.where("k = 0 AND n = 2500").count() == 2500 and got.where("n IS NULL").count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(10)
    vocab = [f"word{i}" for i in range(500)]
    rows = [(i, " ".join(r.choice(vocab) for _ in range(80)), f"s{i % 3}") for i in range(40)]
    rows += [(100, rows[3][1], "s0"), (101, rows[4][1] + " extra", "s1"), (102, "too short", "s1"), (103, "$$$ ### " * 60, "s2"), (104, None, "s2")]
    docs = table(spark, rows).select("doc_id", "text", "source", "lang")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out, sizes = docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, out, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out{k}")
        out = spark.read.parquet(f"{tmp_path}/out{k}")
        sizes.append({x["doc_id"] for x in out.select("doc_id").distinct().collect()})
        assert k == 4 or out.columns == docs.columns
    assert sizes[0] == set(range(40)) | {100, 101} and sizes[1] == set(range(40)) | {101} and sizes[2] == set(range(40))
    assert sizes[4] == sizes[3] <= sizes[2]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == out.count()
