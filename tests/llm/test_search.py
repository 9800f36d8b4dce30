"""Personal data, lexical search and importance resampling against brute force, with edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gridloom.llm import lexical, pii, resampling
from gridloom.llm.queries import QUERIES

DOCS = "doc_id long, text string, source string, score string, Rank int, spans string"


def table(spark, rows, parts=3):
    """Rows (doc_id, text) with columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "s", "x", 7, "y") for i, t in rows], DOCS).repartition(parts)


def words_table(seed=3, n=120):
    r = random.Random(seed)
    vocab = [f"{a}{b}" for a in ("ka", "Lo", "mé", "st", "x1", "日") for b in ("n", "R", "t5", "ü", "")]
    say = lambda k: " ".join(r.choice(vocab[: r.choice((4, 12, 30))]) for _ in range(k))
    rows = [(3 * i, say(r.randrange(1, 120))) for i in range(n)]
    rows += [(1, None), (2, ""), (4, " .,;\n"), (5, "one"), (7, say(9000)), (10, rows[0][1]), (11, rows[0][1]), (None, rows[0][1]), (12, rows[0][1]), (12, rows[0][1]), (13, "w" * 70_000 + " ka " + "é" * 40_000)]
    return rows, [(k, say(r.randrange(1, 30))) for k in range(12)] + [(90, None), (91, ""), (92, "ka"), (92, "Lon"), (93, "nowhere"), (None, "kan")]


# Personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum((v * 2 - 9 if v > 4 else v * 2) if i % 2 else v for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def base_by_force(t):
    def fits(k, v):
        d = re.sub("[^0-9]", "", v)
        return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in v.split(".")), "card": lambda: 12 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[k]()

    found = sorted((m.start(), n, m.end()) for n, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, t or "") if fits(k, m.group()))
    return [f"{list(PATTERNS)[n]}:{a}:{b}" for a, n, b in found]


def personal_texts():
    r = random.Random(9)
    bits = ["a@b.co", "x@y", "a.b+c@d-e.fr.", "@", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "001.02.3.004", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111", "1234 5678  9012", "+1 (017) 555-7713", "+44", "+49 171 2345678 .", "+1--------", "é", "𝔘", "日本", "\n", " ", "-", ".", "0", "17", "_", "%"]
    rows = ["", None, "4" * 5000, "a" * 30_000, "a@b" + ".c" * 8000, "1 " * 20_000, "@" * 5000, ("x@y.zz, " * 3000) + "4111111111111111", "1.2.3.4 " * 700]
    return rows + ["".join(r.choice(bits) for _ in range(r.randrange(1, 14))) for _ in range(3000)]


def test_base_spans(spark):
    texts = personal_texts()
    df = table(spark, list(enumerate(texts)) + [(9999, texts[20]), (9999, texts[20]), (None, texts[21])])
    out = pii.mark_spans(df)
    assert out.columns == ["doc_id", "text", "source", "score", "Rank", *pii.OUT[:5], "spans", "n_added"]
    got = out.collect()
    assert len(got) == len(texts) + 3
    for x in got:
        want = base_by_force(x["text"])
        assert x["spans"] == ",".join(want), ascii(x["text"])[:200]
        assert x["base_sha256"] == hashlib.sha256(x["spans"].encode()).hexdigest() and x["n_added"] == 0
        assert tuple(x[f"n_{k}"] for k in PATTERNS) == tuple(sum(s.startswith(k) for s in want) for k in PATTERNS)
    assert pii.mark_spans(table(spark, [])).count() == 0
    assert pii.mark_spans(df).where("n_email > 0 AND spans LIKE '%card%'").count() == sum({"email", "card"} <= {s.split(":")[0] for s in x["spans"].split(",")} for x in got)


@pytest.fixture(scope="module")
def model(spark):
    r = random.Random(2)
    vocab = [a + b for a in ("ther", "on", "ing", "kel", "mo") for b in ("ta", "ren", "i", "s")]
    docs = [(i, " ".join(r.choice(vocab) for _ in range(r.randrange(20, 200)))) for i in range(300)]
    return pii.fit(table(spark, docs), texts=300, each=24), docs


def test_disguised_spans(spark, model):
    m, docs = model
    assert min(m.recall) > 0.8 and min(m.precision) > 0.97
    said = {
        "write to john.smith (at) mail (dot) com now": "email:9:39", "call (017) 555-7713 today": "phone:5:19", "card 4111.1111.1111.1111, thanks": "card:5:24", "seen at 10[.]20[.]30[.]40 then": "ip:8:25",
        "mail jim@b.de or 4111 1111 1111 1111": "email:5:13,card:17:36",
        "on 2024-05-17 at 12:30:45": "", "version 1.2.3 of it": "", "look at me.You are": "", "card 4111.1111.1111.1112 failed": "", "token = 9c8b45435718dcc700c184a7e303cdc64c6a8f7f": "",
    }
    out = pii.redact(pii.mark_spans(table(spark, list(enumerate(said))), m)).collect()
    for x in out:
        assert x["spans"] == said[x["text"]], x["text"]
        assert all(s in x["spans"].split(",") for s in base_by_force(x["text"]))
        want, at = "", 0
        for k, a, b in (s.split(":") for s in x["spans"].split(",") if s):
            want, at = want + x["text"][at : int(a)] + f"[{k.upper()}]", int(b)
        assert x["redacted"] == want + x["text"][at:]
    assert pii.mark_spans(table(spark, docs), m).where("n_added > 0").count() == 0  # clean texts stay clean
    assert pii.fit(table(spark, [])).bars == (math.inf,) * 4


def test_pii_plan_is_native(spark, model):
    plan = pii.mark_spans(table(spark, [(1, "a@b.de")]), model[0])._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_platt_bar():
    r = np.random.default_rng(1)
    m = r.normal(size=20_000) * 2
    y = (r.random(20_000) < 1 / (1 + np.exp(-(1.5 * m - 1)))).astype(float)
    assert pii.platt_bar(m, y, 0.9) == pytest.approx((math.log(9) + 1) / 1.5, abs=0.1)
    assert pii.platt_bar(m, np.ones(len(m)), 0.9) == math.inf


# Lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))


def ranked_by_force(docs, items, k=20):
    counts = [Counter(TERM.findall(low(t))) for _, t in docs]
    size = [sum(c.values()) for c in counts]
    n_docs, n_terms = sum(n > 0 for n in size), sum(size)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        asked = TERM.findall(low(text))
        scored = []
        for (i, _), c, n in zip(docs, counts, size, strict=True):
            m = 75 + 25 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in asked if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard", [(65_536, 1_000_000), (7, 40)])
def test_search(spark, monkeypatch, shard):
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard[0])
    monkeypatch.setattr(lexical, "SHARD_POSTINGS", shard[1])
    docs, items = words_table()
    asked = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")
    for k, how in ((20, {}), (3, {"block": 5}), (5, {"most_terms": 3})):
        got = lexical.search_documents(table(spark, docs), asked, k=k, **how)
        assert sorted(map(tuple, got.collect()), key=str) == ranked_by_force(docs, items, k)
    none = lexical.search_documents(table(spark, []), asked)
    assert none.count() == 0 and lexical.search_documents(table(spark, docs), asked.limit(0)).count() == 0
    assert lexical.search_documents(table(spark, [(1, None)]), asked).count() == 0


def test_block_ends_are_cheapest():
    """The chosen partition costs what the best of all partitions does."""
    r = np.random.default_rng(2)
    lists = [(np.sort(r.choice(3 * n, n, False)), r.integers(1, 1000, n).astype(np.int64) ** 2) for n in (1, 2, 9, 14, 14)] + [(np.arange(11), np.full(11, 5, np.int64))]

    def cost(d, s, ends, fixed):
        a = np.r_[0, ends]
        return sum(int(s[i:j].max() * (d[j - 1] + 1 - d[i]) - s[i:j].sum()) + fixed for i, j in zip(a[:-1], a[1:], strict=True))

    for longest in (3, 64):
        for (d, s), ends in zip(lists, lexical.block_ends(lists, longest, 0.5), strict=True):
            fixed, n, best = max(1, int(0.5 * s.sum() / len(s))), len(s), math.inf
            for mask in range(1 << (n - 1)):
                e = [i + 1 for i in range(n - 1) if mask >> i & 1] + [n]
                if max(np.diff([0, *e])) <= longest:
                    best = min(best, cost(d, s, e, fixed))
            assert ends[-1] == n and max(np.diff(np.r_[0, ends])) <= longest and cost(d, s, ends, fixed) == best


def test_blocks_are_skipped(spark, monkeypatch):
    """Most documents of a shard are never scored once a few good ones are known, and the result is exact all the same."""
    docs = [(i, "common " * (1 + i % 3) + ("rare " * 5 if i % 400 == 0 else "") + f"u{i} " * (5 + i % 40)) for i in range(8000)]
    index = lexical.build_index(table(spark, docs, 1), terms=frozenset([b"common", b"rare"]))
    row = index.collect()[0].asDict()
    stats = lexical.corpus_stats(index, [b"common", b"rare"])
    shard, best, scored = lexical.Shard({**row, "terms": [bytes(t) for t in row["terms"]]}, stats, {t: stats.weight(t) for t in (b"common", b"rare")}), lexical.Best(10), []
    add = lexical.Best.add
    monkeypatch.setattr(lexical.Best, "add", lambda self, s, i, n: (scored.append(len(s)), add(self, s, i, n))[1])
    shard.search([(b"common", 1), (b"rare", 1)], best, batch=16)
    want = [x[2] for x in sorted(ranked_by_force(docs, [(0, "common rare")], 10), key=lambda x: x[1])]
    assert best.id.tolist() == want and sum(scored) < 500


# Importance resampling


def drawn_by_force(docs, target, percent=5, least=20):
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def features(t):
        w = rx.findall(low(t))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    rows = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in rows for b in f), Counter(b for x in target for b in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in range(10_000)]
    out = []
    for i, n, f in rows:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        out.append([i, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    for r, x in enumerate(fit[: percent * len(fit) // 100], 1):
        x[5] = r
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize(("long", "chunk"), [(65_536, 4096), (200, 7), (1, 1)])
def test_resample(spark, monkeypatch, long, chunk):
    monkeypatch.setattr(resampling, "LONG", long)
    monkeypatch.setattr(resampling, "AT_ONCE", 500)
    docs, items = words_table()
    df, target = table(spark, docs), spark.createDataFrame([(t,) for _, t in items], "text string")
    out = resampling.resample(df, target, percent=20, chunk=chunk)
    assert out.columns == ["doc_id", "text", "source", "spans", *resampling.OUT]
    got = sorted(((x["doc_id"], *(x[c] for c in resampling.OUT)) for x in out.collect()), key=str)
    assert got == drawn_by_force(docs, [t for _, t in items], 20)
    assert resampling.resample(df, target.limit(0)).count() == len(docs) and resampling.resample(table(spark, []), target).count() == 0


def test_equal_scores(spark):
    """A third of the table is one repeated row: equal scores and ids all get ranks of their own."""
    docs = [(7, "a b c d e f g h i j k l m n o p q r s t u v")] * 40 + [(i, f"z{i} " * 25) for i in range(80)]
    got = resampling.resample(table(spark, docs, 5), spark.createDataFrame([("a b c d",)], "text string"), percent=50)
    assert sorted(((x["doc_id"], *(x[c] for c in resampling.OUT)) for x in got.collect()), key=str) == drawn_by_force(docs, ["a b c d"], 50)
    assert sorted(x["rank"] for x in got.collect() if x["rank"]) == list(range(1, 61))


def test_carried_checksums():
    r = random.Random(6)
    pairs = [(r.randbytes(r.randrange(0, 9)), r.randbytes(n)) for n in (0, 1, 5, 64, 65, 66, 67, 300, 70_001) for _ in range(5)]
    got = resampling.carried(np.array([zlib.crc32(a) for a, _ in pairs], np.uint32), np.array([len(b) for _, b in pairs]))
    assert [int(x) ^ zlib.crc32(b) for x, (_, b) in zip(got, pairs, strict=True)] == [zlib.crc32(a + b) for a, b in pairs]


def test_queries(spark, tmp_path):
    """The registered queries on a small folder: columns and rows as asked for."""
    docs, items = words_table(5)
    docs = [(i, t) for i, t in docs if i is not None] + [(9001, "mail a@b.de or call +1 (017) 555-7713")]
    items = [(i, t) for i, t in items if i is not None]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = QUERIES["op12_lexical_search"](spark, str(tmp_path))
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and sorted(map(tuple, got.collect()), key=str) == ranked_by_force(docs, items)
    got = QUERIES["op13_importance_resampling"](spark, str(tmp_path))
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((x[:1] + x[2:] for x in drawn_by_force(docs, [t for _, t in items])), key=str)
    got = QUERIES["op11_pii_spans"](spark, str(tmp_path))
    assert got.columns[:7] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    text = dict(docs)
    for x in got.collect():
        base = base_by_force(text[x["doc_id"]])
        assert x["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(x["spans"].split(",")) | {""}
