"""The registered queries, columns and digests included, against brute force over a small folder of tables."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
from test_corpus import cheapest, groups_of, level, measures, near, reference_fingerprint, rows_of, rules_by_force

from gridloom.llm import chat, common, toxicity
from gridloom.llm.queries import ORACLES, QUERIES

RULES = ("com/en/", "example.com/en/7", "net/de/", "example.net/de/8", "org/es/")
ALLOW = {"example.com/en/7", "net/de/"}


def texts():
    """(doc_id, text, source): copies, near copies, nulls, marks, many languages of characters, a long text."""
    r = random.Random(17)
    vocab = [f"{a}{b}{c}" for a in "bdgklmn" for b in "aeiouéü" for c in "lmnrst"]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    base = [say(r.randrange(60, 260)) for _ in range(40)]
    rows = [None, "", " \n\t", "one", "one two", "# * | <a> " * 40, say(3000) + "\n" + say(40), "É é\x0bΣ\u0558x \u0c5c " + say(60), "line a b c\n" * 30 + say(55)]
    rows += base + [base[3], base[3], base[8], None]
    for i in range(25):
        t = base[i].split(" ")
        for _ in range(len(t) // [12, 30, 60][i % 3]):
            t[r.randrange(len(t))] = r.choice(vocab)
        rows.append(" ".join(t))
    r.shuffle(rows)
    return [(3 * k + 1, t, [None, "a", "b", "b", "c"][r.randrange(5)]) for k, t in enumerate(rows)]


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    docs = texts()
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    r = random.Random(5)
    made = [(i, f"http://{r.choice(['a', 'B', 'win'])}.Example.{r.choice(['com', 'net', 'org'])}/{r.choice(['en', 'de', 'es'])}/{i}{r.choice(['', '/', '.html', '?x=1', '#f', '?bet=2'])}") for i, _, _ in docs]
    urls = [(docs[-1 - k][0], u) for k, (_, u) in enumerate(made)]  # page k is not document k's
    urls += [(1000, None), (1001, "no scheme"), (1002, "x://h"), (1003, "a://b://example.net/de/8?z"), (1004, "http://example.com/en/7/" + "y" * 50_000)]
    spark.createDataFrame([(i, u, "<p>") for i, u in urls], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    known = dict(made)
    labels = [(i, int(not ("win" in known[i] and r.random() < 0.95)), int(r.random() < 0.1)) for i, _, _ in docs]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    turns = [(c, k, r.choice(["user", "assistant", "assistant", "system", "bot", None]), r.choice(["hi", "yo\nyes", "", None, "é" * 40])) for c in range(40) for k in range(r.randrange(1, 7))]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(4).write.parquet(f"{d}/conversations.parquet")
    return str(d), docs, urls, labels, turns


def test_op1(spark, data):
    d, _, urls, labels, _ = data
    tag = {i: q == 0 or t == 1 for i, q, t in labels}

    def tokens_of(url):
        m = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", url or "")
        if not m:
            return set()
        host, path, query = m[2].lower(), m[3].lower(), (m[4] or "").lower()
        labels_ = host.split(".")
        names = [x.split("=")[0] for x in query.split("&")]
        return {f"h:{x}" for x in [*labels_, *(y for z in labels_ for y in z.split("-"))] if x} | {f"p:{x}" for x in path.split("/") if x and not re.match(r"^[0-9]+(\.[a-z]+)?$", x)} | {f"q:{x}" for x in names if x}

    number = lambda u: re.search(r"://[^?#]*/([0-9]+)(?:\.[A-Za-z]+)?/?(?:[?#]|$)", u or "")
    known = [(tokens_of(u), tag[int(m[1])]) for _, u in urls if (m := number(u)) and int(m[1]) in tag]
    by_page = [(tokens_of(u), tag[i]) for i, u in urls if i in tag and u is not None]
    assert ("h:win",) not in rules_by_force(by_page, 5, 0.6, 3, 0.05)  # the association is there by the URL's number only
    rules = rules_by_force(known, 5, 0.6, 3, 0.05)
    assert ("h:win",) in rules
    got = {x["page_id"]: x for x in rows_of(QUERIES["op1_url_rules"](spark, d))}
    assert len(got) == len(urls)
    for i, u in urls:
        _, sep, rest = (u or "").partition("://")
        host, path = (re.split(r"[/?#]", rest)[0], re.split(r"[?#]", rest)[0]) if sep else ("", "")
        path = path[len(host) :]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [x for x in RULES if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith(x[x.index("/") :])]
        rule = max(fits, key=len, default=None)
        blocked = any(set(x) <= tokens_of(u) for x in rules)
        want = (host, path, rule, ("allow" if rule in ALLOW else "block") if rule else "block" if blocked else "allow")
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == want, u


def test_op2(spark, data):
    d, docs, _, labels, _ = data
    got = {x["doc_id"]: x for x in rows_of(QUERIES["op2_toxicity"](spark, d))}
    assert set(got) == {i for i, _, _ in docs} and set(next(iter(got.values()))) == {"doc_id", "severity", "grade", "toxic"}
    assert all(0 <= x["severity"] <= 2 and x["toxic"] == (x["grade"] > 0) for x in got.values())


def test_op2_by_force(spark, tmp_path):
    """The query's vocabulary, held-out split, cut and scores, made again without Spark."""
    r = random.Random(23)
    plain, rude = [f"w{k:02d}" for k in range(60)], ["grobian", "flegel", "luemmel"]
    docs, labels = [], []
    for i in range(900):
        t = [r.choice(plain) for _ in range(r.randrange(5, 40))]
        toxic = int(r.random() < 0.3)
        for _ in range(r.randrange(1, 4) if toxic else int(r.random() < 0.02)):
            t.insert(r.randrange(len(t)), r.choice(rude))
        docs.append((i, " ".join(t) if i else None))
        if i % 3:
            labels.append((i, int(r.random() < 0.6), toxic))
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    text = dict(docs)
    rows = [((2 - q) if x else 0, text[i] or "") for i, q, x in labels]
    sign = lambda v: v - (1 << 64) if v >> 63 else v
    mixed = lambda t: sign(xxhash.xxh64_intdigest((t).encode(), xxhash.xxh64_intdigest((6).to_bytes(4, "little"), 42)))
    held = [mixed(t) % 5 == 0 for _, t in rows]

    def chosen(some):
        n, pos = len(some), sum(g > 0 for g, _ in some)
        d, a = Counter(), Counter()
        for g, t in some:
            for w in toxicity.tokens_of(t):
                d[w] += 1
                a[w] += g > 0
        chi = lambda w: (a[w] - d[w] * pos / n) ** 2 / (d[w] * pos / n * (1 - pos / n) * max(1 - d[w] / n, 1e-9))
        return {w: k for k, w in enumerate(sorted(w for w in d if d[w] >= 5 and round(chi(w), 9) >= 10.83))}

    def fitted(some, vocabulary):
        got = sorted((g, toxicity.features(t, vocabulary)) for g, t in some)
        return toxicity.fit_ordinal([x for _, x in got], np.array([g for g, _ in got]), vocabulary)

    vocabulary = chosen(rows)
    model = fitted(rows, vocabulary)
    others = [x for x, h in zip(rows, held, strict=True) if not h]
    part = chosen(others)
    trial = fitted(others, part)
    clean = sorted((1 / (1 + math.exp(trial.thresholds[0] - trial.weights[toxicity.features(t, part)].sum())) for (g, t), h in zip(rows, held, strict=True) if h and g == 0), reverse=True)
    floor = 1 / (1 + math.exp(min(trial.thresholds[0], model.thresholds[0])))
    cut = min(max(clean[int(0.01 * len(clean))], min(floor, 0.5)), 0.5)
    assert set(rude) <= set(vocabulary) and not set(plain) & set(vocabulary)
    found = 0
    for x in rows_of(QUERIES["op2_toxicity"](spark, str(tmp_path))):
        p = [1 / (1 + math.exp(th - model.weights[toxicity.features(text[x["doc_id"]], vocabulary)].sum())) for th in model.thresholds]
        grade = (p[0] > cut) + (p[1] > 0.5)
        assert x["severity"] == pytest.approx(sum(p), abs=1e-6) and (x["grade"], x["toxic"]) == (grade, grade > 0)
        found += grade > 0
    assert found > 150


def test_ordinal_optimum():
    """The fit is the maximum of the penalised likelihood: no direction improves it, and plain descent ends there."""
    r = np.random.default_rng(4)
    x = [sorted(set(r.integers(0, 12, r.integers(1, 6)).tolist())) for _ in range(300)]
    true = r.normal(0, 1.5, 12)
    grade = np.array([int(true[i].sum() + r.logistic() > -0.5) + int(true[i].sum() + r.logistic() > 1.5) for i in x])
    m = toxicity.fit_ordinal(x, grade, {str(k): k for k in range(12)}, ridge=1.0, steps=4000)

    def loss(w, th):
        score = np.array([w[i].sum() for i in x])
        z = score[:, None] - th
        yes = grade[:, None] > np.arange(2)
        return np.where(yes, np.logaddexp(0, -z), np.logaddexp(0, z)).sum() + 0.5 * (w**2).sum()

    best = loss(m.weights, m.thresholds)
    for k in range(14):
        for step in (-1e-3, 1e-3):
            p = np.r_[m.weights, m.thresholds]
            p[k] += step
            assert loss(p[:12], p[12:]) > best - 1e-4
    p, h = np.r_[np.zeros(12), -0.5, 0.5], 1e-5
    for _ in range(1500):
        g = np.array([(loss(*(np.split(p + h * e, [12]))) - loss(*(np.split(p - h * e, [12])))) / (2 * h) for e in np.eye(14)])
        p = p - 0.01 * g
        if np.abs(g).max() < 1e-2:
            break
    assert np.allclose(p, np.r_[m.weights, m.thresholds], atol=0.02)


def test_op2_scores(spark):
    """Severity is the sum of P(grade > k) over the features that a text has, found one by one."""
    m = toxicity.OrdinalModel({"bad": 0, "bad#2": 1, "awful": 2, "awful*": 3}, np.array([1.0, 0.5, 2.0, 0.25]), np.array([0.5, 1.5]), cut=0.4)
    cases = {"bad": 1.0, "BAD, bad!": 1.5, "awfully": 0.25, "": 0.0, None: 0.0, "bad " * 5000: 1.5, "bad awful": 3.0}
    df = spark.createDataFrame([(t, 1) for t in cases for _ in range(2)], "text string, severity int")
    got = rows_of(toxicity.score(df, m))
    assert len(got) == 2 * len(cases)
    for x in got:
        p = 1 / (1 + np.exp(m.thresholds - cases[x["text"]]))
        assert abs(x["severity"] - p.sum()) < 1e-8 and x["grade"] == (p > [0.4, 0.5]).sum() and x["toxic"] == (x["grade"] > 0)
    assert rows_of(toxicity.score(df.limit(0), m)) == []


def ids_of(name, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda x: np.array(t.encode(x or "", add_special_tokens=False).ids + [end], "<u4")


def test_op3(spark, data):
    d, docs = data[:2]
    encode, at = ids_of("byte_bpe_50k.json", 0), 0
    got = {x["doc_id"]: x for x in rows_of(QUERIES["op3_token_store"](spark, d))}
    assert len(got) == len(docs)
    for i, t, _ in sorted(docs):
        ids = encode(t)
        assert got[i] == {"doc_id": i, "start": at, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes())}
        at += len(ids)


def mixed(docs):
    """(doc_id, size, source size, target, taken), by cutting each source in hash order."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in docs}
    total = Counter()
    for i, _, s in docs:
        total[s] += size[i]
    goal = level(total, (3, 1, 2), 1.5, 2)
    out = {}
    for s in total:
        budget = int(goal[s] + 0.5)
        passes, rest = divmod(budget, total[s]) if total[s] else (0, 0)
        for i in sorted((i for i, _, x in docs if x == s), key=lambda i: hashlib.md5(f"7:{i}:{size[i]}".encode()).hexdigest()):
            part = min(rest, size[i])
            out[i] = (size[i], total[s], goal[s], passes * size[i] + part)
            rest -= part
    return out


def test_op4(spark, data):
    d, docs = data[:2]
    got = rows_of(QUERIES["op4_source_mix"](spark, d))
    want = mixed(docs)
    assert len(got) == len(want)
    for x in got:
        size, total, goal, taken = want[x["doc_id"]]
        assert (x["size"], x["source_size"], x["taken"]) == (size, total, taken) and abs(x["target"] - goal) < 1e-6


def test_op5(spark, data):
    d, turns = data[0], data[4]
    got = defaultdict(list)
    for x in rows_of(QUERIES["op5_chat_format"](spark, d)):
        got[x["conv_id"]].append(x)
    for c in {t[0] for t in turns}:
        rows = sorted(got[c], key=lambda x: x["position"])
        mine = sorted((t for t in turns if t[0] == c), key=lambda t: t[1])
        assert [x["position"] for x in rows] == list(range(len(rows)))
        assert [(x["turn"], x["text"]) for x in rows if x["action"] != "insert"] == [(k, t or "") for _, k, _, t in mine]
        cost, state, roles, said = 0, 0, iter(mine), ""
        for x in rows:
            role = chat.ROLES.index(x["role"])
            if x["action"] == "insert":
                cost += 3
            else:
                cost += (x["action"] == "merge") + 2 * (next(roles)[2] != x["role"])
            assert role == state if x["action"] == "merge" else role in chat.LEGAL[state]
            said += ("\n" if x["action"] == "merge" else ("<|end|>\n" if state else "") + f"<|{x['role']}|>\n") + x["text"]
            state = role
        assert state == chat.FINAL and "".join(x["rendered"] for x in rows) == said + "<|end|>\n"
        assert cost == cheapest([chat._code(t[2]) for t in mine])


def test_op6(spark, data):
    d, docs = data[:2]

    def shard(i, n):
        def h(k):
            x = 42
            for value, width in ((11, 4), (k, 4), (i, 8)):
                x = xxhash.xxh64_intdigest(value.to_bytes(width, "little", signed=True), x)
            return x - (1 << 64) if x >> 63 else x

        return max(range(n), key=lambda k: (h(k), k))

    got = {x["doc_id"]: x for x in rows_of(QUERIES["op6_shards"](spark, d))}
    assert len(got) == len(docs)
    for i, t, _ in docs:
        b = (t or "").encode()
        want = {"doc_id": i, "size": len(b) + 1, "text_crc32": zlib.crc32(b), "law": "key", "shard": shard(i, 8), "grown_shard": shard(i, 9)}
        assert {k: got[i][k] for k in want} == want
    for s in range(8):
        assert sorted(x["slot"] for x in got.values() if x["shard"] == s) == list(range(sum(x["shard"] == s for x in got.values())))


def test_op7(spark, data):
    d, docs = data[:2]
    got = {x["doc_id"]: x for x in rows_of(QUERIES["op7_quality_rules"](spark, d))}
    for i, t, _ in docs:
        m = measures(t)
        x = got[i]
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_lines"], x["n_dup_lines"], x["n_repeat_words"]) == m
        assert x["base_failed"] == (m[0] < 50 or 100 * m[5] > 50 * m[0]) and not (x["base_failed"] and x["kept"])


def test_op8(spark, data):
    d, docs = data[:2]
    got = {x["doc_id"]: x for x in rows_of(QUERIES["op8_exact_dedup"](spark, d))}
    for i, t, _ in docs:
        same = [j for j, u, _ in docs if (u or "") == (t or "")]
        assert got[i] == {"doc_id": i, "keep_id": max(same), "group_size": len(same), "kept": i == max(same), "text_sha256": hashlib.sha256((t or "").encode()).hexdigest()}


def check_pieces(rows, docs, capacity=2048):
    """``docs`` are (doc_id, text), perhaps repeated; every id in one piece, no padding but at powers of two."""
    encode, have, seqs = ids_of("word_bpe_49k.json", 1), defaultdict(list), defaultdict(list)
    for x in rows:
        have[x["doc_id"], x["doc_tokens"]].append(x)
        seqs[x["sequence_id"]].append((x["offset"], x["length"]))
    want = Counter()
    for i, t in docs:
        ids = encode(t)
        want[i, len(ids)] += len(ids)
        crc = {zlib.crc32(ids[x["start"] : x["start"] + x["length"]].tobytes()) for x in have[i, len(ids)]}
        assert crc <= {x["ids_crc32"] for x in have[i, len(ids)]}
    assert want == Counter({k: sum(x["length"] for x in v) for k, v in have.items()})
    for v in seqs.values():
        v.sort()
        assert [o for o, _ in v] == [sum(n for _, n in v[:k]) for k in range(len(v))]
        n = sum(n for _, n in v)
        assert n == capacity or n < capacity and n & (n - 1) == 0


def test_op9(spark, data):
    d, docs = data[:2]
    rows = rows_of(QUERIES["op9_packing"](spark, d))
    check_pieces(rows, [(i, t) for i, t, _ in docs])
    encode = ids_of("word_bpe_49k.json", 1)
    text = {i: t for i, t, _ in docs}
    for x in rows:
        ids = encode(text[x["doc_id"]])
        assert x["doc_tokens"] == len(ids) and x["ids_crc32"] == zlib.crc32(ids[x["start"] : x["start"] + x["length"]].tobytes())


def test_op10(spark, data):
    d, docs = data[:2]
    fp = [reference_fingerprint(t) for _, t, _ in docs]
    g = groups_of(docs, lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    got = {x["doc_id"]: x for x in rows_of(QUERIES["op10_simhash"](spark, d))}
    for k, (i, _, _) in enumerate(docs):
        assert got[i]["fingerprint"] == f"{fp[k]:016x}" and got[i]["component_id"] == min(docs[j][0] for j in range(len(docs)) if g[j] == g[k])


def test_whole_pipeline(spark, data):
    import corpus_pipeline

    d, docs = data[:2]
    kept = []
    for i, t, s in docs:
        words, chars, symbols, lines, dup, rep = measures(t)
        if words >= 50 and 100 * rep <= 50 * words and 2 * symbols <= 3 * words and 2 * dup <= lines and 2 * words <= chars <= 20 * words:
            kept.append((i, t, s))
    once = [x for x in kept if x[0] == min(i for i, t, _ in kept if t == x[1])]
    g = groups_of(once, lambda a, b: near(once[a][1], once[b][1]))
    left = [x for k, x in enumerate(once) if x[0] == min(once[j][0] for j in range(len(once)) if g[j] == g[k])]
    assert len(docs) > len(kept) > len(once) > len(left) > 20
    out = []
    mix = mixed(left)
    for i, t, _ in left:
        size, _, _, taken = mix[i]
        out += [(i, t)] * (taken // size)
        if taken % size:
            out.append((i, " ".join(re.findall(r"[^\x20\x09-\x0D]+", t)[: taken % size])))
    rows = rows_of(corpus_pipeline.run(spark, d))
    for x in rows:
        x["ids_crc32"] = zlib.crc32(bytes(x["ids"]))
    check_pieces(rows, out)
    # Every stage by itself on an empty table and on columns that clash.
    table = spark.read.parquet(f"{d}/documents.parquet")
    clash = table.selectExpr("*", "1 AS size", "'x' AS kept", "2 AS _row", "3 AS target", "4 AS failures", "5 AS n_words", "6 AS root", "7 AS node")
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, clash.limit(0), d)
        assert none.count() == 0
        if name != "packing":
            full = stage(spark, clash, d)
            assert none.columns == full.columns == clash.columns and full.count() > 20


def test_null_ids_in_stages(spark):
    import corpus_pipeline

    r = random.Random(3)
    t = " ".join(f"w{r.randrange(900)}" for _ in range(90))
    rows = [(None, t, "s"), (None, t, "s"), (4, t, None), (4, t, None), (5, t + " more", "s"), (None, None, None), (7, "w " * 200_000, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = []
    for _, stage in corpus_pipeline.STAGES:
        sizes.append(stage(spark, docs, "").count())
    assert sizes[:3] == [5, 4, 3] and sizes[3] > 0 and sizes[4] >= 7


def test_one_row_repeated(spark):
    """A third of the rows of one id and text spread over the buckets of their shard."""
    from gridloom.llm import sharding

    rows = spark.range(100_000).selectExpr("if(id % 3 = 0, -1, id) AS doc_id", "if(id % 3 = 0, 'same text', concat('t', id)) AS text")
    got = sharding.shuffle_into_shards(rows, bucket_bytes=1 << 14).select("doc_id", "shard", "slot")
    assert got.count() == 100_000 and got.distinct().count() == 100_000
    s = got.where("doc_id = -1").agg({"shard": "max"}).first()[0]
    own = sorted(x["slot"] for x in got.where(f"shard = {s}").collect())
    assert own == list(range(len(own))) and len(own) > 33_000


def test_queries_and_oracles():
    assert {k.split("_")[0] for k in QUERIES} == {f"op{n}" for n in range(1, 14)} and set(ORACLES) <= set(QUERIES)


def test_tables_are_released(spark, data):
    QUERIES["op3_token_store"](spark, data[0]).count()
    paths = common.written_so_far(spark)
    assert any(p.endswith("-store") for p in paths)
    common.release(spark)
    assert not any(Path(p.removeprefix("file://")).exists() for p in paths) and common.written_so_far(spark) == []
