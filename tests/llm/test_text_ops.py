"""Operators of the text subpackage against brute force, on small fixtures.

Each fixture holds nulls in every column, empty and long texts, ties, repeated
rows and columns whose names clash with the results'.
"""

import base64
import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolens.llm import (
    op1_shards,
    op2_jaccard,
    op3_leaks,
    op4_languages,
    op5_urls,
    op6_pieces,
    op7_substrings,
    op8_html,
    op9_warc,
    op10_quality,
)
from chronolens.llm import _words

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=120, seed=3):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    passage = [rng.choice(vocab) for _ in range(70)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 4, 5, 20, 60, 200]))]
        if i % 5 == 0:
            at = rng.randint(0, len(words))
            words[at:at] = passage
        sep = rng.choice([" ", "\n", "  ", "\t"])
        rows.append((i, sep.join(words), rng.choice(["en", "fr", None]), "s", 1))
    for i in range(n, n + 40):  # copies and near copies
        words = (rows[i % n][1] or "").split()
        for _ in range(rng.randint(0, 3)):
            if words:
                words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((i, " ".join(words), "en", "s", 2))
    rows += [(n + 50, None, None, None, None), (None, " ".join(passage), "en", None, None), (n + 51, "", "en", "s", 0), (n + 52, " \n ", "fr", "s", 3)]
    rows += [(n + 53, "word " * 3000, "en", "s", 1), rows[5], rows[5]]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# -- words -------------------------------------------------------------------


@pytest.mark.parametrize("piece", [1 << 20, 64])
def test_words(rows, piece, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(_words, "PIECE", piece)
    texts = [r[1] for r in rows]
    raw, offsets = _words.text_buffers(pa.array(texts))
    w = _words.words_of(raw, offsets)
    seen = {}
    for i, t in enumerate(texts):
        a, b = w.first[i], w.first[i + 1]
        assert [bytes(raw[x:y]).decode() for x, y in zip(w.start[a:b], w.end[a:b])] == WORD.findall(t or "")
        for x, h in zip(WORD.findall(t or ""), w.hash[a:b].tolist()):
            assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)


# -- 1 -----------------------------------------------------------------------


def test_shards(spark, docs, rows):
    for n, shards in ((len(rows), 16), (len(rows), 1), (3, 16)):
        df = docs.withColumn("shard", F.lit("x")).withColumn("_row", F.lit(1)).limit(n)
        got = op1_shards.shard(df, shards, range_bytes=100).collect()
        assert len(got) == n
        assert "_row" in got[0].asDict()
        slots = {}
        for r in got:
            slots.setdefault(r["shard"], []).append(r["slot"])
        sizes = [len(slots.get(s, [])) for s in range(shards)]
        assert max(sizes) - min(sizes) <= 1
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        key = lambda r: (str(r["doc_id"]), str(r["text"]))
        if n == len(rows):
            assert sorted(map(key, got)) == sorted((str(r[0]), str(r[1])) for r in rows)
    assert op1_shards.shard(empty(spark), 4).columns == [*empty(spark).columns, "shard", "slot"]
    assert op1_shards.shard(empty(spark), 4).count() == 0


def test_shard_matrix_is_exact_and_uniform():
    counts, cells = np.array([5, 0, 7, 12]), np.array([8, 8, 8])
    mean = np.zeros((4, 3))
    for seed in range(400):
        m = np.array([op1_shards.matrix_row(seed, counts, cells, i) for i in range(4)])
        assert (m.sum(1) == counts).all() and (m.sum(0) == cells).all()
        mean += m
    assert np.abs(mean / 400 - counts[:, None] / 3).max() < 0.35
    rng = np.random.Generator(np.random.PCG64(0))
    big = [op1_shards.hypergeometric(rng, 10**10, 10**10, 10**6) for _ in range(200)]
    assert abs(np.mean(big) - 5e5) < 200 and 350 < np.std(big) < 650


def test_shuffle_is_uniform():
    """Whole arrangements of small tables: all as frequent as the uniform law says."""
    from itertools import permutations

    for counts in ([2, 2], [1] * 6, [3, 0, 1]):  # 6 partitions: tree nodes and partitions with equal numbers
        rows = [(i, k) for i, c in enumerate(counts) for k in range(c)][: sum(counts)]
        n, seen = len(rows), {}
        sizes = np.array([n - n // 2, n // 2])
        draws = 240 if n == 4 else 7200
        for seed in range(draws):
            dealt = [op1_shards.deal_rows(seed, np.array(counts), sizes, i) for i in range(len(counts))]
            order = tuple(sorted(range(n), key=lambda r: (dealt[rows[r][0]][0][rows[r][1]], dealt[rows[r][0]][1][rows[r][1]])))
            assert [sum(d[0].tolist().count(s) for d in dealt) for s in (0, 1)] == sizes.tolist()
            seen[order] = seen.get(order, 0) + 1
        every = list(permutations(range(n)))
        each = draws / len(every)
        chi = sum((seen.get(p, 0) - each) ** 2 / each for p in every)
        assert chi < len(every) - 1 + 4.5 * (2 * (len(every) - 1)) ** 0.5


# -- 2 -----------------------------------------------------------------------


def shingles(text):
    w = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard_brute(rows):
    sets = [shingles(r[1]) for r in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted((str(r[0]), len(sets[i]), str(least.get(root(i)))) for i, r in enumerate(rows))


def test_jaccard(spark, docs, rows):
    got = op2_jaccard.jaccard_components(docs.withColumn("_n", F.lit(1)).withColumn("n_shingles", F.lit("x")))
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got.collect()) == jaccard_brute(rows)
    assert op2_jaccard.jaccard_components(empty(spark)).count() == 0


def test_jaccard_unsettled_tiles(spark):
    """Chains whose links the hub of a tile does not have."""
    rng = random.Random(5)
    rows, i = [], 0
    for _ in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        for _ in range(12):
            at = rng.randrange(len(words))
            words[at] = f"w{rng.randrange(10**6)}"
            rows.append((i, " ".join(words), "en", "s", 1))
            i += 1
    got = op2_jaccard.jaccard_components(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got.collect()) == jaccard_brute(rows)


def test_jaccard_bounds():
    rng = random.Random(1)
    for _ in range(200):
        pool = np.array([rng.getrandbits(64) for _ in range(60)], np.uint64)
        a = np.unique(pool[[rng.random() < 0.8 for _ in pool]])
        b = np.unique(pool[[rng.random() < 0.8 for _ in pool]])
        for x, y in ((a, b), (np.unique(a[:, None] + np.arange(40, dtype=np.uint64)), np.unique(b[:, None] + np.arange(40, dtype=np.uint64)))):
            for u, v in zip(op2_jaccard.signature(x), op2_jaccard.signature(y)):
                if u is not None and v is not None and len(u) == len(v):
                    unequal = int(np.bitwise_count((u ^ v).view(np.uint64)).sum())
                    assert unequal <= len(np.setxor1d(x, y))


def test_bands_hold_all_sizes_that_may_link():
    n = np.arange(1, 5000)
    for x in (1, 2, 3, 4, 7, 50, 51, 1234, 4000):
        near = op2_jaccard.may_link(n, x)
        assert np.abs(op2_jaccard.band(n[near]) - op2_jaccard.band(x)).max() <= 1


def test_jaccard_hot_shingle(spark, monkeypatch):
    """One run of words in most texts, of many sizes, in more ranges than tasks."""
    monkeypatch.setattr(op2_jaccard, "RANGE_ENTRIES", 40)
    monkeypatch.setattr(op2_jaccard, "HELD_ENTRIES", 50)
    monkeypatch.setattr(op2_jaccard, "TILE_ROWS", 8)
    rng = random.Random(11)
    hot = [f"h{i}" for i in range(12)]
    rows = []
    for i in range(150):
        rows.append((i, " ".join(hot + [f"w{rng.randrange(60)}" for _ in range(rng.randrange(9))]), "en", "s", 1))
    got = op2_jaccard.jaccard_components(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got.collect()) == jaccard_brute(rows)


def test_jaccard_large_sets(spark):
    """Sets beyond the narrow bitmaps, in bands of different widths, near the threshold."""
    rng = random.Random(9)
    rows, i = [], 0
    for size in (500, 530, 1000, 1060, 2100):
        base = [f"w{rng.randrange(10**7)}" for _ in range(size)]
        for change in (0, 6, 12, 14, 16, 20, 40, 150):
            words = list(base)
            for k in range(change):
                words[(k * size // max(1, change) + 7) % size] = f"x{rng.randrange(10**7)}"
            rows.append((i, " ".join(words[: size - change % 7]), "en", "s", 1))
            i += 1
    got = op2_jaccard.jaccard_components(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got.collect()) == jaccard_brute(rows)


# -- 3 -----------------------------------------------------------------------


def distance(a, b):
    p = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return min(p)


def test_leaks(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    items = [(k, " ".join(word() for _ in range(rng.randint(6, 25)))) for k in range(15)]
    items += [(15, items[0][1]), (None, items[1][1]), (16, None), (17, ""), (18, "ab"), (19, "Cab-bage"), (20, "!?")]
    rows = []
    for i in range(60):
        text = [word() for _ in range(40)]
        if i % 2:
            s = list(rng.choice(items[:15])[1])
            for _ in range(rng.randint(0, 12)):
                at = rng.randrange(len(s))
                s[at : at + 1] = rng.choice([[], ["x"], [s[at], "q"]])
            text[20:20] = ["".join(s).upper() + "!!"]
        rows.append((i, " ".join(text), "en", "s", 1))
    rows += [(70, None, None, None, None), (71, "", "en", "s", 0), (72, items[3][1], "en", "s", 0), rows[1]]
    rows += [(73, "xab aby", "en", "s", 1), (74, "a cab bage; AB", "en", "s", 1), (75, "z " * 40000 + items[2][1] + " y" * 40000, "en", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("leaks", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for r in op3_leaks.find_leaks(df, bench).collect():
        got.setdefault(r["doc_id"], set()).update((m["item_id"], m["distance"]) for m in r["leaks"])
    for r in rows:
        t = op3_leaks.normal(r[1])
        want = set()
        for k, item in items:
            p = op3_leaks.normal(item)
            if p and t and len(p) < op3_leaks.SHORT:
                if f" {p} " in f" {t} ":
                    want.add((k, 0))
            elif p and t:
                d = distance(p, t)
                if d <= int(op3_leaks.RATE * len(p)):
                    want.add((k, d))
        assert got[r[0]] == want, r[0]
    assert op3_leaks.find_leaks(empty(spark), bench).count() == 0
    assert all(not r["leaks"] for r in op3_leaks.find_leaks(df, bench.limit(0)).collect())


def test_leaks_tell_short_items(spark):
    bench = spark.createDataFrame([(0, "too short"), (1, ""), (2, None), (3, "a b c"), (4, "long enough to be searched")], "item_id long, text string")
    with pytest.warns(UserWarning, match="^2 benchmark items"):
        blocks = list(op3_leaks.item_blocks(bench, "item_id", "text", 20))
    assert [[i for i, _ in b] for b in blocks] == [[4]]
    blocks = list(op3_leaks.item_blocks(bench, "item_id", "text", op3_leaks.MIN_CHARS))
    assert [[i for i, _ in b] for b in blocks] == [[0, 3, 4]]


def test_leak_blocks(spark, monkeypatch):
    monkeypatch.setattr(op3_leaks, "BLOCK_CHARS", 30)
    bench = spark.createDataFrame([(i, f"this is item number {i} of the benchmark {i * 7}") for i in range(9)], "item_id long, text string")
    df = spark.createDataFrame([(i, f"x this is item number {i} of the benchmark {i * 7} y") for i in range(9)], "doc_id long, text string")
    df = df.union(df.where("doc_id = 3")).withColumn("_row", F.lit("x"))
    got = op3_leaks.find_leaks(df, bench, rate=0.02)
    assert got.columns == ["doc_id", "text", "_row", "leaks"] and got.count() == 10
    for r in got.collect():
        assert [m["item_id"] for m in r["leaks"]] == [r["doc_id"]]
    assert op3_leaks.find_leaks(df.limit(0), bench).count() == 0


# -- 4 -----------------------------------------------------------------------


def test_languages(spark):
    rng = random.Random(4)
    parts = {"en": ["the", "ing", "and", "er"], "fr": ["eau", "é", "oi", "que"], "de": ["sch", "ung", "ei", "ü"]}
    make = lambda l, n: " ".join("".join(rng.choice(parts[l]) for _ in range(3)) for _ in range(n))
    rows = [(i, make(l, rng.randint(3, 60)), l, "s", 1) for i, l in enumerate(rng.choice(list(parts)) for _ in range(400))]
    odd = [(500, None, "en", None, None), (501, "", "en", "s", 0), (502, "123 !!", "fr", "s", 0), (None, make("en", 9), "en", "s", 1), (503, make("fr", 9), None, "s", 1)]
    odd += [(504, make("en", 40) + " " + make("fr", 25), "en", "s", 1), (505, make("de", 20000), "de", "s", 1)]
    df = spark.createDataFrame(rows + odd, SCHEMA).withColumn("score", F.lit("x"))
    model = op4_languages.learn(df)
    assert model[0] == ["de", "en", "fr"]
    got = op4_languages.identify(df, model).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r["doc_id"]: r for r in got}
    for i in (500, 501, 502):
        assert by[i]["lang_pred"] == "und" and by[i]["score"] == 0
    assert by[503]["lang_pred"] == "fr" and by[505]["lang_pred"] == "de"
    assert set(by[504]["mixture"]) == {"en", "fr"} and 0.4 < by[504]["score"] < 0.8
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"] and r["lang_pred"] != "und"]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    # neither lang nor source nor the held-out rows take part
    blind = df.withColumn("lang", F.when(F.expr("crc32(encode(cast(doc_id as string), 'UTF-8')) % 5 = 0"), "xx").otherwise(F.col("lang")))
    assert np.array_equal(op4_languages.learn(blind)[1], model[1])
    none = op4_languages.identify(df, op4_languages.learn(empty(spark))).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}


def plain_mixture(p, c, steps=4000):
    """Expectation-maximisation n-gram by n-gram, in plain Python."""
    k = len(p)
    w = [1.0 / k] * k
    for _ in range(steps):
        share = [0.0] * k
        for g, n in enumerate(c):
            total = sum(w[j] * p[j][g] for j in range(k))
            for j in range(k):
                share[j] += n * w[j] * p[j][g] / total
        w = [x / sum(c) for x in share]
    return w, sum(n * np.log(sum(w[j] * p[j][g] for j in range(k))) for g, n in enumerate(c))


def test_mixtures_by_plain_em():
    rng = np.random.Generator(np.random.PCG64(12))
    for truth in ([1.0, 0.0, 0.0], [0.5, 0.5, 0.0], [0.2, 0.3, 0.5], [0.0, 0.85, 0.15]):
        p = rng.dirichlet(np.full(30, 0.3), 3) * 0.99 + 0.01 / 30
        g = rng.choice(30, 900, p=np.array(truth) @ p)
        c = np.bincount(g, minlength=30).astype(float)
        want, like = plain_mixture(p.tolist(), c.tolist())
        got, found = op4_languages.em(p, c)
        assert found <= like + 1e-6 and found > like - 0.01
        assert np.abs(got - want).max() < 0.02
        # the set with the best penalised likelihood of all sets
        penalty = 0.5 * op4_languages.PENALTY * np.log(900)
        sets = [[j for j in range(3) if m >> j & 1] for m in range(1, 8)]
        best = max(sets, key=lambda s: plain_mixture(p[s].tolist(), c.tolist(), 400)[1] - penalty * (len(s) - 1))
        chosen, w = op4_languages.infer(p, np.log(p), g)
        assert sorted(chosen.tolist()) == best and abs(w.sum() - 1) < 1e-9


# -- 5 -----------------------------------------------------------------------


def verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = re.split(r"[?#]", url.split("://", 1)[1])[0]
        host, slash, path = rest.partition("/")
        path = slash + path
        host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    fit = [r for r in rules if host and (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fit, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2]), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


@pytest.mark.parametrize("bytes_", [8 << 20, 0])
def test_urls(spark, bytes_):
    rules = [*op5_urls.RULES, ("org", "/a", "block"), ("x.org", "/ab", "allow"), ("org", "", "allow"), ("x.org", "/ab", "block")]
    effective = {}
    for h, p, v in rules:
        effective[h, p] = max(v, effective.get((h, p), v))
    flat = [(h, p, v) for (h, p), v in effective.items()]
    urls = [None, "", "no scheme", "http://", "http://com/", "http://COM/x", "http://a.com", "http://WWW.Example.com/en/1?x=/fr/", "https://example.com/en", "ftp://m.example.com/en/#a"]
    urls += ["http://q.net/es/", "http://net/fr/x", "http://b.net/de/", "http://x.org/abc", "http://x.org/ac", "http://y.org?q", "http://a://b.com/", "http://xcom/", "http://x.org/ab\nc", "http://..com/"]
    urls += ["http://" + "a." * 60 + "q.net/es/" + "x/" * 20000, "http://a.net/" + "y" * 50000]
    df = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls + urls[:9])] + [(None, "http://a.com/", None)], "page_id long, url string, rule string")
    got = op5_urls.url_filter(df, spark.createDataFrame(rules, "host string, path string, verdict string"), broadcast_bytes=bytes_).collect()
    want = [(i, *verdict(u, flat)) for i, u in enumerate(urls + urls[:9])] + [(None, *verdict("http://a.com/", flat))]
    assert sorted(map(str, [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got])) == sorted(map(str, want))
    none = op5_urls.url_filter(df, spark.createDataFrame([], "host string, path string, verdict string")).collect()
    assert {(r["rule"], r["verdict"]) for r in none} == {(None, "allow")}
    assert op5_urls.url_filter(df.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


# -- 6 -----------------------------------------------------------------------


def test_pieces(spark, docs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=op6_pieces.default_model())
    odd = ["", None, " ", "   a  b ", "a▁b", "▁", "\x00a", "é\tü\n", "日本語 🙂", "a\n\nb\n", "<s> </s> <unk>", "ab" * 4000, " " * 40, "\n" * 9, "x\u200b y", "z" * 60 + " q"]
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string")).withColumn("ids", F.lit(0))
    for r in op6_pieces.encode_decode(df, op6_pieces.default_model()).collect():
        ids = lib.encode(r["text"] or "")
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["decoded"] == lib.decode(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert op6_pieces.encode_decode(empty(spark), op6_pieces.default_model()).count() == 0


def test_pieces_agendas_agree(monkeypatch):
    v, _ = op6_pieces.read_model(op6_pieces.default_model())
    rng = random.Random(0)
    words = ["".join(rng.choice("thenaiou▁") for _ in range(rng.randint(1, 30))) for _ in range(300)]
    flat = [op6_pieces.merge(v, w) for w in words]
    monkeypatch.setattr(op6_pieces, "FLAT", 0)
    assert [op6_pieces.merge(v, w) for w in words] == flat


# -- 7 -----------------------------------------------------------------------


def substring_brute(rows):
    words = [WORD.findall(r[1] or "") for r in rows]
    least = {}
    for r, w in zip(rows, words):
        if r[0] is not None:
            for i in range(len(w) - 49):
                k = tuple(w[i : i + 50])
                least[k] = min(least.get(k, r[0]), r[0])
    out = []
    for r, w in zip(rows, words):
        gone = set()
        for i in range(len(w) - 49):
            if r[0] is not None and least[tuple(w[i : i + 50])] < r[0]:
                gone.update(range(i, i + 50))
        out.append((str(r[0]), len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


def check_substrings(got, rows):
    """Rows against brute force, and each factor against the text of its source."""
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in got) == substring_brute(rows)
    texts = {}
    for r in rows:
        texts.setdefault(r[0], []).append(WORD.findall(r[1] or ""))
    for r in got:
        w = WORD.findall(r["text"] or "")
        covered = set()
        for f in r["factors"]:
            a, n, d, o = f["start"], f["words"], f["source_id"], f["source_start"]
            assert n >= 50 and d < r["doc_id"]
            assert any(w[a : a + n] == t[o : o + n] for t in texts[d])
            covered.update(range(a, a + n))
        assert covered == {j for s in r["spans"] for j in range(s["start"], s["start"] + s["words"])}
        assert len(covered) == r["n_removed"] == sum(s["words"] for s in r["spans"])


@pytest.mark.parametrize("hot", [256, 3, 0])
@pytest.mark.parametrize("block", [4 << 20, 2000])
def test_substrings(spark, docs, rows, block, hot, monkeypatch):
    monkeypatch.setattr(op7_substrings, "BLOCK_BYTES", block)
    monkeypatch.setattr(op7_substrings, "HOT", hot)
    monkeypatch.setattr(op7_substrings, "INDEX_WORDS", block // 4)
    check_substrings(op7_substrings.substring_dedup(docs.withColumn("_block", F.lit(1)).withColumn("kept", F.lit(1))).collect(), rows)
    assert op7_substrings.substring_dedup(empty(spark)).count() == 0


@pytest.mark.parametrize("hot", [256, 5])
def test_substrings_of_edited_copies(spark, hot, monkeypatch):
    """Copies with edits, periodic texts, and factors whose boundaries meet."""
    monkeypatch.setattr(op7_substrings, "HOT", hot)
    monkeypatch.setattr(op7_substrings, "BLOCK_BYTES", 6000)
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = []
    for i in range(60):
        words = list(base[rng.randrange(150) : 250 + rng.randrange(150)])
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(2)] = rng.choice([[], [f"x{rng.randrange(9)}"], base[40:100]])
        rows.append((rng.randrange(50), " ".join(words)))
    rows += [(60 + i, "a b c " * rng.randrange(10, 90)) for i in range(8)] + [(None, " ".join(base)), (1, None)]
    check_substrings(op7_substrings.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect(), rows)


def thue_morse(n):
    return "".join("ab"[i.bit_count() & 1] for i in range(n))


def collisions():
    """Texts that differ in one word, which a polynomial hash modulo 2**64 takes for the same."""
    words = [f"w{i}" for i in range(60)]
    rows = []
    for n in (16, 200, 1024, 2048, 4096):
        x = thue_morse(n)
        for y in (x, x.translate(str.maketrans("ab", "ba"))):
            rows.append((len(rows), " ".join([*words[:29], f"n{n}", y, *words[29:]]), "en", "s", 1))
    return rows


def test_words_that_collide_in_polynomial_hashes(spark):
    rows = collisions()
    df = spark.createDataFrame(rows, SCHEMA)
    check_substrings(op7_substrings.substring_dedup(df).collect(), rows)
    got = op2_jaccard.jaccard_components(df).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == jaccard_brute(rows)
    twice = [(i, a[1] + " " + b[1], "en", "s", 1) for i, (a, b) in enumerate(zip(rows[::2], rows[1::2]))]
    for r in op10_quality.quality(spark.createDataFrame(twice, SCHEMA), spark.createDataFrame([], "doc_id long, quality int")).collect():
        assert (r["n_words"], r["n_repeat_words"]) == (base_brute(r["text"])[0], base_brute(r["text"])[4])


@pytest.mark.parametrize("symbols", [3, 9])
def test_longest_matches(symbols):
    """Factors of the suffix array against all pairs of positions."""
    rng = random.Random(symbols)
    for _ in range(12):
        base = [rng.randrange(symbols) for _ in range(160)]
        seqs = []
        for _ in range(10):
            a = rng.randrange(60)
            s = base[a : a + rng.randrange(50, 100)]
            for _ in range(rng.randrange(3)):
                s[rng.randrange(len(s))] = rng.randrange(9)
            seqs.append(s)
        age = np.array([rng.randrange(8) for _ in seqs])
        index = op7_substrings.SuffixArray(np.array(sum(seqs, [])), np.array([len(s) for s in seqs]))
        got = dict(zip(*[x.tolist() for x in index.longest_before(age)[::2]]))
        for c, s in enumerate(seqs):
            for i in range(len(s) - 49):
                best = 0
                for d, u in enumerate(seqs):
                    for j in range(len(u) - 49) if age[d] < age[c] else ():
                        k = 0
                        while i + k < len(s) and j + k < len(u) and s[i + k] == u[j + k]:
                            k += 1
                        best = max(best, k)
                assert got.get(int(index.begin[c]) + i, 0) == (best if best >= 50 else 0)


def test_substrings_block_in_two_tasks(spark, monkeypatch):
    stage = op7_substrings.stage
    monkeypatch.setattr(op7_substrings, "stage", lambda df, name: stage(df, name).repartition(3, "doc_id") if "doc_id" in df.columns else stage(df, name))
    passage = [f"p{i}" for i in range(50)]
    rows = [(i, " ".join([f"w{i}x{j}" for j in range(60)] + passage * (i % 3 == 0))) for i in range(12)]
    got = op7_substrings.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {i: 50 * (i % 3 == 0 and i > 0) for i in range(12)}
    check_substrings(got, rows)


# -- 8 -----------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="has-sidebar">
<header>Site <a href=/>home</a></header><nav><ul><li><a>one</a><li><a>two</a></ul></nav>
<div class="cookie-notice">We use cookies, fine?</div><!-- <p>no</p> --><script>var a="</p><p>bad";</script>
<%s><h1>A &lt;title&gt;</h1><p>First, with <b>bold</b>&nbsp;text<br>and a break.<p>Second &amp; last, of them.</p>
<div class="ad">Buy, now!</div><p>Ok.</p></%s>
<aside>Other.</aside><section class="comments"><article class="comment"><p>I agree, a lot, really.</p></article></section>
<form><label>Mail</label></form><div class="sidebar"><p>More stories, here.</p></div><footer>bye, all.</footer>"""
WANT = "A <title>\n\nFirst, with bold text and a break.\n\nSecond & last, of them.\n\nOk."


@pytest.mark.parametrize("tag", ["article", "main", 'div class="post"'])
def test_html(tag):
    assert op8_html.extract(PAGE % (tag, tag.split()[0])) == WANT
    assert op8_html.extract((PAGE % (tag, tag.split()[0])).replace("</footer>", "")) == WANT


LONG = "A long sentence, with some commas, and a good many words in it; so it goes on. " * 6


@pytest.mark.parametrize("tag", ["article", "main", "div"])
@pytest.mark.parametrize("n", [2, 12])
def test_html_ratio_decides(tag, n):
    links = "<div><ul>" + "<li><a href=/>Other story</a>" * 9 + "</ul></div>"
    text = f"<p>{LONG}</p>" * n
    page = f"<body><{tag}><h1>T</h1>{text}<div>Buy now</div>{text}<ul><li>Eggs<li>Flour</ul>{links}</{tag}>"
    want = ["T", *[LONG.strip()] * 2 * n, "Eggs", "Flour"]
    assert op8_html.extract(page).split("\n\n") == want


def test_html_sibling_articles():
    page = f"<main><article><h2>A</h2><p>{LONG * 3}</p></article><article><h2>B</h2><p>{LONG}</p></article></main>"
    assert op8_html.extract(page).split("\n\n") == ["A", (LONG * 3).strip(), "B", LONG.strip()]


@pytest.mark.parametrize("n", [1, 20])
def test_html_lead_and_section(n):
    long = f"<p>{LONG}</p>" * n
    want = ["T", "Lead.", *[LONG.strip()] * n]
    assert op8_html.extract(f"<div class=post><h1>T</h1><p>Lead.</p><div class=text>{long}</div></div>").split("\n\n") == want
    if n == 1:
        assert op8_html.extract(f"<div class=post><h1>T</h1><p>Lead.</p><div class=text>{LONG}</div></div>").split("\n\n") == want
    page = f"<div><section>{long * 9}</section><section><p>One short section, with a text.</p></section></div>"
    assert op8_html.extract(page).split("\n\n") == [*[LONG.strip()] * 9 * n, "One short section, with a text."]


@pytest.mark.parametrize("attrs", ['class="content has-sidebar"', 'id="main-form"', 'class="post with-comments"', 'class="sidebar content"', "class=comments"])
def test_html_names_around_the_article(attrs):
    side = '<div class="sidebar"><p>More stories, here.</p></div><div class="ad"><p>Buy, now!</p></div>'
    for page in ("<div %s><h1>T</h1><p>%s</p></div>" + side, "<article %s><h1>T</h1><p>%s</p></article>" + side):
        assert op8_html.extract(page % (attrs, LONG)) == "T\n\n" + LONG.strip()


def test_html_names_inside_the_article():
    more = f'<section class="reviews"><p>{LONG * 9}</p></section>'
    page = f'<article><div class="article-header"><h1>T</h1></div><p>{LONG}</p><div class="more-text"><p>{LONG}</p></div>%s</article>'
    want = ["T", LONG.strip(), LONG.strip()]
    assert op8_html.extract(page % '<div class="comments"><p>I agree, a lot.</p></div>').split("\n\n") == want
    assert op8_html.extract(page % more).split("\n\n") == [*want, (LONG * 9).strip()]
    assert op8_html.extract(f"<article><p>{LONG}</p></article><article class=comment><p>{LONG * 2}</p></article>") == LONG.strip()


def test_html_ratios_by_brute_force():
    """Each block's fused ratio, computed from the page's definition."""
    import math

    rng = random.Random(3)
    for _ in range(20):
        parts = []
        for _ in range(rng.randrange(2, 12)):
            tag = rng.choice(["p", "li", "div", "h2", "section"])
            parts.append((tag, " ".join(rng.choice(["word", "and,", "end.", "x"]) for _ in range(rng.randrange(1, 40)))))
        found = op8_html.blocks("".join(f"<{t}>{x}</{t}>" for t, x in parts))
        assert [t for _, t, _ in found] == [x for _, x in parts]
        mean = lambda tag, f: sum(f(x) for t, x in parts if t == tag) / sum(t == tag for t, _ in parts)
        length = [mean(t, len) for t, _ in parts]
        marks = [mean(t, lambda x: x.count(",") + x.count(".")) for t, _ in parts]
        g = [math.exp(-0.5), 1.0, math.exp(-0.5)]
        got = op8_html.scores(found)
        for i in range(len(parts)):
            around = [max(0, i - 1), i, min(len(parts) - 1, i + 1)]
            a, b = [sum(w * v[j] for w, j in zip(g, around)) / sum(g) for v in (length, marks)]
            assert got[i] == pytest.approx(min(a * math.log(1.1 + b), length[i] * math.log(1.1 + marks[i])))


def test_html_ratios_decide_every_page(monkeypatch):
    page = PAGE % ("article", "article")
    monkeypatch.setattr(op8_html, "scores", lambda found: [1.0] * len(found))
    assert op8_html.extract(page) != WANT


@pytest.mark.parametrize("tag", ["article", "div"])
def test_html_names_that_mislead(tag):
    inner = f'<h1>T</h1><div class="more"><p>{LONG}</p></div><section class="discussion"><p>{LONG}</p></section><p id="follow">Follow the river, it says.</p>'
    page = f'<nav><a href=/>a</a></nav><{tag} class="sidebar">{inner}</{tag}><footer>bye</footer>'
    assert op8_html.extract(page).split("\n\n") == ["T", LONG.strip(), LONG.strip(), "Follow the river, it says."]
    table = f"<table><tr><td><a>go home</a><td>{LONG}<tr><td><a>go home</a><td>{LONG}</table>"
    assert op8_html.extract(table).split("\n\n") == [LONG.strip(), LONG.strip()]


def test_html_letters_that_change_length():
    assert op8_html.extract(f"<p>\u0130</p><SCRIPT>var a = '<p>'</SCRIPT><article><p>{LONG}</p></article>") == LONG.strip()


def test_html_deep_pages_take_linear_memory():
    import tracemalloc

    page = f"<article><p>{LONG}</p></article>" + "<div>" * 20000 + "x" + "</i>" * 20000
    tracemalloc.start()
    assert op8_html.extract(page) == LONG.strip()
    assert tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()


def test_html_odd(spark):
    odd = {None: "", "": "", "   ": "", "<p>": "", "plain words, only.": "plain words, only.", "<p>a<p>b": "a\n\nb", "<article><p>x &#0; <": "x \ufffd <"}
    odd["<article><p>" + "long, text. " * 20000] = ("long, text. " * 20000).strip()
    odd['<article><p>a <i title="x > y">b</i></article>'] = "a b"
    odd["<article><p>one</p></article><nav>" + "<div>" * 3000] = "one"
    odd["<script>x"] = ""
    df = spark.createDataFrame([(i, "u", k, 1) for i, k in enumerate(odd)] + [(None, None, None, None)], "page_id long, url string, html string, text int")
    got = {r["page_id"]: r["text"] for r in op8_html.extract_text(df).collect()}
    assert got == {**dict(enumerate(odd.values())), None: ""}


# -- 9 -----------------------------------------------------------------------


def test_arc_versions():
    body = b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nhe\nlo"
    for version in (1, 2):
        data = op9_warc.arc_version_block(version, "f.arc", "20010203040506")
        data += op9_warc.arc_record(version, "http://a b/c", "1.2.3.4", "20010203040506", "text/html", 200, body, "f.arc", len(data))
        (head, _, fields), (got, block, _) = op9_warc.parse_arc(data)
        assert head["version"] == str(version) and block == body
        assert fields == (op9_warc.V1_FIELDS if version == 1 else op9_warc.V2_FIELDS).split()
        assert got["URL"] == "http://a b/c" and got["IP-address"] == "1.2.3.4" and got["Archive-date"] == "20010203040506"
    with pytest.raises(ValueError):
        list(op9_warc.parse_arc(data[:-9]))
    with pytest.raises(ValueError):
        list(op9_warc.parse_arc(b"http://a 1 2001 text/html 1\nx\n"))
    assert op9_warc.warc_date("20010203040506") == "2001-02-03T04:05:06Z"
    assert op9_warc.warc_date("200102030405") == "2001-02-03T04:05:00Z"


@pytest.mark.parametrize("version", [1, 2])
def test_warc_round_trip(spark, tmp_path, version, monkeypatch):
    monkeypatch.setattr(op9_warc, "CHUNK_BYTES", 3000)
    rng = random.Random(0)
    big = ["".join(rng.choice("abcé\r\n") for _ in range(rng.choice([999, 1000, 5000]))) for _ in range(12)]
    rows = [(i, f"http://h/{i} x", rng.choice([*big, "", None, "small"])) for i in range(60)]
    rows += [(None, None, big[0]), (99, None, big[0]), (99, "u", big[0]), (98, "u\n", "é" * 500)]
    df = spark.createDataFrame(rows, "key long, url string, payload string").repartition(3)
    old, new = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    archive = op9_warc.write_arc(df, old, version)
    captures = op9_warc.read_arc(archive, old)
    assert sorted(str(bytes(r["payload"])) for r in captures.collect()) == sorted(str((p or "").encode()) for _, _, p in rows)
    again = op9_warc.revisits(op9_warc.read_arc(archive, old, blocks=False))
    manifest = op9_warc.convert_archive(archive, again, old, new)
    got = op9_warc.read_warc(manifest, new).collect()
    ids = {r["record_id"]: r["key"] for r in got}
    assert len(ids) == len(rows) == len(got)
    best = {}
    for k, _, p in rows:
        b = (p or "").encode()
        if len(b) >= 1000 and k is not None:
            best[b] = max(best.get(b, k), k)
    want = []
    for k, _, p in rows:
        b = (p or "").encode()
        again = b in best and best[b] != k
        want.append((str(k), len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", str(best[b]) if again else "None"))
    assert sorted((str(r["key"]), r["payload_bytes"], r["payload_digest"], r["type"], str(ids.get(r["refers_to_id"]))) for r in got) == sorted(want)
    # the files are plain gzip members of WARC records
    names = [p for p in (tmp_path / "b").iterdir() if p.name.endswith(".gz")]
    text = b"".join(gzip.decompress(p.read_bytes()) for p in names)
    assert text.count(b"WARC/1.1\r\n") == len(rows)
    for d in re.findall(rb"WARC-Payload-Digest: sha1:(\w+)", text):
        assert len(base64.b32decode(d)) == 20
    none = op9_warc.write_arc(df.limit(0), old)
    assert op9_warc.read_warc(op9_warc.convert_archive(none, op9_warc.revisits(op9_warc.read_arc(none, old)), old, new), new).count() == 0


# -- 10 ----------------------------------------------------------------------


def base_brute(text):
    w = WORD.findall(text or "")
    where = {}
    for i in range(len(w) - 4):
        where.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {j for v in where.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(w), sum(map(len, w)), symbols, dup, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def test_quality(spark, docs, rows):
    junk = [(1000 + i, " ".join(f"ab{j}***%%" for j in range(30)) + "\nx y\nx y\n\n#", "en", "s", 1) for i in range(20)]
    df = docs.union(spark.createDataFrame(junk, SCHEMA)).withColumn("kept", F.lit("x"))
    labels = spark.createDataFrame([(r[0], 1) for r in rows[:60]] + [(None, 1), (1001, 0), (7, None), (5, 1)], "doc_id long, quality int")
    got = op10_quality.quality(df, labels).collect()
    key = lambda r: (str(r["doc_id"]), str(r["text"]))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted((*key(r), *[r[n] for n in names]) for r in got) == sorted((str(r[0]), str(r[1]), *base_brute(r[1])) for r in [*rows, *junk])
    # the ratio by brute force
    every, good = op10_quality.corpus_counts(df, {r[0] for r in rows[:60]})
    ratio = op10_quality.log_ratio(every, good)
    assert every.sum() == sum(max(0, len((r[1] or "").encode()) - 2) for r in [*rows, *junk])
    for r in got:
        g = op10_quality.gram_ids(np.frombuffer((r["text"] or "").encode(), np.uint8))
        assert r["score"] == pytest.approx(ratio[g].mean() if len(g) else 0.0)
    assert not any(r["kept"] for r in got if r["base_failed"] or r["doc_id"] is not None and r["doc_id"] >= 1000)
    assert sum(r["kept"] for r in got) >= 0.98 * sum(not r["base_failed"] and not (r["doc_id"] or 0) >= 1000 for r in got)
    assert all(r["kept"] != r["base_failed"] for r in op10_quality.quality(df, labels.limit(0)).collect())
    assert op10_quality.quality(empty(spark), labels).count() == 0


def test_quality_trusts_every_label(spark, monkeypatch):
    """More trusted documents than any sample held: counts and quantile take all of them."""
    n = 20_500
    df = spark.range(n).selectExpr("id doc_id", "concat_ws(' ', transform(sequence(1, 10), k -> concat('w', (id * 7 + k * k) % 97, if(id % 411 = 3, 'q', 'a')))) text")
    labels = spark.range(n).selectExpr("cast(id as int) doc_id", "1 quality")
    got = op10_quality.quality(df, labels).collect()
    every, good = op10_quality.corpus_counts(df, labels.selectExpr("cast(doc_id as long) doc_id"))
    assert every.sum() and (every == good).all()
    assert {r["score"] for r in got} == {0.0} and all(r["kept"] for r in got)  # all are trusted: no n-gram tells them apart
    monkeypatch.setattr(op10_quality, "HELD", 3)
    rng = np.random.default_rng(1)
    for values in ([0.5], [-1.0, 2.0], [0.25] * 50, rng.normal(size=301).round(2).tolist(), rng.normal(size=300).tolist()):
        for share in (0.0, 0.002, 0.4, 1.0):
            assert op10_quality.quantile(spark.createDataFrame([(v,) for v in values], "score double"), share) == pytest.approx(np.quantile(values, share), abs=1e-15)
    assert op10_quality.quantile(spark.createDataFrame([], "score double"), 0.5) is None
