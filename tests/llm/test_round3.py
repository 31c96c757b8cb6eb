"""MinHash near-dedup, importance resampling and the divergence audit against brute force, on nulls, ties, repeats, long texts and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from corpusloom.llm import divergence, minhash, resampling, setjoin, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node long, rank int, chunk long"


@pytest.fixture(scope="module")
def given():
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abcdefg", k=rng.randint(1, 5))) for _ in range(60)] + ["été", "日本", "X9", "it's"]
    some = [" ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 19, 20, 60, 150]))) for _ in range(50)]
    edited = some[7].split() + some[8].split() + some[9].split()
    near = [[*edited[:k], "changed", *edited[k + 1 :]] for k in (0, len(edited) // 2, len(edited) - 1)]
    long = " ".join(rng.choices(vocabulary, k=40_000))
    texts = [None, "", " \t\n", ".,;", "one", "Two words", *some, some[3], some[3], some[4].upper(), " ".join(edited), *map(" ".join, near), long, "x" * 5000, *["copy of the same text and nothing else"] * 9]
    return [(i, t, rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "é", None]), 1, "k", 2, 3, 4) for i, t in enumerate(texts)] + [(4, "one", "en", "a", 1, "k", 2, 3, 4)] * 2 + [(None, "an id that is null", "xx", "a", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, given):
    return spark.createDataFrame(given, SCHEMA).repartition(3).cache()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def components(given, size, similarity):
    sets = []
    for t in given:
        w = words.words_of(t)
        sets.append({b" ".join(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set())
    root = list(range(len(given)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(given)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= round(100 * similarity) * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(given))], [len(s) for s in sets]


def test_near_duplicates_of_any_rows(spark, docs, given):
    root, sizes = components([r[1] for r in given], 3, 0.85)
    least = {}
    for (i, *_), r in zip(given, root):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = [(r[0], n, least.get(k), r[0] == least.get(k)) for r, k, n in zip(given, root, sizes)]
    assert rows(minhash.near_duplicates(docs, 0.85, 3)) == sorted(want, key=repr)
    assert not rows(minhash.near_duplicates(docs.limit(0), 0.85, 3))


@pytest.mark.parametrize(("bands", "per", "large", "block"), [(24, 7, 4096, 128), (2, 12, 6, 5), (1, 1, 3, 2)])
def test_no_link_is_lost(spark, bands, per, large, block):
    """Dense groups around the threshold, whose texts are unlike their hubs, with sketches that miss links or hold all for alike."""
    rng, given = random.Random(5), []
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    shared = [word() for _ in range(30)]
    for _ in range(10):
        base = [word() for _ in range(rng.randint(3, 90))]
        for _ in range(9):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 12))):
                copy[rng.randrange(len(copy))] = word()
            given.append(" ".join([*copy, *shared[: rng.choice([0, 0, 30])]]))
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, 0.85, 3, bands=bands, rows=per, large=large, block=block).collect()}
    want, _ = components(given, 3, 0.85)
    assert [got[i] for i in range(len(given))] == want and 10 < len(set(want)) < 80


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    probes = minhash._probes(168)
    for n in (3, 20, 170, 3000):
        for share in (0.5, 0.9):
            agree = []
            for _ in range(40):
                x = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64) * np.uint64(2)
                own = round(n * (1 - share) / (1 + share))
                a, b = np.unique(x[:n]), np.unique(np.r_[x[: n - own], x[n : n + own]])
                agree.append((minhash.sketch(a.view(np.int64), probes) == minhash.sketch(b.view(np.int64), probes)).mean())
            assert abs(np.mean(agree) - (n - own) / (n + own)) < 0.08


def test_a_star_has_one_link_less_than_texts(spark):
    df = spark.createDataFrame([(i, [1, 100 + i]) for i in range(50)] + [(50, [7, 8])], "node long, bands array<long>")
    assert rows(minhash.stars(df)) == [(0, i) for i in sorted(range(1, 50), key=lambda i: repr((0, i)))]


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(2)
    for n in (1, 5, 40):
        x = np.unique(rng.integers(0, 1 << 62, n))
        y = np.unique(np.r_[x[: max(1, int(np.ceil(n * 0.9)))], rng.integers(0, 1 << 62, int(n * 0.05))])
        if len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y)):
            assert len(np.intersect1d(setjoin.prefix(x, x[:2], 0.8), setjoin.prefix(y, x[:2], 0.8)))


def features(text, longest=2):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % resampling.BUCKETS for k in range(1, longest + 1) for i in range(len(w) - k + 1))


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_buckets_of_texts_in_runs(given, monkeypatch, longest):
    monkeypatch.setattr(words, "RUN", 50)
    for _, text, *_ in given[:70]:
        n, counts = resampling.buckets_of(None if text is None else text.encode(), longest)
        assert (n, {k: v for k, v in enumerate(counts.tolist()) if v}) == (lambda x: (x[0], dict(x[1])))(features(text, longest))


@pytest.mark.parametrize(("chunk", "percent"), [(1024, 25), (3, 60)])
def test_resampled_rows(spark, docs, given, monkeypatch, chunk, percent):
    monkeypatch.setattr(resampling, "CHUNK_ROWS", chunk)
    target = spark.createDataFrame([(0, given[8][1]), (1, None), (2, given[20][1])], "item_id long, text string")
    s, t = Counter(), Counter()
    for _, text, *_ in given:
        s.update(features(text)[1])
    for i in (8, 20):
        t.update(features(given[i][1])[1])
    up, down = s.total() + resampling.BUCKETS, t.total() + resampling.BUCKETS
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * up / ((s[b] + 1) * down))) for b in s}
    want = []
    for i, text, *_ in given:
        n_words, f = features(text)
        weight = sum(n * gain[b] for b, n in f.items()) // f.total() if f else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append((i, f.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words >= 20))
    able = sorted((r for r in want if r[4]), key=lambda r: (-r[3], r[0]))
    drawn = {r[0]: k for k, r in enumerate(able[: len(able) * percent // 100], 1)}
    got = resampling.resampled(docs, target, percent=percent)
    assert rows(got) == sorted(((*r[:4], drawn.get(r[0])) for r in want), key=repr) and len(drawn) > 5
    if chunk > 3:
        assert not rows(resampling.resampled(docs.limit(0), target))
        assert {r["weight"] for r in resampling.resampled(docs.where("doc_id < 3"), target.limit(0)).collect()} == {0}


def audited(given, least, top):
    held = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source, *_ in given]
    df, count, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, terms in held:
        df[lang].update(set(terms))
        sources[lang].add(source)
    kept = {lang: sorted(t for t, n in c.items() if n >= least) for lang, c in df.items()}
    for lang, source, terms in held:
        for key in ((lang, source), (lang,)):
            count[key].update(t for t in terms if t in set(kept.get(lang, ())))
    p = {key: {t: 1 + 10**9 * (count[key][t] + 1) // (count[key].total() + len(kept[key[0]])) for t in kept[key[0]]} for key in [(la, s) for la in sources for s in sources[la]] + [(la,) for la in sources]}
    out = []
    for lang in sources:
        for a in sources[lang]:
            pairs = [(b, sum((x - y) ** 2 // y for x, y in zip(p[lang, a].values(), p[lang, b].values()))) for b in sources[lang] if b != a]
            terms = [(t, (x - y) ** 2 // y) for (t, x), y in zip(p[lang, a].items(), p[lang,].values()) if count[lang, a][t] and x > y]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, a, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("terms", "share", "held"), [(100_000, 16 << 20, 200_000), (7, 2000, 5)])
def test_audit(spark, docs, given, monkeypatch, terms, share, held):
    monkeypatch.setattr(divergence, "TERMS", terms)
    monkeypatch.setattr(divergence, "SHARE", share)
    monkeypatch.setattr(divergence, "HELD", held)
    got = rows(divergence.audit(docs, top=20))
    assert got == audited(given, 3, 20) and {"pair", "term"} == {r[2] for r in got}
    if terms > 7:
        assert not rows(divergence.audit(docs.limit(0)))
        # Without kept terms pairs have the value 0.
        assert rows(divergence.audit(docs, least=10_000)) == audited(given, 10_000, 20)


def test_shares_of_very_large_counts(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(10**13, 10**15, 7)], "n long, total long, v long")
    (got,) = df.select(divergence._billionths(F.col("n"), F.col("total"), F.col("v"))).first()
    assert got == 1 + 10**9 * (10**13 + 1) // (10**15 + 7)


@pytest.mark.parametrize("run", [" ", "\n", "x", "\xa0"])
def test_token_counts_of_long_runs(spark, run):
    from corpusloom.llm import tokencount

    e = tokencount._encoding(tokencount.VOCABULARY)
    short = f"a word {run * 7000} then{run * 3} more{run}"
    assert tokencount.token_ids(e, short) == e.encode_ordinary(short)
    # The library itself cannot take so many blanks: there what it gives for the run's one word is the rule.
    df = spark.createDataFrame([(1, run * 1_500_000), (2, f"a{run * 1_500_000}b"), (3, None), (3, ""), (None, "one two")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_tokens"]) for r in tokencount.token_counts(df).collect()), key=repr)
    many = run * 1_499_999
    second = [f"a{run}{many}b"] if run == "x" else ["a", many, " b"] if run == " " else ["a", many, run, "b"]
    n = lambda *pieces: sum(len(e._encode_single_piece(p.encode())) for p in pieces)
    assert got[:2] == [(1, n(many + run)), (2, n(*second))] and got[2:] == [(3, 0), (3, 0), (None, 2)]


def test_nearest_by_a_query_on_other_columns(spark):
    from pyspark.sql import functions as F

    from corpusloom.llm import ann

    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 6))
    df = spark.createDataFrame([(i, v.tolist(), i % 7, i, "q" if i == 5 else None) for i, v in enumerate(x)], "vec_id long, embedding array<double>, n int, dim int, query string")
    for is_query, ids in ((F.col("n") == 3, range(3, 40, 7)), (F.col("dim") == 8, [8]), (F.col("query") == "q", [5])):
        got = rows(ann.nearest(df, is_query, 2))
        unit = x / np.sqrt((x * x).sum(1, keepdims=True))
        want = [(q, k, i) for q in ids for k, i in enumerate(sorted((i for i in range(40) if i != q), key=lambda i: (-float(unit[q] @ unit[i]), i))[:2], 1)]
        assert sorted(r[:3] for r in got) == sorted(want)


def test_floors_drop_no_neighbour(spark, monkeypatch):
    from pyspark.sql import functions as F

    from corpusloom.llm import ann

    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(300, 4)), 1) + 0.01
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    whole = sorted(rows(ann.nearest(df, F.col("vec_id") % 9 == 0, 4)))
    monkeypatch.setattr(ann, "BLOCK", 17)
    assert sorted(rows(ann.nearest(df, F.col("vec_id") % 9 == 0, 4))) == whole


def test_every_language_is_learned_and_decided_by_its_machines(spark, monkeypatch):
    from pyspark.sql import functions as F

    from corpusloom.llm import langid

    rng = random.Random(2)
    # Languages of three families and some on their own, each with words of its own letters.
    langs = ["en", "de", "nl", "fr", "es", "ru", "uk", "zz", "q1", "q2", "q3"]
    words_of = {k: ["".join(rng.choices(rng.sample("abcdefghijklmnopqrstuvwxyz", 6), k=5)) for _ in range(12)] for k in langs}
    given = [(i, " ".join(rng.choices(words_of[k], k=25)), k) for i, k in enumerate(langs * 25)]
    df = spark.createDataFrame(given, "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "SAMPLE", 110)
    monkeypatch.setattr(langid, "PIECE", 60)
    model = langid.train(df, F.col("doc_id"))
    assert {x for own in model.languages.values() for x in own} == set(langs) and len(model.top) == len(model.families) == 7
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(df, model).collect()}
    for i, text, _ in given[:60]:
        # The decision by hand: the family whose machine gives most, then the most wins among its languages.
        v = langid.features(text)
        top = [float(m.weights @ v) + m.bias for m in model.top]
        family = model.families[int(np.argmax(top))]
        own, wins, sums = model.languages[family], Counter(), Counter()
        for a, b, m in model.within[family]:
            s = float(m.weights @ v) + m.bias
            wins[a if s >= 0 else b] += 1
            sums[a] += s
            sums[b] -= s
        assert got[i][0] == own[max(range(len(own)), key=lambda k: (wins[k], sums[k], -k))] and 0 <= got[i][1] <= 1
    assert sum(got[i][0] == k for i, _, k in given) >= 0.95 * len(given)


def test_machines_reach_the_optimum_of_the_dual():
    from corpusloom.llm import langid

    rng = np.random.default_rng(0)
    x = [(np.sort(rng.choice(50, 8, replace=False)), rng.random(8)) for _ in range(40)]
    y = np.where(rng.random(40) < 0.4, 1, -1)
    m = langid.fit_svm(x, y, rounds=2000)
    squares = np.array([float(v @ v) for _, v in x])
    scale = 1 / float(np.sqrt(squares).mean())
    dense = np.zeros((40, 51))
    for r, (at, v) in zip(dense, x):
        r[at], r[50] = v * scale, 1
    bound = np.where(y > 0, 40 / (2 * (y > 0).sum()), 40 / (2 * (y < 0).sum()))
    w = np.append(m.weights[:50] / scale, m.bias)
    primal = lambda w: 0.5 * float(w @ w) + float((bound * np.maximum(1 - y * (dense @ w), 0)).sum())
    best = primal(w)
    # Convex: no small step anywhere lessens it.
    assert all(primal(w + 0.02 * rng.normal(size=51)) >= best - 1e-2 for _ in range(300))
