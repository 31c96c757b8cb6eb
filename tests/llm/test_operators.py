"""The operators on small tables: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import base64
import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import ann, bytebpe, langid, packing, pii, sharding, simhash, spotsigs, tokencount, warc
from corpusloom.llm.common import positioned, shared_dir
from corpusloom.llm.graph import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, fp long, node long"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9)))
    some = [" ".join(word() for _ in range(rng.randint(1, 120))) for _ in range(24)]
    long = " ".join(word() for _ in range(9000))
    near = some[5].split()
    near[len(near) // 2] = "changed"
    return [None, "", " \n\t", "one", "it's 12, x.", *some, some[0], some[0], some[1], " ".join(near), long, "x" * 3000, "é ü ß 日本 \U0001f600 42", ".,;", *["same old text of the many copies"] * 12]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, random.Random(i).choice(["en", "de", None]), "s", 1, "k", 7, 8) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[7], (None, "an id that is null", "en", None, 1, None, None, None)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def held(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def empty(docs):
    return docs.limit(0)


def rows(df):
    return [tuple(r) for r in df.collect()]


def keyed(values):
    return sorted(values, key=repr)


def test_positions_are_gapless(docs):
    got = positioned(docs.select("doc_id", "text"), [F.col("text"), F.col("doc_id")]).collect()
    assert sorted(r["pos"] for r in got) == list(range(len(got)))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    rng = random.Random(5)
    edges += [(1000 + rng.randrange(90), 1000 + rng.randrange(90)) for _ in range(60)]
    want = {}
    for a, b in edges:
        if a != b:
            whole = want.get(a, {a}) | want.get(b, {b})
            want |= dict.fromkeys(whole, whole)
    for native in (False, True):
        got = dict(rows(connected_components(spark.createDataFrame([*edges, (None, 5)], "a long, b long"), native=native)))
        assert got.keys() == want.keys() and all((got[x] == got[y]) == (y in want[x]) for x in want for y in want) and all(got[x] in want[x] for x in want)
        assert not rows(connected_components(spark.createDataFrame([], "a long, b long"), native=native))


def test_token_counts(docs, held):
    e = tokencount._encoding(tokencount.VOCABULARY)
    assert keyed((r["doc_id"], r["n_tokens"]) for r in tokencount.token_counts(docs).collect()) == keyed((d, len(e.encode_ordinary(t or ""))) for d, t in held)
    assert not rows(tokencount.token_counts(empty(docs)))


@pytest.mark.parametrize("size", [2, 6, 4096])
def test_documents_across_ranges(spark, docs, held, size):
    folder = shared_dir(spark, "t")
    tokencount.write_token_files(docs.coalesce(1), folder).count()
    got = tokencount.scan(tokencount.byte_ranges(spark, folder, size)).orderBy("ordinal").collect() if size > 6 else tokencount.scan(tokencount.byte_ranges(spark, folder, 512 * size)).orderBy("ordinal").collect()
    e = tokencount._encoding(tokencount.VOCABULARY)
    assert sorted(r["n_tokens"] for r in got) == sorted(len(e.encode_ordinary(t or "")) for _, t in held)
    assert all(a["start"] + a["n_tokens"] + 1 == b["start"] for a, b in zip(got, got[1:]))


def test_warc(spark):
    big = "<p>é</p>" * 40_000
    pages = [(3, "u", "a"), (1, "u", "a"), (2, "u\r\nx", None), (5, None, ""), (4, "v", big), (6, "v", big), (9, "w", "only"), (None, "w", "a"), (9, "w", "only"), (8, "x", "\r\n\r\nWARC/1.1\r\n\r\n")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    archives = warc.write_archives(warc.chunked(warc.assigned(df), 1000), shared_dir(spark, "w"))
    chunks = warc.read_archives(archives, 777)
    first = {"a": 1, "": 2, big: 4, "only": 9, pages[-1][2]: 8}
    name = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = [(i, len((t or "").encode()), name(t or ""), "response" if i == first[t or ""] else "revisit", None if i == first[t or ""] else first[t or ""]) for i, _, t in pages]
    assert keyed(rows(warc.summary(chunks))) == keyed(want)
    parts = [r for r in chunks.where("record_id = '4'").orderBy("chunk_no").collect()]
    assert b"".join(bytes(r["chunk"]) for r in parts) == big.encode() and max(len(r["chunk"]) for r in parts) == 777
    so_far = b""
    for r in parts:
        so_far += bytes(r["chunk"])
        assert r["sha1_so_far"] == base64.b32encode(hashlib.sha1(so_far).digest()).decode()
    assert not rows(warc.summary(warc.read_archives(warc.write_archives(warc.chunked(warc.assigned(df.limit(0))), shared_dir(spark, "w")))))


def test_sharding(spark, docs, held):
    got = sharding.shard_documents(docs).collect()
    counts = [sum(r["shard"] == s for r in got) for s in range(8)]
    assert len(got) == len(held) and max(counts) - min(counts) <= 1
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    assert keyed((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == keyed((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in held)
    pairs = spark.createDataFrame([(i, f"text {i // 2}") for i in range(400)] + [(1000 + i, "hot") for i in range(200)], "doc_id long, text string")
    of = {}
    for r in sharding.shard_documents(pairs).collect():
        of.setdefault("hot" if r["doc_id"] >= 1000 else r["doc_id"] // 2, []).append(r["shard"])
    assert sum(len(set(v)) > 1 for k, v in of.items() if k != "hot") <= 20 and max(of["hot"].count(s) for s in range(8)) >= 60
    assert not rows(sharding.shard_documents(empty(docs)))


def cut_of(labels, hubs):
    return sum(labels[a] != labels[b] for m in hubs for a, b in combinations(m, 2))


def test_propagation_lessens_the_cut(spark):
    rng, first, mine, best = random.Random(13), 0, 0, 0
    for _ in range(4):
        n = 14
        near = [(a, b) for a, b in combinations(range(n), 2) if rng.random() < (0.7 if a % 2 == b % 2 else 0.1)]
        hubs = [*near, tuple(rng.sample(range(0, n, 2), 3)), tuple(rng.sample(range(1, n, 2), 4))]
        side, log = set(rng.sample(range(n), n // 2)), []
        start = {i: int(i in side) for i in range(n)}
        members = spark.createDataFrame([(x, str(h)) for h, m in enumerate(hubs) for x in m], "node long, hub string").coalesce(1)
        nodes = spark.createDataFrame(list(start.items()), "node long, label int").coalesce(1)
        end = start | {r["node"]: r["label"] for r in sharding.propagate(nodes, members, n, 2, slack=0, log=log).collect()}
        assert log[0][0] == cut_of(start, hubs) and all(a[0] > b[0] for a, b in zip(log, log[1:])) and log[-1][0] == cut_of(end, hubs)
        assert sum(end.values()) == n // 2
        least = min(cut_of({i: int(i in side) for i in range(n)}, hubs) for side in map(set, combinations(range(n), n // 2)))
        assert log[-1][0] >= least
        first, mine, best = first + log[0][0], mine + log[-1][0], best + least
    assert mine - best <= 0.5 * (first - best)


def test_groups_end_whole(spark):
    pairs = spark.createDataFrame([(i, f"text {i % 150}") for i in range(400)] + [(1000 + i, "hot") for i in range(200)], "doc_id long, text string")
    log, of = [], {}
    for r in sharding.shard_documents(pairs, log=log).collect():
        of.setdefault("hot" if r["doc_id"] >= 1000 else r["doc_id"] % 150, []).append(r["shard"])
    assert all(a[0] > b[0] for a, b in zip(log, log[1:])) and sum(len(set(v)) > 1 for k, v in of.items() if k != "hot") <= 15
    assert sum(sorted((of["hot"].count(s) for s in range(8)), reverse=True)[:3]) >= 150


def test_quotas_keep_sizes():
    q = sharding.quotas([[0, 9, 0], [4, 0, 0], [7, 0, 0]], [0, 2, 0])
    assert q[0][1] == 6 and q[1][0] == 4 and q[2][0] == 0
    rng = random.Random(8)
    assert sharding.circulated([[0, 5, 0], [0, 0, 5], [7, 0, 0]], [0, 0, 0]) == [[0, 5, 0], [0, 0, 5], [5, 0, 0]]
    for _ in range(50):
        want = [[rng.randint(0, 20) if a != b else 0 for b in range(5)] for a in range(5)]
        room = [rng.randint(-3, 6) for _ in range(5)]
        least, q = sharding.quotas(want, room), sharding.circulated(want, room)
        assert all(least[a][b] <= q[a][b] <= want[a][b] for a in range(5) for b in range(5) if a != b)
        assert all(sum(q[a][b] for a in range(5)) - sum(q[b]) <= max(room[b], 0) for b in range(5))


def _luhn(d):
    return sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def base(t):
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and _luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    return sorted((m.start(), k, m.end(), n) for k, (n, p, ok) in enumerate(kinds) for m in re.finditer(p, t or "") if ok(m.group()))


PII = [
    "mail a.b@c.de, or x@y.z.w_q@r.st; 1.2.3.4.5.6.7.8 and 256.1.1.1 then 0001.2.3.255",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112, 4111111111111111 4111111111111111",
    "+49 (170) 1234567 and +1 2 and +123456789012345678, \U0001f600 +1.202.555.0123",
    "a@b..c a@b.c..d@e.f @x.y é@ü.de mé@a.bc 5.5.5.5@h.io",
    " t@u.vw  9.9.9.9",
    "x@y" + ".z" * 20_000 + " " + "1 " * 20_000 + "a" * 50_000,
]


def test_pii_base_spans(spark):
    rng = random.Random(1)
    noise = ["".join(rng.choices("a@.-+ 0123456789()é", k=60)) for _ in range(150)]
    cards = ["4111111111111111 5500 0000 0000 0004"[rng.randint(0, 3) :] + "".join(rng.choices("0123456789 -", k=6)) for _ in range(60)]
    given = [*PII, *noise, *cards, None, ""]
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    for r in pii.report(df).collect():
        want = base(given[r["doc_id"]])
        spans = ",".join(f"{n}:{a}:{b}" for a, _, b, n in want)
        assert r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest(), (given[r["doc_id"]], r["spans"])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(w[3] == k for w in want) for k in pii.KINDS]


def test_pii_disclosing_terms(spark):
    rng = random.Random(2)
    filler = [f"plain words number {''.join(rng.choices('abcdefgh', k=6))} stand here with nothing" for _ in range(60)]
    reveal = [f"Ask Zorblax about item {''.join(rng.choices('abcdefgh', k=5))} via z@q.com today with nothing" for _ in range(5)]
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate([*filler, *reveal, reveal[0], None, ""])], "doc_id long, text string, _key string")
    spans = {r["doc_id"]: r["spans"] for r in pii.report(df).collect()}
    assert all("term:4:11" in spans[i] and "email" in spans[i] for i in range(60, 66)) and not any(spans[i] for i in range(60))
    assert "nothing" not in {df.where(F.col("doc_id") == 60).first()["text"][int(a) : int(b)] for k, a, b in (s.split(":") for s in spans[60].split(",")) if k == "term"}
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert all("Zorblax" not in clean[i] and "[EMAIL]" in clean[i] for i in range(60, 66)) and clean[66] is None and clean[0] == filler[0] and pii.sanitise(df).columns == df.columns


def test_pii_shares_by_brute_force(spark):
    rng = random.Random(9)
    words = ["alpha", "bravo", "delta", "gamma", "omega", "sigma", "theta", "kappa"]
    texts = [" ".join(rng.choices(words, k=4)) + rng.choice(["", "", " a@x.org", " b@x.org", " a@x.org and b@y.net"]) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = pii._found(df, "text")
    corpus = df.select(F.explode(pii._terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df_term"))
    flagged, places = pii.shares(found, corpus, len(texts), 0.1)
    terms = [set(re.findall(r"(?<![a-z])[a-z]{3,}", t)) for t in texts]
    held = [{x for m in re.findall(r"\w@(\w\.\w+)", t) for x in (f"email:*@{m}",)} | {f"email:{m}" for m in re.findall(r"\w@\w\.\w+", t)} for t in texts]
    want = {}
    for e in set().union(*held):
        n_e = sum(e in h for h in held)
        for w in set().union(*terms):
            n_w, n = sum(w in t for t in terms), sum(w in t and e in h for t, h in zip(terms, held))
            if n:
                c = n * n / (n + 1)
                share = np.log2(c * 60 / (n_w * n_e)) / np.log2(60 / n_e)
                if share >= 0.1 and np.log2(60 / n_w) >= 0.1 * np.log2(60 / n_e) - 1e-9:
                    want[e, w] = (n_e, n_w, n, round(share, 9), bool(c / n_w >= pii.CERTAIN and n < n_w))
    assert {(r["entity"], r["term"]): (r["df_entity"], r["df_term"], r["df_both"], round(r["share"], 9), r["sure"]) for r in flagged.collect()} == want and want
    of = {r["id"]: r["text"] for r in found.collect()}
    got = {(of[r["id"]], r["term"], round(r["share"], 9)) for r in places.collect()}
    assert got == {(t, w, want[e, w][3]) for t, ws, es in zip(texts, terms, held) for e in es for w in ws if (e, w) in want}


def test_pii_beyond_texts_with_base_spans(spark):
    filler = [f"plain words number {i} stand here with nothing" for i in range(200)]
    known, alone = [f"Zorblax wrote no. {i} at z@q.com" for i in range(19)], "what Zorblax wrote stands here"
    df = spark.createDataFrame([(i, t, "b", "t") for i, t in enumerate([*filler, *known, alone, alone])], "doc_id long, text string, base string, terms string")
    clean = pii.sanitise(df)
    got = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert clean.columns == df.columns and len(got) == 221 and [got[i] for i in range(200)] == filler
    assert got[219] == got[220] != alone and "Zorblax" not in got[219] and "stands here" in got[219]
    spans = {r["doc_id"]: (r["n_term"], r["spans"]) for r in pii.report(df).collect()}
    assert spans[219] == spans[220] == (2, "term:5:12,term:13:18") and spans[0] == (0, "")


def test_pii_generalises_to_a_class(spark):
    rng = random.Random(3)
    filler = [f"zo{''.join(rng.choices('abcdef', k=5))} plain words {i}" for i in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*filler, "Zorblax and Qqxyz via z@q.com"])], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}[300]
    assert got.startswith("zo* ") and "Qq" not in got and got.endswith("[EMAIL]")


def test_pii_many_spans_in_one_text(spark):
    many = " ".join(f"10.{i % 200}.{i // 200}.7 x" for i in range(16_000))
    df = spark.createDataFrame([(1, many), (2, many[:100])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.report(df).collect()}
    assert got[1]["n_ip"] == 16_000 and got[1]["base_sha256"] == hashlib.sha256(",".join(f"ip:{a}:{b}" for a, _, b, _ in base(many)).encode()).hexdigest()
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert clean[1] == " ".join(["[IP] x"] * 16_000)


def test_pii_empty(docs):
    assert not rows(pii.report(empty(docs))) and not rows(pii.sanitise(empty(docs)))


def spot_reference(text):
    words = [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]
    content = [(i, w) for i, w in enumerate(words) if w not in spotsigs.ANCHORS]
    out, anchors, at = set(), [], 0
    for n, (i, w) in enumerate(content):
        for a in words[at:i]:
            if n + 1 < len(content):
                out.add((a, w, content[n + 1][1]))
        at = i + 1
    return out


def test_spotsigs(spark, docs, held):
    got = rows(spotsigs.edited_fingerprints(docs, groups=True))
    assert keyed(r[:7] for r in got) == keyed(rows(spotsigs.edited_fingerprints(docs)))
    order = sorted(((d, t or "") for d, t in held), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = []
    for (d, t), (_, n) in zip(order, order[1:] + order[:1]):
        k = len(t) // 2
        want.append((d, len(t), hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest()))
    assert keyed(r[:3] for r in got) == keyed(want)
    sets = {t: spot_reference(t) or {t} for _, t in order}
    jac = lambda a, b: len(a & b) / len(a | b)
    near = []
    for (d, t), (_, n) in zip(order, order[1:] + order[:1]):
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        near.append((d, round(jac(sets[t], spot_reference(e) or {e}), 9), round(jac(sets[t], sets[n]), 9)))
    assert keyed((r[0], round(r[5], 9), round(r[6], 9)) for r in got) == keyed(near)
    root = {d: d for d, _ in order if d is not None}
    texts = [(d, t) for d, t in order if d is not None]
    for _ in root:
        for i, (d, t) in enumerate(texts):
            for c, u in texts[:i]:
                if jac(sets[t], sets[u]) >= 0.8:
                    root[c] = root[d] = min(root[c], root[d])
    assert all(r[7] == root[r[0]] for r in got if r[0] is not None)
    assert all(0 <= x <= 1 for r in got for x in r[5:7]) and not rows(spotsigs.edited_fingerprints(empty(docs)))
    by_text = {}
    for r in got:
        by_text.setdefault(dict(held)[r[0]] or "", set()).add(r[3])
    assert all(len(v) == 1 for v in by_text.values())


def test_spotsigs_likeness(spark):
    a = "The quick fox jumped over a lazy dog and the cat was in the old house with an angry mouse"
    b = "The quick fox jumped over a lazy dog and the cat was in the new house with an angry mouse"
    df = spark.createDataFrame([(1, a), (2, b), (3, None), (4, "nothing")], "doc_id long, text string")
    s = {r["doc_id"]: set(r["s"]) for r in spotsigs.with_signatures(df.withColumn("text", F.coalesce("text", F.lit(""))), F.col("text"), "s").collect()}
    ra, rb = spot_reference(a), spot_reference(b)
    assert len(s[1]) == len(ra) and len(s[1] & s[2]) == len(ra & rb) and len(s[3]) == len(s[4]) == 1


def test_spotsigs_pairs_match_brute_force(spark):
    rng = random.Random(5)
    sets = [sorted(rng.sample(range(400), rng.randint(1, 40))) for _ in range(60)]
    for i in range(40):
        near = set(sets[i])
        near.discard(next(iter(near)))
        near.add(1000 + i)
        sets += [sorted(near), sets[i]]
    df = spark.createDataFrame(list(enumerate(sets)), "doc_id long, sigs array<int>")
    member, pairs = spotsigs.near_pairs(df, 0.8)
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(tuple(s), i)
    assert dict(rows(member)) == {i: first[tuple(s)] for i, s in enumerate(sets)}
    classes = [(i, set(s)) for s, i in first.items()]
    want = {frozenset((i, j)) for i, a in classes for j, b in classes if i < j and len(a & b) >= 0.8 * len(a | b)}
    assert {frozenset(r[:2]) for r in rows(pairs)} == want


def test_byte_bpe(docs, held):
    import tiktoken

    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(bytebpe.VOCABULARY), special_tokens={})
    want = []
    for d, t in held:
        ids = e.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert keyed(rows(bytebpe.digests(docs))) == keyed(want)
    assert keyed((d, bytes(x).decode()) for d, x in rows(bytebpe.decode(bytebpe.encode(docs)))) == keyed((d, t or "") for d, t in held)
    assert not rows(bytebpe.digests(empty(docs)))


def _library(pattern):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bytebpe.read_ranks(bytebpe.VOCABULARY), special_tokens={})


def test_byte_bpe_words_match_the_library(monkeypatch):
    c, e, rng = bytebpe.codec(bytebpe.VOCABULARY, bytebpe.PATTERN), _library("(?s:.+)"), random.Random(1)
    scripts = [(32, 127), (0xC0, 0x250), (0x370, 0x500), (0x600, 0x700), (0x4E00, 0x9FFF), (0xAC00, 0xD7A0), (0x1F600, 0x1F640)]
    words = ["".join(chr(rng.randint(*rng.choice(scripts[k % 7 :][:1]))) for _ in range(rng.randint(1, 50))) for k in range(3000)]
    words += ["abcabcabc" * 90, "-=" * 400, "é" * 300, "thethethe", "x" * 700]
    want = [",".join(map(str, e.encode_ordinary(w))) for w in words]
    assert c.encode_words(words) == want and c.decode(want) == [w.encode() for w in words]
    monkeypatch.setattr(bytebpe, "BYTES_AT_ONCE", 300)
    assert c.encode_words(words[::9]) == want[::9]
    with pytest.raises(ValueError, match="vocabulary"):
        c.decode(["1,60000"])


def test_byte_bpe_many_long_words():
    c, rng = bytebpe.codec(bytebpe.VOCABULARY, bytebpe.PATTERN), random.Random(2)
    words = ["".join(rng.choices("etaoinshrdlucm", k=120)) for _ in range(20_000)]
    assert c.decode(c.encode_words(words)) == [w.encode() for w in words]


def test_byte_bpe_pieces(spark, monkeypatch):
    c = bytebpe.codec(bytebpe.VOCABULARY, bytebpe.PATTERN)
    long = " ".join(f"word{i} and  more\n\nof it's," for i in range(60_000))
    assert len(long) > bytebpe.PIECE
    e = _library(public_tokenizers.PATTERN)
    batch = lambda texts: pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    for given in (["a b", long, "", "c"], ["some words  here \n\n and there ", None, "", " "]):
        got = [r for x in bytebpe._digested(bytebpe.VOCABULARY, bytebpe.PATTERN)(iter([batch(given)])) for r in x.to_pylist()]
        for r, t in zip(got, given):
            ids = e.encode_ordinary(t or "")
            assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        monkeypatch.setattr(bytebpe, "PIECE", 7)
    assert [w for p in c.pieces("some words  here \n\n and there ") for w in p] == c.pattern.findall("some words  here \n\n and there ")


def test_byte_bpe_after_encode_in_one_worker(spark):
    df = spark.createDataFrame([(1, "quite new words here"), (1, "quite new words here"), (2, None)], "doc_id long, text string").coalesce(1)
    assert df.transform(bytebpe.encode).count() == 3 and len(rows(bytebpe.digests(df))) == 3


def test_packing(docs, held):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.TOKENIZER)
    got = packing.packed(docs, keep_ids=True).cache()
    want = []
    for d, x in held:
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(d, k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
    assert keyed(tuple(r)[:5] for r in got.collect()) == keyed(want)
    of = {}
    for r in got.collect():
        of.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in of.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 4096
    assert len(of) <= sum(w[3] for w in want) // 4096 + 2
    assert sum(len(r["ids"]) // 4 for r in packing.sequences(got).collect()) == sum(w[3] for w in want)
    assert not rows(packing.packed(empty(docs)))


def test_packing_ids_are_the_library_s(monkeypatch):
    from tokenizers import Tokenizer

    t, rng = Tokenizer.from_file(packing.TOKENIZER), random.Random(6)
    scripts = [(32, 127), (97, 123), (0xC0, 0x250), (0x300, 0x370), (0x370, 0x500), (0x590, 0x700), (0x900, 0xA00), (0x1E00, 0x2100), (0x4E00, 0x9FFF), (0xAC00, 0xD7A4), (0xFB00, 0xFB50), (0x1F600, 0x1F640)]
    whole = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "\u0130", "\u0958", "\u212b", "'s", "\t", "\n", " ", ".", ",", "?!", "1"]

    def some():
        parts = []
        for _ in range(rng.randint(1, 5)):
            low, high = rng.choice(scripts)
            parts.append(rng.choice(whole) if rng.random() < 0.4 else "".join(chr(rng.randrange(low, high)) for _ in range(rng.randint(1, 4))))
        return "".join(parts)

    given = ["hello <|endoftext|> world", "b\u0130.", "\u0130stanbul, \u0130.", *(some() for _ in range(100_000))]
    words = packing._Words(packing.TOKENIZER)
    for x, e in zip(given, t.encode_batch(given, add_special_tokens=False)):
        assert np.frombuffer(words.ids(x), "<u4").tolist() == e.ids, repr(x)
    monkeypatch.setattr(packing, "PIECE", 9)
    for x in given[:2000]:
        assert np.frombuffer(words.ids(x + " and more of it " + x), "<u4").tolist() == t.encode(x + " and more of it " + x, add_special_tokens=False).ids


def test_minimum_bin_slack():
    rng = random.Random(4)
    for _ in range(20):
        counts = {rng.randint(1, 40): rng.randint(1, 5) for _ in range(8)}
        slack = rng.randint(1, 60)
        used = packing.fullest(dict(counts), sorted(counts, reverse=True), slack)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        assert sum(n * k for n, k in used.items()) == max(s for s in sums if s <= slack) and all(k <= counts[n] for n, k in used.items())
    sizes = [rng.randint(1, 100) for _ in range(500)]
    runs = packing.plan({n: sizes.count(n) for n in sizes}, 100)
    assert runs[:, 3].max() + 1 >= -(-sum(sizes) // 100)


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[100:160] = x[50]
    bad = [(1000, None), (1050, [0.0] * 16), (1100, [float("nan")] + [1.0] * 15), (1150, [1.0, None] + [1.0] * 14), (1200, []), (None, [1.0] * 16)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + bad, "vec_id long, embedding array<float>")
    got = sorted(rows(ann.nearest(df, F.col("vec_id") % 50 == 0)))
    d = x.astype(float)
    want = []
    for q in range(0, 600, 50):
        s = ann.cosines(np.repeat(d[q : q + 1], 600, 0), d)
        best = sorted((-s[i], i) for i in range(600) if i != q)[:5]
        want += [(q, k, i, -v) for k, (v, i) in enumerate(best, 1)]
    assert got == want
    few = df.where("vec_id < 3")
    assert [r[2] for r in rows(ann.nearest(few, F.col("vec_id") % 50 == 0))] and len(rows(ann.nearest(few, F.col("vec_id") % 50 == 0))) == 2
    assert not rows(ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0))


def test_nearest_in_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 5)
    monkeypatch.setattr(ann, "SLAB", 3)
    test_nearest(spark)


def test_nearest_of_long_and_of_huge_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 2500)) * np.where(np.arange(60) % 3 == 0, 1e200, 1e-200)[:, None]
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], "vec_id long, embedding array<double>, n string")
    got = rows(ann.nearest(df, F.col("vec_id") % 20 == 0, 3))
    unit = x / np.abs(x).max(1, keepdims=True)
    unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
    for q in (0, 20, 40):
        s = unit @ unit[q]
        s[q] = -2
        best = np.argsort(-s)[:3]
        assert [(r[1], r[2]) for r in sorted(got) if r[0] == q] == list(enumerate(best.tolist(), 1))
        assert np.allclose([r[3] for r in sorted(got) if r[0] == q], s[best], atol=1e-12)


def simhash_reference(text, size=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    sh = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, radius):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_simhash(docs, held):
    got = rows(simhash.near_duplicates(docs.where("doc_id is not null")))
    fps = {d: simhash_reference(t) for d, t in held if d is not None}
    groups = components(fps, 4)
    assert keyed(got) == keyed((d, f"{fps[d]:016x}", groups[d]) for d, _ in held if d is not None)
    assert len(rows(simhash.near_duplicates(docs))) == len(held) and not rows(simhash.near_duplicates(empty(docs)))


@pytest.mark.parametrize(("radius", "bucket", "few"), [(4, 16384, 64), (4, 3, 64), (3, 3, 64), (4, 16384, 2)])
def test_covering_finds_every_link(spark, monkeypatch, radius, bucket, few):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(simhash, "ALL_LINKS", few)
    rng = random.Random(9)
    fps = [rng.getrandbits(64) for _ in range(12)]
    for f in list(fps):
        fps += [f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))) for _ in range(8)]
    fps = sorted(set(fps))
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps] + [(None,)], "fp long")
    roots = dict(rows(connected_components(simhash.links_within(df, radius))))
    want = components(dict(enumerate(fps)), radius)
    group = {}
    for i, f in enumerate(fps):
        group.setdefault(want[i], set()).add(roots.get(simhash._signed(f), simhash._signed(f)))
    assert all(len(v) == 1 for v in group.values()) and len(set(map(frozenset, group.values()))) == len(group)


def test_deduplicate(spark, docs, texts):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    own = [[word() for _ in range(150)] for _ in range(6)]
    near = [[*w[:70], word(), *w[71:]] for w in own[:3]]
    half = [own[3][:75] + [word() for _ in range(75)]]
    shuffled = [sorted(own[4])]
    given = [" ".join(w) for w in [*own, *near, *half, *shuffled, own[0], sorted(own[4])]]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(given)] + [(2, given[2], "x")], "doc_id long, text string, _key string")
    got = simhash.deduplicate(df)
    assert sorted(r["doc_id"] for r in got.collect()) == [0, 1, 2, 3, 4, 5, 9, 10] and got.columns == df.columns
    assert not rows(simhash.deduplicate(empty(docs))) and simhash.deduplicate(docs).count() < docs.count()


def test_language_id(spark):
    rng = random.Random(7)
    common = {"en": "the of and to in that it is was for".split(), "de": "der die und das nicht ist mit sich auf ein".split(), "fr": "le la les des et est une que dans pour".split(), "es": "el los las una que en por con para del".split()}
    given = [(i, " ".join(rng.choices(common[k], k=30)), k) for i, k in enumerate(rng.choices(list(common), k=400))] + [(900, None, "en"), (901, "", "fr"), (902, "12 +- ½ 3", "de"), (903, "the of and", None)]
    df = spark.createDataFrame([(*g, "x") for g in given], "doc_id long, text string, lang string, _found string")
    model = langid.train(df.where(~langid.held_out()), F.col("doc_id"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"], r["held_out"]) for r in langid.identify(df, model).withColumn("held_out", langid.held_out()).collect()}
    assert all(got[i][2] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= got[i][1] <= 1 for i in got)
    tested = [(i, k) for i, t, k in given if i < 900 and got[i][2]]
    assert sum(got[i][0] == k for i, k in tested) >= 0.97 * len(tested)
    assert {r["_found"] for r in langid.identify(df, model).collect()} == {"x"}
    assert [got[i][0] for i in (900, 901, 902, 903)] == ["und", "und", "und", "en"]
    none = langid.train(df.limit(0), F.col("doc_id"))
    assert {r["lang_pred"] for r in langid.identify(df, none).collect()} == {"und"} and langid.identify(df.limit(0), model).count() == 0
    one = langid.train(df.where("lang = 'en'"), F.col("doc_id"))
    assert {r["lang_pred"] for r in langid.identify(df.where("doc_id < 20"), one).collect()} == {"en"}
