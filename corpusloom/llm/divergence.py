"""Source divergence audit: how each source of a language differs from the others and from the language as a whole.

The first pass counts in how many documents of its language each term stands, and keeps those in enough of them. The second
deals the texts by language, slice of its vocabulary and share of its volume; in each part the kept terms come first, padded with
blanks, and make an Aho-Corasick automaton, which then counts their occurrences in the texts that follow. So an automaton holds
a bounded number of terms, and texts are only ever streamed past it. What it counts are sparse postings
(language, source, term, count); terms that two sources both lack are settled by formula.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import forget, partitions, released, small_batches, table, written
from corpusloom.llm.words import BEYOND_ASCII, LETTERS, RUN, blanks, runs

#: Terms of one automaton; languages with more have several slices.
TERMS = 100_000
#: Bytes of text (for each slice of its language) that one part is dealt.
SHARE = 32 << 20
#: Entries that a task counts before it hands them on.
HELD = 500_000
#: Bytes of words that a task of the second pass hands on at once.
HANDED = 4 << 20
#: Terms are matches of letters and all that is not ASCII.
_TABLE = blanks(LETTERS + BEYOND_ASCII)
_BYTES = np.frombuffer(bytes(range(256)).lower().translate(_TABLE), np.uint8)
#: Bytes of text that go past the automaton at once.
PASSED = 1 << 16
#: A number for each byte at each place in a term (places from 64 on have the same again); the blank after a term counts for nothing.
_NUMBERS = np.arange(1, 64 * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_NUMBERS = ((_NUMBERS ^ _NUMBERS >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32)
_NUMBERS[0x20::256] = 0


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (lang, text): in how many of the documents each term of a language stands, added up within the task."""
    held: dict[str, Counter] = defaultdict(Counter)
    size = 0

    def out() -> pa.RecordBatch:
        lang, terms, n = [], [], []
        for name, c in held.items():
            lang += [name] * len(c)
            terms += c.keys()
            n += c.values()
        held.clear()
        return pa.record_batch([pa.array(lang, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], ["lang", "term", "df"])

    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        for i, lang in enumerate(batch.column(0).to_pylist()):
            terms = set()
            for words in runs(texts[i].as_py(), _TABLE):
                terms.update(words)
            before = len(held[lang])
            held[lang].update(terms)
            size += len(held[lang]) - before
            if size >= HELD:
                yield out()
                size = 0
    yield out()


def _pieces(data: np.ndarray, at: np.ndarray, slices: np.ndarray) -> np.ndarray:
    """The slice of each term, of `slices` in all, from the bytes of terms that begin at the places `at` and may have a blank after them."""
    if not len(at):
        return np.zeros(0, np.int32)
    place = np.arange(len(data), dtype=np.int32) - np.repeat(at.astype(np.int32), np.diff(np.append(at, len(data))))
    h = np.add.reduceat(_NUMBERS[(place & 63) << 8 | data], at)
    h = (h ^ h >> np.uint32(15)) * np.uint32(0x85EBCA6B)
    return ((h >> np.uint32(8)) % slices.astype(np.uint32)).astype(np.int32)


def _joined(data: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that stand one after the other from the places `own` on: their terms, each with a blank, where each term begins, and the text that it is of."""
    given, data = data, np.full(len(data) + len(own) - 1, 0x20, np.uint8)
    for i, (x, y) in enumerate(zip(own[:-1].tolist(), own[1:].tolist())):
        data[x + i : y + i] = given[x:y]
    data = _BYTES[data]
    held = data != 0x20
    held[1:] |= held[:-1]
    # A byte is kept if it is a term's or the first blank after one.
    blank = data == 0x20
    first = held & ~blank
    first[1:] &= blank[:-1]
    text = np.searchsorted(own[1:] + np.arange(1, len(own)), np.flatnonzero(first), "right")
    return data[held], np.flatnonzero(first[held]), text


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (lang, source, slices, first, shares, salt, text): the words of each run of a text by slice, and the share that takes them; both follow from the row alone."""

    def out(data: np.ndarray, at: np.ndarray, text: np.ndarray, rows: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
        size, of = np.diff(np.append(at, len(data))), rows[text]
        piece = _pieces(data, at, slices[of])
        for p in range(int(piece.max(initial=-1)) + 1):
            own = piece == p
            ends = np.cumsum(np.bincount(text[own], size[own], len(rows)).astype(np.int64))
            some = np.flatnonzero(np.diff(ends, prepend=0))
            if not len(some):
                continue
            kept = data[np.repeat(own, size)]
            words = pa.Array.from_buffers(pa.string(), len(some), [None, pa.py_buffer(np.append(0, ends[some]).astype(np.int32)), pa.py_buffer(kept)])
            r = rows[some]
            share = pa.array((first[r] + (salt[r] + k) % shares[r]).astype(np.int32))
            yield pa.record_batch([batch.column(0).take(pa.array(r)), pa.array(np.full(len(r), p, np.int32)), share, batch.column(1).take(pa.array(r)), words], ["lang", "piece", "share", "source", "words"])

    for batch in batches:
        slices, first, shares, salt = (batch.column(c).to_numpy() for c in range(2, 6))
        texts = pc.fill_null(batch.column(6).cast(pa.large_binary()), b"")
        if not len(texts):
            continue
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        whole = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        a = 0
        while a < len(texts):
            b = int(np.searchsorted(ends, ends[a] + RUN, "right")) - 1
            if b > a:
                yield from out(*_joined(whole[ends[a] : ends[b]], ends[a : b + 1] - ends[a]), np.arange(a, b), 0)
            else:
                for k, words in enumerate(runs(texts[a].as_py(), _TABLE)):
                    run = np.frombuffer(b" ".join(words), np.uint8)
                    yield from out(*_joined(run, np.array([0, len(run)])), np.array([a]), k)
            a = max(b, a + 1)


def _recounted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (lang, piece, share, source, words) sorted so that kept terms (no source) come before the texts, and these by source: (lang, source, term, n) as the automaton finds them."""
    at, terms, found, source = None, [], None, None
    passing: list[str] = []
    size, hits, n_hits = 0, [], 0
    made, n_made = [], 0

    def passed() -> None:
        nonlocal size, n_hits
        hits.append(np.fromiter(map(itemgetter(1), found.iter(f" {' '.join(passing)} ")), np.int32))
        n_hits += len(hits[-1])
        passing.clear()
        size = 0

    def counted() -> None:
        """What the texts of one source have so far, as rows."""
        nonlocal n_hits, n_made
        if passing:
            passed()
        if n_hits:
            all_ = np.concatenate(hits)
            if 4 * len(all_) > len(terms):
                n = np.bincount(all_, minlength=len(terms))
                which = np.flatnonzero(n)
                n = n[which]
            else:
                which, n = np.unique(all_, return_counts=True)
            made.append(pa.record_batch([pa.array([at[0]] * len(which), pa.string()), pa.array([source] * len(which), pa.string()), listed.take(pa.array(which)), pa.array(n, pa.int64())], ["lang", "source", "term", "n"]))
            n_made += len(which)
        hits.clear()
        n_hits = 0

    def out() -> Iterator[pa.RecordBatch]:
        nonlocal n_made
        yield from pa.Table.from_batches(made).combine_chunks().to_batches() if made else ()
        made.clear()
        n_made = 0

    listed = pa.array([], pa.string())
    for batch in batches:
        for lang, piece, share, own, words in zip(*(c.to_pylist() for c in batch.columns)):
            if (lang, piece, share) != at or own != source:
                counted()
                if n_made >= HELD:
                    yield from out()
                if (lang, piece, share) != at:
                    at, terms, found = (lang, piece, share), [], None
                source = own
            if own is None:
                terms.append(words)
                continue
            if not terms:
                continue
            if found is None:
                found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
                for i, t in enumerate(terms):
                    found.add_word(f" {t} ", i)
                found.make_automaton()
                listed = pa.array(terms, pa.string())
            passing.append(words)
            size += len(words)
            if size >= PASSED:
                passed()
                if n_hits >= HELD:
                    counted()
    counted()
    yield from out()


def kept_terms(docs: DataFrame, least: int = 3) -> DataFrame:
    """(lang, term) of the terms that stand in at least so many documents of the language; docs has lang and text."""
    each = docs.select("lang", "text").mapInArrow(released(_frequencies), "lang string, term string, df long")
    return each.groupBy("lang", "term").agg(F.sum("df").alias("df")).where(F.col("df") >= least).select("lang", "term")


def occurrences(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, term, n) of the kept terms (lang, term) that occur in the texts of a source; docs has lang, source, text and salt, a number that tells rows apart."""
    spark = docs.sparkSession
    n = partitions(spark)
    # A language's sources stand one after the other and are cut where a share is full, so that a share has few sources and a large source many shares.
    volume = docs.groupBy("lang", "source").agg(F.sum(F.octet_length("text")).alias("bytes"))
    plan = kept.groupBy("lang").agg(F.ceil(F.count("*") / TERMS).cast("int").alias("slices")).join(volume, "lang")
    end = F.sum("bytes").over(Window.partitionBy("lang").orderBy("source").rowsBetween(Window.unboundedPreceding, 0))
    share = lambda at: F.floor(at / (F.lit(SHARE) * F.col("slices"))).cast("int")
    plan = plan.withColumn("end", end).select("lang", "source", "slices", share(F.col("end") - F.col("bytes")).alias("first"), share(F.greatest(F.col("end") - 1, F.lit(0))).alias("last"))
    plan = written(plan.select("lang", "source", "slices", "first", F.greatest(F.col("last") - F.col("first") + 1, F.lit(1)).alias("shares")), "plan")
    whole = plan.groupBy("lang").agg(F.first("slices").alias("slices"), F.max(F.col("first") + F.col("shares")).alias("shares"))
    texts = docs.join(plan, ["lang", "source"]).select("lang", "source", "slices", "first", "shares", "salt", "text").mapInArrow(released(_dealt), "lang string, piece int, share int, source string, words string")
    sliced = kept.join(whole, "lang").select("lang", "slices", "shares", "term").mapInArrow(_placed, "lang string, piece int, shares int, term string")
    terms = sliced.select("lang", "piece", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(None).cast("string").alias("source"), F.col("term").alias("words"))
    both = terms.unionByName(texts).repartition(n, "lang", "piece", "share").sortWithinPartitions("lang", "piece", "share", F.asc_nulls_first("source"))
    return both.mapInArrow(released(_recounted), "lang string, source string, term string, n long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (lang, slices, shares, term): the slice of each term, as `_dealt` gives it to the term's occurrences."""
    for batch in batches:
        terms = batch.column(3).cast(pa.large_binary())
        ends = np.frombuffer(terms.buffers()[1], np.int64)[terms.offset : terms.offset + len(terms) + 1] if len(terms) else np.zeros(1, np.int64)
        data = np.frombuffer(terms.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        piece = pa.array(_pieces(data, ends[:-1] - ends[0], batch.column(1).to_numpy()))
        yield pa.record_batch([batch.column(0), piece, batch.column(2), batch.column(3)], ["lang", "piece", "shares", "term"])


def _billionths(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(1e9 * (n + 1) / (total + terms)), in whole numbers of any size."""
    up = (n + 1).cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", up, (total + terms).cast("decimal(20,0)"))


def _gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q): at most (1e9)^2, which a long holds."""
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, least: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) of every language and source of docs, which has text, lang and source.

    Part `pair` has the other sources of the language with the sum of (p-q)^2/q over all kept terms, p being the source's smoothed
    share of the term (in billionths) and q the other's; part `term` the `top` terms that the source has more of than its
    language, by the same measure. Nulls are empty strings: a null text has no terms, a null language or source is one of
    its own, and is the same as an empty one. Ties go to the item that comes first in UTF-8; repeated rows count as often as they
    are there; texts of any length count as a whole; other columns play no part. A language without kept terms has pairs of
    value 0; no rows, no rows.
    """
    spark = docs.sparkSession
    salt = F.xxhash64(*[f"`{f.name}`" for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])
    held = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")], salt.alias("salt"))
    with small_batches(spark, 256):
        kept = written(kept_terms(held, least), "kept")
        posted = written(occurrences(held, kept), "postings")
    v = kept.groupBy("lang").agg(F.count("*").alias("v"))
    sizes = posted.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = held.select("lang", "source").distinct().join(v, "lang", "left").join(sizes, ["lang", "source"], "left")
    groups = written(groups.select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("total", F.lit(0)).alias("total")), "groups")
    zero = _billionths(F.lit(0), F.col("total"), F.col("v"))
    told = written(groups.where("v > 0").withColumn("p0", zero), "told")
    p = _billionths(F.col("n"), F.col("total"), F.col("v"))
    shares = written(posted.join(told, ["lang", "source"]).select("lang", "source", "term", "n", "p0", p.alias("p")), "shares")

    whole = posted.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    of_lang = told.groupBy("lang").agg(F.sum("total").alias("total"), F.first("v").alias("v"))
    q = whole.join(of_lang, "lang").select("lang", "term", _billionths(F.col("n"), F.col("total"), F.col("v")).alias("q"))
    terms = shares.join(q, ["lang", "term"]).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))

    # Of a term that one source of the pair has only the count matters, so such terms are added up by count; of one that both
    # have, what was added so for either is taken back. Terms that neither has are alike.
    counts = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("k"))
    others = told.select("lang", F.col("source").alias("other"), F.col("p0").alias("other_p0"))
    own = counts.join(told.select("lang", "source", "p0"), ["lang", "source"]).join(others, "lang").where("source != other")
    zeros = _gap(F.col("p0"), F.col("other_p0"))
    back = _gap(F.col("other_p0"), F.col("p0"))
    first = own.groupBy("lang", "source", "other").agg(F.sum(F.col("k") * (_gap(F.col("p"), F.col("other_p0")) - zeros)).alias("value"))
    second = own.groupBy("lang", F.col("other").alias("source"), F.col("source").alias("other")).agg(F.sum(F.col("k") * (_gap(F.col("other_p0"), F.col("p")) - back)).alias("value"))
    lists = shares.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "p", "p0"))).alias("at")).where("size(at) > 1")
    lists = lists.select("lang", "at", F.posexplode("at").alias("i", "x"))
    two = lists.select("lang", "x", F.explode(F.slice("at", F.col("i") + 2, F.size("at"))).alias("y"))
    change = lambda x, y: _gap(F.col(f"{x}.p"), F.col(f"{y}.p")) - _gap(F.col(f"{x}.p"), F.col(f"{y}.p0")) - _gap(F.col(f"{x}.p0"), F.col(f"{y}.p")) + _gap(F.col(f"{x}.p0"), F.col(f"{y}.p0"))
    shared = written(two.groupBy("lang", F.col("x.source").alias("a"), F.col("y.source").alias("b")).agg(F.sum(change("x", "y")).alias("ab"), F.sum(change("y", "x")).alias("ba")), "shared")
    ab = shared.select("lang", F.col("a").alias("source"), F.col("b").alias("other"), F.col("ab").alias("value"))
    ba = shared.select("lang", F.col("b").alias("source"), F.col("a").alias("other"), F.col("ba").alias("value"))
    neither = told.join(others, "lang").where("source != other").select("lang", "source", "other", (F.col("v") * zeros).alias("value"))
    none = groups.where("v = 0").join(groups.where("v = 0").select("lang", F.col("source").alias("other")), "lang").where("source != other").select("lang", "source", "other", F.lit(0).cast("long").alias("value"))
    pairs = first.unionByName(second).unionByName(ab).unionByName(ba).unionByName(neither).unionByName(none).groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= top))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: each language's sources against one another, and their terms against the language."""
    return audit(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
words AS (SELECT r, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT r) >= 3),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source, coalesce(v, 0) AS v FROM docs LEFT JOIN sizes USING (lang)),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
dense AS (SELECT g.lang, g.source, k.term, g.v, coalesce(c.n, 0) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + v) AS p FROM dense),
overall AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + v) AS q
  FROM (SELECT lang, term, any_value(v) AS v, sum(n) AS n FROM dense GROUP BY lang, term)),
pairs AS (
  SELECT g.lang, g.source, h.source AS item, coalesce(value, 0) AS value FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN (SELECT a.lang, a.source AS x, b.source AS y, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) s
  ON s.lang = g.lang AND s.x = g.source AND s.y = h.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM shares JOIN overall USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS r FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) FROM terms)
SELECT lang, source, part, item, value::BIGINT AS value, r::INT AS rank FROM ranked WHERE part = 'pair' OR r <= 200
"""
