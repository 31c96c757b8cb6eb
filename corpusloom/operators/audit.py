"""Profiles, duplicates and anomalies of a corpus."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.sources.shared import saved

BUCKETS = ((0, "0"), (30, "1-30"), (100, "31-100"), (300, "101-300"), (1000, "301-1000"), (3000, "1001-3000"), (10000, "3001-10000"))
LAST_BUCKET = "10001+"


def build_documents(raw: DataFrame, text: str = "text", source: str = "source", title: str | None = None) -> DataFrame:
    """raw with title (else of its first line), normalised text, lengths and flags."""
    norm = T.normalize_text(F.col(text))
    named = F.col(title) if title else F.left(F.split_part(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(1)), F.lit(60))
    d = raw.withColumns({"title": T.normalize_title(named), "normalized_text": norm})
    d = d.withColumns({"text_length": F.char_length("normalized_text"), "char_count_no_space": F.char_length(F.regexp_replace("normalized_text", " ", ""))})
    flags = F.array_compact(F.array(F.when(F.col("text_length") == 0, "empty_body"), F.when(F.col("text_length").between(1, 29), "short_body")))
    return d.withColumns({"publish_source": F.col(source), "quality_flags": flags, "structure_hints": T.structure_hints(F.col("normalized_text"))})


def missing_fields(docs: DataFrame, fields: list[str]) -> DataFrame:
    """(field, missing, rate) of each field, in one pass."""
    counts = docs.agg(F.count("*").alias("_n"), *[F.count_if(~T.present(F.col(f).cast("string"))).alias(f) for f in fields])
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("missing")) for f in fields]))
    return counts.select("_n", rows.alias("r")).select("r.field", "r.missing", (F.col("r.missing") / F.greatest("_n", F.lit(1))).alias("rate"))


def length_profile(docs: DataFrame, length: str = "text_length") -> DataFrame:
    c = F.col(length)
    return docs.agg(F.count("*").alias("n_docs"), F.min(c).cast("long").alias("min_length"), F.max(c).cast("long").alias("max_length"), F.sum(c).cast("long").alias("sum_length"), F.avg(c).alias("mean_length"))


def length_bucket(c: Column) -> Column:
    out = F.lit(LAST_BUCKET)
    for most, name in reversed(BUCKETS):
        out = F.when(c <= most, F.lit(name)).otherwise(out)
    return out


def length_histogram(docs: DataFrame, length: str = "text_length") -> DataFrame:
    """All eight buckets with their numbers, empty ones too."""
    names = docs.sparkSession.createDataFrame([(n,) for _, n in BUCKETS] + [(LAST_BUCKET,)], "bucket string")
    counts = docs.groupBy(length_bucket(F.col(length)).alias("bucket")).agg(F.count("*").alias("n"))
    return names.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def distribution(docs: DataFrame, column: Column, most: int | None = None) -> DataFrame:
    """(key, n) by descending number, then key; null keys are UNKNOWN."""
    counts = docs.groupBy(F.coalesce(column.cast("string"), F.lit("UNKNOWN")).alias("key")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "key").limit(most) if most else counts


def _fingerprint(field: Column) -> Column:
    """Null for blank values."""
    return F.when(T.present(field), T.content_hash(F.btrim(field)))


def _fingerprinted(docs: DataFrame, field: Column, doc_id: str) -> DataFrame:
    return docs.where(T.present(field)).select(T.content_hash(F.btrim(field)).alias("fingerprint"), F.col(doc_id).alias("doc_id"))


def _groups(rows: DataFrame, kind: str) -> DataFrame:
    """exact_duplicates of rows (fingerprint, doc_id)."""
    ids = rows.groupBy("fingerprint").agg(F.array_sort(F.collect_list("doc_id")).alias("ids")).where(F.size("ids") > 1)
    return ids.select(F.lit(kind).alias("kind"), "fingerprint", F.size("ids").cast("long").alias("n"), F.array_join(F.col("ids").cast("array<string>"), "|").alias("doc_ids"))


def exact_duplicates(docs: DataFrame, field: Column, kind: str, doc_id: str = "doc_id") -> DataFrame:
    """(kind, fingerprint, n, doc_ids) of values that several documents share; blank ones do not count.

    For a report that lists a group's ids in a cell; `duplicate_members` has them as rows, whatever the size of a group.
    """
    return _groups(_fingerprinted(docs, field, doc_id), kind)


def duplicate_members(docs: DataFrame, field: Column, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, first_doc_id, n) of every document whose value others share: a row each, so that no group is gathered.

    Numbers and least ids are aggregated, combined before the shuffle; a large group is split by adaptive execution in the join.
    """
    rows = _fingerprinted(docs, field, doc_id)
    shared = rows.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc_id")).where("n > 1")
    return rows.join(shared, "fingerprint").select("doc_id", "first_doc_id", "n")


#: Bit planes that count to 255, more than the sampled trigrams of a text.
_PLANES = 8


def _bit_counts(grams: Column) -> Column:
    """(n, p): how many trigrams there are, and of their MD5s' 64 bits how many are set.

    All 64 bits are counted at once, within the row: plane k holds bit k of each of the 64 counts.
    """
    hashes = F.transform(grams, lambda g: F.conv(F.left(F.md5(g), F.lit(16)), 16, -10).cast("long"))

    def add(acc: Column, h: Column) -> Column:
        carry, planes = h, []
        for k in range(_PLANES):
            planes.append(acc[f"p{k}"].bitwiseXOR(carry).alias(f"p{k}"))
            carry = acc[f"p{k}"].bitwiseAND(carry)
        return F.struct(*planes)

    zero = F.struct(*[F.lit(0).cast("long").alias(f"p{k}") for k in range(_PLANES)])
    return T.let(hashes, lambda h: F.struct(F.size(h).alias("n"), F.aggregate(h, zero, add).alias("p")))


def _halves(rows: DataFrame) -> DataFrame:
    """simhash_halves of rows (doc_id, c) with the bit counts c."""
    # A bit is set if its count exceeds n // 2: counts and that number are compared from the highest plane down.
    over, same = F.lit(0).cast("long"), F.lit(-1).cast("long")
    for k in reversed(range(_PLANES)):
        plane, half = F.col(f"c.p.p{k}"), F.negate(F.shiftright("c.n", k + 1).bitwiseAND(F.lit(1)).cast("long"))
        over = over.bitwiseOR(same.bitwiseAND(plane).bitwiseAND(F.bitwise_not(half)))
        same = same.bitwiseAND(F.bitwise_not(plane.bitwiseXOR(half)))
    return rows.select("doc_id", over.alias("fp")).select("doc_id", F.shiftrightunsigned("fp", 32).alias("fp_hi"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("fp_lo"))


def simhash_halves(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp_hi, fp_lo): 64-bit SimHash of sampled trigrams' MD5, as two non-negative halves."""
    return _halves(docs.select(F.col(doc_id).alias("doc_id"), _bit_counts(T.sampled_ngrams(F.col(text))).alias("c")))


def hamming(a_hi: Column, a_lo: Column, b_hi: Column, b_lo: Column) -> Column:
    return F.bit_count(a_hi.bitwiseXOR(b_hi)) + F.bit_count(a_lo.bitwiseXOR(b_lo))


def near_duplicate_pairs(fps: DataFrame, threshold: int = 3, prefix_bits: int = 16) -> DataFrame:
    """(a, b, distance) of fingerprints within the threshold in the same prefix bucket, by their documents.

    Documents with equal fingerprints are compared once: pairs are between the least documents of different
    fingerprints, and each other document of a fingerprint with its least. Of the bits after the prefix there are
    threshold + 1 bands; two fingerprints meet in the first band in which they agree, as those within the threshold
    must in one, so a bucket is never compared all with all.
    """
    # Fingerprints are read three times and cost much more than they take.
    fps = saved(fps, "fingerprints")
    rest, bands = 64 - prefix_bits, threshold + 1
    cuts = [rest * k // bands for k in range(bands + 1)]
    part = lambda c, k: F.shiftrightunsigned(c, cuts[k]).bitwiseAND(F.lit((1 << (cuts[k + 1] - cuts[k])) - 1))
    least = fps.groupBy("fp_hi", "fp_lo").agg(F.min("doc_id").alias("doc_id"))
    rows = least.select("doc_id", F.shiftleft("fp_hi", 32).bitwiseOR(F.col("fp_lo")).alias("fp"))
    rows = rows.select("doc_id", "fp", F.explode(F.array(*[F.struct(F.lit(k).alias("band"), part(F.col("fp"), k).alias("value"), F.shiftrightunsigned("fp", rest).alias("bucket")) for k in range(bands)])).alias("at"))
    x, y = rows.alias("x"), rows.alias("y")
    apart = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    first = F.coalesce(*[F.when(part(apart, k) == 0, F.lit(k)) for k in range(bands)])
    close = x.join(y, (F.col("x.at") == F.col("y.at")) & (F.col("x.doc_id") < F.col("y.doc_id")))
    apart = F.bit_count(apart)
    close = close.where((first == F.col("x.at.band")) & (apart <= threshold))
    close = close.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"), apart.cast("long").alias("distance"))
    same = fps.join(least.select("fp_hi", "fp_lo", F.col("doc_id").alias("a")), ["fp_hi", "fp_lo"]).where("doc_id != a").select("a", F.col("doc_id").alias("b"), F.lit(0).cast("long").alias("distance"))
    return close.unionByName(same)


def near_duplicate_links(fps: DataFrame, threshold: int = 3) -> DataFrame:
    """(a, b, distance) of all documents a before b whose fingerprints are within the threshold, whatever bits differ and whoever shares them.

    Of threshold + 2 bands two such fingerprints agree in two at least; different ones meet in the first two in which they do, and
    each document of one is then linked with each of the other, as are those of one fingerprint.
    """
    fps = saved(fps.select("doc_id", F.shiftleft("fp_hi", 32).bitwiseOR(F.col("fp_lo")).alias("fp")), "fingerprints")
    bands = threshold + 2
    cuts = [64 * k // bands for k in range(bands + 1)]
    part = lambda c, k: F.shiftrightunsigned(c, cuts[k]).bitwiseAND(F.lit((1 << (cuts[k + 1] - cuts[k])) - 1))
    twos = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), part(F.col("fp"), i).alias("v"), part(F.col("fp"), j).alias("w")) for i, j in combinations(range(bands), 2)]
    rows = fps.select("fp").distinct().select("fp", F.explode(F.array(*twos)).alias("at"))
    x, y = rows.alias("x"), rows.alias("y")
    apart = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    agree = F.filter(F.array(*[F.when(part(apart, k) == 0, F.lit(k)) for k in range(bands)]), lambda k: k.isNotNull())
    first = (F.get(agree, 0) == F.col("x.at.i")) & (F.get(agree, 1) == F.col("x.at.j"))
    met = x.join(y, (F.col("x.at") == F.col("y.at")) & (F.col("x.fp") < F.col("y.fp"))).where((F.bit_count(apart) <= threshold) & first)
    met = met.select(F.col("x.fp").alias("f"), F.col("y.fp").alias("g"), F.bit_count(apart).cast("long").alias("distance"))
    of = lambda fp, name: fps.select(F.col("fp").alias(fp), F.col("doc_id").alias(name))
    like = met.join(of("f", "c"), "f").join(of("g", "d"), "g").select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b"), "distance")
    same = of("f", "a").join(of("f", "b"), "f").where("a < b").select("a", "b", F.lit(0).cast("long").alias("distance"))
    return like.unionByName(same)


def near_duplicate_groups(pairs: DataFrame) -> DataFrame:
    """(n, doc_ids): each later document with the earlier ones that it is near, those alike once."""
    ids = pairs.groupBy("b").agg(F.array_sort(F.collect_set("a")).alias("earlier"))
    listed = F.array_sort(F.array_union("earlier", F.array("b")))
    return ids.select(F.size(listed).alias("n"), F.array_join(listed.cast("array<string>"), "|").alias("doc_ids")).distinct()


def _rules(short: int, repeated: float, low: float) -> Column:
    """The anomalies of a document with its repeated_ratio."""
    rule = lambda when, name, severity: F.when(when, F.struct(F.lit(name).alias("anomaly"), F.lit(severity).alias("severity")))
    n, t = F.col("text_length"), F.col("normalized_text")
    rules = F.when(n == 0, F.array(rule(n == 0, "empty_body", "high"))).otherwise(
        F.array(
            rule(n < short, "very_short_body", "medium"),
            rule(T.is_probably_garbled(t), "garbled_text", "high"),
            rule(F.col("repeated_ratio") >= repeated, "template_repetition", "medium"),
            rule((T.low_information_ratio(t) > low) & (n >= short), "low_information_density", "low"),
        )
    )
    return F.array_compact(rules)


def anomalies(docs: DataFrame, short: int = 30, repeated: float = 0.5, low: float = 0.85, text: str = "text") -> DataFrame:
    """(doc_id, anomaly, severity), a row for each rule that holds; an empty body is only that. Repetition is measured on the raw lines."""
    lines = docs.withColumn("repeated_ratio", T.repeated_line_ratio(F.col(text)))
    return lines.select("doc_id", F.explode(_rules(short, repeated, low)).alias("r")).select("doc_id", "r.anomaly", "r.severity")


def audit_stage(raw: DataFrame, limit: int | None = None, order: tuple[str, ...] = ("doc_id",), text: str = "text", source: str = "source", title: str | None = None) -> dict[str, DataFrame]:
    """Everything an audit reports, as tables: documents, missing fields, lengths, distributions, anomalies, duplicates and their detail rows.

    limit stops the scan after so many records in the given order. Near duplicates are those of `near_duplicate_pairs`; `audit_for_review` has all.
    """
    docs, marks, duplicates, found = _audited(raw, limit, order, text, source, title)
    near = near_duplicate_groups(near_duplicate_pairs(_halves(marks)))
    return {
        "documents": docs,
        "missing": missing_fields(docs, ["title", text, source]),
        "profile": length_profile(docs),
        "histogram": length_histogram(docs),
        "sources": distribution(docs, F.col(source), 20),
        "anomalies": found,
        "anomaly_counts": found.groupBy("anomaly").agg(F.count("*").alias("n")),
        "detail": detail_rows(duplicates, near, found),
    }


def audit_for_review(raw: DataFrame) -> tuple[DataFrame, DataFrame, Callable[[], DataFrame]]:
    """(documents, detail, near): what `review_rows` picks from, detail with exact duplicates and anomalies, and near, which finds the rows of all near duplicates."""
    docs, marks, duplicates, found = _audited(raw)
    none = found.select(F.lit(0).alias("n"), F.lit("").alias("doc_ids")).limit(0)
    near = lambda: detail_rows(duplicates.limit(0), near_duplicate_groups(near_duplicate_links(_halves(marks))), found.limit(0))
    return docs, detail_rows(duplicates, none, found), near


def _audited(raw: DataFrame, limit: int | None = None, order: tuple[str, ...] = ("doc_id",), text: str = "text", source: str = "source", title: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents, marks, exact duplicates, anomalies) of an audit; marks has what is worked out of each text."""
    docs = build_documents(raw.orderBy(*order).limit(limit) if limit else raw, text, source, title)
    # Texts are read and normalised once for all findings.
    body = F.col("normalized_text")
    marks = docs.withColumn("repeated_ratio", T.repeated_line_ratio(F.col(text))).select(
        "doc_id", _fingerprint(F.col("title")).alias("title"), _fingerprint(body).alias("body"), _rules(30, 0.5, 0.85).alias("rules"), _bit_counts(T.sampled_ngrams(body, normalized=True)).alias("c")
    )
    marks = saved(marks, "marks")
    found = marks.select("doc_id", F.explode("rules").alias("r")).select("doc_id", "r.anomaly", "r.severity")
    titles, bodies = (_groups(marks.where(F.col(c).isNotNull()).select(F.col(c).alias("fingerprint"), "doc_id"), f"exact_{c}_duplicate") for c in ("title", "body"))
    return docs, marks, titles.unionByName(bodies), found


def detail_rows(duplicates: DataFrame, near: DataFrame, found: DataFrame) -> DataFrame:
    """(record_type, key, doc_ids, severity, note): duplicates, near duplicates, then anomalies, for one file."""
    none = F.lit(None).cast("string")
    size = lambda n: F.concat(F.lit("group of "), F.col(n).cast("string"))
    same = duplicates.select(F.col("kind").alias("record_type"), F.col("fingerprint").alias("key"), "doc_ids", none.alias("severity"), size("n").alias("note"))
    like = near.select(F.lit("near_duplicate").alias("record_type"), F.md5("doc_ids").alias("key"), "doc_ids", none.alias("severity"), size("n").alias("note"))
    odd = found.select(F.lit("anomaly").alias("record_type"), F.col("anomaly").alias("key"), F.col("doc_id").cast("string").alias("doc_ids"), "severity", none.alias("note"))
    return same.unionByName(like).unionByName(odd)


def review_rows(docs: DataFrame, detail: DataFrame, n: int, preview: int = 300, near: Callable[[], DataFrame] | None = None) -> DataFrame:
    """(sample_type, doc_id, title, source, text_length, flags, preview): n documents at random, n with anomalies and n duplicates.

    At random is by the order of the id's MD5; detail names the others, each document once, in the order of their first row.
    near gives rows of near duplicates that detail lacks. Their type comes after those of exact ones, so no document comes in by
    them, nor changes its place, where exact ones are n already; else all of them are found and take part.
    """
    kind = F.when(F.contains("record_type", F.lit("duplicate")), F.lit("duplicate")).otherwise(F.lit("anomaly"))
    order = Window.partitionBy("sample_type").orderBy("at", "doc_id")

    def firsts(detail: DataFrame) -> DataFrame:
        ids = detail.select("record_type", "key", F.posexplode(F.split("doc_ids", r"\|")).alias("pos", "id")).withColumn("doc_id", F.col("id").try_cast(docs.schema["doc_id"].dataType))
        rows = ids.withColumn("sample_type", kind).groupBy("sample_type", "doc_id").agg(F.min(F.struct("record_type", "key", "pos")).alias("at"))
        return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).select("sample_type", "doc_id")

    picked = firsts(detail)
    if near is not None:
        picked = saved(picked, "picked")
        if picked.where("sample_type = 'duplicate'").count() < n:
            picked = firsts(detail.unionByName(near()))
    chance = docs.select("doc_id").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(n).select(F.lit("random").alias("sample_type"), "doc_id")
    text = F.coalesce(*[F.col(c) for c in ("cleaned_text", "normalized_text") if c in docs.columns])
    # The picked ones are found once, and only their texts are worked on.
    picks = saved(chance.unionByName(picked), "picks")
    rows = docs.join(F.broadcast(picks.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", "title", F.col("publish_source").alias("source"), "text_length", F.array_join("quality_flags", "|").alias("flags"), F.left(text, F.lit(preview)).alias("preview"))
    return picks.join(rows, "doc_id").select("sample_type", "doc_id", "title", "source", "text_length", "flags", "preview")
