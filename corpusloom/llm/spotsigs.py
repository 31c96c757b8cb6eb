"""SpotSigs fingerprints: chains of content words that follow common words.

A signature is an anchor (a common word) with the two content words that follow it; a text's fingerprint
is the set of its signatures' hashes, and likeness is the Jaccard index of the sets. Everything runs as
DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import partitions, table, written
from corpusloom.llm.graph import connected_components

#: Common words of English, French, German and Spanish; none of them is a content word.
ANCHORS = tuple(
    (
        "a an and are as at be by for from has he in is it its of on or that the this to was were will with not but they "
        "au aux ce ces dans de des du elle en est et il la le les leur mais ou par pas pour que qui sa se son sur un une "
        "als auch auf aus das dem den der die ein eine einem einen einer es ich im ist mit nicht sich sie und von vor wie zu zum zur "
        "al como con del desde el ella ellos era esta este lo los las más me mi muy no o para pero por si sin su sus y ya"
    ).split()
)
#: Fingerprints of long texts are compared with those of a length that allows the similarity only.
THRESHOLD = 0.8
#: Signatures that COMMON_SETS of one in COMMON_SAMPLE different sets have come last in prefixes, COMMON of them at most.
COMMON, COMMON_SAMPLE, COMMON_SETS = 2000, 16, 4
#: Tables of at most so many rows are broadcast, others are shuffled.
BROADCAST_ROWS = 1_000_000


def with_signatures(df: DataFrame, text: Column, out: str) -> DataFrame:
    """df with the sorted, distinct 32-bit hashes of text's signatures.

    A text without any signature (too short, without anchors or words) has one: the hash of the whole text.
    A null text is empty.
    """
    word = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    # An anchor ends with a space and a content word with a line end, so that each line is a content word with its anchors.
    marked = F.transform(word, lambda w: F.concat(w, F.when(w.isin(*ANCHORS), F.lit(" ")).otherwise(F.lit("\n"))))
    lines = df.withColumn("_lines", F.split(F.array_join(marked, ""), "\n"))
    n = F.greatest(F.size("_lines") - 2, F.lit(0))

    def signatures(u: Column, v: Column) -> Column:
        chain = F.concat(F.lit(" "), F.substring_index(u, " ", -1), F.lit(" "), F.substring_index(v, " ", -1))
        parts = F.split(u, " ")
        return F.when(F.contains(u, F.lit(" ")), F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda a: F.hash(F.concat(a, chain)))).otherwise(F.array().cast("array<int>"))

    found = F.flatten(F.zip_with(F.slice("_lines", 1, n), F.slice("_lines", 2, n), signatures))
    sets = lines.withColumn("_found", F.sort_array(F.array_distinct(found)))
    return sets.withColumn(out, F.when(F.size("_found") > 0, F.col("_found")).otherwise(F.array(F.hash(text)))).drop("_lines", "_found")


def name_of(signatures: Column) -> Column:
    """A set of signatures as text: eight hexadecimal digits each, in order."""
    return F.array_join(F.transform(signatures, lambda h: F.right(F.concat(F.lit("0000000"), F.lower(F.hex(h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))))), F.lit(8))), "")


def likeness(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def _bucketed(docs: DataFrame, buckets: int) -> tuple[DataFrame, list]:
    """docs with their bucket in descending order of doc_id, and each bucket's greatest doc_id.

    The bounds are percentiles of all ids, at most `buckets` numbers; they are searched in two steps.
    """
    cuts = docs.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], max(10_000, 20 * buckets))).first()[0] or []
    cuts = sorted(set(cuts), reverse=True)
    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    longs = lambda x: F.array(*[F.lit(v).cast("long") for v in x]).cast("array<long>")
    if groups:
        coarse = F.size(F.filter(longs([g[-1] for g in groups]), lambda c: c > F.col("doc_id")))
        fine = F.coalesce(F.size(F.filter(F.get(F.array(*[longs(g) for g in groups]), coarse), lambda c: c > F.col("doc_id"))), F.lit(0))
        number = F.least(coarse * step + F.greatest(fine, F.lit(0)), F.lit(len(cuts)))
    else:
        number = F.lit(0)
    out = docs.withColumn("_bucket", F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(number).cast("int"))
    firsts = {r[0]: r[1] for r in out.groupBy("_bucket").agg(F.max("doc_id")).collect()}
    return out, [firsts.get(b, False) for b in range(len(cuts) + 2)]


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the signatures of text, and text and signatures of the next row in descending doc_id.

    The last row's next is the first. Rows with a null doc_id come last; rows that share a doc_id follow each other
    in the order of their texts. Texts are shuffled once: each bucket of ids also gets the first row of the next.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d, firsts = _bucketed(d, 4 * partitions(spark))
    held = [b for b, first in enumerate(firsts) if first is not False]
    before = {b: held[i - 1] for i, b in enumerate(held)}
    longs = F.array(*[F.lit(None if f is False else f).cast("long") for f in firsts])
    to = F.element_at(F.array(*[F.lit(before.get(b, 0)) for b in range(len(firsts))]), F.col("_bucket") + 1)
    is_first = F.col("doc_id").eqNullSafe(F.element_at(longs, F.col("_bucket") + 1))
    own, copy = F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("copy")), F.struct(to.alias("b"), F.lit(True).alias("copy"))
    rows = d.withColumn("_to", F.explode(F.when(is_first, F.array(own, copy)).otherwise(F.array(own)))).select(F.col("_to.b").alias("_bucket"), F.col("_to.copy").alias("_copy"), "doc_id", "text")
    dealt = with_signatures(rows.repartition(partitions(spark), "_bucket"), F.col("text"), "sigs")
    order = Window.partitionBy("_bucket").orderBy("_copy", F.col("doc_id").desc_nulls_last(), "text")
    following = dealt.withColumns({"next_text": F.lead("text").over(order), "next_sigs": F.lead("sigs").over(order)})
    return following.where("not _copy").drop("_bucket", "_copy")


def edited_fingerprints(docs: DataFrame, groups: bool = False) -> DataFrame:
    """Each row's fingerprint, how near it is to that of its edited text and of the next document, and its group (group_id) if asked for.

    group_id is the least doc_id that links of at least THRESHOLD lead to, found by the partitioned, pruned comparison of
    all fingerprints; rows with equal fingerprints are linked. A null text is empty; a very long one is one row's array of
    hashes. Rows that repeat follow each other and come out as often; no rows, no rows; columns other than doc_id and text
    are not read.
    """
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    rows = rows.withColumn("edited", F.concat(F.left("text", (F.col("n_chars") - half).cast("int")), F.left("next_text", half))).drop("text", "next_text")
    rows = with_signatures(rows, F.col("edited"), "edited_sigs")
    group = F.col("doc_id")
    if groups:
        found = written(near_duplicate_groups(docs).select(F.col("h").alias("_h"), F.col("g").alias("_g"), "group_id"), "groups")
        named = [c.alias(n) for c, n in zip(_key(F.col("sigs")), ("_h", "_g"))]
        rows = rows.select("*", *named).join(_bounded(found), ["_h", "_g"], "left")
        group = F.coalesce("group_id", "doc_id")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        name_of(F.col("sigs")).alias("fingerprint"),
        name_of(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
        *[group.alias("group_id")] * groups,
    )


def _key(sigs: Column) -> tuple[Column, Column]:
    """128 bits that stand for a set of signatures."""
    return F.xxhash64(sigs), F.xxhash64(F.lit(1), sigs)


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def common_signatures(sets: DataFrame, sigs: str = "sigs") -> list[int]:
    """Signatures that several sets of a sample have, the most frequent COMMON of them at most; they come last in prefixes, which decides the work alone."""
    some = sets.where(F.pmod(F.xxhash64(sigs), F.lit(COMMON_SAMPLE)) == 0).select(F.explode(sigs).alias("s"))
    each = some.groupBy("s").count().where(F.col("count") >= COMMON_SETS)
    return [r["s"] for r in each.orderBy(F.desc("count"), "s").limit(COMMON).collect()]


def near_pairs(sets: DataFrame, threshold: float = THRESHOLD, sigs: str = "sigs", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(membership (key, class_id), pairs (a, b, similarity) between classes) of near-duplicate signature sets.

    Rows with equal sets are one class, named by its least key. Sets meet through the signatures of their prefixes: of a
    set of n the first n - ceil(threshold * n) + 1 in an order that all share. Set lengths are partitioned, and a set is
    compared with smaller ones of its own and the next lower partition only, if lengths allow the similarity and the two
    share as many prefix signatures as their lengths demand. What is left is compared by Jaccard.
    """
    h, g = _key(F.col(sigs))
    classes = _classes(sets.select(F.col(key).alias("k"), F.col(sigs).alias("sigs")))
    member = sets.select(F.col(key).alias(key), h.alias("h"), g.alias("g")).join(classes.select("h", "g", "class_id"), ["h", "g"]).select(key, "class_id")
    found = _compared(_met(_prefixes(classes, threshold), threshold), classes, threshold)
    return member, found.select("a", "b", "similarity")


def _classes(sets: DataFrame) -> DataFrame:
    """(h, g, class_id, n_rows, sigs, number) of the different sets of (k, sigs); number is one of their own."""
    h, g = _key(F.col("sigs"))
    classes = sets.select("k", "sigs", h.alias("h"), g.alias("g")).groupBy("h", "g").agg(F.min("k").alias("class_id"), F.count("*").alias("n_rows"), F.first("sigs").alias("sigs"))
    return written(classes.withColumn("number", F.monotonically_increasing_id()), "classes")


def _length(n: Column, threshold: float) -> Column:
    return (n - F.ceil(n * threshold - 1e-9) + 1).cast("int")


def _prefixes(classes: DataFrame, threshold: float) -> DataFrame:
    """(number, n, s) of the signatures in each set's prefix, dealt by signature."""
    common = common_signatures(classes)
    often = lambda x: x.isin(common) if common else F.lit(False)
    ordered = F.concat(F.filter("sigs", lambda x: ~often(x)), F.filter("sigs", often))
    n = F.size("sigs")
    return classes.select("number", n.alias("n"), F.explode(F.slice(ordered, 1, _length(n, threshold))).alias("s")).repartition(partitions(classes.sparkSession), "s")


def _enough(met: DataFrame, threshold: float, best: bool = False) -> DataFrame:
    """(x, y) of pairs met (x, y, na, nb) that share as many prefix signatures as their lengths demand; if asked for, of each y the pair that shares most."""
    na, nb = F.col("na"), F.col("nb")
    needed = F.ceil(F.least(_length(na, threshold) - na, _length(nb, threshold) - nb) + (na + nb) * (threshold / (1 + threshold)) - 1e-6)
    met = met.groupBy("x", "y", "na", "nb").agg(F.count("*").alias("shared")).where(F.col("shared") >= F.greatest(needed, F.lit(1)))
    if best:
        met = met.groupBy("y").agg(F.max_by("x", F.struct("shared", -F.col("x"))).alias("x"))
    return written(met.select("x", "y"), "met")


def _met(prefix: DataFrame, threshold: float, labels: DataFrame | None = None, best: bool = False) -> DataFrame:
    """(x, y) of all sets that may be similar, the shorter one first; with labels (number, label) only those of different labels.

    If asked for, of each y only the x that shares most with it: no more pairs than sets.
    """
    if labels is not None:
        prefix = prefix.join(_bounded(labels), "number", "left").withColumn("label", F.coalesce("label", "number"))
    # Partitions of lengths are four times as wide as the similarity allows lengths to differ.
    part = lambda c: F.floor(F.log(c) / F.log(F.lit(1 / threshold**4)) + 1e-9)
    a, b = prefix.alias("a"), prefix.alias("b")
    na, nb, low = F.col("a.n"), F.col("b.n"), F.col("b.n") * threshold - 1e-9
    fits = (na >= low) & ((na < nb) | ((na == nb) & (F.col("a.number") < F.col("b.number"))))
    together = (part(na) == part(nb)) | (part(na) == part(F.greatest(low, F.lit(1.0))))
    apart = F.lit(True) if labels is None else F.col("a.label") != F.col("b.label")
    met = a.join(b, (F.col("a.s") == F.col("b.s")) & together & fits & apart)
    return _enough(met.select(F.col("a.number").alias("x"), F.col("b.number").alias("y"), na.alias("na"), nb.alias("nb")), threshold, best)


def _compared(met: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(x, y, a, b, similarity) of the pairs met that are similar."""
    wanted = written(met.select(F.explode(F.array("x", "y")).alias("number")).distinct(), "wanted")
    few = written(classes.join(_bounded(wanted), "number", "left_semi").select("number", "class_id", "sigs"), "compared")
    left, right = (few.select(F.col("number").alias(m), F.col("class_id").alias(c), F.col("sigs").alias(v)) for m, c, v in (("x", "a", "sa"), ("y", "b", "sb")))
    pairs = met.join(left, "x").join(right, "y").withColumn("similarity", likeness(F.col("sa"), F.col("sb")))
    return pairs.where(F.col("similarity") >= threshold).select("x", "y", "a", "b", "similarity")


def near_duplicate_groups(docs: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(h, g, group_id) of the signature sets that several rows have or that are linked: the least doc_id that links lead to.

    First each set is compared with the one that shares most with it, which joins most groups by as many links as they
    have members; so once more, between different groups; then all pairs of different groups that may be similar are.
    """
    held = docs.select(F.col(doc_id).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    classes = _classes(with_signatures(held, F.col("_t"), "sigs").select("k", "sigs"))
    prefix = _prefixes(classes, threshold)
    links = labels = None
    for best in (True, True, False):
        found = written(_compared(_met(prefix, threshold, labels, best), classes, threshold).select("x", "y"), "links")
        links = found if links is None else links.unionByName(found)
        labels = connected_components(links, "x", "y", native=True).select(F.col("node").alias("number"), F.col("root").alias("label"))
    roots = labels.withColumnRenamed("label", "root")
    named = classes.select("h", "g", "number", "class_id", "n_rows").join(roots, "number", "left").where("n_rows > 1 or root is not null")
    best = named.groupBy("root").agg(F.min("class_id").alias("least"))
    return named.join(best.where("root is not null"), "root", "left").select("h", "g", F.coalesce("least", "class_id").alias("group_id"))


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SpotSigs fingerprints of all documents, against their edited texts and their neighbours."""
    return edited_fingerprints(table(spark, sf_dir, "documents"))
