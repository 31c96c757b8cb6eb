"""Personal data, and terms that disclose it, found and sanitised by corpus co-occurrence.

Base spans (email, ip, card, phone) are found by patterns. Protected entities are their values, and what values
share: a mail domain, a network, the first digits of a card or phone number. How strongly a term reveals an entity
is their pointwise mutual information over the documents of the corpus, against the entity's information content.
A term that exceeds the disclosure threshold is generalised, or removed, wherever it stands in a text that holds the
entity; if documents with the term nearly always hold the entity, it discloses that in the others too, and goes
there as well. Generalising puts the term's class in its place: the words that begin with the same letters, as many
of them as keep the class below the threshold. Everything runs as DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import fresh, table, written

#: The kinds in the order in which spans at one place are listed.
KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Runs are possessive and begin where a run can begin or the last match ended, so that no text takes more than linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a match that counts: a character, or a shorter pattern. Other texts are not searched.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){13}", "phone": "+"}
#: Of n documents with both, n / (n + DISCOUNT) count: what few documents share may be chance, however rare it is.
DISCOUNT = 1
#: A term that reveals this share of an entity's information is generalised; from REMOVE on it is removed.
DISCLOSE, REMOVE = 0.8, 0.98
#: A term discloses an entity in texts without it too if this share of its documents (discounted) hold the entity.
CERTAIN = 0.8
#: A term is a whole run of letters, of this many at least; its classes are the words that share its first letters, up to CLASS of them.
TERM = r"(?<!\p{L})\p{L}{3,}+"
CLASS = 4
#: Digits of a card or phone number that entities of one group share.
GROUP_DIGITS = 6
#: Tables of at most so many rows are broadcast, others are shuffled.
BROADCAST_ROWS = 200_000
_OPEN, _SHUT = "\ue000", "\ue001"
_SPANS, _TERMS = "array<struct<start:int,kind:int,end:int,value:string>>", "array<struct<start:int,end:int,share:double,by:string>>"


def _let(value: Column, f) -> Column:
    """f of value, which is evaluated once."""
    return F.get(F.transform(F.array(value), f), 0)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _in_blocks(items: Column, even: bool, f) -> Column:
    """f of the array's items as blocks of about the square root of their number, so that appending within one stays cheap."""
    def blocks(x: Column) -> Column:
        width = (F.ceil(F.sqrt(F.size(x)) / 2) * 2 if even else F.ceil(F.sqrt(F.size(x)))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / width).cast("int")), lambda b: F.slice(x, b * width + 1, width))

    return _let(items, lambda x: _let(blocks(x), f))


def _befores(values: Column, join) -> Column:
    """For each of an array of ints what join makes of 0 and all before it."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(values, start, lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])


def _cut(text: Column, pattern: str | Column) -> Column:
    """Struct (start, end, value) of each match; places in code points. The marks are replaced in the text first, one for one."""
    parts = F.split(F.regexp_replace(F.translate(text, _OPEN + _SHUT, "\ufffd\ufffd"), pattern, f"{_OPEN}$0{_SHUT}"), f"[{_OPEN}{_SHUT}]", -1)
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(acc: Column, part: Column) -> Column:
        stop = acc["at"] + F.char_length(part)
        span = F.array(F.struct(acc["at"].alias("start"), stop.alias("end"), part.alias("value")))
        return F.struct(stop.alias("at"), (~acc["inside"]).alias("inside"), F.when(acc["inside"], F.concat(acc["found"], span)).otherwise(acc["found"]).alias("found"))

    def found(blocks: Column) -> Column:
        # Parts outside and inside matches take turns, and blocks are of even size: each begins outside.
        starts = _befores(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + F.char_length(x))), lambda a, x: a + x)
        return F.flatten(F.zip_with(blocks, starts, lambda b, at: F.aggregate(b, F.struct(at.alias("at"), F.lit(False).alias("inside"), none.alias("found")), step, lambda acc: acc["found"])))

    return _in_blocks(parts, True, found)


def _replaced(text: Column, cuts: Column) -> Column:
    """text with each of its cuts (start, end, by), in order of start, replaced; one that begins within an earlier one goes with it."""

    def joined(blocks: Column) -> Column:
        last = F.transform(blocks, lambda b: F.array_max(F.transform(b, lambda s: s["end"])))
        begins = _befores(last, F.greatest)

        def block(b: Column, first: Column) -> Column:
            def run(own: Column) -> Column:
                def step(acc: Column, s: Column) -> Column:
                    gap = F.substring(own, acc["at"] - first + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
                    new = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(gap, s["by"]))).otherwise(acc["out"])
                    return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), new.alias("out"))

                return F.aggregate(b, F.struct(first.alias("at"), F.array().cast("array<string>").alias("out")), step, lambda acc: acc["out"])

            return _let(F.substring(text, first + 1, F.greatest(F.element_at(b, -1)["start"] - first, F.lit(0))), run)

        done = F.array_join(F.flatten(F.zip_with(blocks, begins, block)), "")
        return F.concat(done, F.substring(text, F.array_max(last) + 1, F.lit((1 << 31) - 1)))

    return F.when(F.size(cuts) > 0, _in_blocks(cuts, False, joined)).otherwise(text)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits pass Luhn's check."""
    d = F.transform(F.split(F.reverse(_digits(value)), ""), lambda x, i: F.when(i % 2 == 0, x.try_cast("int")).otherwise(F.get(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), x.try_cast("int"))))
    return F.aggregate(d, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    n = F.length(_digits(value))
    if kind == "card":
        return n.between(14, 19) & _luhn(value)
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<start, kind number, end, value>> of the base spans by start, then kind; null for none.

    Leftmost and non-overlapping per kind; matches that fail their check are dropped and not tried again.
    """
    return F.array_sort(F.concat(*[_kind_spans(text, k, kind) for k, kind in enumerate(KINDS)]))


def _kind_spans(text: Column, k: int, kind: str) -> Column:
    valid = F.filter(_cut(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"]))
    spans = F.transform(valid, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
    return F.when(_could_hold(text, kind), spans).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>"))


def _could_hold(text: Column, kind: str) -> Column:
    return F.contains(text, F.lit(HINTS[kind])) if kind in ("email", "phone") else F.rlike(text, F.lit(HINTS[kind]))


def listed(spans: Column) -> Column:
    """kind:start:end of spans in order, comma-joined."""
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _values(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(_values(text), F.lower))


def _entities(span: Column) -> Column:
    """What a span holds that is protected: its value, and the group of values that it belongs to."""
    kind, value = F.get(F.array(*[F.lit(k) for k in KINDS]), span["kind"]), F.lower(span["value"])
    group = F.when(span["kind"] == 0, F.concat(F.lit("*@"), F.substring_index(value, "@", -1))).when(span["kind"] == 1, F.concat(F.substring_index(value, ".", 3), F.lit(".*")))
    group = F.coalesce(group, F.concat(F.left(_digits(value), F.lit(GROUP_DIGITS)), F.lit("*")))
    return F.array(F.concat_ws(":", kind, value), F.concat_ws(":", kind, group))


def _counted(n: Column) -> Column:
    return n * n / (n + DISCOUNT)


def shares(texts: DataFrame, frequencies: DataFrame, total: int, disclose: float = DISCLOSE, certain: float = CERTAIN) -> tuple[DataFrame, DataFrame]:
    """What terms disclose: (entity, term, df_entity, df_term, df_both, share, sure) from `disclose` on, and (id, term, share) where they stand.

    texts has (id, text, n_docs, spans), a row per different text with base spans; frequencies has the number of
    documents of each term of the corpus. The share is PMI(term; entity) / information of the entity, over all
    documents, with the documents that have both discounted. Every entity counts that not all documents hold, and
    every term of its texts; sure are terms of which `certain` of the documents hold the entity.
    """
    own = texts.select("id", "n_docs", F.explode(F.array_distinct(F.flatten(F.transform("spans", _entities)))).alias("entity"))
    of_entity = own.groupBy("entity").agg(F.sum("n_docs").alias("df_entity")).where(F.col("df_entity") < total)
    own = written(own.join(of_entity, "entity"), "entities")
    information = F.log2(F.lit(float(total)) / F.col("df_entity"))
    least = own.groupBy("id").agg(F.min(information).alias("least"))
    terms = texts.select("id", F.explode(_terms(F.col("text"))).alias("term"))
    # What all entities of a text together cannot make disclosing goes first: PMI is at most the term's own information.
    rare = terms.join(frequencies.hint("merge"), "term").join(least, "id").where(F.log2(F.lit(float(total)) / F.col("df_term")) >= disclose * F.col("least") - 1e-9)
    rare = written(rare.select("id", "term", "df_term"), "rare")
    both = rare.join(own, "id").groupBy("entity", "term", "df_term", "df_entity").agg(F.sum("n_docs").alias("df_both"))
    counted = _counted(F.col("df_both"))
    share = F.log2(counted * F.lit(float(total)) / (F.col("df_term") * F.col("df_entity"))) / information
    sure = (counted / F.col("df_term") >= certain) & (F.col("df_both") < F.col("df_term"))
    flagged = both.withColumns({"share": share, "sure": sure}).where(F.col("share") >= disclose)
    flagged = written(flagged.select("entity", "term", "df_entity", "df_term", "df_both", "share", "sure"), "flagged")
    places = rare.join(own.select("id", "entity"), "id").join(flagged.select("entity", "term", "share"), ["entity", "term"])
    return flagged, places.select("id", "term", "share")


def classes(flagged: DataFrame, frequencies: DataFrame, total: int, disclose: float = DISCLOSE) -> DataFrame:
    """(term, class): the longest beginning of each flagged term, shorter than it, whose words together disclose no entity that it does.

    A class is as frequent as its words' document frequencies together; every document with the entity is taken to hold
    one of them. Terms without such a beginning are not listed.
    """
    information = F.log2(F.lit(float(total)) / F.col("df_entity"))
    least = _counted(F.col("df_entity").cast("double")) * F.lit(float(total)) / F.col("df_entity") / F.pow(F.lit(2.0), F.lit(disclose) * information)
    need = flagged.groupBy("term").agg(F.max(least).alias("least"))
    begins = lambda t: F.explode(F.transform(F.sequence(F.lit(1), F.least(F.char_length(t) - 1, F.lit(CLASS))), lambda n: F.left(t, n)))
    sizes = frequencies.select(begins(F.col("term")).alias("class"), "df_term").groupBy("class").agg(F.sum("df_term").alias("df_class"))
    fits = need.select("term", "least", begins(F.col("term")).alias("class")).join(sizes, "class").where("df_class > least")
    return fits.groupBy("term").agg(F.max_by("class", F.char_length("class")).alias("class"))


def disclosing_terms(texts: DataFrame, corpus: DataFrame, disclose: float = DISCLOSE, remove: float = REMOVE, certain: float = CERTAIN) -> DataFrame:
    """(text_key, terms): the terms of each text that go, at all their places outside base spans, with their share and what replaces them."""
    total = corpus.count()
    df = written(corpus.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df_term")), "frequencies")
    flagged, found = shares(texts, df, total, disclose, certain)
    by = F.when(F.col("share") >= remove, F.lit("")).otherwise(F.coalesce(F.concat("class", F.lit("*")), F.lit("")))
    escaped = written(flagged.where("sure").groupBy("term").agg(F.max("share").alias("share")), "escaped")
    held = texts.select("id", "text_key", "text", "spans")
    if not escaped.isEmpty():
        keyed = corpus.select(F.sha2("text", 256).alias("text_key"), "text")
        there = written(keyed.select("text_key", F.explode(_terms(F.col("text"))).alias("term")).join(_small(escaped), "term").distinct(), "elsewhere")
        new = written(there.select("text_key").distinct().join(held.select("text_key"), "text_key", "left_anti").withColumn("id", -1 - F.monotonically_increasing_id()), "others")
        others = keyed.join(_small(new), "text_key").groupBy("id", "text_key").agg(F.first("text").alias("text"))
        held = held.unionByName(others.withColumn("spans", F.array().cast(_SPANS)))
        ids = held.select("id", "text_key")
        found = found.unionByName(there.join(ids, "text_key").select("id", "term", "share"))
    most = found.groupBy("id", "term").agg(F.max("share").alias("share")).join(classes(flagged, df, total, disclose), "term", "left")
    told = written(most.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", F.struct("share", by.alias("by"))))).alias("told")), "terms")
    # Base spans are blanked; then the words as the text has them are looked for, which are of letters alone, and whole runs.
    blank = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.repeat(F.lit(" "), s["end"] - s["start"]).alias("by")))
    words = F.filter(_values(F.col("text")), lambda w: F.map_contains_key(F.col("told"), F.lower(w)))
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(words, "|"), F.lit(r")(?!\p{L})"))
    places = held.join(told, "id").withColumns({"pattern": pattern, "plain": _replaced(F.col("text"), blank)})
    of = lambda t: F.element_at(F.col("told"), F.lower(t["value"]))
    return places.select("text_key", F.transform(_cut(F.col("plain"), F.col("pattern")), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), of(t)["share"].alias("share"), of(t)["by"].alias("by"))).alias("terms"))


def _found(docs: DataFrame, text: str) -> DataFrame:
    """(id, text_key, text, n_docs, spans) of the different texts that have base spans; id is a number of their own."""
    held = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    hits = held.withColumn("spans", base_spans(F.col("text"))).where(F.size("spans") > 0).withColumn("text_key", F.sha2("text", 256))
    hits = hits.groupBy("text_key").agg(F.first("text").alias("text"), F.count("*").alias("n_docs"), F.first("spans").alias("spans"))
    return written(hits.withColumn("id", F.monotonically_increasing_id()), "found")


def spans_of(docs: DataFrame, text: str = "text", disclose: float = DISCLOSE, remove: float = REMOVE, certain: float = CERTAIN) -> DataFrame:
    """(text_key, base, terms): for the SHA-256 of each different text that has any its base spans and disclosing terms, in order."""
    found = _found(docs, text)
    terms = disclosing_terms(found, docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")), disclose, remove, certain)
    both = found.select("text_key", F.col("spans").alias("base")).join(terms, "text_key", "full")
    return written(both.select("text_key", F.coalesce("base", F.array().cast(_SPANS)).alias("base"), F.coalesce("terms", F.array().cast(_TERMS)).alias("terms")), "spans")


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and spans of every row of docs: n_email, n_ip, n_card, n_phone, n_term, n_spans (all), base_sha256, spans.

    A null text is empty; rows with equal texts have equal spans, and repeated rows come out as often. The time grows with the
    length of a text, also of one with very many spans. No rows, no rows; columns other than the two named are not read.
    """
    spans = spans_of(docs, text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("text_key"))
    rows = rows.join(spans, "text_key", "left")
    base, terms = F.coalesce("base", F.array().cast(_SPANS)), F.coalesce("terms", F.array().cast(_TERMS))
    plain = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    placed = F.transform(terms, lambda t: F.struct(t["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), t["end"].alias("end")))
    number = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
    counts = [number(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    counts += [F.size(terms).cast("long").alias("n_term"), (F.size(base) + F.size(terms)).cast("long").alias("n_spans")]
    return rows.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.array_sort(F.concat(plain(base), placed))).alias("spans"))


def sanitise(docs: DataFrame, text: str = "text", disclose: float = DISCLOSE, remove: float = REMOVE, certain: float = CERTAIN) -> DataFrame:
    """docs with its columns and rows, personal data in text replaced.

    A base span becomes its kind in brackets; overlapping ones are replaced as one. A disclosing term is generalised to
    its class (the letters it begins with, and *), or removed if it reveals nearly all or has no class. Texts without
    either, null and empty ones stay as they are; rows that repeat are changed alike. Only rows with personal data are
    shuffled. No rows, no rows; columns of any other name stay.
    """
    key, base, terms = fresh(docs, "_key", "_base", "_terms")
    spans = spans_of(docs, text, disclose, remove, certain).select(F.col("text_key").alias(key), F.col("base").alias(base), F.col("terms").alias(terms))
    keyed = docs.withColumn(key, F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    holds = F.size(base_spans(F.coalesce(F.col(text), F.lit("")))) > 0
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    cuts = F.array_sort(F.concat(
        F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(names, s["kind"]).alias("by"))),
        F.transform(terms, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["by"].alias("by"))),
    ))
    changed = lambda df: df.withColumn(text, _replaced(F.col(text), cuts)).select(*docs.columns)
    rest, others = docs.where(~holds), spans.where(F.size(base) == 0)
    if not others.isEmpty():
        others = _small(others)
        rest = keyed.where(~holds)
        rest = rest.join(others, key, "left_anti").select(*docs.columns).unionByName(changed(rest.join(others, key)))
    return rest.unionByName(changed(keyed.where(holds).join(spans, key)))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents, with the terms that the corpus shows to disclose it."""
    return report(table(spark, sf_dir, "documents"))
