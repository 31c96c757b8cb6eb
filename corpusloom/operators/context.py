"""Contexts for answers: selection, deduplication, compression, extractive answers and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.presets import LATIN

NO_ANSWER = "No sufficient evidence was found."


def select_contexts(hits: DataFrame, most: int, per_source: int, source: str = "source") -> DataFrame:
    """hits in rank order, at most per_source of each source and `most` in all, ranked anew."""
    own = Window.partitionBy("query_id", source).orderBy("rank")
    kept = hits.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= per_source).drop("_n")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("int")).where(F.col("rank") <= most)


def dedupe_contexts(hits: DataFrame, prefix: int = 120, source: str = "source") -> DataFrame:
    """hits without those whose prefix begins, equals or continues that of a kept earlier hit of their source; a query's hits are few (top k)."""
    one = F.struct("rank", "doc_id", F.col(source).alias("source"), F.substring(F.col("text"), 1, prefix).alias("p"))
    lists = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("hits"))
    clash = lambda k, h: (k["source"] == h["source"]) & (k["p"].startswith(h["p"]) | h["p"].startswith(k["p"]))
    none = F.filter("hits", lambda h: F.lit(False))
    kept = F.aggregate("hits", none, lambda acc, h: F.when(F.exists(acc, lambda k: clash(k, h)), acc).otherwise(F.concat(acc, F.array(h))))
    return lists.select("query_id", F.posexplode(kept).alias("i", "h")).select("query_id", (F.col("i") + 1).alias("rank"), "h.doc_id")


def compress_contexts(hits: DataFrame, per_hit: int, total: int, delimiters: str = LATIN.delimiters) -> DataFrame:
    """(query_id, rank, doc_id, text): each hit's sentences most like the query, in that order, within per_hit and `total` for the query."""
    rows = hits.select("query_id", "rank", "doc_id", "query_text", F.posexplode(T.split_sentences(F.col("text"), delimiters)).alias("pos", "sentence"))
    rows = rows.withColumn("like", T.overlap_ratio(T.tokens(F.col("query_text")), T.tokens(F.col("sentence"))))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "rank").orderBy(F.desc("like"), "pos"))).where(F.col("n") <= per_hit)
    rows = rows.withColumn("all", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "n"))).where(F.col("all") <= total)
    kept = rows.groupBy("query_id", "rank", "doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "sentence"))).alias("s"))
    return kept.select("query_id", "rank", "doc_id", F.array_join(F.col("s.sentence"), " ").alias("text"))


def extractive_answers(contexts: DataFrame, queries: DataFrame, most_contexts: int, most_sentences: int, least_score: float, delimiters: str = LATIN.delimiters) -> DataFrame:
    """(query_id, answer, abstained, used): the first different sentences of contexts with enough score; without any, no answer."""
    strong = contexts.where((F.col("rank") <= most_contexts) & (F.col("score") >= least_score))
    one = F.struct("rank", "doc_id", T.split_sentences(F.col("text"), delimiters).alias("s"))
    lists = strong.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("c"))
    sentences = F.slice(F.array_distinct(F.flatten(F.transform("c", lambda x: x["s"]))), 1, most_sentences)
    found = lists.select("query_id", F.array_join(sentences, " ").alias("answer"), F.col("c.doc_id").alias("used"))
    out = queries.select("query_id").join(found, "query_id", "left")
    return out.select("query_id", F.coalesce("answer", F.lit(NO_ANSWER)).alias("answer"), F.col("answer").isNull().alias("abstained"), F.coalesce("used", F.array().cast("array<long>")).alias("used"))


def support_ratio(answer: Column, contexts: Column, least: float = 0.6, delimiters: str = LATIN.delimiters) -> Column:
    """The share of the answer's sentences that a context contains or overlaps enough; no sentences: 1."""
    s = T.split_sentences(F.regexp_replace(F.coalesce(answer, F.lit("")), r"\[\d+\]", ""), delimiters)
    held = lambda x: F.exists(contexts, lambda c: F.contains(c, x) | (T.overlap_ratio(T.tokens(x), T.tokens(c)) >= least))
    return F.when(F.size(s) == 0, F.lit(1.0)).otherwise(F.size(F.filter(s, held)) / F.size(s))


def guardrail_reasons(answer: Column, abstained: Column, top_score: Column, support: Column, least_score: float, least_support: float, brackets: bool = True) -> Column:
    """Why an answer is blocked: low_score, missing_citation, inconsistent."""
    return F.array_compact(
        F.array(
            F.when(F.coalesce(top_score, F.lit(0.0)) < least_score, "low_score"),
            F.when(F.lit(brackets) & ~abstained & ~T.has_citation_brackets(answer), "missing_citation"),
            F.when(support < least_support, "inconsistent"),
        )
    )


def source_ref(metadata: Column) -> Column:
    """The source file, article label and page of a context, those that it has, joined by | between spaces; null without any."""
    parts = [F.nullif(F.btrim(F.coalesce(F.try_element_at(metadata, F.lit(k)), F.lit(""))), F.lit("")) for k in ("source_file", "article_label", "page")]
    return F.nullif(F.concat_ws(" | ", *parts), F.lit(""))


def citations(contexts: DataFrame, span: int = 120) -> DataFrame:
    """(query_id, label, doc_id, span_text) of each context."""
    return contexts.select("query_id", F.col("rank").cast("string").alias("label"), "doc_id", F.btrim(F.substring(F.col("text"), 1, span)).alias("span_text"))


def context_block(contexts: DataFrame) -> DataFrame:
    """(query_id, block): contexts as numbered passages for a prompt."""
    one = F.struct("rank", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("title"), F.lit(" ("), F.col("doc_id").cast("string"), F.lit(")\n"), F.col("text")).alias("t"))
    lists = contexts.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("c"))
    return lists.select("query_id", F.array_join(F.col("c.t"), "\n\n").alias("block"))


def process_contexts(hits: DataFrame, most: int = 5, per_source: int = 2, dedupe: bool = True, compress: tuple[int, int] | None = None) -> DataFrame:
    """The context stage: hits deduplicated, selected and compressed to (sentences a hit, sentences a query), in that order.

    (query_id, rank, doc_id, text, original_count, processed_count, compressed).
    """
    counts = hits.groupBy("query_id").agg(F.count("*").alias("original_count"))
    kept = hits
    if dedupe:
        first = dedupe_contexts(hits)
        kept = hits.drop("rank").join(first, ["query_id", "doc_id"])
    kept = select_contexts(kept, most, per_source)
    if compress:
        kept = compress_contexts(kept, *compress)
    out = kept.select("query_id", "rank", "doc_id", "text").join(counts, "query_id")
    return out.withColumns({"processed_count": F.count("*").over(Window.partitionBy("query_id")), "compressed": F.lit(compress is not None)})
