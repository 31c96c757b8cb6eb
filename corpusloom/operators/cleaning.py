"""Cleaning by patterns, with a log of what was done."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def canonical_source(source: Column, aliases: Mapping[str, str]) -> Column:
    """The alias of a source, else itself; null stays null."""
    if not aliases:
        return source
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.coalesce(source, F.lit(""))), source)


def apply_cleaning(docs: DataFrame, title: Sequence[str] = (), leading: Sequence[str] = (), everywhere: Sequence[str] = (), aliases: Mapping[str, str] | None = None, least: int = 30) -> DataFrame:
    """docs with cleaned_title, cleaned_text, canonical_source, and the sorted, distinct actions and flags."""
    t, body, actions = T.normalize_title(F.col("title")), F.col("normalized_text"), []
    for kind, patterns in (("title_pattern", title), ("body_leading_pattern", leading), ("body_global_pattern", everywhere)):
        for p in patterns:
            c = t if kind == "title_pattern" else body
            hit = c.rlike(f"(?i){p}")
            new = T.normalize_text(T.sub_all(c, p) if kind == "body_global_pattern" else T.sub_once(c, p))
            actions.append(F.when(hit, F.lit(f"{kind}:{p}")))
            c = F.when(hit, new).otherwise(c)
            t, body = (c, body) if kind == "title_pattern" else (t, c)
    source = canonical_source(F.col("publish_source"), aliases or {})
    actions.append(F.when(source != F.col("publish_source"), F.lit("source_alias_applied")))
    short = F.when((F.char_length("cleaned_text") > 0) & (F.char_length("cleaned_text") < least), F.lit("cleaned_text_too_short"))
    done = docs.withColumns({"cleaned_title": F.coalesce(F.nullif(t, F.lit("")), F.col("title")), "cleaned_text": body, "canonical_source": source, "cleaning_actions": F.array_sort(F.array_distinct(F.array_compact(F.array(*actions))))})
    return done.withColumn("quality_flags", F.array_sort(F.array_distinct(F.concat("quality_flags", F.array_compact(F.array(short))))))


def counts_of(docs: DataFrame, column: str) -> DataFrame:
    return docs.select(F.explode(column).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def review_sample(docs: DataFrame, n: int, doc_id: str = "doc_id") -> DataFrame:
    """A sample of n rows in the order of their id's MD5, so that it is the same everywhere."""
    return docs.withColumn("_h", F.md5(F.col(doc_id).cast("string"))).orderBy("_h", doc_id).limit(n).drop("_h")
