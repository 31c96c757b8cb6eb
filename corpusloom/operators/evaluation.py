"""Metrics of rankings and answers, error labels and comparisons of variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def retrieval_metrics(hits: DataFrame, qrels: DataFrame, queries: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """A row per query of queries: recall, hit, precision, nDCG at each k, and MRR.

    Precision divides by the number of hits that came back; a query without relevant documents has zeros.
    """
    gold = qrels.select("query_id", "doc_id").distinct()
    n_gold = gold.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    flagged = hits.select("query_id", "doc_id", "rank").join(gold.withColumn("rel", F.lit(True)), ["query_id", "doc_id"], "left")
    rel = F.coalesce("rel", F.lit(False))
    sums = [F.min(F.when(rel, F.col("rank"))).alias("first")]
    for k in ks:
        top = F.col("rank") <= k
        sums += [F.count_if(rel & top).alias(f"found{k}"), F.count_if(top).alias(f"n{k}"), F.sum(F.when(rel & top, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias(f"dcg{k}")]
    rows = queries.select("query_id").join(flagged.groupBy("query_id").agg(*sums), "query_id", "left").join(n_gold, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = [zero(1.0 / F.col("first")).alias("mrr")]
    for k in ks:
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
        out += [
            zero(F.col(f"found{k}") / F.col("n_gold")).alias(f"recall_{k}"),
            zero((F.col(f"found{k}") > 0).cast("double")).alias(f"hit_{k}"),
            zero(F.try_divide(F.col(f"found{k}"), F.col(f"n{k}"))).alias(f"precision_{k}"),
            zero(F.col(f"dcg{k}") / ideal).alias(f"ndcg_{k}"),
        ]
    return rows.select("query_id", *out)


def means(metrics: DataFrame, names: list[str], by: str) -> DataFrame:
    """Mean metrics of all rows (group null) and of each group, by one pass of grouping sets."""
    return metrics.groupingSets([[], [F.col(by)]], F.col(by)).agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in names])


def token_f1(answer: Column, reference: Column) -> Column:
    """F1 of the two sets of tokens."""
    a, r = F.array_distinct(T.tokens(answer)), F.array_distinct(T.tokens(reference))
    both = F.size(F.array_intersect(a, r))
    return F.when(both == 0, F.lit(0.0)).otherwise(2 * both / (F.size(a) + F.size(r)))


def token_precision_recall(answer: Column, reference: Column) -> tuple[Column, Column]:
    """The share of the answer's different tokens that the reference has, and the other way round; of no tokens 0."""
    a, r = F.array_distinct(T.tokens(answer)), F.array_distinct(T.tokens(reference))
    both = F.size(F.array_intersect(a, r))
    over = lambda n: F.when(F.size(n) == 0, F.lit(0.0)).otherwise(both / F.size(n))
    return over(a), over(r)


def generation_metrics(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """answers (query_id, answer, abstained, used) against gold (query_id, reference, supporting, answerable, question_type)."""
    j = answers.join(gold, "query_id")
    both = F.size(F.array_intersect("used", "supporting"))
    over = lambda n, d: F.when(d == 0, F.lit(0.0)).otherwise(n / d)
    return j.select(
        "query_id",
        "question_type",
        token_f1(F.col("answer"), F.col("reference")).alias("answer_correctness"),
        over(both, F.size("used")).alias("citation_precision"),
        over(both, F.size("supporting")).alias("citation_recall"),
        F.col("abstained").cast("double").alias("abstained"),
        (F.col("abstained") != F.col("answerable")).cast("double").alias("abstain_accuracy"),
        (F.col("abstained") & F.col("answerable")).cast("double").alias("wrong_abstain"),
    )


def error_labels(rows: DataFrame) -> DataFrame:
    """(query_id, labels) from (relevant, hit_any, hit_top, support, abstained, answerable, correctness)."""
    labels = F.array_compact(
        F.array(
            F.when(F.col("answerable") & ~F.col("hit_any"), "retrieval_miss").when(F.col("answerable") & ~F.col("hit_top"), "ranking_miss"),
            F.when(F.col("support") < 1, "citation_mismatch"),
            F.when(F.col("abstained") == F.col("answerable"), "wrong_abstain"),
            F.when(F.col("answerable") & ~F.col("abstained") & (F.col("correctness") < 0.5), "generation_hallucination"),
        )
    )
    return rows.select("query_id", labels.alias("labels"))


def validate_benchmark(records: DataFrame) -> DataFrame:
    """One row: numbers of repeated ids, unanswerable records with an answer, answerable ones without evidence, and whether all is well."""
    ids = records.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(~F.col("answerable") & (F.col("gold_answer") != "")).alias("a"), F.count_if(F.col("answerable") & (F.col("n_evidence") == 0)).alias("e"))
    sums = ids.agg(F.count_if(F.col("n") > 1).alias("duplicate_ids"), F.coalesce(F.sum("a"), F.lit(0)).alias("unanswerable_with_answer"), F.coalesce(F.sum("e"), F.lit(0)).alias("answerable_without_evidence"))
    return sums.withColumn("is_valid", (F.col("duplicate_ids") + F.col("unanswerable_with_answer") + F.col("answerable_without_evidence")) == 0)


def experiment_matrix(spark, base: list[str], generators: list[str], contexts: list[str]) -> DataFrame:
    """(variant, retriever, generator, contexts): every combination."""
    frame = lambda name, x: spark.createDataFrame([(v,) for v in x], f"{name} string")
    rows = frame("retriever", base).crossJoin(frame("generator", generators)).crossJoin(frame("contexts", contexts))
    return rows.withColumn("variant", F.concat_ws("__", "retriever", "generator", "contexts"))


def ablation(metrics: DataFrame, names: list[str], variants: list[str]) -> DataFrame:
    """(metric, one column per variant) of the mean metrics of rows (variant, metrics)."""
    wide = metrics.groupBy("variant").agg(*[F.avg(m).alias(m) for m in names])
    long = wide.select("variant", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names])).alias("x"))
    return long.groupBy("x.metric").pivot("variant", variants).agg(F.first("x.value")).withColumnRenamed("x.metric", "metric")
