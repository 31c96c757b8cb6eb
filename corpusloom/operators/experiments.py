"""Experiments: variants of retrieval compared by their metrics, with failures kept apart, and a bundle of reports."""

from __future__ import annotations

import json
import zipfile
from collections.abc import Callable, Mapping
from itertools import chain, product
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import context, evaluation
from corpusloom.sources.shared import saved

Retriever = Callable[[], DataFrame]


def run_variants(variants: Mapping[str, Retriever], qrels: DataFrame, queries: DataFrame, ks: tuple[int, ...] = (3, 5)) -> tuple[list[dict], dict[str, str]]:
    """Mean retrieval metrics of each variant, and the errors of those that failed; one failure stops no other."""
    done, failed = [], {}
    names = ["mrr", *[f"{m}_{k}" for k in ks for m in ("recall", "hit", "precision", "ndcg")]]
    for name, hits in variants.items():
        try:
            row = evaluation.retrieval_metrics(hits(), qrels, queries, ks).agg(*[F.avg(m).alias(m) for m in names]).first()
            done.append({"variant": name, **row.asDict()})
        except Exception as e:  # a variant's own failure belongs in the report
            failed[name] = f"{type(e).__name__}: {str(e)[:300]}"
    return done, failed


def expanded(folder: str, matrix: Mapping[str, list[str]], paths: Mapping[str, str], options: Mapping[str, Mapping] | None = None) -> dict[str, dict[str, dict]]:
    """Variants by name, each with its stages and their configurations: every combination of modes, generators and contexts (raw or processed).

    paths has chunks_jsonl, queries_jsonl and benchmark_jsonl; options add to the configuration of a stage. Every variant has a folder of its own.
    """
    more, out = options or {}, {}
    for mode, generator, contexts in product(matrix["modes"], matrix.get("generators", ["extractive"]), matrix.get("contexts", ["raw"])):
        name = f"{mode}__{generator}__{contexts}"
        at = lambda x, name=name: f"{folder}/{name}/{x}"
        steps = {"retrieve": {"chunks_jsonl": paths["chunks_jsonl"], "queries_jsonl": paths["queries_jsonl"], "mode": mode, "output_jsonl": at("hits")}}
        shown = "hits"
        if contexts == "processed":
            steps["process-contexts"], shown = {"input_jsonl": at("hits"), "output_jsonl": at("contexts")}, "contexts"
        steps["generate"] = {"input_jsonl": at(shown), "generator": generator, "output_jsonl": at("answers")}
        steps["eval-retrieval"] = {"results_jsonl": at("hits"), "benchmark_jsonl": paths["benchmark_jsonl"], "output_csv": at("retrieval_metrics")}
        steps["eval-generation"] = {"answers_jsonl": at("answers"), "benchmark_jsonl": paths["benchmark_jsonl"], "output_csv": at("generation_metrics")}
        out[name] = {k: {**v, **more.get(k, {})} for k, v in steps.items()}
    return out


def write_report(folder: str, done: list[dict], failed: dict[str, str]) -> Path:
    """summary.json and summary.md in the folder, and both in bundle.zip."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    (out / "summary.json").write_text(json.dumps({"variants": done, "failed": failed}, indent=2))
    names = list(dict.fromkeys(k for row in done for k in row)) or ["variant"]
    lines = ["# Experiments", "", "| " + " | ".join(names) + " |", "|" + "-|" * len(names)]
    lines += ["| " + " | ".join(f"{v:.4f}" if isinstance(v, float) else str(v) for v in (row.get(n, "") for n in names)) + " |" for row in done]
    lines += [f"\n- failed `{name}`: {why}" for name, why in failed.items()]
    (out / "summary.md").write_text("\n".join(lines) + "\n")
    with zipfile.ZipFile(out / "bundle.zip", "w") as z:
        for name in ("summary.json", "summary.md"):
            z.write(out / name, name)
    return out / "bundle.zip"


def auto_testset(chunks: DataFrame, make: Callable, n: int) -> DataFrame:
    """Questions about n chunks (doc_id, text), those first in the order of their id's MD5, by a client; blank ones are left out."""
    from corpusloom.operators import models

    some = chunks.where(T.present(F.col("text"))).withColumn("_h", F.md5(F.col("doc_id").cast("string"))).orderBy("_h", "doc_id").limit(n).drop("_h")
    asked = some.withColumn("prompt", F.concat(F.lit("Write a question that this passage answers, as JSON with question and answer: "), F.col("text")))
    said = models.complete(asked, make)
    rows = said.select("doc_id", F.get_json_object("payload", "$.question").alias("question"), F.get_json_object("payload", "$.answer").alias("answer"), F.col("text").alias("evidence"))
    return rows.where(T.present(F.col("question")) & T.present(F.col("answer")))


#: What auto evaluation gives for each query.
AUTO = ("faithfulness", "answer_relevancy", "answer_relevance", "context_precision", "citation_support_rate", "answer_correctness")


def auto_eval(answers: DataFrame, testset: DataFrame, hits: DataFrame, ks: tuple[int, ...] = (3, 5)) -> DataFrame:
    """A row per query of testset (query_id, question, truth, doc_id[, evidence]) with AUTO and recalls; answers (query_id, answer[, used]), hits (query_id, doc_id, rank, text).

    Faithful is the share of the answer's different tokens that the evidence has, or without evidence of its sentences that the
    hits support. Relevancy and correctness are the shares of the question's and the truth's tokens that the answer has;
    context precision is the mean precision at the places of the gold document, citation support the share of used contexts that are it.
    """
    share = lambda of, by: F.when(F.size(of) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(of, by)) / F.size(of))
    words = lambda c: F.array_distinct(T.tokens(F.col(c)))
    gold = testset.select("query_id", F.col("doc_id").alias("gold"))
    at = F.array_sort(F.collect_list(F.when(F.col("doc_id") == F.col("gold"), F.col("rank"))))
    held = hits.join(gold, "query_id").groupBy("query_id").agg(at.alias("at"), F.collect_list("text").alias("contexts"))
    used = F.col("used") if "used" in answers.columns else F.array().cast(f"array<{testset.schema['doc_id'].dataType.simpleString()}>")
    rows = testset.join(answers.select("query_id", "answer", used.alias("used")), "query_id").join(held, "query_id", "left")
    found = F.coalesce("at", F.array().cast("array<int>"))
    precise = F.aggregate(F.transform(found, lambda r, i: (i + 1) / r), F.lit(0.0), lambda a, x: a + x)
    faithful = share(words("answer"), words("evidence")) if "evidence" in testset.columns else context.support_ratio(F.col("answer"), F.coalesce("contexts", F.array().cast("array<string>")))
    relevant = share(words("question"), words("answer"))
    return rows.select(
        "query_id",
        faithful.alias("faithfulness"),
        relevant.alias("answer_relevancy"),
        relevant.alias("answer_relevance"),
        F.when(F.size(found) == 0, F.lit(0.0)).otherwise(precise / F.size(found)).alias("context_precision"),
        F.when(F.coalesce(F.size("used"), F.lit(0)) <= 0, F.lit(0.0)).otherwise(F.size(F.filter("used", lambda u: u == F.col("doc_id"))) / F.size("used")).alias("citation_support_rate"),
        share(words("truth"), words("answer")).alias("answer_correctness"),
        *[F.coalesce(F.array_min(found) <= k, F.lit(False)).cast("double").alias(f"recall_{k}") for k in ks],
    )


#: Terms that a unit is tried with first; units that none of these fits are tried with twice as many more, and so on.
TRIED = 8
#: Characters of different terms that are sent to the units; beyond that units meet terms by number.
SENT_CHARS = 1 << 24


def unanswerable_pairs(units: DataFrame, terms: DataFrame, sent: int = SENT_CHARS) -> DataFrame:
    """(doc_id, part, term): for each unit a defined term (doc_id, term) of another document that it does not hold; of units of one document with the same term the first.

    Different terms stand in a ring in the order of their hash, and a unit takes the first of them that fits from its own
    hash on. So a unit meets few more terms than it holds itself, and there is no product of all with all. A ring of at most
    `sent` characters goes to the units (`_walked`), so no text moves; with a longer one they meet by number (`_met`).
    """
    number = lambda *c: F.conv(F.substring(F.md5(F.concat_ws(":", *c)), 1, 15), 16, 10).cast("long")
    parts = 256
    defined = saved(terms.select("doc_id", "term").distinct(), "defined")
    once = defined.select("term").distinct().withColumn("h", number("term"))
    ring = once.withColumn("b", F.pmod("h", F.lit(parts))).withColumn("i", F.row_number().over(Window.partitionBy("b").orderBy("h", "term")) - 1)
    sizes = ring.groupBy("b").agg(F.count("*").alias("n"))
    starts = sizes.withColumn("start", F.sum("n").over(Window.orderBy("b")) - F.col("n"))
    # At most `parts` rows.
    ring = saved(ring.join(F.broadcast(starts), "b").select((F.col("start") + F.col("i")).alias("at"), "term"), "ring")
    total, chars = ring.agg(F.count("*"), F.coalesce(F.sum(F.char_length("term")), F.lit(0))).first()
    if not total:
        return units.select("doc_id", "part", F.lit(None).cast("string").alias("term")).limit(0)
    own = F.pmod(number(F.col("doc_id").cast("string"), F.col("part").cast("string")), F.lit(total)).alias("own")
    rows = units.where(F.col("doc_id").isNotNull()).select("doc_id", "part", "text", own)
    found = _walked(rows, defined, [r[0] for r in ring.orderBy("at").select("term").collect()]) if chars <= sent else _met(rows, defined, ring, total)
    return found.groupBy("doc_id", "term").agg(F.min("part").alias("part")).select("doc_id", "part", "term")


def _walked(units: DataFrame, defined: DataFrame, ring: list[str]) -> DataFrame:
    """(doc_id, part, term): each unit's first term of the ring from own on that neither it nor its document has.

    Units take the first that their texts lack; the few whose document defines that one walk again, with what it defines.
    """
    held = units.sparkSession.sparkContext.broadcast(ring)

    @F.arrow_udf("string")
    def first(text: pa.Array, own: pa.Array, skipped: pa.Array) -> pa.Array:
        ring = held.value

        def fits(text: str, own: int, skipped: list[str] | None) -> str | None:
            return next((t for i in chain(range(own, len(ring)), range(own)) if (t := ring[i]) not in text and t not in (skipped or ())), None)

        return pa.array([fits(*x) for x in zip(text.to_pylist(), own.to_pylist(), skipped.to_pylist())], pa.string())

    term = lambda skipped: first(F.col("text"), F.col("own"), skipped).alias("term")
    # Python is told once, as the found ones are read twice.
    taken = saved(units.select("doc_id", "part", term(F.lit(None).cast("array<string>"))).where(F.col("term").isNotNull()), "found")
    clash = saved(taken.join(defined, ["doc_id", "term"], "left_semi").select("doc_id", "part"), "clash")
    if clash.isEmpty():
        return taken
    skipped = defined.join(clash.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_list("term").alias("skipped"))
    again = units.join(clash, ["doc_id", "part"], "left_semi").join(skipped, "doc_id").select("doc_id", "part", term(F.col("skipped")))
    return taken.join(defined, ["doc_id", "term"], "left_anti").select("doc_id", "part", "term").unionByName(again.where(F.col("term").isNotNull()))


def _met(rest: DataFrame, defined: DataFrame, ring: DataFrame, total: int) -> DataFrame:
    """What `_walked` gives, by joins: units meet terms by number, TRIED at first and twice as many in each further round; only units that none of these fits go on."""
    ring = saved(ring.join(defined.groupBy("term").agg(F.collect_set("doc_id").alias("docs")), "term"), "ring")
    first = Window.partitionBy("doc_id", "part").orderBy("turn")
    out, turn, more = None, 0, TRIED
    while turn < total:
        turns = F.sequence(F.lit(turn), F.lit(min(turn + more, total) - 1))
        tried = rest.withColumn("turn", F.explode(turns)).withColumn("at", F.pmod(F.col("own") + F.col("turn"), F.lit(total)))
        met = tried.join(ring, "at").where(~F.array_contains("docs", F.col("doc_id")) & ~F.contains("text", "term"))
        found = saved(met.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("doc_id", "part", "term"), "found")
        out = found if out is None else out.unionByName(found)
        turn, more = turn + more, more * 2
        rest = saved(rest.join(found, ["doc_id", "part"], "left_anti"), "rest")
        if rest.isEmpty():
            break
    return out


def run_stages(variants: Mapping[str, Mapping[str, Callable[[dict], DataFrame]]]) -> tuple[dict[str, dict[str, DataFrame]], list[dict]]:
    """(results, failures): each variant's stages in order, each given the results of those before it.

    A stage's plan is run where it fails or not by counting; a variant that fails names the stage and keeps what came before.
    """
    results, failures = {}, []
    for name, stages in variants.items():
        done: dict[str, DataFrame] = {}
        for stage, make in stages.items():
            try:
                done[stage] = make(done)
                done[stage].count()
            except Exception as e:  # a variant's own failure belongs in the report
                done.pop(stage, None)
                failures.append({"variant": name, "stage": stage, "error": f"{type(e).__name__}: {str(e)[:300]}"})
                break
        results[name] = done
    return results, failures


def auto_eval_variants(variants: Mapping[str, Callable[[DataFrame], tuple[DataFrame, DataFrame]]], testset: DataFrame) -> DataFrame:
    """(variant, n, mean metrics): each variant's answers and hits for the test set, scored by `auto_eval`; all in one plan."""
    out = None
    for name, run in variants.items():
        answers, hits = run(testset)
        scored = auto_eval(answers, testset, hits)
        names = [c for c in scored.columns if c != "query_id"]
        row = scored.agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in names]).select(F.lit(name).alias("variant"), "n", *names)
        out = row if out is None else out.unionByName(row)
    return out
