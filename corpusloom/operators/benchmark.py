"""Question-answer benchmarks from documents: candidates, filters, deduplication, selection."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.presets import LATIN, Preset
from corpusloom.sources.shared import saved

TYPES = ("definition", "condition", "procedure", "responsibility", "comparison", "unanswerable")


def candidates(units: DataFrame, preset: Preset = LATIN, least: int = 12) -> DataFrame:
    """(doc_id, part, pos, question_type, question, gold_answer) of units (doc_id, part, text), a row for each rule that a sentence meets."""
    s = units.select("doc_id", "part", F.posexplode(T.bare_sentences(F.col("text"), preset.delimiters)).alias("pos", "sentence")).where(F.char_length("sentence") >= least)
    has = lambda marks: F.reduce(F.array(*[F.contains("sentence", F.lit(m)) for m in marks]), F.lit(False), lambda a, x: a | x)
    term = T.clean_term(F.regexp_extract("sentence", preset.definition, 1))
    label = F.concat(F.lit("part "), F.col("part").cast("string"))
    seed = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("pos").cast("string"))
    rules = {
        "definition": (F.char_length(term) >= 2, [F.concat(F.lit("What is "), term, F.lit("?")), F.concat(F.lit("How is "), term, F.lit(" defined?"))]),
        "condition": (has(preset.condition), [F.concat(F.lit("Which conditions does "), label, F.lit(" set?")), F.concat(F.lit("When does "), label, F.lit(" apply?"))]),
        "procedure": (has(preset.procedure), [F.concat(F.lit("Which steps does "), label, F.lit(" name?")), F.concat(F.lit("How does one proceed under "), label, F.lit("?"))]),
    }
    rows = s.withColumn("question_type", F.explode(F.array_compact(F.array(*[F.when(when, F.lit(kind)) for kind, (when, _) in rules.items()]))))
    # A column of its own, so that questions are made only where they are read.
    question = F.coalesce(*[F.when(F.col("question_type") == kind, T.pick_template(options, F.concat(seed, F.lit(f":{kind}")))) for kind, (_, options) in rules.items()])
    return rows.select("doc_id", "part", "pos", "question_type", question.alias("question"), F.col("sentence").alias("gold_answer"))


def definition_terms(units: DataFrame, preset: Preset = LATIN, least: int = 12) -> DataFrame:
    """(doc_id, term) of the definitions among `candidates`; units without the preset's mark have none and are not cut into sentences."""
    mark = F.lit(preset.definition_mark if preset.definition_mark in preset.definition else "")
    s = units.where(F.contains("text", mark)).select("doc_id", F.explode(T.bare_sentences(F.col("text"), preset.delimiters)).alias("sentence"))
    s = s.where(F.contains("sentence", mark) & (F.char_length("sentence") >= least))
    return s.select("doc_id", T.clean_term(F.regexp_extract("sentence", preset.definition, 1)).alias("term")).where(F.char_length("term") >= 2)


def actor_candidates(units: DataFrame, preset: Preset = LATIN, least: int = 12) -> DataFrame:
    """Candidates of type responsibility, as `candidates` has them: sentences with a marker of duty and one of an actor."""
    s = units.select("doc_id", "part", F.posexplode(T.bare_sentences(F.col("text"), preset.delimiters)).alias("pos", "sentence")).where(F.char_length("sentence") >= least)
    has = lambda marks: F.reduce(F.array(*[F.contains("sentence", F.lit(m)) for m in marks]), F.lit(False), lambda a, x: a | x)
    label = F.concat(F.lit("part "), F.col("part").cast("string"))
    seed = F.concat(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("pos").cast("string")), F.lit(":responsibility"))
    question = T.pick_template([F.concat(F.lit("Who is responsible under "), label, F.lit("?")), F.concat(F.lit("Whom does "), label, F.lit(" name as responsible?"))], seed)
    return s.where(has(preset.responsibility) & has(preset.actor)).select("doc_id", "part", "pos", F.lit("responsibility").alias("question_type"), question.alias("question"), F.col("sentence").alias("gold_answer"))


def comparison_candidates(units: DataFrame, preset: Preset = LATIN) -> DataFrame:
    """Candidates of type comparison with their pair: two known terms that a unit names, or two that it sets side by side."""
    known = [F.when(F.contains("text", F.lit(a)) & F.contains("text", F.lit(b)), F.array(F.lit(a), F.lit(b))) for a, b in preset.pairs]
    side = [T.clean_term(F.regexp_extract("text", preset.pair, k)) for k in (1, 2)]
    found = F.array_compact(F.array(*known, F.when(F.col("text").rlike(preset.pair), F.array(*side))))
    rows = units.select("doc_id", "part", "text", F.posexplode(found).alias("pos", "pair"))
    a, b = F.col("pair")[0], F.col("pair")[1]
    seed = F.concat(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("pos").cast("string")), F.lit(":comparison"))
    question = T.pick_template([F.concat(F.lit("How do "), a, F.lit(" and "), b, F.lit(" differ?")), F.concat(F.lit("What sets "), a, F.lit(" apart from "), b, F.lit("?"))], seed)
    return rows.select("doc_id", "part", "pos", F.lit("comparison").alias("question_type"), question.alias("question"), F.col("text").alias("gold_answer"), "pair")


def filter_reason(question: Column, evidence: Column, shortest: int, longest: int, overlap: float, kind: Column | None = None, pair: Column | None = None, preset: Preset = LATIN) -> Column:
    """Why a candidate goes, or null: too_short, too_long, placeholder, missing_evidence, malformed_comparison, malformed_unanswerable, weak_question_evidence_overlap.

    With its kind a comparison must have a pair of two, and an unanswerable question no answer; that is all it needs.
    """
    n = F.char_length(question)
    kind = F.lit("") if kind is None else kind
    marks = F.reduce(F.array(*[F.contains(question, F.lit(m)) for m in preset.placeholders]), F.lit(False), lambda a, x: a | x)
    out = F.when(n < shortest, "too_short").when(n > longest, "too_long").when(marks, "placeholder")
    out = out.when((kind != "unanswerable") & ~T.present(evidence), "missing_evidence")
    if pair is not None:
        out = out.when((kind == "comparison") & (F.coalesce(F.size(pair), F.lit(0)) != 2), "malformed_comparison")
    out = out.when((kind == "unanswerable") & T.present(evidence), "malformed_unanswerable")
    return out.when((kind != "unanswerable") & (T.gram_overlap(question, evidence, 2) < overlap), "weak_question_evidence_overlap")


def lexical_dedup(found: DataFrame) -> DataFrame:
    """The first candidate of each type and normalised question."""
    first = Window.partitionBy("question_type", T.normalize_question(F.col("question"))).orderBy("doc_id", "part", "pos")
    return found.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def near_questions(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b): keys (question_type, doc_id, part, pos) of rows of one type, a before b, whose questions' sets of 3-grams have a Jaccard index of at least threshold.

    Two such sets share one of their first grams in the order of frequency, so rows meet on these alone, rare ones as far
    as their number allows; sizes are compared before the sets are.
    """
    held = rows.select(F.struct("question_type", "doc_id", "part", "pos").alias("k"), "question_type", T.gram_set(F.lower("question")).alias("grams")).withColumn("n", F.size("grams"))
    each = held.select("question_type", "k", "n", "grams", F.explode("grams").alias("gram"))
    often = each.groupBy("question_type", "gram").agg(F.count("*").alias("df"))
    prefixes = each.join(often, ["question_type", "gram"]).groupBy("question_type", "k", "n", "grams").agg(F.collect_list(F.struct("df", "gram")).alias("_g"))
    prefixes = prefixes.select("question_type", "k", "n", "grams", F.explode(F.slice(F.sort_array("_g"), F.lit(1), F.col("n") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1)).alias("g")).select("question_type", "k", "n", "grams", "g.gram")
    side = lambda c: prefixes.select("question_type", "gram", *[F.col(x).alias(f"{x}_{c}") for x in ("k", "n", "grams")])
    met = side("a").join(side("b"), ["question_type", "gram"]).where((F.col("k_a") < F.col("k_b")) & (F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9))
    shared = F.size(F.array_intersect("grams_a", "grams_b"))
    return met.where(shared >= threshold * (F.col("n_a") + F.col("n_b") - shared) - 1e-9).select(F.col("k_a").alias("a"), F.col("k_b").alias("b")).distinct()


def semantic_dedup(found: DataFrame, threshold: float = 0.82) -> DataFrame:
    """Candidates without those whose question is too like an earlier kept one of their type (greedy, in the order of doc_id, part, pos).

    Questions are made unique first. In each round those go that are like a question no earlier one is like: such a
    question stays whatever else happens. What then has nothing before it is settled in the next round, until no two alike are left; so
    the outcome is that of the greedy pass, with no task that holds a whole type. The places of candidates tell them apart.
    """
    rows = saved(lexical_dedup(found), "questions")
    links, gone = saved(near_questions(rows, threshold), "alike"), None
    while not links.isEmpty():
        stays = links.select(F.col("a").alias("k")).distinct().join(links.select(F.col("b").alias("k")), "k", "left_anti")
        goes = saved(links.join(stays.withColumnRenamed("k", "a"), "a", "left_semi").select(F.col("b").alias("k")).distinct(), "gone")
        gone = goes if gone is None else gone.unionByName(goes)
        for c in ("a", "b"):
            links = links.join(goes.withColumnRenamed("k", c), c, "left_anti")
        links = saved(links, "alike")
    if gone is None:
        return rows
    return rows.withColumn("k", F.struct("question_type", "doc_id", "part", "pos")).join(gone.distinct(), "k", "left_anti").select(*rows.columns)


def fill_quotas(found: DataFrame, per_doc: int, per_type: int) -> DataFrame:
    """At most per_doc candidates of a type from one document and per_type in all, in the order of a hash of their place."""
    h = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("part").cast("string"), F.col("pos").cast("string")))
    rows = found.withColumn("_h", h)
    rows = rows.withColumn("_d", F.row_number().over(Window.partitionBy("question_type", "doc_id").orderBy("_h"))).where(F.col("_d") <= per_doc)
    return rows.withColumn("_t", F.row_number().over(Window.partitionBy("question_type").orderBy("_h", "doc_id"))).where(F.col("_t") <= per_type).drop("_h", "_d", "_t")


def final_selection(found: DataFrame, quota: int, per_doc: int = 2, per_part: int = 1) -> DataFrame:
    """Up to quota of each type; documents may give per_doc and units per_part over all types first, and what lacks is filled without caps.

    Each type is taken in the order of what its documents and units have given so far. The caps run across types, so the
    few candidates that quotas leave are taken in one ordered pass.
    """

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["question_type", "doc_id", "part", "pos"]).reset_index(drop=True)
        docs: dict[int, int] = {}
        parts: dict[tuple[int, int], int] = {}
        taken = []
        for kind in TYPES:
            own = rows.index[rows["question_type"] == kind].tolist()
            of = {i: (rows.at[i, "doc_id"], (rows.at[i, "doc_id"], rows.at[i, "part"])) for i in own}
            own.sort(key=lambda i: (docs.get(of[i][0], 0), parts.get(of[i][1], 0), i))
            first: list[int] = []
            for i in own:
                d, p = of[i]
                if len(first) < quota and docs.get(d, 0) < per_doc and parts.get(p, 0) < per_part:
                    first.append(i)
                    docs[d], parts[p] = docs.get(d, 0) + 1, parts.get(p, 0) + 1
            rest = [i for i in own if i not in set(first)][: quota - len(first)]
            for i in rest:
                d, p = of[i]
                docs[d], parts[p] = docs.get(d, 0) + 1, parts.get(p, 0) + 1
            taken += first + rest
        yield rows.loc[taken]

    return fill_quotas(found, quota, quota * 3).coalesce(1).mapInPandas(choose, found.schema)


def to_records(found: DataFrame, units: DataFrame) -> DataFrame:
    """(query_id, question, question_type, answerable, gold_answer, gold_evidence, metadata): candidates with the texts of their units as evidence.

    A candidate with next_part, a comparison of neighbours, has the evidence of both units, in order.
    """
    ids = lambda part: F.concat_ws(":", F.col("doc_id").cast("string"), F.col(part).cast("string"))
    text = lambda part, name: units.select("doc_id", F.col("part").alias(part), F.col("text").alias(name))
    rows = found if "next_part" in found.columns else found.withColumn("next_part", F.lit(None).cast("int"))
    # Only the texts of asked documents meet the candidates.
    units = units.join(found.select("doc_id").distinct(), "doc_id", "left_semi")
    held = rows.join(text("part", "_evidence"), ["doc_id", "part"], "left").join(text("next_part", "_next"), ["doc_id", "next_part"], "left")
    order = Window.partitionBy("question_type").orderBy("doc_id", "part", "pos")
    number = F.lpad(F.row_number().over(order).cast("string"), 4, "0")
    answerable = F.col("question_type") != "unanswerable"
    evidence = lambda part, name: F.struct(ids(part).alias("chunk_id"), F.col("doc_id").cast("string").alias("doc_id"), F.col(name).alias("evidence_text"))
    both = F.array_compact(F.array(evidence("part", "_evidence"), F.when(F.col("next_part").isNotNull(), evidence("next_part", "_next"))))
    none = F.array().cast("array<struct<chunk_id:string,doc_id:string,evidence_text:string>>")
    return held.select(
        F.concat_ws("_", "question_type", number).alias("query_id"),
        "question",
        "question_type",
        answerable.alias("answerable"),
        "gold_answer",
        F.when(answerable, both).otherwise(none).alias("gold_evidence"),
        F.create_map(F.lit("source_doc_id"), F.col("doc_id").cast("string"), F.lit("source_chunk_id"), ids("part")).alias("metadata"),
    )


def to_candidates(found: DataFrame) -> DataFrame:
    """Candidates as `records.CANDIDATE` has them, with the ids of their evidence and none yet of their own."""
    ids = lambda part: F.concat_ws(":", F.col("doc_id").cast("string"), F.col(part).cast("string"))
    answerable = F.col("question_type") != "unanswerable"
    evidence = F.array_compact(F.array(ids("part"), F.when(F.col("next_part").isNotNull(), ids("next_part"))))
    none = F.array().cast("array<string>")
    return found.select(F.lit("").alias("query_id"), "question", "question_type", answerable.alias("answerable"), "gold_answer", F.when(answerable, evidence).otherwise(none).alias("gold_evidence_chunk_ids"), F.col("doc_id").cast("string").alias("source_doc_id"), ids("part").alias("source_chunk_id"))


def quota_candidates(units: DataFrame, per_doc: int, per_type: int, preset: Preset = LATIN) -> DataFrame:
    """fill_quotas of all_candidates: they are picked by their places, without texts, and then made anew from the documents of those picked."""
    keys = ["question_type", "doc_id", "part", "pos"]
    picked = saved(fill_quotas(all_candidates(units, preset).select(*keys), per_doc, per_type), "picked")
    # At most per_type of each type.
    ids = [r[0] for r in picked.select("doc_id").distinct().collect()]
    own = F.col("doc_id").isin([x for x in ids if x is not None])
    made = all_candidates(units.where(own | F.col("doc_id").isNull() if None in ids else own), preset)
    same = [made[c].eqNullSafe(picked[c]) for c in keys]
    return made.join(F.broadcast(picked), same, "left_semi")


def distribution_by_stage(stages: dict[str, DataFrame]) -> DataFrame:
    """(question_type, one column per stage) of the numbers of candidates; every type has a row."""
    types = next(iter(stages.values())).sparkSession.createDataFrame([(t,) for t in TYPES], "question_type string")
    for name, found in stages.items():
        counts = found.groupBy("question_type").agg(F.count("*").alias(name))
        types = types.join(F.broadcast(counts), "question_type", "left").fillna(0, [name])
    return types


def unanswerable_candidates(units: DataFrame, terms: DataFrame) -> DataFrame:
    """Candidates of type unanswerable from `experiments.unanswerable_pairs`: a unit is asked for a term that it does not hold; no answer."""
    from corpusloom.operators import experiments

    pairs = experiments.unanswerable_pairs(units, terms)
    question = F.concat(F.lit("What does part "), F.col("part").cast("string"), F.lit(" say of "), F.col("term"), F.lit("?"))
    return pairs.select("doc_id", "part", F.lit(0).alias("pos"), F.lit("unanswerable").alias("question_type"), question.alias("question"), F.lit("").alias("gold_answer"))


def all_candidates(units: DataFrame, preset: Preset = LATIN) -> DataFrame:
    """Answerable candidates of every rule, each with its pair and next_part where it has one."""
    none = {"pair": F.lit(None).cast("array<string>"), "next_part": F.lit(None).cast("int")}
    plain = candidates(units, preset).unionByName(actor_candidates(units, preset)).withColumns(none)
    return plain.unionByName(comparison_candidates(units, preset).withColumn("next_part", none["next_part"])).unionByName(adjacent_comparisons(units))


def benchmark_steps(units: DataFrame, quota: int, per_doc: int = 6, per_type: int = 200, shortest: int = 12, longest: int = 120, overlap: float = 0.12, preset: Preset = LATIN) -> dict[str, DataFrame]:
    """raw candidates of all types, filled to quotas; deduped ones that the filter keeps; the final selection; and the reasons why candidates went."""
    # Quotas are those of each type alone.
    unanswerable = fill_quotas(unanswerable_candidates(units, definition_terms(units, preset)), per_doc, per_type)
    unanswerable = unanswerable.withColumns({"pair": F.lit(None).cast("array<string>"), "next_part": F.lit(None).cast("int")})
    raw = saved(quota_candidates(units, per_doc, per_type, preset).unionByName(unanswerable), "raw")
    judged = raw.withColumn("reason", filter_reason(F.col("question"), F.col("gold_answer"), shortest, longest, overlap, F.col("question_type"), F.col("pair"), preset))
    kept = judged.where("reason is null").drop("reason")
    deduped = saved(semantic_dedup(kept), "deduped")
    return {"raw": raw, "deduped": deduped, "final": saved(final_selection(deduped, quota), "final"), "reasons": filter_counts(judged, kept, deduped)}


def benchmark_stage(units: DataFrame, quota: int, least: int = 0, **how) -> tuple[DataFrame, DataFrame]:
    """(records, distribution): what `benchmark_steps` selects, and the numbers of candidates at each step; fewer than `least` is an error."""
    steps = benchmark_steps(units, quota, **how)
    if least and steps["final"].count() < least:
        raise ValueError(f"fewer than {least} candidates are left")
    return to_records(steps["final"], units), distribution_by_stage({k: steps[k] for k in ("raw", "deduped", "final")})


def filter_counts(judged: DataFrame, kept: DataFrame, deduped: DataFrame) -> DataFrame:
    """(question_type, reason, n): what the filter and the two deduplications take of the judged candidates, and as `kept` what they leave."""
    count = lambda df, name: df.groupBy("question_type").agg(F.count("*").alias("n")).withColumn("reason", F.lit(name))
    filtered = judged.where("reason is not null").groupBy("question_type", "reason").agg(F.count("*").alias("n"))
    once, left = count(lexical_dedup(kept), "once"), count(deduped, "kept")
    lexical = count(kept, "a").select("question_type", F.col("n").alias("all")).join(once, "question_type").select("question_type", (F.col("all") - F.col("n")).alias("n"), F.lit("lexical_duplicate").alias("reason"))
    semantic = once.select("question_type", F.col("n").alias("all")).join(left, "question_type").select("question_type", (F.col("all") - F.col("n")).alias("n"), F.lit("semantic_duplicate").alias("reason"))
    return filtered.unionByName(lexical).unionByName(semantic).unionByName(left).where("n > 0").select("question_type", "reason", "n")


def adjacent_pairs(units: DataFrame) -> DataFrame:
    """(doc_id, part, next_part): neighbouring units of a document that differ."""
    order = Window.partitionBy("doc_id").orderBy("part")
    rows = units.withColumns({"next_part": F.lead("part").over(order), "next_text": F.lead("text").over(order)})
    return rows.where(F.col("next_part").isNotNull() & (F.col("text") != F.col("next_text"))).select("doc_id", "part", "next_part")


def adjacent_comparisons(units: DataFrame) -> DataFrame:
    """Candidates of type comparison from neighbouring units of a document whose labels differ (label, else the part's number): pair has the two labels, next_part the second unit, and the answer is both texts."""
    labelled = units if "label" in units.columns else units.withColumn("label", F.concat(F.lit("part "), F.col("part").cast("string")))
    order = Window.partitionBy("doc_id").orderBy("part")
    rows = labelled.where(T.present(F.col("label"))).withColumns({f"next_{c}": F.lead(c).over(order) for c in ("part", "label", "text")})
    rows = rows.where(F.col("next_part").isNotNull() & (F.col("label") != F.col("next_label")))
    seed = F.concat(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("part").cast("string"), F.col("next_part").cast("string")), F.lit(":neighbours"))
    question = T.pick_template([F.concat(F.lit("How do "), F.col("label"), F.lit(" and "), F.col("next_label"), F.lit(" differ?")), F.concat(F.lit("What do "), F.col("label"), F.lit(" and "), F.col("next_label"), F.lit(" each say?"))], seed)
    return rows.select("doc_id", "part", F.lit(-1).alias("pos"), F.lit("comparison").alias("question_type"), question.alias("question"), T.normalize_space(F.concat_ws(" ", "text", "next_text")).alias("gold_answer"), F.array("label", "next_label").alias("pair"), "next_part")
