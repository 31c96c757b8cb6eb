"""Answers of models: reading payloads, checking them against contexts, guardrails and the generation stage.

Contexts of a query are an array of structs (chunk_id, doc_id, title, text, rank, score) in rank order; a query's are few (top k).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.presets import LATIN
from corpusloom.operators import context, models

FALLBACK = "No reliable answer could be generated."
BLOCKED = "The answer was withheld: it is not supported well enough."
#: A context that shares so many code points in a row with an answer may be what it rests on; at most INFERRED of them.
SHARED, INFERRED = 4, 2
#: A sentence is supported by a context with this share of its tokens; a citation by one with that share.
SENTENCE_SUPPORT, CITATION_SUPPORT = 0.4, 0.6
#: An answer is consistent if this share of its sentences is supported.
CONSISTENT = 0.5

CONTEXT = "struct<chunk_id:string,doc_id:string,title:string,text:string,rank:int,score:double,source_ref:string>"
CITATION = "struct<label:string,chunk_id:string,doc_id:string,title:string,span_text:string,rank:int,source_ref:string>"


def _ids(values: Column | None = None) -> Column:
    none = F.array().cast("array<string>")
    return none if values is None else F.coalesce(values, none)


def strip_reasoning(content: Column) -> Column:
    """Without <think> segments; if nothing is left what follows the last end mark, else the whole."""
    text = F.coalesce(content, F.lit(""))
    out = T.strip(F.regexp_replace(text, r"(?is)<think>.*?</think>\s*", ""))
    tail = T.strip(F.substring_index(text, "</think>", -1))
    return F.when(out != "", out).when(F.contains(text, F.lit("</think>")) & (tail != ""), tail).otherwise(T.strip(text))


def _object(text: Column) -> Column:
    """text if it is a JSON object and nothing more; within brackets what follows an object is seen."""
    return F.when(text.startswith("{") & F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull(), text)


def _strings(listed: Column) -> Column:
    """The strings of a JSON list, without what else stands in it."""
    return F.coalesce(F.transform(F.regexp_extract_all(listed, F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1)), lambda x: F.coalesce(F.get_json_object(F.concat(F.lit('{"v":"'), x, F.lit('"}')), "$.v"), x)), _ids())


def read_payload(content: Column) -> Column:
    """Struct (answer, used_context_ids, abstained, parse_status) of a model's raw answer.

    strict_json: the whole is an object; loose_json: what stands from the first brace to the last; relaxed_extraction:
    single fields found in broken JSON, or a fenced block; else minimal_fallback, the text itself as an abstained answer.
    """

    def of(text: Column) -> Column:
        strict, loose = _object(text), _object(F.regexp_extract(text, r"(?s)(\{.*\})", 1))
        answer = F.regexp_extract(text, r'"answer"\s*:\s*"((?:[^"\\]|\\.)*)"', 1)
        has_answer, has_state = text.rlike(r'"answer"\s*:\s*"(?:[^"\\]|\\.)*"'), text.rlike(r'(?i)"abstained"\s*:\s*(true|false)')
        listed = F.regexp_extract(text, r'"used_context_ids"\s*:\s*\[([^\]]*)\]', 1)
        has_ids = text.rlike(r'"used_context_ids"\s*:\s*\[[^\]]*\]')
        fenced = _object(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1))
        whole = F.coalesce(strict, loose, F.when(~(has_answer | has_state | has_ids), fenced))
        said = F.get_json_object(whole, "$.abstained")
        state = said.isNotNull() & ~F.lower(said).isin("false", "0", "", "null", "[]", "{}")
        plain = F.coalesce(F.get_json_object(F.concat(F.lit('{"v":"'), answer, F.lit('"}')), "$.v"), answer)
        fields = lambda a, ids, state, how: F.struct(a.alias("answer"), ids.alias("used_context_ids"), state.alias("abstained"), F.lit(how).alias("parse_status"))
        given = lambda how: fields(F.coalesce(F.get_json_object(whole, "$.answer"), F.lit("")), _strings(F.get_json_object(whole, "$.used_context_ids")), state, how)
        found = F.regexp_extract_all(listed, F.lit(r'"([^"]+)"'), F.lit(1))
        relaxed = fields(plain, _ids(found), F.lower(F.regexp_extract(text, r'(?i)"abstained"\s*:\s*(true|false)', 1)) == "true", "relaxed_extraction")
        return (
            F.when(strict.isNotNull(), given("strict_json"))
            .when(loose.isNotNull(), given("loose_json"))
            .when(has_answer | has_state | has_ids, relaxed)
            .when(fenced.isNotNull(), given("relaxed_extraction"))
            .otherwise(fields(F.coalesce(F.nullif(text, F.lit("")), F.lit(FALLBACK)), _ids(), F.lit(True), "minimal_fallback"))
        )

    return T.let(strip_reasoning(content), of)


def _by_labels(answer: Column, contexts: Column) -> Column:
    """Ids of the contexts that [n] in the answer names, each once, in the order of the labels."""
    labels = F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1))
    ids = F.transform(labels, lambda n: F.get(contexts, n.try_cast("int") - 1)["chunk_id"])
    return F.array_distinct(F.array_compact(ids))


def _by_overlap(answer: Column, contexts: Column) -> Column:
    """Ids of the contexts that share most code points in a row with the answer, white space aside."""
    bare = lambda c: F.regexp_replace(c, T.SPACE, "")
    scored = F.transform(contexts, lambda c: F.struct(F.char_length(T.longest_overlap(bare(answer), bare(F.concat(c["title"], c["text"])))).alias("n"), c["chunk_id"].alias("id")))
    best = F.slice(F.sort_array(F.filter(scored, lambda s: s["n"] > 0), False), 1, INFERRED)
    return F.when(F.char_length(bare(answer)) < SHARED, _ids()).otherwise(F.transform(F.filter(best, lambda s: s["n"] >= SHARED), lambda s: s["id"]))


def normalise_payload(payload: Column, contexts: Column, require_ids: bool = True, abstain_when_insufficient: bool = True) -> Column:
    """Struct (answer, abstained, used_context_ids, invalid_context_ids, schema_status) of a payload against its contexts.

    Ids of no context are filtered. Without any valid one they are inferred from citation labels, else from shared text,
    else the answer is turned into an abstention.
    """
    known = F.transform(contexts, lambda c: c["chunk_id"])
    given = payload["used_context_ids"]
    valid = F.filter(given, lambda x: F.array_contains(known, x))
    invalid = F.filter(given, lambda x: ~F.array_contains(known, x))
    answer = F.coalesce(F.nullif(T.strip(payload["answer"]), F.lit("")), F.lit(FALLBACK))

    def decide(s: Column) -> Column:
        missing = F.lit(require_ids) & (F.size(s["valid"]) == 0) & ~s["abstained"]
        labelled, shared = missing & (F.size(s["labels"]) > 0), missing & (F.size(s["labels"]) == 0) & (F.size(s["shared"]) > 0)
        used = F.when(labelled, s["labels"]).when(shared, s["shared"]).otherwise(s["valid"])
        forced = missing & ~labelled & ~shared
        status = (
            F.when(labelled, F.lit("inferred_context_ids_from_citations"))
            .when(shared, F.lit("inferred_context_ids_from_answer"))
            .when(forced, F.lit("forced_abstain_missing_context_ids"))
            .when(F.size(s["invalid"]) > 0, F.lit("filtered_invalid_context_ids"))
            .otherwise(F.lit("valid"))
        )
        late = F.lit(abstain_when_insufficient) & (F.size(used) == 0) & ~s["abstained"] & ~forced
        status = F.when(late & (status == "valid"), F.lit("forced_abstain_no_context_ids")).otherwise(status)
        return F.struct(s["answer"].alias("answer"), (s["abstained"] | forced | late).alias("abstained"), used.alias("used_context_ids"), s["invalid"].alias("invalid_context_ids"), status.alias("schema_status"))

    fields = F.struct(answer.alias("answer"), payload["abstained"].alias("abstained"), valid.alias("valid"), invalid.alias("invalid"), _by_labels(answer, contexts).alias("labels"))

    def shared(s: Column) -> Column:
        # Only where nothing else tells are texts searched.
        needed = F.lit(require_ids) & (F.size(s["valid"]) == 0) & ~s["abstained"] & (F.size(s["labels"]) == 0)
        found = F.when(needed, _by_overlap(s["answer"], contexts)).otherwise(_ids())
        return F.struct(*[s[k].alias(k) for k in ("answer", "abstained", "valid", "invalid", "labels")], found.alias("shared"))

    return T.let(fields, lambda s: T.let(shared(s), decide))


def build_citations(used: Column, contexts: Column, span: int = 120) -> Column:
    """Citations of the used contexts, in the order of the contexts."""
    chosen = F.filter(contexts, lambda c: F.array_contains(used, c["chunk_id"]))
    return F.transform(chosen, lambda c: F.struct(c["rank"].cast("string").alias("label"), c["chunk_id"].alias("chunk_id"), c["doc_id"].alias("doc_id"), c["title"].alias("title"), F.btrim(F.left(c["text"], F.lit(span))).alias("span_text"), c["rank"].alias("rank"), c["source_ref"].alias("source_ref")))


def alignment(used: Column, citations: Column, contexts: Column) -> Column:
    """Struct of how used ids and citations agree with the contexts; without any the ratios are 1."""
    known = F.transform(contexts, lambda c: c["chunk_id"])

    def supported(c: Column) -> Column:
        texts = F.transform(F.filter(contexts, lambda x: x["chunk_id"] == c["chunk_id"]), lambda x: x["text"])
        held = lambda t: ((c["span_text"] != "") & F.contains(t, c["span_text"])) | (T.overlap_ratio(T.tokens(c["span_text"]), T.tokens(t)) >= CITATION_SUPPORT)
        return F.exists(texts, held)

    counts = F.struct(
        F.size(used).alias("used"),
        F.size(F.filter(used, lambda x: F.array_contains(known, x))).alias("used_valid"),
        F.size(citations).alias("cited"),
        F.size(F.filter(citations, lambda c: F.array_contains(known, c["chunk_id"]))).alias("cited_valid"),
        F.size(F.filter(citations, supported)).alias("supported"),
    )
    over = lambda n, d: F.when(d == 0, F.lit(1.0)).otherwise(n / d)
    return T.let(counts, lambda n: F.struct(
        over(n["used_valid"], n["used"]).alias("used_context_id_valid_ratio"),
        over(n["cited_valid"], n["cited"]).alias("citation_id_valid_ratio"),
        over(n["supported"], n["cited"]).alias("citation_support_ratio"),
        ((n["used_valid"] == n["used"]) & (n["cited_valid"] == n["cited"]) & (n["supported"] == n["cited"])).alias("alignment_all_valid"),
        (n["cited"] - n["supported"]).alias("unsupported_citation_count"),
    ))


def consistency(answer: Column, contexts: Column, delimiters: str = LATIN.delimiters) -> Column:
    """The share of the answer's sentences of which a context has SENTENCE_SUPPORT of the tokens; without sentences 0."""
    sentences = T.bare_sentences(F.regexp_replace(F.coalesce(answer, F.lit("")), r"\[\d+\]", ""), delimiters)
    tokens = F.transform(contexts, lambda c: F.array_distinct(T.tokens(F.concat_ws(" ", c["title"], c["text"]))))

    def share(s: Column, held: Column) -> Column:
        found = F.filter(s, lambda x: F.exists(held, lambda t: T.overlap_ratio(T.tokens(x), t) >= SENTENCE_SUPPORT))
        return F.when(F.size(s) == 0, F.lit(0.0)).otherwise(F.size(found) / F.size(s))

    return T.let(sentences, lambda s: T.let(tokens, lambda held: share(s, held)))


def guarded(rows: DataFrame, least_top: float, least_support: float, brackets: bool = True, check_consistency: bool = True, message: str = BLOCKED) -> DataFrame:
    """rows (answer, abstained, used_context_ids, citations, contexts) with what the guardrails leave of them.

    A blocked answer loses its text, ids and citations and counts as abstained; guardrail_reasons say why. What was
    computed on the answer before, such as its alignment, stays as it was.
    """
    top = F.coalesce(F.get("contexts", 0)["score"], F.lit(0.0))
    support = consistency(F.col("answer"), F.col("contexts"))
    rows = rows.withColumns({"guardrail_top_score": top, "guardrail_support": support})
    reasons = F.array_compact(F.array(
        F.when(F.col("guardrail_top_score") < least_top, F.lit("top_score_below_threshold")),
        F.when(F.lit(brackets) & ~F.col("abstained") & ~T.has_citation_brackets(F.col("answer")), F.lit("missing_citation_brackets")),
        F.when(F.lit(check_consistency) & (F.col("guardrail_support") < least_support), F.lit("nli_guardrail_failed")),
    ))
    rows = rows.withColumn("guardrail_reasons", reasons)
    blocked = F.size("guardrail_reasons") > 0
    none = F.array().cast(f"array<{CITATION}>")
    return rows.withColumns({
        "guardrail_status": F.when(blocked, F.lit("blocked")).otherwise(F.lit("passed")),
        "answer": F.when(blocked, F.lit(message)).otherwise(F.col("answer")),
        "abstained": blocked | F.col("abstained"),
        "used_context_ids": F.when(blocked, _ids()).otherwise(F.col("used_context_ids")),
        "citations": F.when(blocked, none).otherwise(F.col("citations")),
    })


def gathered(hits: DataFrame) -> DataFrame:
    """(query_id, contexts) from hits (query_id, doc_id, title, text, rank, score[, chunk_id, metadata or source_file]) of few rows a query."""
    named = {"metadata": lambda: context.source_ref(F.col("metadata")), "source_file": lambda: F.nullif(F.btrim("source_file"), F.lit(""))}
    source = next((make() for name, make in named.items() if name in hits.columns), F.lit(None).cast("string"))
    chunk = F.col("chunk_id") if "chunk_id" in hits.columns else F.col("doc_id")
    one = F.struct(F.col("rank").cast("int").alias("rank"), chunk.cast("string").alias("chunk_id"), F.col("doc_id").cast("string").alias("doc_id"), "title", "text", F.col("score").cast("double").alias("score"), source.alias("source_ref"))
    lists = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("c"))
    return lists.select("query_id", F.transform("c", lambda c: F.struct(*[c[k].alias(k) for k in ("chunk_id", "doc_id", "title", "text", "rank", "score", "source_ref")])).alias("contexts"))


def extractive(rows: DataFrame, most_contexts: int = 3, most_sentences: int = 4, least_score: float = 0.0, delimiters: str = LATIN.delimiters) -> DataFrame:
    """rows (query_id, query_text, contexts) with answer, abstained, used_context_ids and generation_method."""
    strong = F.filter(F.slice("contexts", 1, most_contexts), lambda c: c["score"] >= least_score)
    rows = rows.withColumn("_strong", strong)
    sentences = F.slice(F.array_distinct(F.flatten(F.transform("_strong", lambda c: T.split_sentences(c["text"], delimiters)))), 1, most_sentences)
    text = F.array_join(sentences, " ")
    rows = rows.withColumns({"abstained": F.size("_strong") == 0, "used_context_ids": F.transform("_strong", lambda c: c["chunk_id"]), "generation_method": F.lit("extractive")})
    return rows.withColumn("answer", F.when(F.col("abstained"), F.lit(context.NO_ANSWER)).otherwise(text)).drop("_strong")


def generated(rows: DataFrame, make: Callable[[], models.Client], require_ids: bool = True, abstain_when_insufficient: bool = True, variant: str = "strict_grounded_v1") -> DataFrame:
    """rows (query_id, query_text, contexts) with a client's answers, read and normalised."""
    said = models.complete(rows.withColumn("prompt", models.prompt_of(F.col("query_text"), F.col("contexts"), variant)), make).drop("payload", "status")
    said = said.withColumn("_p", read_payload(F.col("raw"))).withColumn("_n", normalise_payload(F.col("_p"), F.col("contexts"), require_ids, abstain_when_insufficient))
    fields = {k: F.col(f"_n.{k}") for k in ("answer", "abstained", "used_context_ids", "invalid_context_ids", "schema_status")}
    return said.withColumns({**fields, "parse_status": F.col("_p.parse_status"), "generation_method": F.lit("llm_grounded")}).drop("_p", "_n", "prompt")


GENERATORS: dict[str, Callable[..., DataFrame]] = {"extractive": extractive, "llm": generated}


def build_generator(name: str, **options) -> Callable[[DataFrame], DataFrame]:
    """A generator by name: extractive, or llm with make=."""
    if name not in GENERATORS:
        raise ValueError(f"unknown generator {name!r}; there are {sorted(GENERATORS)}")
    return lambda rows: GENERATORS[name](rows, **options)


def generation_stage(hits: DataFrame, queries: DataFrame, generator: Callable[[DataFrame], DataFrame], least_top: float = 0.0, least_support: float = CONSISTENT, brackets: bool = False, check_consistency: bool = False) -> DataFrame:
    """Answers of all queries (query_id, query_text): contexts gathered, answers generated, aligned, then guarded."""
    rows = queries.select("query_id", "query_text").join(gathered(hits), "query_id", "left")
    rows = generator(rows.withColumn("contexts", F.coalesce("contexts", F.array().cast(f"array<{CONTEXT}>"))))
    rows = rows.withColumn("citations", build_citations(F.col("used_context_ids"), F.col("contexts")))
    rows = rows.withColumn("alignment", alignment(F.col("used_context_ids"), F.col("citations"), F.col("contexts")))
    return guarded(rows, least_top, least_support, brackets, check_consistency)


def stage_counts(answers: DataFrame) -> DataFrame:
    """(generation_method, n, n_abstained, n_aligned, n_blocked): the counters of a generation report."""
    return answers.groupBy("generation_method").agg(F.count("*").alias("n"), F.count_if("abstained").alias("n_abstained"), F.count_if(F.col("alignment.alignment_all_valid")).alias("n_aligned"), F.count_if(F.col("guardrail_status") == "blocked").alias("n_blocked"))


#: The stages of a generation run by what an error says, the first that fits.
FAILURES = (("input_lookup", ("no retrieval result",)), ("timeout", ("timeout", "timed out")), ("output_parsing", ("jsondecode", "parse")), ("schema_validation", ("used_context_ids", "schema")), ("citation_postprocess", ("citation",)), ("model_loading_or_inference", ("cuda", "mps", "model")))


def failure_stage(error: Column) -> Column:
    """Which stage an error text (with the name of its kind) of a generation run names; `none` without one, and `generation` where nothing tells."""
    said = F.lower(F.coalesce(error, F.lit("")))
    out = F.when(said == "", F.lit("none"))
    for stage, marks in FAILURES:
        out = out.when(F.reduce(F.array(*[F.contains(said, F.lit(m)) for m in marks]), F.lit(False), lambda a, x: a | x), F.lit(stage))
    return out.otherwise(F.lit("generation"))
