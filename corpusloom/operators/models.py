"""Model hooks: encoders, rerankers, query expansion and answers by any callable, in batches on the executors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T

Encoder = Callable[[list[str]], np.ndarray]
Scorer = Callable[[list[str], list[str]], list[float]]
Client = Callable[[str], str]


def hashing_encoder(dim: int = 64) -> Encoder:
    """A deterministic encoder for tests: hashed character trigrams, unit norm."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for k in range(max(len(t) - 2, 1)):
                h = int.from_bytes(hashlib.md5(t[k : k + 3].encode()).digest()[:4], "big")
                out[i, h % dim] += 1 if h >> 31 else -1
        norm = np.sqrt((out * out).sum(1, keepdims=True))
        return out / np.where(norm == 0, 1, norm)

    return encode


def embed(docs: DataFrame, make: Callable[[], Encoder], text: str = "text", out: str = "embedding") -> DataFrame:
    """docs with vectors; `make` loads the encoder once in each worker's task."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make()
        for texts in batches:
            yield pd.Series(list(encode(texts.fillna("").tolist())))

    return docs.withColumn(out, run(F.col(text)))


def segmented(docs: DataFrame, make: Callable[[], Callable[[str], list[str]]], text: str = "text", out: str = "tokens") -> DataFrame:
    """docs with tokens by a word segmenter: its words, then those of the plain tokenizer."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cut = make()
        for texts in batches:
            yield texts.fillna("").map(lambda t: [w for w in map(str.strip, cut(t)) if w])

    return docs.withColumn(out, F.concat(run(F.col(text)), T.tokens(F.col(text))))


def cross_scores(hits: DataFrame, make: Callable[[], Scorer]) -> DataFrame:
    """hits (query_text, text) with the score replaced by a cross-encoder's."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        score = make()
        for q, t in batches:
            yield pd.Series(score(q.fillna("").tolist(), t.fillna("").tolist()), dtype=float)

    return hits.withColumn("score", run("query_text", "text"))


def complete(prompts: DataFrame, make: Callable[[], Client], prompt: str = "prompt") -> DataFrame:
    """prompts with the client's raw answer, the JSON object in it and how that was found."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = make()
        for texts in batches:
            yield texts.fillna("").map(client)

    said = prompts.withColumn("raw", run(F.col(prompt)))
    return said.withColumns({"payload": T.json_payload(F.col("raw")), "status": T.parse_status(F.col("raw"))})


#: What prompts ask for: the answer from passages alone, or the answer first and its passages after it.
PROMPTS = {
    "strict_grounded_v1": "Answer only from the passages, citing them as [n]. Reply with a JSON object with answer, used_context_ids and abstained.",
    "grounded_answer_first_v1": "Answer the question first, then name the passages that the answer rests on, citing them as [n]. Reply with a JSON object with answer, used_context_ids and abstained.",
}
_REWRITE = "Rewrite this query in {n} ways as JSON with a list named queries: "
_HYDE = "Write a short passage that would answer this query, as JSON with a field named passage: "


def prompt_of(query: Column, contexts: Column, variant: str = "strict_grounded_v1", most: int = 5, chars: int = 1200) -> Column:
    """A grounded prompt from a question and its contexts (title, chunk_id, text, rank), the first `most` of them, cut at `chars`."""
    if variant not in PROMPTS:
        raise ValueError(f"unknown prompt {variant!r}; there are {sorted(PROMPTS)}")
    passage = lambda c: F.concat(F.lit("["), c["rank"].cast("string"), F.lit("] "), c["title"], F.lit(" ("), c["chunk_id"], F.lit(")\n"), F.left(c["text"], F.lit(chars)))
    block = F.array_join(F.transform(F.slice(contexts, 1, most), passage), "\n\n")
    return F.concat(F.lit(PROMPTS[variant] + "\n\n"), block, F.lit("\n\nQuestion: "), query)


def grounded_prompt(blocks: DataFrame, queries: DataFrame, variant: str = "strict_grounded_v1") -> DataFrame:
    """(query_id, prompt) from context blocks and questions."""
    ask = F.concat(F.lit(PROMPTS[variant] + "\n\n"), F.coalesce("block", F.lit("")), F.lit("\n\nQuestion: "), F.col("query_text"))
    return queries.join(blocks, "query_id", "left").select("query_id", ask.alias("prompt"))


def expand(queries: DataFrame, make: Callable[[], Client], n: int = 3, multi_query: bool = True, hyde: bool = False) -> DataFrame:
    """(query_id, source, text): up to n rewritten queries of each and a passage that would answer it, as the client's JSON gives them."""
    out = None
    if multi_query:
        said = complete(queries.withColumn("prompt", F.concat(F.lit(_REWRITE.format(n=n)), F.col("query_text"))), make)
        out = said.select("query_id", F.lit("multi_query").alias("source"), F.explode(F.slice(T.transform_payload(F.col("raw"), n)["multi_queries"], 1, n)).alias("text")).where(T.present(F.col("text")))
    if hyde:
        said = complete(queries.withColumn("prompt", F.concat(F.lit(_HYDE), F.col("query_text"))), make)
        passage = said.select("query_id", F.lit("hyde").alias("source"), T.transform_payload(F.col("raw"))["hyde"].alias("text")).where(T.present(F.col("text")))
        out = passage if out is None else out.unionByName(passage)
    return queries.select("query_id", F.lit("").alias("source"), F.lit("").alias("text")).limit(0) if out is None else out


def mean_pooled(tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Unit vectors from token vectors (text, token, component) by the mean over unmasked tokens; a zero vector stays zero."""
    weights = mask[:, :, None].astype(np.float64)
    mean = (tokens * weights).sum(1) / np.maximum(weights.sum(1), 1e-9)
    norm = np.sqrt((mean * mean).sum(1, keepdims=True))
    return (mean / np.where(norm == 0, 1, norm)).astype(np.float32)


def pooled_encoder(make: Callable[[], Callable[[list[str]], tuple[np.ndarray, np.ndarray]]]) -> Callable[[], Encoder]:
    """A factory of encoders from one of models that give token vectors and their mask: texts become the mean of their tokens, of length one."""

    def built() -> Encoder:
        model = make()
        return lambda texts: mean_pooled(*model(texts))

    return built


def http_client(url: str, model: str, key: str = "", timeout: float = 60, temperature: float = 0.0) -> Callable[[], Client]:
    """A factory of clients of any chat-completions endpoint."""

    def make() -> Client:
        import json
        import urllib.request

        def ask(prompt: str) -> str:
            body = {"model": model, "temperature": temperature, "messages": [{"role": "user", "content": prompt}]}
            headers = {"Content-Type": "application/json", **({"Authorization": f"Bearer {key}"} if key else {})}
            request = urllib.request.Request(f"{url.rstrip('/')}/chat/completions", json.dumps(body).encode(), headers)
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return json.load(answer)["choices"][0]["message"]["content"]

        return ask

    return make
