"""Language identification by hierarchical discrimination.

First a linear machine for each family (one against all others) tells the language families apart, then
one-versus-one linear support vector machines separate the languages within the family. Machines are fitted by the executors. Features are hashed character n-grams of one to
three code points over the whole text, in lower case and with runs of other characters than letters
as one space; a text's vector is the mean over its n-grams.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import fresh, released, table

UNDETERMINED = "und"
DIMENSIONS = 1 << 14
#: The classifiers learn from about so many documents of each language at most (a bounded sample, chosen by hash), ...
SAMPLE_PER_LANGUAGE = 800
#: ... and from about so many in all: where there are many languages, from fewer of each, but of every one.
SAMPLE = 64_000
#: Texts are turned into features in pieces of so many code points, so that a very long one needs little memory.
PIECE = 1 << 18
#: Families of languages by ISO 639-1 code; a language that is not here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "celtic": "ga cy gd br",
    "turkic": "tr az kk uz ky tk",
    "indic": "hi bn ur mr gu pa ne",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_GAP = re.compile(r"[\W\d_]+")


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0].split("_")[0], lang)


def grams(text: str | None) -> Iterator[np.ndarray]:
    """The hashed n-grams of the whole text, piece by piece; none if it is null or has no letter."""
    if not text:
        return
    for at in range(0, len(text), PIECE):
        squeezed = _GAP.sub(" ", text[at : at + PIECE].lower()).strip()
        if not any(map(str.isalpha, squeezed)):
            continue
        c = np.frombuffer(f" {squeezed} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        one = c * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA6B) + one[1:]
        three = (two[:-1] ^ np.uint32(0x27D4EB2F)) * np.uint32(0xC2B2AE35) + one[2:]
        yield np.concatenate([x * np.uint32(0x2C1B3C6D) >> np.uint32(32 - 14) for x in (one, two, three)])


def features(text: str | None) -> np.ndarray:
    counts, total = np.zeros(DIMENSIONS), 0
    for g in grams(text):
        counts += np.bincount(g, minlength=DIMENSIONS)
        total += len(g)
    return counts / max(total, 1)


@dataclass
class Svm:
    """A linear machine over the mean vector, with the slope of its score."""

    weights: np.ndarray
    bias: float
    slope: float


Vector = tuple[np.ndarray, np.ndarray]


def fit_svm(x: list[Vector], y: np.ndarray, rounds: int = 25, c: float = 1.0) -> Svm:
    """Dual coordinate descent for the L1-loss linear SVM over sparse vectors; y is 1 or -1. Deterministic."""
    rng, n = np.random.default_rng(0), len(y)
    squares = np.array([float(v @ v) for _, v in x])
    scale = 1 / max(float(np.sqrt(squares).mean()), 1e-12)
    diagonal, alpha, w, bias = squares * scale * scale + 1, np.zeros(n), np.zeros(DIMENSIONS), 0.0
    bound = np.where(y > 0, c * n / (2 * max((y > 0).sum(), 1)), c * n / (2 * max((y < 0).sum(), 1)))
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(n):
            at, v = x[i]
            margin = y[i] * (float(w[at] @ v) * scale + bias)
            step = min(max(alpha[i] - (margin - 1) / diagonal[i], 0), bound[i]) - alpha[i]
            if step:
                alpha[i] += step
                w[at] += (step * y[i] * scale) * v
                bias += step * y[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return Svm(w * scale, float(bias), 2.0)


@dataclass
class Model:
    """Families by machines of one against all others, then languages within each family by one-versus-one machines."""

    families: list[str]
    languages: dict[str, list[str]]
    top: list[Svm]
    within: dict[str, list[tuple[int, int, Svm]]]

    def machines(self) -> list[Svm]:
        return self.top + [m for f in self.families for _, _, m in self.within[f]]

    def stacked(self) -> np.ndarray:
        m = self.machines()
        return np.array([x.weights for x in m]).T.astype(np.float32).copy() if m else np.zeros((DIMENSIONS, 0), np.float32)

    def decide(self, sums: np.ndarray) -> tuple[str, float]:
        """From the machines' mean sums without bias: the language, and the product of the winners' shares."""
        names, first = self.families, len(self.top)
        margins = [float(s) + m.bias for s, m in zip(sums, self.machines())]
        family, score = _winner(len(names), self.top, margins[:first])
        at = first + sum(len(self.within[f]) for f in names[:family])
        pairs = self.within[names[family]]
        lang, share = _vote(len(self.languages[names[family]]), pairs, margins[at : at + len(pairs)])
        return self.languages[names[family]][lang], min(max(score * share, 0.0), 1.0)


def _winner(n: int, machines: list[Svm], margins: list[float]) -> tuple[int, float]:
    """The class with the largest margin (ties: the first) and its sigmoid; of two classes one machine tells both."""
    if n == 1:
        return 0, 1.0
    if n == 2:
        margins, machines = [margins[0], -margins[0]], [machines[0]] * 2
    best = max(range(n), key=lambda k: (margins[k], -k))
    return best, float(1 / (1 + np.exp(-np.clip(machines[best].slope * margins[best], -50, 50))))


def _vote(n: int, pairs: list[tuple[int, int, Svm]], margins: list[float]) -> tuple[int, float]:
    """The class with the most pairwise wins (ties: the larger sum of margins, then the first), and its mean sigmoid."""
    if n == 1:
        return 0, 1.0
    wins, sums, share = np.zeros(n), np.zeros(n), np.zeros(n)
    for (i, j, m), v in zip(pairs, margins):
        p = 1 / (1 + np.exp(-np.clip(m.slope * v, -50, 50)))
        wins[i if v >= 0 else j] += 1
        sums[i] += v
        sums[j] -= v
        share[i] += p
        share[j] += 1 - p
    best = max(range(n), key=lambda k: (wins[k], sums[k], -k))
    return best, float(share[best] / (n - 1))


def _jobs(langs: list[str]) -> tuple[list[str], dict[str, list[str]], list[tuple[list[str], list[str]]]]:
    """Families, their languages, and for each machine the languages that count for it and those against."""
    families = sorted({family_of(x) for x in langs})
    languages = {f: [x for x in langs if family_of(x) == f] for f in families}
    one = families if len(families) > 2 else families[: len(families) - 1]
    jobs = [(languages[f], [x for x in langs if family_of(x) != f]) for f in one]
    return families, languages, jobs + [([own[i]], [own[j]]) for own in languages.values() for i, j in combinations(range(len(own)), 2)]


def _fitted(sample: list[tuple[Vector, str]], job: tuple[list[str], list[str]]) -> Svm:
    sides = {x: 1 for x in job[0]} | {x: -1 for x in job[1]}
    rows = [(x, sides[lang]) for x, lang in sample if lang in sides]
    return fit_svm([x for x, _ in rows], np.array([y for _, y in rows]))


def fit(sample: list[tuple[Vector, str]], over: Callable | None = None) -> Model:
    """A model of the languages in the sample; of an empty sample a model without any. over(jobs) may fit the machines elsewhere."""
    families, languages, jobs = _jobs(sorted({lang for _, lang in sample}))
    machines = over(jobs) if over else [_fitted(sample, j) for j in jobs]
    n_top = len(families) if len(families) > 2 else max(len(families) - 1, 0)
    top, rest, within = machines[:n_top], iter(machines[n_top:]), {}
    for f in families:
        within[f] = [(i, j, next(rest)) for i, j in combinations(range(len(languages[f])), 2)]
    return Model(families, languages, top, within)


def _packed(counts: np.ndarray) -> bytes:
    at = np.flatnonzero(counts)
    return at.astype(np.uint16).tobytes() + counts[at].astype(np.float32).tobytes()


def _unpacked(data: bytes) -> Vector:
    n = len(data) // 6
    return np.frombuffer(data, np.uint16, n).astype(np.int64), np.frombuffer(data, np.float32, n, 2 * n).astype(np.float64)


def train(labelled: DataFrame, key: Column, text: str = "text", lang: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Learns from about per_language rows of each language, or as many as SAMPLE allows to each, chosen by the hash of key.

    Every language that occurs is learned; the model has 64 KB for each family and for each two languages of one. Rows with a null lang
    or text or without a letter are left out. Features are made by the executors, of whole texts however
    long; the driver gets at most twice the asked number of vectors, first ones in the order of their hash, each of at most
    DIMENSIONS entries, and shares them with the executors, which fit a machine each. Rows that repeat are learned as often as they are
    chosen; no rows give a model without languages.
    """
    spark = labelled.sparkSession
    rows = labelled.select(key.cast("string").alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null and text is not null")
    counts = rows.groupBy("lang").count()
    n = counts.count()
    if not n:
        return fit([])
    each = min(per_language, max(SAMPLE // n, 1))
    hashed = F.pmod(F.xxhash64("key"), F.lit(2**31))
    # A row for each language.
    chosen = rows.join(F.broadcast(counts), "lang").withColumn("hash", hashed).where(F.col("hash") < F.least(F.lit(1.0), F.lit(float(each)) / F.col("count")) * 2**31)

    @F.arrow_udf("binary")
    def vector(texts: pa.Array) -> pa.Array:
        return pa.array([_packed(features(t.as_py())) for t in texts], pa.binary())

    got = chosen.select("hash", "key", "lang", vector("text").alias("v")).orderBy("hash", "key", "lang", "v").limit(2 * each * n).collect()
    got = sorted((r["lang"], r["key"] or "", bytes(r["v"])) for r in got)
    packed = [(v, lang) for lang, _, v in got if v]
    held = spark.sparkContext.broadcast(packed)

    def fitting(jobs: list) -> list[Svm]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sample = [(_unpacked(v), lang) for v, lang in held.value]
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    m = _fitted(sample, jobs[i])
                    yield pa.record_batch([pa.array([i], pa.int64()), pa.array([m.weights.tobytes()]), pa.array([m.bias]), pa.array([m.slope])], ["id", "weights", "bias", "slope"])

        if not jobs:
            return []
        told = spark.range(0, len(jobs), 1, min(len(jobs), 4 * spark.sparkContext.defaultParallelism)).mapInArrow(released(run), "id long, weights binary, bias double, slope double").collect()
        return [Svm(np.frombuffer(bytes(r["weights"])).copy(), r["bias"], r["slope"]) for r in sorted(told, key=lambda r: r["id"])]

    model = fit([(None, lang) for _, lang in packed], fitting)
    held.destroy()
    return model


def identify(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language and a score from 0 to 1; UNDETERMINED and 0 for null texts and those without a letter.

    A very long text is read piece by piece. Rows that repeat are told alike; no rows, no rows; other columns stay, whatever their names.
    """
    weights, empty = model.stacked(), not model.families
    held = docs.sparkSession.sparkContext.broadcast((model, weights))

    def told(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, weights = held.value
        for texts in batches:
            out = []
            for value in texts:
                t = value.as_py()
                sums, total = np.zeros(weights.shape[1]), 0
                for g in grams(t):
                    sums += np.bincount(g, minlength=DIMENSIONS) @ weights if len(g) > 4 * DIMENSIONS else weights.take(g, axis=0).sum(0, dtype=np.float64)
                    total += len(g)
                out.append((UNDETERMINED, 0.0) if not total or empty else model.decide(sums / total))
            lang, score = zip(*out) if out else ((), ())
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang", "score"])

    @F.arrow_udf("lang string, score double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from released(told)(batches)

    found, = fresh(docs, "_found")
    return docs.withColumn(found, predict(F.col(text))).withColumns({lang: F.col(f"{found}.lang"), score: F.col(f"{found}.score")}).drop(found)


def held_out(doc_id: str = "doc_id") -> Column:
    """Those documents that are never learned from; a null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(True))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document; only documents that are not held out are learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out().alias("held_out"))
    model = train(docs.where("not held_out"), F.col("doc_id"))
    return identify(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")
