"""The registered queries and the pipeline over small tables on disk."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import langid, packing, simhash
from corpusloom.llm.queries import ORACLES, QUERIES

COMMON = {"en": "the of and to in that it is was for with from", "de": "der die und das nicht ist mit sich auf ein zu von", "fr": "le la les des et est une que dans pour sur avec"}


def passage(rng, lang, n=60):
    words = COMMON[lang].split()
    return " ".join(rng.choice(words) if rng.random() < 0.5 else "".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(4, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def given():
    rng = random.Random(21)
    rows = [(i, passage(rng, lang), lang) for i, lang in enumerate(rng.choices(list(COMMON), k=90))]
    edited = rows[3][1].split()
    edited[30] = "changed"
    rows += [(100, rows[0][1], rows[0][2]), (101, " ".join(edited), rows[3][2]), (102, None, "en"), (103, "", None), (104, "12 34 .,", "en"), (105, rows[7][1] + " write to some.one@mail.example.com or +49 170 1234567", rows[7][2])]
    return rows


@pytest.fixture(scope="module")
def sf_dir(spark, given, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame([(i, t, lang, "src0", len(t or "")) for i, t, lang in given], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, "u", t) for i, t, _ in given[:20] + given[90:]], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([(i, t) for i, t, _ in given[5:12]] + [(90, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    rng = random.Random(1)
    spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)], 0) for i in range(120)], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return str(d)


ROWS = {"op2_warc": 26, "op8_nearest_neighbours": 15}
#: Their rows are not those of a table; SQL tells how many there are.
REPORTS = ["op13_source_divergence"]


@pytest.mark.parametrize("name", [q for q in QUERIES if q.startswith("op") and q not in REPORTS])
def test_rows(spark, sf_dir, given, name):
    got = QUERIES[name](spark, sf_dir)
    assert got.count() == ROWS.get(name, len(given)) and len(set(got.columns)) == len(got.columns)


@pytest.mark.parametrize("name", list(ORACLES))
def test_sql(spark, sf_dir, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet/*.parquet'")
    mine, other = QUERIES[name](spark, sf_dir), db.sql(ORACLES[name])
    cols = sorted(mine.columns)
    want = sorted(map(repr, other.project(", ".join(cols)).fetchall()))
    assert sorted(repr(tuple(r)) for r in mine.select(*cols).collect()) == want


def linked(a, b):
    """What the near-dedup stage promises: 0.8 of the shingles."""
    x, y = (set(simhash.shingles(simhash.words_of(t), 5)) for t in (a, b))
    return (len(x & y) / len(x | y) if x | y else 1.0) >= 0.8


def test_pipeline(spark, sf_dir, given):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = simhash.written(stage(spark, docs, sf_dir), "t")
        assert docs.columns == before.columns
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    told = {i: t for i, t, _ in given if t and any(map(str.isalpha, t))}
    assert seen["language_id"] == told
    group = {}
    for i in sorted(told):
        group[i] = next((g for g in sorted(group) if group[g] == g and linked(told[g], told[i])), i)
    assert seen["simhash_near_dedup"] == {i: told[i] for i in told if group[i] == i}
    assert not {100, 101} & set(seen["simhash_near_dedup"]) and not {102, 103, 104} & set(seen["language_id"])
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in got} == set(seen["pii"]) and all(r["offset"] + r["length"] <= packing.SEQUENCE for r in got)


def test_pii_takes_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.personal_data(spark, docs, sf_dir).collect()}
    assert "[EMAIL] or [PHONE]" in got[105]["text"] and got[105]["n_chars"] == len(got[105]["text"])
    assert got[102]["text"] is None and all(got[r["doc_id"]]["text"] == r["text"] for r in docs.where("doc_id < 102").collect())


def test_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_held_out_accuracy(spark, sf_dir):
    got = QUERIES["op10_language_id"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id").where(F.col("held_out") & (F.col("lang_pred") != langid.UNDETERMINED))
    assert got.where("lang = lang_pred").count() >= 0.9 * got.count()
