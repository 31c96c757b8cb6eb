"""Variants, reports, automatic test sets and the command line."""

import json
import zipfile

import pytest

from corpusloom.__main__ import main
from corpusloom.operators import experiments


def test_variants(spark, tmp_path):
    hits = spark.createDataFrame([(1, 11, 1)], "query_id long, doc_id long, rank int")
    rel = spark.createDataFrame([(1, 11)], "query_id long, doc_id long")

    def fails():
        raise ValueError("no index")

    done, failed = experiments.run_variants({"a": lambda: hits, "b": fails}, rel, spark.createDataFrame([(1,)], "query_id long"))
    assert done[0]["variant"] == "a" and done[0]["recall_3"] == 1.0 and "no index" in failed["b"]
    bundle = experiments.write_report(str(tmp_path), done, failed)
    assert sorted(zipfile.ZipFile(bundle).namelist()) == ["summary.json", "summary.md"] and json.loads((tmp_path / "summary.json").read_text())["failed"]


def test_auto_eval(spark):
    chunks = spark.createDataFrame([(1, "alpha beta"), (2, None)], "doc_id long, text string")
    made = experiments.auto_testset(chunks, lambda: lambda p: '{"question": "what", "answer": "alpha"}' if "alpha" in p else "none", 5).collect()
    assert [(r["doc_id"], r["answer"]) for r in made] == [(1, "alpha")]
    test = spark.createDataFrame([(1, "what alpha", "alpha", 1)], "query_id long, question string, truth string, doc_id long")
    answers = spark.createDataFrame([(1, "alpha beta")], "query_id long, answer string")
    hits = spark.createDataFrame([(1, 9, 1, "gamma"), (1, 1, 2, "alpha beta")], "query_id long, doc_id long, rank int, text string")
    r = experiments.auto_eval(answers, test, hits).first()
    assert (r["faithfulness"], r["answer_relevancy"], r["context_precision"], r["answer_correctness"], r["recall_3"]) == (1.0, 0.5, 0.5, 1.0, 1.0)


def test_unanswerable(spark):
    units = spark.createDataFrame([(d, 0, f"text of {d}") for d in range(200)], "doc_id long, part int, text string")
    terms = spark.createDataFrame([(1000 + k, f"term{k}") for k in range(300)], "doc_id long, term string")
    got = experiments.unanswerable_pairs(units, terms).collect()
    assert 150 < len(got) <= 200 and len({(r["doc_id"], r["part"]) for r in got}) == len(got)


def test_command_line(capsys):
    main(["list"])
    assert "bm25_topk" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["run", "nothing", "a", "b"])
