"""Tables that go to files and come back whole."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import records

TEXTS = ['plain', 'two\nlines\r\nand "quotes" \\ back', "line separator\x85next", "", None, "é\U0001f600 \t", '{"contentText": "nested"}', "x" * 300_000]


def test_raw_records_by_line(spark, tmp_path):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "docId long, contentText string")
    rows.repartition(3).write.json(str(tmp_path / "raw"))
    got = records.read_raw(spark, str(tmp_path / "raw"), by_line=True).select(F.get_json_object("extra", "$.docId").cast("int").alias("i"), "content_text", "doc_id").collect()
    assert {r["i"]: r["content_text"] for r in got} == {i: t or None for i, t in enumerate(TEXTS)} and len({r["doc_id"] for r in got}) == len(TEXTS)
    whole = records.read_raw(spark, str(tmp_path / "raw")).select("content_text", "doc_id").collect()
    assert sorted(map(str, whole)) == sorted(str(r) for r in records.read_raw(spark, str(tmp_path / "raw"), by_line=True).select("content_text", "doc_id").collect())


def test_lines_of_a_file_in_many_splits(spark, tmp_path):
    lines = [json.dumps({"docId": i, "contentText": f"text {i} " + "y" * (i % 97)}) for i in range(4000)]
    (tmp_path / "a.json").write_text("\n".join(x + "\n" * (k % 3 == 0) for k, x in enumerate(lines)))
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in held:
            spark.conf.set(k, "16384")
        raw = records.read_raw(spark, str(tmp_path / "a.json"), by_line=True)
        got = {r["record_index"]: r["i"] for r in raw.select("record_index", F.get_json_object("extra", "$.docId").cast("int").alias("i")).collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    flat = (tmp_path / "a.json").read_text().split("\n")
    assert got == {n: json.loads(x)["docId"] for n, x in enumerate(flat) if x}


def test_last_of_files_whatever_the_partitioning(spark, tmp_path):
    rows = spark.createDataFrame([(str(i % 50), f"a{i}") for i in range(500)], "query_id string, answer string")
    paths = [str(tmp_path / str(k)) for k in range(2)]
    records.write_table(rows.coalesce(1), paths[0])
    records.write_table(spark.createDataFrame([("7", "late"), ("new", "only")], rows.schema), paths[1])
    for n in (1, 5):
        back = records.last_of(records.read_in_order(spark, records.ANSWER, *paths).repartition(n), "query_id").collect()
        assert {r["query_id"]: r["answer"] for r in back} == {**{str(i): f"a{450 + i}" for i in range(50)}, "7": "late", "new": "only"}


def test_a_line_that_is_no_object(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"docId": 1}\n[1]\n')
    with pytest.raises(Exception, match="not an object in b.json"):
        records.read_raw(spark, str(tmp_path / "b.json"), by_line=True).collect()
