"""Token counts by a separator scan of flat token files.

A flat file holds the little-endian ids of many documents with an end-of-document id after each and no
index. Byte ranges of the files are searched for that id in parallel; what each range found before
its first and after its last separator is stitched to its neighbours by a prefix scan over the ranges.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.llm.bytebpe import PATTERN, read_ranks
from corpusloom.llm.common import partitions, shared_dir, table, written
from corpusloom.llm.files import new_file, opened

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: The end-of-document id; the vocabulary leaves it free.
END = 50256
WIDTH = 2
#: Bytes of a file that one range covers.
RANGE = 1 << 24
#: Bytes that are read and searched at once within a range.
BLOCK = 1 << 20


@lru_cache(1)
def _encoding(path: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})


#: Runs of so many blanks are more than the library's own search for words can take; texts with one are cut into words here.
BLANKS = re.compile(r"\s{5000}")
_WORDS = regex.compile(PATTERN)


def token_ids(encoding, text: str) -> list[int]:
    """The ids of the whole text, as the library has them; with a long run of blanks word by word, which is the same."""
    if not BLANKS.search(text):
        return encoding.encode_ordinary(text)
    return [i for m in _WORDS.finditer(text) for i in encoding._encode_single_piece(m.group().encode("utf-8", "surrogatepass"))]


def write_token_files(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", path: str = VOCABULARY, width: int = WIDTH) -> DataFrame:
    """Writes a flat token file per task; (path, n_bytes, ordinal, doc_id) of every document, in the order of its file.

    The table says which files count and whose turn it is in them, but neither where nor how long a document is.
    A null text is empty: its document is just the separator. Texts of any length count as a whole, whatever they are made of; a text's ids are
    in memory once. Rows that repeat, or share or lack an id, are documents of their own; columns other than the two named are not read; no rows, no files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, kind = _encoding(path), np.dtype(f"<u{width}")
        out, uri, done = None, "", []
        for batch in batches:
            if out is None and batch.num_rows:
                system, name, uri = new_file(folder, ".bin")
                out = system.open_output_stream(name)
            for doc, value in zip(batch.column(0), batch.column(1)):
                out.write(np.array([*token_ids(encoding, value.as_py() or ""), END], kind).tobytes())
                done.append(doc.as_py())
        if out is not None:
            out.close()
            for at in range(0, len(done), 10_000):
                part = done[at : at + 10_000]
                yield pa.record_batch([pa.array([uri] * len(part)), pa.array(range(at, at + len(part)), pa.int64()), pa.array(part, pa.int64())], ["path", "ordinal", "doc_id"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, "path string, ordinal long, doc_id long")


def byte_ranges(spark: SparkSession, folder: str, size: int = RANGE) -> DataFrame:
    """(path, start, stop) for every byte range of every file in the folder; only names and lengths are read."""
    files = spark.read.format("binaryFile").load(folder).select("path", F.col("length").cast("long").alias("n"))
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(size).cast("long")))
    return files.where("n > 0").select("path", "n", starts.alias("start")).select("path", "start", F.least(F.col("start") + size, F.col("n")).alias("stop"))


def _separators(width: int, end: int):
    kind = np.dtype(f"<u{width}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, stop in zip(*(batch[c].to_pylist() for c in ("path", "start", "stop"))):
                system, name = opened(path)
                with system.open_input_file(name) as file:
                    file.seek(start)
                    last, seen = None, 0
                    for at in range(start, stop, BLOCK):
                        ids = np.frombuffer(file.read(min(BLOCK, stop - at)), kind)
                        found = at // width + np.flatnonzero(ids == end)
                        if not len(found):
                            continue
                        before = np.r_[-1 if last is None else last, found[:-1]]
                        rank = np.arange(seen, seen + len(found))
                        yield pa.record_batch([pa.array([path] * len(found)), pa.array([start] * len(found), pa.int64()), pa.array(found), pa.array(before), pa.array(rank)], ["path", "range", "at", "before", "rank"])
                        last, seen = int(found[-1]), seen + len(found)

    return run


def scan(ranges: DataFrame, width: int = WIDTH, end: int = END) -> DataFrame:
    """(path, ordinal, start, n_tokens) of every document of the files, from byte ranges (path, start, stop).

    Each range gives its separators; a prefix scan over the ranges' counts and last separators (one row per
    range) numbers the documents and finds where a document that crosses ranges began. Ids after the last
    separator of a file end no document and are left out; ranges must begin at multiples of width.
    """
    spark = ranges.sparkSession
    spread = ranges.repartition(partitions(spark), "path", "start")
    found = written(spread.mapInArrow(_separators(width, end), "path string, range long, at long, before long, rank long"), "separators")
    held = found.groupBy("path", "range").agg(F.count("*").alias("n"), F.max("at").alias("last"))
    order = Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carry = held.select("path", "range", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("earlier"), F.coalesce(F.max("last").over(order), F.lit(-1)).alias("left"))
    rows = found.join(carry, ["path", "range"])
    begin = F.when(F.col("rank") == 0, F.col("left")).otherwise(F.col("before")) + 1
    return rows.select("path", (F.col("earlier") + F.col("rank")).alias("ordinal"), begin.alias("start"), (F.col("at") - begin).alias("n_tokens"))


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, file, ordinal, start) for every row, counted in flat files written for it.

    Null and empty texts have 0 tokens; repeated rows are counted each; no documents, no rows.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark, "tokens")
    manifest = written(write_token_files(docs, folder, doc_id, text, path), "manifest")
    name = F.regexp_extract("path", "([^/]*)$", 1)
    if manifest.isEmpty():
        return manifest.select("doc_id", F.col("ordinal").alias("n_tokens"), F.col("path").alias("file"), "ordinal", F.col("ordinal").alias("start"))
    files = manifest.select("path").distinct()
    ranges = byte_ranges(spark, folder).withColumn("file", name)
    ranges = ranges.join(files.select(name.alias("file")), "file", "left_semi").select("path", "start", "stop")
    counted = scan(ranges).select(name.alias("file"), "ordinal", "start", "n_tokens")
    return manifest.select(name.alias("file"), "ordinal", "doc_id").join(counted, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal", "start")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of tokens of every document, from a scan of flat token files."""
    return token_counts(table(spark, sf_dir, "documents"))
