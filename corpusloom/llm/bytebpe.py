"""Byte-level BPE encoding and decoding with recursive DuckDB queries in each partition.

A text's words are encoded apart, so each worker keeps the ids of the words it has met and asks DuckDB for
the new ones: rows of word, position and token join the merge table, and in each recursion every word's
leftmost pair of minimum rank is contracted, until no word has such a pair. The recursion is keyed by word and
position, so it holds one row per byte however many steps a word takes. In a long word a step contracts all places of
that pair from the left, as far as single steps would do so too. Decoding joins each document's ids
with the vocabulary and puts their bytes together by an ordered aggregation.

Before that, words are cut at seams: places that no token of the vocabulary can lie across, so that no
contraction ever does. This keeps words short; a run without a seam takes some steps for each different token that it is contracted to.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Words that a worker remembers; beyond that it starts anew.
REMEMBERED = 1_000_000
#: Bytes of words given to one recursive query, unless one word alone has more.
BYTES_AT_ONCE = 1 << 18
#: Code points of text that are split into words, and encoded and decoded, at once.
PIECE = 1 << 20

#: tok of a row is its token, -1 once it has been joined to the one before; x has the rank of the best pair and its place.
ENCODE = """
WITH RECURSIVE t(w, pos, tok) USING KEY (w, pos) AS (
  SELECT w, pos, tok FROM start
  UNION ALL
  (WITH n AS (SELECT w, pos, tok, CASE WHEN lead(w) OVER p = w THEN lead(tok) OVER p END AS following, CASE WHEN lag(w) OVER p = w THEN lag(pos) OVER p END AS before FROM t WHERE tok >= 0 WINDOW p AS (ORDER BY w, pos)),
  best AS (SELECT n.w, min(m.merged * 4294967296 + n.pos) AS x FROM n JOIN merges m ON n.tok * 65536::BIGINT + n.following = m.pair GROUP BY n.w)
  SELECT n.w, n.pos, CASE WHEN n.pos = x % 4294967296 THEN (x // 4294967296)::INT WHEN n.before = x % 4294967296 THEN -1 ELSE n.tok END
  FROM n JOIN best USING (w))
)
SELECT w, string_agg(tok, ',' ORDER BY pos) AS ids FROM t WHERE tok >= 0 GROUP BY w ORDER BY w
"""
#: Words of more bytes are encoded by ENCODE_LONG.
LONG = 64
#: As ENCODE, for words in which a pair of minimum rank may stand often: its places, of overlapping ones every other from the left, are
#: contracted at once, up to the first that makes a pair of lower rank with what then stands before or after it (`first`), as single
#: steps would turn to that pair next.
ENCODE_LONG = """
WITH RECURSIVE t(w, pos, tok) USING KEY (w, pos) AS (
  SELECT w, pos, tok FROM start
  UNION ALL
  (WITH n AS (SELECT w, pos, tok, row_number() OVER p AS k, CASE WHEN lead(w) OVER p = w THEN lead(tok) OVER p END AS following, CASE WHEN lag(w) OVER p = w THEN lag(tok) OVER p END AS l, CASE WHEN lead(w, 2) OVER p = w THEN lead(tok, 2) OVER p END AS r FROM t WHERE tok >= 0 WINDOW p AS (ORDER BY w, pos)),
  c AS (SELECT n.w, n.k, l, r, m.merged FROM n JOIN merges m ON n.tok * 65536::BIGINT + n.following = m.pair),
  best AS (SELECT w, min(merged) AS merged FROM c GROUP BY w),
  nth AS (SELECT *, k - row_number() OVER (PARTITION BY w ORDER BY k) AS run FROM c JOIN best USING (w, merged)),
  place AS (SELECT *, row_number() OVER (PARTITION BY w, run ORDER BY k) AS i FROM nth),
  apart AS (SELECT w, k, merged, CASE WHEN i > 1 THEN merged ELSE l END AS l, r FROM place WHERE i % 2 = 1),
  new AS (SELECT w, k, merged, l * 65536::BIGINT + merged AS pair FROM apart UNION ALL SELECT w, k, merged, merged * 65536::BIGINT + r FROM apart),
  first AS (SELECT new.w, min(new.k) AS last FROM new JOIN merges m ON m.pair = new.pair AND m.merged < new.merged GROUP BY new.w),
  picked AS (SELECT k, merged FROM apart LEFT JOIN first USING (w) WHERE last IS NULL OR k <= last)
  SELECT n.w, n.pos, CASE WHEN a.k IS NOT NULL THEN a.merged::INT WHEN b.k IS NOT NULL THEN -1 ELSE n.tok END
  FROM n JOIN best USING (w) LEFT JOIN picked a ON a.k = n.k LEFT JOIN picked b ON b.k + 1 = n.k)
)
SELECT w, string_agg(tok, ',' ORDER BY pos) AS ids FROM t WHERE tok >= 0 GROUP BY w ORDER BY w
"""
DECODE = """
SELECT d, unhex(array_to_string(list(v.hex ORDER BY pos), '')) AS bytes FROM encoded JOIN vocabulary v USING (id) GROUP BY d ORDER BY d
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Words to comma-joined ids, and ids to bytes, in one process."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN) -> None:
        self.ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.cut = regex.compile(r"(?<=\S) (?=\S)")
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.ids: dict[str, str] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        pairs = [(self.ranks[t[:i]] << 16 | self.ranks[t[i:]], n) for t, n in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        self._table("merges", dict(zip(("pair", "merged"), np.array(pairs, np.int64).reshape(-1, 2).T)))
        self._table("vocabulary", {"id": np.array(list(self.ranks.values()), np.int32), "hex": [t.hex() for t in self.ranks]})
        #: Which two bytes are a token, and which three stand in one.
        self.two, self.three = np.zeros(1 << 16, bool), np.zeros(1 << 24, bool)
        self.two[[t[0] << 8 | t[1] for t in self.ranks if len(t) == 2]] = True
        self.three[[t[i] << 16 | t[i + 1] << 8 | t[i + 2] for t in self.ranks for i in range(len(t) - 2)]] = True

    def _table(self, name: str, columns: dict) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def parts(self, data: list[bytes]) -> tuple[list[bytes], list[int]]:
        """The words cut at their seams, one after the other, and where each word's parts begin and the last one's end.

        A token across a place is two bytes long, or holds the three bytes that end after or begin before it.
        """
        blob = b"".join(data)
        x = np.frombuffer(b"\0\0" + blob + b"\0", np.uint8).astype(np.int32)
        first = np.cumsum([0, *map(len, data)])
        inside = np.ones(len(blob) + 1, bool)
        inside[first] = False
        p2, p1, c, n = x[:-3], x[1:-2], x[2:-1], x[3:]
        left = np.r_[False, inside[:-2]] & inside[:-1]
        right = inside[:-1] & inside[1:]
        across = self.two[p1 << 8 | c] | left & self.three[p2 << 16 | p1 << 8 | c] | right & self.three[p1 << 16 | c << 8 | n]
        starts = np.flatnonzero(~(inside[:-1] & across))
        at = starts.tolist()
        return [blob[s:e] for s, e in zip(at, [*at[1:], len(blob)])], np.searchsorted(starts, first).tolist()

    def encode_words(self, words: list[str]) -> list[str]:
        """Comma-joined ids of each word."""
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        out = [None if (n := self.ranks.get(b)) is None else str(n) for b in data]
        rest = [i for i, x in enumerate(out) if x is None]
        parts, first = self.parts([data[i] for i in rest])
        known = self._encoded({p for p in parts if p not in self.ranks})
        ids = [known[p] if (n := self.ranks.get(p)) is None else str(n) for p in parts]
        for i, s, e in zip(rest, first, first[1:]):
            out[i] = ids[s] if e == s + 1 else ",".join(ids[s:e])
        return out

    def _encoded(self, parts: set[bytes]) -> dict[bytes, str]:
        """The parts' ids by the recursive query, those of like length together."""
        out, part, size = {}, [], 0
        for p in [*sorted(parts, key=lambda p: (len(p), p)), None]:
            if part and (p is None or size + len(p) > BYTES_AT_ONCE or len(part[-1]) <= LONG < len(p)):
                n, flat = np.array([len(x) for x in part]), np.frombuffer(b"".join(part), np.uint8)
                begin = np.repeat(np.cumsum(n) - n, n)
                self._table("start", {"w": np.repeat(np.arange(len(part), dtype=np.int32), n), "pos": (np.arange(len(flat)) - begin).astype(np.int32), "tok": self.byte[flat]})
                out.update(zip(part, self.db.sql(ENCODE if n[-1] <= LONG else ENCODE_LONG).to_arrow_table()["ids"].to_pylist()))
                part, size = [], 0
            if p is not None:
                part.append(p)
                size += len(p)
        return out

    def decode(self, ids: list[str]) -> list[bytes]:
        """The bytes of each comma-joined list of ids; of an empty one none. An id that is not in the vocabulary is an error."""
        n = np.array([x.count(",") + 1 if x else 0 for x in ids], np.int64)
        flat = np.fromstring(",".join(x for x in ids if x), np.int32, sep=",") if n.any() else np.zeros(0, np.int32)
        if len(flat) != n.sum() or (len(flat) and not 0 <= flat.min() <= flat.max() < len(self.ranks)):
            raise ValueError("ids must be those of the vocabulary")
        self.db.register("encoded", pa.table({"d": np.repeat(np.arange(len(ids), dtype=np.int32), n), "pos": np.arange(len(flat), dtype=np.int32), "id": flat}))
        got = self.db.sql(DECODE).to_arrow_table()
        self.db.unregister("encoded")
        out = [b""] * len(ids)
        for d, data in zip(got["d"].to_pylist(), got["bytes"].to_pylist()):
            out[d] = data
        return out

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The words, some at a time; a single space between two other characters always begins a word."""
        at = 0
        while at < len(text):
            cut = self.cut.search(text, at + PIECE) if len(text) - at > PIECE else None
            yield self.pattern.findall(text, at, cut.start() if cut else len(text))
            at = cut.start() if cut else len(text)

    def joined(self, lists: list[list[str]]) -> list[str]:
        """The comma-joined ids of each list of words."""
        words = set().union(*lists)
        new = words.difference(self.ids)
        if len(self.ids) + len(new) > REMEMBERED:
            self.ids.clear()
            new = words
        if new:
            given = list(new)
            self.ids.update(zip(given, self.encode_words(given)))
        return [",".join(map(self.ids.__getitem__, x)) for x in lists]


@lru_cache(1)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _units(own: Codec, batch: pa.RecordBatch) -> Iterator[list[tuple[int, list[str]]]]:
    """(row, words) of the batch's texts, PIECE code points or little more at once; a longer text comes in several."""
    waiting, size = [], 0
    for i, value in enumerate(batch.column(1)):
        text = value.as_py() or ""
        for words in own.pieces(text) if text else [[]]:
            waiting.append((i, words))
            size += sum(map(len, words))
            if size >= PIECE:
                yield waiting
                waiting, size = [], 0
    yield waiting


def _digested(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            n = [0] * batch.num_rows
            ids_of, data_of = ([hashlib.sha256() for _ in n] for _ in range(2))
            for units in _units(own, batch):
                ids = own.joined([words for _, words in units])
                for (i, _), part, data in zip(units, ids, own.decode(ids)):
                    if part:
                        ids_of[i].update(("," * (n[i] > 0) + part).encode())
                        n[i] += part.count(",") + 1
                        data_of[i].update(data)
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), *(pa.array([h.hexdigest() for h in x], pa.string()) for x in (ids_of, data_of))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row: its ids' and their decoded bytes' digests.

    A null or empty text has no ids, and the digests are those of nothing. A very long text is taken in pieces of PIECE
    code points. Rows that repeat come out as often; no rows, no rows. Columns other than the two named are not read.
    """
    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(_digested(path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, ids array<int>) for every row; a null or empty text has no ids. Repeats, no rows and other columns as in `digests`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for doc, value in zip(batch.column(0), batch.column(1)):
                parts = [x for words in own.pieces(value.as_py() or "") for x in own.joined([words])]
                ids = np.fromstring(",".join(parts), np.int32, sep=",") if parts else np.zeros(0, np.int32)
                yield pa.record_batch([pa.array([doc.as_py()], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids))], ["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, data binary) for every row of ids; null or no ids give no bytes. Repeats, no rows and other columns as in `digests`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for doc, value in zip(batch.column(0), batch.column(1)):
                held = value.as_py() or []
                data = b"".join(own.decode([",".join(map(str, held[at : at + PIECE])) for at in range(0, len(held), PIECE)]))
                yield pa.record_batch([pa.array([doc.as_py()], pa.int64()), pa.array([data], pa.binary())], ["doc_id", "data"])

    return encoded.select(F.col(doc_id).cast("long"), F.col(ids)).mapInArrow(run, "doc_id long, data binary")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, digested, and the digest of what they decode to."""
    return digests(table(spark, sf_dir, "documents"))
