"""Best-fit packing of tokenised documents into sequences by minimum bin slack."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import positioned, released, small_batches, table, written

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SEQUENCE = 4096
END = 1
#: Words whose ids a Python worker remembers; beyond that it starts anew.
REMEMBERED = 700_000
#: Letters that stay one letter each when the tokenizer normalises them: Latin, Greek and Cyrillic ones, but for the dotted capital I.
PLAIN = re.compile("[A-Za-z\u00c0-\u012f\u0131-\u024f\u0370-\u04ff]+")
#: Bytes of ASCII letters, and of marks at which a word is cut after one: not those of "'s", which stays whole, or of special strings.
_LETTER = np.isin(np.arange(256), np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8))
_MARK = np.isin(np.arange(256), np.frombuffer(b'!"#$%&()*+,-./:;=?@[]^_{}~', np.uint8))
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
#: Long texts are tokenised in pieces of about so many code points, cut at white space.
PIECE = 1 << 20
#: Bytes of shorter texts whose words are looked up at once.
CUT = 1 << 21
#: Words that are encoded at once: the tokenizer holds much for each letter of them.
TOGETHER = 2_000


class _Words:
    """Ids of whole texts, word by word.

    The tokenizer drops white space and neither its normaliser nor its words nor its special strings reach across
    it, so a text's ids are those of its parts between spaces, one after the other. Nor do its words reach from an ASCII letter to
    a mark. It takes letters in lower case. A special string in a text is the special token, as in the library's own call.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        self.remembered = remembered
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[n for t, n in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        out, at = [], 0
        while at < len(text):
            cut = text.find(" ", at + PIECE) if len(text) - at > PIECE else -1
            out.append(self._ids(text[at:] if cut < 0 else text[at:cut]))
            at = len(text) if cut < 0 else cut
        return b"".join(out)

    def each(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text of a column; null texts are empty. A word is looked up once for some texts, which are then put together from numbers."""
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        if not len(texts):
            return
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        whole = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        a = 0
        while a < len(texts):
            b = int(np.searchsorted(ends, ends[a] + CUT, "right")) - 1
            if b > a:
                out, stop = self._put(whole[ends[a] : ends[b]], ends[a : b + 1] - ends[a])
                for i in range(b - a):
                    yield out[stop[i] : stop[i + 1]].tobytes()
            else:
                yield self.ids(texts[a].as_py().decode())
            a = max(b, a + 1)

    def _ids(self, text: str) -> bytes:
        data = np.frombuffer(text.encode(), np.uint8)
        return self._put(data, np.array([0, len(data)]))[0].tobytes()

    def _put(self, data: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """The ids of texts that stand one after the other from the places `own` on, and the places of each text's ids."""
        if not (data[:-1][data[1:] == 0x7C] == 0x3C).any():
            # Without `<|` there is no special string, which is one as it is written alone. A letter before what may be an accent stays: some have one only in lower case.
            data = np.where(np.append(data[1:] < 0x80, True), _LOWER[data], data)
        held = (data != 0x20) & (data != 0x0A)
        first = held.copy()
        first[1:] &= ~held[:-1] | _LETTER[data[:-1]] & _MARK[data[1:]]
        begins = own[:-1][own[:-1] < len(data)]
        first[begins] = held[begins]
        n_words = np.searchsorted(np.flatnonzero(first), own)
        at = np.append(np.flatnonzero(first[held]), np.count_nonzero(held)).astype(np.int64)
        coded = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data[held])]).dictionary_encode()
        ids = self._of(coded.dictionary.cast(pa.large_string()).to_pylist())
        flat, size = np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        word = coded.indices.to_numpy()
        n = size[word]
        stop = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        step = ((np.cumsum(size, dtype=np.int64) - size)[word] - stop[:-1]).astype(np.int32)
        return flat[np.repeat(step, n) + np.arange(stop[-1], dtype=np.int32)], stop[n_words].tolist()

    def _of(self, words: list[str]) -> list[bytes]:
        """The ids of different words."""
        new = [w for w in words if w not in self.known]
        if new:
            if len(self.known) + len(new) > self.remembered:
                self.known = {}
                new = words
            self._learn(new)
        out = list(map(self.known.__getitem__, words))
        if len(new) > self.remembered // 4:
            self.known = {}
        return out

    def _learn(self, words: list[str]) -> None:
        """A word of plain letters is one word to the tokenizer, and ends with a token that ends words.

        So some of them can be encoded at once and told apart again; all others are encoded one by one.
        """
        plain, rest = [], []
        for w in words:
            (plain if w.isalpha() and PLAIN.fullmatch(w) else rest).append(w)
        for k in range(0, len(plain), TOGETHER):
            listed = plain[k : k + TOGETHER]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(listed)], add_special_tokens=False)[0].ids, "<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stops) == len(listed):
                data = ids.tobytes()
                self.known.update(zip(listed, [data[x:y] for x, y in zip([0, *stops], stops)]))
            else:
                rest += listed
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            self.known[w] = np.array(e.ids, "<u4").tobytes()


@lru_cache(1)
def _words(path: str, remembered: int) -> _Words:
    return _Words(path, remembered)


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = TOKENIZER, length: int = SEQUENCE, keep_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document: its ids, then END, cut only beyond `length`.

    A null text is empty and has one piece of one id. Repeated rows give repeated pieces; no rows, no pieces. A very long
    text is tokenised in parts of about PIECE code points. Columns other than the two named are not read.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * keep_ids]
    end = END.to_bytes(4, "little")

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rows = _words(path, remembered), []

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * len(types), types)], names)

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), words.each(batch.column(1))):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), *[part] * keep_ids))
            yield out()
            rows.clear()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(released(tokenise), schema)


def fullest(counts: dict[int, int], order: list[int], slack: int) -> dict[int, int]:
    """The available lengths, with their numbers, whose sum comes nearest to slack from below.

    Subset sums are bits of one integer; lengths come in by descending size and by powers of two of their
    number, until slack itself is reached.
    """
    reach, mask, steps = 1, (1 << slack + 1) - 1, []
    for n in order:
        if n > slack:
            continue
        left, k = min(counts[n], slack // n), 1
        while left > 0:
            k = min(k, left)
            steps.append((n, k, reach))
            reach |= reach << n * k & mask
            left -= k
            k *= 2
        if reach >> slack & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for n, k, before in reversed(steps):
        if not before >> at & 1:
            at -= n * k
            used[n] = used.get(n, 0) + k
    return used


def plan(histogram: dict[int, int], size: int = SEQUENCE) -> np.ndarray:
    """Runs (start, length, each, sequence, offset) for pieces in order of their length, from the histogram alone.

    Minimum bin slack: a bin begins with the longest piece that is left, the fullest combination that fits is
    added, and the same combination is taken as often as the pieces allow. So the work depends on the number
    of different lengths (at most `size`), not on the number of pieces. The run's i-th piece goes to
    sequence + i // each at offset + i % each * length.
    """
    left = {n: c for n, c in histogram.items() if c}
    order = sorted(left, reverse=True)
    at, total = {}, 0
    for n in sorted(left):
        at[n], total = total, total + left[n]
    runs, sequence = [], 0
    while order:
        first = order[0]
        left[first] -= 1
        used = fullest(left, [n for n in order if left[n]], size - first)
        left[first] += 1
        used[first] = used.get(first, 0) + 1
        times, offset = min(left[n] // k for n, k in used.items()), 0
        for n in sorted(used, reverse=True):
            k = used[n]
            runs.append((at[n], n, k, sequence, offset))
            at[n] += k * times
            left[n] -= k * times
            offset += n * k
        sequence += times
        order = [n for n in order if left[n]]
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def pack(parts: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """parts (doc_id, piece, length and what else they have, each length at most size) with sequence_id and offset.

    The driver sees the histogram of lengths only (at most `size` rows) and broadcasts the plan's runs, which it
    bounds; the places within each length come from a range-partitioned sort.
    """
    histogram = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}
    if any(not 0 < n <= size for n in histogram):
        raise ValueError(f"pieces must have 1 to {size} tokens")
    runs = parts.sparkSession.sparkContext.broadcast(plan(histogram, size))

    @F.arrow_udf("sequence_id long, offset long")
    def place(pos: pa.Array) -> pa.Array:
        p = pos.to_numpy(zero_copy_only=False)
        start, length, each, sequence, offset = runs.value[np.searchsorted(runs.value[:, 0], p, "right") - 1].T
        return pa.StructArray.from_arrays([pa.array(sequence + (p - start) // each), pa.array(offset + (p - start) % each * length)], ["sequence_id", "offset"])

    placed = positioned(parts, [F.col("length"), F.col("doc_id"), F.col("piece")], "_pos")
    return placed.withColumn("_to", place("_pos")).withColumns({"sequence_id": F.col("_to.sequence_id"), "offset": F.col("_to.offset")}).drop("_pos", "_to")


def packed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """Every piece of every document with its place; an empty table of documents gives an empty result.

    Null and very long texts, repeated rows and other columns are as in `pieces`; pieces of equal length stand in the order of
    doc_id and piece. remembered bounds the words whose ids a worker keeps: it decides time and memory alone.
    """
    with small_batches(docs.sparkSession):
        made = written(pieces(docs, doc_id, text, keep_ids=keep_ids, remembered=remembered), "pieces")
    return pack(made)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed token ids, from pieces that kept theirs; a sequence has at most SEQUENCE of them."""
    held = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return held.select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return packed(table(spark, sf_dir, "documents"))
