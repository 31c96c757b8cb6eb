"""Chunking: fixed windows, packed sentences, and structure-aware chunks."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.presets import LATIN, Preset
from corpusloom.sources.shared import saved

SCHEMA = "doc_id long, chunk_index int, text string, start_char int, end_char int, section_path array<string>"


def _schema(docs: DataFrame) -> str:
    """SCHEMA with the documents' own kind of id."""
    return SCHEMA.replace("long", docs.schema["doc_id"].dataType.simpleString(), 1)


def fixed_windows(docs: DataFrame, size: int = 500, overlap: int = 100, text: str = "normalized_text") -> DataFrame:
    """(doc_id, chunk_index, text, start_char, end_char) of windows that advance by size - overlap; the last one ends the text."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    n = F.char_length(text)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    rows = docs.select("doc_id", text, F.posexplode(starts).alias("chunk_index", "start_char"))
    piece = F.btrim(F.substring(F.col(text), F.col("start_char") + 1, F.lit(size)))
    return rows.select("doc_id", "chunk_index", piece.alias("text"), "start_char").withColumn("end_char", F.col("start_char") + F.char_length("text"))


def _sentences(text: str, pattern: re.Pattern) -> list[tuple[int, int]]:
    return [(m.start(), m.end()) for m in pattern.finditer(text) if m.group().strip()]


def pack_sentences(text: str, size: int, overlap: int, pattern: re.Pattern) -> list[tuple[int, int]]:
    """Spans of greedily packed sentences.

    The next span begins at the first sentence that starts within `overlap` of the last one's end, but always
    after the last one's first sentence, so that it ends on every text. A sentence longer than size is cut
    into windows.
    """
    spans, out, i = _sentences(text, pattern), [], 0
    if not spans:
        return [(s, min(s + size, len(text))) for s in range(0, max(len(text) - overlap, 1), size - overlap)] if text.strip() else []
    while i < len(spans):
        start, end = spans[i]
        if end - start > size:
            out += [(s, min(s + size, end)) for s in range(start, max(end - overlap, start + 1), size - overlap)]
            i += 1
            continue
        j = i + 1
        while j < len(spans) and spans[j][1] - start <= size:
            end, j = spans[j][1], j + 1
        out.append((start, end))
        if j >= len(spans):
            break
        back = next((k for k in range(i, j) if spans[k][0] >= end - overlap), j)
        i = max(back, i + 1)
    return out


def sentence_chunks(docs: DataFrame, size: int = 500, overlap: int = 100, text: str = "normalized_text", delimiters: str = LATIN.delimiters) -> DataFrame:
    """Chunks of whole sentences, in SCHEMA; a document is a row of its own task's batch, so memory is bounded by it."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    cls = re.escape(delimiters)
    pattern = re.compile(f"[^{cls}]+[{cls}]?")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, t in zip(frame.iloc[:, 0], frame.iloc[:, 1]):
                spans = pack_sentences(t or "", size, overlap, pattern)
                rows += [(doc, k, t[a:b].strip(), a, b, []) for k, (a, b) in enumerate(spans)]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "text", "start_char", "end_char", "section_path"])

    return docs.select("doc_id", text).mapInPandas(run, _schema(docs))


def _level(label: str, levels: tuple[str, ...]) -> int:
    return next((k for k, mark in enumerate(levels, 1) if mark in label), len(levels) + 1)


def segments(text: str, heading: re.Pattern, levels: tuple[str, ...]) -> list[tuple[str, int, int, int, list[str]]]:
    """(label, level, start, end, path) between headings; the path is the stack of labels that enclose it."""
    found, out, stack = list(heading.finditer(text)), [], []
    if not found or found[0].start() > 0:
        out.append(("", 0, 0, found[0].start() if found else len(text), []))
    for k, m in enumerate(found):
        label = m.group().strip()
        level = _level(m.group(), levels)
        stack = [x for x in stack if x[0] < level] + [(level, label)]
        out.append((label, level, m.start(), found[k + 1].start() if k + 1 < len(found) else len(text), [x for _, x in stack]))
    return [s for s in out if text[s[2] : s[3]].strip()]


def sections(docs: DataFrame, preset: Preset = LATIN, text: str = "text") -> DataFrame:
    """(doc_id, section, label, level, start_char, end_char, path, text): what `segments` finds, a row each, without Python.

    A section begins with its heading. An enclosing label of level L is the last of level L or less so far, where that is of level L
    itself. What stands before the first heading has level 0 and no path; blank sections are left out, null texts have none.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    heads = F.concat(F.array(F.lit("")), F.regexp_extract_all(t, F.lit(preset.heading), F.lit(0)))
    rows = docs.select("doc_id", F.posexplode(F.arrays_zip(heads.alias("head"), F.split(t, preset.heading, -1).alias("rest"))).alias("section", "s"))
    order = Window.partitionBy("doc_id").orderBy("section")
    level = F.coalesce(F.when(F.col("section") == 0, 0), *[F.when(F.contains("s.head", F.lit(mark)), k) for k, mark in enumerate(preset.levels, 1)], F.lit(len(preset.levels) + 1))
    rows = rows.select("doc_id", "section", T.strip(F.col("s.head")).alias("label"), level.alias("level"), F.concat("s.head", "s.rest").alias("text"))
    end = F.sum(F.char_length("text")).over(order)
    last = lambda n: F.last(F.when(F.col("level").between(1, n), F.struct("level", "label")), ignorenulls=True).over(order)
    levels = range(1, len(preset.levels) + 2)
    rows = rows.withColumns({"start_char": (end - F.char_length("text")).cast("int"), "end_char": end.cast("int"), **{f"_{n}": last(n) for n in levels}})
    path = F.array_compact(F.array(*[F.when(F.col(f"_{n}.level") == n, F.col(f"_{n}.label")) for n in levels]))
    return rows.where(T.strip(F.col("text")) != "").select("doc_id", "section", "label", "level", "start_char", "end_char", path.alias("path"), "text")


def _grouped(units: list[str], most: int) -> list[str]:
    """Units that follow one another, together up to `most`."""
    out: list[str] = []
    for unit in units:
        if out and len(out[-1]) + len(unit) <= most:
            out[-1] += unit
        else:
            out.append(unit)
    return out


def split_long(text: str, most: int, sentence: re.Pattern, secondary: re.Pattern) -> list[str]:
    """Parts of a text longer than `most`: whole sentences if there are several, else parts at secondary boundaries, else cuts."""
    sentences = [m.group() for m in sentence.finditer(text) if m.group().strip()]
    parts = _grouped(sentences, most) if len(sentences) > 1 else []
    if len(parts) < 2:
        parts = _grouped([x for x in secondary.split(text) if x.strip()], most)
    return parts if len(parts) > 1 else [text[at : at + most] for at in range(0, len(text), most)]


def structure(text: str, most: int, least: int, heading: re.Pattern, levels: tuple[str, ...], sentence: re.Pattern, secondary: re.Pattern | None = None, overlap: int = 0) -> list[tuple[str, int, int, list[str]]]:
    """(text, start, end, path): segments gathered up to `most`, parted at new sections, cut if too long, short ones merged back.

    What is cut is cut at sentences, else at secondary boundaries, else anywhere. Each later part of a cut begins with
    the last `overlap` sentences of the part before it, which its start does not count.
    """
    secondary = secondary or sentence
    groups: list[list] = []
    for s in segments(text, heading, levels):
        last = groups[-1] if groups else None
        full = last and s[3] - last[0][2] > most
        parted = last and s[1] and s[1] <= 3 and s[4] != last[-1][4] and any(x[1] >= 3 for x in last)
        if last and not full and not parted:
            last.append(s)
        else:
            groups.append([s])
    pieces = []
    for g in groups:
        start, end, path = g[0][2], g[-1][3], g[-1][4]
        own = text[start:end].strip()
        if len(own) <= most:
            pieces.append([own, start, end, path])
            continue
        at, prefix = text.index(own, start), ""
        for part in split_long(own, most, sentence, secondary):
            bare = part.strip()
            if not bare:
                continue
            begin = text.find(bare, at)
            begin = at if begin < 0 else begin
            at = begin + len(bare)
            pieces.append([f"{prefix}{bare}", begin, at, path])
            said = [m.group().strip() for m in sentence.finditer(bare) if m.group().strip()]
            prefix = "".join(said[-overlap:]) if overlap else ""
    out: list[list] = []
    for p in pieces:
        if out and len(p[0]) < least:
            out[-1] = [f"{out[-1][0]}\n{p[0]}".strip(), out[-1][1], p[2], out[-1][3] + [x for x in p[3] if x not in out[-1][3]]]
        else:
            out.append(p)
    return [tuple(p) for p in out if p[0]]


#: Chunks of texts with so many characters in all leave a task at once.
PART_CHARS = 1 << 20


def in_parts(texts: Iterable[tuple]) -> Iterator[list[tuple]]:
    """(id, text) in lists of some texts each, so that a task holds the chunks of few of its batch's texts; a null text is empty."""
    part, size = [], 0
    for doc, t in texts:
        part.append((doc, t or ""))
        size += len(t or "")
        if size >= PART_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def structure_chunks(docs: DataFrame, most: int = 500, least: int = 50, text: str = "text", preset: Preset = LATIN, overlap: int = 0) -> DataFrame:
    """Structure-aware chunks in SCHEMA; `overlap` sentences of a cut part begin the next."""
    heading, cls = re.compile(preset.heading), re.escape(preset.delimiters)
    sentence, levels, secondary = re.compile(f"[^{cls}]+[{cls}]?"), preset.levels, re.compile(preset.secondary)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for texts in in_parts(zip(frame.iloc[:, 0], frame.iloc[:, 1])):
                rows = [(doc, k, *c) for doc, t in texts for k, c in enumerate(structure(t, most, least, heading, levels, sentence, secondary, overlap))]
                yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "text", "start_char", "end_char", "section_path"])

    return docs.select("doc_id", text).mapInPandas(run, _schema(docs))


def merge_short(chunks: DataFrame, least: int) -> DataFrame:
    """(doc_id, chunk_index, n_merged, start_char, end_char): chunks shorter than `least` join the one before them, and numbers are given anew."""
    return merge_short_chunks(chunks, least).select("doc_id", "chunk_index", "n_merged", "start_char", "end_char")


def merge_short_chunks(chunks: DataFrame, least: int) -> DataFrame:
    """chunks with those shorter than `least` joined to the one before them, numbered anew, and n_merged.

    Texts follow one another; section_path has the labels of all paths but empty ones, each where it first came; structure_labels all
    labels once, sorted. Either may be missing. Other columns are those of the first chunk.
    """
    order = Window.partitionBy("doc_id").orderBy("chunk_index")
    opens = (F.char_length("text") >= least) | (F.row_number().over(order) == 1)
    islands = chunks.withColumn("_opens", opens.cast("int")).withColumn("_island", F.sum("_opens").over(order))
    lists = [c for c in ("section_path", "structure_labels") if c in chunks.columns]
    own = [c for c in chunks.columns if c not in ("doc_id", "chunk_index", "text", "start_char", "end_char", *lists)]
    # One ordered list of a piece's chunks; a piece has one long chunk and the short ones after it.
    parts = F.sort_array(F.collect_list(F.struct("chunk_index", "text", "end_char", *lists)))
    merged = islands.groupBy("doc_id", "_island").agg(F.count("*").alias("n_merged"), F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char"), parts.alias("_p"), *[F.min_by(c, "chunk_index").alias(c) for c in own])
    labels = lambda c: F.array_distinct(F.filter(F.flatten(F.transform(F.col(f"_p.{c}"), lambda x: F.coalesce(x, F.array().cast("array<string>")))), lambda x: x.isNotNull() & (x != "")))
    made = {"section_path": lambda: labels("section_path"), "structure_labels": lambda: F.sort_array(labels("structure_labels"))}
    return merged.select("doc_id", (F.col("_island") - 1).cast("int").alias("chunk_index"), "n_merged", F.array_join("_p.text", "").alias("text"), "start_char", "end_char", *[made[c]().alias(c) for c in lists], *own)


def chunk_stage(docs: DataFrame, method: str = "both", size: int = 500, overlap: int = 100, least: int = 50, preset: Preset = LATIN, sentences: int = 0) -> DataFrame:
    """Chunks by method fixed, structure or both, in SCHEMA with chunk_id and chunk_method; docs (doc_id, text, normalized_text)."""
    if method not in ("fixed", "structure", "both"):
        raise ValueError(f"unknown method {method!r}; there are both, fixed and structure")
    made = {}
    if method != "structure":
        made["fixed"] = sentence_chunks(docs, size, overlap, delimiters=preset.delimiters)
    if method != "fixed":
        made["structure"] = structure_chunks(docs, size, least, preset=preset, overlap=sentences)
    out = None
    for name, chunks in made.items():
        rows = chunks.withColumns({"chunk_method": F.lit(name), "chunk_id": F.concat_ws("_", F.col("doc_id").cast("string"), F.lit(name), F.col("chunk_index").cast("string"))})
        out = rows if out is None else out.unionByName(rows)
    return out


def preferred(chunks: DataFrame, method: str) -> DataFrame:
    """The chunks of a method, or all if there is none of it (or the method is `both`)."""
    if method == "both" or chunks.where(F.col("chunk_method") == method).isEmpty():
        return chunks
    return chunks.where(F.col("chunk_method") == method)


def articles(docs: DataFrame, article: str, least: int = 40, text: str = "text") -> DataFrame:
    """(doc_id, part, label, text): texts parted at article headings, or whole without one; those that begin alike count once."""
    t = T.normalize_space(F.col(text))
    found = T.split_articles(t, article)
    rows = docs.withColumn("_t", t).where(F.char_length("_t") >= least).select("doc_id", F.posexplode(F.when(F.size(found) > 0, found).otherwise(F.array("_t"))).alias("part", "text"))
    rows = rows.withColumns({"text": T.normalize_space(F.col("text")), "label": F.nullif(F.regexp_extract("text", f"^{article}", 1), F.lit(""))}).where(F.char_length("text") >= least)
    first = Window.partitionBy("doc_id", F.substring("text", 1, 120)).orderBy("part")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("doc_id", "part", "label", "text")


def article_units(docs: DataFrame, least: int = 40, most: int = 2000, delimiter: str = "\n", text: str = "text") -> DataFrame:
    """(doc_id, part, text): a document's articles (here its lines) of fitting length; those that begin alike count once."""
    parts = docs.select("doc_id", F.posexplode(F.split(F.coalesce(text, F.lit("")), delimiter)).alias("part", "text"))
    units = parts.withColumn("text", T.normalize_space(F.col("text"))).where(F.char_length("text").between(least, most))
    first = Window.partitionBy("doc_id", F.substring("text", 1, 120)).orderBy("part")
    return units.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def saved_units(docs: DataFrame, least: int = 40, most: int = 2000, delimiter: str = "\n", text: str = "text") -> DataFrame:
    """`article_units` as a written table; where ids are different no text is shuffled, as a document's units are found within its row."""
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return saved(article_units(docs, least, most, delimiter, text), "units")
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), delimiter), lambda x, i: F.struct(T.normalize_space(x).alias("text"), i.alias("part")))
    fitting = F.filter(lines, lambda x: F.char_length(x["text"]).between(least, most))
    heads = F.array_sort(F.transform(fitting, lambda x: F.struct(F.substring(x["text"], 1, 120).alias("head"), x["part"].alias("part"), x["text"].alias("text"))))
    # Those that begin alike stand together, the first part before the others.
    firsts = T.let(heads, lambda xs: F.filter(xs, lambda x, i: (i == 0) | (x["head"] != F.get(xs, i - 1)["head"])))
    return saved(docs.select("doc_id", F.explode(firsts).alias("u")).select("doc_id", "u.part", "u.text"), "units")


def partition_column(method: Column) -> Column:
    """The corpus a chunk belongs to."""
    return F.when(method == "structure", "structure").when(method == "fixed", "fixed").otherwise("default")
