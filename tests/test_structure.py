"""The structure-aware chunker, sections and articles against rules written anew."""

import random
import re
from dataclasses import replace

import pytest

from corpusloom.functions.presets import LATIN, ZH
from corpusloom.operators import chunking

PROSE = replace(LATIN, heading=r"([A-Z][a-z]+[.,;:])", levels=(".", ",", ";"))


def headed(text, preset):
    """Sections as (level, label, start, end, path): a section's path has every earlier heading that no later one of its level or less covers."""
    marks = [(m.start(), m.group()) for m in re.finditer(preset.heading, text)]
    level = lambda h: min([k for k, x in enumerate(preset.levels, 1) if x in h], default=len(preset.levels) + 1)
    cuts = [a for a, _ in marks] + [len(text)]
    out = [(0, "", 0, cuts[0], [])]
    for i, (a, h) in enumerate(marks):
        seen = [(level(x), x.strip()) for _, x in marks[: i + 1]]
        path = [x for j, (n, x) in enumerate(seen) if all(m > n for m, _ in seen[j + 1 :])]
        out.append((level(h), h.strip(), a, cuts[i + 1], path))
    return [s for s in out if text[s[2] : s[3]].strip()]


def joined(units, most):
    """Fewest runs of neighbours from the left, each as long as it can be."""
    at, out = 0, []
    while at < len(units):
        n = next((k for k in range(len(units), at + 1, -1) if len("".join(units[at:k])) <= most), at + 1)
        out.append("".join(units[at:n]))
        at = n
    return out


def chunked(text, most, least, preset, overlap):
    """(text, start, end, path) of each chunk."""
    says = lambda t: [x for x in re.findall(f"[^{re.escape(preset.delimiters)}]+[{re.escape(preset.delimiters)}]?", t) if x.strip()]
    groups, own = [], headed(text, preset)
    for s in own:
        new = not groups or s[3] - groups[-1][0][2] > most
        if not new and s[1] and s[0] in (1, 2, 3) and s[4] != groups[-1][-1][4]:
            new = max(x[0] for x in groups[-1]) >= 3
        groups.append([s]) if new else groups[-1].append(s)
    pieces = []
    for g in groups:
        a, b, path = g[0][2], g[-1][3], g[-1][4]
        body = text[a:b].strip()
        if len(body) <= most:
            pieces.append((body, a, b, path))
            continue
        parts = joined(says(body), most) if len(says(body)) > 1 else []
        parts = parts if len(parts) > 1 else joined([x for x in re.split(preset.secondary, body) if x.strip()], most)
        parts = parts if len(parts) > 1 else [body[k : k + most] for k in range(0, len(body), most)]
        at, before = text.index(body, a), []
        for p in filter(None, map(str.strip, parts)):
            found = text.find(p, at)
            start = found if found >= 0 else at
            at = start + len(p)
            pieces.append(("".join(before[-overlap:] if overlap else []) + p, start, at, path))
            before = [x.strip() for x in says(p)]
    out = []
    for p in pieces:
        if out and len(p[0]) < least:
            t, a, _, path = out.pop()
            p = ((t + "\n" + p[0]).strip(), a, p[2], path + [x for x in p[3] if x not in path])
        out.append(p)
    return [p for p in out if p[0]]


def written(rng, preset):
    if preset is ZH:
        made = lambda: rng.choice(["第一编", "第二章", "第3章", "第四节", "第五条", "第六条", "第一款", "第二项", "一、", "（二）", "甲乙丙", "丁，戊", "己。", "庚；", "辛！", "\n", " ", "壬：癸", "甲" * rng.randint(1, 30)])
    else:
        made = lambda: rng.choice(["One.", "Two,", "Three;", "Four:", "plain words", " so, it", "goes. ", "\n", "and! ", "x" * rng.randint(1, 30), " "])
    return "".join(made() for _ in range(rng.randint(0, 60)))


@pytest.mark.parametrize("preset", [ZH, PROSE], ids=["zh", "prose"])
def test_structure_by_rules_written_anew(spark, preset):
    rng = random.Random(5)
    texts = ["", " \n ", "第一条", "Two,", *[written(rng, preset) for _ in range(150)]]
    df = spark.createDataFrame([*enumerate(texts), (len(texts), None)], "doc_id long, text string")
    got = {}
    for r in chunking.sections(df, preset).orderBy("doc_id", "section").collect():
        got.setdefault(r["doc_id"], []).append((r["level"], r["label"], r["start_char"], r["end_char"], r["path"]))
    assert got == {i: h for i, t in enumerate(texts) if (h := headed(t, preset))}
    for most, least, overlap in ((40, 10, 1), (25, 0, 2), (200, 60, 0)):
        got = {}
        for r in chunking.structure_chunks(df, most, least, preset=preset, overlap=overlap).orderBy("doc_id", "chunk_index").collect():
            got.setdefault(r["doc_id"], []).append((r["text"], r["start_char"], r["end_char"], r["section_path"]))
        want = {i: c for i, t in enumerate(texts) if (c := chunked(t, most, least, preset, overlap))}
        assert got.keys() == want.keys() and all(got[i] == want[i] for i in want), next((texts[i], got[i], want[i]) for i in want if got.get(i) != want[i])


def test_a_long_text_without_articles(spark):
    df = spark.createDataFrame([(1, "One. " + "word " * 400_000), (2, "word " * 400_000)], "doc_id long, text string")
    got = chunking.articles(df, PROSE.heading).select("doc_id", "label").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, "One."), (2, None)]
