"""Text functions as Column expressions; null text counts as empty."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.presets import LATIN, MOJIBAKE_MARKERS

_SPACES = r"\s\x0b\x1c-\x1f\x85\p{Z}"
#: All that Python's \s matches; Java's own class leaves some out.
SPACE = f"[{_SPACES}]+"
#: Runs of it but for single blanks, which are as they should be: most texts have few others.
_UNEVEN = f"(?:[{_SPACES}&&[^ ]]| (?=[{_SPACES}]))[{_SPACES}]*+"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def let(value: Column, f) -> Column:
    """f of value, which is evaluated once; an expression that a lambda captures would be evaluated for every element."""
    return F.get(F.transform(F.array(value), f), 0)


def strip(c: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(_text(c), f"^{SPACE}|{SPACE}$", "")


def normalize_space(c: Column) -> Column:
    return F.btrim(F.regexp_replace(_text(c), _UNEVEN, " "))


def without_tags(c: Column) -> Column:
    """Tags as spaces; a text without `<` has none and is not searched for them."""
    return F.when(F.contains(_text(c), F.lit("<")), F.regexp_replace(_text(c), "<[^>]+>", " ")).otherwise(_text(c))


def normalize_text(c: Column) -> Column:
    """Wide and hard spaces as spaces, tags as spaces, runs of white space as one, ends trimmed."""
    return normalize_space(without_tags(c))


normalize_title = normalize_text


def content_hash(c: Column) -> Column:
    return F.sha1(F.encode(c, "UTF-8"))


def extract_year(c: Column, pattern: str = r"(?:19|20)\d{2}") -> Column:
    """Of ten or more digits the UTC year of that many seconds (13 or more: milliseconds), else the first match from 1900 to 2100."""
    digits = F.trim(_text(c))
    long = digits.try_cast("long")
    epoch = F.when(F.length(digits) >= 13, F.floor(long / 1000)).otherwise(long)
    found = F.regexp_extract(digits, pattern, 0).try_cast("int")
    return F.when(digits.rlike(r"^\d{10,18}$"), F.year(F.timestamp_seconds(epoch))).when(found.between(1900, 2100), found)


def is_probably_garbled(c: Column) -> Column:
    return F.reduce(F.array(*[F.contains(_text(c), F.lit(m)) for m in MOJIBAKE_MARKERS]), F.lit(False), lambda a, x: a | x)


def repeated_line_ratio(c: Column) -> Column:
    """The share of non-empty normalised lines that occur more than once; of fewer than two lines 0."""
    lines = F.array_sort(F.filter(F.transform(F.split(_text(c), "\n"), normalize_space), lambda x: x != ""))

    def ratio(lines: Column) -> Column:
        differs = lambda x, y: y.isNull() | (y != x)
        alone = F.size(F.filter(lines, lambda x, i: differs(x, F.get(lines, i - 1)) & differs(x, F.get(lines, i + 1))))
        return F.when(F.size(lines) < 2, F.lit(0.0)).otherwise((F.size(lines) - alone) / F.size(lines))

    return let(lines, ratio)


def low_information_ratio(c: Column) -> Column:
    n = F.char_length(_text(c))
    return F.when(n == 0, F.lit(1.0)).otherwise(1 - F.size(F.array_distinct(F.split(_text(c), ""))) / n)


def structure_hints(c: Column, pattern: str = LATIN.hints, most: int = 20) -> Column:
    return F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(_text(c), F.lit(pattern), F.lit(0)))), 1, most)


def tokens(c: Column, pattern: str = LATIN.token) -> Column:
    """Case-sensitive ASCII words and single CJK characters."""
    return F.regexp_extract_all(_text(c), F.lit(pattern), F.lit(0))


def _grams(chars: Column, n: int) -> Column:
    """The n-grams of an array of characters, in time that grows with its length."""
    some = F.transform(F.slice(chars, 1, F.greatest(F.size(chars) - n + 1, F.lit(0))), lambda x, i: F.concat(x, *[F.get(chars, i + k) for k in range(1, n)]))
    return F.when(F.size(chars) == 0, F.array().cast("array<string>")).when(F.size(chars) < n, F.array(F.array_join(chars, ""))).otherwise(some)


def _chars(c: Column) -> Column:
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.split(c, ""))


def char_ngrams(c: Column, n: int = 3) -> Column:
    """Of the text without white space; a shorter text is its own, an empty one has none."""
    return let(_chars(F.regexp_replace(_text(c), SPACE, "")), lambda chars: _grams(chars, n))


def gram_set(c: Column, n: int = 3) -> Column:
    return F.array_distinct(char_ngrams(c, n))


def sampled_ngrams(c: Column, n: int = 3, head: int = 2000, most: int = 128, normalized: bool = False) -> Column:
    """Trigrams of the first `head` code points of the normalised text (c itself, if it is) at a stride that gives about `most`."""
    def some(chars: Column) -> Column:
        # Only the places that are kept become grams; `most` of them, as a stride rounded down gives more.
        size = F.size(chars) - n + 1
        stride = F.greatest(F.floor(size / most), F.lit(1)).cast("int")
        at = F.sequence(F.lit(0), F.least(stride * (most - 1), size - 1), stride)
        return F.when(size < 2, _grams(chars, n)).otherwise(F.transform(at, lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)])))

    return let(_chars(F.substring(c if normalized else normalize_text(c), 1, head)), some)


def split_sentences(c: Column, delimiters: str = LATIN.delimiters) -> Column:
    """Sentences with their delimiter, trimmed, without blank ones."""
    cls = delimiters.replace("\n", r"\n")
    return F.filter(F.transform(F.split(_text(c), f"(?<=[{cls}])"), normalize_space), lambda s: s != "")


def bare_sentences(c: Column, delimiters: str = LATIN.delimiters) -> Column:
    """Sentences without their delimiter, with white space normalised, without blank ones."""
    cls = delimiters.replace("\n", r"\n")
    return F.filter(F.transform(F.split(_text(c), f"[{cls}]"), normalize_space), lambda s: s != "")


def normalize_question(c: Column) -> Column:
    return F.lower(F.regexp_replace(normalize_space(c), r"[?？。.!！,，;；:：\"'《》]", ""))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def overlap_ratio(a: Column, b: Column) -> Column:
    """The share of a's different members that b has; 0 if either is empty."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def gram_overlap(a: Column, b: Column, n: int) -> Column:
    """overlap_ratio of the gram sets of a and b. A gram of a is one of b's where b, without white space, contains it, so b's are not made."""

    @F.arrow_udf("double")
    def ratio(a: pa.Array, b: pa.Array) -> pa.Array:
        grams: dict[str, set[str]] = {}

        def share(x: str, y: str) -> float:
            if x not in grams:
                bare = "".join(x.split())
                grams[x] = {bare[i : i + n] for i in range(max(len(bare) - n + 1, 1))} if bare else set()
            own, y = grams[x], "".join(y.split())
            # A text that is shorter than a gram is its own.
            held = sum([g in y for g in own]) if len(y) >= n and all(len(g) == n for g in own) else y in own
            return held / len(own) if own and y else 0.0

        return pa.array([share(x or "", y or "") for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())

    return ratio(a, b)


def longest_overlap(a: Column, b: Column, least: int = 3, most: int = 24) -> Column:
    """The first of a's longest substrings, of `most` to `least` code points, that b contains; else empty."""

    def of(size: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.char_length(a) - size + 1, F.lit(1)))
        return F.get(F.filter(F.transform(starts, lambda i: F.substring(a, i, size)), lambda s: (F.char_length(s) == size) & F.contains(b, s)), 0)

    # Shorter runs are looked for only where no longer one was found.
    return F.aggregate(F.sequence(F.lit(most), F.lit(least)), F.lit(""), lambda found, n: F.when(found != "", found).otherwise(F.coalesce(of(n), F.lit(""))))


def clean_term(c: Column) -> Column:
    return F.btrim(F.regexp_replace(_text(c), r"[（(][^）)]*[）)]", ""), F.lit(" \t\r\n,，.。;；:：、\"'“”《》"))


def pick_template(options: list[Column], seed: Column) -> Column:
    """The option numbered by the sum of the seed's code points."""
    total = F.aggregate(F.filter(F.split(seed, ""), lambda x: x != ""), F.lit(0), lambda a, x: a + F.ascii(x))
    return F.get(F.array(*options), F.pmod(total, F.lit(len(options))))


def question_subject(c: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(_text(c), p, 1), F.lit("")) for p in patterns])


def split_articles(c: Column, article: str) -> Column:
    """Parts that begin with an article heading; what stands before the first is dropped."""
    inner = article.strip("()")
    return F.regexp_extract_all(_text(c), F.lit(f"(?s)(?:{inner})(?:(?!{inner}).)*+"), F.lit(0))


def has_citation_brackets(c: Column) -> Column:
    return _text(c).rlike(r"\[\d+\]")


def retrieval_text(*parts: Column) -> Column:
    return F.concat_ws(" ", *[F.nullif(F.btrim(_text(p)), F.lit("")) for p in parts])


def present(c: Column) -> Column:
    return F.length(F.btrim(_text(c))) > 0


def sub_once(c: Column, pattern: str) -> Column:
    return F.regexp_replace(_text(c), f"(?is)^(.*?)(?:{pattern})", "$1")


def sub_all(c: Column, pattern: str, by: str = " ") -> Column:
    return F.regexp_replace(_text(c), f"(?i){pattern}", by)


def hit_key(chunk_id: Column, doc_id: Column, title: Column, text: Column) -> Column:
    named = lambda p, c: F.concat(F.lit(p), F.nullif(c.cast("string"), F.lit("")))
    return F.coalesce(named("chunk:", chunk_id), named("doc:", doc_id), F.concat(F.lit("text:"), _text(title), F.lit("|"), F.substring(_text(text), 1, 120)))


def format_metric(c: Column) -> Column:
    """Four digits, rounded from the number's exact value, ties to the even digit, as C's printf does; Java's rounds its shortest decimals half up. Null is empty."""
    x = c.cast("double")
    # Whole numbers are grouped by commas; only what is not finite has no digits.
    finite = F.translate(F.format_number(x, 4), ",", "")
    return F.when(x.isNull(), F.lit("")).when(F.abs(x) < float("inf"), finite).otherwise(F.format_string("%.4f", x))


def strip_reasoning(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(_text(c), r"(?s)<think>.*?</think>", ""), r"(?s)<think>.*$", "")


def json_payload(c: Column) -> Column:
    """The JSON object in a model's answer: the whole, else from the first brace to the last, else null."""
    whole = F.btrim(strip_reasoning(c))
    slice_ = F.regexp_extract(whole, r"(?s)(\{.*\})", 1)
    valid = lambda x: F.get_json_object(x, "$").isNotNull() & x.startswith("{")
    return F.when(valid(whole), whole).when(valid(slice_), slice_)


def parse_status(c: Column) -> Column:
    whole = F.btrim(strip_reasoning(c))
    payload = json_payload(c)
    return F.when(payload.isNull(), F.lit("fallback")).when(payload == whole, F.lit("strict")).otherwise(F.lit("sliced"))


def json_object(c: Column) -> Column:
    """A lenient reading of a JSON object: the whole, else from the first brace to the last, else {}."""
    return F.coalesce(json_payload(c), F.lit("{}"))


def transform_payload(c: Column, most: int = 3) -> Column:
    """A struct (multi_queries, hyde) of a model's answer: those fields of its object, be it the whole or what stands between the first brace and the last; without one the strings that it quotes, `most` of them."""
    payload = json_payload(c)
    field = lambda *names: F.coalesce(*[F.from_json(F.get_json_object(payload, f"$.{n}"), "array<string>") for n in names], F.array().cast("array<string>"))
    quoted = F.slice(F.regexp_extract_all(strip_reasoning(c), F.lit(r'"([^"]+)"'), F.lit(1)), 1, most)
    told = F.struct(field("multi_queries", "queries").alias("multi_queries"), F.coalesce(F.get_json_object(payload, "$.hyde"), F.get_json_object(payload, "$.passage"), F.lit("")).alias("hyde"))
    return F.when(payload.isNull(), F.struct(quoted.alias("multi_queries"), F.lit("").alias("hyde"))).otherwise(told)
