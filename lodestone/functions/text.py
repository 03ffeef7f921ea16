"""Text expressions: all run inside the JVM, apart from the full tokenizer at the end."""

from __future__ import annotations

import itertools
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import in_runs, let, ship

CJK = "[\\x{3040}-\\x{30FF}\\x{3400}-\\x{9FFF}\\x{AC00}-\\x{D7AF}]"

# Stop words of the tokenizer.
STOP_WORDS = frozenset(
    "a an the and or of to in on for with is are was were be been being by as at it its this that these those from into over under about after before between during without within than then there here how what which who whom whose why when where can could should would will shall may might must do does did done has have had having not no nor so such very just also only own same too more most other some any each few both all if but because while until against up down out off again further once i me my we our you your he him his she her they them their".split()
)


def simple_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order; null text has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), "")


def approx_tokens(text: Column) -> Column:
    """A quarter of the characters, each CJK character counting one."""
    cjk = F.regexp_count(text, F.lit(CJK))
    return (F.ceil((F.length(text) - cjk) / 4.0) + cjk).cast("long")


def word_count(text: Column) -> Column:
    """White-space separated words; every CJK character is a word."""
    cjk = F.regexp_count(text, F.lit(CJK))
    rest = F.filter(F.split(F.regexp_replace(text, CJK, " "), "[ \\t-\\r]+"), lambda t: t != "")
    return (cjk + F.size(rest)).cast("long")


def content_hash(text: Column) -> Column:
    """First 22 characters of the base64url SHA-256 of lower-cased text with single spaces."""
    norm = F.lower(F.trim(F.regexp_replace(text, "[ \\t-\\r]+", " ")))
    return short_hash(norm)


def short_hash(value: Column) -> Column:
    return F.substring(F.translate(F.base64(F.unhex(F.sha2(value, 256))), "+/", "-_"), 1, 22)


def chunk_id(canonical_url: Column, chunk_hash: Column) -> Column:
    return short_hash(F.concat(canonical_url, F.lit("#"), chunk_hash))


def light_stem(t: Column) -> Column:
    """Plural, -ing and -ed endings off words long enough to stand without them."""
    n = F.length(t)

    def less(k: int) -> Column:
        return F.substring(t, F.lit(1), n - k)

    return (
        F.when(n <= 4, t)
        .when(t.endswith("ies") & (n > 5), F.concat(less(3), F.lit("y")))
        .when(t.endswith("sses"), less(2))
        .when(t.endswith("ing") & (n > 6), less(3))
        .when(t.endswith("ed") & (n > 5), less(2))
        .when(t.endswith("s") & ~t.endswith("ss") & ~t.endswith("us") & ~t.endswith("is"), less(1))
        .otherwise(t)
    )


def script_language(text: Column) -> Column:
    """Language by script share of the first 4000 characters; null when Latin or too short."""
    head = F.substring(text, 1, 4000)
    letters = F.regexp_count(head, F.lit("\\p{L}"))

    def share(cls: str) -> Column:
        return F.regexp_count(head, F.lit(cls)) / letters

    return (
        F.when(letters < 20, F.lit(None).cast("string"))
        .when(share("[\\x{3040}-\\x{30FF}]") > 0.05, "ja")
        .when(share("[\\x{AC00}-\\x{D7AF}]") > 0.2, "ko")
        .when(share("[\\x{4E00}-\\x{9FFF}]") > 0.2, "zh")
        .when(share("[\\x{0400}-\\x{04FF}]") > 0.2, "ru")
        .when(share("[\\x{0600}-\\x{06FF}]") > 0.2, "ar")
        .when(share("[\\x{0370}-\\x{03FF}]") > 0.2, "el")
        .when(share("[\\x{0590}-\\x{05FF}]") > 0.2, "he")
        .when(share("[\\x{0900}-\\x{097F}]") > 0.2, "hi")
        .when(share("[\\x{0E00}-\\x{0E7F}]") > 0.2, "th")
    )


def lead_text(markdown: Column, size: int = 240) -> Column:
    """The first prose lines (40 characters at least; no heading, image, table or link line), cut to size."""
    prose = F.filter(F.split(markdown, "\n"), lambda x: (F.length(F.trim(x)) >= 40) & ~F.trim(x).rlike("^(#|!\\[|\\||\\[)"))
    return F.substring(F.array_join(F.transform(prose, lambda x: F.trim(x)), " "), 1, size)


def extract_numbers(text: Column) -> Column:
    """Distinct ISO dates, numbers and percentages, without thousands separators."""
    found = F.regexp_extract_all(text, F.lit("\\b[0-9]{4}-[0-9]{2}-[0-9]{2}\\b|\\b[0-9][0-9,]*(?:\\.[0-9]+)?%?"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit(""))))


def clean_snippet(html: Column) -> Column:
    """Tags and entities off a search-result snippet, one line."""
    out = F.regexp_replace(html, "<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, "[ \\t-\\r]+", " "))


def markdown_to_text(md: Column) -> Column:
    """Markdown marks off: fences, images, links, headings, quotes, lists, emphasis, table pipes."""
    steps = (
        ("(?m)^(```|~~~).*$", ""), ("!\\[([^\\]]*)\\]\\([^)]*\\)", "$1"), ("\\[([^\\]]*)\\]\\([^)]*\\)", "$1"), ("(?m)^#{1,6}[ \\t]+", ""),
        ("(?m)^>[ \\t]?", ""), ("(?m)^[ \\t]*[-*+][ \\t]+", ""), ("(?m)^[ \\t]*[0-9]+[.)][ \\t]+", ""), ("(?m)^[ \\t]*\\|?[ \\t]*:?-{3,}.*$", ""),
        ("\\*\\*([^*]+)\\*\\*", "$1"), ("`([^`]+)`", "$1"), ("[ \\t]*\\|[ \\t]*", " "), ("[ \\t]+", " "), ("\\n{3,}", "\n\n"),
    )
    out = md
    for pattern, new in steps:
        out = F.regexp_replace(out, pattern, new)
    return F.trim(out)


def redact_secrets(text: Column) -> Column:
    """Key-like tokens, passwords in URLs and key parameters masked."""
    out = F.regexp_replace(text, "(?i)\\b(sk|pk|ghp|gho|xox[abp]|AKIA)[-_A-Za-z0-9]{12,}", "[redacted]")
    out = F.regexp_replace(out, "(?i)://[^/@\\s:]+:[^/@\\s]+@", "://[redacted]@")
    return F.regexp_replace(out, "(?i)\\b(api[_-]?key|token|secret|password)(\\s*[=:]\\s*)[\"']?[^\\s\"'&]+[\"']?", "$1$2[redacted]")


def shingles(tokens: Column, n: int = 5) -> Column:
    """Distinct runs of n tokens; of fewer tokens the whole sequence."""

    def of(w: Column) -> Column:
        # by element, as slice copies the whole array each time; what lies beyond the end is null and left out
        runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), lambda i: F.concat_ws(" ", *(F.get(w, i + k) for k in range(n))))
        return F.array_distinct(F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(runs))

    return let(tokens, of)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; two empty ones are alike."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def recency_boost(age_days: Column, half_life: float, weight: float = 0.3, most: float = 1.3) -> Column:
    """1 + weight halved with each half-life, at most `most`; 1 without a date."""
    return F.when(age_days.isNull(), 1.0).otherwise(F.least(F.lit(most), 1.0 + weight * F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / half_life)))


_COMPOUND = re.compile(r"[^\W_]+(?:[._-][^\W_]+)+")
_OTHER = re.compile(r"[^\w\s]|_")


def stem(t: str) -> str:
    n = len(t)
    if n <= 4:
        return t
    if t.endswith("ies") and n > 5:
        return t[:-3] + "y"
    if t.endswith("sses"):
        return t[:-2]
    if t.endswith("ing") and n > 6:
        return t[:-3]
    if t.endswith("ed") and n > 5:
        return t[:-2]
    return t[:-1] if t.endswith("s") and not t.endswith(("ss", "us", "is")) else t


def tokenize_positions(text: str) -> list[tuple[str, int]]:
    """(token, word ordinal): compounds whole and first, then stemmed words without stop words."""
    norm = (text or "").lower()
    norm = norm if norm.isascii() else "".join(c for c in unicodedata.normalize("NFKD", norm) if not "̀" <= c <= "ͯ")
    flat = _OTHER.sub(" ", norm)
    starts, ordinal = [], {}
    for k, m in enumerate(re.finditer(r"\S+", flat)):
        starts.append(m.start())
        ordinal[m.start()] = k
    out = []
    for m in _COMPOUND.finditer(norm):
        if len(m[0]) > 4 or any(c.isalpha() for c in m[0]):
            at = max((k for s, k in ordinal.items() if s <= m.start()), default=0)
            out.append((m[0], at))
    for k, m in enumerate(re.finditer(r"\S+", flat)):
        if len(m[0]) > 1 and m[0] not in STOP_WORDS:
            out.append((stem(m[0]), k))
    return out


def tokenize(text: str) -> list[str]:
    return [t for t, _ in tokenize_positions(text)]


def full_tokens(text: Column) -> Column:
    """array<struct<token, pos>> by the full tokenizer; Unicode decomposition needs Python, so Arrow batches."""

    ship()

    def arrays(texts):
        found = [tokenize_positions(t) for t in texts]
        tokens, at = (pa.array([x[i] for f in found for x in f], kind) for i, kind in enumerate((pa.string(), pa.int32())))
        return pa.ListArray.from_arrays(pa.array([0, *itertools.accumulate(map(len, found))], pa.int32()), pa.StructArray.from_arrays([tokens, at], ["token", "pos"]))

    @F.arrow_udf("array<struct<token:string,pos:int>>")
    def run(col: pa.Array) -> pa.Array:
        return in_runs(col, arrays)

    return run(text)
