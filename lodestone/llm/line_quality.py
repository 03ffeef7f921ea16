"""Line-first quality rules.

Every line is judged alone by ordered rules (repeated, navigation, boilerplate,
shouting, symbols, run of one word, punctuation).  Failing lines go; a document
that loses too large a share of its words goes with them.  One pass, no shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .shared import texts

SYMBOLS = b"#*$%&|<>"
TERMINAL = tuple(x.encode() for x in (".", "!", "?", ":", ";", '"', "'", ")", "]", "…", "”", "’", "»", "。", "！", "？"))
#: Phrases that mark a line as site furniture or a licence notice; lower case.
BOILERPLATE = re.compile(
    rb"all rights reserved|licensed under|released under|apache license|creative commons|permission is hereby granted|spdx-license|copyright \(c\)|privacy policy|terms of (?:use|service)|use of cookies|accept (?:all )?cookies|enable javascript|lorem ipsum|subscribe to our newsletter|click here to|sign up for|share this (?:article|post)|powered by"
)
NAVIGATION = re.compile("|".join(map(re.escape, "|»›·•→")).encode())


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules; the document goes if it loses more than max_lost of its words."""

    max_lost: float = 0.5
    nav_share: float = 0.2
    symbol_share: float = 0.3
    shout_share: float = 0.3
    run_share: float = 0.3
    run_words: int = 10
    bare_words: int = 12
    min_words: int = 50
    max_repeat_percent: int = 50


def failed_rule(line: bytes, words: list[bytes], seen: set, r: LineRules) -> str:
    """The first rule that a line with words fails, or an empty string."""
    n = len(words)
    if n >= 4 and line in seen:
        return "repeated"
    marks = len(NAVIGATION.findall(line))
    if marks >= 3 and marks >= r.nav_share * n:
        return "navigation"
    low = line.lower()
    if n <= 60 and BOILERPLATE.search(low):
        return "boilerplate"
    if n >= 4 and sum(1 for w in words if len(w) > 1 and w[-1] in b"!" and w[-2] in b"!") > r.shout_share * n:
        return "shouting"
    if len(line) - len(line.translate(None, SYMBOLS)) > r.symbol_share * n:
        return "symbols"
    if n >= r.run_words and len(set(words)) < r.run_share * n and sum(a == b for a, b in zip(words, words[1:])) > 0.5 * n:
        return "run"
    if n < r.bare_words and not line.rstrip().endswith(TERMINAL):
        return "punctuation"
    return ""


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that the text holds twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == n:
        return 0
    many = Counter(windows)
    count, upto = 0, 0
    for i, w in enumerate(windows):
        if many[w] > 1:
            count += i + 3 - max(i, upto)
            upto = i + 3
    return count


def judge(text: bytes, r: LineRules) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, n_lines_removed, n_words_removed, cleaned)."""
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    n_repeat = repeated_words(words)
    seen: set = set()
    dup = n_lines = gone = lost = 0
    left = []
    for line in text.split(b"\n"):
        own = line.split()
        if not own:
            left.append(line)
            continue
        n_lines += 1
        dup += line in seen
        if failed_rule(line, own, seen, r):
            gone += 1
            lost += len(own)
        else:
            left.append(line)
        seen.add(line)
    base_failed = n < r.min_words or 100 * n_repeat > r.max_repeat_percent * n
    kept = not base_failed and lost <= r.max_lost * n
    return n, len(joined.decode("utf-8", "replace")), len(joined) - len(joined.translate(None, SYMBOLS)), dup, n_repeat, base_failed, kept, n_lines, gone, lost, b"\n".join(left)


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_lines_removed", "n_words_removed")
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_lines_removed long, n_words_removed long"


def clean_lines(docs: DataFrame, rules: LineRules | None = None, with_text: bool = True) -> DataFrame:
    """One row for each document: line statistics, the verdict, and (with_text) the cleaned text.

    Null text counts as empty and fails (too few words); repeated rows are
    judged each on its own; a null doc_id stays null; an empty table gives no
    rows; other columns are ignored.
    """
    r = rules or LineRules()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [judge(x, r) for x in batch.column("text").cast(pa.binary()).to_pylist()]
            cols = list(zip(*rows)) if rows else [()] * 11
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 3
            out = {"doc_id": batch.column("doc_id")} | {k: pa.array(c, t) for k, c, t in zip(FIELDS, cols, kinds)}
            if with_text:
                out["cleaned"] = pa.array(cols[10], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_pydict(out)

    return texts(docs).mapInArrow(run, SCHEMA + (", cleaned string" if with_text else ""))
