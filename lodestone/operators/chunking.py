"""Markdown to chunks that keep their offsets: headings, atomic code, size and overlap in approximate tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from ..functions.common import HELD, runs, ship

HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*#*\s*$")
FENCE = re.compile(r"^\s*(```|~~~)")
WIDE = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " ")


def approx_tokens(text: str) -> int:
    wide = len(WIDE.findall(text))
    return -(-(len(text) - wide) // 4) + wide


def sections(md: str) -> Iterator[tuple[int, int, tuple[str, ...], bool]]:
    """(start, end, breadcrumb, is code) of runs of lines under one heading; fenced code stands alone."""
    trail: list[tuple[int, str]] = []
    at = begin = 0
    fence = None
    for line in md.splitlines(keepends=True):
        end = at + len(line)
        mark = FENCE.match(line)
        if fence is None and mark:
            if begin < at:
                yield begin, at, tuple(t for _, t in trail), False
            fence, begin = mark[1], at
        elif fence is not None:
            if line.strip().startswith(fence):
                yield begin, end, tuple(t for _, t in trail), True
                fence, begin = None, end
        elif h := HEADING.match(line.rstrip("\n")):
            if begin < at:
                yield begin, at, tuple(t for _, t in trail), False
            while trail and trail[-1][0] >= len(h[1]):
                trail.pop()
            trail.append((len(h[1]), h[2]))
            begin = at
        at = end
    if begin < at:
        yield begin, at, tuple(t for _, t in trail), fence is not None


def split_span(md: str, start: int, end: int, most: int, level: int = 0) -> list[tuple[int, int]]:
    """Pieces of a span of at most `most` tokens, cut at the coarsest separator that does."""
    if approx_tokens(md[start:end]) <= most:
        return [(start, end)]
    if level >= len(SEPARATORS):
        step = max(50, most * 4)
        return [(i, min(i + step, end)) for i in range(start, end, step)]
    sep, parts, at = SEPARATORS[level], [], start
    while at < end:
        hit = md.find(sep, at, end)
        stop = end if hit < 0 else hit + len(sep)
        parts.append((at, stop))
        at = stop
    out: list[tuple[int, int]] = []
    for s, e in parts:
        for a, b in [(s, e)] if approx_tokens(md[s:e]) <= most else split_span(md, s, e, most, level + 1):
            if out and approx_tokens(md[out[-1][0] : b]) <= most:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
    return out


def chunk_markdown(md: str, size: int = 480, overlap: int = 60, min_chars: int = 40, most: int | None = None) -> list[dict]:
    """Chunks with start, end and breadcrumb, the first `most` if given; md[start:end] is the text before it is stripped."""
    spans: list[tuple[int, int, tuple[str, ...], bool]] = []
    for s, e, trail, code in sections(md):
        limit = int(size * 1.5) if code else size
        pieces = [(s, e)] if code and approx_tokens(md[s:e]) <= limit else split_span(md, s, e, size)
        for a, b in pieces:
            last = spans[-1] if spans else None
            if last and last[2] == trail and not code and not last[3] and a - last[1] <= 2 and approx_tokens(md[last[0] : b]) <= size:
                spans[-1] = (last[0], b, trail, False)
            else:
                spans.append((a, b, trail, code))
    overlap = min(overlap, size // 3)
    out, before = [], None
    for s, e, trail, code in spans:
        begin = s
        if before and overlap and not code and not before[3] and before[2] == trail and s - before[1] <= 2:
            back = max(before[0], s - overlap * 4)
            hit = md.find(" ", back, s)
            begin = hit + 1 if back > before[0] and 0 <= hit < s else back
        before = (s, e, trail, code)
        text = md[begin:e].strip()
        if len(text) >= min_chars:
            out.append({"chunk_index": len(out), "start": begin, "end": e, "breadcrumb": " > ".join(trail), "text": text})
        if most is not None and len(out) >= most:
            break
    return out


SCHEMA = "doc_id long, chunk_index int, start int, end int, breadcrumb string, text string"


def chunk_documents(docs: DataFrame, size: int = 480, overlap: int = 60, min_chars: int = 100, most: int | None = None) -> DataFrame:
    """docs (doc_id, text) -> chunks; the greedy cut is sequential, so it runs in Python over Arrow batches."""

    ship()

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for a, b in runs([len(t or "") for t in pdf["text"]], HELD):
                part = pdf.iloc[a:b]
                rows = [{"doc_id": d, **c} for d, t in zip(part["doc_id"], part["text"]) for c in chunk_markdown(t or "", size, overlap, min_chars, most)]
                if rows:
                    yield pd.DataFrame(rows)

    return docs.select("doc_id", "text").mapInPandas(run, SCHEMA)
