"""Personal-data spans by offset-preserving deobfuscation.

Base patterns run on the source text.  Every text also goes through a chain of
transducers (homoglyphs, at/dot disguises, spelled digits); each is skipped only
where a part that all its matches hold is not in the text.  Every output
character carries the source span it came from, so identifiers found in the
normalised text map back to source code points.  One pass, no shuffle.

A single spoken "at" before a host with written dots is ordinary prose
("available at example.com") and no disguise; with a spoken dot it is one.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import texts

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")

# Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТУХІЈЅαινορυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhqwABEKMHOPCTYXIJSaivopuxABEZHIKMNOPTYX"))
INVISIBLE = "​‌‍⁠﻿­"
ODD = re.compile(f"[{''.join(LOOKALIKES)}{INVISIBLE}！-～٠-٩۰-۹०-९\U0001d400-\U0001d7ff․﹒﹫]")

# Digit words and the words for "@", "." and "+".
DIGIT_WORDS = {
    **dict(zip("zero one two three four five six seven eight nine".split(), "0123456789")),
    **dict(zip("cero uno dos tres cuatro cinco seis siete ocho nueve".split(), "0123456789")),
    **dict(zip("zéro un deux trois quatre cinq six sept huit neuf".split(), "0123456789")),
    **dict(zip("null eins zwei drei vier fünf sechs sieben acht neun".split(), "0123456789")),
    "oh": "0",
}
AT_WORDS, DOT_WORDS = ("at", "arroba", "arobase", "ät"), ("dot", "punto", "point", "punkt")
_AT, _DOT = "|".join(AT_WORDS), "|".join(DOT_WORDS)
BRACKETED = re.compile(rf"\s*[(\[{{<]\s*(?:(?P<at>{_AT}|@)|(?P<dot>{_DOT}|\.))\s*[)\]}}>]\s*", re.I)
SPOKEN = re.compile(rf"(?<![\w.%+-])[\w.%+-]{{1,64}}(?P<at>\s+(?:{_AT})\s+)[\w-]{{1,63}}(?:(?:\s+(?:{_DOT})\s+|\.)[\w-]{{1,63}}){{0,6}}(?:\s+(?:{_DOT})\s+)[a-z]{{2,24}}(?!\w)", re.I)
SPOKEN_DOT = re.compile(rf"\s+(?:{_DOT})\s+", re.I)
_UNIT = rf"(?:{'|'.join(sorted(DIGIT_WORDS, key=len, reverse=True))}|[0-9]+)"
SPELLED = re.compile(rf"(?<!\w)(?:plus\s+|\+\s*)?{_UNIT}(?:(?:[\s-]+|\s*(?:{_DOT}|\.)\s*){_UNIT}(?!\w)){{3,}}", re.I)
PART = re.compile(rf"(?P<plus>plus\s+|\+\s*)|(?P<dot>\s*(?:{_DOT}|\.)\s*)|(?P<unit>{_UNIT})|(?P<gap>[\s-]+)", re.I)
ENTITY = re.compile(r"(?P<at>&(?:#0*64|#x0*40|commat);)|(?P<dot>&(?:#0*46|#x0*2e|period);)", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Each match holds one "@", so every "@" is tried once: linear in the text."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > end and text[s - 1] in LOCAL:
            s -= 1
        m = DOMAIN.match(text, at + 1) if s < at else None
        if m:
            end = m.end()
            out.append((s, end))
        else:
            end = max(end, at + 1)
        at = text.find("@", end)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = emails(text)
    if not DIGIT.search(text):
        return found
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found["ip"].append(m.span())
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(d) <= 19 and luhn(d):
                found["card"].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                found["phone"].append(m.span())
    return found


class Tape:
    """A text whose every character knows its source span."""

    def __init__(self, text: str, starts=None, ends=None):
        self.text = text
        self.starts = range(len(text)) if starts is None else starts
        self.ends = range(1, len(text) + 1) if ends is None else ends

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Tape:
        """edits: sorted (start, end, replacement); the characters of a replacement share the span."""
        if not edits:
            return self
        text, starts, ends, at = [], [], [], 0
        for s, e, new in [*edits, (len(self.text), len(self.text), "")]:
            text.append(self.text[at:s])
            starts.extend(self.starts[at:s])
            ends.extend(self.ends[at:s])
            if new and e > s:
                text.append(new)
                starts.extend([self.starts[s]] * len(new))
                ends.extend([self.ends[e - 1]] * len(new))
            at = e
        return Tape("".join(text), starts, ends)

    def source(self, s: int, e: int) -> tuple[int, int]:
        return self.starts[s], self.ends[e - 1]


def fold_lookalikes(t: Tape) -> Tape:
    def fold(c: str) -> str:
        if c in INVISIBLE:
            return ""
        if c in LOOKALIKES:
            return LOOKALIKES[c]
        n = unicodedata.normalize("NFKC", c)
        return str(unicodedata.digit(n)) if len(n) == 1 and not n.isascii() and unicodedata.digit(n, None) is not None else n

    return t.rewritten([(m.start(), m.end(), fold(m[0])) for m in ODD.finditer(t.text)])


def fold_at_dot(t: Tape) -> Tape:
    if "&" in t.text:
        t = t.rewritten([(m.start(), m.end(), "@" if m["at"] else ".") for m in ENTITY.finditer(t.text)])
    if any(c in t.text for c in "([{<"):
        t = t.rewritten([(m.start(), m.end(), "@" if m["at"] else ".") for m in BRACKETED.finditer(t.text)])
    if not SPOKEN_DOT.search(t.text):
        return t
    edits = []
    for m in SPOKEN.finditer(t.text):
        edits.append((*m.span("at"), "@"))
        edits += [(*d.span(), ".") for d in SPOKEN_DOT.finditer(t.text, m.end("at") - 1, m.end())]
    return t.rewritten([x for i, x in enumerate(edits) if not i or x[0] >= edits[i - 1][1]])


def fold_spelled(t: Tape) -> Tape:
    edits = []
    for m in SPELLED.finditer(t.text):
        if sum(x[0].lower() in DIGIT_WORDS for x in PART.finditer(m[0])) < 3:
            continue
        for p in PART.finditer(m[0]):
            s, e = m.start() + p.start(), m.start() + p.end()
            edits.append((s, e, "+" if p["plus"] else "." if p["dot"] else "" if p["gap"] else DIGIT_WORDS.get(p[0].lower(), p[0])))
    return t.rewritten(edits)


def added_spans(text: str, base: dict) -> dict[str, list[tuple[int, int]]]:
    """Spans of disguised identifiers, apart from all base spans."""
    tape = fold_spelled(fold_at_dot(Tape(text) if text.isascii() else fold_lookalikes(Tape(text))))
    if tape.text is text:
        return {}
    taken = sorted(s for spans in base.values() for s in spans)
    out: dict[str, list[tuple[int, int]]] = {}
    for kind, spans in base_spans(tape.text).items():
        for span in spans:
            s, e = tape.source(*span)
            if not any(a < e and s < b for a, b in taken):
                out.setdefault(kind, []).append((s, e))
    return out


def find_spans(text: str) -> tuple[dict, dict]:
    base = base_spans(text)
    return base, added_spans(text, base)


def written_spans(*found: dict) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in sorted(x for f in found for x in f.get(k, ())))


def masked(text: str, *found: dict) -> str:
    """text with every span replaced by its kind in angle brackets; of overlapping spans the first start wins."""
    out, at = [], 0
    for s, e, k in sorted((s, e, k) for f in found for k, spans in f.items() for s, e in spans):
        if s >= at:
            out += [text[at:s], f"<{k.upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def personal_spans(docs: DataFrame) -> DataFrame:
    """Per document: counts and digest of the base spans, and all spans as kind:start:end (code points).

    Null text is empty and has no spans (its digest is that of the empty string).
    Repeated rows give repeated results, a null doc_id stays null, an empty
    table gives no rows, other columns are ignored.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for x in batch.column("text").to_pylist():
                base, more = find_spans(x)
                first = written_spans(base)
                rows.append((*(len(base[k]) for k in KINDS), hashlib.sha256(first.encode()).hexdigest(), written_spans(base, more) if more else first, sum(map(len, more.values()))))
            cols = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")] + [pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()])],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
            )

    return texts(docs).mapInArrow(run, SCHEMA)


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """The same rows with every span of the text column masked; null text stays null."""

    @F.pandas_udf("string")
    def mask(col):
        return col.map(lambda x: None if x is None else masked(x, *find_spans(x)))

    return docs.withColumn("text", mask("text"))
