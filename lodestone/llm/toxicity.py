"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer maps tokens to classes (insult, threat, target, negation,
report).  Transducers for negation, reported speech and targets ahead of a hit
are composed into one machine that reads a clause forwards; one for targets
behind a hit reads its output backwards, so every hit knows its clause.  A hit
that is aimed at somebody counts in full, an insult alone little, a threat
word alone (one can kill a process) next to nothing.

Fixed words and prefixes learned from labels make up the lexicon; a two-parameter
logistic maps the evidence of all clauses to a probability.  Learned prefixes
are insults: labels tell that a word marks toxic texts, not what it does there.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import texts

# The seeds of the lexicon.
INSULTS = "idiot moron stupid loser scum trash pathetic worthless disgusting clown imbecile cretin dumbass bastard vermin abschaum dummkopf trottel vollidiot connard imbécile salaud imbécil idiota estúpido".split()
THREATS = "kill murder strangle stab slaughter annihilate umbringen erwürgen étrangler assassiner asesinar estrangular".split()
TARGETS = "you your youre u he she they him her them these those people all everyone dich dir euch toi vous usted ustedes".split()
NEGATIONS = "not never no nobody isnt arent dont doesnt didnt cannot cant wont nicht kein keine nunca ningún jamais aucun".split()
REPORTS = "said says wrote writes quoted quote claimed called reported alleged according accused sagte schrieb disait écrivit dijo escribió".split()

OTHER, INSULT, THREAT, TARGET, NEG, REPORT, AIMED_INSULT, AIMED_THREAT = range(8)
AIMED = {INSULT: AIMED_INSULT, THREAT: AIMED_THREAT}
#: Evidence of a hit that nothing else weighs.
WEIGHTS = {INSULT: 0.25, THREAT: 0.05, AIMED_INSULT: 1.5, AIMED_THREAT: 2.0}
#: Tokens over which a negation and a target reach.
NEGATED_WITHIN, AIMED_WITHIN = 3, 4
CLAUSE_END = re.compile(r"[.!?;:\n]+")
TOKEN = re.compile(r"[^\W\d_]+")


class Transducer:
    """A deterministic weighted transducer over token classes: (state, symbol) -> (state, symbol, weight)."""

    def __init__(self, start, step):
        self.start, self.arcs = start, {}
        todo = [start]
        seen = {start}
        while todo:
            q = todo.pop()
            for a in range(8):
                self.arcs[q, a] = r, _, _ = step(q, a)
                if r not in seen:
                    seen.add(r)
                    todo.append(r)

    def then(self, other: Transducer) -> Transducer:
        """Composition: other reads what this one writes; weights multiply."""

        def step(q, a):
            p, b, w = self.arcs[q[0], a]
            r, c, v = other.arcs[q[1], b]
            return (p, r), c, w * v

        return Transducer((self.start, other.start), step)

    def run(self, symbols) -> list[tuple[int, float]]:
        """(symbol written, weight) for each symbol read."""
        q, out = self.start, []
        for a in symbols:
            q, b, w = self.arcs[q, a]
            out.append((b, w))
        return out


def negation() -> Transducer:
    """A hit up to three tokens behind a negation weighs 0.3."""
    return Transducer(0, lambda q, a: (NEGATED_WITHIN, a, 1.0) if a == NEG else (0, a, 0.3) if q and a in WEIGHTS else (max(q - 1, 0), a, 1.0))


def reported() -> Transducer:
    """Hits behind a reporting verb of the same clause weigh 0.6."""
    return Transducer(0, lambda q, a: (1, a, 1.0) if a == REPORT else (q, a, 0.6 if q and a in WEIGHTS else 1.0))


def aimed() -> Transducer:
    """Hits up to four tokens behind a target become aimed ones."""
    return Transducer(0, lambda q, a: (AIMED_WITHIN, a, 1.0) if a == TARGET else (q, AIMED[a], 1.0) if q and a in AIMED else (max(q - 1, 0), a, 1.0))


FORWARDS, BACKWARDS = negation().then(reported()).then(aimed()), aimed()


def clause_weights(classes: list[int]) -> list[float]:
    """What each token of a clause weighs: the forward machine, then the backward one over what it wrote."""
    first = FORWARDS.run(classes)
    second = BACKWARDS.run(a for a, _ in reversed(first))
    return [WEIGHTS.get(b, 0.0) * w * v for (_, w), (b, v) in zip(first, reversed(second))]


@dataclass(frozen=True)
class Lexicon:
    """stems: learned prefix -> weight.  slope, offset: of the logistic on log(1 + evidence)."""

    stems: dict = field(default_factory=dict)
    slope: float = 4.0
    offset: float = -3.0

    def signs(self) -> tuple[str, ...]:
        return (*INSULTS, *THREATS, *self.stems)

    def classify(self, token: str) -> tuple[int, float]:
        known = FIXED.get(token)
        if known is not None:
            return known, 1.0
        for k in range(min(len(token), 8), 2, -1):
            w = self.stems.get(token[:k])
            if w is not None:
                return INSULT, w
        return OTHER, 0.0


FIXED = {w: c for c, words in ((TARGET, TARGETS), (NEG, NEGATIONS), (REPORT, REPORTS), (INSULT, INSULTS), (THREAT, THREATS)) for w in words}


def evidence(text: str, lexicon: Lexicon, signs: tuple[str, ...]) -> float:
    """Sum of the weights of the hits of all clauses."""
    low = text.lower()
    if not any(s in low for s in signs):
        return 0.0
    total, cache = 0.0, {}
    for clause in CLAUSE_END.split(low):
        if not any(s in clause for s in signs):
            continue
        own = []
        for token in TOKEN.findall(clause):
            if (c := cache.get(token)) is None:
                c = cache[token] = lexicon.classify(token)
            own.append(c)
        total += sum(w * c[1] for w, c in zip(clause_weights([c[0] for c in own]), own) if w)
    return total


def score_of(e: float, lexicon: Lexicon) -> float:
    return 1 / (1 + math.exp(-(lexicon.offset + lexicon.slope * math.log1p(e))))


def prefixes(text: str) -> Counter:
    """Occurrences of each prefix of 3 to 8 letters of the text's words."""
    own: Counter = Counter()
    for w, n in Counter(TOKEN.findall(text.lower())).items():
        for k in range(3, min(len(w), 8) + 1):
            own[w[:k]] += n
    return own


def prefix_counts(batches):
    """Per prefix: toxic and clean documents with it, and with it twice."""
    import pyarrow as pa

    counts: dict[str, list[int]] = {}
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            at = 0 if toxic > 0 else 1
            for p, n in prefixes(text).items():
                c = counts.get(p)
                if c is None:
                    c = counts[p] = [0, 0, 0, 0]
                c[at] += 1
                if n > 1:
                    c[at + 2] += 1
    if counts:
        cols = list(zip(*counts.values()))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array(c, pa.int64()) for c in cols)], ["prefix", "pos", "neg", "pos2", "neg2"])


def covering_stems(stats: dict[str, tuple[float, float]], toxic: list[dict[str, int]], least: float) -> dict[str, float]:
    """Greedy cover of the toxic documents by prefixes.

    stats: prefix -> odds ratio of documents with it, and with it twice.
    toxic: per document its candidate prefixes with their counts.  A stem must
    cover least documents that no stem before it covers, so that words that
    merely stand in copies of one toxic text are not taken.
    """
    holds: dict[str, set[int]] = {}
    for i, own in enumerate(toxic):
        for p, n in own.items():
            once, twice = stats[p]
            if once >= 12 or n > 1 and twice >= 12:
                holds.setdefault(p, set()).add(i)
    out: dict[str, float] = {}
    # the first cover may use any prefix, the second only short ones: stems with inflections
    for longest in (8, 6):
        left = set(range(len(toxic)))
        rest = {p: own for p, own in holds.items() if len(p) <= longest and not any(p.startswith(s) or s.startswith(p) for s in out)}
        while left:
            gain = {p: len(own & left) for p, own in rest.items()}
            gain = {p: g for p, g in gain.items() if g >= least}
            if not gain:
                break
            # of equal gains the stronger, then the longer prefix
            best = max(gain, key=lambda p: (gain[p] * math.log(max(stats[p])), math.log(stats[p][0]), len(p), p))
            out[best] = min(1.0, max(0.3, math.log(stats[best][0]) / 5))
            left -= rest[best]
            rest = {p: rest[p] for p in gain if p != best}
    return out


def fit_logistic(points: list[tuple[float, int, int]]) -> tuple[float, float]:
    """(slope, offset) of labels on log(1 + evidence), by damped Newton steps with a weak prior; points: (x, label, count)."""
    a, b = 3.0, -2.5
    for _ in range(50):
        g0, g1, h00, h01, h11 = -0.02 * (b + 2.5), -0.02 * (a - 3.0), 0.02, 0.0, 0.02
        for x, y, n in points:
            p = 1 / (1 + math.exp(-max(-30, min(30, b + a * x))))
            g0, g1, w = g0 + n * (y - p), g1 + n * (y - p) * x, n * p * (1 - p)
            h00, h01, h11 = h00 + w, h01 + w * x, h11 + w * x * x
        det = h00 * h11 - h01 * h01
        db, da = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        a, b = a + max(-2, min(2, da)), b + max(-2, min(2, db))
        if abs(da) + abs(db) < 1e-6:
            break
    return max(a, 0.1), b


def fit_lexicon(docs: DataFrame, labels: DataFrame, max_rows: int = 10_000, train=None, min_share: float = 0.01) -> Lexicon:
    """Learn stems and the logistic from at most about max_rows labelled rows (a sample by hash of the id).

    min_share: the least share of all toxic documents that a stem must mark.
    At most 5000 prefixes, those that tell most, come to the driver; stems are
    few, as each must cover toxic documents that none before it covers.
    train: condition on doc_id for rows that may be learned from.  Labels that
    are null, or rows without a partner, are not used; with none left the fixed
    seeds and the default logistic hold.  A doc_id labelled twice counts with its larger label.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    own = own.where(train) if train is not None else own
    n = own.count()
    if n > max_rows:  # a sample by hash: the same rows on every run and partitioning
        own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # own has max_rows rows give or take sampling noise: a proven bound, so it is broadcast
    sample = texts(docs).join(F.broadcast(own), "doc_id").select("text", "toxic")
    sizes = {r["toxic"] > 0: r["n"] for r in own.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = sizes.get(True, 0), sizes.get(False, 0)
    if not n_pos or not n_neg:
        return Lexicon()
    counts = sample.mapInArrow(prefix_counts, "prefix string, pos long, neg long, pos2 long, neg2 long")
    ratio = ((F.col("pos") + 0.5) / (n_pos + 1.0)) / ((F.col("neg") + 0.5) / (n_neg + 1.0))
    ratio2 = ((F.col("pos2") + 0.5) / (n_pos + 1.0)) / ((F.col("neg2") + 0.5) / (n_neg + 1.0))
    least = max(3.0, min_share * n_pos)
    rows = (
        counts.groupBy("prefix").agg(*(F.sum(c).alias(c) for c in ("pos", "neg", "pos2", "neg2")))
        .select("prefix", ratio.alias("ratio"), ratio2.alias("ratio2"), "pos", "pos2")
        .where(((F.col("pos") >= max(5.0, least)) & (F.col("ratio") >= 12)) | ((F.col("pos2") >= least) & (F.col("ratio") >= 3) & (F.col("ratio2") >= 12)))
        .orderBy(F.desc(F.col("pos") * F.log("ratio") + F.col("pos2") * F.log("ratio2")), F.desc(F.length("prefix")), "prefix").limit(5000).collect()
    )
    stats = {r["prefix"]: (r["ratio"], r["ratio2"]) for r in rows}

    def hits(batches):
        import pyarrow as pa

        for batch in batches:
            own = [{p: n for p, n in prefixes(x).items() if p in stats} for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([list(x) for x in own], pa.list_(pa.string())), pa.array([list(x.values()) for x in own], pa.list_(pa.int64()))], ["p", "n"])

    toxic = [dict(zip(r["p"], r["n"])) for r in sample.where("toxic > 0").mapInArrow(hits, "p array<string>, n array<long>").collect()]
    stems = covering_stems(stats, toxic, least)
    first = Lexicon(stems)

    def weigh(batches):
        import pyarrow as pa

        signs, seen = first.signs(), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                seen[round(math.log1p(evidence(text, first, signs)), 2), int(toxic > 0)] += 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.float64()), pa.array([k[1] for k in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())], ["x", "y", "n"])

    points = sample.mapInArrow(weigh, "x double, y long, n long").groupBy("x", "y").agg(F.sum("n").alias("n")).collect()
    return Lexicon(stems, *fit_logistic([tuple(p) for p in sorted(points)])) if points else Lexicon()


def score_toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score (0 to 1), predicted (score >= 0.5).

    Null and empty texts get the score of no evidence.  Repeated rows give
    repeated results, a null doc_id stays null, other columns are ignored.
    """

    def run(batches):
        import pyarrow as pa

        signs = lexicon.signs()
        for batch in batches:
            s = [score_of(evidence(x, lexicon, signs), lexicon) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], ["doc_id", "score", "predicted"])

    return texts(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows whose text scores under 0.5, with all their columns; null text scores as empty."""

    @F.pandas_udf("boolean")
    def clean(col):
        signs = lexicon.signs()
        return col.map(lambda x: score_of(evidence(x or "", lexicon, signs), lexicon) < 0.5)

    return docs.where(clean("text"))
