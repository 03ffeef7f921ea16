"""Mixture-controlled packing by deficit round-robin over source queues.

The tokens of each source form a queue, and queues have weights.  Every window of
1024 tokens is filled to their proportions: a queue earns its share with each
window and is served a grain at least when it is owed most; what it was served
too much or too little carries into the next window.

Parts of WINDOWS windows are packed apart.  Token j of a queue of weight w falls
due at (j + 1/2) / w; the order of all tokens by their due times (ties by queue)
is a mixture that is right at every point, and its run p of 1024 * WINDOWS tokens
is part p.  A token's rank in that order is a sum over queues of exact integers,
so any task can tell where a document's tokens belong, all windows but the last
are full, and a part starts with the fractions of a token that its queues are
owed by the parts before it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import texts, written
from .token_files import crc32_of
from .tokens import encoded, id_type, unpacked, vocabulary_path

WIDTH = 1024
#: Windows of a part: about two million tokens, packed in one task.
WINDOWS = 2048
#: Least tokens for which a queue is served while others can fill the window.
GRAIN = 512
#: Sources with less than this share of all tokens and no target of their own form one queue.
LEAST_SHARE = 1 / (1 << 16)
#: Pairs of task and source up to which their places are broadcast; beyond, they are joined by a shuffle.
BROADCAST_PAIRS = 100_000
#: Numbers that ranks are worked out on at once.
CELLS = 1 << 20


@dataclass(frozen=True)
class Plan:
    """Sizes and integer weights of the queues; late queues come behind all others."""

    sizes: np.ndarray
    weights: np.ndarray
    late: np.ndarray
    part_tokens: int

    @staticmethod
    def of(sizes: list[int], shares: list[float], part_tokens: int) -> Plan:
        """shares: target proportions; queues of share 0 are late and stand among themselves by size."""
        n, own = np.array(sizes, np.int64), np.array(shares, np.float64)
        late = own <= 0
        # a weight times twice a place stays below 2^62
        top = 1 << min(24, 60 - int(n.max(initial=1)).bit_length())
        weights = np.ones(len(n), np.int64)
        for tier in (late, ~late):
            x = np.where(late, n, own)[tier]
            weights[tier] = np.maximum(1, np.round(x / max(x.max(initial=0), 1e-300) * top))
        return Plan(n, weights, late, part_tokens)

    def rank(self, queue: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Place of token `at` of each queue in the order of all tokens."""
        out = np.zeros(len(at), np.int64)
        for tier in (False, True):
            group, rows = np.flatnonzero(self.late == tier), np.flatnonzero(self.late[queue] == tier)
            sizes, weights = self.sizes[group], self.weights[group]
            step = max(1, CELLS // max(1, len(group)))
            for k in range(0, len(rows), step):
                own = rows[k : k + step]
                q = queue[own][:, None]
                w, due = self.weights[q], (2 * at[own][:, None] + 1) * weights
                # tokens that fall due before it, and in queues ahead of its own those that do so with it
                n = np.where(group < q, (due + w) // (2 * w), -((w - due) // (2 * w)))
                out[own] = np.clip(n, 0, sizes).sum(axis=1)
            if tier:
                out[rows] += int(self.sizes[~self.late].sum())
        return out

    def pieces(self, queue: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of documents of n tokens at places `at` of their queues, in order: (document, part, first token, end) of each piece."""
        if not len(at):
            return at, at, at, at
        low, high = (self.rank(queue, x) // self.part_tokens for x in (at, at + n - 1))
        count = high - low + 1
        row = np.repeat(np.arange(len(at)), count)
        part = np.arange(len(row)) - np.repeat(np.cumsum(count) - count - low, count)
        # the first token whose rank lies in the part or beyond, by halving
        begin, end = np.zeros(len(row), np.int64), np.where(part > low[row], n[row], 0)
        while len(todo := np.flatnonzero(begin < end)):
            mid = (begin[todo] + end[todo]) // 2
            beyond = self.rank(queue[row[todo]], at[row[todo]] + mid) // self.part_tokens >= part[todo]
            end[todo[beyond]], begin[todo[~beyond]] = mid[beyond], mid[~beyond] + 1
        stop = np.append(begin[1:], 0)
        final = np.append(row[1:] != row[:-1], True)
        stop[final] = n[row[final]]
        full = stop > begin
        return row[full], part[full], begin[full], stop[full]

    def owed(self, first: dict[int, int]) -> dict[int, float]:
        """What the queues of a part have earned and not been served before it; first: the place of each one's first token."""
        out = dict.fromkeys(first, 0.0)
        for tier in (False, True):
            own = [q for q in first if self.late[q] == tier]
            now = min(((first[q] + 0.5) / self.weights[q] for q in own), default=0.0)
            out |= {q: float(now * self.weights[q] - first[q]) for q in own}
        return out

    def rates(self) -> np.ndarray:
        """Weights by which windows are filled: late queues wait until the others are served."""
        return np.where(self.late, 1e-9, 1.0) * self.weights


def queues_of(large: list[tuple[str, int]], whole: int) -> tuple[dict[str, int], int, list[int]]:
    """(queue by source, queue of all other sources, tokens by queue)."""
    order = sorted(large)
    sizes = [n for _, n in order]
    return {s: i for i, (s, _) in enumerate(order)}, len(order), [*sizes, whole - sum(sizes)]


def queued(docs: DataFrame, path: str) -> DataFrame:
    """Tokenized rows with their task, and the tokens of their source ahead of them in it."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        part, ahead = TaskContext.get().partitionId(), {}
        for own, ids in encoded(batches, path):
            before = []
            for s, x in zip(own.column("source").to_pylist(), ids):
                before.append(ahead.get(s, 0))
                ahead[s] = before[-1] + len(x)
            yield pa.RecordBatch.from_arrays(
                [own.column("doc_id"), own.column("source"), pa.array([part] * own.num_rows, pa.int32()), pa.array(before, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([pack(x.data) for x in ids], pa.binary())],
                ["doc_id", "source", "task", "before", "n_tokens", "ids"],
            )

    rows = texts(docs, F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"))
    return rows.mapInArrow(run, "doc_id long, source string, task int, before long, n_tokens long, ids binary")


class Queue:
    """Pieces of one source within a part, served from the front."""

    def __init__(self):
        self.pieces: list[list] = []
        self.at = self.left = 0

    def add(self, doc_id, start, doc_tokens, ids):
        self.pieces.append([doc_id, start, doc_tokens, ids])
        self.left += len(ids)

    def serve(self, n: int):
        """The next n tokens as (doc_id, start, doc_tokens, ids)."""
        self.left -= n
        while n:
            piece = self.pieces[self.at]
            ids = piece[3]
            yield piece[0], piece[1], piece[2], ids[:n]
            if len(ids) <= n:
                n -= len(ids)
                self.pieces[self.at] = None
                self.at += 1
            else:
                piece[1] += n
                piece[3] = ids[n:]
                n = 0


def fill(queues: dict[int, Queue], owed: dict[int, float], rates: np.ndarray, first: int, grain: int = GRAIN):
    """Windows from the queues of one part: (sequence_id, offset, queue, doc_id, start, doc_tokens, ids).

    owed: deficit of each queue at the start; rates: its weight.  A window takes from the queue that is owed most,
    at least a grain while it has one; deficits carry on.
    """
    names = [q for q in sorted(queues) if queues[q].left]
    weight = rates[names].astype(np.float64)
    left = np.array([queues[q].left for q in names], np.int64)
    deficit = np.array([owed[q] for q in names])
    window = first
    while left.any():
        room, offset = WIDTH, 0
        deficit += WIDTH * weight / weight.sum()
        while room and left.any():
            i = int(np.argmax(np.where(left > 0, deficit, -np.inf)))
            n = int(min(room, left[i], max(grain, int(deficit[i]))))
            deficit[i] -= n
            left[i] -= n
            for doc_id, start, doc_tokens, ids in queues[names[i]].serve(n):
                yield window, offset, names[i], doc_id, start, doc_tokens, ids
                offset += len(ids)
            room -= n
            if not left[i]:
                weight[i] = 0
        window += 1


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
FIELDS = [x.split()[0] for x in PIECE.split(", ")]


def pack(docs: DataFrame, targets: dict[str, float] | None = None, tokenizer_path: str | None = None, windows: int = WINDOWS) -> DataFrame:
    """One row for each piece of a document in a sequence of at most 1024 tokens.

    targets: weights by source.  From the first sequence on the sources stand in
    these proportions; a source that runs dry leaves its share to the rest, and
    sources without a weight come behind all others.  By default a source's
    weight is its tokens, so that all queues end together; sources of less than
    LEAST_SHARE then form one queue, which has their weight.  Only the last
    sequence may need padding.

    Null text is empty (its end id is packed), a null source counts as the
    source "", repeated rows are packed each, a null doc_id stays null, an empty
    table gives no rows, other columns are ignored.
    """
    path = tokenizer_path or vocabulary_path()
    rows = written(queued(docs, path))
    sums = rows.groupBy("task", "source").agg(F.sum("n_tokens").alias("n"))
    totals = sums.groupBy("source").agg(F.sum("n").alias("n"))
    whole, pairs = sums.agg(F.sum("n"), F.count("*")).first()
    if not pairs:
        return docs.sparkSession.createDataFrame([], PIECE)
    # 1 / LEAST_SHARE rows and the targets at most come to the driver
    named_rows = totals.where((F.col("n") >= LEAST_SHARE * whole) | F.col("source").isin(list(targets or {})))
    names, other, sizes = queues_of([(r["source"], r["n"]) for r in named_rows.collect()], whole)
    shares = [float(x) for x in sizes]
    if targets:
        shares = [max(0.0, float(targets.get(s, 0.0))) for s in names] + [0.0]
    plan = Plan.of(sizes, shares, WIDTH * windows)
    rates = plan.rates()
    # where the rows of a task and source start in their queue: other tasks, then other sources of the task
    named = docs.sparkSession.createDataFrame([(s, q) for s, q in names.items()], "source string, queue int")
    marked = sums.join(F.broadcast(named), "source", "left").select("task", "source", "n", F.coalesce("queue", F.lit(other)).alias("queue"))
    tasks = marked.groupBy("queue", "task").agg(F.sum("n").alias("m"))
    tasks = tasks.select("queue", "task", (F.sum("m").over(Window.partitionBy("queue").orderBy("task")) - F.col("m")).alias("base"))
    inner = F.sum("n").over(Window.partitionBy("queue", "task").orderBy("source")) - F.col("n")
    places = marked.withColumn("inner", inner).join(tasks, ["queue", "task"]).select("task", "source", "queue", (F.col("base") + F.col("inner")).alias("ahead"))
    if pairs <= BROADCAST_PAIRS:
        places = F.broadcast(places)

    def deal(batches):
        import pyarrow as pa
        import zstandard

        small, kind = zstandard.ZstdCompressor(level=1).compress, id_type(path)
        for batch in batches:
            queue, ahead, before, n = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("queue", "ahead", "before", "n_tokens"))
            row, part, first, stop = plan.pieces(queue, ahead + before, n)
            data, own = batch.column("ids"), []
            for r, a, b in zip(row.tolist(), first.tolist(), stop.tolist()):
                ids = data[r].as_py()
                own.append(ids if b - a == n[r] else small(unpacked(ids, kind)[a:b].tobytes()))
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array(queue[row], pa.int32()), pa.array((ahead + before)[row] + first), batch.column("doc_id").take(at), pa.array(first), pa.array(n[row]), batch.column("source").take(at), pa.array(own, pa.binary())],
                ["part", "queue", "place", "doc_id", "start", "doc_tokens", "source", "ids"],
            )

    def run(batches):
        import pyarrow as pa

        kind = id_type(path)

        def packed(p, queues, firsts):
            pieces = [(doc[0], start, len(ids), crc32_of(ids), n, window, offset, doc[1]) for window, offset, q, doc, start, n, ids in fill(queues, plan.owed(firsts), rates, p * windows)]
            cols = list(zip(*pieces))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if f == "source" else pa.int64()) for c, f in zip(cols, FIELDS)], FIELDS)

        now, queues, firsts = None, {}, {}
        for batch in batches:
            for p, q, place, doc_id, start, n, source, data in zip(*(batch.column(c).to_pylist() for c in ("part", "queue", "place", "doc_id", "start", "doc_tokens", "source", "ids"))):
                if p != now:
                    if queues:
                        yield packed(now, queues, firsts)
                    now, queues, firsts = p, {}, {}
                firsts.setdefault(q, place)
                queues.setdefault(q, Queue()).add((doc_id, source), start, n, unpacked(data, kind))
        if queues:
            yield packed(now, queues, firsts)

    dealt = rows.join(places, ["task", "source"]).select("queue", "ahead", "before", "n_tokens", "doc_id", "source", "ids").mapInArrow(deal, "part long, queue int, place long, doc_id long, start long, doc_tokens long, source string, ids binary")
    return dealt.repartition("part").sortWithinPartitions("part", "queue", "place").mapInArrow(run, PIECE)
