"""Greedy selectors over one query's pool; a pool is at most a few hundred rows by construction."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import HELD, ship
from ..functions.text import tokenize


def word_shingles(text: str, n: int = 5) -> set:
    w = [x for x in _split(text) if x]
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def _split(text: str) -> list[str]:
    import re

    return re.split(r"[^a-z0-9_]+", text.lower())


def set_jaccard(a: set, b: set) -> float:
    if not a and not b:
        return 1.0
    return len(a & b) / len(a | b)


def mmr_order(relevance: np.ndarray, similarity: np.ndarray, k: int, trade: float = 0.7) -> list[int]:
    """Indexes in the order of maximal marginal relevance; the input order if all fit or trade is 1."""
    n = len(relevance)
    if n <= k or trade >= 1:
        return list(range(n))[:k] if n > k else list(range(n))
    chosen, left = [], list(range(n))
    most = np.full(n, 0.0)
    while left and len(chosen) < k:
        values = [trade * relevance[i] - (1 - trade) * (most[i] if chosen else 0.0) for i in left]
        best = left[int(np.argmax(values))]
        chosen.append(best)
        left.remove(best)
        most = np.maximum(most, similarity[best]) if len(chosen) > 1 else similarity[best].copy()
    return chosen


def xquad_order(relevance: np.ndarray, aspects: list[tuple[float, np.ndarray]], k: int, trade: float = 0.5) -> list[int]:
    """Explicit aspect diversification: (1 - trade) relevance + trade * uncovered aspect relevance."""
    total = sum(w for w, _ in aspects) or 1.0
    open_ = [np.float64(1.0)] * len(aspects)
    chosen, left = [], list(range(len(relevance)))
    while left and len(chosen) < k:
        values = [(1 - trade) * relevance[i] + trade * sum(w / total * r[i] * o for (w, r), o in zip(aspects, open_)) for i in left]
        best = left[int(np.argmax(values))]
        chosen.append(best)
        left.remove(best)
        open_ = [o * (1 - r[best]) for (_, r), o in zip(aspects, open_)]
    return chosen


def mmr(pool: DataFrame, k: int, trade: float = 0.7) -> DataFrame:
    """pool (query_id, doc_id, score, vector) -> (query_id, doc_id, position)."""

    ship()

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["score", "doc_id"], ascending=[False, True]).reset_index(drop=True)
        v = np.array(g["vector"].tolist(), dtype=np.float64)
        order = mmr_order(g["score"].to_numpy(), v @ v.T, k, trade)
        return pd.DataFrame({"query_id": g["query_id"].iloc[0], "doc_id": g["doc_id"].iloc[order].to_numpy(), "position": np.arange(1, len(order) + 1)})

    kind = dict(pool.dtypes)
    return pool.groupBy("query_id").applyInPandas(run, f"query_id {kind['query_id']}, doc_id {kind['doc_id']}, position int")


def xquad(pool: DataFrame, k: int, trade: float = 0.5) -> DataFrame:
    """pool (query_id, doc_id, score, aspects array<double>) with equal weights -> (query_id, doc_id, position)."""

    ship()

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["score", "doc_id"], ascending=[False, True]).reset_index(drop=True)
        a = np.array(g["aspects"].tolist(), dtype=np.float64).T
        order = xquad_order(g["score"].to_numpy(), [(1.0, x) for x in a], k, trade)
        return pd.DataFrame({"query_id": g["query_id"].iloc[0], "doc_id": g["doc_id"].iloc[order].to_numpy(), "position": np.arange(1, len(order) + 1)})

    kind = dict(pool.dtypes)
    return pool.groupBy("query_id").applyInPandas(run, f"query_id {kind['query_id']}, doc_id {kind['doc_id']}, position int")


def pack_budget(passages: DataFrame, budget: int | None = None) -> DataFrame:
    """passages (query_id, doc_id, source, score, tokens, rank[, budget]): those that fit a token budget, one for all or a column.

    All if they fit; else the first one, the best of each source, then by score
    for each token, each if there is room for it; the original order stays.
    """
    ship()

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["rank", "doc_id"]).reset_index(drop=True)
        room = int(g["budget"].iloc[0]) if budget is None else budget
        if g["tokens"].sum() <= room:
            return g
        best = g.sort_values(["score", "rank"], ascending=[False, True])
        value = (g["score"] / g["tokens"].clip(lower=1)).sort_values(ascending=False, kind="stable")
        order = dict.fromkeys([0, *best.drop_duplicates("source").index, *value.index])
        taken, used = [], 0
        for i in order:
            if used + g["tokens"][i] <= room:
                taken.append(i)
                used += int(g["tokens"][i])
        return g.loc[sorted(taken)]

    return passages.groupBy("query_id").applyInPandas(run, passages.schema)


def join_adjacent(a: str, b: str, a_end: int | None = None, b_start: int | None = None) -> str:
    """Two neighbours as one text: their overlap once, by offsets if texts agree, else by the longest shared end and beginning."""
    if a_end is not None and b_start is not None and 0 < a_end - b_start <= min(len(a), len(b)) and a.endswith(b[: a_end - b_start]):
        return a + b[a_end - b_start :]
    n = shared_end(a, b)
    return a + b[n:] if n else f"{a}\n\n{b}"


#: Characters of an overlap at most, and at least.
OVERLAP, LEAST_OVERLAP = 2000, 20


def shared_end(a: str, b: str) -> int:
    """Length of the longest end of a that b begins with, within OVERLAP; 0 if shorter than LEAST_OVERLAP."""
    most = min(len(a), len(b), OVERLAP)
    tail, head = a[len(a) - most :], b[:LEAST_OVERLAP]
    at = tail.find(head) if most >= LEAST_OVERLAP else -1
    while at >= 0 and not b.startswith(tail[at:]):
        at = tail.find(head, at + 1)
    return most - at if at >= 0 else 0


def merge_adjacent(chunks: DataFrame) -> DataFrame:
    """chunks (query_id, url, chunk_index, text, score): neighbours of a url as one passage with the best score.

    Chunks come sorted, whatever their query, so a task merges them in one pass and holds one passage.
    """

    ship()
    kind = dict(chunks.dtypes)
    rows = chunks.select("query_id", F.col("url").cast("string"), F.col("chunk_index").cast("int"), F.coalesce("text", F.lit("")).alias("text"), F.col("score").cast("double"))

    def run(batches):
        import pyarrow as pa

        names = ["query_id", "url", "first", "last", "text", "score", "parts"]
        last, end, out, held = None, "", [], 0

        def made():
            kinds = [of_query, pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(["".join(r[n]) if n == "text" else r[n] for r in out], k) for n, k in zip(names, kinds)], names)

        for batch in batches:
            of_query = batch.schema.field("query_id").type
            for row in range(batch.num_rows):
                q, url, index, text, score = (batch.column(i)[row].as_py() for i in range(5))
                if last is not None and (q, url) == (last["query_id"], last["url"]) and index == last["last"] + 1:
                    n = shared_end(end, text)
                    more = text[n:] if n else f"\n\n{text}"
                    last["text"].append(more)
                    last |= {"last": index, "score": max((x for x in (last["score"], score) if x is not None), default=None), "parts": last["parts"] + 1}
                    end = (end + more)[-OVERLAP:]
                else:
                    if held > HELD:
                        yield made()
                        out, held = [], 0
                    more, end = text, text[-OVERLAP:]
                    last = {"query_id": q, "url": url, "first": index, "last": index, "text": [text], "score": score, "parts": 1}
                    out.append(last)
                held += len(more)
        if out:
            yield made()

    ordered = rows.repartition("query_id", "url").sortWithinPartitions("query_id", "url", "chunk_index")
    return ordered.mapInArrow(run, f"query_id {kind['query_id']}, url string, first int, last int, text string, score double, parts int")


def drop_near_copies(pool: DataFrame, threshold: float = 0.9) -> DataFrame:
    """pool (query_id, doc_id, text, score): in score order, those not alike to one kept before."""

    ship()

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["score", "doc_id"], ascending=[False, True])
        kept, seen, out = [], set(), []
        for i, text in zip(g.index, g["text"]):
            key = " ".join((text or "").lower().split())
            if key in seen:
                continue
            s, n = word_shingles(text or ""), len(text or "")
            if any(min(n, m) * 2 >= max(n, m) and set_jaccard(s, t) >= threshold for t, m in kept):
                continue
            seen.add(key)
            kept.append((s, n))
            out.append(i)
        return g.loc[out]

    return pool.groupBy("query_id").applyInPandas(run, pool.schema)


def rerank(pool: DataFrame, fn=None, top: int = 50) -> DataFrame:
    """The first `top` of a pool by fn(query, text), the rest behind in its old order; by default shared query terms."""

    def overlap(query: str, text: str) -> float:
        q = set(tokenize(query))
        return len(q & set(tokenize(text))) / len(q) if q else 0.0

    score = fn or overlap

    ship()

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["rank", "doc_id"]).reset_index(drop=True)
        head, tail = g.head(top).copy(), g.iloc[top:]
        head["_s"] = [score(q, t) for q, t in zip(head["query"], head["text"])]
        out = pd.concat([head.sort_values("_s", ascending=False, kind="stable").drop(columns="_s"), tail])
        out["rank"] = np.arange(1, len(out) + 1)
        return out

    return pool.groupBy("query_id").applyInPandas(run, pool.schema)
