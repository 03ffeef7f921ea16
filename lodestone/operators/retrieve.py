"""The retrieve stage: lists to passages in one plan, for any number of queries.

lists:  query_id, list_no, kind (vector or bm25), list_query, weight, doc_id, score
chunks: doc_id, url, source, domain, chunk_index, title, text, published_at, prior
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import settled
from ..functions.text import recency_boost
from ..functions.urls import canonical_url
from . import fusion, greedy, selection


@dataclass(frozen=True)
class RetrieveOptions:
    """Defaults of a query over a few pages; now: time that ages count from (None: no recency boost)."""

    top_k: int = 12
    per_source: int = 3
    per_domain: int = 5
    fusion: str = "rsf"
    relative: float = 0.6
    lexical_relative: float = 0.3
    near_copies: float = 0.9
    primary_boost: float = 1.15
    recency_weight: float = 0.3
    half_life_days: float = 180.0
    now: str | None = None
    autocut: int = 0
    merge: bool = True


def candidates(lists: DataFrame, sources: DataFrame, opts: RetrieveOptions) -> DataFrame:
    """Each list capped by source and in length, ranked anew; sources: doc_id, source."""
    cap, k = max(2 * opts.per_source, 6), max(4 * opts.top_k, opts.top_k + 10)
    rows = lists.join(sources, "doc_id")
    order = [F.desc("score"), F.col("doc_id")]
    own = Window.partitionBy("query_id", "list_no", "source").orderBy(*order)
    rows = rows.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= cap)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "list_no").orderBy(*order))).where(F.col("rank") <= k).drop("_n", "source")


def best_scores(lists: DataFrame) -> DataFrame:
    """(query_id, doc_id, cosine, bm25, relative, matched): best of each kind over the lists, bm25 relative to its list's best, and the lists' queries."""
    top = F.max("score").over(fusion.each_list())
    rows = lists.withColumn("_rel", F.when((F.col("kind") == "bm25") & (top > 0), F.col("score") / top))
    return rows.groupBy("query_id", "doc_id").agg(
        F.max(F.when(F.col("kind") == "vector", F.col("score"))).alias("cosine"), F.max(F.when(F.col("kind") == "bm25", F.col("score"))).alias("bm25"),
        F.max("_rel").alias("relative"), F.array_sort(F.collect_set("list_query")).alias("matched"),
    )


def cut(rows: DataFrame, opts: RetrieveOptions) -> DataFrame:
    """Candidates whose cosine is far below the best go; in queries without vectors those whose lexical share is."""
    top = F.max("cosine").over(Window.partitionBy("query_id"))
    keep = F.when(top.isNotNull(), F.col("cosine").isNull() | (F.col("cosine") >= opts.relative * top)).otherwise(F.coalesce("relative", F.lit(0.0)) >= opts.lexical_relative)
    return rows.withColumn("_keep", keep).where("_keep").drop("_keep")


def boosted(rows: DataFrame, opts: RetrieveOptions, primary: Column | None = None) -> DataFrame:
    """fused times source prior, primary source and recency; `multipliers` has what was applied."""
    age = (F.unix_timestamp(F.lit(opts.now).cast("timestamp")) - F.unix_timestamp(F.col("published_at").cast("timestamp"))) / 86400.0 if opts.now else F.lit(None).cast("double")
    parts = {"prior": F.coalesce("prior", F.lit(1.0)), "primary": F.when(F.coalesce(primary if primary is not None else F.lit(False), F.lit(False)), opts.primary_boost).otherwise(1.0), "recency": recency_boost(age, opts.half_life_days, opts.recency_weight)}
    out = rows.withColumn("multipliers", F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), v)]))
    return out.withColumn("fused", F.col("fused") * F.aggregate(F.map_values("multipliers"), F.lit(1.0), lambda a, b: a * b))


def aspect_relevance(lists: DataFrame) -> DataFrame:
    """(query_id, aspect, doc_id, relevance): per list query the best min-max score over its lists."""
    rows = lists.withColumn("_r", fusion.minmax(F.col("score")))
    return rows.groupBy("query_id", F.col("list_query").alias("aspect"), "doc_id").agg(F.max("_r").alias("relevance"))


def aspect_coverage(passages: DataFrame) -> DataFrame:
    """(query_id, aspect, passages): passages that each of a query's list queries matched; passages (query_id, matched)."""
    return passages.select("query_id", F.explode("matched").alias("aspect")).groupBy("query_id", "aspect").agg(F.count("*").alias("passages"))


def final_cut(rows: DataFrame, opts: RetrieveOptions, by: str = "fused") -> DataFrame:
    """The best top_k by `by`; score = .9 of its min-max share plus .1, four digits; index from 1; autocut if asked for."""
    order = Window.partitionBy("query_id").orderBy(F.desc(by), "doc_id")
    top = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= opts.top_k)
    share = fusion.minmax(F.col(by), Window.partitionBy("query_id"))
    out = top.withColumn("score", F.round(0.9 * share + 0.1, 4))
    out = selection.autocut(out, opts.autocut) if opts.autocut else out
    return out.withColumn("index", F.col("rank").cast("int")).drop("rank")


def retrieve(lists: DataFrame, chunks: DataFrame, opts: RetrieveOptions = RetrieveOptions(), primary: Column | None = None) -> DataFrame:
    """Passages (query_id, index, doc_id, url, title, text, score, fused, cosine, bm25, matched, multipliers, parts, ...) of all queries.

    Cap, fuse, cut, drop near copies, boost, diversify, demote domains, merge
    neighbours, cut.  Each query is ranked in its own windows; only pools of at
    most max(2 * top_k, 50) rows go to Python, for near copies and merging.
    """
    kept = settled(candidates(lists, chunks.select("doc_id", "source"), opts))
    fused = fusion.fuse(kept, opts.fusion).join(best_scores(kept), ["query_id", "doc_id"])
    pool = cut(fused.join(chunks, "doc_id"), opts)
    pool = boosted(pool, opts, primary)
    pool = selection.diversify_by_source(pool, opts.per_source, max(2 * opts.top_k, 50), "fused").drop("rank")
    pool = greedy.drop_near_copies(pool.withColumn("score", F.col("fused")), opts.near_copies).drop("score")
    ranked = pool.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("fused"), "doc_id")))
    ranked = settled(selection.demote_domains(ranked, opts.per_domain).where(F.col("new_rank") <= opts.top_k))
    if opts.merge:
        merged = greedy.merge_adjacent(ranked.select("query_id", "url", "chunk_index", "text", F.col("fused").alias("score")))
        first = merged.select("query_id", "url", F.col("first").alias("chunk_index"), F.col("text").alias("_text"), F.col("score").alias("_fused"), "parts")
        ranked = ranked.join(first, ["query_id", "url", "chunk_index"]).withColumn("text", F.col("_text")).withColumn("fused", F.col("_fused")).drop("_text", "_fused")
    else:
        ranked = ranked.withColumn("parts", F.lit(1))
    return final_cut(ranked.drop("rank", "new_rank"), opts)


def passages_by_source(sources: DataFrame, passages: DataFrame) -> DataFrame:
    """sources (url) with the indices, ascending, and the best score of the passages (url, index, score) cut from them, by canonical URL.

    Sources without a passage keep an empty array and a null score; passages of no source are left out.
    """
    found = passages.groupBy(canonical_url(F.col("url")).alias("_canonical")).agg(F.sort_array(F.collect_list("index")).alias("passage_indices"), F.max("score").alias("best_score"))
    joined = sources.withColumn("_canonical", canonical_url(F.col("url"))).join(found, "_canonical", "left").drop("_canonical")
    return joined.withColumn("passage_indices", F.coalesce("passage_indices", F.array().cast("array<int>")))
