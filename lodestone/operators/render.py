"""Passages as Markdown: quoted bodies, citations, budgets, sources and follow-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import approx_tokens
from ..functions.urls import host_of, page_url, text_fragment_url
from . import greedy

CODE = "(?s)```.*?```|~~~.*?~~~|`[^`\\n]*`"
IMAGE = "!\\[[ \\t]*([^\\]]*?)[ \\t]*\\]\\([^)]*\\)"
LINK = '\\[([^\\]]+)\\]\\([^) \\t-\\r]+(?:[ \\t]+"[^"]*")?\\)'


def strip_links(markdown: Column) -> Column:
    """Links become their labels, images [image: alt]; code stays as it is."""

    def prose(x: Column) -> Column:
        x = F.regexp_replace(x, IMAGE, "[image: $1]")
        return F.regexp_replace(F.replace(x, F.lit("[image: ]"), F.lit("[image: untitled]")), LINK, "$1")

    rest = F.transform(F.split(markdown, CODE), prose)
    code = F.regexp_extract_all(markdown, F.lit(CODE), F.lit(0))
    return F.array_join(F.zip_with(rest, code, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")


def trim_text(text: Column, most: Column | int) -> Column:
    """At most so many characters, cut at a space in the last two fifths if there is one, with an ellipsis."""
    n = F.lit(most) if isinstance(most, int) else most
    head = F.substring(text, F.lit(1), n + 1)
    space = F.length(head) - F.instr(F.reverse(head), " ")  # characters before the last space
    cut = F.when((F.instr(head, " ") > 0) & (space > n * 0.6), space).otherwise(n)
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.rtrim(F.substring(text, F.lit(1), cut.cast("int"))), F.lit("…")))


def citation(index: Column, title: Column, url: Column, published: Column, page: Column) -> Column:
    """[n] title — url (date)."""
    date = F.when(published.isNotNull(), F.concat(F.lit(" ("), F.substring(published, 1, 10), F.lit(")"))).otherwise("")
    return F.concat(F.lit("["), index.cast("string"), F.lit("] "), title, F.lit(" — "), page_url(url, page), date)


def render_passages(passages: DataFrame, max_chars: int = 1500, detailed: bool = True, deep_links: bool = False, highlight_only: bool = False, cards: bool = False) -> DataFrame:
    """passages (index, title, url, text, score, published_at, parts, from_snippet[, highlight, corroboration, matched]) with `rendered`.

    cards: a line with host, date, corroboration and score.  Null dates, parts
    and flags leave their mark out.
    """
    has = set(passages.columns)
    text = F.coalesce("highlight.text", "text") if highlight_only and "highlight" in has else F.col("text")
    body = strip_links(F.trim(F.regexp_replace(text, "[ \\t\\r]+\\n", "\n")))
    limit = F.when(F.coalesce(F.col("parts"), F.lit(1)) > 1, 2 * max_chars).otherwise(max_chars)
    quoted = F.concat(F.lit("> "), F.regexp_replace(trim_text(body, limit), "\\n", "\n> "))
    url = F.when(F.lit(deep_links) & ~F.col("url").rlike("(?i)\\.pdf(?:[?#]|$)"), text_fragment_url(F.col("url"), body)).otherwise(F.col("url"))
    shown = F.when(F.col("published_at").isNotNull(), F.concat(F.lit("published "), F.substring("published_at", 1, 10)))
    score = F.concat(F.lit("score "), F.format_string("%.2f", F.col("score").cast("double")))
    snippet = F.when(F.coalesce(F.col("from_snippet"), F.lit(False)), "search snippet")
    part = F.when(F.length(text) < F.length("text"), "highlight") if highlight_only and "highlight" in has else F.lit(None).cast("string")
    head = F.concat(F.lit("**["), F.col("index").cast("string"), F.lit("]** "), F.col("title"), F.lit(" — <"), url, F.lit(">"))
    if cards:
        others = F.coalesce(F.col("corroboration"), F.lit(1)) - 1 if "corroboration" in has else F.lit(0)
        agreed = F.when(others > 0, F.concat(F.lit("corroborated by "), others.cast("string"), F.lit(" other site"), F.when(others > 1, "s").otherwise("")))
        queries = F.when(F.size("matched") > 0, F.concat(F.lit('matched: "'), F.array_join(F.slice("matched", 1, 3), '", "'), F.lit('"'))) if "matched" in has else F.lit(None).cast("string")
        line = F.concat(head, F.lit(" · "), F.concat_ws(" · ", F.regexp_replace(host_of(F.col("url")), "^www\\.", ""), shown, agreed, queries, score, snippet, part))
    else:
        marks = F.concat_ws(", ", *([shown, score] if detailed else []), snippet, part)
        line = F.concat(head, F.when(marks != "", F.concat(F.lit(" ("), marks, F.lit(")"))).otherwise(""))
    return passages.withColumn("rendered", F.concat(line, F.lit("\n"), quoted))


def render_research(queries: DataFrame, passages: DataFrame, sources: DataFrame, max_tokens: int = 0, **options) -> DataFrame:
    """queries (query_id, query[, suggested]), passages (query_id, index, ...), sources (query_id, url, title, chunks, ok) -> (query_id, markdown, omitted, tokens).

    Passages are packed into what the budget leaves after head and sources (a
    tenth of it at least); what is left out is named.  A query without passages
    says so.
    """
    shown = render_passages(passages, **options)
    per = passages.groupBy("query_id", "url").agg(F.array_sort(F.collect_list("index")).alias("own"))
    listed = sources.where("ok").join(per, ["query_id", "url"], "left").withColumn("own", F.coalesce("own", F.array().cast("array<int>")))
    marks = F.when(F.size("own") > 0, F.concat(F.lit(" ["), F.array_join("own", ", "), F.lit("]"))).otherwise("")
    unread = F.col("chunks") - F.size("own")
    more = F.when((F.size("own") > 0) & (unread >= 4), F.concat(F.lit(" ("), unread.cast("string"), F.lit(" more chunks)"))).otherwise("")
    line = F.concat(F.lit("- "), "title", F.lit(" — <"), "url", F.lit(">"), marks, more)
    order = F.struct(F.coalesce(F.array_min("own"), F.lit(1 << 30)).alias("o"), "url", line.alias("line"))
    tail = listed.groupBy("query_id").agg(F.concat(F.lit("## Sources\n"), F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["line"]), "\n")).alias("sources"))
    heads = queries.join(tail, "query_id", "left").withColumn("head", F.concat(F.lit("# Research: "), "query"))
    if "suggested" in queries.columns:
        heads = heads.withColumn("tail", F.concat_ws("\n\n", "sources", F.when(F.size("suggested") > 0, F.concat(F.lit("_Suggested follow-ups: "), F.array_join("suggested", " · "), F.lit("_")))))
    else:
        heads = heads.withColumn("tail", F.coalesce("sources", F.lit("")))
    fixed = F.length("head") + F.length("tail") + 4
    costs = shown.select("query_id", F.col("index").alias("doc_id"), F.col("url").alias("source"), "score", (approx_tokens(F.col("rendered")) + 1).alias("tokens"), F.col("index").alias("rank"), "rendered")
    if max_tokens:
        room = F.greatest(F.floor(F.lit(max_tokens) * 0.1), F.lit(max_tokens) - F.ceil(fixed / 4.0) - 40)
        kept = greedy.pack_budget(costs.join(heads.select("query_id", room.cast("long").alias("budget")), "query_id"))
    else:
        kept = costs
    body = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "rendered"))).alias("k"))
    every = costs.groupBy("query_id").agg(F.array_sort(F.collect_list("rank")).alias("every"))
    rows = heads.join(body, "query_id", "left").join(every, "query_id", "left")
    rows = rows.withColumn("omitted", F.coalesce(F.array_except("every", F.transform("k", lambda x: x["rank"])), F.array().cast("array<int>")))
    n = F.size("omitted")
    span = F.when(n == 1, F.concat(F.lit("index "), F.col("omitted")[0].cast("string"))).otherwise(F.concat(F.lit("indices "), F.get("omitted", F.lit(0)).cast("string"), F.lit("–"), F.try_element_at("omitted", F.lit(-1)).cast("string")))
    note = F.when(n > 0, F.concat(F.lit("_"), n.cast("string"), F.when(n == 1, " more passage").otherwise(" more passages"), F.lit(" omitted ("), span, F.lit(")._")))
    none = F.when(F.coalesce(F.size("k"), F.lit(0)) <= 0, "_No relevant passages found._")
    text = F.concat_ws("\n\n", "head", none, F.nullif(F.array_join(F.transform("k", lambda x: x["rendered"]), "\n\n"), F.lit("")), note, F.nullif(F.col("tail"), F.lit("")))
    return rows.select("query_id", text.alias("markdown"), "omitted", F.ceil(F.length(text) / 4.0).cast("long").alias("tokens"))


def suggested_queries(used: DataFrame, most: int = 4) -> DataFrame:
    """used (query_id, query, position, asked): queries asked for a query other than itself, the first of each whatever its case."""
    rows = used.withColumn("t", F.trim("asked")).where((F.col("t") != "") & (F.lower("t") != F.lower(F.trim("query"))))
    first = rows.groupBy("query_id", F.lower("t").alias("k")).agg(F.min_by("t", "position").alias("asked"), F.min("position").alias("position"))
    w = Window.partitionBy("query_id").orderBy("position")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("query_id", "rank", "asked")


def snippet_passages(results: DataFrame, fetched: DataFrame) -> DataFrame:
    """results (query_id, url, title, snippet, rank) of queries none of whose pages was fetched, as passages that fall from 1 to .05."""
    rows = results.where(F.trim(F.coalesce("snippet", F.lit(""))) != "").join(fetched.select("query_id").distinct(), "query_id", "left_anti")
    w = Window.partitionBy("query_id")
    n, i = F.count("*").over(w), F.row_number().over(w.orderBy("rank", "url")) - 1
    return rows.select("query_id", (i + 1).alias("index"), "url", "title", F.col("snippet").alias("text"), F.greatest(F.lit(0.05), 1.0 - i / n).alias("score"), F.lit(True).alias("from_snippet"))


def result_blocks(passages: DataFrame) -> DataFrame:
    """(query_id, blocks): each passage as a JSON search-result block, in order."""
    block = F.struct(F.lit("search_result").alias("type"), F.col("url").alias("source"), "title", F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content"))
    ordered = F.array_sort(F.collect_list(F.struct("index", F.to_json(block).alias("b"))))
    return passages.groupBy("query_id").agg(F.transform(ordered, lambda x: x["b"]).alias("blocks"))
