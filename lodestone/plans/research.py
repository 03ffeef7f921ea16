"""Queries of the research side: asks, intake, retrieval stage, rendering, state; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import asks as Q
from ..functions import text as T
from ..functions import urls as U
from ..functions.common import settled
from ..operators import bm25, evidence, html, render, retrieve, selection
from ..sources import acquisition as A
from ..streaming import windows as S
from .queries import CANON, HITS_SQL, HOST, LISTS_SQL, TOKENS, hits, lexical, query, query_terms, ranked, table, two_lists, values, with_documents

# ---- asks -----------------------------------------------------------------

ASKS, ASKS_SQL = values("asks", "query_id long, query string, category string", [
    (1, 'how to fix "undefined is not a function" in v2.1.0', "docs"), (2, "why does the long plain question about nothing in particular matter", "news"), (3, "asyncio.run_in_executor error", "github"), (4, "Mount Everest And Lake Como maps", None),
    (5, "cheap pdf readers", "pdf"), (6, "transformers paper site:github.com", "github"), (7, "What is it", "research"), (8, 'a "b" "two words" "" "x y z"', "other"), (9, "ENOENT in 2023 with --force and camelCase", "docs"), (10, "   ", "news"), (11, "documentation of x", "docs"),
])


@query(f"""WITH {ASKS_SQL}, c(category, op) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in Q.CATEGORIES.items())}) SELECT query_id, CASE WHEN op IS NULL OR contains(lower(query), lower(op)) THEN query ELSE query || ' ' || op END AS query FROM asks LEFT JOIN c USING (category)""")
def category_query(spark, d):
    return ASKS(spark).select("query_id", Q.category_query(F.col("query"), F.col("category")).alias("query"))


PHRASES = "list_filter(list_transform(regexp_extract_all(query, '\"([^\"]{2,})\"', 1), lambda x: trim(x)), lambda x: len(regexp_split_to_array(x, '[ \\t-\\r]+')) >= 2)"


@query(f"WITH {ASKS_SQL} SELECT query_id, array_to_string({PHRASES}, '|') AS phrases FROM (SELECT query_id, query FROM asks UNION ALL SELECT -item_id, text FROM benchmark)")
def quoted_phrases(spark, d):
    rows = ASKS(spark).select("query_id", "query").unionByName(table(spark, d, "benchmark").select((-F.col("item_id")).alias("query_id"), F.col("text").alias("query")))
    return rows.select("query_id", F.array_join(Q.quoted_phrases(F.col("query")), "|").alias("phrases"))


FACTORS = " * ".join(f"CASE WHEN regexp_matches(q, '{p}') THEN {f!r}e0 ELSE 1e0 END" for p, f in Q.AFFINITY)


@query(f"""WITH {ASKS_SQL} SELECT query_id, round(least(2.5e0, CASE WHEN f = 1e0 AND len(w) >= 8 AND regexp_matches(q, '{Q.QUESTION}') THEN 0.75e0 ELSE f END), 6) AS affinity FROM (SELECT *, {FACTORS} * CASE WHEN len(list_filter(w[2:], lambda x: regexp_matches(x, '^[A-Z][a-z]+$'))) >= 2 THEN 1.2e0 ELSE 1e0 END AS f
 FROM (SELECT query_id, trim(query) AS q, regexp_split_to_array(trim(query), '[ \\t-\\r]+') AS w FROM (SELECT query_id, query FROM asks UNION ALL SELECT -item_id, text FROM benchmark)))""")
def lexical_affinity(spark, d):
    rows = ASKS(spark).select("query_id", "query").unionByName(table(spark, d, "benchmark").select((-F.col("item_id")).alias("query_id"), F.col("text").alias("query")))
    return rows.select("query_id", F.round(Q.lexical_affinity(F.col("query")), 6).alias("affinity"))


OBJECTIVE_STOP = ", ".join(f"'{w}'" for w in Q.OBJECTIVE_STOP)


@query(f"""WITH raw AS (SELECT item_id AS query_id, regexp_split_to_array(lower(left(text, 2000)), '[^\\p{{L}}\\p{{N}}._/:-]+') AS r FROM benchmark), e AS (SELECT query_id, regexp_replace(unnest(r), '^[._/:-]+|[._/:-]+$', '', 'g') AS word, unnest(range(len(r))) AS pos FROM raw),
 g AS (SELECT query_id, word, min(pos) AS first, count(*) AS n FROM e WHERE length(word) >= 2 AND word NOT IN ({OBJECTIVE_STOP}) GROUP BY query_id, word),
 s AS (SELECT query_id, word, first, round(n + CASE WHEN regexp_matches(word, '[0-9._/:-]') THEN 1.5e0 ELSE 0e0 END + least(length(word), 12) / 24e0, 9) AS score FROM g),
 k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS rank FROM s) SELECT query_id, string_agg(word, ' ' ORDER BY rank) AS terms FROM k WHERE rank <= 12 GROUP BY query_id""")
def objective_terms(spark, d):
    return Q.objective_terms(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("objective")))


PLAIN_SQL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\]\\([^)]*\\)', ']', 'g'), 'https?://[^ \\t-\\r]+', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\\\?\\[[0-9]+\\\\?\\]', ' ', 'g')"
STOPS = ", ".join(f"'{w}'" for w in sorted(T.STOP_WORDS))


@query(f"""SELECT doc_id, CAST(len(w) AS BIGINT) AS n, sha256(array_to_string(w, ' ')) AS words FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all({PLAIN_SQL}, '[\\p{{L}}\\p{{N}}](?:[\\p{{L}}\\p{{N}}._-]*[\\p{{L}}\\p{{N}}])?'), lambda x: lower(x)), lambda x: length(x) >= 3 AND x NOT IN ({STOPS}) AND NOT regexp_matches(x, '^[0-9]+$')) AS w FROM documents)""")
def surface_words(spark, d):
    w = table(spark, d, "documents").select("doc_id", Q.surface_words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n"), F.sha2(F.array_join("w", " "), 256).alias("words"))


@query("SELECT conv_id, min(turn) AS turn, arg_min(trim(text), turn) AS text FROM conversations WHERE trim(text) <> '' GROUP BY conv_id, lower(trim(text))")
def distinct_strings(spark, d):
    return Q.distinct_strings(table(spark, d, "conversations"), "conv_id", "text", "turn").select("conv_id", "turn", "text")


DOMAINS, DOMAINS_SQL = values("args", "id long, domains array<string>", [(1, ["Example.com", "*.x.org", "https://a.b.de/p?q"]), (2, ["bad domain", "x.org"]), (3, [".x.org", "x.org:80", "x.org"]), (4, ["localhost"]), (5, ["-a.com"])])
CLEAN_DOMAIN = "regexp_replace(regexp_replace(lower(trim(x)), '^[a-z][a-z0-9+.-]*://', ''), '^\\*?\\.|[/?#:].*$', '', 'g')"


@query(f"""WITH {DOMAINS_SQL}, h AS (SELECT id, list_transform(domains, lambda x: {CLEAN_DOMAIN}) AS h FROM args) SELECT id, CASE WHEN len(list_filter(h, lambda x: NOT regexp_matches(x, '^[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\\.[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)+$'))) = 0 THEN array_to_string(list_sort(list_distinct(h)), ',') END AS domains FROM h""")
def valid_domains(spark, d):
    return DOMAINS(spark).select("id", F.array_join(F.array_sort(Q.valid_domains(F.col("domains"))), ",").alias("domains"))


HOSTS, HOSTS_SQL = values("hosts", "id long, host string, public boolean", [(k, h, p) for k, (h, p) in enumerate([
    ("example.org", True), ("localhost", False), ("a.localhost", False), ("10.1.2.3", False), ("8.8.8.8", True), ("172.15.0.1", True), ("172.16.0.1", False), ("172.31.255.255", False), ("172.32.0.1", True), ("192.168.1.1", False), ("169.254.169.254", False), ("100.64.0.1", False),
    ("100.128.0.1", True), ("127.0.0.1", False), ("0.0.0.0", False), ("224.0.0.1", False), ("198.18.0.1", False), ("203.0.113.9", False), ("[::1]", False), ("[fe80::1]", False), ("[fd00::1]", False), ("[2606:4700::1111]", True), ("[::ffff:10.0.0.1]", False), ("printer.local", False), ("", False), ("999.1.1.1", False)])])


@query(f"WITH {HOSTS_SQL} SELECT id, public FROM hosts")
def public_hosts(spark, d):
    """Against the answers stated beside the hosts."""
    return HOSTS(spark).select("id", U.public_host(F.col("host")).alias("public"))


PRIMARY, PRIMARY_SQL = values("primary_urls", "id long, url string, query string, yes boolean", [
    (1, "https://docs.lucene.org/core/", "lucene scoring", True), (2, "https://www.duckdb.org/docs/", "DuckDB window functions", True), (3, "https://en.wikipedia.org/wiki/DuckDB", "DuckDB window functions", False), (4, "https://thetimes.com/x", "the best phones", False), (5, "https://postgresqltutorial.com/", "postgresql index", True), (6, "https://go.dev/", "go maps", False)])


@query(f"WITH {PRIMARY_SQL} SELECT id, yes FROM primary_urls")
def primary_sources(spark, d):
    """Against the answers stated beside the URLs."""
    return PRIMARY(spark).select("id", U.is_primary_for(F.col("url"), F.col("query")).alias("yes"))


# ---- intake ---------------------------------------------------------------

REPLIES, REPLIES_SQL = values("replies", "id long, content_type string, url string, head string, control string, etag string, modified string", [
    (1, "text/html; charset=utf-8", "https://x.org/", "<html>", "max-age=60", "e1", "Wed, 21 Oct 2015 07:28:00 GMT"), (2, "text/plain", "https://x.org/readme.md", "# A", "public, s-maxage=30, max-age=60", None, "yesterday"), (3, "application/pdf", "https://x.org/a", "%PDF-1.7", "no-store, max-age=5", None, None),
    (4, None, "https://x.org/b.pdf?x", "", None, None, None), (5, None, "https://x.org/", "<!DOCTYPE html><p>", "private", "e5", None), (6, "application/json", "https://x.org/a.json", "{}", "MAX-AGE=7", None, None), (7, "image/png", "https://x.org/a.png", "x", None, None, None), (8, "text/markdown", "https://x.org/", "# B", None, None, None), (9, "text/plain", "https://x.org/a.txt", "t", None, None, None)])


@query(f"""WITH {REPLIES_SQL}, b AS (SELECT *, lower(trim(regexp_extract(coalesce(content_type, ''), '^([^;]*)', 1))) AS base, lower(regexp_replace(url, '[?#].*$', '')) AS path FROM replies)
 SELECT id, CASE WHEN regexp_matches(base, '^text/(?:x-)?markdown$') OR (base = 'text/plain' AND regexp_matches(path, '\\.mdx?$')) THEN 'markdown' WHEN base = 'application/pdf' OR starts_with(head, '%PDF-') OR (base = '' AND path LIKE '%.pdf') THEN 'pdf'
 WHEN regexp_matches(base, '^(?:text/html|application/xhtml\\+xml)$') OR (base = '' AND regexp_matches(lower(head), '<(?:!doctype html|html|body)')) THEN 'html' WHEN regexp_matches(base, '^text/|json|xml|yaml') OR base = '' THEN 'text' END AS parser FROM b""")
def parser_choice(spark, d):
    return REPLIES(spark).select("id", A.parser_of(F.col("content_type"), F.col("url"), F.col("head")).alias("parser"))


@query(f"""WITH {REPLIES_SQL}, c AS (SELECT *, lower(coalesce(control, '')) AS c FROM replies) SELECT id, etag, CASE WHEN regexp_matches(modified, '^[A-Z][a-z]{{2}}, [0-9]{{2}} [A-Z][a-z]{{2}} [0-9]{{4}} [0-9:]{{8}} GMT$') THEN modified END AS last_modified,
 CASE WHEN NOT regexp_matches(c, 'no-store|no-cache|private') THEN CAST(coalesce(nullif(regexp_extract(c, 's-maxage=([0-9]+)', 1), ''), nullif(regexp_extract(c, 'max-age=([0-9]+)', 1), '')) AS BIGINT) END AS max_age_s FROM c""")
def page_validators(spark, d):
    pairs = [F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for k, c in (("cache-control", "control"), ("etag", "etag"), ("last-modified", "modified"))]
    return REPLIES(spark).select("id", A.page_validators(F.map_from_entries(F.array(*pairs))).alias("v")).select("id", "v.*")


@query(f"WITH {CANON}, seen AS (SELECT canonical FROM canon WHERE page_id % 3 = 0) SELECT page_id, canonical FROM canon WHERE canonical NOT IN (SELECT canonical FROM seen)")
def unseen_pages(spark, d):
    pages = table(spark, d, "pages")
    return A.unseen(pages.select("page_id", "url"), pages.where("page_id % 3 = 0").select("url")).select("page_id", "canonical")


@query(f"SELECT {HOST} AS host, count(*) AS entries, CAST(sum(length(html)) AS BIGINT) AS bytes, min(page_id) AS oldest, max(page_id) AS newest FROM pages GROUP BY ALL")
def cache_stats(spark, d):
    return A.cache_stats(table(spark, d, "pages").select(U.host_of(F.col("url")).alias("host"), F.length("html").cast("long").alias("bytes"), F.col("page_id").alias("fetched_at")))


@query("SELECT count(*) AS pages, coalesce(sum(length(html)), 0)::BIGINT AS bytes FROM pages")
def page_totals(spark, d):
    return table(spark, d, "pages").agg(F.count("*").alias("pages"), F.coalesce(F.sum(F.length("html").cast("long")), F.lit(0).cast("long")).alias("bytes"))


@query("SELECT doc_id, source FROM documents WHERE lang = 'en' AND source IN ('src0', 'src1', 'src2')")
def chunk_filter(spark, d):
    return table(spark, d, "documents").where((F.col("lang") == "en") & F.col("source").isin("src0", "src1", "src2")).select("doc_id", "source")


READ, READ_SQL = values("readings", "id long, r_len int, r_links double, r_code int, r_rows int, f_len int, f_links double, f_code int, f_rows int, a_len int, a_links double, a_rows int", [
    (1, None, None, None, None, 900, 0.1, 0, 0, None, None, None), (2, 900, 0.1, 0, 0, None, None, None, None, None, None, None), (3, None, None, None, None, None, None, None, None, 500, 0.1, 0), (4, 100, 0.1, 0, 0, 900, 0.1, 0, 0, None, None, None), (5, 100, 0.1, 0, 0, 900, 0.7, 0, 0, None, None, None),
    (6, 1000, 0.5, 0, 0, 1200, 0.1, 0, 0, 700, 0.1, 0), (7, 1000, 0.2, 0, 9, 900, 0.1, 0, 0, 600, 0.1, 5), (8, 1000, 0.5, 0, 0, 1200, 0.1, 0, 0, 500, 0.1, 0), (9, 300, 0.1, 0, 0, 900, 0.1, 0, 0, 200, 0.0, 0), (10, 600, 0.1, 0, 9, 900, 0.1, 2, 9, None, None, None), (11, 600, 0.1, 2, 1, 900, 0.1, 4, 4, None, None, None), (12, 600, 0.1, 2, 2, 900, 0.1, 4, 4, 1000, 0.0, 0)])


@query(f"""WITH {READ_SQL}, g AS (SELECT *, coalesce(f_len > coalesce(r_len, 0) AND f_links < 0.6, false) AS larger FROM readings),
 c AS (SELECT id, CASE WHEN r_len IS NULL AND f_len IS NULL THEN 'none' WHEN r_len IS NULL THEN 'no-article' WHEN larger AND r_len < 250 THEN 'thin-article'
 WHEN f_len IS NOT NULL AND a_len >= 250 AND a_len >= 0.6 * r_len AND a_len <= r_len AND (r_links > a_links + 0.15 OR r_rows - a_rows >= 4) THEN 'link-density' WHEN NOT larger THEN NULL WHEN r_len < 0.35 * f_len THEN 'text-recall'
 WHEN f_code >= 2 AND r_code < 0.5 * f_code THEN 'code-recall' WHEN f_rows >= 4 AND r_rows < 0.5 * f_rows THEN 'table-recall' END AS g FROM g)
 SELECT CAST(id AS BIGINT) AS id, CASE WHEN g = 'none' THEN NULL WHEN g IS NULL THEN 'reader' WHEN g = 'link-density' THEN 'boundary' ELSE 'full' END AS choice, nullif(g, 'none') AS guard FROM c""")
def reading_choice(spark, d):
    def made(c, code=True):
        parts = [F.col(f"{c}_len").alias("text_len"), F.col(f"{c}_links").alias("link_density"), F.col(f"{c}_rows").alias("table_rows")] + ([F.col(f"{c}_code").alias("code_blocks")] if code else [])
        return F.when(F.col(f"{c}_len").isNotNull(), F.struct(*parts))

    rows = READ(spark).select("id", made("r").alias("reader"), made("f").alias("full"), made("a", False).alias("boundary"))
    return html.choose_candidate(rows).select("id", "choice", "guard")


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END, event_id % 7 DESC, event_id) AS INTEGER) AS position FROM events")
def answer_order(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", (F.col("event_type") == "purchase").alias("accepted"), (F.col("event_id") % 7).alias("score"))
    return selection.order_answers(rows, "user_id", "event_id").select("event_id", "position")


# ---- retrieval stage ------------------------------------------------------

KINDS_SQL = f"WITH {LISTS_SQL}, k AS (SELECT *, CASE WHEN list_no = 0 THEN 'bm25' ELSE 'vector' END AS kind, CASE WHEN list_no = 0 THEN 'main' ELSE 'other' END AS list_query FROM lists)"


def kinds(spark, d) -> DataFrame:
    return two_lists(spark, d).withColumn("kind", F.when(F.col("list_no") == 0, "bm25").otherwise("vector")).withColumn("list_query", F.when(F.col("list_no") == 0, "main").otherwise("other"))


@query(f"""{KINDS_SQL} SELECT query_id, doc_id, max(CASE WHEN kind = 'vector' THEN score END) AS cosine, max(CASE WHEN kind = 'bm25' THEN score END) AS bm25, round(max(rel), 6) AS relative, array_to_string(list_sort(list_distinct(list(list_query))), ',') AS matched
 FROM (SELECT *, CASE WHEN kind = 'bm25' AND max(score) OVER (PARTITION BY query_id, list_no) > 0 THEN score / max(score) OVER (PARTITION BY query_id, list_no) END AS rel FROM k) GROUP BY query_id, doc_id""")
def best_scores(spark, d):
    return retrieve.best_scores(kinds(spark, d)).withColumn("relative", F.round("relative", 6)).withColumn("matched", F.array_join("matched", ","))


@query(f"""{KINDS_SQL} SELECT query_id, list_query AS aspect, doc_id, round(max(r), 6) AS relevance FROM (SELECT *, CASE WHEN max(score) OVER l = min(score) OVER l THEN 1e0 ELSE (score - min(score) OVER l) / (max(score) OVER l - min(score) OVER l) END AS r FROM k WINDOW l AS (PARTITION BY query_id, list_no)) GROUP BY ALL""")
def aspect_relevance(spark, d):
    return retrieve.aspect_relevance(kinds(spark, d)).withColumn("relevance", F.round("relevance", 6))


@query(f"{KINDS_SQL} SELECT query_id, list_query AS aspect, count(DISTINCT doc_id) AS passages FROM k GROUP BY ALL")
def aspect_coverage(spark, d):
    return retrieve.aspect_coverage(retrieve.best_scores(kinds(spark, d)))


@query(f"""WITH {HITS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS n FROM hits), t AS (SELECT * FROM r WHERE n <= 12)
 SELECT query_id, doc_id, CAST(n AS INTEGER) AS index, round(0.9e0 * CASE WHEN max(score) OVER q = min(score) OVER q THEN 1e0 ELSE (score - min(score) OVER q) / (max(score) OVER q - min(score) OVER q) END + 0.1e0, 4) AS score FROM t WINDOW q AS (PARTITION BY query_id)""")
def final_cut(spark, d):
    return retrieve.final_cut(hits(spark, d).withColumnRenamed("score", "fused"), retrieve.RetrieveOptions()).select("query_id", "doc_id", "index", "score")


@query(f"""WITH {HITS_SQL} SELECT query_id, doc_id, round(score * p * b * least(1.3e0, 1e0 + 0.3e0 * pow(0.5e0, (doc_id % 400) / 180e0)), 4) AS fused FROM (SELECT *, CASE WHEN source = 'src1' THEN 1.1e0 ELSE 1e0 END AS p, CASE WHEN source = 'src2' THEN 1.15e0 ELSE 1e0 END AS b FROM hits)""")
def boosts(spark, d):
    published = F.date_sub(F.lit("2026-01-01").cast("date"), (F.col("doc_id") % 400).cast("int")).cast("string")
    rows = hits(spark, d).withColumnRenamed("score", "fused").withColumn("prior", F.when(F.col("source") == "src1", 1.1).otherwise(1.0)).withColumn("published_at", published)
    got = retrieve.boosted(rows, retrieve.RetrieveOptions(now="2026-01-01"), F.col("source") == "src2")
    return got.select("query_id", "doc_id", F.round("fused", 4).alias("fused"))


@query(f"WITH {LISTS_SQL} SELECT DISTINCT query_id, doc_id FROM lists")
def union_of_lists(spark, d):
    return two_lists(spark, d).select("query_id", "doc_id").distinct()


@query(f"""WITH w AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents WHERE doc_id % 7 <> 3) SELECT term, count(DISTINCT doc_id) AS df FROM w GROUP BY term""")
def index_remove(spark, d):
    """Document frequencies once every seventh document has left the index."""
    docs = table(spark, d, "documents")
    posts = bm25.postings(bm25.terms_of(docs, "doc_id", T.simple_tokens(F.col("text"))))
    return bm25.without(posts, docs.where("doc_id % 7 = 3").select("doc_id")).groupBy("term").agg(F.count("*").alias("df"))


FIELDS_SQL = f"""f AS (SELECT doc_id, 'title' AS field, 2e0 AS weight, {TOKENS.replace('text', "regexp_extract(text, '^[^\\n]*')")} AS t FROM documents UNION ALL SELECT doc_id, 'body', 1e0, {TOKENS} FROM documents)"""


@query(f"""WITH {FIELDS_SQL}, q AS (SELECT item_id AS query_id, unnest(list_distinct({TOKENS})) AS term FROM benchmark), n AS (SELECT count(*)::DOUBLE AS n FROM documents), len AS (SELECT doc_id, field, weight, len(t)::DOUBLE AS len FROM f), avg AS (SELECT field, sum(len) / max(n) AS avg_len FROM len, n GROUP BY field),
 w AS (SELECT doc_id, field, unnest(t) AS term FROM f), tf AS (SELECT doc_id, field, term, count(*)::DOUBLE AS tf FROM w WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(DISTINCT doc_id)::DOUBLE AS df FROM tf GROUP BY term),
 ft AS (SELECT doc_id, term, sum(weight * tf / (1e0 - 0.75e0 + 0.75e0 * len / avg_len)) AS f FROM tf JOIN len USING (doc_id, field) JOIN avg USING (field) GROUP BY ALL),
 s AS (SELECT query_id, doc_id, sum(ln(1e0 + (n - df + 0.5e0) / (df + 0.5e0)) * (f * 2.2e0 / (f + 1.2e0) + 0.5e0)) AS score FROM q JOIN ft USING (term) JOIN df USING (term), n GROUP BY ALL)
 SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 10""")
def bm25_fields(spark, d):
    """Two fields, the first line and the whole text, the first weighing twice."""
    docs = table(spark, d, "documents").select("doc_id", T.simple_tokens(F.regexp_extract("text", "^[^\\n]*", 0)).alias("title"), T.simple_tokens(F.col("text")).alias("body"))
    return ranked(bm25.search(docs, query_terms(spark, d), 10, bm25.Bm25Options(weights={"title": 2.0})))


def stage(spark, d, opts=retrieve.RetrieveOptions()) -> DataFrame:
    """Passages of every benchmark item: BM25 with and without proximity as two lists over whole documents."""
    top = lexical(spark, d, 100, bm25.Bm25Options(proximity=0.3), bm25.Bm25Options(delta=0.0))
    main = F.col("list_no") == 0
    lists = top.select("query_id", "list_no", F.lit("bm25").alias("kind"), F.when(main, "main").otherwise("plain").alias("list_query"), F.when(main, 1.0).otherwise(0.7).alias("weight"), "doc_id", "score")
    docs = table(spark, d, "documents").join(F.broadcast(top.select("doc_id").distinct()), "doc_id", "left_semi")  # at most 200 for each item
    url = F.concat(F.lit("https://"), "source", F.lit(".example.org/"), F.col("lang"))
    chunks = docs.select("doc_id", url.alias("url"), "source", F.col("source").alias("domain"), F.col("doc_id").cast("int").alias("chunk_index"), F.substring(F.split("text", "\n")[0], 1, 60).alias("title"), "text", F.lit(None).cast("string").alias("published_at"), F.lit(1.0).alias("prior"))
    return retrieve.retrieve(lists, chunks, opts)


@query()
def retrieve_stage(spark, d):
    return stage(spark, d).select("query_id", "index", "doc_id", "url", "score", F.round("fused", 6).alias("fused"), "parts")


@query()
def render_research(spark, d):
    got = settled(stage(spark, d)).withColumn("from_snippet", F.lit(False))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.substring("text", 1, 80).alias("query"))
    sources = got.groupBy("query_id", "url").agg(F.min("title").alias("title"), F.sum("parts").cast("int").alias("chunks")).withColumn("ok", F.lit(True))
    return render.render_research(items, got, sources, max_tokens=3000)


@query()
def query_expansion(spark, d):
    found = with_documents(lexical(spark, d, 5, bm25.Bm25Options()), table(spark, d, "documents")).select("query_id", "rank", F.split("text", "\n")[0].alias("title"), F.col("text").alias("snippet"))
    return evidence.expand_queries(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), found)


@query()
def sentence_split(spark, d):
    return evidence.sentence_split(table(spark, d, "documents")).select("doc_id", "position", "start", "end", "kind")


# ---- rendering ------------------------------------------------------------


@query("SELECT page_id, '[' || page_id || '] ' || trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) || ' — ' || CASE WHEN page_id % 4 = 0 THEN regexp_replace(url, '#.*$', '') || '#page=' || page_id % 9 ELSE url END || CASE WHEN page_id % 3 = 0 THEN ' (2025-05-05)' ELSE '' END AS citation FROM pages")
def citations(spark, d):
    title = F.trim(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1))
    date, page = F.when(F.col("page_id") % 3 == 0, "2025-05-05T10:00:00Z"), F.when(F.col("page_id") % 4 == 0, F.col("page_id") % 9)
    return table(spark, d, "pages").select("page_id", render.citation(F.col("page_id"), title, F.col("url"), date, page).alias("citation"))


@query(f"WITH {CANON}, p AS (SELECT canonical, string_agg(page_id::VARCHAR, ',' ORDER BY page_id) AS passages, max(page_id % 97) AS best FROM canon GROUP BY canonical) SELECT page_id, passages, best FROM canon JOIN p USING (canonical)")
def passages_by_source(spark, d):
    pages = table(spark, d, "pages")
    passages = pages.select("url", F.col("page_id").cast("int").alias("index"), (F.col("page_id") % 97).alias("score"))
    got = retrieve.passages_by_source(pages.select("page_id", "url"), passages)
    return got.select("page_id", F.array_join("passage_indices", ",").alias("passages"), F.col("best_score").alias("best"))


@query("SELECT page_id % 10 AS query_id, CAST(row_number() OVER (PARTITION BY page_id % 10 ORDER BY page_id, url) AS INTEGER) AS index, url, round(greatest(0.05e0, 1e0 - (row_number() OVER (PARTITION BY page_id % 10 ORDER BY page_id, url) - 1) / count(*) OVER (PARTITION BY page_id % 10)::DOUBLE), 6) AS score FROM pages WHERE page_id % 10 >= 4")
def snippet_passages(spark, d):
    pages = table(spark, d, "pages").select((F.col("page_id") % 10).alias("query_id"), "url", F.lit("t").alias("title"), F.lit("a snippet").alias("snippet"), F.col("page_id").alias("rank"))
    got = render.snippet_passages(pages, pages.where("query_id < 4"))
    return got.select("query_id", "index", "url", F.round("score", 6).alias("score"))


USED, USED_SQL = values("used", "query_id long, query string, position int, asked string", [(1, "Rank fusion", 0, "rank fusion "), (1, "Rank fusion", 1, "reciprocal"), (1, "Rank fusion", 2, " RECIPROCAL"), (1, "Rank fusion", 3, "score fusion"), (1, "Rank fusion", 4, ""), (1, "Rank fusion", 5, "a"), (1, "Rank fusion", 6, "b"), (1, "Rank fusion", 7, "c"), (2, "x", 0, "x")])


@query(f"""WITH {USED_SQL}, t AS (SELECT *, trim(asked) AS t FROM used), f AS (SELECT query_id, arg_min(t, position) AS asked, min(position) AS position FROM t WHERE t <> '' AND lower(t) <> lower(trim(query)) GROUP BY query_id, lower(t)) SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY position) AS INTEGER) AS rank, asked FROM f) WHERE rank <= 4""")
def suggested_queries(spark, d):
    return render.suggested_queries(USED(spark))


@query()
def rendered_passages(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("int").alias("index"), F.split("text", "\n")[0].alias("title"), F.concat(F.lit("https://x.org/"), "doc_id").alias("url"), "text", F.lit(0.5).alias("score"), F.lit("2025-05-05").alias("published_at"), F.lit(1).alias("parts"), F.lit(False).alias("from_snippet"))
    return render.render_passages(rows, deep_links=True).select("index", "rendered")


@query("SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE rtrim(left(text, CASE WHEN strpos(left(text, 201), ' ') > 0 AND s > 120 THEN s ELSE 200 END)) || '…' END AS short FROM (SELECT doc_id, text, length(left(text, 201)) - strpos(reverse(left(text, 201)), ' ') AS s FROM documents)")
def trim_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", render.trim_text(F.col("text"), 200).alias("short"))


# ---- state ----------------------------------------------------------------


@query("SELECT e.event_id, l.leader FROM events e JOIN (SELECT user_id, event_type, ts, min(event_id) AS leader FROM events GROUP BY ALL) l USING (user_id, event_type, ts)")
def single_flight(spark, d):
    return S.single_flight(table(spark, d, "events"), ["user_id", "event_type"]).select("event_id", "leader")


@query("SELECT event_id FROM (SELECT *, max(CASE WHEN event_type = 'purchase' THEN epoch_us(ts) END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM events) WHERE p IS NULL OR epoch_us(ts) - p >= 600000000")
def cooldown(spark, d):
    return S.cooled_down(table(spark, d, "events"), F.col("event_type") == "purchase", 600).select("event_id")


@query("SELECT event_id, round(least(8000e0, greatest(500 * pow(2e0, event_id % 6) * (0.5e0 + (event_id % 10) / 10e0), CASE WHEN event_id % 4 = 0 THEN (event_id % 7) * 1000e0 ELSE 0e0 END)), 4) AS delay_ms FROM events")
def retry_delays(spark, d):
    rows = table(spark, d, "events").select("event_id", (F.col("event_id") % 6 + 1).alias("attempt"), ((F.col("event_id") % 10) / 10.0).alias("jitter"), F.when(F.col("event_id") % 4 == 0, F.col("event_id") % 7).alias("retry_after_s"))
    return S.retry_delays(rows).select("event_id", F.round("delay_ms", 4).alias("delay_ms"))


@query("WITH l AS (SELECT user_id, max(ts) AS last_used FROM events GROUP BY user_id), m AS (SELECT max(last_used) AS m FROM l) SELECT user_id FROM l, m WHERE epoch_us(m) // 1000000 - epoch_us(last_used) // 1000000 <= 86400 ORDER BY last_used DESC, user_id LIMIT 100")
def live_sessions(spark, d):
    listing = S.session_listing(table(spark, d, "events"))
    now = listing.agg(F.max("last_used")).first()[0]
    return S.live_sessions(listing, str(now), 86_400, 100).select("user_id")


@query("SELECT event_id, round(least(1.3e0, 1e0 + 0.3e0 * pow(0.5e0, greatest(0e0, (epoch_us(timestamp '2025-01-01') - epoch_us(ts)) / 86400000000e0) / 30e0)), 6) AS boost FROM events")
def recency(spark, d):
    age = (F.unix_micros(F.lit("2025-01-01").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86_400_000_000.0
    return table(spark, d, "events").select("event_id", F.round(T.recency_boost(age, 30.0), 6).alias("boost"))
