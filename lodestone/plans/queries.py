"""Queries over the driver's tables, one for each operator family, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..functions import vectors as V
from ..functions.common import let
from ..operators import bm25, chunking, duplicates, evidence, fusion, greedy, html, selection
from ..sources import acquisition as A
from ..streaming import windows as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"
HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1))"
PATH = "regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
TRACK = ", ".join(f"'{x}'" for x in U.TRACKING)
AMP = ", ".join(f"'{x}'" for x in U.AMP)


def values(name: str, schema: str, rows: list[tuple]):
    """A table given in the query itself: (its DataFrame by session, its SQL)."""

    def literal(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool) or not isinstance(x, (str, float)):
            return str(x).lower() if isinstance(x, bool) else f"[{', '.join(map(literal, x))}]" if isinstance(x, list) else str(x)
        return f"{x!r}e0" if isinstance(x, float) else "'" + x.replace("'", "''") + "'"

    columns = ", ".join(c.split()[0] for c in schema.split(", "))
    return lambda spark: spark.createDataFrame(rows, schema), f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)})"


def clean_sql(source: str) -> str:
    """SQL of clean_url over (page_id, url) of source: the cleaned URL as bare."""
    found = " ".join(f"WHEN regexp_matches(u, '{p}') AND regexp_matches(url_decode(regexp_extract(u, '[?&](?:{n})=([^&#]+)', 1)), '^https?://') THEN url_decode(regexp_extract(u, '[?&](?:{n})=([^&#]+)', 1))" for p, n in U.WRAPPERS)
    inner = f"SELECT page_id, url, url AS u FROM {source}"
    for _ in range(3):
        inner = f"SELECT page_id, url, CASE {found} ELSE u END AS u FROM ({inner})"
    out = "u"
    for p, new in U.FOLDS:
        out = f"regexp_replace({out}, '{p}', '{new.replace('$', chr(92))}', 'g')"
    return f"SELECT page_id, url, {out} AS bare FROM ({inner})"


def canon_sql(name: str, source: str) -> str:
    host = HOST.replace("(url,", "(bare,")
    port = "regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*:([0-9]+)', 1)"
    return f"""{name} AS (SELECT page_id, url, CASE WHEN scheme IN ('http', 'https') AND host <> '' THEN scheme || '://' || regexp_replace(host, '^www\\.', '') ||
  CASE WHEN port <> '' AND NOT (scheme = 'http' AND port = '80') AND NOT (scheme = 'https' AND port = '443') THEN ':' || port ELSE '' END ||
  CASE WHEN {PATH} = '' THEN '/' WHEN {PATH} <> '/' THEN regexp_replace({PATH}, '/$', '') ELSE '/' END ||
  CASE WHEN len(kept) > 0 THEN '?' || array_to_string(list_transform(kept, lambda x: x.p), '&') ELSE '' END ELSE url END AS canonical
  FROM (SELECT *, lower(regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, {host} AS host, {port} AS port,
    list_sort(list_transform(list_filter(string_split(regexp_extract(bare, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND lower(regexp_extract(p, '^([^=]*)', 1)) NOT IN ({TRACK}) AND lower(p) NOT IN ({AMP})), lambda p, i: {{'k': regexp_extract(p, '^([^=]*)', 1), 'i': i, 'p': p}})) AS kept
    FROM ({clean_sql(source)})))"""


CANON = canon_sql("canon", "pages")
DOMAIN = """CASE WHEN len(p) <= 2 THEN array_to_string(p, '.') WHEN length(p[-1]) = 2 AND p[-2] IN ('co','com','org','net','gov','edu','ac','or','ne')
  THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END"""


# ---- urls and pages -------------------------------------------------------


#: URLs for every rule that the pages table does not meet.
URLS, URLS_SQL = values("urls", "page_id long, url string", [
    (-1, "https://www.google.com/url?q=https%3A%2F%2Fen.m.wikipedia.org%2Fwiki%2FA%3Fb%3D1&sa=U"), (-2, "https://l.facebook.com/l.php?u=https%3A%2F%2Fduckduckgo.com%2Fl%2F%3Fuddg%3Dhttps%253A%252F%252Fx.org%252Fp&h=1"),
    (-3, "https://a-b.cdn.ampproject.org/c/s/x.org/story/amp/?amp=1&z=2"), (-4, "http://amp.x.org:8080/p.amp?b=2&a=2&a=1&a-b=3&utm_source=q"), (-5, "https://x.org:443/"), (-6, "http://www.X.org:80/A/B/?outputType=amp#top"),
    (-7, "mailto:a@b.org"), (-8, "no url"), (-9, "https://de.m.wikipedia.org/wiki/Z?utm_medium=m&c"), (-10, "https://www.youtube.com/redirect?q=ftp%3A%2F%2Fx.org"), (-11, "https://www.google.com/amp/s/news.org/a/"),
])


@query(f"WITH {URLS_SQL}, {canon_sql('canon', '(SELECT page_id, url FROM pages UNION ALL SELECT page_id, url FROM urls)')} SELECT page_id, canonical FROM canon")
def canonical_url(spark, d):
    rows = table(spark, d, "pages").select("page_id", "url").unionByName(URLS(spark))
    return rows.select("page_id", U.canonical_url(F.col("url")).alias("canonical"))


@query(f"WITH {URLS_SQL} SELECT page_id, CASE WHEN regexp_matches(bare, '(?i)^https?://[^/?#]+') THEN bare END AS clean FROM ({clean_sql('(SELECT page_id, url FROM pages UNION ALL SELECT page_id, url FROM urls)')})")
def normalize_url(spark, d):
    rows = table(spark, d, "pages").select("page_id", "url").unionByName(URLS(spark))
    return rows.select("page_id", U.normalize_url(F.col("url")).alias("clean"))


@query(f"SELECT page_id, host, {DOMAIN} AS domain FROM (SELECT page_id, {HOST} AS host, list_filter(string_split({HOST}, '.'), lambda x: x <> '') AS p FROM pages)")
def registrable_domain(spark, d):
    host = U.host_of(F.col("url"))
    return table(spark, d, "pages").select("page_id", host.alias("host"), U.registrable_domain(host).alias("domain"))


@query(f"SELECT page_id, url FROM pages WHERE ({HOST} = 'example.org' OR {HOST} LIKE '%.example.org' OR {HOST} = 'example.net' OR {HOST} LIKE '%.example.net') AND NOT ({HOST} = 'blog.example.org' OR {HOST} LIKE '%.blog.example.org')")
def domain_filter(spark, d):
    return A.domain_filter(table(spark, d, "pages"), ["example.org", "*.example.net"], ["blog.example.org"]).select("page_id", "url")


@query(f"WITH {CANON} SELECT canonical, min(page_id) AS rank FROM canon GROUP BY canonical")
def url_dedupe_best_rank(spark, d):
    serp = table(spark, d, "pages").select(F.lit("q").alias("query_id"), "url", F.col("page_id").alias("rank"), F.lit("").alias("title"))
    return A.best_rank(serp).select("canonical", "rank")


@query(f"""WITH {CANON}, lists AS (SELECT *, CASE WHEN page_id % 3 = 0 THEN 1e0 ELSE 0.8e0 END / (10e0 + page_id) AS part FROM canon),
 per AS (SELECT page_id % 25 AS query_id, canonical, sum(part) AS score FROM lists GROUP BY ALL)
 SELECT query_id, canonical, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, canonical) AS BIGINT) AS rank FROM per""")
def serp_merge(spark, d):
    serp = table(spark, d, "pages").select((F.col("page_id") % 25).alias("query_id"), "url", F.col("page_id").alias("rank"), F.lit("").alias("title"), F.when(F.col("page_id") % 3 == 0, 0).otherwise(1).alias("list_no"))
    return A.merge_lists(serp).select("query_id", "canonical", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("SELECT page_id, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS title, CAST(len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS BIGINT) AS n_links FROM pages")
def html_title_links(spark, d):
    return table(spark, d, "pages").select("page_id", html.title_of(F.col("html")).alias("title"), F.size(html.hrefs(F.col("html"))).cast("long").alias("n_links"))


STRIP = """trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html,
 '(?s)<(script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \\t-\\r]+', ' ', 'g'))"""
JUNK = """CAST(len(regexp_extract_all(html, '<(nav|footer|aside|form)|class="ad"')) AS BIGINT)"""


@query(f"SELECT page_id, {STRIP} AS text FROM pages")
def html_strip(spark, d):
    return table(spark, d, "pages").select("page_id", html.strip_tags(F.col("html")).alias("text"))


@query(f"SELECT page_id, {JUNK} AS junk, round({JUNK} / CAST(length(html) AS DOUBLE) * 1e3, 6) AS junk_per_k FROM pages")
def junk_density(spark, d):
    j = html.junk_count(F.col("html"))
    return table(spark, d, "pages").select("page_id", j.alias("junk"), F.round(j / F.length("html").cast("double") * 1000.0, 6).alias("junk_per_k"))


@query(f"SELECT page_id, round(ln(1e0 + length({STRIP})) - 0.3e0 * least({JUNK}, 10) + 0.05e0 * least(len(regexp_extract_all(html, '<h[1-6]')), 20), 6) AS score FROM pages")
def candidate_score(spark, d):
    text = F.length(html.strip_tags(F.col("html")))
    score = html.candidate_score(text, F.lit(0.0), html.junk_count(F.col("html")), F.regexp_count("html", F.lit("<h[1-6]")), F.lit(False), F.lit(False))
    return table(spark, d, "pages").select("page_id", F.round(score, 6).alias("score"))


@query(f"""SELECT page_id, ((html LIKE '%id="root"%' OR html LIKE '%id="app"%' OR html LIKE '%id="\\_\\_next"%' ESCAPE '\\' OR html LIKE '%id="\\_\\_nuxt"%' ESCAPE '\\' OR lower(html) LIKE '%enable javascript%') AND length({STRIP}) < 300)
 OR (length({STRIP}) < 200 AND length({STRIP}) < 0.02e0 * length(html)) AS shell FROM pages""")
def js_shell(spark, d):
    return table(spark, d, "pages").select("page_id", html.js_shell(F.col("html"), F.length(html.strip_tags(F.col("html")))).alias("shell"))


@query()
def html_extract(spark, d):
    return html.extract_pages(table(spark, d, "pages")).drop("links")


PRIORS, PRIORS_SQL = values("more", "page_id long, url string", [(-k, f"https://{h}{p}") for k, (h, p) in enumerate([("nasa.gov", "/x"), ("www.mit.edu", ""), ("arxiv.org", "/abs/1"), ("export.arxiv.org", "/"), ("en.wikipedia.org", "/wiki/A"), ("github.com", "/a/b/blob/main/readme.md"), ("github.com", "/a/b"), ("de.pinterest.com", "/p"), ("scribd.com", ""), ("notscribd.com", ""), ("www.ehow.com", "/"), ("gov", "/")], 1)])
PRIOR_SQL = " * ".join(f"CASE WHEN {'regexp_matches(path, ' if '/' in g else f'(host = {chr(39)}{g.removeprefix(chr(42) + chr(46))}{chr(39)} OR regexp_matches(host, '}'^{g.replace('.', chr(92) + '.').replace('*', '.*')}$'){'' if '/' in g else ')'} THEN {m!r}e0 ELSE 1e0 END" for g, m in A.SOURCE_PRIORS.items())


@query(f"""WITH {PRIORS_SQL} SELECT page_id, round(least(1.3e0, greatest(0.7e0, {PRIOR_SQL})), 6) AS prior FROM
 (SELECT page_id, {HOST} AS host, regexp_replace(regexp_replace(lower(url), '^[a-z]+://(www\\.)?', ''), '[?#].*$', '') AS path FROM (SELECT page_id, url FROM pages UNION ALL SELECT page_id, url FROM more))""")
def source_priors(spark, d):
    rows = table(spark, d, "pages").select("page_id", "url").unionByName(PRIORS(spark))
    return rows.select("page_id", F.round(A.source_prior(F.col("url")), 6).alias("prior"))


@query()
def fast_paths(spark, d):
    return table(spark, d, "pages").select("page_id", A.fast_path(U.clean_url(F.col("url"))).alias("fetch_url"))


# ---- text -----------------------------------------------------------------


STEM = """CASE WHEN length(t) <= 4 THEN t WHEN t LIKE '%ies' AND length(t) > 5 THEN left(t, length(t) - 3) || 'y' WHEN t LIKE '%sses' THEN left(t, length(t) - 2)
 WHEN t LIKE '%ing' AND length(t) > 6 THEN left(t, length(t) - 3) WHEN t LIKE '%ed' AND length(t) > 5 THEN left(t, length(t) - 2)
 WHEN t LIKE '%s' AND t NOT LIKE '%ss' AND t NOT LIKE '%us' AND t NOT LIKE '%is' THEN left(t, length(t) - 1) ELSE t END"""


@query(f"SELECT DISTINCT t AS token, {STEM} AS stem FROM (SELECT unnest({TOKENS}) AS t FROM benchmark)")
def light_stem(spark, d):
    t = table(spark, d, "benchmark").select(F.explode(T.simple_tokens(F.col("text"))).alias("token")).distinct()
    return t.select("token", T.light_stem(F.col("token")).alias("stem"))


@query(f"SELECT DISTINCT t AS token, {STEM} AS stem FROM (SELECT unnest({TOKENS}) AS t FROM documents)")
def light_stem_documents(spark, d):
    t = table(spark, d, "documents").select(F.explode(T.simple_tokens(F.col("text"))).alias("token")).distinct()
    return t.select("token", T.light_stem(F.col("token")).alias("stem"))


@query(f"""WITH w AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents), n AS (SELECT count(*)::DOUBLE AS n FROM documents),
 df AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM w GROUP BY term) SELECT term, df, cf, round(ln(1e0 + (n - df + 0.5e0) / (df + 0.5e0)), 6) AS idf FROM df, n""")
def tokens_df_idf(spark, d):
    docs = table(spark, d, "documents")
    terms = bm25.terms_of(docs, "doc_id", T.simple_tokens(F.col("text")))
    n = docs.count()
    stats = terms.groupBy("term", "doc_id").agg(F.count("*").alias("tf")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    return stats.select("term", "df", "cf", F.round(F.log(1.0 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"))


@query(f"SELECT 'body' AS field, sum(len({TOKENS}))::BIGINT AS total_len, round(sum(len({TOKENS}))::DOUBLE / count(*), 6) AS avg_len FROM documents")
def field_stats(spark, d):
    n = F.size(T.simple_tokens(F.col("text"))).cast("long")
    return table(spark, d, "documents").agg(F.lit("body").alias("field"), F.sum(n).alias("total_len"), F.round(F.sum(n).cast("double") / F.count("*"), 6).alias("avg_len"))


@query("SELECT doc_id, CAST(ceil(length(text) / 4e0) AS BIGINT) AS tokens FROM documents")
def approx_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", T.approx_tokens(F.col("text")).alias("tokens"))


@query("SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[ \\t-\\r]+'), lambda t: t <> '')) AS BIGINT) AS words FROM documents")
def word_count(spark, d):
    return table(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"))


@query("SELECT doc_id, left(replace(replace(to_base64(unhex(sha256(lower(trim(regexp_replace(text, '[ \\t-\\r]+', ' ', 'g')))))), '+', '-'), '/', '_'), 22) AS hash FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("hash"))


NUMBERS = "list_transform(regexp_extract_all(text, '\\b[0-9]{4}-[0-9]{2}-[0-9]{2}\\b|\\b[0-9][0-9,]*(?:\\.[0-9]+)?%?'), lambda x: replace(x, ',', ''))"
NUMBER_LIST = f"array_to_string(list_filter({NUMBERS}, lambda x, i: list_position({NUMBERS}, x) = i), ' ')"
AMOUNTS, AMOUNTS_SQL = values("amounts", "doc_id long, text string", [(-1, "up 12.5% to 1,200 on 2024-05-01 and 2023, again 12.5%"), (-2, "none"), (-3, "v1.2.3, 7, 7 and 1,234,567.89"), (-4, "x9 9x 2024-13 -5")])


@query(f"SELECT conv_id, turn, {NUMBER_LIST} AS numbers FROM conversations")
def extract_numbers(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.extract_numbers(F.col("text")), " ").alias("numbers"))


@query(f"WITH {AMOUNTS_SQL} SELECT doc_id, {NUMBER_LIST} AS numbers FROM (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, text FROM amounts)")
def extract_numbers_documents(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text").unionByName(AMOUNTS(spark))
    return rows.select("doc_id", F.array_join(T.extract_numbers(F.col("text")), " ").alias("numbers"))


@query("""SELECT doc_id, left(array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) >= 40 AND NOT regexp_matches(trim(x), '^(#|!\\[|\\||\\[)')), lambda x: trim(x)), ' '), 240) AS lead FROM documents""")
def lead_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.lead_text(F.col("text")).alias("lead"))


SCRIPTS, SCRIPTS_SQL = values("scripts", "doc_id long, text string", [(-k, x) for k, x in enumerate(["これは日本語の文章です。とても長いので判定できます。", "이것은 한국어 문장입니다 충분히 길어서 판정할 수 있습니다", "这是一个足够长的中文句子用来判断语言应该没有问题的吧", "Это русское предложение достаточной длины", "هذه جملة عربية طويلة بما يكفي للحكم عليها", "Αυτή είναι μια ελληνική πρόταση", "זהו משפט בעברית ארוך מספיק כדי לקבוע", "यह एक हिंदी वाक्य है जो काफी लंबा है और पर्याप्त", "นี่คือประโยคภาษาไทยที่ยาวพอสมควร", "short", "mostly latin words with пять here and there only"], 1)])
SHARES = [("ja", "\\x{3040}-\\x{30FF}", "0.05e0"), ("ko", "\\x{AC00}-\\x{D7AF}", "0.2e0"), ("zh", "\\x{4E00}-\\x{9FFF}", "0.2e0"), ("ru", "\\x{0400}-\\x{04FF}", "0.2e0"), ("ar", "\\x{0600}-\\x{06FF}", "0.2e0"), ("el", "\\x{0370}-\\x{03FF}", "0.2e0"), ("he", "\\x{0590}-\\x{05FF}", "0.2e0"), ("hi", "\\x{0900}-\\x{097F}", "0.2e0"), ("th", "\\x{0E00}-\\x{0E7F}", "0.2e0")]
SHARE_SQL = " ".join(f"WHEN len(regexp_extract_all(head, '[{c}]')) > {share} * letters THEN '{lang}'" for lang, c, share in SHARES)


@query(f"WITH {SCRIPTS_SQL} SELECT doc_id, CASE WHEN letters < 20 THEN NULL {SHARE_SQL} END AS script_lang FROM (SELECT doc_id, left(text, 4000) AS head, len(regexp_extract_all(left(text, 4000), '\\p{{L}}')) AS letters FROM (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, text FROM scripts))")
def lang_script_guess(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text").unionByName(SCRIPTS(spark))
    return rows.select("doc_id", T.script_language(F.col("text")).alias("script_lang"))


@query("SELECT doc_id, CAST(unnest(range(len(string_split(text, chr(10))))) AS BIGINT) AS idx, unnest(string_split(text, chr(10))) AS paragraph FROM documents")
def chunk_paragraphs(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "paragraph"))
    return rows.withColumn("idx", F.col("idx").cast("long"))


@query()
def chunk_tokens(spark, d):
    return chunking.chunk_documents(table(spark, d, "documents"))


# ---- lexical retrieval ----------------------------------------------------

QUERY_TERMS = f"""q AS (SELECT item_id AS query_id, unnest(list_distinct({TOKENS})) AS term FROM benchmark)"""
BM25_BASE = f"""WITH {QUERY_TERMS}, w AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents), n AS (SELECT count(*)::DOUBLE AS n FROM documents),
 tf AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM w GROUP BY ALL), len AS (SELECT doc_id, count(*)::DOUBLE AS len FROM w GROUP BY ALL),
 avg AS (SELECT sum(len) / max(n) AS avg_len FROM len, n), df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term), asked AS (SELECT query_id, count(*)::DOUBLE AS asked FROM q GROUP BY ALL),
 hit AS (SELECT query_id, doc_id, term, asked, tf AS n_tf, tf / (1e0 - 0.75e0 + 0.75e0 * len / avg_len) AS f, ln(1e0 + (n - df + 0.5e0) / (df + 0.5e0)) AS idf FROM q JOIN tf USING (term) JOIN len USING (doc_id) JOIN df USING (term) JOIN asked USING (query_id), avg, n)"""


def query_terms(spark, d) -> DataFrame:
    """All distinct tokens of each benchmark text."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(T.simple_tokens(F.col("text")))).alias("term"))


def lexical(spark, d, k: int, *options: bm25.Bm25Options) -> DataFrame:
    """The k best documents of every benchmark item by each of the options: one field, the whole text."""
    docs = table(spark, d, "documents").select("doc_id", T.simple_tokens(F.col("text")).alias("body"))
    return bm25.search(docs, query_terms(spark, d), k, *options)


def with_documents(top: DataFrame, docs: DataFrame) -> DataFrame:
    """top (query_id, doc_id, ...) with the columns of its documents; top has a few rows for each query and is broadcast, so documents stay where they are."""
    return docs.join(F.broadcast(top), "doc_id")


def ranked_sql(score: str, extra: str = "", k: int = 10) -> str:
    return f"""{BM25_BASE}, s AS (SELECT query_id, doc_id, {score} AS score FROM hit{extra} GROUP BY query_id, doc_id)
 SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= {k}"""


def ranked(top: DataFrame, digits: int = 6) -> DataFrame:
    return top.select("query_id", "doc_id", F.round("score", digits).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(ranked_sql("sum(idf * (f * 2.2e0 / (f + 1.2e0)))"))
def bm25_topk(spark, d):
    return ranked(lexical(spark, d, 10, bm25.Bm25Options(delta=0.0)))


@query(ranked_sql("sum(idf * (f * 2.2e0 / (f + 1.2e0) + 0.5e0))"))
def bm25_plus(spark, d):
    return ranked(lexical(spark, d, 10, bm25.Bm25Options(delta=0.5)))


@query(ranked_sql("sum(idf * (f * 2.2e0 / (f + 1.2e0) + 0.5e0)) + 0.4e0 * (count(*) / max(asked)) * count(*)"))
def bm25_coverage(spark, d):
    return ranked(lexical(spark, d, 10, bm25.Bm25Options(coverage=0.4)))


BMX = f"""{BM25_BASE}, ent AS (SELECT term, sum(-(1e0 / (1e0 + exp(-tf))) * ln(1e0 / (1e0 + exp(-tf)))) AS raw FROM tf WHERE term IN (SELECT term FROM q) GROUP BY term),
 qe AS (SELECT query_id, term, raw, CASE WHEN max(raw) OVER (PARTITION BY query_id) > 0 THEN coalesce(raw, 0e0) / max(raw) OVER (PARTITION BY query_id) ELSE 0e0 END AS e FROM q LEFT JOIN ent USING (term)),
 me AS (SELECT query_id, avg(e) AS mean_e FROM qe WHERE raw IS NOT NULL GROUP BY ALL), a AS (SELECT least(1.5e0, greatest(0.5e0, avg_len / 100e0)) AS a FROM avg),
 s AS (SELECT query_id, doc_id, sum(idf * f * (a + 1e0) / (f + a + a * mean_e)) + 1e0 / ln(1e0 + max(n)) * sum(e) * (count(*) / max(asked)) AS score FROM hit JOIN qe USING (query_id, term) JOIN me USING (query_id), a, n GROUP BY query_id, doc_id)
 SELECT query_id, doc_id, round(score, 4) AS score, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 10"""


@query(BMX)
def bm25_bmx(spark, d):
    # sums of many logarithms: four digits do not depend on their order
    return ranked(lexical(spark, d, 10, bm25.Bm25Options(variant="bmx")), digits=4)


@query(f"""WITH w AS (SELECT doc_id, CAST(unnest(range(len({TOKENS}))) AS BIGINT) AS pos, unnest({TOKENS}) AS term FROM documents) SELECT DISTINCT a.doc_id FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the'""")
def phrase_filter(spark, d):
    terms = bm25.terms_of(table(spark, d, "documents"), "doc_id", T.simple_tokens(F.col("text"))).where(F.col("term").isin("of", "the"))
    return bm25.phrase_documents(bm25.postings(terms, positions=True), ["of", "the"])


@query()
def proximity_bonus(spark, d):
    docs = table(spark, d, "documents").select("doc_id", T.simple_tokens(F.col("text")).alias("body"))
    return bm25.spans(docs, query_terms(spark, d)).withColumn("bonus", F.round("bonus", 6))


@query()
def tokenize_full(spark, d):
    return table(spark, d, "documents").select("doc_id", F.transform(T.full_tokens(F.col("text")), lambda x: x["token"]).alias("tokens"))


# ---- vectors --------------------------------------------------------------

DOT = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


def knn(spark, d, k: int, same_label: bool = False) -> DataFrame:
    """Exact search; queries are the rows whose id divides by 100, against all rows, in blocks."""
    rows = table(spark, d, "embeddings")
    own, asked = (V.blocks(x, "vec_id", "embedding", "label") for x in (rows, rows.where("vec_id % 100 = 0")))
    return V.nearest(own, asked, k, same_tag=same_label)


def knn_sql(k: int, where: str = "true") -> str:
    return f"""SELECT query_id, doc_id, score, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM
 (SELECT b.vec_id AS query_id, a.vec_id AS doc_id, round({DOT}, 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND {where})) WHERE rank <= {k}"""


@query(knn_sql(10))
def knn_cosine(spark, d):
    return knn(spark, d, 10)


@query(knn_sql(5, "a.label = b.label"))
def knn_filtered(spark, d):
    return knn(spark, d, 5, same_label=True)


@query("""SELECT vec_id, round(list_dot_product(v, v), 6) AS norm2, round(v[1] / sqrt(list_dot_product(v, v)), 5) AS first FROM (SELECT a.vec_id, list_transform(list_zip(a.embedding, b.embedding), lambda x: 0.7e0 * x[1]::DOUBLE + 0.3e0 * x[2]::DOUBLE) AS v FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)""")
def vector_combine(spark, d):
    a = table(spark, d, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    v = F.zip_with(F.col("embedding").cast("array<double>"), F.col("next").cast("array<double>"), lambda x, y: x * 0.7 + y * 0.3)
    rows = a.join(b, "vec_id").select("vec_id", v.alias("v"), V.combine(F.col("embedding"), F.col("next"), 0.7, 0.3).alias("c"))
    return rows.select("vec_id", F.round(V.dot(F.col("v"), F.col("v")), 6).alias("norm2"), F.round(F.col("c")[0], 5).alias("first"))


# ---- fusion and selection -------------------------------------------------

LISTS_SQL = """lists AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, list_no ORDER BY score DESC, doc_id) AS DOUBLE) AS rank FROM
 (SELECT doc_id % 49 AS query_id, 0 AS list_no, doc_id, n_chars::DOUBLE AS score, 1e0 AS weight FROM documents UNION ALL
  SELECT doc_id % 49, 1, doc_id, ((doc_id * 7919) % 1009)::DOUBLE, 0.7e0 FROM documents WHERE doc_id % 2 = 0))"""


def two_lists(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    key = (F.col("doc_id") % 49).alias("query_id")
    a = docs.select(key, F.lit(0).alias("list_no"), "doc_id", F.col("n_chars").cast("double").alias("score"), F.lit(1.0).alias("weight"))
    b = docs.where("doc_id % 2 = 0").select(key, F.lit(1).alias("list_no"), "doc_id", ((F.col("doc_id") * 7919) % 1009).cast("double").alias("score"), F.lit(0.7).alias("weight"))
    w = Window.partitionBy("query_id", "list_no").orderBy(F.desc("score"), "doc_id")
    return a.unionByName(b).withColumn("rank", F.row_number().over(w).cast("double"))


def fused_sql(part: str) -> str:
    return f"WITH {LISTS_SQL} SELECT query_id, doc_id, round(sum(part), 6) AS fused FROM (SELECT query_id, doc_id, {part} AS part FROM lists WINDOW l AS (PARTITION BY query_id, list_no)) GROUP BY query_id, doc_id"


@query(fused_sql("weight / (60 + rank)"))
def rrf_fusion(spark, d):
    return fusion.fuse(two_lists(spark, d), "rrf").withColumn("fused", F.round("fused", 6))


@query(fused_sql("weight * CASE WHEN max(score) OVER l = min(score) OVER l THEN 1e0 ELSE (score - min(score) OVER l) / (max(score) OVER l - min(score) OVER l) END"))
def rsf_fusion(spark, d):
    return fusion.fuse(two_lists(spark, d), "rsf").withColumn("fused", F.round("fused", 6))


@query(fused_sql("weight * least(1e0, greatest(0e0, (score - (avg(score) OVER l - 3e0 * CASE WHEN stddev_pop(score) OVER l = 0 THEN 1e-9 ELSE stddev_pop(score) OVER l END)) / (6e0 * CASE WHEN stddev_pop(score) OVER l = 0 THEN 1e-9 ELSE stddev_pop(score) OVER l END)))"))
def dbsf_fusion(spark, d):
    return fusion.fuse(two_lists(spark, d), "dbsf").withColumn("fused", F.round("fused", 6))


@query("SELECT doc_id, round(CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 3 = 0 THEN 1e0 WHEN doc_id % 3 = 1 THEN 0.85e0 ELSE 0.7e0 END ELSE CASE WHEN doc_id % 3 = 0 THEN 1e0 ELSE 0.7e0 END * 1.5e0 END, 6) AS weight FROM documents")
def list_weights(spark, d):
    role = F.when(F.col("doc_id") % 3 == 0, "primary").when(F.col("doc_id") % 3 == 1, "related").otherwise("expansion")
    kind = F.when(F.col("doc_id") % 2 == 0, "vector").otherwise("bm25")
    return table(spark, d, "documents").select("doc_id", F.round(fusion.list_weight(kind, role, F.lit(True)), 6).alias("weight"))


HITS_SQL = "hits AS (SELECT doc_id % 25 AS query_id, doc_id, source, ((doc_id * 7919) % 10007)::DOUBLE AS score FROM documents)"


def hits(spark, d) -> DataFrame:
    return table(spark, d, "documents").select((F.col("doc_id") % 25).alias("query_id"), "doc_id", "source", ((F.col("doc_id") * 7919) % 10007).cast("double").alias("score"))


@query(f"WITH {HITS_SQL}, c AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) AS n FROM hits), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM c WHERE n <= 3) SELECT query_id, doc_id, source, score, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 30")
def per_source_cap(spark, d):
    return selection.cap_per_source(hits(spark, d), 3, 30).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {HITS_SQL}, c AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) AS n FROM hits), t AS (SELECT *, max(score) OVER (PARTITION BY query_id, source) AS best, min(CASE WHEN n = 1 THEN doc_id END) OVER (PARTITION BY query_id, source) AS first FROM c WHERE n <= 3),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n, best DESC, first) AS rank FROM t) SELECT query_id, doc_id, source, score, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 30""")
def round_robin_diversify(spark, d):
    return selection.diversify_by_source(hits(spark, d), 3, 30).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH h AS (SELECT page_id, list_filter(string_split({HOST}, '.'), lambda x: x <> '') AS p FROM pages), o AS (SELECT page_id, {DOMAIN} AS domain, page_id AS rank FROM h), v AS (SELECT *, row_number() OVER (PARTITION BY page_id % 5, domain ORDER BY rank) > 5 AS over FROM o)
 SELECT page_id, domain, CAST(row_number() OVER (PARTITION BY page_id % 5 ORDER BY over, rank) AS BIGINT) AS new_rank FROM v""")
def domain_cap_demote(spark, d):
    rows = table(spark, d, "pages").select((F.col("page_id") % 5).alias("query_id"), "page_id", U.registrable_domain(U.host_of(F.col("url"))).alias("domain"), F.col("page_id").alias("rank"))
    return selection.demote_domains(rows, 5).select("page_id", "domain", F.col("new_rank").cast("long").alias("new_rank"))


@query(f"WITH {HITS_SQL} SELECT query_id, doc_id, source, score FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM hits) WHERE score >= 0.6e0 * top")
def relative_cutoff(spark, d):
    return selection.relative_cutoff(hits(spark, d), 0.6)


@query(f"""WITH {HITS_SQL}, r AS (SELECT query_id, doc_id, score * score AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM hits), g AS (SELECT *, score - lead(score) OVER (PARTITION BY query_id ORDER BY rank) AS gap FROM r),
 j AS (SELECT *, CASE WHEN gap > 3e0 * avg(gap) OVER (PARTITION BY query_id) AND rank >= 3 THEN 1 ELSE 0 END AS jump FROM g), c AS (SELECT *, coalesce(sum(jump) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cuts FROM j) SELECT query_id, doc_id, score, CAST(rank AS BIGINT) AS rank FROM c WHERE cuts < 1""")
def autocut(spark, d):
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    rows = hits(spark, d).select("query_id", "doc_id", (F.col("score") * F.col("score")).alias("score"), F.row_number().over(w).cast("long").alias("rank"))
    return selection.autocut(rows)


@query("SELECT query_id, url, CAST(min(chunk_index) AS BIGINT) AS first, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, chunk_index - row_number() OVER (PARTITION BY query_id, url ORDER BY chunk_index) AS island FROM (SELECT 0 AS query_id, source AS url, doc_id AS chunk_index FROM documents)) GROUP BY query_id, url, island")
def adjacent_islands(spark, d):
    rows = table(spark, d, "documents").select(F.lit(0).alias("query_id"), F.col("source").alias("url"), F.col("doc_id").alias("chunk_index"))
    got = selection.adjacent_islands(rows).groupBy("query_id", "url", "island").agg(F.min("chunk_index").alias("first"), F.count("*").alias("n"))
    return got.drop("island")


def pool(spark, d) -> DataFrame:
    top = knn(spark, d, 40)
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return top.join(v, "doc_id").select("query_id", "doc_id", "score", "vector")


@query()
def mmr(spark, d):
    return greedy.mmr(pool(spark, d), 10)


@query()
def xquad(spark, d):
    rows = pool(spark, d).withColumn("aspects", F.transform(F.slice("vector", 1, 3), lambda x: F.greatest(F.lit(0.0), x.cast("double"))))
    return greedy.xquad(rows.drop("vector"), 10)


@query()
def pack_budget(spark, d):
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    top = bm25.top_k(hits(spark, d), 40).drop("rank").join(table(spark, d, "documents").select("doc_id", T.approx_tokens(F.col("text")).alias("tokens")), "doc_id")
    return greedy.pack_budget(top.select("query_id", "doc_id", "source", "score", "tokens", F.row_number().over(w).alias("rank")), 5000)


@query()
def merge_adjacent(spark, d):
    c = chunking.chunk_documents(table(spark, d, "documents"), size=120)
    return greedy.merge_adjacent(c.select(F.col("doc_id").alias("query_id"), F.col("doc_id").cast("string").alias("url"), "chunk_index", "text", (1.0 / (1 + F.col("chunk_index"))).alias("score")))


# ---- duplicates -----------------------------------------------------------

NORM_HASH = "sha256(lower(trim(regexp_replace(text, '[ \\t-\\r]+', ' ', 'g'))))"


@query(f"SELECT min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY {NORM_HASH}")
def exact_dedupe(spark, d):
    return duplicates.by_content(table(spark, d, "documents")).select("first_id", "copies")


NEAR = f"""WITH t AS (SELECT doc_id, {TOKENS} AS w FROM documents), s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END)) AS s FROM t WHERE len(w) > 0),
 o AS (SELECT min(doc_id) AS doc_id, s FROM s GROUP BY s), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM o), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL)
 SELECT a, b, round(c::DOUBLE / (na + nb - c), 6) AS similarity FROM p WHERE c::DOUBLE / (na + nb - c) >= 0.8e0"""


@query(NEAR)
def near_dup_jaccard(spark, d):
    return duplicates.shingle_pairs(table(spark, d, "documents"), 5, 0.8).withColumn("similarity", F.round("similarity", 6))


@query()
def minhash_candidates(spark, d):
    return duplicates.minhash_candidates(table(spark, d, "documents"))


@query(
    "WITH l AS (SELECT source AS host, doc_id, sha256(lower(trim(regexp_replace(line, '[ \\t-\\r]+', ' ', 'g')))) AS h, length(line) AS n FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)), p AS (SELECT host, h, doc_id, max(n) AS n FROM l GROUP BY ALL) SELECT host, count(*) AS pages, CAST(max(n) AS BIGINT) AS n_chars FROM p GROUP BY host, h HAVING count(*) >= 2")
def host_boilerplate(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("host"), F.col("doc_id").alias("url"), F.explode(F.split("text", "\n")).alias("text"))
    return duplicates.host_boilerplate(rows).select("host", "pages", F.col("n_chars").cast("long").alias("n_chars"))


@query("""WITH g AS (SELECT doc_id, substr(t, i, 3) AS g, count(*) AS n FROM (SELECT doc_id, t, unnest(range(1, length(t) - 1)) AS i FROM (SELECT doc_id, trim(regexp_replace(text, '[ \\t-\\r]+', ' ', 'g')) AS t FROM documents)) GROUP BY ALL), tot AS (SELECT doc_id, sum(n) AS t FROM g GROUP BY ALL),
 c AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS c FROM g a JOIN g b ON b.doc_id = a.doc_id + 1 AND a.g = b.g GROUP BY ALL) SELECT ta.doc_id AS a, tb.doc_id AS b, round(2e0 * coalesce(c, 0) / (ta.t + tb.t), 6) AS f1 FROM tot ta JOIN tot tb ON tb.doc_id = ta.doc_id + 1 LEFT JOIN c ON c.a = ta.doc_id AND c.b = tb.doc_id""")
def trigram_f1(spark, d):
    """All pairs of neighbours by id."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    ids = docs.select("doc_id")
    pairs = ids.select(F.col("doc_id").alias("a")).join(ids.select(F.col("doc_id").alias("b")), F.col("b") == F.col("a") + 1)
    return duplicates.trigram_scores(docs, docs, pairs).withColumn("f1", F.round("f1", 6))


# ---- evidence, verification, expansion ------------------------------------


@query()
def prf_terms(spark, d):
    docs = with_documents(lexical(spark, d, 5, bm25.Bm25Options()).select("query_id", "doc_id"), table(spark, d, "documents"))
    tokens = docs.select("query_id", "doc_id", F.explode(T.simple_tokens(F.col("text"))).alias("term")).where(F.length("term") >= 3)
    return evidence.prf_terms(tokens, query_terms(spark, d)).select("query_id", "term", "tf", "df", F.round("score", 6).alias("score"), "rank")


@query()
def bridge_entities(spark, d):
    return evidence.bridge_entities(table(spark, d, "documents").select(F.col("source").alias("query_id"), "text"))


LEVEL_SQL = """SELECT query_id, count(*) AS passages, count(DISTINCT domain) AS domains, max(coverage) AS coverage, max(score) / avg(score) AS top_ratio, count(*) / 10e0 AS cutoff FROM p GROUP BY ALL"""
LEVEL = """SELECT query_id, passages, domains, round(coverage, 6) AS coverage, round(top_ratio, 6) AS top_ratio, CASE WHEN coverage < 0.34e0 THEN 'none' WHEN coverage >= 0.67e0 AND (domains >= 2 OR top_ratio >= 1.5e0 OR cutoff >= 0.75e0) THEN 'strong' ELSE 'weak' END AS level FROM l"""
TOP_SQL = """top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, sum(idf * (f * 2.2e0 / (f + 1.2e0) + 0.5e0)) AS score FROM hit GROUP BY ALL)) WHERE rank <= 10)"""
LEVELS, LEVELS_SQL = values("p", "query_id long, score double, domain string, coverage double", [(1, 1.0, "a", 0.9), (1, 0.9, "b", 0.9), (2, 1.0, "a", 0.2), (3, 1.0, "a", 0.7), (3, 0.9, "a", 0.7), (4, 1.0, "a", 0.7), (4, 0.1, "a", 0.7), (5, 1.0, "a", 0.5), (5, 0.9, "b", 0.5), *[(6, 1.0, "a", 0.68)] * 8, *[(7, 1.0, "a", 0.68)] * 7])


def shown_levels(rows: DataFrame) -> DataFrame:
    return evidence.evidence_level(rows).select("query_id", "passages", "domains", F.round("coverage", 6).alias("coverage"), F.round("top_ratio", 6).alias("top_ratio"), "level")


@query(f"WITH {LEVELS_SQL}, l AS ({LEVEL_SQL}) {LEVEL}")
def evidence_rules(spark, d):
    """Every branch of the levels on passages given here."""
    return shown_levels(LEVELS(spark))


@query(f"""{BM25_BASE}, {TOP_SQL}, c AS (SELECT query_id, count(DISTINCT term) / max(asked) AS coverage FROM hit JOIN (SELECT query_id, doc_id FROM top WHERE rank <= 3) USING (query_id, doc_id) GROUP BY query_id),
 p AS (SELECT query_id, score, source AS domain, coverage FROM top JOIN documents USING (doc_id) JOIN c USING (query_id)), l AS ({LEVEL_SQL}) {LEVEL}""")
def evidence_levels(spark, d):
    """Levels of the ten best documents of each benchmark item; coverage by the best three."""
    top = lexical(spark, d, 10, bm25.Bm25Options())
    docs = table(spark, d, "documents")
    wanted = query_terms(spark, d)
    three = with_documents(top.where("rank <= 3").select("query_id", "doc_id"), docs.select("doc_id", "text"))
    present = three.select("query_id", F.explode(T.simple_tokens(F.col("text"))).alias("term")).join(wanted, ["query_id", "term"], "left_semi").distinct()
    asked = wanted.groupBy("query_id").agg(F.count("*").alias("asked"))
    coverage = present.groupBy("query_id").agg(F.count("*").alias("n")).join(asked, "query_id").select("query_id", (F.col("n") / F.col("asked")).alias("coverage"))
    return shown_levels(with_documents(top, docs.select("doc_id", F.col("source").alias("domain"))).join(coverage, "query_id"))


@query()
def citation_verify(spark, d):
    turns = table(spark, d, "conversations").where("role = 'assistant'")
    answers = turns.select(F.col("conv_id").alias("answer_id"), F.concat(F.col("text"), F.lit(" [1]")).alias("text"))
    sources = table(spark, d, "conversations").select(F.col("conv_id").alias("answer_id"), F.col("turn").cast("int").alias("index"), "text")
    return evidence.verify_summary(evidence.verify_answers(answers, sources))


@query()
def highlights(spark, d):
    """Best windows of the three best documents of each benchmark item; every term weighs one."""
    rows = with_documents(lexical(spark, d, 3, bm25.Bm25Options()), table(spark, d, "documents").select("doc_id", "text"))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(F.transform(T.full_tokens(F.col("text")), lambda x: x["token"]))).alias("term"))
    got = evidence.attach_highlights(rows, items.withColumn("weight", F.lit(1.0)))
    return got.select("query_id", "doc_id", "highlight.start", "highlight.end", F.round("highlight.score", 6).alias("score"))


CLEAN = "regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')"


@query(f"SELECT item_id, doc_id FROM (SELECT item_id, trim({CLEAN}) AS b FROM benchmark) JOIN (SELECT doc_id, ' ' || trim({CLEAN}) || ' ' AS t FROM documents) ON contains(t, ' ' || b || ' ')")
def benchmark_containment(spark, d):
    """Documents that hold a benchmark item word for word: joined on the item's rarest word run, then verified."""
    clean = F.trim(F.regexp_replace(F.lower("text"), "[^\\p{L}\\p{N}]+", " "))
    items = table(spark, d, "benchmark").select("item_id", clean.alias("b")).withColumn("k", F.array_join(F.slice(F.split("b", " "), 1, 3), " ")).withColumn("short", F.size(F.split("b", " ")) < 3)
    docs = table(spark, d, "documents").select("doc_id", clean.alias("t"))
    w = F.split("t", " ")
    runs = docs.select("doc_id", F.explode(let(w, lambda x: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(x) - 2, F.lit(1))), lambda i: F.array_join(F.slice(x, i, 3), " "))))).alias("k"))
    cand = items.where("not short").join(runs, "k").select("item_id", "b", "doc_id")
    long = cand.join(docs, "doc_id").where(F.contains(F.concat(F.lit(" "), "t", F.lit(" ")), F.concat(F.lit(" "), "b", F.lit(" ")))).select("item_id", "doc_id")
    one = docs.select("doc_id", "t", F.explode(F.array_distinct(w)).alias("first"))
    few = items.where("short").withColumn("first", F.element_at(F.split("b", " "), 1)).join(one, "first").where(F.contains(F.concat(F.lit(" "), "t", F.lit(" ")), F.concat(F.lit(" "), "b", F.lit(" "))))
    return long.unionByName(few.select("item_id", "doc_id")).distinct()


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents), m AS (SELECT rank, quality FROM r JOIN labels USING (doc_id))
 SELECT round(avg(quality), 6) AS precision, round(1e0 / min(CASE WHEN quality = 1 THEN rank END), 6) AS mrr, count(*) AS judged FROM m""")
def eval_metrics(spark, d):
    # ranks by counting longer documents per length, so no single task sorts the table
    docs = table(spark, d, "documents")
    sizes = docs.groupBy("n_chars").agg(F.count("*").alias("n"))
    ahead = sizes.withColumn("ahead", F.sum("n").over(Window.orderBy(F.desc("n_chars"))) - F.col("n")).drop("n")
    rank = docs.join(ahead, "n_chars").select("doc_id", (F.col("ahead") + F.row_number().over(Window.partitionBy("n_chars").orderBy("doc_id"))).alias("rank"))
    m = rank.join(table(spark, d, "labels"), "doc_id")
    return m.agg(F.round(F.avg("quality"), 6).alias("precision"), F.round(1.0 / F.min(F.when(F.col("quality") == 1, F.col("rank"))), 6).alias("mrr"), F.count("*").alias("judged"))


# ---- events ---------------------------------------------------------------


@query("SELECT time_bucket(interval '1 hour', ts, timestamp '1970-01-01') AS start, event_type, count(*) AS calls, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def usage_by_window(spark, d):
    rows = S.usage_windows(table(spark, d, "events"))
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "calls", F.round("value", 4).alias("value"))


@query("""WITH g AS (SELECT *, CASE WHEN lag(ts) OVER u IS NULL OR ts >= lag(ts) OVER u + interval '30 minutes' THEN 1 ELSE 0 END AS new FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)),
 s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS calls FROM s GROUP BY user_id, k""")
def session_windows(spark, d):
    rows = S.sessions(table(spark, d, "events"))
    return rows.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "calls")


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), r AS (SELECT user_id, event_id, t, n FROM o WHERE n = 1
 UNION ALL SELECT o.user_id, o.event_id, o.t, o.n FROM (SELECT r.user_id, min(o.n) AS n FROM r JOIN o ON o.user_id = r.user_id AND o.n > r.n AND o.t >= r.t + 3600000000 GROUP BY r.user_id) x JOIN o USING (user_id, n)) SELECT event_id FROM r""")
def negative_cache_dedupe(spark, d):
    return S.negative_cache(table(spark, d, "events"), 3600).select("event_id")


@query("SELECT event_id, round((epoch_us(ts) - epoch_us(p)) / 1000e0, 3) AS wait_ms FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE (epoch_us(ts) - epoch_us(p)) / 1000e0 < 3600000")
def host_interval(spark, d):
    return S.host_intervals(table(spark, d, "events"), 3_600_000, "user_id").select("event_id", F.round("wait_ms", 3).alias("wait_ms"))


@query("SELECT user_id, count(*) AS entries, max(ts) AS last_used FROM events GROUP BY user_id")
def session_listing(spark, d):
    return S.session_listing(table(spark, d, "events")).withColumn("last_used", F.col("last_used").cast("timestamp_ntz"))


@query("SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n, sum(b) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS s FROM (SELECT *, CAST(floor(value * 10) AS BIGINT) AS b FROM events)) WHERE n <= 20 AND s <= 20000")
def cache_lru_eviction(spark, d):
    rows = table(spark, d, "events").select("event_id", F.col("event_id").alias("key"), F.col("ts").alias("last_access"), F.floor(F.col("value") * 10).cast("long").alias("bytes"), "user_id")
    return selection.evict(rows, 20, 20_000, scope="user_id").select("event_id")


@query("""WITH p(model, per_1k, per_1m) AS (VALUES ('click', 1.5e0, 0.2e0), ('view', 0.5e0, 0.1e0), ('purchase', 5e0, 1e0)), u AS (SELECT user_id AS call_id, event_type AS model, count(*) AS calls, sum(CAST(floor(value) AS BIGINT) * 10) AS tokens FROM events GROUP BY ALL)
 SELECT call_id, round(sum(calls / 1000e0 * per_1k + tokens / 1000000e0 * per_1m), 6) AS usd FROM u LEFT JOIN p USING (model) GROUP BY call_id""")
def cost_estimate(spark, d):
    prices = spark.createDataFrame([("click", 1.5, 0.2), ("view", 0.5, 0.1), ("purchase", 5.0, 1.0)], "model string, per_1k_calls double, per_1m_tokens double")
    usage = table(spark, d, "events").groupBy(F.col("user_id").alias("call_id"), F.col("event_type").alias("model")).agg(F.count("*").alias("calls"), F.sum(F.floor("value").cast("long") * 10).alias("tokens"))
    return A.cost(usage, F.broadcast(prices))
