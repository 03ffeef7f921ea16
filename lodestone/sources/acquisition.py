"""Search results, page gates, caches and costs as relations: the network side comes in as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import canonical_url, host_of, matches_domain

SERP = "query_id string, list_no int, url string, title string, snippet string, rank int, published_at string, source string"

# Priors of sources by host or host/path pattern.
SOURCE_PRIORS = {
    "*.gov": 1.1, "*.edu": 1.1, "*.arxiv.org": 1.1, "*.wikipedia.org": 1.1, "github.com/*/*/blob/*/readme*": 1.1,
    "*.pinterest.com": 0.85, "*.scribd.com": 0.85, "*.slideshare.net": 0.85, "*.coursehero.com": 0.85, "*.chegg.com": 0.85,
    "*.answers.com": 0.85, "*.ehow.com": 0.85, "*.hubpages.com": 0.85, "*.ezinearticles.com": 0.85,
}


def best_rank(serp: DataFrame) -> DataFrame:
    """One row for each query and canonical URL: the best-ranked result."""
    rows = serp.withColumn("canonical", canonical_url(F.col("url")))
    return rows.groupBy("query_id", "canonical").agg(F.min("rank").alias("rank"), F.min_by("title", F.struct("rank", "url")).alias("title"))


def merge_lists(serp: DataFrame) -> DataFrame:
    """Lists of one query by reciprocal rank: 1 / (10 + i), primary lists (list_no 0) weigh 1, others .8; new ranks."""
    weight = F.when(F.col("list_no") == 0, 1.0).otherwise(0.8)
    rows = serp.withColumn("canonical", canonical_url(F.col("url")))
    per = rows.groupBy("query_id", "canonical").agg(F.sum(weight / (10.0 + F.col("rank"))).alias("score"), F.min_by("title", F.struct("list_no", "rank", "url")).alias("title"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "canonical")
    return per.withColumn("rank", F.row_number().over(w))


def fallback_chain(serp: DataFrame) -> DataFrame:
    """Of providers by priority the first that has results for a query."""
    first = serp.groupBy("query_id").agg(F.min("priority").alias("priority"))
    return serp.join(first, ["query_id", "priority"])


def domain_filter(rows: DataFrame, allow: list[str] = (), block: list[str] = ()) -> DataFrame:
    host = host_of(F.col("url"))
    out = rows.where(matches_domain(host, list(allow))) if allow else rows
    return out.where(~matches_domain(host, list(block))) if block else out


def parse_serp_html(raw: DataFrame) -> DataFrame:
    """raw (query_id, html) -> result rows of a plain result page; advertisements are dropped."""
    block = F.regexp_extract_all("html", F.lit('(?s)<a[^>]*class=[\'"]result-link[\'"][^>]*>.*?</a>'), F.lit(0))
    rows = raw.select("query_id", F.posexplode(block).alias("at", "b"))
    url = F.regexp_extract("b", "href=['\"]([^'\"]*)['\"]", 1)
    target = F.coalesce(F.try_url_decode(F.regexp_extract(url, "[?&]uddg=([^&]*)", 1)), F.lit(""))
    rows = rows.select("query_id", "at", F.when(target != "", target).otherwise(url).alias("url"), F.regexp_replace(F.regexp_extract("b", "(?s)>(.*)</a>", 1), "<[^>]*>", "").alias("title"))
    rows = rows.where(~F.col("url").contains("/y.js?"))
    return rows.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("at")).alias("rank"), "url", "title")


def provider_content_ok(text: Column) -> Column:
    """Content of a search provider that can stand for the page: long, not HTML, not cut at a round length, not mostly links or short lines."""
    tags = F.regexp_count(text, F.lit("</?[a-zA-Z][^>]*>"))
    round_cut = (F.length(text) % 500 == 0) & ~F.trim(text).rlike("[.!?][\"')]?$") | text.rlike("(\\.\\.\\.|…)\\s*$")
    links = F.aggregate(F.regexp_extract_all(text, F.lit("\\[[^\\]]*\\]\\([^)]*\\)"), F.lit(0)), F.lit(0), lambda s, x: s + F.length(x))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    short = F.size(F.filter(lines, lambda x: F.length(x) < 40))
    return (F.length(text) >= 300) & (tags < 8) & ~round_cut & (links <= 0.5 * F.length(text)) & ~((F.size(lines) >= 10) & (short > 0.8 * F.size(lines)))


def bot_wall(status: Column, headers: Column, body: Column) -> Column:
    """Vendor of a bot wall, in order of rules; null if there is none."""
    head = F.lower(F.coalesce(F.array_join(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n"), F.lit("")))
    low = F.lower(F.substring(F.coalesce(body, F.lit("")), 1, 8192))
    blocked = status.isin(401, 403, 429, 503)
    return (
        F.when(status == 402, "payment").when(head.contains("cf-mitigated") | (blocked & (low.contains("cf-chl") | low.contains("just a moment"))), "cloudflare")
        .when(head.contains("x-datadome") & blocked | low.contains("captcha-delivery.com"), "datadome").when(low.contains("px-captcha") | low.contains("perimeterx"), "perimeterx")
        .when(low.contains("_incapsula_resource"), "imperva").when(blocked & (low.contains("reference #") | head.contains("akamaighost")), "akamai").when(blocked & low.contains("captcha"), "unknown")
    )


def fetchable_type(content_type: Column, url: Column) -> Column:
    """Types that can hold text; images, media, archives and fonts cannot."""
    base = F.lower(F.regexp_extract(F.coalesce(content_type, F.lit("")), "^([^;]*)", 1))
    return ~base.rlike("^(image|audio|video|font)/|zip|octet-stream|x-tar|gzip") | F.lower(url).rlike("\\.(pdf|md|txt)(\\?|$)")


def content_signal(header: Column) -> Column:
    """struct(search, ai_input, ai_train) of a Content-Signal value; null where it is silent."""
    pairs = F.filter(F.transform(F.split(F.lower(header), ","), lambda x: F.split(F.trim(x), "=")), lambda x: F.size(x) == 2)
    m = F.map_from_entries(F.transform(F.array_distinct(pairs), lambda x: F.struct(F.trim(x[0]), F.trim(x[1]) == "yes")))
    return F.struct(F.try_element_at(m, F.lit("search")).alias("search"), F.try_element_at(m, F.lit("ai-input")).alias("ai_input"), F.try_element_at(m, F.lit("ai-train")).alias("ai_train"))


def robots_allowed(rules: Column, path: Column) -> Column:
    """rules array<struct<allow boolean, prefix string>>: the longest prefix that matches decides; allow wins ties and by default."""
    hit = F.filter(rules, lambda r: (r["prefix"] != "") & path.startswith(r["prefix"]))
    best = F.array_max(F.transform(hit, lambda r: F.struct(F.length(r["prefix"]).alias("n"), r["allow"].alias("a"))))
    return F.coalesce(best["a"], F.lit(True))


def fast_path(url: Column) -> Column:
    """Where a page's plain form is fetched instead."""
    return (
        F.when(url.rlike("^https?://arxiv\\.org/abs/"), F.regexp_replace(url, "/abs/", "/html/"))
        .when(url.rlike("^https?://github\\.com/[^/]+/[^/]+/blob/"), F.regexp_replace(url, "^https?://github\\.com/([^/]+)/([^/]+)/blob/", "https://raw.githubusercontent.com/$1/$2/"))
        .when(url.rlike("^https?://github\\.com/[^/]+/[^/?#]+/?$"), F.concat(F.regexp_replace(F.regexp_replace(url, "/$", ""), "^https?://github\\.com/", "https://raw.githubusercontent.com/"), F.lit("/HEAD/README.md")))
        .when(url.rlike("^https?://docs\\.google\\.com/document/d/"), F.concat(F.regexp_extract(url, "^(https?://docs\\.google\\.com/document/d/[^/?#]+)", 1), F.lit("/export?format=md")))
        .when(url.rlike("^https?://(www\\.)?npmjs\\.com/package/"), F.regexp_replace(url, "^https?://(www\\.)?npmjs\\.com/package/", "https://registry.npmjs.org/"))
        .when(url.rlike("^https?://pypi\\.org/project/[^/]+/?$"), F.concat(F.lit("https://pypi.org/pypi/"), F.regexp_extract(url, "/project/([^/]+)", 1), F.lit("/json")))
        .when(url.rlike("^https?://news\\.ycombinator\\.com/item\\?id=[0-9]+"), F.concat(F.lit("https://hn.algolia.com/api/v1/items/"), F.regexp_extract(url, "id=([0-9]+)", 1)))
        .otherwise(url)
    )


def source_prior(url: Column, own: dict[str, float] | None = None) -> Column:
    """Product of the priors whose pattern fits, within .7 to 1.3."""
    host, path = host_of(url), F.regexp_replace(F.lower(url), "^[a-z]+://(www\\.)?|[?#].*$", "")
    out = F.lit(1.0)
    for glob, m in (SOURCE_PRIORS | (own or {})).items():
        pattern = "^" + "".join(".*" if c == "*" else "\\." if c == "." else c for c in glob) + "$"
        fits = path.rlike(pattern) if "/" in glob else host.rlike(pattern) | (host == glob.removeprefix("*."))
        out = out * F.when(fits, m).otherwise(1.0)
    return F.least(F.lit(1.3), F.greatest(F.lit(0.7), out))


def cache_status(entries: DataFrame, wanted: DataFrame, ttl_s: int) -> DataFrame:
    """wanted (url, now) against entries (url, fetched_at, max_age_s, etag): hit, stale (can be revalidated) or miss."""
    rows = wanted.withColumn("key", canonical_url(F.col("url"))).join(entries.withColumn("key", canonical_url(F.col("url"))).drop("url"), "key", "left")
    life = F.least(F.coalesce(F.col("max_age_s"), F.lit(ttl_s)), F.lit(ttl_s))
    age = F.col("now").cast("timestamp").cast("long") - F.col("fetched_at").cast("timestamp").cast("long")
    return rows.withColumn("status", F.when(F.col("fetched_at").isNull(), "miss").when(age <= life, "hit").when(F.col("etag").isNotNull(), "stale").otherwise("miss"))


def cache_upsert(entries: DataFrame, new: DataFrame) -> DataFrame:
    """The latest row of each URL."""
    rest = [c for c in entries.columns if c != "url"]
    latest = entries.unionByName(new).groupBy("url").agg(F.max_by(F.struct(*rest), "fetched_at").alias("_r"))
    return latest.select("url", "_r.*").select(*entries.columns)


def cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage (call_id, model, calls, tokens), prices (model, per_1k_calls, per_1m_tokens): dollars by call; null where nothing has a price."""
    rows = usage.join(prices, "model", "left")
    each = F.col("calls") / 1000.0 * F.col("per_1k_calls") + F.col("tokens") / 1000000.0 * F.col("per_1m_tokens")
    return rows.groupBy("call_id").agg(F.round(F.sum(each), 6).alias("usd"))


def page_validators(headers: Column) -> Column:
    """struct(etag, last_modified, max_age_s) of response headers (lower-case names): null where absent, or not to be stored."""
    control = F.lower(F.coalesce(F.try_element_at(headers, F.lit("cache-control")), F.lit("")))
    age = F.coalesce(F.nullif(F.regexp_extract(control, "s-maxage=([0-9]+)", 1), F.lit("")), F.nullif(F.regexp_extract(control, "max-age=([0-9]+)", 1), F.lit("")))
    modified = F.try_element_at(headers, F.lit("last-modified"))
    dated = F.when(modified.rlike("^[A-Z][a-z]{2}, [0-9]{2} [A-Z][a-z]{2} [0-9]{4} [0-9:]{8} GMT$"), modified)
    return F.struct(F.try_element_at(headers, F.lit("etag")).alias("etag"), dated.alias("last_modified"), F.when(~control.rlike("no-store|no-cache|private"), age.cast("long")).alias("max_age_s"))


def parser_of(content_type: Column, url: Column, head: Column) -> Column:
    """The parser for a response: served Markdown, PDF, HTML or text; null for what holds no text."""
    base = F.lower(F.trim(F.regexp_extract(F.coalesce(content_type, F.lit("")), "^([^;]*)", 1)))
    path = F.lower(F.regexp_replace(url, "[?#].*$", ""))
    return (
        F.when(base.rlike("^text/(?:x-)?markdown$") | ((base == "text/plain") & path.rlike("\\.mdx?$")), "markdown")
        .when((base == "application/pdf") | head.startswith("%PDF-") | ((base == "") & path.endswith(".pdf")), "pdf")
        .when(base.rlike("^(?:text/html|application/xhtml\\+xml)$") | ((base == "") & F.lower(head).rlike("<(?:!doctype html|html|body)")), "html")
        .when(base.rlike("^text/|json|xml|yaml") | (base == ""), "text")
    )


def unseen(results: DataFrame, seen: DataFrame) -> DataFrame:
    """results (url, ...) whose canonical URL is none of seen (url): an anti-join on equal keys."""
    old = seen.select(canonical_url(F.col("url")).alias("canonical")).distinct()
    return results.withColumn("canonical", canonical_url(F.col("url"))).join(old, "canonical", "left_anti")


def cache_stats(entries: DataFrame) -> DataFrame:
    """entries (host, bytes, fetched_at): entries, bytes, oldest and newest of each host."""
    return entries.groupBy("host").agg(F.count("*").alias("entries"), F.sum("bytes").alias("bytes"), F.min("fetched_at").alias("oldest"), F.max("fetched_at").alias("newest"))


#: Fields of the results of JSON search APIs: (path of the list, url, title, snippet, date).
# Field names of the providers' answers.
SEARCH_APIS = {
    "brave": ("$.web.results", "url", "title", "description", "page_age"), "serper": ("$.organic", "link", "title", "snippet", "date"), "serpapi": ("$.organic_results", "link", "title", "snippet", "date"),
    "google-cse": ("$.items", "link", "title", "snippet", ""), "tavily": ("$.results", "url", "title", "content", "published_date"), "exa": ("$.results", "url", "title", "text", "publishedDate"),
    "perplexity": ("$.results", "url", "title", "snippet", "date"), "searxng": ("$.results", "url", "title", "content", "publishedDate"), "wikipedia": ("$.pages", "key", "title", "excerpt", ""),
}


def parse_search_json(raw: DataFrame) -> DataFrame:
    """raw (query_id, provider, body) of landed API answers -> result rows (query_id, source, rank, url, title, snippet, published_at); answers that are no JSON have none."""
    out = None
    for name, (path, url, title, snippet, date) in SEARCH_APIS.items():
        items = F.from_json(F.get_json_object("body", path), "array<map<string,string>>")
        rows = raw.where(F.col("provider") == name).select("query_id", F.lit(name).alias("source"), F.posexplode(items).alias("at", "m"))
        pick = lambda k: F.try_element_at("m", F.lit(k)) if k else F.lit(None).cast("string")
        own = rows.select("query_id", "source", (F.col("at") + 1).alias("rank"), pick(url).alias("url"), pick(title).alias("title"), pick(snippet).alias("snippet"), pick(date).alias("published_at")).where("url is not null")
        out = own if out is None else out.unionByName(own)
    return out


SOURCES: dict = {}


def register_source(name: str, fn) -> None:
    """fn(spark, queries) -> result rows; search(name, ...) finds it by name."""
    SOURCES[name] = fn


def search(name: str, spark, queries: DataFrame) -> DataFrame:
    if name not in SOURCES:
        raise ValueError(f"no search source {name!r}; known: {', '.join(sorted(SOURCES)) or 'none'}")
    return SOURCES[name](spark, queries)
