"""Web pages to text, metadata and quality signals.

extract_pages parses in Python (standard library), in Arrow batches; the other
functions are expressions over raw HTML or extracted text.
"""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import HELD, runs, ship

SKIP = frozenset("script style noscript template svg iframe nav footer aside form button".split())
BLOCKS = frozenset("p div section article main header ul ol li table tr blockquote pre h1 h2 h3 h4 h5 h6 br hr figure figcaption dl dt dd".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Names of elements that are not content.
JUNK = re.compile(r"\b(?:ad|ads|advert|advertisement|banner|cookie|consent|sidebar|breadcrumb|share|social|related|newsletter|promo|popup|menu|footer|nav)\b", re.I)
# Where a page tells its dates, in order of trust.
PUBLISHED = ("article:published_time", "datepublished", "date", "dc.date", "dc.date.issued", "citation_publication_date", "parsely-pub-date", "sailthru.date", "pubdate", "publishdate")
MODIFIED = ("article:modified_time", "datemodified", "og:updated_time", "last-modified", "dc.date.modified", "revised")


class PageReader(HTMLParser):
    """Markdown-like text, links, metadata and counts of one page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.meta: dict[str, str] = {}
        self.links: list[str] = []
        self.json_ld: list[str] = []
        self.stack: list[tuple[str, bool]] = []
        self.hidden = self.pre = self.cells = 0
        self.title = self.lang = self.canonical = ""
        self.alternates: list[tuple[str, str]] = []
        self.capture: str | None = None
        self.tables = self.codes = self.link_chars = 0
        self.in_link = 0

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "html":
            self.lang = a.get("lang", "")
        elif tag == "meta":
            key = (a.get("property") or a.get("name") or a.get("itemprop") or "").lower()
            if key and a.get("content"):
                self.meta.setdefault(key, a["content"].strip())
        elif tag == "link":
            rel = a.get("rel", "").lower()
            if "canonical" in rel and not self.canonical:
                self.canonical = a.get("href", "")
            elif "alternate" in rel and a.get("hreflang") and len(self.alternates) < 50:
                self.alternates.append((a["hreflang"], a.get("href", "")))
        elif tag == "script" and a.get("type", "").lower() == "application/ld+json":
            self.capture = "ld"
        elif tag == "title" and not self.title:
            self.capture = "title"
        elif tag == "time" and a.get("datetime"):
            self.meta.setdefault("time", a["datetime"])
        if tag in VOID:
            if tag == "br":
                self.out.append("\n")
            return
        hide = tag in SKIP or bool(JUNK.search(f"{a.get('class', '')} {a.get('id', '')}")) or a.get("hidden") == "" and "hidden" in a or a.get("aria-hidden") == "true"
        self.stack.append((tag, hide))
        self.hidden += hide
        if self.hidden:
            return
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag == "pre":
            self.pre += 1
            self.codes += 1
            language = re.search(r"(?:language|lang|highlight-source)-([\w+#-]+)", a.get("class", ""))
            self.out.append(f"\n\n```{language[1] if language else ''}\n")
        elif tag == "table":
            self.tables += 1
            self.out.append("\n\n")
        elif tag == "tr":
            self.out.append("\n|")
            self.cells = 0
        elif tag == "a":
            self.in_link += 1
            if a.get("href", "").startswith(("http", "/")) and len(self.links) < 150 and a["href"] not in self.links:
                self.links.append(a["href"])
        elif tag in BLOCKS:
            self.out.append("\n\n")

    def handle_endtag(self, tag):
        self.capture = None
        if not any(t == tag for t, _ in self.stack):
            return
        while self.stack:
            t, hide = self.stack.pop()
            shown = not self.hidden
            self.hidden -= hide
            if shown:
                if t == "pre":
                    self.pre -= 1
                    self.out.append("\n```\n\n")
                elif t in ("td", "th"):
                    self.out.append(" |")
                elif t == "a":
                    self.in_link -= 1
                elif t in BLOCKS:
                    self.out.append("\n")
            if t == tag:
                break

    def handle_data(self, data):
        if self.capture == "ld":
            self.json_ld.append(data)
        elif self.capture == "title":
            self.title += data
        elif not self.hidden and (data.strip() or self.pre):
            text = data if self.pre else re.sub(r"\s+", " ", data)
            self.link_chars += len(text) if self.in_link else 0
            self.out.append(text)

    def markdown(self) -> str:
        text = "".join(self.out)
        text = re.sub(r"[​‌‍﻿‪-‮\x00-\x08\x0b\x0c\x0e-\x1f]", "", text).replace("\xa0", " ")
        text = re.sub(r"[ \t]+\n", "\n", text)
        return re.sub(r"\n{3,}", "\n\n", text).strip()


def ld_nodes(blocks: list[str]) -> list[dict]:
    out: list[dict] = []
    todo: list = []
    for b in blocks:
        try:
            todo.append(json.loads(re.sub(r",\s*([}\]])", r"\1", b.strip())))
        except ValueError:
            continue
    while todo and len(out) < 200:
        x = todo.pop(0)
        if isinstance(x, list):
            todo = x + todo
        elif isinstance(x, dict):
            out.append(x)
            todo = (x["@graph"] if isinstance(x.get("@graph"), list) else []) + todo
    return out


def date_in_url(url: str) -> str | None:
    m = re.search(r"/(20\d\d|19\d\d)[/-](0[1-9]|1[0-2])[/-](0[1-9]|[12]\d|3[01])(?:[/-]|$)", url or "")
    return f"{m[1]}-{m[2]}-{m[3]}" if m else None


def page_kind(types: set[str], og_type: str, url: str) -> str:
    if types & {"QAPage", "DiscussionForumPosting"}:
        return "forum"
    if types & {"NewsArticle"}:
        return "news"
    if types & {"TechArticle", "APIReference"} or re.search(r"/(?:docs?|reference|api|manual)/", url or ""):
        return "docs"
    if types & {"Product", "Offer"} or og_type == "product":
        return "product"
    if types & {"VideoObject"} or og_type.startswith("video"):
        return "video"
    if types & {"Article", "BlogPosting", "ScholarlyArticle"} or og_type == "article":
        return "article"
    return "other"


def read_page(url: str, html: str) -> dict:
    r = PageReader()
    try:
        r.feed(html or "")
        r.close()
    except (AssertionError, ValueError):
        pass
    nodes = ld_nodes(r.json_ld)
    types = {t for n in nodes for t in (n["@type"] if isinstance(n.get("@type"), list) else [n.get("@type")]) if isinstance(t, str)}
    first = lambda key: next((str(n[key]) for n in nodes if isinstance(n.get(key), str | int)), None)
    author = next((a.get("name") if isinstance(a, dict) else a for n in nodes for a in (n["author"] if isinstance(n.get("author"), list) else [n.get("author")]) if a), None)
    md = r.markdown()
    free = next((n["isAccessibleForFree"] for n in nodes if "isAccessibleForFree" in n), None)
    return {
        "title": (r.meta.get("og:title") or " ".join(r.title.split()) or None), "description": r.meta.get("og:description") or r.meta.get("description"),
        "site_name": r.meta.get("og:site_name"), "byline": r.meta.get("author") or (str(author) if author else None), "lang": r.lang or r.meta.get("og:locale"),
        "published_at": next((r.meta[k] for k in PUBLISHED if k in r.meta), None) or first("datePublished") or r.meta.get("time") or date_in_url(url),
        "updated_at": next((r.meta[k] for k in MODIFIED if k in r.meta), None) or first("dateModified"),
        "canonical": r.canonical or None, "kind": page_kind(types, r.meta.get("og:type", ""), url), "free": None if free is None else str(free).lower() not in ("false", "0"),
        "markdown": md, "links": r.links, "n_tables": r.tables, "n_code": r.codes, "link_chars": r.link_chars,
    }


PAGE = "page_id long, url string, title string, description string, site_name string, byline string, lang string, published_at string, updated_at string, canonical string, kind string, free boolean, markdown string, links array<string>, n_tables int, n_code int, link_chars long"


def extract_pages(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> text and metadata; a page that cannot be parsed gives what was read of it."""

    ship()

    def run(batches):
        for pdf in batches:
            for a, b in runs([len(h or "") for h in pdf["html"]], HELD):
                part = pdf.iloc[a:b]
                yield pd.DataFrame([{"page_id": p, "url": u, **read_page(u, h)} for p, u, h in zip(part["page_id"], part["url"], part["html"])])

    return pages.select("page_id", "url", "html").mapInPandas(run, PAGE)


def strip_tags(html: Column) -> Column:
    """Text of a page by patterns alone: scripts, styles, comments, tags and entities off."""
    out = F.regexp_replace(html, "(?s)<(script|style)[^>]*>.*?</(?:script|style)>", " ")
    out = F.regexp_replace(F.regexp_replace(out, "(?s)<!--.*?-->", " "), "<[^>]*>", " ")
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, "[ \\t-\\r]+", " "))


def title_of(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, "(?s)<title>(.*?)</title>", 1))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def junk_count(html: Column) -> Column:
    return F.regexp_count(html, F.lit('<(nav|footer|aside|form)|class="ad"')).cast("long")


def candidate_score(text_len: Column, link_density: Column, junk: Column, headings: Column, code: Column, table: Column) -> Column:
    """Score of a content candidate: length, few links, little junk, structure."""
    kept = 1.0 - F.least(link_density, F.lit(0.9))
    return F.log(1.0 + text_len) * kept * kept - 0.3 * F.least(junk, F.lit(10)) + 0.05 * F.least(headings, F.lit(20)) + F.when(code, 0.3).otherwise(0.0) + F.when(table, 0.3).otherwise(0.0)


def choose_candidate(pages: DataFrame, least_chars: int = 250) -> DataFrame:
    """pages with reader, full and boundary, structs (text_len, link_density, code_blocks, table_rows) or null: adds choice and guard.

    The reader's text stands unless a guard speaks against it, the first that does: there is none; it is thin; the page's
    one article element holds most of it with fewer links or tables; the full text has far more text, code or tables.
    Both are null where no candidate exists; guard is null where none spoke.
    """
    r, f, a = (lambda name, c=c: F.coalesce(F.col(f"{c}.{name}"), F.lit(0)) for c in ("reader", "full", "boundary"))
    larger = F.col("full").isNotNull() & (f("text_len") > r("text_len")) & (f("link_density") < 0.6)
    within = F.col("boundary").isNotNull() & (a("text_len") >= least_chars) & a("text_len").between(0.6 * r("text_len"), r("text_len"))
    crowded = (r("link_density") > a("link_density") + 0.15) | (r("table_rows") - a("table_rows") >= 4)
    lost = lambda name, least: (f(name) >= least) & (r(name) < 0.5 * f(name))
    guards = [
        ("no-article", "full", F.col("reader").isNull()),
        ("thin-article", "full", larger & (r("text_len") < least_chars)),
        ("link-density", "boundary", F.col("full").isNotNull() & within & crowded),
        ("text-recall", "full", larger & (r("text_len") < 0.35 * f("text_len"))),
        ("code-recall", "full", larger & lost("code_blocks", 2)),
        ("table-recall", "full", larger & lost("table_rows", 4)),
    ]
    verdict = F.coalesce(*(F.when(speaks, F.struct(F.lit(pick).alias("choice"), F.lit(name).alias("guard"))) for name, pick, speaks in guards),
                         F.struct(F.lit("reader").alias("choice"), F.lit(None).cast("string").alias("guard")))
    some = F.col("reader").isNotNull() | F.col("full").isNotNull()
    return pages.withColumn("choice", F.when(some, verdict["choice"])).withColumn("guard", F.when(some, verdict["guard"]))


def js_shell(html: Column, text_len: Column) -> Column:
    """Pages that only a browser fills: framework roots or near-empty text."""
    marks = html.rlike('id="(root|app|__next|__nuxt)"') | html.rlike("(?i)enable javascript")
    return (marks & (text_len < 300)) | ((text_len < 200) & (text_len < 0.02 * F.length(html)))


def served_markdown(content_type: Column, url: Column) -> Column:
    return content_type.rlike("(?i)text/(x-)?markdown") | url.rlike("(?i)\\.mdx?(\\?|$)")


def clean_served_markdown(md: Column) -> Column:
    """Front matter, MDX imports and component tags off."""
    out = F.regexp_replace(md, "(?s)^---\\n.*?\\n---\\n", "")
    out = F.regexp_replace(out, "(?m)^(import|export) .*$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "</?[A-Z][A-Za-z0-9.]*[^>]*>", ""), "\\n{3,}", "\n\n"))


def front_matter(md: Column) -> Column:
    """Map of the front matter's simple keys."""
    block = F.regexp_extract(md, "(?s)^---\\n(.*?)\\n---\\n", 1)
    pairs = F.filter(F.split(block, "\n"), lambda x: x.rlike("^[A-Za-z_][\\w-]*:"))
    return F.map_from_entries(F.transform(F.slice(pairs, 1, 24), lambda x: F.struct(F.regexp_extract(x, "^([\\w-]+):", 1), F.trim(F.regexp_replace(x, "^[\\w-]+:[ \\t]*[\"']?|[\"']$", "")))))


def slice_page(text: Column, offset: int, size: int) -> Column:
    return F.substring(text, offset + 1, size)
