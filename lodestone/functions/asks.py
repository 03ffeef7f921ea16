"""Expressions over query texts: rewrites, phrases, bounded terms, affinity to exact matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import STOP_WORDS

# What a category adds to a query.
CATEGORIES = {"pdf": "filetype:pdf", "github": "site:github.com", "research": "(arxiv OR doi OR paper)", "docs": "documentation", "news": "news"}
# Stop words of objectives.
OBJECTIVE_STOP = "a an the and or but of to in on for with by from as at is are was were be been being it its this that these those i we you they he she them our your their my me us do does did doing have has had having not no so if then than about into over under between while which who whom whose what when where why how would could should can may might will shall just also very more most much many some any each other such only own same too s t don now want need find know tell".split()
# Signs that exact words matter, with their factors.
AFFINITY = (
    ('"[^"]{2,}"', 1.6), ("[A-Za-z0-9]+(?:[._-][A-Za-z0-9]+)+|[a-z]+[A-Z][A-Za-z]+|--?[a-z][0-9A-Za-z_-]+", 1.4),
    ("\\b[0-9]+(?:\\.[0-9]+)+\\b|\\bv[0-9]+\\b|\\b(?:19|20)[0-9]{2}\\b", 1.2), ("\\b(?:error|exception|failed|cannot|undefined is not|ENOENT|E[A-Z]{3,})\\b", 1.3),
)
QUESTION = "(?i)^(?:why|how|what|when|which|explain|describe|compare)\\b"


def category_query(query: Column, category: Column) -> Column:
    """The query with its category's operator, unless it holds it already."""
    extra = F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])
    op = F.try_element_at(extra, category)
    return F.when(op.isNull() | F.contains(F.lower(query), F.lower(op)), query).otherwise(F.concat(query, F.lit(" "), op))


def quoted_phrases(query: Column) -> Column:
    """Texts of two characters or more between double quotes that have two words at least."""
    found = F.regexp_extract_all(query, F.lit('"([^"]{2,})"'), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: F.size(F.split(x, "[ \\t-\\r]+")) >= 2)


def lexical_affinity(query: Column) -> Column:
    """How much a query rewards exact matching: products of AFFINITY, at most 2.5; .75 for a long plain question."""
    q = F.trim(query)
    words = F.split(q, "[ \\t-\\r]+")
    f = F.lit(1.0)
    for pattern, factor in AFFINITY:
        f = f * F.when(q.rlike(pattern), factor).otherwise(1.0)
    f = f * F.when(F.size(F.filter(F.slice(words, 2, 1_000_000), lambda w: w.rlike("^[A-Z][a-z]+$"))) >= 2, 1.2).otherwise(1.0)
    return F.least(F.when((f == 1.0) & (F.size(words) >= 8) & q.rlike(QUESTION), 0.75).otherwise(f), F.lit(2.5))


def objective_terms(objectives: DataFrame, most: int = 12) -> DataFrame:
    """(query_id, objective) -> (query_id, terms): the most telling words of the first 2000 characters, by count, signs of an identifier and length."""
    raw = F.posexplode(F.split(F.lower(F.substring("objective", 1, 2000)), "[^\\p{L}\\p{N}._/:-]+")).alias("pos", "raw")
    words = objectives.select("query_id", raw).withColumn("w", F.regexp_replace("raw", "^[._/:-]+|[._/:-]+$", "")).where((F.length("w") >= 2) & ~F.col("w").isin(OBJECTIVE_STOP))
    stats = words.groupBy("query_id", "w").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    score = F.round(F.col("n") + F.when(F.col("w").rlike("[0-9._/:-]"), 1.5).otherwise(0.0) + F.least(F.length("w"), F.lit(12)) / 24.0, 9)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "first")
    top = stats.withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return top.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "w"))), lambda x: x["w"]), " ").alias("terms"))


def plain_text(text: Column) -> Column:
    """Link targets, URLs, tags and citation marks off."""
    out = text
    for pattern, new in (("\\]\\([^)]*\\)", "]"), ("https?://[^ \\t-\\r]+", " "), ("<[^>]+>", " "), ("\\\\?\\[[0-9]+\\\\?\\]", " ")):
        out = F.regexp_replace(out, pattern, new)
    return out


def surface_words(text: Column) -> Column:
    """Lower-case words as they stand, three letters or more, no stop words or bare numbers."""
    found = F.regexp_extract_all(plain_text(text), F.lit("[\\p{L}\\p{N}](?:[\\p{L}\\p{N}._-]*[\\p{L}\\p{N}])?"), F.lit(0))
    return F.filter(F.transform(found, lambda w: F.lower(w)), lambda w: (F.length(w) >= 3) & ~w.isin(*sorted(STOP_WORDS)) & ~w.rlike("^[0-9]+$"))


def distinct_strings(rows: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """The first row, by order, of each trimmed text whatever its case, within a key; blank ones go."""
    low = F.lower(F.trim(text))
    first = rows.where(F.trim(text) != "").groupBy(key, low.alias("_low")).agg(F.min_by(F.struct(F.col(order), F.trim(text).alias(text)), order).alias("_r"))
    return first.select(key, "_r.*")


def valid_domains(domains: Column) -> Column:
    """Domain arguments in lower case, without wildcards, URLs reduced to their hosts; null where one is no host name."""
    hosts = F.transform(domains, lambda d: F.regexp_replace(F.regexp_replace(F.lower(F.trim(d)), "^[a-z][a-z0-9+.-]*://", ""), "^\\*?\\.|[/?#:].*$", ""))
    good = F.forall(hosts, lambda h: h.rlike("^[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\\.[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)+$"))
    return F.when(good, F.array_distinct(hosts))
