from pyspark.sql import functions as F

from lodestone.functions import text, urls, vectors


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_tokenizer():
    assert text.tokenize("The Rankings of fused lists!") == ["ranking", "fused", "list"]
    assert text.tokenize("Combining ranked results") == ["combin", "rank", "result"]
    assert text.tokenize("AbortSignal.any")[0] == "abortsignal.any"
    assert text.tokenize("") == []


def test_canonical_url(spark):
    got = value(spark, urls.canonical_url(F.lit("https://www.Example.com/a/b/?utm_source=x&b=2&a=1#frag")))
    assert got == "https://example.com/a/b?a=1&b=2"
    assert value(spark, urls.canonical_url(F.lit("not a url"))) == "not a url"
    assert value(spark, urls.canonical_url(F.lit("http://x.org:80/"))) == "http://x.org/"


def test_registrable_domain(spark):
    assert value(spark, urls.registrable_domain(F.lit("en.m.wikipedia.org"))) == "wikipedia.org"
    assert value(spark, urls.registrable_domain(F.lit("www.bbc.co.uk"))) == "bbc.co.uk"


def test_redirects_and_fragments(spark):
    wrapped = "https://www.google.com/url?q=https%3A%2F%2Fen.m.wikipedia.org%2Fwiki%2FA&sa=U"
    assert value(spark, urls.clean_url(F.lit(wrapped))) == "https://en.wikipedia.org/wiki/A"
    assert value(spark, urls.text_fragment(F.lit("https://x.org/#:~:text=one%20two"))) == "one two"


def test_numbers_and_tokens(spark):
    assert value(spark, text.extract_numbers(F.lit("up 12.5% to 1,200 on 2024-05-01 and 2023"))) == ["12.5%", "1200", "2024-05-01", "2023"]
    assert value(spark, text.approx_tokens(F.lit("abcdefgh"))) == 2
    assert value(spark, text.approx_tokens(F.lit("日本"))) == 2
    assert value(spark, text.light_stem(F.lit("queries"))) == "query"


def test_recency(spark):
    assert abs(value(spark, text.recency_boost(F.lit(30.0), 30.0)) - 1.15) < 1e-9
    assert value(spark, text.recency_boost(F.lit(0.0), 30.0, 0.9)) == 1.3
    assert value(spark, text.recency_boost(F.lit(None).cast("double"), 30.0)) == 1.0


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))
    assert abs(value(spark, vectors.cosine(a, b)) - 0.96) < 1e-9
    assert value(spark, vectors.l2_normalize(a)) == [0.6, 0.8]
