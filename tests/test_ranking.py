import math
import random

import numpy as np

from pyspark.sql import functions as F

from lodestone.functions import vectors
from lodestone.operators import bm25, chunking, duplicates, evidence, fusion, greedy, html, render, retrieve, selection
from lodestone.sources import acquisition


def test_bm25_equals_brute_force(spark):
    random.seed(1)
    docs = {i: [random.choice("abcdefghij") for _ in range(random.randrange(1, 30))] for i in range(40)}
    terms = spark.createDataFrame([(i, "body", p, t) for i, w in docs.items() for p, t in enumerate(w)], "doc_id long, field string, pos int, term string")
    q = spark.createDataFrame([(0, "a"), (0, "c"), (1, "j")], "query_id long, term string")
    got = {(r.query_id, r.doc_id): r.score for r in bm25.scores(q, bm25.postings(terms), bm25.field_lengths(terms), 40).collect()}
    avg = sum(map(len, docs.values())) / 40
    for query, words in ((0, "ac"), (1, "j")):
        for i, w in docs.items():
            s = 0.0
            for t in words:
                tf, df = w.count(t), sum(t in x for x in docs.values())
                if tf:
                    f = tf / (0.25 + 0.75 * len(w) / avg)
                    s += math.log(1 + (40 - df + 0.5) / (df + 0.5)) * (f * 2.2 / (f + 1.2) + 0.5)
            assert abs(got.get((query, i), 0.0) - s) < 1e-9


def test_min_span():
    assert bm25.min_span([[1, 10], [4, 11], [12]]) == 3
    assert bm25.min_span([[1], []]) == 0


def test_fusion(spark):
    rows = [("q", 0, "a", 2.0, 1.0, 1), ("q", 0, "b", 1.0, 1.0, 2), ("q", 1, "b", 5.0, 1.0, 1), ("q", 1, "c", 4.0, 1.0, 2), ("q", 2, "z", 9.0, 0.0, 1)]
    lists = spark.createDataFrame(rows, "query_id string, list_no int, doc_id string, score double, weight double, rank int")
    got = [r.doc_id for r in fusion.fuse(lists, "rrf").orderBy("fused", ascending=False).collect()]
    assert got[0] == "b" and set(got) == {"a", "b", "c"}


def test_autocut(spark):
    rows = spark.createDataFrame([("q", i, s, i + 1) for i, s in enumerate([1.0, 0.98, 0.97, 0.5, 0.49, 0.48])], "query_id string, doc_id long, score double, rank int")
    assert selection.autocut(rows, 1).count() == 3


def test_xquad_and_mmr():
    rel = np.array([1.0, 0.9, 0.8, 0.7])
    a, b = np.array([1, 1, 1, 0.0]), np.array([0, 0, 0, 1.0])
    assert greedy.xquad_order(rel, [(1, a), (1, b)], 4)[:2] == [0, 3]
    assert greedy.xquad_order(rel, [(1, a), (1, b)], 4, 0) == [0, 1, 2, 3]
    sim = np.array([[1, 0.99, 0], [0.99, 1, 0], [0, 0, 1.0]])
    assert greedy.mmr_order(np.array([1.0, 0.95, 0.8]), sim, 2, 0.5) == [0, 2]
    assert greedy.mmr_order(np.array([1.0, 0.95]), sim[:2, :2], 5) == [0, 1]


def test_join_adjacent():
    shared = "this is a shared overlap text"
    assert greedy.join_adjacent(f"begin {shared}", f"{shared} end") == f"begin {shared} end"
    assert greedy.join_adjacent("a", "b") == "a\n\nb"


def test_chunks_keep_offsets():
    md = "# One\n\n" + "word " * 900 + "\n\n## Two\n\n```py\nx = 1\n```\n\nLast paragraph that is long enough to stay here."
    for c in chunking.chunk_markdown(md, 100, 20):
        assert c["text"] == md[c["start"] : c["end"]].strip()
    assert chunking.chunk_markdown("") == []


def test_html():
    page = '<html lang="en"><head><title>T</title><meta name="author" content="A"><link rel="canonical" href="/x"></head><body><nav>menu</nav><h1>Head</h1><p>Text &amp; more</p><pre><code>a  b</code></pre></body></html>'
    got = html.read_page("https://x.org/2024/05/06/slug", page)
    assert got["title"] == "T" and got["byline"] == "A" and got["lang"] == "en" and got["published_at"] == "2024-05-06"
    assert "# Head" in got["markdown"] and "Text & more" in got["markdown"] and "a  b" in got["markdown"] and "menu" not in got["markdown"]
    assert html.read_page("", "")["markdown"] == ""


def test_verifier(spark):
    page = "Opening words. Lake Orta lies west of the big lake and is drained towards the north. Ferries cross every 45 minutes in summer."
    sources = [(1, 1, "The glacier on the north face shrinks by 1,250 metres in a century. Its area was first measured in 1898. No roads lead there.", None), (1, 2, "Lake Orta lies west of the big lake and is drained towards the north.", page)]
    said = [
        ("Its area was first measured in 1898 [1].", "verbatim"), ("The glacier on the north face shrank by 1250 metres in one century [1].", "paraphrase"), ("The glacier was bought in 1951 by a hotel keeper [1].", "unsupported"),
        ("Ferries cross every 45 minutes in summer [2, 2].", "verbatim"), ("Lake Orta lies west of the big lake.", "verbatim"), ("Cheese is made from milk in most places.", "uncited"), ("All of this was told to us by somebody [9].", "unsupported"),
    ]
    answers = spark.createDataFrame([(1, " ".join(t for t, _ in said) + " Yes."), (2, None), (3, "There is no source for this one at all.")], "answer_id long, text string")
    table = spark.createDataFrame(sources, "answer_id long, index int, text string, page_text string")
    rows = evidence.verify_answers(answers, table).orderBy("answer_id", "position").collect()
    got = [r for r in rows if r.answer_id == 1]
    assert [(r.sentence, r.status) for r in got] == said
    assert got[2].unsupported_numbers == ["1951"] and got[1].unsupported_numbers == [] == got[3].unsupported_numbers
    assert got[3].citations == [2] and got[4].best_index == 2 and got[6].unknown == [9] and got[5].best_index is None or got[5].score < 0.6
    assert [r.status for r in rows if r.answer_id == 3] == ["uncited"] and not [r for r in rows if r.answer_id == 2]
    summary = {r.answer_id: r for r in evidence.verify_summary(evidence.verify_answers(answers, table)).collect()}
    assert (summary[1].total, summary[1].verbatim, summary[1].uncited, summary[1].support_rate) == (7, 3, 1, 0.571)


def test_longest_common_subsequence():
    random.seed(3)
    for _ in range(300):
        a, b = ([random.choice("abcd") for _ in range(random.randrange(0, 14))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0] + [max(row[j + 1], 0) if x != b[j] else row[j] + 1 for j in range(len(b))]
            for j in range(len(b)):
                row[j + 1] = max(row[j + 1], row[j])
        assert evidence.lcs(a, b) == row[-1]


def test_segments():
    text = "# Head\nOne sentence that is long enough, e.g. this one. And another one follows here! Short. x\n\n```py\na. B = 1\n\nc\n```\n| a | b |\n|---|---|\n- item. With more\nLast"
    got = [(text[a:b], k) for a, b, k in evidence.segments(text)]
    assert got == [
        ("# Head", "line"), ("One sentence that is long enough, e.g. this one.", "sentence"), ("And another one follows here!", "sentence"), ("Short. x", "sentence"),
        ("```py\na. B = 1\n\nc\n```", "block"), ("| a | b |\n|---|---|", "block"), ("- item. With more", "line"), ("Last", "sentence"),
    ]
    assert evidence.segments("") == [] == evidence.segments(" \n\n") and evidence.segments("~~~\nopen")[0][2] == "block"


def test_highlights(spark):
    text = "Nothing to see in this opening line. " + "Alpha beta stand together here. " + "Gamma is alone in its own sentence. Filler " + "word " * 200 + "alpha beta gamma end."
    rows = spark.createDataFrame([(1, text), (2, text), (3, ""), (4, None)], "query_id long, text string")
    terms = spark.createDataFrame([(1, "alpha", 1.0), (1, "beta", 1.0), (1, "gamma", 1.0), (2, "unheard", 1.0), (3, "alpha", 1.0)], "query_id long, term string, weight double")
    got = {r.query_id: r.highlight for r in evidence.attach_highlights(rows, terms).collect()}
    assert got[1].text == "Alpha beta stand together here. Gamma is alone in its own sentence." and text[got[1].start : got[1].end] == got[1].text
    assert got[2].start == 0 and got[2].score == 0 and len(got[2].text) <= 600 and got[3] is None and got[4] is None


def test_expansion_and_entities(spark):
    q = spark.createDataFrame([(1, "how to tune the garbage collector"), (2, "")], "query_id long, query string")
    serp = spark.createDataFrame([(1, 1, "Garbage collector tuning guide | Site", "pause times heap pause times"), (1, 2, None, "heap sizes and pause goals")], "query_id long, rank int, title string, snippet string")
    got = [r.expansion for r in evidence.expand_queries(q, serp).where("query_id = 1").orderBy("position").collect()]
    assert got[0] == "tune garbage collector" and got[1].startswith("how to tune the garbage collector ") and got[2] == "Garbage collector tuning guide"
    texts = spark.createDataFrame([(1, "New York City and asyncio.run call in New York City. The Long Road. See example.com", "asyncio basics")], "query_id long, text string, query string")
    assert {r.entity for r in evidence.bridge_entities(texts).collect()} == {"New York City", "asyncio.run"}


def test_negative_cache_is_not_renewed(spark):
    from lodestone.streaming import windows

    at = [0, 10, 20, 34, 35, 36, 200]
    rows = spark.createDataFrame([(i, 1_700_000_000 + t, 1) for i, t in enumerate(at)] + [(10, 1_700_000_005, 2), (11, 1_700_000_005, 2)], "event_id long, t long, user_id long").selectExpr("event_id", "timestamp_seconds(t) ts", "user_id")
    assert sorted(r.event_id for r in windows.negative_cache(rows).collect()) == [0, 2, 4, 6, 10]
    assert windows.negative_cache(rows.where("false")).count() == 0


def test_rendering(spark):
    rows = [(1, i, f"Page {i}", f"https://s.example/p{i % 2}", body, 0.99 - i / 100, "2025-05-05T00:00:00Z" if i == 1 else None, 1, False) for i, body in enumerate(["See [the docs](https://d.org/x) and ![pic](a.png)\n`[code](y)`", "Beta text.", "word " * 800], 1)]
    passages = spark.createDataFrame(rows, "query_id long, index int, title string, url string, text string, score double, published_at string, parts int, from_snippet boolean")
    full = [r.rendered for r in render.render_passages(passages).orderBy("index").collect()]
    assert full[0] == "**[1]** Page 1 — <https://s.example/p1> (published 2025-05-05, score 0.98)\n> See the docs and [image: pic]\n> `[code](y)`"
    assert full[2].endswith("…") and len(full[2]) < 1600
    assert "score" not in render.render_passages(passages, detailed=False).first().rendered
    q = spark.createDataFrame([(1, "rank fusion"), (2, "nothing")], "query_id long, query string")
    sources = spark.createDataFrame([(1, "https://s.example/p1", "One", 9, True), (1, "https://s.example/p0", "Two", 1, True), (1, "https://down.example", "x", 0, False)], "query_id long, url string, title string, chunks int, ok boolean")
    got = {r.query_id: r for r in render.render_research(q, passages, sources, max_tokens=500).collect()}
    assert got[1].omitted == [3] and "_1 more passage omitted (index 3)._" in got[1].markdown and "- One — <https://s.example/p1> [1, 3] (7 more chunks)" in got[1].markdown and "down" not in got[1].markdown
    assert got[2].markdown == "# Research: nothing\n\n_No relevant passages found._"
    fragment = render.render_passages(passages, deep_links=True).where("index = 2").first().rendered
    assert "<https://s.example/p0>" in fragment  # two words are too few
    blocks = render.result_blocks(passages).first().blocks
    assert len(blocks) == 3 and '"type":"search_result"' in blocks[0]


def test_retrieve_stage(spark):
    """Two queries over chunks of three sources: caps, neighbours merged, scores from .1 to 1."""
    chunks = spark.createDataFrame([(i, f"https://{s}.org/p", s, f"{s}.org", k, "t", f"{s} own words {i} " + " ".join(f"w{i}x{j}" for j in range(30)), None, 1.0) for i, (s, k) in enumerate([("a", 0), ("a", 1), ("a", 5), ("a", 9), ("b", 0), ("c", 3)])], "doc_id long, url string, source string, domain string, chunk_index int, title string, text string, published_at string, prior double")
    lists = spark.createDataFrame([(q, 0, "bm25", "main", 1.0, i, 10.0 - i) for q in (1, 2) for i in range(6)] + [(1, 1, "bm25", "other", 0.7, 5, 3.0), (1, 1, "bm25", "other", 0.7, 4, 1.0)], "query_id long, list_no int, kind string, list_query string, weight double, doc_id long, score double")
    got = retrieve.retrieve(lists, chunks, retrieve.RetrieveOptions(top_k=4, lexical_relative=0.0)).orderBy("query_id", "index").collect()
    own = [r for r in got if r.query_id == 2]
    assert [r.doc_id for r in own] == [0, 2, 4] and own[0].parts == 2 and own[0].score == 1.0 and own[-1].score == 0.1 and [r["index"] for r in own] == [1, 2, 3]
    first = {r.doc_id: r for r in got if r.query_id == 1}
    assert first[5].matched == ["main", "other"] and first[0].matched == ["main"]
    assert retrieve.retrieve(lists.where("false"), chunks).count() == 0


def test_search_answers(spark):
    raw = spark.createDataFrame([(1, "brave", '{"web":{"results":[{"url":"https://a.org","title":"A","description":"d","page_age":"2024"},{"title":"no url"}]}}'), (1, "serper", '{"organic":[{"link":"https://b.org","title":"B"}]}'), (2, "exa", "no json"), (2, "unknown", "{}"), (3, "tavily", None)], "query_id long, provider string, body string")
    got = [(r.query_id, r.source, r["rank"], r.url, r.published_at) for r in acquisition.parse_search_json(raw).orderBy("source").collect()]
    assert got == [(1, "brave", 1, "https://a.org", "2024"), (1, "serper", 1, "https://b.org", None)]
    acquisition.register_source("own", lambda s, q: q.select("query_id"))
    assert acquisition.search("own", spark, raw).count() == 5


def test_operators_on_odd_tables(spark):
    """Nulls, ties, repeated rows and empty tables."""
    hits = spark.createDataFrame([(1, 1, "a", 1.0), (1, 2, "a", 1.0), (1, 2, "a", 1.0), (1, 3, None, None), (None, 4, "b", 0.5)], "query_id long, doc_id long, source string, score double")
    none = hits.where("false")
    assert [r.doc_id for r in selection.diversify_by_source(hits.where("query_id = 1 and score is not null"), 1, 5).collect()] == [1]
    assert selection.cap_per_source(hits, 1, 9).count() == 3 and selection.cap_per_source(none, 1, 9).count() == 0
    lists = hits.select("query_id", F.lit(0).alias("list_no"), "doc_id", "score", F.lit(1.0).alias("weight"), F.lit(1).alias("rank"))
    for how in ("rrf", "rsf", "dbsf"):
        assert fusion.fuse(lists, how).count() == 4 and fusion.fuse(lists.where("false"), how).count() == 0
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "one two three four five six"), (3, "one two three four five six"), (None, "x")], "doc_id long, text string")
    assert duplicates.shingle_pairs(docs).count() == 0 and duplicates.by_content(docs.where("false")).count() == 0
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 1.0])], "id long, v array<float>")
    near = vectors.nearest(vectors.blocks(v, "id", "v"), vectors.blocks(v, "id", "v"), 2)
    assert sorted((r.query_id, r.doc_id, r["rank"]) for r in near.collect()) == [(1, 2, 1), (1, 4, 2), (2, 1, 1), (2, 4, 2), (4, 1, 1), (4, 2, 2)]
    empty = vectors.blocks(v.where("false"), "id", "v")
    assert vectors.nearest(empty, vectors.blocks(v, "id", "v"), 2).count() == 0


def test_sessions_stream_and_batch(spark, tmp_path):
    from lodestone.streaming import windows

    rows = spark.createDataFrame([(i, f"2024-01-01 {h:02d}:00:00", 1, "view", 1.0) for i, h in enumerate((1, 1, 3, 9))], "event_id long, ts string, user_id long, event_type string, value double").selectExpr("event_id", "cast(ts as timestamp_ntz) ts", "user_id", "event_type", "value")
    assert windows.sessions(rows).count() == 3
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windows.usage_windows(stream, late="1 minute").writeStream.outputMode("complete").format("memory").queryName("usage_test").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("usage_test").count() == windows.usage_windows(rows).count()
