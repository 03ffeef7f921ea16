"""Steps whose memory and shuffles must not grow faster than the input, against plain models."""

import random
import re

from pyspark.sql import functions as F

from lodestone.operators import bm25
from lodestone.plans import queries, research

WORDS = [f"w{i}" for i in range(12)] + ["é", "日本"]


def corpus(spark, n=60, seed=1):
    """Documents with copies, an empty one, and queries with unknown terms."""
    random.seed(seed)
    docs = [(i, [random.choice(WORDS) for _ in range(random.randrange(0, 40))]) for i in range(n)]
    docs += [(n + i, w) for i, w in docs[:10]] + [(2 * n, [])]
    asked = [(q, t) for q in range(7) for t in random.sample([*WORDS, "unheard"], random.randrange(1, 8))]
    return spark.createDataFrame(docs, "doc_id long, body array<string>").repartition(3), spark.createDataFrame(asked, "query_id long, term string")


def indexed(docs):
    return docs.select("doc_id", F.lit("body").alias("field"), F.posexplode("body").alias("pos", "term"))


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def put(spark, d, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")


def texts(spark, d):
    random.seed(5)
    put(spark, d, documents=([(i, "\n".join(" ".join(random.choices(WORDS, k=9)) for _ in range(4)), f"s{i % 3}", "en") for i in range(30)], "doc_id long, text string, source string, lang string"), benchmark=([(i, " ".join(random.sample(WORDS, 5))) for i in range(4)], "item_id long, text string"))
    return str(d)


def test_spans_equal_the_index(spark, monkeypatch):
    docs, asked = corpus(spark)
    want = {(r.query_id, r.doc_id): (round(r.bonus, 9), r.span) for r in bm25.proximity(asked, bm25.postings(indexed(docs), positions=True), docs.count()).collect()}
    for most in (4096, 3):
        monkeypatch.setattr(bm25, "QUERIES", most)
        assert {(r.query_id, r.doc_id): (round(r.bonus, 9), r.span) for r in bm25.spans(docs, asked).collect()} == want and want
    assert bm25.spans(docs.where("false"), asked).count() == 0 == bm25.spans(docs, asked.where("false")).count()


def test_spans_of_long_texts(spark):
    """More occurrences than are spread out at once, of one document and of many."""
    random.seed(2)
    docs = spark.createDataFrame([(1, random.choices(WORDS, k=30000)), (2, ["w1"] * 70000 + ["w2"]), *[(i, random.choices(WORDS, k=300)) for i in range(3, 120)]], "doc_id long, body array<string>").coalesce(1)
    asked = spark.createDataFrame([(q, t) for q in range(40) for t in random.sample(WORDS, 9)], "query_id long, term string")
    want = {(r.query_id, r.doc_id): r.span for r in bm25.proximity(asked, bm25.postings(indexed(docs), positions=True), docs.count()).collect()}
    assert {(r.query_id, r.doc_id): r.span for r in bm25.spans(docs, asked).collect()} == want


def test_proximity_moves_no_documents(spark, tmp_path):
    assert "Exchange hashpartitioning" not in plan(queries.proximity_bonus(spark, texts(spark, tmp_path)))


def test_search_equals_the_index(spark, monkeypatch):
    docs, asked = corpus(spark)
    options = [bm25.Bm25Options(), bm25.Bm25Options(delta=0.0), bm25.Bm25Options(coverage=0.4), bm25.Bm25Options(variant="bmx"), bm25.Bm25Options(proximity=0.3)]
    posts, lengths = bm25.postings(indexed(docs), positions=True), docs.select("doc_id", F.lit("body").alias("field"), F.size("body").cast("long").alias("len"))
    want = {}
    for no, o in enumerate(options):
        rows = bm25.scores(asked, posts, lengths, docs.count(), o).withColumn("score", F.round("score", 9))
        want |= {(no, r.query_id, r["rank"]): (r.doc_id, r.score, r.present) for r in bm25.top_k(rows, 4).collect()}
    for most, pairs in ((4096, 1 << 15), (3, 20)):
        monkeypatch.setattr(bm25, "QUERIES", most)
        monkeypatch.setattr(bm25, "PAIRS", pairs)
        got = {(r.list_no, r.query_id, r["rank"]): (r.doc_id, r.score, r.present) for r in bm25.search(docs, asked, 4, *options).collect()}
        assert got.keys() == want.keys() and all(got[k][::2] == want[k][::2] and abs(got[k][1] - want[k][1]) < 2e-9 for k in want)
    assert bm25.search(docs.where("false"), asked, 4, *options).count() == 0 == bm25.search(docs, asked.where("false"), 4, *options).count()


def test_searches_shuffle_only_the_best(spark, tmp_path):
    """No row for each query, term and document; documents stay where they are."""
    d = texts(spark, tmp_path)
    for name in ("bm25_topk", "bm25_plus", "bm25_coverage", "bm25_bmx", "bm25_fields", "prf_terms", "evidence_levels", "highlights", "query_expansion"):
        got = re.sub(r"#\d+L?", "", plan(queries.QUERIES[name](spark, d)))
        assert not re.search(r"hashpartitioning\((doc_id|term\b)", got), name


def test_stage_moves_only_documents_found(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(research.retrieve, "retrieve", lambda lists, chunks, opts: chunks)
    chunks = research.stage(spark, texts(spark, tmp_path))
    assert chunks.count() == 30 and re.search(r"BroadcastHashJoin \[doc_id#\d+L\], \[doc_id#\d+L\], LeftSemi", plan(chunks))


def test_python_holds_runs_of_a_batch():
    """Runs keep within their size, in order, none is lost; arrays come out as for the whole."""
    import pyarrow as pa

    from lodestone.functions import common, text

    assert list(common.runs([3, 3, 3, 20, 1], 6)) == [(0, 2), (2, 3), (3, 4), (4, 5)] and list(common.runs([], 6)) == []
    most = []
    done = common.in_runs(pa.array(["a" * 400_000, None, "b" * 700_000, "c"] * 3), lambda x: most.append(sum(len(t or "") for t in x)) or pa.array([len(t or "") for t in x], pa.int64()))
    assert done.to_pylist() == [400_000, 0, 700_000, 1] * 3 and max(most) <= common.HELD and len(most) > 1
    assert text.tokenize("Café e-mail İstanbul") == ["e-mail", "cafe", "mail", "istanbul"]


def test_segments_and_tokens_column(spark):
    from lodestone.functions import text
    from lodestone.operators import evidence

    rows = spark.createDataFrame([(1, "Sentence one is long enough. Sentence two is long enough too."), (2, None), (3, "")], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.t, r.s) for r in rows.select("doc_id", text.full_tokens(F.col("text")).alias("t"), evidence.segment_column(F.col("text")).alias("s")).collect()}
    assert [x.token for x in got[1][0]][:3] == ["sentence", "one", "long"] and got[2] == ([], []) == got[3]
    assert [x.kind for x in got[1][1]] == ["sentence"] * 2 and got[1][1][0].words == "sentence one is long enough".split() and "one" in got[1][1][0].terms
    assert evidence.sentence_split(rows).columns == ["doc_id", "position", "start", "end", "kind", "text"]


def test_pages_and_chunks_in_runs(spark, monkeypatch):
    from lodestone.operators import chunking, html

    pages = spark.createDataFrame([(i, "u", f"<p>{'word ' * 60000}</p>" if i % 3 else None) for i in range(12)], "page_id long, url string, html string").coalesce(1)
    assert [len(r.markdown) for r in html.extract_pages(pages).orderBy("page_id").collect()] == [299_999 if i % 3 else 0 for i in range(12)]
    docs = spark.createDataFrame([(i, "word " * 60000) for i in range(8)], "doc_id long, text string").coalesce(1)
    assert chunking.chunk_documents(docs).groupBy("doc_id").count().where("count > 100").count() == 8


def test_merge_in_one_pass(spark):
    """Overlaps as by trying every length; gaps, repeated queries, null urls and scores; more text than is held at once."""
    from lodestone.operators import greedy

    random.seed(4)
    for _ in range(2000):
        a, b = ("".join(random.choices("ab", k=random.randrange(0, 60))) for _ in range(2))
        b = a[-random.randrange(0, 45) :] + b if random.random() < 0.5 else b
        assert greedy.shared_end(a, b) == next((n for n in range(min(len(a), len(b), 2000), 19, -1) if a.endswith(b[:n])), 0)
    rows = [(q, f"u{u}", k, f"q{q} u{u} k{k} " + "x" * 9000, None if k == 1 else k / 10) for q in range(40) for u in range(3) for k in (0, 1, 2, 4)] + [(7, None, 3, None, 0.5)]
    got = {(r.query_id, r.url, r["first"]): r for r in greedy.merge_adjacent(spark.createDataFrame(rows, "query_id long, url string, chunk_index int, text string, score double")).collect()}
    assert len(got) == 241 and got[5, "u2", 0].parts == 3 and got[5, "u2", 0].score == 0.2 and got[5, "u2", 4].parts == 1 and got[7, None, 3].text == ""
    assert len(got[5, "u2", 0].text) > 27000 and got[5, "u2", 0].text.endswith("k2 " + "x" * 9000)
    assert "FlatMapGroupsInPandas" not in plan(greedy.merge_adjacent(spark.createDataFrame(rows, "query_id long, url string, chunk_index int, text string, score double")))


def test_verification_copies_no_source(spark):
    """Sentences meet their sources in one row; likeness is that of all windows."""
    from lodestone.operators import evidence

    random.seed(6)
    for _ in range(200):
        segs = [random.choices("abcdef", k=random.randrange(0, 9)) for _ in range(random.randrange(0, 5))]
        words = random.choices("abcdef", k=random.randrange(3, 9))
        windows = [w for w in [*segs, *(a + b for a, b in zip(segs, [*segs[1:], []]))] if w]
        runs = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
        want = (max((len(runs(words) & runs(w)) / len(runs(words) | runs(w)) for w in windows), default=0.0), max((evidence.rouge_l(words, w) for w in windows), default=0.0))
        assert evidence.Source(1, 0, "", segs).closeness(words) == want
    answers = spark.createDataFrame([(1, "One two three four. Two three four five [1].")], "answer_id long, text string")
    sources = spark.createDataFrame([(1, 1, "Two three four five.")], "answer_id long, index int, text string")
    rows = evidence.verify_answers(answers, sources)
    assert [r.status for r in rows.orderBy("position").collect()] == ["paraphrase", "verbatim"]
    assert not re.search(r"hashpartitioning\(answer_id#\d+L, position", plan(rows))


def test_minhash_by_arrays(spark):
    """Keys are those of Spark's own hash functions, in runs of any size."""
    import numpy as np

    from lodestone.operators import duplicates

    values = [0, 1, -1, 2**63 - 1, -(2**63), 123456789012345]
    frame = spark.createDataFrame([(v,) for v in values], "v long")
    x = np.array(values, np.int64).view(np.uint64)
    assert [r[0] for r in frame.select(F.xxhash64("v", F.lit(63))).collect()] == duplicates.hash_int(63, duplicates.hash_long(x, np.uint64(42))).view(np.int64).tolist()
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, "A b c d e f g h!"), (3, "other words altogether"), (4, None), (5, ""), (6, "a " * 9000 + "b c")], "doc_id long, text string")
    got = duplicates.minhash_candidates(docs)
    assert sorted((r.band, r.first_id, r.doc_id) for r in got.collect()) == [(b, 1, 2) for b in range(16)]
    assert "array_min" not in plan(got)


def test_near_copies_by_places(spark, monkeypatch):
    """All pairs alike, copies once, whatever order the table of places gives; sets are not grouped by their hashes."""
    from lodestone.functions import text
    from lodestone.operators import duplicates

    random.seed(8)
    base = [random.choices([f"x{i}" for i in range(50)], k=random.randrange(3, 60)) for _ in range(12)]
    docs = [" ".join(w) for w in base] + [" ".join([*w[: len(w) // 2], "new", *w[len(w) // 2 + random.randrange(2) :]]) for w in base for _ in range(3)]
    docs += docs[:20] + ["", "same same same"]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    sets = {r.doc_id: frozenset(r.s) for r in frame.select("doc_id", text.shingles(text.simple_tokens(F.col("text")), 3).alias("s")).collect() if r.s}
    firsts = {}
    for i in sorted(sets):
        firsts.setdefault(sets[i], i)
    ids = sorted(firsts.values())
    want = {(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    for places in (1 << 20, 4):
        monkeypatch.setattr(duplicates, "PLACES", places)
        rows = duplicates.shingle_pairs(frame, 3, 0.7)
        assert {(r.a, r.b) for r in rows.collect()} == want and want
    assert not re.search(r"hashpartitioning\(h#", plan(rows)) and duplicates.shingle_pairs(frame.where("false")).count() == 0
