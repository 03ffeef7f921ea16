"""Queries do the whole job: no prefix, no row filter, no largest number of chunks."""

import math

from lodestone.plans import queries


def put(spark, d, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")


def test_lexical_queries_use_all_terms(spark, tmp_path):
    put(spark, tmp_path, "benchmark", [(1, "alpha beta gamma delta epsilon zeta alpha")], "item_id long, text string")
    put(spark, tmp_path, "documents", [(1, "zeta other words"), (2, "epsilon zeta"), (3, "nothing here")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in queries.bm25_topk(spark, str(tmp_path)).collect()}
    want = {}
    texts = {1: "zeta other words".split(), 2: "epsilon zeta".split(), 3: "nothing here".split()}
    average = sum(map(len, texts.values())) / 3
    for i, w in texts.items():
        for t in "alpha beta gamma delta epsilon zeta".split():
            df = sum(t in x for x in texts.values())
            if t in w:
                f = w.count(t) / (0.25 + 0.75 * len(w) / average)
                want[i] = want.get(i, 0) + math.log(1 + (3 - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2)
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_trigrams_of_long_texts(spark, tmp_path):
    from collections import Counter

    texts = {1: "short  text é日", 2: "long text " * 900, 3: "another long\ntext, " * 300, 4: "ab"}
    put(spark, tmp_path, "documents", [(i, t, len(t)) for i, t in texts.items()], "doc_id long, text string, n_chars long")
    got = {(r.a, r.b): r.f1 for r in queries.trigram_f1(spark, str(tmp_path)).collect()}

    def grams(t):
        t = " ".join(t.split())
        return Counter(t[i : i + 3] for i in range(len(t) - 2))

    want = {(a, a + 1): (grams(texts[a]), grams(texts[a + 1])) for a in (1, 2)}
    assert got == {k: round(2 * (x & y).total() / (x.total() + y.total()), 6) for k, (x, y) in want.items()}


def test_merge_adjacent_takes_all_chunks(spark, tmp_path):
    text = " ".join(f"Sentence number {i} has a few words of its own." for i in range(300))
    put(spark, tmp_path, "documents", [(7, text), (57, text[:3000])], "doc_id long, text string")
    got = {r.url: r for r in queries.merge_adjacent(spark, str(tmp_path)).collect()}
    assert got.keys() == {"7", "57"} and all(r.text == text[: len(r.text)] and r["first"] == 0 and r.parts == r.last + 1 for r in got.values())
    assert got["7"].text == text and got["57"].text == text[:3000].strip() and got["7"].parts == 30


def test_numbers_of_all_rows(spark, tmp_path):
    texts = ["In 2024-05-06 it cost 1,234.50 or 12%, again 12%", "none here", "7"]
    put(spark, tmp_path, "conversations", [(1, i, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    put(spark, tmp_path, "documents", list(enumerate(texts)), "doc_id long, text string")
    want = ["2024-05-06 1234.50 12%", "", "7"]
    assert [r.numbers for r in queries.extract_numbers(spark, str(tmp_path)).orderBy("turn").collect()] == want
    assert [r.numbers for r in queries.QUERIES["extract_numbers_documents"](spark, str(tmp_path)).where("doc_id >= 0").orderBy("doc_id").collect()] == want


def test_chunks_of_very_long_texts(spark, tmp_path):
    text = " ".join(f"Sentence number {i} has a few words of its own." for i in range(12000))
    put(spark, tmp_path, "documents", [(7, text)], "doc_id long, text string")
    got = queries.chunk_tokens(spark, str(tmp_path)).orderBy("chunk_index").collect()
    assert len(got) > 200 and got[0].start == 0 and got[-1].end == len(text) and all(a.end >= b.start for a, b in zip(got, got[1:]))
    merged = queries.merge_adjacent(spark, str(tmp_path)).collect()
    assert len(merged) == 1 and merged[0].text == text and merged[0].parts > 200


def test_stems_and_tokens_of_documents(spark, tmp_path):
    put(spark, tmp_path, "benchmark", [(1, "word")], "item_id long, text string")
    put(spark, tmp_path, "documents", [(1, "stories walking walking"), (2, "stories")], "doc_id long, text string")
    got = {r.token: r.stem for r in queries.QUERIES["light_stem_documents"](spark, str(tmp_path)).collect()}
    assert got == {"stories": "story", "walking": "walk"}
    assert {r.doc_id for r in queries.tokenize_full(spark, str(tmp_path)).collect()} == {1, 2}
