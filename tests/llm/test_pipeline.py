"""The stages one after the other, each on what its predecessor kept."""

import corpus_pipeline
from lodestone.llm import personal_data, simhash


def test_stages(spark, rows, docs, labels, tmp_path):
    more = [(900, "you idiot and moron, worthless scum. " * 5), (901, "write to jo@mail.example.com today please"), (902, rows[3][1])]
    table = docs.unionByName(spark.createDataFrame([(i, t, "en", "s1", len(t), 7, 0.5, "x") for i, t in more], docs.schema))
    table.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    before = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        before = spark.read.parquet(str(tmp_path / f"out{k}"))
        kept[name] = before
        if name != "packing":
            assert before.columns == list(corpus_pipeline.COLUMNS)
    ids = {n: {r.doc_id for r in t.collect()} for n, t in kept.items()}
    assert 900 not in ids["toxicity"] and 901 in ids["toxicity"]
    assert {100, 101, 902} & ids["simhash_near_dedup"] == set() and 3 in ids["simhash_near_dedup"]
    assert ids["personal_data"] == ids["simhash_near_dedup"]
    assert next(r.text for r in kept["personal_data"].collect() if r.doc_id == 901) == "write to <EMAIL> today please"
    assert ids["packing"] == ids["mixing"] <= ids["personal_data"]
    texts = {r.doc_id: r.text for r in kept["simhash_near_dedup"].collect()}
    marks = [simhash.fingerprint_of((t or "").encode(), 3) for t in texts.values()]
    assert len(set(marks)) == len(marks) and not any(personal_data.find_spans(r.text or "")[0]["email"] for r in kept["personal_data"].collect())
