"""The corpus pipeline: each stage against what its operator says of the stage's own input."""

import corpus_pipeline
from trackloom.llm import contam, exact, pieces, toxic

from test_text_operators import near_components

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, ids = docs.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        before = sorted(r.doc_id for r in docs.select("doc_id").collect())
        kept = sorted(r.doc_id for r in out.select("doc_id").collect())
        if name == "toxicity":
            model = toxic.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
            want = [r.doc_id for r in toxic.score(docs, model, ["doc_id"]).where("score < 0.5").collect()]
        elif name == "exact_dedup":
            want = [r.doc_id for r in exact.exact_duplicates(docs).where("kept").collect()]
        elif name == "near_dedup":
            want = set(near_components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]).values())
        elif name == "decontamination":
            found = contam.find(docs, spark.read.parquet(f"{DATA}/benchmark.parquet"), ["doc_id"])
            want = [r.doc_id for r in found.where(f"NOT ({contam.contaminated()})").collect()]
        else:
            want = before
            made = {r.doc_id: r.ids for r in pieces.encode(docs, pieces.model_bytes(), "doc_id").collect()}
            assert all(r.ids == made[r.doc_id] and r.n_tokens == len(r.ids) for r in out.collect())
        assert kept == sorted(want)
        assert i + 1 == len(corpus_pipeline.STAGES) or out.columns == columns
        ids.append(kept)
        docs = out
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, DATA).select("doc_id").collect()) == ids[-1]


def test_stages_take_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, None), (2, "", "en", "s", 0, None), (None, "a b c", "en", "s", 5, None), (3, "w " * 50_000, "en", "s", 1, None)]
    for data in (rows, []):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, spark.createDataFrame(data, schema), DATA).count()
