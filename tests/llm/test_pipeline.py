"""The pipeline against its stages' own results on a small table."""

import corpus_pipeline
from kinespark.llm import decontaminate, mixing, quality, secrets

from test_similar import classes

DATA = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-dedup", "decontamination", "secret scans", "mixing"]
    kept = quality.clean(docs)
    good = {r["doc_id"] for r in quality.measure(docs).collect() if r["kept"]}
    assert {r["doc_id"] for r in kept.collect()} == good
    first = set(classes([(r["doc_id"], r["text"]) for r in kept.collect()]).values())
    index = decontaminate.Index([tuple(r) for r in bench.collect()])
    text = {r["doc_id"]: r["text"] for r in kept.collect()}
    clean = {k for k in first if not decontaminate.find(index, text[k])}
    out = corpus_pipeline.run(spark, DATA).collect()
    assert {r["doc_id"] for r in out} == clean
    one = spark.createDataFrame([(k, text[k], r["source"]) for r in kept.collect() if (k := r["doc_id"]) in clean], "doc_id long, text string, source string")
    want = mixing.mix(secrets.redact(one)).collect()
    assert sorted((r["doc_id"], r["size"]) for r in out) == sorted((r["doc_id"], r["size"]) for r in want)


def test_stages_keep_columns_and_take_empty_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and out.count() == 0
