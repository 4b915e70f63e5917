import corpus_pipeline
from inkprobe.llm import queries


def test_stages_decide_as_their_operators_do(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    n = docs.count()
    stage = dict(corpus_pipeline.STAGES)
    told = stage["language"](spark, docs, folder)
    assert told.columns == docs.columns and told.count() == n  # every document has letters
    single = stage["exact dedup"](spark, told, folder)
    marks = queries.op4_exact_dedup(spark, folder)
    assert sorted(r.doc_id for r in single.collect()) == sorted(r.doc_id for r in marks.filter("kept").collect())
    near = stage["simhash near-dedup"](spark, single, folder)
    groups = queries.op5_simhash(spark, folder).filter("doc_id = component_id").select("doc_id")
    assert sorted(r.doc_id for r in near.collect()) == sorted(r.doc_id for r in groups.collect())
    clean = stage["decontamination"](spark, near, folder)
    bad = queries.op1_decontamination(spark, folder).filter("contaminated").select("doc_id")
    want = near.select("doc_id").exceptAll(near.select("doc_id").intersect(bad))
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in want.collect())
    coded = stage["sentencepiece"](spark, clean, folder)
    assert coded.count() == clean.count() and coded.filter("NOT round_trip").count() == 0


def test_run_equals_the_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    got = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, got.collect())) == sorted(map(str, docs.collect()))


def test_odd_rows_and_empty_tables(spark, docs, no_docs):
    folder = "/root/testdata/sf0.001"
    out, none = docs, no_docs
    for _, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, out, folder), stage(spark, none, folder)
    assert none.count() == 0
    # Fox texts 1, 2 equal; 10 differs only in letter case; the rest are single.
    assert sorted((r.doc_id or -1) for r in out.collect()) == [-1, 1, 6, 11]
