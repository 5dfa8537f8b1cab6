"""Each stage of the pipeline on small tables, against the plain reading of what it should do."""

import corpus_pipeline as P
from pyspark.sql import functions as F

from .conftest import sorted_rows
from .test_dedup import brute_components, brute_exact, brute_fingerprint


def stage(name):
    return dict(P.STAGES)[name]


def test_exact_stage(spark, docs, rows, data):
    got = stage("exact dedup")(spark, docs, data)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(r[0] for r in brute_exact(rows) if r[3])


def test_near_stage(spark, docs, rows, data):
    fp = {i: brute_fingerprint(t) for i, t, *_ in rows}
    want = brute_components(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    got = stage("SimHash near-dedup")(spark, docs, data)
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i, c in want.items() if i == c)


def test_stages_on_empty_and_clashing_tables(spark, empty, clashing, data):
    for name, f in P.STAGES:
        assert f(spark, empty, data).count() == 0, name
    for name, f in P.STAGES[:-1]:
        assert f(spark, clashing, data).columns == clashing.columns, name


def test_language_stage_keeps_clean_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert stage("language ID")(spark, docs, data).count() == docs.count()


def test_run_is_the_stages_in_turn(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    step = docs
    for _, f in P.STAGES:
        step = f(spark, step, data)
    got = P.run(spark, data)
    assert got.columns == ["doc_id", "ids", "n_tokens"]
    assert sorted_rows(got) == sorted_rows(step)
    assert got.filter(F.size("ids") != F.col("n_tokens")).count() == 0
