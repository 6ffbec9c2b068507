import shutil

import corpus_pipeline
from veritab.llm import queries

from .edges import docs, empty, rows
from .test_models import brute_components


def folder(spark, tmp_path, df):
    df.write.parquet(f"{tmp_path}/documents.parquet")
    leak = "which of the following rivers runs through the largest number of countries before it meets the sea"
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), leak


def test_stages(spark, tmp_path):
    path, leak = folder(spark, tmp_path, docs(spark))
    extra = [(300, f"some say {leak} and that is all", "en", "s1", 9, "x", "y", 1), (301, "write to ann@site.org about the old house by the river", "en", "s1", 9, "x", "y", 1)]
    given = docs(spark).union(spark.createDataFrame(extra, docs(spark).schema))
    now = given
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, path)
        if i < 4:
            assert now.columns == given.columns
        now.write.parquet(f"{tmp_path}/out{i}")
        now = spark.read.parquet(f"{tmp_path}/out{i}")
        seen[name] = now.collect()
    ids = {name: {r.doc_id for r in got} for name, got in seen.items()}
    words = {i: t for i, t, *_ in rows() + extra if i is not None and t and any(c.isalpha() for c in t)}
    assert ids["language"] - {None} == set(words)
    texts = {r.doc_id: r.text for r in seen["language"] if r.doc_id is not None}
    assert ids["near duplicates"] - {None} == {i for i, (_, c) in brute_components(texts, 5, 80).items() if c == i}
    assert 300 in ids["near duplicates"] and 300 not in ids["decontamination"]
    assert ids["near duplicates"] - {300} == ids["decontamination"]
    assert next(r.text for r in seen["personal data"] if r.doc_id == 301) == "write to <EMAIL> about the old house by the river"
    assert all(r.taken > 0 for r in seen["mix"]) and "target" in seen["mix"][0].asDict()
    shutil.rmtree(f"{tmp_path}/out0")


def test_run_and_empty(spark, tmp_path):
    path, _ = folder(spark, tmp_path, empty(spark))
    assert corpus_pipeline.run(spark, path).count() == 0


def test_every_operator_has_a_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14))
