from collections import Counter

import pytest

import corpus_pipeline
from docquery.llm import jaccard, kdtree, mixing, tiling
from docquery.llm import toxicity as svm
from tests.llm.test_jaccard import brute as similar


@pytest.fixture(scope="session")
def folder(tmp_path_factory, hostile, labels, benchmark):
    root = tmp_path_factory.mktemp("tables")
    hostile.write.parquet(f"{root}/documents.parquet")
    labels.write.parquet(f"{root}/labels.parquet")
    benchmark.write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixture", "shards"]


def test_hostile_tables(spark, folder, hostile, empty):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        assert set(out.columns) - set(docs.columns) == (set() if i < 4 else {"kd_shard"})
        assert stage(spark, docs.where("1 = 0"), folder).count() == 0
        out.count()
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_run_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = svm.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [r for r in docs.collect()]
    scores = model.scores([r["text"] for r in rows])
    rows = [r for r, s in zip(rows, scores) if s <= model.cut]
    root = {r["doc_id"]: r["doc_id"] for r in rows}
    pairs = similar([(r["doc_id"], r["text"]) for r in rows], jaccard.N, jaccard.THRESHOLD)
    for _ in rows:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    rows = [r for r in rows if root[r["doc_id"]] == r["doc_id"]]
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    found = tiling.Benchmark([r["item_id"] for r in items], [r["text"] for r in items]).leaks([r["text"] for r in rows], tiling.THRESHOLD)
    rows = [r for r, f in zip(rows, found) if not f]
    kept = spark.createDataFrame(rows, docs.schema)
    copies = Counter(r["doc_id"] for r in mixing.mixture(kept).collect())
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == [*docs.columns, "shard"]
    got = out.collect()
    assert Counter(r["doc_id"] for r in got) == copies
    assert {r["shard"] for r in got} == {0}  # below the target


def test_shards_of_the_last_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert kdtree.shard_documents(docs, 30_000).select("shard").distinct().count() > 5
