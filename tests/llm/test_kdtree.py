import math
from collections import Counter

import xxhash

from docquery.llm import kdtree


def points_of(docs):
    """(doc_id, coordinates, bytes) of each row, from what the docstring says."""
    rows = [r.asDict() for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    langs, sources = (sorted({r[c] or "" for r in rows}, key=str.encode) for c in ("lang", "source"))
    out = []
    for r in rows:
        n = r["n_chars"] if r["n_chars"] is not None else len(r["text"] or "")
        h = 42 if r["doc_id"] is None else xxhash.xxh64_intdigest(r["doc_id"].to_bytes(8, "little", signed=True), 42)
        out.append((r["doc_id"], (langs.index(r["lang"] or ""), sources.index(r["source"] or ""), math.floor(math.log2(max(n, 0) + 1) * 65536), h >> 1), len((r["text"] or "").encode())))
    return out


def brute(points, target, held):
    """Leaves as lists of point indexes, from the left."""
    whole = [max(1, max(p[1][d] for p in points) - min(p[1][d] for p in points)) for d in range(4)]

    def split(rows):
        total = sum(points[i][2] for i in rows)
        coarse = len({points[i][1] for i in rows}) > held
        value = lambda i, d: points[i][1][d] >> (kdtree.COARSE[d] if coarse else 0)
        if coarse and all(len({value(i, d) for i in rows}) == 1 for d in range(4)):
            value = lambda i, d: points[i][1][d]
        able = [d for d in range(4) if len({value(i, d) for i in rows}) > 1]
        if total <= target or not able:
            return [rows]
        spread = [max(points[i][1][d] for i in rows) - min(points[i][1][d] for i in rows) for d in range(4)]
        d = max(able, key=lambda d: (spread[d] / whole[d], -d))
        at, run = None, 0
        values = sorted({value(i, d) for i in rows})
        for v in values:
            run += sum(points[i][2] for i in rows if value(i, d) == v)
            if run * 2 >= total:
                at = v
                break
        if at == values[-1]:
            at = values[-2]
        return split([i for i in rows if value(i, d) <= at]) + split([i for i in rows if value(i, d) > at])

    return split(list(range(len(points))))


def check(docs, target, held=kdtree.HELD):
    points = points_of(docs)
    leaves = brute(points, target, held)
    want = Counter((points[i][0], n, points[i][2]) for n, leaf in enumerate(leaves) for i in leaf)
    sharded = kdtree.KdSharding(docs, target, held).shard(docs)
    assert Counter((r["row"]["doc_id"], r["shard"], r["bytes"]) for r in sharded.collect()) == want
    return leaves


def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(check(docs, 20_000)) > 10
    for held in (60,):  # distributed levels first
        assert len(check(docs, 20_000, held)) > 10
    got = kdtree.shards(docs, 20_000).collect()
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["bytes"]
    assert len(got) == docs.count() and set(sizes) == set(range(len(sizes)))
    assert max(sizes.values()) <= max(20_000, max(r["bytes"] for r in got))


def test_one_homogeneous_source(spark):
    """3000 documents that differ in nothing but doc_id make leaves of at most the target, over 100 of them."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('x', 100) AS text", "'en' AS lang", "'src' AS source", "100L AS n_chars")
    for held in (kdtree.HELD, 500):
        sizes = [r["n"] for r in kdtree.shards(docs, 2500, held).groupBy("shard").agg(kdtree.F.sum("bytes").alias("n")).collect()]
        assert len(sizes) >= 120 and max(sizes) <= 2500


def test_hostile_rows(hostile, empty):
    check(hostile, 100)
    check(hostile, 100, 3)
    out = kdtree.shard_documents(hostile, 100)
    assert out.columns == [*hostile.columns, "kd_shard"] and out.count() == hostile.count()
    same = {r["kd_shard"] for r in out.where("doc_id = 5").collect()}
    assert len(same) == 1  # repeated rows can't be parted
    assert {r["shard"] for r in kdtree.shards(hostile).collect()} == {0}
    assert kdtree.shards(empty).count() == 0 and kdtree.shard_documents(empty).count() == 0


def test_tree_does_not_depend_on_held(spark):
    """The same rows in the same shards whether a level is distributed or not; most lengths are in the bin that has the median."""
    rows = [(i, "x" * 100, "en", "src", 1000 + i if i < 60 else 5000) for i in range(61)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    trees = [sorted((r["doc_id"], r["shard"]) for r in kdtree.shards(docs, 3500, held).collect()) for held in (kdtree.HELD, 40)]
    assert trees[0] == trees[1] and [s for _, s in trees[0]] == [0] * 31 + [1] * 30
