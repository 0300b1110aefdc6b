import random
import time

import numpy as np

from docquery.llm import tiling
from docquery.llm.tiling import tile
from docquery.llm.vec import Words


def brute(p, d, least):
    """Greedy tiling by comparing everything: the longest match first, then by position."""
    fp, fd, out = [True] * len(p), [True] * len(d), []
    while True:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(d)):
                k = 0
                while i + k < len(p) and j + k < len(d) and fp[i + k] and fd[j + k] and p[i + k] == d[j + k]:
                    k += 1
                if k >= least and k > best[0]:
                    best = (k, i, j)
        if not best[0]:
            return out
        k, i, j = best
        out.append((i, j, k))
        fp[i : i + k] = fd[j : j + k] = [False] * k


def test_tiles_against_brute_force():
    random.seed(1)
    for _ in range(300):
        kinds = random.choice([2, 3, 6])
        p, d = (np.array([random.randrange(kinds) for _ in range(random.randrange(n))], np.uint64) for n in (30, 40))
        least = random.choice([1, 2, 3])
        assert tile(p, d, least) == brute(p.tolist(), d.tolist(), least)


def test_documents_against_brute_force(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "benchmark"))
    items = [(r["item_id"], Words([r["text"]]).hash.tolist()) for r in bench.collect()]
    want = set()
    for r in docs.collect():
        words = Words([r["text"] or ""]).hash.tolist()
        for i, item in items:
            if len(item) >= 5 and len(set(item) & set(words)) * 2 >= len(set(item)):
                covered = sum(k for _, _, k in tile(np.array(item, np.uint64), np.array(words, np.uint64), 5)) / len(item)
                if covered >= 0.5:
                    want.add((r["doc_id"], i, round(covered, 6)))
    for slices in (10**6, 50):
        got = {(r["doc_id"], r["item_id"], r["coverage"]) for r in tiling.contaminated(docs, bench, slice_seeds=slices).collect()}
        assert got == want and got


def test_reordered_passages_are_found(spark):
    words = [f"q{i}" for i in range(40)]
    shuffled = words[20:30] + ["x"] + words[0:10] + ["y"] + words[30:40] + words[10:20]
    docs = spark.createDataFrame([(1, " ".join(shuffled)), (2, " ".join(words[:12])), (3, " ".join(words[::-1]))], "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(words))], "item_id long, text string")
    (r,) = tiling.contaminated(docs, bench).collect()
    assert (r["doc_id"], r["item_id"], r["coverage"], r["tiles"]) == (1, 9, 1.0, 4)


def test_hostile_rows(hostile, benchmark, empty):
    got = sorted(((r["doc_id"], r["item_id"]) for r in tiling.contaminated(hostile, benchmark).collect()), key=repr)
    passage = [(d, i) for d in (10, 11, None) for i in (1, 1, None)]  # item 4, of two words, is nowhere as a whole
    assert got == sorted(passage + [(5, 5), (5, 5), (6, 5), (7, 5)], key=repr)
    kept = tiling.decontaminate(hostile, benchmark)
    assert kept.columns == hostile.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([None, None, 1, 2, 3, 4, 7, 8, 9], key=repr)
    assert tiling.contaminated(empty, benchmark).count() == 0
    assert tiling.decontaminate(hostile, benchmark.where("1 = 0")).count() == hostile.count()


def test_short_items_are_matched_as_a_whole(spark):
    docs = spark.createDataFrame([(1, "an answer of just three words here"), (2, "just three"), (3, "just three words"), (4, "three just words"), (5, "forty-two")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "Just three words!"), (8, "forty two"), (9, "...")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["coverage"], r["tiles"]) for r in tiling.contaminated(docs, bench).collect()}
    assert got == {(1, 7, 1.0, 1), (3, 7, 1.0, 1), (5, 8, 1.0, 1)}
    assert {r["doc_id"] for r in tiling.contaminated(docs, bench, slice_seeds=1).collect()} == {1, 3, 5}


def test_repeated_words_take_no_quadratic_time():
    one = np.zeros(5_000, np.uint64)
    began = time.perf_counter()
    assert tile(one[:1000], one) == [(0, 0, 1000)]
    assert tile(np.tile(np.arange(2, dtype=np.uint64), 500), np.tile(np.arange(2, dtype=np.uint64), 5000))[0] == (0, 0, 1000)
    assert time.perf_counter() - began < 5
