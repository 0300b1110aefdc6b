import random
from fractions import Fraction

import numpy as np
import pytest

from docquery.llm import jaccard
from docquery.llm.vec import Words


def sets_of(rows, n):
    out = {}
    for i, text in rows:
        g = Words([text]).grams(n)[0]
        if i is not None and len(g):
            out.setdefault(i, []).append(set(g.tolist()))
    return out


def brute(rows, n, t):
    """Pairs of documents that some of their sets join."""
    every = [(i, s) for i, ss in sets_of(rows, n).items() for s in ss]
    return {(a, b): len(x & y) / len(x | y) for a, x in every for b, y in every if a < b and len(x & y) >= Fraction(t) * len(x | y)}


@pytest.mark.parametrize("n,t", [(1, "0.5"), (2, "0.7"), (3, "1"), (1, "0.05")])
def test_against_brute_force(spark, n, t):
    random.seed(n)
    base = [[f"w{random.randrange(40)}" for _ in range(random.randrange(1, 25))] for _ in range(25)]
    rows = []
    for i in range(90):
        w = list(random.choice(base))
        for _ in range(random.randrange(3)):
            w[random.randrange(len(w))] = f"w{random.randrange(40)}"
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_a"], r["doc_b"]): r["jaccard"] for r in jaccard.similar_documents(d, n, t).collect()}
    want = brute(rows, n, t)
    assert got.keys() == want.keys()
    assert all(abs(got[p] - want[p]) < 1e-6 for p in got)


def test_hostile_rows(hostile):
    got = {(r["doc_a"], r["doc_b"]) for r in jaccard.similar_documents(hostile, 3, "0.6").collect()}
    assert got == {(5, 6), (5, 7), (6, 7), (10, 11)}  # of 7's two texts one resembles 5's


def test_keep_one(hostile):
    kept = jaccard.keep_one(hostile, 3, "0.6")
    assert kept.columns == hostile.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=repr)
    want = sorted([None, None, None, 1, 2, 3, 4, 5, 7, 8, 9, 10], key=repr)
    assert ids == want
    assert [r["text"] for r in kept.where("doc_id = 7").collect()] == ["another text under the same id"]


def test_empty_table(empty):
    assert jaccard.similar_documents(empty).count() == 0
    assert jaccard.keep_one(empty).count() == 0


def test_candidates_lose_no_pair():
    rng = np.random.default_rng(3)
    s = jaccard.Sizes("0.5")
    sets = [np.unique(rng.integers(1, 14, rng.integers(1, 20)).astype(np.uint64)) for _ in range(120)]
    entries = [(int(k), int(p), i, len(x), j) for i, x in enumerate(sets) for j, (k, p) in enumerate(zip(x[: s.prefix(len(x))], [0, *(x << np.uint64(1) | np.uint64(1)).tolist()]))]
    columns = [np.array(c, np.int64) for c in zip(*entries)]
    found = {(a, b) for x, y in jaccard.pairs_of_lists(*columns, s) for a, b in zip(x.tolist(), y.tolist())}
    want = {(a, b) for a in range(120) for b in range(a + 1, 120) if 2 * len(np.intersect1d(sets[a], sets[b])) >= len(np.union1d(sets[a], sets[b]))}
    same = {(a, b) for a, b in want if np.array_equal(sets[a], sets[b])}  # equal sets have equal ids in production
    assert len(want - same) > 500 and not want - found


def test_overlaps_from_differences():
    rng = np.random.default_rng(4)
    sets = {i: np.unique(rng.integers(0, 50, 30).astype(np.uint64)) for i in range(12)}
    a, b = np.array([x for x in sets for y in sets if x < y]), np.array([y for x in sets for y in sets if x < y])
    assert jaccard.verify(sets[0], sets, a, b).tolist() == [len(np.intersect1d(sets[x], sets[y])) for x, y in zip(a, b)]


def test_signatures_bound_differences():
    rng = np.random.default_rng(5)
    for _ in range(50):
        x, y = (np.unique(rng.integers(0, 2**58, rng.integers(1, 300)).astype(np.uint64)) for _ in "ab")
        y = np.union1d(x[::2], y)
        d = jaccard.differences([jaccard.signature(x)], [jaccard.signature(y)])[0]
        assert d <= len(np.setxor1d(x, y))


def test_components(spark):
    random.seed(1)
    edges = [(random.randrange(200), random.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)]
    edges = [(a, b) for a, b in edges if a != b]
    root = {x: x for e in edges for x in e}
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = jaccard.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["x"]: r["root"] for r in got.collect()} == root


def test_every_pair_against_brute_force(spark, hostile):
    base = [f"w{i}" for i in range(30)]
    texts = [" ".join(base), " ".join(base), " ".join(base), " ".join([*base[:28], "x", "y"]), " ".join([*base[:28], "x", "y"]), "one of its own"]
    rows = [(9 - i, t) for i, t in enumerate(texts)] + [(9, texts[3])]  # copies of lower ids; 9 has a near copy of its own
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_a"], r["doc_b"]) for r in jaccard.similar_documents(d).collect()]
    assert set(got) == set(brute(rows, 2, "0.6")) == {(a, b) for a in range(5, 10) for b in range(a + 1, 10)}
    got = {(r["doc_a"], r["doc_b"]) for r in jaccard.similar_documents(hostile, 3, "0.6").collect()}
    assert got == {(5, 6), (5, 7), (6, 7), (10, 11)}


def linked(rows, n, t):
    """(doc_id, class_id, links) by brute force."""
    nodes = sorted({(i, frozenset(Words([text or ""]).grams(n)[0].tolist())) for i, text in rows if i is not None}, key=lambda x: x[0])
    near = [[k for k, (_, y) in enumerate(nodes) if k != j and x & y and len(x & y) >= Fraction(t) * len(x | y)] for j, (_, x) in enumerate(nodes)]
    of = list(range(len(nodes)))
    for _ in nodes:
        of = [min([of[j], *(of[k] for k in near[j])]) for j in range(len(nodes))]
    return sorted((i, nodes[of[j]][0], len(near[j])) for j, (i, _) in enumerate(nodes))


def near_copies(n, copies=0):
    """One text of which n have a share of other words, and some exact copies."""
    random.seed(7)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(random.randrange(1, 7)):
            w[random.randrange(len(w))] = f"x{random.randrange(60)}"
        rows.append((i, " ".join(w)))
    return rows + [(n + i, " ".join(base)) for i in range(copies)]


def test_linked_documents_against_brute_force(spark, hostile, monkeypatch):
    rows = near_copies(150, 5) + [(500 + i, f"alone {i} words of its own {i * 7}") for i in range(20)]
    d = spark.createDataFrame(rows + rows[:3], "doc_id long, text string")
    for parts in (2000, 40):  # a star in one part, and in several
        monkeypatch.setattr(jaccard, "PART_SETS", parts)
        got = sorted(tuple(r) for r in jaccard.linked_documents(d).collect())
        assert got == linked(rows, 2, "0.6")
        assert {(r["doc_a"], r["doc_b"]) for r in jaccard.similar_documents(d).collect()} == set(brute(rows, 2, "0.6"))
    kept = [r["doc_id"] for r in jaccard.keep_one(d).collect()]
    assert sorted(kept) == sorted({c for _, c, _ in linked(rows, 2, "0.6")})
    rows = [(r["doc_id"], r["text"]) for r in hostile.select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in jaccard.linked_documents(hostile, 3, "0.6").collect()) == linked(rows, 3, "0.6")


def test_near_copies_dont_meet_in_lists(spark, monkeypatch):
    """What the lists emit for near copies of one text grows with these, not with their square."""
    seen = []
    grouped = jaccard.Join._grouped
    monkeypatch.setattr(jaccard.Join, "_grouped", lambda self, met: seen.append(met.count()) or grouped(self, met))
    d = spark.createDataFrame(near_copies(300), "doc_id long, text string")
    assert jaccard.linked_documents(d).count() == 300
    assert seen[0] < 20 * 300


def test_overlaps_of_two_parts():
    rng = np.random.default_rng(6)
    a, b = ([np.unique(np.concatenate([rng.integers(0, 40, 25), rng.integers(40, 900, 30)]).astype(np.uint64)) for _ in range(n)] for n in (90, 70))
    assert jaccard.overlaps(a, b).tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]


def test_pairs_equal_sql(spark, duck, sf):
    got = {(r["doc_a"], r["doc_b"], r["jaccard"]) for r in jaccard.similar_documents(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert got == set(duck.execute(jaccard.oracle()).fetchall())
    assert got


def test_links_of_a_table_without_rows(empty):
    assert jaccard.linked_documents(empty).count() == 0
