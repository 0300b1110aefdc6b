import random

import numpy as np
from pyspark.accumulators import AccumulatorParam

from docquery.llm import lpf
from docquery.llm.vec import Words


def test_longest_previous_against_brute_force():
    random.seed(3)
    for _ in range(200):
        x = np.array([random.randrange(random.choice([1, 2, 3, 8])) for _ in range(random.randrange(40))], np.int64)
        match = lambda i, j: next((k for k in range(len(x) - i + 1) if i + k == len(x) or x[i + k] != x[j + k]), 0)
        assert lpf.longest_previous(x).tolist() == [max((match(i, j) for j in range(i)), default=0) for i in range(len(x))]


def test_every_window_has_the_same_anchors_everywhere():
    random.seed(4)
    for _ in range(30):
        w = np.array([random.randrange(1, 5) for _ in range(60)], np.uint64)
        at, _ = lpf.anchors(w, 12, 4)
        for i in range(60 - 12 + 1):
            own = lpf.anchors(w[i : i + 12], 12, 4)[0] + i
            assert len(own) and set(own) <= set(at)


def brute(rows, least):
    """(doc_id, text, n_words, removed) by comparing all windows in order."""
    import hashlib

    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, hashlib.md5((rows[i][1] or "").encode()).hexdigest()))
    seen, out = set(), [None] * len(rows)
    for i in order:
        text = rows[i][1]
        w = Words([text or ""])
        gone = set()
        for a in range(len(w.hash) - least + 1):
            key = w.hash[a : a + least].tobytes()
            gone |= set(range(a, a + least)) if key in seen else set()
            seen.add(key)
        kept, last, a = "", 0, 0
        while a < len(w.hash):
            if a in gone:
                b = a
                while b in gone:
                    b += 1
                kept += text[last : w.start[a]]
                last = w.end[b - 1]
                a = b
            else:
                a += 1
        out[i] = (rows[i][0], None if text is None else kept + text[last:], len(w.hash), len(gone))
    return sorted(out, key=repr)


def test_documents_against_brute_force(spark):
    random.seed(6)
    pool = [" ".join(random.choices("abcdefgh", k=9)) for _ in range(12)]
    rows = [(i, ", ".join(random.choices(pool, k=random.randrange(1, 6))) + random.choice(["", ".", " x y z"])) for i in range(60)]
    rows += [(70, "a " * 40), (71, rows[3][1]), (71, rows[3][1])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for part in (100_000, 60):
        got = sorted(map(tuple, lpf.deduplicate(d, 8, 3, part).collect()), key=repr)
        assert got == brute(rows, 8), part


def test_hostile_rows(hostile, empty):
    got = lpf.deduplicate(hostile)
    rows = [(r["doc_id"], r["text"]) for r in hostile.collect()]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, lpf.LEAST)
    r = {x["doc_id"]: x for x in got.where("doc_id is not null").collect()}
    assert (r[10]["removed_words"], r[11]["removed_words"], r[11]["text"]) == (0, 70, "a second copy ")
    assert lpf.deduplicate(empty).count() == 0


def test_many_documents_that_share_an_anchor_and_nothing_else(spark, monkeypatch):
    """No task gets more than about a part's words, and nothing is removed."""
    random.seed(8)
    shared = "zero one two three four five six seven eight nine"
    texts = [" ".join([*(f"a{random.randrange(10**6)}" for _ in range(30)), shared, *(f"b{random.randrange(10**6)}" for _ in range(30))]) for _ in range(5000)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    d = d.unionByName(d.limit(3).selectExpr("doc_id + 10000 AS doc_id", "concat(text, ' end') AS text"))
    most = spark.sparkContext.accumulator(0, Most())
    own = lpf._matches

    def watched(rows, least):
        most.add(int(np.sum(rows["size"].to_numpy())))
        return own(rows, least)

    monkeypatch.setattr(lpf, "_matches", watched)
    grouped = lpf._grouped

    def with_watch(least, enough):
        run = grouped(least, enough)

        def watching(batches):
            lpf._matches = watched
            yield from run(batches)

        return watching

    monkeypatch.setattr(lpf, "_grouped", with_watch)
    got = lpf.deduplicate(d, 50, 10, 20_000)
    assert sorted(r["doc_id"] for r in got.where("removed_words > 0").collect()) == [10000, 10001, 10002]
    assert 0 < most.value < 60_000


class Most(AccumulatorParam):
    def zero(self, value):
        return 0

    def addInPlace(self, a, b):
        return max(a, b)
