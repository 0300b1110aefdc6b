import math

import numpy as np
import pytest

from docquery.llm import ctw


def kt(a, b):
    p = 1.0
    for i in range(a):
        p *= (i + 0.5) / (i + 1)
    for j in range(b):
        p *= (j + 0.5) / (a + j + 1)
    return p


def brute(texts, depth):
    """Code length of each text, by the recursion over context trees of each binary decision."""
    counts = {}
    seen = []
    for t in texts:
        b = bytes(depth) + t.encode()
        for i in range(depth, len(b)):
            for k in range(8):
                known, bit = b[i] >> (8 - k) | 1 << k, b[i] >> (7 - k) & 1
                for d in range(depth + 1):
                    counts.setdefault((known, b[i - d : i]), [0, 0])[bit] += 1

    def pw(known, context):
        own = kt(*counts.get((known, context), (0, 0)))
        if len(context) == depth:
            return own
        rest = 1.0
        for c in range(256):
            if (known, bytes([c]) + context) in counts:
                rest *= pw(known, bytes([c]) + context)
        return (own + rest) / 2

    def predict(known, history, bit, d):
        context = history[len(history) - d :]
        n = counts[known, context]
        own = (n[bit] + 0.5) / (sum(n) + 1)
        if d == depth:
            return own
        w = kt(*n) / 2 / pw(known, context)
        return w * own + (1 - w) * predict(known, history, bit, d + 1)

    for t in texts:
        b, bits = bytes(depth) + t.encode(), 0.0
        for i in range(depth, len(b)):
            for k in range(8):
                bits -= math.log2(predict(b[i] >> (8 - k) | 1 << k, b[i - depth : i], b[i] >> (7 - k) & 1, 0))
        seen.append(bits)
    return seen


TEXTS = ["abracadabra", "abba", "éa", "", "a"]


def test_against_brute_force(spark):
    d = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for depth in (1, 2, 3):
        got = [r["bits"] for r in ctw.score(d, depth=depth).orderBy("doc_id").collect()]
        assert np.allclose(got, brute(TEXTS, depth), rtol=1e-5), depth


def test_slices_and_deep_contexts_agree(spark):
    d = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    one, many = (sorted((r["doc_id"], round(r["bits"], 4)) for r in ctw.score(d, slice_rows=n).collect()) for n in (10**6, 4))
    assert one == many
    deep = [r["bits"] for r in ctw.score(d, depth=5).orderBy("doc_id").collect()]
    assert np.allclose(deep, brute(TEXTS, 5), rtol=1e-5)


def test_log_kt_of_large_counts():
    a = np.array([0, 1, 1023, 1024, 5000, 0, 3]), np.array([0, 0, 2, 1025, 1, 2000, 900])
    want = [math.lgamma(x + 0.5) + math.lgamma(y + 0.5) - math.log(math.pi) - math.lgamma(x + y + 1) for x, y in zip(*a)]
    assert np.allclose(ctw.log_kt(*a), want, atol=1e-9)


def test_training_on_other_texts(spark):
    train = spark.createDataFrame([(1, "aaaa" * 50)], "doc_id long, text string")
    d = spark.createDataFrame([(1, "aaaa"), (2, "zzzz")], "doc_id long, text string")
    bits = {r["doc_id"]: r["bits_per_byte"] for r in ctw.score(d, train).collect()}
    assert bits[1] < 1 < bits[2]


def test_hostile_rows(hostile, empty):
    got = ctw.score(hostile)
    assert got.count() == hostile.count()
    r = {x["doc_id"]: x for x in got.collect()}
    assert (r[1]["n_bytes"], r[1]["bits"], r[1]["bits_per_byte"]) == (None, None, None)
    assert (r[2]["n_bytes"], r[2]["bits"], r[2]["bits_per_byte"]) == (0, 0.0, None)
    assert len({x["bits"] for x in got.where("doc_id = 5").collect()}) == 1
    assert ctw.score(empty).count() == 0
    assert ctw.score(hostile, empty).count() == hostile.count()


def test_contexts_grow_with_the_corpus_and_reach_past_three_bytes(spark):
    # The byte after "bcd" follows from the bytes before it only.
    d = spark.createDataFrame([(1, "abcde" * 40 + "xbcdf" * 40)], "doc_id long, text string")
    assert ctw.score(d).first()["bits"] < 0.8 * ctw.score(d, depth=3).first()["bits"]
    rows = [(i, f"the {i * 7919 % 100003} of {i * 104729 % 99991}") for i in range(3000)]
    few, many = (ctw.gram_counts(spark.createDataFrame(r, "doc_id long, text string"), ctw.DEPTH).count() for r in (rows[:300], rows))
    assert many > 4 * few


def test_hash_table_finds_what_it_holds():
    rng = np.random.default_rng(2)
    key = np.unique(rng.integers(0, 2**48, 5000).astype(np.uint64))
    keys, values = ctw.hashed(key[::2], np.arange(1, len(key[::2]) + 1, dtype=np.float32))
    got = ctw.looked_up(keys, values, key)
    assert (got[::2] == np.arange(1, len(key[::2]) + 1)).all() and not got[1::2].any()
    assert not ctw.looked_up(*ctw.hashed(key[:0], np.zeros(0, np.float32)), key).any()


def test_depths_beyond_eight_bytes_are_refused(hostile):
    for depth in (0, 8):
        with pytest.raises(ValueError):
            ctw.score(hostile, depth=depth)
