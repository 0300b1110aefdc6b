import random
import unicodedata

from docquery.llm import sketch, vec

M = 2**64


def words(text):
    out, run = [], ""
    for c in text + " ":
        if unicodedata.category(c)[0] in "LN":
            run += c.lower() if len(c.lower()) == 1 else c
        elif run:
            out.append(run)
            run = ""
    return out


def shingles(text, n):
    def h(word):
        x = 0
        for c in word:
            x = (x * vec.BASE + ord(c)) % M
        return x

    def g(run):
        x = 0
        for w in run:
            x = (x * vec.GRAM + h(w)) % M
        x = (x ^ (x >> 32)) * vec.MIX % M
        return (x ^ (x >> 29)) >> 1

    w = words(text)
    return sorted({g(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}) if w else []


def brute(text, n, k):
    s = shingles(text, n)[:k]
    return s, float(len(s)) if len(s) < k else (k - 1) / (s[k - 1] / 2**63)


def test_against_brute_force_and_hostile_rows(hostile):
    n, k = 3, 16
    got = sketch.sketches(hostile, n, k).where("not whole").collect()
    want = [(r["doc_id"], r["source"], brute(r["text"] or "", n, k)[0]) for r in hostile.collect()]
    key = lambda r: (repr(r[0]), repr(r[1]), r[2])
    assert sorted(((r["doc_id"], r["part"], r["sketch"]) for r in got), key=key) == sorted(want, key=key)


def test_merge_is_the_sketch_of_the_union(hostile):
    n, k = 3, 16
    got = {r["part"]: r["sketch"] for r in sketch.merge(sketch.sketches(hostile, n, 2, k).where("whole"), k, salts=2).collect()}
    union: dict = {}
    for r in hostile.collect():
        union.setdefault(r["source"], set()).update(shingles(r["text"] or "", n))
    assert got == {p: sorted(s)[:k] for p, s in union.items()}


def test_estimates_are_near(spark):
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(5000)]
    a = [random.choice(vocabulary) for _ in range(3000)]
    b = a[:1500] + [random.choice(vocabulary) for _ in range(1500)]
    d = spark.createDataFrame([(1, " ".join(a), "x"), (2, " ".join(b), "y")], "doc_id long, text string, source string")
    rows = [r for r in sketch.fingerprints(d, 5, 16, 256).collect() if r["kind"] == "parts" and r["part"] == "x"]
    sa, sb = set(shingles(" ".join(a), 5)), set(shingles(" ".join(b), 5))
    (r,) = rows
    assert abs(r["shingles"] / len(sa) - 1) < 0.2
    assert abs(r["resemblance"] - len(sa & sb) / len(sa | sb)) < 0.1
    assert abs(r["containment"] - len(sa & sb) / len(sa)) < 0.15


def test_empty_table(empty):
    assert sketch.fingerprints(empty).count() == 0


def test_containment_of_a_small_part_in_a_large_one(spark):
    random.seed(6)
    word = lambda: f"w{random.randrange(10**6)}"
    big = [" ".join(word() for _ in range(1004)) for _ in range(60)]
    rows = [(i, t, "hot") for i, t in enumerate(big)]
    rows.append((100, " ".join(big[0].split()[:604]), "inside"))  # 1 % of the other's shingles, all of them its own
    rows.append((101, " ".join([*big[1].split()[:604], *(word() for _ in range(1400))]), "partly"))
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {(r["part"], r["other_part"]): r for r in sketch.fingerprints(d).where("kind = 'parts'").collect()}
    union = {p: set().union(*(shingles(t, 5) for _, t, q in rows if q == p)) for p in ("hot", "inside", "partly")}
    for (a, b), r in got.items():
        assert abs(r["containment"] - len(union[a] & union[b]) / len(union[a])) < 0.12, (a, b)
        assert abs(r["resemblance"] - len(union[a] & union[b]) / len(union[a] | union[b])) < 0.02, (a, b)
    assert got["inside", "hot"]["containment"] == 1.0 and got["inside", "hot"]["sample"] > 20


def test_many_parts_are_sent_on(spark, hostile):
    """Parts' sketches that a task can't hold go on to be merged."""
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(batch, "1")
    few, many = (sketch.sketches(hostile.coalesce(1), 3, 2, 16, held).where("whole") for held in (10**6, 10))
    assert many.count() > few.count()
    spark.conf.unset(batch)
    merged = [sorted(map(repr, sketch.merge(x, 16, salts=2).collect())) for x in (few, many)]
    assert merged[0] == merged[1]
