import random

import numpy as np

from docquery.llm import toxicity as svm


def ssk(s, t, p, decay=svm.DECAY):
    """Sum over common subsequences of p letters or marks, directly."""
    from itertools import combinations

    total = 0.0
    for i in combinations(range(len(s)), p):
        for j in combinations(range(len(t)), p):
            if max(i[-1] - i[0], j[-1] - j[0]) < svm.SPAN and all(s[a] == t[b] and s[a] for a, b in zip(i, j)):
                total += decay ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def direct(a, b):
    """The normalised kernel by sums over all places; a norm counts each place by itself."""
    from itertools import combinations

    def norm(c):
        return max(1e-12, sum(svm.DECAY ** (2 * (i[-1] - i[0] + 1)) for p in (3, 4) for i in combinations(range(len(c)), p) if all(c[x] for x in i))) ** 0.5

    return sum(ssk(codes(a), codes(b), p) for p in (3, 4)) / (norm(codes(a)) * norm(codes(b)))


def codes(unit):
    ((_, c),) = svm.encode([unit]).values()
    return c[0].tolist()


def test_kernel_against_direct_sum():
    units = ["moron", "mo.ron", "m*or-on", "ée", "aa", "banana", "x", ""]
    k = svm.kernel(units, units)
    for i, a in enumerate(units):
        for j, b in enumerate(units):
            want = direct(a, b)
            assert abs(k[i, j] - want) < 1e-4, (a, b)


def labelled(n, seed):
    random.seed(seed)
    syllables = "an the or ti on sh ed wh in re st nd ly er ing ou".split()
    insults = ["moron", "worthless", "pathetic", "idiot"]
    out = []
    for i in range(n):
        w = ["".join(random.choices(syllables, k=random.randrange(1, 4))) for _ in range(random.randrange(5, 80))]
        bad = i % 4 == 0
        for _ in range(3 if bad else 0):
            w.insert(random.randrange(len(w)), random.choice(insults))
        out.append((" ".join(w), int(bad)))
    return out


def test_held_out_accuracy_and_gapped_insults():
    m = svm.fit(*zip(*labelled(400, 1)))
    held = labelled(400, 2)
    wrong = sum((s > m.cut) != y for s, (_, y) in zip(m.scores([t for t, _ in held]), held))
    assert wrong <= 4
    clean = "thean orti shed whin rest"
    for text in ("mo.ron {} w-o-r-thless", "moroon {} pathe*tic", "m o r o n {} worthlesss", "idi..ot {} mor_on"):
        assert m.scores([text.format(clean)])[0] > m.cut, text
    assert m.scores([clean])[0] < m.cut


def test_without_both_classes():
    assert svm.fit(["a b", "c"], [0, 0]) is None and svm.fit([None, ""], [1, 0]) is None


def test_hostile_rows(hostile, labels, empty):
    got = svm.score_documents(hostile, labels)
    assert got.columns == ["doc_id", "score", "toxic"] and got.count() == hostile.count()
    assert {r["toxic"] for r in got.where("doc_id in (1, 2, 3)").collect()} == {0}
    assert {r["score"] for r in got.where("doc_id in (1, 2, 3)").collect()} == {svm.EMPTY}
    assert svm.score_documents(hostile, labels.where("1 = 0")).where("toxic = 1").count() == 0
    assert svm.score_documents(empty, labels).count() == 0


def test_held_out_documents(spark, sf):
    big = sf.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    held = labels.where("doc_id % 7 = 0")
    model = svm.train(docs, labels.where("doc_id % 7 <> 0"))
    rows = docs.join(held, "doc_id").select("doc_id", svm.toxicity(docs, model).alias("s"), "toxic").toPandas()
    hit = np.array(rows["s"] > model.cut)
    y = np.array(rows["toxic"] == 1)
    print(hit[y].mean(), hit[~y].mean())
    # Insults of some languages occur only a few times in so few labels.
    assert hit[y].mean() > 0.8 and hit[~y].mean() < 0.03


def test_texts_of_one_word():
    m = svm.fit(*zip(*labelled(400, 1)))
    for insult in ("moron", "worthless", "pathetic", "idiot"):
        assert m.scores([insult])[0] > m.cut, insult
    clean = sorted({u for t, y in labelled(200, 3) if not y for u in t.split()})
    assert (m.scores(clean) > m.cut).mean() < 0.02


def test_values_and_scores_against_the_sum_over_landmarks(monkeypatch):
    """The table that production uses gives the SVM's function, bias + sum of weight * K(u, landmark)."""
    seen = {}
    own = svm._newton

    def newton(x, y, weight, ridge):
        seen["w"] = own(x, y, weight, ridge)
        return seen["w"]

    eigh = np.linalg.eigh

    def marks(units, landmarks):
        if units is landmarks:
            seen["marks"] = list(landmarks)
        return kernel(units, landmarks)

    kernel = svm.kernel
    monkeypatch.setattr(svm, "_newton", newton)
    monkeypatch.setattr(svm, "kernel", marks)
    texts, toxic = zip(*labelled(60, 1))
    m = svm.fit(texts, toxic, landmarks=12, rounds=2)
    k = np.array([[direct(a, b) for b in seen["marks"]] for a in seen["marks"]])
    value, vector = eigh(k)
    beta = vector @ np.diag(np.maximum(value, 1e-3) ** -0.5) @ vector.T @ seen["w"][:-1]
    units = ["moron", "idi..ot", "whered", "x", "ouled"]
    want = [sum(b * direct(u, v) for b, v in zip(beta, seen["marks"])) + m.bias for u in units]
    assert np.abs(m.values(units) - want).max() < 2e-2
    high = sorted(want)[-2:]
    assert abs(m.scores([" ".join(units)])[0] - sum(high) / 2) < 2e-2


def test_insults_of_40_characters():
    insult = "pneumonoultramicroscopicsilicovolcanofool"
    rows = [(f"{t} {insult} and {insult}", 1) if y else (t, 0) for t, y in labelled(200, 1)]
    m = svm.fit(*zip(*rows))
    tail = insult[20:]
    assert m.scores([f"they say {insult} twice {insult}"])[0] > m.cut
    assert m.scores([f"they say {tail} twice {tail}"])[0] > m.scores(["they say where then twice"])[0]
    assert len(svm.units_of("x" * 1000)) == 83 and svm.units_of("x" * 24) == ["x" * 24] and max(map(len, svm.units_of("x" * 1000))) == 24


def test_labels_without_text_do_not_use_up_the_bound(spark):
    rows = labelled(60, 5)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)] + [(i, i % 2) for i in range(1000, 3000)], "doc_id long, toxic int")
    assert svm.train(docs, labels, per_class=30) is not None
