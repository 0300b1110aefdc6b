import random

from docquery.llm import mixing


def brute(sizes, weights, others, most, budget):
    """Rounds of clamping, as by hand."""
    w = {s: weights.get(s, others) for s in sizes}
    live = {s for s in sizes if w[s] > 0 and sizes[s] > 0}
    share, left = {s: 0.0 for s in sizes}, budget * sum(sizes[s] for s in live)
    while live:
        total = sum(w[s] for s in live)
        over = {s for s in live if left * w[s] / total > most * sizes[s]}
        if not over:
            share |= {s: left * w[s] / total for s in live}
            break
        for s in over:
            share[s] = most * sizes[s]
        left -= sum(share[s] for s in over)
        live -= over
    return {s: share[s] / sizes[s] if sizes[s] else 0.0 for s in sizes}


def test_levels_against_rounds_of_clamping(spark):
    random.seed(2)
    for _ in range(8):
        sizes = {f"s{i}": random.choice([0, 1, 10, 10, 500]) for i in range(random.randrange(1, 8))}
        weights = {s: random.choice([0.0, 0.5, 1.0, 20.0]) for s in list(sizes)[::2]}
        budget, most = random.choice([0.5, 1.0, 3.0]), random.choice([1, 4])
        df = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r["source"]: r["epochs"] for r in mixing.water_fill(df, weights, 1.0, most, budget).collect()}
        want = brute(sizes, weights, 1.0, most, budget)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 for s in got)


def test_hostile_rows(hostile, empty):
    out = mixing.mix(hostile, weights={"src0": 0.0, "src3": 50.0}, max_epochs=3, budget=50.0)
    assert out.columns == hostile.columns
    rows = out.collect()
    assert not [r for r in rows if r["source"] == "src0"]
    assert len([r for r in rows if r["source"] == "src3"]) == 9  # clamped at three epochs
    m = mixing.mixture(hostile, weights={"src3": 50.0}, max_epochs=3)
    assert m.where("source = 'src3'").count() == 9 and m.where("source is null").count() > 0
    assert mixing.mix(empty).count() == 0 and mixing.mixture(empty).count() == 0


def test_seeded(hostile):
    a, b, c = (sorted(map(str, mixing.mixture(hostile, seed=s).collect())) for s in (1, 1, 2))
    assert a == b
    assert all(0 <= r[0] < 1 for r in hostile.select(mixing.draw(mixing.F.col("doc_id"), 5)).collect())
