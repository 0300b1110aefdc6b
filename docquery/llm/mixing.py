"""Mixing sources to target weights by capped water-filling.

A budget of bytes is shared out in proportion to target weights, but no source is read more than
``max_epochs`` times: sources whose share exceeds that are clamped and their excess goes to the
others in proportion to their weights, until all shares are feasible.  Sources clamp in order of
capacity over weight, so one pass over running sums in that order finds the level at which the
rounds of clamping end.  Each row is then repeated the whole number of epochs, and once more if a
hash of seed and doc_id falls below the fraction.

Defined cases: a null source is a source of its own; a source without weight in the map has the
default weight; one of weight 0, or without a byte, gets nothing; if all sources are clamped the
budget isn't reached; equal capacities per weight clamp together; a null doc_id is drawn like an
empty one; repeated rows are drawn alike; an empty table stays empty; all columns are returned as
they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle

#: The production mixture: weights of sources by name, and of all others.
WEIGHTS = {"src0": 8.0, "src1": 12.0, "src2": 2.0, "src3": 0.5}
OTHERS = 1.0
MAX_EPOCHS = 4
BUDGET = 1.0
SEED = 17


def water_fill(sizes: DataFrame, weights: dict[str, float] | None = None, others: float = OTHERS, max_epochs: int = MAX_EPOCHS, budget: float = BUDGET) -> DataFrame:
    """(source, size, weight, epochs) from (source, size); budget counts times the sum of sizes."""
    named = WEIGHTS if weights is None else weights
    weight = F.lit(float(others))
    for name, w in named.items():
        weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    cap = F.col("size") * F.lit(float(max_epochs))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_first())  # one row for each source
    s = sizes.withColumn("weight", weight).withColumn("live", (F.col("weight") > 0) & (F.col("size") > 0))
    live = s.where("live").withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("size").over(Window.partitionBy()).cast("double") * F.lit(float(budget))
    live = live.withColumn("level", (total - before) / rest)
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", F.col("source"), "level"))).over(Window.partitionBy())["level"]
    share = F.least(F.col("cap"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))
    return live.withColumn("epochs", F.greatest(share / F.col("size"), F.lit(0.0))).select("source", "size", "weight", "epochs").unionByName(s.where("not live").select("source", "size", "weight", F.lit(0.0).alias("epochs")))


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) that depends on seed and doc_id alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(float(2**32))


def _copies(docs: DataFrame, seed: int, **how) -> tuple[DataFrame, Column]:
    """Rows as struct ``row`` with their source's plan, and how often each is to be repeated."""
    sizes = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.sum(F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long")).alias("size"))
    plan = settle(water_fill(sizes, **how)).select(F.col("source").alias("plan_source"), "epochs")  # a small table: Spark broadcasts it if its size allows
    rows = docs.select(F.struct("*").alias("row"))
    joined = rows.join(plan, F.col("row.source").cast("string").eqNullSafe(F.col("plan_source")))
    whole = F.floor("epochs")
    return joined, (whole + (draw(F.col("row.doc_id"), seed) < F.col("epochs") - whole).cast("long")).cast("int")


def mix(docs: DataFrame, seed: int = SEED, **how) -> DataFrame:
    """The documents repeated or left out so that sources meet their weights; columns as given."""
    joined, n = _copies(docs, seed, **how)
    return joined.withColumn("n", n).where("n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")


def mixture(docs: DataFrame, seed: int = SEED, **how) -> DataFrame:
    """(doc_id, source, epochs, copy): a row for each repetition of each document that is sampled."""
    joined, n = _copies(docs, seed, **how)
    e = joined.withColumn("n", n).where("n > 0").select(F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.source").cast("string").alias("source"), F.round("epochs", 9).alias("epochs"), F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    return e


def oracle(weights: dict[str, float] = WEIGHTS, others: float = OTHERS, max_epochs: int = MAX_EPOCHS, budget: float = BUDGET, seed: int = SEED) -> str:
    """DuckDB SQL for :func:`mixture`."""
    cases = " ".join(f"WHEN source = '{k}' THEN {v}" for k, v in weights.items())
    return f"""
    WITH sizes AS (SELECT source, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS size FROM documents GROUP BY source),
    w AS (SELECT *, (CASE {cases} ELSE {others} END)::DOUBLE AS weight, size * {max_epochs}::DOUBLE AS cap FROM sizes),
    live AS (SELECT *, cap / weight AS ratio FROM w WHERE weight > 0 AND size > 0),
    t AS (SELECT *, ((SELECT sum(size) FROM live)::DOUBLE * {budget} - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY ratio, source NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM live),
    e AS (SELECT source, greatest(least(cap, coalesce((SELECT level FROM t WHERE ratio >= level ORDER BY ratio, source NULLS FIRST LIMIT 1), 'Infinity'::DOUBLE) * weight) / size, 0) AS epochs FROM t),
    d AS (SELECT doc_id, d.source, epochs, (floor(epochs) + (('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / {2**32}::DOUBLE < epochs - floor(epochs))::INT)::INT AS n FROM documents d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
    SELECT doc_id, source, round(epochs, 9) AS epochs, unnest(range(1, n + 1))::INT AS copy FROM d WHERE n > 0"""
