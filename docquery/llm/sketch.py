"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the k smallest distinct 63-bit hashes of a text's n-word shingles, ascending.  The
sketch of a union is the k smallest of the sketches' union, so sketches merge across parts (sources)
in any order.  With fewer than k entries a sketch is the whole set and all estimates are exact.
Documents have small sketches, parts much larger ones, as a small part's share of a large one's
least hashes is small.  Two sketches are compared on the hashes up to the end of both: there either
one is complete.

Defined cases: a null or wordless text has an empty sketch (0 shingles); a text of 1 to n - 1 words
has one shingle of all its words; repeated rows give repeated sketches and don't change a part's; a
null part is a part of its own; parts that share no hash of their sketches have no row together; null
ids stay null; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import settle
from .vec import SQL_WORDS, Words, chunks, sql_hash

SPAN = float(2**63)
#: Sizes of documents' and parts' sketches.
K, PART_K = 64, 4096
#: Hashes of parts' sketches that a task holds before it sends them on.
HELD = 4_000_000


def sketches(docs: DataFrame, n: int = 5, k: int = K, part_k: int = PART_K, held: int = HELD) -> DataFrame:
    """(doc_id, part, sketch, whole): for each row of documents its sketch, and (whole) each task's sketches of parts, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str | None, np.ndarray] = {}

        def rows(ids: pa.Array, parts: pa.Array, found: list[np.ndarray], whole: bool) -> pa.RecordBatch:
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            values = pa.array(np.concatenate(found).astype(np.int64))
            return pa.RecordBatch.from_arrays([ids, parts, pa.ListArray.from_arrays(ends, values), pa.array(np.full(len(found), whole))], ["doc_id", "part", "sketch", "whole"])

        def flush() -> pa.RecordBatch:
            names, arrays = list(kept), list(kept.values())
            kept.clear()
            return rows(pa.nulls(len(names), pa.int64()), pa.array(names, pa.string()), arrays, True)

        for batch in batches:
            ids, parts, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            for at, run in chunks(texts):
                found = [np.unique(g >> np.uint64(1)) for g in Words(run).grams(n)]
                own = parts.slice(at, len(run))
                yield rows(ids.slice(at, len(run)), own, [f[:k] for f in found], False)
                by: dict[str | None, list[np.ndarray]] = {}
                for part, f in zip(own.to_pylist(), found):
                    old = kept.get(part)
                    by.setdefault(part, []).append(f[: part_k if old is None or len(old) < part_k else np.searchsorted(f, old[-1])])
                for part, arrays in by.items():
                    old = [kept[part]] if part in kept else []
                    kept[part] = np.unique(np.concatenate([*arrays, *old]))[:part_k]
                if sum(map(len, kept.values())) > held:
                    yield flush()
        if kept:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, part string, sketch array<long>, whole boolean")


def merge(sketched: DataFrame, k: int = PART_K, salts: int = 32) -> DataFrame:
    """(part, sketch): one bottom-k sketch for each part from many, merged within salts, then at last."""

    def together(t: pa.Table) -> pa.Table:
        values = np.concatenate([c.flatten().to_numpy() for c in t["sketch"].chunks])
        return pa.table({"part": t["part"].slice(0, 1), "sketch": pa.array([np.unique(values)[:k]], pa.list_(pa.int64()))})

    salted = sketched.select("part", "sketch").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    some = salted.groupBy("part", "salt").applyInArrow(together, "part string, sketch array<long>")
    return some.groupBy("part").applyInArrow(together, "part string, sketch array<long>")


def distinct_count(sketch: Column, k: int) -> Column:
    """Estimated number of distinct shingles."""
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / (F.element_at(sketch, k) / SPAN))


def compare(a: Column, b: Column, both: Column, k: int) -> dict[str, Column]:
    """Estimates for two sketches that share ``both`` hashes: resemblance, the share of a's shingles that b contains, and the number of a's hashes it rests on."""
    end = lambda c: F.when(F.size(c) < k, F.lit(2**63 - 1)).otherwise(F.element_at(c, k))
    last = F.least(end(a), end(b))
    n, m = (F.size(F.filter(c, lambda x: x <= last)) for c in (a, b))
    return {"resemblance": both / (n + m - both), "containment": both / n, "sample": n.cast("long")}


def fingerprints(docs: DataFrame, n: int = 5, k: int = K, part_k: int = PART_K) -> DataFrame:
    """All documents' sketches, all parts', and the resemblance and containment of parts that share hashes.

    Rows of kind ``document`` have doc_id, part, shingles and the sketch (hashes joined by blanks);
    rows of kind ``part`` a part's shingles and merged sketch; rows of kind ``parts`` compare part
    with other_part, ``sample`` being the number of part's hashes compared.  Parts meet on their hashes.
    """
    each = settle(sketches(docs, n, k, part_k))
    parts = settle(merge(each.where("whole"), part_k).withColumn("p", F.monotonically_increasing_id()))
    hashes = parts.select("p", F.explode("sketch").alias("h"))
    met = hashes.join(hashes.withColumnRenamed("p", "q"), "h").where("p <> q").groupBy("p", "q").agg(F.count("*").alias("both"))
    pairs = met.join(parts, "p").join(parts.toDF("other_part", "other", "q"), "q")
    e = compare(F.col("sketch"), F.col("other"), F.col("both"), part_k)
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    text = F.array_join(F.col("sketch").cast("array<string>"), " ").alias("sketch")
    none = [null("double", "resemblance"), null("double", "containment"), null("long", "sample")]
    size = lambda k: F.round(distinct_count(F.col("sketch"), k), 3).alias("shingles")
    documents = each.where("not whole").select(F.lit("document").alias("kind"), "doc_id", "part", null("string", "other_part"), size(k), *none, text)
    whole = parts.select(F.lit("part").alias("kind"), null("long", "doc_id"), "part", null("string", "other_part"), size(part_k), *none, text)
    compared = pairs.select(F.lit("parts").alias("kind"), null("long", "doc_id"), "part", "other_part", size(part_k), F.round(e["resemblance"], 6).alias("resemblance"), F.round(e["containment"], 6).alias("containment"), e["sample"].alias("sample"), null("string", "sketch"))
    return documents.unionByName(whole).unionByName(compared)


def oracle(n: int = 5, k: int = K, part_k: int = PART_K) -> str:
    """DuckDB SQL for :func:`fingerprints`."""
    count = lambda s, k: f"round(CASE WHEN len({s}) < {k} THEN len({s})::DOUBLE ELSE {k - 1} / ({s}[{k}] / {SPAN}) END, 3)"
    end = lambda s: f"CASE WHEN len({s}) < {part_k} THEN {2**63 - 1} ELSE {s}[{part_k}] END"
    return f"""
    WITH t AS (SELECT row_number() OVER () AS r, doc_id, source AS part, {SQL_WORDS.format("coalesce(text, '')")} AS w FROM documents),
    g AS (SELECT r, part, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [w] ELSE list_transform(range(1, len(w) - {n - 2}), lambda i: w[i:i + {n - 1}]) END) AS g FROM t),
    h AS (SELECT DISTINCT r, part, ({sql_hash("g")} >> 1)::BIGINT AS h FROM g),
    s AS (SELECT r, list_sort(list(h))[1:{k}] AS s FROM h GROUP BY r),
    d AS (SELECT doc_id, part, coalesce(s, []) AS s FROM t LEFT JOIN s USING (r)),
    q AS (SELECT part, list_sort(list(DISTINCT h))[1:{part_k}] AS s FROM h GROUP BY part),
    p AS (SELECT o.part, coalesce(s, []) AS s FROM (SELECT DISTINCT part FROM t) o LEFT JOIN q ON o.part IS NOT DISTINCT FROM q.part),
    x AS (SELECT a.part, b.part AS other_part, a.s, b.s AS o, list_intersect(a.s, b.s) AS i, least({end("a.s")}, {end("b.s")}) AS e FROM p a JOIN p b ON a.part IS DISTINCT FROM b.part),
    y AS (SELECT *, len(list_filter(s, lambda v: v <= e)) AS n, len(list_filter(o, lambda v: v <= e)) AS m FROM x WHERE len(i) > 0)
    SELECT 'document' AS kind, doc_id, part, NULL::VARCHAR AS other_part, {count("s", k)} AS shingles, NULL::DOUBLE AS resemblance, NULL::DOUBLE AS containment, NULL::BIGINT AS sample, array_to_string(s, ' ') AS sketch FROM d
    UNION ALL SELECT 'part', NULL, part, NULL, {count("s", part_k)}, NULL, NULL, NULL, array_to_string(s, ' ') FROM p
    UNION ALL SELECT 'parts', NULL, part, other_part, {count("s", part_k)}, round(len(i) / (n + m - len(i)), 6), round(len(i) / n, 6), n, NULL FROM y"""
