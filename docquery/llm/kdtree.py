"""Sharding by a k-d tree over metadata.

Documents are points in four dimensions: language, source, length (logarithm, in 65536ths of an
octave) and a 63-bit hash of doc_id, each weighing its bytes.  A node over ``target_bytes`` is split
at the weighted median of its widest dimension (range over the whole table's range; ties go to the
first named).  Equal points are summed first.  While nodes hold more than ``held`` points, a level
is two distributed passes over the points: for each such node and each dimension ranges and running sums of
bytes, length and hash in their highest bits, give the bin that holds the weighted median; then the
values of that bin give the median itself.  Smaller nodes go whole to a task each, which builds the
subtree below.  Both find the same cuts, so ``held`` decides costs only.
Assigning a document walks the tree (a few dozen bytes a leaf, as arrays), so documents' texts are
never shuffled.

Defined cases: a null language or source is the empty string's; a null length is measured on the
text; a null text weighs 0 bytes; a null doc_id hashes like any value; rows that agree in all four
dimensions can't be parted, so their leaf may stay over the target; repeated rows share a leaf; a
table below the target is shard 0; an empty one gives no rows; all columns are returned as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free, settle

TARGET_BYTES = 64 << 20
HELD = 1_000_000
DIMENSIONS = ("lang", "source", "length", "hash")
#: Bits of each dimension that cuts leave out: none, whatever a node's size.
COARSE = (0, 0, 0, 0)
#: Bits of length and hash that the first pass of a distributed level leaves out.
BINS = (0, 0, 12, 43)


@dataclass
class Tree:
    """Node i is a leaf if dim[i] < 0; else x[dim] <= cut goes left."""

    dim: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def descend(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int32)
        rows = np.arange(len(x))
        while len(rows := rows[self.dim[node[rows]] >= 0]):
            at = node[rows]
            node[rows] = np.where(x[rows, self.dim[at]] <= self.cut[at], self.left[at], self.right[at])
        return node

    def shards(self) -> np.ndarray:
        """Node to shard number: leaves counted from the left."""
        out, stack, n = np.full(len(self.dim), -1, np.int32), [0], 0
        while stack:
            i = stack.pop()
            if self.dim[i] < 0:
                out[i], n = n, n + 1
            else:
                stack += [int(self.right[i]), int(self.left[i])]
        return out


class Growing:
    """A tree that grows: rows (dim, cut, left, right)."""

    def __init__(self):
        self.rows = [(-1, 0, -1, -1)]

    def split(self, node: int, dim: int, cut: int) -> tuple[int, int]:
        left = len(self.rows)
        self.rows[node] = (dim, cut, left, left + 1)
        self.rows += [(-1, 0, -1, -1)] * 2
        return left, left + 1

    def graft(self, node: int, rows: list[tuple]) -> None:
        """Put a subtree, by rows, in the place of a leaf."""
        to = [node, *range(len(self.rows), len(self.rows) + len(rows) - 1)]
        self.rows += [None] * (len(rows) - 1)
        for i, (d, c, a, b) in zip(to, rows):
            self.rows[i] = (d, c, to[a] if d >= 0 else -1, to[b] if d >= 0 else -1)

    def tree(self) -> Tree:
        d, c, a, b = zip(*self.rows)
        return Tree(np.array(d, np.int8), np.array(c, np.int64), np.array(a, np.int32), np.array(b, np.int32))


def subtree(x: np.ndarray, w: np.ndarray, whole: np.ndarray, target: int) -> list[tuple]:
    """Rows of the tree over points x [n, 4] of weights w; ``whole`` are the table's ranges."""
    grown, stack = Growing(), [(0, np.arange(len(x)))]
    while stack:
        node, at = stack.pop()
        total = int(w[at].sum())
        low, high = x[at].min(0), x[at].max(0)
        if total <= target or (low == high).all():
            continue
        d = int(np.argmax((high - low) / whole))
        order = np.argsort(x[at, d], kind="stable")
        v = x[at[order], d]
        cut = v[np.searchsorted(np.cumsum(w[at[order]]) * 2, total)]
        if cut == v[-1]:
            cut = v[np.searchsorted(v, cut) - 1]
        left, right = grown.split(node, d, int(cut))
        under = x[at, d] <= cut
        stack += [(left, at[under]), (right, at[~under])]
    return grown.rows


def _points(docs: DataFrame, *also: Column) -> DataFrame:
    text = F.col("text").cast("string")
    n = F.coalesce(F.col("n_chars").cast("long"), F.length(text).cast("long"), F.lit(0).cast("long"))
    return docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.floor(F.log2(F.greatest(n, F.lit(0)) + 1.0) * 65536).cast("long").alias("length"),
        F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("long")), 1).alias("hash"),
        F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long")).alias("bytes"),
        *also,
    )


def _codes(cells: DataFrame, name: str) -> DataFrame:
    """Each value's place in order; as many rows as there are values."""
    return settle(cells.select(name).distinct().select(name, (F.row_number().over(Window.orderBy(name)) - 1).alias(f"{name}_code")))


class KdSharding:
    """The tree over a table of documents; ``shard`` assigns."""

    def __init__(self, docs: DataFrame, target_bytes: int = TARGET_BYTES, held: int = HELD):
        if target_bytes < 1:
            raise ValueError("target_bytes must be 1 at least")
        spark = docs.sparkSession
        cells = settle(_points(docs).groupBy(*DIMENSIONS).agg(F.sum("bytes").alias("bytes")))
        self.codes = {d: _codes(cells, d) for d in ("lang", "source")}
        coded = settle(self._coded(cells).select(*(f"x{i}" for i in range(4)), "bytes"))
        free(cells)
        span = coded.agg(F.count("*").alias("n"), *(F.min(f"x{i}").alias(f"l{i}") for i in range(4)), *(F.max(f"x{i}").alias(f"h{i}") for i in range(4))).first()
        grown = Growing()
        if span["n"]:
            whole = np.array([max(1, span[f"h{i}"] - span[f"l{i}"]) for i in range(4)], float)
            large, small = ([0], []) if span["n"] > held else ([], [0])
            while large:
                by: dict[int, list] = {}
                for r in _level(coded, grown.tree(), large):
                    by.setdefault(r["node"], []).append(r)
                tree, split, large = grown.tree(), {}, []
                for node, dims in sorted(by.items()):
                    if dims[0]["total"] <= target_bytes or all(r["lo"] == r["hi"] for r in dims):
                        continue
                    if dims[0]["n"] <= held:
                        small.append(node)
                    else:
                        split[node] = max((r for r in dims if r["lo"] < r["hi"]), key=lambda r: ((r["hi"] - r["lo"]) / whole[r["d"]], -r["d"]))
                for node, cut in sorted(_cuts(coded, tree, split).items()):
                    large += grown.split(node, split[node]["d"], cut)
            for node, rows in _subtrees(coded, grown.tree(), small, whole, target_bytes) if small else ():
                grown.graft(node, rows)
        self.tree = grown.tree()

    def _coded(self, points: DataFrame) -> DataFrame:
        for d in ("lang", "source"):  # settled tables: Spark broadcasts them if their size allows
            points = points.join(self.codes[d], d, "left")
        return points.select("*", F.col("lang_code").alias("x0"), F.col("source_code").alias("x1"), F.col("length").alias("x2"), F.col("hash").alias("x3"))

    def shard(self, docs: DataFrame) -> DataFrame:
        """(row, shard, bytes): the rows as structs with their shard."""
        sent = docs.sparkSession.sparkContext.broadcast((self.tree, self.tree.shards()))  # 21 bytes a node: 70 MB for 100 TB in leaves of 64 MB

        @F.arrow_udf("int")
        def leaf(*x: pa.Array) -> pa.Array:
            tree, shards = sent.value
            return pa.array(shards[tree.descend(np.stack([c.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for c in x], 1))].astype(np.int32))

        p = self._coded(_points(docs, F.struct("*").alias("row")))
        return p.select("row", leaf("x0", "x1", "x2", "x3").alias("shard"), "bytes")


def _placed(cells: DataFrame, tree: Tree, nodes: list[int], also: str, columns):
    """Rows of the points in these nodes, as ``columns`` makes them of nodes, points and weights."""
    live = np.zeros(len(tree.dim), bool)
    live[nodes] = True
    sent = cells.sparkSession.sparkContext.broadcast((tree, live))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, live = sent.value
        for b in batches:
            x = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], 1)
            node = tree.descend(x)
            keep = live[node]
            yield pa.RecordBatch.from_pydict(columns(node[keep].astype(np.int64), x[keep], b.column(4).to_numpy()[keep]))

    return cells.mapInArrow(place, also)


def _level(cells: DataFrame, tree: Tree, nodes: list[int]) -> list:
    """For each node and dimension: range, bytes, points, the bin (by the highest bits) that holds the median and the bytes before it."""

    def columns(node: np.ndarray, x: np.ndarray, w: np.ndarray) -> dict:
        n = len(node)
        return {"node": np.tile(node, 4), "d": np.repeat(np.arange(4, dtype=np.int32), n), "x": x.T.reshape(-1), "w": np.tile(w, 4)}

    placed = _placed(cells, tree, nodes, "node long, d int, x long, w long", columns)
    bits = F.element_at(F.array(*map(F.lit, BINS)), F.col("d") + 1)
    hist = placed.groupBy("node", "d", F.call_function("shiftright", "x", bits).alias("v")).agg(F.sum("w").alias("w"), F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    by = Window.partitionBy("node", "d")
    run = hist.select("*", F.sum("w").over(by.orderBy("v")).alias("upto"), F.sum("w").over(by).alias("total"))
    median = F.min(F.when(F.col("upto") * 2 >= F.col("total"), F.struct("v", (F.col("upto") - F.col("w")).alias("before"))))
    return run.groupBy("node", "d").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("total").alias("total"), median.alias("median")).select("*", "median.*").collect()  # 4 rows a node of over ``held`` points


def _cuts(cells: DataFrame, tree: Tree, split: dict[int, dict]) -> dict[int, int]:
    """Each node's weighted median in its dimension, or the largest value below its highest if the median is that."""
    if not split:
        return {}
    nodes = np.array(sorted(split))
    d, v, hi, before, total = (np.array([split[i][k] for i in nodes.tolist()], np.int64) for k in ("d", "v", "hi", "before", "total"))

    def columns(node: np.ndarray, x: np.ndarray, w: np.ndarray) -> dict:
        at = np.searchsorted(nodes, node)
        value = x[np.arange(len(x)), d[at]]
        inside = value >> np.array(BINS)[d[at]] == v[at]
        # Of values outside the bin only the largest of a batch below the node's highest can matter.
        low = np.flatnonzero(~inside & (value < hi[at]))
        low = low[np.lexsort((value[low], node[low]))]
        keep = np.concatenate([np.flatnonzero(inside), low[np.append(node[low][1:] != node[low][:-1], True)] if len(low) else low])
        at = at[keep]
        return {"node": node[keep], "v": value[keep], "w": np.where(inside[keep], w[keep], 0), "inside": inside[keep], "hi": hi[at], "before": before[at], "total": total[at]}

    placed = _placed(cells, tree, nodes.tolist(), "node long, v long, w long, inside boolean, hi long, before long, total long", columns)
    hist = placed.groupBy("node", "v", "inside", "hi", "before", "total").agg(F.sum("w").alias("w"))
    upto = F.col("before") + F.sum("w").over(Window.partitionBy("node", "inside").orderBy("v"))
    median, under = F.min(F.when(F.col("inside") & (F.col("upto") * 2 >= F.col("total")), F.col("v"))), F.max(F.when(F.col("v") < F.col("hi"), F.col("v")))
    rows = hist.withColumn("upto", upto).groupBy("node", "hi").agg(median.alias("median"), under.alias("under")).collect()  # a row a node of over ``held`` points
    return {r["node"]: r["median"] if r["median"] < r["hi"] else r["under"] for r in rows}


def _subtrees(cells: DataFrame, tree: Tree, nodes: list[int], whole: np.ndarray, target: int) -> Iterator[tuple[int, list[tuple]]]:
    """(node, rows of the tree below), each built by one task."""
    placed = _placed(cells, tree, nodes, "node long, x0 long, x1 long, x2 long, x3 long, w long", lambda node, x, w: {"node": node, **{f"x{i}": x[:, i] for i in range(4)}, "w": w})

    def build(t: pa.Table) -> pa.Table:
        x = np.stack([t[f"x{i}"].to_numpy() for i in range(4)], 1)
        rows = list(zip(*subtree(x, t["w"].to_numpy(), whole, target)))
        return pa.table({"node": pa.array(np.full(len(rows[0]), t["node"][0].as_py())), "i": pa.array(np.arange(len(rows[0]))), **{k: pa.array(v, pa.int64()) for k, v in zip(("dim", "cut", "lft", "rgt"), rows)}})

    t = placed.groupBy("node").applyInArrow(build, "node long, i long, dim long, cut long, lft long, rgt long").toArrow().sort_by([("node", "ascending"), ("i", "ascending")])
    columns = [c.to_pylist() for c in t.columns]
    a = 0
    while a < t.num_rows:
        b = a + 1
        while b < t.num_rows and columns[0][b] == columns[0][a]:
            b += 1
        yield columns[0][a], list(zip(*(c[a:b] for c in columns[2:])))
        a = b


def shard_documents(docs: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """The documents with a last column ``shard`` (``kd_shard`` if there is one of that name)."""
    name = "kd_shard" if "shard" in docs.columns else "shard"
    return KdSharding(docs, target_bytes).shard(docs).select("row.*", F.col("shard").alias(name))


def shards(docs: DataFrame, target_bytes: int = TARGET_BYTES, held: int = HELD) -> DataFrame:
    """(doc_id, shard, bytes) for each row of documents."""
    return KdSharding(docs, target_bytes, held).shard(docs).select(F.col("row.doc_id").cast("long").alias("doc_id"), "shard", "bytes")
