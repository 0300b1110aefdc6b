"""Language-model scores by context-tree weighting over bytes.

Each byte is eight binary decisions; the decisions already taken in the byte select one of 255
binary context trees, whose contexts are the 0 to ``depth`` bytes before it.  A node's counts give
its Krichevsky-Trofimov estimate Pe; its weighted probability is Pw = Pe at full depth and
(Pe + product of the children's Pw) / 2 above.  After training on all documents, the probability of
a decision mixes the KT predictions of all depths, node weights being Pe / 2 Pw, and a document's
code length is the sum of -log2 of these probabilities.

Training: each partition counts its (context, byte) grams, one shuffle adds them up, and the trees
below each two last bytes are weighted in parallel; their sums by last byte meet in a table of 256 x 511 rows.
Scoring needs the code length of each gram.  That table is broadcast in slices of at most
``slice_rows`` rows, as hash tables, and documents pass the slices in one scan without a shuffle, whatever their number.

Defined cases: a null text has null scores; an empty one has 0 bytes, 0 bits and null bits per byte;
contexts before a text's first byte are zero bytes; repeated rows count as often as they occur; an
empty corpus gives no rows; null ids stay; other columns are ignored; depths are 1 to 7, as a gram is
eight bytes at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settle
from .vec import MIX, chunks, mix

DEPTH = 5
SLICE_ROWS = 4_000_000
FLUSH_ROWS = 2_000_000
_HALF, _LOG_PI = np.log(0.5), np.log(np.pi)
_table = np.concatenate([[0.5 * _LOG_PI], 0.5 * _LOG_PI + np.cumsum(np.log(np.arange(1023) + 0.5))])  # lgamma(n + 1/2)
_facts = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 1024)))])  # lgamma(n + 1)


def _stirling(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural logarithm of the KT probability of a zeros and b ones."""

    def half(n: np.ndarray) -> np.ndarray:
        return np.where(n < 1024, _table[np.minimum(n, 1023)], _stirling(np.maximum(n, 1) + 0.5))

    n = a + b
    whole = np.where(n < 1024, _facts[np.minimum(n, 1023)], _stirling(np.maximum(n, 1) + 1.0))
    return half(a) + half(b) - _LOG_PI - whole


def grams(texts: list[str], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The key of each byte, most recent context byte first and the byte itself last; where each text's begin and end."""
    kind = np.uint32 if depth <= 3 else np.uint64
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    gap = bytes(depth)
    b = np.frombuffer(gap + gap.join(raw), np.uint8)
    n = max(len(b) - depth, 0)
    key = b[depth:].astype(kind)
    for j in range(1, depth + 1):
        key |= b[depth - j : depth - j + n].astype(kind) << kind(8 * (depth - j + 1))
    size = np.array([len(r) for r in raw], np.int64)
    at = np.cumsum(size + depth) - (size + depth)
    inside = np.ones(n, bool)
    for j in range(1, depth + 1):  # the gaps before all texts but the first
        inside[at[1:] - j] = False
    ends = np.concatenate([[0], np.cumsum(size)])
    return key[inside], ends


def gram_counts(docs: DataFrame, depth: int, weight: int = 1) -> DataFrame:
    """(last, gram, n): how often each gram occurs in all texts; ``last`` are the two most recent context bytes (one at depth 1)."""
    if not 1 <= depth <= 7:
        raise ValueError("depth must be 1 to 7")

    def add(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        key, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return key, np.bincount(at, np.concatenate([n for _, n in parts]), len(key)).astype(np.int64)

    def out(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array((key >> key.dtype.type(8 * max(depth - 1, 1))).astype(np.int32)), pa.array(key.astype(np.int64)), pa.array(n * weight)], ["last", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for _, run in chunks(batch.column(0).to_pylist(), 1 << 21):
                parts.append(np.unique(grams(run, depth)[0], return_counts=True))
                if sum(len(k) for k, _ in parts[1:]) > FLUSH_ROWS:
                    parts = [add(parts)]
                    if len(parts[0][0]) > FLUSH_ROWS:
                        yield out(*parts.pop())
        if parts:
            yield out(*add(parts))

    counted = docs.select(F.col("text").cast("string")).where("text is not null").mapInArrow(run, "last int, gram long, n long")
    return counted.groupBy("last", "gram").agg(F.sum("n").alias("n"))


class Trees:
    """The weighted trees of depths ``top`` to ``depth`` over the grams of one last byte (or of all, with top 0)."""

    def __init__(self, gram: np.ndarray, n: np.ndarray, depth: int, top: int):
        self.depth, self.top = depth, top
        order = np.argsort(gram, kind="stable")
        self.gram, n = gram[order].astype(np.uint64), n[order].astype(np.int64)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for d in range(depth, top - 1, -1):
            own = ((self.gram >> np.uint64(8 * (depth - d + 1))) << np.uint64(8)) | (self.gram & np.uint64(255)) if d else self.gram & np.uint64(255)
            kinds, of = np.unique(own, return_inverse=True)
            self.levels.append((kinds, of.astype(np.int32), np.bincount(of, n, len(kinds)).astype(np.int64)))

    def decision(self, k: int, predict: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """(nodes, log Pw) at depth top for k bits known, and for each gram the probability of decision k, mixed over the depths from top down.

        Only one decision's and two depths' arrays are held at a time.
        """
        p = child = child_pw = None
        for kinds, of, total in self.levels:
            node = kinds >> np.uint64(8 - k)
            first = np.flatnonzero(np.diff(node, prepend=node[:1] + np.uint64(1)) != 0)
            one = (kinds >> np.uint64(7 - k)) & np.uint64(1)
            n1 = np.add.reduceat(total * one.astype(np.int64), first)
            n0 = np.add.reduceat(total, first) - n1
            node = node[first]
            pe = log_kt(n0, n1)
            if child is None:
                pw = pe
            else:
                # A child's node is (context, its oldest byte, k bits); its parent's is (context, k bits).
                bits = child & np.uint64((1 << k) - 1)
                parent = ((child >> np.uint64(k + 8)) << np.uint64(k)) | bits
                rest = np.bincount(np.searchsorted(node, parent), child_pw, len(node))
                pw = _HALF + np.logaddexp(pe, rest)
            if predict:
                of_kind = np.repeat(np.arange(len(first)), np.diff(first, append=len(kinds)))
                hit = np.where(one.astype(bool), n1[of_kind], n0[of_kind])
                kt = ((hit + 0.5) / (n0 + n1 + 1.0)[of_kind])[of]
                if p is None:
                    p = kt
                else:
                    w = np.exp(_HALF + pe - pw)[of_kind][of]
                    p = w * kt + (1 - w) * p
            child, child_pw = node, pw
        return child, child_pw, p


def code_lengths(counts: DataFrame, depth: int) -> DataFrame:
    """(gram, bits): the code length of each gram under the weighted trees of the whole corpus."""
    top = min(depth, 2)

    def subtree(pdf: pd.DataFrame) -> pd.DataFrame:
        t = Trees(pdf["gram"].to_numpy(), pdf["n"].to_numpy(), depth, top)
        rows = []
        last = int(pdf["last"].iloc[0]) >> 8 * (top - 1)
        totals = pdf.assign(x=pdf["gram"] & 255).groupby("x")["n"].sum()
        for k in range(8):
            node, pw, _ = t.decision(k, predict=False)
            bits = (node & np.uint64((1 << k) - 1)).astype(np.int64)
            rows.append(pd.DataFrame({"last": last, "k": k, "bits": bits, "pw": pw, "x": -1, "n": 0}))
        rows.append(pd.DataFrame({"last": last, "k": -1, "bits": 0, "pw": 0.0, "x": totals.index, "n": totals.to_numpy()}))
        return pd.concat(rows)

    # By last byte: sums of log Pw below it, for each decision, and counts of the bytes after it.
    tops = counts.groupBy("last").applyInPandas(subtree, "last int, k int, bits long, pw double, x long, n long")
    tops = tops.groupBy("last", "k", "bits", "x").agg(F.sum("pw").alias("pw"), F.sum("n").alias("n")).toPandas()  # 256 x 511 rows at most
    of_bytes = tops[tops.k < 0]
    after = np.zeros((256, 256), np.int64)
    after[of_bytes["last"].to_numpy(int), of_bytes.x.to_numpy(int)] = of_bytes.n.to_numpy()

    def level(n: np.ndarray, below: np.ndarray, k: int, leaf: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(weight, prediction, log Pw) for each context's row of byte counts; ``below`` by bits known."""
        node, one = np.arange(256) >> (8 - k), (np.arange(256) >> (7 - k)) & 1
        place = np.arange(len(n))[:, None] * 256 + node
        total = np.bincount(place.reshape(-1), n.reshape(-1), n.size).astype(np.int64)[place]
        ones = np.bincount(place.reshape(-1), (n * one).reshape(-1), n.size).astype(np.int64)[place]
        pe = log_kt(total - ones, ones)
        pw = pe if leaf else _HALF + np.logaddexp(pe, below[:, node])
        return (np.ones(n.shape) if leaf else np.exp(_HALF + pe - pw)), (np.where(one == 1, ones, total - ones) + 0.5) / (total + 1.0), pw

    weight, predict = np.zeros((2, 8, 256, 256)), np.zeros((2, 8, 256, 256))  # of depths 0 (its first row) and 1
    for k in range(8):
        of, below = tops[tops.k == k], np.zeros((256, 256))
        below[of["last"].to_numpy(int), of.bits.to_numpy(int)] = of.pw.to_numpy()
        weight[1, k], predict[1, k], pw = level(after, below, k, depth == 1)
        first = np.minimum(np.arange(256) << (8 - k), 255)  # a byte that begins with these bits
        weight[0, k, :1], predict[0, k, :1], _ = level(after.sum(0, keepdims=True), pw[:, first].sum(0, keepdims=True), k, False)

    def lengths(pdf: pd.DataFrame) -> pd.DataFrame:
        t = Trees(pdf["gram"].to_numpy(), pdf["n"].to_numpy(), depth, top)
        x, last = (t.gram & np.uint64(255)).astype(np.int64), int(pdf["last"].iloc[0]) >> 8 * (top - 1)
        bits = np.zeros(len(x))
        for k in range(8):
            p = t.decision(k)[2]
            for d, row in ((1, last), (0, 0)):
                w = weight[d, k, row][x]
                p = w * predict[d, k, row][x] + (1 - w) * p
            bits -= np.log2(p)
        return pd.DataFrame({"gram": t.gram.astype(np.int64), "bits": bits})

    return counts.groupBy("last").applyInPandas(lengths, "gram long, bits double")


def score(docs: DataFrame, train: DataFrame | None = None, depth: int = DEPTH, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(doc_id, n_bytes, bits, bits_per_byte) for each row, under the trees of ``train`` (documents themselves by default).

    Grams of ``docs`` that training lacks take part with count 0, so every gram has a code length.
    """
    spark = docs.sparkSession
    counts = gram_counts(docs, depth)
    if train is not None:
        counts = gram_counts(train, depth).unionByName(gram_counts(docs, depth, 0)).groupBy("last", "gram").agg(F.sum("n").alias("n"))
    counts = settle(counts)
    model = settle(code_lengths(counts, depth))
    rows = model.count()
    slices = max(1, -(-rows // slice_rows))
    bounds: list = [None]
    if slices > 1:
        cuts = model.stat.approxQuantile("gram", [i / slices for i in range(1, slices)], 0.001)
        bounds += sorted(set(map(int, cuts)))

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.lit(0.0).alias("bits"))
    for i, low in enumerate(bounds):
        high = bounds[i + 1] if i + 1 < len(bounds) else None
        part = model
        if low is not None:
            part = part.where(F.col("gram") >= low)
        if high is not None:
            part = part.where(F.col("gram") < high)
        t = part.toArrow()  # slice_rows at most, but for quantiles' error
        sent = spark.sparkContext.broadcast(hashed(t["gram"].to_numpy().astype(np.uint64), t["bits"].to_numpy().astype(np.float32)))
        scored = scored.mapInArrow(_scorer(sent, depth), "doc_id long, text string, bits double")
    size = F.octet_length("text")
    return scored.select("doc_id", size.cast("long").alias("n_bytes"), F.when(F.col("text").isNotNull(), F.col("bits")).alias("bits"), F.when(size > 0, F.col("bits") / size).alias("bits_per_byte"))


FREE = np.uint64(2**64 - 1)  # no gram: UTF-8 has no bytes 255


def _slot(key: np.ndarray, bits: int) -> np.ndarray:
    return (mix(key * np.uint64(MIX)) >> np.uint64(64 - bits)).astype(np.int64)


def hashed(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A table of open addressing, at most half full: slots' keys (FREE if none) and values (then 0)."""
    bits = max(4, int(2 * len(key)).bit_length())
    keys, values = np.full(1 << bits, FREE), np.zeros(1 << bits, np.float32)
    at, left = _slot(key, bits), np.arange(len(key))
    while len(left):
        free = left[keys[at[left]] == FREE]
        keys[at[free]] = key[free]
        left = left[keys[at[left]] != key[left]]
        at[left] = (at[left] + 1) & (len(keys) - 1)
    values[at] = value
    return keys, values


def looked_up(keys: np.ndarray, values: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The value of each q, 0 for those that the table lacks."""
    at = _slot(q, len(keys).bit_length() - 1)
    left = np.flatnonzero(keys[at] != q)
    while len(left):
        left = left[keys[at[left]] != FREE]
        at[left] = (at[left] + 1) & (len(keys) - 1)
        left = left[keys[at[left]] != q[left]]
    return values[at]


def _scorer(sent, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, lengths = sent.value
        for batch in batches:
            texts, so_far = batch.column(1).to_pylist(), batch.column(2).to_numpy()
            sums = []
            for _, run in chunks(texts, 1 << 19):
                q, ends = grams(run, depth)
                bits = np.zeros(len(q) + 1)
                np.cumsum(looked_up(keys, lengths, q.astype(np.uint64)), out=bits[1:], dtype=np.float64)
                sums.append(bits[ends[1:]] - bits[ends[:-1]])
            total = so_far + (np.concatenate(sums) if sums else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(total)], ["doc_id", "text", "bits"])

    return run
