"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items meet on shared word n-grams (seeds).  For each pair that shares
enough of them, Karp-Rabin scans with falling lengths find the longest matches of yet unmarked words,
which are marked as tiles until none of ``least`` words is left; tiles never overlap, and as their
order is free a passage is found however its parts were reordered.  A document is contaminated by an
item if tiles cover ``threshold`` of the item's words.  Words are compared by 64-bit hashes.

Seeds are broadcast in slices of at most ``slice_seeds``; documents pass all slices in one scan, so
there is no shuffle and no limit to the benchmark's size.

Defined cases: a null or wordless text meets nothing; null or wordless items are never matched, and
items with fewer than ``least`` words only as a whole; repeated items are matched each under its own id, and with a null id under
null; matches of equal length are marked in order of position in the item, then in the document;
repeated rows are treated alike; columns of documents are returned as they are.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vec import GRAM, Words, chunks, powers

LEAST = 5
THRESHOLD = 0.5
SLICE_SEEDS = 2_000_000


def _hashes(w: np.ndarray, free: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Karp-Rabin hashes of all windows of n words that are free, and where they begin."""
    if len(w) < n:
        return w[:0], np.zeros(0, np.int64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(w * powers(GRAM, len(w))[: len(w)], dtype=np.uint64)])
    taken = np.concatenate([[0], np.cumsum(~free)])
    at = np.flatnonzero(taken[n:] == taken[:-n])
    # Differences of prefix sums carry a factor GRAM ** at; bring all to the same power.
    return (sums[at + n] - sums[at]) * powers(GRAM, len(w))[: len(w)][len(w) - 1 - at], at


def tile(item: np.ndarray, doc: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(item position, doc position, length) of the tiles, in the order in which they are marked."""
    free_i, free_d = np.ones(len(item), bool), np.ones(len(doc), bool)
    tiles: list[tuple[int, int, int]] = []
    n = least
    while n * 2 <= min(len(item), len(doc)):
        n *= 2
    while n >= least:
        hi, at_i = _hashes(item, free_i, n)
        hd, at_d = _hashes(doc, free_d, n)
        # The factor differs with the lengths of both arrays: scale the shorter one's.
        if len(item) < len(doc):
            hi = hi * powers(GRAM, len(doc))[len(doc) - len(item)]
        elif len(doc) < len(item):
            hd = hd * powers(GRAM, len(item))[len(item) - len(doc)]
        heap = [(-size, i, d) for i, d, size in zip(*_matches(item, doc, free_i, free_d, n, hi, at_i, hd, at_d))]
        heapq.heapify(heap)
        while heap:
            size, i, d = heapq.heappop(heap)
            free = free_i[i : i - size] & free_d[d : d - size]
            if free.all():
                tiles.append((i, d, -size))
                free_i[i : i - size] = free_d[d : d - size] = False
                continue
            edge = np.diff(np.concatenate([[0], free.view(np.int8), [0]]))
            for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
                if b - a >= n:
                    heapq.heappush(heap, (a - b, i + a, d + a))
        n = n // 2 if n >= 2 * least else (least if n > least else 0)
    return tiles


def _matches(item: np.ndarray, doc: np.ndarray, free_i: np.ndarray, free_d: np.ndarray, n: int, hi: np.ndarray, at_i: np.ndarray, hd: np.ndarray, at_d: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """(item positions, doc positions, lengths) of the matches of free words of n or more that can't be extended to the left.

    Windows of equal hash are paired by the words before them, so that of a repeated word only the
    pairs at the beginning of either run are looked at, not each with each.
    """
    kinds, kind_i = np.unique(hi, return_inverse=True)
    kind_d = np.minimum(np.searchsorted(kinds, hd), max(len(kinds) - 1, 0))
    met = kinds[kind_d] == hd if len(kinds) else np.zeros(len(hd), bool)
    at_d, kind_d = at_d[met], kind_d[met]
    order_i, order_d = np.argsort(kind_i, kind="stable"), np.argsort(kind_d, kind="stable")
    at_i, kind_i, at_d, kind_d = at_i[order_i], kind_i[order_i], at_d[order_d], kind_d[order_d]

    def before(words: np.ndarray, free: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = np.maximum(at - 1, 0)
        return (at > 0) & free[p], words[p]

    has_i, last_i = before(item, free_i, at_i)
    has_d, last_d = before(doc, free_d, at_d)
    n_i, n_d = np.bincount(kind_i, minlength=len(kinds)), np.bincount(kind_d, minlength=len(kinds))
    once = np.flatnonzero((n_i == 1) & (n_d == 1))
    x, y = np.searchsorted(kind_i, once), np.searchsorted(kind_d, once)
    begins = ~(has_i[x] & has_d[y] & (last_i[x] == last_d[y]))
    starts, ends = [at_i[x[begins]]], [at_d[y[begins]]]
    for k in np.flatnonzero((n_i * n_d > 1)).tolist():
        a, b = np.searchsorted(kind_i, k), np.searchsorted(kind_i, k, "right")
        c, e = np.searchsorted(kind_d, k), np.searchsorted(kind_d, k, "right")
        groups = [(at_i[a:b][~has_i[a:b]], np.ones(e - c, bool))]
        for word in np.unique(last_i[a:b][has_i[a:b]]):
            groups.append((at_i[a:b][has_i[a:b] & (last_i[a:b] == word)], ~has_d[c:e] | (last_d[c:e] != word)))
        for own, other in groups:
            other = at_d[c:e][other]
            starts.append(np.repeat(own, len(other)))
            ends.append(np.tile(other, len(own)))
    i, d = np.concatenate(starts), np.concatenate(ends)
    size, live, t = np.zeros(len(i), np.int64), np.arange(len(i)), 0
    while len(live):
        live = live[(i[live] + t < len(item)) & (d[live] + t < len(doc))]
        p, q = i[live] + t, d[live] + t
        live = live[free_i[p] & free_d[q] & (item[p] == doc[q])]
        t += 1
        size[live] = t
    long = size >= n
    return i[long].tolist(), d[long].tolist(), size[long].tolist()


class Benchmark:
    """Items' words and, by length, an index of their seeds: all grams of ``least`` words, or a shorter item as a whole."""

    def __init__(self, ids: list[int | None], texts: list[str | None], least: int = LEAST):
        w = Words([t or "" for t in texts])
        self.least, self.ids = least, []
        self.words: list[np.ndarray] = []
        grams: dict[int, list] = {}
        for i, (a, b) in enumerate(zip(w.ptr[:-1].tolist(), w.ptr[1:].tolist())):
            if b > a:
                n = min(least, b - a)
                g = Words.grams_of(w.hash[a:b], n)
                grams.setdefault(n, []).append((g, np.full(len(g), len(self.ids)), np.arange(len(g))))
                self.ids.append(ids[i])
                self.words.append(w.hash[a:b].copy())
        self.index = {}
        for n, found in sorted(grams.items()):
            seed, item, place = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(seed, kind="stable")
            self.index[n] = self._indexed(seed[order], item[order], place[order])

    @staticmethod
    def _indexed(seed: np.ndarray, item: np.ndarray, place: np.ndarray) -> tuple:
        some = np.zeros(1 << 16, bool)
        some[(seed >> np.uint64(48)).astype(np.int64)] = True
        return seed, item, place, some

    def slices(self, most: int) -> list["Benchmark"]:
        """Benchmarks of whole items with at most ``most`` seeds each, or one item."""
        out, run, size = [], [], 0
        for i, w in enumerate(self.words):
            n = max(1, len(w) - self.least + 1)
            if run and size + n > most:
                out.append(self._only(run))
                run, size = [], 0
            run.append(i)
            size += n
        return [*out, self._only(run)] if out else [self]

    def _only(self, items: list[int]) -> "Benchmark":
        b = object.__new__(Benchmark)
        b.least, b.ids, b.words, b.index = self.least, [self.ids[i] for i in items], [self.words[i] for i in items], {}
        for n, (seed, item, place, _) in self.index.items():
            keep = np.isin(item, items)
            if keep.any():
                b.index[n] = self._indexed(seed[keep], np.searchsorted(items, item[keep]), place[keep])
        return b

    def leaks(self, texts: list[str], threshold: float) -> list[list[tuple[int | None, float, int]]]:
        """For each text the (item_id, coverage, number of tiles) at or over the threshold."""
        w = Words(texts)
        out: list[list] = [[] for _ in texts]
        reached: dict[int, dict[int, set[int]]] = {}
        for n, (seed, item, place, some) in self.index.items():
            g = Words.grams_of(w.hash, n)
            maybe = np.flatnonzero(some[(g >> np.uint64(48)).astype(np.int64)])
            low = np.minimum(np.searchsorted(seed, g[maybe]), len(seed) - 1)
            maybe = maybe[seed[low] == g[maybe]]
            doc = np.searchsorted(w.ptr, maybe, "right") - 1
            inside = maybe + n <= w.ptr[doc + 1]
            maybe, doc = maybe[inside], doc[inside]
            for d in np.unique(doc).tolist():
                kinds = np.unique(g[maybe[np.searchsorted(doc, d) : np.searchsorted(doc, d, "right")]])
                own = reached.setdefault(d, {})
                for a, b in zip(np.searchsorted(seed, kinds).tolist(), np.searchsorted(seed, kinds, "right").tolist()):
                    for i, p in zip(item[a:b].tolist(), place[a:b].tolist()):
                        own.setdefault(i, set()).update(range(p, p + n))
        for d, items in reached.items():
            words = w.hash[w.ptr[d] : w.ptr[d + 1]]
            for i, places in sorted(items.items()):
                n = len(self.words[i])
                if len(places) >= threshold * n:  # tiles lie within the seeds' places
                    tiles = tile(self.words[i], words, min(self.least, n))
                    covered = sum(t[2] for t in tiles) / n
                    if covered >= threshold:
                        out[d].append((self.ids[i], round(covered, 6), len(tiles)))
        return out


LEAKS = "array<struct<item_id: bigint, coverage: double, tiles: int>>"


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, threshold: float = THRESHOLD, slice_seeds: int = SLICE_SEEDS, text: str = "text") -> Column:
    """Of each document the array of items that contaminate it."""
    if least < 1 or not 0 < threshold <= 1:
        raise ValueError("least must be 1 at least, and threshold in (0, 1]")
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
    every = Benchmark(rows.column(0).to_pylist(), rows.column(1).to_pylist(), least)
    found = []
    for part in every.slices(slice_seeds):
        sent = docs.sparkSession.sparkContext.broadcast(part)
        found.append(_udf(sent, threshold)(F.col(text).cast("string")))
    return F.concat(*found) if len(found) > 1 else found[0]


def _udf(sent, threshold: float):
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.int32())]))

    @F.arrow_udf(LEAKS)
    def match(texts: pa.Array) -> pa.Array:
        out: list = []
        for _, run in chunks(texts.to_pylist()):
            out += [[dict(zip(("item_id", "coverage", "tiles"), x)) for x in found] for found in sent.value.leaks(run, threshold)]
        return pa.array(out, kind)

    return match


def contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """(doc_id, item_id, coverage, tiles) for each document and each item that contaminates it."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), leaks(docs, benchmark, **how).alias("leaks"))
    return found.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents that no item contaminates, columns as given."""
    rows = docs.select(F.struct("*").alias("row"), leaks(docs, benchmark, **how).alias("leaks"))
    return rows.where(F.size("leaks") == 0).select("row.*")
