"""Exact self-join of documents on the Jaccard similarity of their word n-gram sets, by skipping over set relations.

Index level: each set is ordered by a global order of n-grams (classes of rarity counted over all
documents, then hash), and only its prefix is indexed: sets with Jaccard similarity t share an n-gram
in their first size - ceil(t size) + 1.  An n-gram's list is kept in blocks of equal set size, each
ordered by position.  A set looks only into blocks whose size can reach t, and of a block reads only
the positions from which enough n-grams are left; the rest of the block is skipped by binary search.
A pair is emitted only where a run of common n-grams begins, so that highly similar sets don't meet
at every n-gram of the run.

Answer level: equal sets are one set.  Of each neighbourhood of candidates one set leads; the
others' sets come once to the leader's group and are reduced to their differences from it (candidates that parity signatures rule out aren't sent).  Overlaps
of any two of them follow from the leader's size and the differences alone
(|r & s| = |L| - |L-r| - |L-s| + |(L-r) & (L-s)| + |(r-L) & (s-L)|), so a set's answers are
derived from those of the set it resembles: the leader's overlap with s is known, and the few
n-grams by which r differs from the leader change it.

Stars: many different sets that all resemble each other would meet in every list, and their pairs
grow with the square of their number.  Sets whose sketches (a least hash in each of 8 ranges) point to the same
set are a star; pairs within a star of STAR sets or more aren't emitted by the lists but all compared by
tasks for two parts of the star each, as products of incidence matrices.  Which sets make a star
decides what the join costs, never its result.  Nothing is capped, and the join is exact up to
collisions of 58-bit hashes of n-grams, and of 36 bits of two different predecessors wherever a pair's
common runs begin (one pair in 2**36 that have a single run).

Defined cases: null, empty and wordless texts have no n-grams and no partners; a text of 1 to n - 1
words has one n-gram; rows without doc_id can't be named and are left out of the join (and kept by
:func:`keep_one`); rows that repeat doc_id and text are one document; texts that share a doc_id
each take part under it, but not in pairs with each other; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import free, settle, sweep
from .vec import SQL_WORDS, Words, chunks, mix

N = 2
THRESHOLD = "0.6"
#: Buckets that hold more n-grams than that count as frequent; about HEAVY of the fullest are told apart (and broadcast).
USUAL, HEAVY = 8, 4_000_000
FLUSH, STRIDE = 1_500_000, 1 << 19
#: Sets that make a star; sets in stars at most (the largest stars count first; they are broadcast, others meet in lists); sets and n-grams in a part of a star.
STAR, STARRED, PART_SETS, PART_GRAMS = 50, 2_000_000, 2_000, 4_000_000


class Rarity:
    """Classes of n-grams by how often their hash bucket occurs: 0 for the usual, then by powers of two."""

    def __init__(self, bits: int, buckets: np.ndarray, classes: np.ndarray):
        order = np.argsort(buckets)
        self.bits, self.buckets, self.classes = bits, buckets[order].astype(np.uint32 if bits <= 32 else np.uint64), classes[order].astype(np.uint8)

    def __getstate__(self) -> tuple:
        return self.bits, self.buckets, self.classes

    def __setstate__(self, state: tuple) -> None:
        self.bits, self.buckets, self.classes = state

    @functools.cached_property
    def filter(self) -> np.ndarray:
        """Which of 2**22 ranges of hashes have a frequent bucket; made in each worker."""
        found = np.zeros(1 << 22, bool)
        found[(self.buckets.astype(np.uint64) << np.uint64(64 - self.bits) >> np.uint64(42)).astype(np.int64)] = True
        return found

    def of(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros(len(g), np.uint64)
        maybe = np.flatnonzero(self.filter[(g >> np.uint64(42)).view(np.int64)])
        if len(maybe):
            bucket = (g[maybe] >> np.uint64(64 - self.bits)).astype(self.buckets.dtype)
            at = np.minimum(np.searchsorted(self.buckets, bucket), len(self.buckets) - 1)
            out[maybe] = np.where(self.buckets[at] == bucket, self.classes[at], 0).astype(np.uint64)
        return out


def rarity(docs: DataFrame, n: int) -> Rarity:
    """Count all documents' n-grams in hash buckets, as many that one holds about one on average.

    Tasks send sorted bucket numbers as deltas (about a byte each), by range of buckets.  Only
    buckets over USUAL are kept, and of these about the fullest HEAVY, so that what is broadcast
    stops growing: the order decides what the join costs, never its result.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = int(np.clip(np.ceil(np.log2(max(size, 1) / 8)), 16, 48))
    range_bits, kind = min(bits, 20), np.uint32 if bits <= 32 else np.uint64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            every = np.sort(np.concatenate(held)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(every >> range_bits, prepend=-1))
            rows = []
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(every)]):
                part = every[a:b] & ((1 << range_bits) - 1)
                rows.append((int(every[a] >> range_bits), np.diff(part, prepend=0).astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "deltas"])

        for batch in batches:
            for _, run in chunks(batch.column(0).to_pylist()):
                held.append((np.concatenate(Words(run).grams(n)) >> np.uint64(64 - bits)).astype(kind))
                if sum(map(len, held)) > FLUSH:
                    yield out()
                    held = []
        if sum(map(len, held)):
            yield out()

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(1 << range_bits, np.int64)
        for blob in t["deltas"].to_pylist():
            part = np.cumsum(np.frombuffer(blob, np.uint8).reshape(4, -1).T.copy().view(np.uint32).reshape(-1).astype(np.int64))
            total += np.bincount(part, minlength=len(total))
        heavy = np.flatnonzero(total > USUAL)
        return pa.table({"bucket": pa.array((t["part"][0].as_py() << range_bits) + heavy), "kind": pa.array((np.log2(total[heavy] / USUAL).astype(np.int32) + 1).astype(np.int32))})

    heavy = settle(docs.select("text").mapInArrow(count, "part int, deltas binary").groupBy("part").applyInArrow(add, "bucket long, kind int"))
    least, share, rows = 0, 1.0, 0
    for r in sorted(heavy.groupBy("kind").count().collect(), reverse=True):
        if rows + r["count"] > HEAVY:  # of this class a share by hash, so that cost rises without a step
            least, share = r["kind"], (HEAVY - rows) / r["count"]
            break
        rows += r["count"]
    t = heavy.where((F.col("kind") > least) | (F.col("kind") == least) & (F.pmod(F.xxhash64("bucket"), F.lit(1 << 20)) < share * (1 << 20))).toArrow()
    free(heavy)
    return Rarity(bits, t["bucket"].to_numpy(), np.minimum(t["kind"].to_numpy(), 40))


def ordered_sets(texts: list[str], n: int, rarity: Rarity) -> list[np.ndarray]:
    """For each text its distinct n-grams in the global order, each as class (6 bits) and hash (58 bits)."""
    grams = Words(texts).grams(n)
    g = np.concatenate(grams)
    keys = (rarity.of(g) << np.uint64(58)) | (g >> np.uint64(6))
    out, a = [], 0
    for own in grams:
        k = keys[a : a + len(own)]
        a += len(own)
        if len(k) > 1:
            k.sort()
            new = np.empty(len(k), bool)
            new[0] = True
            np.not_equal(k[1:], k[:-1], out=new[1:])
            k = k[new]
        out.append(k)
    return out


def signature(keys: np.ndarray) -> bytes:
    """Parities of how many n-grams fall on each of 2**k places, about two places for each n-gram.

    Two sets differ in at least as many n-grams as their parities do in places; folding the halves
    of a signature by xor gives that of half the size.
    """
    bits = max(64, 1 << int(2 * len(keys) - 1).bit_length())
    odd = np.bincount((keys & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def sketch(keys: np.ndarray) -> np.ndarray:
    """The least hash in each of 8 ranges that has one; by its range's bits each hash tells its range."""
    h = np.sort(mix(keys & np.uint64((1 << 58) - 1)))
    bins = h >> np.uint64(61)
    return h[np.flatnonzero(np.diff(bins.view(np.int64), prepend=-1))].view(np.int64)


def differences(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Lower bounds of the sizes of the sets' symmetric differences."""
    out = np.zeros(len(a), np.int64)
    for i, (x, y) in enumerate(zip(a, b)):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        while len(x) > len(y):
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        while len(y) > len(x):
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
        out[i] = np.bitwise_count(x ^ y).sum()
    return out


def set_id(keys: np.ndarray) -> int:
    """63-bit name of a set, whatever the classes."""
    return int(mix(mix(keys & np.uint64((1 << 58) - 1)).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(keys)))[0] >> np.uint64(1))


class Sizes:
    """Bounds that follow from the threshold num / den, in whole numbers."""

    def __init__(self, threshold: str | float | Fraction):
        t = Fraction(str(threshold)) if not isinstance(threshold, Fraction) else threshold
        if not 0 < t <= 1:
            raise ValueError("threshold must be in (0, 1]")
        self.num, self.den = t.numerator, t.denominator

    def overlap(self, a, b):
        """The least overlap of sets of sizes a and b that reaches the threshold."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def prefix(self, n):
        return n + (-self.num * n // self.den) + 1

    def largest(self, n):
        """The largest size of a partner."""
        return n * self.den // self.num


def pairs_of_lists(token: np.ndarray, prev: np.ndarray, sid: np.ndarray, size: np.ndarray, pos: np.ndarray, s: Sizes, star: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates from index entries, which may hold many n-grams' lists: (smaller id, larger id); none of one star (0 is no star)."""
    star = np.zeros(len(token), np.int64) if star is None else star
    order = np.lexsort((sid, pos, star, size, token))
    token, prev, sid, size, pos, star = (x[order] for x in (token, prev, sid, size, pos, star))
    fresh = np.ones(len(token), bool)
    fresh[1:] = (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])  # copies of a set have equal size, star and position
    first = np.ones(len(token), bool)
    first[1:] = token[1:] != token[:-1]
    of = np.cumsum(first) - 1
    fresh &= np.bincount(of, fresh)[of] > 1
    token, prev, sid, size, pos, star = (x[fresh] for x in (token, prev, sid, size, pos, star))
    if not len(token):
        return
    begins = np.ones(len(token), bool)
    begins[1:] = (token[1:] != token[:-1]) | (size[1:] != size[:-1]) | (star[1:] != star[:-1])
    block = np.cumsum(begins) - 1  # entries of one n-gram, one size and one star, by position
    at = np.flatnonzero(begins)
    list_of = np.cumsum(np.concatenate([[True], token[at][1:] != token[at][:-1]])) - 1
    block_size, block_end = size[at], np.append(at[1:], len(token))
    # Blocks a set may look into: its own and later ones of its list up to the largest size.
    key = list_of * np.int64(1 << 32) + block_size
    upto = np.searchsorted(key, list_of[block] * np.int64(1 << 32) + s.largest(size.astype(np.int64)), "right")
    place = block * np.int64(1 << 32) + pos
    looks = upto - block
    for a, b in _strides(looks):
        who = np.repeat(np.arange(a, b), looks[a:b])
        into = np.arange(len(who)) - np.repeat(np.cumsum(looks[a:b]) - looks[a:b], looks[a:b]) + block[who]
        need = s.overlap(size[who].astype(np.int64), block_size[into].astype(np.int64))
        able = (pos[who] <= size[who] - need) & ((star[who] == 0) | (star[who] != star[at[into]]))
        who, into, need = who[able], into[able], need[able]
        low = np.where(into == block[who], who + 1, at[into])
        high = np.searchsorted(place, into * np.int64(1 << 32) + (block_size[into] - need), "right")  # the rest of the block is skipped
        high = np.minimum(np.maximum(high, low), block_end[into])
        n = high - low
        for c, d in _strides(n):
            r = np.repeat(who[c:d], n[c:d])
            x = np.arange(len(r)) - np.repeat(np.cumsum(n[c:d]) - n[c:d], n[c:d]) + np.repeat(low[c:d], n[c:d])
            new = (prev[r] != prev[x]) | (prev[r] == 0)
            r, x = sid[r[new]], sid[x[new]]
            keep = r != x
            yield np.minimum(r, x)[keep], np.maximum(r, x)[keep]


def _strides(n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of entries whose counts add up to about STRIDE at most."""
    total = np.cumsum(n)
    a = 0
    while a < len(n):
        base = total[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(total, base + STRIDE, "right")))
        yield a, b
        a = b


def verify(lead: np.ndarray, sets: dict[int, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Overlaps of the pairs (a, b) of one group, from the sets' differences from the leader's."""
    names = sorted(sets)
    less, more = [], []
    for x in names:
        s = sets[x]
        inside = lead[np.minimum(np.searchsorted(lead, s), len(lead) - 1)] == s if len(lead) else np.zeros(len(s), bool)
        more.append(s[~inside])
        missing = np.ones(len(lead), bool)
        missing[np.searchsorted(lead, s[inside])] = False
        less.append(lead[missing])
    n_less = np.array([len(x) for x in less])
    diffs = [np.concatenate([p, q]) for p, q in zip(less, more)]  # keys of the two kinds never meet
    ends = np.cumsum([0, *map(len, diffs)])
    known, flat = np.unique(np.concatenate(diffs), return_inverse=True)
    flag = np.zeros(len(known) + 1, np.int64)
    ia, ib = np.searchsorted(names, a), np.searchsorted(names, b)
    out = np.empty(len(a), np.int64)
    order = np.argsort(ia, kind="stable")
    cuts = np.flatnonzero(np.diff(ia[order], prepend=-1))
    for c, d in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
        r = int(ia[order[c]])
        own = flat[ends[r] : ends[r + 1]]
        flag[own] = 1
        for at in np.array_split(order[c:d], max(1, -(-(d - c) // 4096))):
            other = ib[at]
            size = ends[other + 1] - ends[other]
            to = np.cumsum(size)
            here = np.arange(int(to[-1])) - np.repeat(to - size, size) + np.repeat(ends[other], size)
            hits = np.concatenate([[0], np.cumsum(flag[flat[here]])])
            out[at] = len(lead) - n_less[r] - n_less[other] + hits[to] - hits[to - size]
        flag[own] = 0
    return out


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of any set of a with any of b, as a matrix.

    N-grams that many of the sets have are columns of incidence matrices, whose product counts them;
    of the others each pair of sets that has one is counted by itself.
    """
    flat = np.concatenate([*a, *b])
    row = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    _, of, times = np.unique(flat, return_inverse=True, return_counts=True)
    usual = times > max(1, (len(a) + len(b)) // 50)
    column = np.cumsum(usual) - 1
    out = np.zeros((len(a), len(b)), np.float32)
    mine = usual[of]
    r, c = row[mine], column[of[mine]]
    order = np.argsort(c, kind="stable")
    r, c = r[order], c[order]
    for low in range(0, int(usual.sum()), 1024):
        x, y = np.searchsorted(c, (low, low + 1024))
        m = np.zeros((len(a) + len(b), 1024), np.float32)
        m[r[x:y], c[x:y] - low] = 1
        out += m[: len(a)] @ m[len(a) :].T
    rest = ~usual[of] & (times[of] > 1)
    r, c = row[rest], of[rest]
    left = r < len(a)
    ra, ca, rb, cb = r[left], c[left], r[~left] - len(a), c[~left]
    order = np.argsort(cb, kind="stable")
    rb, cb = rb[order], cb[order]
    low = np.searchsorted(cb, ca)
    n = np.searchsorted(cb, ca, "right") - low
    for x, y in _strides(n):
        who = np.repeat(ra[x:y], n[x:y])
        other = np.arange(len(who)) - np.repeat(np.cumsum(n[x:y]) - n[x:y], n[x:y]) + np.repeat(low[x:y], n[x:y])
        np.add.at(out, (who, rb[other]), 1)
    return out.astype(np.int64)


def _roots(linked: np.ndarray, names: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the least name that it's connected with."""
    out, open_ = names.copy(), np.ones(len(names), bool)
    for i in np.argsort(names).tolist():
        if open_[i]:
            front = np.array([i])
            open_[i] = False
            while len(front):
                out[front] = names[i]
                front = np.flatnonzero(linked[front].any(0) & open_)
                open_[front] = False
    return out


class Join:
    """The join's parts, as settled tables.

    ``members`` (doc_id, h, sid) and ``pairs`` (a, b, jaccard, links) of set ids.  What ``pairs`` has by ``form``: "pairs" all
    similar pairs; "stars" rows that connect what similar pairs connect, jaccard null; "links" these, and
    rows with b null that give parts of how many documents the sets similar to a have.
    """

    def __init__(self, docs: DataFrame, n: int = N, threshold: str | float = THRESHOLD, form: str = "pairs"):
        s, spark = Sizes(threshold), docs.sparkSession
        named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
        classes = spark.sparkContext.broadcast(rarity(named, n))  # HEAVY entries at most

        def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, run in chunks(batch.column(2).to_pylist()):
                    sets = ordered_sets(run, n, classes.value)
                    ids = pa.array([set_id(k) if len(k) else None for k in sets], pa.int64())
                    marks = [pa.array([len(k) for k in sets], pa.int32()), pa.array([signature(k) for k in sets], pa.binary()), pa.array([sketch(k) for k in sets], pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(run)), batch.column(1).slice(at, len(run)), ids, *marks], ["doc_id", "h", "sid", "size", "signature", "sketch"])

        def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, run in chunks(batch.column(0).to_pylist()):
                    sets = [k for k in ordered_sets(run, n, classes.value) if len(k)]
                    if not sets:
                        continue
                    size = np.array([len(k) for k in sets])
                    most = s.prefix(size)
                    before = [np.concatenate([[np.uint64(0)], mix(k[: p - 1]) >> np.uint64(28)]) for k, p in zip(sets, most.tolist())]
                    pos = np.arange(int(most.sum())) - np.repeat(np.cumsum(most) - most, most)
                    ids = np.repeat(np.array([set_id(k) for k in sets]), most)
                    # Three numbers a row, some 18 bytes when compressed.  44 bits of a token suffice: others that look alike
                    # only make candidates, and a position over 20 bits only skips less.
                    token = mix(np.concatenate([k[:p] for k, p in zip(sets, most.tolist())])) >> np.uint64(20)
                    packed = token << np.uint64(20) | np.minimum(pos, (1 << 20) - 1).astype(np.uint64)
                    other = np.concatenate(before) << np.uint64(28) | np.repeat(size, most).astype(np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids, packed.view(np.int64), other.view(np.int64))], ["sid", "packed", "other"])

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []

            def out(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                sid, packed, other = (np.concatenate([r.column(i).to_numpy() for r in rows]) for i in range(3))
                found: list[tuple[np.ndarray, np.ndarray]] = []
                of, star = starred.value
                at = np.minimum(np.searchsorted(of, sid), len(of) - 1)
                for pair in pairs_of_lists(packed >> 20, other >> 28, sid, other & 0xFFFFFFF, packed & 0xFFFFF, s, np.where(of[at] == sid, star[at], 0)):
                    found.append(pair)
                    if sum(len(a) for a, _ in found) > STRIDE:
                        yield _distinct(found)
                        found = []
                if found:
                    yield _distinct(found)

            for batch in batches:
                if not batch.num_rows:
                    continue
                token = batch.column(1).to_numpy() >> 20
                cut = int(np.flatnonzero(token != token[-1])[-1]) + 1 if token[0] != token[-1] else 0
                if cut or (held and held[-1].column(1)[-1].as_py() >> 20 != token[0]):
                    yield from out([*held, batch.slice(0, cut)])
                    held = []
                held.append(batch.slice(cut))
            if held:
                yield from out(held)

        self.members = settle(named.select("doc_id", F.unhex(F.md5("text")).alias("h"), "text").mapInArrow(name, "doc_id long, h binary, sid long, size int, signature binary, sketch array<long>").where("sid is not null").distinct())
        self.sets = settle(
            self.members.groupBy("sid", "doc_id").agg(F.min("h").alias("h"), F.first("size").alias("size"), F.first("sketch").alias("sketch"))
            .groupBy("sid").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "h")).alias("first"), F.first("size").alias("size"), F.first("sketch").alias("sketch"))
        )
        sweep(spark)
        parts = self._stars()
        starred = spark.sparkContext.broadcast((parts["sid"].to_numpy(), parts["star"].to_numpy()) if parts.num_rows else (np.array([-1]), np.array([0])))  # STARRED sets at most
        lists = named.select("text").mapInArrow(index, "sid long, packed long, other long").repartition(F.shiftrightunsigned("packed", 20)).sortWithinPartitions("packed")
        met = settle(lists.mapInArrow(meet, "a long, b long").distinct())
        grouped = settle(self._grouped(met))
        free(met)
        candidates = settle(self._near(grouped, s))
        free(grouped)
        self.pairs = settle(self._verified(named, candidates, parts, n, s, classes, form))
        free(candidates)

    def _stars(self) -> pa.Table:
        """(sid, star, part, base, parts), by sid: the sets of large stars, in parts; ``base`` counts pairs of parts of earlier stars."""
        of = Window.partitionBy("key")
        keys = self.sets.select("sid", F.struct((-F.col("copies")).alias("order"), "sid").alias("rank"), F.size("sketch").alias("n"), "size", F.explode("sketch").alias("key"))
        led = keys.withColumns({"lead": F.min("rank").over(of), "times": F.count("*").over(of)}).where(F.col("times") >= STAR // 4)
        best = led.groupBy("sid", "n", "size", "lead").count().groupBy("sid", "n", "size").agg(F.min(F.struct((-F.col("count")).alias("less"), "lead")).alias("best"))
        labels = settle(best.where("-best.less * 8 >= n * 3").select("sid", "size", F.col("best.lead.sid").alias("label")))
        large = labels.groupBy("label").agg(F.count("*").alias("members")).where(F.col("members") >= STAR)
        kept = large.orderBy(F.desc("members"), "label").limit(STARRED // STAR)  # each has STAR sets at least
        t = labels.join(kept, "label").orderBy(F.desc("members"), "label", "sid").limit(STARRED).select("label", "sid", "size").toArrow()
        free(labels)
        label, sid, size = (t[c].to_numpy().astype(np.int64) for c in ("label", "sid", "size"))
        star, part, base, parts = (np.zeros(len(sid), np.int64) for _ in range(4))
        pairs = 0
        cuts = np.flatnonzero(label[1:] != label[:-1]) + 1
        for k, (a, b) in enumerate(zip([0, *cuts.tolist()], [*cuts.tolist(), len(label)]) if len(label) else ()):
            load = np.maximum(np.arange(b - a) // PART_SETS, (np.cumsum(size[a:b]) - size[a:b]) // PART_GRAMS)
            own = np.unique(load, return_inverse=True)[1]
            star[a:b], part[a:b], base[a:b], parts[a:b] = k + 1, own, pairs, own[-1] + 1
            pairs += (int(own[-1]) + 1) ** 2
        order = np.argsort(sid)
        return pa.table({k: pa.array(x[order]) for k, x in (("sid", sid), ("star", star), ("part", part), ("base", base), ("parts", parts))})

    def _grouped(self, candidates: DataFrame) -> DataFrame:
        """(g, a, b): candidates with a neighbour, or themselves, as the group to meet in."""
        ends = candidates.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(candidates.select(F.col("b").alias("x"), F.col("a").alias("y")))
        lead = ends.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("g"))
        return candidates.join(lead.withColumnRenamed("x", "a"), "a").select("g", "a", "b")

    def _near(self, grouped: DataFrame, s: Sizes) -> DataFrame:
        """(g, a, b): candidates whose signatures allow the overlap, each with a set to lead its group.

        Signatures, a thirtieth of the sets' size, go once to each neighbourhood; so what is sent grows with
        the sets, not with their pairs.
        """
        marks = self.members.groupBy("sid").agg(F.first("size").alias("size"), F.first("signature").alias("signature"))
        wants = grouped.select(F.col("g").alias("leader"), F.explode(F.array("a", "b")).alias("sid")).distinct()

        def able(pairs: pa.Table, rows: pa.Table) -> pa.Table:
            sid, at = np.unique(rows["sid"].to_numpy(), return_index=True)
            size, mark = rows["size"].to_numpy()[at].astype(np.int64), rows["signature"].take(at).to_pylist()
            a, b = pairs["a"].to_numpy(), pairs["b"].to_numpy()
            ia, ib = np.searchsorted(sid, a), np.searchsorted(sid, b)
            ok = np.zeros(len(a), bool)
            for c in range(0, len(a), 10_000):
                x, y = ia[c : c + 10_000], ib[c : c + 10_000]
                least = differences([mark[i] for i in x.tolist()], [mark[i] for i in y.tolist()])
                ok[c : c + 10_000] = size[x] + size[y] - least >= 2 * s.overlap(size[x], size[y])
            a, b = a[ok], b[ok]
            return pa.table({"g": pa.array(_leaders(a, b)), "a": pa.array(a), "b": pa.array(b)})

        marks = marks.join(wants, "sid").select("leader", "sid", "size", "signature")
        return grouped.groupBy("g").cogroup(marks.groupBy("leader")).applyInArrow(able, "g long, a long, b long")

    def _verified(self, named: DataFrame, grouped: DataFrame, stars: pa.Table, n: int, s: Sizes, classes, form: str) -> DataFrame:
        wants = grouped.select(F.col("g").alias("leader"), F.explode(F.array("g", "a", "b")).alias("sid"), F.lit(-1).cast("long").alias("part")).distinct()
        if stars.num_rows:  # names of groups below 0 are of two parts of a star
            both = "explode(transform(sequence(0L, parts - 1), q -> -1 - base - least(part, q) * parts - greatest(part, q))) AS leader"
            wants = wants.unionByName(named.sparkSession.createDataFrame(stars).selectExpr(both, "sid", "part"))
        wants = wants.groupBy("sid").agg(F.collect_list("leader").alias("leaders"), F.max("part").alias("part"))
        one = self.sets.join(wants, "sid").select("sid", F.col("first.doc_id").alias("doc_id"), F.col("first.h").alias("h"), "copies", "part", "leaders")

        def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, run in chunks(batch.column(1).to_pylist()):
                    leaders = batch.column(4).slice(at, len(run))
                    who = pa.array(np.repeat(np.arange(len(run)), np.diff(leaders.offsets.to_numpy())))
                    keys = pa.array([k.tobytes() for k in ordered_sets(run, n, classes.value)], pa.binary())
                    yield pa.RecordBatch.from_arrays([leaders.flatten(), *(batch.column(i).slice(at, len(run)).take(who) for i in (0, 2, 3)), keys.take(who)], ["leader", "sid", "copies", "part", "keys"])

        # Texts go once by doc_id, sets once to each of their leaders.
        texts = named.join(one, "doc_id").where(F.unhex(F.md5("text")) == F.col("h")).select("sid", "text", "copies", "part", "leaders")
        sets = texts.mapInArrow(rebuild, "leader long, sid long, copies long, part long, keys binary")

        def table(a, b=None, jaccard=None, links=None) -> pa.Table:
            return pa.table({"a": pa.array(a, pa.int64()), "b": pa.nulls(len(a), pa.int64()) if b is None else pa.array(b, pa.int64()), "jaccard": pa.nulls(len(a), pa.float64()) if jaccard is None else pa.array(jaccard), "links": pa.nulls(len(a), pa.int64()) if links is None else pa.array(links, pa.int64())})

        def result(name: np.ndarray, root: np.ndarray, links: np.ndarray) -> pa.Table:
            edges = table(root[name != root], name[name != root])
            return edges if form == "stars" else pa.concat_tables([edges, table(name[links > 0], links=links[links > 0])])

        def compare(rows: pa.Table) -> pa.Table:
            """All pairs of two parts of a star, or of one with itself."""
            part, sid, copies = (rows[c].to_numpy() for c in ("part", "sid", "copies"))
            order = np.unique(sid, return_index=True)[1]  # repeated rows are one
            order = order[np.argsort(part[order], kind="stable")]
            part, sid, copies = part[order], sid[order], copies[order]
            keys = [np.frombuffer(k, np.uint64) for k in rows["keys"].take(pa.array(order)).to_pylist()]
            size = np.array([len(k) for k in keys])
            cut = int(np.searchsorted(part, part[-1]))
            one, two = (slice(0, cut), slice(cut, None)) if cut else (slice(0, None), slice(0, None))
            overlap = overlaps(keys[one], keys[two])
            ok = overlap >= s.overlap(size[one][:, None], size[two][None, :])
            if not cut:
                np.fill_diagonal(ok, False)
            if form == "pairs":
                x, y = np.nonzero(ok if cut else np.triu(ok))
                a, b, o = sid[one][x], sid[two][y], overlap[x, y]
                return table(np.minimum(a, b), np.maximum(a, b), o / (size[one][x] + size[two][y] - o))
            if cut:
                linked = np.zeros((len(sid), len(sid)), bool)
                linked[one, two], linked[two, one] = ok, ok.T
            else:
                linked = ok
            links = np.concatenate([linked[i : i + 256] @ copies.astype(float) for i in range(0, len(sid), 256)])
            return result(sid, _roots(linked, sid), links.astype(np.int64))

        def check(pairs: pa.Table, rows: pa.Table) -> pa.Table:
            if rows.num_rows and rows["leader"][0].as_py() < 0:
                return compare(rows)
            held = {i: np.frombuffer(k, np.uint64) for i, k in zip(rows["sid"].to_pylist(), rows["keys"].to_pylist())}
            a, b = pairs["a"].to_numpy(), pairs["b"].to_numpy()
            overlap = verify(held[pairs["g"][0].as_py()], held, a, b) if len(a) else np.zeros(0, np.int64)
            sid = np.unique(rows["sid"].to_numpy())
            size = np.array([len(held[x]) for x in sid.tolist()], np.int64)
            ia, ib = np.searchsorted(sid, a), np.searchsorted(sid, b)
            ok = np.flatnonzero(overlap >= s.overlap(size[ia], size[ib]))
            a, b, ia, ib, overlap = (x[ok] for x in (a, b, ia, ib, overlap))
            if form != "pairs":
                root = _leaders(a, b)
                name, at, of = np.unique(np.concatenate([a, b]), return_index=True, return_inverse=True)
                first = np.unique(rows["sid"].to_numpy(), return_index=True)[1]
                copies = rows["copies"].to_numpy()[first]
                return result(name, np.concatenate([root, root])[at], np.bincount(of, np.concatenate([copies[ib], copies[ia]])).astype(np.int64))
            return table(a, b, overlap / (size[ia] + size[ib] - overlap))

        return grouped.groupBy("g").cogroup(sets.groupBy("leader")).applyInArrow(check, "a long, b long, jaccard double, links long")

    def similar(self) -> DataFrame:
        """(doc_a, doc_b, jaccard), doc_a < doc_b: a row for each two documents' sets that reach the threshold, copies included.

        Pairs stay named by set until the members of both sides are joined in, so the rows of a
        document don't depend on which copies of it there are; they grow with the product of two sets' copies.
        """
        of = self.members.select("sid", "doc_id").distinct()
        sides = self.pairs.select("a", "b", F.round("jaccard", 6).alias("jaccard")).join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b").where("x <> y")
        near = sides.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "jaccard")
        equal = of.toDF("sid", "doc_a").join(of.toDF("sid", "doc_b"), "sid").where("doc_a < doc_b").select("doc_a", "doc_b", F.lit(1.0).alias("jaccard"))
        return near.unionByName(equal)


def _leaders(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair of a group the least set of those that pairs connect with it."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for c in range(0, len(a), 10_000):
        for x, y in zip(a[c : c + 10_000].tolist(), b[c : c + 10_000].tolist()):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
    kinds, of = np.unique(a, return_inverse=True)
    return np.array([find(x) for x in kinds.tolist()], np.int64)[of]


def _distinct(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(x, root): the connected components of (a, b) edges, root being the least; alternating large and small stars."""

    def star(e: DataFrame) -> DataFrame:
        return e.select("u", "v").where("u <> v").distinct()

    now = settle(star(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))))
    mark = None
    while True:
        by = Window.partitionBy("u")
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both.withColumn("m", F.least("u", F.min("v").over(by))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.withColumn("m", F.min("v").over(by))
        small = star(low.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))))
        now = settle(small)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("u").alias("x"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("x"), F.col("v").alias("root")).distinct())
        mark = seen


def keep_one(docs: DataFrame, n: int = N, threshold: str | float = THRESHOLD) -> DataFrame:
    """The documents less all but the first (by doc_id) of each group that similar pairs connect; columns as given."""
    j = Join(docs, n, threshold, "stars")
    groups = j.members.join(components(j.pairs).withColumnRenamed("x", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    ranked = groups.select("doc_id", "h", F.row_number().over(Window.partitionBy("root").orderBy("doc_id", "h")).alias("nth"))
    gone = settle(ranked.where("nth > 1").select(F.col("doc_id").alias("gone_id"), F.col("h").alias("gone_h")))
    rows = docs.select(F.struct("*").alias("row")).select("row", F.col("row.doc_id").cast("long").alias("id"), F.unhex(F.md5(F.col("row.text").cast("string"))).alias("h"))
    left = rows.join(gone, (F.col("id") == F.col("gone_id")) & (F.col("h") == F.col("gone_h")), "left_anti")
    nth = F.row_number().over(Window.partitionBy("id", "h").orderBy("id"))
    return left.withColumn("nth", nth).where("nth = 1 or id is null or h is null").select("row.*")


def similar_documents(docs: DataFrame, n: int = N, threshold: str | float = THRESHOLD) -> DataFrame:
    return Join(docs, n, threshold).similar()


def linked_documents(docs: DataFrame, n: int = N, threshold: str | float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, links): a row for each doc_id and each set of n-grams that its texts have, empty ones included.

    ``links`` counts the other rows whose sets reach the threshold, copies included; ``class_id`` is the
    least doc_id of the rows that links connect.  Rows without doc_id are left out; a set without
    n-grams has no links.
    """
    j = Join(docs, n, threshold, "links")
    nodes = j.members.select("doc_id", "sid").distinct()
    count = j.pairs.where("b is null").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "sid")
    root = components(j.pairs.where("b is not null")).withColumnRenamed("x", "sid")
    sets = j.sets.select("sid", "copies", F.col("first.doc_id").alias("least")).join(count, "sid", "left").join(root, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    sets = sets.select("sid", F.min("least").over(Window.partitionBy("root")).alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    found = nodes.join(sets, "sid").select("doc_id", "class_id", "links")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("h")).where("doc_id is not null").distinct()
    wordless = named.join(j.members.select("doc_id", "h"), ["doc_id", "h"], "left_anti").select("doc_id").distinct()
    return found.unionByName(wordless.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("links")))


def oracle(n: int = N, threshold: str = THRESHOLD) -> str:
    """DuckDB SQL for :func:`similar_documents`, by counting common n-grams of all pairs of documents."""
    return f"""
    WITH t AS (SELECT doc_id, {SQL_WORDS.format("text")} AS w FROM documents WHERE doc_id IS NOT NULL AND len(w) > 0),
    s AS (SELECT DISTINCT doc_id, list_sort(list_distinct(CASE WHEN len(w) < {n} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' ')) END)) AS g FROM t),
    e AS (SELECT r, doc_id, len(g) AS size, unnest(g) AS g FROM (SELECT row_number() OVER () AS r, * FROM s)),
    p AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, any_value(a.size) AS size_a, any_value(b.size) AS size_b, count(*) AS o FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2, a.r, b.r)
    SELECT doc_a, doc_b, round(o / (size_a + size_b - o), 6) AS jaccard FROM p WHERE o >= {threshold}::DECIMAL(9, 6) * (size_a + size_b - o)"""


def oracle_links(n: int = N, threshold: str = THRESHOLD) -> str:
    """DuckDB SQL for :func:`linked_documents`, by counting common n-grams of all pairs of rows."""
    return f"""
    WITH RECURSIVE t AS (SELECT doc_id, {SQL_WORDS.format("coalesce(text, '')")} AS w FROM documents WHERE doc_id IS NOT NULL),
    s AS (SELECT DISTINCT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < {n} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' ')) END)) AS g FROM t),
    r AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id, g) AS r, * FROM s),
    e AS (SELECT r, len(g) AS size, unnest(g) AS g FROM r),
    p AS (SELECT a.r AS a, b.r AS b, any_value(a.size) AS size_a, any_value(b.size) AS size_b, count(*) AS o FROM e a JOIN e b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2),
    l AS MATERIALIZED (SELECT a, b FROM p WHERE o >= {threshold}::DECIMAL(9, 6) * (size_a + size_b - o)),
    c AS (SELECT r, doc_id AS class_id FROM r UNION SELECT l.b, c.class_id FROM c JOIN l ON l.a = c.r)
    SELECT r.doc_id, k.class_id, coalesce(n.links, 0) AS links FROM r JOIN (SELECT r, min(class_id) AS class_id FROM c GROUP BY 1) k USING (r) LEFT JOIN (SELECT a AS r, count(*) AS links FROM l GROUP BY 1) n USING (r)"""
