"""Toxicity: a subsequence string kernel support vector machine with Nystroem landmarks.

A unit is a blank-separated token, or a run of four or more single characters ("m o r o n"), lower-
cased, with a mark at either end; of a token longer than ``WINDOW`` every window is a unit.  The
kernel of two units sums, over common subsequences of 3 and 4 characters that spread over at most
``SPAN``, decay ** (both spans), divided by the units' norms; so inserted characters and gaps cost
similarity but don't break a match.  Characters other than letters only widen gaps.  Half of the
landmarks are insults far from each other, the others a sample of sound units; features are
K(u, L) K(L, L) ** -1/2; a linear squared-hinge SVM over all units of the training texts is fitted on
them with Newton steps (units beyond the margin have no part in its optimum, so only the others are
held).  Only labels of whole texts exist, so the units that count as insults are found by
alternating between fitting and relabelling (multiple-instance SVM, begun from a greedy cover of the
toxic texts).  As the kernel is linear in the weights of subsequences, the fitted function collapses
into one table of subsequence weights, and a unit costs the same whatever the number of landmarks.

A text's score is the mean of its two highest units' values, or its only unit's value; the cut is put into the widest gap that
separates the labelled texts best.

Defined cases: a null, empty or wordless text is scored as ``EMPTY`` and kept as clean; a label of a
missing document, of one without text or without value is ignored and doesn't use up the bound; several labels of one doc_id count as its highest;
without both classes in the labels nothing is rejected; whole texts are read; repeated rows are scored alike; other columns pass untouched.
"""

from __future__ import annotations

import functools
import heapq
import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vec import chunks

DECAY = 0.6
#: Subsequences spread over at most SPAN characters; tokens longer than WINDOW come in windows of that length, one every STEP.
SPAN, WINDOW, STEP = 9, 24, 12
EMPTY = -10.0
KNOWN = 300_000
#: The classifier is fitted on at most so many labelled texts of each class, chosen by hash of doc_id.
TRAIN_PER_CLASS = 1500
LANDMARKS = 96
#: Sound units that fitting begins with; the others take part as soon as the fitted function puts them over -1.
BEGIN = 4000
SPACED = re.compile(r"(?<!\S)\S(?:\s\S){3,}(?!\S)")


@functools.cache
def _alphabet() -> np.ndarray:
    """Code point to 1..26 for letters, 29..31 for those with diacritics (a, e, others), 0 for what isn't a letter."""
    to = np.zeros(0x110000, np.uint8)
    for c in range(0x3000):
        base, *marks = unicodedata.normalize("NFD", chr(c).lower())
        if "a" <= base <= "z":
            to[c] = {"a": 29, "e": 30}.get(base, 31) if marks else ord(base) - 96
        elif base.isalpha():
            to[c] = 1 + ord(base) % 26
    letters = np.arange(0x3000, 0x110000)
    to[0x3000:] = 1 + letters % 26
    return to


def encode(units: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: (indexes of units, codes with end marks 27 and 28)."""
    to, by = _alphabet(), {}
    for i, u in enumerate(units):
        at, texts = by.setdefault(len(u), ([], []))
        at.append(i)
        texts.append(u)
    out = {}
    for n, (at, texts) in by.items():
        codes = np.empty((len(texts), n + 2), np.uint32)
        codes[:, 0], codes[:, -1] = 27, 28
        codes[:, 1:-1] = to[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)].reshape(len(texts), n)
        out[n + 2] = (np.array(at), codes)
    return out


@functools.cache
def _places(width: int, p: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.array([x for i in range(width) for x in combinations(range(i, min(width, i + SPAN)), p) if x[0] == i], np.int64).reshape(-1, p)
    return at, DECAY ** (at[:, -1] - at[:, 0] + 1.0) if len(at) else np.zeros(0)


def subsequences(codes: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids [units, places] of all subsequences of p characters and their weights.  Ids in which a character isn't a letter or mark belong to no landmark."""
    at, weight = _places(codes.shape[1], p)
    n, w = codes.shape
    pair = ((codes[:, :, None] << np.uint32(5)) | codes[:, None, :]).reshape(n, w * w)
    low = pair[:, at[:, p - 2] * w + at[:, p - 1]]
    if p == 3:
        return (codes[:, at[:, 0]] << np.uint32(10)) | low, weight
    high = (pair << np.uint32(10)) + np.uint32(1 << 15)
    return high[:, at[:, 0] * w + at[:, 1]] + low, weight


SPACE = (1 << 15) + (1 << 20)


def landmark(unit: str) -> dict[int, float]:
    """The normalised weight of each subsequence of letters and marks in a unit."""
    found: dict[int, float] = {}
    for _, codes in encode([unit]).values():
        norm = norms(codes)[0]
        for p in (3, 4):
            (ids, weight), (at, _) = subsequences(codes, p), _places(codes.shape[1], p)
            whole = codes[0][at].all(1) if len(at) else np.zeros(0, bool)
            for x, y in zip(ids[0][whole].tolist(), weight[whole].tolist()):
                found[x] = found.get(x, 0.0) + y / norm
    return found


def norms(codes: np.ndarray) -> np.ndarray:
    """Of each unit the root of the summed squared weights of its subsequences, each place counted by itself."""
    letters, fade = (codes > 0).astype(float).T, DECAY**2
    ending, total = letters * fade, np.zeros(len(codes))
    for q in (2, 3, 4):
        carried, longer = np.zeros(len(codes)), np.zeros_like(ending)
        for j in range(1, len(ending)):
            carried = fade * (carried + ending[j - 1])
            longer[j] = letters[j] * carried
        ending = longer
        if q >= 3:
            total += ending.sum(0)
    return np.sqrt(np.maximum(total, 1e-12))


def kernel(units: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel of each unit with each landmark."""
    sub: dict[int, np.ndarray] = {}
    for j, u in enumerate(landmarks):
        for x, y in landmark(u).items():
            sub.setdefault(x, np.zeros(len(landmarks), np.float32))[j] += y
    row = np.zeros(SPACE + 1, np.int32)
    matrix = np.zeros((len(sub) + 1, len(landmarks)), np.float32)
    for r, (x, v) in enumerate(sub.items(), 1):
        row[x], matrix[r] = r, v
    out = np.zeros((len(units), len(landmarks)), np.float32)
    for at, codes in encode(units).values():
        for a in range(0, len(codes), 2000):
            c = codes[a : a + 2000]
            k = np.zeros((len(c), len(landmarks)), np.float32)
            for p in (3, 4):
                ids, weight = subsequences(c, p)
                hit = row[ids]
                who, place = np.nonzero(hit)
                for b in range(0, len(who), 100_000):
                    w, q = who[b : b + 100_000], place[b : b + 100_000]
                    first = np.flatnonzero(np.diff(w, prepend=-1))
                    k[w[first]] += np.add.reduceat(matrix[hit[w, q]] * weight[q, None].astype(np.float32), first)
            out[at[a : a + 2000]] = k / norms(c)[:, None].astype(np.float32)
    return out


@dataclass
class Model:
    table: np.ndarray  # weight of each subsequence
    bias: float
    cut: float

    def __post_init__(self):
        self.known: dict[str, float] = {}

    def values(self, units: list[str]) -> np.ndarray:
        """The SVM's function for each unit."""
        out = np.full(len(units), EMPTY)
        for at, codes in encode(units).values():
            for a in range(0, len(codes), 4000):
                c, f = codes[a : a + 4000], 0.0
                for p in (3, 4):
                    if c.shape[1] >= p:
                        ids, weight = subsequences(c, p)
                        f = f + self.table[ids] @ weight
                out[at[a : a + 4000]] = f / norms(c) + self.bias
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        found = [units_of(t) for t in texts]
        new = set().union(*found)
        if len(self.known) + len(new) > KNOWN:
            self.known = {}
        new = [u for u in new if u not in self.known]
        self.known.update(zip(new, self.values(new).tolist()))
        return np.array([pooled([self.known[u] for u in units]) for units in found])


def units_of(text: str | None) -> list[str]:
    if not text:
        return []
    text = text.lower()
    tokens = [*text.split(), *("".join(m.split()) for m in SPACED.findall(text))]
    if max(map(len, tokens), default=0) <= WINDOW:
        return tokens
    return [u[a : a + WINDOW] for u in tokens for a in range(0, max(1, len(u) - WINDOW + STEP), STEP)]


def pooled(values: list[float]) -> float:
    if len(values) < 2:
        return values[0] if values else EMPTY
    top = max(values)
    values.remove(top)
    return (top + max(values)) / 2


def _cover(bags: list[list[str]], forbidden: Counter, per: int = 2, least: int = 2) -> set[str]:
    """Units chosen greedily until each bag has ``per``, or no unit would serve ``least`` more bags; ties go by name."""
    holders: dict[str, list[int]] = {}
    for i, b in enumerate(bags):
        for u in b:
            if not forbidden[u]:
                holders.setdefault(u, []).append(i)
    holders = {u: h for u, h in holders.items() if len(h) >= least}
    need, gain, chosen = [per] * len(bags), {u: len(h) for u, h in holders.items()}, set()
    heap = [(-g, u) for u, g in gain.items()]
    heapq.heapify(heap)
    while heap:
        g, u = heapq.heappop(heap)
        now = sum(need[i] > 0 for i in holders[u])
        if now < -g:
            if now >= least:
                heapq.heappush(heap, (-now, u))
            continue
        chosen.add(u)
        for i in holders[u]:
            need[i] -= 1
    return chosen or {u for b in bags for u in b if not forbidden[u]} or {bags[0][0]}


def _without_copies(bags: list[list[str]]) -> list[list[str]]:
    """Bags of which no earlier one has half of the 8 units with the least hashes."""
    seen: dict[str, list[int]] = {}
    kept = []
    for i, b in enumerate(bags):
        least = sorted(b, key=hash32)[:8]
        shared = Counter(j for u in least for j in seen.get(u, ()))
        if not shared or max(shared.values()) * 2 < len(least):
            kept.append(b)
            for u in least:
                seen.setdefault(u, []).append(i)
    return kept


def _newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Weights (the last one the bias) of the least ridge / 2 |w|^2 + sum of weighted squared hinges."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(30):
        slack = 1 - y * (x @ w)
        on = slack > 0
        grad = penalty * w - 2 * x[on].T @ (weight[on] * slack[on] * y[on])
        step = np.linalg.solve(np.diag(penalty) + 2 * (x[on] * weight[on, None]).T @ x[on], grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(texts: list[str | None], toxic: list[int], landmarks: int = LANDMARKS, rounds: int = 4, ridge: float = 0.05) -> Model | None:
    """A model from labelled texts (documents or sentences); None unless both classes are there."""
    bags = [(sorted(set(units_of(t))), bool(y)) for t, y in zip(texts, toxic) if t]
    good, bad = [b for b, y in bags if not y and b], [b for b, y in bags if y and b]
    if not good or not bad:
        return None
    in_bad, in_good = Counter(u for b in bad for u in b), Counter(u for b in good for u in b)
    # Begin: the units that explain the toxic texts, two for each, greedily; no sound text may have them.
    positive = _cover(bad, in_good)
    # And those that so many toxic texts that aren't copies of each other can't have by chance.
    single = _without_copies(bad)
    chance = math.log((len(single) + len(good)) / len(single))
    often = Counter(u for b in single for u in b)
    positive |= {u for u, n in often.items() if not in_good[u] and n * chance > math.log(len(often)) + 5}
    half = landmarks // 2
    every = sorted(in_good, key=lambda u: (hash32(u), u))
    units = sorted(in_bad)
    active = np.zeros(len(every), bool)
    active[:BEGIN] = True
    for r in range(rounds):
        pos = sorted(positive, key=lambda u: (-in_bad[u], u))
        chosen = _spread(pos, half)
        marks = list(dict.fromkeys(chosen + every[: landmarks - len(chosen)]))  # of sound units a sample by hash
        kll = kernel(marks, marks).astype(float)
        value, vector = np.linalg.eigh((kll + kll.T) / 2)
        root = vector @ np.diag(np.maximum(value, 1e-3) ** -0.5) @ vector.T
        parts = [landmark(u) for u in marks]
        # A positive that many toxic texts share is surer than one that only one has.
        sure = np.array([in_bad[u] for u in pos], float)
        x, order, new = kernel(pos, marks) @ root, np.zeros(0, np.int64), np.flatnonzero(active)
        while len(new):
            # A sound unit at or under -1 has no part in the optimum, so adding those over it until there are none left out fits them all.
            order = np.concatenate([order, new])
            x = np.vstack([x, kernel([every[i] for i in new.tolist()], marks) @ root])
            y = np.r_[np.ones(len(pos)), -np.ones(len(order))]
            w = _newton(x, y, np.r_[sure * (len(every) / sure.sum() / 2), np.ones(len(order))], ridge)
            beta = root @ w[:-1]
            table = np.zeros(SPACE + 1)
            for b, found in zip(beta.tolist(), parts):
                for i, v in found.items():
                    table[i] += b * v
            model = Model(table.astype(np.float32), float(w[-1]), 0.0)
            over = model.values(every) > -1
            used = np.zeros(len(every), bool)
            used[order] = True
            new = np.flatnonzero(over & ~used)
            active = over
        if r + 1 < rounds:
            value_of = dict(zip(units, model.values(units).tolist()))
            positive |= {u for u in units if value_of[u] > 0 and not in_good[u]}
            active[:BEGIN] = True
    low = sorted(model.scores([t for t, y in zip(texts, toxic) if t and not y]).tolist())
    high = sorted(model.scores([t for t, y in zip(texts, toxic) if t and y]).tolist())
    model.cut = _cut(low, high)
    model.known = {}
    return model


def _cut(low: list[float], high: list[float]) -> float:
    """Between neighbouring scores, where the classes' accuracies are best, a sound text's counting four times; of those the widest gap's middle."""
    every = np.array(sorted({*low, *high}))
    if len(every) < 2:
        return float(every[0]) + 1.0
    mids = (every[1:] + every[:-1]) / 2
    fine = 4 * np.searchsorted(low, mids) / len(low) + 1 - np.searchsorted(high, mids) / len(high)
    best = np.flatnonzero(fine >= fine.max() - 1e-12)
    return float(mids[best[np.argmax((every[1:] - every[:-1])[best])]])


def hash32(s: str) -> int:
    h = 2166136261
    for b in s.encode("utf-8", "surrogatepass"):
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return h


def _spread(units: list[str], n: int) -> list[str]:
    """n units far from each other: half of them the first ones, then always the four whose nearest chosen one is least similar."""
    if len(units) <= n:
        return list(units)
    chosen = list(units[: max(1, n // 2)])
    near = kernel(units, chosen).max(1)
    while len(chosen) < n:
        more = [units[i] for i in np.argsort(near, kind="stable")[: min(4, n - len(chosen))]]
        chosen += more
        near = np.maximum(near, kernel(units, more).max(1))
    return chosen


def train(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS, **how) -> Model | None:
    """Fit on at most ``per_class`` labelled documents of each class; the choice goes by hash, not by order."""
    labelled = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    with_text = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"))
    labelled = labelled.join(with_text, "doc_id", "left_semi")
    share = F.xxhash64("doc_id")
    picked = labelled.where("toxic <> 0").orderBy(share, "doc_id").limit(per_class).unionByName(labelled.where("toxic = 0").orderBy(share, "doc_id").limit(per_class))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(picked), "doc_id").where("text is not null").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return fit(rows["text"].to_pylist(), rows["toxic"].to_pylist(), **how)


def toxicity(docs: DataFrame, model: Model | None, text: str = "text") -> Column:
    """Score of each text, for use in select or where; above the model's cut it's toxic."""
    if model is None:
        return F.lit(EMPTY)
    sent = docs.sparkSession.sparkContext.broadcast((model.table, model.bias, model.cut))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        m = _model(sent)
        out = [m.scores(run) for _, run in chunks(texts.to_pylist())]
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return score(F.col(text).cast("string"))


def _model(sent) -> Model:
    """One model in each worker for each broadcast, so that known units stay known between batches."""
    if getattr(_model, "of", None) is not sent:
        _model.of, _model.it = sent, Model(*sent.value)
    return _model.it


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score, toxic) for each row of documents."""
    model = train(docs, labels)
    cut = model.cut if model else float("inf")
    score = toxicity(docs, model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.round(score, 6).alias("score")).withColumn("toxic", (F.col("score") > F.lit(cut)).cast("int"))
