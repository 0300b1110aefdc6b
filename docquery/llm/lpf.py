"""Deduplication of passages by longest-previous-factor arrays.

A passage of at least ``least`` words that occurred before (in order of doc_id, then position) is
removed; its first occurrence stays, within documents as between them.

Suffixes can't be sorted over a whole corpus at once, so documents meet on anchors.  Of the
``anchor``-word grams in any window of ``least`` words the one of least hash is an anchor; equal
windows have equal anchors wherever they are.  Anchors that occur once are dropped.  The others'
surroundings (all windows that hold the anchor) go to the first document that has the anchor, where
a group's segments are laid out in order, a suffix array is built by prefix doubling, and previous
and next smaller positions in suffix order give each position's longest earlier match.  So every
window's first and later occurrences are in one group, and the result is that of one suffix array
over the whole corpus.  Groups of many words are worked off in parts of about ``part`` words, by text;
windows that are the first of their kind in their part then meet those of other parts by hash, so
that no task holds a whole group, also if its documents have nothing but the anchor in common.

Exact copies of a text are settled by its hash: later ones lose all words if they have ``least``.

Defined cases: a null text stays null with 0 words; texts of fewer words than ``least`` stay whole;
null doc_ids come last, in order of the text's hash; of repeated rows one counts as the first; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free, settle
from .vec import GRAM, SQL_WORDS, Words, chunks

LEAST = 50
ANCHOR = 10
#: Words of a group that one task sorts; of segments that are sent, or small groups that are sorted, at once.
PART, SEND, ENOUGH = 500_000, 250_000, 200_000
LAST = 2**63 - 1


def _slide(x: np.ndarray, n: int, op) -> np.ndarray:
    """op over each n neighbours, by doubling."""
    size, out = 1, x
    while size * 2 <= n:
        out = op(out[:-size], out[size:]) if len(out) > size else out[:0]
        size *= 2
    if size < n:
        rest = n - size
        out = op(out[:-rest], out[rest:]) if len(out) > rest else out[:0]
    return out


def anchors(hashes: np.ndarray, least: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of one text's words: grams that are least in some window."""
    if len(hashes) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g, n = Words.grams_of(hashes, anchor), least - anchor + 1
    low = _slide(g, n, np.minimum)
    edge = np.zeros(n - 1, np.uint64)
    of = _slide(np.concatenate([edge, low, edge]), n, np.maximum)  # the greatest minimum of the windows with a gram
    at = np.flatnonzero(of == g)
    return at, g[at]


def _narrow(rank: np.ndarray) -> np.ndarray:
    return rank.astype(np.int32) if len(rank) < 2**31 else rank


def suffix_ranks(x: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... symbols, until no two are equal."""
    rank = np.unique(x, return_inverse=True)[1].astype(np.int64)
    levels, size = [_narrow(rank)], 1
    while size < len(x) and rank.max() < len(x) - 1:
        key = (rank + 1) * (len(x) + 2)
        key[:-size] += rank[size:] + 1
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        levels.append(_narrow(rank))
        size *= 2
    return levels


def common(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of the longest common prefixes of suffixes i and j."""
    i, j, n = i.copy(), j.copy(), len(levels[0])
    total = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (i < n) & (j < n)
        same = np.zeros(len(i), bool)
        same[inside] = levels[k][i[inside]] == levels[k][j[inside]]
        total += same * (1 << k)
        i, j = i + same * (1 << k), j + same * (1 << k)
    return total


def longest_previous(x: np.ndarray, least: int = 1) -> np.ndarray:
    """For each position the length of its longest match that begins earlier; matches under ``least`` may count as 0."""
    out = np.zeros(len(x), np.int64)
    if not len(x):
        return out
    levels = suffix_ranks(x)
    order = np.argsort(levels[-1], kind="stable")
    near = common(levels, order[:-1], order[1:]) >= least  # neighbours in suffix order
    block = np.cumsum(np.concatenate([[True], ~near])) - 1
    shared = np.concatenate([[False], near]) | np.concatenate([near, [False]])
    live, of = order[shared].tolist(), block[shared].tolist()
    before, after = [-1] * len(live), [-1] * len(live)
    stack: list[int] = []
    for k, p in enumerate(live):  # indexes into live with rising positions
        while stack and (of[stack[-1]] != of[k] or live[stack[-1]] > p):
            top = stack.pop()
            if of[top] == of[k]:
                after[top] = p
        if stack:
            before[k] = live[stack[-1]]
        stack.append(k)
    live = np.array(live, np.int64)
    for found in (np.array(before, np.int64), np.array(after, np.int64)):
        has = found >= 0
        out[live[has]] = np.maximum(out[live[has]], common(levels, live[has], found[has]))
    return out


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _key() -> Column:
    return F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def _halves(h: pa.Array) -> np.ndarray:
    """16-byte names as two numbers each."""
    return np.frombuffer(b"".join(h.to_pylist()), np.uint64).reshape(-1, 2)


def _packed(words: np.ndarray, size: np.ndarray) -> pa.Array:
    """Runs of words of these sizes, each as bytes."""
    ends = np.concatenate([[0], np.cumsum(size * 8)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(words))])


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), start[1], ..."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


def _unions(start: np.ndarray, stop: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which spans begin a union of overlapping or touching ones, and which end it; spans in order, stops rising within ``of``."""
    new = np.ones(len(start), bool)
    new[1:] = (of[1:] != of[:-1]) | (start[1:] > stop[:-1])
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(start))[: len(first)] - 1


_FOUND = pa.schema([("h", pa.binary()), ("fid", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("window", pa.int64())])
_FOUND_SQL = "h binary, fid long, start int, stop int, window long"


def _matches(rows: pa.Table, least: int) -> pa.RecordBatch:
    """Of whole groups (owner, salt), in order: word spans that occurred earlier in their group (window null), and, of groups
    that are one part of several, the windows that are the first of their kind in it, by hash."""
    h = _halves(rows["h"].combine_chunks())
    owner, salt, start = rows["owner"].to_numpy(), rows["salt"].to_numpy(), rows["start"].to_numpy().astype(np.int64)
    group = np.cumsum(np.concatenate([[True], (owner[1:] != owner[:-1]) | (salt[1:] != salt[:-1])]))
    same = np.zeros(len(h), bool)  # repeated rows of one text
    same[1:] = (group[1:] == group[:-1]) & (start[1:] == start[:-1]) & (h[1:] == h[:-1]).all(1)
    if same.any():
        rows, group, start = rows.filter(pa.array(~same)), group[~same], start[~same]
    size = rows["size"].to_numpy().astype(np.int64)
    words = np.frombuffer(b"".join(rows["words"].to_pylist()), np.uint64)
    begin = np.cumsum(size + 1) - (size + 1)
    inside = np.ones(len(words) + len(size), bool)
    inside[begin + size] = False
    # Groups don't meet: a symbol is a word of a group.  Ends of segments are unlike all else.
    known, of = np.unique(words + np.repeat(group, size).astype(np.uint64) * np.uint64(GRAM), return_inverse=True)
    x = np.empty(len(inside), np.int64)
    x[inside], x[~inside] = of, len(known) + np.arange(len(size))
    previous = longest_previous(x, least)
    segment = np.repeat(np.arange(len(size)), size + 1)
    again = np.flatnonzero(previous >= least)
    stop = again + previous[again]
    first, last = _unions(again, stop, segment[again])
    at, to, windows = [again[first]], [stop[last]], [pa.nulls(len(first), pa.int64())]
    more = rows["parts"].to_numpy()[segment] > 1
    if more.any():
        fresh = np.flatnonzero(more & inside & (previous < least))
        fresh = fresh[fresh + least <= (begin + size)[segment[fresh]]]
        at.append(fresh)
        to.append(fresh + least)
        hashes = Words.grams_of(words, least)
        windows.append(pa.array(hashes[fresh - segment[fresh]].view(np.int64)))
    at, to = np.concatenate(at), np.concatenate(to)
    who = segment[at]
    shift = start[who] - begin[who]
    take = pa.array(who)
    return pa.RecordBatch.from_arrays([rows["h"].take(take).combine_chunks(), rows["fid"].take(take).combine_chunks(), pa.array((at + shift).astype(np.int32)), pa.array((to + shift).astype(np.int32)), pa.concat_arrays(windows)], schema=_FOUND)


def _grouped(least: int, enough: int):
    """Rows sorted by group come in batches; whole groups are worked off together, ``enough`` words or one group at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.column("size").to_numpy().sum() for b in held) < enough:
                continue
            t = pa.Table.from_batches(held)
            owner, salt = t["owner"].to_numpy(), t["salt"].to_numpy()
            open_ = int(np.flatnonzero((owner != owner[-1]) | (salt != salt[-1]))[-1]) + 1 if (owner[0], salt[0]) != (owner[-1], salt[-1]) else 0
            if open_:
                yield from _split(t.slice(0, open_), least, enough)
                held = t.slice(open_).to_batches()
        if held:
            yield from _split(pa.Table.from_batches(held), least, enough)

    return run


def _split(t: pa.Table, least: int, enough: int) -> Iterator[pa.RecordBatch]:
    """Whole groups, in runs that end with the group that reaches ``enough`` words."""
    owner, salt, upto = t["owner"].to_numpy(), t["salt"].to_numpy(), np.cumsum(t["size"].to_numpy().astype(np.int64))
    ends = np.append(np.flatnonzero((owner[1:] != owner[:-1]) | (salt[1:] != salt[:-1])) + 1, len(owner))
    a = 0
    while a < len(owner):
        base = upto[a - 1] if a else 0
        b = int(ends[min(np.searchsorted(upto[ends - 1], base + enough), len(ends) - 1)])
        yield _matches(t.slice(a, b - a), least)
        a = b


def repeats(docs: DataFrame, least: int = LEAST, anchor: int = ANCHOR, part: int = PART) -> DataFrame:
    """(h, spans): for each distinct text, by md5, the word spans that occurred before in another text or earlier in it."""
    if not 1 <= anchor <= least:
        raise ValueError("anchor must be 1 to least")
    keyed = docs.select(_key().alias("h"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, ids = batch.column(0), batch.column(1).fill_null(LAST)
            for at, run in chunks(batch.column(2).to_pylist()):
                w = Words(run)
                found = [anchors(w.hash[a:b], least, anchor) for a, b in zip(w.ptr[:-1].tolist(), w.ptr[1:].tolist())]
                n = [len(p) for p, _ in found]
                who = pa.array(np.repeat(np.arange(at, at + len(run)), n))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([g for _, g in found]).view(np.int64)), h.take(who), pa.array(np.concatenate([p for p, _ in found]).astype(np.int32)), ids.take(who)], ["anchor", "h", "pos", "fid"])

    # One shuffle by anchor serves copies, counts and owners.
    by = Window.partitionBy("anchor")
    found = keyed.mapInArrow(find, "anchor long, h binary, pos int, fid long").repartition("anchor")
    found = found.groupBy("anchor", "h", "pos").agg(F.min("fid").alias("fid"))
    first = F.min(F.struct("fid", "h")).over(by)
    shared = found.select("*", F.count("*").over(by).alias("n"), F.xxhash64(first["fid"], first["h"]).alias("owner")).where("n > 1")
    wanted = shared.groupBy("h").agg(F.min("fid").alias("fid"), F.collect_list(F.struct("owner", "pos")).alias("at"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fid, h, lists = batch.column(0), batch.column(1), batch.column(3)
            ends, owners, places = lists.offsets.to_numpy(), lists.values.field(0).to_numpy(), lists.values.field(1).to_numpy()
            for at, run in chunks(batch.column(2).to_pylist()):
                w, own = Words(run), ends[at : at + len(run) + 1]
                text = np.repeat(np.arange(len(run)), np.diff(own))
                owner, pos = owners[own[0] : own[-1]], places[own[0] : own[-1]].astype(np.int64)
                order = np.lexsort((pos, owner, text))
                text, owner, pos = text[order], owner[order], pos[order]
                start, stop = np.maximum(0, pos - least + anchor), np.minimum(np.diff(w.ptr)[text], pos + least)
                kind = np.cumsum(np.concatenate([[0], (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])]))
                first, last = _unions(start, stop, kind)
                text, owner, start, size = text[first], owner[first], start[first], stop[last] - start[first]
                upto, a = np.cumsum(size), 0
                while a < len(size):  # batches of bounded bytes, or one segment
                    b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + SEND, "right")))
                    who = pa.array(text[a:b] + at)
                    words = w.hash[_ranges(w.ptr[text[a:b]] + start[a:b], size[a:b])]
                    yield pa.RecordBatch.from_arrays([pa.array(owner[a:b]), fid.take(who), h.take(who), pa.array(start[a:b].astype(np.int32)), pa.array(size[a:b].astype(np.int32)), _packed(words, size[a:b])], ["owner", "fid", "h", "start", "size", "words"])
                    a = b

    texts = keyed.select("h", F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), "text")
    segments = texts.join(wanted, (texts["h"] == wanted["h"]) & (texts["doc_id"] == wanted["fid"])).select("fid", texts["h"].alias("h"), "text", "at").mapInArrow(cut, "owner long, fid long, h binary, start int, size int, words binary")
    segments = settle(segments)  # two plans read it
    parts = segments.groupBy("owner").agg(F.ceil(F.sum("size") / part).cast("int").alias("parts")).where("parts > 1")
    # The salt goes by the text; owners of few words have one part.
    salted = segments.join(parts, "owner", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("salt", F.pmod(F.xxhash64("h"), F.col("parts")).cast("int"))
    sorted_ = salted.repartition("owner", "salt").sortWithinPartitions("owner", "salt", "fid", "h", "start")
    found = settle(sorted_.select("owner", "salt", "fid", "h", "start", "size", "words", "parts").mapInArrow(_grouped(least, min(part, ENOUGH)), _FOUND_SQL))
    free(segments)
    # First windows of one part may have occurred in another: they meet by hash, whatever their number.
    earliest = F.min(F.struct("fid", "h", "start")).over(Window.partitionBy("window"))
    across = found.where("window is not null").withColumn("earliest", earliest).where(F.struct("fid", "h", "start") > F.col("earliest"))
    spans = found.where("window is null").select("h", "start", "stop").unionByName(across.select("h", "start", "stop"))
    return spans.groupBy("h").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def deduplicate(docs: DataFrame, least: int = LEAST, anchor: int = ANCHOR, part: int = PART) -> DataFrame:
    """(doc_id, text, n_words, removed_words) for each row of documents, later copies of passages removed."""
    spans = settle(repeats(docs, least, anchor, part))
    keyed = docs.select(_key().alias("h"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = Window.partitionBy("h").orderBy(F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first())
    # Copies are numbered without their texts; the window and the join share the shuffle by h.
    rows = keyed.join(spans, "h", "left").select("doc_id", "text", "spans", (F.row_number().over(order) > 1).alias("copy"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans, copy = batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()
            for at, run in chunks(texts):
                w = Words(run)
                kept, total, gone = [], np.diff(w.ptr), []
                for d, t in enumerate(run):
                    a, n = int(w.ptr[d]), int(total[d])
                    s = spans[at + d].as_py() or []
                    cuts = [(0, n)] if copy[at + d] and n >= least else _merge([(x["start"], x["stop"]) for x in s])
                    out, last = [], 0
                    for i, j in cuts:
                        out.append(t[last : w.start[a + i]])
                        last = w.end[a + j - 1]
                    kept.append(None if texts[at + d] is None else "".join([*out, t[last:]]))
                    gone.append(sum(j - i for i, j in cuts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(run)), pa.array(kept, pa.string()), pa.array(total.astype(np.int32)), pa.array(gone, pa.int32())], ["doc_id", "text", "n_words", "removed_words"])

    return rows.mapInArrow(remove, "doc_id long, text string, n_words int, removed_words int")


def oracle(least: int = LEAST) -> str:
    """DuckDB SQL for :func:`deduplicate`, by all windows of ``least`` words."""
    runs = r"'[\p{L}\p{N}]+'"
    return f"""
    WITH t AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id NULLS LAST, md5(coalesce(text, ''))) AS r, {SQL_WORDS.format("text")} AS w FROM documents),
    p AS (SELECT r, unnest(range(0, len(w) - {least - 1})) AS i, w FROM t WHERE len(w) >= {least}),
    k AS (SELECT r, i, md5(array_to_string(w[i + 1:i + {least}], ' ')) AS k FROM p),
    again AS (SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY k ORDER BY r, i) AS nth FROM k) WHERE nth > 1),
    gone AS (SELECT r, list(DISTINCT j) AS gone FROM (SELECT r, unnest(range(i, i + {least})) AS j FROM again) GROUP BY r),
    words AS (SELECT t.r, doc_id, text, coalesce(gone, []) AS gone, regexp_extract_all(text, {runs}) AS own, string_split_regex(text, {runs}) AS gaps FROM t LEFT JOIN gone USING (r)),
    pieces AS (SELECT r, unnest(range(0, len(own) + 1)) AS i, gone, own, gaps FROM words),
    kept AS (SELECT r, string_agg(CASE WHEN i > 0 AND list_contains(gone, i - 1) AND list_contains(gone, i) THEN '' ELSE gaps[i + 1] END || CASE WHEN i >= len(own) OR list_contains(gone, i) THEN '' ELSE own[i + 1] END, '' ORDER BY i) AS kept FROM pieces GROUP BY r)
    SELECT doc_id, kept AS text, len(coalesce(own, []))::INT AS n_words, len(gone)::INT AS removed_words FROM words LEFT JOIN kept USING (r)"""
