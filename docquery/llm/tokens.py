"""Token counts by rank-synchronous merging of ragged arrays.

Pre-tokens of a batch are held as one flat symbol array with sequence bounds.  Each round looks up
the ranks of all adjacent pairs, takes each sequence's lowest, merges all its occurrences from left
to right (overlaps skipped), and drops the sequences in which nothing is left to merge.  What
survives of a pre-token is its token count.  A pair's rank is that of its bytes in the vocabulary,
so the counts are those of byte-level BPE with the file's ranks.

Defined cases: a null text has null counts, an empty one 0; repeated rows and any id are kept as
they are; texts of any length are counted whole; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vec import chunks

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PRETOKEN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
NONE = np.int64(2**62)
KNOWN = 400_000


class Merger:
    """Counts tokens of pre-tokens under a vocabulary of (base64 bytes, rank) lines."""

    def __init__(self, lines: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        self.width = np.int64(max(ranks.values()) + 1)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a * int(self.width) + b] = rank
        keys = np.array(sorted(pairs), np.int64)
        self.keys, self.ranks = keys, np.array([pairs[k] for k in keys.tolist()], np.int64)
        self.known: dict[str, int] = {}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word."""
        size = np.array([len(w) for w in words], np.int64)
        out = size.copy()
        who = np.flatnonzero(size > 1)
        symbols = self.single[np.frombuffer(b"".join(w for w in words if len(w) > 1), np.uint8)]
        size = size[who]
        end = np.cumsum(size)
        rank = np.full(len(symbols), NONE)  # of the pair that begins here
        inner = np.ones(len(symbols), bool)
        inner[end - 1] = False
        at = np.flatnonzero(inner)
        rank[at] = self.rank(symbols[at], symbols[at + 1])
        while len(who):
            start = np.cumsum(size) - size
            low = np.minimum.reduceat(rank, start)
            live = low < NONE
            if not live.all():  # the others are done
                out[who[~live]] = size[~live]
                keep = np.repeat(live, size)
                symbols, rank = symbols[keep], rank[keep]
                who, size, low = who[live], size[live], low[live]
                if not len(who):
                    break
            here = np.flatnonzero(rank == np.repeat(low, size))
            # In a run of neighbouring occurrences (a a a) every other one is merged.
            run = np.diff(here, prepend=-2) != 1
            first = here[run]
            here = here[((here - first[np.cumsum(run) - 1]) & 1) == 0]
            symbols[here] = rank[here]
            gone = np.zeros(len(symbols), bool)
            gone[here + 1] = True
            owner = np.repeat(np.arange(len(who)), size)
            size = size - np.bincount(owner[here], minlength=len(who))
            keep = ~gone
            new = (np.cumsum(keep) - 1)[here]
            symbols, rank = symbols[keep], rank[keep]
            last = np.zeros(len(symbols), bool)
            last[np.cumsum(size) - 1] = True
            begin = np.zeros(len(symbols) + 1, bool)
            begin[0] = True
            begin[1:] = last
            changed = np.union1d(new, (new - 1)[~begin[new]])
            rank[changed] = NONE
            changed = changed[~last[changed]]
            rank[changed] = self.rank(symbols[changed], symbols[changed + 1])
        return out

    def learn(self, pieces: set[str]) -> dict[str, int]:
        """Counts for these pre-tokens; recent ones are remembered."""
        if len(self.known) + len(pieces) > KNOWN:
            self.known = {}
        new = [p for p in pieces if p not in self.known]
        if new:
            self.known.update(zip(new, self.count([p.encode("utf-8", "surrogatepass") for p in new]).tolist()))
        return self.known


def _merger(sent) -> Merger:
    """One in each worker for each vocabulary."""
    if getattr(_merger, "of", None) is not sent:
        _merger.of, _merger.it = sent, Merger(sent.value)
    return _merger.it


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PRETOKEN) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) for each row of documents; nothing is shuffled.

    The vocabulary's file is read by the driver only and broadcast (under a megabyte, whatever the input).
    """
    sent = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, split = _merger(sent), regex.compile(pattern).findall
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for at, run in chunks(texts):
                pieces = [split(t) for t in run]
                known = bpe.learn(set().union(*pieces)).__getitem__
                null = np.array([t is None for t in texts[at : at + len(run)]], bool)
                n = [np.array(x, np.int64) for x in ([len(p) for p in pieces], [sum(map(known, p)) for p in pieces])]
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(run)), *(pa.array(x, mask=null) for x in n)], ["doc_id", "n_pretokens", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")
