"""Retrieval end to end: analyse the query, get candidates, rerank, and tell how it went."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import answer, domain, retrieve
from ..operators.embed import hashed
from ..operators.filters import FilterSpec, for_app
from ..operators.query import Query, analyse
from .config import Settings

MODES = ("dense", "hybrid", "keyword")


class Timer:
    """Milliseconds by stage."""

    def __init__(self) -> None:
        self.stages: dict[str, float] = {}

    @contextmanager
    def measure(self, stage: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.stages[stage] = (time.perf_counter() - began) * 1000

    def total(self) -> float:
        return sum(self.stages.values())


@dataclass(frozen=True)
class Response:
    query: Query
    mode: str
    results: DataFrame
    timings: Mapping[str, float]
    trace: Sequence[str] = field(default_factory=tuple)


@dataclass(frozen=True)
class Service:
    """Over stored chunks, and postings if they're kept as a table; ``embed`` makes a query's vector."""

    chunks: DataFrame
    settings: Settings = Settings()
    embed: Callable[[str], Sequence[float]] = hashed
    postings: DataFrame | None = None
    size: int | None = None

    def retrieve(self, text: str, mode: str | None = None, top_k: int | None = None, filters: FilterSpec = FilterSpec(), threshold: float | None = None, rerank: bool = True) -> Response:
        s, timer = self.settings, Timer()
        log = logging.getLogger(s.observability.logger_name)
        with timer.measure("analyse"):
            q = analyse(text, s.query_processing)
        mode, k = mode or s.retrieval_mode, top_k or s.vector.top_k
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}; known are {', '.join(MODES)}")
        vector: Sequence[float] = ()
        if mode != "keyword":
            with timer.measure("embed"):
                vector = self.embed(q.normalized)
        with timer.measure("plan"):
            if mode == "dense":
                r = retrieve.dense(self.chunks, vector, k, filters, threshold, s)
            elif mode == "keyword":
                r = retrieve.keyword(self.chunks, q, k, filters, threshold, s, self.postings, self.size)
            else:
                r = retrieve.hybrid(self.chunks, q, vector, k, filters, threshold, s, self.postings, self.size)
            if rerank and s.reranker.enabled:
                r = retrieve.rerank(r, q, k, s)
        trace = (f"mode={mode}", f"top_k={k}", f"terms={len(q.terms())}", f"filters={not filters.is_empty}")
        log.log(logging.DEBUG if s.observability.debug else logging.NOTSET + 1, "%s %s", q.normalized, " ".join(trace))
        return Response(q, mode, r, timer.stages, trace)

    def ask(self, text: str, mode: str | None = None, top_k: int | None = None, manual_domain: str | None = None, source_types: Sequence[str] = ()) -> tuple[DataFrame, dict]:
        """The answer's row, and how the query was routed; needs one action for the documents' domains."""
        spark = self.chunks.sparkSession
        counts = {r["domain"]: r["documents"] for r in domain.domain_counts(self.chunks).collect() if r["domain"]}  # four rows
        if not counts:
            empty = self.chunks.limit(0).withColumn("score", F.lit(0.0))
            return answer.answer(empty, text), {"domain": None, "filter_applied": False}
        route = domain.route(spark.createDataFrame([(text,)], "text string"), counts, manual=manual_domain).first().asDict()
        chosen = route["domain"] if route["filter_applied"] else None
        found = self.retrieve(text, mode, top_k, for_app(chosen, source_types))
        return answer.answer(found.results, text, route["domain"], route["filter_applied"]), route
