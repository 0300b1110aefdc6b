"""Evaluation of answers by judges: which metrics apply to a row, and what became of each.

The judge is a function of a metric's name and a payload; it runs in Arrow batches on executors.
"""

from __future__ import annotations

import os
import re
import time
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("faithfulness", "context_utilization")
WITH_REFERENCE = ("context_precision", "context_recall")
ALIASES = {"answer_relevance": "answer_relevancy", "response_relevancy": "answer_relevancy", "context_relevance": "context_utilization", "groundedness": "faithfulness"}
KNOWN = (*BASE, *WITH_REFERENCE, "answer_relevancy")


def metric_name(name: str) -> str:
    plain = re.sub(r"[\s-]+", "_", name.strip().lower())
    plain = ALIASES.get(plain, plain)
    if plain not in KNOWN:
        raise ValueError(f"unknown metric {name!r}; known are {', '.join(KNOWN)}")
    return plain


@dataclass(frozen=True)
class JudgeConfig:
    model: str
    base_url: str | None = None
    timeout: float = 180.0
    max_tokens: int | None = None
    reasoning: bool = False

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ, prefix: str = "DOCQUERY_JUDGE_") -> "JudgeConfig":
        get = lambda k: env.get(prefix + k, "").strip()
        if not get("MODEL"):
            raise ValueError(f"{prefix}MODEL isn't set")
        seconds = float(get("TIMEOUT") or 180)
        if seconds <= 0:
            raise ValueError("the timeout must be positive")
        return cls(get("MODEL"), get("BASE_URL") or None, seconds, int(get("MAX_TOKENS")) if get("MAX_TOKENS") else None, is_reasoning_model(get("MODEL")))


def is_reasoning_model(name: str) -> bool:
    return bool(re.search(r"(?i)(?:^|[/:_-])(?:o[134]|r1|qwq|qwen3|gpt-5|gpt-oss|think\w*|reason\w*)(?:[._:-]|$)", name))


Judge = Callable[[str, dict[str, Any]], float]
_RESULT = pa.list_(pa.struct([("metric", pa.string()), ("score", pa.float64()), ("error", pa.string()), ("skipped", pa.bool_()), ("seconds", pa.float64())]))


def evaluate(payloads: DataFrame, judge: Judge, metrics: Sequence[str] | None = None, timeout: float = 180.0) -> DataFrame:
    """Adds ``results``: of each metric score, or error, or skipped.

    Columns of ``payloads``: user_input, response, retrieved_contexts[, reference].  Rows without
    response or contexts have one error and no scores; metrics that need a reference are skipped
    without; a judge that fails, or takes longer than ``timeout``, leaves an error and the rest goes on.
    """
    wanted = tuple(dict.fromkeys(map(metric_name, metrics))) if metrics else None

    def of(row: dict[str, Any]) -> list[dict[str, Any]]:
        none = {"metric": None, "score": None, "error": None, "skipped": False, "seconds": None}
        if not (row["response"] or "").strip():
            return [none | {"error": "there is no response"}]
        if not any((c or "").strip() for c in row["retrieved_contexts"] or ()):
            return [none | {"error": "there are no contexts"}]
        reference = bool((row.get("reference") or "").strip())
        out = []
        for m in wanted or (*BASE, *(WITH_REFERENCE if reference else ())):
            if m in WITH_REFERENCE and not reference:
                out.append(none | {"metric": m, "skipped": True})
                continue
            began = time.monotonic()
            pool = ThreadPoolExecutor(1)
            try:
                out.append(none | {"metric": m, "score": float(pool.submit(judge, m, row).result(timeout))})
            except Late:
                out.append(none | {"metric": m, "error": f"no score within {timeout:g} s"})
            except Exception as e:  # a judge's failure is a result
                out.append(none | {"metric": m, "error": f"{type(e).__name__}: {e}"})
            pool.shutdown(wait=False)
            out[-1]["seconds"] = time.monotonic() - began
        return out

    @F.arrow_udf("array<struct<metric: string, score: double, error: string, skipped: boolean, seconds: double>>")
    def run(rows: pa.Array) -> pa.Array:
        return pa.array([of(r) for r in rows.to_pylist()], _RESULT)

    columns = [c for c in ("user_input", "response", "retrieved_contexts", "reference") if c in payloads.columns]
    return payloads.withColumn("results", run(F.struct(*columns)))
