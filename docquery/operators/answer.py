"""Answers composed of retrieved passages, their citations, and counts over results."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import strip, without_thoughts
from ..functions.text import contains_term, lookup, q_normal, q_tokens
from .domain import PROMPTS

CITATIONS, EXCERPT, FALLBACK = 4, 240, 220


def label() -> Column:
    """Where a passage is from: file, then page, section, sheet and rows, path, block, or chunk."""
    has = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    rows = F.when((F.col("row_start") > 0) & (F.col("row_end") > 0), F.concat(F.lit(" • rows "), F.col("row_start").cast("string"), F.lit("-"), F.col("row_end").cast("string"))).otherwise("")
    place = (
        F.when(F.col("page_number").isNotNull(), F.concat(F.lit("p."), F.col("page_number").cast("string")))
        .when(has("section"), F.col("section"))
        .when(has("sheet_name"), F.concat(F.col("sheet_name"), rows))
        .when(has("json_key_path"), F.col("json_key_path"))
        .when(has("cisco_section"), F.concat_ws(" ", F.when(has("cisco_feature"), F.col("cisco_feature")).otherwise("cisco"), "cisco_section"))
        .otherwise(F.concat(F.lit("chunk "), F.substring("chunk_id", 1, 8)))
    )
    return F.concat_ws(" • ", F.coalesce(F.nullif("filename", F.lit("")), F.lit("unknown")), place)


def excerpt(text: Column, query: str) -> Column:
    """The line or sentence with most of the query's terms (2 each, 3 for the whole query), the longest of equals."""
    whole = q_normal(query)
    parts = F.filter(F.transform(F.split(text, r"(?U)\n+|(?<=[.!?])\s+"), strip), lambda p: p != "")
    points = lambda p: sum((contains_term(p, t).cast("int") * 2 for t in q_tokens(whole, 2)), contains_term(p, whole).cast("int") * 3)
    folded = F.transform(parts, lambda p: F.struct(p.alias("p"), lookup(p).alias("l")))
    scored = F.transform(folded, lambda x, i: F.struct(points(x["l"]).alias("s"), F.length(x["p"]).alias("n"), (-i).alias("i"), x["p"].alias("p")))
    best = F.array_max(scored)["p"]  # null without parts
    return strip(F.coalesce(F.substring(best, 1, EXCERPT), F.substring(text, 1, FALLBACK)))


def citations(results: DataFrame, query: str) -> DataFrame:
    """The best results with rank, label and excerpt."""
    ranked = results.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")))  # results are a top-k already
    return ranked.where(F.col("rank") <= CITATIONS).select("rank", "chunk_id", label().alias("label"), "source_type", "score", excerpt(F.col("text"), query).alias("excerpt"))


def answer(results: DataFrame, query: str, domain: str | None = None, filtered: bool = False) -> DataFrame:
    """One row: content, result_count."""
    where = f"the {domain} documents" if domain and filtered else "documents that lean to " + domain if domain else "the documents"
    c = citations(results, query)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("- "), "excerpt", F.lit(" ["), "label", F.lit("]")).alias("line")))), lambda x: x["line"])
    found = F.concat(F.lit(f"Best passages in {where}:\n\n"), F.array_join(lines, "\n"))
    nothing = f"Nothing in {where} answers this. A wider query, another mode or more files may help."
    counted = results.agg(F.count("*").alias("result_count"))
    return c.agg(F.when(F.count("*") > 0, found).otherwise(F.lit(nothing)).alias("content")).crossJoin(counted)


def prompt(results: DataFrame, query: str, domain: str | None = None) -> DataFrame:
    """One row: the prompt for a language model, passages numbered with their labels."""
    about, style = PROMPTS.get(domain or "general", PROMPTS["general"])
    ranked = results.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id"))).where(F.col("rank") <= CITATIONS)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), label(), F.lit("\n"), "text").alias("p")))), lambda x: x["p"])
    head = f"{about} {style} Answer from the passages alone and cite them by number.\n\nQuestion: {q_normal(query)}\n\n"
    return ranked.agg(F.concat(F.lit(head), F.array_join(parts, "\n\n")).alias("prompt"))


def generate(prompts: DataFrame, complete: Callable[[Sequence[str]], Sequence[str]]) -> DataFrame:
    """``prompts`` with ``answer``: ``complete`` is called with a batch of prompts, on executors; thoughts are taken out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(complete(b.column(0).to_pylist())), pa.string())], ["prompt", "answer"])

    return prompts.select("prompt").mapInArrow(run, "prompt string, answer string").withColumn("answer", without_thoughts(F.col("answer")))


def source_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("source_type").agg(F.count("*").alias("results"))


def document_summaries(chunks: DataFrame) -> DataFrame:
    """A row for each document, the latest first if there's an added_at."""
    also = [F.max("added_at").alias("added_at")] if "added_at" in chunks.columns else []
    s = chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"), F.first("source_type").alias("source_type"), F.first("filename").alias("filename"), F.first("domain").alias("domain"), *also)
    return s.orderBy(F.desc("added_at"), "document_id") if also else s.orderBy("document_id")


def metadata_totals(docs: DataFrame, content: str = "content") -> DataFrame:
    """Documents, characters and estimated tokens (words) by source type."""
    words = F.size(F.filter(F.split(F.col(content), r"(?U)\s+"), lambda w: w != ""))
    return docs.groupBy("source_type").agg(F.count("*").alias("documents"), F.sum(F.length(content)).alias("characters"), F.sum(words).alias("tokens"))


_CHAT = {"llama": 50, "qwen": 45, "phi": 40, "coder": 10, "instruct": 5}
_EMBED = {"qwen": 40, "phi": 35, "llama": 30, "coder": 5}
_EMBED_NAMES = ("arctic", "bge", "e5", "embed", "mxbai", "nomic", "snowflake")


def model_rank(name: Column, embedding: bool = False) -> Column:
    """Struct to take the greatest of: points by name, the shorter name, the later one."""
    low = F.lower(name)
    points = sum((F.when(low.contains(t), n).otherwise(0) for t, n in (_EMBED if embedding else _CHAT).items()), F.lit(0))
    if embedding:
        points = points + F.when(F.greatest(*(low.contains(t) for t in _EMBED_NAMES)), 100).otherwise(0)
    return F.struct(points.alias("points"), (-F.length(name)).alias("shortness"), name.alias("name"))


def fallback_model(models: DataFrame, name: str = "name", embedding: bool = False) -> DataFrame:
    return models.agg(F.max(model_rank(F.col(name), embedding))["name"].alias("model"))
