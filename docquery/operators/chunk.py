"""Chunks: greedy packing of units with overlap, per source type, and their enrichment.

Packing keeps state from unit to unit, so it runs in Arrow batches over arrays of units; grouping
the units is Spark's.  Chunk ids are hashes of document and index, so a rerun gives the same ids.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_SIZE, OVERLAP = 1000, 100
_KEYS = ("document_id", "source_type", "source")


def fixed(text: Column, size: int = MAX_SIZE, overlap: int = OVERLAP) -> Column:
    """Array of windows of ``size`` characters, each ``size - overlap`` on from the last; the one that reaches the end is the last."""
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("size must be positive and overlap in [0, size)")
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text) - size) / step), F.lit(0)).cast("int")
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def _trimmed(text: str, most: int) -> str:
    tail = text[-most:].strip()
    cut = tail.find(" ")
    return tail[cut + 1 :].strip() if cut > 0 else tail


def _tail(chunk: str, most: int, delimiter: str) -> str:
    """What the next chunk repeats of this one: all if it fits, else its last units, else its last words."""
    if len(chunk) <= most:
        return chunk
    units = [u for u in map(str.strip, chunk.split(delimiter)) if u]
    if len(units) < 2:
        return _trimmed(chunk, most)
    if len(units[-1]) > most:
        return _trimmed(units[-1], most)
    n, size = 1, len(units[-1])
    while n < len(units) and size + len(delimiter) + len(units[-n - 1]) <= most:
        size += len(delimiter) + len(units[-n - 1])
        n += 1
    return delimiter.join(units[-n:]).strip()


def pack(units: list[str], max_size: int, overlap: int, delimiter: str = "\n\n", split: bool = True) -> list[str]:
    """Units joined greedily; a longer unit is cut into sentences and these into slices, apart from its neighbours."""
    groups: list[list[str]] = []
    run: list[str] = []
    size = 0

    def put(piece: str) -> None:
        nonlocal run, size
        cost = len(piece) + len(delimiter)
        if run and size + cost > max_size:
            close()
        run.append(piece)
        size += cost

    def close() -> None:
        nonlocal run, size
        groups.append(run)
        run, size = [], 0

    for unit in filter(None, units):
        if split and len(unit) > max_size:
            close()
            for sentence in filter(None, map(str.strip, re.split(r"(?<=[.!?])\s+", unit.strip()))):
                for i in range(0, len(sentence), max_size):
                    put(sentence[i : i + max_size])
            close()
        else:
            put(unit)
    close()
    base = [c for c in (delimiter.join(g).strip() for g in groups) if c]
    if overlap <= 0:
        return base
    return base[:1] + [f"{_tail(before, overlap, delimiter)}{delimiter}{c}".strip() for before, c in zip(base, base[1:])]


def packed(units: Column, max_size: int = MAX_SIZE, overlap: int = OVERLAP, delimiter: str = "\n\n", split: bool = True) -> Column:
    """:func:`pack` over a column of arrays."""

    @F.arrow_udf("array<string>")
    def run(a: pa.Array) -> pa.Array:
        return pa.array([None if u is None else pack(u, max_size, overlap, delimiter, split) for u in a.to_pylist()], pa.list_(pa.string()))

    return run(units)


def _row_groups(rows: Column, max_size: int) -> Column:
    """Of (row_index, content) structs: chunks of whole rows with their first and last index."""

    @F.arrow_udf("array<struct<content: string, row_start: int, row_end: int>>")
    def run(a: pa.Array) -> pa.Array:
        out = []
        for sheet in a.to_pylist():
            found, run, size = [], [], 0
            for r in sheet or []:
                if run and size + len(r["content"]) + 2 > max_size:
                    found.append(run)
                    run, size = [], 0
                run.append(r)
                size += len(r["content"]) + 2
            out.append([{"content": "\n".join(x["content"] for x in g), "row_start": g[0]["row_index"], "row_end": g[-1]["row_index"]} for g in [*found, run] if g])
        return pa.array(out, pa.list_(pa.struct([("content", pa.string()), ("row_start", pa.int32()), ("row_end", pa.int32())])))

    return run(rows)


_KIND = {"text": "text", "text_file": "text", "url": "section", "web": "section", "docx": "section", "pdf": "page", "excel": "row", "json": "json_object", "cisco": "cisco_block", "cisco_config": "cisco_block"}


def chunk_nodes(nodes: DataFrame, max_size: int = MAX_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of structure nodes: per document, section, page, sheet, object or block, as the source type has it."""
    kind = F.element_at(F.create_map(*(F.lit(x) for pair in _KIND.items() for x in pair)), F.col("source_type"))
    n = nodes.withColumn("content_type", F.coalesce(kind, F.lit("text")))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("node", c))), lambda x: x[c])
    g = n.groupBy(*_KEYS, "content_type", "parent").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("node", "row_index", "content"))), lambda x: F.struct(x["row_index"].alias("row_index"), x["content"].alias("content"))).alias("rows"),
        ordered("content").alias("units"),
        F.min_by("path", "node").alias("path"),
        *(F.min_by(c, "node").alias(c) for c in ("page", "sheet", "json_path", "block_type", "block_name")),
    )
    line = F.col("content_type").isin("json_object", "cisco_block")
    block_lines = F.filter(F.transform(F.split(F.element_at("units", 1), "\n"), F.trim), lambda x: x != "")
    # Each kind's units go to its own packing; the others see null.
    para = packed(F.when(~line & (F.col("content_type") != "row"), F.col("units")), max_size, overlap)
    objects = packed(F.when(F.col("content_type") == "json_object", F.col("units")), max_size, overlap, "\n", False)
    blocks = packed(F.when(F.col("content_type") == "cisco_block", block_lines), max_size, overlap, "\n")
    plain = F.transform(F.coalesce(para, objects, blocks, F.array().cast("array<string>")), lambda t: F.struct(t.alias("content"), F.lit(None).cast("int").alias("row_start"), F.lit(None).cast("int").alias("row_end")))
    rows = _row_groups(F.when(F.col("content_type") == "row", F.col("rows")), max_size)
    made = g.select(*_KEYS, "content_type", "parent", "path", "page", "sheet", "json_path", "block_type", "block_name", F.posexplode(F.when(F.col("content_type") == "row", rows).otherwise(plain)).alias("i", "c"))
    depth = F.when(F.col("content_type") == "text", 1).otherwise(2)
    path = F.when(F.col("content_type") == "cisco_block", F.col("path")).otherwise(F.slice("path", F.lit(1), depth))
    json_path = F.when(F.col("content_type") == "json_object", F.element_at("path", 2))
    return made.select(*_KEYS, "parent", "i", F.col("c.content").alias("content"), "content_type", path.alias("structural_path"), "page", "sheet", F.col("c.row_start").alias("row_start"), F.col("c.row_end").alias("row_end"), json_path.alias("json_path"), "block_type", "block_name")


def chunk_text_nodes(nodes: DataFrame, max_size: int = MAX_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Prose is packed over the whole document, whatever its paragraphs."""
    return chunk_nodes(nodes.withColumn("parent", F.lit(0)), max_size, overlap)


def enrich(chunks: DataFrame) -> DataFrame:
    """chunk_index (from 1), total_chunks and chunk_id."""
    by = Window.partitionBy("document_id")
    c = chunks.withColumn("chunk_index", F.row_number().over(by.orderBy("parent", "i"))).withColumn("total_chunks", F.count("*").over(by).cast("int"))
    return c.drop("parent", "i").withColumn("chunk_id", F.sha2(F.concat_ws("\x1f", "document_id", F.col("chunk_index").cast("string")), 256))
