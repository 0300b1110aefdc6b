"""Chunks with search text, and the inverted index over them: postings and document frequencies as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.clean import strip
from ..functions.text import lookup

#: Optional metadata of a chunk and their types; absent ones are read as null.
METADATA = {
    "document_id": "string", "source_type": "string", "file_path": "string", "filename": "string", "page_number": "int", "section": "string", "sheet_name": "string", "row_start": "int", "row_end": "int",
    "column_names": "array<string>", "json_key_path": "string", "cisco_feature": "string", "cisco_section": "string", "domain": "string", "domain_confidence": "double", "domain_reason": "string", "tags": "array<string>", "structural_path": "array<string>", "custom": "string",
}
_SEARCHED = ("filename", "source_type", "section", "sheet_name", "json_key_path", "cisco_feature", "cisco_section", "domain")


def filename(path: Column) -> Column:
    """Last part of a path or URL (a URL that ends in a slash stays whole)."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(path.contains("://"), F.when(name == "", path).otherwise(name)).otherwise(F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1))


def _filled(a: str) -> Column:
    return F.filter(F.coalesce(F.col(a), F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(x) != ""))


def metadata_text(custom: bool = True) -> Column:
    """All searchable values, joined by blanks."""
    one = F.filter(F.array(*_SEARCHED), lambda x: x.isNotNull() & (x != ""))
    values = F.concat(one, _filled("column_names"), _filled("tags"), _filled("structural_path"))
    if custom:
        values = F.concat(values, F.filter(F.coalesce(F.map_values(F.from_json("custom", "map<string,string>")), F.array().cast("array<string>")), lambda x: x.isNotNull()))
    return F.array_join(values, " ")


def stored(chunks: DataFrame) -> DataFrame:
    """Chunks (chunk_id, text, …) with every metadata column, a filename, and search_text unless it's given."""
    c = chunks
    for name, kind in METADATA.items():
        c = c.withColumn(name, F.col(name).cast(kind) if name in c.columns else F.lit(None).cast(kind))
    c = c.withColumn("filename", F.coalesce(F.nullif("filename", F.lit("")), filename(F.col("file_path"))))
    made = strip(F.concat(F.col("text"), F.lit("\n"), metadata_text()))
    c = c.withColumn("search_text", F.coalesce("search_text", made) if "search_text" in c.columns else made)
    return c.withColumn("chunk_id", F.when(F.col("chunk_id").isNotNull(), F.col("chunk_id")).otherwise(F.raise_error(F.lit("a chunk has no chunk_id")).cast("string")))


def section_of(source_type: Column, path: Column) -> Column:
    return F.when(source_type.isin("docx", "web") & (F.size(path) >= 2), path[1]).when((source_type == "text") & (F.size(path) >= 1), F.element_at(path, -1))


def from_pipeline(chunks: DataFrame) -> DataFrame:
    """Pipeline chunks under the index's column names."""
    return chunks.select(
        "chunk_id", "document_id", "source_type", F.col("content").alias("text"), F.col("source").alias("file_path"), F.col("page").alias("page_number"), section_of(F.col("source_type"), F.col("structural_path")).alias("section"), F.col("sheet").alias("sheet_name"), "row_start", "row_end",
        F.col("json_path").alias("json_key_path"), F.col("block_type").alias("cisco_feature"), F.col("block_name").alias("cisco_section"), "structural_path", *(c for c in ("domain", "domain_confidence", "domain_reason", "embedding", "tags", "column_names", "custom") if c in chunks.columns),
    )


def postings(stored: DataFrame, true_frequencies: bool = False, only: Sequence[str] | None = None) -> DataFrame:
    """(term, chunk_id, tf): tokens of the folded search text; each counts once unless true frequencies are asked for; only some terms' rows, if these are given."""
    found = text.found(lookup(F.col("search_text")))  # folded, as its text is
    if not true_frequencies:
        if only:
            found = F.array_intersect(found, F.array(*map(F.lit, only)))
        return stored.select("chunk_id", F.explode(F.array_distinct(found)).alias("term")).select("term", "chunk_id", F.lit(1).cast("long").alias("tf"))
    return stored.select("chunk_id", F.explode(found).alias("term")).groupBy("term", "chunk_id").agg(F.count("*").alias("tf"))


def document_frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))
