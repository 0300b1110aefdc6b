"""Ingestion end to end: documents → domain → structure → chunks → enriched chunks → index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunk, domain, embed, index, structure

PROSE = ("text", "text_file")


def documents(loaded: DataFrame) -> DataFrame:
    """Loaded files as documents; an id is the hash of type, path and content."""
    name = F.sha2(F.concat_ws("\x1f", "source_type", "source_path", "content"), 256)
    return loaded.where("error is null and content is not null").select(name.alias("document_id"), "source_type", F.col("source_path").alias("source"), "content", "metadata")


def with_domain(docs: DataFrame) -> DataFrame:
    """domain, confidence and reason for each document, unless it has a domain already."""
    meta = F.col("metadata") if "metadata" in docs.columns else F.create_map().cast("map<string,string>")
    name = F.coalesce(F.nullif(meta["filename"], F.lit("")), index.filename(F.col("source")))
    d = domain.classify(docs, "content", F.col("source_type"), name, domain.metadata_blob(meta))
    given = meta["domain"].isNotNull()
    return d.withColumn("domain", F.coalesce(meta["domain"], "domain")).withColumn("domain_confidence", F.when(given, meta["domain_confidence"].try_cast("double")).otherwise(F.col("domain_confidence"))).withColumn("domain_reason", F.when(given, meta["domain_reason"]).otherwise(F.col("domain_reason"))).drop("domain_scores")


def run(docs: DataFrame, max_size: int = chunk.MAX_SIZE, overlap: int = chunk.OVERLAP, extract: Callable | None = None, chunker: Callable | None = None, enrich: Callable | None = None) -> DataFrame:
    """Enriched chunks of documents (document_id, source_type, source, content[, metadata]).

    Own processors are taken only if all three are given.
    """
    d = with_domain(docs)
    if extract and chunker and enrich:
        made = enrich(chunker(extract(d)))
    else:
        nodes = structure.extract(d)
        nodes = nodes.withColumn("parent", F.when(F.col("source_type").isin(*PROSE), 0).otherwise(F.col("parent")))
        made = chunk.enrich(chunk.chunk_nodes(nodes, max_size, overlap))
    return made.join(d.select("document_id", "domain", "domain_confidence", "domain_reason"), "document_id")


def indexed(chunks: DataFrame, dimension: int = embed.DIMENSION) -> DataFrame:
    """Chunks with vectors and search text, ready for a store."""
    c = index.stored(index.from_pipeline(chunks))
    return c.withColumn("embedding", embed.embedding(F.col("text"), dimension))


