"""A store of chunks as a Parquet table: replace, append, remove, read, page and search."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.embed import checked_dimension
from ..operators.filters import FilterSpec
from ..operators.retrieve import dense


class Store(Protocol):
    def chunks(self) -> DataFrame: ...


class FrameStore:
    """Chunks of a DataFrame."""

    def __init__(self, chunks: DataFrame):
        self._chunks = chunks

    def chunks(self) -> DataFrame:
        return self._chunks

    def search(self, embedding: Sequence[float], top_k: int = 10, filters: FilterSpec = FilterSpec()) -> DataFrame:
        return dense(self.chunks(), embedding, top_k, filters)

    def get(self, ids: Sequence[str]) -> DataFrame:
        """The chunks in the order of ids; missing ones are left out."""
        wanted = self.chunks().sparkSession.createDataFrame([(list(ids),)], "ids array<string>").select(F.posexplode("ids").alias("pos", "chunk_id"))
        return self.chunks().join(wanted, "chunk_id").orderBy("pos").drop("pos")

    def page(self, limit: int = 25, offset: int = 0, preview: int = 8) -> DataFrame:
        """Rows by chunk_id with the first places of their vectors."""
        return self.chunks().orderBy("chunk_id").offset(offset).limit(limit).withColumn("preview", F.slice("embedding", 1, preview))

    def dimension(self) -> int:
        return checked_dimension(self.chunks()).first()["dimension"]


class TableStore(FrameStore):
    """Chunks in a folder.  Each replacement is a new version beside the old, which stays readable until it's dropped."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        done = [s.getPath() for s in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName().removeprefix("v")) for p in done)

    def chunks(self) -> DataFrame:
        versions = self._versions()
        if not versions:
            raise ValueError(f"the store {self.path} is empty")
        return self.spark.read.parquet(f"{self.path}/v{versions[-1]}")

    def replace(self, chunks: DataFrame) -> None:
        n = (self._versions() or [0])[-1] + 1
        chunks.write.parquet(f"{self.path}/v{n}")

    def append(self, chunks: DataFrame) -> None:
        """Add chunks; ids that are there already keep their old row, so a repeated batch adds nothing."""
        versions = self._versions()
        if not versions:
            return self.replace(chunks.dropDuplicates(["chunk_id"]))
        new = chunks.dropDuplicates(["chunk_id"]).join(self.chunks().select("chunk_id"), "chunk_id", "left_anti")
        new.write.mode("append").parquet(f"{self.path}/v{versions[-1]}")

    def remove_documents(self, document_ids: DataFrame) -> None:
        self.replace(without_documents(self.chunks(), document_ids))

    def reindex(self, embedded: DataFrame) -> None:
        """New vectors (chunk_id, embedding) for the same chunks."""
        self.replace(self.chunks().drop("embedding").join(embedded.select("chunk_id", "embedding"), "chunk_id"))

    def clear(self) -> None:
        self.replace(self.chunks().where(F.lit(False)))

    def drop_old(self) -> None:
        jvm = self.spark.sparkContext._jvm
        for n in self._versions()[:-1]:
            p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{n}")
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def without_documents(chunks: DataFrame, document_ids: DataFrame) -> DataFrame:
    return chunks.join(document_ids.select("document_id"), "document_id", "left_anti")


def latest(versions: DataFrame, key: str, at: str) -> DataFrame:
    """Of several rows with a key the last one."""
    return versions.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at)))).where("_n = 1").drop("_n")
