"""Loaders by name: paths in, (source_type, source_path, content, metadata, error, loaded_at) out."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import Cleaner, redact
from ..operators.domain import network_text
from ..operators.index import filename
from . import html, network, office, pdf


class Loader(Protocol):
    source_type: str
    extensions: Sequence[str]

    def load(self, spark: SparkSession, paths: str | Sequence[str]) -> DataFrame: ...


def decoded(content: Column) -> Column:
    """Bytes as UTF-8, or as Latin-1 where they aren't valid UTF-8."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.decode(content, "ISO-8859-1"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def has_extension(path: Column, allowed: Iterable[str]) -> Column:
    return extension(path).isin([a.lower().lstrip(".") for a in allowed])


def _of_kind(rows: DataFrame, allowed: Iterable[str]) -> DataFrame:
    return rows.where(has_extension(F.col("path"), allowed)).select("path", F.length("content").cast("long").alias("length"), "content")


def files(spark: SparkSession, paths: str | Sequence[str], allowed: Iterable[str]) -> DataFrame:
    """(path, length, content) of files with these extensions."""
    globs = ",".join("*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in a.lstrip(".")) for a in allowed)
    return spark.read.format("binaryFile").option("pathGlobFilter", f"{{{globs}}}").option("recursiveFileLookup", "true").load(paths).select("path", "length", "content")


def _row(df: DataFrame, source_type: str | Column, content: Column, metadata: Column | None = None, error: Column | None = None, path: str = "path") -> DataFrame:
    kind = F.lit(source_type) if isinstance(source_type, str) else source_type
    return df.select(kind.alias("source_type"), F.col(path).alias("source_path"), content.alias("content"), (F.create_map().cast("map<string,string>") if metadata is None else metadata).alias("metadata"), (F.lit(None).cast("string") if error is None else error).alias("error"), F.current_timestamp().alias("loaded_at"))


class TextLoader:
    source_type, extensions = "text_file", ("txt",)

    def __init__(self, cleaner: Cleaner = Cleaner.ocr_prose(), encoding: str | None = None):
        self.cleaner, self.encoding = cleaner, encoding

    def load(self, spark, paths):
        return self.of_files(files(spark, paths, self.extensions))

    def of_files(self, f: DataFrame) -> DataFrame:
        """From (path, length, content)."""
        text = F.decode("content", self.encoding) if self.encoding else decoded(F.col("content"))
        return _row(f, self.source_type, self.cleaner.clean(text), F.create_map(F.lit("file_size"), F.col("length").cast("string")))


class ParsedLoader:
    """Files that a function of their bytes reads."""

    def __init__(self, source_type: str, extensions: Sequence[str], parse: Callable, cleaner: Cleaner = Cleaner.structured(), text: bool = False):
        self.source_type, self.extensions, self.parse, self.cleaner, self.text = source_type, extensions, parse, cleaner, text

    def load(self, spark, paths):
        return self.of_files(files(spark, paths, self.extensions))

    def of_files(self, f: DataFrame) -> DataFrame:
        """From (path, length, content)."""
        r = f.withColumn("r", office.parsed(decoded(F.col("content")) if self.text else F.col("content"), self.parse))
        return _row(r, self.source_type, self.cleaner.clean(F.col("r.content")), F.col("r.metadata"), F.col("r.error"))


class ConfigLoader:
    source_type, extensions = "cisco_config", ("txt", "conf", "cfg", "config")

    def __init__(self, organize: bool = True, redact_sensitive: bool = True, strict: bool = False, cleaner: Cleaner = Cleaner.network()):
        self.organize, self.redact, self.strict, self.cleaner = organize, redact_sensitive, strict, cleaner

    def load(self, spark, paths):
        return self.of(files(spark, paths, self.extensions).select("path", decoded(F.col("content")).alias("text")))

    def of(self, texts: DataFrame) -> DataFrame:
        """From (path, text)."""
        t = texts.withColumn("text", redact(F.col("text"), self.strict) if self.redact else F.col("text"))
        if self.organize:
            s = network.sections(t, "path", "text")
            t = network.marked(s, "path").withColumnRenamed("content", "text").join(s.groupBy("path").agg(F.count("*").alias("n")), "path")
        else:
            t = t.withColumn("n", F.lit(0))
        lines = F.size(F.split("text", "\n")).cast("string")
        return _row(t, self.source_type, self.cleaner.clean(F.col("text")), F.create_map(F.lit("section_count"), F.col("n").cast("string"), F.lit("line_count"), lines))


class WebLoader:
    """Pages given as (url, html); fetching is a function that the caller brings."""

    source_type, extensions = "url", ()

    def __init__(self, fetch: Callable[[Sequence[str]], Sequence[str]] | None = None, links: bool = False, cleaner: Cleaner = Cleaner.prose()):
        self.fetch, self.links, self.cleaner = fetch, links, cleaner

    def of(self, pages: DataFrame) -> DataFrame:
        ok = html.valid_url(F.col("url"))
        return _row(pages, self.source_type, F.when(ok, self.cleaner.clean(html.text(F.col("html"), self.links))), error=F.when(~ok, F.lit("not an http(s) URL")), path="url")

    def load(self, spark, paths):
        if self.fetch is None:
            raise ValueError("a web loader needs a function that fetches")
        fetch = self.fetch
        urls = spark.createDataFrame([(u,) for u in ([paths] if isinstance(paths, str) else paths)], "url string")
        import pyarrow as pa

        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(fetch(b.column(0).to_pylist())), pa.string())], ["url", "html"])

        return self.of(urls.mapInArrow(run, "url string, html string"))


LOADERS: dict[str, Loader] = {
    "text": TextLoader(),
    "web": WebLoader(),
    "docx": ParsedLoader("docx", ("docx",), office.docx, Cleaner.prose()),
    "excel": ParsedLoader("excel", ("xlsx", "xls"), office.xlsx),
    "json": ParsedLoader("json", ("json",), office.json_text, text=True),
    "pdf": ParsedLoader("pdf", ("pdf",), office.pdf_with(pdf.extract), Cleaner.prose()),
    "cisco": ConfigLoader(),
}


def register(name: str, loader: Loader) -> None:
    LOADERS[name.lower()] = loader


def get_loader(name: str) -> Loader | None:
    return LOADERS.get(name.lower())


def list_loaders() -> list[str]:
    return list(LOADERS)


KINDS = ("docx", "excel", "json", "pdf")
PLAIN = ("txt", "conf", "cfg", "config")


def load(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Files of all kinds, each by its extension's loader; text files that look like configurations go to theirs."""
    return _routed(lambda allowed: files(spark, paths, allowed))


def load_uploads(df: DataFrame) -> DataFrame:
    """Uploads (name, content_base64) of all kinds as :func:`load` gives files; a bad one leaves its error, and the others go on."""
    u = uploads(df)
    known = has_extension(F.col("path"), [x for n in KINDS for x in LOADERS[n].extensions] + [*PLAIN])
    bad = u.withColumn("error", F.coalesce("error", F.when(~known, F.lit("unsupported file type")))).where("error is not null")
    good = u.where("error is null").select("path", "content")
    return _routed(lambda allowed: _of_kind(good, allowed)).unionByName(_row(bad, "upload", F.lit(None).cast("string"), error=F.col("error")))


def _routed(of: Callable[[Iterable[str]], DataFrame]) -> DataFrame:
    parts = [LOADERS[n].of_files(of(LOADERS[n].extensions)) for n in KINDS]
    texts = of(PLAIN).select("path", "length", decoded(F.col("content")).alias("text"))
    config = (extension(F.col("path")) != "txt") | network_text(filename(F.col("path")), F.col("text"))
    prose = texts.where(~config)
    parts.append(_row(prose, "text_file", LOADERS["text"].cleaner.clean(F.col("text")), F.create_map(F.lit("file_size"), F.col("length").cast("string"))))
    parts.append(LOADERS["cisco"].of(texts.where(config).select("path", "text")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def upload_name(upload_id: Column, name: Column) -> Column:
    return F.concat_ws("_", upload_id, F.regexp_replace(name, r"^.*[/\\]", ""))


def uploads(df: DataFrame) -> DataFrame:
    """(name, content_base64) as (path, content, error), ids by hash; a bad row leaves its error."""
    raw = F.try_to_binary("content_base64", F.lit("base64"))
    return df.select(upload_name(F.substring(F.sha2(F.concat_ws("\n", "name", "content_base64"), 256), 1, 32), F.col("name")).alias("path"), raw.alias("content"), F.when(F.coalesce(F.trim("name"), F.lit("")) == "", "no name").when(raw.isNull(), "content isn't base64").alias("error"))
