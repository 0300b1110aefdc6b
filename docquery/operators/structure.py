"""Structure of cleaned documents: leaf nodes in order, each with its place in the tree.

Input: (document_id, source_type, source, content).  Output: NODES; ``node`` counts leaves within the
document, ``parent`` its sections (pages, sheets, blocks, objects).  :func:`sections` gives those.
Pages, sheets and paragraphs come from splitting a row in place; only sections that depend on
preceding lines (headings, configuration blocks) need a window over the document's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import strip
from ..functions.text import is_heading, lines, paragraphs

NODES = ("document_id", "source_type", "source", "node", "parent", "node_type", "title", "content", "path", "page", "sheet", "row_index", "json_path", "block_type", "block_name")
_TYPES = {"page": "int", "row_index": "int", "node": "int", "parent": "int", "path": "array<string>"}
_KEYS = ("document_id", "source_type", "source")
_PAGE = r"(?m)^[^\S\n]*---[^\S\n]*Page[^\S\n]*(\d+)[^\S\n]*---[^\n]*$"
_SHEET = r"(?m)^[^\S\n]*---[^\S\n]*Sheet:[^\S\n]*([^\n]+?)[^\S\n]*---[^\S\n]*$"


def _shape(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*_KEYS, *(columns.get(c, F.lit(None)).cast(_TYPES.get(c, "string")).alias(c) for c in NODES[3:]))


def _numbered(prefix: str, n: Column) -> Column:
    return F.concat(F.lit(prefix), n.cast("string"))


def text_nodes(docs: DataFrame) -> DataFrame:
    p = docs.select(*_KEYS, F.posexplode(paragraphs(F.col("content"))).alias("i", "t"))
    title = _numbered("paragraph-", F.col("i") + 1)
    return _shape(p, node=F.col("i") + 1, parent=F.lit(0), node_type=F.lit("paragraph"), title=title, content=F.col("t"), path=F.array(F.lit("Document"), title))


def _marked(docs: DataFrame, marker: str) -> DataFrame:
    """(…, k, name, body): what follows each marker line, in order; what precedes the first is dropped."""
    names = F.regexp_extract_all("content", F.lit(marker), F.lit(1))
    bodies = F.split("content", marker)
    return docs.withColumn("names", names).select(*_KEYS, "content", F.posexplode(F.arrays_zip("names", F.slice(bodies, 2, F.size(bodies)).alias("bodies"))).alias("k", "z")).select(*_KEYS, "k", F.col("z.names").alias("name"), F.col("z.bodies").alias("body"))


def pdf_nodes(docs: DataFrame) -> DataFrame:
    """Paragraphs of pages; a document without page markers is its own page 1."""
    content = F.when(F.col("content").rlike(_PAGE), F.col("content")).otherwise(F.concat(F.lit("--- Page 1 ---\n"), "content"))
    b = _marked(docs.withColumn("content", content), _PAGE).select("*", F.posexplode(paragraphs(F.col("body"))).alias("i", "t"))
    page, block = _numbered("page-", F.col("name")), _numbered("block-", F.col("i") + 1)
    order = Window.partitionBy("document_id").orderBy("k", "i")
    return _shape(b, node=F.row_number().over(order), parent=F.col("k") + 1, node_type=F.lit("block"), title=block, content=F.col("t"), path=F.array(F.lit("PDF"), page, block), page=F.col("name"))


def sheet_nodes(docs: DataFrame) -> DataFrame:
    """Rows of sheets, numbered without blank ones."""
    r = _marked(docs, _SHEET).select("*", F.posexplode(lines(F.col("body"))).alias("i", "t"))
    order = Window.partitionBy("document_id").orderBy("k", "i")
    return _shape(r, node=F.row_number().over(order), parent=F.col("k") + 1, node_type=F.lit("row"), content=F.col("t"), path=F.array(F.lit("Excel"), F.col("name"), _numbered("row-", F.col("i") + 1)), sheet=F.col("name"), row_index=F.col("i") + 1)


def _headed(docs: DataFrame, root: str, first: str, heading: Column, title: Column) -> DataFrame:
    e = docs.select(*_KEYS, F.posexplode(lines(F.col("content"))).alias("i", "t")).withColumn("h", heading)
    order = Window.partitionBy("document_id").orderBy("i")
    e = e.withColumn("k", F.sum(F.col("h").cast("int")).over(order)).withColumn("name", F.coalesce(F.last(F.when(F.col("h"), title), ignorenulls=True).over(order), F.lit(first)))
    return _shape(e.where("not h"), node=F.col("i") + 1, parent=F.col("k"), node_type=F.lit("paragraph"), content=F.col("t"), path=F.array(F.lit(root), F.col("name")))


def web_nodes(docs: DataFrame) -> DataFrame:
    """Lines under headings; sections without lines are dropped."""
    return _headed(docs, "Web", "Introduction", is_heading(F.col("t")), F.col("t"))


def docx_nodes(docs: DataFrame) -> DataFrame:
    table = F.col("t").startswith("--- Table")
    return _headed(docs, "DOCX", "Document", table | is_heading(F.col("t")), F.when(table, strip(F.regexp_replace("t", "^-+|-+$", ""))).otherwise(F.col("t")))


def segments(path: Column) -> Column:
    """Parts of a dotted path, dots in brackets aside."""
    return F.filter(F.split(path, r"\.(?![^\[]*\])"), lambda s: s != "")


def json_nodes(docs: DataFrame) -> DataFrame:
    """Values of ``path: value`` lines, in depth-first order of the objects' first appearance."""
    e = docs.select(*_KEYS, F.posexplode(lines(F.col("content"))).alias("i", "t")).where(F.col("t").contains(":"))
    e = e.withColumn("p", strip(F.split_part("t", F.lit(":"), F.lit(1)))).withColumn("v", strip(F.expr("substring(t, instr(t, ':') + 1)"))).withColumn("s", segments(F.col("p"))).where(F.size("s") > 0)
    step = e.select("document_id", "i", F.explode(F.sequence(F.lit(1), F.size("s"))).alias("d"), "s").withColumn("prefix", F.slice("s", F.lit(1), F.col("d")))
    seen = step.withColumn("first", F.min("i").over(Window.partitionBy("document_id", "prefix")))
    key = seen.groupBy("document_id", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "first"))), lambda x: x["first"]).alias("firsts"))
    e = e.join(key, ["document_id", "i"]).withColumn("order", F.concat("firsts", F.array("i")))
    by = Window.partitionBy("document_id")
    return _shape(e, node=F.row_number().over(by.orderBy("order")), parent=F.dense_rank().over(by.orderBy(F.col("firsts")[0])), node_type=F.lit("value"), title=F.element_at("s", -1), content=F.concat_ws(": ", "p", "v"), path=F.concat(F.array(F.lit("JSON")), "s", F.array(F.lit("value"))), json_path=F.col("p"))


_BLOCKS = (
    ("interface", r"(?i)^interface\s+(\S+)", 1),
    ("router", r"(?i)^router\s+(.+)", 1),
    ("access-list", r"(?i)^ip\s+access-list\s+(standard|extended)\s+(\S+)", 2),
    ("class-map", r"(?i)^class-map\s+(?:match-(any|all)\s+)?(\S+)", 2),
    ("policy-map", r"(?i)^policy-map\s+(\S+)", 1),
    ("line", r"(?i)^line\s+(\S+)(?:\s+(\S+))?", 2),
)


def config_nodes(docs: DataFrame) -> DataFrame:
    """Blocks of a network configuration: lines from one block's head to the next's; marker lines end a block."""
    e = docs.select(*_KEYS, F.posexplode(lines(F.col("content"))).alias("i", "t"))
    kind, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for block, pattern, groups in reversed(_BLOCKS):
        hit = F.col("t").rlike(pattern)
        parts = [F.nullif(F.regexp_extract("t", pattern, g + 1), F.lit("")) for g in range(groups)]
        kind, name = F.when(hit, block).otherwise(kind), F.when(hit, F.concat_ws(" ", *parts)).otherwise(name)
    e = e.withColumn("marker", F.col("t").rlike(r"(?i)^---\s*Cisco Section:\s*(.+?)\s*---$")).withColumn("kind", kind).withColumn("name", name)
    order = Window.partitionBy("document_id").orderBy("i")
    loose = F.col("kind").isNull() & ~F.col("marker")
    # A line that belongs to no block begins a global one, if it's the first or follows a marker.
    e = e.withColumn("begin", F.col("kind").isNotNull() | (loose & F.coalesce(F.lag("marker").over(order), F.lit(True))))
    e = e.where("not marker").withColumn("k", F.sum(F.col("begin").cast("int")).over(order))
    b = e.groupBy(*_KEYS, "k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]), "\n").alias("body"), F.coalesce(F.min_by("kind", "i"), F.lit("global")).alias("kind"), F.coalesce(F.min_by("name", "i"), F.lit("global")).alias("name"))
    title = F.concat_ws(":", "kind", "name")
    return _shape(b, node=F.col("k"), parent=F.col("k"), node_type=F.lit("block"), title=title, content=F.col("body"), path=F.array(F.lit("Cisco"), title, _numbered("block-", F.col("k"))), block_type=F.col("kind"), block_name=F.col("name"))


def sections(nodes: DataFrame) -> DataFrame:
    """The inner nodes that leaves belong to, in order, with the number of leaves."""
    return nodes.groupBy("document_id", "parent").agg(F.min("node").alias("first_node"), F.count("*").alias("leaves"), F.slice(F.min_by("path", "node"), 1, 2).alias("path"))


EXTRACTORS = {"text": text_nodes, "text_file": text_nodes, "pdf": pdf_nodes, "url": web_nodes, "web": web_nodes, "docx": docx_nodes, "excel": sheet_nodes, "json": json_nodes, "cisco": config_nodes, "cisco_config": config_nodes}


def register(source_type: str, extractor) -> None:
    EXTRACTORS[source_type] = extractor


def extract(docs: DataFrame, source_types: list[str] | None = None) -> DataFrame:
    """Nodes of documents of all registered source types, one branch for each extractor; other types are an error."""
    known = source_types or list(EXTRACTORS)
    if unknown := set(known) - set(EXTRACTORS):
        raise ValueError(f"no extractor for {sorted(unknown)}")
    checked = docs.withColumn("source_type", F.when(F.col("source_type").isin(known), F.col("source_type")).otherwise(F.raise_error(F.concat(F.lit("no extractor for source type "), F.coalesce("source_type", F.lit("null")))).cast("string")))
    branches: dict = {}
    for t in known:
        branches.setdefault(EXTRACTORS[t], []).append(t)
    out = None
    for extractor, types in branches.items():
        nodes = extractor(checked.where(F.col("source_type").isin(types)))
        out = nodes if out is None else out.unionByName(nodes)
    return out
