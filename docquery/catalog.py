"""Queries over the test tables, one or more for each operator, each with DuckDB SQL for the same rows where SQL can express it.

DuckDB's regular expressions know ASCII classes only, so white space, letters and numbers are spelt out by
Unicode categories in the SQL; only word boundaries can't be, and texts of queries that tokenize are kept to
ASCII on both sides.  Noise that the tables lack is added to both as literals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import clean, scoring, text
from .operators import answer, chunk, domain, embed, filters, index, retrieve, structure
from .operators.query import analyse
from .plans import pipeline
from .plans.config import HybridSettings, Settings
from .session import table as t
from .sources import html, loaders, network, office

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add




def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


ASCII = r"\A[\x00-\x7F]*\z"
HEAD = "Visit https://x.example/a?b=1 or www.y.example, mail a.b+c@d-e.org: I can't, we'll; THEY'D say “so” — fine\r\nand ​on\r"
TAIL = "\x07\t two  blanks \n\n\n\n end \x0b"
_ALL = f"(SELECT *, {q(HEAD)} || text || {q(TAIL)} AS noisy FROM documents)"
_DOCS = f"(SELECT * FROM {_ALL} WHERE regexp_full_match(text, '[\\x00-\\x7F]*'))"
#: What Unicode has of white space, inside a class.
_SPACE = r"\s\x0b\x{85}\p{Z}"


def all_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").withColumn("noisy", F.concat(F.lit(HEAD), "text", F.lit(TAIL)))


def ascii_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_docs(spark, sf_dir).where(F.col("text").rlike(ASCII))


# Cleaning.
def _r(x: str, pattern: str, by: str = "''", flags: str = "g") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {by}, '{flags}')"


def _contractions(x: str) -> str:
    for a, b in clean.CONTRACTIONS:
        x = _r(x, a, q(b), "gi")
    return x


_KEEP = rf"\p{{L}}\p{{N}}_{_SPACE}" + r".,!?;:'\"\-()\[\]{}<>/@#%&+=_*|\\$"
SQL = {
    "boundaries": lambda x: f"translate({_r(x, chr(13) + chr(10) + '?', 'chr(10)')}, {q(clean._FANCY)}, {q(clean._PLAIN)})",
    "control_characters": lambda x: _r(x, r"[\x00-\x08\x0B-\x1F]"),
    "urls": lambda x: _r(x, rf"https?://[^{_SPACE}]+|www\.[^{_SPACE}]+"),
    "emails": lambda x: _r(x, r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    "contractions": _contractions,
    "lowercase": lambda x: f"lower({x})",
    "special_characters": lambda x: _r(x, f"[^{_KEEP}]"),
    "whitespace": lambda x: _r(_r(_r(_r(x, r"[\t\x0b\x0c\r\x{85}\p{Z}]+", "' '"), "(?m)^ | $"), r"\n{3,}", "chr(10) || chr(10)"), r"^\n+|\n+\z"),
    "strip": lambda x: _r(x, rf"^[{_SPACE}]+|[{_SPACE}]+\z"),
}


def _cleaning(name: str) -> None:
    step, first = getattr(clean, name), name in ("boundaries", "control_characters", "urls", "emails", "contractions", "lowercase")
    prepare = (lambda c: c) if first else (lambda c: clean.control_characters(clean.boundaries(c)))
    x = "noisy" if first else SQL["control_characters"](SQL["boundaries"]("noisy"))

    def run(spark, sf_dir):
        return all_docs(spark, sf_dir).select("doc_id", step(prepare(F.col("noisy"))).alias("cleaned"))

    QUERIES[f"clean_{name}"] = run
    ORACLES[f"clean_{name}"] = f"SELECT doc_id, {SQL[name](x)} AS cleaned FROM {_ALL}"


for _name in ("boundaries", "control_characters", "urls", "emails", "contractions", "lowercase", "special_characters", "whitespace", "strip"):
    _cleaning(_name)


@query(f"SELECT doc_id, {_r(SQL['control_characters'](SQL['boundaries']('noisy')), '[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_' + _SPACE + ']')} AS cleaned FROM {_ALL}")
def clean_special_strip(spark, sf_dir):
    c = clean.control_characters(clean.boundaries(F.col("noisy")))
    return all_docs(spark, sf_dir).select("doc_id", clean.special_characters(c, keep_punctuation=False).alias("cleaned"))


@query("SELECT doc_id, nfc_normalize(text || 'e' || chr(769) || 'u' || chr(776)) AS cleaned FROM documents")
def clean_compose(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", clean.compose(F.concat("text", F.lit("éü"))).alias("cleaned"))


def _ocr(x: str) -> str:
    """Words are runs of letters, numbers and _; those of Latin letters and digits only are repaired."""
    for a, b in clean._SPLIT_WORDS:
        x = _r(x, rf"\b{a}[{_SPACE}]+{b}\b", q(a + b), "gi")
    x = _r(x, r"\bfin1sh\b", "'finish'", "gi")
    word = f"CASE WHEN length(w) > 3 AND regexp_full_match(w, '[A-Za-zÀ-ÿ0-9]+') AND regexp_matches(w, '[01]') AND regexp_matches(w, '\\p{{L}}') THEN translate(w, '01', 'ol') ELSE w END"
    runs = r"'[\p{L}\p{N}_]+'"
    return f"list_reduce(list_concat([''], list_transform(list_zip(string_split_regex({x}, {runs}), list_concat(list_transform(regexp_extract_all({x}, {runs}), lambda w: {word}), [''])), lambda p: p[1] || p[2])), lambda a, b: a || b)"


@query(f"SELECT doc_id, {_ocr("'The shee t of c0st1y he11o, 2010s: fin1sh. ' || text")} AS cleaned FROM documents")
def clean_ocr(spark, sf_dir):
    return all_docs(spark, sf_dir).select("doc_id", clean.ocr(F.concat(F.lit("The shee t of c0st1y he11o, 2010s: fin1sh. "), "text")).alias("cleaned"))


def _limited(x: str) -> str:
    """SQL for repeated lines of (doc_id, x) from ``x``."""
    return f"""(WITH l AS (SELECT doc_id, unnest(string_split(x, chr(10))) AS line, unnest(range(0, len(string_split(x, chr(10))))) AS i FROM {x}),
    n AS (SELECT *, lower({SQL['strip']('line')}) AS name FROM l), c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, name) AS many, row_number() OVER (PARTITION BY doc_id, name ORDER BY i) AS nth FROM n)
    SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS cleaned FROM c WHERE NOT starts_with(name, 'ocr_extract') AND (length(name) < 4 OR many <= 4 OR nth = 1) GROUP BY doc_id)"""


@query("SELECT * FROM " + _limited("(SELECT doc_id, repeat('Page header ' || (doc_id % 7)::VARCHAR || chr(10), 6) || text || chr(10) || 'OCR_extract 1' AS x FROM documents)"))
def clean_repeated_lines(spark, sf_dir):
    x = F.concat(F.repeat(F.concat(F.lit("Page header "), (F.col("doc_id") % 7).cast("string"), F.lit("\n")), F.lit(6)), "text", F.lit("\nOCR_extract 1"))
    return all_docs(spark, sf_dir).select("doc_id", clean.repeated_lines(x).alias("cleaned"))


def _prose(x: str) -> str:
    for step in ("boundaries", "control_characters", "urls", "emails", "contractions", "special_characters", "whitespace", "strip"):
        x = SQL[step](x)
    return x


@query(f"SELECT doc_id, {_prose('noisy')} AS cleaned FROM {_ALL}")
def clean_prose(spark, sf_dir):
    return all_docs(spark, sf_dir).select("doc_id", clean.Cleaner.prose().clean(F.col("noisy")).alias("cleaned"))


def _ocr_prose(x: str) -> str:
    for step in ("boundaries", "control_characters"):
        x = SQL[step](x)
    x = f"nfc_normalize({x})"
    for step in ("urls", "emails", "contractions"):
        x = SQL[step](x)
    return x


@query(f"SELECT doc_id, {SQL['strip'](SQL['whitespace']('cleaned'))} AS cleaned FROM {_limited(f'(SELECT doc_id, {SQL["special_characters"](_ocr("y"))} AS x FROM (SELECT doc_id, {_ocr_prose("text")} AS y FROM documents))')}")
def clean_ocr_prose(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", clean.Cleaner.ocr_prose().clean(F.col("text")).alias("cleaned"))


_CONFIG = (
    "hostname {name}\nenable password {key}\nusername admin secret 5 x{key}\nsnmp-server community pub{key} RO\n!\ninterface Gi0/{key}\n description to {name}\n ip address 10.0.0.{key} 255.255.255.0\n!\n"
    "router bgp {key}\n neighbor 10.1.1.1\nip access-list extended ACL-{key}\n permit ip any any\nclass-map match-any CM{key}\npolicy-map PM\nline vty 0 4\n password p{key}\ninterface Gi0/{key}\n shutdown"
)


def configs(spark, sf_dir) -> DataFrame:
    parts = [c for piece in _CONFIG.replace("{name}", "\0s_name\0").replace("{key}", "\0s_suppkey\0").split("\0") for c in [F.col(piece).cast("string") if piece in ("s_name", "s_suppkey") else F.lit(piece)]]
    return t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("document_id"), F.lit("cisco").alias("source_type"), F.concat(F.lit("cfg/"), "s_name").alias("source"), F.concat(*parts).alias("content"))


_SQL_CONFIG = "(SELECT s_suppkey AS document_id, " + " || ".join("s_suppkey::VARCHAR" if p == "s_suppkey" else p if p == "s_name" else q(p) for p in _CONFIG.replace("{name}", "\0s_name\0").replace("{key}", "\0s_suppkey\0").split("\0") if p) + " AS content FROM supplier)"


def _redacted(x: str) -> str:
    for key in clean._CREDENTIALS:
        x = _r(x, rf"({key})(\S+)", r"'\1[REDACTED]'", "gi")
    return x


@query(f"SELECT document_id, {_redacted('content')} AS redacted FROM {_SQL_CONFIG}")
def redact_config(spark, sf_dir):
    return configs(spark, sf_dir).select("document_id", clean.redact(F.col("content")).alias("redacted"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'Answer ' || n_name ELSE '<think>only ' || n_name || '</think>' END AS answer FROM nation")
def think_strip(spark, sf_dir):
    x = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("<think>a\nb</THINK> Answer "), "n_name", F.lit("\n"))).otherwise(F.concat(F.lit(" <think>only "), "n_name", F.lit("</think> ")))
    return t(spark, sf_dir, "nation").select("n_nationkey", clean.without_thoughts(x).alias("answer"))


@query(f"SELECT doc_id, {_r('noisy', r'[\x00-\x08\x0B\x0C\x0E-\x1F]')} AS cleaned FROM {_ALL}")
def clean_sanitize(spark, sf_dir):
    return all_docs(spark, sf_dir).select("doc_id", clean.sanitize(F.col("noisy")).alias("cleaned"))


# Structure.
_STRIP = SQL["strip"]


def _split_sql(parts: str) -> str:
    return f"SELECT doc_id, i::INT AS i, part FROM (SELECT doc_id, unnest(p) AS part, unnest(range(0, len(p))) AS i FROM (SELECT doc_id, list_filter(list_transform({parts}, lambda x: {_STRIP('x')}), lambda x: x <> '') AS p FROM {_ALL}))"


def _exploded(spark, sf_dir, f) -> DataFrame:
    return all_docs(spark, sf_dir).select("doc_id", F.posexplode(f(F.col("noisy"))).alias("i", "part"))


@query(_split_sql("string_split(noisy, chr(10))"))
def split_lines(spark, sf_dir):
    return _exploded(spark, sf_dir, text.lines)


@query(_split_sql(r"string_split_regex(noisy, '\n[" + _SPACE + r"]*\n')"))
def split_paragraphs(spark, sf_dir):
    return _exploded(spark, sf_dir, text.paragraphs)


@query(_split_sql(f"string_split(regexp_replace({_STRIP('noisy')}, '([.!?])[{_SPACE}]+', '\\1' || chr(1), 'g'), chr(1))"))
def split_sentences(spark, sf_dir):
    return _exploded(spark, sf_dir, text.sentences)


def _heading(x: str) -> str:
    w = f"string_split_regex({x}, '[{_SPACE}]+')"
    return f"(length({x}) BETWEEN 3 AND 80 AND (ends_with({x}, ':') OR (upper({x}) = {x} AND lower({x}) <> {x}) OR (len({w}) > 1 AND len(list_filter({w}, lambda y: regexp_matches(y, '^\\p{{Lu}}'))) >= 0.6::DOUBLE * len({w}))))"


_HEADED = f"(SELECT doc_id, regexp_replace(text, '\\. ', '.' || chr(10), 'g') AS x FROM {_ALL})"
_HEADED_LINES = f"(SELECT doc_id, unnest(p) AS part, unnest(range(0, len(p))) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(x, chr(10)), lambda x: {_STRIP('x')}), lambda x: x <> '') AS p FROM {_HEADED}))"


def headed(spark, sf_dir) -> DataFrame:
    return all_docs(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.lit("web").alias("source_type"), F.col("source"), F.regexp_replace("text", r"\. ", ".\n").alias("content"))


@query(f"SELECT doc_id, i::INT AS i, part, {_heading('part')} AS heading FROM {_HEADED_LINES}")
def heading_lines(spark, sf_dir):
    return headed(spark, sf_dir).select(F.col("document_id").alias("doc_id"), F.posexplode(text.lines(F.col("content"))).alias("i", "part")).withColumn("heading", text.is_heading(F.col("part")))


@query(f"""WITH h AS (SELECT *, {_heading('part')} AS h FROM {_HEADED_LINES}), s AS (SELECT *, sum(h::INT) OVER w AS k, last_value(CASE WHEN h THEN part END IGNORE NULLS) OVER w AS title FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i))
    SELECT doc_id AS document_id, (i + 1)::INT AS node, k::INT AS parent, 'Web/' || coalesce(title, 'Introduction') AS path, part AS content FROM s WHERE NOT h""")
def sections_web(spark, sf_dir):
    return structure.web_nodes(headed(spark, sf_dir)).select("document_id", "node", "parent", F.array_join("path", "/").alias("path"), "content")


@query("SELECT doc_id, trim(array_to_string(list_slice(string_split(text, chr(10)), 2, 3), chr(10)), ' ' || chr(10)) AS content, 2 AS first_line, 3 AS last_line FROM " + _ALL)
def sliced_lines(spark, sf_dir):
    s = text.slice_lines(F.split("text", "\n"), 1, 3)
    return all_docs(spark, sf_dir).select("doc_id", s["content"].alias("content"), s["first"].alias("first_line"), s["last"].alias("last_line"))


@query(f"""WITH l AS (SELECT doc_id, unnest(p) AS part, unnest(range(0, len(p))) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(x || chr(10) || '--- Table 1 ---' || chr(10) || 'a | b' || chr(10), chr(10)), lambda x: {_STRIP('x')}), lambda x: x <> '') AS p FROM {_HEADED})),
    h AS (SELECT *, starts_with(part, '--- Table') AS tab FROM l), n AS (SELECT *, tab OR {_heading('part')} AS h FROM h),
    s AS (SELECT *, sum(h::INT) OVER w AS k, last_value(CASE WHEN tab THEN {_STRIP("regexp_replace(part, '^-+|-+$', '', 'g')")} WHEN h THEN part END IGNORE NULLS) OVER w AS title FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY i))
    SELECT doc_id AS document_id, (i + 1)::INT AS node, k::INT AS parent, 'DOCX/' || coalesce(title, 'Document') AS path, part AS content FROM s WHERE NOT h""")
def sections_docx(spark, sf_dir):
    d = headed(spark, sf_dir).withColumn("content", F.concat("content", F.lit("\n--- Table 1 ---\na | b\n")))
    return structure.docx_nodes(d).select("document_id", "node", "parent", F.array_join("path", "/").alias("path"), "content")


@query(f"""WITH p AS (SELECT doc_id, unnest(v) AS part, unnest(range(0, len(v))) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\n[{_SPACE}]*\\n'), lambda x: {_STRIP('x')}), lambda x: x <> '') AS v FROM {_ALL}))
    SELECT doc_id AS document_id, (i + 1)::INT AS node, 'Document/paragraph-' || (i + 1)::VARCHAR AS path, part AS content FROM p""")
def nodes_text(spark, sf_dir):
    d = all_docs(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.lit("text").alias("source_type"), "source", F.col("text").alias("content"))
    return structure.text_nodes(d).select("document_id", "node", F.array_join("path", "/").alias("path"), "content")


@query("""SELECT n_regionkey AS document_id, page, (row_number() OVER (PARTITION BY n_regionkey ORDER BY page))::INT AS node, 'PDF/page-' || page::VARCHAR || '/block-1' AS path, n_name AS content
    FROM (SELECT *, (2 * row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey))::INT AS page FROM nation)""")
def nodes_pdf(spark, sf_dir):
    pages = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"])
    d = t(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("document_id")).agg(F.flatten(F.transform(pages, lambda p: F.array(F.lit(""), p))).alias("pages"))
    d = d.select("document_id", F.lit("pdf").alias("source_type"), F.lit("x.pdf").alias("source"), F.concat(F.lit("dropped\n"), office.pdf_text(F.col("pages"))).alias("content"))
    return structure.pdf_nodes(d).select("document_id", "page", "node", F.array_join("path", "/").alias("path"), "content")


def sheets(spark, sf_dir) -> DataFrame:
    n = t(spark, sf_dir, "nation").join(t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", office.row_line(F.col("n_nationkey"), F.col("n_name")).alias("l")))), lambda x: x["l"])
    one = n.groupBy("r_regionkey", "r_name").agg(F.concat(F.lit("--- Sheet: "), "r_name", F.lit(" ---\n\n"), F.array_join(rows, "\n")).alias("s"))
    book = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_regionkey", "s"))), lambda x: x["s"]), "\n")
    return one.agg(book.alias("content")).select(F.lit(1).alias("document_id"), F.lit("excel").alias("source_type"), F.lit("a.xlsx").alias("source"), "content")


_SHEET_ROWS = "(SELECT r_regionkey, r_name, n_nationkey::VARCHAR || ' | ' || n_name AS line, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS i FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query(f"SELECT r_name AS sheet, i::INT AS row_index, line AS content FROM {_SHEET_ROWS}")
def nodes_sheet(spark, sf_dir):
    return structure.sheet_nodes(sheets(spark, sf_dir)).select("sheet", "row_index", "content")


@query("SELECT p_partkey, 'Key, Name, ' || p_brand AS headers FROM part")
def sheet_headers(spark, sf_dir):
    x = F.concat(F.lit("Key |  Name | key|"), "p_brand", F.lit(" ||\nrow | row"))
    return t(spark, sf_dir, "part").select("p_partkey", F.array_join(text.sheet_headers(x), ", ").alias("headers"))


@query("SELECT p_partkey, p_name || ' | ' || coalesce(CASE WHEN p_size % 2 = 0 THEN p_size END::VARCHAR || ' | ', '') || p_brand AS line, p_name || ' | ' || coalesce(CASE WHEN p_size % 2 = 0 THEN p_size END::VARCHAR, '[EMPTY]') || ' | ' || p_brand AS filled FROM part")
def sheet_rows(spark, sf_dir):
    cells = F.col("p_name"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")), F.col("p_brand")
    return t(spark, sf_dir, "part").select("p_partkey", office.row_line(*cells).alias("line"), office.row_line(*cells, empty_cells=True).alias("filled"))


@query("SELECT event_id, 'k: ' || (props->>'k') AS content FROM events")
def json_flatten(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", office.parsed(F.col("props"), office.json_text)["content"].alias("content"))


def orders_json(spark, sf_dir) -> DataFrame:
    o = t(spark, sf_dir, "orders").where("o_orderkey % 10 = 0")
    body = F.to_json(F.struct(F.struct(F.col("o_orderkey").alias("key"), F.struct(F.col("o_custkey").alias("id")).alias("customer")).alias("order"), F.array(F.struct(F.col("o_orderstatus").alias("status")), F.struct(F.col("o_orderpriority").alias("status"))).alias("log")))
    return o.select(F.col("o_orderkey").alias("document_id"), F.lit("json").alias("source_type"), F.lit("o.json").alias("source"), office.parsed(body, office.json_text)["content"].alias("content"))


@query("""SELECT o_orderkey AS document_id, n AS node, g AS parent, path, c AS content FROM (SELECT o_orderkey, unnest([1, 2, 3, 4])::INT AS n, unnest([1, 1, 2, 3])::INT AS g, unnest(['JSON/order/key/value', 'JSON/order/customer/id/value', 'JSON/log[0]/status/value', 'JSON/log[1]/status/value']) AS path,
    unnest(['order.key: ' || o_orderkey::VARCHAR, 'order.customer.id: ' || o_custkey::VARCHAR, 'log[0].status: ' || o_orderstatus, 'log[1].status: ' || o_orderpriority]) AS c FROM orders WHERE o_orderkey % 10 = 0)""")
def nodes_json(spark, sf_dir):
    return structure.json_nodes(orders_json(spark, sf_dir)).select("document_id", "node", "parent", F.array_join("path", "/").alias("path"), "content")


_SECTION_LINES = f"(SELECT document_id, unnest(v) AS line, unnest(range(0, len(v))) AS i FROM (SELECT document_id, string_split(content, chr(10)) AS v FROM {_SQL_CONFIG}))"


@query(f"""WITH l AS (SELECT *, regexp_matches(lower({_STRIP('line')}), '^({'|'.join(network.SECTIONS)})') AS b FROM {_SECTION_LINES}), k AS (SELECT *, sum(b::INT) OVER (PARTITION BY document_id ORDER BY i) AS k FROM l),
    s AS (SELECT document_id, k, coalesce(max(CASE WHEN b THEN left({_STRIP('line')}, 50) END), 'general') AS name, string_agg(line, chr(10) ORDER BY i) AS body FROM k GROUP BY document_id, k)
    SELECT document_id, name, min(k)::INT AS ord, arg_max(body, k) AS body FROM s GROUP BY document_id, name""")
def config_sections(spark, sf_dir):
    return network.sections(configs(spark, sf_dir)).select("document_id", "name", F.col("ord").cast("int").alias("ord"), "body")


@query(f"""WITH l AS (SELECT document_id, i, {_STRIP('line')} AS t FROM {_SECTION_LINES} WHERE {_STRIP('line')} <> ''),
    h AS (SELECT *, CASE WHEN regexp_matches(t, '^interface\\s+\\S+') THEN 'interface' WHEN regexp_matches(t, '^router\\s+.+') THEN 'router' WHEN regexp_matches(t, '^ip access-list') THEN 'access-list' WHEN regexp_matches(t, '^class-map') THEN 'class-map' WHEN regexp_matches(t, '^policy-map') THEN 'policy-map' WHEN regexp_matches(t, '^line ') THEN 'line' END AS kind FROM l),
    k AS (SELECT *, sum((kind IS NOT NULL OR i = 0)::INT) OVER (PARTITION BY document_id ORDER BY i) AS k FROM h)
    SELECT document_id, k::INT AS node, coalesce(arg_min(kind, i), 'global') AS block_type, string_agg(t, chr(10) ORDER BY i) AS content FROM k GROUP BY document_id, k""")
def config_blocks(spark, sf_dir):
    return structure.config_nodes(configs(spark, sf_dir)).select("document_id", "node", "block_type", "content")


@query()
def html_text(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", html.text(F.col("html"), links=True).alias("content"))


@query("""SELECT page_id, array_to_string(regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*"([^"]*)"', 1), ' ') AS links, regexp_matches(url, '(?i)^https?://[^/?#\\s]+') AS valid FROM pages""")
def html_links(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", F.array_join(html.hrefs(F.col("html")), " ").alias("links"), html.valid_url(F.col("url")).alias("valid"))


# Chunks.
@query(f"""SELECT doc_id, i::INT AS i, substr(text, (i * 900 + 1)::INT, 1000) AS chunk, count(*) OVER (PARTITION BY doc_id)::INT AS total
    FROM (SELECT doc_id, text, unnest(range(0, greatest(ceil((length(text) - 1000) / 900.0), 0)::BIGINT + 1)) AS i FROM {_ALL} WHERE text <> '')""")
def chunk_fixed(spark, sf_dir):
    parts = chunk.fixed(F.col("text"))
    return all_docs(spark, sf_dir).select("doc_id", F.size(parts).alias("total"), F.posexplode(parts).alias("i", "chunk"))


@query()
def chunk_units(spark, sf_dir):
    d = all_docs(spark, sf_dir).select("doc_id", chunk.packed(text.paragraphs(F.col("text")), 900, 120).alias("c"))
    return d.select("doc_id", F.posexplode("c").alias("i", "chunk"))


@query(f"""WITH RECURSIVE r AS (SELECT *, length(line) + 2 AS cost FROM {_SHEET_ROWS}), g AS (SELECT r_regionkey, r_name, i, line, cost AS used, 1 AS grp FROM r WHERE i = 1
    UNION ALL SELECT r.r_regionkey, r.r_name, r.i, r.line, CASE WHEN g.used + r.cost > 40 THEN r.cost ELSE g.used + r.cost END, g.grp + (g.used + r.cost > 40)::INT FROM g JOIN r ON r.r_regionkey = g.r_regionkey AND r.i = g.i + 1)
    SELECT r_name AS sheet, min(i)::INT AS row_start, max(i)::INT AS row_end, string_agg(line, chr(10) ORDER BY i) AS content FROM g GROUP BY r_name, grp""")
def chunk_rows(spark, sf_dir):
    return chunk.chunk_nodes(structure.sheet_nodes(sheets(spark, sf_dir)), 40, 0).select("sheet", "row_start", "row_end", "content")


@query("""SELECT o_orderkey AS document_id, i AS chunk_index, 3 AS total_chunks, p AS json_path, c AS content FROM (SELECT o_orderkey, unnest([1, 2, 3]) AS i, unnest(['order', 'log[0]', 'log[1]']) AS p,
    unnest(['order.key: ' || o_orderkey::VARCHAR || chr(10) || 'order.customer.id: ' || o_custkey::VARCHAR, 'log[0].status: ' || o_orderstatus, 'log[1].status: ' || o_orderpriority]) AS c FROM orders WHERE o_orderkey % 10 = 0)""")
def chunk_json(spark, sf_dir):
    return chunk.enrich(chunk.chunk_nodes(structure.json_nodes(orders_json(spark, sf_dir)))).select("document_id", "chunk_index", "total_chunks", "json_path", "content")


@query()
def pipeline_chunks(spark, sf_dir):
    d = headed(spark, sf_dir).unionByName(configs(spark, sf_dir)).withColumn("document_id", F.concat_ws("-", "source_type", "document_id"))
    return pipeline.run(d, 900, 120).select("chunk_id", "document_id", "chunk_index", "total_chunks", "content_type", F.array_join("structural_path", "/").alias("path"), "content", "domain", F.round("domain_confidence", 6).alias("confidence"))


# Tokens.
_TOKEN = q(text.TOKEN)


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, {_TOKEN}), lambda x: lower(x)))), ' ') AS tokens FROM {_DOCS}")
def tokenize(spark, sf_dir):
    return ascii_docs(spark, sf_dir).select("doc_id", F.array_join(F.sort_array(text.tokens(F.col("text"))), " ").alias("tokens"))


@query()
def technical_terms(spark, sf_dir):
    x = F.concat(F.lit("show vlan 12 on Gi1/0/24 at 10.0.0.0/24 and user.name[0].id, "), F.substring("text", 1, 300))
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(text.technical_terms(x), " | ").alias("terms"))


@query("SELECT conv_id, turn, array_to_string([left(text, 5) || 'x', 'a b'], '|') AS phrases FROM conversations WHERE regexp_full_match(text, '[A-Za-z][\\x00-\\x21\\x23-\\x26\\x28-\\x7F]*') AND NOT regexp_matches(left(text, 5), '\\s')")
def quoted_phrases(spark, sf_dir):
    c = t(spark, sf_dir, "conversations").where(F.col("text").rlike(r"\A[A-Za-z][\x00-\x21\x23-\x26\x28-\x7F]*\z") & ~F.substring("text", 1, 5).rlike(r"\s"))
    x = F.concat(F.lit('say "'), F.substring("text", 1, 5), F.lit("x\" or 'a  b' and \"A B\" "))
    return c.select("conv_id", "turn", F.array_join(text.quoted(x), "|").alias("phrases"))


# Retrieval.
QUESTION = 'the onti "of the"'
_CHUNKS = """(SELECT d.doc_id::VARCHAR AS chunk_id, d.doc_id, text, lang, ['text', 'pdf', 'json', 'excel', 'web'][(d.doc_id % 5 + 1)::INT] AS source_type, 'doc' || d.doc_id::VARCHAR || '.txt' AS filename, source,
    'doc' || d.doc_id::VARCHAR || '.txt ' || ['text', 'pdf', 'json', 'excel', 'web'][(d.doc_id % 5 + 1)::INT] || ' ' || lang || ' ' || source AS meta, embedding::DOUBLE[] AS embedding FROM documents d LEFT JOIN embeddings ON vec_id = d.doc_id WHERE regexp_full_match(text, '[\\x00-\\x7F]*') AND text <> '')"""
_FOLDED = f"(SELECT *, lower({_STRIP(_r('text || chr(10) || meta', chr(92) + 's+', q(' ')))}) AS st FROM {_CHUNKS})"


def chunks(spark, sf_dir) -> DataFrame:
    d = ascii_docs(spark, sf_dir).where("text <> ''").join(t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    kind = F.element_at(F.array(*map(F.lit, ("text", "pdf", "json", "excel", "web"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return index.stored(d.select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").cast("string").alias("document_id"), "text", "lang", "source", kind.alias("source_type"), F.concat("source", F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"), F.array("lang", "source").alias("tags"), F.col("embedding").cast("array<double>").alias("embedding")))


_POSTINGS = f"(SELECT chunk_id, unnest(list_distinct(regexp_extract_all(st, {_TOKEN}))) AS term FROM {_FOLDED})"


@query(f"SELECT term, count(*) AS df FROM {_POSTINGS} GROUP BY term")
def doc_freq(spark, sf_dir):
    return index.document_frequencies(index.postings(chunks(spark, sf_dir)))


@query(f"SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest(regexp_extract_all(st, {_TOKEN})) AS term FROM {_FOLDED}) GROUP BY ALL")
def tf_postings(spark, sf_dir):
    return index.postings(chunks(spark, sf_dir), true_frequencies=True)


def _has(c: str, term: str) -> str:
    return f"regexp_matches({c}, {q('(?:^|[^0-9A-Za-z_])' + term + '(?:[^0-9A-Za-z_]|$)')})::INT"


_BOOST = f"({_has('st', 'of the')} + {_has('st', QUESTION)}) * 2.5::DOUBLE + ({_has('lower(meta)', 'the')} + {_has('lower(meta)', 'onti')} + {_has('lower(meta)', 'of')}) * 0.8::DOUBLE"
_KEYWORD = f"""(WITH f AS MATERIALIZED (SELECT * FROM {_FOLDED}), p AS (SELECT chunk_id, unnest(list_distinct(regexp_extract_all(st, {_TOKEN}))) AS term FROM f), d AS (SELECT term, count(*) AS df FROM p WHERE term IN ('the', 'onti', 'of') GROUP BY term),
    s AS (SELECT chunk_id, sum(ln((n + 1) / (df + 1)) + 1) AS tfidf, array_to_string(list_sort(list(term)), ' ') AS terms FROM p JOIN d USING (term), (SELECT count(*) AS n FROM f) GROUP BY chunk_id)
    SELECT f.*, terms, tfidf + {_BOOST} AS score FROM s JOIN f USING (chunk_id))"""


@query(f"SELECT chunk_id, round(score, 6) AS score, terms FROM {_KEYWORD} ORDER BY round(score, 9) DESC, chunk_id LIMIT 10")
def keyword_topk(spark, sf_dir):
    r = retrieve.keyword(chunks(spark, sf_dir), analyse(QUESTION), 10)
    return r.select("chunk_id", F.round("score", 6).alias("score"), F.array_join("matched_terms", " ").alias("terms"))


@query(f"SELECT chunk_id, round(score, 6) AS score FROM {_KEYWORD} WHERE source_type IN ('pdf', 'json') AND score >= 5 ORDER BY round(score, 9) DESC, chunk_id LIMIT 20")
def keyword_filtered(spark, sf_dir):
    f = filters.FilterSpec(any_of={"source_type": ["pdf", "json"]})
    return retrieve.keyword(chunks(spark, sf_dir), analyse(QUESTION), 20, f, 5.0).select("chunk_id", F.round("score", 6).alias("score"))


def _vector(spark, sf_dir) -> list[float]:
    return [float(x) for x in t(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]]


def vectors(spark, sf_dir) -> DataFrame:
    return t(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding", "label")


_COSINE = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))"


@query(f"SELECT vec_id::VARCHAR AS chunk_id, label, round({_COSINE}, 6) AS score FROM embeddings ORDER BY {_COSINE} DESC, 1 LIMIT 10")
def vec_topk(spark, sf_dir):
    return retrieve.dense(vectors(spark, sf_dir), _vector(spark, sf_dir), 10).select("chunk_id", "label", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id::VARCHAR AS chunk_id, round({_COSINE}, 6) AS score FROM embeddings WHERE label <> 3 AND {_COSINE} >= 0.2 ORDER BY {_COSINE} DESC, 1 LIMIT 15")
def vec_threshold(spark, sf_dir):
    v = vectors(spark, sf_dir).where("label <> 3")
    return retrieve.dense(v, _vector(spark, sf_dir), 15, threshold=0.2).select("chunk_id", F.round("score", 6).alias("score"))


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE a.vec_id < 20""")
def cosine_pairs(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    a, b = e.where("vec_id < 20").select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"), "label"), e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"), "label")
    return a.join(b, "label").where("a < b").select("a", "b", F.round(scoring.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


def _norm(x: str) -> str:
    return f"CASE WHEN abs(max({x}) OVER () - min({x}) OVER ()) <= 1e-9 * greatest(abs(max({x}) OVER ()), abs(min({x}) OVER ())) THEN ({x} > 0)::INT::DOUBLE ELSE ({x} - min({x}) OVER ()) / (max({x}) OVER () - min({x}) OVER ()) END"


_POOLS = f"""dp AS (SELECT chunk_id, {_COSINE} AS s FROM {_CHUNKS} WHERE embedding IS NOT NULL ORDER BY s DESC, chunk_id LIMIT 40), kp AS (SELECT chunk_id, score AS s FROM {_KEYWORD} WHERE embedding IS NOT NULL ORDER BY round(score, 9) DESC, chunk_id LIMIT 40),
    dn AS (SELECT chunk_id, s AS dense, {_norm('s')} AS dn, row_number() OVER (ORDER BY s DESC, chunk_id) AS dr FROM dp), kn AS (SELECT chunk_id, s AS keyword, {_norm('s')} AS kn, row_number() OVER (ORDER BY round(s, 9) DESC, chunk_id) AS kr FROM kp),
    m AS (SELECT chunk_id, dense, keyword, dn, kn, dr, kr FROM dn FULL JOIN kn USING (chunk_id)),
    w(source_type, wd, wk) AS (VALUES ('text', 0.85, 0.15), ('pdf', 0.75, 0.25), ('json', 0.35, 0.65), ('excel', 0.45, 0.55), ('web', 0.72, 0.28)),
    x AS (SELECT m.*, c.source_type, 0.65::DOUBLE * wd::DOUBLE AS wd, 0.35::DOUBLE * wk::DOUBLE AS wk FROM m JOIN {_CHUNKS} c USING (chunk_id) JOIN w USING (source_type))"""


def _pools(spark, sf_dir) -> DataFrame:
    c = embedded(spark, sf_dir)
    return retrieve.fuse(retrieve.dense(c, _vector(spark, sf_dir), 40).select("chunk_id", "score"), retrieve.keyword(chunks(spark, sf_dir), analyse(QUESTION), 40, size=None).select("chunk_id", "score"))


def embedded(spark, sf_dir) -> DataFrame:
    return chunks(spark, sf_dir).where("embedding is not null")


def _hybrid(spark, sf_dir, strategy: str) -> DataFrame:
    # Frequencies are those of all chunks; only embedded ones can be retrieved.
    every, s = chunks(spark, sf_dir), Settings(hybrid=HybridSettings(fusion_strategy=strategy))
    only = embedded(spark, sf_dir)
    return retrieve.hybrid(only, analyse(QUESTION), _vector(spark, sf_dir), 10, settings=s, index=index.postings(every), size=every.count())


@query(f"WITH {_POOLS.replace(' WHERE embedding IS NOT NULL ORDER BY round', ' ORDER BY round')} SELECT chunk_id, round(dn, 6) AS dense_norm, round(kn, 6) AS keyword_norm FROM m")
def minmax_pool(spark, sf_dir):
    return _pools(spark, sf_dir).select("chunk_id", F.round("dense_norm", 6).alias("dense_norm"), F.round("keyword_norm", 6).alias("keyword_norm"))


def _top(score: str) -> str:
    return f"SELECT chunk_id, source_type, round(s, 6) AS score FROM (SELECT *, {score} AS s FROM x) ORDER BY round(s, 12) DESC, chunk_id LIMIT 10"


@query(None)
def hybrid_weighted(spark, sf_dir):
    return _hybrid(spark, sf_dir, "weighted_sum").select("chunk_id", "source_type", F.round("score", 6).alias("score"))


@query(None)
def hybrid_rrf(spark, sf_dir):
    return _hybrid(spark, sf_dir, "rrf").select("chunk_id", "source_type", F.round("score", 6).alias("score"))


# Document frequencies in the hybrid queries are of the postings' rows for all chunks.
ORACLES["hybrid_weighted"] = f"WITH {_POOLS} {_top('(coalesce(dn, 0) * wd + coalesce(kn, 0) * wk) / greatest(wd + wk, 1e-9)')}"
ORACLES["hybrid_rrf"] = f"WITH {_POOLS} {_top('(coalesce(1.0::DOUBLE / (60 + dr), 0) * wd + coalesce(1.0::DOUBLE / (60 + kr), 0) * wk) / greatest(wd + wk, 1e-9)')}"


@query(f"""WITH p(source_type, e, m) AS (VALUES ('text', 0.10, 0.15), ('pdf', 0.18, 0.25), ('json', 0.36, 0.48), ('excel', 0.32, 0.42), ('web', 0.18, 0.22)), k AS (SELECT * FROM {_KEYWORD} ORDER BY round(score, 9) DESC, chunk_id LIMIT 20),
    h AS (SELECT *, {_has('st', 'of the')} + {_has('st', QUESTION)} AS hits, {_has('lower(meta)', 'the')} + {_has('lower(meta)', 'onti')} + {_has('lower(meta)', 'of')} AS meta_hits FROM k JOIN p USING (source_type))
    SELECT chunk_id, round(score + hits * 0.7 * (1 + e::DOUBLE) + meta_hits * 0.15 * (1 + m::DOUBLE), 6) AS score, array_to_string(list_filter([CASE WHEN hits > 0 THEN 'exact_phrase' END, CASE WHEN meta_hits > 0 THEN 'metadata_match' END], lambda x: x IS NOT NULL), ' ') AS boosts FROM h""")
def rerank(spark, sf_dir):
    pool = retrieve.keyword(chunks(spark, sf_dir), analyse(QUESTION), 20)
    return retrieve.rerank(pool, analyse(QUESTION), 20).select("chunk_id", F.round("score", 6).alias("score"), F.array_join("applied_boosts", " ").alias("boosts"))


# Filters.
def _filter(name: str, table: str, spec: filters.FilterSpec, key: str, where: str, prepare: Callable[[DataFrame], DataFrame] = lambda d: d) -> None:
    QUERIES[f"filter_{name}"] = lambda spark, sf_dir: spec.apply(prepare(t(spark, sf_dir, table))).select(*key.split(", "))
    ORACLES[f"filter_{name}"] = f"SELECT {key} FROM {table} WHERE {where}"


_tags = lambda d: d.withColumn("tags", F.array("lang", "source"))
_custom = lambda d: d.withColumn("custom", F.to_json(F.struct(F.struct("lang", F.col("n_chars").alias("size")).alias("doc"))))
_S = filters.FilterSpec
_filter("equals", "documents", _S(equals={"lang": "de", "source": "src1"}), "doc_id", "lang = 'de' AND source = 'src1'")
_filter("any_of", "documents", _S(any_of={"source": ["src1", "src2"]}), "doc_id", "source IN ('src1', 'src2')")
_filter("contains", "documents", _S(contains={"source": "RC1"}), "doc_id", "contains(source, 'rc1')")
_filter("range", "lineitem", _S(numeric_ranges={"l_quantity": filters.NumericRange(gte=10, lt=20), "l_discount": filters.NumericRange(gt=0.02, lte=0.05)}), "l_orderkey, l_linenumber", "l_quantity >= 10 AND l_quantity < 20 AND l_discount > 0.02 AND l_discount <= 0.05")
_filter("tags_any", "documents", _S(tags_any=("de", "src3")), "doc_id", "lang = 'de' OR source = 'src3'", _tags)
_filter("tags_all", "documents", _S(tags_all=("en", "src3")), "doc_id", "lang = 'en' AND source = 'src3'", _tags)
_filter("custom_path", "documents", _S(equals={"custom.doc.lang": "fr"}, numeric_ranges={"custom.doc.size": filters.NumericRange(lt=2000)}), "doc_id", "lang = 'fr' AND n_chars < 2000", _custom)
_filter("missing", "documents", _S(equals={"absent": "x"}), "doc_id", "false")
_filter("empty_any_of", "documents", _S(any_of={"lang": []}), "doc_id", "false")
_filter("app", "documents", filters.for_app("legal", ["pdf", "text"]), "doc_id", "source IN ('src1', 'src2')", lambda d: d.withColumn("domain", F.lit("legal")).withColumn("source_type", F.when(F.col("source") == "src1", "pdf").when(F.col("source") == "src2", "text").otherwise("web")))

# Domains.
_KINDS = ("Whereas the agreement and governing law: this contract shall end", "Patient with blood pressure 120 mmHg.\nAssessment: plan\nchief complaint", "interface Gi0/1\n switchport mode access\nrouter bgp 1\nhostname x", "a plain note")


def domain_docs(spark, sf_dir) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("doc_id") % 4 + 1).cast("int"))
    source_type = F.element_at(F.array(*map(F.lit, ("text", "pdf", "cisco_config", "url"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return all_docs(spark, sf_dir).select("doc_id", source_type.alias("source_type"), F.concat(kind, F.lit("\n"), "text").alias("content"), F.concat("source", F.lit("_contract.txt")).alias("name"))


def _domain_sql() -> str:
    # Terms match anywhere in the folded preview.
    score = {}
    for d in domain.SPECIALISTS:
        s = domain.SIGNALS[d]
        n = lambda c, terms: " + ".join(f"contains({c}, {q(x)})::INT" for x in terms.split("|"))
        m = lambda patterns: " + ".join(f"regexp_matches(prev, {q(p.replace('(?im)', '(?ims)').replace('(?ims)', '(?im)'))})::INT" for p in patterns)
        prior = "CASE source_type " + " ".join(f"WHEN {q(k)} THEN {v[d]}" for k, v in domain.PRIORS.items() if d in v) + " ELSE 0 END"
        cap = lambda c, base, each, most: f"CASE WHEN ({c}) > 0 THEN least({most}, {base} + {each}::DOUBLE * ({c})) ELSE 0 END"
        score[d] = [f"{prior}::DOUBLE", cap(n("name", s.names), 1.10, 0.45, 2.4), cap(n("low", s.words), 0.55, 0.28, 3.2), f"1.40::DOUBLE * ({m(s.strong)})", f"least(2.4, 0.85::DOUBLE * ({m(s.layout)}))"]
    kinds, types = ", ".join(map(q, _KINDS)), "'text', 'pdf', 'cisco_config', 'url'"
    weights = ", ".join(f"[{', '.join(f'({w})::DOUBLE' for w in v)}] AS {k}_w" for k, v in score.items())
    kinds_of = "['source type', 'file name', 'content', 'document structure', 'document layout']"
    return f"""d AS (SELECT doc_id, [{types}][(doc_id % 4 + 1)::INT] AS source_type, [{kinds}][(doc_id % 4 + 1)::INT] || chr(10) || text AS content, source || '_contract.txt' AS name FROM {_ALL}),
    p AS (SELECT *, left(content, 20000) AS prev, lower({_STRIP(_r('left(content, 20000)', '[' + _SPACE + ']+', q(' ')))}) AS low FROM d),
    w AS (SELECT doc_id, {weights} FROM p),
    s AS (SELECT *, 0.25 + list_sum(legal_w) AS legal, 0.25 + list_sum(medical_w) AS medical, 0.25 + list_sum(cisco_w) AS cisco FROM w),
    o AS (SELECT *, CASE WHEN legal >= medical AND legal >= cisco THEN 'legal' WHEN medical >= cisco THEN 'medical' ELSE 'cisco' END AS top, greatest(legal, medical, cisco) AS best, 1 + legal + medical + cisco AS total, list_reverse_sort([legal, medical, cisco])[2] AS second FROM s),
    x AS (SELECT *, CASE top WHEN 'legal' THEN legal_w WHEN 'medical' THEN medical_w ELSE cisco_w END AS own FROM o),
    e AS (SELECT *, len(list_filter(own[2:], lambda v: v > 0)) AS evidence FROM x),
    k AS (SELECT *, CASE WHEN best <= 1 THEN 'baseline' WHEN best - 0.25 < 1.05 AND evidence < 2 THEN 'weak' WHEN best - second < 0.35 AND best - 0.25 < 1.80 THEN 'ambiguous' ELSE 'specialist' END AS mode FROM e),
    g AS (SELECT *, CASE mode WHEN 'specialist' THEN top ELSE 'general' END AS domain, CASE mode WHEN 'baseline' THEN greatest(1 / total, 0.58) WHEN 'weak' THEN greatest(1 / total, 0.56) WHEN 'ambiguous' THEN greatest(1 / total, 0.54) ELSE best / total END AS confidence,
        array_to_string(list_transform(list_reverse_sort(list_filter(list_transform(range(1, 6), lambda i: {{w: own[i], i: -i, t: {kinds_of}[i]}}), lambda v: v.w > 0))[1:3], lambda v: v.t || ' ' || printf('%.2f', v.w)), ', ') AS detail FROM k)"""


_DOMAINS = _domain_sql()


def _classified(spark, sf_dir) -> DataFrame:
    return domain.classify(domain_docs(spark, sf_dir), "content", F.col("source_type"), F.col("name"))


@query(f"WITH {_DOMAINS} SELECT doc_id, round(legal, 4) AS legal, round(medical, 4) AS medical, round(cisco, 4) AS cisco, CASE WHEN best <= 1 THEN 'general' ELSE top END AS best FROM g")
def domain_scores(spark, sf_dir):
    c = _classified(spark, sf_dir).select("doc_id", *(F.col(f"domain_scores.{d}").alias(d) for d in domain.SPECIALISTS))
    top = F.greatest("legal", "medical", "cisco")
    return c.withColumn("best", F.when(top <= 1, "general").when((F.col("legal") >= F.col("medical")) & (F.col("legal") >= F.col("cisco")), "legal").when(F.col("medical") >= F.col("cisco"), "medical").otherwise("cisco"))


@query(f"""WITH {_DOMAINS} SELECT doc_id, domain, round(least(1, greatest(0, confidence)), 6) AS confidence,
    CASE WHEN detail = '' THEN 'general: no specialist signal' ELSE domain || ' (' || mode || '): ' || top || printf(' %.2f of %.2f from ', best, total) || detail END AS domain_reason FROM g""")
def domain_classify(spark, sf_dir):
    return _classified(spark, sf_dir).select("doc_id", "domain", F.round("domain_confidence", 6).alias("confidence"), "domain_reason")


@query(f"WITH {_DOMAINS} SELECT domain, count(*) AS documents FROM g GROUP BY domain")
def domain_counts(spark, sf_dir):
    return domain.domain_counts(_classified(spark, sf_dir).withColumnRenamed("doc_id", "document_id"))


@query()
def route_queries(spark, sf_dir):
    return domain.route(t(spark, sf_dir, "conversations").where("role = 'user'"), {"general": 5, "legal": 2}).select("conv_id", "turn", "domain", F.round("domain_confidence", 6).alias("confidence"), "mode", "filter_applied")


# Answers and counts.
@query("""SELECT chunk_id, filename || ' • ' || CASE source_type WHEN 'pdf' THEN 'p.' || (doc_id % 9)::VARCHAR WHEN 'excel' THEN 'S • rows 1-' || (doc_id + 1)::VARCHAR WHEN 'json' THEN 'a.b' WHEN 'web' THEN 'Intro' ELSE 'chunk ' || left(chunk_id, 8) END AS label FROM """ + _CHUNKS)
def citation_label(spark, sf_dir):
    n, k = F.col("chunk_id").cast("int"), F.col("source_type")
    c = chunks(spark, sf_dir).withColumn("page_number", F.when(k == "pdf", n % 9)).withColumn("section", F.when(k == "web", "Intro")).withColumn("sheet_name", F.when(k == "excel", "S")).withColumn("row_start", F.when(k == "excel", 1)).withColumn("row_end", F.when(k == "excel", n + 1)).withColumn("json_key_path", F.when(k == "json", "a.b"))
    return c.select("chunk_id", answer.label().alias("label"))


@query()
def best_excerpt(spark, sf_dir):
    return chunks(spark, sf_dir).select("chunk_id", answer.excerpt(F.col("text"), QUESTION).alias("excerpt"))


@query()
def grounded_answer(spark, sf_dir):
    return answer.answer(retrieve.keyword(chunks(spark, sf_dir), analyse(QUESTION), 10), QUESTION)


@query()
def answer_prompt(spark, sf_dir):
    return answer.prompt(retrieve.keyword(chunks(spark, sf_dir), analyse(QUESTION), 10), QUESTION, "legal")


@query(f"SELECT source_type, count(*) AS results FROM (SELECT * FROM {_KEYWORD} ORDER BY round(score, 9) DESC, chunk_id LIMIT 50) GROUP BY source_type")
def source_counts(spark, sf_dir):
    return answer.source_counts(retrieve.keyword(chunks(spark, sf_dir), analyse(QUESTION), 50))


@query("SELECT conv_id AS document_id, count(*) AS chunk_count FROM conversations GROUP BY conv_id")
def doc_summary(spark, sf_dir):
    c = t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.lit("text").alias("source_type"), F.lit("f").alias("filename"), F.lit("general").alias("domain"))
    return answer.document_summaries(c).select("document_id", "chunk_count")


@query(f"SELECT lang AS source_type, count(*) AS documents, sum(length(text))::BIGINT AS characters, sum(len(list_filter(string_split_regex(text, '[{_SPACE}]+'), lambda w: w <> '')))::BIGINT AS tokens FROM {_ALL} GROUP BY lang")
def metadata_agg(spark, sf_dir):
    return answer.metadata_totals(all_docs(spark, sf_dir).withColumn("source_type", F.col("lang")), "text")


_MODELS = ("Llama-3-{}-instruct", "qwen-{}", "phi-{}-coder", "{}-embed", "{}")


def _ranked(name: str) -> str:
    points = " + ".join(f"CASE WHEN contains(lower({name}), {q(w)}) THEN {n} ELSE 0 END" for w, n in answer._CHAT.items())
    return f"arg_max({name}, {{p: {points}, l: -length({name}), n: {name}}})"


@query(f"SELECT n_regionkey, {_ranked('name')} AS model FROM (SELECT n_regionkey, CASE (n_nationkey + n_regionkey) % 5 {' '.join(f'WHEN {i} THEN ' + q(m).replace('{}', chr(39) + ' || n_name || ' + chr(39)) for i, m in enumerate(_MODELS))} END AS name FROM nation WHERE n_regionkey > 0) GROUP BY n_regionkey UNION ALL SELECT NULL, {_ranked('n_name')} FROM nation")
def model_fallback(spark, sf_dir):
    n = t(spark, sf_dir, "nation")
    name = F.element_at(F.array(*(F.replace(F.lit(m), F.lit("{}"), F.col("n_name")) for m in _MODELS)), ((F.col("n_nationkey") + F.col("n_regionkey")) % 5 + 1).cast("int"))
    found = [answer.fallback_model(n.where(F.col("n_regionkey") == r).select(name.alias("name"))).select(F.lit(r).cast("int").alias("n_regionkey"), "model") for r in range(1, 5)]
    out = answer.fallback_model(n, "n_name").select(F.lit(None).cast("int").alias("n_regionkey"), "model")
    for f in found:
        out = out.unionByName(f)
    return out


@query("SELECT vec_id, array_to_string(list_transform(embedding[1:8], lambda x: round(x::DOUBLE, 4)::VARCHAR), ' ') AS preview FROM embeddings ORDER BY lpad(vec_id::VARCHAR, 9, '0') LIMIT 25 OFFSET 50")
def store_page(spark, sf_dir):
    from .sources.store import FrameStore

    v = t(spark, sf_dir, "embeddings").select("vec_id", F.lpad(F.col("vec_id").cast("string"), 9, "0").alias("chunk_id"), "embedding")
    p = FrameStore(v).page(25, 50)
    return p.select("vec_id", F.array_join(F.transform("preview", lambda x: text.decimal(x.cast("double"), 4)), " ").alias("preview"))


@query("SELECT chunk_id, (row_number() OVER (ORDER BY pos) - 1)::INT AS pos FROM (SELECT unnest(['7', '3', '3', 'none', '5']) AS chunk_id, unnest([0, 1, 2, 3, 4]) AS pos) JOIN (SELECT doc_id::VARCHAR AS chunk_id FROM documents) USING (chunk_id)")
def get_chunks(spark, sf_dir):
    from .sources.store import FrameStore

    d = t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"))
    return FrameStore(d).get(["7", "3", "3", "none", "5"]).withColumn("pos", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).cast("int") - 1)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def remove_docs(spark, sf_dir):
    from .sources.store import without_documents

    d = t(spark, sf_dir, "documents").withColumnRenamed("doc_id", "document_id")
    return without_documents(d, t(spark, sf_dir, "labels").where("quality = 0").withColumnRenamed("doc_id", "document_id")).select(F.col("document_id").alias("doc_id"))


@query("""SELECT left(sha256(name || chr(10) || b), 32) || '_' || regexp_replace(name, '^.*[/\\\\]', '') AS path, CASE WHEN event_id % 9 > 0 THEN body END AS content, CASE WHEN event_id % 9 = 0 THEN 'content isn''t base64' END AS error
    FROM (SELECT *, CASE WHEN event_id % 9 = 0 THEN '*' ELSE '' END || base64(encode(body)) AS b FROM (SELECT event_id, 'up/' || event_type || '.txt' AS name, event_type || ' ' || event_id::VARCHAR AS body FROM events))""")
def upload_decode(spark, sf_dir):
    body = F.base64(F.encode(F.concat_ws(" ", "event_type", F.col("event_id").cast("string")), "utf-8"))
    e = t(spark, sf_dir, "events").select(F.concat(F.lit("up/"), "event_type", F.lit(".txt")).alias("name"), F.concat(F.when(F.col("event_id") % 9 == 0, "*").otherwise(""), body).alias("content_base64"))
    return loaders.uploads(e).select("path", F.col("content").cast("string").alias("content"), "error")


@query("SELECT doc_id, text FROM documents")
def decode_fallback(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    latin = ~F.col("text").rlike(r"[^\x00-\xFF]") & F.col("text").rlike(r"[\x{80}-\x{FF}]")
    raw = F.when(latin, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    return d.select("doc_id", loaders.decoded(raw).alias("text"))


@query("SELECT n_nationkey, lower(n_name) || '.TXT' AS filename, 'txt' AS extension, n_nationkey % 2 = 0 AS config FROM nation")
def file_routing(spark, sf_dir):
    n = t(spark, sf_dir, "nation")
    path = F.concat(F.lit("/a/b.c/"), F.lower("n_name"), F.lit(".TXT"))
    body = F.when(F.col("n_nationkey") % 2 == 0, F.lit("!\n  Router ospf 1\n")).otherwise("see the router ospf 1")
    return n.select("n_nationkey", index.filename(path).alias("filename"), loaders.extension(path).alias("extension"), domain.network_text(index.filename(path), body).alias("config"))


_RUN = "[A-Za-zÀ-ÿ]{18,}"


@query(f"""SELECT doc_id, letters >= 40 AND (regexp_matches(text, '{_RUN}') OR blanks / letters < 0.08) AS needed, CASE WHEN letters = 0 THEN 0 ELSE round((blanks - 3 * coalesce(list_sum(list_transform(regexp_extract_all(text, '{_RUN}'), lambda w: length(w) - 17)), 0)) / letters, 6) END AS readability
    FROM (SELECT doc_id, text, length({_r('text', '[^' + chr(92) + 'p{L}]')}) AS letters, length(text) - length(replace(text, ' ', '')) AS blanks FROM documents)""")
def page_readability(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", office.needs_spacing(F.col("text")).alias("needed"), F.round(office.readability(F.col("text")), 6).alias("readability"))


@query()
def hash_embed(spark, sf_dir):
    v = t(spark, sf_dir, "documents").select("doc_id", embed.embedding(F.col("text"), 64).alias("v"))
    return v.select("doc_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm"), F.round(F.element_at("v", 1), 6).alias("first"))


@query()
def chunk_index(spark, sf_dir):
    d = headed(spark, sf_dir).withColumn("document_id", F.col("document_id").cast("string"))
    c = pipeline.indexed(pipeline.run(d, 900, 120), 64)
    return c.select("chunk_id", "document_id", "filename", "section", "search_text", F.round(F.element_at("embedding", 1), 6).alias("first"))
