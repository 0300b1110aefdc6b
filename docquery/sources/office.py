"""Word-processor files and spreadsheets (zipped XML), JSON, and page texts, as marked plain text."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator, Sequence
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _words(p: ElementTree.Element) -> str:
    parts = {f"{_W}t": lambda e: e.text or "", f"{_W}tab": lambda e: "\t", f"{_W}br": lambda e: "\n"}
    return "".join(parts[e.tag](e) for e in p.iter() if e.tag in parts)


def docx(data: bytes, tables: bool = True) -> tuple[str, dict[str, str]]:
    """Paragraphs, then tables with a marker line each and cells between bars."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    own = [_words(p) for p in body.findall(f"{_W}p")]
    found = body.findall(f"{_W}tbl")
    parts = [p for p in own if p.strip()]
    for i, t in enumerate(found if tables else (), 1):
        rows = [" | ".join("\n".join(_words(p) for p in c.findall(f"{_W}p")) for c in r.findall(f"{_W}tc")) for r in t.findall(f"{_W}tr")]
        parts.append(f"\n--- Table {i} ---\n" + "".join(r + "\n" for r in rows))
    return "\n".join(parts), {"paragraph_count": str(len(own)), "table_count": str(len(found))}


def _cells(row: ElementTree.Element, shared: list[str]) -> Iterator[str | None]:
    at = 0
    for c in row.findall(f"{_S}c"):
        if ref := re.match(r"[A-Z]+", c.get("r", "")):
            column = 0
            for letter in ref.group():
                column = column * 26 + ord(letter) - 64
            while at < column - 1:
                at += 1
                yield None
        at += 1
        v = c.find(f"{_S}v")
        if (f := c.find(f"{_S}f")) is not None and f.text:
            yield "=" + f.text
        elif c.get("t") == "inlineStr":
            yield "".join(t.text or "" for t in c.iter(f"{_S}t"))
        elif v is None or v.text is None:
            yield None
        elif c.get("t") == "s":
            yield shared[int(v.text)]
        elif c.get("t") == "b":
            yield str(v.text == "1")
        else:
            yield v.text


def xlsx(data: bytes, empty_cells: bool = False, names: Sequence[str] | None = None) -> tuple[str, dict[str, str]]:
    """Sheets with a marker line each and a line for each row, cells between bars; formulas aren't computed."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        files = set(z.namelist())
        shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in files else []
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = {s.get("name"): targets[s.get(_R)] for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet")}
        parts = []
        for name in names or sheets:
            if name not in sheets:
                continue
            parts.append(f"--- Sheet: {name} ---")
            target = sheets[name].lstrip("/")
            for row in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_S}row"):
                shown = [c.strip() if c is not None else "[EMPTY]" for c in _cells(row, shared) if c is not None or empty_cells]
                if shown:
                    parts.append(" | ".join(shown))
    return "\n".join(parts), {"sheet_count": str(len(sheets)), "sheets": json.dumps(list(sheets))}


def flatten(value: object, key: str = "") -> Iterator[tuple[str, object]]:
    """(a.b[0].c, leaf) pairs; empty containers have none."""
    items = ((f"{key}.{k}" if key else k, v) for k, v in value.items()) if isinstance(value, dict) else ((f"{key}[{i}]", v) for i, v in enumerate(value))
    for k, v in items:
        if isinstance(v, (dict, list)):
            yield from flatten(v, k)
        else:
            yield k, v


def json_text(text: str, flat: bool = True) -> tuple[str, dict[str, str]]:
    """A line ``path: value`` for each value that isn't null; a later equal path replaces an earlier one's value."""
    value = json.loads(text)
    if not isinstance(value, (dict, list)) or not flat and not isinstance(value, dict):
        raise ValueError("only objects (and lists, if flattened) have lines")
    pairs = dict(flatten(value)) if flat else value
    return "\n".join(f"{k}: {v}" for k, v in pairs.items() if v is not None), {"json_type": type(pairs).__name__}


_OUT = pa.struct([("content", pa.string()), ("metadata", pa.map_(pa.string(), pa.string())), ("error", pa.string())])


def parsed(c: Column, parse: Callable[[bytes | str], tuple[str, dict[str, str]]]) -> Column:
    """Struct of content, metadata and error: a file that can't be read leaves its error, and the others go on."""

    @F.arrow_udf("struct<content: string, metadata: map<string, string>, error: string>")
    def run(files: pa.Array) -> pa.Array:
        out = []
        for f in files.to_pylist():
            try:
                content, meta = parse(f) if f is not None else (None, {})
                out.append({"content": content, "metadata": list(meta.items()), "error": None})
            except Exception as e:  # kept with the row
                out.append({"content": None, "metadata": [], "error": f"{type(e).__name__}: {e}"})
        return pa.array(out, _OUT)

    return run(c)


def row_line(*cells: Column, empty_cells: bool = False) -> Column:
    """Cells of a table's row as a sheet's line."""
    text = [F.trim(c.cast("string")) for c in cells]
    return F.concat_ws(" | ", *(F.coalesce(t, F.lit("[EMPTY]")) for t in text)) if empty_cells else F.concat_ws(" | ", *text)


_RUN = r"[A-Za-zÀ-ÿ]{18,}"


def letters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}]", ""))


def blanks(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def needs_spacing(c: Column) -> Column:
    """Whether a page's words seem run together."""
    return (letters(c) >= 40) & (c.rlike(_RUN) | (blanks(c) / letters(c) < 0.08))


def readability(c: Column) -> Column:
    over = F.aggregate(F.regexp_extract_all(c, F.lit(_RUN), F.lit(0)), F.lit(0), lambda s, r: s + F.length(r) - 17)
    return F.when(letters(c) == 0, 0.0).otherwise((blanks(c) - 3 * over) / letters(c))


def better_page(given: Column, recovered: Column) -> Column:
    """The recovered text of a page where the given one needs it and reads worse."""
    return F.when(needs_spacing(given) & (readability(F.coalesce(recovered, F.lit(""))) > readability(given)), recovered).otherwise(given)


def pdf_text(pages: Column) -> Column:
    """Pages' texts with marker lines; empty pages are left out, but counted."""
    marked = F.transform(pages, lambda p, i: F.when(p != "", F.concat(F.lit("--- Page "), (i + 1).cast("string"), F.lit(" ---\n"), p)))
    return F.array_join(marked, "\n")


def pdf_with(extract: Callable[[bytes], tuple[Sequence[str], dict[str, str]]]) -> Callable[[bytes], tuple[str, dict[str, str]]]:
    """A parser for :func:`parsed` of any library's page extraction (pages' texts, document information)."""

    def parse(data: bytes) -> tuple[str, dict[str, str]]:
        pages, info = extract(data)
        text = "\n".join(f"--- Page {i} ---\n{p}" for i, p in enumerate(pages, 1) if p)
        return text, {"pdf_title": info.get("title") or "Unknown", "pdf_author": info.get("author") or "Unknown", "page_count": str(len(pages))}

    return parse
