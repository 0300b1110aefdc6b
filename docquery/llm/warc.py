"""WARC derivatives: of each response record a linked metadata and a linked plain-text conversion record.

Both carry WARC-Refers-To (the response's record id), the response's target, date and payload
digest, and their own record id, block digest and length.  The metadata block is JSON with all of the
source's WARC and HTTP header lines, the page's title, description, links and counts; the conversion block is the
page's text, one line a block element.  Character references (numeric ones and HTML's table of names, with
their semicolon) are resolved.  Record ids are name-based (UUID version 3): a response's on its page, target, date and
payload, a derivative's on its response and kind, so that captures differ and a
rerun after a lost executor gives the same ones.  Row by row, without a shuffle.

Defined cases: a null payload or header block counts as empty; a response without record id gets
derivatives that refer to null; a null target stays null; an HTML comment, script, style, template
or noscript element that isn't closed reaches to the end of the page; a reference to no character is
U+FFFD; an unknown name stays; rows equal in page_id, url and html give repeated records with the same ids; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "1970-01-01T00:00:00Z"
SOFTWARE = "docquery derivatives"
HIDDEN = r"(?is)<(?:script\b.*?(?:</script\s*>|$)|style\b.*?(?:</style\s*>|$)|template\b.*?(?:</template\s*>|$)|noscript\b.*?(?:</noscript\s*>|$)|!--.*?(?:-->|$))"
BLOCK = r"(?i)</?(?:address|article|aside|blockquote|body|br|caption|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^>]*>"
TAG = r"<[/!?]?[A-Za-z][^>]*>"
#: Those that are looked up first; all others are in NAMED.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&copy;": "©", "&reg;": "®", "&middot;": "·", "&hellip;": "…", "&ndash;": "–", "&mdash;": "—", "&laquo;": "«", "&raquo;": "»", "&euro;": "€", "&amp;": "&"}
NAMED = {k[:-1]: v for k, v in sorted(html5.items()) if k.endswith(";")} | {"nbsp": " "}
REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);"
#: Code points that HTML reads as those of Windows.
WINDOWS = {chr(c): bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(0x80, 0xA0)}
TITLE = r"(?is)<title[^>]*>(.*?)</title"
DESCRIPTION = r"""(?is)<meta\s[^>]*?name\s*=\s*["']?description["'\s/>][^>]*"""
CONTENT = r"""(?is)\scontent\s*=\s*(?:"([^"]*)|'([^']*))"""
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"'>]*)"""


def base32(hexes: Column) -> Column:
    """A SHA-1 in hexadecimal, as 32 letters."""
    letters = []
    for i in range(8):
        n = F.conv(F.substring(hexes, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.pmod(F.shiftright(n, s), F.lit(32)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha1:"), base32(F.sha1(text)))


def record_id(name: Column) -> Column:
    """A urn:uuid made of a name's MD5."""
    h = F.md5(name)
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat_ws("-", F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8)), F.substring(h, 9, 4), F.concat(F.lit("3"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.concat(F.substring(h, 21, 12), F.lit(">")))


def plain_text(html: Column) -> Column:
    """Visible text: a line for each block element, blanks collapsed, the commonest entities resolved."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN, " "), BLOCK, "\n"), TAG, "")
    return _bound(_bound(t, _entities), _tidy)


def _bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a column that is evaluated once, however often f names it."""
    return F.transform(F.array(c), f)[0]


def _tidy(t: Column) -> Column:
    ragged = t.contains("  ") | t.contains("\t") | t.contains("\r") | t.contains("\f")
    t = F.when(ragged, F.regexp_replace(t, r"[ \t\r\f]+", " ")).otherwise(t)
    return F.btrim(F.replace(F.regexp_replace(t, r"\n[ \n]*", "\n"), F.lit(" \n"), F.lit("\n")), F.lit(" \n"))


def _entities(t: Column) -> Column:
    """Only what follows an ampersand is looked at, and in the long table only what the short one lacks."""
    named = F.str_to_map(F.lit("\x1e".join(f"{k}\x1f{v}" for k, v in NAMED.items())), F.lit("\x1e"), F.lit("\x1f"))

    def character(name: Column) -> Column:
        code = F.when(F.lower(F.substring(name, 2, 1)) == "x", F.conv(F.substring(name, F.lit(3), F.length(name)), 16, 10)).otherwise(F.substring(name, F.lit(2), F.length(name))).cast("int")
        none = (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
        point = F.decode(F.unhex(F.lpad(F.hex(F.when(none, 0xFFFD).otherwise(code).cast("long")), 8, "0")), "UTF-32")
        return F.translate(point, "".join(WINDOWS), "".join(WINDOWS.values()))

    def other(piece: Column) -> Column:
        return _bound(F.regexp_extract(piece, REFERENCE, 1), lambda name: F.coalesce(F.concat(F.when(name.startswith("#"), character(name)).otherwise(named[name]), F.substring(piece, F.length(name) + 2, F.length(piece))), F.concat(F.lit("&"), piece)))

    def resolve(piece: Column, i: Column) -> Column:
        out = F.when(piece.rlike(REFERENCE), other(piece)).otherwise(F.concat(F.lit("&"), piece))
        for name, c in reversed(ENTITIES.items()):
            out = F.when(piece.startswith(name[1:]), F.concat(F.lit(c), F.substring(piece, F.lit(len(name)), F.length(piece)))).otherwise(out)
        return F.when(i == 0, piece).otherwise(out)

    return F.when(t.contains("&"), F.array_join(F.transform(F.split(t, "&"), resolve), "")).otherwise(t)


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records (record_id, target_uri, warc_date, warc_headers, http_headers, payload) of a table of pages (page_id, url, html)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    url = F.col("url").cast("string")
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"))
    name = F.concat_ws("\n", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce(url, F.lit("")), F.lit(date), F.sha1(html))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), record_id(name).alias("record_id"), url.alias("target_uri"), F.lit(date).alias("warc_date"), headers.alias("http_headers"), html.alias("payload"))
    own = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: "), F.col("record_id"), F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), F.col("target_uri")), F.lit("")), F.lit("\r\nWARC-Date: "), F.col("warc_date"), F.lit("\r\nContent-Type: application/http; msgtype=response"))
    return rows.withColumn("warc_headers", own)


def derivatives(source: DataFrame, *keep: str) -> DataFrame:
    """Two rows for each response: warc_type, record_id, refers_to, target_uri, warc_date, content_type, content_length, block_digest, source_digest, header, block.

    ``warc_headers``, if the source has them, are its header lines; all go into the metadata.
    """
    lines = F.coalesce(F.col("warc_headers").cast("string"), F.lit("")) if "warc_headers" in source.columns else F.lit("")
    headers = F.coalesce(F.col("http_headers").cast("string"), F.lit(""))
    payload = F.coalesce(F.col("payload").cast("string"), F.lit(""))
    s = source.select(*keep, F.col("record_id").cast("string").alias("refers_to"), F.col("target_uri").cast("string").alias("target_uri"), F.col("warc_date").cast("string").alias("warc_date"), headers.alias("http"), lines.alias("lines"), payload.alias("payload"), digest(payload).alias("source_digest"))
    title = F.regexp_extract("payload", TITLE, 1)
    meta = F.to_json(
        F.struct(
            F.struct(F.lit("response").alias("type"), F.coalesce("refers_to", F.lit("")).alias("record_id"), F.coalesce("target_uri", F.lit("")).alias("target_uri"), F.coalesce("warc_date", F.lit("")).alias("date"), F.col("source_digest").alias("payload_digest"), F.split("lines", "\r\n").alias("headers")).alias("warc"),
            F.split("http", "\r\n").alias("http"),
            _bound(F.regexp_replace(F.regexp_replace(title, TAG, ""), r"^\s+|\s+$", ""), _entities).alias("title"),
            _bound(_bound(F.regexp_extract("payload", DESCRIPTION, 0), lambda tag: F.concat(F.regexp_extract(tag, CONTENT, 1), F.regexp_extract(tag, CONTENT, 2))), _entities).alias("description"),
            F.regexp_extract_all("payload", F.lit(LINK), 1).alias("links"),
            F.octet_length("payload").alias("payload_length"),
        )
    )
    made = lambda kind, block: F.struct(F.lit(kind).alias("warc_type"), block.alias("block"))
    rows = s.select(*keep, "refers_to", "target_uri", "warc_date", "source_digest", F.explode(F.array(made("metadata", meta), made("conversion", plain_text(F.col("payload"))))).alias("r"))
    rows = rows.select(*keep, F.col("r.warc_type").alias("warc_type"), record_id(F.concat_ws("\n", F.coalesce("refers_to", F.lit("")), F.col("r.warc_type"), F.coalesce("target_uri", F.lit("")), F.coalesce("warc_date", F.lit("")), "source_digest")).alias("record_id"), "refers_to", "target_uri", "warc_date", F.when(F.col("r.warc_type") == "metadata", "application/json").otherwise("text/plain").alias("content_type"), F.octet_length("r.block").alias("content_length"), digest(F.col("r.block")).alias("block_digest"), "source_digest", F.col("r.block").alias("block"))
    line = lambda name, c: F.concat(F.lit(f"\r\n{name}: "), c)
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("warc_type"), line("WARC-Record-ID", F.col("record_id")), F.coalesce(line("WARC-Refers-To", F.col("refers_to")), F.lit("")),
        F.coalesce(line("WARC-Target-URI", F.col("target_uri")), F.lit("")), F.coalesce(line("WARC-Date", F.col("warc_date")), F.lit("")), line("WARC-Block-Digest", F.col("block_digest")),
        line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length").cast("string")), F.lit(f"\r\nX-Source-Payload-Digest: "), F.col("source_digest"),
    )
    return rows.withColumn("header", header)


def from_pages(pages: DataFrame) -> DataFrame:
    return derivatives(responses(pages), "page_id")


def record(header: Column, block: Column) -> Column:
    """A record's bytes as WARC files hold them."""
    return F.concat(header, F.lit("\r\n\r\n"), block, F.lit("\r\n\r\n")).cast("binary")


def oracle() -> str:
    """DuckDB SQL for :func:`from_pages`."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    crlf = "chr(13) || chr(10)"

    def b32(h: str) -> str:
        n = lambda i: f"('0x' || substr({h}, {5 * i + 1}, 5))::INT"
        return " || ".join(f"substr('{BASE32}', (({n(i)} >> {s}) & 31) + 1, 1)" for i in range(8) for s in (15, 10, 5, 0))

    dig = lambda c: f"'sha1:' || (SELECT {b32('h')} FROM (SELECT sha1({c}) AS h))"
    rid = lambda c: f"(SELECT '<urn:uuid:' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '{"89ab" * 4}') || substr(h, 18, 3) || '-' || substr(h, 21, 12) || '>' FROM (SELECT md5({c}) AS h))"
    text = f"regexp_replace(regexp_replace(regexp_replace(payload, {q(HIDDEN)}, ' ', 'g'), {q(BLOCK)}, chr(10), 'g'), {q(TAG)}, '', 'g')"
    code = "(CASE WHEN lower(n[2:2]) = 'x' THEN ('0x' || n[3:])::BIGINT ELSE n[2:]::BIGINT END)"
    point = f"CASE WHEN {code} = 0 OR {code} BETWEEN 55296 AND 57343 OR {code} > 1114111 THEN chr(65533) ELSE translate(chr({code}::INT), {q(''.join(WINDOWS))}, {q(''.join(WINDOWS.values()))}) END"
    named = ", ".join(f"({q(k)}, {q(v)})" for k, v in NAMED.items())
    tidy = "regexp_replace(regexp_replace(regexp_replace(t, '[ \\t\\r\\f]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')"
    meta = f"regexp_extract(payload, {q(DESCRIPTION)}, 0)"
    title = f"regexp_replace(regexp_replace(regexp_extract(payload, {q(TITLE)}, 1), {q(TAG)}, '', 'g'), '^\\s+|\\s+$', '', 'g')"
    return f"""
    WITH named(name, c) AS (VALUES {named}),
    a AS (SELECT row_number() OVER () AS k, page_id, url AS target_uri, coalesce(html, '') AS payload, {rid(f"coalesce(page_id::VARCHAR, '') || chr(10) || coalesce(url, '') || chr(10) || '{DATE}' || chr(10) || sha1(coalesce(html, ''))")} AS refers_to FROM pages),
    raw AS (SELECT k, unnest(['title', 'description', 'text']) AS kind, unnest([{title}, regexp_extract({meta}, {q(CONTENT)}, 1) || regexp_extract({meta}, {q(CONTENT)}, 2), {text}]) AS t FROM a),
    pieces AS (SELECT k, kind, unnest(string_split(t, '&')) AS p, generate_subscripts(string_split(t, '&'), 1) AS i FROM raw),
    names AS (SELECT *, regexp_extract(p, {q(REFERENCE)}, 1) AS n FROM pieces),
    clean AS (SELECT k, kind, string_agg(CASE WHEN i = 1 THEN p ELSE coalesce(CASE WHEN n[1:1] = '#' THEN {point} WHEN n <> '' THEN c END || p[len(n) + 2:], '&' || p) END, '' ORDER BY i) AS t FROM names LEFT JOIN named ON name = n GROUP BY k, kind),
    s AS (SELECT a.*, x.t AS title, y.t AS description, {tidy.replace("(t,", "(z.t,")} AS plain, 'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: ' || octet_length(encode(payload))::VARCHAR AS http, 'WARC/1.1' || {crlf} || 'WARC-Type: response' || {crlf} || 'WARC-Record-ID: ' || refers_to || coalesce({crlf} || 'WARC-Target-URI: ' || target_uri, '') || {crlf} || 'WARC-Date: {DATE}' || {crlf} || 'Content-Type: application/http; msgtype=response' AS lines, {dig("payload")} AS source_digest FROM a JOIN clean x ON x.k = a.k AND x.kind = 'title' JOIN clean y ON y.k = a.k AND y.kind = 'description' JOIN clean z ON z.k = a.k AND z.kind = 'text'),
    m AS (SELECT *, 'metadata' AS warc_type, to_json(struct_pack(warc := struct_pack("type" := 'response', record_id := refers_to, target_uri := coalesce(target_uri, ''), date := '{DATE}', payload_digest := source_digest, headers := string_split(lines, {crlf})), http := string_split(http, {crlf}), title := title, description := description, links := regexp_extract_all(payload, {q(LINK)}, 1), payload_length := octet_length(encode(payload))))::VARCHAR AS block FROM s),
    c AS (SELECT *, 'conversion' AS warc_type, plain AS block FROM s),
    r AS (SELECT page_id, warc_type, {rid(f"refers_to || chr(10) || warc_type || chr(10) || coalesce(target_uri, '') || chr(10) || '{DATE}' || chr(10) || source_digest")} AS record_id, refers_to, target_uri, '{DATE}' AS warc_date, CASE WHEN warc_type = 'metadata' THEN 'application/json' ELSE 'text/plain' END AS content_type, octet_length(encode(block))::INT AS content_length, {dig("block")} AS block_digest, source_digest, block FROM (SELECT * FROM m UNION ALL SELECT * FROM c))
    SELECT *, 'WARC/1.1' || {crlf} || 'WARC-Type: ' || warc_type || {crlf} || 'WARC-Record-ID: ' || record_id || {crlf} || 'WARC-Refers-To: ' || refers_to || coalesce({crlf} || 'WARC-Target-URI: ' || target_uri, '') || {crlf} || 'WARC-Date: ' || warc_date || {crlf} || 'WARC-Block-Digest: ' || block_digest || {crlf} || 'Content-Type: ' || content_type || {crlf} || 'Content-Length: ' || content_length::VARCHAR || {crlf} || 'X-Source-Payload-Digest: ' || source_digest AS header FROM r"""
