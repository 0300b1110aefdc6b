import base64
import hashlib
import html
import html.entities
import json
import re

from docquery.llm import warc

PAGE = '<!DOCTYPE html><html><head><title> A &amp; <b>B</b> </title><meta name="description" content="d"><script>var t="</p>";</script><style>p{}</style></head><body><!-- x --><a href="/a">one</a><p>two&nbsp;&lt;3<br>four</p></body></html>'


def rows(spark, data):
    return warc.from_pages(spark.createDataFrame(data, "page_id long, url string, html string")).collect()


def test_linked_records(spark):
    r = {x["warc_type"]: x for x in rows(spark, [(1, "http://h/p", PAGE)])}
    m, c = r["metadata"], r["conversion"]
    assert m["refers_to"] == c["refers_to"] and m["record_id"] != c["record_id"]
    meta = json.loads(m["block"])
    assert meta["title"] == "A & B" and meta["links"] == ["/a"] and meta["description"] == "d"
    assert meta["warc"]["record_id"] == m["refers_to"] and meta["http"][0] == "HTTP/1.1 200 OK" and f"WARC-Record-ID: {m['refers_to']}" in meta["warc"]["headers"]
    assert c["block"] == "A & B\none\ntwo <3\nfour"
    for x in (m, c):
        want = "sha1:" + base64.b32encode(hashlib.sha1(x["block"].encode()).digest()).decode()
        assert x["block_digest"] == want and f"WARC-Block-Digest: {want}" in x["header"]
        assert x["source_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(PAGE.encode()).digest()).decode()
        assert x["content_length"] == len(x["block"].encode()) and f"WARC-Refers-To: {x['refers_to']}" in x["header"]


def test_hostile_pages(spark):
    data = [(None, None, None), (1, None, PAGE), (2, "u", None), (3, "u", ""), (4, "u", "<script>never closed"), (5, "u", "<p>" * 50_000 + "x"), (6, "u", "é<" * 1000), (1, None, PAGE)]
    got = rows(spark, data)
    assert len(got) == 2 * len(data)
    text = {r["page_id"]: r["block"] for r in got if r["warc_type"] == "conversion"}
    assert text[None] == text[2] == text[3] == text[4] == "" and text[5] == "x"
    assert all(r["target_uri"] is None and "WARC-Target-URI" not in r["header"] for r in got if r["page_id"] in (None, 1))


def test_clashing_names_and_general_responses(spark):
    d = warc.responses(spark.createDataFrame([(1, "u", PAGE)], "page_id long, url string, html string")).withColumn("block", warc.F.lit(1)).withColumn("header", warc.F.lit(2))
    own = d.withColumn("http_headers", warc.F.lit("HTTP/1.1 404 Gone\r\nX: y")).withColumn("record_id", warc.F.lit(None).cast("string"))
    got = warc.derivatives(own).collect()
    assert json.loads(got[0]["block"])["http"] == ["HTTP/1.1 404 Gone", "X: y"] and all(r["refers_to"] is None for r in got)
    assert bytes(d.select(warc.record(warc.F.lit("H"), warc.F.lit("é")).alias("r")).first()["r"]) == "H\r\n\r\né\r\n\r\n".encode()


def test_empty_table(spark):
    assert rows(spark, []) == []


def test_captures_have_ids_of_their_own(spark):
    """Pages without ids, and two captures of one address, differ in their payload."""
    got = rows(spark, [(None, None, "<p>a"), (None, None, "<p>b"), (1, "u", "<p>a"), (1, "u", "<p>b")])
    assert len({r["record_id"] for r in got} | {r["refers_to"] for r in got}) == 12
    assert all(re.fullmatch(r"<urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-3[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}>", r["record_id"]) for r in got)


def test_character_references(spark):
    known = [k for k in html.entities.html5 if k.endswith(";")]
    texts = ["&" + k for k in known] + ["&#8217;", "&#x27;", "&#XE9;", "&#128;", "&#0;", "&#xD800;", "&#1114112;", "&nosuch;", "&amp;lt;", "a & b", "&;", "&#;", "AT&T &eacute;t&eacute;"]
    page = "<p>[" + "]<p>[".join(texts) + "]"
    (c,) = [r["block"] for r in rows(spark, [(1, "u", page)]) if r["warc_type"] == "conversion"]
    want = [html.unescape(t) for t in texts]
    tidy = lambda t: "\n".join(x.strip(" ") for x in re.sub(r"\n[ \n]*", "\n", re.sub(r"[ \t\r\f]+", " ", t.replace("\xa0", " "))).split("\n")).strip()
    assert tidy(c) == tidy("\n".join(f"[{t}]" for t in want))


def test_descriptions(spark):
    for tag in ("<META content='it is \"d\"' name=description>", '<meta property="x" name="description" content="it is &quot;d&quot;">', "<meta name='description' lang=en content='it is &#34;d&#34;' />"):
        m = [r["block"] for r in rows(spark, [(1, "u", f"<head>{tag}</head>")]) if r["warc_type"] == "metadata"][0]
        assert json.loads(m)["description"] == 'it is "d"', tag
