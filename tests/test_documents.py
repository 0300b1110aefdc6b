import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from docquery.functions import text
from docquery.operators import chunk, domain, structure
from docquery.plans import pipeline
from docquery.sources import html, loaders, office


def docs(spark, *rows):
    return spark.createDataFrame([(str(i), t, f"f{i}", c) for i, (t, c) in enumerate(rows)], "document_id string, source_type string, source string, content string")


def test_pack_overlaps_by_whole_units():
    units = ["First sentence here.", "Second sentence is here.", "Third sentence is the last one."]
    assert chunk.pack(units, 60, 45, " ") == ["First sentence here. Second sentence is here.", "First sentence here. Second sentence is here. Third sentence is the last one."]
    assert chunk.pack(units, 60, 25, " ")[1] == "Second sentence is here. Third sentence is the last one."
    assert chunk.pack(["a" * 25, "bb. cc"], 10, 0) == ["a" * 10, "a" * 10, "a" * 5, "bb. cc"]
    assert chunk.pack(["x" * 20], 10, 0, split=False) == ["x" * 20] and chunk.pack([], 10, 2) == []
    assert chunk._trimmed("one two three", 7) == "three"


def test_fixed_windows(spark):
    d = spark.createDataFrame([("abcdefghij",), ("",), (None,)], "t string").select(chunk.fixed(F.col("t"), 4, 1).alias("c"))
    assert [r["c"] for r in d.collect()] == [["abcd", "defg", "ghij"], [], []]
    with pytest.raises(ValueError):
        chunk.fixed(F.col("t"), 4, 4)


def test_every_source_type(spark):
    d = docs(
        spark, ("text", "One.\n\nTwo."), ("pdf", "lost\n--- Page 2 ---\nA\n\nB\n--- Page 3 ---\nC"), ("url", "Intro line here\nThe Big Heading\nbody one\nbody two"), ("docx", "Some Title Here\nbody\n--- Table 1 ---\na | b"),
        ("excel", "x\n--- Sheet: S1 ---\nA | B\n\n1 | 2\n--- Sheet: S2 ---\nq"), ("json", "user.name: Alice\nitems[0].id: 1\nuser.mail: a:b\nnot a path"), ("cisco_config", "hostname R1\ninterface Gi0/1\n ip address x\nrouter bgp 65000\n neighbor y"), ("pdf", "no marks"),
    )
    c = {}
    for r in pipeline.run(d, 1000, 0).orderBy("document_id", "chunk_index").collect():
        c.setdefault(r["document_id"], []).append(r)
    assert [r["content"] for r in c["0"]] == ["One.\n\nTwo."]
    assert [(r["page"], r["content"]) for r in c["1"]] == [(2, "A\n\nB"), (3, "C")]
    assert [(r["structural_path"][1], r["content"]) for r in c["2"]] == [("Introduction", "Intro line here"), ("The Big Heading", "body one\n\nbody two")]
    assert [(r["structural_path"][1], r["content"]) for r in c["3"]] == [("Some Title Here", "body"), ("Table 1", "a | b")]
    assert [(r["sheet"], r["row_start"], r["row_end"], r["content"]) for r in c["4"]] == [("S1", 1, 2, "A | B\n1 | 2"), ("S2", 1, 1, "q")]
    assert [(r["json_path"], r["content"]) for r in c["5"]] == [("user", "user.name: Alice\nuser.mail: a:b"), ("items[0]", "items[0].id: 1")]
    assert [(r["block_type"], r["block_name"]) for r in c["6"]] == [("global", "global"), ("interface", "Gi0/1"), ("router", "bgp 65000")]
    assert [r["page"] for r in c["7"]] == [1]
    assert {r["total_chunks"] for r in c["5"]} == {2} and len({r["chunk_id"] for v in c.values() for r in v}) == sum(map(len, c.values()))


def test_unknown_type_is_an_error(spark):
    with pytest.raises(Exception, match="no extractor"):
        structure.extract(docs(spark, ("nonsense", "x"))).count()


def test_path_segments(spark):
    d = spark.createDataFrame([("a.b[0.1].c..d",)], "p string").select(structure.segments(F.col("p")).alias("s"))
    assert d.first()["s"] == ["a", "b[0.1]", "c", "d"]


def test_json_lines():
    value = {"a": {"b": [1, {"c": True}], "e": {}}, "n": None, "s": "x\ny"}
    assert office.json_text(json.dumps(value))[0] == "a.b[0]: 1\na.b[1].c: True\ns: x\ny"
    with pytest.raises(ValueError):
        office.json_text("[1]", flat=False)


def make(files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, body in files.items():
            z.writestr(name, body)
    return b.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
DOCX = make({"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>Title Words</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p/><w:p><w:r><w:t>body</w:t></w:r></w:p></w:body></w:document>"})
XLSX = make({
    "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="One" r:id="r1"/><sheet name="Two" r:id="r2"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<R xmlns="x"><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="/xl/worksheets/s2.xml"/></R>',
    "xl/sharedStrings.xml": f"<sst {S}><si><t>name</t></si></sst>",
    "xl/worksheets/s1.xml": f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3</v></c></row><row><c r="A2"><f>SUM(A1)</f><v>9</v></c></row></sheetData></worksheet>',
    "xl/worksheets/s2.xml": f'<worksheet {S}><sheetData><row><c r="A1" t="inlineStr"><is><t> x </t></is></c></row></sheetData></worksheet>',
})


def test_office_files():
    assert office.docx(DOCX) == ("Title Words\nbody\n\n--- Table 1 ---\na | b\n", {"paragraph_count": "3", "table_count": "1"})
    assert office.docx(DOCX, tables=False)[0] == "Title Words\nbody"
    assert office.xlsx(XLSX)[0] == "--- Sheet: One ---\nname | 3\n=SUM(A1)\n--- Sheet: Two ---\nx"
    assert office.xlsx(XLSX, True, ["One", "None"])[0] == "--- Sheet: One ---\nname | [EMPTY] | 3\n=SUM(A1)"


def test_html():
    page = '<nav><a href="/n">n</a></nav><p>one <b>two</b></p><script>var t="</p>";</script><footer>f</footer><a href="/x">link</a>'
    assert html.read(page).split("\n") == ["one ", "two", "link"]
    assert html.read(page, links=True).endswith("--- Links ---\nLink: /x")


def test_loading_a_folder(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(DOCX)
    (tmp_path / "b.XLSX").write_bytes(XLSX)
    (tmp_path / "c.json").write_text('{"a": [1, 2]}')
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "latin.txt").write_bytes("caf\xe9 time".encode("latin-1"))
    (tmp_path / "r.txt").write_text("hostname R1\ninterface Gi0/1\n password 7 abc")
    (tmp_path / "s.cfg").write_text("vlan 10")
    (tmp_path / "x.csv").write_text("not read")
    got = {r["source_path"].rsplit("/", 1)[1]: r for r in loaders.load(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.docx", "b.XLSX", "c.json", "bad.json", "latin.txt", "r.txt", "s.cfg"}
    assert got["latin.txt"]["content"] == "café time" and got["latin.txt"]["source_type"] == "text_file"
    assert got["bad.json"]["content"] is None and "JSONDecodeError" in got["bad.json"]["error"]
    assert got["c.json"]["content"] == "a[0]: 1\na[1]: 2"
    assert got["r.txt"]["source_type"] == "cisco_config" and "--- Cisco Section: interface Gi0/1 ---" in got["r.txt"]["content"] and "[REDACTED]" in got["r.txt"]["content"]
    assert pipeline.run(pipeline.documents(loaders.load(spark, str(tmp_path)))).where("domain = 'cisco'").count() > 0
    assert loaders.get_loader("nothing") is None and "json" in loaders.list_loaders()


def test_pages_and_spacing(spark):
    run, ok = "loremipsumdolorsitametconsectetur" * 2, "a b c d e f g h " * 10
    d = spark.createDataFrame([(run, ok), (ok, run)], "a string, b string").select(office.better_page(F.col("a"), F.col("b")).alias("p"), office.needs_spacing(F.col("a")).alias("n"))
    assert [tuple(r) for r in d.collect()] == [(ok, True), (ok, False)]
    parse = office.pdf_with(lambda data: (["one", "", "three"], {"title": None}))
    assert parse(b"")[0] == "--- Page 1 ---\none\n--- Page 3 ---\nthree" and parse(b"")[1]["pdf_title"] == "Unknown"


def test_uploads(spark):
    d = spark.createDataFrame([("a/b.txt", "aGk="), ("", "aGk="), ("c.txt", "***")], "name string, content_base64 string")
    r = loaders.uploads(d).collect()
    assert bytes(r[0]["content"]) == b"hi" and r[0]["path"].endswith("_b.txt") and [x["error"] for x in r] == [None, "no name", "content isn't base64"]


CASES = [
    ("text", "contract.txt", "This agreement: whereas the parties. Governing law applies. Each party shall pay.", "legal", 0.55),
    ("text", "visit.txt", "Chief complaint: pain.\nAssessment: stable\nPlan: rest. Blood pressure 120 mmHg", "medical", 0.55),
    ("cisco_config", "r.cfg", "interface Gi0/1\n switchport access vlan 10\nrouter bgp 1", "cisco", 0.60),
    ("text", "note.txt", "The project moves on and the team meets on Monday.", "general", 0.55),
]


@pytest.mark.parametrize("source_type,name,content,want,least", CASES)
def test_domains(spark, source_type, name, content, want, least):
    d = spark.createDataFrame([(source_type, name, content)], "s string, n string, content string")
    r = domain.classify(d, "content", F.col("s"), F.col("n")).first()
    assert r["domain"] == want and r["domain_confidence"] >= least and r["domain_reason"].startswith(want)


def test_routing(spark):
    q = spark.createDataFrame([("which switchport and interface vlan, router bgp, line vty?",), ("hello there",)], "text string")
    r = domain.route(q, {"cisco": 2, "general": 1}).collect()
    assert [(x["domain"], x["filter_applied"]) for x in r] == [("cisco", True), ("general", True)]
    assert domain.route(q, {"legal": 2}).first()["filter_applied"] is False
    assert domain.route(q, {"cisco": 2}).first()["domain_confidence"] >= 0.85
    assert domain.route(q, {}, manual="legal").first()["mode"] == "manual"
    with pytest.raises(ValueError):
        domain.route(q, {}, manual="cooking")


def test_contains_term(spark):
    d = spark.createDataFrame([("vlan 10 on gi1/0/24",)], "t string")
    has = lambda n: d.select(text.contains_term(F.col("t"), n).alias("x")).first()["x"]
    assert has("VLAN") and has("Gi1/0") and not has("lan") and not has("") and not has("gi")


def test_batches_to_python_are_bounded_by_bytes(spark):
    import pyarrow as pa

    from docquery.session import ready

    @F.arrow_udf("long")
    def size(a: pa.Array) -> pa.Array:
        return pa.array([a.nbytes] * len(a), pa.int64())

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    text = F.repeat(F.lit("x"), 1 << 20)
    texts = ready(spark).range(40, numPartitions=1).select(F.concat(text, F.col("id").cast("string")).alias("t"))
    for c in (size("t"), size(F.struct("t")), size(F.array("t"))):
        assert texts.agg(F.max(c)).first()[0] < 8 << 20
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "123456")  # one's own bound stays
    assert ready(spark).conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "123456"
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    ready(spark)
