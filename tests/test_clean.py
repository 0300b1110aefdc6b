import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docquery.functions import clean, text
from docquery.functions.clean import Cleaner

ODD = st.text(st.sampled_from(list("aZéßΣ ’“—\u00a0\u200b\r\n\t\x07.,:@/'01\u2028İ日-_€\u0301")), max_size=40)


def run(spark, values, *columns):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [tuple(r)[1:] for r in d.select("i", *columns).orderBy("i").collect()]


def one(spark, value, column):
    return run(spark, [value], column(F.col("t")))[0][0]


def test_prose_keeps_technical_syntax(spark):
    x = "Use Gi1/0/24 on 10.10.0.0/24, user.name[0].id = $10 #tag\r\nmail me@x.org  https://x.y/z"
    assert one(spark, x, Cleaner.prose().clean) == "Use Gi1/0/24 on 10.10.0.0/24, user.name[0].id = $10 #tag\nmail"


def test_ocr_prose(spark):
    x = "The shee t has a hea der and foo ter. It fin1sh c0st1y w0rk, 10 of 2010.\n" + "Page\n" * 6 + "ocr_extract 3\nend"
    assert one(spark, x, Cleaner.ocr_prose().clean) == "The sheet has a header and footer. It finish costly work, 10 of 2010.\nPage\nend"


def test_contractions_in_order(spark):
    assert one(spark, "I CAN'T, won't, don't, we're, I've, it'll, he'd, I'm", clean.contractions) == "I cannot, will not, do not, we are, I have, it will, he would, I am"


def test_redaction(spark):
    x = "enable password hush\nusername a password 7 0F1C\nsnmp-server community pub RO"
    assert one(spark, x, clean.redact) == "enable password [REDACTED]\nusername a password [REDACTED] 0F1C\nsnmp-server community [REDACTED] RO"
    assert one(spark, x, lambda c: clean.redact(c, strict=True)) == "enable password [REDACTED]\nusername a password [REDACTED]\nsnmp-server community [REDACTED]"


def test_null_passes(spark):
    assert run(spark, [None], Cleaner.ocr_prose().clean(F.col("t"))) == [(None,)]


def plain_whitespace(t):
    t = re.sub(r"[^\S\n]+", " ", t)
    out = []
    for line in map(str.strip, t.split("\n")):
        if line or (out and out[-1]):
            out.append(line)
    while out and not out[-1]:
        out.pop()
    return "\n".join(out)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(ODD, min_size=5, max_size=30))
def test_columns_against_plain_python(spark, values):
    fancy = str.maketrans(dict(zip(clean._FANCY, [*clean._PLAIN, "", ""])))
    c = F.col("t")
    base = clean.control_characters(clean.boundaries(c))
    got = run(spark, values, base, clean.compose(c), clean.whitespace(base), clean.strip(c), clean.special_characters(base), text.collapse(c))
    for v, row in zip(values, got):
        b = "".join(x for x in v.replace("\r\n", "\n").replace("\r", "\n").translate(fancy) if ord(x) >= 32 or x in "\n\t")
        assert row[0] == b
        assert row[1] == unicodedata.normalize("NFC", v)
        if not set(v) & set("\u2028"):  # line separators are lines to some and blanks to others
            assert row[2] == plain_whitespace(b)
        assert row[3] == v.strip()
        assert row[4] == re.sub(r"[^\w\s.,!?;:'\"\-()\[\]{}<>/@#%&+=_*|\\$]", "", b)
        assert row[5] == re.sub(r"\s+", " ", v).strip()


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from(list("aB1 ./:-[]_GivlanTe09'\"é")), max_size=30), min_size=5, max_size=30))
def test_tokens_for_columns_and_for_queries_agree(spark, values):
    c = F.col("t")
    got = run(spark, values, text.tokens(c), text.quoted(c), text.technical_terms(c))
    for v, row in zip(values, got):
        assert tuple(row[0]) == text.q_tokens(v)
        assert tuple(row[1]) == text.q_quoted(v)
        assert tuple(row[2]) == text.q_terms(v)


@pytest.mark.parametrize("line,heading", [("Overview:", True), ("ALL UPPER", True), ("Two Words", True), ("Word", False), ("a plain line of text", False), ("ab", False), ("X" * 81, False), ("12 34", False), ("Éa Ünder the", True)])
def test_headings(spark, line, heading):
    assert one(spark, line, text.is_heading) is heading
