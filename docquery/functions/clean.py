"""Text cleaning as Column expressions.

All but three steps are built-in expressions; composition to NFC, OCR repair and the limit on
repeated lines need Python, and read only the rows that can change.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, replace

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Quotes, dashes and the no-break space have plain stand-ins; the last two are dropped.
_FANCY = "‘’‚‛“”„‟–—− " + "​﻿"
_PLAIN = "''''" + '""""' + "---" + " "

CONTRACTIONS = (("can't", "cannot"), ("won't", "will not"), ("n't", " not"), ("'re", " are"), ("'ve", " have"), ("'ll", " will"), ("'d", " would"), ("'m", " am"))
_SPLIT_WORDS = (("shee", "t"), ("hea", "der"), ("foo", "ter"))
_CREDENTIALS = (r"password\s+", r"secret\s+", r"user\s+\S+\s+password\s+", r"enable password\s+", r"snmp-server\s+community\s+")
#: What Java's Unicode class of white space has.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_KEEP = re.escape(".,!?;:'\"-()[]{}<>/@#%&+=_*|$") + r"\\"


def _only(where: Callable[[Column], Column], c: Column, f: Callable[[str], str]) -> Column:
    """f on the rows where it may matter, in Arrow batches; c is evaluated once, and the other rows pass as they are."""

    @F.arrow_udf("string")
    def run(rows: pa.Array) -> pa.Array:
        texts, on = rows.field(0), rows.field(1).fill_null(False)
        return pc.replace_with_mask(texts, on, pa.array([f(t) for t in texts.filter(on).to_pylist()], texts.type))

    return run(F.transform(F.array(c), lambda x: F.struct(x.alias("text"), (x.isNotNull() & where(x)).alias("on")))[0])


def boundaries(c: Column) -> Column:
    """Line feeds as the only line ends, plain quotes and dashes, no invisible characters."""
    return F.translate(F.regexp_replace(c, "\r\n?", "\n"), _FANCY, _PLAIN)


def control_characters(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0B-\x1F]", "")


def compose(c: Column) -> Column:
    """Unicode NFC."""
    return _only(lambda x: ~x.rlike(r"^[\x00-\x{2FF}]*$"), c, lambda t: unicodedata.normalize("NFC", t))


def urls(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)https?://\S+|www\.\S+", "")


def emails(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\b[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "")


def contractions(c: Column) -> Column:
    for short, long in CONTRACTIONS:
        c = F.regexp_replace(c, f"(?i){short}", long)
    return c


def _repair(text: str) -> str:
    def token(m: re.Match) -> str:
        t = m.group()
        return t.replace("0", "o").replace("1", "l") if len(t) > 3 and ("0" in t or "1" in t) and any(map(str.isalpha, t)) else t

    return re.sub(r"\b[A-Za-zÀ-ÿ0-9]+\b", token, text)


def ocr(c: Column) -> Column:
    """Rejoin known split words; in tokens with letters read 0 as o and 1 as l."""
    for a, b in _SPLIT_WORDS:
        c = F.regexp_replace(c, rf"(?iU)\b{a}\s+{b}\b", a + b)
    c = F.regexp_replace(c, r"(?iU)\bfin1sh\b", "finish")
    return _only(lambda x: x.rlike("[01]"), c, _repair)


def lowercase(c: Column) -> Column:
    return F.lower(c)


def special_characters(c: Column, keep_punctuation: bool = True) -> Column:
    # Letters, numbers and _, without the combining marks that Java's own word class has.
    return F.regexp_replace(c, rf"(?U)[^\p{{L}}\p{{N}}_\s{_KEEP if keep_punctuation else ''}]", "")


def repeated_lines(c: Column, most: int = 4) -> Column:
    """Of a line that occurs more than ``most`` times only the first stays; lines of OCR markers go."""

    def limit(text: str) -> str:
        lines = text.split("\n")
        names = [x.strip().casefold() for x in lines]
        n, seen, out = Counter(x for x in names if len(x) >= 4), Counter(), []
        for line, name in zip(lines, names):
            if name.startswith("ocr_extract"):
                continue
            seen[name] += 1
            if n[name] <= most or seen[name] == 1:
                out.append(line)
        return "\n".join(out)

    def some(x: Column) -> Column:
        return (F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit(""))) >= most) | F.lower(x).contains("ocr_extract")

    return _only(some, c, limit)


def whitespace(c: Column) -> Column:
    """Single blanks, stripped lines, at most one empty line in a row and none at the ends."""
    c = F.regexp_replace(c, r"(?U)[^\S\n ][^\S\n]*| [^\S\n]+", " ")  # single blanks are left as they are
    c = F.regexp_replace(c, r"(?md)^ | $", "")
    return F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"^\n+|\n+\z", "")


def sanitize(c: Column) -> Column:
    """Without control characters other than line feeds, tabs and returns."""
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def redact(c: Column, strict: bool = False) -> Column:
    """Mask the word after a credential's keyword; strict: the rest of the line, so that typed hashes don't leak."""
    for key in _CREDENTIALS:
        c = F.regexp_replace(c, rf"(?i)({key})({r'\S[^\n]*' if strict else r'\S+'})", "$1[REDACTED]")
    return c


def without_thoughts(c: Column) -> Column:
    """Without a model's <think> passages, unless nothing else is there."""
    rest = strip(F.regexp_replace(c, r"(?is)<think>.*?</think>", ""))
    return F.when(rest == "", strip(c)).otherwise(rest)


def strip(c: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.btrim(c, F.lit(_SPACE))


@dataclass(frozen=True)
class Cleaner:
    """Which steps :meth:`clean` takes, in the order of the fields."""

    unicode: bool = True
    urls: bool = True
    emails: bool = True
    contractions: bool = True
    ocr: bool = False
    lowercase: bool = False
    keep_punctuation: bool = True
    repeated_lines: bool = False
    whitespace: bool = True

    @classmethod
    def prose(cls) -> "Cleaner":
        return cls()

    @classmethod
    def ocr_prose(cls) -> "Cleaner":
        return cls(ocr=True, repeated_lines=True)

    @classmethod
    def structured(cls) -> "Cleaner":
        return cls()

    @classmethod
    def network(cls) -> "Cleaner":
        return cls()

    def but(self, **changes: bool) -> "Cleaner":
        return replace(self, **changes)

    def clean(self, c: Column) -> Column:
        c = control_characters(boundaries(c))
        for on, step in ((self.unicode, compose), (self.urls, urls), (self.emails, emails), (self.contractions, contractions), (self.ocr, ocr), (self.lowercase, lowercase)):
            c = step(c) if on else c
        c = special_characters(c, self.keep_punctuation)
        c = repeated_lines(c) if self.repeated_lines else c
        return strip(whitespace(c) if self.whitespace else c)
