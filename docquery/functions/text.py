"""Tokens, technical terms, query hints and line tests, for columns and (with a leading q) for one query on the driver."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clean import compose, strip

# One prefix stands for all longer interface names that begin with it.
_INTERFACE = r"(?:Fa|Gi|Lo|Po|Te|Vlan|Serial|Tunnel)\S*"
_ADDRESS = r"\d{1,3}(?:\.\d{1,3}){3}(?:/\d{1,2})?"
_KEY = r"[A-Za-z_][\w-]*(?:\[[0-9]+\])?"
_PATH = rf"{_KEY}(?:\.{_KEY})+"
TOKEN = rf"\b{_ADDRESS}\b|\b{_INTERFACE}\b|\b{_PATH}\b|\b[A-Za-z][A-Za-z0-9_./:-]*\b"
# The same tokens with less going back: one test of the first character, and names that are followed by a dot whole.
_NAME = r"[A-Za-z_][\w-]*+(?:\[[0-9]+\])?+"
_FAST = rf"(?=[\dA-Za-z_])\b(?:{_ADDRESS}\b|{_INTERFACE}\b|(?:{_NAME}\.)+{_KEY}\b|[A-Za-z][A-Za-z0-9_./:-]*\b)"
ADDRESS, INTERFACE, PATH = rf"\b{_ADDRESS}\b", rf"(?i)\b{_INTERFACE}\b", rf"\b{_PATH}\b"
LIST_OR_VLAN = r"(?i)\b(?:access-list|acl|vlan)\s+[A-Za-z0-9_-]+\b"
QUOTED = r"\"([^\"]+)\"|'([^']+)'"
COMMANDS = tuple(sorted({"access-list", "class-map", "hostname", "interface", "ip access-list", "ip route", "policy-map", "router bgp", "router eigrp", "router ospf", "service-policy", "snmp-server", "spanning-tree", "switchport"}))
DELIMITERS = "./:-[]"


def fold(c: Column) -> Column:
    """Case folding by built-ins: lower case, with sharp s written out and one sigma."""
    return F.replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)[^\S ]\s*| \s+", " "))


def lookup(c: Column, composed: bool = True) -> Column:
    """The form in which texts and needles are compared; ``composed``: c is NFC already."""
    return collapse(fold(c if composed else compose(c)))


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, which is evaluated once however often f has it."""
    return F.transform(F.array(c), f)[0]


def found(c: Column) -> Column:
    """All tokens as they stand; ASCII texts need no Unicode classes."""
    return once(c, lambda x: F.when(x.rlike(r"\A[\x00-\x7F]*\z"), F.regexp_extract_all(x, F.lit(_FAST), F.lit(0))).otherwise(F.regexp_extract_all(x, F.lit(f"(?U){_FAST}"), F.lit(0))))


def lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"(?U)\n\s*\n"), strip), lambda x: x != "")


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(strip(c), r"(?U)(?<=[.!?])\s+"), strip), lambda x: x != "")


def is_heading(c: Column) -> Column:
    """Of a stripped line: 3 to 80 characters, and a colon at the end, all upper case, or most words capitalised."""
    capital = lambda words: F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    title = once(F.split(strip(c), r"(?U)\s+"), lambda words: (F.size(words) > 1) & (capital(words) >= 0.6 * F.size(words)))
    return F.coalesce(F.length(c).between(3, 80) & (c.endswith(":") | ((F.upper(c) == c) & (F.lower(c) != c)) | title), F.lit(False))


def unique(a: Column) -> Column:
    """Non-empty elements, each once whatever its case, in order of first occurrence."""
    pairs = F.filter(a, lambda x: x.isNotNull() & (x != ""))
    return F.filter(pairs, lambda x, i: F.array_position(F.transform(pairs, F.lower), F.lower(x)) == i + 1)


def tokens(c: Column, least: int = 1) -> Column:
    """Distinct tokens that keep technical syntax (addresses, interfaces, paths), folded."""
    every = found(c)
    every = every if least <= 1 else F.filter(every, lambda t: F.length(t) >= least)
    return F.array_distinct(F.transform(F.array_distinct(every), fold))


def quoted(c: Column) -> Column:
    either = F.regexp_extract_all(c, F.lit(QUOTED), F.lit(0))
    return unique(F.transform(either, lambda q: collapse(F.substring(q, 2, F.length(q) - 2))))


def technical_terms(c: Column) -> Column:
    whole = collapse(c)
    parts = [F.regexp_extract_all(c, F.lit("(?U)" + p), F.lit(0)) for p in (ADDRESS, INTERFACE, PATH, LIST_OR_VLAN)]
    command = F.when(_any(F.lower(whole), COMMANDS), F.array(whole)).otherwise(F.array().cast("array<string>"))
    marked = F.filter(tokens(c), lambda t: t.rlike(r"(?U)[\d./:\[\]-]"))
    return unique(F.concat(*parts, command, marked))


def _any(c: Column, terms: Iterable[str]) -> Column:
    return F.greatest(*(c.contains(t) for t in terms))


def contains_term(haystack: Column, needle: str) -> Column:
    """Whether a folded haystack has the needle: anywhere if it has a delimiter, else as a word."""
    n = q_lookup(needle)
    if not n:
        return F.lit(False)
    return haystack.contains(n) if any(d in n for d in DELIMITERS) else haystack.contains(n) & haystack.rlike(r"(?U)(?<!\w)" + re.escape(n) + r"(?!\w)")


def decimal(x: Column, places: int) -> Column:
    """A rounded double as text as SQL engines write it: no exponent under 1e16, and the sign of what was rounded also on zero."""
    n = F.abs(F.round(x, places))
    digits = F.regexp_replace(n.cast(f"decimal({17 + places}, {places})").cast("string"), r"(\.\d+?)0*$", "$1")
    short = F.format_string("%.15e", n)  # Java may write more digits than a double needs
    large = F.when(F.isnan(n) | (n == float("inf")), "inf").when(short.try_cast("double") == n, F.regexp_replace(short, r"\.?0*e", "e")).otherwise(F.regexp_replace(n.cast("string"), r"(\.0)?E", "e+"))
    sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")
    return F.when(F.isnan(x), "nan").otherwise(F.concat(sign, F.when(n < 1e16, digits).otherwise(large)))


def sheet_headers(c: Column) -> Column:
    """Distinct column names of a table's first line."""
    first = F.element_at(F.split(c, r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"), 1)
    return F.when(first.contains("|"), unique(F.transform(F.split(first, r"\|"), collapse))).otherwise(F.array().cast("array<string>"))


def slice_lines(a: Column, start: int, end: int) -> Column:
    """Struct of lines start to end (from 0, end excluded) as text and their numbers from 1."""
    return F.struct(strip(F.array_join(F.slice(a, start + 1, end - start), "\n")).alias("content"), F.lit(start + 1).alias("first"), F.lit(end).alias("last"))


# The same for one query.


def q_collapse(s: str) -> str:
    return re.sub(r"\s+", " ", s).strip()


def q_normal(s: str, collapse: bool = True) -> str:
    s = unicodedata.normalize("NFC", s).strip()
    return q_collapse(s) if collapse else s


def q_lookup(s: str) -> str:
    return q_collapse(unicodedata.normalize("NFC", s).casefold())


def q_unique(values: Iterable[str]) -> tuple[str, ...]:
    seen: dict[str, str] = {}
    for v in values:
        if v:
            seen.setdefault(v.lower(), v)
    return tuple(seen.values())


_q_found = re.compile(_FAST).findall


def q_tokens(s: str, least: int = 1) -> tuple[str, ...]:
    # Tokens have no white space, so all are folded at once as lines of one text.
    all_lines = unicodedata.normalize("NFC", "\n".join(t for t in _q_found(s) if len(t) >= least)).casefold()
    if not all_lines:
        return ()
    found = all_lines.split("\n")
    return tuple(dict.fromkeys(found)) if all_lines == all_lines.lower() else q_unique(found)


def q_quoted(s: str) -> tuple[str, ...]:
    return q_unique(q_collapse(a or b) for a, b in re.findall(QUOTED, s) if (a or b).strip())


def q_terms(s: str) -> tuple[str, ...]:
    found = [m.group().strip() for p in (ADDRESS, INTERFACE, PATH, LIST_OR_VLAN) for m in re.finditer(p, s)]
    whole = q_normal(s)
    if any(k in whole.casefold() for k in COMMANDS):
        found.append(whole)
    return q_unique([*found, *(t for t in q_tokens(s) if re.search(r"[\d./:\[\]-]", t))])
