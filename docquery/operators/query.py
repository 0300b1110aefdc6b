"""Analysis of one query, on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.text import COMMANDS, INTERFACE, PATH, q_collapse, q_lookup, q_normal, q_quoted, q_terms, q_tokens, q_unique
from ..plans.config import QuerySettings

EXPANSIONS = {"json": ("key path", "object field"), "xlsx": ("excel", "spreadsheet"), "ospf": ("router ospf", "open shortest path first"), "bgp": ("router bgp", "border gateway protocol"), "acl": ("access-list",)}


@dataclass(frozen=True)
class Hints:
    preferred_source_types: tuple[str, ...] = ()
    page_numbers: tuple[int, ...] = ()
    sheet_names: tuple[str, ...] = ()
    section_terms: tuple[str, ...] = ()
    json_paths: tuple[str, ...] = ()
    cisco_terms: tuple[str, ...] = ()


@dataclass(frozen=True)
class Query:
    original: str
    normalized: str
    keyword: str
    tokens: tuple[str, ...]
    technical_terms: tuple[str, ...]
    quoted_phrases: tuple[str, ...]
    expansions: tuple[str, ...]
    hints: Hints = field(default_factory=Hints)

    def phrases(self) -> list[str]:
        return [*self.quoted_phrases, *([self.normalized] if len(self.normalized.split()) > 1 else [])]

    def terms(self, least: int = 2) -> tuple[str, ...]:
        return q_unique(t for t in (*self.tokens, *map(q_lookup, self.technical_terms), *map(q_lookup, self.expansions)) if len(t) >= least)


def hints(text: str, terms: tuple[str, ...]) -> Hints:
    whole = q_normal(text)
    low = whole.casefold()
    pages = tuple(map(int, re.findall(r"\bpage\s+(\d+)\b", low)))
    named = lambda word: q_unique(map(q_collapse, re.findall(rf"(?i)\b{word}\s+([A-Za-z0-9 _-]+)\b", whole)))
    paths = q_unique(t for t in terms if re.fullmatch(PATH, t))
    network = any(k in low for k in COMMANDS) or any(re.fullmatch(INTERFACE, t) or "vlan" in t.casefold() or "acl" in t.casefold() for t in terms)
    says = lambda *words: any(w in low for w in words)
    preferred = [*(["pdf"] if pages else []), *(["excel"] if says("row", "header", "column", "sheet") else []), *(["json"] if paths or says("json", "key path") else []), *(["docx"] if says("heading", "section") else []), *(["cisco", "cisco_config"] if network else [])]
    return Hints(q_unique(preferred), pages, named("sheet"), named("section"), paths, q_unique(terms) if network else ())


def analyse(text: str, settings: QuerySettings = QuerySettings()) -> Query:
    if not text or not text.strip():
        raise ValueError("the query is empty")
    whole = q_normal(text, settings.collapse_whitespace)
    terms, tokens = q_terms(whole), q_tokens(whole, settings.minimum_token_length)
    more = q_unique(e for t in tokens for e in EXPANSIONS.get(t, ())) if settings.enable_query_expansion else ()
    quoted = q_quoted(whole) if settings.preserve_quoted_phrases else ()
    return Query(text, whole, q_lookup(whole) if settings.casefold_for_keywords else whole, tokens, terms, quoted, more, hints(whole, terms))
