"""Domain classification by weighted signals, as one projection, and routing of queries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collapse, fold

GENERAL = "general"
SPECIALISTS = ("legal", "medical", "cisco")
DOMAINS = (GENERAL, *SPECIALISTS)
PREVIEW = 20_000
_M = "(?im)"


@dataclass(frozen=True)
class Signals:
    """What speaks for a domain: terms as words of one string, separated by bars, and patterns."""

    names: str
    fields: str
    words: str
    strong: tuple[str, ...]
    layout: tuple[str, ...]


SIGNALS = {
    "legal": Signals(
        "affidavit|agreement|complaint|contract|deed|hipoteca|lease|legal|mortgage|nda|policy|terms",
        "article|clause|counterparty|effective date|governing law|jurisdiction|parties|party|section",
        "agreement|arrendamiento|breach|clause|confidentiality|contrato|defendant|escritura|governing law|hereby|herein|hereto|hipoteca|indemnify|liability|notary|plaintiff|pursuant to|termination|whereas",
        (r"(?i)\bgoverning law\b", r"(?i)\bwhereas\b", r"(?i)\bpart(?:y|ies)\b.{0,30}\bshall\b", r"(?i)\bthis (?:lease|contract|agreement)\b"),
        (_M + r"^\s*in witness whereof\b", r"(?m)^\s*\d+\.\d+\s+[A-Z].+$", _M + r"^\s*(?:clause|section|article)\s+\d+"),
    ),
    "medical": Signals(
        "clinical|diagnosis|discharge|hospital|lab|medical|medication|nursing|patient|prescription|radiology|soap",
        "allergies|assessment|chief complaint|diagnosis|encounter|medications|plan|vitals",
        "allergies|assessment|blood pressure|chief complaint|diagnosis|dosage|exam|follow-up|heart rate|history of present illness|impression|medication|patient|plan|prescribed|symptoms|treatment|vital signs",
        (r"(?i)\b(?:ml|mg|mcg|kg|lb|bpm|mmhg|celsius|fahrenheit)\b", r"(?i)\bassessment and plan\b", r"(?i)\bchief complaint\b", r"(?i)\bhistory of present illness\b"),
        (_M + r"^\s*(?:dob|mrn|patient)\s*[:=]", _M + r"^\s*(?:spo2|temp|bp|hr|rr)\s*[:=]", _M + r"^\s*(?:diagnosis|medications|allergies|assessment|plan):"),
    ),
    "cisco": Signals(
        "asa|cisco|config|ios|iosxe|network|router|switch|vlan|wireless|wlc",
        "access-list|class-map|interface|policy-map|router|switchport|wireless",
        "class-map|controller|hostname|interface|ip access-list|line vty|policy-map|router bgp|router ospf|service-policy|snmp-server|spanning-tree|ssid|switchport|vlan|wlan",
        (_M + r"^\s*line\s+vty\b", _M + r"^\s*switchport\s+", _M + r"^\s*router\s+(?:eigrp|ospf|bgp)\b", _M + r"^\s*interface\s+\S+"),
        (_M + r"^\s*wireless\b", _M + r"^\s*snmp-server\s+", _M + r"^\s*ip\s+access-list\s+", r"(?i)\b(?:Vlan|Port-channel|(?:Fast|(?:Ten)?Gigabit)Ethernet)\S*\b"),
    ),
}

PRIORS: dict[str, dict[str, float]] = {
    "config": {"cisco": 4.25}, "cisco_config": {"cisco": 4.75}, "cisco": {"cisco": 4.5},
    "json": {"cisco": 0.35, "medical": 0.3, "legal": 0.2}, "excel": {"cisco": 0.15, "medical": 0.35, "legal": 0.25},
    **{t: {"cisco": 0.2, "medical": 0.2, "legal": 0.2} for t in ("text", "text_file")}, **{t: {"medical": 0.45, "legal": 0.45} for t in ("docx", "pdf")},
}


#: By a part of a pattern the words of which one is in every lowered text that it matches.
_NEEDED = (
    *((w, (w,)) for w in ("governing law", "whereas", "whereof", "assessment and plan", "chief complaint", "history of present illness", "vty", "switchport", "interface")),
    ("shall", ("shall",)), ("this (?:", ("this lease", "this contract", "this agreement")), ("Port-channel", ("vlan", "port-channel", "ethernet")),
)


def _count(tests: Sequence[Column]) -> Column:
    total = F.lit(0)
    for t in tests:
        total = total + F.coalesce(t, F.lit(False)).cast("int")
    return total


def classify(docs: DataFrame, content: str = "content", source_type: Column | None = None, file_name: Column | None = None, metadata: Column | None = None, target: str = "document") -> DataFrame:
    """``docs`` with domain, domain_confidence, domain_reason and domain_scores (struct of the four domains).

    ``metadata`` is the text of keys and values; terms match anywhere, also within words.
    """
    kind = collapse(fold(F.coalesce(source_type, F.lit("")))) if source_type is not None else F.lit("")
    text = F.substring(F.col(content), 1, PREVIEW)
    low, name, meta = collapse(fold(text)), collapse(fold(F.coalesce(file_name, F.lit("")))) if file_name is not None else None, collapse(fold(F.coalesce(metadata, F.lit("")))) if metadata is not None else None
    out = docs.withColumn("_low", low).withColumn("_text", text)
    # Patterns are looked for where their words are; letters that fold to others by case alone aren't in the lowered text as these.
    odd = F.col("_low").rlike("[\u017f\u0131\u0307\u212a]")

    def matches(p: str) -> Column:
        hit = F.col("_text").rlike((r"(?iU)(?=[bcfklm])" if "mmhg" in p else "(?U)") + p)
        there = F.lit(False)
        for w in next((words for part, words in _NEEDED if part in p), ()):
            there = there | F.col("_low").contains(w)
        return (there | odd) & hit if any(part in p for part, _ in _NEEDED) else hit

    for d in SPECIALISTS:
        s = SIGNALS[d]
        prior = F.coalesce(F.create_map(*(F.lit(x) for t, p in PRIORS.items() if d in p for x in (t, p[d])))[kind], F.lit(0.0))
        hits = lambda c, terms: _count([c.contains(t) for t in terms.split("|")])
        zero = F.lit(0)
        counts = F.struct(
            prior.alias("prior"),
            (zero if name is None else hits(name, s.names)).alias("name"),
            (zero if meta is None else hits(meta, s.fields)).alias("meta"),
            hits(F.col("_low"), s.words).alias("words"),
            _count([matches(p) for p in s.strong]).alias("strong"),
            _count([matches(p) for p in s.layout]).alias("layout"),
        )
        out = out.withColumn(f"_{d}", counts)
    capped = lambda n, base, each, most: F.when(n > 0, F.least(F.lit(most), F.lit(base) + each * n)).otherwise(0.0)
    parts: dict[str, list[tuple[Column, str]]] = {}
    for d in SPECIALISTS:
        c = F.col(f"_{d}")
        parts[d] = [(c["prior"], "source type"), (capped(c["name"], 1.10, 0.45, 2.4), "file name"), (capped(c["meta"], 0.80, 0.35, 2.2), "metadata"), (capped(c["words"], 0.55, 0.28, 3.2), "content"), (1.40 * c["strong"], f"{target} structure"), (F.least(F.lit(2.4), 0.85 * c["layout"]), f"{target} layout")]
        score = F.lit(0.25)
        for w, _ in parts[d]:
            score = score + w
        out = out.withColumn(f"_{d}_score", score)
    score = {d: F.col(f"_{d}_score") for d in SPECIALISTS}
    top = F.when((score["legal"] >= score["medical"]) & (score["legal"] >= score["cisco"]), "legal").when(score["medical"] >= score["cisco"], "medical").otherwise("cisco")
    by_top = lambda values: F.when(F.col("_top") == "legal", values["legal"]).when(F.col("_top") == "medical", values["medical"]).otherwise(values["cisco"])
    out = out.withColumn("_top", top).withColumn("_best", F.greatest(*score.values())).withColumn("_total", 1.0 + score["legal"] + score["medical"] + score["cisco"])
    second = F.sort_array(F.array(*score.values()), asc=False)[1]
    evidence = by_top({d: _count([w > 0 for w, _ in parts[d][1:]]) for d in SPECIALISTS})
    signal, margin = F.col("_best") - 0.25, F.col("_best") - second
    mode = F.when(F.col("_best") <= 1.0, "baseline").when((signal < 1.05) & (evidence < 2), "weak").when((margin < 0.35) & (signal < 1.80), "ambiguous").otherwise("specialist")
    out = out.withColumn("_mode", mode)
    share = 1.0 / F.col("_total")
    confidence = F.when(F.col("_mode") == "baseline", F.greatest(share, F.lit(0.58))).when(F.col("_mode") == "weak", F.greatest(share, F.lit(0.56))).when(F.col("_mode") == "ambiguous", F.greatest(share, F.lit(0.54))).otherwise(F.col("_best") / F.col("_total"))
    ranked = lambda d: F.transform(F.slice(F.sort_array(F.filter(F.array(*(F.struct(w.cast("double").alias("w"), F.lit(-i).alias("i"), F.lit(t).alias("t")) for i, (w, t) in enumerate(parts[d]))), lambda x: x["w"] > 0), asc=False), 1, 3), lambda x: F.concat(x["t"], F.format_string(" %.2f", x["w"])))
    detail = F.array_join(by_top({d: ranked(d) for d in SPECIALISTS}), ", ")
    domain = F.when(F.col("_mode") == "specialist", F.col("_top")).otherwise(GENERAL)
    reason = F.when(detail == "", F.lit("general: no specialist signal")).otherwise(F.format_string("%s (%s): %s %.2f of %.2f from %s", domain, F.col("_mode"), F.col("_top"), F.col("_best"), F.col("_total"), detail))
    out = out.withColumn("domain", domain).withColumn("domain_confidence", F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence))).withColumn("domain_reason", reason)
    out = out.withColumn("domain_scores", F.struct(F.lit(1.0).alias(GENERAL), *(F.round(score[d], 4).alias(d) for d in SPECIALISTS)))
    return out.drop("_low", "_text", "_top", "_best", "_total", "_mode", *(f"_{d}" for d in SPECIALISTS), *(f"_{d}_score" for d in SPECIALISTS))


def metadata_blob(metadata: Column) -> Column:
    """Keys and values of a map as text."""
    return F.array_join(F.transform(F.filter(F.map_entries(metadata), lambda e: e["value"].isNotNull()), lambda e: F.concat_ws(" ", e["key"], e["value"])), " ")


def classify_queries(queries: DataFrame, text: str = "text", available: Sequence[str] = ()) -> DataFrame:
    meta = F.lit("available_domains " + " ".join(available)) if available else None
    return classify(queries, text, F.lit("query"), None, meta, "query")


def domain_counts(chunks: DataFrame) -> DataFrame:
    """Indexed documents by domain."""
    return chunks.groupBy("domain").agg(F.count_distinct("document_id").alias("documents"))


def route(queries: DataFrame, counts: Mapping[str, int], text: str = "text", manual: str | None = None, threshold: float = 0.52) -> DataFrame:
    """Adds domain, domain_confidence, mode, filter_applied: whether retrieval keeps to the domain's documents."""
    if manual is not None and manual not in DOMAINS:
        raise ValueError(f"unknown domain {manual!r}; known are {', '.join(DOMAINS)}")
    if manual:
        return queries.withColumn("domain", F.lit(manual)).withColumn("domain_confidence", F.lit(1.0)).withColumn("domain_reason", F.lit("chosen by the user")).withColumn("mode", F.lit("manual")).withColumn("filter_applied", F.lit(True))
    there = sorted(d for d, n in counts.items() if d in DOMAINS and n > 0)
    q = classify_queries(queries, text, there)
    indexed = F.col("domain").isin(there) if there else F.lit(True)
    sure = F.col("domain_confidence") >= threshold
    only = sure & indexed if len(there) == 1 else F.lit(False)
    return q.withColumn("mode", F.lit("automatic")).withColumn("filter_applied", sure & indexed).withColumn("domain_confidence", F.when(only, F.greatest(F.col("domain_confidence"), F.lit(0.85))).otherwise(F.col("domain_confidence")))


#: How an answer is to be worded, by domain: (about the context, about the response).
PROMPTS = {
    GENERAL: ("The passages are of no special field.", "Write plainly; say so where the passages leave something open."),
    "legal": ("The passages are legal texts: keep clauses, parties, dates and exceptions as they stand.", "Stay with the wording of what you cite; draw no conclusion that the texts don't carry."),
    "medical": ("The passages are medical records: keep findings, doses, units and dates as they stand.", "Tell what is recorded from what is inferred; where a diagnosis isn't supported, say so."),
    "cisco": ("The passages are network configurations: keep commands, interfaces and indentation as they stand.", "Show configuration as code and change no command."),
}


def prompts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d, *p) for d, p in PROMPTS.items()], "domain string, about_context string, about_response string")


def network_text(file_name: Column, content: Column) -> Column:
    """Whether a .txt file is a network configuration, by its name or the first 8000 characters."""
    named = _count([fold(file_name).contains(t) for t in ("config", "firewall", "switch", "router", "cisco")]) > 0
    head = F.substring(content, 1, 8000)
    return named | head.rlike(r"(?Uim)^\s*(?:(?:hostname|interface|router)\s+\S+|line\s+vty\b|ip\s+access-list\s+)")


