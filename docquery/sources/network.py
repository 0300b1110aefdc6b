"""Network configurations: sections under marker lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import strip

SECTIONS = ("access-list", "bgp", "class-map", "eigrp", "interface", "ip route", "isis", "line", "ospf", "policy-map", "rip", "route-map", "router", "service-policy", "vlan")


def begins(line: Column) -> Column:
    low = F.lower(strip(line))
    test = F.lit(False)
    for s in SECTIONS:
        test = test | low.startswith(s)
    return test


def sections(docs: DataFrame, key: str = "document_id", text: str = "content") -> DataFrame:
    """(key, ord, name, body): names are a head's first 50 characters; of equal names the last body counts, at the first's place."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("i", "t")).withColumn("b", begins(F.col("t")))
    order = Window.partitionBy(key).orderBy("i")
    lines = lines.withColumn("k", F.sum(F.col("b").cast("int")).over(order))
    joined = lines.groupBy(key, "k").agg(F.coalesce(F.max(F.when(F.col("b"), F.substring(strip(F.col("t")), 1, 50))), F.lit("general")).alias("name"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]), "\n").alias("body"))
    return joined.groupBy(key, "name").agg(F.min("k").alias("ord"), F.max_by("body", "k").alias("body"))


def marked(sections: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, content): sections with marker lines, in order."""
    part = F.concat(F.lit("\n--- Cisco Section: "), "name", F.lit(" ---\n\n"), "body")
    return sections.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", part.alias("part")))), lambda x: x["part"]), "\n").alias("content"))
