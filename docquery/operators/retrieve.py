"""Dense, keyword and hybrid retrieval and reranking, each a lazy plan over stored chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import cosine_to, min_max, reciprocal_rank, weighted_sum
from ..functions.text import contains_term, lookup, q_unique
from ..plans.config import Settings
from .filters import FilterSpec
from .index import metadata_text, postings
from .query import Query


def _sum(tests: Sequence[Column]) -> Column:
    total = F.lit(0)
    for t in tests:
        total = total + t.cast("int")
    return total


def dense(chunks: DataFrame, embedding: Sequence[float], top_k: int = 10, filters: FilterSpec = FilterSpec(), threshold: float | None = None, settings: Settings = Settings()) -> DataFrame:
    """The best chunks by cosine: filter, score, one top-k; ties go by chunk_id."""
    pool = max(top_k, settings.vector.candidate_pool_size)
    least = threshold if threshold is not None else settings.vector.score_threshold
    scored = filters.apply(chunks).withColumn("score", cosine_to(F.col("embedding"), embedding)).orderBy(F.desc("score"), "chunk_id").limit(pool)
    return (scored if least is None else scored.where(F.col("score") >= least)).orderBy(F.desc("score"), "chunk_id").limit(top_k)


def keyword(chunks: DataFrame, query: Query, top_k: int = 15, filters: FilterSpec = FilterSpec(), threshold: float | None = None, settings: Settings = Settings(), index: DataFrame | None = None, size: int | None = None) -> DataFrame:
    """The best chunks by TF-IDF with boosts for phrases, technical terms and metadata.

    ``index``: stored postings (else made on the fly), of which only the query's terms are read;
    ``size``: the number of chunks.  Frequencies are those of all chunks: filters come later.
    """
    s, terms = settings.keyword, query.terms(settings.keyword.minimum_token_length)
    index = postings(chunks, s.true_frequencies, terms) if index is None else index
    hits = index.where(F.col("term").isin(*terms)) if terms else index.where(F.lit(False))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    n = F.lit(size) if size is not None else F.col("n")
    weighed = hits.join(df, "term")  # a row for each of the query's terms: broadcast by its size
    if size is None:
        weighed = weighed.crossJoin(chunks.agg(F.count("*").alias("n")))
    idf = F.log((n + 1) / (F.col("df") + 1)) + 1.0
    scores = weighed.groupBy("chunk_id").agg(F.sum((1.0 + F.log("tf")) * idf).alias("tfidf"), F.sort_array(F.collect_set("term")).alias("matched_terms"))
    c = chunks.join(scores, "chunk_id").withColumn("_text", lookup(F.col("search_text"))).withColumn("_meta", lookup(metadata_text()))
    phrase = _sum([contains_term(F.col("_text"), p) for p in q_unique(query.phrases())])
    technical = _sum([contains_term(F.col("_text"), t) for t in query.technical_terms])
    meta = _sum([contains_term(F.col("_meta"), t) for t in (*query.tokens, *query.technical_terms)])
    c = c.withColumn("score", F.col("tfidf") + phrase * s.exact_phrase_boost + technical * s.technical_term_boost + meta * s.metadata_field_boost).drop("_text", "_meta", "tfidf")
    c = filters.apply(c)
    return (c if threshold is None else c.where(F.col("score") >= threshold)).orderBy(F.desc("score"), "chunk_id").limit(top_k)


def _profile(settings: Settings, field: str) -> Column:
    """A weight by source type, as a constant map."""
    pairs = [F.lit(x) for k, p in settings.source_profiles.items() for x in (k, float(getattr(p, field)))]
    return F.coalesce(F.create_map(*pairs)[F.col("source_type")], F.lit(float(getattr(settings.profile_for(None), field))))


def hybrid(chunks: DataFrame, query: Query, embedding: Sequence[float], top_k: int = 10, filters: FilterSpec = FilterSpec(), threshold: float | None = None, settings: Settings = Settings(), index: DataFrame | None = None, size: int | None = None) -> DataFrame:
    """Both legs' pools, joined on chunk_id and fused by profile weights: min-max sums or reciprocal ranks."""
    h = settings.hybrid
    pool = max(top_k, top_k * h.candidate_pool_multiplier)
    legs = fuse(dense(chunks, embedding, pool, filters, threshold, settings).select("chunk_id", "score"), keyword(chunks, query, pool, filters, threshold, settings, index, size).select("chunk_id", "score", "matched_terms"))
    return fused(chunks.join(legs, "chunk_id"), settings).orderBy(F.desc("score"), "chunk_id").limit(top_k)


def fuse(dense_pool: DataFrame, keyword_pool: DataFrame) -> DataFrame:
    """Full outer join of two pools (chunk_id, score[, matched_terms]) with normalised scores and ranks."""
    # Pools have at most a few times top_k rows.
    whole = Window.partitionBy()
    best = Window.orderBy(F.desc("score"), "chunk_id")
    leg = lambda df, name: df.select("chunk_id", F.col("score").alias(f"{name}_score"), min_max(F.col("score"), F.min("score").over(whole), F.max("score").over(whole)).alias(f"{name}_norm"), F.row_number().over(best).alias(f"{name}_rank"), *(c for c in df.columns if c == "matched_terms"))
    return leg(dense_pool, "dense").join(leg(keyword_pool, "keyword"), "chunk_id", "full_outer")


def fused(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``score`` and ``fused_score`` of rows with both legs' columns and a source_type."""
    h = settings.hybrid
    if h.fusion_strategy == "rrf":
        d, k = (reciprocal_rank(F.col(f"{x}_rank"), h.reciprocal_rank_constant) for x in ("dense", "keyword"))
    else:
        d, k = (F.coalesce(F.col(f"{x}_norm"), F.lit(0.0)) for x in ("dense", "keyword"))
    wd, wk = h.dense_weight * _profile(settings, "dense_weight"), h.keyword_weight * _profile(settings, "keyword_weight")
    return df.withColumn("fused_score", weighted_sum(d, k, wd, wk) / F.greatest(wd + wk, F.lit(1e-9))).withColumn("score", F.col("fused_score"))


def _one_has(values: Column, term: str) -> Column:
    return F.exists(values, lambda x: contains_term(lookup(x), term))


def rerank(candidates: DataFrame, query: Query, top_k: int = 10, settings: Settings = Settings()) -> DataFrame:
    """Candidates by fused score plus boosts for exact, technical, metadata and source-specific matches.

    Adds ``rerank_score`` and ``applied_boosts``; like fusion it sees the pool that was kept, no more.
    """
    r, q = settings.reranker, query
    c = candidates.withColumn("_text", lookup(F.coalesce("search_text", "text"))).withColumn("_meta", lookup(metadata_text()))
    base = F.coalesce(F.col("fused_score"), F.col("score")) if "fused_score" in c.columns else F.col("score")
    exact, meta_weight = 1.0 + _profile(settings, "exact_match_weight"), 1.0 + _profile(settings, "metadata_weight")
    kind = F.col("source_type")
    section = lookup(F.coalesce(F.nullif("section", F.lit("")), F.array_join(F.coalesce("structural_path", F.array().cast("array<string>")), " ")))
    path, low = F.col("json_key_path"), lookup(F.col("json_key_path"))
    targets = lookup(F.concat_ws(" ", F.nullif("cisco_feature", F.lit("")), F.nullif("cisco_section", F.lit("")), F.nullif("text", F.lit(""))))
    any_of = lambda tests: _sum(tests) > 0
    columns = F.coalesce("column_names", F.array().cast("array<string>"))
    paths = [contains_term(low, p) | F.lit(p.casefold()).contains(low) for p in q.hints.json_paths]
    boosts = [
        ("exact_phrase", _sum([contains_term(F.col("_text"), p) for p in q.phrases()]), r.exact_phrase_boost * exact),
        ("technical_match", _sum([contains_term(F.col("_text"), t) for t in q.technical_terms]), r.technical_term_boost * exact),
        ("metadata_match", _sum([contains_term(F.col("_meta"), t) for t in (*q.tokens, *q.technical_terms)]), r.metadata_match_boost * meta_weight),
        ("source_hint", kind.isin(*q.hints.preferred_source_types).cast("int") if q.hints.preferred_source_types else F.lit(0), F.lit(r.source_hint_boost)),
        ("page_match", ((kind == "pdf") & F.col("page_number").isin(*q.hints.page_numbers)).cast("int") if q.hints.page_numbers else F.lit(0), F.lit(r.page_match_boost)),
        ("section_match", (kind.isin("docx", "text", "text_file", "web") & any_of([contains_term(section, t) for t in q.hints.section_terms])).cast("int"), F.lit(r.section_match_boost)),
        ("sheet_match", ((kind == "excel") & any_of([contains_term(lookup(F.col("sheet_name")), t) for t in q.hints.sheet_names])).cast("int"), F.lit(r.sheet_match_boost)),
        ("column_match", F.when(kind == "excel", _sum([_one_has(columns, t) for t in q.tokens])).otherwise(0), F.lit(r.column_match_boost)),
        ("json_path_match", ((kind == "json") & path.isNotNull() & (path != "") & any_of(paths)).cast("int"), F.lit(r.json_path_boost)),
        ("cisco_match", F.when(kind.isin("cisco", "cisco_config"), _sum([contains_term(targets, t) for t in q.hints.cisco_terms or q.technical_terms])).otherwise(0), F.lit(r.cisco_command_boost)),
    ]
    score, labels = base, []
    for name, hits, weight in boosts:
        hits = F.coalesce(hits, F.lit(0))
        score = score + hits * weight
        labels.append(F.when(hits > 0, F.lit(name)))
    return c.withColumn("applied_boosts", F.array_compact(F.array(*labels))).withColumn("rerank_score", score).withColumn("score", F.col("rerank_score")).drop("_text", "_meta").orderBy(F.desc("score"), "chunk_id").limit(top_k)
