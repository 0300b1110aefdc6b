"""Settings of retrieval, with per-source-type profiles merged over the defaults."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields
from typing import Any


@dataclass(frozen=True)
class Profile:
    """Weights of one source type, in hybrid fusion and in reranking."""

    keyword_weight: float
    dense_weight: float
    exact_match_weight: float
    metadata_weight: float


def _profiles() -> dict[str, Profile]:
    prose, config = Profile(0.15, 0.85, 0.10, 0.15), Profile(0.75, 0.25, 0.45, 0.55)
    return {"cisco": config, "cisco_config": config, "default": Profile(0.40, 0.60, 0.20, 0.25), "docx": Profile(0.30, 0.70, 0.20, 0.30), "excel": Profile(0.55, 0.45, 0.32, 0.42), "json": Profile(0.65, 0.35, 0.36, 0.48), "pdf": Profile(0.25, 0.75, 0.18, 0.25), "text": prose, "text_file": prose, "web": Profile(0.28, 0.72, 0.18, 0.22)}


@dataclass(frozen=True)
class QuerySettings:
    minimum_token_length: int = 2
    preserve_quoted_phrases: bool = True
    enable_query_expansion: bool = False
    casefold_for_keywords: bool = True
    collapse_whitespace: bool = True


@dataclass(frozen=True)
class DenseSettings:
    candidate_pool_size: int = 40
    top_k: int = 10
    score_threshold: float | None = None
    similarity_metric: str = "cosine"


@dataclass(frozen=True)
class KeywordSettings:
    minimum_token_length: int = 2
    metadata_field_boost: float = 0.8
    technical_term_boost: float = 1.4
    exact_phrase_boost: float = 2.5
    top_k: int = 15
    enabled: bool = True
    #: True: weigh a term by how often it occurs; the default counts it once, as tokens are distinct.
    true_frequencies: bool = False


@dataclass(frozen=True)
class HybridSettings:
    candidate_pool_multiplier: int = 4
    reciprocal_rank_constant: int = 60
    fusion_strategy: str = "weighted_sum"
    keyword_weight: float = 0.35
    dense_weight: float = 0.65
    enabled: bool = True


@dataclass(frozen=True)
class RerankSettings:
    cisco_command_boost: float = 0.40
    json_path_boost: float = 0.35
    sheet_match_boost: float = 0.30
    page_match_boost: float = 0.28
    section_match_boost: float = 0.22
    source_hint_boost: float = 0.20
    column_match_boost: float = 0.18
    technical_term_boost: float = 0.18
    metadata_match_boost: float = 0.15
    exact_phrase_boost: float = 0.70
    enabled: bool = True


@dataclass(frozen=True)
class ObservabilitySettings:
    debug: bool = False
    log_level: str = "INFO"
    logger_name: str = "docquery"


@dataclass(frozen=True)
class Settings:
    retrieval_mode: str = "hybrid"
    query_processing: QuerySettings = QuerySettings()
    vector: DenseSettings = DenseSettings()
    keyword: KeywordSettings = KeywordSettings()
    hybrid: HybridSettings = HybridSettings()
    reranker: RerankSettings = RerankSettings()
    observability: ObservabilitySettings = ObservabilitySettings()
    source_profiles: Mapping[str, Profile] = field(default_factory=_profiles)

    def profile_for(self, source_type: str | None) -> Profile:
        return self.source_profiles.get(source_type or "", self.source_profiles["default"])

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    @classmethod
    def from_dict(cls, given: Mapping[str, Any]) -> "Settings":
        parts: dict[str, Any] = {}
        for f in fields(cls):
            if f.name == "source_profiles":
                parts[f.name] = _profiles() | {k: Profile(**v) for k, v in given.get(f.name, {}).items()}
            elif f.name in given:
                parts[f.name] = given[f.name] if f.name == "retrieval_mode" else type(f.default)(**given[f.name])
        return cls(**parts)

    @classmethod
    def from_json_file(cls, path: str) -> "Settings":
        with open(path, encoding="utf-8") as f:
            return cls.from_dict(json.load(f))
