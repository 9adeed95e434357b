"""Settings that are part of the semantics, in a local and a cloud profile."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Config:
    extract_block: int = 2000
    chunk_chars: int = 4000
    chunk_overlap: int = 400
    min_document_chars: int = 20
    max_document_bytes: int = 50 * 2**20
    max_dataset_bytes: int = 500 * 2**20
    er_top_k: int = 5
    er_cosine: float = 0.70
    er_max_group: int = 8
    er_groups_per_call: int = 15
    leiden_max_levels: int = 10
    leiden_gamma: float = 1.0
    leiden_seed: int = 42
    summary_chars: int = 12_000
    retrieval_threshold: float = 0.50
    retrieval_top_k: int = 6
    retrieval_min_top: int = 2
    retrieval_margin: float = 0.05
    retrieval_max_visits: int = 40
    context_chars: int = 30_000
    leaf_entities: int = 8
    leaf_relationships: int = 12
    source_chunks: int = 6
    excerpt_chars: int = 1500
    rerank_chars: int = 1200
    descriptions: int = 8
    description_chars: int = 800
    vector_dim: int = 1024


LOCAL = Config()
CLOUD = replace(LOCAL, er_cosine=0.85, retrieval_threshold=0.55, vector_dim=768)
