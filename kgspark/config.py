"""Parameters of the pipelines, and how settings override them."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any


@dataclass(frozen=True)
class Construction:
    mode: str = "agent"  # or noagent
    chunk_size: int = 1000
    overlap: int = 200


@dataclass(frozen=True)
class Communities:
    struct_weight: float = 0.3
    merge_threshold: float = 0.5
    max_iter: int = 1
    max_merged: int = 100
    min_similarity: float = 0.5
    keywords: int = 5
    members_shown: int = 10
    batch: int = 5
    seed: int = 42


@dataclass(frozen=True)
class TailDedup:
    method: str = "embedding"
    threshold: float = 0.85
    batch: int = 8
    max_candidates: int = 50
    cluster_batch: int = 30
    contexts: int = 10
    context_chars: int = 5000


@dataclass(frozen=True)
class HeadDedup:
    similarity: float = 0.85
    prefilter: float = 0.75
    max_pairs: int = 1000
    relations_in_context: int = 10
    review: tuple[float, float] = (0.70, 0.90)
    alias_relation: str = "等同于"


@dataclass(frozen=True)
class Retrieval:
    top_k: int = 20
    top_k_filter: int = 20
    recall_paths: int = 2
    node_k: int = 50
    node_score: float = 0.05
    triple_score: float = 0.05
    neighbour_score: float = 0.1
    relevance: float = 0.1
    postings_cap: int = 50
    keyword_nodes_cap: int = 200
    path_depth: int = 2
    hops: int = 3
    relation_bonus: float = 0.1


@dataclass(frozen=True)
class Agent:
    max_steps: int = 5
    answer_retries: int = 20
    temperature: float = 0.3
    concurrency: int = 10


@dataclass(frozen=True)
class Settings:
    construction: Construction = field(default_factory=Construction)
    communities: Communities = field(default_factory=Communities)
    tail_dedup: TailDedup = field(default_factory=TailDedup)
    head_dedup: HeadDedup = field(default_factory=HeadDedup)
    retrieval: Retrieval = field(default_factory=Retrieval)
    agent: Agent = field(default_factory=Agent)
    language_threshold: float = 0.8
    vector_dim: int = 384
    prompts: dict[str, Any] = field(default_factory=dict)

    def validate(self) -> Settings:
        if self.construction.mode not in ("agent", "noagent"):
            raise ValueError("construction.mode is agent or noagent")
        if self.retrieval.top_k <= 0:
            raise ValueError("retrieval.top_k must be positive")
        if not 0 <= self.communities.struct_weight <= 1:
            raise ValueError("communities.struct_weight lies between 0 and 1")
        return self

    def prompt(self, kind: str, name: str) -> str:
        try:
            return self.prompts[kind][name]
        except KeyError:
            raise ValueError(f"no prompt {kind}.{name}") from None


def override(base: Any, changes: dict[str, Any]) -> Any:
    """A copy with nested changes, validated; unknown names are refused."""
    known = {f.name for f in fields(base)}
    if extra := set(changes) - known:
        raise ValueError(f"unknown settings: {sorted(extra)}")
    new = {k: override(getattr(base, k), v) if is_dataclass(getattr(base, k)) else v for k, v in changes.items()}
    out = replace(base, **new)
    return out.validate() if isinstance(out, Settings) else out
