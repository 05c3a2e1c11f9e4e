"""Settings with their defaults; each can be given per call, or by an environment variable TESSERA_<NAME> that is set
before the package is imported."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    # Names of hosted and published models are fixed values.
    llm_model: str = "openai/gpt-oss-120b"
    fallback_models: tuple[str, ...] = ("openai/gpt-oss-20b", "qwen/qwen3.8-27b")
    reasoning_effort: str = "low"
    embed_model: str = "all-MiniLM-L6-v2"
    nli_model: str = "cross-encoder/nli-deberta-v3-small"
    chunk_tokens: int = 350
    overlap_tokens: int = 60
    top_k: int = 4
    min_similarity: float = 0.15
    nli_threshold: float = 0.5
    nli_window: int = 3
    embed_dim: int = 512

    @property
    def models(self) -> tuple[str, ...]:
        """The model and those that take its place, in order."""
        return (self.llm_model, *self.fallback_models)

    @classmethod
    def from_env(cls) -> Settings:
        """Read when called, so a later change of the environment has effect."""
        found = {}
        for f in fields(cls):
            if (raw := os.environ.get(f"TESSERA_{f.name.upper()}")) is not None:
                kind = type(f.default)
                found[f.name] = tuple(x for x in raw.split(",") if x) if kind is tuple else kind(raw)
        return cls(**found)


DEFAULTS = Settings.from_env()
