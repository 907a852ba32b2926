"""Settings: one frozen value, passed to what needs it."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields

_TRUE = {"1", "true", "yes", "y", "on"}


@dataclass(frozen=True)
class Settings:
    """Defaults of the retrieval pipeline. Environment variables LODESTONE_<NAME> override them in from_env()."""

    top_k: int = 4
    candidate_k: int = 30
    rrf_k: int = 60
    chunk_size: int = 1000
    chunk_overlap: int = 200
    embed_batch: int = 32
    embed_dim: int = 256
    request_timeout: int = 60
    rerank_candidates: int = 30
    rerank_top_n: int = 10
    final_context_k: int = 4
    rerank_enabled: bool = False
    mmr_enabled: bool = False
    mmr_lambda: float = 0.65
    mmr_similarity: float = 0.82
    ocr_enabled: bool = False
    ocr_cap: int = 20
    ocr_dpi: int = 150
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    simple_k: int = 2
    hash_property: str = "Content Hash"
    secrets: tuple[str, ...] = ()

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Settings:
        """Blank and unreadable values fall back to the defaults."""
        env, out = os.environ if env is None else env, {}
        for f in fields(cls):
            raw = env.get(f"LODESTONE_{f.name.upper()}", "").strip()
            if raw:
                out[f.name] = parse_setting(raw, getattr(cls, f.name))
        return cls(**out)

    def public(self) -> dict[str, object]:
        """Everything but secrets."""
        return {k: v for k, v in asdict(self).items() if k != "secrets"}


def parse_setting(raw: str, default: object) -> object:
    """A setting of the default's type: bool words, int, float, comma-separated list or text; the default if unreadable."""
    if isinstance(default, bool):
        return raw.lower() in _TRUE
    if isinstance(default, tuple):
        return tuple(x.strip() for x in raw.split(",") if x.strip())
    if isinstance(default, int | float):
        try:
            return type(default)(raw)
        except ValueError:
            return default
    return raw
