"""Semantic knobs of retrieval, with their defaults, and partial overrides."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any


@dataclass(frozen=True)
class LayerWeighting:
    enabled: bool = True
    boost: float = 0.6


@dataclass(frozen=True)
class Config:
    """Defaults that results depend on."""

    top_n: int = 8
    graph_hops: int = 2
    max_expand: int = 10
    adjacency_bonus: float = 0.4
    rrf_k: float = 60.0
    symbol_match_bonus: float = 3.0
    k1: float = 1.5
    b: float = 0.75
    search_rows: int = 80
    attach_rows: int = 40
    symbols_per_file: int = 6
    forced_exact: int = 5
    whole_file_lines: int = 50
    symbol_hits: int = 200
    scan_hits: int = 8
    candidate_ids: int = 20
    arch_files: int = 20_000
    include: tuple[str, ...] = ("**/*.ts", "**/*.tsx")
    exclude: tuple[str, ...] = ("**/node_modules/**", "**/dist/**", "**/build/**", "**/*.d.ts", "**/.tessera/**")
    package_weights: dict[str, float] = field(default_factory=dict)
    layers: LayerWeighting = LayerWeighting()
    embedding_model: str = "hashing-64"
    index_dir: str = ".tessera"

    def merged(self, partial: dict[str, Any]) -> Config:
        """This configuration with the keys of ``partial`` laid over it; nested
        objects are merged, unknown keys are refused."""
        return _merge(self, partial)

    @staticmethod
    def load(path: str) -> Config:
        with open(path, encoding="utf-8") as f:
            return Config().merged(json.load(f))


def _merge(base: Any, partial: dict[str, Any]) -> Any:
    known = {f.name for f in fields(base)}
    if unknown := sorted(partial.keys() - known):
        raise ValueError(f"unknown configuration keys: {', '.join(unknown)}")
    changes = {}
    for name, value in partial.items():
        old = getattr(base, name)
        if is_dataclass(old):
            value = _merge(old, value)
        elif isinstance(old, dict):
            value = {**old, **value}
        elif isinstance(old, tuple):
            value = tuple(value)
        changes[name] = value
    return replace(base, **changes)
