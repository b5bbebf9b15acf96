"""All parameters of the engine with their defaults; environment and file override them."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    chunk_size: int = 1000
    chunk_overlap: int = 200
    similarity_threshold: float = 0.85
    confidence_threshold: float = 0.5
    proximity: int = 50
    pair_batch: int = 10
    search_limit: int = 10
    alpha: float = 0.5
    ego_depth: int = 2
    ego_nodes: int = 50
    path_depth: int = 3
    entity_limit: int = 100
    extraction_chars: int = 0  # 0: whole texts
    embedding_chars: int = 8_000
    case_sensitive: bool = False
    store: str = "knotwork-store"

    @staticmethod
    def load(path: str | None = None, prefix: str = "KNOTWORK_") -> Config:
        """Defaults, overridden by environment variables, overridden by a JSON file."""
        values: dict = {}
        for f in fields(Config):
            raw = os.environ.get(prefix + f.name.upper())
            if raw is not None:
                kind = type(f.default)
                values[f.name] = raw.lower() in ("1", "true", "yes") if kind is bool else kind(raw)
        if path and os.path.exists(path):
            with open(path, encoding="utf-8") as src:
                known = {f.name for f in fields(Config)}
                values |= {k: v for k, v in json.load(src).items() if k in known}
        return Config(**values)

    def set(self, **values) -> Config:
        return replace(self, **values)

    def get(self, name: str, default=None):
        return getattr(self, name, default)

    def as_dict(self) -> dict:
        return asdict(self)

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as out:
            json.dump(self.as_dict(), out, indent=2)
