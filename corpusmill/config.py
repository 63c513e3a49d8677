"""Settings of a corpus: defaults, a JSON file, environment variables, in that order; checked as they are set."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, fields, replace

#: Variables with this prefix and a setting's name in capitals override the file.
ENVIRONMENT = "CORPUSMILL_"


@dataclass(frozen=True)
class Config:
    """All settings; sizes are in estimated tokens."""

    embedding_model: str = "deterministic-hash-256"
    query_prefix: str = ""
    document_prefix: str = ""
    prefixes_off: bool = False
    chunk_size: int = 512
    chunk_overlap: int = 50
    chunk_least: int = 50
    pool_size: int = 60
    default_k: int = 5
    most_k: int = 100
    rrf_k: int = 60
    near_bits: int = 3
    suspicious: float = 0.40
    quarantine: float = 0.70
    redacting: bool = False
    adaptive: bool = False
    retry: bool = False
    cached_results: int = 256
    cached_vectors: int = 512
    watch_interval: str = "60 seconds"
    #: Index the document's title and the chunk's headings too, which count three and two times.
    field_weights: bool = False

    def __post_init__(self) -> None:
        wrong = [f.name for f in fields(self) if f.type == "int" and getattr(self, f.name) < 0]
        if wrong or not 0 <= self.suspicious <= self.quarantine <= 1 or self.chunk_size < 1 or self.near_bits > 16:
            raise ValueError(f"settings out of range: {wrong or 'thresholds, chunk_size or near_bits'}")

    def set(self, name: str, value: str) -> Config:
        """A copy with one setting given as text."""
        kinds = {f.name: f.type for f in fields(self)}
        if name not in kinds:
            raise KeyError(name)
        parsed = value.strip().lower() in ("1", "true", "yes", "on") if kinds[name] == "bool" else {"int": int, "float": float, "str": str}[kinds[name]](value)
        return replace(self, **{name: parsed})

    def get(self, name: str) -> object:
        return asdict(self)[name]

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as file:
            json.dump(asdict(self), file, indent=1)


def load(path: str | None = None, environment: dict[str, str] | None = None) -> Config:
    """Settings from a file, where there is one, and the environment. Unknown names in the file are an error."""
    given = {}
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as file:
            given = json.load(file)
    config = Config(**given)
    for name, value in (os.environ if environment is None else environment).items():
        if name.startswith(ENVIRONMENT):
            config = config.set(name.removeprefix(ENVIRONMENT).lower(), value)
    return config
