"""Typed settings of the pipelines, read from YAML or made in code, and their grids."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, fields
from itertools import product
from pathlib import Path
from typing import Any, TypeVar

C = TypeVar("C")


@dataclass(frozen=True)
class CleanConfig:
    val_ratio: float = 0.02
    seed: int = 42
    min_question_chars: int = 2
    min_answer_chars: int = 4
    question_threshold: float = 0.96
    answer_threshold: float = 0.92
    pair_threshold: float = 0.95
    audit_limit: int = 3000


@dataclass(frozen=True)
class ClusterConfig:
    backend: str = "tfidf"  # or "dense": vectors come with the rows
    similarity: float = -1.0  # negative: the backend's own default
    neighbours: int = 25
    family_threshold: float = 0.82
    max_answers: int = 2
    max_variants: int = 4
    min_support: int = 1
    large_cluster: int = 100
    val_ratio: float = 0.02
    seed: int = 42

    def threshold(self) -> float:
        if self.backend not in ("tfidf", "dense"):
            raise ValueError(f"no such backend: {self.backend}")
        return self.similarity if self.similarity >= 0 else 0.72 if self.backend == "tfidf" else 0.83


@dataclass(frozen=True)
class PreferenceConfig:
    temperatures: tuple[float, ...] = (0.5, 0.7, 0.9)
    top_ps: tuple[float, ...] = (0.9, 0.9, 0.9)
    min_candidates: int = 2
    discard_fraction: float = 0.1
    val_ratio: float = 0.1
    seed: int = 42
    sample: int = 3000


def make(kind: type[C], values: dict[str, Any]) -> C:
    """A config from a mapping; unknown names are an error, lists become tuples."""
    known = {f.name for f in fields(kind)}
    if unknown := set(values) - known:
        raise ValueError(f"{kind.__name__} has no {', '.join(sorted(unknown))}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def load(kind: type[C], path: str) -> C:
    """A config from a YAML (or JSON, which is YAML) file; an empty file gives the defaults."""
    import yaml

    return make(kind, yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {})


def grid(base: C, **axes: list[Any]) -> list[C]:
    """The base with every combination of the given values, in order."""
    return [dataclasses.replace(base, **dict(zip(axes, combo, strict=True))) for combo in product(*axes.values())]
