"""What a table contributes to the index, and which model stages run."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class TextJoin:
    """A one-to-many text join: remote_field of table, where remote_key equals the row's local_key."""

    table: str
    local_key: str
    remote_key: str
    remote_field: str
    label: str = "related"


@dataclass(frozen=True)
class TableConfig:
    """pk names a record; text_fields are searched; display_fields are shown, the first as title.

    json_field, if set, holds the record as a JSON object and decides everything.
    """

    pk: str
    text_fields: tuple[str, ...] = ()
    display_fields: tuple[str, ...] = ()
    text_join: TextJoin | None = None
    json_field: str | None = None
    enrich: bool = False
    slug: str | None = None
    display_name: str | None = None


@dataclass(frozen=True)
class Stages:
    """Switches and limits of the stages; ``clamped`` keeps every number within its range."""

    fuzzy: bool = True
    fuzzy_floor: float = 0.90
    semantic: bool = False
    semantic_floor: float = 0.40
    dims: int = 256
    enrich: bool = False
    enrich_cap: int = 1000  # rows a sync may enrich; 0: no cap
    enrich_workers: int = 4
    embed_cap: int = 5000  # rows a sync may embed
    understand: bool = False
    understand_ms: int = 3500
    rerank: bool = False
    rerank_ms: int = 4000
    rerank_candidates: int = 15
    one_threshold: float = 0.85
    models: dict = field(default_factory=dict)

    def clamped(self) -> Stages:
        limits = {
            "fuzzy_floor": (0.5, 0.99), "semantic_floor": (0.05, 0.99), "dims": (64, 3072), "enrich_cap": (0, 1_000_000), "enrich_workers": (1, 16),
            "understand_ms": (500, 15_000), "rerank_ms": (500, 15_000), "rerank_candidates": (2, 30), "one_threshold": (0.5, 1),
        }
        return replace(self, **{k: min(max(getattr(self, k), lo), hi) for k, (lo, hi) in limits.items()})

    def ready(self, stage: str) -> str:
        """Empty if the stage can run, else why not."""
        if not getattr(self, stage):
            return "off"
        return "" if stage == "fuzzy" or self.models.get(stage) else "no model"
