"""Requests, states and what is kept between them."""

from __future__ import annotations

import json
import os
import re
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Any

from vecshift.operators.migrate import POLICIES
from vecshift.operators.selection import WEIGHTS

# The states in order. FAILED can follow any of them.
STATES = ("INIT", "CONNECT", "DISCOVER", "NORMALIZE", "COMPARE", "PLAN", "DRY_RUN", "BENCHMARK", "APPROVAL", "MIGRATE", "CDC_SYNC", "VERIFY", "CUTOVER", "COMPLETE")
FAILED = "FAILED"


@dataclass(frozen=True)
class Request:
    migration_id: str
    source_provider: str
    source_resource: str
    target_provider: str
    target_resource: str
    source_endpoint: str | None = None
    target_endpoint: str | None = None
    source_credential: str | None = None
    target_credential: str | None = None
    namespace: str | None = None
    target_dimension: int | None = None
    minimum_recall: float = 0.80
    minimum_ndcg: float = 0.90
    maximum_overlap_drop: float = 0.15
    id_collision_policy: str = "fail"
    resume: bool = False
    document_field: str | None = None
    embedding_provider: str | None = None
    embedding_model: str | None = None
    #: Weights of the measures by which the strategy is chosen (``selection.WEIGHTS`` where not given).
    weights: dict | None = None
    #: The most by which searches may become slower, in per cent; not gated if null, as short runs on a sample are noisy.
    maximum_latency_percent: float | None = None
    #: Records copied at a time, each page a batch with its own cursor; null for the whole collection in one batch.
    page_records: int | None = None
    #: Whether the chosen strategy waits for ``Migration.approve``.
    needs_approval: bool = False
    verification_blocks: bool = True

    def __post_init__(self):
        if self.id_collision_policy not in POLICIES:
            raise ValueError(f"id_collision_policy must be one of {POLICIES}")
        if self.page_records is not None and self.page_records < 1:
            raise ValueError("page_records must be positive")
        if unknown := set(self.weights or ()) - set(WEIGHTS):
            raise ValueError(f"no measures: {sorted(unknown)}")


@dataclass
class Result:
    migration_id: str
    state: str
    status: str
    summary: str = ""
    report: dict = field(default_factory=dict)


class Checkpoints:
    """A small JSON file per migration: facts and history. Samples, results and ledgers are tables beside it."""

    def __init__(self, folder: str | os.PathLike):
        self.folder = Path(folder)

    def path(self, migration_id: str) -> Path:
        return self.folder / (re.sub(r"[^\w-]", "_", migration_id) + ".json")

    def save(self, migration_id: str, state: dict) -> Path:
        """Replaces the file at once, readable by its owner only."""
        self.folder.mkdir(parents=True, exist_ok=True)
        path = self.path(migration_id)
        part = path.with_suffix(".part")
        with os.fdopen(os.open(part, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w", encoding="utf-8") as file:
            json.dump(state, file, default=str, ensure_ascii=False)
        part.replace(path)
        return path

    def load(self, migration_id: str) -> dict | None:
        path = self.path(migration_id)
        return json.loads(path.read_text(encoding="utf-8")) if path.exists() else None

    def all(self) -> list[str]:
        return sorted(json.loads(p.read_text(encoding="utf-8"))["request"]["migration_id"] for p in self.folder.glob("*.json")) if self.folder.exists() else []

    def delete(self, migration_id: str) -> None:
        self.path(migration_id).unlink(missing_ok=True)


def start(request: Request, checkpoints: Checkpoints) -> dict:
    """The state to go on from: the kept one if the request resumes, else a fresh one."""
    kept = checkpoints.load(request.migration_id) if request.resume else None
    return kept or {"request": asdict(request), "next_state": "CONNECT", "history": []}


def record(state: dict, name: str, detail: Any, following: str) -> None:
    """Append to the history; ``following`` is where a resumed migration goes on."""
    state["history"].append({"state": name, "detail": detail})
    state["next_state"] = following
