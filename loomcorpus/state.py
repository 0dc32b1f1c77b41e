"""Sampler state: settings that must not change, and the next epoch, slot and source cursors. Kept
as one JSON file, written aside and renamed."""

from __future__ import annotations

import copy
import json
import os
from dataclasses import asdict, dataclass, field
from typing import Protocol

from .config import SplitRatios
from .errors import StateError


@dataclass
class SamplerState:
    seed: int = 42
    ratios: SplitRatios = field(default_factory=SplitRatios)
    epoch: int = 0
    next_slot: int = 0
    cursors: dict[str, int] = field(default_factory=dict)
    overrides: dict[str, str] = field(default_factory=dict)
    checksum: int | None = None

    def advance(self, slots: int, per_epoch: int) -> SamplerState:
        """After ``slots`` more; the epoch rolls over when each record was visited."""
        self.next_slot += slots
        if per_epoch > 0:
            self.epoch += self.next_slot // per_epoch
            self.next_slot %= per_epoch
        return self


class Store(Protocol):
    """Where a sampler's state is kept."""

    def load(self, seed: int | None = None, ratios: SplitRatios | None = None) -> SamplerState: ...

    def save(self, state: SamplerState, path: str | None = None) -> None: ...


def checked(state: SamplerState, seed: int | None, ratios: SplitRatios | None) -> SamplerState:
    if seed is not None and seed != state.seed or ratios is not None and ratios != state.ratios:
        raise StateError("the state belongs to another seed or other split ratios")
    return state


class MemoryStore:
    """A state kept for as long as the program runs, apart from the one that is worked with."""

    def __init__(self):
        self.kept: dict[str | None, SamplerState] = {}

    def load(self, seed: int | None = None, ratios: SplitRatios | None = None) -> SamplerState:
        if None not in self.kept:
            raise StateError("no state was saved")
        return checked(copy.deepcopy(self.kept[None]), seed, ratios)

    def save(self, state: SamplerState, path: str | None = None) -> None:
        if path and path in self.kept:
            raise StateError(f"{path} exists")
        self.kept[path] = copy.deepcopy(state)


class StateStore:
    """A state file. Another seed or other ratios than those stored are an error; a copy is saved to a
    new path only where nothing is there."""

    VERSION = 1

    def __init__(self, path: str):
        self.path = path

    def load(self, seed: int | None = None, ratios: SplitRatios | None = None) -> SamplerState:
        with open(self.path) as f:
            raw = json.load(f)
        if raw.pop("version", None) != self.VERSION:
            raise StateError("the state was written by another version")
        state = SamplerState(**{**raw, "ratios": SplitRatios(**raw["ratios"])})
        return checked(state, seed, ratios)

    def save(self, state: SamplerState, path: str | None = None) -> None:
        if path and os.path.exists(path):
            raise StateError(f"{path} exists")
        to = path or self.path
        with open(f"{to}.new", "w") as f:
            json.dump({"version": self.VERSION, **asdict(state)}, f)
        os.replace(f"{to}.new", to)
