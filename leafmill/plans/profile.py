"""Profiles: which implementation fills each slot, in which order, with which parameters (TOML)."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class Step:
    slot: str
    impl: str
    params: dict[str, Any]


def _scalar(text: str) -> Any:
    try:
        return tomllib.loads(f"v = {text}")["v"]
    except tomllib.TOMLDecodeError:
        return text


def parse(text: str, overrides: list[str] = ()) -> list[Step]:
    """Steps of a profile: ``[pipeline] stages = [...]`` and for each slot ``[stage.SLOT] impl, params``.

    overrides: ``SLOT.KEY=VALUE``, values read as TOML scalars, else as strings; ``SLOT.impl=NAME`` changes the implementation.
    A slot may stand in the order twice.  A slot without implementation raises.
    """
    data = tomllib.loads(text)
    found = data.get("stage", {})
    for o in overrides:
        name, eq, value = o.partition("=")
        slot, dot, key = name.partition(".")
        if not (eq and dot and key):
            raise ValueError(f"override {o!r} is not SLOT.KEY=VALUE")
        own = found.setdefault(slot, {})
        (own if key == "impl" else own.setdefault("params", {}))[key] = _scalar(value)
    steps = []
    for slot in data["pipeline"]["stages"]:
        if "impl" not in found.get(slot, {}):
            raise ValueError(f"slot {slot} has no implementation")
        steps.append(Step(slot, found[slot]["impl"], dict(found[slot].get("params", {}))))
    return steps


def load(path: str, overrides: list[str] = ()) -> list[Step]:
    return parse(Path(path).read_text(encoding="utf-8"), overrides)
