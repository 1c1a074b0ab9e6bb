"""Stages: named implementations of a slot, each a pure function from a DataFrame to a DataFrame with declared parameters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Stage:
    slot: str
    impl: str
    run: Callable[..., DataFrame]
    defaults: dict[str, Any] = field(default_factory=dict)

    def bind(self, params: dict[str, Any]) -> Callable[[DataFrame], DataFrame]:
        """The stage with its parameters; ones it does not declare raise."""
        unknown = sorted(set(params) - set(self.defaults))
        if unknown:
            raise ValueError(f"{self.slot}.{self.impl} has no parameter {', '.join(unknown)}; it has {', '.join(sorted(self.defaults)) or 'none'}")
        return lambda df: self.run(df, **(self.defaults | params))


_STAGES: dict[tuple[str, str], Stage] = {}


def stage(slot: str, impl: str, **defaults: Any):
    """Register a function (df, **params) under its slot; a name can be taken once."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if (slot, impl) in _STAGES:
            raise ValueError(f"{slot}.{impl} is registered twice")
        _STAGES[slot, impl] = Stage(slot, impl, f, defaults)
        return f

    return add


def find(slot: str, impl: str) -> Stage:
    if (slot, impl) not in _STAGES:
        own = sorted(i for s, i in _STAGES if s == slot)
        raise KeyError(f"no stage {slot}.{impl}; " + (f"{slot} has {', '.join(own)}" if own else f"slots are {', '.join(sorted({s for s, _ in _STAGES})) or 'none'}"))
    return _STAGES[slot, impl]


def listing(spark: SparkSession) -> DataFrame:
    """(slot, impl, params): all that is registered."""
    rows = [(s.slot, s.impl, {k: repr(v) for k, v in s.defaults.items()}) for s in _STAGES.values()]
    return spark.createDataFrame(rows, "slot string, impl string, params map<string,string>")
