"""Named searches: a registry of DataFrame -> DataFrame plans with their configuration checked before a plan is built."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession


class UnknownName(KeyError):
    pass


class InvalidConfig(ValueError):
    def __init__(self, faults: list[tuple[str, str]]):
        super().__init__("; ".join(f"{f}: {m}" for f, m in faults))
        self.faults = faults


@dataclass(frozen=True)
class Entry:
    name: str
    kind: str
    description: str
    version: str
    config: type
    run: Callable[..., DataFrame]


ENTRIES: dict[tuple[str, str], Entry] = {}


def register(name: str, description: str, version: str, config: type, kind: str = "method"):
    def add(f: Callable[..., DataFrame]):
        if (kind, name) in ENTRIES:
            raise ValueError(f"{kind} {name} is there already")
        ENTRIES[kind, name] = Entry(name, kind, description, version, config, f)
        return f

    return add


def unregister(name: str, kind: str = "method") -> None:
    ENTRIES.pop((kind, name), None)


def get(name: str, kind: str = "method") -> Entry:
    if (kind, name) not in ENTRIES:
        raise UnknownName(f"no {kind} {name}")
    return ENTRIES[kind, name]


def listing(spark: SparkSession, kind: str | None = None) -> DataFrame:
    rows = [(e.kind, e.name, e.description, e.version, [f.name for f in fields(e.config)]) for e in sorted(ENTRIES.values(), key=lambda e: (e.kind, e.name)) if kind in (None, e.kind)]
    return spark.createDataFrame(rows, "kind string, name string, description string, version string, options array<string>")


def configured(name: str, options: dict[str, Any], kind: str = "method") -> Any:
    """The entry's configuration; all faults at once, by field."""
    entry = get(name, kind)
    known = {f.name for f in fields(entry.config)}
    faults = [(k, "unknown option") for k in options if k not in known]
    if not faults:
        try:
            return entry.config(**options)
        except InvalidConfig:
            raise
        except (TypeError, ValueError) as e:
            faults.append(("config", str(e)))
    raise InvalidConfig(faults)
