"""Named factories for everything that can be plugged in."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

KINDS = ("source", "enricher", "poller", "lookup", "sink", "backend")


class Registry:
    """Name -> factory of one kind; a name can be taken once."""

    def __init__(self, kind: str):
        self.kind = kind
        self._made: dict[str, Callable[..., Any]] = {}

    def add(self, name: str, factory: Callable[..., Any]) -> None:
        if not name:
            raise ValueError(f"a {self.kind} needs a name")
        if factory is None:
            raise ValueError(f"{self.kind} {name} has no factory")
        if name in self._made:
            raise ValueError(f"{self.kind} {name} is registered twice")
        self._made[name] = factory

    def make(self, name: str, *args: Any, **kwargs: Any) -> Any:
        if name not in self._made:
            raise KeyError(f"{self.kind} {name} is not registered; known: {', '.join(self.names()) or 'none'}")
        return self._made[name](*args, **kwargs)

    def names(self) -> list[str]:
        return sorted(self._made)


REGISTRIES = {k: Registry(k) for k in KINDS}


def register(kind: str, name: str, factory: Callable[..., Any]) -> None:
    REGISTRIES[kind].add(name, factory)
