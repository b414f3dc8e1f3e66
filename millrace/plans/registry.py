"""Named factories with aliases."""

from __future__ import annotations

import difflib
from collections.abc import Callable
from typing import Any


class Registry[X]:
    """Names to factories. Registering a name twice raises; an unknown name raises with the nearest one."""

    def __init__(self, kind: str) -> None:
        self.kind = kind
        self._made: dict[str, Callable[..., X]] = {}

    def register(self, name: str, *aliases: str) -> Callable[[Callable[..., X]], Callable[..., X]]:
        def keep(factory: Callable[..., X]) -> Callable[..., X]:
            for n in (name, *aliases):
                if n in self._made:
                    raise ValueError(f"{self.kind} {n!r} is registered already")
                self._made[n] = factory
            return factory

        return keep

    def names(self) -> list[str]:
        return sorted(self._made)

    def get(self, name: str) -> Callable[..., X]:
        if name not in self._made:
            near = difflib.get_close_matches(name, self._made, 1)
            raise KeyError(f"unknown {self.kind} {name!r}" + (f"; did you mean {near[0]!r}?" if near else "") + f" There are: {', '.join(self.names())}")
        return self._made[name]

    def build(self, spec: dict[str, Any] | str, **extra: Any) -> X:
        params = {"name": spec} if isinstance(spec, str) else dict(spec)
        return self.get(params.pop("name"))(**params, **extra)
