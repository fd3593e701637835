"""Named handlers, such as input formats: registering a name twice is an error."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Iterator


class Registry:
    def __init__(self) -> None:
        self._found: dict[str, type] = {}

    def register(self, name: str, handler: type) -> None:
        if name in self._found:
            raise ValueError(f"{name} is already registered")
        self._found[name] = handler

    def unregister(self, name: str) -> None:
        if name not in self._found:
            raise KeyError(name)
        del self._found[name]

    def get(self, name: str) -> type:
        return self._found[name]

    def names(self) -> list[str]:
        return sorted(self._found)

    def all(self) -> dict[str, type]:
        return dict(self._found)

    def register_all(self, package: str, base: type) -> None:
        for c in discover(package, base):
            self.register(getattr(c, "name", c.__name__), c)


def discover(package: str, base: type) -> Iterator[type]:
    """Subclasses of `base` defined in the modules of a package."""
    top = importlib.import_module(package)
    for m in pkgutil.walk_packages(top.__path__, f"{package}."):
        module = importlib.import_module(m.name)
        for x in vars(module).values():
            if isinstance(x, type) and issubclass(x, base) and x is not base and x.__module__ == module.__name__:
                yield x
