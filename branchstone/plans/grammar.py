"""A small grammar for JSON documents that admit nothing but what is described: a description is data, one walk checks it."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any


class Node:
    """A description of JSON values; faults() tells what of a value it does not describe, as (path, what was expected)."""

    def faults(self, value: Any, path: str = "") -> Iterator[tuple[str, str]]:
        if not self.fits(value):
            yield path, self.expected()

    def fits(self, value: Any) -> bool:
        return True

    def expected(self) -> str:
        return "anything"


@dataclass(frozen=True)
class Whole(Node):
    low: int
    high: int

    def fits(self, value):
        return type(value) is int and self.low <= value <= self.high

    def expected(self):
        return f"a whole number from {self.low} to {self.high}"


class Truth(Node):
    def fits(self, value):
        return type(value) is bool

    def expected(self):
        return "true or false"


@dataclass(frozen=True)
class Text(Node):
    pattern: str

    def fits(self, value):
        return isinstance(value, str) and re.fullmatch(self.pattern, value) is not None

    def expected(self):
        return f"a text like {self.pattern}"


@dataclass(frozen=True)
class Choice(Node):
    of: tuple

    def fits(self, value):
        return any(type(value) is type(x) and value == x for x in self.of)

    def expected(self):
        return f"one of {', '.join(map(str, self.of))}"


@dataclass(frozen=True)
class Many(Node):
    """A list. `apart`: the key whose values differ from item to item."""

    of: Node
    low: int
    high: int
    apart: str | None = None

    def faults(self, value, path=""):
        if not isinstance(value, list) or not self.low <= len(value) <= self.high:
            yield path, f"a list of {self.low} to {self.high}"
            return
        for k, item in enumerate(value):
            yield from self.of.faults(item, f"{path}[{k}]")
        if self.apart is not None:
            names = [x.get(self.apart) for x in value if isinstance(x, dict)]
            if any(n in names[:k] for k, n in enumerate(names)):
                yield path, f"items of different {self.apart}"


@dataclass(frozen=True)
class Record(Node):
    """An object with exactly these keys; those in `also` may be missing."""

    keys: Mapping[str, Node]
    also: Mapping[str, Node] = field(default_factory=dict)

    def faults(self, value, path=""):
        if not isinstance(value, dict) or not set(self.keys) <= set(value) <= set(self.keys) | set(self.also):
            yield path, f"an object of {', '.join(self.keys)}" + (f" and perhaps {', '.join(self.also)}" if self.also else "")
            return
        for key, node in {**self.keys, **self.also}.items():
            if key in value:
                yield from node.faults(value[key], f"{path}.{key}")


@dataclass(frozen=True)
class Tagged(Node):
    """An object that one of its keys says the description of."""

    tag: str
    by: Mapping[Any, Node]

    def faults(self, value, path=""):
        kind = value.get(self.tag) if isinstance(value, dict) else None
        known = next((n for k, n in self.by.items() if type(k) is type(kind) and k == kind), None)
        if known is None:
            yield path, f"an object whose {self.tag} is {', '.join(map(str, self.by))}"
        else:
            yield from known.faults(value, path)


@dataclass(frozen=True)
class Either(Node):
    """What one of some descriptions fits."""

    of: tuple

    def fits(self, value):
        return any(not any(True for _ in n.faults(value)) for n in self.of)

    def expected(self):
        return "one of its forms"


@dataclass(frozen=True)
class Mapped(Node):
    """An object of any keys whose values have one description."""

    of: Node

    def faults(self, value, path=""):
        if not isinstance(value, dict):
            yield path, "an object"
            return
        for key, item in value.items():
            yield from self.of.faults(item, f"{path}.{key}")
