"""YAML as written: scalars keep their text, errors their line and path."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

import yaml

_INT = re.compile(r"^[-+]?(0x[0-9a-fA-F_]+|0o[0-7_]+|0b[01_]+|[0-9][0-9_]*)$")
_FLOAT = re.compile(r"^[-+]?(\.[0-9]+|[0-9][0-9_]*(\.[0-9_]*)?)([eE][-+]?[0-9]+)?$")
_NULL = {"", "~", "null", "Null", "NULL"}
_BOOL = {"true": True, "True": True, "TRUE": True, "false": False, "False": False, "FALSE": False}


@dataclass(frozen=True)
class Fault:
    """One thing wrong with a rubric."""

    line: int
    path: str
    message: str

    def __str__(self) -> str:
        return f"line {self.line}: {self.path + ': ' if self.path else ''}{self.message}"


class RubricError(ValueError):
    """All faults of a rubric at once."""

    def __init__(self, faults: list[Fault]):
        self.faults = faults
        super().__init__("\n".join(map(str, faults)))


class Node:
    """A YAML node and where it stands."""

    def __init__(self, raw: yaml.Node | None, path: str = "", line: int | None = None):
        self.raw, self.path = raw, path
        self.line = line or (raw.start_mark.line + 1 if raw is not None else 1)

    @property
    def kind(self) -> str:
        names = {yaml.MappingNode: "a mapping", yaml.SequenceNode: "a list", yaml.ScalarNode: "a single value", type(None): "nothing"}
        return names[type(self.raw)]

    @property
    def is_map(self) -> bool:
        return isinstance(self.raw, yaml.MappingNode)

    @property
    def is_list(self) -> bool:
        return isinstance(self.raw, yaml.SequenceNode)

    @property
    def is_scalar(self) -> bool:
        return isinstance(self.raw, yaml.ScalarNode)

    @property
    def is_null(self) -> bool:
        return self.raw is None or (self.is_scalar and self.natural() is None)

    def items(self) -> list[tuple[str, Node]]:
        if not self.is_map:
            return []
        return [(k.value, Node(v, f"{self.path}.{k.value}".lstrip("."), k.start_mark.line + 1)) for k, v in self.raw.value]

    def get(self, key: str) -> Node | None:
        return dict(self.items()).get(key)

    def elements(self) -> list[Node]:
        return [Node(x, f"{self.path}[{i}]") for i, x in enumerate(self.raw.value)] if self.is_list else []

    @property
    def text(self) -> str:
        return self.raw.value if self.is_scalar else ""

    @property
    def quoted(self) -> bool:
        return self.is_scalar and self.raw.style is not None

    def natural(self) -> Any:
        """A scalar's own value: float, bool, text or None. Words such as yes are text."""
        t = self.text
        if self.quoted:
            return t
        if t in _NULL:
            return None
        if t in _BOOL:
            return _BOOL[t]
        if _INT.match(t):
            plain = t.replace("_", "")
            return float(int(plain, 10) if plain.lstrip("+-").isdigit() else int(plain, 0))
        if _FLOAT.match(t):
            return float(t.replace("_", ""))
        return t


def read(text: str) -> Node:
    """The document's root; raises ``RubricError`` for bad YAML, aliases and repeated keys."""
    try:
        faults = [Fault(e.start_mark.line + 1, "", f"an alias (*{e.anchor}) is not allowed") for e in yaml.parse(text, Loader=yaml.SafeLoader) if isinstance(e, yaml.AliasEvent)]
        if faults:
            raise RubricError(faults)
        root = yaml.compose(text, Loader=yaml.SafeLoader)
    except yaml.YAMLError as e:
        mark = getattr(e, "problem_mark", None)
        raise RubricError([Fault(mark.line + 1 if mark else 1, "", f"not YAML: {getattr(e, 'problem', e)}")]) from e
    faults = []
    _repeated(root, "", faults)
    if faults:
        raise RubricError(faults)
    return Node(root)


def _repeated(node: yaml.Node | None, path: str, faults: list[Fault]) -> None:
    if isinstance(node, yaml.MappingNode):
        seen: dict[str, int] = {}
        for k, v in node.value:
            key = k.value if isinstance(k, yaml.ScalarNode) else str(k.start_mark.line)
            here = f"{path}.{key}".lstrip(".")
            if key in seen:
                faults.append(Fault(k.start_mark.line + 1, here, f"this key is already on line {seen[key]}"))
            seen[key] = k.start_mark.line + 1
            _repeated(v, here, faults)
    elif isinstance(node, yaml.SequenceNode):
        for i, v in enumerate(node.value):
            _repeated(v, f"{path}[{i}]", faults)


def canonical(node: Node) -> str:
    """The document's content without layout, for versions."""
    if node.is_map:
        return "{" + ",".join(f"{k!r}:{canonical(v)}" for k, v in sorted(node.items(), key=lambda x: x[0])) + "}"
    if node.is_list:
        return "[" + ",".join(map(canonical, node.elements())) + "]"
    return repr(node.natural())
