"""Reading many known paths of a parsed JSON document at once, into a struct made for them.

All functions take and return SQL text.
"""

from __future__ import annotations

from collections.abc import Iterable

from signalpact.functions.paths import json_path, name, quoted


class Paths:
    """A struct type with a field per key of the given paths, and the way to each of them.

    A key that is both a value and an object on the way, or whose sibling differs in case only, is read as a
    whole; what lies below is then taken from it by a path.
    """

    def __init__(self, paths: Iterable[tuple[str, ...]], leaf: str):
        self.want, self.tree = leaf, {}
        for path in paths:
            node = self.tree
            for segment in path:
                node = node.setdefault(segment, {})
            node[None] = {}

    def _whole(self, node: dict) -> bool:
        keys = [k for k in node if k is not None]
        return None in node or len({k.lower() for k in keys}) < len(keys)

    def _kind(self, node: dict) -> str:
        if self._whole(node):
            return "variant" if any(k is not None for k in node) else self.want
        return f"struct<{self._fields(node)}>"

    def _fields(self, node: dict) -> str:
        return ", ".join(f"{name(k)}: {self._kind(child)}" for k, child in node.items())

    @property
    def plain(self) -> bool:
        """Whether the root itself can be a struct."""
        return bool(self.tree) and not self._whole(self.tree)

    def read(self, document: str) -> str:
        """A VARIANT document as the struct; leaves of another type than wanted are NULL."""
        return f"try_variant_get({document}, '$', {quoted(self._kind(self.tree))})"

    def at(self, document: str, path: tuple[str, ...]) -> str:
        """Value at a path of a document that was :meth:`read`."""
        node, found = self.tree, document
        for i, segment in enumerate(path):
            node, found = node[segment], f"{found}.{name(segment)}"
            if self._whole(node) and any(k is not None for k in node):
                steps = json_path(path[i + 1:])
                return f"try_variant_get({found}, {steps}, '{self.want}')"
        return found
