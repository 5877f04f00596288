"""What projectors produce: declarations with keys, nesting, spans and canonical text."""

from __future__ import annotations

from dataclasses import dataclass, field

MODES = ("types", "signatures", "tests")


class ProjectionError(ValueError):
    """A source file that its language's grammar refuses, with the place of the first error."""

    def __init__(self, message: str, line: int | None = None, column: int | None = None):
        super().__init__(message if line is None else f"{message} (line {line}, column {column})")
        self.line, self.column = line, column


@dataclass
class Item:
    """One declaration. Bytes and lines count from 0; columns are bytes."""

    stable_key: str
    parent_key: str | None
    kind: str
    name: str
    start_byte: int
    end_byte: int
    start_line: int
    start_column: int
    end_line: int
    end_column: int
    canonical_text: str


@dataclass
class Keys:
    """Keys of a file: the first use stays as it is, later ones get ~1, ~2 and so on in source order."""

    seen: dict[str, int] = field(default_factory=dict)

    def new(self, base: str) -> str:
        n = self.seen.get(base, 0)
        self.seen[base] = n + 1
        return base if not n else f"{base}~{n}"


def canonical_text(items: list[Item]) -> str:
    """Texts of the items without a parent, a blank line between, a line end behind; empty if there are none."""
    parts = [i.canonical_text.rstrip("\n") for i in items if i.parent_key is None]
    return "\n\n".join(parts) + "\n" if parts else ""


def check(items: list[Item]) -> None:
    """Raises if a key repeats, or a parent is missing, the item itself, or below it."""
    parents = {}
    for i in items:
        if i.stable_key in parents:
            raise ProjectionError(f"duplicate key {i.stable_key}")
        parents[i.stable_key] = i.parent_key
    for key in parents:
        seen, at = set(), key
        while at is not None:
            if at not in parents:
                raise ProjectionError(f"dangling parent {at}")
            if at in seen:
                raise ProjectionError(f"cyclic parent {key}")
            seen.add(at)
            at = parents[at]
