"""What a citation names: `file.json:a.b[member].c` read out of a run's documents."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

#: Fields whose value names a member of a list.
NAMES = ("config", "engine", "id", "name", "label")


class Malformed(ValueError):
    """A path whose brackets don't match."""


@dataclass(frozen=True)
class Answer:
    kind: str  # field, pending, every_option, requirements, unresolved
    value: Any = None
    note: str = ""


def steps(path: str) -> list[tuple[str, str | None]]:
    """(field, member or None) of each step; dots and brackets inside a member belong to it."""
    parts, depth, held = [], 0, ""
    for c in path:
        depth += (c == "[") - (c == "]")
        if depth < 0:
            raise Malformed(path)
        if c == "." and not depth:
            parts.append(held)
            held = ""
        else:
            held += c
    if depth:
        raise Malformed(path)
    out = []
    for part in filter(None, [*parts, held]):
        field, bracket, member = part.partition("[")
        out.append((field, member[:-1] if bracket else None))
    return out


def member_of(items: list, name: str) -> Any:
    return next((x for x in items if isinstance(x, dict) and any(x.get(k) == name for k in NAMES)), None)


def resolve(source: str, documents: dict[str, Any], member: str | None = None, pending: tuple[str, ...] = ()) -> Answer:
    """Reads `source` from documents by file name. `member` chooses where a list, or the engines of a run, stands on the way.

    A file that is about to be written is pending; `[*]` names every option; what isn't there is unresolved, with the reason.
    """
    if not source:
        return Answer("unresolved", note="no source")
    if source.startswith("requirements:"):
        return Answer("requirements", note="written by the user")
    name, _, path = source.partition(":")
    if "[*]" in path:
        return Answer("every_option")
    if name in pending:
        return Answer("pending", note=f"{name} is being written")
    if name not in documents:
        return Answer("unresolved", note=f"no {name}")
    if not path:
        return Answer("unresolved", note="no field is named")
    node, way = documents[name], steps(path)
    if isinstance(node, dict) and "engines" in node and member and way[0][0] not in node:
        engines = node["engines"]
        node = engines.get(member, node) if isinstance(engines, dict) else member_of(engines, member) or node
    for field, want in way:
        if isinstance(node, list) and member is not None:
            node = member_of(node, member)
        if not isinstance(node, dict) or field not in node:
            return Answer("unresolved", note=f"no field {field}")
        node = node[field]
        if want is not None:
            node = member_of(node, want) if isinstance(node, list) else node.get(want) if isinstance(node, dict) else None
            if node is None:
                return Answer("unresolved", note=f"no member {want}")
    return Answer("field", node)


def disagreements(cites: list[tuple[str, Any, str | None]], documents: dict[str, Any], within: float = 1e-9, pending: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    """(source, problem) of cites (source, value, member) that name nothing or something else."""
    out = []
    for source, value, member in cites:
        got = resolve(source, documents, member, pending)
        if got.kind == "unresolved":
            out.append((source, got.note))
        elif got.kind == "field":
            numbers = all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in (got.value, value))
            if abs(got.value - value) > within if numbers else got.value != value:
                inside = [k for k, v in got.value.items() if v == value] if isinstance(got.value, dict) else []
                out.append((source, f"holds it as {inside[0]}" if inside else f"holds {got.value!r}"))
    return out
