"""What a parser returns for one file."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Parsed:
    """calls: (path, callee, line, column); extends: (path, child, parent, line, column);
    requires: (path, module, is_static, line, column)."""

    path: str
    symbols: list[dict] = field(default_factory=list)
    calls: list[tuple] = field(default_factory=list)
    extends: list[tuple] = field(default_factory=list)
    requires: list[tuple] = field(default_factory=list)


def symbol(path: str, kind: str, name: str, qualified: str, line: int, column: int, end_line: int, end_column: int, signature: str, local: bool, exported: bool) -> dict:
    """Lines and columns count from 1, but a Lua end column from 0."""
    return {
        "id": f"{path}#{kind}#{qualified}#{line}:{column}",
        "kind": kind,
        "name": name,
        "qualified_name": qualified,
        "file_path": path,
        "signature": signature,
        "start_line": line,
        "start_column": column,
        "end_line": end_line,
        "end_column": end_column,
        "is_local": local,
        "is_exported": exported,
        "is_unresolved": False,
    }
