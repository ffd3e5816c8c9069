"""Reports of commands: named sections of rows, as text or JSON, with totals and a limit for what is shown."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

TEXT_LIMIT = 50


@dataclass
class Section:
    """Rows under a title; ``total`` is their number before the limit."""

    title: str
    rows: list[dict[str, Any]]
    total: int

    @property
    def hidden(self) -> int:
        return self.total - len(self.rows)


@dataclass
class Report:
    """What a command has to say, and how it ended."""

    command: str
    sections: list[Section] = field(default_factory=list)
    notices: list[str] = field(default_factory=list)
    code: int = 0

    def add(self, title: str, rows: DataFrame, limit: int | None = None) -> Section:
        """A section of ``rows`` in their order; with a limit the driver gets no more than that."""
        total = rows.count()
        shown = rows.limit(limit) if limit and limit > 0 else rows
        out = Section(title, [r.asDict(recursive=True) for r in shown.collect()], total)
        self.sections.append(out)
        return out

    def as_json(self, ascii_only: bool = False) -> str:
        body = {"command": self.command, "notices": self.notices, "sections": {s.title: {"total": s.total, "rows": s.rows} for s in self.sections}}
        return json.dumps(body, indent=2, ensure_ascii=ascii_only, default=str)

    def as_text(self, quiet: bool = False) -> str:
        lines = list(self.notices)
        for s in [] if quiet else self.sections:
            lines += ["", f"{s.title} ({s.total:,})"]
            names = list(s.rows[0]) if s.rows else []
            cells = [[_plain(r[c]) for c in names] for r in s.rows]
            width = [max(map(len, column)) for column in zip(names, *cells)] if names else []
            for row in ([names, *cells] if names else []):
                lines.append("  " + "  ".join(x.ljust(w) for x, w in zip(row, width)).rstrip())
            if s.hidden:
                lines.append(f"  ... and {s.hidden:,} more")
        return "\n".join(lines).lstrip("\n")


def _plain(value: Any) -> str:
    """One line of text, without signs that a terminal would take for orders."""
    if value is None:
        return ""
    if isinstance(value, float):
        return f"{value:.1f}" if abs(value) >= 10 else f"{value:.4g}"
    if isinstance(value, (list, tuple)):
        return "; ".join(map(_plain, value))
    if isinstance(value, dict):
        return ", ".join(f"{k}: {_plain(v)}" for k, v in value.items() if v is not None)
    return "".join(c if c.isprintable() else " " for c in str(value))
