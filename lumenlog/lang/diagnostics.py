"""Errors that point at the source text."""

from __future__ import annotations

from dataclasses import dataclass

from .ast import Span


@dataclass(frozen=True)
class Finding:
    message: str
    span: Span
    help: str = ""


class ProgramError(ValueError):
    """One or more findings, rendered with the lines they are about."""

    def __init__(self, findings: list[Finding], texts: dict[str, str] | None = None):
        self.findings = findings
        super().__init__("\n".join(render(f, (texts or {}).get(f.span.source)) for f in findings))


def render(found: Finding, text: str | None) -> str:
    said = f"error: {found.message}"
    if text is not None and found.span.stop > 0:
        line = text.count("\n", 0, found.span.start) + 1
        begin = text.rfind("\n", 0, found.span.start) + 1
        end = text.find("\n", begin)
        shown = text[begin : end if end >= 0 else len(text)]
        at = found.span.start - begin
        width = max(1, min(found.span.stop, begin + len(shown)) - found.span.start)
        margin = " " * len(str(line))
        said += f"\n{margin}--> {found.span.source or '<program>'}:{line}:{at + 1}\n{margin} |\n{line} | {shown}\n{margin} | {' ' * at}{'^' * width}"
    return said + (f"\n  help: {found.help}" if found.help else "")
