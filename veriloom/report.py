"""Reports as text: a document's brief, its limits and its result, from small tables of counts that were aggregated before."""

from __future__ import annotations

import textwrap
from collections.abc import Mapping, Sequence

WIDTH = 100


def wrapped(text: str, indent: str = "") -> str:
    """TXT19: lines of at most ``WIDTH`` characters, those after the first under ``indent``."""
    return textwrap.fill(text, WIDTH, subsequent_indent=indent, break_long_words=False, break_on_hyphens=False)


def counted(n: int, one: str, many: str | None = None) -> str:
    """TXT19: the number with its noun."""
    return f"{n:,} {one if n == 1 else many or one + 's'}"


def verb(n: int, one: str = "was", many: str = "were") -> str:
    return one if n == 1 else many


def rule(title: str = "") -> str:
    return f"== {title} {'=' * max(0, WIDTH - len(title) - 4)}" if title else "=" * WIDTH


def stage_lines(counts: Mapping[str, int]) -> list[str]:
    """REP1: what each stage did, in a plain sentence each, from counts by name; counts that are absent are 0."""
    n = lambda k: int(counts.get(k, 0))
    return [
        f"{counted(n('sections'), 'section')} with {counted(n('sentences'), 'sentence')} {verb(n('sections'))} read.",
        f"{counted(n('generated'), 'section')} {verb(n('generated'))} summarised and {counted(n('passed'), 'short one')} {verb(n('passed'))} kept as {verb(n('passed'), 'it is', 'they are')}.",
        f"{counted(n('checked'), 'pair')} of claims {verb(n('checked'))} compared and {counted(n('flags'), 'conflict')} found: {n('decided')} decided, {n('unresolved')} open, {n('superseded')} superseded, {n('unscored')} not scored.",
        f"{counted(n('final'), 'sentence')} {verb(n('final'), 'is', 'are')} in the result: {n('supported')} supported, {n('weak')} weakly supported, {n('unsupported')} unsupported.",
    ]


def brief(counts: Mapping[str, int]) -> str:
    """REP1."""
    return "\n".join(wrapped(f"{i}. {line}", "   ") for i, line in enumerate(stage_lines(counts), 1))


def limits(rows: Sequence[Mapping]) -> str:
    """REP2: rows (stage, limit, hit, detail); those that were hit come first."""
    if not rows:
        return "No limits apply."
    ordered = sorted(rows, key=lambda r: (not r["hit"], r["stage"], r["limit"]))
    return "\n".join(wrapped(f"[{'HIT' if r['hit'] else 'ok'}] {r['stage']} {r['limit']}: {r['detail']}", "      ") for r in ordered)


def summary(sentences: Sequence[str]) -> str:
    """SNK4: the final sentences as one wrapped text."""
    return wrapped(" ".join(sentences)) if sentences else "(empty)"


def result(title: str, counts: Mapping[str, int], rows: Sequence[Mapping], limit_rows: Sequence[Mapping] = (), evidence: bool = False) -> str:
    """SNK4, REP2: the whole report.  ``rows`` are final sentences (text, status, cited[, flags, notes]) in order; ``evidence`` adds their panel."""
    parts = [rule(title), summary([r["text"] for r in rows]), rule("what was done"), brief(counts)]
    if limit_rows:
        parts += [rule("limits"), limits(limit_rows)]
    if evidence:
        parts.append(rule("evidence"))
        for i, r in enumerate(rows, 1):
            parts.append(wrapped(f"{i}. [{r['status']}] {r['text']}", "   "))
            parts.append(wrapped(f"   source: {r['cited']}" if r.get("cited") else "   source: none close enough", "           "))
            parts += [wrapped(f"   ! {x}", "     ") for x in r.get("flags") or ()]
            parts += [wrapped(f"   - {x}", "     ") for x in r.get("notes") or ()]
    return "\n".join(parts) + "\n"
