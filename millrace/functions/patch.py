"""Patches of files as text: reading them, finding their lines inexactly, and applying them. Control flow per row: Arrow pandas UDFs.

A patch stands between ``*** Begin Patch`` and ``*** End Patch`` and adds, deletes or updates files. A change of an
update says which lines it expects; they are looked for from the end of the change before it, first as they are, then
without blanks at their ends, without blanks around them, and at last with plain punctuation.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import PUNCTUATION

# Marks of patches.
BEGIN, END = "*** Begin Patch", "*** End Patch"
ADD, DELETE, UPDATE, MOVE = "*** Add File:", "*** Delete File:", "*** Update File:", "*** Move to:"
_PLAIN = str.maketrans({**PUNCTUATION, "…": "..."})
LOOKS: tuple[Callable[[str], str], ...] = (str, str.rstrip, str.strip, lambda s: s.strip().translate(_PLAIN))


@dataclass
class Change:
    """Lines that are expected and lines that take their place, below a line of context if one is told."""

    context: str = ""
    old: list[str] = field(default_factory=list)
    new: list[str] = field(default_factory=list)


@dataclass
class Hunk:
    kind: str
    path: str
    move: str | None = None
    content: str | None = None
    changes: list[Change] = field(default_factory=list)


def find_lines(lines: list[str], want: list[str], start: int = 0, at_end: bool = False) -> int:
    """The first place from ``start`` on where the wanted lines stand, by the strictest look that finds any; -1 if none does.

    With ``at_end``, each look tries the end of the file first.
    """
    if not want:
        return -1
    last = len(lines) - len(want)
    for look in LOOKS:
        seen, wanted = [look(x) for x in lines], [look(x) for x in want]
        places = ([last] if at_end and last >= start else []) + list(range(start, last + 1))
        for i in places:
            if seen[i : i + len(want)] == wanted:
                return i
    return -1


def parse_patch(text: str) -> list[Hunk]:
    """The hunks of a patch, which may stand in a here-document; ValueError without its begin or end."""
    here = re.match(r"(?s)^(?:cat\s+)?<<['\"]?(\w+)['\"]?\s*\n(.*?)\n\1\s*$", text.strip())
    lines = (here[2] if here else text.strip()).split("\n")
    marks = [x.strip() for x in lines]
    if BEGIN not in marks or END not in marks or marks.index(BEGIN) >= marks.index(END):
        raise ValueError("no begin or end of the patch")
    hunks: list[Hunk] = []
    open_hunk: Hunk | None = None
    for line in lines[marks.index(BEGIN) + 1 : marks.index(END)]:
        kind = next((k for k in (ADD, DELETE, UPDATE) if line.startswith(k)), None)
        if kind:
            path = line[len(kind) :].strip()
            open_hunk = Hunk({ADD: "add", DELETE: "delete", UPDATE: "update"}[kind], path, content="" if kind == ADD else None) if path else None
            hunks += [open_hunk] if open_hunk else []
        elif line.startswith(MOVE) and open_hunk and open_hunk.kind == "update" and not open_hunk.changes and open_hunk.move is None:
            open_hunk.move = line[len(MOVE) :].strip()
        elif line.startswith("***"):
            open_hunk = None
        elif open_hunk and open_hunk.kind == "add" and line.startswith("+"):
            open_hunk.content += line[1:] + "\n"
        elif open_hunk and open_hunk.kind == "update":
            if line.startswith("@@"):
                open_hunk.changes.append(Change(line[2:].strip()))
            elif open_hunk.changes:
                change = open_hunk.changes[-1]
                change.old += [line[1:]] if line[:1] in (" ", "-") and line else []
                change.new += [line[1:]] if line[:1] in (" ", "+") and line else []
    for h in hunks:
        if h.kind == "add":
            h.content = h.content.removesuffix("\n")
    return hunks


def changed(content: str, changes: list[Change]) -> str:
    """The content after the changes; it ends with a line feed. ValueError where expected lines are not found."""
    lines = content.split("\n")
    lines = lines[:-1] if lines[-1] == "" else lines
    edits, at = [], 0
    for c in changes:
        if c.context:
            found = find_lines(lines, [c.context], at)
            if found < 0:
                raise ValueError(f"no context {c.context!r}")
            at = found + 1
        if not c.old:
            edits.append((len(lines) - (lines[-1:] == [""]), 0, c.new))
            continue
        old, new = c.old, c.new
        found = find_lines(lines, old, at)
        if found < 0 and old[-1] == "":
            old, new = old[:-1], new[:-1] if new[-1:] == [""] else new
            found = find_lines(lines, old, at)
        if found < 0:
            raise ValueError("expected lines are not there")
        edits.append((found, len(old), new))
        at = found + len(old)
    for start, n, new in sorted(edits, key=lambda e: e[0], reverse=True):
        lines[start : start + n] = new
    return "\n".join(lines if lines[-1:] == [""] else [*lines, ""])


def hunks(patch: Column) -> Column:
    """Array of struct(kind, path, move, content, changes) of a patch; null for what is none."""

    @F.pandas_udf("array<struct<kind: string, path: string, move: string, content: string, changes: int>>")
    def run(s: pd.Series) -> pd.Series:
        def one(text: str | None):
            try:
                return [{"kind": h.kind, "path": h.path, "move": h.move, "content": h.content, "changes": len(h.changes)} for h in parse_patch(text or "")]
            except ValueError:
                return None

        return s.map(one)

    return run(patch)


def located(content: Column, wanted: Column) -> Column:
    """The place (from 0) of the wanted lines among those of a content, by :func:`find_lines`; -1 where they are not there."""

    @F.pandas_udf("int")
    def run(c: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([find_lines((a or "").split("\n"), (b or "").split("\n")) for a, b in zip(c, w, strict=True)])

    return run(content, wanted)


def applied(content: Column, path: Column, patch: Column) -> Column:
    """struct(content, path, error): a file after a patch. A deleted one has no content; a file that the patch does not name stays as it is."""

    @F.pandas_udf("content string, path string, error string")
    def run(c: pd.Series, p: pd.Series, t: pd.Series) -> pd.DataFrame:
        rows = []
        for text, name, told in zip(c, p, t, strict=True):
            try:
                now, at = text, name
                for h in parse_patch(told or ""):
                    if h.path == name:
                        now = None if h.kind == "delete" else h.content if h.kind == "add" else changed(now or "", h.changes)
                        at = h.move or at
                rows.append((now, at, None))
            except ValueError as e:
                rows.append((text, name, str(e)))
        return pd.DataFrame(rows, columns=["content", "path", "error"])

    return run(content, path, patch)
