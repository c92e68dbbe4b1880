"""Replacing a block of text that is quoted inexactly. Ordered tries with early ends need control flow: an Arrow pandas UDF.

A try relaxes what counts as the same line; the first try with a match decides. Unless all matches are to be replaced,
a match must be the only one of its try, otherwise the next try goes on.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from millrace.sources.shared import narrow_batches

# Escape sequences of quoted blocks; least likeness of a block between anchors; share of equal middle lines.
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "'": "'", '"': '"', "`": "`", "\\": "\\", "\n": "\n", "$": "$"}
MANY_ANCHORS, MIDDLE_SHARE = 0.3, 0.5
#: A task holds the texts of so many rows at once, and what they become.
BATCH_ROWS = 256


def distance(a: str, b: str) -> int:
    """Edit distance; for an empty text the other's length."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _dedented(lines: list[str]) -> list[str]:
    least = min((len(x) - len(x.lstrip()) for x in lines if x.strip()), default=0)
    return [x[least:] if x.strip() else x for x in lines]


def _unescaped(s: str) -> str:
    return re.sub(r"\\(n|t|r|'|\"|`|\\|\n|\$)", lambda m: ESCAPES[m[1]], s)


def _windows(text: str, find: str, same: Callable[[list[str], list[str]], bool]) -> Iterator[tuple[int, int]]:
    """Spans of as many whole lines as the block has for which ``same`` holds; a last empty line of the block is left out."""
    lines, want = text.split("\n"), find.split("\n")
    want = want[:-1] if len(want) > 1 and want[-1] == "" else want
    at = [0]
    for x in lines:
        at.append(at[-1] + len(x) + 1)
    for i in range(len(lines) - len(want) + 1):
        if same(lines[i : i + len(want)], want):
            yield at[i], at[i + len(want)] - 1


def _anchored(text: str, find: str) -> list[tuple[int, int]]:
    """Blocks of any length between the first and the last line; of many, the likest if it is like enough."""
    want = [x.strip() for x in find.strip("\n").split("\n")]
    if len(want) < 3:
        return []
    lines, found = text.split("\n"), []
    starts = [i for i, x in enumerate(lines) if x.strip() == want[0]]
    for i in starts:
        end = next((j for j in range(i + 2, len(lines)) if lines[j].strip() == want[-1]), None)
        if end is not None:
            pairs = list(zip((x.strip() for x in lines[i + 1 : end]), want[1:-1], strict=False))
            likeness = [1 - distance(a, b) / max(len(a), len(b), 1) for a, b in pairs]
            found.append((sum(likeness) / max(len(likeness), 1), i, end))
    if not found or len(found) > 1 and max(found)[0] < MANY_ANCHORS:
        return []
    _, i, end = max(found, key=lambda x: (x[0], -x[1]))
    start = sum(len(x) + 1 for x in lines[:i])
    return [(start, start + len("\n".join(lines[i : end + 1])))]


def _context(got: list[str], want: list[str]) -> bool:
    if len(want) < 3 or got[0].strip() != want[0].strip() or got[-1].strip() != want[-1].strip():
        return False
    middle = [(a.strip(), b.strip()) for a, b in zip(got[1:-1], want[1:-1], strict=True) if a.strip() or b.strip()]
    return not middle or sum(a == b for a, b in middle) >= MIDDLE_SHARE * len(middle)


def matches(text: str, find: str) -> Iterator[list[tuple[int, int]]]:
    """The matches of each try, as spans, from exact to loose."""
    whole = lambda s: " ".join(s.split())
    exact = lambda s: [(m.start(), m.end()) for m in re.finditer(re.escape(s), text)] if s else []
    yield exact(find)
    yield list(_windows(text, find, lambda a, b: [x.strip() for x in a] == [x.strip() for x in b]))
    yield _anchored(text, find)
    yield list(_windows(text, find, lambda a, b: [whole(x) for x in a] == [whole(x) for x in b]))
    yield list(_windows(text, find, lambda a, b: _dedented(a) == _dedented(b)))
    yield exact(_unescaped(find))
    yield exact(find.strip())
    yield list(_windows(text, find, _context))


def replace_block(text: str, find: str, new: str, everywhere: bool = False) -> tuple[str | None, str | None]:
    """The changed text, or what is wrong: ``identical``, ``not found`` or ``multiple``."""
    if find == new:
        return None, "identical"
    seen = False
    for spans in matches(text, find):
        seen = seen or bool(spans)
        if spans and (everywhere or len(spans) == 1):
            for a, b in reversed(spans):
                text = text[:a] + new + text[b:]
            return text, None
    return None, "multiple" if seen else "not found"


def replaced(text: Column, find: Column, new: Column, everywhere: bool = False) -> Column:
    """struct(text, error) for every row; a null argument counts as empty."""
    narrow_batches(SparkSession.active(), BATCH_ROWS)

    @F.pandas_udf("text string, error string")
    def run(t: pd.Series, f: pd.Series, n: pd.Series) -> pd.DataFrame:
        rows = [replace_block(a or "", b or "", c or "", everywhere) for a, b, c in zip(t, f, n, strict=True)]
        return pd.DataFrame(rows, columns=["text", "error"])

    return run(text, find, new)
