"""Readable text of HTML as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements whose content is no text.
SKIPPED = ("script", "style", "noscript", "iframe", "object", "embed")


def html_text(html: Column) -> Column:
    """The text outside of skipped elements, whole subtrees of which go, trimmed; entities are left as they are."""
    for tag in SKIPPED:
        html = F.regexp_replace(html, rf"(?is)<{tag}(\s[^>]*)?>.*?</{tag}\s*>", "")
    return F.trim(F.regexp_replace(html, r"(?s)<[^>]*>", ""))
