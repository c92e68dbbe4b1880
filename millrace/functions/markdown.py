"""HTML as Markdown: headings by ``#``, lists by ``-``, fenced code, ``*`` for emphasis. A subset of what a library would do."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements that go with their content, elements that stand on lines of their own, marks around text.
REMOVED = ("script", "style", "meta", "link")
BLOCKS = ("p", "div", "section", "article", "header", "footer", "main", "table", "tr", "blockquote", "ul", "ol", "pre", "h1", "h2", "h3", "h4", "h5", "h6")
MARKS = {"em": "*", "i": "*", "strong": "**", "b": "**", "code": "`"}


class _Writer(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden, self.pre, self.links, self.lists = 0, 0, [], []

    def _line(self, blank: bool = True) -> None:
        self.out.append("\n\n" if blank else "\n")

    def handle_starttag(self, tag, attrs):
        if tag in REMOVED:
            self.hidden += tag in ("script", "style")
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag in MARKS and not self.pre:
            self.out.append(MARKS[tag])
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.out.append("[")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self._line(len(self.lists) == 1)
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.out.append("\n" + "    " * (len(self.lists) - 1) + (f"{kind[1]}.  " if kind[0] == "ol" else "-   "))
        elif tag == "br":
            self.out.append("  \n")
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag in BLOCKS:
            self._line()
            self.out.append("#" * int(tag[1]) + " " if tag[0] == "h" and tag[1:].isdigit() else "")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            self.out.append("\n```\n\n")
        elif tag in MARKS and not self.pre:
            self.out.append(MARKS[tag])
        elif tag == "a" and self.links:
            self.out.append(f"]({self.links.pop()})")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self._line(not self.lists)
        elif tag in BLOCKS:
            self._line()

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def to_markdown(html: str) -> str:
    w = _Writer()
    w.feed(html)
    w.close()
    parts = re.split(r"(```\n.*?\n```)", "".join(w.out), flags=re.S)
    for i in range(0, len(parts), 2):
        lines = [x.rstrip(" ") if not x.endswith("  ") or not x.strip() else x.rstrip(" ") + "  " for x in parts[i].split("\n")]
        lines = [x if re.match(r" *(-|\d+\.) {2,}", x) else x.lstrip(" ") for x in lines]
        parts[i] = re.sub(r"\n{3,}", "\n\n", "\n".join(lines))
    return "".join(parts).strip()


def markdown(html: Column) -> Column:
    """The Markdown of a page; null stays null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else to_markdown(x))

    return run(html)
