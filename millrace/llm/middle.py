"""Fill-in-middle: texts are cut into units, and their prefix, middle and suffix are put in another order.

A unit grammar is a pair of neighbouring character classes: a unit ends where a character of the first class is
followed by one of the second. It becomes a zero-width regular expression of a lookbehind and a lookahead, so Spark's
``split`` takes nothing out of the text and its pieces, put together, are the text. DataFrame functions only; one narrow
pass, no shuffle.

The two cuts, the choice to transform and the form are read from a digest of the seed and the id, so a row always gets
the same result. ``restore`` reads a text back from its output and form.

Defined results: a null text counts as an empty one; an empty text has no units and stays plain, and so does a text that
holds a marker; a null id is written as nothing behind the seed; equal ids get equal draws; rows are transformed one by
one, so repeated rows give repeated results; texts are cut whole, however long; other columns pass through, and those
with the name of a result give way to it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space between words.
BLANK = r"\x20\x09-\x0D"

#: Unit grammars: the class at the end of a unit, and the class at the start of the next.
GRAMMARS = {
    "lines": (r"\n", r"\s\S"),
    "words": (rf"{BLANK}", rf"^{BLANK}"),
    "sentences": (r".!?", BLANK),
    "characters": (r"\s\S", r"\s\S"),
}


@dataclass(frozen=True)
class Markers:
    """The control strings before each part. None may begin with an end of another, so the first one found is the real one."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        for a in self.all:
            for b in self.all:
                if not a or (a != b and a in b) or any(a.endswith(b[:k]) for k in range(1, len(b))):
                    raise ValueError(f"markers {a!r} and {b!r} can overlap")
        if len(set(self.all)) < 3:
            raise ValueError("markers must differ")

    @property
    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output")


def boundary(grammar: str) -> str:
    """The zero-width expression between two units."""
    before, after = GRAMMARS[grammar]
    return f"(?<=[{before}])(?=[{after}])"


def units(text: Column, grammar: str = "lines") -> Column:
    """The units of a text, which put together are the text; an empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar)))


def draws(key: Column, seed: int, count: int = 4) -> list[Column]:
    """Unsigned 32-bit integers from the first groups of eight hexadecimal digits of a digest."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(count)]


def transform(docs: DataFrame, grammar: str = "lines", seed: int = 7, percent: int = 100, spm_percent: int = 50, markers: Markers = Markers(), key: str = "doc_id") -> DataFrame:
    """All rows with the number of units, form, the lengths of prefix and middle in code points, and the output."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in RESULTS]
    body = F.coalesce(F.col("text"), F.lit(""))
    # One array of what later columns need; names with a double underscore are not those of the input.
    drawn = docs.select(*kept, body.alias("__body"), units(body, grammar).alias("__units"), F.array(*draws(F.col(f"`{key}`"), seed)).alias("__h"))
    n = F.size("__units")
    first, second, third, fourth = (F.col("__h")[i] for i in range(4))
    marked = F.col("__body") == ""
    for m in markers.all:
        marked |= F.contains(F.col("__body"), F.lit(m))
    plain = marked | (third % 100 >= percent)
    cuts = drawn.select(
        "*",
        n.cast("long").alias("__n"),
        F.least(first % (n + 1), second % (n + 1)).cast("int").alias("__a"),
        F.greatest(first % (n + 1), second % (n + 1)).cast("int").alias("__b"),
        F.when(plain, "plain").when(fourth % 100 < spm_percent, "spm").otherwise("psm").alias("__form"),
    )

    def joined(start: Column, length: Column) -> Column:
        return F.array_join(F.slice("__units", start, length), "")

    parts = cuts.select(
        *kept,
        "__body",
        "__n",
        "__form",
        joined(F.lit(1), F.col("__a")).alias("__p"),
        joined(F.col("__a") + 1, F.col("__b") - F.col("__a")).alias("__m"),
        joined(F.col("__b") + 1, F.greatest(F.size("__units") - F.col("__b"), F.lit(0))).alias("__s"),
    )
    p, s, m = F.lit(markers.prefix), F.lit(markers.suffix), F.lit(markers.middle)
    output = (
        F.when(F.col("__form") == "plain", F.col("__body"))
        .when(F.col("__form") == "psm", F.concat(p, "__p", s, "__s", m, "__m"))
        .otherwise(F.concat(s, "__s", p, "__p", m, "__m"))
    )
    moved = F.col("__form") != "plain"
    return parts.select(
        *kept,
        F.col("__n").alias("n"),
        F.col("__form").alias("form"),
        F.when(moved, F.length("__p").cast("long")).alias("prefix_chars"),
        F.when(moved, F.length("__m").cast("long")).alias("middle_chars"),
        output.alias("output"),
    )


def restore(output: Column, form: Column, markers: Markers = Markers()) -> Column:
    """The text that an output was made from. The first marker of a kind is the real one, as no moved text holds any."""

    def after(text: Column, mark: str) -> Column:
        return F.substr(text, F.instr(text, mark) + F.lit(len(mark)))

    def between(mark: str, end: str) -> Column:
        rest = after(output, mark)
        return F.substr(rest, F.lit(1), F.instr(rest, end) - F.lit(1))

    middle = after(output, markers.middle)
    psm = F.concat(between(markers.prefix, markers.suffix), middle, between(markers.suffix, markers.middle))
    spm = F.concat(between(markers.prefix, markers.middle), middle, between(markers.suffix, markers.prefix))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
