"""Text functions as column expressions; all stay on the JVM."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Token estimate, limits of truncation and pages.
CHARS_PER_TOKEN = 4
MAX_LINES, MAX_BYTES, MAX_LINE = 2_000, 51_200, 2_000
PUNCTUATION = {"‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "‟": '"', "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", " ": " "}


def like_escape(s: Column) -> Column:
    """A needle whose LIKE wildcards stand for themselves; the backslash is escaped first."""
    for c in ("\\", "%", "_"):
        s = F.replace(s, F.lit(c), F.lit("\\" + c))
    return s


def snippet(text: Column, needle: str, radius: int = 50) -> Column:
    """The surroundings of the first hit, between ellipses; without a hit the start of the text."""
    at = F.locate(needle.lower(), F.lower(text))
    start = F.greatest(at - radius, F.lit(1))
    hit = F.substring(text, start, at - start + len(needle) + radius)
    return F.when(at > 0, F.concat(F.lit("…"), hit, F.lit("…"))).otherwise(F.substring(text, 1, 2 * radius))


def collapse_blanks(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def dedent(s: Column) -> Column:
    """Lines without the indent that all lines with content share."""
    lines = F.split(s, "\n")
    widths = F.transform(F.filter(lines, lambda x: F.trim(x) != ""), lambda x: F.length(x) - F.length(F.regexp_replace(x, r"^\s+", "")))
    least = F.coalesce(F.array_min(widths), F.lit(0))
    return F.array_join(F.transform(lines, lambda x: F.when(F.trim(x) == "", x).otherwise(F.substring(x, least + 1, F.length(x)))), "\n")


def unescape(s: Column) -> Column:
    """Backslash sequences for line feed, tab, return, quotes, backtick, dollar and backslash, resolved in one reading."""
    keep = ""
    s = F.replace(s, F.lit("\\\\"), F.lit(keep))
    for code, char in (("n", "\n"), ("t", "\t"), ("r", "\r"), ("'", "'"), ('"', '"'), ("`", "`"), ("$", "$")):
        s = F.replace(s, F.lit("\\" + code), F.lit(char))
    return F.replace(s, F.lit(keep), F.lit("\\"))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; two empty texts are alike."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def plain_punctuation(s: Column) -> Column:
    """Typographic quotes, dashes and blanks as ASCII."""
    s = F.translate(s, "".join(PUNCTUATION), "".join(PUNCTUATION.values()))
    return F.replace(s, F.lit("…"), F.lit("..."))


def token_estimate(s: Column) -> Column:
    units = F.octet_length(F.encode(s, "UTF-16BE")) / 2
    return F.floor(units / CHARS_PER_TOKEN + 0.5).cast("long")


def truncate_head(s: Column, lines: int = MAX_LINES, most_bytes: int = MAX_BYTES) -> Column:
    """The first lines within both limits; bytes count a line feed per line after the first."""
    first = F.slice(F.split(s, "\n"), 1, lines)
    fits = F.aggregate(
        first,
        F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("n"), F.lit(True).alias("open")),
        lambda a, x: F.struct(
            (a["bytes"] + F.octet_length(x) + F.when(a["n"] > 0, 1).otherwise(0)).alias("bytes"),
            F.when(a["open"] & (a["bytes"] + F.octet_length(x) + F.when(a["n"] > 0, 1).otherwise(0) <= most_bytes), a["n"] + 1).otherwise(a["n"]).alias("n"),
            (a["open"] & (a["bytes"] + F.octet_length(x) + F.when(a["n"] > 0, 1).otherwise(0) <= most_bytes)).alias("open"),
        ),
        lambda a: a["n"],
    )
    return F.array_join(F.slice(first, F.lit(1), fits), "\n")


def grep(text: Column, pattern: str) -> Column:
    """Matching lines as an array of (line from 1, text cut at MAX_LINE)."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda x, i: F.struct((i + 1).alias("line"), x.alias("text")))
    cut = lambda x: F.when(F.length(x) > MAX_LINE, F.concat(F.substring(x, 1, MAX_LINE), F.lit("..."))).otherwise(x)
    hits = F.filter(lines, lambda x: F.regexp_like(x["text"], F.lit(pattern)))
    return F.transform(hits, lambda x: F.struct(x["line"].alias("line"), cut(x["text"]).alias("text")))


def wildcard_regex(pattern: str) -> str:
    """A pattern with ``*`` and ``?`` as a regex over the whole text; a final `` *`` may be missing."""
    import re

    body = re.escape(pattern).replace(r"\*", ".*").replace(r"\?", ".")
    if body.endswith(r"\ .*"):
        body = body[: -len(r"\ .*")] + r"(\ .*)?"
    return f"(?s)^{body}$"


def fork_title(title: Column) -> Column:
    n = F.regexp_extract(title, r"\(fork #(\d+)\)$", 1)
    base = F.regexp_replace(title, r" \(fork #\d+\)$", "")
    return F.when(n == "", F.concat(title, F.lit(" (fork #1)"))).otherwise(F.concat(base, F.lit(" (fork #"), (n.cast("long") + 1).cast("string"), F.lit(")")))


def csv_cell(s: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(s.rlike('[",\n]'), quoted).otherwise(s)


def key_prefix(s: Column, kind: str = "sk_") -> Column:
    """The prefix part of an API key ``{kind}{env}_{prefix}_...``, at most ten characters; null for other texts."""
    import re

    found = F.regexp_extract(s, rf"^{re.escape(kind)}[^_]+_([^_]{{1,10}})", 1)
    return F.when(found != "", found)


def hash_bucket(s: Column, n: int) -> Column:
    """h * 31 + c over the last four characters in 32-bit arithmetic, unsigned, modulo n."""
    codes = F.transform(F.split(F.right(s, F.lit(4)), ""), lambda x: F.ascii(x).cast("long"))
    h = F.aggregate(F.filter(codes, lambda x: x > 0), F.lit(0).cast("long"), lambda a, x: (a * 31 + x).bitwiseAND(F.lit(0xFFFFFFFF)))
    return h % n


def base64url(b: Column) -> Column:
    return F.rtrim(F.translate(F.base64(b), "+/=", "-_ "))


def utf16_units(s: Column) -> Column:
    """The UTF-16 code units of a text as an array of numbers."""
    h = F.hex(F.encode(s, "UTF-16BE"))
    places = F.when(F.length(h) > 0, F.sequence(F.lit(0), (F.length(h) / 4 - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.conv(F.substring(h, i * 4 + 1, F.lit(4)), 16, 10).cast("long"))


def fnv1a(s: Column) -> Column:
    """The 32-bit FNV-1a hash over UTF-16 units, unsigned."""
    return F.aggregate(utf16_units(s), F.lit(2_166_136_261), lambda h, c: (h.bitwiseXOR(c) * 16_777_619) % (1 << 32))


def fnv1a_base36(s: Column) -> Column:
    """:func:`fnv1a` in base 36; null for an empty text."""
    return F.when(s != "", F.lower(F.conv(fnv1a(s).cast("string"), 10, 36)))


def sampled_checksum(s: Column, limit: int = 500_000, size: int = 4_096) -> Column:
    """The checksum of a text, or for one over ``limit`` its length and those of five pieces of it."""
    n = F.length(s)

    def piece(point: Column) -> Column:
        start = F.greatest(F.lit(0), F.least(n - size, F.floor(point) - size // 2)).cast("int")
        return F.coalesce(fnv1a_base36(F.substring(s, start + 1, F.lit(size))), F.lit(""))

    points = [F.lit(0), n * 0.25, n * 0.5, n * 0.75, n - size]
    return F.when(n <= limit, fnv1a_base36(s)).otherwise(F.concat(n.cast("string"), F.lit(":"), F.concat_ws(":", *map(piece, points))))


def chunk_count(text: Column, size: int = 400, overlap: int = 50) -> Column:
    """How many windows ``chunks`` cuts a text into, from its number of words alone."""
    n = F.regexp_count(text, F.lit(r"\S+"))
    return F.when(n <= size, 1).when(n > size, F.floor((n - 1) / max(size - overlap, 1)).cast("int") + 1)


def chunks(text: Column, size: int = 400, overlap: int = 50) -> Column:
    """Windows of words as (chunk_idx, chunk_offset, chunk_text); a chunk ends where the next word after it starts.

    Words are runs of anything but white space. Windows go on by size - overlap words, at least one, until words run
    out; a text of up to ``size`` words is one chunk, itself.
    """
    step = max(size - overlap, 1)
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)\S+\s*"), F.lit(0))
    lead = F.length(F.regexp_extract(text, r"^\s*", 0))

    def windows(p: Column) -> Column:
        whole = F.array(F.struct(F.lit(0).alias("chunk_idx"), F.lit(0).alias("chunk_offset"), text.alias("chunk_text")))
        starts = F.sequence(F.lit(0), F.greatest(F.size(p) - 1, F.lit(0)), F.lit(step))
        # A window's offset is the sum of the steps before it, each joined once.
        lengths = F.transform(starts, lambda s: F.length(F.array_join(F.slice(p, s + 1, step), "")))
        first = F.array(F.struct(F.lit(0).alias("i"), lead.alias("at")))
        offsets = F.aggregate(lengths, first, lambda a, n: F.concat(a, F.array(F.struct(F.size(a).alias("i"), (F.element_at(a, -1)["at"] + n).alias("at")))))
        cut = F.transform(
            F.slice(offsets, F.lit(1), F.size(starts)),
            lambda o: F.struct(
                o["i"].alias("chunk_idx"), o["at"].alias("chunk_offset"), F.array_join(F.slice(p, o["i"] * step + 1, size), "").alias("chunk_text")
            ),
        )
        return F.when(F.size(p) <= size, whole).otherwise(cut)

    # The words are bound once, so that windows do not split the text again.
    return F.transform(F.array(pieces), windows)[0]


def preview(s: Column, length: int = 500) -> Column:
    return F.substring(s, 1, length)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Everything before the last slash; ``.`` where there is none."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(".")


def trim_diff(diff: Column) -> Column:
    """A diff whose body lines lose the indent that all body lines with content share; headers stay."""
    lines = F.split(diff, "\n")
    body = lambda x: x.rlike(r"^[-+ ]") & ~x.rlike(r"^(---|\+\+\+)")
    content = F.filter(lines, lambda x: body(x) & (F.trim(F.regexp_replace(F.substring(x, 2, F.length(x)), r"\s", " ")) != ""))
    widths = F.transform(content, lambda x: F.length(F.regexp_extract(x, r"^.(\s*)", 1)))
    least = F.coalesce(F.array_min(widths), F.lit(0))

    def cut(n: Column) -> Column:
        short = F.transform(lines, lambda x: F.when(body(x), F.concat(F.substring(x, 1, 1), F.substring(x, n + 2, F.length(x)))).otherwise(x))
        return F.when(n == 0, diff).otherwise(F.array_join(short, "\n"))

    return F.transform(F.array(least), cut)[0]


def truncated(s: Column, lines: int = MAX_LINES, most_bytes: int = MAX_BYTES, tail: bool = False) -> Column:
    """struct(kept, removed, unit): what stays of a text within both limits, from its start or its end, and what went.

    Bytes count a line feed for each line after the first one kept. ``unit`` is ``bytes`` where they ended it, else
    ``lines``; nothing removed gives 0 and null.
    """
    every = F.split(s, "\n")
    some = F.slice(F.reverse(every) if tail else every, 1, lines)
    state = F.struct(F.lit(0).cast("long").alias("bytes"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def step(a: Column, x: Column) -> Column:
        size = a["bytes"] + F.octet_length(x) + F.when(a["n"] > 0, 1).otherwise(0)
        fits = a["open"] & (size <= most_bytes)
        return F.struct(F.when(fits, size).otherwise(a["bytes"]).cast("long").alias("bytes"), F.when(fits, a["n"] + 1).otherwise(a["n"]).alias("n"), fits.alias("open"))

    def told(a: Column) -> Column:
        kept = F.slice(some, F.lit(1), a["n"])
        whole = F.octet_length(s).cast("long")
        uncut = (F.size(every) <= lines) & (whole <= most_bytes)
        removed = F.when(uncut, F.lit(0).cast("long")).when(a["open"], (F.size(every) - a["n"]).cast("long")).otherwise(whole - a["bytes"])
        unit = F.when(uncut, F.lit(None)).when(a["open"], "lines").otherwise("bytes")
        return F.struct(F.array_join(F.reverse(kept) if tail else kept, "\n").alias("kept"), removed.alias("removed"), unit.alias("unit"))

    return F.aggregate(some, state, step, told)


def read_page(s: Column, offset: int = 1, limit: int = MAX_LINES, most_bytes: int = MAX_BYTES, longest: int = MAX_LINE) -> Column:
    """struct(content, first, last, more): numbered lines from ``offset`` on within the limits; null where it is out of range.

    A line over ``longest`` characters is cut and marked; bytes count one line feed for each line after the first.
    """
    lines = F.split(F.regexp_replace(s, r"\r?\n$", ""), r"\r?\n")
    there = F.when(s == "", 0).otherwise(F.size(lines))
    shown = lambda x: F.when(F.length(x) > longest, F.concat(F.substring(x, 1, longest), F.lit(f"... (line truncated to {longest} chars)"))).otherwise(x)
    page = F.transform(F.slice(lines, offset, limit), shown)
    state = F.struct(F.lit(0).cast("long").alias("bytes"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def step(a: Column, x: Column) -> Column:
        size = a["bytes"] + F.octet_length(x) + F.when(a["n"] > 0, 1).otherwise(0)
        fits = a["open"] & (size <= most_bytes)
        return F.struct(F.when(fits, size).otherwise(a["bytes"]).cast("long").alias("bytes"), F.when(fits, a["n"] + 1).otherwise(a["n"]).alias("n"), fits.alias("open"))

    def told(a: Column) -> Column:
        kept = F.transform(F.slice(page, F.lit(1), a["n"]), lambda x, i: F.concat((i + offset).cast("string"), F.lit(": "), x))
        last = (a["n"] + (offset - 1)).alias("last")
        return F.struct(F.array_join(kept, "\n").alias("content"), F.lit(offset).alias("first"), last, (there > a["n"] + (offset - 1)).alias("more"))

    empty = F.struct(F.lit("").alias("content"), F.lit(offset).alias("first"), F.lit(offset - 1).alias("last"), F.lit(False).alias("more"))
    paged = F.aggregate(page, state, step, told)
    return F.when((there == 0) & F.lit(offset == 1), empty).when(there >= offset, paged)


def wildcard_value(s: Column, patterns: dict[str, str]) -> Column:
    """The value of the last pattern that matches, shorter ones first and equal lengths by name; null if none does."""
    out = F.lit(None).cast("string")
    for p in sorted(patterns, key=lambda p: (len(p), p)):
        out = F.when(s.rlike(wildcard_regex(p)), F.lit(patterns[p])).otherwise(out)
    return out


def _matcher(word: str):
    return lambda x: x.rlike(wildcard_regex(word))


def wildcard_sequence(tokens: Column, pattern: str) -> Column:
    """Whether the tokens match a pattern of words: the first word the first token, the others some later ones in order.

    A word ``*`` takes no token. Taking the first token that matches leaves most for the words behind it.
    """
    head, *rest = pattern.split()
    ok = F.get(tokens, F.lit(0)).rlike(wildcard_regex(head))
    left = F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1)))
    for word in (w for w in rest if w != "*"):
        hit = F.array_position(F.transform(left, _matcher(word)), True)
        ok = ok & (hit > 0)
        left = F.when(hit > 0, F.slice(left, hit.cast("int") + 1, F.greatest(F.size(left), F.lit(1)))).otherwise(F.array().cast("array<string>"))
    return ok


def structured_value(tokens: Column, patterns: dict[str, str]) -> Column:
    """As :func:`wildcard_value` for tokens and patterns of words."""
    out = F.lit(None).cast("string")
    for p in sorted(patterns, key=lambda p: (len(p), p)):
        out = F.when(wildcard_sequence(tokens, p), F.lit(patterns[p])).otherwise(out)
    return out


def glob_regex(glob: str) -> str:
    """A file glob as a regex over a relative path: ``**`` crosses folders, ``*`` and ``?`` do not, ``{a,b}`` are choices."""
    import re

    out, at, depth = "", 0, 0
    while at < len(glob):
        if glob.startswith("**/", at):
            out, at = out + "(?:.*/)?", at + 3
        elif glob.startswith("**", at):
            out, at = out + ".*", at + 2
        else:
            c = glob[at]
            depth += (c == "{") - (c == "}")
            special = {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")"}
            out += "|" if c == "," and depth else special.get(c, re.escape(c))
            at += 1
    return f"^{out}$"


#: What a match of letters in order is worth: each letter, one that follows the one before, one at the start of a word,
#: the whole name; and what each letter in a gap, before the match and behind it costs.
LETTER, RUN, WORD_START, WHOLE, GAP, LEADING, TRAILING = 100, 60, 80, 200, 3, 1, 1
WORD_SIGNS = "/\\\\_-. "


def best_alignment(names: list[str], query: str):
    """The score of the best way to find the letters of a query in order in each name; -1 where there is none.

    Cells (letter of the query, place in the name) hold the best score of a match that ends there; all names and places
    are worked on at once, letter by letter.
    """
    import numpy as np

    low, wanted = [n.lower() for n in names], query.lower()
    if not names or not wanted:
        return np.zeros(len(names), np.int64)
    width = max(max(map(len, low)), 1)
    letters = np.zeros((len(low), width), np.uint32)
    starts = np.zeros((len(low), width), bool)
    for i, (n, name) in enumerate(zip(low, names, strict=True)):
        letters[i, : len(n)] = np.frombuffer(n.encode("utf-32-le"), np.uint32)
        for j, c in enumerate(name[: len(n)]):
            starts[i, j] = j == 0 or name[j - 1] in WORD_SIGNS or (c.isupper() and name[j - 1].islower())
    none = np.int64(-(1 << 40))
    place = np.arange(width)
    worth = LETTER + WORD_START * starts.astype(np.int64)
    best = None
    for c in wanted:
        here = letters == ord(c)
        if best is None:
            found = worth - LEADING * place
        else:
            # The best end of the letters before, any number of places back, less what the gap costs.
            far = np.maximum.accumulate(best + GAP * place, axis=1)[:, :-2] - GAP * (place[2:] - 1) if width > 2 else np.empty((len(low), 0), np.int64)
            found = np.full(letters.shape, none)
            found[:, 1:] = best[:, :-1] + RUN
            found[:, 2:] = np.maximum(found[:, 2:], far)
            found = found + worth
        best = np.where(here & (found > none // 2), found, none)
    lengths = np.array([len(n) for n in low])
    behind = np.maximum(lengths[:, None] - 1 - place, 0)
    score = (best - TRAILING * behind).max(axis=1) + WHOLE * np.array([n == wanted for n in low])
    return np.where(score > none // 2, np.maximum(score, 0), -1)


def fuzzy_score(s: Column, query: str) -> Column:
    """The best alignment's score of a query in each name, -1 where its letters are not all there in order; a null name has none.

    The reference's scorer is a library that is not part of it; the values of LETTER and the rest are our own.
    """
    @F.pandas_udf("long")
    def scored(names: pd.Series) -> pd.Series:
        return pd.Series(best_alignment(["" if n is None else n for n in names], query))

    return F.when(s.isNotNull(), scored(s))


def hidden_path(s: Column) -> Column:
    """Whether a part of a path begins with a dot."""
    parts = F.split(F.regexp_replace(F.replace(s, F.lit("\\"), F.lit("/")), "/+$", ""), "/")
    return F.exists(parts, lambda p: p.startswith(".") & (F.length(p) > 1))


def fuzzy_search(names: DataFrame, column: str, query: str, limit: int = 100, hidden_last: bool = True) -> DataFrame:
    """The names that hold the letters of a query in order, best first with ``score``; equal scores by name.

    Hidden paths come behind all others, unless the query asks for them. An empty query gives the first names.
    """
    query = query.strip()
    prefer = query.startswith(".") or "/." in query or not hidden_last
    kept = names.where(F.col(column).isNotNull()).withColumn("score", fuzzy_score(F.col(column), query)).where("score >= 0")
    order = [F.lit(False) if prefer else hidden_path(F.col(column)), F.desc("score"), F.col(column)]
    return kept.orderBy(*order).limit(limit)


def weighted_bucket(s: Column, weights: dict[str, int]) -> Column:
    """The name that a hash of the last four characters picks from a list in which each name stands as often as its weight."""
    names = [n for n, w in weights.items() for _ in range(w)]
    return F.get(F.array(*[F.lit(n) for n in names]), hash_bucket(s, len(names)).cast("int"))
